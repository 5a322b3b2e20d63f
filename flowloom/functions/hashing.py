"""Repeatable pseudo-random order from a row's key."""

from pyspark.sql import functions as F


def _names(key):
    return [key] if isinstance(key, str) else list(key)


def order_hash(key, seed=42):
    """Hex digest of key and seed; sorting by it shuffles the rows."""
    parts = [F.col(k).cast("string") for k in _names(key)]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def uniform(key, seed=42):
    """A number in [0, 1) per key, the same on every run."""
    head = F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)


def stratum(columns):
    """One text key for a set of columns that keeps NULL apart from values."""
    if not columns:
        return F.lit("")
    return F.concat_ws(
        "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    )
