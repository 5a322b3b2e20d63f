"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import functions as F

from flowloom.sources import scratch

SHARE = 0.001
MIN_ROWS = 1_000_000


def hot_keys(facts, on, share=SHARE, min_rows=MIN_ROWS):
    """(on..., _salts): keys with more than ``share`` of the rows and over ``min_rows`` rows.

    There are at most ``1 / share`` of them, so the list is safe to send to
    every task. A key is to be cut into parts of ``min_rows`` rows. None when
    there is no such key.
    """
    on = [on] if isinstance(on, str) else list(on)
    sizes = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
    total = facts.count()
    if total <= min_rows:
        return None
    floor = max(total * share, min_rows)
    found = sizes.filter(F.col("_c") > floor).select(*on, F.ceil(F.col("_c") / min_rows).cast("int").alias("_salts"))
    rows = found.collect()
    if not rows:
        return None
    return facts.sparkSession.createDataFrame(rows, found.schema)


FIND = object()


def skew_join(facts, lookup, on, how="inner", hot=FIND):
    """Join ``facts`` to ``lookup`` (one row per key), salting only hot keys.

    Rows of a hot key are spread over as many parts as its count asks for and
    its lookup row is copied as often. ``hot`` may carry the result of
    ``hot_keys``.
    """
    on = [on] if isinstance(on, str) else list(on)
    if hot is FIND:
        hot = hot_keys(facts, on)
    if hot is None:
        return facts.join(lookup, on, how)
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*facts.columns), F.col("_salts")).cast("int")
    left = facts.join(hot, on, "left").withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_salts")
    copies = F.coalesce(F.sequence(F.lit(0), F.col("_salts") - 1), F.array(F.lit(0)))
    right = lookup.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(facts, lookup, on, how="inner"):
    """Join to a narrow lookup table: broadcast when small, else salted."""
    small = scratch.broadcast_if_small(lookup)
    if small is not lookup:
        return facts.join(small, on, how)
    return skew_join(facts, scratch.materialise(lookup, "lookup"), on, how)
