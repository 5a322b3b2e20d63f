"""Train, validation and test splits as a column."""

from pyspark.sql import functions as F

from flowloom.operators.ordering import segments, sorted_ordinal

NAMES = ("train", "val", "test")


def _named(column, names):
    value = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        value = F.when(column == i, F.lit(names[i])).otherwise(value)
    return value


def _edges(shares, size):
    """Cut positions floor(n * running share), without float drift."""
    # As a long: a count of a few hundred thousand times ten thousand is no int.
    total, out, size = 0.0, [], size.cast("long")
    for share in shares[:-1]:
        total += share
        out.append(F.floor(size * F.lit(int(round(total * 10_000))) / F.lit(10_000)))
    return out


def stratified(df, key, shares=(0.70, 0.15, 0.15), label="label", names=NAMES, seed=42):
    """Every class cut at the same shares, in hash order."""
    cut = segments(df, key, lambda n: _edges(shares, n), (label,), seed, "_seg")
    return cut.withColumn("split", _named(F.col("_seg"), names)).drop("_seg")


def kfold(df, key, k=5, label="label", seed=42, name="fold"):
    """Stratified folds 0..k-1 of equal size up to one row per class."""
    return segments(
        df, key, lambda n: [F.floor(n * i / k) for i in range(1, k)], (label,), seed, name
    )


def temporal(df, time, key, shares=(0.70, 0.15, 0.15), names=NAMES):
    """Cut along time: the first rows train, the last rows test."""
    ordered = sorted_ordinal(df, [time, *([key] if isinstance(key, str) else key)], (), "_o")
    edges = _edges(shares, F.lit(df.count()))
    seg = F.lit(0)
    for edge in edges:
        seg = seg + F.when(F.col("_o") >= edge, 1).otherwise(0)
    return ordered.withColumn("split", _named(seg, names)).drop("_o")
