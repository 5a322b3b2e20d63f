"""Exact quantiles of many columns, without holding a column in one task.

An approximate pass brackets each wanted position, a second pass counts the
values inside the bracket (pre-aggregated, so a value shared by a third of the
rows is one row), and only those counts are put in order, in range partitions,
so no bracket and no column has to fit into a task. NaN is no value.
"""

import math
import re

from pyspark.sql import functions as F

from flowloom.operators.ordering import running_totals
from flowloom.sources import scratch


def _value(column):
    """The column as a double, NaN as NULL."""
    number = F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


def exact_quantiles(df, columns, probs, accuracy=10_000):
    """{column: [value per prob]}, linear between neighbours, NULL and NaN skipped.

    Returns None for a column without values.
    """
    columns, probs = list(columns), list(probs)
    margin = 3.0 / accuracy
    marks = sorted({min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)})
    first = df.agg(
        *[F.count(_value(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[
            F.percentile_approx(_value(c), F.array(*[F.lit(m) for m in marks]), F.lit(accuracy)).alias(f"q_{i}")
            for i, c in enumerate(columns)
        ],
    ).first()

    wanted = []
    for i, _ in enumerate(columns):
        n = first[f"n_{i}"]
        if not n:
            continue
        for j, p in enumerate(probs):
            at = (n - 1) * p
            low = first[f"q_{i}"][marks.index(min(1.0, max(0.0, p - margin)))]
            high = first[f"q_{i}"][marks.index(min(1.0, max(0.0, p + margin)))]
            if p - margin <= 0:
                low = None
            if p + margin >= 1:
                high = None
            wanted.append((i, j, math.floor(at), math.ceil(at), at - math.floor(at), low, high))

    found = _values_at(df, columns, wanted)
    missing = [w for w in wanted if (w[0], w[1]) not in found]
    if missing:
        found.update(_values_at(df, columns, [(*w[:5], None, None) for w in missing]))
    return {
        c: [found[(i, j)] for j in range(len(probs))] if first[f"n_{i}"] else None
        for i, c in enumerate(columns)
    }


def _values_at(df, columns, wanted):
    if not wanted:
        return {}
    below, entries = [], []
    for w, (i, _, _, _, _, low, high) in enumerate(wanted):
        value = _value(columns[i])
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= F.lit(low))
            below.append(F.count_if(value < F.lit(low)).alias(f"b_{w}"))
        else:
            below.append(F.lit(0).cast("long").alias(f"b_{w}"))
        if high is not None:
            inside = inside & (value <= F.lit(high))
        entries.append(
            F.when(inside, F.struct(F.lit(w).alias("w"), value.alias("v")))
        )
    offsets = df.agg(F.count(F.lit(1)).alias("_rows"), *below).first()
    counts = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.w").alias("w"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counts = running_totals(counts, ["w", "v"], ["c"])
    # One row per wanted mark: what the marks before it add to the running total.
    totals = {r["w"]: r["n"] for r in counts.groupBy("w").agg(F.sum("c").alias("n")).collect()}
    ahead = F.lit(0).cast("long")
    for w in range(len(wanted)):
        ahead = F.when(F.col("w") == w, F.lit(sum(totals.get(i, 0) for i in range(w)))).otherwise(ahead)
    counts = counts.withColumn("upto", F.col("c_upto") - ahead)
    position = F.lit(None).cast("long")
    ceiling = F.lit(None).cast("long")
    for w, (_, _, floor_at, ceil_at, *_rest) in enumerate(wanted):
        base = offsets[f"b_{w}"]
        position = F.when(F.col("w") == w, F.lit(floor_at - base)).otherwise(position)
        ceiling = F.when(F.col("w") == w, F.lit(ceil_at - base)).otherwise(ceiling)
    start = F.col("upto") - F.col("c")
    hits = (
        counts.groupBy("w")
        .agg(
            F.max(F.when((start <= position) & (position < F.col("upto")), F.col("v"))).alias("a"),
            F.max(F.when((start <= ceiling) & (ceiling < F.col("upto")), F.col("v"))).alias("b"),
        )
        .collect()
    )
    found = {}
    for row in hits:
        i, j, _, _, weight, _, _ = wanted[row["w"]]
        if row["a"] is not None and row["b"] is not None:
            found[(i, j)] = row["a"] + (row["b"] - row["a"]) * weight
    return found


class FileSketches:
    """KLL sketches of columns per file, kept as a table, merged for any quantile.

    ``read`` opens a list of paths as a table of numbers. ``add`` sketches only the files
    that the table does not hold, in one job, grouped by file; a table of few kilobytes a
    file and column is all that later calls read. Ranks are off by about ``2.3 / k ** 0.9``
    of the rows at most (``rank_error``), nearly always; a merged sketch keeps that bound.
    Sketches are made with random choices: two calls may differ within the bound.
    """

    def __init__(self, spark, read, columns, path=None, k=800):
        self.spark, self.read, self.columns, self.k = spark, read, list(columns), k
        self.path = path or scratch.new_path(spark, "sketches")

    @property
    def rank_error(self):
        """The normalised rank error that nineteen in twenty columns stay within, as of the published fit, doubled."""
        return 2 * 2.296 / self.k**0.9021

    def table(self):
        """(file, column, sketch) of the files added so far, or None."""
        system, target = scratch.filesystem(self.spark, self.path)
        if not system.exists(target):
            return None
        return self.spark.read.schema("file string, column string, sketch binary").parquet(self.path)

    def _name(self, path):
        """A path as the scan names it, but for the slashes after the scheme."""
        system, target = scratch.filesystem(self.spark, path)
        return re.sub(r"^(\w+):/+", r"\1:/", system.makeQualified(target).toUri().toString())

    def add(self, paths):
        """Sketch the files of ``paths`` that are new; returns how many were."""
        held = self.table()
        known = set() if held is None else {r["file"] for r in held.select("file").distinct().collect()}
        new = {n: p for p in paths if (n := self._name(p)) not in known}
        if not new:
            return 0
        file = F.regexp_replace(F.input_file_name(), r"^(\w+):/+", "$1:/")
        rows = self.read(list(new.values())).select(file.alias("file"), *self.columns)
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _value(c).alias("value")) for c in self.columns]))
        values = rows.select("file", stack.alias("e")).select("file", "e.column", "e.value").filter("value is not null")
        made = values.groupBy("file", "column").agg(F.kll_sketch_agg_double("value", F.lit(self.k)).alias("sketch"))
        # A file without values is remembered too.
        names = self.spark.createDataFrame([(n,) for n in new], "file string")
        made.join(names, "file", "right").select("file", "column", "sketch").write.mode("append").parquet(self.path)
        return len(new)

    def quantiles(self, probs):
        """{column: [value per prob]} over all added files; None for a column without values."""
        merged = self.table().filter("sketch is not null").groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("s"))
        found = merged.select("column", *[F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])
        values = {r["column"]: [r[f"q{i}"] for i in range(len(probs))] for r in found.collect()}
        return {c: values.get(c) for c in self.columns}
