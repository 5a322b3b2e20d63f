"""Global positions without a single-task window.

``shuffled_ordinal`` and ``segments`` order rows by a hash, so fixed prefixes
of the hash are evenly filled buckets whatever the data looks like: positions
are a small table of bucket offsets plus a rank inside one bucket.
``sorted_ordinal`` orders by values, with range partitions as buckets.
``first_per`` cuts at a position found in histograms, so that few rows are ordered.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.hashing import order_hash, stratum
from flowloom.sources import scratch


def _hashed(df, key, per, seed, digits):
    return (
        df.withColumn("_h", order_hash(key, seed))
        .withColumn("_b", F.substring("_h", 1, digits))
        .withColumn("_s", stratum(per))
    )


def _bucket_starts(hashed, per):
    counts = hashed.groupBy("_s", "_b").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in per]
    )
    before = Window.partitionBy("_s").orderBy("_b")
    return counts.withColumn("_start", F.sum("_c").over(before) - F.col("_c")).withColumn(
        "_n", F.sum("_c").over(Window.partitionBy("_s"))
    )


def _key(key):
    return [key] if isinstance(key, str) else list(key)


def shuffled_ordinal(df, key, per=(), seed=42, name="ordinal", digits=4):
    """Number rows 0..n-1 (within ``per``) in hash order of ``key``.

    ``key`` must tell rows apart. ``digits`` hex digits give 16**digits
    buckets; raise it when a bucket outgrows one task.
    """
    hashed = _hashed(df, key, per, seed, digits)
    starts = _bucket_starts(hashed, per).select("_s", "_b", "_start")
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", *_key(key)))
    return (
        hashed.withColumn("_r", rank - 1)
        .join(starts, ["_s", "_b"])
        .withColumn(name, F.col("_start") + F.col("_r"))
        .select(*df.columns, name)
    )


def segments(df, key, bounds, per=(), seed=42, name="segment", digits=4):
    """Cut each stratum, in hash order, at exact positions.

    ``bounds`` maps the stratum's row count (a column; the ``per`` columns may
    be used too) to a list of rising positions. A row gets the number of
    bounds at or before its position. Only the buckets that a bound falls into
    are ranked; every other row is placed by comparing its hash prefix, so the
    table itself is not shuffled.
    """
    hashed = _hashed(df, key, per, seed, digits)
    starts = _bucket_starts(hashed, per)
    limits = [b.cast("long") for b in bounds(F.col("_n"))]
    cut = []
    for i, limit in enumerate(limits):
        here = (F.col("_start") <= limit) & (limit < F.col("_start") + F.col("_c"))
        cut.append(F.max(F.when(here, F.col("_b"))).alias(f"_cb{i}"))
        cut.append(F.max(F.when(here, limit - F.col("_start"))).alias(f"_need{i}"))
    plan = starts.groupBy("_s").agg(*cut)
    if per:
        placed = hashed.join(scratch.broadcast_if_small(plan), "_s")
    else:
        only = plan.first()
        kinds = {f.name: f.dataType for f in plan.schema.fields if f.name != "_s"}
        placed = hashed.withColumns(
            {c: F.lit(only[c] if only else None).cast(t) for c, t in kinds.items()}
        )

    ids = range(len(limits))
    on_cut = F.lit(False)
    for i in ids:
        on_cut = on_cut | F.coalesce(F.col("_b") == F.col(f"_cb{i}"), F.lit(False))

    def passed(i, rank):
        after = F.col("_b") > F.col(f"_cb{i}")
        if rank is not None:
            after = after | ((F.col("_b") == F.col(f"_cb{i}")) & (rank > F.col(f"_need{i}")))
        return F.when(after, 1).otherwise(0)

    def number(rank):
        total = F.lit(0)
        for i in ids:
            total = total + passed(i, rank)
        return total

    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", *_key(key)))
    whole = placed.filter(~on_cut).withColumn(name, number(None))
    split = (
        placed.filter(on_cut).withColumn("_r", rank).withColumn(name, number(F.col("_r")))
    )
    columns = [*df.columns, name]
    return whole.select(*columns).unionByName(split.select(*columns))


def _ranged(df, keys, parts):
    """``df`` in range partitions of ``keys``, written once, with _p and _at of each row."""
    ranged = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return scratch.materialise(ranged, "ordinal").withColumn("_p", F.shiftright("_at", 33))


def sorted_ordinal(df, order_by, per=(), name="ordinal", partitions=None):
    """Number rows 0..n-1 (within ``per``) in the order of ``order_by``.

    ``order_by`` must end in something that tells rows apart, so that a value
    shared by many rows can still be cut between range partitions.
    """
    parts = partitions or scratch.partitions_for(df)
    keys = [F.col("_s"), *[F.col(c) if isinstance(c, str) else c for c in order_by]]
    fixed = _ranged(df.withColumn("_s", stratum(per)), keys, parts)
    counts = fixed.groupBy("_s", "_p").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy("_s").orderBy("_p")
    starts = counts.withColumn("_start", F.sum("_c").over(before) - F.col("_c")).drop("_c")
    return (
        fixed.join(scratch.broadcast_if_small(starts), ["_s", "_p"])
        .withColumn(name, F.col("_start") + F.col("_at") - F.col("_first"))
        .select(*df.columns, name)
    )


def running_totals(df, order_by, sums, partitions=None):
    """Adds ``<column>_upto`` for each column of ``sums``: its total up to the row.

    Rows go to range partitions of ``order_by``, which must tell them apart.
    Each partition adds up its own rows; the only window over all of them has
    one row per partition.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    fixed = _ranged(df, keys, partitions or scratch.partitions_for(df))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    starts = starts.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = fixed.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums})
    return (
        own.join(scratch.broadcast_if_small(starts), "_p")
        .withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_b_{c}") for c in sums})
        .select(*df.columns, *[f"{c}_upto" for c in sums])
    )


def previous(df, order_by, columns, partitions=None):
    """Adds ``<column>_before``: the value of the row before in ``order_by``, NULL for the first."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    fixed = _ranged(df, keys, partitions or scratch.partitions_for(df))
    last = fixed.groupBy("_p").agg(*[F.max_by(F.struct(c), "_at").alias(f"_l_{c}") for c in columns])
    ahead = Window.orderBy("_p")
    ends = last.select("_p", *[F.lag(f"_l_{c}").over(ahead).alias(f"_l_{c}") for c in columns])
    inside = Window.partitionBy("_p").orderBy("_at")
    own = fixed.withColumns({f"_o_{c}": F.lag(F.struct(c)).over(inside) for c in columns})
    joined = own.join(scratch.broadcast_if_small(ends), "_p")
    return joined.withColumns(
        {f"{c}_before": F.coalesce(f"_o_{c}", f"_l_{c}")[c] for c in columns}
    ).select(*df.columns, *[f"{c}_before" for c in columns])


def top_n(df, score, n, key, steps=1_000_000, small=100_000):
    """The n rows with the largest score, ties to the smaller key, for any n.

    Up to ``small`` rows are taken with a bounded heap per task. A longer list
    is cut at the score's histogram of at most ``steps`` rows: rows above the cut
    step are in, only the rows of that one step are put in order, in range
    partitions. Both ways give the same rows. NULL scores come last.
    """
    order = [F.col(score).desc_nulls_last(), *[F.col(k) for k in _key(key)]]
    if n <= small:
        return df.orderBy(*order).limit(n)
    ends = df.agg(F.min(score), F.max(score)).first()
    low, high = (float(e) if e is not None else 0.0 for e in ends)
    width = (high - low) / steps or 1.0
    step = F.coalesce(F.floor((F.col(score) - low) / width), F.lit(-1)).cast("long")
    placed = df.withColumn("_step", step)
    counts = placed.groupBy("_step").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(F.col("_step").desc()))
    cut = (
        counts.withColumn("_upto", upto)
        .filter(F.col("_upto") >= n)
        .orderBy(F.col("_step").desc())
        .first()
    )
    if cut is None:
        return df
    missing = n - (cut["_upto"] - cut["_c"])
    above = placed.filter(F.col("_step") > cut["_step"]).drop("_step")
    edge = sorted_ordinal(placed.filter(F.col("_step") == cut["_step"]).drop("_step"), order, (), "_at")
    return above.unionByName(edge.filter(F.col("_at") < missing).drop("_at"))


def _height(df, column):
    """A double that never falls as ``column`` rises; None for a kind without one."""
    value, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.TimestampType)):
        return value.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return (F.unix_date(value.cast("date")) * F.lit(86_400.0)) + seconds
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.StringType) and kind.collation == "UTF8_BINARY":
        start = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0")
        return F.conv(start, 16, 10).cast("double")
    return None


def first_per(df, n, order_by, per=(), steps=65_536):
    """The first ``n`` rows of each stratum in the order of ``order_by``, exactly.

    ``order_by`` must tell rows apart. Two passes over its first column, both summed up
    in each task, find the step of at most ``steps`` even ones that the cut falls into.
    Rows below it stay where they are; only rows of that one step are put in order, in
    range partitions. ``df`` is read four times, so write it first where it is costly. A
    first column that is no name of a number, time, date, boolean or text has no steps:
    all rows are put in order. NULL comes first, NaN last, as in any Spark order.
    """
    lead = order_by[0]
    height = _height(df, lead) if isinstance(lead, str) else None
    if height is None:
        return sorted_ordinal(df, order_by, per, "_at").filter(F.col("_at") < n).drop("_at")
    placed = df.withColumn("_s", stratum(per)).withColumn("_v", height)
    plain = ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    ends = placed.groupBy("_s").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(plain, F.col("_v"))).alias("_low"), F.max(F.when(plain, F.col("_v"))).alias("_high")
    )
    ends = scratch.materialise(ends.filter(F.col("_n") > n), "ends")
    width = F.col("_high") / steps - F.col("_low") / steps
    inner = F.when(width > 0, F.floor(F.col("_v") / width - F.col("_low") / width)).otherwise(0)
    step = (
        F.when(F.col("_v").isNull(), -2)
        .when(F.isnan("_v"), steps + 2)
        .when(F.abs("_v") == float("inf"), F.when(F.col("_v") < 0, -1).otherwise(steps + 1))
        .otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(steps)))
        .cast("long")
    )
    marked = placed.join(scratch.broadcast_if_small(ends), "_s", "left").withColumn("_step", step)
    counts = marked.filter("_n is not null").groupBy("_s", "_step").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_s").orderBy("_step"))
    cuts = (
        counts.withColumn("_upto", upto)
        .filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_c") < n))
        .select("_s", F.col("_step").alias("_cut"), (F.lit(n) - F.col("_upto") + F.col("_c")).alias("_missing"))
    )
    cuts = scratch.broadcast_if_small(scratch.materialise(cuts, "cuts"))
    near = marked.join(cuts, "_s", "left")
    whole = F.col("_n").isNull() | (F.col("_step") < F.col("_cut"))
    edge = near.filter(F.col("_step") == F.col("_cut")).select(*df.columns, "_s", "_missing")
    edge = sorted_ordinal(edge, order_by, ("_s",), "_at").filter(F.col("_at") < F.col("_missing"))
    return near.filter(whole).select(*df.columns).unionByName(edge.select(*df.columns))
