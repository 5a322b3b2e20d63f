"""Standard scaling with parameters kept as a table."""

from pyspark.sql import functions as F

from flowloom.sources import scratch

PARAMETERS = ["pos", "feature", "mean", "std_pop", "scale"]


def _one(column):
    return F.when(column == 0, 1.0).otherwise(column)


def _stats(df, columns, by):
    """(by..., n, pos, feature, mean, std_pop), one row per group and feature."""
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
    )
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("pos"),
                    F.lit(c).alias("feature"),
                    F.col(f"m_{i}").alias("mean"),
                    F.col(f"s_{i}").alias("std_pop"),
                )
                for i, c in enumerate(columns)
            ]
        )
    )
    return stats.select(*by, "n", entry.alias("e")).select(*by, "n", "e.*")


def fit(df, columns, by=()):
    """(by..., pos, feature, mean, std_pop, scale): one pass over ``df``.

    ``scale`` is 1 for a constant column. With ``by`` (a fold column) every
    group's parameters come from the same pass.
    """
    by = [by] if isinstance(by, str) else list(by)
    stats = _stats(df, columns, by).withColumn("scale", _one(F.col("std_pop")))
    return stats.select(*by, *PARAMETERS)


def apply(df, params, by=()):
    """Scale the columns named in ``params``; one parameter row per feature.

    Without ``by`` the few parameters become literals, so scaling is a plain
    projection. With ``by`` they are one wide row per group, broadcast.
    """
    by = [by] if isinstance(by, str) else list(by)
    if not by:
        rows = params.select("feature", "mean", "scale").collect()
        return df.withColumns(
            {r["feature"]: (F.col(r["feature"]) - r["mean"]) / r["scale"] for r in rows}
        )
    params = scratch.broadcast_if_small(params)
    names = [r[0] for r in params.select("feature").distinct().collect()]
    wide = params.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_m_{c}") for c in names],
        *[F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"_s_{c}") for c in names],
    )
    return (
        df.join(scratch.broadcast_if_small(wide), by)
        .withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in names})
        .select(*df.columns)
    )


def apply_to_vector(df, params, features="features"):
    """Scale an array column; positions follow ``pos`` of the parameters.

    A vector of another width than the parameters is an error.
    """
    rows = params.orderBy("pos").select("mean", "scale").collect()
    fits = F.assert_true(F.size(features) == len(rows), f"a vector has other than {len(rows)} values")
    means = F.array(*[F.lit(float(r["mean"])) for r in rows])
    scales = F.array(*[F.lit(float(r["scale"])) for r in rows])
    vector = F.when(fits.isNull(), F.col(features))
    pairs = F.arrays_zip(vector.alias("x"), means.alias("m"), scales.alias("s"))
    return df.withColumn(features, F.transform(pairs, lambda p: (p["x"] - p["m"]) / p["s"]))


def save(params, path):
    params.write.mode("overwrite").parquet(path)


def load(spark, path):
    """Read saved parameters; an error when the columns are not a scaler's."""
    params = spark.read.parquet(path)
    absent = {"feature", "mean", "scale", "pos"} - set(params.columns)
    if absent:
        raise ValueError(f"not scaler parameters, missing {sorted(absent)}")
    return params


def fit_folds(df, columns, fold="fold"):
    """Parameters per held-out fold, from the rows of all other folds.

    Counts, means and squared deviations of every fold come from one pass; the
    other folds of each fold are then merged on that small table.
    """
    part = scratch.broadcast_if_small(_stats(df, columns, [fold])).select(
        F.col(fold).alias("_f"), "pos", "feature", "n", "mean",
        (F.col("std_pop") * F.col("std_pop") * F.col("n")).alias("m2"),
    )
    held = part.select(F.col("_f").alias(fold), "feature")
    pairs = part.join(held, "feature").filter(F.col("_f") != F.col(fold))
    centre = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    merged = pairs.groupBy(fold, "pos", "feature").agg(
        F.sum("n").alias("rows"), centre.alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("_parts"),
    )
    spread = F.aggregate(
        "_parts",
        F.lit(0.0),
        lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")),
    )
    return (
        merged.withColumn("std_pop", F.sqrt(spread / F.col("rows")))
        .withColumn("scale", _one(F.col("std_pop")))
        .select(fold, *PARAMETERS)
    )
