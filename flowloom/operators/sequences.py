"""Fixed-length sequences of consecutive rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.operators.ordering import sorted_ordinal


def tumbling(df, order_by, columns, label="label", n=10, per=(), ordinal=None):
    """(per..., seq_id, steps, label): consecutive groups of n rows.

    The remainder is dropped; a sequence takes the label of its last row.
    With ``ordinal`` the rows already carry their position.
    """
    per = [per] if isinstance(per, str) else list(per)
    placed = df
    if ordinal is None:
        ordinal = "_o"
        placed = sorted_ordinal(df, order_by, per, ordinal)
    row = F.struct(F.col(ordinal).alias("o"), F.array(*columns).alias("x"))
    return (
        placed.withColumn("seq_id", F.floor(F.col(ordinal) / n))
        .groupBy(*per, "seq_id")
        .agg(
            F.array_sort(F.collect_list(row)).alias("_rows"),
            F.max_by(label, ordinal).alias(label),
        )
        .filter(F.size("_rows") == n)
        .select(*per, "seq_id", F.col("_rows.x").alias("steps"), label)
    )


def sliding(df, key, order_by, features, n=10, chunk=20_000, name="buffer"):
    """Adds the last n vectors of the row's key, the row itself being last.

    Rows are numbered in (key, order) and cut into even chunks whatever the
    key sizes are; each chunk borrows the n - 1 rows before it, so a chunk has
    at least that many.
    """
    if chunk < n - 1:
        raise ValueError(f"a chunk of {chunk} rows cannot lend {n - 1}")
    key = [key] if isinstance(key, str) else list(key)
    placed = sorted_ordinal(df, [*key, *order_by], (), "_o").withColumn(
        "_c", F.floor(F.col("_o") / chunk)
    )
    tail = placed.filter(F.col("_o") % chunk >= chunk - (n - 1))
    both = placed.withColumn("_lent", F.lit(False)).unionByName(
        tail.withColumn("_c", F.col("_c") + 1).withColumn("_lent", F.lit(True))
    )
    frame = Window.partitionBy("_c").orderBy("_o").rowsBetween(-(n - 1), 0)
    mine = F.struct(*[F.col(c) for c in key]).alias("k") if key else F.lit(0).alias("k")
    owner = F.struct(*[F.col(c) for c in key]) if key else F.lit(0)
    return (
        both.withColumn("_last", F.collect_list(F.struct(mine, F.col(features).alias("x"))).over(frame))
        .filter(~F.col("_lent"))
        .withColumn("_k", owner)
        .withColumn("_own", F.filter("_last", lambda e: e["k"] == F.col("_k")))
        .withColumn(name, F.col("_own.x"))
        .select(*df.columns, name)
    )


def pad_zero(df, width, n=10, name="buffer"):
    """Zero vectors after the real rows until there are n."""
    zero = F.array(*[F.lit(0.0)] * width)
    return df.withColumn(
        name, F.concat(F.col(name), F.array_repeat(zero, F.lit(n) - F.size(name)))
    )


def buffer_mean(name, width):
    """Mean vector of an array of vectors."""

    def mean(i):
        return F.aggregate(name, F.lit(0.0), lambda s, x: s + x[i]) / F.size(name)

    return F.array(*[mean(i) for i in range(width)])


def pad_mean(df, width, n=10, name="buffer"):
    """The buffer's mean vector after the real rows until there are n."""
    missing = F.greatest(F.lit(0), F.lit(n) - F.size(name))
    return df.withColumn(
        name, F.concat(F.col(name), F.array_repeat(buffer_mean(name, width), missing))
    )


def as_steps(df, features="features", name="steps"):
    """Every feature is a step of its own."""
    return df.withColumn(name, F.transform(features, lambda x: F.array(x)))


def equal_steps(df, width, steps=10, features="features", name="steps"):
    """One vector of ``width`` features cut into equal steps.

    The last step is filled up with zeros when ``steps`` does not divide
    ``width``. A vector of another width is an error.
    """
    size = -(-width // steps)
    fits = F.assert_true(F.size(features) == width, f"features of other than {width} values")
    zeros = F.array(*[F.lit(0.0)] * (size * steps - width)).cast("array<double>")
    whole = F.concat(F.when(fits.isNull(), F.col(features)), zeros)
    return df.withColumn(
        name,
        F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(whole, i * size + 1, size)),
    )
