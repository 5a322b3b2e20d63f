"""Repeatable samples, balancing and class weights.

Rows are ordered by a hash of their key, so a sample is the same on every run
and exact sizes are cut without shuffling the table (ordering.segments).
"""

import math

from pyspark.sql import functions as F

from flowloom.functions.hashing import order_hash, uniform
from flowloom.operators.ordering import segments, shuffled_ordinal
from flowloom.sources import scratch


def exact_n(df, key, n, per=(), seed=42):
    """The first n rows in hash order, per stratum.

    ``n`` is a number, or a function from the stratum's row count (a column;
    the ``per`` columns are in scope) to a column.
    """
    want = n if callable(n) else (lambda _: F.lit(n))
    return (
        segments(df, key, lambda size: [want(size)], per, seed, "_seg")
        .filter(F.col("_seg") == 0)
        .drop("_seg")
    )


def per_class(label, counts):
    """A size rule for ``exact_n`` from {class: n}; other classes are kept whole."""

    def want(size):
        rule = size
        for value, n in counts.items():
            rule = F.when(F.col(label) == value, F.lit(n)).otherwise(rule)
        return rule

    return want


def fraction(df, key, share, seed=42):
    """Rows whose hash falls below ``share``: a narrow filter."""
    return df.filter(uniform(key, seed) < share)


def shuffle(df, key, seed=42):
    """All rows in hash order (a range-partitioned sort)."""
    return df.withColumn("_h", order_hash(key, seed)).orderBy("_h", key).drop("_h")


def renumber(df, key, seed=42, name="flow_id"):
    return shuffled_ordinal(df, key, (), seed, name)


def ratio_per_file(df, key, share, file="source_file", label="label", seed=42):
    """max(1, int(n * share)) rows of every class of every file.

    ``share`` is a number or {class: number}.
    """

    def want(size):
        part = F.lit(share) if not isinstance(share, dict) else F.lit(0.0)
        if isinstance(share, dict):
            for value, x in share.items():
                part = F.when(F.col(label) == value, F.lit(x)).otherwise(part)
        return F.greatest(F.lit(1), F.floor(size * part))

    return exact_n(df, key, want, (file, label), seed)


def class_counts(df, label="label"):
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def trim_total(df, key, total, attack_share=0.3, label="label", seed=42):
    """Cut to ``total`` rows at the given attack share when there are more."""
    counts = class_counts(df, label)
    if sum(counts.values()) <= total:
        return df
    attack = int(total * attack_share)
    return exact_n(df, key, per_class(label, {0: total - attack, 1: attack}), (label,), seed)


def balanced(df, key, total, attack_share=0.3, label="label", seed=42):
    """A sample at a fixed attack share; too few attacks shrink the benign part."""
    counts = class_counts(df, label)
    attack = int(total * attack_share)
    benign = total - attack
    if counts.get(1, 0) < attack:
        attack = counts.get(1, 0)
        benign = int(attack * (1 - attack_share) / attack_share)
    return exact_n(df, key, per_class(label, {0: benign, 1: attack}), (label,), seed)


def under_sample(df, key, target=None, label="label", seed=42):
    """Cut classes to ``target`` rows each; by default to the smallest class."""
    if target is None:
        counts = class_counts(df, label)
        target = {c: min(counts.values()) for c in counts}
    return exact_n(df, key, per_class(label, target), (label,), seed)


def class_weights(df, label="label", scale=None):
    """(label, n, weight) with weight n_rows / (n_classes * n), times ``scale``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    weight = F.lit(float(total["t"] or 0)) / (F.lit(total["k"]) * F.col("n"))
    for value, factor in (scale or {}).items():
        weight = F.when(F.col(label) == value, weight * factor).otherwise(weight)
    return counts.withColumn("weight", weight)


def fixed_weights(df, weights, label="label", name="weight"):
    value = F.lit(1.0)
    for c, w in weights.items():
        value = F.when(F.col(label) == c, F.lit(float(w))).otherwise(value)
    return df.withColumn(name, value)


def replicate(df, key, weights, label="label", seed=42, name="copy"):
    """Every row as often as a Poisson number with its class's weight as mean says.

    The number is read from a hash of the key, so it is the same on every run, and
    learners without weights then see each class about ``weight`` times. ``name`` counts a
    row's copies from 0. A row of a class without a weight stays once, a row without a
    label too.
    """
    u = uniform(key, seed)
    copies = F.lit(1)
    for value, weight in weights.items():
        term = total = math.exp(-weight)
        reached, steps = [], 0
        # The hash has 32 bits.
        while 1.0 - total > 2.0**-32 and steps < 40 + 4 * weight:
            reached.append(total)
            steps += 1
            term *= weight / steps
            total += term
        count = sum(((u >= c).cast("int") for c in reached), F.lit(0))
        copies = F.when(F.col(label) == value, count).otherwise(copies)
    made = df.withColumn(name, F.expr("0")).withColumn("_copies", copies).filter("_copies > 0")
    return made.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")


def balanced_weights(df, label="label"):
    """{class: weight}: rows / (classes * rows of the class)."""
    return {r[label]: r["weight"] for r in class_weights(df.filter(F.col(label).isNotNull()), label).collect()}


def smote(df, key, features, counts, k=5, label="label", seed=42, **search):
    """Raise classes to ``counts`` rows with points between near neighbours.

    The i-th new row of a class starts from its (i mod n)-th row in hash
    order, so a class with n rows yields ceil(missing / n) rounds over all of
    them; neighbour and position are read from hashes. ``search`` goes to ``knn_edges``.
    """
    from flowloom.operators.neighbours import knn_edges

    have = class_counts(df, label)
    made = []
    for value, want in counts.items():
        missing = want - have.get(value, 0)
        if missing <= 0 or not have.get(value):
            continue
        rows = scratch.materialise(df.filter(F.col(label) == value), "smote")
        near = knn_edges(rows, key, features, k, metric="euclidean", **search).select(
            F.col("src").alias(key), "rank", F.col("dst")
        )
        degree = min(k, have[value] - 1)
        if degree < 1:
            raise ValueError(f"class {value} needs two rows to be over-sampled")
        n = have[value]
        base = shuffled_ordinal(rows.select(key, features), key, (), seed, "_o")
        repeats = F.expr(f"cast(ceil(({missing} - _o) / {n}) as int)")
        base = (
            base.filter(F.col("_o") < missing)
            .withColumn("_round", F.explode(F.sequence(F.lit(0), repeats - 1)))
            .withColumn("_pick", F.concat_ws("|", F.col(key).cast("string"), F.col("_round")))
            .withColumn("rank", F.floor(uniform("_pick", seed) * degree).cast("int") + 1)
            .withColumn("_u", uniform("_pick", seed + 1))
        )
        other = rows.select(F.col(key).alias("dst"), F.col(features).alias("_to"))
        mixed = F.zip_with(features, "_to", lambda a, b: a + (b - a) * F.col("_u"))
        made.append(
            base.join(near, [key, "rank"])
            .join(other, "dst")
            .select(
                F.col(key),
                mixed.alias(features),
                F.lit(value).cast(df.schema[label].dataType).alias(label),
                F.lit(True).alias("synthetic"),
            )
        )
    out = df.select(key, features, label).withColumn("synthetic", F.lit(False))
    for part in made:
        out = out.unionByName(part)
    return out
