import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.operators import ordering, sampling, splitting
from flowloom.operators.ordering import segments, shuffled_ordinal, sorted_ordinal, top_n
from flowloom.operators.quantiles import exact_quantiles
from flowloom.operators.skew import hot_keys, skew_join


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one value, one label is rare, one is NULL."""
    value = F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 101).cast("double"))
    label = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 5 == 0, 1).otherwise(0)
    return spark.range(3000).select("id", value.alias("v"), label.alias("label"))


def test_sorted_ordinal_is_a_global_rank(rows):
    got = sorted_ordinal(rows, ["v", "id"], (), "o").orderBy("o").collect()
    assert [r["o"] for r in got] == list(range(3000))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_sorted_ordinal_starts_at_zero_in_each_group(rows):
    got = sorted_ordinal(rows, ["v", "id"], ("label",), "o").collect()
    for label in (0, 1, None):
        part = sorted((r["v"], r["id"], r["o"]) for r in got if r["label"] == label)
        assert [p[2] for p in part] == list(range(len(part)))


def test_shuffled_ordinal_is_a_permutation(rows):
    got = [r["o"] for r in shuffled_ordinal(rows, "id", name="o").orderBy("id").collect()]
    assert sorted(got) == list(range(3000)) and got != list(range(3000))


def test_segments_match_the_ordinal(rows):
    cut = segments(rows, "id", lambda n: [F.lit(10), F.floor(n / 2)], (), 42, "s")
    both = cut.join(shuffled_ordinal(rows.select("id"), "id", name="o"), "id").collect()
    assert len(both) == 3000
    assert all(r["s"] == (r["o"] >= 10) + (r["o"] >= 1500) for r in both)


def test_exact_n_per_class_keeps_other_classes(rows):
    got = sampling.exact_n(rows, "id", sampling.per_class("label", {0: 100, 1: 10**9}), ("label",))
    counts = {r[0]: r[1] for r in got.groupBy("label").count().collect()}
    have = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    assert counts == {0: 100, 1: have[1], None: have[None]}


def test_exact_n_edges(rows):
    assert sampling.exact_n(rows, "id", 0).count() == 0
    assert sampling.exact_n(rows, "id", 3000).count() == 3000
    assert sampling.exact_n(rows.limit(0), "id", 5).count() == 0


def test_splits_are_whole_and_stratified(rows):
    got = splitting.stratified(rows, "id")
    assert got.count() == 3000 and got.select("id").distinct().count() == 3000
    sizes = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    for label in (0, 1, None):
        n = sum(v for k, v in sizes.items() if k[0] == label)
        assert abs(sizes[(label, "train")] - 0.7 * n) < 1 and abs(sizes[(label, "val")] - 0.15 * n) < 1.01


def test_folds_are_even(rows):
    sizes = splitting.kfold(rows, "id").groupBy("label", "fold").count().collect()
    for label in (0, 1, None):
        part = [r["count"] for r in sizes if r["label"] == label]
        assert len(part) == 5 and max(part) - min(part) <= 1


def test_temporal_split_keeps_the_order(rows):
    got = splitting.temporal(rows, "v", "id").collect()
    top = {s: max((r["v"], r["id"]) for r in got if r["split"] == s) for s in ("train", "val", "test")}
    low = {s: min((r["v"], r["id"]) for r in got if r["split"] == s) for s in ("train", "val", "test")}
    assert top["train"] < low["val"] and top["val"] < low["test"]
    assert sum(r["split"] == "train" for r in got) == 2100


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1500, 2999, 3000, 5000])
def test_top_n_of_any_length(rows, n):
    got = top_n(rows, "v", n, "id", steps=50, small=0)
    want = sorted(((-r["v"], r["id"]) for r in rows.collect()))[:n]
    assert sorted((-r["v"], r["id"]) for r in got.collect()) == want


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_with_a_heavy_value(rows, accuracy):
    probs = [0.0, 0.01, 0.33, 0.5, 0.99, 1.0]
    data = rows.withColumn("w", F.when(F.col("label") == 1, F.col("v") * 1.5))
    got = exact_quantiles(data.withColumn("none", F.lit(None).cast("double")), ["v", "w", "none"], probs, accuracy)
    pdf = data.toPandas()
    assert np.allclose(got["v"], np.quantile(pdf["v"], probs))
    assert np.allclose(got["w"], np.nanquantile(pdf["w"].astype(float), probs))
    assert got["none"] is None


def test_skew_join_salts_hot_keys_and_loses_nothing(spark):
    facts = spark.range(2000).withColumn("k", F.when(F.col("id") < 900, 1).otherwise(F.col("id")))
    lookup = spark.range(0, 1900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    hot = hot_keys(facts, "k", share=0.1, min_rows=10)
    assert [r["k"] for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew_join(facts, lookup, "k", how, hot).collect()), key=str)
        assert got == sorted(map(tuple, facts.join(lookup, "k", how).collect()), key=str)


@pytest.mark.parametrize("kind", ["double", "string", "timestamp", "timestamp_ntz", "date", "decimal(20,3)", "array<double>"])
@pytest.mark.parametrize("n", [0, 37, 200])
def test_first_per_equals_a_window(spark, kind, n):
    odd = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 4 == 0, 7).otherwise(F.pmod(F.col("id") * 7919, F.lit(997)))
    value = {
        "date": F.date_add(F.lit("2024-01-01").cast("date"), odd.cast("int")),
        "array<double>": F.array(odd.cast("double")),
        "timestamp": F.timestamp_micros(odd * 1_000_003),
        "timestamp_ntz": F.timestamp_micros(odd * 40_000_000_003),
        "double": F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).when(F.col("id") % 17 == 0, F.lit(float("-inf")))
        .when(F.col("id") % 19 == 0, F.lit(float("inf"))).otherwise(odd * 1e300 - 4e302),
        "string": F.concat(F.lit("é" * 2), odd.cast("string")),
    }.get(kind, odd)
    file = F.when(F.col("id") % 7 == 0, None).when(F.col("id") < 300, "a").otherwise("b")
    df = spark.range(600).select("id", file.alias("file"), value.cast(kind).alias("v"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("v", "id"))
    want = {r.id for r in df.withColumn("r", rank).filter(F.col("r") <= n).collect()}
    got = [r.id for r in ordering.first_per(df, n, ["v", "id"], ("file",), steps=50).collect()]
    assert len(got) == len(want) and set(got) == want


def test_temporal_split_of_many_rows(spark):
    """A count times ten thousand beyond an int."""
    got = splitting.temporal(spark.range(310_000).withColumn("v", F.col("id") % 7), "v", "id")
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 217_000, "val": 46_500, "test": 46_500}
