import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import numeric, text
from flowloom.operators import clean, scaling


def test_label_rules(spark):
    df = spark.createDataFrame([("Benign",), (" benign ",), ("BENIGN-x",), ("Bot",), (None,)], "l string")
    for rule, want in {"contains": [0, 0, 0, 1, 1], "iequals": [0, 0, 1, 1, 1], "equals": [0, 1, 1, 1, 1]}.items():
        got = [r[0] for r in df.select(text.binary_label(F.col("l"), rule)).collect()]
        assert got == want, rule


def test_six_classes(spark):
    names = {"Benign": 0, "Bot": 1, "DDoS attack-HOIC": 2, "DDOS attack-LOIC-UDP": 2, "DoS attacks-Hulk": 3,
             "FTP-BruteForce": 4, "SSH-Bruteforce": 4, "Brute Force -XSS": 4, "SQL Injection": 4,
             "Infilteration": 5, "Infiltration": 5, "other": None}
    df = spark.createDataFrame([(n,) for n in names], "l string")
    assert {r[0]: r[1] for r in df.select("l", text.multiclass_label(F.col("l"))).collect()} == names


def test_whole_chain_by_hand(spark):
    raw = spark.createDataFrame(
        [
            ("f1", "1.1.1.1", " 1 ", "10", "Benign"),
            ("f1", "1.1.1.1", " 1 ", "10", "Benign"),
            ("f2", "1.1.1.2", "Infinity", "20", " benign"),
            ("f3", "1.1.1.3", "5", "x", "Bot"),
            ("f4", "1.1.1.4", "nan", "", "Bot"),
            ("f5", "1.1.1.5", "9", "40", None),
        ],
        "`Flow ID` string, ` Src IP` string, ` A` string, `B ` string, ` Label` string",
    )
    got = clean.clean_flows(raw, "iequals", "median")
    assert got.columns == ["A", "B", "Label"]
    # f4 misses two of five columns; the medians come from 1, 5, 9 and 10, 20, 40.
    assert sorted(map(tuple, got.collect())) == [(1.0, 10.0, 0), (5.0, 20.0, 0), (5.0, 20.0, 1), (9.0, 40.0, 1)]
    zero = clean.clean_flows(raw, "contains", "zero", keep_ip=True)
    assert zero.columns == ["Src_IP", "A", "B", "Label"] and zero.count() == 5
    assert {(r["A"], r["B"]) for r in zero.collect()} == {(1, 10), (0, 20), (5, 0), (0, 0), (9, 40)}


def test_missing_label_and_missing_features(spark):
    with pytest.raises(ValueError):
        clean.require_label(spark.range(1))
    with pytest.raises(ValueError):
        clean.feature_columns(spark.createDataFrame([("a", "b")], "Flow_ID string, Label string"))


def test_columns_by_name(spark):
    df = spark.createDataFrame([("a", "b", 1, 2, "x")], "Source_IP string, DstIP string, My_Flow_ID_x int, Rate int, Label string")
    assert clean.ip_columns(df) == ("Source_IP", "DstIP")
    assert clean.feature_columns(df) == ["Rate"]
    assert clean.ip_columns(spark.range(1)) == (None, None)


def test_header_rows(spark):
    df = spark.createDataFrame([("Label",), (" Label ",), ("Bot",), (None,)], "Label string")
    assert clean.drop_header_rows(df).count() == 2


def test_encoding_unseen_and_null(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    other = spark.createDataFrame([("a",), ("z",), (None,), ("b",)], "c string")
    got = [r[0] for r in clean.encode_categories(other, ["c"], train).collect()]
    assert sorted(got) == [-1, 0, 1, 2]


def test_width_check_keeps_rejects(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "features array<double>")
    good, bad = clean.check_width(df, 2)
    assert (good.count(), bad.count()) == (1, 2)


def test_finite_and_signed_log(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.finite(F.col("x"))).collect()] == [1.0, None, None, None, None]
    one = spark.createDataFrame([(-3.0,)], "x double").select(numeric.signed_log(F.col("x"))).first()[0]
    assert one == pytest.approx(-math.log(4))


def test_low_variance_and_skew_choose_columns(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("wide"), F.lit(3.0).alias("flat"), F.pow("id", F.lit(6)).alias("skewed"))
    assert clean.drop_low_variance(df, df.columns).columns == ["wide", "skewed"]
    logged = clean.log_skewed(df, ["wide", "skewed"]).orderBy("wide").collect()
    assert logged[-1]["wide"] == 99.0 and logged[-1]["skewed"] == pytest.approx(math.log1p(99.0**6))


def test_scaler_uses_the_population_deviation(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 4.0, 0), (3.0, 4.0, 1)], "a double, b double, fold int")
    params = scaling.fit(df, ["a", "b"])
    assert sorted((r["a"], r["b"]) for r in scaling.apply(df, params).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    vector = df.withColumn("features", F.array("a", "b"))
    assert sorted(r["features"] for r in scaling.apply_to_vector(vector, params).collect()) == [[-1.0, 0.0], [1.0, 0.0]]
    scaling.save(params, str(tmp_path / "scaler"))
    assert scaling.load(spark, str(tmp_path / "scaler")).count() == 2
    df.write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        scaling.load(spark, str(tmp_path / "other"))


def test_fold_parameters_equal_a_fit_on_the_other_folds(spark):
    df = spark.range(60).select((F.col("id") % 5).alias("fold"), (F.col("id") * F.col("id") * 1.0).alias("x"), F.lit(2.0).alias("c"))
    merged = {(r["fold"], r["feature"]): r for r in scaling.fit_folds(df, ["x", "c"]).collect()}
    for fold in range(5):
        for r in scaling.fit(df.filter(F.col("fold") != fold), ["x", "c"]).collect():
            got = merged[(fold, r["feature"])]
            assert got["mean"] == pytest.approx(r["mean"]) and got["scale"] == pytest.approx(r["scale"])


def test_sketches_read_every_file_once_and_stay_within_their_error(spark, tmp_path):
    from flowloom.operators import quantiles

    rows = spark.range(20_000).select(
        (F.hash("id") % 1000).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).otherwise(float("nan")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.concat(F.lit("day "), F.col("id") % 5, F.lit(" é")).alias("day"),
    )
    rows.write.partitionBy("day").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    files = df.inputFiles()
    reads = []

    def read(paths):
        reads.append(len(paths))
        return spark.read.parquet(*paths)

    held = quantiles.FileSketches(spark, read, ["a", "b", "c"], str(tmp_path / "sketches"))
    assert held.table() is None
    paths = sorted(str(p) for p in (tmp_path / "in").rglob("*.parquet"))
    assert (held.add(paths[:7]), held.add(paths), held.add(paths)) == (7, len(files) - 7, 0) and sum(reads) == len(files)
    again = quantiles.FileSketches(spark, read, ["a", "b", "c"], str(tmp_path / "sketches"))
    assert again.add(paths) == 0
    got = again.quantiles([0.01, 0.5, 0.99])
    assert got["c"] is None
    for c in "ab":
        values = np.array(sorted(r[0] for r in df.filter(~F.isnan(c)).select(c).collect()))
        for p, v in zip([0.01, 0.5, 0.99], got[c]):
            assert (values < v).mean() - again.rank_error <= p <= (values <= v).mean() + again.rank_error
    filled = clean.impute_median(spark.createDataFrame([(None, 1.0, None)], "a double, b double, c double"), ["a", "b", "c"], again)
    row = filled.first()
    assert (row["b"], row["c"]) == (1.0, None) and abs(row["a"] - got["a"][1]) <= 2000 * 2 * again.rank_error


def test_features_by_type(spark):
    df = spark.createDataFrame([("x", 1, 2.0, None, [1.0], 0)], "Src_IP string, n int, v double, empty double, list array<double>, Label int")
    assert clean.numeric_features(df) == ["n", "v"]
    assert clean.numeric_features(df, drop_empty=False) == ["n", "v", "empty"]
    with pytest.raises(ValueError, match="numeric"):
        clean.numeric_features(df.select("empty", "list", "Label"))
