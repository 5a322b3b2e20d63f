import pytest
from pyspark.sql import functions as F

from flowloom.operators import metrics


def counts(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


# Recorded confusion counts with their recorded rates.
GOLDEN = [
    ((27079, 4265, 1370, 12286), dict(accuracy=0.8747777778, precision=0.7423116428, recall=0.8996777973, f1=0.8134538352,
                                      specificity=0.8639293007, fpr=0.1360706993, fnr=0.1003222027, npv=0.9518436500)),
    ((249906, 65094, 12333, 122667), dict(accuracy=0.82794, precision=0.6533145861, recall=0.9086444444, f1=0.7601104223)),
    ((27049, 4295, 1495, 12161), dict(accuracy=0.8713333333, precision=0.7390009723, recall=0.8905243117, f1=0.8077178533)),
]


@pytest.mark.parametrize("cells,want", GOLDEN)
def test_golden_rates(spark, cells, want):
    got = metrics.scores(counts(spark, *cells)).first()
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-9)


def test_undefined_rates_are_zero(spark):
    got = metrics.scores(counts(spark, 5, 0, 0, 0)).first()
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, prob double, y_pred int")


def test_report_of_golden_counts(spark):
    parts = [(0, 0, 27079), (0, 1, 4265), (1, 0, 1370), (1, 1, 12286)]
    df = spark.createDataFrame([(t, p) for t, p, n in parts for _ in range(n)], "y_true int, y_pred int")
    got = {r["class"]: r for r in metrics.report(df).collect()}
    assert got["Benign"]["precision"] == pytest.approx(0.951844, abs=1e-6)
    assert got["Benign"]["f1"] == pytest.approx(0.905758, abs=1e-6)
    assert got["macro avg"]["f1"] == pytest.approx(0.859606, abs=1e-6)
    assert got["weighted avg"]["f1"] == pytest.approx(0.877747, abs=1e-6)
    assert got["accuracy"]["f1"] == pytest.approx(0.8747777778)


def test_auc_edges(spark):
    assert metrics.auc(scored(spark, [(0, 0.5, 0), (1, 0.5, 0), (1, 0.5, 0)])).first()[0] == 0.5
    assert metrics.auc(scored(spark, [(1, 0.2, 0), (1, 0.9, 1)])).first()[0] is None
    rows = [(0, 0.1, 0), (1, 0.4, 0), (0, 0.4, 0), (1, 0.8, 1), (0, 0.7, 1)]
    assert metrics.auc(scored(spark, rows)).first()[0] == pytest.approx(4.5 / 6)
    assert metrics.roc_area(metrics.roc(scored(spark, rows))).first()[0] == pytest.approx(4.5 / 6)


def test_threshold_is_strict_and_first_wins(spark):
    df = scored(spark, [(0, 0.40, 0), (1, 0.45, 0), (1, 0.60, 1), (0, 0.30, 0)])
    sweep = {r["threshold"]: r for r in metrics.threshold_sweep(df, 30, 69).collect()}
    assert len(sweep) == 40 and sweep[0.4]["fp"] == 0 and sweep[0.39]["fp"] == 1
    best = metrics.best_threshold(metrics.threshold_sweep(df, 30, 69), ["f1"]).first()
    assert (best["threshold"], best["f1"]) == (0.4, 1.0)


def test_fold_summary_uses_the_sample_deviation(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (1.0,)], "accuracy double")
    row = metrics.fold_summary(df, ["accuracy"]).first()
    assert row["mean"] == pytest.approx(0.9) and row["std"] == pytest.approx(0.1)


def test_throughput_and_tiers(spark):
    df = spark.createDataFrame([(512, 0.198916877 * 512)], "batch_size int, total_ms double")
    row = metrics.capability(metrics.latency_summary(df)).first()
    assert row["throughput"] == pytest.approx(5027.2255, abs=1e-4)
    assert (row["std_latency"], row["capability"], row["network_capacity"]) == (0.0, "Real-time", "Sub-Gbps")


def test_best_epoch_counts_from_one_and_takes_the_first(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.92), (2, 0.9331), (3, 0.9331)], "epoch int, val_auc double")
    assert tuple(metrics.best_epoch(df).first()) == (3, 0.9331)


def test_miss_rate_tiers_and_percent_text(spark):
    df = spark.createDataFrame([(0.04,), (0.07,), (0.2,)], "fnr double")
    assert [r["tier"] for r in metrics.fnr_tier(df).collect()] == ["excellent", "good", "needs improvement"]
    assert metrics.compare(df, ["fnr"]).first()["fnr_pct"] == "4.00%"


def test_balance(spark):
    df = spark.createDataFrame([(0,)] * 66 + [(1,)] * 34, "label int")
    assert metrics.balance_check(df).first()["balanced"]
    assert not metrics.balance_check(df.unionAll(df.filter("label = 1"))).first()["balanced"]


def test_close_scores_are_told_apart(spark):
    df = spark.range(1000).select((0.5 + F.col("id") * 1e-9).alias("prob"), (F.col("id") >= 500).cast("int").alias("y_true"))
    assert metrics.auc(df).first()["auc"] == 1.0
    points = metrics.roc(df)
    assert points.count() == 1000
    assert metrics.roc_area(points).first()["area"] == pytest.approx(1.0)
    logits = df.withColumn("prob", F.col("prob") * 100 - 50)
    assert metrics.auc(logits.unionByName(logits.withColumn("prob", F.lit(None).cast("double")))).first()["auc"] == 1.0
