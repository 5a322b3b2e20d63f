import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import learning


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        label = int(i % 4 == 0)
        rows.append((i, label, *map(float, rng.normal(2.0 * label, 1.0, 3))))
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double")


def test_budgets():
    assert learning.budgets(1000) == (50, 20)
    assert 50 + 9 * 20 == 230


def test_first_labels_are_stratified(blobs):
    keys = learning.initial_labels(blobs, "id", 40)
    got = {r[0]: r[1] for r in blobs.join(keys, "id").groupBy("label").count().collect()}
    assert got == {0: 30, 1: 10}
    one = blobs.filter("label = 0")
    assert learning.initial_labels(one, "id", 40).count() == 40


def test_query_takes_the_least_certain_unlabelled_rows(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.49), (3, 0.9), (4, 0.1), (5, 0.51)], "id long, prob double")
    labeled = df.filter("id = 1").select("id")
    for strategy in ("entropy", "margin"):
        assert sorted(r[0] for r in learning.query(df, labeled, "id", 2, strategy).collect()) == [2, 5]
    assert learning.query(df, labeled, "id", 9, "random").count() == 4


def test_rounds_grow_the_labelled_set(blobs):
    history = learning.active_learning(blobs, "id", ["a", "b", "c"], k=3, rounds=3, hops=2).orderBy("round").collect()
    assert [r["labeled_count"] for r in history] == [20, 28, 36]
    assert history[0]["labeled_percent"] == 5.0
    assert all(r["test_auc"] > 0.8 for r in history)


def test_a_round_writes_features_of_labelled_rows_only(blobs, monkeypatch):
    written, columns = [], ["a", "b", "c"]
    keep = learning.scratch.materialise

    def record(df, *args, **kwargs):
        table = keep(df, *args, **kwargs)
        if set(columns) <= set(table.columns):
            written.append(table.count())
        return table

    monkeypatch.setattr(learning.scratch, "materialise", record)
    learning.active_learning(blobs, "id", columns, k=3, rounds=3, hops=2)
    assert written == [400, 20, 28, 36]


def test_edges_among_all_rows_smooth_the_test_rows_too(blobs):
    labeled = blobs.filter("id < 100").select("id")
    columns = ["a", "b", "c"]
    own = {r["id"]: r["a"] for r in blobs.collect()}
    part = {r["id"]: r["a"] for r in learning.smooth(blobs, labeled, "id", columns, 3, 1).collect()}
    full = {r["id"]: r["a"] for r in learning.smooth(blobs, labeled, "id", columns, 3, 1, "all").collect()}
    assert len(part) == len(full) == 400
    assert all(part[i] == own[i] for i in range(100, 400))
    assert sum(full[i] != own[i] for i in range(100, 400)) > 250


def test_classifiers_learn_and_thresholds_differ(spark, blobs):
    columns = ["a", "b", "c"]
    model = learning.fit_dense(blobs, columns, max_iter=40)
    assert learning.evaluate(learning.score(model, blobs))["auc"] > 0.9
    weighted = learning.fit_graph_classifier(blobs, columns)
    folds = blobs.withColumn("fold", (F.col("id") % 3).cast("int"))
    rows = learning.cross_validate(folds, lambda t: learning.fit_graph_classifier(t, columns), k=3)
    assert rows.count() == 3 and rows.agg(F.sum(F.expr("tn + fp + fn + tp"))).first()[0] == 400
    p = learning.score(weighted, blobs).agg(F.max("prob")).first()[0]
    strict = learning.score(weighted, blobs, p).agg(F.sum("y_pred")).first()[0]
    assert (strict, learning.score(weighted, blobs, p, True).agg(F.sum("y_pred")).first()[0] >= 1) == (0, True)


def test_a_model_that_learned_nothing_fails_the_checks(spark, monkeypatch):
    from flowloom.plans import training

    sf = "/root/testdata/sf0.001"
    constant = lambda model, df, threshold=0.5, inclusive=False: df.withColumns({"prob": F.lit(0.5), "y_pred": F.lit(0)})
    monkeypatch.setattr(learning, "score", constant)
    for query in (training.l11, training.l13):
        assert {r["learned"] for r in query(spark, sf).select("learned").distinct().collect()} == {False}
    assert [r["learned"] for r in training.a26(spark, sf).collect()] == [False]


def test_folds_fitted_together_equal_folds_fitted_alone(spark, blobs):
    columns, folds = ["a", "b", "c"], blobs.withColumn("fold", (F.col("id") % 3).cast("int"))
    models = learning.fit_folds(folds, columns, k=3)
    together = {r["fold"]: r.asDict() for r in learning.cross_validate_together(folds, columns, k=3).collect()}
    for f in range(3):
        # Alone: the other folds' rows become fold 1 of two, so only model 0 sees them.
        alone = folds.withColumn("fold", F.when(F.col("fold") == f, 0).otherwise(1))
        one = learning.fit_folds(alone, columns, k=2)
        assert np.abs(one.coefficients[0] - models.coefficients[f]).max() < 1e-6
        result = learning.evaluate(one.score(alone.filter("fold = 0")))
        assert all(result[c] == pytest.approx(together[f][c], abs=1e-6) for c in learning._FOLD_COLUMNS)
        # The library's learner stops earlier; it must not be better by more than its tolerance.
        ml = learning.fit_graph_classifier(folds.filter(F.col("fold") != f), columns, max_iter=200)
        theirs = np.r_[ml.stages[-1].coefficients.toArray(), ml.stages[-1].intercept]
        assert np.abs(theirs - models.coefficients[f]).max() < 0.05


def test_replicated_rows_follow_their_weights(spark):
    from flowloom.operators.sampling import balanced_weights, replicate

    df = spark.range(40_000).select("id", F.when(F.col("id") % 8 == 0, 1).when(F.col("id") % 8 < 7, 0).alias("label"))
    weights = balanced_weights(df)
    assert weights == {0: pytest.approx(35_000 / 60_000), 1: pytest.approx(3.5)}
    made = replicate(df, "id", weights)
    rows = {r[0]: (r[1], r[2]) for r in made.groupBy("label").agg(F.count("*"), F.countDistinct("id")).collect()}
    assert rows[None] == (5000, 5000)
    for label, n in ((0, 30_000), (1, 5000)):
        assert rows[label][0] == pytest.approx(17_500, rel=0.04)
        assert rows[label][1] == pytest.approx(n * (1 - np.exp(-weights[label])), rel=0.04)
    assert made.select("id", "copy").distinct().count() == made.count()
    assert sorted(map(tuple, replicate(df, "id", {1: 3.5}).collect())) == sorted(map(tuple, replicate(df.repartition(7), "id", {1: 3.5}).collect()))


def test_sequence_classifier(spark):
    rows = [(i, i % 2, [[float(i % 2), float(j)] for j in range(10)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, steps array<array<double>>")
    wide, columns = learning.sequence_features(df, 2)
    assert len(columns) == 6 and wide.first()["last_1"] == 9.0 and wide.first()["mean_1"] == 4.5
    model = learning.fit_sequence(wide, columns, max_iter=3)
    assert learning.evaluate(learning.score(model, wide))["accuracy"] == 1.0
