"""Queries: budgets, labelling, classifiers, active learning."""

import json
import math

from pyspark.sql import functions as F

from flowloom.functions import numeric
from flowloom.operators import learning, sequences
from flowloom.operators.sampling import balanced_weights, replicate
from flowloom.operators.splitting import kfold, stratified
from flowloom.plans import fixtures as fx
from flowloom.plans.registry import query
from flowloom.sources import scratch, sinks

VECTORS, SCORED, SIGNAL = fx.VECTORS_SQL, fx.SCORED_SQL, fx.SIGNAL_SQL


def _part(table, key, first="85"):
    """SQL: the rows of ``table`` from that percentage of each class on, in hash order."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {fx.hash_sql(key)}) - 1 AS o,
        count(*) OVER (PARTITION BY label) AS n FROM {table}), test AS (SELECT * FROM r WHERE o >= n * {first} // 100)"""


#: Planted classes must be told apart this well; a constant or a random score does not.
LEAST_AUC = 0.85


def _decided(scored, key, threshold=0.5):
    """Key, label, whether score and decision agree, and whether the model tells the planted classes apart."""
    scored = scratch.materialise(scored, "decided")
    p = F.col("prob")
    agree = p.between(0, 1) & (F.col("y_pred") == F.when(p > threshold, 1).otherwise(0))
    found = learning.evaluate(scored)
    learned = (found["auc"] or 0.0) > LEAST_AUC and found["accuracy"] > 0.75
    return scored.select(key, "label", agree.alias("agrees"), F.lit(learned).alias("learned"))


SAME = "true AS agrees, true AS learned FROM test"


@query(
    "l01_budgets",
    "SELECT count(*) AS n, CAST(floor(count(*) * 0.05) AS BIGINT) AS initial, CAST(floor(count(*) * 0.02) AS BIGINT) AS per_round FROM embeddings",
)
def l01(spark, sf):
    n = F.count(F.lit(1))
    return fx.vectors(spark, sf).agg(
        n.alias("n"), F.floor(n * F.lit(0.05)).alias("initial"), F.floor(n * F.lit(0.02)).alias("per_round")
    )


@query(
    "l02_initial_labels",
    fx.with_sql(
        VECTORS,
        f"r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {fx.hash_sql('row_id')}) - 1 AS o FROM vectors)",
        "b AS (SELECT floor(count(*) * 0.05) AS budget, floor(floor(count(*) * 0.05) * (count(*) FILTER (label = 0) / count(*))) AS benign FROM vectors)",
        "SELECT row_id FROM r, b WHERE o < CASE label WHEN 0 THEN benign ELSE budget - benign END",
    ),
)
def l02(spark, sf):
    v = fx.vectors(spark, sf)
    budget, _ = learning.budgets(v.count())
    return learning.initial_labels(v, "row_id", budget)


def _selection(name, strategy, order):
    @query(
        name,
        fx.with_sql(
            SCORED,
            f"lab AS (SELECT flow_key FROM scored ORDER BY {fx.hash_sql('flow_key')} LIMIT 3000)",
            "pool AS (SELECT * FROM scored WHERE flow_key NOT IN (SELECT flow_key FROM lab))",
            f"SELECT flow_key FROM pool ORDER BY {order}, flow_key LIMIT 1200",
        ),
    )
    def run(spark, sf):
        from flowloom.operators.sampling import exact_n

        df = fx.scored(spark, sf)
        labeled = exact_n(df, "flow_key", 3000).select("flow_key")
        return learning.query(df, labeled, "flow_key", 1200, strategy)


_selection("l05_random_query", "random", f"{fx.uniform_sql('flow_key')} DESC")
_selection(
    "l06_entropy_query",
    "entropy",
    "-((1 - prob) * ln((1 - prob) + 1e-10) + prob * ln(prob + 1e-10)) DESC",
)


def _history(spark, sf, rounds):
    df = fx.signal(spark, sf)
    return learning.active_learning(df, "row_id", fx.WIDE, k=10, rounds=rounds)


ROUNDS = """SELECT r::INT AS round, floor(n * 0.05)::BIGINT + (r - 1) * floor(n * 0.02)::BIGINT AS labeled_count,
    round((floor(n * 0.05) + (r - 1) * floor(n * 0.02)) * 100 / n, 6) AS labeled_percent"""


@query(
    "l07_active_learning",
    f"WITH c AS (SELECT count(*) AS n FROM embeddings) {ROUNDS}, true AS learned FROM c, range(1, 11) t(r)",
)
def l07(spark, sf):
    """Budgets of all rounds, and whether each round's model tells the planted classes apart."""
    learned = F.col("test_auc").between(0.75, 1) & F.col("test_acc").between(0.7, 1) & F.col("test_f1").between(0.5, 1)
    return _history(spark, sf, 10).select(
        "round", "labeled_count", F.round("labeled_percent", 6).alias("labeled_percent"),
        learned.alias("learned"),
    )


@query(
    "a26_round_history",
    """WITH c AS (SELECT count(*) AS n FROM embeddings)
       SELECT count(*) AS rounds, max(floor(n * 0.05)::BIGINT + (r - 1) * floor(n * 0.02)::BIGINT) AS labeled,
         true AS learned FROM c, range(1, 3) t(r)""",
)
def a26(spark, sf):
    """The history of two rounds in one row; the labelled set must have taught something."""
    return _history(spark, sf, 2).agg(
        F.count(F.lit(1)).alias("rounds"),
        F.max("labeled_count").alias("labeled"),
        (F.max_by("test_auc", "round") > 0.75).alias("learned"),
    )


def _graph_scores(spark, sf):
    """Test rows scored by a classifier on the labelled neighbour graph."""
    nodes = scratch.materialise(stratified(fx.signal(spark, sf), "row_id"), "nodes")
    labeled = nodes.filter(F.col("split") == "train").select("row_id")
    out = learning.smooth(nodes.drop("split"), labeled, "row_id", fx.WIDE)
    out = scratch.materialise(out, "smooth")
    model = learning.fit_graph_classifier(out.join(labeled, "row_id", "left_semi"), fx.WIDE)
    return learning.score(model, out.join(labeled, "row_id", "left_anti"))


def _row(spark, result):
    columns = ["tn", "fp", "fn", "tp", "accuracy", "f1", "auc"]
    return spark.createDataFrame(
        [tuple(result[c] for c in columns)],
        "tn long, fp long, fn long, tp long, accuracy double, f1 double, auc double",
    )


@query(
    "l08_graph_classifier", fx.with_sql(SIGNAL, _part("signal", "row_id", "70"), f"SELECT row_id, label, {SAME}")
)
def l08(spark, sf):
    return _decided(_graph_scores(spark, sf), "row_id")


CONSISTENT = """SELECT count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attacks, true AS rates_agree, true AS learned"""


def _consistent(rows, by=()):
    """Class sizes from the confusion counts, and whether the rates follow from them."""
    hits = (F.col("tn") + F.col("tp")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    f1 = numeric.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    agree = (F.abs(hits - F.col("accuracy")) < 1e-9) & (F.abs(f1 - F.col("f1")) < 1e-9) & F.col("auc").between(0, 1)
    learned = (F.col("auc") > LEAST_AUC) & (F.col("accuracy") > 0.75)
    return rows.select(
        *by, (F.col("tn") + F.col("fp")).alias("benign"), (F.col("fn") + F.col("tp")).alias("attacks"),
        agree.alias("rates_agree"), learned.alias("learned"),
    )


@query("l09_evaluate_graph", fx.with_sql(SIGNAL, _part("signal", "row_id", "70"), f"{CONSISTENT} FROM test"))
def l09(spark, sf):
    return _consistent(_row(spark, learning.evaluate(scratch.materialise(_graph_scores(spark, sf), "scored"))))


@query(
    "l10_result_document",
    fx.with_sql(
        SCORED, fx.COUNTS_SQL,
        """SELECT tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, 'made-up' AS name, 0.5::DOUBLE AS threshold
           FROM cells""",
    ),
)
def l10(spark, sf):
    """The nested document, read back field by field."""
    from flowloom.operators import metrics

    rates = metrics.scores(metrics.confusion(fx.scored(spark, sf)))
    text = sinks.result_document(rates, {"model": {"name": "made-up", "threshold": 0.5}})
    schema = """metrics STRUCT<tn: LONG, fp: LONG, fn: LONG, tp: LONG, accuracy: DOUBLE>,
        model STRUCT<name: STRING, threshold: DOUBLE>"""
    doc = text.select(F.from_json("document", schema).alias("d"))
    return doc.select("d.metrics.*", "d.model.*").withColumn("accuracy", F.round("accuracy", 6))


def _split_flows(spark, sf):
    """Scaled flows with a split column."""
    from flowloom.operators import scaling

    # A planted class: attacks have other discounts and taxes.
    flows = fx.flows(spark, sf).withColumn("disc", F.col("disc") + F.col("label") * 0.06).withColumn("tax", F.col("tax") - F.col("label") * 0.05)
    df = scratch.materialise(stratified(flows, "flow_key"), "split")
    params = scaling.fit(df.filter(F.col("split") == "train"), fx.FEATURES)
    return scratch.materialise(scaling.apply(df, params), "scaled")


@query("l11_dense_classifier", fx.with_sql(SIGNAL, _part("signal", "row_id"), f"SELECT row_id, label, {SAME}"))
def l11(spark, sf):
    df = stratified(fx.signal(spark, sf), "row_id")
    df = scratch.materialise(df, "split")
    model = learning.fit_dense(df.filter(F.col("split") == "train"), fx.WIDE, key="row_id", weights="balanced")
    scored = learning.score(model, df.filter(F.col("split") == "test"))
    return _decided(scored, "row_id")


@query(
    "l12_sequence_classifier",
    fx.with_sql(
        fx.EVENTS_SQL,
        "p AS (SELECT *, row_number() OVER (ORDER BY ts, flow_id) - 1 AS i, count(*) OVER () AS c FROM ev)",
        "s AS (SELECT i // 10 AS seq_id, label FROM p WHERE i % 10 = 9)",
        _part("s", "seq_id"), f"SELECT seq_id, label, {SAME}",
    ),
)
def l12(spark, sf):
    # A planted class: the last step of an error sequence lies three deviations off.
    df = fx.events(spark, sf)
    spread = df.agg(F.stddev_pop("x0")).first()[0]
    df = df.withColumn("x0", F.col("x0") + F.col("label") * 3 * spread)
    cut = sequences.tumbling(df, ["ts", "flow_id"], ["x0", "x1"])
    rows, columns = learning.sequence_features(cut, 2)
    rows = scratch.materialise(stratified(rows.drop("steps"), "seq_id"), "sequences")
    model = learning.fit_sequence(rows.filter(F.col("split") == "train"), columns)
    scored = learning.score(model, rows.filter(F.col("split") == "test"))
    return _decided(scored, "seq_id")


@query(
    "l13_score_threshold",
    fx.with_sql(fx.FLOWS_SQL, _part("flows", "flow_key"), f"SELECT flow_key, label, {SAME}"),
)
def l13(spark, sf):
    df = _split_flows(spark, sf)
    model = learning.fit_graph_classifier(df.filter(F.col("split") == "train"), fx.FEATURES)
    scored = learning.score(model, df.filter(F.col("split") == "test"), 0.42)
    return _decided(scored, "flow_key", 0.42)


@query(
    "l14_cross_validate",
    fx.with_sql(
        SIGNAL, _part("signal", "row_id"),
        "f AS (SELECT label, list_sum([(o >= n * i // 5)::INT FOR i IN [1, 2, 3, 4]])::INT AS fold FROM r)",
        f"SELECT * FROM (SELECT fold, {CONSISTENT.removeprefix('SELECT ')} FROM f GROUP BY fold)",
    ),
)
def l14(spark, sf):
    df = scratch.materialise(kfold(fx.signal(spark, sf), "row_id"), "folds")
    return _consistent(learning.cross_validate_together(df, fx.WIDE), ["fold"])


_CDF = [" + ".join(["1.0", *[f"pow(w, {j}) / {math.factorial(j)}.0" for j in range(1, c + 1)]]) for c in range(16)]


@query(
    "l11_class_weights",
    fx.with_sql(
        SIGNAL, _part("signal", "row_id"),
        "train AS (SELECT * FROM r WHERE o < n * 70 // 100)",
        "sizes AS (SELECT label, count(*) AS c, sum(count(*)) OVER () / (2 * count(*)) AS w FROM train GROUP BY label)",
        f"u AS (SELECT label, w, {fx.uniform_sql('row_id')} AS u FROM train JOIN sizes USING (label))",
        f"n AS (SELECT label, {' + '.join(f'(u >= exp(-w) * ({c}))::INT' for c in _CDF)} AS copies FROM u)",
        "SELECT label, count(*) FILTER (copies > 0) AS rows, sum(copies)::BIGINT AS copies FROM n GROUP BY label",
    ),
)
def l11_weights(spark, sf):
    """Rows that the dense classifier learns from, by class, once replicated by balanced weights."""
    df = scratch.materialise(stratified(fx.signal(spark, sf), "row_id"), "split")
    train = df.filter(F.col("split") == "train")
    made = replicate(train, "row_id", balanced_weights(train))
    return made.groupBy("label").agg(F.countDistinct("row_id").alias("rows"), F.count(F.lit(1)).alias("copies"))


@query("s17_model_checkpoint", fx.with_sql(fx.FLOWS_SQL, "SELECT count(*) AS rows, 0 AS differing, 'made-up' AS name FROM flows"))
def s17(spark, sf):
    """A saved model scores every flow as before; its settings come back with it."""
    df = fx.flows(spark, sf)
    model = learning.fit_graph_classifier(df, fx.FEATURES, max_iter=5)
    folder = scratch.new_path(spark, "model")
    counts = df.agg(F.count(F.lit(1)).alias("rows"))
    sinks.save_model(model, folder, counts, {"model": {"name": "made-up"}})
    loaded, meta = sinks.load_model(spark, folder)
    one = learning.score(model, df).select("flow_key", F.col("prob").alias("p"))
    both = learning.score(loaded, df).join(one, "flow_key")
    name = json.loads(meta)["model"]["name"]
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prob") != F.col("p")).alias("differing"), F.lit(name).alias("name")
    )
