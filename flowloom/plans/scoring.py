"""Queries: class distributions, classification metrics, result tables."""

from pyspark.sql import functions as F

from flowloom.functions import numeric
from flowloom.operators import metrics
from flowloom.operators.splitting import kfold, stratified
from flowloom.plans import fixtures as fx
from flowloom.plans.registry import query
from flowloom.sources import scratch

SCORED, CELLS, FLOWS = fx.SCORED_SQL, fx.COUNTS_SQL, fx.FLOWS_SQL
H = fx.hash_sql("flow_key")


def _round(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def rates_sql(names):
    formula = {
        "accuracy": "(tp + tn) / (tn + fp + fn + tp)",
        "precision": "tp / nullif(tp + fp, 0)",
        "recall": "tp / nullif(tp + fn, 0)",
        "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
        "specificity": "tn / nullif(tn + fp, 0)",
        "npv": "tn / nullif(tn + fn, 0)",
        "fpr": "fp / nullif(fp + tn, 0)",
        "fnr": "fn / nullif(fn + tp, 0)",
    }
    return ", ".join(f"round(coalesce({formula[n]}, 0), 6) AS {n}" for n in names)


@query(
    "a01_class_distribution",
    fx.with_sql(
        FLOWS,
        f"""r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {H}) - 1 AS o,
              count(*) OVER (PARTITION BY label) AS n FROM flows)""",
        "s AS (SELECT label, CASE WHEN o < n * 7 // 10 THEN 'train' WHEN o < n * 85 // 100 THEN 'val' ELSE 'test' END AS split FROM r)",
        """SELECT split, label, count(*) AS n,
             round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS percent
           FROM s GROUP BY split, label""",
    ),
)
def a01(spark, sf):
    df = stratified(fx.flows(spark, sf), "flow_key")
    return _round(metrics.class_distribution(df, "label", "split"), ["percent"])


@query(
    "a02_feature_statistics",
    fx.with_sql(
        FLOWS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(var_pop({c}), 2) AS var_pop, min({c}) AS min, max({c}) AS max FROM flows"
            for c in fx.FEATURES
        ),
    ),
)
def a02(spark, sf):
    stats = metrics.feature_statistics(fx.flows(spark, sf), fx.FEATURES)
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("var_pop", F.round("var_pop", 2))


@query("a03_confusion", fx.with_sql(SCORED, CELLS, "SELECT * FROM cells"))
def a03(spark, sf):
    return metrics.confusion(fx.scored(spark, sf))


@query(
    "a04_confusion_shares",
    fx.with_sql(
        SCORED,
        """SELECT y_true, y_pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y_true), 6) AS share
           FROM scored GROUP BY y_true, y_pred""",
    ),
)
def a04(spark, sf):
    return _round(metrics.confusion_long(fx.scored(spark, sf)), ["share"])


def _rates(name, columns):
    @query(name, fx.with_sql(SCORED, CELLS, f"SELECT {rates_sql(columns)} FROM cells"))
    def run(spark, sf):
        return _round(metrics.scores(metrics.confusion(fx.scored(spark, sf))).select(*columns), columns)


_rates("a05_scores", ["accuracy", "precision", "recall", "f1"])
_rates("a06_error_rates", ["fpr", "fnr"])
_rates("a07_specificity_npv", ["specificity", "npv"])

_HIST = "h AS (SELECT prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM scored GROUP BY prob)"


@query(
    "a08_auc",
    fx.with_sql(
        SCORED, _HIST,
        "c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM h)",
        "SELECT round(sum(neg * (over + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c",
    ),
)
def a08(spark, sf):
    return _round(metrics.auc(fx.scored(spark, sf)), ["auc"])


@query(
    "a08_auc_quality",
    """WITH s AS (SELECT quality AS y, round(toxic * 0.4 + quality * 0.3, 6) AS p FROM labels),
       h AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
       c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM h)
       SELECT round(sum(neg * (over + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""",
)
def a08_quality(spark, sf):
    df = fx.table(spark, sf, "labels").select(
        "quality", F.round(F.col("toxic") * 0.4 + F.col("quality") * 0.3, 6).alias("prob")
    )
    return _round(metrics.auc(df, "quality"), ["auc"])


_ROC = """roc AS (SELECT prob AS threshold,
    sum(neg) OVER (ORDER BY prob DESC) / sum(neg) OVER () AS fpr,
    sum(pos) OVER (ORDER BY prob DESC) / sum(pos) OVER () AS tpr FROM h)"""


@query(
    "a09_roc_curve",
    fx.with_sql(SCORED, _HIST, _ROC, "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc"),
)
def a09(spark, sf):
    return _round(metrics.roc(fx.scored(spark, sf)), ["fpr", "tpr"])


@query(
    "a09_roc_area",
    fx.with_sql(
        SCORED, _HIST, _ROC,
        "l AS (SELECT fpr, tpr, lag(fpr, 1, 0) OVER (ORDER BY fpr, tpr) AS f0, lag(tpr, 1, 0) OVER (ORDER BY fpr, tpr) AS t0 FROM roc)",
        "SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS area FROM l",
    ),
)
def a09_area(spark, sf):
    return _round(metrics.roc_area(metrics.roc(fx.scored(spark, sf))), ["area"])


@query(
    "a10_classification_report",
    fx.with_sql(
        SCORED, CELLS,
        "m AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS s0, tp + fn AS s1 FROM cells)",
        "f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS n, (tn + tp) / (s0 + s1) AS acc FROM m)",
        """t AS (SELECT 'Benign' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
             UNION ALL SELECT 'Attack', p1, r1, f1, s1 FROM f
             UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
             UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
             UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f)""",
        "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM t",
    ),
)
def a10(spark, sf):
    return _round(metrics.report(fx.scored(spark, sf)), ["precision", "recall", "f1"])


def _sweep(first, last):
    return f"""g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range({first}, {last + 1}) t(i)),
      w AS (SELECT threshold, count(*) FILTER (y_true = 0 AND NOT prob > threshold) AS tn,
        count(*) FILTER (y_true = 0 AND prob > threshold) AS fp,
        count(*) FILTER (y_true = 1 AND NOT prob > threshold) AS fn,
        count(*) FILTER (y_true = 1 AND prob > threshold) AS tp FROM scored, g GROUP BY threshold)"""


_SWEEP_COLUMNS = ["threshold", "tn", "fp", "fn", "tp", "accuracy", "f1"]


@query(
    "a11_best_accuracy_threshold",
    fx.with_sql(
        SCORED, _sweep(35, 65),
        f"""SELECT threshold, tn, fp, fn, tp, {rates_sql(['accuracy', 'f1'])} FROM w
            ORDER BY (tp + tn) DESC, 2 * tp / (2 * tp + fp + fn) DESC, w.threshold LIMIT 1""",
    ),
)
def a11(spark, sf):
    best = metrics.best_threshold(metrics.threshold_sweep(fx.scored(spark, sf), 35, 65))
    return _round(best.select(*_SWEEP_COLUMNS), ["accuracy", "f1"])


@query(
    "a12_best_f1_threshold",
    fx.with_sql(
        SCORED, _sweep(30, 69),
        f"""SELECT threshold, tn, fp, fn, tp, {rates_sql(['accuracy', 'f1'])} FROM w
            ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, w.threshold LIMIT 1""",
    ),
)
def a12(spark, sf):
    best = metrics.best_threshold(metrics.threshold_sweep(fx.scored(spark, sf), 30, 69), ["f1"])
    return _round(best.select(*_SWEEP_COLUMNS), ["accuracy", "f1"])


@query(
    "a12_threshold_sweep",
    fx.with_sql(SCORED, _sweep(30, 69), f"SELECT threshold, tn, fp, fn, tp, {rates_sql(['accuracy', 'f1'])} FROM w"),
)
def a12_sweep(spark, sf):
    sweep = metrics.threshold_sweep(fx.scored(spark, sf), 30, 69)
    return _round(sweep.select(*_SWEEP_COLUMNS), ["accuracy", "f1"])


@query(
    "a13_operating_point",
    fx.with_sql(
        SCORED, _HIST, _ROC,
        """SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc
           ORDER BY abs(threshold - 0.42::DOUBLE), roc.threshold DESC LIMIT 1""",
    ),
)
def a13(spark, sf):
    point = metrics.operating_point(metrics.roc(fx.scored(spark, sf)), 0.42)
    return _round(point, ["fpr", "tpr"])


FOLDS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {H}) - 1 AS o,
      count(*) OVER (PARTITION BY y_true) AS n FROM scored),
    f AS (SELECT *, list_sum([(o >= n * i // 5)::INT FOR i IN [1, 2, 3, 4]])::INT AS fold FROM r),
    fc AS (SELECT fold, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
      count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM f GROUP BY fold)"""


def _fold_scores(spark, sf):
    folds = kfold(fx.scored(spark, sf), "flow_key", label="y_true")
    return metrics.scores(metrics.confusion(folds, "fold"))


@query(
    "a14_fold_summary",
    fx.with_sql(
        SCORED, FOLDS,
        "s AS (SELECT (tp + tn) / (tn + fp + fn + tp) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1 FROM fc)",
        """SELECT 'accuracy' AS metric, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std FROM s
           UNION ALL SELECT 'f1', round(avg(f1), 6), round(stddev_samp(f1), 6) FROM s""",
    ),
)
def a14(spark, sf):
    return _round(metrics.fold_summary(_fold_scores(spark, sf), ["accuracy", "f1"]), ["mean", "std"])


@query(
    "a15_summed_confusion",
    fx.with_sql(
        SCORED, FOLDS,
        "t AS (SELECT sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM fc)",
        f"SELECT tn, fp, fn, tp, {rates_sql(['accuracy'])} FROM t",
    ),
)
def a15(spark, sf):
    total = metrics.summed_confusion(_fold_scores(spark, sf))
    return _round(total.select("tn", "fp", "fn", "tp", "accuracy"), ["accuracy"])


def _models(spark, sf):
    """Two thresholds of one scorer, as if they were two models."""
    df = fx.scored(spark, sf)
    rows = []
    for name, t in (("loose", 0.35), ("strict", 0.65)):
        guess = df.withColumn("y_pred", F.when(F.col("prob") > t, 1).otherwise(0))
        rows.append(metrics.scores(metrics.confusion(guess)).withColumn("model", F.lit(name)))
    return rows[0].unionByName(rows[1])


MODELS = """ms AS (SELECT m.model, count(*) FILTER (y_true = 0 AND NOT prob > t) AS tn, count(*) FILTER (y_true = 0 AND prob > t) AS fp,
    count(*) FILTER (y_true = 1 AND NOT prob > t) AS fn, count(*) FILTER (y_true = 1 AND prob > t) AS tp
    FROM scored, (VALUES ('loose', 0.35::DOUBLE), ('strict', 0.65::DOUBLE)) m(model, t) GROUP BY m.model)"""


@query(
    "j07_comparison_table",
    fx.with_sql(SCORED, MODELS, f"SELECT model, {rates_sql(['accuracy', 'precision', 'recall', 'f1'])} FROM ms"),
)
def j07(spark, sf):
    columns = ["accuracy", "precision", "recall", "f1"]
    return _round(_models(spark, sf).select("model", *columns), columns)


@query(
    "a16_percent_table",
    fx.with_sql(
        SCORED, MODELS,
        """SELECT model, printf('%.2f', 100.0 * (tp + tn) / (tn + fp + fn + tp)) || '%' AS accuracy_pct,
             printf('%.2f', 100.0 * 2 * tp / (2 * tp + fp + fn)) || '%' AS f1_pct FROM ms""",
    ),
)
def a16(spark, sf):
    table = metrics.compare(_models(spark, sf), ["accuracy", "f1"])
    return table.select("model", "accuracy_pct", "f1_pct")


@query(
    "a17_improvement",
    fx.with_sql(SCORED, MODELS, "SELECT model, round(((tp + tn) / (tn + fp + fn + tp) - 0.5) / 0.5 * 100, 6) AS improvement FROM ms"),
)
def a17(spark, sf):
    gain = metrics.improvement(_models(spark, sf), "accuracy", 0.5)
    return _round(gain.select("model", "improvement"), ["improvement"])


TIMINGS = "tm AS (SELECT 1 << (event_id % 6)::INT AS batch_size, value AS total_ms FROM events)"
SUMMARY = """sm AS (SELECT batch_size, avg(total_ms / batch_size) AS latency_ms, stddev_pop(total_ms / batch_size) AS std_latency,
    1000.0 / avg(total_ms / batch_size) AS throughput FROM tm GROUP BY batch_size)"""


def _timings(spark, sf):
    size = F.pow(F.lit(2), F.col("event_id") % 6).cast("int")
    return fx.table(spark, sf, "events").select(
        size.alias("batch_size"), F.col("value").alias("total_ms")
    )


@query(
    "a18_latency_summary",
    fx.with_sql(
        TIMINGS, SUMMARY,
        "SELECT batch_size, round(latency_ms, 6) AS latency_ms, round(std_latency, 6) AS std_latency, round(throughput, 4) AS throughput FROM sm",
    ),
)
def a18(spark, sf):
    out = _round(metrics.latency_summary(_timings(spark, sf)), ["latency_ms", "std_latency"])
    return out.withColumn("throughput", F.round("throughput", 4))


@query(
    "a19_capability_tiers",
    fx.with_sql(
        TIMINGS, SUMMARY,
        """SELECT batch_size,
             CASE WHEN latency_ms < 1 THEN 'Real-time' WHEN latency_ms < 10 THEN 'Near real-time'
               WHEN latency_ms < 100 THEN 'Batch mode' ELSE 'Not suitable' END AS capability,
             CASE WHEN throughput >= 100000 THEN '10 Gbps+' WHEN throughput >= 10000 THEN '1 Gbps' ELSE 'Sub-Gbps' END AS network_capacity
           FROM sm""",
    ),
)
def a19(spark, sf):
    tiers = metrics.capability(metrics.latency_summary(_timings(spark, sf)))
    return tiers.select("batch_size", "capability", "network_capacity")


@query(
    "a20_best_epoch",
    """WITH log AS (SELECT day(ts) - 1 AS epoch, round(avg(value), 4) AS val_auc FROM events GROUP BY 1)
       SELECT epoch + 1 AS best_epoch, val_auc FROM log ORDER BY val_auc DESC, epoch LIMIT 1""",
)
def a20(spark, sf):
    log = (
        fx.table(spark, sf, "events")
        .groupBy((F.dayofmonth("ts") - 1).cast("long").alias("epoch"))
        .agg(F.round(F.avg("value"), 4).alias("val_auc"))
    )
    return metrics.best_epoch(log)


@query(
    "a24_balance_check",
    fx.with_sql(
        FLOWS,
        """SELECT count(*) FILTER (label = 0) AS benign, count(*) AS total, round(count(*) FILTER (label = 0) / count(*), 6) AS benign_share,
             abs(count(*) FILTER (label = 0) / count(*) - 0.7) <= 0.05 AS balanced FROM flows""",
    ),
)
def a24(spark, sf):
    return _round(metrics.balance_check(fx.flows(spark, sf)), ["benign_share"])


@query(
    "a25_predicted_counts",
    fx.with_sql(SCORED, "SELECT y_pred, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM scored GROUP BY 1"),
)
def a25(spark, sf):
    return _round(metrics.class_distribution(fx.scored(spark, sf), "y_pred"), ["percent"])


@query(
    "a27_fnr_tier",
    fx.with_sql(
        SCORED, MODELS,
        """SELECT model, round(fn / (fn + tp), 6) AS fnr, CASE WHEN 100.0 * fn / (fn + tp) < 5 THEN 'excellent'
             WHEN 100.0 * fn / (fn + tp) < 10 THEN 'good' ELSE 'needs improvement' END AS tier FROM ms""",
    ),
)
def a27(spark, sf):
    return _round(metrics.fnr_tier(_models(spark, sf)).select("model", "fnr", "tier"), ["fnr"])


# ---- joins on scored rows ------------------------------------------------


@query(
    "j04_labeled_selection",
    fx.with_sql(
        FLOWS,
        f"lab AS (SELECT flow_key FROM flows ORDER BY {H} LIMIT 3000)",
        "SELECT flow_key, label, flow_key IN (SELECT flow_key FROM lab) AS labeled FROM flows",
    ),
)
def j04(spark, sf):
    from flowloom.operators.sampling import exact_n

    df = fx.flows(spark, sf).select("flow_key", "label")
    labeled = scratch.materialise(exact_n(df, "flow_key", 3000).select("flow_key"), "labeled")
    return (
        df.join(labeled, "flow_key", "left_semi")
        .withColumn("labeled", F.lit(True))
        .unionByName(df.join(labeled, "flow_key", "left_anti").withColumn("labeled", F.lit(False)))
    )


@query(
    "j05_align_truth",
    fx.with_sql(
        SCORED,
        "SELECT flow_key, s.y_true, s.y_pred, f.label = s.y_pred AS correct FROM scored s JOIN flows f USING (flow_key)",
    ),
)
def j05(spark, sf):
    truth = fx.flows(spark, sf).select("flow_key", "label")
    joined = fx.scored(spark, sf).join(truth, "flow_key")
    return joined.select(
        "flow_key", "y_true", "y_pred", (F.col("label") == F.col("y_pred")).alias("correct")
    )


@query(
    "j09_complement",
    fx.with_sql(
        FLOWS,
        f"lab AS (SELECT flow_key FROM flows ORDER BY {H} LIMIT 3000)",
        "SELECT label, count(*) AS n FROM flows WHERE flow_key NOT IN (SELECT flow_key FROM lab) GROUP BY label",
    ),
)
def j09(spark, sf):
    from flowloom.operators.sampling import exact_n

    df = fx.flows(spark, sf).select("flow_key", "label")
    rest = df.join(exact_n(df, "flow_key", 3000).select("flow_key"), "flow_key", "left_anti")
    return rest.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- uncertainty ---------------------------------------------------------


def _uncertainty(name, fn, sql):
    @query(name, fx.with_sql(SCORED, f"SELECT flow_key, round({sql}, 6) + 0.0 AS score FROM scored"))
    def run(spark, sf):
        p = F.col("prob")
        return fx.scored(spark, sf).select("flow_key", (F.round(fn([1 - p, p]), 6) + 0.0).alias("score"))


_uncertainty(
    "l03_entropy", numeric.entropy, "-((1 - prob) * ln((1 - prob) + 1e-10) + prob * ln(prob + 1e-10))"
)
_uncertainty("l04_margin", numeric.margin, "-abs(1 - 2 * prob)")
