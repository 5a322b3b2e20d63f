"""Queries: ordering, samples, splits, balancing."""

from pyspark.sql import functions as F

from flowloom.operators import sampling, splitting
from flowloom.plans import fixtures as fx
from flowloom.plans.registry import query
from flowloom.sources import scratch, sinks

FLOWS = fx.FLOWS_SQL
H = fx.hash_sql("flow_key")
PER_CLASS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) - 1 AS o,
    count(*) OVER (PARTITION BY label) AS n FROM flows)"""


@query(
    "p30_renumber",
    fx.with_sql(FLOWS, f"SELECT flow_key, row_number() OVER (ORDER BY {H}) - 1 AS flow_id, qty FROM flows"),
)
def p30(spark, sf):
    return sampling.renumber(fx.flows(spark, sf), "flow_key").select("flow_key", "flow_id", "qty")


@query(
    "q08_permutation",
    fx.with_sql(
        FLOWS,
        f"SELECT flow_key, label, row_number() OVER (PARTITION BY label ORDER BY {fx.hash_sql('flow_key', 7)}) - 1 AS position FROM flows",
    ),
)
def q08(spark, sf):
    from flowloom.operators.ordering import shuffled_ordinal

    df = fx.flows(spark, sf).select("flow_key", "label")
    return shuffled_ordinal(df, "flow_key", ["label"], 7, "position")


@query(
    "r01_ratio_per_file",
    fx.with_sql(
        FLOWS,
        f"""r AS (SELECT *, row_number() OVER (PARTITION BY source_file, label ORDER BY {H}) AS r,
              count(*) OVER (PARTITION BY source_file, label) AS n FROM flows)""",
        """SELECT flow_key, source_file, label FROM r
           WHERE r <= greatest(1, floor(n * CASE label WHEN 1 THEN 0.25 ELSE 0.125 END))""",
    ),
)
def r01(spark, sf):
    picked = sampling.ratio_per_file(fx.flows(spark, sf), "flow_key", {0: 0.125, 1: 0.25})
    return picked.select("flow_key", "source_file", "label")


def _classes(benign, attack):
    return f"SELECT flow_key, label FROM r WHERE o < CASE label WHEN 0 THEN {benign} ELSE {attack} END"


@query(
    "r02_trim_total",
    fx.with_sql(FLOWS, PER_CLASS, _classes(3500, 1500)),
)
def r02(spark, sf):
    return sampling.trim_total(fx.flows(spark, sf), "flow_key", 5000).select("flow_key", "label")


def _balanced(name, share):
    """A balanced sample of that share of all rows."""

    @query(
        name,
        fx.with_sql(
            FLOWS, PER_CLASS,
            f"a AS (SELECT count(*) FILTER (label = 1) AS a, CAST(floor(count(*) * {share}::DOUBLE) AS BIGINT) AS total FROM flows)",
            "w AS (SELECT a, total, CAST(floor(total * 0.3::DOUBLE) AS BIGINT) AS attack FROM a)",
            """t AS (SELECT least(a, attack) AS attack,
                   CASE WHEN a < attack THEN CAST(floor(a * (1 - 0.3::DOUBLE) / 0.3::DOUBLE) AS BIGINT) ELSE total - attack END AS benign FROM w)""",
            "SELECT flow_key, label FROM r, t WHERE o < CASE label WHEN 0 THEN benign ELSE attack END",
        ),
    )
    def run(spark, sf):
        df = fx.flows(spark, sf)
        return sampling.balanced(df, "flow_key", int(df.count() * share)).select("flow_key", "label")


# Attacks are about a quarter of the rows: enough for half of the table, too few for nearly all of it.
_balanced("r03_balanced_sample", 0.5)
_balanced("r03_balanced_too_few", 0.95)


@query(
    "r04_exact_n",
    fx.with_sql(FLOWS, f"SELECT flow_key, price FROM flows ORDER BY {H} LIMIT 1000"),
)
def r04(spark, sf):
    return sampling.exact_n(fx.flows(spark, sf), "flow_key", 1000).select("flow_key", "price")


@query(
    "r05_fraction",
    fx.with_sql(FLOWS, f"SELECT flow_key, price FROM flows WHERE {fx.uniform_sql('flow_key')} < 0.1"),
)
def r05(spark, sf):
    return sampling.fraction(fx.flows(spark, sf), "flow_key", 0.1).select("flow_key", "price")


@query(
    "r06_stratified_split",
    fx.with_sql(
        FLOWS, PER_CLASS,
        """SELECT flow_key, label, CASE WHEN o < n * 7 // 10 THEN 'train' WHEN o < n * 85 // 100 THEN 'val' ELSE 'test' END AS split
           FROM r""",
    ),
)
def r06(spark, sf):
    return splitting.stratified(fx.flows(spark, sf), "flow_key").select("flow_key", "label", "split")


@query(
    "r07_kfold",
    fx.with_sql(
        FLOWS, PER_CLASS,
        "SELECT flow_key, label, list_sum([(o >= n * i // 5)::INT FOR i IN [1, 2, 3, 4]])::INT AS fold FROM r",
    ),
)
def r07(spark, sf):
    return splitting.kfold(fx.flows(spark, sf), "flow_key").select("flow_key", "label", "fold")


@query(
    "s10_write_folds",
    fx.with_sql(
        FLOWS, PER_CLASS,
        "f AS (SELECT label, qty, list_sum([(o >= n * i // 5)::INT FOR i IN [1, 2, 3, 4]])::INT AS fold FROM r)",
        "SELECT fold, label, count(*) AS n, round(sum(qty), 2) AS qty FROM f GROUP BY fold, label",
    ),
)
def s10(spark, sf):
    folder = scratch.new_path(spark, "folds")
    sinks.write_table(splitting.kfold(fx.flows(spark, sf), "flow_key"), folder, "parquet", ["fold"])
    saved = spark.read.parquet(folder)
    return saved.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 2).alias("qty")
    )


@query(
    "r08_temporal_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS o, count(*) OVER () AS n FROM events)
       SELECT event_id, CASE WHEN o < n * 7 // 10 THEN 'train' WHEN o < n * 85 // 100 THEN 'val' ELSE 'test' END AS split FROM r""",
)
def r08(spark, sf):
    df = fx.table(spark, sf, "events").select("event_id", "ts")
    return splitting.temporal(df, "ts", "event_id").select("event_id", "split")


@query(
    "r09_smote",
    fx.with_sql(
        fx.VECTORS_SQL,
        f"""m AS (SELECT row_id, features, row_number() OVER (ORDER BY {fx.hash_sql('row_id')}) - 1 AS o, count(*) OVER () AS n
             FROM vectors WHERE label = 1)""",
        "t AS (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS missing FROM vectors)",
        """pairs AS (SELECT a.row_id AS src, b.row_id AS dst, list_distance(a.features, b.features) AS distance
             FROM m a, m b WHERE a.row_id <> b.row_id)""",
        "near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs)",
        "b AS (SELECT row_id, features, unnest(range(ceil((missing - o) / n)::BIGINT)) AS round FROM m, t WHERE o < missing)",
        "p AS (SELECT *, concat_ws('|', row_id, round) AS pick FROM b)",
        f"""s AS (SELECT p.row_id, p.features AS x, o.features AS y, {fx.uniform_sql('pick', 43)} AS u FROM p
             JOIN near ON src = p.row_id AND rank = floor({fx.uniform_sql('pick')} * 5) + 1 JOIN m o ON o.row_id = dst)""",
        """SELECT row_id, label, false AS synthetic, round(list_avg(features), 6) + 0.0 AS mean FROM vectors
           UNION ALL SELECT row_id, 1, true, round(list_avg(x) + (list_avg(y) - list_avg(x)) * u, 6) + 0.0 FROM s""",
    ),
)
def r09(spark, sf):
    v = fx.vectors(spark, sf)
    counts = sampling.class_counts(v)
    made = sampling.smote(v, "row_id", "features", {1: counts[0]})
    mean = F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")
    return made.select("row_id", "label", "synthetic", (F.round(mean, 6) + 0.0).alias("mean"))


@query(
    "r10_under_sample",
    fx.with_sql(FLOWS, PER_CLASS, "m AS (SELECT min(n) AS m FROM r)", "SELECT flow_key, label FROM r, m WHERE o < m"),
)
def r10(spark, sf):
    return sampling.under_sample(fx.flows(spark, sf), "flow_key").select("flow_key", "label")


@query(
    "r11_class_weights",
    fx.with_sql(
        FLOWS,
        "c AS (SELECT label, count(*) AS n FROM flows GROUP BY 1)",
        """SELECT label, n, round(CASE label WHEN 0 THEN 0.9 ELSE 0.85 END * sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
           FROM c""",
    ),
)
def r11(spark, sf):
    weights = sampling.class_weights(fx.flows(spark, sf), "label", {0: 0.9, 1: 0.85})
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "r12_fixed_weights",
    fx.with_sql(FLOWS, "SELECT flow_key, label, CASE label WHEN 0 THEN 0.8::DOUBLE ELSE 1.75::DOUBLE END AS weight FROM flows"),
)
def r12(spark, sf):
    df = fx.flows(spark, sf).select("flow_key", "label")
    return sampling.fixed_weights(df, {0: 0.80, 1: 1.75})


@query(
    "r13_display_sample",
    fx.with_sql(
        fx.SCORED_SQL,
        f"""SELECT flow_key, y_true, y_pred, printf('%.4f', prob) AS prob FROM scored
            ORDER BY {fx.hash_sql('flow_key', 9)} LIMIT 20""",
    ),
)
def r13(spark, sf):
    df = sampling.exact_n(fx.scored(spark, sf), "flow_key", 20, seed=9)
    return df.withColumn("prob", F.format_string("%.4f", "prob"))
