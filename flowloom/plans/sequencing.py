"""Queries: sequences and top-k."""

from pyspark.sql import functions as F

from flowloom.operators import sequences
from flowloom.operators.ordering import top_n
from flowloom.plans import fixtures as fx
from flowloom.plans.registry import query

EV = fx.EVENTS_SQL
NUMBERED = "o AS (SELECT *, row_number() OVER (ORDER BY ts, flow_id) - 1 AS o FROM ev)"
WHOLE = "g AS (SELECT o // 10 AS seq_id, o % 10 AS step, x0, x1, label FROM o WHERE o // 10 < (SELECT count(*) // 10 FROM o))"


def _steps(df, keys):
    """One row per step of a sequence."""
    return df.select(*keys, "label", F.posexplode("steps").alias("step", "x")).select(
        *keys, F.col("step").cast("long").alias("step"), F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")
    )


@query("q01_tumbling_sequences", fx.with_sql(EV, NUMBERED, WHOLE, "SELECT seq_id, step, x0, x1 FROM g"))
def q01(spark, sf):
    df = fx.events(spark, sf)
    return _steps(sequences.tumbling(df, ["ts", "flow_id"], ["x0", "x1"]), ["seq_id"])


@query(
    "q01_tumbling_per_key",
    fx.with_sql(
        EV,
        "o AS (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY ts, flow_id) - 1 AS o, count(*) OVER (PARTITION BY stream_key) AS n FROM ev)",
        "SELECT stream_key, o // 10 AS seq_id, o % 10 AS step, x0, x1 FROM o WHERE o // 10 < n // 10",
    ),
)
def q01_key(spark, sf):
    df = fx.events(spark, sf)
    cut = sequences.tumbling(df, ["ts", "flow_id"], ["x0", "x1"], per=["stream_key"])
    return _steps(cut, ["stream_key", "seq_id"])


@query("q02_sequence_label", fx.with_sql(EV, NUMBERED, WHOLE, "SELECT seq_id, label FROM g WHERE step = 9"))
def q02(spark, sf):
    cut = sequences.tumbling(fx.events(spark, sf), ["ts", "flow_id"], ["x0", "x1"])
    return cut.select("seq_id", "label")


def _signature(buffer, i):
    """Position-weighted sum, so that a wrong order of steps shows."""
    places = F.sequence(F.lit(1), F.size(buffer))
    return F.aggregate(
        F.zip_with(buffer, places, lambda x, p: x[i] * p), F.lit(0.0), lambda s, v: s + v
    )


BUFFER = """b AS (SELECT flow_id, list(x0) OVER w AS xs FROM ev
    WINDOW w AS (PARTITION BY stream_key ORDER BY ts, flow_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW))"""


@query(
    "q03_sliding_zero_pad",
    fx.with_sql(
        EV, BUFFER.format(9),
        """SELECT flow_id, CAST(10 AS INT) AS steps,
             round(list_sum([x * i FOR x, i IN xs]) + 1e-7, 4) AS signature FROM b""",
    ),
)
def q03(spark, sf):
    df = fx.events(spark, sf).withColumn("features", F.array("x0", "x1"))
    slid = sequences.sliding(df, "stream_key", ["ts", "flow_id"], "features", 10)
    return sequences.pad_zero(slid, 2, 10).select(
        "flow_id", F.size("buffer").alias("steps"), F.round(_signature("buffer", 0) + 1e-7, 4).alias("signature")
    )


@query(
    "q04_sliding_mean_pad",
    fx.with_sql(
        EV, BUFFER.format(49),
        "p AS (SELECT flow_id, xs || [list_avg(xs) FOR i IN range(10 - len(xs))] AS xs FROM b)",
        """SELECT flow_id, CAST(len(xs) AS INT) AS steps,
             round(list_sum([x * i FOR x, i IN xs]) + 1e-7, 4) AS signature FROM p""",
    ),
)
def q04(spark, sf):
    df = fx.events(spark, sf).withColumn("features", F.array("x0", "x1"))
    slid = sequences.sliding(df, "stream_key", ["ts", "flow_id"], "features", 50)
    return sequences.pad_mean(slid, 2, 10).select(
        "flow_id", F.size("buffer").alias("steps"), F.round(_signature("buffer", 0) + 1e-7, 4).alias("signature")
    )


@query(
    "q05_feature_steps",
    fx.with_sql(
        fx.VECTORS_SQL,
        "SELECT row_id, unnest(range(64))::INT AS step, 1 AS width, unnest([round(x, 6) FOR x IN features]) AS value FROM vectors",
    ),
)
def q05(spark, sf):
    df = sequences.as_steps(fx.vectors(spark, sf))
    return df.select("row_id", F.posexplode("steps").alias("step", "x")).select(
        "row_id", "step", F.size("x").alias("width"), F.round(F.col("x")[0], 6).alias("value")
    )


@query(
    "q06_equal_steps",
    fx.with_sql(
        fx.VECTORS_SQL,
        "w AS (SELECT row_id, features || [0.0, 0.0, 0.0, 0.0, 0.0, 0.0] AS f FROM vectors)",
        "s AS (SELECT row_id, i::INT AS step, f[i * 7 + 1 : i * 7 + 7] AS x FROM w, range(10) t(i))",
        "SELECT row_id, step, len(x)::INT AS width, round(x[1], 6) AS first, round(x[7], 6) AS last FROM s",
    ),
)
def q06(spark, sf):
    df = sequences.equal_steps(fx.vectors(spark, sf), fx.WIDTH, 10)
    return df.select("row_id", F.posexplode("steps").alias("step", "x")).select(
        "row_id", "step", F.size("x").alias("width"),
        F.round(F.col("x")[0], 6).alias("first"), F.round(F.col("x")[6], 6).alias("last"),
    )


@query(
    "q07_top_k",
    fx.with_sql(fx.SCORED_SQL, "SELECT flow_key, prob FROM scored ORDER BY prob DESC, scored.flow_key LIMIT 100"),
)
def q07(spark, sf):
    return top_n(fx.scored(spark, sf), "prob", 100, "flow_key").select("flow_key", "prob")
