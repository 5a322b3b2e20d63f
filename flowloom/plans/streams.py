"""Queries: the online detector over replayed events."""

from pyspark.sql import functions as F

from flowloom.functions import numeric
from flowloom.operators import scaling
from flowloom.plans import fixtures as fx
from flowloom.plans.registry import query
from flowloom.sources import packets, scratch
from flowloom.streaming import detect

EXTRA = "stream_key LONG, seq LONG"
EV = fx.EVENTS_SQL
# The made-up score of a buffer: logistic of a weighted sum of its feature means over ten steps.
FRAME = "ORDER BY ts, flow_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"
SCALED = """m AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM ev),
  z AS (SELECT ev.*, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1 FROM ev, m)"""


def _prob(part):
    """SQL of the score over the ten rows that a partition ends in."""
    mean = lambda c: f"sum({c}) OVER (PARTITION BY {part} {FRAME}) / 10"
    return f"1 / (1 + exp(-2 * {mean('z0')} + {mean('z1')}))"


SCORE = f"""{SCALED},
  p AS (SELECT flow_id, stream_key, label AS true_label, {_prob('stream_key')} AS prob FROM z),
  v AS (SELECT *, CASE WHEN round(prob, 9) >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM p)"""
COUNTS = """c AS (SELECT stream_key % 7 AS sensor, count(*) AS total, count(*) FILTER (y_pred = 1) AS detected_attack,
    count(*) FILTER (y_pred = 0) AS detected_benign,
    count(*) FILTER (true_label = 0 AND y_pred = 0) AS tn, count(*) FILTER (true_label = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (true_label = 1 AND y_pred = 0) AS fn, count(*) FILTER (true_label = 1 AND y_pred = 1) AS tp
    FROM v GROUP BY 1)"""


def _lines(spark, sf):
    """Events as packet lines with their order; every 50th line is cut short."""
    df = fx.events(spark, sf).withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    lines = packets.encode(df, "flow_id", ["x0", "x1"], "label", ["stream_key", "seq"])
    seq = F.get_json_object("value", "$.seq").cast("double")
    number = F.get_json_object("value", "$.flow_id").cast("long")
    return lines.withColumns({"at": seq, "number": number})


def _feed(spark, lines):
    folder = scratch.new_path(spark, "feed")
    detect.replay(lines, folder, "at", ties=["number"])
    return folder


def _drain(spark, stream):
    """Everything a stream yields, as a table."""
    out = scratch.new_path(spark, "drain")
    (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/rows")


@query(
    "t01_parse_lines",
    fx.with_sql(
        EV,
        "SELECT flow_id, CAST(2 AS INT) AS width, label AS true_label, flow_id % 50 <> 0 AS readable FROM ev",
    ),
)
def t01(spark, sf):
    lines = _lines(spark, sf)
    number = F.get_json_object("value", "$.flow_id").cast("long")
    broken = F.expr("substring(value, 1, length(value) - 1)")
    feed = _feed(spark, lines.withColumn("value", F.when(number % 50 == 0, broken).otherwise(F.col("value"))))
    good, bad = detect.read_flows(spark, feed, EXTRA, 1)
    good = _drain(spark, good.select("flow_id", F.size("features").alias("width"), "true_label"))
    bad = _drain(spark, bad)
    # The cut line still shows its number and label to a lenient look.
    found = bad.select(
        F.regexp_extract("value", r'"flow_id":(\d+)', 1).cast("long").alias("flow_id"),
        F.lit(2).alias("width"),
        F.regexp_extract("value", r'"true_label":(\d)', 1).cast("int").alias("true_label"),
        F.lit(False).alias("readable"),
    )
    return good.withColumn("readable", F.lit(True)).unionByName(found)


@query(
    "t02_reject_width",
    fx.with_sql(EV, "SELECT flow_id, label AS true_label, x1 <> 7 AS accepted FROM ev"),
)
def t02(spark, sf):
    """Packets that lost a feature on the way are set aside by the detector."""
    short = F.when(F.col("features")[1] == 7, F.slice("features", 1, 1)).otherwise(F.col("features"))
    detector = _detect(spark, sf, lambda flows: flows.withColumn("features", short))
    rejected = spark.read.parquet(f"{detector.out}/rejected")
    return (
        detector.results(spark).select("flow_id", "true_label", F.lit(True).alias("accepted"))
        .unionByName(rejected.select("flow_id", "true_label", F.lit(False).alias("accepted")))
    )


@query(
    "t03_normalise_stream",
    fx.with_sql(
        EV,
        "m AS (SELECT avg(x0) AS a, stddev_pop(x0) AS s, avg(x1) AS b, stddev_pop(x1) AS t FROM ev)",
        "SELECT flow_id, round((x0 - a) / s, 6) + 0.0 AS x0, round((x1 - b) / t, 6) + 0.0 AS x1 FROM ev, m",
    ),
)
def t03(spark, sf):
    params = scaling.fit(fx.events(spark, sf), ["x0", "x1"])
    good, _ = detect.read_flows(spark, _feed(spark, _lines(spark, sf)), EXTRA, 1)
    scaled = _drain(spark, scaling.apply_to_vector(good, params).select("flow_id", "features"))
    return scaled.select(
        "flow_id", *[(F.round(F.col("features")[i], 6) + 0.0).alias(f"x{i}") for i in (0, 1)]
    )


def _score(df):
    """Logistic of a weighted sum of both feature means over the padded buffer."""
    total = F.aggregate("buffer", F.lit(0.0), lambda s, x: s - 2 * x[0] + x[1])
    return df.withColumn("prob", 1 / (1 + F.exp(total / F.size("buffer"))))


def _detect(spark, sf, change=lambda flows: flows, **options):
    params = scaling.fit(fx.events(spark, sf), ["x0", "x1"])
    flows, _ = detect.read_flows(spark, _feed(spark, _lines(spark, sf)), EXTRA, 1)
    detector = detect.Detector(
        params, 2, detect.zero_padded(2), _score, scratch.new_path(spark, "detector"),
        key=["stream_key"], order=["seq"], **options,
    )
    detector.run(change(flows))
    return detector


@query("t04_sliding_stream", fx.with_sql(EV, SCORE, "SELECT flow_id, CAST(10 AS INT) AS steps, round(prob, 6) AS prob FROM v"))
def t04(spark, sf):
    out = _detect(spark, sf).results(spark)
    return out.select("flow_id", F.size("buffer").alias("steps"), F.round("prob", 6).alias("prob"))


@query("t05_threshold", fx.with_sql(EV, SCORE, "SELECT y_pred, count(*) AS n FROM v GROUP BY 1"))
def t05(spark, sf):
    out = _detect(spark, sf).results(spark)
    return out.groupBy("y_pred").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t06_confidence",
    fx.with_sql(EV, SCORE, "SELECT flow_id, round(abs(prob - 0.5) * 2, 6) AS confidence FROM v"),
)
def t06(spark, sf):
    out = _detect(spark, sf).results(spark)
    return out.select("flow_id", F.round(numeric.confidence(F.col("prob")), 6).alias("confidence"))


def _counts(spark, sf):
    """Counters that the detector keeps next to its verdicts."""
    return _detect(spark, sf, count_by={"sensor": F.col("stream_key") % 7}).counts(spark)


@query("t07_running_counts", fx.with_sql(EV, SCORE, COUNTS, "SELECT * FROM c"))
def t07(spark, sf):
    return _counts(spark, sf)


@query(
    "t08_stream_summary",
    fx.with_sql(
        EV, SCORE, COUNTS,
        """SELECT sensor, total, tn, fp, fn, tp, round(100 * (tp + tn) / total, 4) AS accuracy,
             round(coalesce(100 * tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(100 * tp / nullif(tp + fn, 0), 0), 4) AS recall,
             round(coalesce(100 * 2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""",
    ),
)
def t08(spark, sf):
    rates = ["accuracy", "precision", "recall", "f1"]
    out = detect.summary(_counts(spark, sf))
    return out.select("sensor", "total", "tn", "fp", "fn", "tp", *[F.round(c, 4).alias(c) for c in rates])


@query(
    "t09_verdicts",
    fx.with_sql(
        EV, SCORE,
        """SELECT flow_id, CASE y_pred WHEN 1 THEN 'Attack' ELSE 'Benign' END AS verdict,
             CASE true_label WHEN 1 THEN 'Attack' ELSE 'Benign' END AS truth, y_pred = true_label AS correct FROM v""",
    ),
)
def t09(spark, sf):
    return _detect(spark, sf).results(spark).select("flow_id", "verdict", "truth", "correct")


@query(
    "t10_replay",
    fx.with_sql(EV, "SELECT flow_id, stream_key, label AS true_label, round(x0, 4) AS x0, x1 FROM ev"),
)
def t10(spark, sf):
    good, _ = detect.read_flows(spark, _feed(spark, _lines(spark, sf)), EXTRA, 1)
    rows = _drain(spark, good)
    return rows.select(
        "flow_id", "stream_key", "true_label",
        F.round(F.col("features")[0], 4).alias("x0"), F.col("features")[1].alias("x1"),
    )


# Buffers of 50 rows, padded with their mean to ten, as graphs of ten nearest rows by cosine; three hops.
GRAPH_SQL = f"""{SCALED},
  o AS (SELECT flow_id, stream_key, z0, z1, row_number() OVER (PARTITION BY stream_key ORDER BY ts, flow_id) AS r FROM z),
  real AS (SELECT a.flow_id, b.r - greatest(a.r - 50, 0) AS i, least(a.r, 50) AS last, b.z0 AS a0, b.z1 AS a1
    FROM o a JOIN o b ON a.stream_key = b.stream_key AND b.r BETWEEN a.r - 49 AND a.r),
  mean AS (SELECT flow_id, max(last) AS last, avg(a0) AS a0, avg(a1) AS a1 FROM real GROUP BY 1),
  buf AS (SELECT flow_id, i, last, a0, a1 FROM real
    UNION ALL SELECT flow_id, unnest(range(last + 1, 11)), last, a0, a1 FROM mean WHERE last < 10),
  unit AS (SELECT *, coalesce(a0 / nullif(sqrt(a0 * a0 + a1 * a1), 0), 0) AS u0, coalesce(a1 / nullif(sqrt(a0 * a0 + a1 * a1), 0), 0) AS u1 FROM buf),
  pick AS (SELECT s.flow_id, s.i AS src, t.i AS dst,
      row_number() OVER (PARTITION BY s.flow_id, s.i ORDER BY 1 - (s.u0 * t.u0 + s.u1 * t.u1), t.i) AS k
    FROM unit s JOIN unit t ON s.flow_id = t.flow_id AND s.i <> t.i),
  link AS (SELECT flow_id, src, dst FROM pick WHERE k <= 10 UNION ALL SELECT flow_id, i, i FROM buf),
  deg AS (SELECT flow_id, dst AS i, count(*) AS d FROM link GROUP BY 1, 2),
  w AS (SELECT l.flow_id, l.src, l.dst, 1 / sqrt(a.d * b.d) AS w FROM link l
    JOIN deg a ON a.flow_id = l.flow_id AND a.i = l.src JOIN deg b ON b.flow_id = l.flow_id AND b.i = l.dst),
  h1 AS (SELECT w.flow_id, w.dst AS i, sum(w.w * x.a0) AS a0, sum(w.w * x.a1) AS a1 FROM w JOIN buf x ON x.flow_id = w.flow_id AND x.i = w.src GROUP BY 1, 2),
  h2 AS (SELECT w.flow_id, w.dst AS i, sum(w.w * x.a0) AS a0, sum(w.w * x.a1) AS a1 FROM w JOIN h1 x ON x.flow_id = w.flow_id AND x.i = w.src GROUP BY 1, 2),
  h3 AS (SELECT w.flow_id, sum(w.w * x.a0) AS a0, sum(w.w * x.a1) AS a1 FROM w JOIN h2 x ON x.flow_id = w.flow_id AND x.i = w.src
    JOIN mean m ON m.flow_id = w.flow_id AND m.last = w.dst GROUP BY 1),
  g AS (SELECT flow_id, 1 / (1 + exp(-2 * a0 + a1)) AS prob FROM h3)"""


@query(
    "t11_buffer_graph",
    fx.with_sql(EV, GRAPH_SQL, "SELECT flow_id, round(prob, 6) AS prob, CASE WHEN round(prob, 9) >= 0.35 THEN 1 ELSE 0 END AS y_pred FROM g"),
)
def t11(spark, sf):
    """Graph detector: mean-padded buffers of 50, threshold 0.35."""
    params = scaling.fit(fx.events(spark, sf), ["x0", "x1"])
    flows, _ = detect.read_flows(spark, _feed(spark, _lines(spark, sf)), EXTRA, 1)
    n, pad = detect.mean_padded(2)

    def rule(df):
        return pad(df.withColumn("real", F.size("buffer")))

    def score(df):
        near = detect.buffer_graph(df)
        return near.withColumn("prob", 1 / (1 + F.exp(-2 * F.col("smoothed")[0] + F.col("smoothed")[1])))

    detector = detect.Detector(
        params, 2, (n, rule), score, scratch.new_path(spark, "detector"),
        key=["stream_key"], order=["seq"], threshold=0.35,
    )
    detector.run(flows)
    return detector.results(spark).select("flow_id", F.round("prob", 6).alias("prob"), "y_pred")


# Every 40th flow arrives 20 days late. A file of the feed is a batch; a row is late when its time, in
# milliseconds, is not after the largest of the files before. Buffers live for three days without a row.
TTL_MS = 3 * 86_400_000
EXPIRY_SQL = f"""{SCALED},
  arr AS (SELECT *, epoch_ms(ts) AS ms, ts + CASE WHEN flow_id % 40 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END AS arrived FROM z),
  pl AS (SELECT *, (row_number() OVER (ORDER BY arrived, flow_id) - 1) * 4 // count(*) OVER () AS file FROM arr),
  top AS (SELECT file, max(max(ms)) OVER (ORDER BY file) AS mark FROM pl GROUP BY file),
  seen AS (SELECT pl.*, coalesce(epoch_us(ts) <= top.mark * 1000, false) AS late FROM pl LEFT JOIN top ON top.file = pl.file - 1),
  own AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY stream_key ORDER BY ts, flow_id) > {TTL_MS}, false) AS fresh FROM seen WHERE NOT late),
  run AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY stream_key ORDER BY ts, flow_id) AS life FROM own),
  p AS (SELECT flow_id, {_prob('stream_key, life')} AS prob FROM run),
  ends AS (SELECT stream_key, life, max(ms) AS ms, least(count(*), 10) AS held, max(life) OVER (PARTITION BY stream_key) AS newest FROM run GROUP BY 1, 2)"""


@query(
    "t12_late_and_expired",
    fx.with_sql(
        EV, EXPIRY_SQL,
        f"""SELECT 'decided' AS kind, flow_id AS id, round(prob, 6) AS value FROM p
          UNION ALL SELECT 'late', flow_id, NULL FROM seen WHERE late
          UNION ALL SELECT 'expired', stream_key, held FROM ends
            WHERE life < newest OR ms + {TTL_MS} <= (SELECT max(mark) FROM top)""",
    ),
)
def t12(spark, sf):
    """Rows behind the watermark are dropped; silent keys lose their buffers."""
    df = fx.events(spark, sf).withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    lines = packets.encode(df, "flow_id", ["x0", "x1"], "label", ["stream_key", "seq"])
    number = F.get_json_object("value", "$.flow_id").cast("long")
    days = F.when(number % 40 == 0, 20).otherwise(0)
    arrived = F.get_json_object("value", "$.seq").cast("long") + days * 86_400_000_000
    feed = _feed(spark, lines.withColumns({"at": arrived, "number": number}))
    flows, _ = detect.read_flows(spark, feed, EXTRA, 1)
    detector = detect.Detector(
        scaling.fit(fx.events(spark, sf), ["x0", "x1"]), 2, detect.zero_padded(2), _score, scratch.new_path(spark, "detector"),
        key=["stream_key"], order=["seq"], event="event", ttl_ms=TTL_MS, buckets=detect.BUCKETS,
    )
    detector.run(flows.withColumn("event", F.timestamp_micros("seq")))
    done = detector.results(spark).select(F.lit("decided").alias("kind"), F.col("flow_id").alias("id"), F.round("prob", 6).alias("value"))
    sent = packets.decode(spark.read.text(feed), EXTRA)[0].select(F.lit("late").alias("kind"), F.col("flow_id").alias("id"))
    late = sent.join(done.select("id"), "id", "left_anti").select("kind", "id", F.lit(None).cast("double").alias("value"))
    gone = detector.expired(spark).select(F.lit("expired"), "stream_key", F.col("expired_rows").cast("double"))
    return done.unionByName(late).union(gone)
