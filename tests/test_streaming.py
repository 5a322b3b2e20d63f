import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import graphs, scaling, sequences
from flowloom.operators.neighbours import knn_edges
from flowloom.sources import packets, scratch
from flowloom.streaming import detect

EXTRA = "key STRING, seq LONG"


@pytest.fixture(scope="module")
def flows(spark):
    """Two thirds of the rows belong to one key."""
    key = F.when(F.col("id") % 3 < 2, "busy").otherwise(F.concat(F.lit("k"), F.col("id") % 4))
    return spark.range(90).select(
        F.col("id").alias("flow_id"), key.alias("key"), F.col("id").alias("seq"),
        (F.col("id") * 7 % 13 * 1.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def feed(spark, flows):
    lines = packets.encode(flows, "flow_id", ["a", "b"], "label", ["key", "seq"])
    lines = lines.withColumn("at", F.get_json_object("value", "$.seq").cast("double"))
    folder = scratch.new_path(spark, "feed")
    detect.replay(lines, folder, "at", 3)
    return folder


def score(df):
    total = F.aggregate("buffer", F.lit(0.0), lambda s, x: s + x[0])
    return df.withColumn("prob", 1 / (1 + F.exp(-total)))


def detector(spark, flows, key, rule=None, score=score):
    params = scaling.fit(flows, ["a", "b"])
    return detect.Detector(
        params, 2, rule or detect.zero_padded(2, 4), score, scratch.new_path(spark, "out"), key=key, order=["seq"]
    )


def batch_scores(flows, key):
    params = scaling.fit(flows, ["a", "b"])
    scaled = scaling.apply(flows, params).withColumn("features", F.array("a", "b"))
    slid = sequences.sliding(scaled, key, ["seq", "flow_id"], "features", 4, chunk=11)
    return {r["flow_id"]: r["prob"] for r in score(sequences.pad_zero(slid, 2, 4)).collect()}


@pytest.mark.parametrize("key", [["key"], []])
def test_stream_equals_batch(spark, flows, key):
    """Also with one buffer for the whole stream, as a single detector has."""
    d = detector(spark, flows, key)
    good, _ = detect.read_flows(spark, feed(spark, flows), EXTRA, 1)
    d.run(good)
    got = {r["flow_id"]: r["prob"] for r in d.results(spark).collect()}
    want = batch_scores(flows, key)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_wrong_width_touches_neither_buffer_nor_counts(spark, flows):
    short = flows.withColumn("flow_id", F.col("flow_id") + 1000)
    for key in (["key"], []):
        d = detector(spark, flows, key)
        d.count_by = {"key": F.col("key")}
        good, _ = detect.read_flows(spark, feed(spark, flows.unionByName(short)), EXTRA, 1)
        one = F.when(F.col("flow_id") < 1000, F.col("features")).when(F.col("flow_id") % 2 == 0, F.slice("features", 1, 1))
        d.run(good.withColumn("features", one))
        assert spark.read.parquet(f"{d.out}/rejected").count() == 90
        want = batch_scores(flows, key)
        got = {r["flow_id"]: r["prob"] for r in d.results(spark).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
        assert d.counts(spark).agg(F.sum("total")).first()[0] == 90


class Broken(Exception):
    pass


@pytest.mark.parametrize("key", [["key"], []])
@pytest.mark.parametrize("at", ["score", "_verdicts", "_count"])
def test_a_crash_loses_nothing(spark, flows, key, at, monkeypatch):
    """The query dies in its second batch, before or after writing, and is started again."""
    d, runs = detector(spark, flows, key), []
    d.count_by = {"key": F.col("key")}
    folder = feed(spark, flows)
    whole = getattr(d, at)

    def dies(*args):
        runs.append(1)
        if len(runs) == 2:
            if at != "score":
                whole(*args)
            raise Broken
        return whole(*args)

    monkeypatch.setattr(d, at, dies)
    with pytest.raises(Exception, match="Broken"):
        d.run(detect.read_flows(spark, folder, EXTRA, 1)[0])
    again = detector(spark, flows, key)
    again.out, again.count_by = d.out, d.count_by
    again.run(detect.read_flows(spark, folder, EXTRA, 1)[0])
    got = {r["flow_id"]: r["prob"] for r in again.results(spark).collect()}
    want = batch_scores(flows, key)
    assert again.results(spark).count() == 90 and all(got[i] == pytest.approx(want[i]) for i in want)
    counted = detect.running_counts(again.results(spark), "key")
    assert sorted(map(tuple, again.counts(spark).collect())) == sorted(map(tuple, counted.collect()))


def test_a_restart_goes_on_with_the_state(spark, flows):
    """Keys that were silent for several batches still have their rows; the state has n - 1 rows a key."""
    folder = scratch.new_path(spark, "feed")
    d = detector(spark, flows, ["key"])
    for part in (F.col("seq") < 40, F.col("seq").between(40, 69) & (F.col("key") == "busy"), (F.col("seq") >= 40) & ~(F.col("seq").between(40, 69) & (F.col("key") == "busy"))):
        some = feed(spark, flows.filter(part))
        spark.read.text(some).coalesce(1).write.mode("append").text(folder)
        again = detector(spark, flows, ["key"])
        again.out = d.out
        again.run(detect.read_flows(spark, folder, EXTRA, 1)[0])
    busy = flows.withColumn("seq", F.col("seq") + F.when((F.col("key") != "busy") | (F.col("seq") >= 70), 1000).otherwise(F.when(F.col("seq") >= 40, 500).otherwise(0)))
    order = busy.withColumn("seq", F.when(F.col("flow_id") < 40, F.col("flow_id")).otherwise(F.col("seq")))
    want = batch_scores(order, ["key"])
    got = {r["flow_id"]: r["prob"] for r in d.results(spark).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    state = spark.read.format("statestore").option("stateVarName", "rows").load(f"{d.out}/checkpoint")
    held = state.groupBy("key").agg(F.count("*").alias("n")).collect()
    assert len(held) == flows.select("key").distinct().count() and all(r["n"] <= 3 for r in held)


def test_late_rows_are_dropped_and_silent_buffers_expire(spark):
    """Seconds as event time, a buffer of three, ten seconds to live; one file per list."""
    batches = [
        [("a", 1), ("a", 2), ("b", 3)],
        [("a", 3), ("a", 4), ("b", 20)],  # a at 3 is not after the largest time before
        [("a", 15), ("a", 21), ("b", 40), (None, 41)],
        [("c", 60), ("d", None)],
    ]
    folder, number, keys = scratch.new_path(spark, "feed"), 0, {}
    for rows in batches:
        made = []
        for key, at in rows:
            made.append((number, [1.0, float(number)], 0, key, at))
            keys[number] = key, at
            number += 1
        df = spark.createDataFrame(made, "flow_id long, features array<double>, true_label int, key string, seq long")
        df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(folder)
    params = spark.createDataFrame([(i, f"x{i}", 0.0, 1.0, 1.0) for i in range(2)], "pos int, feature string, mean double, std_pop double, scale double")
    d = detect.Detector(
        params, 2, detect.zero_padded(2, 3), lambda df: df.withColumn("prob", F.lit(1.0)), scratch.new_path(spark, "out"),
        key=["key"], order=["seq"], event="event", ttl_ms=10_000,
    )
    flows, _ = detect.read_flows(spark, folder, EXTRA, 1)
    d.run(flows.withColumn("event", F.timestamp_seconds("seq")))
    got = {keys[r.flow_id]: [keys[int(x[1])] for x in r.buffer if x[0]] for r in d.results(spark).collect()}
    a, b = [("a", t) for t in (1, 2, 4, 21)], [("b", t) for t in (3, 20, 40)]
    assert got == {
        a[0]: a[:1], a[1]: a[:2], a[2]: a[:3], a[3]: a[3:], b[0]: b[:1], b[1]: b[1:2], b[2]: b[2:],
        (None, 41): [(None, 41)], ("c", 60): [("c", 60)], ("d", None): [("d", None)],
    }
    gone = sorted(((r.key or "", int(r.expired_at.timestamp()), r.expired_rows) for r in d.expired(spark).collect()))
    assert gone == [("", 41, 1), ("a", 4, 3), ("a", 21, 1), ("b", 3, 1), ("b", 20, 1), ("b", 40, 1), ("d", 0, 1)]
    state = spark.read.format("statestore").option("stateVarName", "rows").load(f"{d.out}/checkpoint")
    assert {r.key.key for r in state.select("key").collect()} == {"c"}


def test_replay_of_few_rows(spark, tmp_path):
    for n in (1, 2, 3, 5):
        lines = spark.range(n).select(F.col("id").cast("string").alias("value"), F.col("id").alias("at"))
        detect.replay(lines, str(tmp_path / str(n)), "at", 4)
        files = sorted((tmp_path / str(n)).glob("part-*-*.txt"))
        files = [f for f in files if f.stat().st_size]
        assert [int(x) for f in files for x in f.read_text().split()] == list(range(n)) and len(files) == min(n, 4)
        dates = [f.stat().st_mtime for f in files]
        assert dates == sorted(set(dates))


def test_running_counts_of_a_stream_equal_the_batch(spark, flows):
    decided = flows.select("key", F.col("label").alias("true_label"), (F.col("flow_id") % 3 % 2).cast("int").alias("y_pred"))
    folder = scratch.new_path(spark, "verdicts")
    decided.write.parquet(folder)
    got = detect.count_stream(spark, folder, decided.schema, scratch.new_path(spark, "counts"), "key")
    want = detect.running_counts(decided, "key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    row = detect.summary(detect.running_counts(decided)).first()
    assert row["accuracy"] == pytest.approx((row["tn"] + row["tp"]) * 100 / 90)


def test_verdict_rule_is_inclusive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.49, 1), (1.0, 0)], "prob double, true_label int")
    got = [(r["y_pred"], r["verdict"], r["correct"]) for r in detect.verdicts(df).collect()]
    assert got == [(1, "Attack", True), (0, "Benign", False), (1, "Attack", False)]
    assert detect.verdicts(df).first()["confidence"] == 0.0


@pytest.mark.parametrize("n,last", [(12, 12), (10, 4), (2, 2), (1, 1)])
def test_buffer_graph_equals_the_table_operators(spark, n, last):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    df = spark.createDataFrame([(x.tolist(), last)], "buffer array<array<double>>, real int")
    got = detect.buffer_graph(df, k=10, hops=3).first()["smoothed"]
    if n < 3:
        assert np.allclose(got, x[last - 1])
        return
    nodes = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, f0 double, f1 double, f2 double")
    edges = knn_edges(nodes.withColumn("v", F.array("f0", "f1", "f2")), "id", "v", 10)
    out = graphs.propagate(nodes, edges, "id", ["f0", "f1", "f2"], 3)
    row = out.filter(F.col("id") == last - 1).first()
    assert np.allclose(got, [row["f0"], row["f1"], row["f2"]])


def test_replay_keeps_rows_without_an_order_key(spark, tmp_path):
    lines = spark.range(50).select(
        F.col("id").cast("string").alias("value"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("at")
    )
    detect.replay(lines, str(tmp_path / "a"), "at", 4)
    assert {int(r[0]) for r in spark.read.text(str(tmp_path / "a")).collect()} == set(range(50))
    same = lines.withColumn("at", F.lit(1.0))
    detect.replay(same, str(tmp_path / "b"), "at", 4, rows_per_file=10)
    assert len([f for f in (tmp_path / "b").glob("part-*.txt") if f.stat().st_size]) >= 5 and spark.read.text(str(tmp_path / "b")).count() == 50
    detect.replay(lines.limit(0), str(tmp_path / "c"), "at")
    assert spark.read.text(str(tmp_path / "c")).count() == 0


def test_keys_of_a_bucket_share_one_read_and_one_write_of_state():
    calls, held = [], []

    class Rows:
        def get(self):
            calls.append("get")
            return iter(held)

        def put(self, rows):
            calls.append("put")
            held[:] = rows

    class Handle:
        def getListState(self, name, schema):
            return Rows()

    state = detect.Buckets(["flow_id", "k", "seq", "features"], "_key", ["seq", "flow_id"], 1, 3)
    state.init(Handle())
    got = {}
    for batch in range(3):
        at = [(batch * 4 + i, k) for k in range(50) for i in (1, 0, 2, 3)]
        rows = pd.DataFrame({"flow_id": [a for a, _ in at], "k": [k for _, k in at], "seq": [a for a, _ in at], "features": [[a + k / 100] for a, k in at], "_key": [str(k) for _, k in at], "_bucket": 0})
        for out in state.handleInputRows((0,), iter([rows[:70], rows[70:]]), None):
            got |= {(r.k, r.flow_id): r.buffer for r in out.itertuples()}
    assert calls == ["get", "put"] * 3 and len(held) == 50
    assert got == {(k, a): [[x + k / 100] for x in range(max(0, a - 2), a + 1)] for k in range(50) for a in range(12)}


@pytest.mark.parametrize("width", [1, 2])
def test_keys_that_share_buckets_expire_as_they_would_alone(spark, width):
    """Seconds as event time, five to live; gaps, late rows, rows without a time, ties with the watermark."""
    rng, folder, number = np.random.default_rng(width), scratch.new_path(spark, "feed"), 0
    for batch in range(4):
        made = []
        for _ in range(40):
            at = int(batch * 8 + rng.integers(0, 12))
            key = None if rng.random() < 0.1 else int(rng.integers(0, 12))
            x = [float(number)] * (width + (rng.random() < 0.1))
            made.append((number, x, 0, f"k{key}" if key is not None else None, None if rng.random() < 0.1 else at))
            number += 1
        df = spark.createDataFrame(made, "flow_id long, features array<double>, true_label int, key string, seq long")
        df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(folder)
    params = spark.createDataFrame([(i, f"x{i}", 0.0, 1.0, 1.0) for i in range(width)], "pos int, feature string, mean double, std_pop double, scale double")
    got = []
    for buckets in (None, 3):
        d = detect.Detector(
            params, width, detect.zero_padded(width, 3), lambda df: df.withColumn("prob", F.lit(1.0)), scratch.new_path(spark, "out"),
            key=["key"], order=["seq"], event="event", ttl_ms=5_000, buckets=buckets,
        )
        flows, _ = detect.read_flows(spark, folder, EXTRA, 1)
        d.run(flows.withColumn("event", F.timestamp_seconds("seq")))
        bad = spark.read.parquet(f"{d.out}/rejected")
        got.append((
            sorted((r.flow_id, r.key or "", r.buffer) for r in d.results(spark).collect()),
            sorted((r.key or "", r.expired_at, r.expired_rows) for r in d.expired(spark).collect()),
            sorted(r.flow_id for r in bad.collect()), d.expired(spark).schema, bad.drop("expired_key").columns,
        ))
    assert len(got[0][0]) > 40 and len(got[0][1]) > 20
    assert got[0] == got[1] and "expired_key" not in d.results(spark).columns


class Handle:
    """State of one bucket, and the calls that it answers."""

    def __init__(self):
        self.calls, self.held, self.timers = [], [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return iter(self.held)

    def put(self, rows):
        self.calls.append("put")
        self.held = rows

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_keys_of_a_bucket_that_expire_share_one_state_and_one_timer():
    handle = Handle()
    state = detect.Buckets(["flow_id", "features"], "_key", ["flow_id"], 2, 3, 1000, packed=True)
    state.init(handle)
    for batch in range(3):
        rows = pd.DataFrame({"flow_id": range(100), "features": [[1.0, i] for i in range(100)], "_ms": 500 * batch + 500, "_key": [str(i % 50) for i in range(100)], "_bucket": 0})
        outs = list(state.handleInputRows((0,), iter([rows]), handle))
        assert sum(map(len, outs)) == 100
    # One timer, for whichever key expires first, and 50 keys in one list.
    assert handle.calls == ["get", "put", "timer", "get", "put", "get", "put"] and handle.timers == [1500]
    assert len(handle.held) == 50
    # A row and a buffer are their doubles' bytes, not lists of lists.
    assert {(at, len(past)) for _, at, past in handle.held} == {(1500, 3 * 2 * 8)}
    assert np.frombuffer(handle.held[7][2]).reshape(-1, 2).tolist() == [[1.0, 57.0], [1.0, 7.0], [1.0, 57.0]]
    assert all(isinstance(b, bytes) for b in outs[0]["buffer"])


def test_a_batch_of_buffer_graphs_takes_ties_in_order(spark):
    """Buffers of many lengths, widths and copies in one batch, next to the graph written out."""
    rng, rows = np.random.default_rng(5), []
    for n in (1, 2, 3, 9, 12, 12, 12, 50, 50):
        for width in (2, 3):
            # Along an axis or zero, so that distances tie exactly.
            x = np.eye(width + 1, width)[rng.integers(0, width + 1, n)] * rng.integers(1, 3, (n, 1)) if n != 50 else rng.normal(size=(n, width))
            for last in sorted({n, max(1, n // 2)}):
                rows.append((len(rows), x.tolist(), last))
    df = spark.createDataFrame(rows, "id int, buffer array<array<double>>, real int").coalesce(1)
    got = {r.id: r.smoothed for r in detect.buffer_graph(df, k=4, hops=3).collect()}
    for i, x, last in rows:
        x = np.array(x)
        n, length = len(x), np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        gap = 1.0 - unit @ unit.T
        np.fill_diagonal(gap, np.inf)
        link = np.eye(n)
        for a in range(n):
            link[a, sorted(range(n), key=lambda b: (gap[a, b], b))[: min(4, n - 1)]] = 1
        degree = link.sum(0)
        spread = (link / np.sqrt(np.outer(degree, degree))).T
        assert np.allclose(got[i], (spread @ spread @ spread @ x if n > 2 else x)[last - 1])
