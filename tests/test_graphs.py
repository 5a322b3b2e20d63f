import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import graphs


def frame(spark, values):
    width = len(next(iter(values.values())))
    return spark.createDataFrame(
        [(i, *map(float, x)) for i, x in values.items()],
        "id long, " + ", ".join(f"f{i} double" for i in range(width)),
    )


def result(df, columns):
    return {r["id"]: [r[c] for c in columns] for r in df.collect()}


def dense_propagate(x, pairs, hops):
    n = len(x)
    a = np.eye(n)
    for s, d in pairs:
        if s != d:
            a[s, d] += 1
    degree = a.sum(0)
    weight = a / np.sqrt(np.outer(degree, degree))
    for _ in range(hops):
        x = weight.T @ x
    return x


def test_two_nodes_meet_in_the_middle(spark):
    nodes = frame(spark, {0: (2,), 1: (4,)})
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    got = result(graphs.propagate(nodes, edges, "id", ["f0"]), ["f0"])
    assert got[0] == pytest.approx([3.0]) and got[1] == pytest.approx([3.0])


def test_rows_without_edges_keep_their_features(spark):
    nodes = frame(spark, {0: (2, 1), 1: (4, 5), 2: (7, 8)})
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    got = result(graphs.propagate(nodes, edges, "id", ["f0", "f1"], hops=2), ["f0", "f1"])
    assert got[2] == [7.0, 8.0] and got[0] == [2.0, 1.0]


def test_regular_graph_keeps_a_constant(spark):
    nodes = frame(spark, {i: (5,) for i in range(6)})
    edges = spark.createDataFrame([(i, (i + s) % 6) for i in range(6) for s in (1, 2)], "src long, dst long")
    got = result(graphs.propagate(nodes, edges, "id", ["f0"], hops=3), ["f0"])
    assert len(got) == 6 and all(v == pytest.approx([5.0]) for v in got.values())


@pytest.mark.parametrize("hops", [1, 3])
def test_propagation_equals_the_matrix_form(spark, hops):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 3))
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))]
    nodes = frame(spark, {i: x[i] for i in range(12)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = result(graphs.propagate(nodes, edges, "id", ["f0", "f1", "f2"], hops), ["f0", "f1", "f2"])
    want = dense_propagate(x, pairs, hops)
    assert all(np.allclose(got[i], want[i]) for i in range(12))


def test_gcn_and_head_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10, 4))
    pairs = [(i, (i * 3 + 1) % 10) for i in range(10)]
    nodes = frame(spark, {i: x[i] for i in range(10)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    layers, head = graphs.seeded_layers([4, 6, 6]), graphs.seeded_layers([6, 5, 2], 9)
    layers[0].update(mean=rng.normal(size=6), var=rng.uniform(0.5, 2, 6), gain=rng.normal(size=6))
    out, logits = graphs.gcn_logits(nodes, edges, "id", ["f0", "f1", "f2", "f3"], layers, head)
    got = {r["id"]: r for r in graphs.class_scores(out, logits).collect()}

    def act(h, layer):
        h = (h @ layer["weight"] + layer["bias"] - layer["mean"]) / np.sqrt(layer["var"] + 1e-5)
        return np.maximum(h * layer["gain"] + layer["shift"], 0)

    h = x
    for layer in layers:
        h = act(dense_propagate(h, pairs, 1), layer)
    z = act(h, head[0]) @ head[1]["weight"] + head[1]["bias"]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for i in range(10):
        assert np.allclose([got[i]["p0"], got[i]["p1"]], p[i])
        assert np.isclose(got[i]["logp1"], np.log(p[i, 1])) and got[i]["pred"] == p[i].argmax()


def test_majority_tie_goes_to_the_first_vote(spark):
    flows = spark.createDataFrame(
        [(1, "a", "b", 1), (2, "a", "c", 0), (3, "b", "c", 0)], "seq long, s string, d string, label int"
    )
    got = {r["node"]: r["label"] for r in graphs.host_labels(flows, "s", "d", "label", ["seq"]).collect()}
    assert got == {"a": 1, "b": 1, "c": 0}


def test_host_graph_counts_both_ends_and_keeps_parallel_edges(spark):
    flows = spark.createDataFrame(
        [(1, "a", "b", 2.0, 0), (2, "a", "b", 4.0, 1), (3, "c", "c", 9.0, 1)],
        "seq long, s string, d string, x double, label int",
    )
    nodes, edges = graphs.host_graph(flows, "s", "d", ["x"], "label", ["seq"])
    got = {r["node"]: (r["node_id"], r["x"], r["label"]) for r in nodes.collect()}
    assert got == {"a": (0, 3.0, 0), "b": (1, 3.0, 0), "c": (2, 9.0, 1)}
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 2.0), (0, 1, 4.0), (2, 2, 9.0)]
    stats = graphs.degree_stats(nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("n")))
    assert tuple(stats.first()) == (3, 3, 1.0)


def test_self_loops(spark):
    assert sorted(map(tuple, graphs.self_loops(frame(spark, {3: (1,), 4: (1,)}), "id").collect())) == [(3, 3), (4, 4)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fewer_than_three_rows_have_loops_only(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "id long, features array<double>")
    _, edges = graphs.knn_graph(df, "id", df.select("id"), k=10)
    got = sorted((r["src"], r["dst"]) for r in edges.collect())
    want = [(i, j) for i in range(n) for j in range(n) if (i == j) == (n < 3)]
    assert got == want


def test_host_nodes_equal_means_and_votes(spark):
    flows = spark.range(60).select(
        F.concat(F.lit("a"), F.col("id") % 3).alias("s"), F.concat(F.lit("b"), F.col("id") % 4).alias("d"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("x"), (F.col("id") % 5 % 2).cast("int").alias("label"), "id",
    )
    got = {r["node"]: (r["label"], r["x"]) for r in graphs.host_nodes(flows, "s", "d", ["x"], "label", ["id"]).collect()}
    means = {r["node"]: r["x"] for r in graphs.host_features(flows, "s", "d", ["x"]).collect()}
    labels = {r["node"]: r["label"] for r in graphs.host_labels(flows, "s", "d", "label", ["id"]).collect()}
    assert got.keys() == means.keys() and all(got[n] == (labels[n], pytest.approx(means[n])) for n in got)


def test_host_votes_are_hashed_not_sorted(spark):
    flows = spark.createDataFrame([(1, "x", "a", "b", 2.0, 0)], "t long, k string, s string, d string, x double, label int")
    votes = graphs.host_votes(flows, "s", "d", ["x"], "label", ["t", "k"])
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("order", [["t", "k"], ["k", "t"], ["t"], ["k"]])
def test_host_ties_follow_the_whole_order(spark, order):
    rng = np.random.default_rng(3)
    pick = lambda values: values[rng.integers(len(values))]
    rows = [
        (i, pick([None, 1, 2]), pick([None, "x", "y"]), pick([None, "a", "b", "c", f"h{i}"]), pick([None, "a", f"g{i % 40}"]), pick([None, 0, 1]), pick([None, 1.0, 3.0]))
        for i in range(400)
    ]
    flows = spark.createDataFrame(rows, "i long, t long, k string, s string, d string, label int, x double")
    order = [*order, "i"]
    low = lambda v: (v is not None, v if v is not None else 0)
    votes, sums = {}, {}
    for r in flows.collect():
        for side, node in ((0, r.s), (1, r.d)):
            seen = (*[low(r[c]) for c in order], side)
            n, first = votes.setdefault(node, {}).get(r.label, (0, seen))
            votes[node][r.label] = (n + 1, min(first, seen))
            sums.setdefault(node, []).extend([] if r.x is None else [r.x])
    want = {
        node: (min(v, key=lambda y: (-v[y][0], v[y][1])), sum(sums[node]) / len(sums[node]) if sums[node] else None)
        for node, v in votes.items()
    }
    nodes = graphs.host_nodes(flows, "s", "d", ["x"], "label", order)
    got = [tuple(r) for r in nodes.collect()]
    assert len(got) == len(want) and {n: (y, x) for n, y, x in got} == want
    assert {r.node: r.label for r in graphs.host_labels(flows, "s", "d", "label", order).collect()} == {n: y for n, (y, _) in want.items()}
    ids = {r.node: r.node_id for r in graphs.numbered(nodes).collect()}
    assert ids == {r.node: r.node_id for r in graphs.host_ids(flows, "s", "d").collect() if r.node is not None}
