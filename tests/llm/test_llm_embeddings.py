"""The embedding join against all pairs in numpy."""

import numpy as np
import pytest

from flowloom.llm import embeddings, graph

SCHEMA = "vec_id long, embedding array<double>, label int, node string, weight string"


def brute(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    ok = [v is not None and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                linked[i, j] = linked[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    label = np.arange(n)
    while True:
        least = np.array([min([label[i], *label[linked[i]]]) for i in range(n)])
        if (least == label).all():
            break
        label = least
    group = {}
    for i in range(n):
        key = label[i]
        group[key] = min(group.get(key, 2**63), ids[i])
    return sorted((ids[i], int(linked[i].sum()), group[label[i]], group[label[i]] == ids[i]) for i in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    out = [list(map(float, v)) for v in base]
    out += [list(map(float, base[i % 10] + rng.standard_normal(64) * s)) for i, s in enumerate(np.linspace(0.05, 0.45, 80))]
    out += [out[5]] * 4 + [[2 * x for x in out[6]]]
    centre = rng.standard_normal(64)
    out += [list(map(float, centre + rng.standard_normal(64) * 0.1)) for _ in range(60)]
    out += [None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]]
    return list(enumerate(out))


@pytest.mark.parametrize("unit", [2048, 16])
def test_links_equal_all_pairs(spark, rows, unit, monkeypatch):
    monkeypatch.setattr(embeddings, "UNIT", unit)
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(frame).collect())
    assert got == brute(rows)


def test_missing_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(str, (tuple(r) for r in embeddings.near_duplicates(frame).collect())))
    assert got == sorted(map(str, [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True)]))


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_linked_pair_passes_in_one_block():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 50))
    y = x + rng.standard_normal(x.shape) * rng.uniform(0, 0.5, (400, 1))
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    linked = (x * y).sum(1) >= 0.95
    turn = embeddings.rotation(50)
    near = [(((x - y) @ turn)[:, part] ** 2).sum(1) <= budget for part, budget in embeddings.layout(50, 0.95)]
    assert linked.any() and np.any(near, axis=0)[linked].all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
