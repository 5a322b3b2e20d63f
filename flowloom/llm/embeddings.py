"""Embedding near-dedup by a subspace pigeonhole join.

For unit vectors cosine >= t means squared distance <= 2 - 2t. After a rotation
the coordinates are split into blocks; at least one block of a linked pair has a
squared distance within its share of that budget, in proportion to its width.
Each block is joined by range: its first axes are cut into cells twice as wide
as the block's radius, a vector is home in one cell and visits the neighbouring
cells its ball reaches, and a home and a visitor are compared in the block. What
passes is checked on the whole vectors in double precision. A pair counts in the
first block it passes, so no list of pairs has to be made distinct, and a task
returns link sums and one edge per vector, not pairs.

Identical vectors are one vector with a weight. The rows of a cell are dealt to
chunks, and every pair of chunks is a task's unit, so no group grows with the
data. The number of axes in use follows the number of vectors, as a partition
count does; the number of compared pairs is a fixed share of all pairs.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from flowloom.llm.graph import components
from flowloom.llm.text import id_or_last, id_or_null
from flowloom.sources import scratch

THRESHOLD = 0.95
BLOCK = 16
UNIT = 2048
CELL_BITS = 9


def rotation(dims, seed=11):
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def layout(dims, threshold, width=BLOCK):
    """[(slice, squared budget)] of the blocks of vectors with ``dims`` components."""
    total = 2 - 2 * threshold
    cuts = [*range(0, dims, width), dims]
    return [(slice(a, b), total * (b - a) / dims * (1 + 1e-9) + 1e-12) for a, b in zip(cuts, cuts[1:])]


def _unit(lists, dims):
    """Unit vectors in double precision from an Arrow column of lists of one length."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cells(x, budget, axes):
    """Home cell codes, and (row, cell) of the higher cells each ball reaches."""
    wide = 2 * np.sqrt(budget)
    low = x[:, :axes]
    home = np.floor(low / wide)
    gaps = np.stack([low - home * wide, np.zeros_like(low), (home + 1) * wide - low]) ** 2
    place = (2 ** (CELL_BITS * np.arange(axes))).astype(np.int64)
    code = ((home.astype(np.int64) + 2 ** (CELL_BITS - 1)) * place).sum(1)
    rows, cells = [], []
    for step in itertools.product((-1, 0, 1), repeat=axes):
        move = int((np.array(step) * place).sum())
        if move > 0:
            reach = np.flatnonzero(sum(gaps[s + 1][:, a] for a, s in enumerate(step)) <= budget)
            rows.append(reach)
            cells.append(code[reach] + move)
    return code, np.concatenate(rows or [np.empty(0, int)]), np.concatenate(cells or [np.empty(0, np.int64)])


def _assign(threshold, axes):
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = _unit(lists.take(pa.array(own)), d) @ rotation(d)
                for b, (part, budget) in enumerate(layout(d, threshold)):
                    code, rows, cells = _cells(x[:, part], budget, min(axes, part.stop - part.start))
                    n = len(own) + len(rows)
                    yield pa.record_batch(
                        [
                            pa.array(np.r_[nodes[own], nodes[own][rows]]),
                            pa.array(np.full(n, d, np.int32)),
                            pa.array(np.full(n, b, np.int32)),
                            pa.array(np.r_[code, cells]),
                            pa.array(np.r_[np.ones(len(own), bool), np.zeros(len(rows), bool)]),
                        ],
                        names=["node", "dims", "block", "cell", "home"],
                    )

    return run


def _squares(x, y):
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T


def _met(threshold):
    """Link sums and one edge per vector for a unit of homes and others."""

    def run(key, unit):
        d, b = key[0].as_py(), key[1].as_py()
        left = unit.filter(unit["left"])
        right = unit.filter(pc.invert(unit["left"]))
        parts = layout(d, threshold)
        empty = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        turn = rotation(d)
        x, y = _unit(left["embedding"], d), _unit(right["embedding"], d)
        xr, yr = x @ turn, y @ turn
        xn, yn = left["node"].to_numpy(), right["node"].to_numpy()
        home = right["home"].to_numpy(zero_copy_only=False)
        pairs = []
        for at in range(0, len(x), 256):
            part, budget = parts[b]
            rows = slice(at, at + 256)
            near = _squares(xr[rows, part], yr[:, part]) <= budget
            near &= ~home[None, :] | (xn[rows, None] < yn[None, :])
            i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(i):
                continue
            near = near[np.ix_(i, j)] & (x[rows][i] @ y[j].T >= threshold)
            for part, budget in parts[:b]:
                near &= _squares(xr[rows, part][i], yr[j, part]) > budget
            a, c = np.nonzero(near)
            pairs.append(np.stack([i[a] + at, j[c]]))
        if not pairs:
            return empty
        a, c = np.concatenate(pairs, axis=1)
        xw, yw = left["weight"].to_numpy(), right["weight"].to_numpy()
        lx, ly = xn.copy(), yn.copy()
        while True:
            before = lx.copy(), ly.copy()
            np.minimum.at(ly, c, lx[a])
            np.minimum.at(lx, a, ly[c])
            if (before[0] == lx).all() and (before[1] == ly).all():
                break
        nx = np.bincount(a, weights=yw[c], minlength=len(x)).astype(np.int64)
        ny = np.bincount(c, weights=xw[a], minlength=len(y)).astype(np.int64)
        return pa.table(
            {
                "node": np.r_[xn[nx > 0], yn[ny > 0]],
                "n": np.r_[nx[nx > 0], ny[ny > 0]],
                "to": np.r_[lx[nx > 0], ly[ny > 0]],
            }
        )

    return run


def links(vectors, threshold=THRESHOLD):
    """(node, n, to): partial link sums, and edges that connect linked vectors.

    ``vectors`` is a written table (node, embedding, weight) of distinct vectors
    that are finite and not zero.
    """
    axes = int(np.clip(round(np.log2(max(vectors.count(), 1) / (4 * UNIT))), 1, 6))
    schema = "node long, dims int, block int, cell long, home boolean"
    placed = vectors.select("node", "embedding").mapInArrow(_assign(threshold, axes), schema)
    placed = scratch.materialise(placed, "cells")
    where = ["dims", "block", "cell"]
    sizes = placed.groupBy(*where).agg(
        F.sum(F.col("home").cast("long")).alias("_homes"), F.count("*").alias("_all")
    )
    sizes = sizes.filter("_homes > 0 and _all > 1").select(
        *where,
        F.ceil(F.col("_homes") / UNIT).alias("_l"),
        F.ceil(F.col("_all") / UNIT).alias("_r"),
    )
    dealt = placed.join(sizes, where).withColumns(
        {
            "_i": F.pmod(F.xxhash64("node"), F.col("_l")),
            "_j": F.pmod(F.xxhash64(F.lit(1), "node"), F.col("_r")),
        }
    )
    left = dealt.filter("home").select(
        *where, "_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1)).alias("_j"), "node", "home", F.lit(True).alias("left")
    )
    right = dealt.select(
        *where, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l") - 1)).alias("_i"), "_j", "node", "home", F.lit(False).alias("left")
    )
    units = left.unionByName(right).join(vectors, "node")
    return units.groupBy(*where, "_i", "_j").applyInArrow(_met(threshold), "node long, n long, to long")


def near_duplicates(table, threshold=THRESHOLD):
    """vec_id, n_links, component_id and kept for every row of ``table``.

    Vectors that are null, zero or hold a null or non-finite component link with
    nothing; vectors of different lengths are not compared; repeated rows are
    copies of each other and each counts as another vector. A missing vec_id
    counts as the largest and comes back null. Vectors are told apart by a
    64-bit hash before they are compared. Other columns are ignored.
    """
    rows = table.select(id_or_last(F.col("vec_id")).alias("_id"), F.col("embedding"))
    # A norm that is not finite covers null, NaN and infinite components at once.
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    fit = F.coalesce((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    keyed = rows.withColumn("node", F.when(fit, F.xxhash64("embedding")))
    vectors = (
        keyed.filter("node is not null").groupBy("node")
        .agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("_id").alias("_least"))
    )
    vectors = scratch.materialise(vectors, "vectors")
    found = scratch.materialise(links(vectors.drop("_least"), threshold), "links")
    sums = found.groupBy("node").agg(F.sum("n").alias("_n"))
    labels = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    labels = labels.withColumnRenamed("component", "_group")
    known = (
        vectors.select("node", "weight", "_least").join(sums, "node", "left").join(labels, "node", "left")
        .withColumn("_group", F.coalesce("_group", "node"))
    )
    least = known.groupBy("_group").agg(F.min("_least").alias("_first"))
    known = known.join(least, "_group").select(
        "node", "_first", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("_links")
    )
    joined = keyed.select("_id", "node").join(known, "node", "left")
    first = F.coalesce("_first", "_id")
    return joined.select(
        id_or_null(F.col("_id")).alias("vec_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        id_or_null(first).alias("component_id"),
        (first == F.col("_id")).alias("kept"),
    )


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE e IS NOT NULL AND list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y
      ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b)
      SELECT a, min(b) AS c FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, r.c AS component_id, r.c = v.vec_id AS kept
FROM v JOIN r ON r.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
