"""Merkle manifest against a plain tree, for groups of every interesting size."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from flowloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _node string, path string, root string, _at string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, source, lang, n_chars, text = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(top, siblings per level of each node) by plain lists."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, w in enumerate(where):
            run = w // 8 * 8
            paths[i].append((nodes[run:w], nodes[w + 1 : run + 8]))
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        where = [w // 8 for w in where]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[g] = tree([leaf(r) for r in groups[g]])
    root, above = tree([tops[g][0] for g in order])
    found = []
    for g, over in zip(order, above):
        for r, path in zip(groups[g], tops[g][1]):
            whole = path + over
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, tampered)
            for left, right in whole:
                node = h("".join(left) + node + "".join(right))
            proof = h("".join("".join(left + right) for left, right in whole))
            found.append((r[0], leaf(r), tops[g][0], root, proof, node, node == root))
    return found


def rows_of(sizes):
    rows, n = [], 0
    for lang, size in sizes.items():
        for i in range(size):
            n += 1
            text = None if i % 11 == 5 else "" if i % 13 == 7 else f"Text {i} Ünï" * (1 + i % 3)
            rows.append((n, None if i % 5 == 0 else f"s{i % 3}", lang, None if i % 7 == 0 else i, text, "x", "y", "z", "w"))
    return rows


SIZES = [
    {"en": 1},
    {"en": 8},
    {"en": 9, "de": 1},
    {"en": 513, "fr": 512, None: 64, "": 65, "é": 7, "z": 8, "a": 1, "b": 2, "c": 3},
    {"en": 4097, "de": 3},
]


@pytest.mark.parametrize("sizes", SIZES, ids=str)
def test_equals_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    if len(sizes) > 3:
        # Ties, missing ids, and rows that are there twice.
        rows += [rows[3], rows[3], (None, *rows[4][1:]), (None, *rows[4][1:]), (rows[5][0], "other", *rows[5][2:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in manifest.digest(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(rows)))


def test_paths_fold_to_the_root(spark):
    docs = spark.createDataFrame(rows_of({"en": 700, "de": 20}), SCHEMA)
    proved = manifest.prove(docs, carry={"chars": F.col("n_chars")})
    bad = proved.filter(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root"))
    assert proved.count() == 720 and bad.count() == 0
    assert proved.select("root").distinct().count() == 1
    spots = {(r.group_key, r.position) for r in proved.collect()}
    assert len(spots) == 720


def test_empty_table(spark):
    assert manifest.digest(spark.createDataFrame([], SCHEMA)).collect() == []
