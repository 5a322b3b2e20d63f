"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for every document and every term that some test item uses,
the positions of the term. A search starts from the rarest terms: every window
of a test item names its two rarest terms, their position lists are shifted by
the offsets of the terms in the item and intersected inside the document, and
only starts that survive are checked against the lists of all other terms. No
text is read twice and no window list of the corpus is built.

Only the vocabulary of the test items is sent to the tasks. It is taken in
blocks of items with at most ``MAX_TERMS`` distinct terms each, so its size is
bounded whatever the number of items.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.llm.text import id_or_last, id_or_null, lower_ascii, terms
from flowloom.sources import scratch

WINDOW = 13
MAX_TERMS = 500_000
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["_id", "_text"]
INDEX = "_id long, _text long, term long, n long, positions array<int>"


def item_terms(items):
    """(_key, item_id, _n, q, term) for every term of every distinct item with terms."""
    found = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    lists = (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), found.alias("_words"))
        .distinct()
        .filter(F.size("_words") > 0)
    )
    return lists.select(
        F.xxhash64("item_id", "_words").alias("_key"),
        "item_id",
        F.size("_words").alias("_n"),
        F.posexplode("_words").alias("q", "_word"),
    ).select("_key", "item_id", "_n", "q", F.xxhash64("_word").alias("term"), "_word")


def index(docs, vocabulary):
    """The positional index of ``docs`` (_id, _text, data) for a term -> hash map.

    One row per document and term: positions of the term, counted in terms from
    0, and their number. A row without term carries the document's term count.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches):
        get = known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield _postings(batch.slice(at, 1000), get)

    return docs.select("_id", "_text", "data").mapInArrow(build, INDEX)


def _postings(batch, get):
    found, sizes = [], []
    for data in batch.column(2).to_pylist():
        ids = np.array([get(t, 0) for t in terms(data or b"")], dtype=np.int64)
        found.append(ids)
        sizes.append(len(ids))
    sizes = np.array(sizes, dtype=np.int64)
    everything = np.concatenate(found) if found else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(everything)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = np.flatnonzero(everything)
    order = hit[np.lexsort((place[hit], everything[hit], doc[hit]))]
    term, doc, place = everything[order], doc[order], place[order]
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.empty(0, int)
    owner = np.r_[doc[starts], np.arange(len(sizes))]
    lists = np.r_[starts, np.full(len(sizes) + 1, len(term))].astype(np.int32)
    empty = np.r_[np.zeros(len(starts), bool), np.ones(len(sizes), bool)]
    return pa.record_batch(
        [
            batch.column(0).take(pa.array(owner)),
            batch.column(1).take(pa.array(owner)),
            pa.array(np.r_[term[starts], np.zeros(len(sizes), np.int64)], mask=empty),
            pa.array(np.r_[np.diff(np.r_[starts, len(term)]), sizes].astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(lists), pa.array(place.astype(np.int32))),
        ],
        names=["_id", "_text", "term", "n", "positions"],
    )


def rarest_pairs(items, counts, window=WINDOW):
    """(_key, t1, q1, t2, q2): the two rarest terms of each window of each item.

    A window with a term the corpus lacks cannot occur and is left out.
    """
    placed = items.join(counts, "term")
    first = F.sequence(
        F.greatest(F.lit(0), F.col("q") - window + 1),
        F.least(F.col("q"), F.greatest(F.lit(0), F.col("_n") - window)),
    )
    windows = (
        placed.withColumn("_w", F.explode(first))
        .groupBy("_key", "_n", "_w")
        .agg(F.sort_array(F.collect_list(F.struct("total", "term", "q"))).alias("_by"))
        .filter(F.size("_by") == F.least(F.lit(window), F.col("_n")))
    )
    other = F.coalesce(F.get("_by", 1), F.get("_by", 0))
    return windows.select(
        "_key",
        F.get("_by", 0)["term"].alias("t1"),
        F.get("_by", 0)["q"].alias("q1"),
        other["term"].alias("t2"),
        other["q"].alias("q2"),
    ).distinct()


def _both(postings, pairs):
    one = postings.select(*DOC, F.col("term").alias("t1"), F.col("positions").alias("_p1"))
    two = postings.select(*DOC, F.col("term").alias("t2"), F.col("positions").alias("_p2"))
    return one.join(pairs, "t1").join(two, [*DOC, "t2"])


def phrases(postings, items, window=WINDOW):
    """(_id, _text, _key, item_id, start, end) of every maximal exact phrase match.

    A match covers ``window`` consecutive item terms or more, or the whole of an
    item with fewer. ``postings`` is a written index, ``items`` of ``item_terms``.
    """
    counts = postings.filter("term is not null").groupBy("term").agg(F.sum("n").alias("total"))
    pairs = scratch.materialise(rarest_pairs(items, counts, window), "rarest")
    used = pairs.select(F.col("t1").alias("term")).union(pairs.select("t2")).distinct()
    rare = postings.join(used, "term", "left_semi")
    shifted = F.array_intersect(
        F.transform("_p1", lambda p: p - F.col("q1")), F.transform("_p2", lambda p: p - F.col("q2"))
    )
    starts = _both(rare, pairs).select(*DOC, "_key", F.explode(shifted).alias("_at")).distinct()
    starts = scratch.materialise(starts, "aligned")
    there = postings.join(starts.select(*DOC).distinct(), DOC, "left_semi")
    wanted = starts.join(items.select("_key", "item_id", "_n", "q", "term"), "_key")
    met = (
        wanted.join(there.select(*DOC, "term", "positions"), [*DOC, "term"])
        .filter(F.array_contains("positions", F.col("_at") + F.col("q")))
        .select(*DOC, "_key", "item_id", "_n", "_at", "q")
        .distinct()
    )
    line = Window.partitionBy(*DOC, "_key", "_at").orderBy("q")
    runs = met.withColumn("_run", F.col("q") - F.row_number().over(line)).groupBy(
        *DOC, "_key", "item_id", "_n", "_at", "_run"
    ).agg(F.min("q").alias("_a"), F.max("q").alias("_b"))
    return runs.filter(F.col("_b") - F.col("_a") + 1 >= F.least(F.lit(window), F.col("_n"))).select(
        *DOC, "_key", "item_id", (F.col("_at") + F.col("_a")).alias("start"), (F.col("_at") + F.col("_b")).alias("end")
    )


def proximity(postings, items, slop=5, window=WINDOW):
    """(_id, _text, _key, position, gap): the two rarest terms of a window close together.

    A document is returned with its smallest gap when that is at most ``slop``.
    """
    counts = postings.filter("term is not null").groupBy("term").agg(F.sum("n").alias("total"))
    pairs = rarest_pairs(items, counts, window)
    used = pairs.select(F.col("t1").alias("term")).union(pairs.select("t2")).distinct()
    gaps = F.flatten(
        F.transform("_p1", lambda p: F.transform("_p2", lambda r: F.struct(F.abs(p - r).alias("gap"), p.alias("position"))))
    )
    near = _both(postings.join(used, "term", "left_semi"), pairs).select(*DOC, "_key", F.array_min(gaps).alias("_g"))
    best = near.groupBy(*DOC, "_key").agg(F.min("_g").alias("_g"))
    return best.filter(F.col("_g.gap") <= slop).select(*DOC, "_key", "_g.position", "_g.gap")


def blocks(items, max_terms=MAX_TERMS):
    """The items in parts of at most about ``max_terms`` distinct terms, each with its term map."""
    items = scratch.materialise(items, "items")
    parts = items.select("_word").distinct().count() // max_terms + 1
    for part in range(parts):
        own = items.filter(F.pmod("_key", F.lit(parts)) == part)
        words = own.select("_word", "term").distinct().collect()
        yield own.drop("_word"), {w.encode(): t for w, t in words}


def tagged(docs):
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        id_or_last(F.col("doc_id")).alias("_id"), F.xxhash64(text).alias("_text"), text.cast("binary").alias("data")
    )


def judge(docs, benchmark, window=WINDOW, share=20):
    """How far each document repeats the test items.

    Returns one row per row of ``docs``: doc_id, n_words, n_hit (words inside an
    occurring window), n_items, items_sha256 (of the sorted item ids), and
    contaminated (n_hit > 0 and share * n_hit >= n_words). Null and empty texts
    have no words and are clean; items without words never match; an item
    without id counts under the empty id; repeated rows are judged alike; an
    empty benchmark leaves everything clean. Other columns are ignored.
    """
    hits, sizes = None, None
    for own, vocabulary in blocks(item_terms(benchmark), max_terms=MAX_TERMS):
        postings = scratch.materialise(index(tagged(docs), vocabulary), "postings")
        found = phrases(postings, own, window)
        hits = found if hits is None else hits.unionByName(found)
        if sizes is None:
            sizes = postings.filter("term is null").select(*DOC, F.col("n").alias("n_words"))
    hits = scratch.materialise(hits, "phrases")
    covered = (
        hits.select(*DOC, F.explode(F.sequence("start", "end")).alias("_p")).distinct()
        .groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    )
    named = hits.groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("_items"))
    judged = sizes.join(covered.join(named, DOC), DOC, "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        id_or_null(F.col("_id")).alias("doc_id"),
        "_text",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs, benchmark, window=WINDOW, share=20):
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = judge(docs, benchmark, window, share).filter("contaminated")
    bad = bad.select(id_or_last(F.col("doc_id")).alias("_id"), "_text").distinct()
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        id_or_last(F.col("doc_id")).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"),
    )
    return keyed.join(bad, DOC, "left_anti").select("_row.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), (SELECT DISTINCT n FROM bw) z
       WHERE i + z.n - 1 <= len(w)),
h AS (SELECT DISTINCT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
