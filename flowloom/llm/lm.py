"""Stupid-backoff language-model scores from n-gram count tables.

The text becomes blocks of words, numbered within the block. Each block counts
its own n-grams, known by 64-bit hashes of their words, and sends them, packed and
dealt by hash, to the count tables; a table adds the counts of all blocks and
answers every block with the totals of the n-grams it sent. One order goes after the other,
so only one order's counts are under way at a time. Joined back to the exploded n-grams of
the block's documents, the totals give a score per word, summed per document. An n-gram goes over the wire once
for each block that has it, so a phrase in every document costs no more than any
other.

S(w | context) = count(context w) / count(context) if that n-gram was counted at
least ``CUTOFF`` times (a scored document has every n-gram of its own once, so from one on
nothing would ever back off), else ``BACKOFF`` * S(w | shorter context); single words
have their share of all words. Every word counts as itself, however rare; only a
caller that names a vocabulary size gets one unknown word for the rest.
"""

import contextlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowloom.llm.text import words
from flowloom.sources import scratch

ORDER = 3
BACKOFF = 0.4
CUTOFF = 2
#: Stands for all words outside a named vocabulary; no word is empty.
UNKNOWN = b""
BLOCK_WORDS = 1_000_000
TABLE_KEYS = 1_500_000
COUNTED = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# An odd multiplier and the final mix of the n-gram hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _count_words(batches):
    counts = {}

    def flush():
        names = list(counts)
        return pa.record_batch(
            [pa.array(names, pa.binary()), pa.array([counts[w] for w in names], pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for data in batch.column(0).to_pylist():
            for word in words(data):
                counts[word] = counts.get(word, 0) + 1
            if len(counts) >= COUNTED:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def vocabulary(docs, size):
    """The ``size`` most frequent words; ties by the word's bytes."""
    counts = docs.select("data").mapInArrow(_count_words, "word binary, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    # Written first, so that the driver gets the list and not a list per task.
    return {bytes(r["word"]) for r in scratch.materialise(top, "vocabulary").collect()}


def _number(known, block_words):
    """Rows of documents as blocks of words: hashes of the distinct ones, and their numbers."""

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        ids, lists, size, local = [], [], 0, {}

        def block():
            flat = np.concatenate(lists) if lists else np.empty(0, np.uint32)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in local], np.uint64)
            return pa.record_batch(
                [
                    pa.array([(part << 32) + serial], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in lists]], pa.list_(pa.int64())),
                    pa.array([hashes.tobytes()], pa.binary()),
                    pa.array([_pack(flat)], pa.binary()),
                ],
                names=["block", "ids", "sizes", "hashes", "numbers"],
            )

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(data)
                if known is not None:
                    found = [w if w in known.value else UNKNOWN for w in found]
                ids.append(doc)
                lists.append(np.array([local.setdefault(w, len(local)) for w in found], np.uint32))
                size += len(found)
                if size >= block_words:
                    yield block()
                    serial, ids, lists, size, local = serial + 1, [], [], 0, {}
        if ids:
            yield block()

    return run


def _pack(array):
    """Compressed byte planes of an array."""
    return zstandard.compress(array.view(np.uint8).reshape(-1, array.itemsize).T.tobytes(), 1)


def _unpack(data, kind):
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _hashes(row):
    """The hash of each word of a block."""
    return np.frombuffer(row["hashes"], np.uint64)[_unpack(row["numbers"], np.uint32)]


def _mixed(h):
    for factor in MIX:
        h = h ^ (h >> np.uint64(33))
        h = h * factor
    return h ^ (h >> np.uint64(33))


def grams(hashes, sizes, order):
    """Keys of the ``order``-grams of each document, and the place each one ends at."""
    n = max(0, len(hashes) - order + 1)
    key = hashes[:n]
    for i in range(1, order):
        key = _mixed(key * FACTOR + hashes[i : n + i])
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.flatnonzero(within >= order - 1)
    return key[ends - order + 1], ends


def _deal(keys, tables):
    """The table of each key; a table has a range of keys."""
    return ((keys >> np.uint64(40)) * np.uint64(tables) >> np.uint64(24)).astype(np.int32)


def _steps(keys):
    """Sorted keys as differences, which pack better."""
    return np.diff(keys, prepend=np.uint64(0))


def _send(n, tables):
    """Each block's own counts of n-grams, packed per table."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, sizes = _hashes(row), np.array(row["sizes"], np.int64)
                keys, counts = np.unique(grams(hashes, sizes, n)[0], return_counts=True)
                owner = _deal(keys, tables)
                for table in np.unique(owner):
                    own = owner == table
                    yield pa.record_batch(
                        [
                            pa.array([n], pa.int32()),
                            pa.array([table], pa.int32()),
                            pa.array([row["block"]], pa.int64()),
                            pa.array([_pack(_steps(keys[own]))], pa.binary()),
                            pa.array([_pack(counts[own].astype(np.uint32))], pa.binary()),
                        ],
                        names=["n", "part", "block", "keys", "counts"],
                    )

    return run


def _total(rows):
    """The totals of one count table, as answers to the blocks that share it."""
    keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()]
    counts = [_unpack(c, np.uint32) for c in rows["counts"].to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)[place]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table(
        {
            "block": rows["block"],
            "n": rows["n"],
            "part": rows["part"],
            "totals": pa.array([_pack(t) for t in np.split(totals, cuts)], pa.binary()),
        }
    )


def _scores(order, tables, total, backoff, cutoff):
    """Sum of log scores per document of each block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, sizes = _hashes(row), np.array(row["sizes"], np.int64)
                answers = {(a["n"], a["part"]): a["totals"] for a in row["answers"] or []}
                before = np.full(len(hashes), float(total))
                score = np.zeros(len(hashes))
                for n in range(1, order + 1):
                    keys, ends = grams(hashes, sizes, n)
                    distinct, place = np.unique(keys, return_inverse=True)
                    owner, found = _deal(distinct, tables), np.zeros(len(distinct))
                    for table in np.unique(owner):
                        found[owner == table] = _unpack(answers[n, int(table)], np.uint64)
                    here = np.zeros(len(hashes))
                    here[ends] = found[place]
                    if n == 1:
                        score = np.log(here / total) if len(hashes) else score
                    else:
                        known = np.zeros(len(hashes), bool)
                        known[ends] = here[ends] >= cutoff
                        context = np.r_[1.0, before[:-1]]
                        backed = np.zeros(len(hashes), bool)
                        backed[ends] = True
                        score = np.where(
                            known,
                            np.log(np.maximum(here, 1)) - np.log(np.maximum(context, 1)),
                            score + np.where(backed, np.log(backoff), 0.0),
                        )
                    before = here
                doc = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.bincount(doc, weights=score, minlength=len(sizes))
                yield pa.record_batch(
                    [pa.array(row["ids"], pa.int64()), pa.array(sizes), pa.array(sums)],
                    names=["doc_id", "n_words", "log_score"],
                )

    return run


@contextlib.contextmanager
def _shuffles_removed(spark):
    """What a query inside shuffled is deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def score(docs, order=ORDER, size=None, backoff=BACKOFF, cutoff=CUTOFF, block_words=BLOCK_WORDS, table_keys=TABLE_KEYS):
    """doc_id, n_words, log_score and mean_log_score of every row of ``docs``.

    The counts cover all rows. ``log_score`` is the sum of the natural logs of
    the scores of a document's words; n-grams do not cross documents. Null and
    empty texts have no words and score 0; repeated rows count and score each;
    null ids stay null; an empty table gives an empty result. Other columns are
    ignored. With ``size`` all but the ``size`` most frequent words are one word.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    known = None if size is None else docs.sparkSession.sparkContext.broadcast(vocabulary(rows, size))
    schema = "block long, ids array<long>, sizes array<long>, hashes binary, numbers binary"
    blocks = scratch.materialise(rows.mapInArrow(_number(known, block_words), schema), "blocks")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, v: s + v))).head()[0] or 0
    tables = max(1, -(-total // table_keys))
    answers = None
    with _shuffles_removed(docs.sparkSession):
        for n in range(1, order + 1):
            sent = blocks.mapInArrow(_send(n, tables), "n int, part int, block long, keys binary, counts binary")
            totals = sent.groupBy("n", "part").applyInArrow(_total, "block long, n int, part int, totals binary")
            totals = scratch.materialise(totals, "totals")
            answers = totals if answers is None else answers.unionByName(totals)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("n", "part", "totals")).alias("answers"))
    ready = blocks.join(answers, "block", "left")
    scored = ready.mapInArrow(
        _scores(order, tables, total, backoff, cutoff), "doc_id long, n_words long, log_score double"
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return scored.withColumn("mean_log_score", mean)
