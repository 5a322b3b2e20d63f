"""Removal of repeated 100-byte strings: prefix doubling over a sparse suffix sample.

Plain prefix doubling gives every byte position a rank and sorts rank pairs at
growing offsets in every round, which moves all positions again and again. Here
only a sample of positions is ranked at first: each 100-byte string contains, at
a place that depends on nothing but its own bytes, the smallest of its 32-byte
gram hashes, its anchor. Equal strings have equal anchors, so the strings that
share an anchor form a run of starts with one row.

Round 1 ranks the runs by the anchor's 32 bytes, and pairs that rank with the
rank of the run's whole context. A run whose anchor is unique is finished: none
of its strings repeats. A run whose context pair equals an earlier one is covered
completely. What is left is ambiguous and goes to the next round with a larger
offset: the run is cut into blocks of starts, ranked by the pair of the anchor's
rank and the longer string all starts of the block share, 93 bytes or more in
round 2 and the threshold of 100 in round 3. Rounds end when a rank is unique or
the threshold is reached.

Copies inside a batch are merged before the shuffle, with the list of the places
they stand for, so a passage in a third of all documents sends one row a batch.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.llm.text import id_or_last, id_or_null
from flowloom.sources import scratch

LENGTH = 100
GRAM = 32
WIDTHS = (8, 1)
DOC = ["_id", "content"]
PIECE = 1_000_000
#: Documents of a round up to which their ids are sent to the scan of the texts.
SEND_IDS = 500_000
# Base of the polynomial hash, its inverse modulo 2**64, the final mix.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
RUN = (
    "_id long, content long, anchor long, low int, high int, rank long, pair long, "
    "others array<struct<_id:long,content:long,anchor:long>>"
)


def _mixed(h):
    for factor in MIX:
        h = h ^ (h >> np.uint64(33))
        h = h * factor
    return h ^ (h >> np.uint64(33))


class Hashes:
    """64-bit hashes of any substring of a byte array."""

    def __init__(self, data):
        table = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        power = self._powers(BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[:-1], dtype=np.uint64, out=self.sums[1:])
        self.back = self._powers(INVERSE, len(data) + 1)

    @staticmethod
    def _powers(base, n):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, start, end):
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def runs(texts):
    """(doc, anchor, low, high, rank, pair) of each run of starts of the texts.

    ``low`` and ``high`` are the distances from the first and last start to the
    anchor; ``rank`` hashes the anchor's gram, ``pair`` the context and its place.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(data) or sizes.max() < LENGTH:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    hashes = Hashes(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = hashes.of(place, place + GRAM)
    bits = np.uint64(int(len(data)).bit_length())
    least = (gram >> bits << bits) | place.astype(np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(least) - width + span], least[width - span :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    p = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= (starts + sizes)[doc])
    anchor, doc = anchor[p], doc[p]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    a, lo, hi, doc = anchor[first], p[first], p[last], doc[first]
    pair = _paired(hashes.of(lo, hi + LENGTH), a - lo, a - hi)
    return [doc, a - starts[doc], a - lo, a - hi, gram[a], pair]


def _paired(rank, low, high):
    """The rank of a string together with where its starts lie."""
    return _mixed(rank + (low * 128 + high).astype(np.uint64) * np.uint64(BASE))


def _merged(ids, content, anchor, low, high, rank, pair):
    """One row per (rank, pair) of a batch, at its earliest place, with the other places."""
    order = np.lexsort((anchor, content, ids, pair, rank))
    ids, content, anchor, low, high, rank, pair = (x[order] for x in (ids, content, anchor, low, high, rank, pair))
    n = len(ids)
    first = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (pair[1:] != pair[:-1])]) if n else np.empty(0, int)
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    other = (ids != ids[first][owner]) | (content != content[first][owner]) | (anchor != anchor[first][owner])
    offsets = np.r_[0, np.cumsum(np.bincount(owner[other], minlength=len(first)))].astype(np.int32)
    places = pa.StructArray.from_arrays(
        [pa.array(ids[other]), pa.array(content[other]), pa.array(anchor[other])], names=["_id", "content", "anchor"]
    )
    return pa.record_batch(
        [
            pa.array(ids[first]),
            pa.array(content[first]),
            pa.array(anchor[first]),
            pa.array(low[first].astype(np.int32)),
            pa.array(high[first].astype(np.int32)),
            pa.array(rank[first].view(np.int64)),
            pa.array(pair[first].view(np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets), places),
        ],
        names=["_id", "content", "anchor", "low", "high", "rank", "pair", "others"],
    )


def _pieces(texts):
    """Slices of a list of texts of about ``PIECE`` bytes."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _ranked(batches):
    """Runs of every document, merged per batch."""
    for batch in batches:
        ids, content = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(2))
        texts = batch.column(2).to_pylist()
        parts = []
        for piece in _pieces(texts):
            found = runs(texts[piece])
            parts.append([ids[piece][found[0]], content[piece][found[0]], *found[1:]])
        if parts:
            yield _merged(*(np.concatenate(x) for x in zip(*parts)))


def _refined(width):
    """Blocks of ``width`` starts of the ambiguous runs of each document."""

    def run(batches):
        for batch in batches:
            parts = []
            for doc, content, data, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hashes = Hashes(np.frombuffer(data, np.uint8))
                a, low, high, rank = (np.array([f[k] for f in found], np.int64) for k in ("anchor", "low", "high", "rank"))
                # A later start is nearer to the anchor; blocks are cut at multiples of the width.
                n = low // width - high // width + 1
                each = np.repeat(np.arange(len(a)), n)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                block = (high // width)[each] + step
                far = np.minimum(low[each], block * width + width - 1)
                near = np.maximum(high[each], block * width)
                own = a[each]
                # What all starts of the uncut block share, so that differently cut blocks meet.
                common = hashes.of(own - block * width, own - block * width - width + 1 + LENGTH)
                whole = hashes.of(own - far, own - near + LENGTH)
                shared = _paired(common + _mixed(rank[each].view(np.uint64)), block, block)
                parts.append([np.full(len(own), doc, np.int64), np.full(len(own), content, np.int64), own, far, near, shared, _paired(whole, far, near)])
                if sum(len(x[0]) for x in parts) > 200_000:
                    yield _merged(*(np.concatenate(x) for x in zip(*parts)))
                    parts = []
            if parts:
                yield _merged(*(np.concatenate(x) for x in zip(*parts)))

    return run


def settle(rows):
    """(covered, ambiguous) of a round: places that repeat, and rows for the next round.

    Rows of one rank are sorted together. The earliest of equal pairs stands for
    them; if a rank has other pairs too, it must be looked at more closely.
    """
    rank = Window.partitionBy("rank")
    pair = Window.partitionBy("rank", "pair")
    place = F.struct("_id", "content", "anchor")
    judged = (
        rows.select(
            "*",
            F.count("*").over(rank).alias("_n"),
            F.min("pair").over(rank).alias("_least"),
            F.max("pair").over(rank).alias("_most"),
            F.min(place).over(pair).alias("_first"),
        )
        .filter((F.col("_n") > 1) | (F.size("others") > 0))
        .select(
            "_id", "content", "anchor", "low", "high", "rank",
            (F.col("_first") != place).alias("late"),
            (F.col("_least") != F.col("_most")).alias("mixed"),
            F.filter("others", lambda o: o != F.col("_first")).alias("others"),
        )
    )
    judged = scratch.materialise(judged, "ranks")
    spans = F.concat("others", F.when(F.col("late"), F.array(place)).otherwise(F.expr("filter(others, o -> false)")))
    covered = judged.select("low", "high", F.explode(spans).alias("_o")).select(
        "_o._id",
        "_o.content",
        (F.col("_o.anchor") - F.col("low")).alias("start"),
        (F.col("_o.anchor") - F.col("high") + LENGTH).alias("end"),
    )
    ambiguous = judged.filter("mixed and not late").select("_id", "content", "anchor", "low", "high", "rank")
    return covered, ambiguous


def covered(docs):
    """(_id, content, start, end) of byte ranges that repeat an earlier string; ranges may overlap.

    ``docs`` has _id, content and data. A document is known by its id and the hash
    of its bytes. A place is earlier if its id is smaller, or in documents that
    share an id its content, or its start in the same document.
    """
    found, left = settle(docs.mapInArrow(_ranked, RUN))
    for width in WIDTHS:
        work = left.groupBy(*DOC).agg(F.collect_set(F.struct("anchor", "low", "high", "rank")).alias("found"))
        work = scratch.materialise(work, "ambiguous")
        ids = work.select(*DOC)
        source = docs.join(F.broadcast(ids), DOC, "left_semi") if ids.count() <= SEND_IDS else docs
        cut = source.join(work, DOC).select(*DOC, "data", "found").mapInArrow(_refined(width), RUN)
        more, left = settle(cut)
        found = found.unionByName(more)
    return found


def _cut(data, spans):
    """(kept bytes, removed, number of maximal removed runs) for sorted spans."""
    kept, done, n = [], 0, 0
    for start, end in spans:
        start, end = min(start, len(data)), min(end, len(data))
        if end <= done:
            continue
        if start > done or n == 0:
            kept.append(data[done:start])
            n += end > start
        done = end
    kept.append(data[done:])
    kept = b"".join(kept)
    return kept, len(data) - len(kept), n


def _removed(batches):
    for batch in batches:
        kept, lost, counts = [], [], []
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text, removed, n = _cut(data, sorted((s["start"], s["end"]) for s in spans or []))
            kept.append(text)
            lost.append(removed)
            counts.append(n)
        yield pa.record_batch(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array(lost, pa.int64()), pa.array(counts, pa.int64())],
            names=["_id", "kept", "n_removed", "n_spans"],
        )


def remove(docs):
    """(_id, kept, n_removed, n_spans) of every row of ``docs`` (_id, data)."""
    docs = docs.select("_id", F.xxhash64("data").alias("content"), "data")
    spans = covered(docs).distinct().groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans, DOC, "left").select("_id", "data", "spans")
    return joined.mapInArrow(_removed, "_id long, kept binary, n_removed long, n_spans long")


def digest(docs):
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Null and empty texts have no bytes; a missing id counts as the largest and
    comes back null; rows that share an id are told apart by their texts, in the
    order of a hash of them. Repeated rows, of one id and text, are one document
    and give equal results. Other columns are ignored.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    done = remove(docs.select(id_or_last(F.col("doc_id")).alias("_id"), data.alias("data")))
    return done.select(
        id_or_null(F.col("_id")).alias("doc_id"),
        (F.length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
