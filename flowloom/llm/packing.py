"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and an end id; one longer than a sequence is cut into
whole sequences and a rest. What has to be packed is known once the pieces of each
length are counted, and there are at most ``capacity`` lengths, so the packing is
decided on these counts, whatever the number of documents:

1. pieces above a third of the capacity fit in a sequence twice at most: the longest
   is matched with the longest that still fits, which gives the most pairs there are;
2. shorter pieces, longest first, go where the least room is left over.

A decision places a run of equal pieces into a run of sequences with equal room. Each
time a run of sequences is filled further its room falls below half (what remains of
``g`` after whole pieces of at most ``g`` is under ``g / 2``), a length opens or splits
at most three runs, so a plan has under ``40 * capacity`` decisions. Pieces
are numbered within their length (place among those of its task, counts of the tasks
before) and so find their decision with one join of narrow rows.
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.sources import scratch

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = (0).to_bytes(4, "little")
#: Bytes of text that are cut into words at a time, words kept with their ids, and bytes of ids sent at a time.
SEGMENT, KNOWN, LONGEST_KNOWN, SEND = 1 << 22, 800_000, 64, 1 << 22
#: Stands between words that are encoded in one call.
MARK, STOPS = b"\x00", b".,;:!?"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, _part int, _rank long"
PLAN = "length long, _from long, _n long, _first long, _each long, _offset long"


def tokenizer_path(path=None):
    """The tokenizer file: ``path``, or the public word-level one."""
    if path is None:
        import public_tokenizers

        return public_tokenizers.path(TOKENIZER)
    return path


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, of UTF-8 texts.

    The tokenizer drops white space and neither its normal form nor its tokens reach
    across ASCII white space, so a text's ids are those of its words, one after the
    other, and words met before are not encoded again. A word of ASCII letters is one
    unit of the tokenizer's model once lower-cased; of the others, those of letters go to
    the tokenizer in one text, where an id that closes a word ends each, and the rest with
    a mark between them. Works for tokenizers with these properties only; whether the model
    may be asked alone, and stops parted from the letter before them, is tried out.
    """

    def __init__(self, path=None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.known = {}
        mark = self._ids([MARK.decode()])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.model = self.tokenizer.model
        close = getattr(self.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab()
        self.numbers = [i.to_bytes(4, "little") for i in range(max(words.values()) + 1)]
        self.closes = np.zeros(len(self.numbers), bool)
        self.closes[[i for w, i in words.items() if close and w.endswith(close)]] = True
        joined, parted = self._ids([f"a{stops} b1{stops}" for stops in (STOPS.decode(), " " + STOPS.decode())])
        self.part = joined.tobytes() == parted.tobytes()
        tried = [w for w in sorted(words) if w.isascii() and w.isalpha()][::97] + ["The", "QUICK", "aZbYcX"]
        self.plain = all(self._model(w.encode()) == i.tobytes() for w, i in zip(tried, self._ids(tried)))

    def _model(self, word):
        numbers = self.numbers
        return b"".join([numbers[t.id] for t in self.model.tokenize(word.lower().decode())])

    def _ids(self, texts):
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _keep(self, words, ids, starts, ends):
        data = ids.tobytes()
        self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, starts, ends, strict=True))

    def _encode(self, words):
        """Ids of new words."""
        known = self.known
        if self.plain:
            for w in words:
                if w.isalpha():
                    known[w] = self._model(w)
            words = [w for w in words if w not in known]
        letters = [w for w in words if w.decode().isalpha()]
        if letters:
            ids = self._ids([b" ".join(letters).decode()])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(letters):
                self._keep(letters, ids, [0, *ends[:-1].tolist()], ends.tolist())
        left = [w for w in words if w not in known]
        marked = [w for w in left if MARK not in w] if self.mark is not None else []
        if marked:
            ids = self._ids([(b" %b " % MARK).join(marked).decode()])[0]
            cuts = np.flatnonzero(ids == self.mark)
            self._keep(marked, ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        rest = [w for w in left if w not in known]
        known.update((w, i.tobytes()) for w, i in zip(rest, self._ids([w.decode() for w in rest])))

    def _learn(self, new):
        known, stopped, needed = self.known, {}, set()
        for w in new:
            core = w.rstrip(STOPS) if self.part else w
            if 0 < len(core) < len(w) and core[-1:].isalnum():
                stopped[w] = core, w[len(core) :]
                needed.update(p for p in stopped[w] if p not in known)
            else:
                needed.add(w)
        if needed:
            self._encode(list(needed))
        known.update((w, known[a] + known[b]) for w, (a, b) in stopped.items())

    def encode(self, texts):
        """The ids of each text; texts are bytes of some megabytes at most together."""
        if len(self.known) > KNOWN:
            self.known = {}
        split = [text.split() for text in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        found = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONGEST_KNOWN:
                del self.known[w]
        return found


def _segments(rows):
    """Lists of (row, bytes, whether they end its text), about ``SEGMENT`` bytes of text each.

    Long texts are cut before white space.
    """
    part, held = [], 0
    for row, data in rows:
        start = 0
        while True:
            cut = BLANK.search(data, start + SEGMENT) if len(data) - start > SEGMENT else None
            end = cut.start() if cut else len(data)
            part.append((row, data[start:end], end == len(data)))
            held, start = held + end - start, end
            if held >= SEGMENT:
                yield part
                part, held = [], 0
            if start == len(data):
                break
    if part:
        yield part


def pieces(docs, capacity=CAPACITY, path=None):
    """A written table of each document's pieces with their ids.

    ``_part`` is the task that cut the piece and ``_rank`` its place, from 0, among the
    task's pieces of that length.
    """
    size = 4 * capacity

    def run(batches):
        encoder, task, seen = Encoder(path), TaskContext.get().partitionId(), {}
        rows, held = [], 0

        def add(doc, number, start, ids):
            length = len(ids) // 4
            rank = seen.get(length, 0)
            seen[length] = rank + 1
            rows.append((doc, number, start, length, ids, zlib.crc32(ids), task, rank))

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.record_batch(columns, names=names)

        def documents():
            for one in batches:
                for doc, text in zip(one.column(0), one.column(1)):
                    yield doc.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b""

        number, buffer = 0, b""
        for part in _segments(documents()):
            for (doc, _, last), ids in zip(part, encoder.encode([data for _, data, _ in part])):
                buffer += ids + END if last else ids
                at, keep = 0, 0 if last else 1
                while len(buffer) - at >= size + keep or (last and at < len(buffer)):
                    add(doc, number, number * capacity, buffer[at : at + size])
                    at, number, held = at + size, number + 1, held + size
                number, buffer = (0, b"") if last else (number, buffer[at:])
            if held >= SEND:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return scratch.materialise(read.mapInArrow(run, PIECES), "pieces")


def plan(counts, capacity=CAPACITY):
    """The decisions: (length, from, n, first, each, offset).

    Of the pieces of ``length``, those ranked ``from`` and on, ``n`` of them, go to the
    sequences ``first`` and on, ``each`` to a sequence, the first of them at ``offset``.
    ``counts`` maps a length to its number of pieces.
    """
    steps, rooms = [], {}
    left = {length: n for length, n in counts.items() if n}
    rank, opened = dict.fromkeys(left, 0), 0

    def place(length, n, first, each, offset):
        steps.append((length, rank[length], n, first, each, offset))
        rank[length] += n
        left[length] -= n

    def room(gap, first, n):
        if gap and n:
            rooms.setdefault(gap, []).append((first, n))

    large = sorted((length for length in left if 3 * length > capacity), reverse=True)
    for i, length in enumerate(large):
        for other in large[i:]:
            if not left[length]:
                break
            if length + other > capacity or not left[other]:
                continue
            n = left[length] // 2 if other == length else min(left[length], left[other])
            if n:
                place(length, n, opened, 1, 0)
                place(other, n, opened, 1, length)
                room(capacity - length - other, opened, n)
                opened += n
        if n := left[length]:
            place(length, n, opened, 1, 0)
            room(capacity - length, opened, n)
            opened += n

    for length in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        for gap in sorted(g for g in rooms if g >= length):
            if not left[length]:
                break
            each, groups = gap // length, rooms.pop(gap)
            for first, n in groups:
                full = min(n, left[length] // each)
                if full:
                    place(length, full * each, first, each, capacity - gap)
                    room(gap - each * length, first, full)
                rest = min(left[length], each) if full < n else 0
                if rest:
                    place(length, rest, first + full, rest, capacity - gap)
                    room(gap - rest * length, first + full, 1)
                room(gap, first + full + bool(rest), n - full - bool(rest))
        if n := left[length]:
            each = capacity // length
            full, rest = divmod(n, each)
            if full:
                place(length, full * each, opened, each, 0)
                room(capacity - each * length, opened, full)
            if rest:
                place(length, rest, opened + full, rest, 0)
                room(capacity - rest * length, opened + full, 1)
            opened += full + bool(rest)
    return steps


def pack(docs, capacity=CAPACITY, path=None):
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset of every piece.

    ``path`` is the tokenizer's file. Ids are binary, little-endian unsigned 32-bit
    numbers. A null or empty text is the end id alone. Rows are never told apart by
    their id, so null and repeated ids and repeated rows are packed like others; equal
    rows give pieces of their own. An empty table gives no sequence. Only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    cut = pieces(docs, capacity, path)
    sizes = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_c"))
    sizes = scratch.materialise(sizes, "piece-counts")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_c").alias("n")).collect()}
    steps = F.broadcast(spark.createDataFrame(plan(counts, capacity), PLAN))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    overlap = (F.col("_before") < F.col("_from") + F.col("_n")) & (F.col("_from") < F.col("_before") + F.col("_c"))
    runs = runs.join(steps, "length").filter(overlap)
    at = F.col("_rank") + F.col("_before") - F.col("_from")
    placed = cut.join(runs, ["length", "_part"]).filter((at >= 0) & (at < F.col("_n")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).alias("offset"),
    )


def sequences(packed):
    """(sequence_id, length, ids): the pieces of each sequence one after the other.

    A sequence has at most ``capacity`` pieces and ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def digest(docs, capacity=CAPACITY, path=None):
    """What ``pack`` gives, with ``ids_crc32`` for the ids."""
    return pack(docs, capacity, path).drop("ids")
