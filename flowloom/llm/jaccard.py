"""N-gram Jaccard join as a blocked sparse product of document by n-gram incidence.

Documents with the same shingle set are one row of the incidence matrix. Its
columns are ordered, frequent ones last, and a row of ``n`` shingles only keeps
its first ``n - ceil(0.8 n) + 1``: two rows that overlap enough share one of
them. Columns that have the same hub, the row with the most company, are a block;
a block multiplies its part of the matrix with itself, the products of a pair are
summed over the blocks, and a pair whose sum plus the shingles not looked at
stays below the overlap its sizes demand is discarded. Survivors are checked on
whole sets.

A group of thousands of near copies must not become all its pairs. So a row is
first compared with at most two others: the hub it shares the most columns with,
and the smallest row of its columns. The product then skips pairs that are
already connected, by multiplying the rows outside a column's largest component
with the others; large blocks are cut into pairs of chunks. No pair of different
components that shares a column is left out, so the components are exact.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.llm.graph import components
from flowloom.llm.text import id_or_last, id_or_null, words
from flowloom.sources import scratch

WIDTH = 5
#: Shingles that sort last: at most this many, seen this often in a chunk of rows.
STOP_LIST = 2**18
STOP_LOCAL, STOP_TOTAL = 3, 8
CHUNK = 4_000_000
CACHE = 1_000_000
#: Involved documents up to which their ids are sent to the scan of the texts.
SEND_IDS = 500_000
#: Rows of a chunk of a block, and products that are added up at a time.
UNIT = 1000
STRIP = 2_000_000
# Odd multipliers of the rolling combination and its final mix.
FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for the words met so far."""

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(data, hashes, width=WIDTH):
    """Sorted distinct shingle hashes of UTF-8 bytes.

    With fewer words than ``width`` the whole sequence is one shingle; without
    words the set is empty.
    """
    found = words(data)
    if not found:
        return np.empty(0, np.uint64)
    each = np.array([hashes[w] for w in found], np.uint64)
    n = min(width, len(each))
    total = np.full(len(each) - n + 1, n, np.uint64)
    for i in range(n):
        total += each[i : len(each) - n + 1 + i] * FACTORS[i % len(FACTORS)] + np.uint64(i // len(FACTORS))
    for factor in MIX:
        total ^= total >> np.uint64(33)
        total *= factor
    total ^= total >> np.uint64(33)
    return np.unique(total)


def set_key(shingles):
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _signed(values):
    return pa.array(values.view(np.int64))


def describe(width):
    """Per document its set size and set key; per chunk the shingles seen often."""

    def run(batches):
        hashes, pending, size = WordHashes(), [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts >= STOP_LOCAL
            n = int(often.sum())
            nulls = pa.nulls(n, pa.int64())
            return pa.record_batch(
                [nulls, nulls, nulls, nulls, _signed(values[often]), pa.array(counts[often].astype(np.int64))],
                names=["_id", "content", "n", "key", "shingle", "seen"],
            )

        for batch in batches:
            sizes, keys = [], []
            for data in batch.column(1).to_pylist():
                own = shingle_set(data, hashes, width)
                sizes.append(len(own))
                keys.append(set_key(own))
                pending.append(own)
                size += len(own)
                if size >= CHUNK:
                    yield frequent()
                    pending, size = [], 0
            nulls = pa.nulls(len(sizes), pa.int64())
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), nulls, nulls],
                names=["_id", "content", "n", "key", "shingle", "seen"],
            )
        if pending:
            yield frequent()

    return run


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def prefixes(stops, width):
    """Per distinct set of a batch the shingles that come first, stop shingles last."""

    def run(batches):
        hashes, last = WordHashes(), stops.value
        for batch in batches:
            done, keys, sizes, lists = set(), [], [], []
            for data in batch.column(0).to_pylist():
                own = shingle_set(data, hashes, width)
                key = set_key(own)
                if not len(own) or key in done:
                    continue
                done.add(key)
                if len(last):
                    place = np.minimum(np.searchsorted(last, own), len(last) - 1)
                    common = last[place] == own
                    own = np.r_[own[~common], own[common]]
                keys.append(key)
                sizes.append(len(own))
                lists.append(own[: prefix_length(len(own))].view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.record_batch(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["key", "n", "shingles"],
            )

    return run


def whole_sets(width):
    """The sets of the documents that hold a wanted key, one per key and batch."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys, members = [], []
            for wanted, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingle_set(data, hashes, width)
                if set_key(own) == wanted and wanted not in keys[-1:]:
                    keys.append(wanted)
                    members.append(own.tobytes())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(members, pa.binary())], names=["key", "members"])

    return run


def _linked(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def verify(pairs, docs, holders, width=WIDTH):
    """The pairs (a, b) of set keys whose whole sets are similar enough.

    ``holders`` maps a key to the (_id, content) of one document that has the set;
    ids alone do not tell documents apart. Only sets that some
    pair names are built; their ids go to the scan when there are at most
    ``SEND_IDS``, otherwise texts and ids meet in a shuffle.
    """
    pairs = scratch.materialise(pairs, "pairs")
    named = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    ids = scratch.materialise(named.join(holders, "key").select("_id", "content", "key"), "involved")
    if ids.count() <= SEND_IDS:
        ids = F.broadcast(ids)
    held = docs.join(ids, ["_id", "content"]).select("key", "data")
    sets = held.mapInArrow(whole_sets(width), "key long, members binary").dropDuplicates(["key"])
    sets = scratch.materialise(sets, "sets")
    one = sets.select(F.col("key").alias("a"), F.col("members").alias("_x"))
    two = sets.select(F.col("key").alias("b"), F.col("members").alias("_y"))
    ready = pairs.join(one, "a").join(two, "b").select("a", "b", "_x", "_y")
    return scratch.materialise(ready.mapInArrow(_linked, "a long, b long"), "links")


def beyond(n):
    """Shingles of a set that its prefix leaves out."""
    return F.floor((n * 4 + 4) / 5) - 1


def possible(common, na, nb):
    """Whether sets of these sizes that share ``common`` prefix shingles may be similar enough."""
    sizes = (na * 5 >= nb * 4) & (nb * 5 >= na * 4)
    return sizes & ((common + F.greatest(beyond(na), beyond(nb))) * 9 >= (na + nb) * 4)


def columns(postings):
    """``postings`` with the hub and the end of each column, both as (key, n).

    The hub of a column is its row with the most company in all columns, in a
    group of near copies most likely the text they were made from, so that the
    columns of a group have one hub.
    """
    company = postings.groupBy("key").agg(F.sum("_rows").alias("_met"))
    column = Window.partitionBy("shingle")
    return postings.join(company, "key").select(
        "shingle", "key", "n",
        F.max(F.struct("_met", "key", "n")).over(column).alias("_hub"),
        F.min(F.struct("key", "n")).over(column).alias("_end"),
    )


def stars(placed):
    """Up to two pairs (a, b) for each key: with a hub and with an end of its columns.

    Pairs that the prefixes in common make unlikely are left to the product.
    """
    side = lambda i, name: F.struct(F.lit(i).alias("side"), F.col(f"{name}.key"), F.col(f"{name}.n"))
    met = placed.select("key", "n", F.explode(F.array(side(0, "_hub"), side(1, "_end"))).alias("_e"))
    counts = met.filter(F.col("key") != F.col("_e.key")).groupBy("key", "n", "_e").agg(F.count("*").alias("_c"))
    likely = counts.filter(possible(F.col("_c"), F.col("n"), F.col("_e.n")))
    best = likely.groupBy("key", "_e.side").agg(F.max(F.struct("_c", "_e.key")).alias("_b"))
    end = F.col("_b.key")
    return best.select(F.least("key", end).alias("a"), F.greatest("key", end).alias("b")).distinct()


def _multiplied(unit):
    """Shared columns of the pairs between two chunks of rows of one block.

    ``all`` is the number of columns a row has in all blocks: a pair leaves the task
    only if what the two may share elsewhere could still lift it over the bounds.
    """
    shingles = np.unique(unit["shingle"].to_numpy())
    sides = []
    for left in (True, False):
        rows = unit.filter(unit["left"] if left else pc.invert(unit["left"]))
        column = np.searchsorted(shingles, rows["shingle"].to_numpy())
        order = np.argsort(column, kind="stable")
        keys, first, place = np.unique(rows["key"].to_numpy(), return_index=True, return_inverse=True)
        main = rows["main"].to_numpy(zero_copy_only=False)
        # Columns that a row has in other blocks, or that the unit with the sides changed counts.
        apart = rows["all"].to_numpy()[first] - np.bincount(place[main != left], minlength=len(keys))
        sides.append(
            (keys, rows["n"].to_numpy()[first], rows["component"].to_numpy()[first], apart, place[order], column[order], main[order])
        )
    (ka, na, ca, else_a, row_a, col_a, _), (kb, nb, cb, else_b, row_b, col_b, main) = sides
    total = np.zeros(len(ka) * len(kb), np.int64)
    width = np.bincount(col_b, minlength=len(shingles))
    start = np.cumsum(width) - width
    ends = np.cumsum(width[col_a])
    cuts = np.searchsorted(ends, np.arange(STRIP, (ends[-1] if len(ends) else 0) + STRIP, STRIP))
    for lo, hi in zip([0, *cuts], [*cuts, len(col_a)]):
        times = width[col_a[lo:hi]]
        i = np.repeat(row_a[lo:hi], times)
        at = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[col_a[lo:hi]], times)
        j = row_b[at]
        # Two rows outside the main component meet in both orders; one counts.
        once = main[at] | (ka[i] < kb[j])
        total += np.bincount((i * len(kb) + j)[once], minlength=len(total))
    i, j = np.divmod(np.flatnonzero(total), max(len(kb), 1))
    fits = (na[i] * 5 >= nb[j] * 4) & (nb[j] * 5 >= na[i] * 4) & (ca[i] != cb[j])
    i, j = i[fits], j[fits]
    here = total[i * len(kb) + j]
    # Of a pair in falling order a column outside the main component on both sides counts in the other unit.
    rest_a = np.where(ka[i] < kb[j], else_a[i], else_a[i] + np.bincount(row_a, minlength=len(ka))[i] - here)
    most = here + np.minimum(rest_a, else_b[j])
    beyond_prefix = np.maximum((4 * na[i] + 4) // 5, (4 * nb[j] + 4) // 5) - 1
    fits = (most + beyond_prefix) * 9 >= (na[i] + nb[j]) * 4
    i, j = i[fits], j[fits]
    swap = ka[i] > kb[j]
    return pa.table(
        {
            "a": np.where(swap, kb[j], ka[i]),
            "b": np.where(swap, ka[i], kb[j]),
            "na": np.where(swap, nb[j], na[i]),
            "nb": np.where(swap, na[i], nb[j]),
            "common": total[i * len(kb) + j],
        }
    )


def product(placed, labels):
    """Pairs (a, b) of different components that the size bounds do not rule out.

    ``placed`` is the result of ``columns``, ``labels`` (key, component) of the
    keys that have one. Columns are dealt to blocks by the hash of their hub; the
    rows of a block outside the largest component of their column are multiplied
    with all its rows, a pair of chunks of about ``UNIT`` rows at a time. Sums
    count common prefix shingles; what lies beyond the prefix can add at most its
    length, and other blocks at most the columns that a row has there, so that a
    block gives out only pairs that may still be similar enough.
    """
    tagged = placed.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    column = Window.partitionBy("shingle")
    part = Window.partitionBy("shingle", "component")
    mixed = (
        tagged.withColumn("_size", F.count("*").over(part))
        .withColumn("_most", F.max(F.struct("_size", "component")).over(column)["component"])
        .withColumn("main", F.col("component") == F.col("_most"))
        .withColumn("_other", F.max(~F.col("main")).over(column))
        .filter("_other")
        .withColumn("all", F.count("*").over(Window.partitionBy("key")))
        .select("shingle", "key", "n", "component", "main", "all", F.col("_hub.key").alias("_hub"))
    )
    mixed = scratch.materialise(mixed, "mixed-columns")
    blocks = mixed.select("_hub", "key").distinct().count() // UNIT + 1
    mixed = mixed.withColumn("block", F.pmod(F.xxhash64("_hub"), F.lit(blocks)))
    sizes = (
        mixed.groupBy("block", "key").agg(F.max((~F.col("main")).cast("long")).alias("_out"))
        .groupBy("block").agg(
            F.ceil(F.sum("_out") / UNIT).alias("_l"), F.ceil(F.count("*") / UNIT).alias("_r")
        )
    )
    dealt = mixed.join(sizes, "block").withColumns(
        {"_i": F.pmod(F.xxhash64("key"), F.col("_l")), "_j": F.pmod(F.xxhash64(F.lit(1), "key"), F.col("_r"))}
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["shingle", "key", "n", "component", "main", "all"]
    left = dealt.filter("not main").select("block", "_i", every("_r").alias("_j"), *kept, F.lit(True).alias("left"))
    right = dealt.select("block", every("_l").alias("_i"), "_j", *kept, F.lit(False).alias("left"))
    units = left.unionByName(right).groupBy("block", "_i", "_j")
    pairs = units.applyInArrow(_multiplied, "a long, b long, na long, nb long, common long")
    return (
        pairs.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("_common"))
        .filter(possible(F.col("_common"), F.col("na"), F.col("nb")))
        .select("a", "b")
    )


def join(docs, width=WIDTH):
    """(described, links): every document's set, and the links found between sets.

    ``docs`` has _id and data. ``described`` has (_id, content, n, key), content
    being a hash of data; ``links`` has the verified pairs (a, b) of keys, enough of
    them to connect what is connected.
    """
    spark = docs.sparkSession
    schema = "_id long, content long, n long, key long, shingle long, seen long"
    read = docs.select("_id", "data", F.xxhash64("data").alias("content"))
    first = scratch.materialise(read.mapInArrow(describe(width), schema), "sets-described")
    described = first.filter("shingle is null").select("_id", "content", "n", "key")
    holders = (
        described.filter("n > 0").groupBy("key").agg(F.min(F.struct("_id", "content")).alias("_h"))
        .select("key", "_h._id", "_h.content")
    )
    often = (
        first.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("_c"))
        .filter(F.col("_c") >= STOP_TOTAL).orderBy(F.desc("_c"), "shingle").limit(STOP_LIST).select("shingle")
    )
    stops = np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))
    known = spark.sparkContext.broadcast(stops)
    lists = docs.select("data").mapInArrow(prefixes(known, width), "key long, n long, shingles array<long>")
    dealt = lists.select("key", "n", F.explode("shingles").alias("shingle")).repartition("shingle")
    column = Window.partitionBy("shingle")
    postings = (
        dealt.groupBy("shingle", "key", "n").agg(F.lit(1).alias("_one"))
        .select(
            "shingle", "key", "n",
            F.count("*").over(column).alias("_rows"),
        )
        .filter("_rows > 1")
    )
    postings = scratch.materialise(postings, "postings")
    placed = scratch.materialise(columns(postings), "columns")
    links = verify(stars(placed), read, holders, width)
    labels = components(links).select(F.col("node").alias("key"), "component")
    rest = verify(product(placed, labels), read, holders, width)
    return described, links.union(rest)


def grouped(docs, width=WIDTH):
    """(_id, content, n, key, label) of every document; documents of a group share the label."""
    described, links = join(docs, width)
    labels = components(links).select(F.col("node").alias("key"), F.col("component").alias("label"))
    return described.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def near_duplicates(docs, width=WIDTH):
    """(_id, n, key, component) of every document; component is the smallest id reachable.

    ``docs`` has _id and data (UTF-8 bytes). A document without words is linked
    with nothing.
    """
    found = grouped(docs, width)
    least = found.filter("n > 0").groupBy("label").agg(F.min("_id").alias("_least"))
    return found.join(least, "label", "left").select(
        "_id", "n", "key", F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component")
    )


def tagged(docs):
    data = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(id_or_last(F.col("doc_id")).alias("_id"), data.alias("data"))


def digest(docs, width=WIDTH):
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Null and empty texts have no shingles and stand alone; texts of fewer words
    than ``width`` have one; a missing id counts as the largest and comes back
    null; repeated rows are copies of each other. Other columns are ignored.
    """
    found = near_duplicates(tagged(docs), width)
    return found.select(
        id_or_null(F.col("_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        id_or_null(F.col("component")).alias("component_id"),
    )


def keep_first(docs, width=WIDTH):
    """One row of each group of near duplicates, the one with the smallest id; all rows without words.

    Rows that share an id, or have none, are told apart by their texts: only rows
    with the same id and text are copies of one place.
    """
    place = F.struct("_id", "key", "content")
    chosen = grouped(tagged(docs), width).filter("n > 0").groupBy("label").agg(F.min(place).alias("_p"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    wordless = ~F.coalesce("_row.text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    content = F.xxhash64(F.col("_row.text").cast("binary"))
    # Copies are merged in each task before they meet.
    merged = (
        rows.filter(~wordless).groupBy(id_or_last(F.col("_row.doc_id")).alias("_id"), content.alias("content"))
        .agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    )
    kept = merged.join(chosen.select("_p._id", "_p.content"), ["_id", "content"], "left_semi")
    return kept.select("_row.*").unionByName(rows.filter(wordless).select("_row.*"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id
      HAVING 180 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = x.doc_id) + (SELECT n FROM n WHERE n.doc_id = y.doc_id))),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
      SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id
"""
