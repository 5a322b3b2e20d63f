"""Line dedup with levelled sorted runs of line hashes.

A run is a Parquet table of line-key hashes, sorted inside its hash partitions.
A new batch of documents merge-anti-joins the runs to find the keys nobody held
before, writes these as a run on level 0, and when a level has ``fanout`` runs
they are merged into one run of the next level. Every key is in one run only, so
a lookup reads each level once and the runs on disk never exceed the distinct
keys. Batches must come in ascending id order; the first holder of a key then
has the smallest id.
"""

from pyspark.sql import functions as F

from flowloom.llm.text import WHITE, id_or_last, lower_ascii
from flowloom.sources import scratch

MIN_KEY = 10
KEY = ["_h1", "_h2"]


class Runs:
    """The levels of hash runs under a folder of the shared store."""

    def __init__(self, spark, path=None, fanout=2):
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch.new_path(spark, "line-runs")
        self.levels = []

    def known(self):
        """All hashes held so far, or None."""
        paths = [path for level in self.levels for path in level]
        return self.spark.read.schema("_h1 long, _h2 long").parquet(*paths) if paths else None

    def add(self, keys):
        """Add a batch's distinct new hashes as a run and compact full levels."""
        self._write(keys.select(*KEY), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self.spark.read.schema("_h1 long, _h2 long").parquet(*merged), level + 1)
            for path in merged:
                scratch.remove(self.spark, path)
            level += 1

    def _write(self, keys, level):
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.path}/level-{level}-{scratch.uuid.uuid4().hex}"
        keys.repartition(F.col("_h1")).sortWithinPartitions(*KEY).write.parquet(path)
        self.levels[level].append(path)


def keyed(docs):
    """(_id, _text, _line, _h1, _h2) of every line whose key is long enough."""
    lines = docs.select("_id", "_text", F.posexplode(F.split("text", "\n", -1)).alias("_line", "_raw"))
    key = lower_ascii(F.btrim("_raw", F.lit(WHITE)))
    return (
        lines.select("_id", "_text", "_line", key.alias("_key"))
        .filter(F.length("_key") >= MIN_KEY)
        .select("_id", "_text", "_line", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )


def repeated(docs, batches=4, fanout=2):
    """(_id, _text, _lines): the line numbers each document loses.

    ``docs`` has _id, _text (a hash of the text) and text. Documents go through
    the runs in ``batches`` id ranges.
    """
    spark = docs.sparkSession
    marks = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx("_id", marks, 10000)).head()[0] or []))
    low = [None, *cuts]
    lines = scratch.materialise(keyed(docs), "line-keys")
    runs, lost = Runs(spark, fanout=fanout), []
    for start, end in zip(low, [*cuts, None]):
        batch = lines
        if start is not None:
            batch = batch.filter(F.col("_id") > start)
        if end is not None:
            batch = batch.filter(F.col("_id") <= end)
        first = batch.groupBy(*KEY).agg(F.min("_id").alias("_first"))
        known = runs.known()
        if known is not None:
            first = first.join(known.hint("merge"), KEY, "left_anti")
        new = scratch.materialise(first, "line-new")
        hit = batch.join(new, KEY, "left").filter("_first is null or _id > _first")
        lost.append(scratch.materialise(hit.select("_id", "_text", "_line"), "line-lost"))
        if end is not None:
            runs.add(new)
    union = lost[0]
    for part in lost[1:]:
        union = union.unionByName(part)
    return union.groupBy("_id", "_text").agg(F.collect_set("_line").alias("_lines"))


def _lined(docs, batches, fanout):
    """(_row, text, n_lines, n_dropped): every row as it was, and its text without lost lines."""
    text = F.coalesce("text", F.lit(""))
    tagged = docs.select(
        F.struct(*docs.columns).alias("_row"),
        text.alias("text"),
        id_or_last(F.col("doc_id")).alias("_id"),
        F.xxhash64(text).alias("_text"),
    )
    lost = repeated(tagged.select("_id", "_text", "text"), batches, fanout)
    joined = tagged.join(lost, ["_id", "_text"], "left").withColumn("_split", F.split("text", "\n", -1))
    numbers = F.coalesce("_lines", F.array().cast("array<int>"))
    spared = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), numbers)
    kept = F.concat_ws("\n", F.transform(spared, lambda i: F.get("_split", i)))
    return joined.select(
        "_row",
        "_lines",
        F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("_split").cast("long").alias("n_lines"),
        F.size(numbers).cast("long").alias("n_dropped"),
    )


def dedup(docs, batches=4, fanout=2, drop_emptied=False):
    """``docs`` with the lines taken out of ``text`` that an earlier document holds.

    A line's key is the line without white space at both ends, A-Z lower-cased;
    keys of under ten code points never count. A key that two or more ids hold
    keeps its lines only under the smallest id, there all of them. Null text is
    one empty line. Rows of one id count as one document; a missing id counts as
    the largest. Other columns come back as they were, whatever their names. With
    ``drop_emptied`` rows that lost lines and have nothing but white space left go too;
    rows that had nothing else before stay.
    """
    done = _lined(docs, batches, fanout)
    if drop_emptied:
        blank = lambda c: F.btrim(c, F.lit(WHITE + "\n")) == ""
        had = ~blank(F.coalesce(F.col("_row.text"), F.lit("")))
        done = done.filter(~(F.col("_lines").isNotNull() & had & blank(F.col("text"))))
    return done.select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")


def digest(docs, batches=4, fanout=2):
    """doc_id, n_lines (before), n_dropped and kept_sha256 of what ``dedup`` leaves."""
    done = _lined(docs.select("doc_id", "text"), batches, fanout)
    return done.select(
        "_row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id > f.first AS lost FROM l LEFT JOIN f USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
