"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic model
over its words and word stems; a document's is the noisy-or of its sentences, so labels of
documents train a model of sentences, which then points at the offending ones.

Training reads a bounded sample of the labelled rows (``max_train``, chosen by a
hash of the id) and at most ``max_features`` words; gradients are summed by
Spark tasks, only sums of that bounded width reach the driver. Scoring reads
every document once.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowloom.llm.text import terms
from flowloom.sources import scratch

MAX_TRAIN = 20_000
MAX_FEATURES = 5_000
THRESHOLD = 0.3
SENTENCE = re.compile(rb"[^.!?\n]+")
PARTS = 12
#: Lengths in characters of the leading parts of a word that are features too.
STEMS = range(4, 9)
CACHE = 500_000
#: Candidates must differ between the classes by so many standard errors.
LEAST_Z = 3.0


@dataclass
class Model:
    """Word weights and the bias every sentence starts from."""

    weights: dict
    bias: float


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 modulo 4; a missing id does not."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs, labels, max_train=MAX_TRAIN, seed=7):
    """(data, y) of about ``max_train`` labelled documents that are not held out.

    The sample is a range of the id's hash, so reruns and any partitioning give
    the same rows. A document with several labels is toxic if any says so.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .filter("doc_id is not null and y is not null")
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .filter(~held_out(F.col("doc_id")))
    )
    share = min(1.0, max_train / max(1, marks.count()))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    marks = marks.filter(place < int(share * 1_000_000))
    text = F.coalesce("text", F.lit("")).cast("binary").alias("data")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(marks, "doc_id").select("data", "y")


def features(word):
    """A word and its stems, the latter with a star."""
    text = word.decode(errors="replace")
    return [word, *(text[:n].encode() + b"*" for n in STEMS if len(text) > n)]


class Known(dict):
    """Word -> numbers of its features that a model has, remembered per word."""

    def __init__(self, numbers):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = tuple(self.numbers[f] for f in features(word) if f in self.numbers)
        return found

    def of(self, found):
        """Distinct feature numbers of the words of a sentence."""
        return {i for w in found for i in self[w]}


def _word_counts(batches):
    for batch in batches:
        seen = ({}, {})
        for data, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = seen[1 if y else 0]
            for feature in {f for w in set(terms(data)) for f in features(w)}:
                counts[feature] = counts.get(feature, 0) + 1
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.binary())]
        columns += [pa.array([seen[k].get(w, 0) for w in names], pa.int64()) for k in (0, 1)]
        yield pa.record_batch(columns, names=["word", "n0", "n1"])


def candidate_words(rows, max_features=MAX_FEATURES, min_docs=3):
    """[(word, log odds ratio)] of the words that tell the classes apart best."""
    n0, n1 = rows.agg(F.sum(1 - F.col("y")), F.sum("y")).head()
    if not n0 or not n1:
        return []
    counts = rows.mapInArrow(_word_counts, "word binary, n0 long, n1 long").groupBy("word").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    odds = F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.log(
        (F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5)
    )
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    top = (
        counts.filter(F.col("n0") + F.col("n1") >= min_docs)
        .select("word", odds.alias("odds"), F.abs(odds / error).alias("z"))
        .filter(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "word")
        .limit(max_features)
    )
    return [(bytes(r["word"]), r["odds"], r["z"]) for r in top.collect()]


def _bags(known):
    """Sentences as lists of feature numbers, one row per document."""

    def build(batches):
        numbers = Known(known.value)
        for batch in batches:
            ids, lengths = [], []
            for data in batch.column(0).to_pylist():
                own, sizes = [], []
                for sentence in SENTENCE.findall(data):
                    found = terms(sentence)
                    if found:
                        hit = numbers.of(found)
                        own.extend(sorted(hit))
                        sizes.append(len(hit))
                ids.append(own)
                lengths.append(sizes)
            yield pa.record_batch(
                [batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))],
                names=["y", "ids", "sizes"],
            )

    return build


def _softplus(z):
    return np.logaddexp(0, z)


def _gradient(weights, bias):
    """Loss and gradient of the noisy-or likelihood over a task's documents."""

    def run(batches):
        total = np.zeros(len(weights) + 2)
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), dtype=float)
            ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            per_doc = np.diff(batch.column(2).offsets.to_numpy())
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            doc = np.repeat(np.arange(len(y)), per_doc)
            z = bias + np.bincount(sentence, weights=weights[ids], minlength=len(sizes))
            clear = np.bincount(doc, weights=_softplus(z), minlength=len(y))
            toxic = -np.expm1(-clear)
            pull = np.where(y > 0, -np.exp(-clear) / np.maximum(toxic, 1e-12), 1.0)
            pull[per_doc == 0] = 0.0
            slope = pull[doc] / (1 + np.exp(-z))
            total[:-2] += np.bincount(ids, weights=slope[sentence], minlength=len(weights))
            total[-2] += slope.sum()
            total[-1] += np.where(y > 0, -np.log(np.maximum(toxic, 1e-12)), clear).sum()
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def train(docs, labels, max_train=MAX_TRAIN, max_features=MAX_FEATURES, steps=40, penalty=1e-3):
    """A ``Model`` from document labels.

    Adam steps on the noisy-or likelihood with a squared penalty on weights.
    Without labels of both classes the model scores every text as harmless.
    """
    spark = docs.sparkSession
    rows = scratch.materialise(training_rows(docs, labels, max_train), "toxic-rows")
    chosen = candidate_words(rows, max_features)
    if not chosen:
        return Model({}, -20.0)
    known = spark.sparkContext.broadcast({word: i for i, (word, _, _) in enumerate(chosen)})
    bags = rows.repartition(PARTS).mapInArrow(_bags(known), "y int, ids array<int>, sizes array<int>")
    bags = scratch.materialise(bags, "toxic-bags")
    n = bags.count()
    weights = np.array([odds / 2 if odds > 1 else 0.0 for _, odds, _ in chosen])
    point, m, v = np.r_[weights, -6.0], 0.0, 0.0
    rate = 0.3
    for step in range(1, steps + 1):
        parts = bags.mapInArrow(_gradient(point[:-1], point[-1]), "sums binary").collect()
        slope = sum(np.frombuffer(p["sums"]) for p in parts)[:-1] / n
        slope[:-1] += penalty * point[:-1] / 10
        m, v = 0.8 * m + 0.2 * slope, 0.95 * v + 0.05 * slope**2
        point = point - rate * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-4)
        rate *= 0.97
    return Model({w: float(x) for (w, _, _), x in zip(chosen, point)}, float(point[-1]))


def _sentence_scores(data, known, weights, bias):
    """Logits of the sentences of a text that have words."""
    for match in SENTENCE.finditer(data):
        found = terms(match[0])
        if found:
            hit = known.of(found)
            yield match, bias + sum(weights[i] for i in hit) if hit else bias


def score(rows, model, data="data"):
    """``rows`` with the binary column ``data`` replaced by ``score`` in 0 to 1.

    A text without words scores 0.
    """
    bias, names = model.bias, list(model.weights)
    weights = [model.weights[w] for w in names]
    sent = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})
    kept = [c for c in rows.columns if c != data]

    def run(batches):
        known = Known(sent.value)
        for batch in batches:
            scores = []
            for text in batch.column(len(kept)).to_pylist():
                logits = np.array([z for _, z in _sentence_scores(text or b"", known, weights, bias)])
                scores.append(float(-np.expm1(-_softplus(logits).sum())))
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    schema = StructType([*rows.select(*kept).schema.fields, StructField("score", DoubleType())])
    return rows.select(*kept, data).mapInArrow(run, schema)


def locate(docs, model, threshold=THRESHOLD):
    """(doc_id, sentence, start, end, score, text) of offending sentences; byte offsets.

    ``sentence`` counts the sentences of a document that have words.
    """
    bias, names = model.bias, list(model.weights)
    weights = [model.weights[w] for w in names]
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})
    fields = [
        ("doc_id", pa.int64()), ("sentence", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
        ("score", pa.float64()), ("text", pa.string()),
    ]

    def run(batches):
        known = Known(sent.value)
        for batch in batches:
            out = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (m, z) in enumerate(_sentence_scores(data, known, weights, bias)):
                    p = float(1 / (1 + np.exp(-z)))
                    if p >= threshold:
                        text = m[0].decode(errors="replace")
                        out.append(dict(zip((f for f, _ in fields), (doc, i, m.start(), m.end(), p, text))))
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    ready = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary"))
    return ready.mapInArrow(run, "doc_id long, sentence long, start long, end long, score double, text string")


def classify(docs, labels, threshold=THRESHOLD, **options):
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Ids are read only to split off the held-out quarter and to find labels;
    source, language and labels are no inputs of a score. Null and empty texts
    score 0; repeated rows score alike; a null id is not held out.
    """
    model = train(docs, labels, **options)
    scored = score(docs.select("doc_id", F.col("text").cast("binary").alias("data")), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean(docs, labels, threshold=THRESHOLD, **options):
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = train(docs, labels, **options)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("binary").alias("data"))
    scored = score(rows, model)
    return scored.filter(F.col("score") < threshold).select("_row.*")
