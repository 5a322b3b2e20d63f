"""A corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage works on what the one before kept. All but the last return the
columns of ``documents``; the last returns how much of each document the mix
takes.
"""

from pyspark.sql import functions as F

from flowloom.llm import decontaminate, jaccard, lines, mixing, toxicity
from flowloom.llm.text import table
from flowloom.sources import scratch


def toxicity_stage(spark, docs, sf_dir):
    """Documents that do not score as toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark, docs, sf_dir):
    """Documents without the lines an earlier one holds; ``n_chars`` follows the text.

    A document that had words and keeps none repeats others as a whole, and goes;
    one that was empty before stays.
    """
    done = lines.dedup(docs, drop_emptied=True)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark, docs, sf_dir):
    """The first document of each group of near duplicates."""
    return jaccard.keep_first(docs)


def decontaminate_stage(spark, docs, sf_dir):
    """Documents that do not repeat the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """How much of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The trained scores of the first stage are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
