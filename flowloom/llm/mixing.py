"""Mixing sources to target weights by a low-discrepancy schedule.

The mix has one slot per block of equal token count, so many for each source as
its target asks for, the last of them shorter. Slot ``k`` lies at the golden-ratio
point ``k * g mod slots``, where ``g`` is near ``slots / phi`` and has no factor in
common with ``slots``: every point is met once, and each prefix of the mix has the
target shares up to a few blocks. The cumulative block counts say which source a
point belongs to. The slots of a source are ranked, and rank ``r`` takes block
``r`` from the source's shuffled stream, which starts again when it ends.

A source may hold any share of the rows, there may be many sources, and a row may
be repeated any number of times: equal rows are counted before anything else,
totals over sources run in range partitions, totals inside a source over hash
buckets first and inside a bucket second, slots are ranked by chunk first, and the
block join has one slot per block.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.llm.text import narrow
from flowloom.operators.ordering import running_totals
from flowloom.sources import scratch

BLOCK_TOKENS = 64
MAX_PASSES = 3
BUCKET_ROWS = 50_000
COPIES = 4096
CHUNK = 65536
GRID = 4096
GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots are multiplied in two halves, so that 64 bits hold the products up to 2**43 slots.
HALF = 2**20


def n_tokens(text):
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources, weights=(1, 2, 3), max_passes=MAX_PASSES):
    """Token target of each source.

    ``sources`` has (source, source_size). Sources by code point, null last, are
    given ``weights`` in turn and share the sum of all sizes; a target stops at
    ``max_passes`` times the size and the excess goes to the others by weight.
    Sorted by cap per weight, the capped sources are a prefix, so one running
    sum finds the level at which the rest is shared.
    """
    by_name = F.col("source").asc_nulls_last()
    turn = (F.col("_one_upto") - 1) % len(weights)
    numbered = running_totals(sources.withColumn("_one", F.lit(1)), [by_name], ["_one"])
    weighed = numbered.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1).alias("_w"),
        (F.col("source_size") * max_passes).alias("_cap"),
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    summed = running_totals(weighed, ["_ratio", by_name], ["_cap", "_w"])
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    rest = F.lit(whole["size"] or 0) - (F.col("_cap_upto") - F.col("_cap"))
    level = rest / (F.lit(whole["w"] or 0) - (F.col("_w_upto") - F.col("_w")))
    found = summed.agg(F.max(F.when(level <= F.col("_ratio"), level))).first()[0]
    share = F.col("_w") * F.lit(found).cast("double")
    cap = F.col("_cap").cast("double")
    return weighed.select(
        "source",
        "source_size",
        F.coalesce(F.when(cap < share, cap).otherwise(share), F.lit(0.0)).alias("target"),
    )


def _largest_quotient(a, b):
    """The largest term of the continued fraction of a / b: small for even multiples."""
    largest = 0
    while a:
        largest = max(largest, b // a)
        a, b = b % a, a
    return largest


def multiplier(slots, reach=64):
    """The factor near ``slots / phi`` whose multiples modulo ``slots`` spread best."""
    middle = int(slots * GOLDEN)
    near = [g for g in range(max(1, middle - reach), middle + reach + 1) if math.gcd(g, slots) == 1]
    return min(near, key=lambda g: (_largest_quotient(g % slots, slots), abs(g - middle)))


def schedule(goal, block_tokens=BLOCK_TOKENS):
    """The mix as rows (slot, source, block, length): which block fills each slot.

    ``goal`` is the result of ``targets``. Null sources are a source. The lengths of
    a source add up to its target, rounded; only its last block may be shorter than
    ``block_tokens``.
    """
    spark = goal.sparkSession
    wanted = goal.select("source", F.round("target").cast("long").alias("_words")).filter("_words > 0")
    wanted = wanted.withColumn("_blocks", F.ceil(F.col("_words") / block_tokens).cast("long"))
    bounds = scratch.materialise(
        running_totals(wanted, [F.col("source").asc_nulls_last()], ["_blocks"]).select(
            "source", "_words", (F.col("_blocks_upto") - F.col("_blocks")).alias("_from"),
            F.col("_blocks_upto").alias("_to"),
        ),
        "mix-bounds",
    )
    n_sources, slots = bounds.agg(F.count(F.lit(1)), F.coalesce(F.max("_to"), F.lit(0))).first()
    grid = max(1, -(-slots // max(GRID, n_sources)))
    cells = bounds.withColumn(
        "_cell",
        F.explode(F.sequence(F.expr(f"_from div {grid}"), F.expr(f"(_to - 1) div {grid}"))),
    )
    step = multiplier(slots) if slots else 1
    modulus = max(slots, 1)
    high, low = F.expr(f"id div {HALF}") * (step * HALF % modulus), F.pmod("id", F.lit(HALF)) * step
    placed = (
        spark.range(slots)
        .select(
            F.col("id").alias("slot"),
            F.expr(f"id div {CHUNK}").alias("_chunk"),
            F.pmod(F.pmod(high, F.lit(modulus)) + F.pmod(low, F.lit(modulus)), F.lit(modulus)).alias("_point"),
        )
        .withColumn("_cell", F.expr(f"_point div {grid}"))
        .join(cells, "_cell")
        .filter("_point >= _from and _point < _to")
        .select("slot", "_chunk", "source", "_words")
    )
    inside = Window.partitionBy("source", "_chunk").orderBy("slot")
    ahead = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy("source", "_chunk").agg(F.count("*").alias("_n")).select(
        F.col("source").alias("_s"),
        F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_earlier"),
    )
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c"))
    block = (F.col("_earlier") + F.col("_rank")).cast("long")
    return ranked.join(earlier, same).select(
        "slot", "source", block.alias("block"),
        F.least(F.lit(block_tokens), F.col("_words") - block * block_tokens).cast("long").alias("length"),
    )


def streams(rows, seed=42):
    """Each document's token range [_start, _end) in its source's shuffled stream.

    ``rows`` has doc_id, source, size, _hash (of the text) and _copies, each row once.
    Copies lie one after the other and come back as a row each, numbered by ``_copy``.
    """
    buckets = max(64, rows.count() // BUCKET_ROWS)
    order = F.xxhash64(F.lit(seed), "doc_id", "_hash")
    keyed = rows.withColumn("_order", order).withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    keyed = keyed.withColumn("_words", F.col("size") * F.col("_copies"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source", "_bucket")
        .agg(F.sum("_words").alias("_n"))
        .select(
            F.col("source").alias("_s"),
            F.col("_bucket").alias("_b"),
            F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size", "_hash")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("_upto", F.sum("_words").over(upto))
    joined = placed.join(
        offsets, placed["source"].eqNullSafe(offsets["_s"]) & (placed["_bucket"] == offsets["_b"])
    )
    first = F.col("_offset") + F.col("_upto") - F.col("_words")
    parts = joined.select(
        "doc_id", "source", "size", "_hash", "_copies", first.alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES}"))).alias("_part"),
    )
    last = F.least(F.col("_copies"), (F.col("_part") + 1) * COPIES) - 1
    each = parts.repartition("doc_id", "_hash", "_part").withColumn(
        "_copy", F.explode(F.sequence(F.col("_part") * COPIES, last))
    )
    start = F.col("_first") + F.col("_copy") * F.col("size")
    return each.select(
        "doc_id", "source", "size", "_hash", "_copy", start.alias("_start"), (start + F.col("size")).alias("_end")
    )


def mix(docs, weights=(1, 2, 3), block_tokens=BLOCK_TOKENS, max_passes=MAX_PASSES, seed=42):
    """How much of every document the mix takes.

    Returns one row per row of ``docs``: doc_id, size (words; 0 for null and
    empty text), source, source_size, target (of its source), taken (words,
    repeats counted; at most ``max_passes`` times size). The taken words of a
    source add up to its target, rounded, however small it is. A null source is a
    source of its own and last; null ids and repeated rows are documents like
    others; an empty table gives an empty result. Other columns are ignored.
    The result depends only on ids, sources and texts, so reruns agree.
    """
    sized = narrow(docs, "doc_id", "source", n_tokens(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash"))
    rows = sized.groupBy("doc_id", "source", "size", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    rows = scratch.materialise(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"))
    goal = scratch.materialise(targets(scratch.materialise(sources, "mix-sources"), weights, max_passes), "mix-targets")
    known = streams(rows, seed).join(
        goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    passes = F.sequence(F.lit(0), F.lit(max_passes - 1))
    runs = known.withColumn("_pass", F.explode(passes)).select(
        "doc_id", "source", "size", "source_size", "target", "_hash", "_copy", "_pass",
        (F.col("_start") + F.col("_pass") * F.col("source_size")).alias("_lo"),
        (F.col("_end") + F.col("_pass") * F.col("source_size")).alias("_hi"),
    ).filter((F.col("_pass") == 0) | (F.col("_lo") < F.round("target")))
    block = F.sequence(
        F.expr(f"_lo div {block_tokens}"), F.expr(f"(greatest(_hi, _lo + 1) - 1) div {block_tokens}")
    )
    pieces = runs.withColumn("_block", F.explode(block))
    plan = schedule(goal, block_tokens).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "length")
    joined = pieces.join(
        plan, pieces["source"].eqNullSafe(plan["_s"]) & (pieces["_block"] == plan["_b"]), "left"
    )
    start = F.col("_block") * block_tokens
    part = F.least("_hi", start + F.coalesce("length", F.lit(0))) - F.greatest("_lo", start)
    took = F.greatest(part, F.lit(0))
    return (
        joined.groupBy("doc_id", "source", "size", "source_size", "target", "_hash", "_copy")
        .agg(F.sum(took).cast("long").alias("taken"))
        .select("doc_id", "size", "source", "source_size", "target", "taken")
    )
