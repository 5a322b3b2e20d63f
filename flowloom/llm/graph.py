"""Connected components of a link table by alternating star steps."""

from pyspark.sql import functions as F

from flowloom.sources import scratch


def _mark(edges):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def _large(edges):
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_u")).agg(F.least(F.min("b"), F.first("a")).alias("_m"))
    return (
        both.filter("b > a").join(least, F.col("a") == F.col("_u"))
        .select(F.col("_m").alias("a"), F.col("b")).filter("a <> b").distinct()
    )


def _small(edges):
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    least = edges.groupBy(F.col("b").alias("_u")).agg(F.min("a").alias("_m"))
    moved = edges.join(least, F.col("b") == F.col("_u")).select(F.col("_m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("_m").alias("a"), F.col("_u").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def components(edges):
    """(node, component): the smallest node reachable from each node of an edge.

    ``edges`` has long columns a and b. Each step is written to the shared
    folder, so the plan stays short and a lost executor costs one step.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    current = scratch.materialise(ordered, "edges")
    mark = _mark(current)
    while True:
        current = scratch.materialise(_small(_large(current)), "edges")
        now = _mark(current)
        if now == mark:
            break
        mark = now
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
