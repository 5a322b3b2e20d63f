"""Flows as JSON lines."""

from pyspark.sql import functions as F

PACKET = "flow_id LONG, features ARRAY<DOUBLE>, true_label INT"


def encode(df, flow_id, columns, label, extra=()):
    """One ``value`` text per flow: {flow_id, features, true_label, extra...}."""
    packet = F.struct(
        F.col(flow_id).cast("long").alias("flow_id"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("features"),
        F.col(label).cast("int").alias("true_label"),
        *[F.col(c) for c in extra],
    )
    return df.select(F.to_json(packet).alias("value"))


def decode(lines, extra=""):
    """Packet columns of ``value`` texts; (readable, unreadable) lines.

    ``extra`` names further fields as a DDL text.
    """
    schema = PACKET + (f", {extra}" if extra else "")
    parsed = lines.withColumn("_p", F.from_json("value", schema))
    good = F.col("_p.flow_id").isNotNull() & F.col("_p.features").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return parsed.filter(good).select("_p.*"), parsed.filter(~good).select("value")
