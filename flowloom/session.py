"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession


def partitions_for_bytes(size, per_partition=128 * 1024 * 1024):
    """Shuffle partitions for an input of ``size`` bytes: 200 to 100,000."""
    return max(200, min(100_000, -(-size // per_partition)))


def session(app="flowloom", master=None, shuffle_partitions=None, extra=None):
    """A session with adaptive execution, skew handling and UTC time.

    On a cluster leave ``master`` to spark-submit and give a generous
    ``shuffle_partitions`` (see ``partitions_for_bytes``); the adaptive planner
    merges the small ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (extra or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
