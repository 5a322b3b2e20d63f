"""Intermediate tables in the folder all executors share.

A result that later passes must read unchanged (range-partition bounds, loop
state) is written as Parquet and read back: that cuts the lineage, survives
the loss of executors and lets later passes prune columns.
"""

import contextlib
import math
import tempfile
import threading
import uuid

from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
PARTITION_BYTES = 256 * 1024 * 1024
MAX_PARTITIONS = 100_000
UNKNOWN_SIZE = 2**60

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local = threading.local()


def shared_dir(spark):
    """The folder named by the session; a temporary one only in local mode."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="flowloom-")
    spark.conf.set(SETTING, path)
    return path


def new_path(spark, tag="table"):
    path = f"{shared_dir(spark)}/flowloom/{tag}-{uuid.uuid4().hex}"
    for scope in getattr(_local, "scopes", [])[-1:]:
        scope.append(path)
    return path


def filesystem(spark, path):
    """(file system, path) of Hadoop for any path Spark can read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark, path):
    system, target = filesystem(spark, path)
    system.delete(target, True)


@contextlib.contextmanager
def temporary(spark):
    """Tables written inside the block are deleted when it ends.

    For loops and micro-batches, whose scratch would otherwise pile up; what
    must outlive the block is written to a path made before it.
    """
    scopes = _local.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            remove(spark, path)


@contextlib.contextmanager
def shuffles_removed(spark):
    """What a query inside shuffles is deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df, tag="table", path=None):
    """Write ``df`` once and return a scan of what was written."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df, max_rows=20_000):
    """``df`` as a broadcast table when it has at most ``max_rows`` rows.

    Beyond that the frame comes back as it was, so a join with it shuffles and
    leaves skew to the adaptive planner.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def partitions_for(df):
    """A partition number that keeps explicit repartitions at even, modest sizes.

    Taken from the size of the scanned files, never below the session's shuffle
    partitions; adaptive execution cannot resize a range partitioning itself.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < UNKNOWN_SIZE)
    return max(least, min(MAX_PARTITIONS, math.ceil(known / PARTITION_BYTES)))
