"""Writers for cleaned data, splits, metric tables and result documents."""

from pyspark.sql import functions as F


def write_table(df, path, fmt="parquet", partition_by=(), mode="overwrite"):
    """One folder per partition value; CSV with a header."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def feature_table(spark, names):
    """(pos, name) of the feature columns."""
    return spark.createDataFrame(list(enumerate(names)), "pos int, name string")


def result_document(metrics, meta=None, name="document"):
    """One JSON text per metrics row, with ``meta`` as a nested object."""
    entries = [F.struct(*metrics.columns).alias("metrics")]
    for section, values in (meta or {}).items():
        entries.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]).alias(section))
    return metrics.select(F.to_json(F.struct(*entries)).alias(name))


def save_model(model, path, metrics, meta):
    """Model, and next to it one row with its settings and metrics."""
    model.write().overwrite().save(f"{path}/model")
    result_document(metrics, meta).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark, path):
    """(model, metadata text)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), spark.read.text(f"{path}/meta").first()[0]
