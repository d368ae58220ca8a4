"""Writing result tables and models."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from revlens.session import shared_folder


def _writer(df: DataFrame, fmt: str, partition_by: tuple[str, ...]):
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a table, replacing what the folder held."""
    _writer(df, fmt, partition_by).mode("overwrite").save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Add rows to a table; in CSV every part file carries its own header."""
    _writer(df, fmt, partition_by).mode("append").save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def large_values(group_bytes: int) -> dict[str, str]:
    """Options to write rows of many bytes each: a writer looks at the size after every row, not after
    a hundred, and holds about ``group_bytes``; a reader as much."""
    sizes = {"parquet.block.size": group_bytes, "parquet.page.size": group_bytes}
    checks = {f"parquet.{unit}.size.row.check.{end}": 1 for unit in ("block", "page") for end in ("min", "max")}
    return {name: str(n) for name, n in {**sizes, **checks}.items()} | {"parquet.enable.dictionary": "false"}


def stored(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The table written to the folder all executors share, and read from there.

    For what several later jobs read: it survives lost executors and needs no release.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_model_results(
    path: str, models: Mapping[str, PipelineModel], metrics: DataFrame, predictions: DataFrame | None = None
) -> None:
    """Keep fitted models, their metrics and their predictions for later jobs."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{_folder(name)}")
    write_table(metrics, f"{path}/metrics")
    if predictions is not None:
        write_table(predictions, f"{path}/predictions")


def load_model_results(spark: SparkSession, path: str, names: tuple[str, ...] = ()):
    """Models by name and the metrics table, as saved above."""
    models = {name: PipelineModel.load(f"{path}/models/{_folder(name)}") for name in names}
    return models, read_table(spark, f"{path}/metrics")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/predictions")


def _folder(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name.lower())
