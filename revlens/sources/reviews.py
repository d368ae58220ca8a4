"""Reading review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.times import parse_timestamp
from revlens.schema import RAW_COLUMNS, TIMESTAMP_FORMAT


def drop_index_column(df: DataFrame) -> DataFrame:
    """Remove the unnamed leading column a dump with row numbers carries."""
    unnamed = [c for c in df.columns if c in ("", "_c0") or c.startswith("Unnamed:")]
    return df.drop(*unnamed)


def with_known_types(df: DataFrame, ts_format: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Rename and type the known raw columns, pass all others through.

    A value that does not fit its type becomes null instead of failing the job.
    """
    known = {raw: spec for raw, spec in RAW_COLUMNS.items() if raw in df.columns}
    columns = []
    for name in df.columns:
        if name not in known:
            columns.append(F.col(f"`{name}`"))
            continue
        alias, kind = known[name]
        raw = F.col(f"`{name}`")
        if kind != "timestamp_ntz":
            value = raw.try_cast("double").cast("int") if kind == "int" else raw.cast(kind)
        elif df.schema[name].dataType.typeName() == "string":
            value = parse_timestamp(raw, ts_format)
        else:
            value = raw.cast(kind)
        columns.append(value.alias(alias))
    return df.select(*columns)


def parse_timestamps(
    df: DataFrame, columns: tuple[str, ...] = ("review_ts", "replied_at"), ts_format: str = TIMESTAMP_FORMAT
) -> DataFrame:
    return df.withColumns({c: parse_timestamp(F.col(c), ts_format) for c in columns})


def read_reviews(
    spark: SparkSession, path: str, fmt: str = "csv", ts_format: str = TIMESTAMP_FORMAT
) -> DataFrame:
    """Review table from CSV (quoted, multi-line text allowed) or a columnar format.

    A multi-line CSV file cannot be split, so one file is one task: keep files to a
    few hundred MB, or convert once to Parquet, which every later job then prunes.
    """
    if fmt == "csv":
        raw = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("mode", "PERMISSIVE")
            .csv(path)
        )
    else:
        raw = spark.read.format(fmt).load(path)
    return with_known_types(drop_index_column(raw), ts_format)


def reviews_view(documents: DataFrame) -> DataFrame:
    """Review table over a (doc_id, text, lang, source, n_chars) document table.

    Ratings, times, versions and replies follow from the id by arithmetic.
    """
    i = F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    replied = i % 3 == 0
    return (
        documents.withColumn("review_ts", F.timestamp_add("HOUR", i * 17 % 17520, start))
        .select(
            "doc_id",
            i.cast("string").alias("review_id"),
            F.col("text").alias("content"),
            (1 + (i * 7 + F.col("n_chars")) % 5).cast("int").alias("score"),
            "review_ts",
            F.when(i % 11 == 0, F.lit(None).cast("string"))
            .when(i % 13 == 0, "beta")
            .otherwise(F.concat((1 + i % 4).cast("string"), F.lit("."), F.substring("source", 4, 100)))
            .alias("app_version"),
            F.when(replied, "Thanks").alias("reply_content"),
            F.when(replied, F.timestamp_add("HOUR", i % 61 * 26 - 24, F.col("review_ts"))).alias("replied_at"),
            "lang",
            "source",
        )
    )
