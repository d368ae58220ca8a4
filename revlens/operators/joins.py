"""Joins and the size check in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.schema import NOT_PROCESSED, WEEKDAYS

SENT_BYTES = 16 * 1024 * 1024
SENT_ROWS = 200_000


def small_side(df: DataFrame, max_bytes: int = SENT_BYTES, max_rows: int = SENT_ROWS) -> DataFrame:
    """Send a word list whole if it is small, by rows and bytes.

    The list is worked out once: what was read for the check is what is sent. A larger one
    comes back without a hint; Spark then shuffles both sides and splits skewed partitions.
    """
    read = df.limit(max_rows + 1).toArrow()
    if read.num_rows > max_rows or read.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(read, df.schema))


def with_hits(
    df: DataFrame, items: Column, table: DataFrame, on: str, column: str, key: str = "review_id"
) -> DataFrame:
    """``df`` with an array of those rows of ``table`` whose ``on`` is among a row's ``items``.

    The row itself travels with its first item only: it is worked out once and shuffled once, and
    items without a match stay where they are. ``key`` has to be unique. Hits come in no order.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    listed = df.select(F.col(key).alias("__key"), row.alias("__row"), F.array_distinct(items).alias("__items"))
    parts = listed.select("__key", "__row", F.posexplode_outer("__items").alias("__at", on)).select(
        "__key", on, F.when(F.coalesce("__at", F.lit(0)) == 0, F.col("__row")).alias("__row")
    )
    hit = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    found = small_side(table.where(F.col(on).isNotNull()).select(on, hit.alias("__hit")))
    return (
        parts.join(found, on, "left")
        .where(F.col("__row").isNotNull() | F.col("__hit").isNotNull())
        .groupBy("__key")
        .agg(F.first("__row", ignorenulls=True).alias("__row"), F.collect_list("__hit").alias(column))
        .select("__row.*", column)
    )


def one_per_key(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, the smallest in column order; combined before the shuffle."""
    best = F.min(F.struct(*columns)).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "best.*")


def merge_predictions(
    df: DataFrame,
    predictions: DataFrame,
    key: str = "review_id",
    label: str = "roberta_sentiment",
    confidence: str = "roberta_confidence",
) -> DataFrame:
    """Left join of model labels; reviews without one are marked as not processed.

    The right side is reduced to one row per key first, so no review multiplies. A key
    that fills a large part of the left side is one skewed partition, which adaptive
    execution splits.
    """
    unique = one_per_key(predictions, key, [label, confidence])
    return df.join(unique, key, "left").withColumns(
        {
            label: F.coalesce(F.col(label), F.lit(NOT_PROCESSED)),
            confidence: F.coalesce(F.col(confidence), F.lit(0.0)),
        }
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; equal counts go by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def top_value_rows(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """Rows whose value is one of the ``n`` most frequent: at most n rows are broadcast."""
    return df.join(F.broadcast(top_values(df, column, n).select(column)), column, "left_semi")


def calendar_reindex(df: DataFrame, day: str = "day_of_week") -> DataFrame:
    """One row per weekday from Monday on; days without data keep null values."""
    spark = df.sparkSession
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    week = spark.range(7).select(
        (F.col("id") + 1).cast("int").alias("day_number"),
        F.element_at(names, (F.col("id") + 1).cast("int")).alias(day),
    )
    return week.join(df, day, "left")
