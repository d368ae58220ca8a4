"""Table profile: size, numeric summary, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from revlens.operators.quantiles import exact_quantiles


def table_shape(df: DataFrame) -> DataFrame:
    """Row count, column count, and the columns' names and types in one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {
            "n_columns": F.lit(len(df.columns)).cast("bigint"),
            "columns": F.lit(", ".join(df.columns)),
            "types": F.lit(", ".join(kind for _, kind in column_types(df))),
        }
    )


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def first_rows(df: DataFrame, key: str = "review_id", n: int = 3) -> DataFrame:
    """The ``n`` rows with the smallest keys, with their place: a table has no order of its own.

    Every task keeps its ``n`` smallest; nothing is sorted as a whole.
    """
    few = df.orderBy(key).limit(n)
    return few.withColumn("place", F.row_number().over(Window.orderBy(key)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    names = list(columns or numeric_columns(df))
    # not-a-number counts as missing, in the moments as in the quartiles
    doubles = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names])
    moments = (
        doubles.unpivot([], names, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = exact_quantiles(doubles, names, (0.25, 0.5, 0.75)).withColumnsRenamed(
        {"q0": "p25", "q1": "p50", "q2": "p75"}
    )
    return moments.join(quartiles, "column").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Null count and share per column, only for columns that have nulls."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
    )
    return (
        counted.unpivot(["__rows"], names, "column", "missing_count")
        .where(F.col("missing_count") > 0)
        .select(
            "column",
            "missing_count",
            (F.col("missing_count") * 100.0 / F.col("__rows")).alias("missing_pct"),
        )
    )
