"""Combining and comparing the labels of several sentiment methods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import classify_ensemble, encode_polarity
from revlens.operators.filters import is_prediction, valid_predictions
from revlens.operators.quantiles import exact_quantiles
from revlens.schema import NOT_AVAILABLE

# Vote of each method; model methods count more than lexicons.
METHOD_WEIGHTS = {"vader": 0.15, "textblob": 0.15, "roberta": 0.35, "bert": 0.35}


def available_methods(df: DataFrame, weights: Mapping[str, float] = METHOD_WEIGHTS) -> list[str]:
    return [m for m in weights if f"{m}_sentiment" in df.columns]


def ensemble_sentiment(df: DataFrame, weights: Mapping[str, float] = METHOD_WEIGHTS) -> DataFrame:
    """Weighted vote over the methods the table has, weights scaled to sum 1.

    One method alone is copied with score 0; without any the label says so.
    """
    methods = available_methods(df, weights)
    if not methods:
        return df.withColumns({"ensemble_score": F.lit(0.0), "ensemble_sentiment": F.lit(NOT_AVAILABLE)})
    if len(methods) == 1:
        only = F.col(f"{methods[0]}_sentiment")
        return df.withColumns({"ensemble_score": F.lit(0.0), "ensemble_sentiment": only})
    total = sum(weights[m] for m in methods)
    encoded = df.withColumns({f"{m}_encoded": encode_polarity(F.col(f"{m}_sentiment")) for m in methods})
    score = sum((F.col(f"{m}_encoded") * (weights[m] / total) for m in methods), F.lit(0.0))
    voted = encoded.withColumn("ensemble_score", score)
    return voted.withColumn("ensemble_sentiment", classify_ensemble(F.col("ensemble_score")))


def method_accuracy(df: DataFrame, methods: Sequence[str], actual: str = "sentiment_label") -> DataFrame:
    """Share of all rows on which a method agrees with the label, per method.

    ``valid_accuracy`` looks at the rows the method has a prediction for.
    """
    agrees = {m: F.coalesce(F.col(m) == F.col(actual), F.lit(False)).cast("double") for m in methods}
    cells = [
        F.struct(
            F.lit(m).alias("method"),
            F.avg(agrees[m]).alias("accuracy"),
            F.avg(F.when(is_prediction(F.col(m)), agrees[m])).alias("valid_accuracy"),
            F.count_if(is_prediction(F.col(m))).alias("predictions"),
        )
        for m in methods
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def method_distribution(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Label counts per method, nulls left out."""
    return (
        df.select(*methods)
        .unpivot([], list(methods), "method", "label")
        .where(F.col("label").isNotNull())
        .groupBy("method", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confidence_by_class(df: DataFrame, label: str, confidence: str) -> DataFrame:
    return valid_predictions(df, label).groupBy(label).agg(F.avg(confidence).alias("mean_confidence"))


def confidence_quartiles(df: DataFrame, label: str, confidence: str) -> DataFrame:
    """Minimum, quartiles and maximum of the confidence per predicted class."""
    valid = valid_predictions(df, label).select(label, F.col(confidence).alias("confidence"))
    return exact_quantiles(valid, ["confidence"], (0.0, 0.25, 0.5, 0.75, 1.0), by=[label]).select(
        label,
        F.col("q0").alias("min"),
        F.col("q1").alias("p25"),
        F.col("q2").alias("median"),
        F.col("q3").alias("p75"),
        F.col("q4").alias("max"),
    )
