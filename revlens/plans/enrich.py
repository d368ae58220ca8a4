"""Derived review columns, all of them narrow projections: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import labels, text, times


def temporal_features(df: DataFrame, ts: str = "review_ts") -> DataFrame:
    at = F.col(ts)
    return df.withColumns(
        {
            "year": F.year(at),
            "month": F.month(at),
            "quarter": F.quarter(at),
            "day_of_week": times.day_name(at),
            "review_date": F.to_date(at),
        }
    )


def presence_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "has_reply": F.col("reply_content").isNotNull().cast("int"),
            "has_version": F.col("app_version").isNotNull().cast("int"),
        }
    )


def response_time(df: DataFrame) -> DataFrame:
    hours = times.response_hours(F.col("review_ts"), F.col("replied_at"))
    return df.withColumn("response_time_hours", hours)


def clean_columns(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("content_clean", text.clean_text(F.col(content)))


def nostop_columns(df: DataFrame) -> DataFrame:
    """Add the token list without stopwords and its text form."""
    tokens = text.drop_stopwords(text.word_tokens(F.col("content_clean")))
    return df.withColumn("tokens_nostop", tokens).withColumn(
        "content_clean_nostop", text.join_tokens(F.col("tokens_nostop"))
    )


def lemma_column(df: DataFrame) -> DataFrame:
    lemmas = F.transform("tokens_nostop", text.singular)
    return df.withColumn("content_lemmatized", text.join_tokens(lemmas))


def text_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "review_length": F.length("content_clean"),
            "word_count": text.word_count(F.col("content_clean")),
            "word_count_nostop": F.size("tokens_nostop"),
        }
    )


def label_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "major_version": labels.major_version(F.col("app_version")),
            "sentiment_label": labels.sentiment_label(F.col("score")),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    """All derived columns. The text is cleaned and tokenised once per row.

    Reports read few of these columns, and Spark drops the rest from their plans;
    a job that runs many reports should write this table once as Parquet.
    """
    out = presence_flags(temporal_features(df))
    out = label_columns(response_time(out))
    out = lemma_column(nostop_columns(clean_columns(out)))
    return text_metrics(out).drop("tokens_nostop")


def text_column(df: DataFrame) -> str:
    """The text without stopwords where the table has it, else the cleaned text."""
    return "content_clean_nostop" if "content_clean_nostop" in df.columns else "content_clean"


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
