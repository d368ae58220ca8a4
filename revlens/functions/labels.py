"""Labels, bands and codes derived from numbers or other labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.schema import NEGATIVE, NEUTRAL, POSITIVE


def sentiment_label(score: Column) -> Column:
    """Class of a star rating. A missing rating counts as Negative."""
    return F.when(score >= 4, POSITIVE).when(score == 3, NEUTRAL).otherwise(NEGATIVE)


def classify_compound(compound: Column) -> Column:
    return (
        F.when(compound >= 0.05, POSITIVE)
        .when(compound <= -0.05, NEGATIVE)
        .otherwise(NEUTRAL)
    )


def classify_polarity(polarity: Column) -> Column:
    return (
        F.when(polarity > 0.1, POSITIVE)
        .when(polarity < -0.1, NEGATIVE)
        .otherwise(NEUTRAL)
    )


def classify_ensemble(score: Column) -> Column:
    return F.when(score > 0.2, POSITIVE).when(score < -0.2, NEGATIVE).otherwise(NEUTRAL)


def normalize_label(label: Column) -> Column:
    """Model label in all lower or all upper case; anything else is Neutral."""
    known = {
        POSITIVE: ("positive", "POSITIVE"),
        NEGATIVE: ("negative", "NEGATIVE"),
    }
    out = None
    for name, spellings in known.items():
        hit = label.isin(*spellings)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(NEUTRAL)


def encode_label(label: Column) -> Column:
    """Class code for training, null for anything that is not a class."""
    return F.when(label == NEGATIVE, 0).when(label == NEUTRAL, 1).when(label == POSITIVE, 2)


def decode_label(code: Column) -> Column:
    return F.when(code == 0, NEGATIVE).when(code == 1, NEUTRAL).when(code == 2, POSITIVE)


def encode_polarity(label: Column) -> Column:
    """Signed vote of a label; missing and unknown labels vote 0."""
    return F.when(label == NEGATIVE, -1.0).when(label == POSITIVE, 1.0).otherwise(0.0)


def rating_band(rating: Column) -> Column:
    return F.when(rating < 3, "critical").when(rating < 4, "warning").otherwise("good")


def effect_size_band(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(size < 0.2, "negligible")
        .when(size < 0.5, "small")
        .when(size < 0.8, "medium")
        .otherwise("large")
    )


def impact_label(p_value: Column, topic_avg: Column, other_avg: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(F.coalesce(p_value, F.lit(1.0)) >= alpha, "NOT SIGNIFICANT")
        .when(topic_avg < other_avg, "NEGATIVE")
        .otherwise("POSITIVE")
    )


def neg_log10(p_value: Column) -> Column:
    return F.when(p_value > 0, -F.log10(p_value))


def major_version(version: Column) -> Column:
    digits = F.regexp_extract(version, r"^(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("v"), digits)).otherwise("Unknown")
