"""Does mentioning a topic go with higher or lower ratings?

One scan gathers, for all topics at once, count, mean and variance of the ratings with
and without the topic's keywords; everything after that works on two rows per topic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from revlens.functions.keywords import matched_categories
from revlens.functions.labels import effect_size_band, impact_label, neg_log10, rating_band

Topics = Mapping[int, Sequence[str]]
ALPHA = 0.05


def _label(keywords: Sequence[str], n: int = 5) -> str:
    return ", ".join(list(keywords)[:n])


def topics_from_frame(frame: DataFrame) -> dict[int, list[str]]:
    """Read a (topic_id, keywords) table; topics travel with the plan, as the caller's list does."""
    rows = frame.select("topic_id", "keywords").collect()
    return {r.topic_id: list(r.keywords) for r in sorted(rows, key=lambda r: r.topic_id)}


def _named(topics: Topics) -> dict[str, Sequence[str]]:
    return {str(topic): words for topic, words in topics.items()}


def topic_moments(df: DataFrame, topics: Topics, text: str = "content_clean", score: str = "score") -> DataFrame:
    """Rows, ratings, mean and variance with and without each topic's keywords.

    The text of a row is searched once; the row then counts once for every topic, on the one
    side or the other, and map-side moments leave two rows per topic and task. The engine's
    variance works with deviations from the mean, so ratings far from zero lose nothing.
    """
    hits = matched_categories(F.col(text), _named(topics)).alias("hits")
    rows = df.select(F.col(score).cast("double").alias("y"), hits)
    sides = F.transform(
        F.sequence(F.lit(0), F.lit(len(topics) - 1)),
        lambda i: F.struct(i.alias("i"), F.array_contains("hits", i).alias("hit")),
    )
    sided = rows.select("y", F.explode(sides).alias("s")).select("y", "s.i", "s.hit")
    moments = sided.groupBy("i", "hit").agg(
        F.count(F.lit(1)).alias("rows"), F.count("y").alias("n"), F.avg("y").alias("avg"), F.var_samp("y").alias("var")
    )
    by_topic = moments.groupBy("i").agg(
        *[
            F.max(F.when(F.col("hit") == (side == "with"), F.col(name))).alias(f"{side}_{name}")
            for side in ("with", "without")
            for name in ("rows", "n", "avg", "var")
        ]
    )
    topic_rows = [(i, int(t), _label(words)) for i, (t, words) in enumerate(topics.items())]
    listed = df.sparkSession.createDataFrame(topic_rows, "i int, topic_id int, keywords string")
    counts = [f"{side}_{name}" for side in ("with", "without") for name in ("rows", "n")]
    return listed.join(by_topic, "i", "left").na.fill(0, counts).drop("i")


def keyword_presence(df: DataFrame, topics: Topics, text: str = "content_clean", score: str = "score") -> DataFrame:
    """Mean rating and count with and without any of a topic's keywords."""
    m = topic_moments(df, topics, text, score)
    return m.select(
        "topic_id",
        "keywords",
        F.col("with_avg").alias("with_keywords_avg"),
        F.col("with_rows").alias("with_keywords_count"),
        F.col("without_avg").alias("without_keywords_avg"),
        F.col("without_rows").alias("without_keywords_count"),
        (F.col("with_avg") - F.col("without_avg")).alias("rating_difference"),
    )


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Lanczos approximation for positive arguments."""
    # Published coefficients for g = 7, nine terms.
    g = 7.0
    terms = [
        0.99999999999980993, 676.5203681218851, -1259.1392167224028,
        771.32342877765313, -176.61502916214059, 12.507343278686905,
        -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
    ]
    z = x - 1.0
    series = terms[0] + sum(c / (z + i) for i, c in enumerate(terms[1:], start=1))
    t = z + g + 0.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(series)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's rule."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    safe = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(safe) + q * np.log1p(-safe))
    value = np.where(y <= 0, 0.0, front * _beta_fraction(p, q, safe) / p)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; used on one row per topic."""
    tv, nu = t.to_numpy(float), dof.to_numpy(float)
    ok = np.isfinite(tv) & np.isfinite(nu) & (nu > 0)
    p = np.full(len(tv), np.nan)
    if ok.any():
        p[ok] = incomplete_beta(nu[ok] / 2, np.full(ok.sum(), 0.5), nu[ok] / (nu[ok] + tv[ok] ** 2))
    return pd.Series(p).where(ok, None)


def _cohens_d(m1: Column, m0: Column, v1: Column, v0: Column, n1: Column, n0: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
    return F.when(pooled > 0, (m1 - m0) / pooled).otherwise(0.0)


def topic_statistics(df: DataFrame, topics: Topics, text: str = "content_clean", score: str = "score") -> DataFrame:
    """Welch's t, its degrees of freedom and Cohen's d per topic, without p-values.

    A topic needs more than one rating on both sides. Where both sides are constant,
    t is not defined and stays null.
    """
    m = topic_moments(df, topics, text, score).where((F.col("with_n") > 1) & (F.col("without_n") > 1))
    n1, n0 = F.col("with_n").cast("double"), F.col("without_n").cast("double")
    m1, m0, v1, v0 = F.col("with_avg"), F.col("without_avg"), F.col("with_var"), F.col("without_var")
    e1, e0 = v1 / n1, v0 / n0
    return m.select(
        "topic_id",
        "keywords",
        m1.alias("topic_avg"),
        m0.alias("other_avg"),
        F.col("with_n").alias("topic_n"),
        F.col("without_n").alias("other_n"),
        F.try_divide(m1 - m0, F.sqrt(e1 + e0)).alias("t_statistic"),
        F.try_divide((e1 + e0) * (e1 + e0), e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)).alias("dof"),
        _cohens_d(m1, m0, v1, v0, n1, n0).alias("cohens_d"),
    )


def topic_ttest(
    df: DataFrame, topics: Topics, text: str = "content_clean", score: str = "score", alpha: float = ALPHA
) -> DataFrame:
    """Test result per topic with p-value, significance and direction."""
    tested = topic_statistics(df, topics, text, score).withColumn(
        "p_value", t_two_sided(F.col("t_statistic"), F.col("dof"))
    )
    return tested.withColumns(
        {
            "is_significant": F.coalesce(F.col("p_value") < alpha, F.lit(False)),
            "impact": impact_label(F.col("p_value"), F.col("topic_avg"), F.col("other_avg"), alpha),
        }
    )


def impact_summary(tests: DataFrame) -> DataFrame:
    """Significant topics by strength of effect, with band and difference in stars."""
    return (
        tests.where("is_significant")
        .withColumn("effect_band", effect_size_band(F.col("cohens_d")))
        .withColumn("star_difference", F.col("topic_avg") - F.col("other_avg"))
        .orderBy(F.abs("cohens_d").desc(), "topic_id")
    )


def not_significant(tests: DataFrame) -> DataFrame:
    return tests.where(~F.col("is_significant"))


def impact_chart_frames(tests: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """The four sorted tables a chart of the tests draws."""
    by_mean = tests.select("topic_id", "topic_avg", rating_band(F.col("topic_avg")).alias("band"))
    by_p = tests.select(
        "topic_id",
        "p_value",
        neg_log10(F.col("p_value")).alias("neg_log10_p"),
        F.lit(float(-np.log10(alpha))).alias("threshold"),
        (F.col("p_value") < alpha).alias("significant"),
    )
    by_d = tests.select("topic_id", "cohens_d", (F.col("cohens_d") < 0).alias("lower"))
    return {
        "by_mean": by_mean.orderBy("topic_avg", "topic_id"),
        "by_p": by_p.orderBy("p_value", "topic_id"),
        "by_d": by_d.orderBy("cohens_d", "topic_id"),
        "group_sizes": tests.select("topic_id", "topic_n", "other_n").orderBy("topic_id"),
    }
