"""Rating, sentiment, time, version and reply reports.

Every report is one aggregation with map-side partial sums, so a value that most rows
share does not overload a task. Class columns come from a fixed list: no extra pass to
find the distinct labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.labels import rating_band
from revlens.functions.times import month_key
from revlens.functions.wordlists import FREQUENCY_STOPWORDS
from revlens.operators.filters import having_min_reviews, last_year, response_outliers
from revlens.operators.joins import calendar_reindex, top_value_rows, top_values
from revlens.operators.quantiles import exact_quantiles
from revlens.schema import NEGATIVE, SENTIMENTS


def _n() -> Column:
    return F.count(F.lit(1))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency of each value, nulls left out; ``top`` keeps the most frequent."""
    if top is not None:
        return top_values(df, column, top)
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(_n().alias("n"))


def class_counts(
    df: DataFrame, by: str, label: str = "sentiment_label", classes: Sequence[str] = SENTIMENTS
) -> DataFrame:
    """Rows per key and class, one column per class, zeros filled."""
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes])
    )


def class_shares(
    df: DataFrame, by: str, label: str = "sentiment_label", classes: Sequence[str] = SENTIMENTS
) -> DataFrame:
    """Class percentages per key; every row adds up to 100."""
    counts = class_counts(df, by, label, classes)
    total = sum((F.col(c) for c in classes), F.lit(0))
    return counts.where(total > 0).select(
        by, *[(F.col(c) * 100.0 / total).alias(c) for c in classes]
    )


def _by_month(df: DataFrame, ts: str = "review_ts") -> DataFrame:
    return df.withColumn("month", month_key(F.col(ts))).where(F.col("month").isNotNull())


def monthly_volume(df: DataFrame) -> DataFrame:
    return _by_month(df).groupBy("month").agg(_n().alias("reviews"))


def peak_months(df: DataFrame) -> DataFrame:
    """Months with the most and the fewest reviews, the earliest on ties."""
    most = F.min(F.struct((-F.col("reviews")).alias("x"), "month", "reviews")).alias("most")
    least = F.min(F.struct("reviews", "month")).alias("least")
    return monthly_volume(df).agg(most, least).select(
        F.col("most.month").alias("peak_month"),
        F.col("most.reviews").alias("peak_reviews"),
        F.col("least.month").alias("lowest_month"),
        F.col("least.reviews").alias("lowest_reviews"),
    )


def monthly_avg_rating(df: DataFrame) -> DataFrame:
    return _by_month(df).groupBy("month").agg(F.avg("score").alias("avg_rating"))


def monthly_sentiment(df: DataFrame) -> DataFrame:
    return class_counts(_by_month(df), "month")


def monthly_sentiment_pct(df: DataFrame) -> DataFrame:
    return class_shares(_by_month(df), "month")


def recent_sentiment(df: DataFrame, months: int = 6) -> DataFrame:
    return monthly_sentiment(df).orderBy(F.desc("month")).limit(months)


def daily_volume(df: DataFrame) -> DataFrame:
    return value_counts(df, "review_date")


def daily_sentiment(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("review_date").isNotNull())
        .groupBy("review_date", "sentiment_label")
        .agg(_n().alias("n"))
    )


def weekday_sentiment(df: DataFrame) -> DataFrame:
    return calendar_reindex(class_counts(df, "day_of_week"))


def score_by_sentiment(df: DataFrame) -> DataFrame:
    return df.groupBy("sentiment_label", "score").agg(_n().alias("n"))


def rating_summary(df: DataFrame) -> DataFrame:
    """Headline numbers in one pass. Ratings have five values, so their median is cheap."""
    words, kept = F.avg("word_count"), F.avg("word_count_nostop")
    return df.agg(
        _n().alias("reviews"),
        F.avg("score").alias("mean_score"),
        F.median("score").alias("median_score"),
        F.try_divide(F.count_if(F.col("sentiment_label") == NEGATIVE) * 100.0, _n()).alias("negative_pct"),
        F.try_divide(F.sum("has_reply") * 100.0, _n()).alias("response_pct"),
        F.avg("response_time_hours").alias("mean_response_hours"),
        (F.avg("response_time_hours") / 24).alias("mean_response_days"),
        words.alias("mean_words"),
        kept.alias("mean_words_nostop"),
        F.avg("review_length").alias("mean_chars"),
        F.try_divide((words - kept) * 100, words).alias("stopword_reduction_pct"),
    )


def group_rating_stats(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Rating statistics per group, rounded to three digits."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.round(F.avg(score), 3).alias("mean_rating"),
            F.round(F.median(score), 3).alias("median_rating"),
            F.round(F.stddev_samp(score), 3).alias("std_dev"),
            F.count(score).alias("review_count"),
            F.min(score).alias("min_rating"),
            F.max(score).alias("max_rating"),
        )
    )


def best_worst_group(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Groups with the highest and lowest mean rating, the first key on ties."""
    stats = group_rating_stats(df, group, score).select(F.col(group).alias("g"), F.col("mean_rating").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("x"), "g")).alias("best")
    worst = F.min(F.struct("m", "g")).alias("worst")
    overall = df.select(F.avg(score).alias("m")).scalar()
    return stats.agg(best, worst).select(
        F.col("best.g").alias("best_group"),
        (-F.col("best.x")).alias("best_rating"),
        F.col("worst.g").alias("worst_group"),
        F.col("worst.m").alias("worst_rating"),
        (-F.col("best.x") - F.col("worst.m")).alias("rating_gap"),
        overall.alias("overall_rating"),
    )


def topic_share(df: DataFrame, topic: str = "dominant_topic") -> DataFrame:
    """Reviews and percentage per topic. The total is summed over the few group rows."""
    counts = value_counts(df, topic)
    total = counts.select(F.sum("n").alias("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def version_ratings(df: DataFrame, min_reviews: int = 10) -> DataFrame:
    """Last year's mean rating per app version with enough reviews."""
    grouped = (
        last_year(df)
        .where(F.col("app_version").isNotNull())
        .groupBy("app_version")
        .agg(F.avg("score").alias("avg_rating"), F.count("review_id").alias("review_count"))
    )
    return having_min_reviews(grouped, min_reviews).withColumn("band", rating_band(F.col("avg_rating")))


def version_sentiment(df: DataFrame, top: int | None = None) -> DataFrame:
    """Class percentages by major version, for all versions or the most reviewed."""
    rows = df if top is None else top_value_rows(df, "major_version", top)
    return class_shares(rows, "major_version")


def recent_version_sentiment(df: DataFrame, top: int = 8) -> DataFrame:
    return class_shares(top_value_rows(last_year(df), "app_version", top), "app_version")


def top_version_ratings(df: DataFrame, top: int = 8) -> DataFrame:
    return (
        top_value_rows(df, "major_version", top)
        .groupBy("major_version")
        .agg(F.avg("score").alias("avg_rating"))
        .withColumn("band", rating_band(F.col("avg_rating")))
    )


def negative_by_version(df: DataFrame, label: str, top: int = 8) -> DataFrame:
    """Major versions with the most Negative predictions."""
    return (
        df.groupBy("major_version")
        .agg(F.count_if(F.col(label) == NEGATIVE).alias("negative_reviews"))
        .orderBy(F.desc("negative_reviews"), "major_version")
        .limit(top)
    )


def response_impact(df: DataFrame) -> DataFrame:
    return df.groupBy("has_reply").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))


def monthly_response_rate(df: DataFrame) -> DataFrame:
    return _by_month(df).groupBy("month").agg((F.avg("has_reply") * 100).alias("response_pct"))


def sentiment_by_response(df: DataFrame) -> DataFrame:
    return class_shares(df, "has_reply")


def response_time_stats(df: DataFrame) -> DataFrame:
    days = response_outliers(df)
    median = exact_quantiles(days, ["response_days"], [0.5]).select("q0").scalar()
    return days.agg(
        F.count("response_days").alias("n"),
        F.avg("response_days").alias("mean_days"),
        F.min("response_days").alias("min_days"),
        F.max("response_days").alias("max_days"),
    ).withColumn("median_days", median)


def response_time_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed.

    Empty bins are kept. If all values are equal, the range is one day around them.
    """
    days = response_outliers(df).select("response_days")
    ends = days.agg(F.min("response_days").alias("a"), F.max("response_days").alias("b"))
    pad = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    low = ends.select(F.col("a") - pad).scalar()
    high = ends.select(F.col("b") + pad).scalar()
    width = (high - low) / bins
    number = F.least(F.floor((F.col("response_days") - low) / width) + 1, F.lit(bins))
    counted = days.groupBy(number.cast("int").alias("bin")).agg(_n().alias("n"))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").select(
        "bin",
        (low + width * (F.col("bin") - 1)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def word_frequencies(
    df: DataFrame,
    text: str = "content_clean_nostop",
    label: str = "sentiment_label",
    top: int = 100,
    stopwords: Sequence[str] = FREQUENCY_STOPWORDS,
    merge_plurals: bool = True,
) -> DataFrame:
    """Most frequent words per class with their weight relative to the class maximum.

    Words are runs of two or more word characters; plain numbers are left out, and a
    plural in -s is counted with its singular where the class has both. Counting comes
    first, so the ranking sees one row per word and class, of which each task passes
    on at most ``top`` per class.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\w[\w']+"), 0)
    listed = list(stopwords)
    counts = (
        df.select(F.col(label).alias("label"), F.explode_outer(words).alias("word"))
        .where(F.col("word").isNotNull())
        # only words below ":" start with a digit and need the pattern
        .where(~F.col("word").isin(listed) & ((F.col("word") > ":") | ~F.col("word").rlike("^[0-9]+$")))
        .groupBy("label", "word")
        .agg(_n().alias("n"))
    )
    if merge_plurals:
        plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss")
        stem = F.when(plural, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
        counts = (
            counts.groupBy("label", stem.alias("stem"))
            .agg(F.min("word").alias("word"), F.sum("n").alias("n"))
            .drop("stem")
        )
    by_class = Window.partitionBy("label").orderBy(F.desc("n"), "word")
    ranked = counts.withColumn("rank", F.row_number().over(by_class)).where(F.col("rank") <= top)
    largest = F.max("n").over(Window.partitionBy("label"))
    return ranked.withColumn("weight", F.col("n") / largest).select(
        F.col("label").alias(label), "word", "n", "rank", "weight"
    )
