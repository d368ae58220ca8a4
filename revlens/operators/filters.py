"""Row filters and reproducible sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.schema import NEUTRAL, NO_PREDICTION, POSITIVE

OUTLIER_DAYS = 42
# Hexadecimal digits of the sample hash by which the rows of a class are told apart, step by
# step: 4096 parts of a class, then of one part, then of one part of that.
PREFIXES = (3, 6, 9)
# Classes whose cut points are sent to every task; more of them are joined by shuffle.
SENT_CLASSES = 100_000
SALTS = 64


def filter_sentiment(df: DataFrame, label: str, column: str = "sentiment_label") -> DataFrame:
    return df.where(F.col(column) == label)


def filter_rating(df: DataFrame, label: str, score: str = "score") -> DataFrame:
    """Rows of one class, told by plain comparisons that reach a Parquet scan.

    Same rows as a filter on the derived label, whose case distinction stays in Spark.
    """
    y = F.col(score)
    if label == POSITIVE:
        return df.where(y >= 4)
    if label == NEUTRAL:
        return df.where(y == 3)
    return df.where(y.isNull() | ((y < 4) & (y != 3)))


def has_text(df: DataFrame, column: str = "content_clean") -> DataFrame:
    return df.where(F.col(column) != "")


def is_prediction(label: Column) -> Column:
    return label.isNotNull() & ~label.isin(*NO_PREDICTION)


def valid_predictions(df: DataFrame, label: str) -> DataFrame:
    return df.where(is_prediction(F.col(label)))


def last_year(df: DataFrame, date: str = "review_date") -> DataFrame:
    """Rows of the year up to the latest date, its first day included."""
    start = df.select(F.add_months(F.max(date), -12).alias("start")).scalar()
    return df.where(F.col(date) >= start)


def response_outliers(df: DataFrame, max_days: float = OUTLIER_DAYS) -> DataFrame:
    """Answered reviews with the reply time in days, long delays left out."""
    return df.withColumn("response_days", F.col("response_time_hours") / 24).where(
        (F.col("has_reply") == 1) & (F.col("response_days") < max_days)
    )


def having_min_reviews(grouped: DataFrame, minimum: int = 10, count: str = "review_count") -> DataFrame:
    return grouped.where(F.col(count) >= minimum)


def sample_hash(key: str, seed: int = 42) -> Column:
    """Position of a row in a fixed random order; depends on its key and the seed only."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def hash_fold(key: str, folds: int, seed: int = 42) -> Column:
    return F.conv(F.substring(sample_hash(key, seed), 1, 8), 16, 10).cast("bigint") % folds


def _cut_points(df: DataFrame, key: str, seed: int, group: Column, quota: Callable[[Column], Column]):
    """Last key in hash order that still belongs to each group's quota: (g, cut).

    Counts per hash prefix find the part of a group in which its quota ends; the same again
    inside that part, and once more. Only the rows under the last prefix are ranked, some
    4096**3 times fewer than the group has, so neither a group nor a large part of it is ever
    ordered. Each step reads keys and groups only and leaves one row per group.
    """
    keys = df.select(group.alias("g"), sample_hash(key, seed).alias("h"), F.col(key).alias("k")).where("g IS NOT NULL")
    edge, under = None, keys
    for digits in PREFIXES:
        if edge is not None:
            under = under.join(edge, ["g", "prefix"]).drop("prefix")
        under = under.withColumn("prefix", F.substring("h", 1, digits))
        counts = under.groupBy("g", "prefix").agg(F.count(F.lit(1)).alias("n"), *([] if edge is None else [F.first("rest").alias("quota")]))
        if edge is None:
            counts = counts.withColumn("quota", quota(F.sum("n").over(Window.partitionBy("g"))))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("prefix"))
        edge = (
            counts.withColumn("upto", upto)
            .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
            .select("g", "prefix", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))
        )
        under = under.drop("rest")
    rank = F.row_number().over(Window.partitionBy("g").orderBy("h", "k"))
    return (
        under.join(edge, ["g", "prefix"])
        .withColumn("rank", rank)
        .where(F.col("rank") == F.col("rest"))
        .select("g", F.struct("h", "k").alias("cut"))
    )


def seeded_sample(df: DataFrame, n: int, key: str = "review_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones in every run.

    Expects unique keys. The rows are filtered where they stand; neither one task nor
    the driver ever holds the sample.
    """
    if n <= 0:
        return df.limit(0)
    cut = _cut_points(df, key, seed, F.lit(0), lambda total: F.least(total, F.lit(n)))
    position = F.struct(sample_hash(key, seed).alias("h"), F.col(key).alias("k"))
    return df.where(position <= cut.select("cut").scalar())


def stratified_split(
    df: DataFrame, label: str = "sentiment_label", key: str = "review_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train or test) with the same test share in every class.

    A class of c rows puts round(c * test_share) of them into the test part. Rows without a
    label are training rows.
    """
    cut = _cut_points(df, key, seed, F.col(label), lambda c: F.round(c * F.lit(test_share)).cast("bigint"))
    position = F.struct(sample_hash(key, seed).alias("h"), F.col(key).alias("k"))
    few = cut.limit(SENT_CLASSES + 1).collect()
    if len(few) <= SENT_CLASSES:
        # the table itself is neither shuffled nor sorted
        cuts = F.broadcast(df.sparkSession.createDataFrame(few, cut.schema))
        placed = df.join(cuts, F.col(label) == F.col("g"), "left")
    else:
        # a class with most of the rows is dealt out over SALTS keys
        salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = df.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        placed = dealt.join(salted, (F.col(label) == F.col("g")) & (F.col("__salt") == F.col("salt")), "left").drop("__salt", "salt")
    in_test = F.coalesce(position <= F.col("cut"), F.lit(False))
    return placed.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("g", "cut")


def stratified_folds(
    df: DataFrame, label: str = "sentiment_label", key: str = "review_id", folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` (0 to folds - 1); every class is spread evenly over the folds.

    Of a class of c rows the first round(c / folds) in hash order are fold 0, and so on. Rows
    without a label are in fold 0.
    """
    cuts = None
    for k in range(1, folds):
        # a bound that admits no row yet stays below every row
        found = _cut_points(df, key, seed, F.col(label), lambda c, k=k: F.round(c * F.lit(k / folds)).cast("bigint"))
        found = found.select("g", F.col("cut"))
        cuts = found if cuts is None else cuts.unionByName(found)
    if cuts is None:
        return df.withColumn("fold", F.lit(0))
    by_class = cuts.groupBy("g").agg(F.collect_list("cut").alias("cuts"), F.count(F.lit(1)).alias("cut_count"))
    few = by_class.limit(SENT_CLASSES + 1).collect()
    listed = F.broadcast(df.sparkSession.createDataFrame(few, by_class.schema)) if len(few) <= SENT_CLASSES else by_class
    position = F.struct(sample_hash(key, seed).alias("h"), F.col(key).alias("k"))
    placed = df.join(listed, F.col(label) == F.col("g"), "left")
    passed = F.size(F.filter("cuts", lambda cut: cut < position)) + (folds - 1 - F.col("cut_count"))
    return placed.withColumn("fold", F.coalesce(passed, F.lit(0)).cast("int")).drop("g", "cuts", "cut_count")


def hash_split(df: DataFrame, key: str = "review_id", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Split by a hash threshold alone: no shuffle, shares hold on average."""
    bucket = hash_fold(key, 10_000, seed)
    return df.withColumn("split", F.when(bucket < int(test_share * 10_000), "test").otherwise("train"))
