"""Issue reports: which categories of a keyword table do reviews mention?

All categories are counted in one pass over the text. A row may count for several
categories. Each row gets the array of its hits, and the exploded hits are counted by value
before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.keywords import Taxonomy, matched_categories
from revlens.functions.text import snippet
from revlens.functions.wordlists import COMPACT_TAXONOMY, ISSUE_TAXONOMY
from revlens.operators.filters import filter_rating, filter_sentiment, last_year
from revlens.operators.joins import top_value_rows
from revlens.plans.enrich import text_column
from revlens.schema import NEGATIVE


def _negative(df: DataFrame) -> DataFrame:
    """Negative reviews, by the rating where there is one: that filter reaches the scan."""
    return filter_rating(df, NEGATIVE) if "score" in df.columns else filter_sentiment(df, NEGATIVE)


def taxonomy_match(df: DataFrame, taxonomy: Taxonomy, text: str | None = None, key: str = "review_id") -> DataFrame:
    """One row per review and category it mentions."""
    names = F.array(*[F.lit(name) for name in taxonomy])
    hits = df.select(key, matched_categories(F.col(text or text_column(df)), taxonomy).alias("hits"))
    # the outer form: a plain explode would put "is there any hit?" in front of the
    # scan and so read every text a second time
    return (
        hits.select(key, F.explode_outer("hits").alias("ordinal"))
        .where(F.col("ordinal").isNotNull())
        .select(key, "ordinal", F.element_at(names, F.col("ordinal") + 1).alias("category"))
    )


def category_mentions(
    df: DataFrame, taxonomy: Taxonomy, text: str, by: Sequence[str] = (), example: Column | None = None
) -> DataFrame:
    """Rows and mentions per category (and group), categories without hits included."""
    # position -1 stands for the row itself and so counts the group's size
    hits = F.concat(F.array(F.lit(-1)), matched_categories(F.col(text), taxonomy))
    extra = [] if example is None else [example.alias("example")]
    cell = [F.count(F.lit(1)).alias("n")] + ([] if example is None else [F.min("example").alias("e")])
    counted = (
        df.select(*by, *extra, F.explode(hits).alias("i"))
        .groupBy(*by, "i")
        .agg(*cell)
        .groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*[c for c in ("n", "e") if c == "n" or extra])))).alias("m"))
    )
    names = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("category")) for i, n in enumerate(taxonomy)])
    return counted.select(*by, "m", F.explode(names).alias("c")).select(
        *by,
        F.col("m")[F.lit(-1)]["n"].alias("total"),
        "c.ordinal",
        "c.category",
        F.coalesce(F.try_element_at("m", F.col("c.ordinal"))["n"], F.lit(0)).alias("mentions"),
        *([] if example is None else [F.try_element_at("m", F.col("c.ordinal"))["e"].alias("example")]),
    )


def issue_breakdown(
    df: DataFrame,
    taxonomy: Taxonomy = ISSUE_TAXONOMY,
    text: str | None = None,
    key: str = "review_id",
) -> DataFrame:
    """Mentions, share and an example per category among the negative reviews.

    The example is the hit with the smallest key. Only its excerpt travels.
    """
    negative = _negative(df)
    example = F.struct(F.col(key).alias("k"), snippet(F.col("content")).alias("text"))
    counted = category_mentions(negative, taxonomy, text or text_column(df), example=example)
    return counted.select(
        F.col("category").alias("issue"),
        "mentions",
        F.try_divide(F.col("mentions") * 100.0, F.col("total")).alias("percentage"),
        F.coalesce(F.col("example.text"), F.lit("N/A")).alias("example"),
        "ordinal",
    )


def issue_breakdown_compact(
    df: DataFrame, taxonomy: Taxonomy = COMPACT_TAXONOMY, text: str | None = None
) -> DataFrame:
    negative = _negative(df)
    counted = category_mentions(negative, taxonomy, text or text_column(df))
    return counted.select(
        F.col("category").alias("issue"),
        F.col("mentions").alias("count"),
        F.try_divide(F.col("mentions") * 100.0, F.col("total")).alias("percentage"),
        "ordinal",
    )


def version_issues(
    df: DataFrame, taxonomy: Taxonomy = ISSUE_TAXONOMY, text: str | None = None, top: int = 8
) -> DataFrame:
    """Last year, most reviewed versions, negative reviews: mentions per version and issue."""
    rows = _negative(top_value_rows(last_year(df), "app_version", top))
    counted = category_mentions(rows, taxonomy, text or text_column(df), by=["app_version"])
    return counted.select(
        F.col("app_version").alias("version"),
        F.col("category").alias("issue"),
        "ordinal",
        F.col("mentions").alias("count"),
        (F.col("mentions") * 100.0 / F.col("total")).alias("percentage"),
    )


def version_issue_matrix(issues: DataFrame, taxonomy: Taxonomy = ISSUE_TAXONOMY) -> DataFrame:
    """One row per version, one column per issue, percentages with one digit."""
    names = list(taxonomy)
    wide = issues.groupBy("version").pivot("issue", names).agg(F.first("percentage"))
    return wide.select(
        "version", *[F.round(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)), 1).alias(n) for n in names]
    )


def dominant_issue(issues: DataFrame) -> DataFrame:
    """Most frequent issue per version, the first category on ties."""
    order = Window.partitionBy("version").orderBy(F.desc("percentage"), "ordinal")
    return (
        issues.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == 1)
        .select("version", "issue", "percentage", "count")
    )
