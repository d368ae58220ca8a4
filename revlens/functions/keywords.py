"""Keyword matching: substrings by default, whole tokens on request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Taxonomy = Mapping[str, Sequence[str]]


def taxonomy_from_frame(frame: DataFrame) -> dict[str, list[str]]:
    """Read a (category, ordinal, keywords) table; it travels with the plan, as a dictionary does."""
    rows = frame.select("category", "ordinal", "keywords").collect()
    return {r.category: list(r.keywords) for r in sorted(rows, key=lambda r: r.ordinal)}


def _needed(keywords: Sequence[str]) -> list[str]:
    """Keywords without those that contain another one: the shorter one hits first."""
    distinct = list(dict.fromkeys(k.lower() for k in keywords))
    return [k for k in distinct if not any(o != k and o in k for o in distinct)]


def _constant_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def contains_keywords(
    text: Column, keywords: Sequence[str], min_keywords: int = 1, mode: str = "substring"
) -> Column:
    """True if the text holds at least ``min_keywords`` of the keywords.

    A keyword counts once, however often it occurs. ``mode='token'`` matches whole
    words (or word sequences) instead of substrings.
    """
    low = F.coalesce(F.lower(text), F.lit(""))
    if mode == "token":
        low = F.concat(F.lit(" "), F.regexp_replace(low, r"[.,!?\s]+", " "), F.lit(" "))
        wanted = [f" {k.lower()} " for k in keywords]
    elif mode == "substring":
        wanted = [k.lower() for k in keywords]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if not wanted:
        return F.lit(min_keywords <= 0)
    if min_keywords == 1:
        return F.exists(_constant_array(_needed(wanted)), lambda k: F.contains(low, k))
    hits = F.filter(_constant_array(wanted), lambda k: F.contains(low, k))
    return F.size(hits) >= min_keywords


def matched_categories(text: Column, taxonomy: Taxonomy) -> Column:
    """Positions (from 0) of all categories with at least one keyword in the text.

    One expression over a constant table: every row is handled where it stands, so
    neither a join nor a pair of row and keyword is ever produced.
    """
    table = F.array(
        *[
            F.struct(F.lit(i).alias("i"), _constant_array(_needed(keywords)).alias("k"))
            for i, keywords in enumerate(taxonomy.values())
        ]
    )

    def hits(low: Column) -> Column:
        found = F.filter(table, lambda row: F.exists(row["k"], lambda k: F.contains(low, k)))
        return F.transform(found, lambda row: row["i"])

    # the one-element array names the lower-cased text, which is then made only once
    low = F.coalesce(F.lower(text), F.lit(""))
    return F.get(F.transform(F.array(low), hits), F.lit(0))
