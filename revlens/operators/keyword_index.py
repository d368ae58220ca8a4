"""Keyword tables too large for an expression: found through an index of character q-grams.

``issues.taxonomy_match`` holds every keyword in the plan. Here keywords stay a table. One that can
be sent to all tasks is listed by first bytes, and the texts are read once: a keyword without a
blank stands within a word, and a task looks into a word it meets again only once. A larger table
stays where it is: each keyword is listed under the one of its q-grams that fewest texts hold, a
text looks up its own q-grams, and the keywords it gets are verified in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from revlens.functions.text import named
from revlens.operators.joins import small_side, with_hits
from revlens.plans.enrich import text_column

Q = 3
#: Words a task remembers, and the bytes of the longest one. Bounds memory, not results.
WORDS, WORD_BYTES = 100_000, 64


def _grams(text: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many characters of a text; none in a shorter one or in null."""

    def runs(chars: Column, q: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - q)
        found = F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)]))
        return F.when(F.size(chars) >= q, found).otherwise(F.array().cast("array<string>"))

    cut = named(F.split(text, ""), lambda chars: F.concat(*[runs(chars, q) for q in lengths]))
    return F.when(F.length(text) >= min(lengths), F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def rarest_grams(texts: DataFrame, keywords: DataFrame, lengths: list[int]) -> DataFrame:
    """gram, category, keyword: each keyword once, under the q-gram that fewest texts hold.

    A keyword with a q-gram that no text holds occurs nowhere and is left out.
    """
    own = F.when(F.length("keyword") < Q, F.array("keyword")).otherwise(_grams(F.col("keyword"), [Q]))
    listed = keywords.select("category", "keyword", F.explode(own).alias("gram"))
    wanted = small_side(listed.select("gram").distinct())
    seen = texts.select(F.explode(_grams(F.col("low"), lengths)).alias("gram"))
    counts = seen.join(wanted, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return (
        listed.join(counts, "gram", "left")
        .groupBy("category", "keyword")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        .where("best.n > 0")
        .select("best.gram", "category", "keyword")
    )


def within(keywords: list[tuple[bytes, int]]) -> Callable[[bytes], frozenset[int]]:
    """A function from a text to the numbers of the keywords that it holds."""
    numbers: dict[bytes, set[int]] = {}
    for keyword, number in keywords:
        numbers.setdefault(keyword, set()).add(number)
    heads: dict[bytes, set[int]] = {}
    for keyword in numbers:
        heads.setdefault(keyword[:Q], set()).add(len(keyword))
    widths = sorted({len(head) for head in heads})

    def found(text: bytes) -> frozenset[int]:
        out: set[int] = set()
        for i in range(len(text)):
            for width in widths:
                for n in heads.get(text[i : i + width], ()):
                    out |= numbers.get(text[i : i + n], frozenset())
        return frozenset(out)

    return found


def _sent_table_match(texts: DataFrame, table: pa.Table, category: StructField, key: str) -> DataFrame:
    """key, category of every row, from one scan: ``texts`` is (key, low), ``table`` goes to all tasks."""
    coded = table.column("category").combine_chunks().dictionary_encode(null_encoding="encode")
    listed = list(zip((k.encode() for k in table.column("keyword").to_pylist()), coded.indices.to_pylist(), strict=True))
    sent = texts.sparkSession.sparkContext.broadcast((listed, coded.dictionary))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords, names = sent.value
        look = within([k for k in keywords if b" " not in k[0]])
        known = lru_cache(WORDS)(look)
        spaced = [k for k in keywords if b" " in k[0]]
        across = within(spaced)
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                mine: set[int] = set()
                for word in set((text or b"").split(b" ")):
                    if len(mine) == len(names):
                        break
                    mine |= known(word) if len(word) <= WORD_BYTES else look(word)
                if spaced and text and len(mine) < len(names):
                    mine |= across(text)
                rows += [row] * len(mine)
                hits += mine
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, names.take(pa.array(hits, pa.int32()))], names=[key, "category"])

    schema = StructType([StructField(key, texts.schema[key].dataType), StructField("category", category.dataType)])
    return texts.select(key, F.col("low").cast("binary")).mapInArrow(match, schema).distinct()


def keyword_table_match(df: DataFrame, keywords: DataFrame, text: str | None = None, key: str = "review_id") -> DataFrame:
    """One row per review and category of which the text holds a keyword, as a substring in any case.

    ``keywords`` is (category, keyword), of any size; empty and null keywords are left out. ``key``
    has to be unique. One scan of the texts, where they stand; for a table too large to be sent to
    all tasks two, of which one counts q-grams and one finds.
    """
    table = keywords.select("category", F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    local = small_side(table)
    if local is not table:
        texts = df.select(key, F.lower(text or text_column(df)).alias("low"))
        return _sent_table_match(texts, local.toArrow(), table.schema["category"], key)
    # at most the numbers 1 to Q
    lengths = sorted(r[0] for r in table.select(F.least(F.length("keyword"), F.lit(Q))).distinct().collect())
    if not lengths:
        return df.select(key).limit(0).withColumn("category", F.lit(None).cast(keywords.schema["category"].dataType))
    texts = df.select(key, F.lower(text or text_column(df)).alias("low"))
    index = rarest_grams(texts, table, lengths)
    sent = small_side(index)
    if sent is index:  # too large to be sent: grams are shuffled, each text once
        found = with_hits(texts, _grams(F.col("low"), lengths), index, "gram", "hits", key)
        held = F.filter("hits", lambda h: F.contains("low", h["keyword"]))
        categories = F.array_distinct(F.transform(held, lambda h: h["category"]))
        return found.select(key, F.explode(categories).alias("category"))
    # texts stay where they are and only the categories of each are shuffled; the outer form, as
    # a plain explode would cut every text a second time
    own = texts.select(key, "low", F.explode_outer(_grams(F.col("low"), lengths)).alias("gram"))
    return own.join(sent, "gram").where(F.contains("low", "keyword")).select(key, "category").distinct()
