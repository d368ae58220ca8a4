"""Small tables for the corpus operators."""

from __future__ import annotations

import random

#: Column names that operators use inside, as extra columns of the input.
CLASHING = "body long, key string, id long, n long, score string, label string, component long, line long, gone string, copies string"


def documents(spark, texts, clash=False, langs=None):
    """doc_id, text, lang, source, n_chars of the given texts, numbered from 0."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "src", len(t) if t else 0) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for f in CLASHING.split(", "):
            name, kind = f.split()
            df = df.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return df


def with_rows(df, rows):
    """``df`` and further rows of (doc_id, text)."""
    spark = df.sparkSession
    more = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select(*more.columns).unionByName(more)


def prose(seed, words=120, pool=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(words))


#: What every operator has to survive: null, empty, blank, one word, odd characters, long.
ODD = [None, "", " \n\t ", "word", "Ünïcödé 中文 \U0001f389 á\x85\x1c", "x" * 50_000, "a b " * 20_000, "same text here", "same text here"]


def collected(df, key="doc_id"):
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: (r[key] is None, r[key]))
