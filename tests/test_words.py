"""Abbreviations, phrases of word lists and keyword tables against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.functions.text import word_tokens
from revlens.operators import issues, keyword_index, lexicon, sentences
from revlens.operators.joins import with_hits
from revlens.operators.keyword_index import keyword_table_match
from tests.conftest import rows

TEXT = "review_id string, content_clean string"


def plain_scores(texts):
    stop, bare = Counter(), Counter()
    for text in texts:
        for word in (w.strip(",!?") for w in (text or "").lower().split()):
            if word.endswith(".") and not word.endswith("..") and len(word) > 1:
                stop[word[:-1]] += 1
            elif word and not word.endswith("."):
                bare[word] += 1
    n, stops = sum(stop.values()) + sum(bare.values()), sum(stop.values())
    p = min(stops / n, 0.99)
    out = {}
    for w, a in stop.items():
        if any("a" <= c <= "z" for c in w):
            b, inner = bare[w], w.count(".")
            m = len(w) - inner
            odds = -2 * (a * math.log(p) + b * math.log(1 - p) - a * math.log(0.99) - b * math.log(0.01))
            out[w] = odds * math.exp(-m) * (inner + 1) * m ** -float(b)
    return out


def corpus(n=300):
    draw = random.Random(5)
    plain = ["street", "app", "opens", "slowly", "crash", "screen", "works", "again", "button", "update"]
    out = []
    for _ in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(4, 14))]
        words.insert(draw.randrange(len(words)), draw.choice(["dr.", "e.g.", "st.", "vs."]))
        for _ in range(draw.randint(0, 2)):
            k = draw.randrange(len(words))
            words[k] = words[k].rstrip(".") + "." if words[k][0] not in "desv" else words[k]
        out.append(" ".join(words) + ".")
    return out


def test_abbreviations_are_learned_from_stops(spark):
    texts = [*corpus(), None, "", "...", "?! .", "wait... done"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], TEXT)
    got = {r["term"]: r["score"] for r in rows(sentences.abbreviation_scores(sentences.stop_counts(df)))}
    assert got == pytest.approx(plain_scores(texts))
    assert {r["term"] for r in rows(sentences.abbreviations(df))} == {"dr", "e.g", "st", "vs"}
    spread = sentences.abbreviation_scores(sentences.stop_counts(df.repartition(7)))
    assert {r["term"]: r["score"] for r in rows(spread)} == pytest.approx(got)


def test_an_abbreviation_keeps_its_stop_inside_a_text(spark):
    texts = {
        "see dr. who. it cannot work, e.g. here st.": "see dr. who . it can not work , e.g. here st .",
        "no stops here": "no stops here",
        "dr.": "dr .",
        "dr... no": "dr ... no",
        "dr.! st. x": "dr . ! st. x",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], TEXT)
    known = spark.createDataFrame([("dr",), ("e.g",), ("St",), ("st",)], "term string")
    got = rows(sentences.tokenize(df, known), "review_id")
    joined = [None if r["tokens"] is None else " ".join(r["tokens"]) for r in got]
    assert joined == list(texts.values())
    without = rows(sentences.tokenize(df, known.limit(0)), "review_id")
    assert [r["tokens"] for r in without] == [r["t"] for r in df.select(word_tokens(F.col("content_clean")).alias("t")).collect()]
    assert sentences.abbreviation_scores(sentences.stop_counts(df.limit(0))).count() == 0


def plain_merge(words, phrases):
    out, i = [], 0
    while i < len(words):
        n = max((len(p) for p in phrases if len(p) > 1 and tuple(words[i : i + len(p)]) == p), default=1)
        out.append(" ".join(words[i : i + n]))
        i += n
    return out


def test_phrases_are_taken_longest_first(spark):
    draw = random.Random(3)
    phrases = {tuple(draw.choice("abcd") for _ in range(draw.randint(2, 5))) for _ in range(25)}
    lists = [[draw.choice("abcde") for _ in range(draw.randint(0, 60))] for _ in range(60)] + [["a"] * 3000, None]
    df = spark.createDataFrame([(str(i), w) for i, w in enumerate(lists)], "review_id string, words array<string>")
    table = spark.createDataFrame([(" ".join(p),) for p in phrases], "term string")
    got = {r["review_id"]: r["words"] for r in rows(lexicon.merge_phrases(df, table))}
    assert got == {str(i): None if w is None else plain_merge(w, phrases) for i, w in enumerate(lists)}
    assert any(len(x.split()) > 2 for w in got.values() if w for x in w)


def test_a_phrase_counts_as_one_word(spark):
    entries = [("good", 1.9), ("kiss of death", -1.5), ("kiss", 1.0), ("Yeah,  right!", -2.0), ("a b", 3.0), (" bad ", -2.5)]
    table = spark.createDataFrame(entries, "term string, polarity double").withColumn("subjectivity", F.lit(0.5))
    texts = ["the kiss of death", "kiss of life", "not kiss of death", "yeah, right! good", "very kiss of death.", "a b", ""]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], TEXT)
    sums = [-1.5, 1.0, 1.5 * 0.74, -0.1, -1.793, 0.0, 0.0]
    sums[3] -= 0.292
    got = rows(lexicon.lexicon_compound(df, table), "review_id")
    assert [r["vader_compound"] for r in got] == [round(s / math.sqrt(s * s + 15), 4) for s in sums]
    mean = rows(lexicon.lexicon_polarity(df, table), "review_id")
    assert [r["textblob_polarity"] for r in mean] == pytest.approx([-1.5, 1.0, -1.5, -0.05, -1.5, 0.0, 0.0])


def test_hits_come_to_their_row(spark):
    df = spark.createDataFrame([("1", ["x", "y", "x"], "k"), ("2", [], "l"), ("3", None, None)], "review_id string, items array<string>, hits string")
    table = spark.createDataFrame([("x", 1), ("x", 2), ("z", 3), (None, 4)], "term string, n int")
    got = rows(with_hits(df, F.col("items"), table, "term", "found"), "review_id")
    assert [sorted(h["n"] for h in r["found"]) for r in got] == [[1, 2], [], []]
    assert [r["hits"] for r in got] == ["k", "l", None]


def test_fifty_thousand_keywords_match_as_the_expression_does(spark):
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    texts = [" ".join(word(draw.randint(1, 9)) for _ in range(draw.randint(0, 80))) for _ in range(200)] + ["", None, "ÄÖ😀x", "a"]
    held = [t[k : k + draw.randint(4, 12)] for t in texts if t and len(t) > 40 for k in draw.sample(range(len(t) - 20), 5)]
    keywords = {*held, "a", "gh", "ö😀", *(word(draw.randint(7, 11)) for _ in range(50_000))}
    pairs = [(len(k) % 7, k.upper() if i % 2 else k) for i, k in enumerate(sorted(keywords))]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], TEXT)
    table = spark.createDataFrame([*pairs, (1, ""), (2, None)], "category int, keyword string")
    got = keyword_table_match(df, table)
    want = {(str(i), c) for i, t in enumerate(texts) for c, k in pairs if k.lower() in (t or "").lower()}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000


def test_texts_stay_where_they_are_unless_the_table_is_too_large_to_be_sent(spark, monkeypatch):
    texts = ["the price is Fair", "slow and pricey", "", None, "fast, slow", "the price is Fair"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], TEXT)
    pairs = [("money", "price"), ("money", "fair"), ("speed", "slow"), ("speed", "fast"), ("odd", "is"), ("odd", "y")]
    table = spark.createDataFrame(pairs, "category string, keyword string")
    want = sorted({(str(i), c) for i, t in enumerate(texts) for c, k in pairs if k in (t or "").lower()})
    got = keyword_table_match(df, table)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("low" in line or "row" in line for line in shuffled)
    monkeypatch.setattr(keyword_index, "small_side", lambda table, *sizes: table)
    assert sorted(map(tuple, keyword_table_match(df, table).collect())) == want


def test_small_keyword_tables_give_the_rows_of_the_expression(spark, enriched):
    taxonomy = {"money": ["price", "pay", "€"], "speed": ["slow", "fast"], "none": ["qqqq"], "all": ["e"]}
    table = spark.createDataFrame([(c, k) for c, ks in taxonomy.items() for k in ks], "category string, keyword string")
    got = {(r["review_id"], r["category"]) for r in rows(keyword_table_match(enriched, table))}
    assert got == {(r["review_id"], r["category"]) for r in rows(issues.taxonomy_match(enriched, taxonomy))}
    assert keyword_table_match(enriched, table.limit(0)).count() == 0


def test_texts_are_read_once_for_a_keyword_table_that_can_be_sent(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abé  \t.") for _ in range(draw.randint(0, 200))) for _ in range(60)] + ["", None, " ", "b" * 300 + "éa" + "b" * 90]
    pairs = [(c, k) for c, ks in {"x": ["aé", "b\tb", "ba b"], "y": [" ", "bbéabb", "A."], None: ["é  b", "b" * 70], "z": ["zz"]}.items() for k in ks]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "n int, t string").withColumn("t", counted("t"))
    got = keyword_table_match(df, spark.createDataFrame(pairs, "category string, keyword string"), "t", "n")
    want = {(i // 2, c) for i, t in enumerate(texts) for c, k in pairs if k.lower() in (t or "").lower()}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert seen.value == len(texts)
