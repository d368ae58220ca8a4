import pytest
from pyspark.sql import functions as F

from revlens.functions import keywords, labels, text
from revlens.functions.wordlists import COMPACT_TAXONOMY, ISSUE_TAXONOMY
from revlens.plans.enrich import nostop_columns, text_column
from tests.conftest import rows

# raw text and what cleaning leaves of it
CASES = [
    (None, ''),
    ('', ''),
    ('   ', ''),
    ('Plain TEXT', 'plain text'),
    ('a\nb\tc', 'a b c'),
    ('x https://a.b/c?d=e y', 'x y'),
    ('wwwxyz http', 'http'),
    ('me@x.y a@ @b a@b@ @@c @a@b', 'a b'),
    ('1234567890 123-456-7890 123.456.7890 12345678901', '12345678901'),
    ("don't stop!!! really?", 'dont stop!!! really?'),
    ('na\xefve caf\xe9 \u0130stanbul', 'nave caf istanbul'),
    ('a\xa0b\u2003c\u3000d\x1ce\x85f', 'a b c d e f'),
    ('tab\x0bform\x0c', 'tab form'),
    ('control\x01glue', 'controlglue'),
    ('\U0001f600emoji', 'emoji'),
    ('3.5, 1,000 ...', '3.5, 1,000 ...'),
    ('x@http://foo bar', 'x bar'),
    ('\xe91234567890', '1234567890'),
    ('\u212aelvin', 'kelvin'),
    ('_under_score_ [brackets] {x} `q` ~', 'underscore brackets x q'),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.clean_text(F.col("t")).alias("c")).collect()}
    for i, (raw, left) in enumerate(CASES):
        assert got[i] == left, repr(raw)


def test_clean_text_is_linear_on_long_words(spark):
    df = spark.range(1).select(F.expr("repeat('x', 2000000)").alias("t"))
    assert df.select(F.length(text.clean_text(F.concat("t", F.lit(" a@b"))))).first()[0] == 2000000


def tokens_of(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(text.word_tokens(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("", []),
        ("good,bad", ["good", ",", "bad"]),
        ("costs 3.5 or 1,000.", ["costs", "3.5", "or", "1,000", "."]),
        ("wait... what", ["wait", "...", "what"]),
        ("stop! now?", ["stop", "!", "now", "?"]),
        ("one. two. three", ["one", ".", "two", ".", "three"]),
        ("i cannot and gonna", ["i", "can", "not", "and", "gon", "na"]),
        ("cannots", ["cannots"]),
    ],
)
def test_word_tokens(spark, value, expected):
    assert tokens_of(spark, value) == expected


def test_stopwords_short_words_and_custom_words(spark):
    df = spark.createDataFrame([("the app is very slow ... ok nz vodafone broken",)], "content_clean string")
    row = nostop_columns(df).first()
    assert row.tokens_nostop == ["slow", "...", "broken"]
    assert row.content_clean_nostop == "slow ... broken"


def test_singular(spark):
    words = ["dogs", "boxes", "buses", "ladies", "glass", "his", "bus", "this", "watches", "wishes", "gas", "yes"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(text.singular(F.col("w"))).collect()]
    assert got == ["dog", "box", "buse", "lady", "glass", "his", "bus", "this", "watch", "wish", "gas", "yes"]


def test_metrics_of_empty_text(enriched):
    row = [r for r in rows(enriched) if r["review_id"] in ("a02", "a03")]
    assert all(r["content_clean"] == "" and r["word_count"] == 0 and r["word_count_nostop"] == 0 for r in row)


def test_snippet_and_keyword_label(spark):
    df = spark.createDataFrame([("x" * 200, ["a", "b", "c", "d", "e", "f"])], "t string, k array<string>")
    row = df.select(text.snippet(F.col("t")).alias("s"), text.keyword_list_label(F.col("k")).alias("k")).first()
    assert row.s == "x" * 150 + "..." and row.k == "a, b, c, d, e"


def test_text_column_falls_back(enriched):
    assert text_column(enriched) == "content_clean_nostop"
    assert text_column(enriched.drop("content_clean_nostop")) == "content_clean"


def test_taxonomies_have_their_size():
    assert len(ISSUE_TAXONOMY) == 15 and len(COMPACT_TAXONOMY) == 7
    assert "can't log" in ISSUE_TAXONOMY["Login/Authentication Issues"]
    assert sum(map(len, ISSUE_TAXONOMY.values())) == 156


def test_keywords_match_inside_words_unless_told_otherwise(spark):
    df = spark.createDataFrame([("quick build",), ("ui broken, sadly",), (None,)], "t string")
    t = F.col("t")
    got = df.select(
        keywords.contains_keywords(t, ["ui"]).alias("sub"),
        keywords.contains_keywords(t, ["ui"], mode="token").alias("tok"),
        keywords.contains_keywords(t, ["ui", "broken", "BUILD"], min_keywords=2).alias("two"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (True, True, True), (False, False, False)]


def test_pruned_keywords_give_the_same_hits(spark):
    words = ["crash", "crashes", "data", "data usage", "eating data"]
    values = ["it crashes", "data usage", "nothing", "cras dat", "eating data"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(keywords.contains_keywords(F.col("t"), words)).collect()]
    assert got == [any(w in v for w in words) for v in values]


def test_matched_categories(spark):
    df = spark.createDataFrame([("Slow login and CRASH",), ("fine",), (None,)], "t string")
    got = [r[0] for r in df.select(keywords.matched_categories(F.col("t"), ISSUE_TAXONOMY)).collect()]
    assert got == [[0, 1, 2], [], []]


def test_taxonomy_from_frame(spark):
    df = spark.createDataFrame([("B", 1, ["y"]), ("A", 0, ["x"])], "category string, ordinal int, keywords array<string>")
    assert keywords.taxonomy_from_frame(df) == {"A": ["x"], "B": ["y"]}


def test_labels(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.9,), (3.0,), (3.5,), (4.0,), (5.0,)], "x double")
    x = F.col("x")
    got = df.select(labels.sentiment_label(x), labels.rating_band(x)).collect()
    assert [r[0][:3] for r in got] == ["Neg", "Neg", "Neg", "Neu", "Neg", "Pos", "Pos"]
    assert [r[1] for r in got][1:] == ["critical", "critical", "warning", "warning", "good", "good"]


def test_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.1,), (-0.1,), (0.2,), (-0.2,), (0.0,)], "x double")
    x = F.col("x")
    out = df.select(labels.classify_compound(x), labels.classify_polarity(x), labels.classify_ensemble(x)).collect()
    assert ["".join(v[2] for v in r) for r in out] == ["suu", "guu", "suu", "guu", "ssu", "ggu", "uuu"]


def test_bands_versions_codes(spark):
    df = spark.createDataFrame([(-0.9, "12.3"), (0.1, "beta"), (0.3, None), (-0.5, "v9")], "d double, v string")
    out = df.select(labels.effect_size_band(F.col("d")), labels.major_version(F.col("v"))).collect()
    assert [tuple(r) for r in out] == [
        ("large", "v12"), ("negligible", "Unknown"), ("small", "Unknown"), ("medium", "Unknown"),
    ]
    votes = spark.createDataFrame([("Negative",), ("Positive",), ("Not Processed",), (None,), ("?",)], "l string")
    assert [r[0] for r in votes.select(labels.encode_polarity(F.col("l"))).collect()] == [-1, 1, 0, 0, 0]


def test_impact_label_and_log_p(spark):
    df = spark.createDataFrame(
        [(0.01, 2.0, 3.0), (0.01, 3.0, 2.0), (0.05, 2.0, 3.0), (None, 2.0, 3.0), (0.0, 2.0, 2.0)],
        "p double, a double, b double",
    )
    out = df.select(labels.impact_label(F.col("p"), F.col("a"), F.col("b")), labels.neg_log10(F.col("p"))).collect()
    assert [r[0] for r in out] == ["NEGATIVE", "POSITIVE", "NOT SIGNIFICANT", "NOT SIGNIFICANT", "POSITIVE"]
    assert out[0][1] == pytest.approx(2.0) and out[4][1] is None
