"""Every operator as a query over the given tables.

Each function takes (spark, sf_dir) and reads whole tables. Dates and timestamps leave
as text and doubles rounded, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import keywords as kw
from revlens.functions import labels, text
from revlens.operators import (
    classify,
    ensemble,
    evaluate,
    features,
    filters,
    issues,
    joins,
    keyword_index,
    lexicon,
    profile,
    reports,
    scoring,
    sentences,
    stats,
    topics,
)
from revlens.plans import enrich
from revlens.plans.topic_impact import topic_impact as run_topic_impact
from revlens.schema import RAW_COLUMNS, TIMESTAMP_FORMAT
from revlens.session import shared_folder
from revlens.sources import sinks
from revlens.sources.reviews import drop_index_column as drop_row_numbers
from revlens.sources.reviews import parse_timestamps as parse_columns
from revlens.sources.reviews import read_reviews as read_review_table
from revlens.sources.reviews import reviews_view as as_reviews

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOPICS = {
    0: ["the", "and", "that"],
    1: ["que", "des"],
    2: ["tion", "ing"],
    3: ["worthless", "idiot", "stupid"],
    4: ["zzzz"],
}
LEXICON = [
    ("best", 1.0, 0.3),
    ("worthless", -0.8, 0.9),
    ("idiot", -0.8, 0.8),
    ("stupid", -0.7, 1.0),
    ("with", 0.2, 0.1),
    ("from", -0.1, 0.1),
]
PHRASES = [
    ("of the", -0.4, 0.2),
    ("that the", 0.5, 0.4),
    ("the the the", 0.9, 0.6),
    ("de la", -0.6, 0.1),
    ("de la de la", 0.7, 0.9),
    ("is is", -0.3, 0.3),
]
LEMMAS = [
    ("des", "de"),
    ("les", "le"),
    ("que", "qui"),
    ("the", "a"),
    ("worthless", "worth"),
    ("words", "word"),
    ("eren", "ere"),
    ("aux", "au"),
    ("der", "die"),
    ("los", "el"),
    ("una", "un"),
    ("ing", "in"),
]
METHODS = ["vader_sentiment", "textblob_sentiment", "roberta_sentiment", "bert_sentiment"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(column: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: r4(n, digits) for n in names})


def as_text(column: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(column, fmt).alias(column)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_reviews(table(spark, sf_dir, "documents"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that does not need the text."""
    base = enrich.presence_flags(enrich.temporal_features(reviews(spark, sf_dir)))
    return enrich.label_columns(enrich.response_time(base))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the raw text."""
    return facts(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.clean_columns(texts(spark, sf_dir))


def nostop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.nostop_columns(cleaned(spark, sf_dir))


def lemmatized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.lemma_column(nostop(spark, sf_dir))


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, polarity double, subjectivity double")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of four methods, derived from the id, with gaps."""
    i = F.col("doc_id")
    votes = {m: (i * factor + shift) % 3 for m, factor, shift in zip(METHODS, (1, 2, 4, 5), (0, 1, 0, 2))}
    named = {m: labels.decode_label(v) for m, v in votes.items()}
    named["roberta_sentiment"] = F.when(i % 7 == 0, "Not Processed").otherwise(named["roberta_sentiment"])
    named["bert_sentiment"] = F.when(i % 5 != 0, named["bert_sentiment"])
    return facts(spark, sf_dir).withColumns(
        {**named, "roberta_confidence": (i % 100) / 100.0, "prediction": labels.decode_label(i % 4 % 3)}
    )


# ---------------------------------------------------------------- sources, profile


@query
def reviews_view(spark, sf_dir):
    return reviews(spark, sf_dir).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("review_ts", "replied_at")}
    )


@query
def table_shape(spark, sf_dir):
    return profile.table_shape(reviews(spark, sf_dir))


@query
def first_rows(spark, sf_dir):
    return profile.first_rows(reviews(spark, sf_dir).select("doc_id", "content", "score", "lang"), "doc_id")


@query
def describe_numeric(spark, sf_dir):
    out = profile.describe_numeric(facts(spark, sf_dir), ["score", "response_time_hours", "has_reply"])
    return rounded(out, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def describe_events(spark, sf_dir):
    out = profile.describe_numeric(table(spark, sf_dir, "events"), ["user_id", "value"])
    return rounded(out, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def missing_values(spark, sf_dir):
    return rounded(profile.missing_values(reviews(spark, sf_dir)), "missing_pct")


def _work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _as_dump(df: DataFrame) -> DataFrame:
    """A review table under the column names and formats of a raw dump."""
    raw = {alias: name for name, (alias, _) in RAW_COLUMNS.items()}
    shown = {c: F.date_format(c, TIMESTAMP_FORMAT) for c in ("review_ts", "replied_at")}
    return df.withColumns(shown).select(*[F.col(c).alias(raw[c]) for c in df.columns if c in raw])


def _as_shown(df: DataFrame) -> DataFrame:
    out = df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("review_ts", "replied_at")})
    return out.select("review_id", "content", "score", "review_ts", "app_version", "reply_content", "replied_at")


@query
def read_reviews(spark, sf_dir):
    """A dump with row numbers, written as CSV and read back."""
    path = _work_path(spark, "dump")
    numbered = _as_dump(reviews(spark, sf_dir)).select(F.monotonically_increasing_id().alias("Unnamed: 0"), "*")
    sinks.write_table(numbered, path, "csv")
    return _as_shown(read_review_table(spark, path))


@query
def drop_index_column(spark, sf_dir):
    numbered = reviews(spark, sf_dir).select(F.col("doc_id").alias("_c0"), F.col("doc_id").alias("Unnamed: 0"), "review_id", "score")
    return drop_row_numbers(numbered)


@query
def write_and_append(spark, sf_dir):
    """Two halves of the table, written and appended, read as one."""
    path, df = _work_path(spark, "halves"), reviews(spark, sf_dir)
    sinks.write_table(df.where("lang = 'en'"), path, partition_by=("lang",))
    sinks.append_table(df.where("lang <> 'en' OR lang IS NULL"), path, partition_by=("lang",))
    return _as_shown(sinks.read_table(spark, path)).select("review_id", "content", "score", "review_ts")


@query
def saved_predictions(spark, sf_dir):
    path = _work_path(spark, "models")
    shown = predictions(spark, sf_dir).select("doc_id", "prediction", F.lit("rule").alias("model"))
    metrics = rounded(evaluate.weighted_prf(predictions(spark, sf_dir)), "accuracy").select("accuracy")
    sinks.save_model_results(path, {}, metrics, shown)
    _, loaded = sinks.load_model_results(spark, path)
    return sinks.load_predictions(spark, path).crossJoin(F.broadcast(loaded))


@query
def text_column_fallback(spark, sf_dir):
    """The text that reports read where the column without stopwords is missing."""
    bare = cleaned(spark, sf_dir)
    fallback = enrich.column_or(bare, "content_clean_nostop", F.col(enrich.text_column(bare)))
    return bare.select("doc_id", fallback.alias("chosen"), enrich.column_or(bare, "no_such", F.lit("none")).alias("absent"))


# ---------------------------------------------------------------- projections


@query
def parse_timestamps(spark, sf_dir):
    i = F.col("doc_id")
    raw = (
        F.when(i % 17 == 0, "n/a")
        .when(i % 7 == 0, "13/45/2024 99:99")
        .otherwise(F.date_format("review_ts", "M/d/yyyy H:mm"))
    )
    dump = reviews(spark, sf_dir).select("doc_id", raw.alias("review_ts"))
    return parse_columns(dump, ("review_ts",)).select("doc_id", as_text("review_ts"))


@query
def temporal_features(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "doc_id", "year", "month", "quarter", "day_of_week", as_text("review_date", "yyyy-MM-dd")
    )


@query
def presence_flags(spark, sf_dir):
    return facts(spark, sf_dir).select("doc_id", "has_reply", "has_version")


@query
def response_time(spark, sf_dir):
    hours = F.col("response_time_hours")
    return facts(spark, sf_dir).select("doc_id", r4(hours).alias("hours"), r4(hours / 24).alias("days"))


@query
def clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", "content_clean")


@query
def tokenize_review(spark, sf_dir):
    tokens = cleaned(spark, sf_dir).select("doc_id", text.word_tokens(F.col("content_clean")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), text.join_tokens(F.col("t")).alias("tokens"))


@query
def abbreviation_scores(spark, sf_dir):
    scored = sentences.abbreviation_scores(sentences.stop_counts(cleaned(spark, sf_dir)))
    return scored.select("term", "with_stop", "without_stop", (r4(F.col("score") * 1000) / 1000).alias("score"))


@query
def tokenize_abbreviations(spark, sf_dir):
    base = cleaned(spark, sf_dir).select("doc_id", "content_clean")
    # the test tables hold few real abbreviations: a lower bar keeps a good many words
    found = sentences.tokenize(base, sentences.abbreviations(base, threshold=1e-3), key="doc_id")
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), text.join_tokens(F.col("tokens")).alias("tokens"))


@query
def remove_stopwords(spark, sf_dir):
    return nostop(spark, sf_dir).select("doc_id", "content_clean_nostop")


@query
def lemmatize(spark, sf_dir):
    return lemmatized(spark, sf_dir).select("doc_id", "content_lemmatized")


@query
def lemmatize_dictionary(spark, sf_dir):
    dictionary = spark.createDataFrame(LEMMAS, "form string, lemma string")
    rows = nostop(spark, sf_dir).select("doc_id", "tokens_nostop")
    return lexicon.lemmatize(rows, dictionary, key="doc_id").select("doc_id", "content_lemmatized")


@query
def text_metrics(spark, sf_dir):
    return enrich.text_metrics(nostop(spark, sf_dir)).select(
        "doc_id", "review_length", "word_count", "word_count_nostop"
    )


@query
def major_version(spark, sf_dir):
    return facts(spark, sf_dir).select("doc_id", "app_version", "major_version")


@query
def sentiment_label(spark, sf_dir):
    return facts(spark, sf_dir).select("doc_id", "score", "sentiment_label")


@query
def normalize_label(spark, sf_dir):
    names = ["positive", "NEGATIVE", "neutral", "LABEL_1", "POSITIVE", "negative", "NEUTRAL", "Positive"]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 8 + 1).cast("int"))
    return reviews(spark, sf_dir).select("doc_id", raw.alias("raw")).select(
        "doc_id", "raw", labels.normalize_label(F.col("raw")).alias("label")
    )


@query
def encode_label(spark, sf_dir):
    coded = facts(spark, sf_dir).select("doc_id", labels.encode_label(F.col("sentiment_label")).alias("code"))
    return coded.withColumn("decoded", labels.decode_label(F.col("code")))


@query
def rating_band(spark, sf_dir):
    return facts(spark, sf_dir).select("doc_id", labels.rating_band(F.col("score")).alias("band"))


# ---------------------------------------------------------------- filters, sampling


@query
def has_text(spark, sf_dir):
    return filters.has_text(cleaned(spark, sf_dir)).select("doc_id", F.length("content_clean").alias("n"))


@query
def filter_sentiment(spark, sf_dir):
    return filters.filter_sentiment(facts(spark, sf_dir), "Negative").select("doc_id", "score")


@query
def contains_keywords(spark, sf_dir):
    words = ["the", "tion", "that", "que", "idiot"]
    clean = F.col("content_clean")
    return cleaned(spark, sf_dir).select(
        "doc_id",
        kw.contains_keywords(clean, words).cast("int").alias("any_hit"),
        kw.contains_keywords(clean, words, min_keywords=3).cast("int").alias("three_hits"),
        kw.contains_keywords(clean, words, mode="token").cast("int").alias("token_hit"),
    )


@query
def last_year(spark, sf_dir):
    return filters.last_year(facts(spark, sf_dir)).select("doc_id", as_text("review_date", "yyyy-MM-dd"))


@query
def response_outliers(spark, sf_dir):
    return filters.response_outliers(facts(spark, sf_dir)).select("doc_id", r4("response_days").alias("days"))


@query
def valid_predictions(spark, sf_dir):
    return filters.valid_predictions(predictions(spark, sf_dir), "roberta_sentiment").select(
        "doc_id", "roberta_sentiment"
    )


@query
def seeded_sample(spark, sf_dir):
    return filters.seeded_sample(facts(spark, sf_dir), 100).select("doc_id", "sentiment_label")


# ---------------------------------------------------------------- joins


@query
def merge_predictions(spark, sf_dir):
    scored = predictions(spark, sf_dir).where("doc_id % 4 <> 0")
    first = scored.select("review_id", "roberta_sentiment", "roberta_confidence")
    again = scored.where("doc_id % 6 = 1").select(
        "review_id", F.col("bert_sentiment").alias("roberta_sentiment"), F.lit(0.5).alias("roberta_confidence")
    )
    merged = joins.merge_predictions(facts(spark, sf_dir).select("doc_id", "review_id"), first.union(again.na.drop()))
    return merged.select("doc_id", "roberta_sentiment", r4("roberta_confidence").alias("confidence"))


@query
def top_version_rows(spark, sf_dir):
    return joins.top_value_rows(facts(spark, sf_dir), "app_version", 8).select("doc_id", "app_version")


@query
def taxonomy_match(spark, sf_dir):
    return issues.taxonomy_match(nostop(spark, sf_dir), kw_tables()["full"], key="doc_id").select(
        "doc_id", "category"
    )


@query
def taxonomy_match_table(spark, sf_dir):
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("keyword")
    keywords = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).cast("int").alias("category"), word)
    return keyword_index.keyword_table_match(cleaned(spark, sf_dir), keywords.distinct(), "content_clean", "doc_id")


def kw_tables():
    from revlens.functions.wordlists import COMPACT_TAXONOMY, ISSUE_TAXONOMY

    return {"full": ISSUE_TAXONOMY, "compact": COMPACT_TAXONOMY}


# ---------------------------------------------------------------- reports


@query
def score_distribution(spark, sf_dir):
    return reports.value_counts(facts(spark, sf_dir), "score")


@query
def sentiment_distribution(spark, sf_dir):
    return reports.value_counts(facts(spark, sf_dir), "sentiment_label")


@query
def top_versions(spark, sf_dir):
    return reports.value_counts(facts(spark, sf_dir), "app_version", 10)


@query
def recent_top_versions(spark, sf_dir):
    return reports.value_counts(filters.last_year(facts(spark, sf_dir)), "app_version", 5)


@query
def reply_counts(spark, sf_dir):
    return reports.value_counts(facts(spark, sf_dir), "has_reply")


@query
def event_type_counts(spark, sf_dir):
    return reports.value_counts(table(spark, sf_dir, "events"), "event_type")


@query
def event_daily_volume(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return reports.value_counts(days, "day")


@query
def monthly_volume(spark, sf_dir):
    return reports.monthly_volume(facts(spark, sf_dir))


@query
def peak_months(spark, sf_dir):
    return reports.peak_months(facts(spark, sf_dir))


@query
def monthly_avg_rating(spark, sf_dir):
    return rounded(reports.monthly_avg_rating(facts(spark, sf_dir)), "avg_rating")


@query
def monthly_sentiment(spark, sf_dir):
    return reports.monthly_sentiment(facts(spark, sf_dir))


@query
def monthly_sentiment_pct(spark, sf_dir):
    return rounded(reports.monthly_sentiment_pct(facts(spark, sf_dir)), "Negative", "Neutral", "Positive")


@query
def recent_sentiment(spark, sf_dir):
    return reports.recent_sentiment(facts(spark, sf_dir))


@query
def daily_volume(spark, sf_dir):
    return reports.daily_volume(facts(spark, sf_dir)).select(as_text("review_date", "yyyy-MM-dd"), "n")


@query
def daily_sentiment(spark, sf_dir):
    return reports.daily_sentiment(facts(spark, sf_dir)).select(
        as_text("review_date", "yyyy-MM-dd"), "sentiment_label", "n"
    )


@query
def weekday_sentiment(spark, sf_dir):
    return reports.weekday_sentiment(facts(spark, sf_dir))


@query
def score_by_sentiment(spark, sf_dir):
    return reports.score_by_sentiment(facts(spark, sf_dir))


@query
def rating_summary(spark, sf_dir):
    out = reports.rating_summary(enrich.text_metrics(nostop(spark, sf_dir)))
    return rounded(out, *[c for c in out.columns if c != "reviews"])


@query
def group_rating_stats(spark, sf_dir):
    return reports.group_rating_stats(facts(spark, sf_dir), "lang")


@query
def best_worst_group(spark, sf_dir):
    out = reports.best_worst_group(facts(spark, sf_dir), "source")
    return rounded(out, "best_rating", "worst_rating", "rating_gap", "overall_rating")


@query
def topic_share(spark, sf_dir):
    return rounded(reports.topic_share(facts(spark, sf_dir), "source"), "pct")


@query
def version_ratings(spark, sf_dir):
    return rounded(reports.version_ratings(facts(spark, sf_dir)), "avg_rating")


@query
def version_sentiment(spark, sf_dir):
    return rounded(reports.version_sentiment(facts(spark, sf_dir)), "Negative", "Neutral", "Positive")


@query
def top_version_sentiment(spark, sf_dir):
    out = reports.version_sentiment(facts(spark, sf_dir), top=3)
    return rounded(out, "Negative", "Neutral", "Positive")


@query
def recent_version_sentiment(spark, sf_dir):
    return rounded(reports.recent_version_sentiment(facts(spark, sf_dir)), "Negative", "Neutral", "Positive")


@query
def top_version_ratings(spark, sf_dir):
    return rounded(reports.top_version_ratings(facts(spark, sf_dir), top=4), "avg_rating")


@query
def negative_by_version(spark, sf_dir):
    return reports.negative_by_version(predictions(spark, sf_dir), "roberta_sentiment")


@query
def response_impact(spark, sf_dir):
    return rounded(reports.response_impact(facts(spark, sf_dir)), "mean_score")


@query
def monthly_response_rate(spark, sf_dir):
    return rounded(reports.monthly_response_rate(facts(spark, sf_dir)), "response_pct")


@query
def sentiment_by_response(spark, sf_dir):
    return rounded(reports.sentiment_by_response(facts(spark, sf_dir)), "Negative", "Neutral", "Positive")


@query
def response_time_stats(spark, sf_dir):
    out = reports.response_time_stats(facts(spark, sf_dir))
    return rounded(out, "mean_days", "min_days", "max_days", "median_days")


@query
def response_time_histogram(spark, sf_dir):
    return rounded(reports.response_time_histogram(facts(spark, sf_dir)), "bin_start")


@query
def word_frequencies(spark, sf_dir):
    return rounded(reports.word_frequencies(nostop(spark, sf_dir)), "weight")


# ---------------------------------------------------------------- issues


@query
def issue_breakdown(spark, sf_dir):
    return rounded(issues.issue_breakdown(nostop(spark, sf_dir), key="doc_id"), "percentage").drop("ordinal")


@query
def issue_breakdown_compact(spark, sf_dir):
    return rounded(issues.issue_breakdown_compact(nostop(spark, sf_dir)), "percentage").drop("ordinal")


@query
def version_issues(spark, sf_dir):
    return rounded(issues.version_issues(nostop(spark, sf_dir)), "percentage").drop("ordinal")


@query
def version_issue_matrix(spark, sf_dir):
    return issues.version_issue_matrix(issues.version_issues(nostop(spark, sf_dir)))


@query
def dominant_issue(spark, sf_dir):
    return rounded(issues.dominant_issue(issues.version_issues(nostop(spark, sf_dir))), "percentage")


# ---------------------------------------------------------------- sentiment


@query
def lexicon_compound(spark, sf_dir):
    out = lexicon.lexicon_compound(
        cleaned(spark, sf_dir),
        lexicon_table(spark),
        key="doc_id",
        negators=["that", "not", "never"],
        boosters_up=["this", "so"],
        boosters_down=["by"],
    )
    return rounded(out, "vader_compound", digits=3)


def phrase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON + PHRASES, "term string, polarity double, subjectivity double")


@query
def lexicon_compound_phrases(spark, sf_dir):
    out = lexicon.lexicon_compound(
        cleaned(spark, sf_dir),
        phrase_table(spark),
        key="doc_id",
        negators=["that", "not", "never"],
        boosters_up=["this", "so"],
        boosters_down=["by"],
    )
    return rounded(out, "vader_compound", digits=3)


@query
def lexicon_polarity_phrases(spark, sf_dir):
    out = lexicon.lexicon_polarity(cleaned(spark, sf_dir), phrase_table(spark), key="doc_id")
    return rounded(out, "textblob_polarity", "textblob_subjectivity")


@query
def lexicon_polarity(spark, sf_dir):
    out = lexicon.lexicon_polarity(cleaned(spark, sf_dir), lexicon_table(spark), key="doc_id")
    return rounded(out, "textblob_polarity", "textblob_subjectivity")


@query
def score_batches(spark, sf_dir):
    def make():
        def logits(batch):
            marks = np.array([[t.count(m) for m in (",", "!", ".")] for t in batch], dtype=float)
            return marks / 8.0

        return scoring.softmax_scorer(logits, ["negative", "neutral", "positive"])

    out = scoring.score_batches(cleaned(spark, sf_dir).select("doc_id", "content_clean"), make)
    return out.select("doc_id", "roberta_sentiment", r4("roberta_confidence").alias("confidence"))


@query
def ensemble_sentiment(spark, sf_dir):
    out = ensemble.ensemble_sentiment(predictions(spark, sf_dir))
    return out.select("doc_id", *METHODS, r4("ensemble_score").alias("ensemble_score"), "ensemble_sentiment")


@query
def method_accuracy(spark, sf_dir):
    voted = ensemble.ensemble_sentiment(predictions(spark, sf_dir))
    return rounded(
        ensemble.method_accuracy(voted, [*METHODS, "ensemble_sentiment"]), "accuracy", "valid_accuracy"
    )


@query
def method_distribution(spark, sf_dir):
    return ensemble.method_distribution(predictions(spark, sf_dir), METHODS)


@query
def confidence_by_class(spark, sf_dir):
    out = ensemble.confidence_by_class(predictions(spark, sf_dir), "roberta_sentiment", "roberta_confidence")
    return rounded(out, "mean_confidence")


@query
def confidence_quartiles(spark, sf_dir):
    out = ensemble.confidence_quartiles(predictions(spark, sf_dir), "roberta_sentiment", "roberta_confidence")
    return rounded(out, "min", "p25", "median", "p75", "max")


@query
def weighted_prf(spark, sf_dir):
    out = evaluate.weighted_prf(predictions(spark, sf_dir))
    return rounded(out, *out.columns)


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return rounded(evaluate.classification_report(predictions(spark, sf_dir)), "precision", "recall", "f1")


@query
def method_confusion(spark, sf_dir):
    return evaluate.method_confusion(predictions(spark, sf_dir), METHODS)


# ---------------------------------------------------------------- topics, features


@query
def vocabulary(spark, sf_dir):
    out = features.vocabulary(lemmatized(spark, sf_dir), "content_lemmatized", 1000, 5, 0.7)
    return out.select("term", "tf", "df", r4("idf").alias("idf"))


def _topic_texts(spark, sf_dir):
    # read for every vocabulary and for the vectors: written once
    return sinks.stored(lemmatized(spark, sf_dir).select("doc_id", "content_lemmatized"), "lemmas")


def _topic_vectors(spark, sf_dir, rows=None):
    # vectors are read in every round: written once
    rows = _topic_texts(spark, sf_dir) if rows is None else rows
    model = features.fit_tfidf(rows, "content_lemmatized", "features", 1000, 5, 0.7)
    return sinks.stored(model.transform(rows).select("doc_id", "features"), "topic-vectors"), features.terms_of(model)


@query
def tfidf_terms(spark, sf_dir):
    vectors, terms = _topic_vectors(spark, sf_dir)
    return rounded(features.tfidf_terms(vectors, terms, "doc_id"), "weight")


@query
def lda_topics(spark, sf_dir):
    vectors, terms = _topic_vectors(spark, sf_dir)
    model = topics.fit_lda(vectors.select("features"))
    return topics.lda_topic_terms(model, terms, 10)


@query
def dominant_topic(spark, sf_dir):
    vectors, _ = _topic_vectors(spark, sf_dir)
    model = topics.fit_lda(vectors.select("features"))
    return topics.dominant_topic(model, vectors).select("doc_id", "dominant_topic")


@query
def topic_keywords(spark, sf_dir):
    vectors, terms = _topic_vectors(spark, sf_dir)
    model = topics.fit_lda(vectors.select("features"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    listed = topics.lda_topic_terms(model, terms, 15).groupBy("topic").agg(ranked.alias("ranked"))
    keywords = F.transform("ranked", lambda x: x["term"])
    return listed.select("topic", text.keyword_list_label(keywords, 15).alias("keywords"))


@query
def nmf_topics(spark, sf_dir):
    vectors, terms = _topic_vectors(spark, sf_dir)
    model = topics.fit_nmf(vectors.select("features"), len(terms))
    return model.topic_terms(spark, terms, 10)


@query
def reviews_with_topic(spark, sf_dir):
    """Which reviews get a topic from each of the two models: those with a known term."""
    vectors, terms = _topic_vectors(spark, sf_dir)
    lda = topics.dominant_topic(topics.fit_lda(vectors.select("features")), vectors)
    nmf = topics.nmf_dominant_topic(topics.fit_nmf(vectors.select("features"), len(terms)), vectors, "doc_id")
    by_nmf = nmf.select("doc_id", F.col("topic").between(0, 4).alias("nmf_topic"))
    return lda.select("doc_id", F.col("dominant_topic").between(0, 4).alias("lda_topic")).join(by_nmf, "doc_id", "left").na.fill(False)


@query
def topic_term_checks(spark, sf_dir):
    """Per topic: terms listed, terms of the vocabulary among them, and weights in falling order."""
    rows = _topic_texts(spark, sf_dir)
    vectors, terms = _topic_vectors(spark, sf_dir, rows)
    lda = topics.lda_topic_terms(topics.fit_lda(vectors.select("features")), terms, 10)
    nmf = topics.fit_nmf(vectors.select("features"), len(terms)).topic_terms(spark, terms, 10)
    listed = lda.withColumn("model", F.lit("lda")).unionByName(nmf.withColumn("model", F.lit("nmf")))
    known = features.vocabulary(rows, "content_lemmatized", 1000, 5, 0.7).select("term", F.lit(1).alias("known"))
    weights = F.array_sort(F.collect_list(F.struct("rank", "weight")))
    in_order = F.transform(weights, lambda w: w["weight"])
    return (
        listed.join(known, "term", "left")
        .groupBy("model", "topic")
        .agg(F.count("*").alias("listed"), F.count("known").alias("known"), (in_order == F.sort_array(in_order, asc=False)).alias("falling"))
    )


@query
def keyword_presence(spark, sf_dir):
    out = stats.keyword_presence(cleaned(spark, sf_dir), TOPICS)
    return rounded(out, "with_keywords_avg", "without_keywords_avg", "rating_difference")


# ---------------------------------------------------------------- statistics


@query
def topic_ttest(spark, sf_dir):
    out = stats.topic_statistics(cleaned(spark, sf_dir), TOPICS)
    return rounded(out, "topic_avg", "other_avg", "t_statistic", "dof", "cohens_d")


@query
def cohens_d(spark, sf_dir):
    out = stats.topic_statistics(cleaned(spark, sf_dir), TOPICS)
    return out.select("topic_id", r4("cohens_d").alias("cohens_d"), labels.effect_size_band(F.col("cohens_d")).alias("band"))


MANY_TOPICS = {i: [a + b] for i, (a, b) in enumerate([(a, b) for a in "aeioun" for b in "nrstldcmhe"])}


def _test_columns(df: DataFrame) -> DataFrame:
    out = rounded(df, "topic_avg", "other_avg", "t_statistic", "dof", "cohens_d")
    return rounded(out, "p_value", digits=6)


@query
def topic_ttest_many(spark, sf_dir):
    out = stats.topic_statistics(cleaned(spark, sf_dir), MANY_TOPICS)
    return rounded(out, "topic_avg", "other_avg", "t_statistic", "dof", "cohens_d", digits=3)


@query
def topic_ttest_p(spark, sf_dir):
    return _test_columns(stats.topic_ttest(cleaned(spark, sf_dir), TOPICS))


@query
def impact_summary(spark, sf_dir):
    out = stats.impact_summary(stats.topic_ttest(cleaned(spark, sf_dir), TOPICS, alpha=0.9))
    return rounded(_test_columns(out), "star_difference")


def _chart_frame(spark, sf_dir, name):
    return stats.impact_chart_frames(stats.topic_ttest(cleaned(spark, sf_dir), TOPICS))[name]


@query
def impact_chart_frames(spark, sf_dir):
    return rounded(_chart_frame(spark, sf_dir, "by_p"), "p_value", "neg_log10_p", "threshold")


@query
def impact_chart_by_mean(spark, sf_dir):
    return rounded(_chart_frame(spark, sf_dir, "by_mean"), "topic_avg")


@query
def impact_chart_by_d(spark, sf_dir):
    return rounded(_chart_frame(spark, sf_dir, "by_d"), "cohens_d")


@query
def impact_chart_group_sizes(spark, sf_dir):
    return _chart_frame(spark, sf_dir, "group_sizes")


@query
def topic_impact(spark, sf_dir):
    rows = enrich.enrich(texts(spark, sf_dir)).select("review_id", "score", "content_clean", "content_lemmatized")
    return run_topic_impact(sinks.stored(rows, "impact-texts")).tests


# ---------------------------------------------------------------- classifiers


@query
def stratified_split(spark, sf_dir):
    return filters.stratified_split(facts(spark, sf_dir)).select("doc_id", "sentiment_label", "split")


@query
def cv_folds(spark, sf_dir):
    return filters.stratified_folds(facts(spark, sf_dir)).select("doc_id", "sentiment_label", "fold")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts of the documents whose quality is labelled: the label can be learned."""
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = F.when(F.col("quality") == 1, "Positive").otherwise("Negative")
    return cleaned(spark, sf_dir).join(known, "doc_id").withColumn("sentiment_label", good)


@query
def train_models(spark, sf_dir):
    """All five learners with their full number of rounds."""
    return classify.train_models(labelled(spark, sf_dir))[1]


@query
def best_model(spark, sf_dir):
    return classify.best_model(classify.train_models(labelled(spark, sf_dir), folds=0)[1])


@query
def cross_validate(spark, sf_dir):
    return classify.cv_summary(classify.cross_validate(labelled(spark, sf_dir)))
