"""Whole analyses as jobs: each writes its tables, later ones read what earlier ones wrote."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import classify, ensemble, evaluate, issues, lexicon, profile, reports, scoring
from revlens.operators.classify import Trainer
from revlens.operators.filters import last_year
from revlens.operators.scoring import Scorer
from revlens.plans.enrich import enrich
from revlens.plans.topic_impact import save_topic_impact, topic_impact
from revlens.sources import sinks


def with_lexicon_scores(
    df: DataFrame, valence: DataFrame, polarity: DataFrame | None = None, key: str = "review_id"
) -> DataFrame:
    """Add the valence columns and, with a second word list, the polarity columns.

    Only the key and the text take part in the word job; its one row per review is
    joined back to the wide table.
    """
    text = df.select(key, "content_clean")
    out = df.join(lexicon.lexicon_compound(text, valence, key=key), key, "left")
    if polarity is not None:
        out = out.join(lexicon.lexicon_polarity(text, polarity, key=key), key, "left")
    return out


def analyse_reviews(
    raw: DataFrame,
    path: str,
    valence: DataFrame,
    polarity: DataFrame | None = None,
    trainers: Mapping[str, Trainer] | None = None,
    **topic_options,
) -> dict[str, DataFrame]:
    """Clean, profile, score, find topics and their impact, train classifiers, list issues.

    The text is cleaned once and the enriched reviews are written; the word lists are applied
    to that table, and every later step scans the few columns it needs. ``review_id`` has to
    be unique.
    """
    spark = raw.sparkSession
    sinks.write_table(enrich(raw), f"{path}/enriched")
    enriched = sinks.read_table(spark, f"{path}/enriched")
    sinks.write_table(with_lexicon_scores(enriched, valence, polarity), f"{path}/reviews")
    reviews = sinks.read_table(spark, f"{path}/reviews")
    out = {
        "shape": profile.table_shape(raw),
        "numeric": profile.describe_numeric(raw),
        "missing": profile.missing_values(raw),
        "summary": reports.rating_summary(reviews),
        "scores": reports.value_counts(reviews, "score"),
        "sentiments": reports.value_counts(reviews, "sentiment_label"),
        "peak_months": reports.peak_months(reviews),
        "top_versions": reports.value_counts(reviews, "app_version", 10),
        "issues": issues.issue_breakdown(reviews),
        "version_sentiment": reports.version_sentiment(reviews),
        "response_impact": reports.response_impact(reviews),
        "recent_sentiment": reports.recent_sentiment(reviews),
    }
    methods = [f"{m}_sentiment" for m in ensemble.available_methods(reviews)]
    if methods:
        out["method_accuracy"] = ensemble.method_accuracy(reviews, methods)
        out["method_distribution"] = ensemble.method_distribution(reviews, methods)
    for name, table in out.items():
        sinks.write_table(table, f"{path}/reports/{name}")

    save_topic_impact(topic_impact(reviews, **topic_options), f"{path}/topics")
    models, metrics, predictions = classify.train_models(reviews, trainers)
    sinks.save_model_results(f"{path}/models", models, metrics, predictions)
    return {name: sinks.read_table(spark, f"{path}/reports/{name}") for name in out}


def score_and_vote(
    reviews: DataFrame, path: str, scorers: Mapping[str, Callable[[], Scorer]], batch_size: int = 16
) -> DataFrame:
    """Score the reviews with each supplied model, vote, and write the result."""
    out = reviews
    for name, make in scorers.items():
        out = scoring.score_batches(out, make, batch_size=batch_size, prefix=name)
    sinks.write_table(ensemble.ensemble_sentiment(out), path)
    return sinks.read_table(reviews.sparkSession, path)


def comparison_frames(voted: DataFrame) -> dict[str, DataFrame]:
    """Accuracy, labels, confusion matrices and confidences of all methods side by side."""
    methods = [f"{m}_sentiment" for m in (*ensemble.available_methods(voted), "ensemble")]
    methods = [m for m in methods if m in voted.columns]
    out = {
        "accuracy": ensemble.method_accuracy(voted, methods),
        "distribution": ensemble.method_distribution(voted, methods),
        "confusion": evaluate.method_confusion(voted, methods),
    }
    for name in ("roberta", "bert"):
        label, confidence = f"{name}_sentiment", f"{name}_confidence"
        if {label, confidence} <= set(voted.columns):
            out[f"{name}_confidence_by_class"] = ensemble.confidence_by_class(voted, label, confidence)
            out[f"{name}_confidence_quartiles"] = ensemble.confidence_quartiles(voted, label, confidence)
            out[f"{name}_report"] = evaluate.classification_report(voted, predicted=label)
    return out


def dashboard_frames(
    reviews: DataFrame, predicted: str = "roberta_sentiment", model_path: str | None = None
) -> dict[str, DataFrame]:
    """The tables behind all charts, by chart set and name."""
    version_issues = issues.version_issues(reviews)
    recent = last_year(reviews)
    out = {
        "executive/sentiments": reports.value_counts(reviews, "sentiment_label"),
        "executive/daily_volume": reports.daily_volume(reviews),
        "executive/monthly_rating": reports.monthly_avg_rating(reviews),
        "executive/issues": issues.issue_breakdown(reviews),
        "executive/replies": reports.value_counts(reviews, "has_reply"),
        "trends/monthly": reports.monthly_sentiment(reviews),
        "trends/monthly_pct": reports.monthly_sentiment_pct(reviews),
        "trends/scores": reports.score_by_sentiment(reviews),
        "trends/weekdays": reports.weekday_sentiment(reviews),
        "words/frequencies": reports.word_frequencies(reviews),
        "timeline/daily": reports.daily_sentiment(reviews),
        "timeline/version_ratings": reports.version_ratings(reviews),
        "timeline/version_sentiment": reports.recent_version_sentiment(reviews),
        "timeline/top_versions": reports.value_counts(recent, "app_version", 5),
        "timeline/version_issues": version_issues,
        "timeline/issue_matrix": issues.version_issue_matrix(version_issues),
        "timeline/dominant_issue": issues.dominant_issue(version_issues),
        "versions/ratings": reports.top_version_ratings(reviews),
        "versions/sentiment": reports.version_sentiment(reviews, top=8),
        "responses/monthly_rate": reports.monthly_response_rate(reviews),
        "responses/impact": reports.response_impact(reviews),
        "responses/histogram": reports.response_time_histogram(reviews),
        "responses/times": reports.response_time_stats(reviews),
        "responses/sentiment": reports.sentiment_by_response(reviews),
        "issues/compact": issues.issue_breakdown_compact(reviews),
    }
    if predicted in reviews.columns:
        out["executive/negative_versions"] = reports.negative_by_version(reviews, predicted)
    if model_path is not None:
        _, metrics = sinks.load_model_results(reviews.sparkSession, model_path)
        best = classify.best_model(metrics)
        out["models/metrics"] = metrics
        out["models/best"] = best
        chosen = sinks.load_predictions(reviews.sparkSession, model_path).where(
            F.col("model") == best.select("model").scalar()
        )
        out["models/confusion"] = evaluate.confusion_matrix(chosen, predicted="predicted_label")
    return out
