"""From topics to their effect on ratings, as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from revlens.operators import features, reports, stats, topics
from revlens.sources.sinks import write_table


@dataclass
class TopicImpact:
    assigned: DataFrame
    topic_share: DataFrame
    topic_stats: DataFrame
    topic_terms: DataFrame
    keyword_stats: DataFrame
    tests: DataFrame
    impact: DataFrame


def topic_impact(
    df: DataFrame,
    k: int = 5,
    n_words: int = 15,
    text: str = "content_clean",
    topic_text: str = "content_lemmatized",
    max_features: int = 1000,
    min_df: int = 5,
    max_df: float = 0.7,
    max_iter: int = 20,
    seed: int = 42,
) -> TopicImpact:
    """Fit topics, assign them, and test what their keywords do to the rating.

    ``df`` is an enriched review table. It is read several times (vocabulary, twenty
    model rounds, reports): pass a written table or a persisted frame.
    """
    vectorizer = features.fit_tfidf(df, topic_text, "features", max_features, min_df, max_df)
    vectors = vectorizer.transform(df)
    terms = features.terms_of(vectorizer)
    model = topics.fit_lda(vectors.select("features"), k, max_iter, seed)
    topic_terms = topics.lda_topic_terms(model, terms, n_words)
    keywords = topics.topic_keywords(topic_terms)
    assigned = topics.dominant_topic(model, vectors).drop("features")
    tests = stats.topic_ttest(df, keywords, text)
    return TopicImpact(
        assigned=assigned,
        topic_share=reports.topic_share(assigned),
        topic_stats=reports.group_rating_stats(assigned, "dominant_topic"),
        topic_terms=topic_terms,
        keyword_stats=stats.keyword_presence(df, keywords, text),
        tests=tests,
        impact=stats.impact_summary(tests),
    )


def save_topic_impact(result: TopicImpact, path: str, fmt: str = "parquet") -> None:
    write_table(result.topic_stats, f"{path}/topic_statistics", fmt)
    write_table(result.keyword_stats, f"{path}/keyword_presence_statistics", fmt)
    write_table(result.tests, f"{path}/topic_impact_test_results", fmt)
