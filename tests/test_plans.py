"""The three whole analyses, one after the other, over the fixture reviews."""

import pytest
from pyspark.sql import functions as F

from revlens import session
from revlens.operators import classify
from revlens.plans import analysis
from revlens.sources import sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("analysis"))


@pytest.fixture(scope="module")
def analysed(spark, raw, folder):
    words = spark.createDataFrame(
        [("great", 3.1, 0.75), ("love", 3.2, 0.6), ("slow", -1.5, 0.4), ("crash", -1.7, 0.1)],
        "term string, polarity double, subjectivity double",
    )
    one_each = raw.dropDuplicates(["review_id"])
    trainers = {"Naive Bayes": classify.naive_bayes(), "Logistic Regression": classify.logistic_regression(20)}
    return analysis.analyse_reviews(
        one_each, folder, words, words.withColumn("polarity", F.col("polarity") / 4), trainers,
        k=2, n_words=3, min_df=1, max_df=1.0, max_iter=3,
    )


def test_analysis_writes_every_report(spark, analysed, folder):
    assert analysed["summary"].first()["reviews"] == 39
    assert analysed["issues"].count() == 15
    assert {r["method"] for r in analysed["method_accuracy"].collect()} == {"vader_sentiment", "textblob_sentiment"}
    assert sinks.read_table(spark, f"{folder}/topics/topic_impact_test_results").count() <= 2
    assert sinks.load_model_results(spark, f"{folder}/models")[1].count() == 2


def test_scoring_voting_and_dashboards(spark, analysed, folder):
    reviews = sinks.read_table(spark, f"{folder}/reviews")

    def make():
        return lambda texts: [("positive" if "love" in t else "negative", 0.8) for t in texts]

    voted = analysis.score_and_vote(reviews, f"{folder}/voted", {"roberta": make, "bert": make})
    assert voted.count() == 39 and voted.where("ensemble_sentiment = 'Positive'").count() >= 9
    compared = {n: f.count() for n, f in analysis.comparison_frames(voted).items()}
    assert compared["accuracy"] == 5 and compared["confusion"] == 45 and compared["roberta_report"] == 6
    frames = analysis.dashboard_frames(voted, model_path=f"{folder}/models")
    counts = {n: f.count() for n, f in frames.items()}
    assert counts["trends/weekdays"] == 7 and counts["models/best"] == 1 and counts["models/confusion"] == 9
    assert counts["responses/histogram"] == 50 and counts["issues/compact"] == 7 and len(frames) == 29


def test_rating_filter_reaches_the_parquet_scan(spark, analysed, folder):
    from revlens.operators.filters import filter_rating

    reviews = sinks.read_table(spark, f"{folder}/reviews")
    plan = filter_rating(reviews, "Negative").select("review_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "LessThan(score,4)" in pushed and "content" not in plan[plan.index("ReadSchema") :]


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.ensure_checkpoint_dir(spark) == session.shared_folder(spark) == named
