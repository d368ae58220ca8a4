import datetime as dt
import hashlib
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.functions.wordlists import COMPACT_TAXONOMY, ISSUE_TAXONOMY
from revlens.operators import filters, issues, joins, profile, reports
from revlens.operators import quantiles
from revlens.operators.quantiles import exact_quantiles
from tests.conftest import rows


def brute(enriched):
    return [r.asDict() for r in enriched.collect()]


# ------------------------------------------------------------------ quantiles, profile


@pytest.mark.parametrize("partitions", [1, 16])
def test_exact_quantiles_against_numpy(spark, partitions):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=997), "b": np.repeat([1.0, 2.0, 5.0], [400, 1, 77]), "c": np.array([4.5])}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(partitions)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in rows(exact_quantiles(df, ["v"], probs, ["g"]))}
    assert set(got) == {"a", "b", "c"}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, probs)))


@pytest.mark.parametrize("bracket", [1_000_000, 50])
def test_quantiles_of_many_rows_narrow_their_brackets(spark, monkeypatch, bracket):
    monkeypatch.setattr(quantiles, "BRACKET", bracket)
    rng = np.random.default_rng(4)
    wide = np.round(rng.lognormal(sigma=3, size=40_000), 4)
    same = np.r_[np.full(39_000, 7.0), rng.normal(size=1_500)]
    few = rng.normal(size=300)
    groups = {"wide": wide, "same": same, "few": few, None: few[:40]}
    data = [(g, float(v), -float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(6)
    probs = (0.0, 0.001, 0.02, 0.5, 0.75, 0.9999, 1.0)
    got = {(r["g"], r["column"]): [r[f"q{i}"] for i in range(7)] for r in rows(exact_quantiles(df, ["v", "w"], probs, ["g"]))}
    assert set(got) == {(g, c) for g in groups for c in "vw"}
    for g, vs in groups.items():
        assert got[g, "v"] == pytest.approx(list(np.quantile(vs, probs)))
        assert got[g, "w"] == pytest.approx(list(np.quantile(-vs, probs)))


def test_quantiles_read_the_table_twice(spark, tmp_path, monkeypatch):
    """One scan for the sketch and one for the counts, however many columns and probabilities."""
    spark.range(70_000).selectExpr("id % 3 AS g", "cast(id AS double) AS v", "sqrt(id) AS w").write.parquet(str(tmp_path / "t"))
    scans, keep = [], quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda df, name: scans.append(len(df.inputFiles()) > 0 and str(tmp_path) in str(df.inputFiles())) or keep(df, name))
    out = exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["v", "w"], (0.25, 0.5, 0.75), ["g"])
    assert scans == [True, True]
    assert str(tmp_path) not in str(out.inputFiles())
    assert {r["column"]: r["q1"] for r in rows(out) if r["g"] == 0} == pytest.approx({"v": 34999.5, "w": (34998**0.5 + 35001**0.5) / 2})


def test_describe_and_missing(spark, raw):
    out = {r["column"]: r for r in rows(profile.describe_numeric(raw))}
    scores = [r.score for r in raw.collect() if r.score is not None]
    assert out["score"]["count"] == len(scores)
    assert out["score"]["mean"] == pytest.approx(statistics.mean(scores))
    assert out["score"]["std"] == pytest.approx(statistics.stdev(scores))
    missing = {r["column"]: r["missing_count"] for r in rows(profile.missing_values(raw))}
    assert missing["score"] == 1 and missing["review_ts"] == 2 and "review_id" not in missing
    shape = profile.table_shape(raw).first()
    assert (shape.n_rows, shape.n_columns) == (40, 8)
    assert shape.types.split(", ") == [kind for _, kind in raw.dtypes]
    few = rows(profile.first_rows(raw, "review_id"), "place")
    assert [r["review_id"] for r in few] == sorted(r.review_id for r in raw.collect())[:3] and [r["place"] for r in few] == [1, 2, 3]
    assert ("score", "int") in profile.column_types(raw)


# ------------------------------------------------------------------ filters, samples


def test_last_year_includes_first_day_and_clamps(spark):
    days = ["2023-02-27", "2023-02-28", "2023-06-01", "2024-02-29"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days] + [(None,)], "review_date date")
    kept = sorted(str(r[0]) for r in filters.last_year(df).collect())
    assert kept == days[1:]


def test_rating_filter_equals_label_filter(spark, enriched):
    df = spark.createDataFrame([(x,) for x in (None, 1.0, 2.9, 3.0, 3.5, 3.9, 4.0, 5.0)], "score double")
    from revlens.functions.labels import sentiment_label

    df = df.withColumn("sentiment_label", sentiment_label(F.col("score")))
    for label in ("Negative", "Neutral", "Positive"):
        a = filters.filter_rating(df, label).collect()
        assert sorted(map(str, a)) == sorted(map(str, filters.filter_sentiment(df, label).collect()))


def test_response_outliers_keep_negative_delays(enriched):
    days = {r["review_id"]: r["response_days"] for r in rows(filters.response_outliers(enriched))}
    assert days["a06"] == pytest.approx(-1.0) and days["a01"] == 1.0 and "a07" not in days


def rank(key, seed=42):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 50, 4999, 5000, 9000])
def test_seeded_sample_is_exact_and_reproducible(spark, n):
    df = spark.range(5000).select(F.col("id").cast("string").alias("review_id"))
    expected = sorted((str(i) for i in range(5000)), key=lambda k: (rank(k), k))[:n]
    for parts in (1, 7):
        got = [r[0] for r in filters.seeded_sample(df.repartition(parts), n).collect()]
        assert sorted(got) == sorted(expected)
    assert filters.seeded_sample(df, 0).count() == 0
    assert filters.seeded_sample(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("sent", [100_000, 10])
def test_no_class_is_lost_by_the_split(spark, monkeypatch, sent):
    monkeypatch.setattr(filters, "SENT_CLASSES", sent)
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("review_id"), F.when(F.col("id") % 1500 > 0, F.concat(F.lit("c"), F.col("id") % 1500)).alias("sentiment_label")
    )
    counts = filters.stratified_split(df).groupBy("sentiment_label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test"))
    got = {r["sentiment_label"]: (r["n"], r["test"]) for r in counts.collect()}
    assert len(got) == 1500 and got.pop(None) == (20, 0) and set(got.values()) == {(20, 4)}


def test_stratified_split_with_one_dominant_class(spark):
    df = spark.range(6000).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") % 3 > 0, "Negative").when(F.col("id") % 300 == 0, "Neutral").otherwise("Positive").alias("sentiment_label"),
    )
    by_class = {}
    for r in df.collect():
        by_class.setdefault(r.sentiment_label, []).append(r.review_id)
    expected = set()
    for keys in by_class.values():
        expected |= set(sorted(keys, key=lambda k: (rank(k), k))[: int(len(keys) * 0.2 + 0.5)])
    out = filters.stratified_split(df)
    assert out.count() == 6000
    assert {r.review_id for r in out.where("split = 'test'").collect()} == expected
    assert filters.hash_split(df).where("split = 'test'").count() == pytest.approx(1200, rel=0.1)


# ------------------------------------------------------------------ joins


def test_small_side_is_sent_only_within_its_limits(spark):
    big, small = spark.range(100), spark.range(10).withColumn("word", F.lit("w" * 100))
    for limits, sent in (((10_000, 10), True), ((10_000, 9), False), ((500, 10), False)):
        joined = big.join(joins.small_side(small, *limits), "id")
        assert ("broadcast" in joined._jdf.queryExecution().logical().toString()) == sent
        assert joined.count() == 10


def test_merge_predictions_never_multiplies(spark):
    left = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), (None,)], "review_id string")
    right = spark.createDataFrame(
        [("2", "Positive", 0.9), ("2", "Negative", 0.8), ("9", "Neutral", 0.1), (None, "Neutral", 0.2)],
        "review_id string, roberta_sentiment string, roberta_confidence double",
    )
    out = rows(joins.merge_predictions(left, right), "review_id")
    assert len(out) == 5
    assert [r["roberta_sentiment"] for r in out] == [
        "Not Processed", "Negative", "Negative", "Not Processed", "Not Processed",
    ]
    assert out[0]["roberta_confidence"] == 0.0


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccaabbd"] + [(None,)], "v string")
    assert [tuple(r) for r in joins.top_values(df, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert sorted(r[0] for r in joins.top_value_rows(df, "v", 2).collect()) == list("aabb")


# ------------------------------------------------------------------ reports


def test_months_peak_and_ties(spark, enriched):
    months = Counter(r["review_ts"].strftime("%Y-%m") for r in brute(enriched) if r["review_ts"])
    got = {r["month"]: r["reviews"] for r in rows(reports.monthly_volume(enriched))}
    assert got == dict(months)
    peak = reports.peak_months(enriched).first()
    top = max(months.values())
    assert peak.peak_reviews == top and peak.peak_month == min(m for m in months if months[m] == top)
    low = min(months.values())
    assert peak.lowest_month == min(m for m in months if months[m] == low)


def test_shares_add_up(enriched):
    for df in (reports.monthly_sentiment_pct(enriched), reports.version_sentiment(enriched), reports.sentiment_by_response(enriched)):
        for r in rows(df):
            assert r["Negative"] + r["Neutral"] + r["Positive"] == pytest.approx(100)


def test_weekdays_come_in_order_and_complete(enriched):
    out = rows(reports.weekday_sentiment(enriched.where("day_of_week <> 'Sunday'")), "day_number")
    assert [r["day_of_week"] for r in out][0] == "Monday" and len(out) == 7
    assert out[6]["day_of_week"] == "Sunday" and out[6]["Negative"] is None


def test_versions_need_ten_reviews(enriched):
    got = {r["app_version"]: r["review_count"] for r in rows(reports.version_ratings(enriched))}
    assert got == {"13.0": 10}


def test_histogram_counts_everything(spark, enriched):
    out = rows(reports.response_time_histogram(enriched), "bin")
    n = filters.response_outliers(enriched).count()
    assert len(out) == 50 and sum(r["n"] for r in out) == n and out[-1]["n"] >= 1
    same = spark.createDataFrame([(24.0, 1)] * 5, "response_time_hours double, has_reply int")
    flat = rows(reports.response_time_histogram(same), "bin")
    assert sum(r["n"] for r in flat) == 5 and flat[0]["bin_start"] == 0.5


def test_response_time_stats_against_numpy(enriched):
    days = [r["response_days"] for r in rows(filters.response_outliers(enriched))]
    got = reports.response_time_stats(enriched).first()
    assert got.median_days == pytest.approx(float(np.median(days)))
    assert (got.n, got.min_days, got.max_days) == (len(days), min(days), max(days))


def test_group_stats_and_best_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", 5), ("d", 1), ("d", 2), (None, 3)], "g string, score int")
    stats = {r["g"]: r for r in rows(reports.group_rating_stats(df, "g"))}
    assert stats["a"]["std_dev"] == 0.707 and stats["b"]["std_dev"] is None and len(stats) == 4
    best = reports.best_worst_group(df, "g").first()
    assert (best.best_group, best.worst_group, best.rating_gap) == ("b", "a", 3.5)


def test_word_frequencies_merge_plurals_within_a_class(spark):
    df = spark.createDataFrame(
        [("Positive", "dog dogs dogs cats glass 12 app the2"), ("Negative", "cat cat cats 99 bus x")],
        "sentiment_label string, content_clean_nostop string",
    )
    out = {(r["sentiment_label"], r["word"]): r for r in rows(reports.word_frequencies(df))}
    assert out[("Positive", "dog")]["n"] == 3 and out[("Positive", "dog")]["weight"] == 1.0
    assert ("Positive", "cats") in out and ("Negative", "cats") not in out and out[("Negative", "cat")]["n"] == 3
    assert not {("Positive", "12"), ("Positive", "app"), ("Negative", "x")} & set(out)


def test_results_do_not_depend_on_partitioning(enriched):
    one, many = enriched.repartition(1), enriched.repartition(16)
    for f in (
        reports.rating_summary,
        reports.peak_months,
        lambda d: reports.value_counts(d, "app_version", 5),
        lambda d: issues.issue_breakdown(d),
        lambda d: reports.word_frequencies(d),
    ):
        key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert key(f(one)) == key(f(many))


# ------------------------------------------------------------------ issues


def issues_by_hand(data, taxonomy):
    negative = [r for r in data if r["sentiment_label"] == "Negative"]
    out = {}
    for name, words in taxonomy.items():
        hits = [r for r in negative if any(w in r["content_clean_nostop"] for w in words)]
        first = min(hits, key=lambda r: r["review_id"])["content"][:150] + "..." if hits else "N/A"
        out[name] = (len(hits), 100 * len(hits) / len(negative), first)
    return out


def test_issue_breakdown_against_loops(enriched):
    data = [r for r in brute(enriched) if r["review_id"] != "a16"]
    df = enriched.where("review_id <> 'a16'")
    got = {r["issue"]: (r["mentions"], r["percentage"], r["example"]) for r in rows(issues.issue_breakdown(df))}
    expected = issues_by_hand(data, ISSUE_TAXONOMY)
    assert set(got) == set(expected)
    for name in expected:
        assert got[name][0] == expected[name][0] and got[name][2] == expected[name][2]
        assert got[name][1] == pytest.approx(expected[name][1])


def test_a_large_taxonomy_counts_like_loops(spark, enriched):
    many = {f"c{i}": [w] for i, w in enumerate(["app", "slow", "login", "crash", "the", *[f"none{k}" for k in range(95)]])}
    got = {r["category"]: r["mentions"] for r in rows(issues.category_mentions(enriched, many, "content_clean"))}
    held = [r["content_clean"] or "" for r in rows(enriched)]
    assert got == {c: sum(words[0] in t for t in held) for c, words in many.items()}


def test_dominant_issue_is_a_row_of_version_issues(enriched):
    table = issues.version_issues(enriched)
    all_rows = {(r["version"], r["issue"]): r for r in rows(table)}
    for r in rows(issues.dominant_issue(table)):
        top = max(v["percentage"] for (version, _), v in all_rows.items() if version == r["version"])
        assert all_rows[(r["version"], r["issue"])]["percentage"] == top == r["percentage"]
    matrix = rows(issues.version_issue_matrix(table))
    assert set(matrix[0]) == {"version", *ISSUE_TAXONOMY}


def test_negative_by_version(enriched):
    df = enriched.withColumn("model", F.col("sentiment_label"))
    got = [tuple(r) for r in reports.negative_by_version(df, "model", 3).collect()]
    assert got == sorted(got, key=lambda r: (-r[1], r[0])) and len(got) == 3
