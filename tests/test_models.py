import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from catalog import queries
from revlens.learners.blocks import Sparse, packed
from revlens.operators import classify, ensemble, evaluate, features, filters, lexicon, scoring, stats, topics
from revlens.plans.topic_impact import save_topic_impact, topic_impact
from revlens.sources import sinks
from tests.conftest import rows

LEX = [("good", 1.9, 0.6), ("bad", -2.5, 0.7), ("love", 3.2, 0.6), ("awful", -2.0, 1.0)]


def lex(spark):
    return spark.createDataFrame(LEX, "term string, polarity double, subjectivity double")


def compound(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, content_clean string")
    out = rows(lexicon.lexicon_compound(df, lex(spark)))
    return [r["vader_compound"] for r in sorted(out, key=lambda r: int(r["review_id"]))]


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_compound_rules(spark):
    cases = {
        "": 0.0,
        "nothing here": 0.0,
        "good": norm(1.9),
        "very good": norm(1.9 + 0.293),
        "slightly bad": norm(-2.5 + 0.293),
        "very very good": norm(1.9 + 0.293 + 0.293 * 0.95),
        "not good": norm(1.9 * -0.74),
        "not very good": norm((1.9 + 0.293) * -0.74),
        "never so good": norm((1.9 + 0.293) * 1.5),
        "not a very good": norm(((1.9 + 0.293) * -0.74)),
        "least good": norm(1.9 * -0.74),
        "at least good": norm(1.9),
        "good but awful": norm(1.9 * 0.5 - 2.0 * 1.5),
        "good!!": norm(1.9 + 2 * 0.292),
        "bad!!!!!!": norm(-2.5 - 4 * 0.292),
        "good??": norm(1.9 + 0.36),
        "good?????": norm(1.9 + 0.96),
        "good, good.": norm(3.8),
    }
    assert compound(spark, *cases) == pytest.approx(list(cases.values()))


def test_a_modifier_listed_in_the_lexicon_does_not_modify(spark):
    df = spark.createDataFrame([("1", "not good")], "review_id string, content_clean string")
    words = spark.createDataFrame([("good", 1.9), ("not", -1.0), ("good", 1.9)], "term string, polarity double")
    assert lexicon.lexicon_compound(df, words).first()["vader_compound"] == norm(0.9)


def test_polarity(spark):
    df = spark.createDataFrame([("1", "good bad x"), ("2", ""), ("3", "awful!")], "review_id string, content_clean string")
    out = rows(lexicon.lexicon_polarity(df, lex(spark)), "review_id")
    assert out[0]["textblob_polarity"] == pytest.approx(-0.3) and out[0]["textblob_subjectivity"] == pytest.approx(0.65)
    assert [r["textblob_sentiment"] for r in out] == ["Negative", "Neutral", "Negative"]


def test_dictionary_lemmas(spark):
    df = spark.createDataFrame([("1", ["mice", "ran", "mice"]), ("2", ["plain"]), ("3", [])], "review_id string, tokens_nostop array<string>")
    words = spark.createDataFrame([("mice", "mouse"), ("ran", "run"), ("x", "x")], "form string, lemma string")
    out = rows(lexicon.lemmatize(df, words), "review_id")
    assert [r["content_lemmatized"] for r in out] == ["mouse run mouse", "plain", ""]


# ------------------------------------------------------------------ scoring, ensemble


def test_scoring_batches_failures_and_missing_text(spark):
    def make():
        def score(texts):
            assert len(texts) <= 4
            if any("boom" in t for t in texts):
                raise RuntimeError("model failed")
            return [("POSITIVE" if "good" in t else "negative", 0.9) for t in texts]

        return score

    texts = ["good one"] * 5 + [None, ""] + ["dull"] * 3 + ["boom"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content_clean string").coalesce(1)
    out = rows(scoring.score_batches(df, make, batch_size=4), "i")
    labels = [r["roberta_sentiment"] for r in out]
    assert labels == ["Positive"] * 5 + ["Not Processed"] * 2 + ["Negative"] * 3 + ["Neutral"]
    assert out[-1]["roberta_confidence"] == 0.5 and out[5]["roberta_confidence"] == 0.0


def test_softmax_scorer():
    scorer = scoring.softmax_scorer(lambda t: np.array([[0.0, 0.0, math.log(2)]] * len(t)), ["a", "b", "c"])
    assert scorer(["x"]) == [("c", pytest.approx(0.5))]


def test_ensemble_truth_table(spark):
    values = ["Negative", "Neutral", "Positive", "Not Processed", None]
    names = ["vader_sentiment", "textblob_sentiment", "roberta_sentiment", "bert_sentiment"]
    data = list(itertools.product(values, repeat=4))
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    vote = {"Negative": -1, "Positive": 1}
    for r in rows(ensemble.ensemble_sentiment(df)):
        score = sum(w * vote.get(r[n], 0) for w, n in zip((0.15, 0.15, 0.35, 0.35), names))
        assert r["ensemble_score"] == pytest.approx(score)
        if abs(abs(score) - 0.2) > 1e-9:
            assert r["ensemble_sentiment"] == ("Positive" if score > 0.2 else "Negative" if score < -0.2 else "Neutral")


def test_ensemble_with_fewer_methods(spark):
    two = spark.createDataFrame([("Positive", "Negative")], "vader_sentiment string, bert_sentiment string")
    row = ensemble.ensemble_sentiment(two).first()
    assert row.ensemble_score == pytest.approx((0.15 - 0.35) / 0.5) and row.ensemble_sentiment == "Negative"
    one = ensemble.ensemble_sentiment(two.select("bert_sentiment")).first()
    assert (one.ensemble_sentiment, one.ensemble_score) == ("Negative", 0)
    none = ensemble.ensemble_sentiment(spark.range(1)).first()
    assert none.ensemble_sentiment == "Not Available"


def test_evaluation_invariants(spark):
    data = [("Negative", "Negative"), ("Negative", "Positive"), ("Positive", "Positive"), ("Positive", None), ("Neutral", "Negative")]
    df = spark.createDataFrame(data, "sentiment_label string, prediction string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in rows(evaluate.confusion_matrix(df))}
    assert len(cells) == 9 and cells[("Negative", "Positive")] == 1 and cells[("Neutral", "Neutral")] == 0
    scores = {r["label"]: r for r in rows(evaluate.classification_report(df))}
    assert scores["Neutral"]["precision"] == 0 and scores["Negative"]["recall"] == 0.5
    prf = evaluate.weighted_prf(df).first()
    assert prf.recall == pytest.approx(prf.accuracy) == pytest.approx(0.4)
    assert scores["weighted avg"]["f1"] == pytest.approx(prf.f1_score) and scores["accuracy"]["f1"] == prf.accuracy
    methods = rows(evaluate.method_confusion(df, ["prediction"]))
    assert sum(r["n"] for r in methods) == 4


# ------------------------------------------------------------------ features


def test_term_counts_and_tfidf_by_hand(spark):
    docs = ["red fox red fox", "red hen", "", "a fox hen hen", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "review_id int, t string")
    grams = []
    for d in docs:
        w = [x for x in (d or "").split() if len(x) > 1]
        grams.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    counts = {r["term"]: (r["tf"], r["df"]) for r in rows(features.term_counts(df, "t"))}
    expected = {t: (sum(g.count(t) for g in grams), sum(t in g for g in grams)) for g in grams for t in g}
    assert counts == expected

    model = features.fit_tfidf(df, "t", max_features=50)
    terms = features.terms_of(model)
    assert terms == [t for t, _ in sorted(expected.items(), key=lambda x: (-x[1][0], x[0]))]
    got = {(r["review_id"], r["term"]): r["weight"] for r in rows(features.tfidf_terms(model.transform(df), terms))}
    for i, g in enumerate(grams):
        raw = {t: g.count(t) * (math.log(6 / (1 + expected[t][1])) + 1) for t in g}
        length = math.sqrt(sum(v * v for v in raw.values())) or 1
        for t, v in raw.items():
            assert got.pop((i, t)) == pytest.approx(v / length)
    assert not got


def test_vocabulary_bounds(spark):
    df = spark.createDataFrame([("aa bb cc",), ("aa bb",), ("aa",), ("aa dd",)], "t string")
    words = [r["term"] for r in features.vocabulary(df, "t", 10, min_df=2, max_df=0.7, pairs=False).collect()]
    assert words == ["bb"]
    with pytest.raises(ValueError):
        features.fit_tfidf(df, "t", min_df=9)


@pytest.mark.parametrize("buckets,looked_into", [(1 << 18, 2), (50, 1), (3, 1), (400, 1)])
def test_vocabulary_is_exact_whatever_the_buckets(spark, monkeypatch, buckets, looked_into):
    monkeypatch.setattr(features, "BUCKETS", buckets)
    monkeypatch.setattr(features, "LOOKED_INTO", looked_into)
    rng = np.random.default_rng(7)
    docs = [" ".join(f"w{int(k)}" for k in rng.zipf(1.4, 30) if k < 5000) for _ in range(200)]
    df = spark.createDataFrame([(d,) for d in docs], "t string")
    tf, seen = Counter(), Counter()
    for d in docs:
        w = d.split()
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        tf.update(grams)
        seen.update(set(grams))
    for most, low, high in ((20, 1, 1.0), (20, 5, 0.5), (10_000, 3, 1.0)):
        wanted = sorted((t for t in tf if low <= seen[t] <= high * len(docs)), key=lambda t: (-tf[t], t))[:most]
        got = features.vocabulary(df, "t", most, low, high).orderBy(F.desc("tf"), "term").collect()
        assert [(r["term"], r["tf"], r["df"]) for r in got] == [(t, tf[t], seen[t]) for t in wanted]


@pytest.mark.parametrize("pairs", [True, False])
def test_term_counts_are_those_of_the_grams_column(spark, monkeypatch, pairs):
    monkeypatch.setattr(features, "TERMS", 5)
    monkeypatch.setattr(features, "ROWS", 2)
    texts = ["Ab ab a cd_9 x", "\u212aing ÄBC été İx", "", None, "one", "z" * 40 + " aa\taa\naa", "x y z", "ab-ab.ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    found = [r.g for r in df.select(features.grams("t", pairs).alias("g")).collect()]
    tf, seen = Counter(t for g in found for t in g), Counter(t for g in found for t in set(g))
    assert {r["term"]: (r["tf"], r["df"]) for r in rows(features.term_counts(df, "t", pairs))} == {t: (tf[t], seen[t]) for t in tf}
    sizes = {r["bucket"]: r["size"] for r in rows(features.bucket_sizes(df, "t", pairs))}
    want = Counter()
    for t, n in tf.items():
        want[crc32(t.encode()) % features.BUCKETS] += n
    assert sizes == want


def test_topic_texts_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def lemma(text):
        made.add(1)
        return text

    groups, data = [[f"word{chr(97 + g)}{chr(97 + k)}" for k in range(12)] for g in range(6)], np.random.default_rng(2)
    texts = [(k, " ".join(data.choice(groups[k % 6], 20))) for k in range(90)]
    monkeypatch.setattr(queries, "lemmatized", lambda spark, sf_dir: spark.createDataFrame(texts, "doc_id long, t string").withColumn("content_lemmatized", lemma("t")))
    out = queries.topic_term_checks(spark, "").collect()
    assert made.value == len(texts)
    assert sorted((r["model"], r["topic"], r["listed"], r["known"], r["falling"]) for r in out) == [(m, k, 10, 10, True) for m in ("lda", "nmf") for k in range(5)]


def planted(spark, n=120):
    rng = np.random.default_rng(1)
    groups = [["apple", "pear", "plum", "grape"], ["wheel", "brake", "motor", "clutch"]]
    data = [(str(i), " ".join(rng.choice(groups[i % 2], size=12)), i % 2) for i in range(n)]
    return spark.createDataFrame([*data, ("empty", "", 2)], "review_id string, t string, side int")


def purity(pairs):
    frame = pd.DataFrame(pairs, columns=["side", "topic"])
    return frame.groupby("topic")["side"].agg(lambda s: s.value_counts().iloc[0]).sum() / len(frame)


def test_lda_finds_planted_topics(spark):
    df = planted(spark)
    model = features.fit_tfidf(df, "t", pairs=False)
    vectors = model.transform(df).persist()
    lda = topics.fit_lda(vectors, k=2, max_iter=30)
    out = rows(topics.dominant_topic(lda, vectors))
    assert [r["dominant_topic"] for r in out if r["review_id"] == "empty"] == [None]
    assert purity([(r["side"], r["dominant_topic"]) for r in out if r["review_id"] != "empty"]) > 0.95
    words = topics.topic_keywords(topics.lda_topic_terms(lda, features.terms_of(model), 4))
    assert {frozenset(w) for w in words.values()} == {
        frozenset(["apple", "pear", "plum", "grape"]), frozenset(["wheel", "brake", "motor", "clutch"]),
    }


def test_nmf_finds_planted_topics_and_loss_falls(spark):
    df = planted(spark)
    model = features.fit_tfidf(df, "t", pairs=False)
    vectors = model.transform(df).repartition(5)
    nmf = topics.fit_nmf(vectors, len(features.terms_of(model)), k=2, max_iter=40)
    assert all(b <= a + 1e-9 for a, b in zip(nmf.losses, nmf.losses[1:]))
    assert (nmf.components >= 0).all()
    side = {r["review_id"]: r["side"] for r in rows(df)}
    out = rows(topics.nmf_dominant_topic(nmf, vectors))
    assert len(out) == 120 and purity([(side[r["review_id"]], r["topic"]) for r in out]) > 0.95
    assert topics.NMFModel.topic_terms(nmf, spark, features.terms_of(model), 3).count() == 6


# ------------------------------------------------------------------ statistics


def test_t_distribution_against_published_values(spark):
    table = [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e6, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0), (2.0, 2, 0.18350)]
    df = spark.createDataFrame([(float(t), float(n), p) for t, n, p in table], "t double, n double, p double")
    for r in df.withColumn("got", stats.t_two_sided("t", "n")).collect():
        assert r.got == pytest.approx(r.p, abs=2e-4)
    tiny = stats.incomplete_beta(np.array([50.0]), np.array([0.5]), np.array([100 / (100 + 40.0**2)]))
    assert 0 < tiny[0] < 1e-50


def topic_data(spark):
    data = [("slow login", 1), ("slow", 2), ("nice", 5), ("login nice", 4), ("ok", 3), ("ok slow", 1), (None, 3)]
    return spark.createDataFrame(data, "content_clean string, score int")


TOPICS = {0: ["slow", "lag"], 1: ["login"], 2: ["nothing"], 3: ["nice"]}


def test_keyword_presence_invariants_and_welch(spark):
    df = topic_data(spark)
    for r in rows(stats.keyword_presence(df, TOPICS)):
        assert r["with_keywords_count"] + r["without_keywords_count"] == 7
        stars = (r["with_keywords_avg"] or 0) * r["with_keywords_count"]
        assert stars + r["without_keywords_avg"] * r["without_keywords_count"] == pytest.approx(19)
    tests = {r["topic_id"]: r for r in rows(stats.topic_ttest(df, TOPICS))}
    assert set(tests) == {0, 1, 3}
    a, b = np.array([1, 2, 1.0]), np.array([5, 4, 3, 3.0])
    va, vb = a.var(ddof=1) / 3, b.var(ddof=1) / 4
    assert tests[0]["t_statistic"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    pooled = math.sqrt((2 * a.var(ddof=1) + 3 * b.var(ddof=1)) / 5)
    assert tests[0]["cohens_d"] == pytest.approx((a.mean() - b.mean()) / pooled)
    assert tests[0]["impact"] == "NEGATIVE" and 0 < tests[0]["p_value"] < 0.05
    summary = [r["topic_id"] for r in stats.impact_summary(stats.topic_ttest(df, TOPICS)).collect()]
    assert summary[0] in (0, 3)


def sparse_table(spark, x, parts=3):
    rows = [(k, Vectors.sparse(len(v), np.flatnonzero(v).tolist(), v[v != 0].tolist())) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, ["review_id", "features"]).repartition(parts)


def low_rank(seed, rows=120, width=40, rank=4):
    r = np.random.default_rng(seed)
    x = r.gamma(0.3, size=(rows, rank)) @ (r.gamma(0.5, size=(rank, width)) * (r.random((rank, width)) < 0.4))
    return np.where(x < 0.05, 0, x) + (r.random(x.shape) < 0.05)


def test_digamma_by_known_values():
    got = topics.digamma(np.array([1.0, 0.2, 0.5, 10.0, 1e6]))
    assert got == pytest.approx([-0.5772156649015329, -5.289039896592188, -1.9635100260214235, 2.2517525890667214, math.log(1e6) - 5e-7], rel=1e-9)


def test_lda_reads_every_review_once_a_pass(spark):
    df = planted(spark, 90)
    vectors = features.fit_tfidf(df, "t", pairs=False).transform(df)
    known = sum(r["features"].numNonzeros() > 0 for r in vectors.collect())
    for share in (1.0, 0.25, 0.07):
        assert topics.fit_lda(vectors, k=2, max_iter=3, batch_share=share).read == [known] * 3
    again = [topics.fit_lda(vectors, k=2, max_iter=2).components for _ in range(2)]
    assert np.allclose(*again)


def test_an_lda_update_reads_its_own_reviews_only(spark, monkeypatch):
    df = planted(spark, 90)
    vectors = features.fit_tfidf(df, "t", pairs=False).transform(df)
    given, total = [], topics.total

    def counted(blocks, f):
        given.append(blocks.rdd.map(len).sum())
        return total(blocks, f)

    monkeypatch.setattr(topics, "total", counted)
    model = topics.fit_lda(vectors, k=2, max_iter=2)
    # one look at all of them for the sizes of the mini-batches, then each review once a pass
    assert sum(given[1:]) == sum(model.read) == 2 * given[0] and max(given[1:]) < given[0]


def test_lda_shares_of_a_review_stand_still():
    """The parameters of a review satisfy their own equation."""
    r = np.random.default_rng(2)
    beta, x = r.dirichlet(np.ones(9), 3), r.poisson(2.0, (20, 9)).astype(float)
    x[4] = 0
    row, index = np.nonzero(x)
    rows = Sparse(np.r_[0, np.cumsum((x > 0).sum(axis=1))], index, x[row, index], 9)
    gamma = topics.document_topics(rows, beta, 0.5)
    e = topics._expected(gamma)
    want = 0.5 + e * ((x / np.maximum(e @ beta, 1e-100)) @ beta.T)
    full = x.sum(axis=1) > 0
    assert np.abs(gamma - want)[full].mean() < 2e-3 and (gamma[4] == 1).all()


def test_singular_vectors_equal_numpy(spark):
    x = low_rank(5)
    blocks = packed(sparse_table(spark, x), ["features"], [40], "review_id", label=None)
    sizes, v = topics.singular_vectors(blocks, 40, 4)
    _, s, vt = np.linalg.svd(x)
    assert sizes == pytest.approx(s[:4], rel=1e-6)
    assert np.allclose(np.abs((v * vt[:4]).sum(axis=1)), 1, atol=1e-6)


def test_nmf_starts_from_singular_vectors(spark):
    x = low_rank(6)
    vectors = sparse_table(spark, x)
    blocks = packed(vectors, ["features"], [40], "review_id", label=None)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = np.zeros((4, 40))
    want[0] = np.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, 4):
        best = max(((np.linalg.norm(a) * np.linalg.norm(b), b / np.linalg.norm(b)) for a, b in ((np.maximum(u[:, j], 0), np.maximum(vt[j], 0)), (np.maximum(-u[:, j], 0), np.maximum(-vt[j], 0)))), key=lambda p: p[0])
        want[j] = np.sqrt(s[j] * best[0]) * best[1]
    want[want < 1e-12] = x.mean()
    assert np.allclose(topics.nndsvda(blocks, 40, 4), want, atol=1e-6)
    start, random = (topics.fit_nmf(vectors, 40, 4, max_iter=3, tol=0.0, start=s).losses for s in ("nndsvda", "random"))
    assert all(a < b for a, b in zip(start, random))
    with pytest.raises(ValueError, match="start"):
        topics.fit_nmf(vectors, 40, 4, start="zero")


def test_topics_of_no_rows(spark):
    empty = sparse_table(spark, np.zeros((3, 5)))
    assert topics.fit_nmf(empty, 5, 2).losses == [] and topics.fit_lda(empty, 2).read == []
    assert [r["dominant_topic"] for r in topics.dominant_topic(topics.fit_lda(empty, 2), empty).collect()] == [None] * 3
    assert topics.nmf_dominant_topic(topics.fit_nmf(empty, 5, 2), empty).collect() == []


def test_moments_of_many_topics_far_from_zero(spark):
    r = np.random.default_rng(3)
    topics = {i: [f"k{i:02d}"] for i in range(60)}
    texts = [" ".join(f"k{i:02d}" for i in range(60) if r.random() < 0.3) for _ in range(1000)]
    y = 1e9 + r.integers(0, 4, 1000) / 1000
    df = spark.createDataFrame([(t, float(v)) for t, v in zip(texts, y)], "content_clean string, score double")
    got = {m["topic_id"]: m for m in rows(stats.topic_moments(df, topics))}
    assert len(got) == 60
    for i, (word,) in topics.items():
        hit = np.array([word in t for t in texts])
        for side, mine in (("with", y[hit]), ("without", y[~hit])):
            assert got[i][f"{side}_rows"] == got[i][f"{side}_n"] == len(mine)
            assert got[i][f"{side}_avg"] == pytest.approx(mine.mean(), rel=1e-15)
            assert got[i][f"{side}_var"] == pytest.approx((mine - 1e9).var(ddof=1), rel=1e-3)


def test_constant_groups_have_no_effect(spark):
    df = spark.createDataFrame([("x", 3), ("x", 3), ("y", 3), ("y", 3)], "content_clean string, score int")
    row = stats.topic_ttest(df, {0: ["x"]}).first()
    assert row.t_statistic is None and row.p_value is None and row.cohens_d == 0 and not row.is_significant


def test_topic_impact_and_saving(spark, enriched, tmp_path):
    docs = planted(spark).where("side < 2")
    df = docs.select(
        "review_id", F.col("t").alias("content_clean"), F.col("t").alias("content_lemmatized"),
        F.when(F.col("side") == 0, 1 + F.col("review_id").cast("int") % 4 / 2).otherwise(5 - F.col("review_id").cast("int") % 3).cast("int").alias("score"),
    ).persist()
    result = topic_impact(df, k=2, n_words=3, max_iter=10)
    assert result.assigned.count() == 120
    assert {r["impact"] for r in rows(result.impact)} == {"NEGATIVE", "POSITIVE"}
    save_topic_impact(result, str(tmp_path))
    assert sinks.read_table(spark, f"{tmp_path}/topic_statistics").count() == 2
    charts = stats.impact_chart_frames(result.tests)
    assert {n: f.count() for n, f in charts.items()} == {"by_mean": 2, "by_p": 2, "by_d": 2, "group_sizes": 2}


# ------------------------------------------------------------------ classifiers


def test_classifiers_learn_and_survive_saving(spark, tmp_path):
    df = planted(spark, 200).where("side < 2").select(
        "review_id", F.col("t").alias("content_clean"),
        F.when(F.col("side") == 0, "Negative").otherwise("Positive").alias("sentiment_label"),
    ).persist()
    trainers = {
        "Logistic Regression": classify.logistic_regression(30),
        "Random Forest": classify.random_forest(5, 4),
        "SVM": classify.linear_svm(200),
        "Naive Bayes": classify.naive_bayes(),
        "Gradient Boosting": classify.gradient_boosting(3),
    }
    models, metrics, predictions = classify.train_models(df, trainers, folds=2)
    table = {r["model"]: r for r in rows(metrics)}
    assert set(table) == set(trainers) and all(r["f1_score"] > 0.9 for r in table.values())
    for r in table.values():
        assert len(r["cv_scores"]) == 2 and r["cv_mean"] == pytest.approx(sum(r["cv_scores"]) / 2)
    # what is returned reads written tables only, not the texts again
    assert "LocalTableScan" not in predictions._jdf.queryExecution().optimizedPlan().toString()
    assert predictions.count() == 5 * 40
    assert classify.best_model(metrics).first()["f1_score"] == max(r["f1_score"] for r in table.values())
    keep = {"Naive Bayes": models["Naive Bayes"]}
    sinks.save_model_results(str(tmp_path), keep, metrics, predictions)
    loaded, again = sinks.load_model_results(spark, str(tmp_path), ("Naive Bayes",))
    assert again.count() == 5 and sinks.load_predictions(spark, str(tmp_path)).count() == 200
    text = spark.createDataFrame([("apple pear plum",), ("wheel brake",)], "content_clean string")
    assert [r.predicted_label for r in loaded["Naive Bayes"].transform(text).collect()] == ["Negative", "Positive"]


def test_cross_validation(spark):
    df = planted(spark).where("side < 2").select(
        "review_id", F.col("t").alias("content_clean"),
        F.when(F.col("side") == 0, "Negative").otherwise("Positive").alias("sentiment_label"),
    ).persist()
    scores = classify.cross_validate(df, {"Naive Bayes": classify.naive_bayes()}, folds=3)
    row = classify.cv_summary(scores).first()
    assert len(row.cv_scores) == 3 and row.cv_mean > 0.95


def test_stratified_folds_spread_every_class(spark):
    df = spark.range(1003).select(
        F.col("id").cast("string").alias("review_id"), F.when(F.col("id") < 13, "rare").when(F.col("id") < 1000, "common").alias("sentiment_label")
    )
    counts = filters.stratified_folds(df, folds=5).groupBy("sentiment_label", "fold").count().collect()
    got = {(r.sentiment_label, r.fold): r["count"] for r in counts}
    assert {got[("rare", k)] for k in range(5)} == {2, 3} and {got[("common", k)] for k in range(5)} <= {197, 198}
    assert got[(None, 0)] == 3 and len(got) == 11
    few = filters.stratified_folds(df.where("sentiment_label = 'rare'").limit(2), folds=5)
    assert few.count() == 2


def test_the_registered_training_has_cross_validation(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "labelled", lambda spark, sf_dir: None)
    monkeypatch.setattr(classify, "train_models", lambda df, *args, **kwargs: asked.append((args, kwargs)) or (None, "metrics", None))
    assert queries.train_models(spark, "") == "metrics"
    assert asked == [((), {})]  # the operator's own folds
