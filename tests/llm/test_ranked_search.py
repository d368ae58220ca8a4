"""Ranked search against scores computed by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from revlens.llm import ranked_search
from tests.llm.helpers import ODD, documents, prose, with_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(texts, items, best=50):
    counted = [(d, Counter(cut(t))) for d, t in texts if cut(t)]
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for i, text in items:
        scores = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * len(counted) // total
            w = {t: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) for t in set(cut(text)) if t in c}
            scores.append((sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w), d))
        top = sorted((-s, d is None, d or 0, d) for s, d in scores if s > 0)[:best]
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(top)]
    return out


def search(spark, docs, items, **more):
    query = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as body", "2 as doc_id")
    return sorted((tuple(r) for r in ranked_search.ranked(docs, query, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus():
    texts = [prose(k, 5 + k % 90, pool=300) for k in range(400)]
    texts += [texts[3]] * 70 + ["w1 " * 3000, "W1, w2; (w3) é-É w1"] + ODD  # ties beyond the last rank; a very long text
    items = [(k, prose(1000 + k, 3 + 4 * k, pool=350)) for k in range(40)]  # up to 150 terms
    return texts, items + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 W1 É"), (94, texts[3])]


def test_ranks_equal_brute_force(spark):
    texts, items = corpus()
    docs = documents(spark, texts, clash=True).repartition(5)
    want = sorted(by_hand(list(enumerate(texts)), items), key=str)
    assert search(spark, docs, items) == want
    assert search(spark, docs, items, block=1500) == want
    assert search(spark, docs, items, best=3) == sorted(by_hand(list(enumerate(texts)), items, 3), key=str)


def test_groups_hold_equal_masks():
    r = np.random.default_rng(1)
    for terms in (1, 8, 63, 64, 65, 200):
        present = r.random((terms, 300)) < 0.02
        group, example = ranked_search.masks_of(present)
        assert (present[:, example[group]] == present).all()
        assert len(example) == len(np.unique(present, axis=1).T)


def test_few_groups_are_scored(spark, monkeypatch):
    """Documents in groups below the last rank so far are never scored."""
    r = random.Random(5)
    scored = []
    add = ranked_search.Ranking.add
    monkeypatch.setattr(ranked_search.Ranking, "add", lambda self, s, i, m: (scored.append(len(s)), add(self, s, i, m)))
    rows = [(d, ["rare"] * (d < 60) + ["common"] * (d % 2) + ["x"] * r.randint(1, 40)) for d in range(2000)]
    items = ranked_search.Items([(1, [b"common", b"rare"])])
    counts = [Counter(w) for _, w in rows]
    number = {"common": 0, "rare": 1}
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(w) for _, w in rows], pa.int64()),
            pa.array([[number[t] for t in c if t in number] for c in counts], pa.list_(pa.int32())),
            pa.array([[c[t] for t in c if t in number] for c in counts], pa.list_(pa.int64())),
        ],
        names=["doc_id", "n", "terms", "counts"],
    )
    weights = np.array([math.floor(1000 * math.log(4002 / (2 * n + 1))) for n in (1000, 60)])
    ranking = ranked_search.Ranking(50)
    ranked_search.Batch(batch, weights, 2000, sum(len(w) for _, w in rows)).search(items.terms[0], ranking)
    assert len(ranking.scores) == 50 and sum(scored) <= 60
    assert set(ranking.ids) <= set(range(60))


def test_repeated_and_null_ids_and_empty_tables(spark):
    docs = with_rows(documents(spark, ["w1 w2", "w3"]), [(None, "w1 w2"), (0, "w1 w2"), (None, "w9")])
    items = [(1, "w1"), (1, "w3"), (None, "w2 w9")]
    rows = [(0, "w1 w2"), (1, "w3"), (None, "w1 w2"), (0, "w1 w2"), (None, "w9")]
    assert search(spark, docs, items) == sorted(by_hand(rows, items), key=str)
    assert search(spark, documents(spark, []), items) == []
    assert search(spark, docs, []) == []
