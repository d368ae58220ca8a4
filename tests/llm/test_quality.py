"""Perplexity bands: the measured numbers by brute force, the model by its definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from revlens.llm import perplexity as X
from revlens.llm.common import keyed_texts
from tests.llm.helpers import ODD, collected, documents, with_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            inside.update(range(k, k + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside), failed


def sentences(seed, n, syllables):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    clean = sentences(1, 120, ["the", "an", "er", "ti", "on", "re"]) + sentences(2, 60, ["eau", "ou", "le", "ch", "é"])
    junk = [" ".join(w + s for w, s in zip(t.split(), "#&%$" * 40)) for t in sentences(1, 6, ["qx", "zv", "jk"])]
    looped = ["one two three four five six seven eight nine ten " * 8]
    repeats = ["line here\n" * 5 + sentences(1, 1, ["the", "an", "er", "ti", "on", "re"])[0]]
    texts = clean + junk + looped + repeats + ODD
    langs = ["en"] * 120 + ["fr"] * 60 + ["en"] * (len(texts) - 180 - 1) + [None]
    return texts, langs


def test_numbers_and_verdicts(spark, corpus):
    texts, langs = corpus
    got = collected(X.quality(documents(spark, texts, clash=True, langs=langs).drop("score")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(r[n] for n in names) for r in got] == [by_hand(t) for t in texts]
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert sum(r["kept"] for r in got[:180]) >= 176
    assert not any(r["kept"] for r in got[180:186])


def test_probabilities_after_a_context_sum_to_one(spark):
    docs = documents(spark, sentences(4, 40, ["ab", "ba", "cab"]))
    model = X.fit(keyed_texts(docs.selectExpr("*", "cast(lang as binary) as lang_key"), "doc_id", "text", "lang_key"))
    for context in ("", "a", "ab", "b", "ca"):
        before = prefix_cost(model, context)
        total = sum(np.exp(before - prefix_cost(model, context + c)) for c in "abc")
        total += np.exp(before - model.word_scores([context.encode()], b"en", model.spread())[0])  # the word ends
        assert total == pytest.approx(1.0, abs=0.02)


def prefix_cost(model, text):
    """Cost of the characters of a word without its end."""
    tables, p = model.spread(), {}
    for order, gram, context, _, _, owner in X.gram_hashes([text.encode()], b"en"):
        w, b = tables[order]
        ends = np.arange(len(text) + 1)[len(text) + 1 - len(gram) :]
        for e, g, c in zip(ends, gram, context, strict=True):
            p[e] = float(w[g]) + float(b[c]) * p.get(e, model.floor)
    return -sum(np.log(p[e]) for e in range(len(text)))


def plain_kneser_ney(words):
    """Cost of each (text, number of occurrences): modified Kneser-Ney of one language, with dictionaries."""
    raw = [Counter() for _ in range(X.ORDER + 1)]
    for w, n in words.items():
        marked = ("<s>", *w, "</s>")
        for order in range(1, X.ORDER + 1):
            for i in range(max(1, order - 1), len(marked)):
                raw[order][marked[i - order + 1 : i + 1]] += n
    counts = {X.ORDER: raw[X.ORDER]}
    for order in range(1, X.ORDER):
        before = Counter(g[1:] for g in raw[order + 1])
        counts[order] = {g: n if g[0] == "<s>" else before[g] for g, n in raw[order].items()}
    discounts, total, spared = {}, Counter(), Counter()
    for order, c in counts.items():
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        d = (0.5, 0.75, 0.9)
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.9)
        discounts[order] = [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True)]
        for g, v in c.items():
            total[order, g[:-1]] += v
            spared[order, g[:-1]] += discounts[order][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        order, lower = len(g), p(g[1:])
        if not total[order, g[:-1]]:
            return lower
        v = counts[order].get(g, 0)
        own = v - discounts[order][min(v, 3) - 1] if v else 0
        return (own + spared[order, g[:-1]] * lower) / total[order, g[:-1]]

    def cost(w):
        marked = ("<s>", *w, "</s>")
        return -sum(np.log(p(marked[max(0, i - X.ORDER + 1) : i + 1])) for i in range(1, len(marked)))

    return cost


def test_weights_are_those_of_a_plain_model_for_each_language(spark):
    r = random.Random(8)
    # characters enough that n-grams outnumber any small table, and code points of all sizes
    letters = "".join(map(chr, range(0x4E00, 0x4E00 + 2500))) + "abcde\x02\x03" * 200 + "\U0010ffff"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=120)) for _ in range(60)] + sentences(5, 30, ["ab", "ba", "cab", "d"])
    langs = ["zh"] * 60 + ["en"] * 30
    docs = documents(spark, texts, langs=langs).selectExpr("*", "cast(lang as binary) as lang_key")
    model = X.fit(keyed_texts(docs, "doc_id", "text", "lang_key"))
    tables = model.spread()
    for lang in ("zh", "en"):
        known = Counter(w for t, k in zip(texts, langs, strict=True) if k == lang for w in t.split(" "))
        cost = plain_kneser_ney(known)
        asked = [*list(known)[:200], "", "a", "ab", "abcd"]
        got = model.word_scores([w.encode() for w in asked], lang.encode(), tables)
        assert np.allclose(got, [cost(w) for w in asked], rtol=1e-4)


def test_no_two_ngrams_share_a_count(spark):
    words = [f"{chr(0x4E00 + k // 1600)}{chr(0x6000 + k % 1600)}" for k in range(60_000)]
    docs = documents(spark, [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]).selectExpr("*", "cast('en' as binary) as lang_key")
    model = X.fit(keyed_texts(docs, "doc_id", "text", "lang_key"))
    # of three: the start mark and both characters, both characters and the end mark
    assert len(model.grams[3][0]) == 2 * len(words)
    assert len(model.grams[4][0]) == len(words)
    assert all((np.diff(k) > 0).all() for k, _ in [*model.grams.values(), *model.backoff.values()])


def test_repeated_words_in_runs():
    r = random.Random(3)
    for k in range(400):
        words = [r.choice("ab" if k % 2 else "abcdefg") for _ in range(r.randint(0, 60))]
        assert X.repeated_words(np.array([ord(w) for w in words], np.int64)) == by_hand(" ".join(words))[4]


def test_passing_keeps_columns_and_rows(spark, corpus):
    docs = with_rows(documents(spark, corpus[0][:130]), [(None, corpus[0][0]), (5, corpus[0][5])])
    left = X.passing(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(5) == 2 and ids.count(None) == 1


def test_empty_table(spark):
    assert X.quality(documents(spark, [])).count() == 0
