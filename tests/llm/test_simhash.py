"""SimHash near duplicates against brute force: fingerprints, the index, components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revlens.llm import gray_index
from revlens.llm.linking import components
from tests.llm.helpers import ODD, collected, documents, prose, with_rows


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(codes, bits=4):
    """For each code the smallest place it is connected with."""
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(codes):
        for j in range(i):
            if (x ^ codes[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(codes))]


def edited(text, words, seed):
    r, out = random.Random(seed), text.split(" ")
    for k in r.sample(range(len(out)), words):
        out[k] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def test_documents_equal_brute_force(spark):
    texts = [prose(k, 60 + k) for k in range(60)]
    for k in range(25):
        texts += [texts[k].upper(), edited(texts[k], 1, k), edited(texts[k], 3, 100 + k)]
    hot = prose(999, 700)
    texts += [hot] * 40 + [edited(hot, 1 + k % 4, 500 + k) for k in range(120)] + ODD + ["a b", "a b c d", "A B"]
    got = collected(gray_index.near_duplicates(documents(spark, texts, clash=True)))
    codes = [fingerprint_by_hand(t) for t in texts]
    assert [r["fingerprint"] for r in got] == [f"{c:016x}" for c in codes]
    want = components_by_hand(codes)
    assert [r["component_id"] for r in got] == want
    assert 1 < len(set(want)) < len(want) - 100


def test_spark_hashes_the_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three four", 42) == gray_index.fingerprint(b"One two  three four")


def test_gray_ranks_follow_the_sequence():
    places = np.arange(1 << 10, dtype=np.uint64)
    codes = places ^ (places >> np.uint64(1))
    assert (gray_index.gray_rank(codes) == places).all()


def clustered_codes(seed, centres, around, flips):
    r, out = random.Random(seed), set()
    for _ in range(centres):
        centre = r.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(flips + 1))) for _ in range(around)}
    return sorted(out)


@pytest.mark.parametrize("bits,agree", [(4, 1), (4, 2), (4, 3), (2, 1), (6, 2)])
def test_every_pair_is_connected_whatever_the_turns(spark, bits, agree):
    codes = clustered_codes(bits * 10 + agree, 12, 60, 7) + [0, 1, 2**64 - 1, 2**63]
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    links = gray_index.hamming_links(df, len(codes), bits, agree)
    found = {r["id"]: r["component"] for r in components(links).collect()}
    mine, want = [found.get(c, c) for c in signed], components_by_hand(codes, bits)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_one_large_group_spans_many_leaves(spark):
    """More near codes under one upper node than a leaf holds: no link is lost, no pair is emitted."""
    r = random.Random(7)
    codes = sorted({sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(9000)})
    assert len(codes) > 4 * gray_index.LEAF
    df = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "code long")
    links = gray_index.hamming_links(df, len(codes), 4, 1)
    leaves = 5 * (len(codes) // gray_index.LEAF + 20) ** 2
    assert links.count() < leaves * gray_index.LEAF
    assert {x["component"] for x in components(links).collect()} == {min(c - 2**64 if c >= 2**63 else c for c in codes)}
    assert components(links).count() == len(codes)


def test_near_pairs_of_two_leaves():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    a = np.array([x ^ (1 << r.randrange(64)) for x in base], np.uint64)
    b = np.array([x ^ (7 << r.randrange(61)) for x in base[:33]], np.uint64)
    i, j = gray_index.near_pairs(a, b, 4)
    want = {(p, q) for p, x in enumerate(a.tolist()) for q, y in enumerate(b.tolist()) if (x ^ y).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = prose(4)
    docs = with_rows(documents(spark, [None, text, text]), [(None, text), (2, prose(5)), (None, prose(6))])
    got = sorted(((r["doc_id"], r["component_id"]) for r in gray_index.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, 0), (1, 1), (2, 1), (None, 1), (2, 2), (None, None)], key=str)
    none = documents(spark, [])
    assert gray_index.near_duplicates(none).collect() == []
    assert gray_index.deduplicated(none).columns == none.columns


def test_one_of_a_group_stays(spark):
    texts = [prose(8, 300), prose(8, 300), prose(9), None, ""]
    docs = documents(spark, texts, clash=True)
    left = gray_index.deduplicated(docs)
    assert left.columns == docs.columns
    assert [r["doc_id"] for r in collected(left)] == [0, 2, 3]
    assert left.filter(F.col("body") != 7).count() == 0
