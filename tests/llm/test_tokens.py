"""Token counts and packing against the tokenizer library."""

import random
import zlib

import numpy as np
import pytest

from revlens.llm import packing, token_counts
from tests.llm.helpers import ODD, collected, documents, with_rows

P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "the ", "é", "É", "中", "🎉", "12", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "'ll", "'S", ",.", "###", "İ", "Σ", "\x85", "\x1c", "ß", "²", "Wort "]


def mixed_texts(n=400, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_token_counts_equal_the_library(spark, libraries):
    texts = ODD + mixed_texts()
    got = collected(token_counts.token_counts(documents(spark, texts, clash=True), BYTES, limit=20))
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]
    want = [len(libraries[0].encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n_tokens"] for r in got] == want
    assert [r["over_limit"] for r in got] == [n > 20 for n in want]


def test_a_run_of_equal_bytes_is_merged_from_the_left():
    merges = token_counts.Merges(BYTES)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    words = ["a" * n for n in range(1, 40)] + ["aab" * n for n in range(1, 20)]
    assert merges.count([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_forgetting_changes_no_ids(libraries, monkeypatch):
    monkeypatch.setattr(packing.Ids, "GENERATION", 50)
    ids = packing.Ids(WORDS)
    for seed in range(5):
        texts = mixed_texts(100, seed)
        want = [np.array(libraries[1].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert ids.of(texts) == want


def test_packed_pieces_are_the_documents(spark, libraries):
    texts = ODD + mixed_texts(200) + ["wort " * 3000]
    docs = with_rows(documents(spark, texts), [(0, "again"), (None, "without id")])
    got = collected(packing.pack(docs, WORDS, capacity=64))
    by_doc = {}
    for i, t in [*enumerate(texts), (0, "again"), (None, "without id")]:
        ids = np.array([*libraries[1].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        by_doc.setdefault(i, []).extend((k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(ids[64 * k : 64 * k + 64].tobytes())) for k in range(-(-len(ids) // 64)))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by_doc.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 64) + 1


def test_fullest_finds_the_best_sum():
    r = random.Random(5)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for _ in range(r.randint(1, 6)):
            counts[r.randint(1, 30)] += r.randint(1, 3)
        fixed = int(np.flatnonzero(counts)[-1])
        rest = [n for n in range(31) for _ in range(int(counts[n]) - (n == fixed))]
        best = {0}
        for n in rest:
            best |= {s + n for s in best if s + n <= 30 - fixed}
        chosen = packing.fullest(counts, fixed, 30)
        assert sum(n * k for n, k in chosen.items()) == fixed + max(best)
        assert all(k <= counts[n] for n, k in chosen.items())


def test_every_piece_gets_one_place():
    r = np.random.default_rng(1)
    counts = np.bincount(r.integers(1, 65, 3000), minlength=65)
    used = np.zeros(65, np.int64)
    for length, first, end, many, _, _ in packing.places(counts, 64):
        assert first == used[length] and (end - first) % many == 0
        used[length] = end
    assert (used == counts).all()


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts.token_counts(none, BYTES).count() == 0
    assert packing.pack(none, WORDS).count() == 0
