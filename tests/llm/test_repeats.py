"""Near duplicates, substrings and fuzzy lines against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.llm import fuzzy_lines, linking, near_dups, queries, substrings
from tests.llm.helpers import ODD, collected, documents, prose, with_rows


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


def groups_by_hand(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(sets[i]), root(i)) for i in sets]


@pytest.fixture(scope="module")
def copies():
    texts = []
    for g in range(12):
        base = prose(g)
        texts += [base, base.upper(), base + " tail"] + [edited(base, share, g * 10 + k) for k, share in enumerate((0.01, 0.02, 0.04, 0.06, 0.1))]
    hot = prose(99, 150)
    texts += [edited(hot, 0.02, 1000 + k) for k in range(60)]  # a large group, linked in part
    texts += [edited(hot, 0.08, 2000 + k) for k in range(60)]
    passage = prose(77, 60)
    texts += [passage + " " + prose(3000 + k, 50) for k in range(40)]  # alike in half, not linked
    return texts + ODD + ["same text here"]


def test_components_equal_brute_force(spark, copies):
    got = collected(near_dups.near_duplicates(documents(spark, copies, clash=True)))
    want = groups_by_hand(copies)
    assert [(r["n_shingles"], r["component_id"]) for r in got] == want
    assert [r["kept"] for r in got] == [i == c for i, (_, c) in enumerate(want)]


def test_chains_are_one_component(spark):
    r = random.Random(1)
    nodes = list(range(300))
    links = [(a, a + 1) for a in range(0, 99)] + [(r.choice(nodes[100:]), r.choice(nodes[100:])) for _ in range(120)] + [(7, 7)]
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in {x for a, b in links if a != b for x in (a, b)}}


def test_one_of_a_group_stays(spark):
    base = prose(5)
    docs = with_rows(documents(spark, [base, base + " x", prose(6), None, ""]), [(None, prose(8)), (2, prose(6))])
    left = near_dups.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.collect()) == [(False, 0), (False, 2), (False, 2), (False, 3), (False, 4), (True, None)]


def cut_by_hand(texts, length):
    words = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if windows[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [35, 8, 3])
def test_cut_words_equal_brute_force(spark, length):
    passage, other = prose(1, 50), prose(2, 35)
    texts = [prose(10, 80), prose(10, 80), passage, prose(11, 20) + " " + passage + " " + prose(12, 20), other + " x " + other, other[:-1]]
    texts += [prose(k, 90, pool=3) for k in range(20, 26)] + ["one " * 60, passage + " " + passage] + ODD
    got = collected(substrings.cut_repeats(documents(spark, texts, clash=True), length))
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == cut_by_hand(texts, length)


def test_repeated_rows_are_copies(spark):
    text = prose(3, 40)
    docs = with_rows(documents(spark, [text]), [(0, text), (None, prose(4, 40)), (None, "short")])
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substrings.cut_repeats(docs).collect())
    assert got == [(False, 40, 40), (False, 40, 40), (True, 1, 0), (True, 40, 0)]


def test_equal_and_similar_lines_go(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank while the sun goes down and the wind blows from the north"
    near = line.replace("north", "norths")
    texts = [f"{line}\n{prose(1, 20)}", f"{prose(2, 20)}\n  {line.upper()}  \nshort", near + "\nshort", None, "", f"{prose(3, 20)}\n{prose(3, 20)}"]
    got = collected(fuzzy_lines.deduplicated(documents(spark, texts, clash=True)))
    assert got[0]["text"] == texts[0]
    assert got[1]["text"] == f"{prose(2, 20)}\nshort"
    assert got[2]["text"] in ("short", texts[2])  # a SimHash may differ in more than two bits
    assert got[3]["text"] is None and got[4]["text"] == ""
    assert got[5]["text"] == prose(3, 20)
    assert [r["n_removed"] for r in got][:2] == [0, 1] and got[3]["n_lines"] == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_similarity_is_the_edit_share(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(150):
        a = "".join(r.choice("abcd ") for _ in range(r.randint(1, 120)))
        b = "".join(c if r.random() > 0.1 else r.choice("abcd") for c in a)[r.randint(0, 3) :]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy_lines.similar("a", "b").alias("s"))
    for row in df.collect():
        longer = max(len(row.a), len(row.b))
        assert row.s == (100 * distance(row.a, row.b) <= fuzzy_lines.EDIT_PERCENT * longer), (row.a, row.b)


def test_simhash_by_hand(spark):
    words = "alpha beta gamma delta alpha omega".split()
    lines = spark.createDataFrame([(7, 8, 0, 1, " ".join(words) + " | the a")], "doc_id long, row_key long, line_no int, line_id long, line string")
    hashes = [r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    bits = [int(2 * sum(h >> k & 1 for h in hashes) > len(hashes)) for k in range(60)]
    row = fuzzy_lines.simhashes(lines).first()
    assert row["simhash"] == sum(bit << k for k, bit in enumerate(bits))
    blocks = spark.createDataFrame([(row["simhash"],)], "h long").select(*[fuzzy_lines.block_of(F.col("h"), b) for b in range(4)]).first()
    assert list(blocks) == [sum(bits[15 * b + k] << k for k in range(15)) for b in range(4)]


def noisy(line, share, seed):
    """``line`` with words changed that hold about ``share`` of its characters."""
    r, words = random.Random(seed), line.split(" ")
    for k in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = "".join(r.choice("abcdefgh") for _ in words[k])
    return " ".join(words)


def linked_share(spark, pairs):
    """Share of the similar ones among pairs of lines that end in one group."""
    near = [(a, b) for a, b in pairs if 100 * distance(a, b) <= fuzzy_lines.EDIT_PERCENT * max(len(a), len(b))]
    assert 2 * len(near) > len(pairs)
    docs = spark.createDataFrame([(k, 0, "\n".join(p)) for k, p in enumerate(near)], "doc_id long, row_key long, body string")
    groups = fuzzy_lines.line_groups(docs).groupBy("doc_id").agg(F.count_distinct("group_id").alias("n")).collect()
    return sum(r["n"] == 1 for r in groups) / len(near)


def test_most_similar_lines_are_linked(spark):
    lines = [prose(4000 + k, 18 + k % 60) for k in range(120)]
    assert linked_share(spark, [(line, noisy(line, 0.05 + 0.01 * (k % 10), k)) for k, line in enumerate(lines)]) >= 0.95


def test_lines_of_few_or_short_words_are_linked_as_well(spark):
    pairs = [
        ("He is on it as we go up to see if it is ok", "He is on it as we go up to see if it is so"),
        ("Copyright 2019 The Authors", "Copyright 2020 The Authors"),
        ("All rights reserved by the owner", "All rights reserved by the owners"),
        ("这是一个没有空格的很长的句子用来检查近似重复行的处理是否正确", "这是一个没有空格的很长的句子用来检查近似重复行的处理是否准确"),
        ("x" * 3000 + "abcdefghijklmnop" * 20, "x" * 3000 + "abcdefghijklmnop" * 19),
        (prose(8, 23), prose(8, 23) + " a b"),
    ]
    assert linked_share(spark, [(a.lower(), b.lower()) for a, b in pairs]) == 1


def test_long_lines_keep_the_share_of_edits(spark):
    line = prose(61, 5000)
    for share, same in ((0.03, True), (0.12, True), (0.5, False)):
        r = random.Random(3)
        other = "".join(r.choice("abc") if r.random() < share else c for c in line)
        row = spark.createDataFrame([(line, other)], "a string, b string").select(fuzzy_lines.similar("a", "b").alias("s")).first()
        assert row.s == same
    docs = documents(spark, [line, noisy(line, 0.04, 1), "w " * 40_000, "w " * 39_000 + "v"])
    assert [r["n_removed"] for r in collected(fuzzy_lines.deduplicated(docs))] == [0, 1, 0, 1]


def spread(line, share, seed):
    """``line`` with single characters changed, inserted or left out, at even distances or at random."""
    r, chars = random.Random(seed), list(line)
    n = int(share * len(chars))
    places = [int((k + 0.5) * len(chars) / n) for k in range(n)] if n and seed % 2 else r.sample(range(len(chars)), n)
    for k in places:
        chars[k] = r.choice(["#", "#", "", chars[k] + "+"])
    return "".join(chars)


def test_spread_edits_lose_no_link(spark):
    pairs = []
    for k, words in enumerate((4, 8, 12, 16, 20, 24, 25, 30, 40, 48, 60, 80, 90, 120, 200, 400)):
        for share in (0.03, 0.06, 0.1, 0.14):
            line = prose(7000 + 10 * k + int(100 * share), words)
            pairs.append((line, spread(line, share, k)))
    assert linked_share(spark, pairs) == 1


def test_line_groups_equal_all_pairs(spark):
    r, lines = random.Random(5), []
    for k in range(14):
        # two syllables only, so that runs are common; lengths on both sides of where the comparison changes
        base = "".join(r.choice(["la", "lu ", "\U0001f389"]) for _ in range((9, 17, 30, 33, 44, 62, 66)[k % 7])).strip()
        lines += [base, *(spread(base, share, k).strip() for share in (0.07, 0.15, 0.2))]
    lines = sorted({x for x in lines if len(x) >= fuzzy_lines.MIN_CHARS})
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            longer = max(len(a), len(b))
            if 100 * (longer - min(len(a), len(b))) <= 15 * longer and 100 * distance(a, b) <= 15 * longer:
                parent[root(i)] = root(j)
    docs = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "doc_id long, row_key long, body string")
    found = {}
    for row in fuzzy_lines.line_groups(docs).collect():
        found.setdefault(row["group_id"], set()).add(row["doc_id"])
    want = {}
    for i in range(len(lines)):
        want.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert 1 < len(want) < len(lines)


def test_blocks_of_lines_lose_no_link(spark, monkeypatch):
    pairs = [(prose(k, words), spread(prose(k, words), 0.14, 1)) for k, words in enumerate((4, 15, 30, 60, 120))]
    monkeypatch.setattr(fuzzy_lines, "BLOCK_BYTES", 4000)
    assert linked_share(spark, pairs) == 1


def test_short_lines_are_compared_exactly(spark, tmp_path):
    texts = ["Read more\n\nx", "read more \n\nRead mode", "READ MORE", None, "\n"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = collected(queries.op8_fuzzy_lines(spark, str(tmp_path)))
    assert [r["text"] for r in got] == ["Read more\n\nx", "\nRead mode", "", None, "\n"]
    assert [r["n_removed"] for r in got] == [0, 1, 1, 0, 0]


def test_repeated_rows_share_their_result(spark):
    line = "a line that is long enough to count"
    docs = with_rows(documents(spark, [line, f"{line}\nb", "w " * 70_000]), [(1, f"{line}\nb"), (0, line), (None, line)])
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"][:9], r["n_removed"]) for r in fuzzy_lines.deduplicated(docs).collect()), key=str)
    # a null id comes first in Spark's order, so its row keeps the line
    assert got == [(False, 0, "", 1), (False, 0, "", 1), (False, 1, "b", 1), (False, 1, "b", 1), (False, 2, "w w w w w", 0), (True, None, "a line th", 0)]


def test_empty_tables(spark):
    none = documents(spark, [])
    assert near_dups.near_duplicates(none).count() == 0
    assert substrings.cut_repeats(none).count() == 0
    assert fuzzy_lines.deduplicated(none).count() == 0
