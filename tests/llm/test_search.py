"""Decontamination by planted passages and brute force; main text; toxicity; surrogates."""

import random
import re

import numpy as np
import pytest

from revlens.llm import decontaminate, main_text, surrogates, toxicity
from tests.llm.helpers import ODD, collected, documents, prose, with_rows


def benchmark(spark, texts):
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as body")


def changed(text, edits, seed):
    r, s = random.Random(seed), list(text)
    for _ in range(edits):
        at = r.randrange(len(s))
        kind = r.random()
        if kind < 0.4:
            s[at] = r.choice("abcde")
        elif kind < 0.7:
            s.insert(at, "x")
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def least_edits(part, text):
    """Edits between ``part`` and the substring of ``text`` that is most like it."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_planted_passages_are_found_and_clean_documents_left(spark):
    items = [prose(500 + k, 40, pool=9000) for k in range(30)]
    texts = [prose(k, 80, pool=9000) for k in range(40)]
    leaks = {}
    for k in range(0, 30, 2):
        item = items[k]
        hidden = (item, item.upper(), item.replace(" ", ",\n  "), changed(item, 3, k), item[:150])[k // 2 % 5]
        texts[k] = texts[k][:100] + " " + hidden + " " + texts[k][100:]
        leaks[k] = 100 + k
    docs = documents(spark, texts + ODD, clash=True)
    got = collected(decontaminate.contaminated(docs, benchmark(spark, items + [None, "", "tiny", items[0]])))
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == {(d, i) for d, i in leaks.items()} | {(0, 133)}
    left = decontaminate.decontaminated(docs, benchmark(spark, items))
    assert {r["doc_id"] for r in left.collect()} == set(range(40 + len(ODD))) - set(leaks)
    assert left.columns == docs.columns


def test_no_stretch_within_the_budget_is_missed():
    r = random.Random(8)
    for k in range(120):
        item = "".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 128))).strip()
        text = "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 200))) + changed(item, r.randint(0, len(item) // 8), k) + "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 200)))
        chars, part = decontaminate.normalised(text.encode()), decontaminate.normalised(item.encode())
        index = decontaminate.Index([(1, part)])
        edits = least_edits(part.tolist(), chars.tolist())
        budget = int(index.budget[0])
        got = index.matches(chars)
        if len(part) + 1 - decontaminate.Q - budget * decontaminate.Q >= 1:
            # an item longer than a segment is also found by its segments, which may need fewer edits
            if len(part) <= decontaminate.PART:
                assert bool(got) == (edits <= budget)
            if edits <= budget:
                assert got and (got[0][1] == edits if len(part) <= decontaminate.PART else got[0][1] <= edits)


def test_the_benchmark_goes_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    items = [prose(700 + k, 40) for k in range(6)]
    docs = documents(spark, [f"{prose(k)} {items[k]}" for k in range(6)])
    got = decontaminate.contaminated(docs, benchmark(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(k, 100 + k, 0) for k in range(6)]


def test_a_passage_of_a_long_item_is_found_wherever_it_starts():
    item = decontaminate.normalised(prose(41, 90, pool=9000).encode())
    before, after = (decontaminate.normalised(prose(k, 30, pool=9000).encode()) for k in (42, 43))
    index = decontaminate.Index([(1, item)])
    length = decontaminate.PART + decontaminate.STRIDE - 1
    assert length <= 80 and not index.matches(np.r_[before, after])
    for start in range(len(item) - length + 1):
        got = index.matches(np.r_[before, item[start : start + length], after])
        assert got and got[0][1] == 0 and decontaminate.PART <= got[0][2] <= length + decontaminate.PART


@pytest.mark.parametrize("length", [80, 90, 100, 126, 127, 128, 129, 150, 200, 300])
def test_one_rule_for_items_of_all_lengths(length):
    """A passage of 79 characters is found wherever it starts in an item of any length."""
    item = decontaminate.normalised(prose(60 + length, 90, pool=9000).encode())[:length]
    before, after = (decontaminate.normalised(prose(k, 30, pool=9000).encode()) for k in (42, 43))
    index = decontaminate.Index([(1, item)])
    passage = decontaminate.PART + decontaminate.STRIDE - 1
    assert passage == 79 and not index.matches(np.r_[before, after])
    for start in range(0, length - passage + 1, 1 if length < 140 else 7):
        got = index.matches(np.r_[before, item[start : start + passage], after])
        assert got and got[0][1] == 0


def test_decontamination_of_empty_tables(spark):
    docs = documents(spark, ["a text"])
    assert decontaminate.contaminated(docs, benchmark(spark, [])).count() == 0
    assert decontaminate.contaminated(documents(spark, []), benchmark(spark, ["a text"])).count() == 0


# --- main text


@pytest.fixture(scope="module")
def field():
    return main_text.fitted(main_text.labelled_pages())


def test_held_out_pages_are_labelled_right(field):
    pages = main_text.labelled_pages(200, seed=77)
    right = [field.labels(main_text.blocks_of(html)) == labels for html, labels in pages]
    assert sum(right) >= 0.95 * len(right)


def test_viterbi_equals_all_label_sequences(field):
    for html, _ in main_text.labelled_pages(40, seed=5):
        blocks = main_text.blocks_of(html)[:9]
        scores = field.emissions(blocks)

        def total(labels, scores=scores):
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.next[a, b] for a, b in zip(labels, labels[1:]))

        best = max(total([k >> i & 1 for i in range(len(blocks))]) for k in range(2 ** len(blocks)))
        assert total(field.labels(blocks)) == pytest.approx(best)


def test_blocks_of_broken_markup():
    html = "<p>one <b>two<p>three &amp; four&nbsp;five<br>six<!-- no --><script>var x='</p>';</script><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>end"
    assert [b.text for b in main_text.blocks_of(html)] == ["one two", "three & four five six", "a", "b", "c", "d", "end"]
    for odd in ("", "<", "<p", "</", "&#x110000;", "<![CDATA[", "<!--", "<a href='", "]]>", "\x00"):
        main_text.blocks_of(odd)


@pytest.mark.parametrize("odd", ["<![ if IE]>", "<![foo[", "<![foo[ x ]]>", "<![>", "<![1]>", "<![endif]>", "<![if !IE>", "<![CDATA[ x>", "<!DOCTYPE html [<!ELEMENT a>]>", "<!x y>", "<![CDATA[ x ]]>"])
def test_text_goes_on_after_odd_declarations(odd):
    texts = [b.text for b in main_text.blocks_of(f"<p>before</p>{odd}<p>one</p><p>after &amp; end</p>")]
    assert texts[0] == "before" and texts[-1] == "after & end"
    for cut in range(len(odd)):
        assert main_text.blocks_of(f"<p>before</p>{odd[:cut]}")[0].text == "before"


def test_main_text_of_pages(spark, field):
    page = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>B</a></li></ul></nav><div class='ad'>Buy now.</div>"
        "<article><h1>Title of it</h1><p>First  line\n of text &amp;c.</p><p>Second line, with more of the same words in it.</p></article>"
        "<div class='comments'><p>I do not agree with that at all.</p></div><footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "<p>" + "word " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as body", "2 as text")
    got = collected(main_text.main_text(pages, field=field), "page_id")
    want = "Title of it\nFirst line of text &c.\nSecond line, with more of the same words in it."
    assert [r["text"] for r in got[:4]] == [want, want, "", ""]
    assert [r["n_chars"] for r in got[:4]] == [len(want), len(want), 0, 0]
    assert main_text.main_text(pages.limit(0), field=field).count() == 0


# --- toxicity

BAD = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    texts, toxic = [], []
    for k in range(500):
        words = prose(k, 40, pool=900).replace("w", "wo").split()
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        bad = k % 4 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(BAD))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(k, t, 1) for k, t in enumerate(toxic)] + [(3, None, 1), (None, 1, 1), (0, 1, 1)], "doc_id long, toxic int, quality int")
    return texts, toxic, labels


def test_toxic_texts_are_told_apart_outside_the_training_fold(spark, labelled):
    import zlib

    texts, toxic, labels = labelled
    got = collected(toxicity.toxicity(documents(spark, texts + ODD, clash=True), labels))
    assert [r["held_out"] for r in got] == [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got]
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] < 500]
    assert np.mean([a == b for a, b in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_hidden_words_are_restored(spark, labelled):
    from revlens.llm.common import keyed_texts

    costs = toxicity.character_costs(keyed_texts(documents(spark, labelled[0]), "doc_id", "text"))
    restorer = toxicity.Restorer(costs)
    for written in ("id10t", "m0r0n", "$cum", "i.d.i.o.t", "mooooron", "IDIOT!!", "sc*m", "m-o-r-o-n"):
        assert restorer.restored(written) in BAD, written
    assert restorer.words("an i d i o t is a b") == ["an", "idiot", "is", "a", "b"]
    assert restorer.restored("plain") == "plain" and restorer.restored("12345") == ""


def test_decoding_equals_all_readings(spark, labelled):
    from itertools import product

    from revlens.llm.common import keyed_texts

    costs = toxicity.character_costs(keyed_texts(documents(spark, labelled[0]), "doc_id", "text"))
    for word in ("1d10t", "m00r0n", "sc.um", "aa1!", "5cuum"):
        best = None
        for ways in product(*toxicity.options(word)):
            symbols = [s for s, _ in ways if s is not None]
            total, state = sum(c for _, c in ways), [toxicity.GAP] * 3
            for s in [*symbols, toxicity.GAP]:
                total += costs[(state[0] * toxicity.SYMBOLS + state[1]) * toxicity.SYMBOLS + state[2]][s]
                state = [*state[1:], s]
            reading = "".join(toxicity.LETTERS[s] for s in symbols)
            best = min(best or (total, reading), (total, reading))
        assert toxicity.decoded(word, costs) == best[1]


def test_toxicity_without_labels_or_rows(spark, labelled):
    none = labelled[2].limit(0)
    assert {r["predicted"] for r in toxicity.toxicity(documents(spark, ODD), none).collect()} == {0}
    assert toxicity.toxicity(documents(spark, []), labelled[2]).count() == 0


# --- surrogates


def test_surrogates_keep_type_format_and_reference(spark):
    texts = [
        "Mrs. Anna Smith met Mr Smith; Smith rang +1 (017) 555-7713, or +1 017-555-7713. Anna left.",
        "Pay 4111 1111 1111 1111 or 4111-1111-1111-1111, number 123-45-6789",
        "mail The.72@Mail3.example.com the.72@mail3.EXAMPLE.com ip 97.51.17.173.",
        'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! DE89370400440532013000 госпожа Анна Петрова',
        "Herr Smith wrote to The.72@mail3.example.com",
        "plain 3.14 text 2024-01-02 1.2.3 of 12 words",
    ]
    got = collected(surrogates.pseudonymised(documents(spark, texts + ODD, clash=True), "k"))
    new = [r["text"] for r in got]
    person = re.fullmatch(r"Mrs\. ([A-Z][a-z]+a) ([A-Z][a-z]+) met Mr (\w+); (\w+) rang \+1 \((\d{3})\) (\d{3})-(\d{4}), or \+1 (\d{3})-(\d{3})-(\d{4})\. (\w+) left\.", new[0])
    assert person and person[2] == person[3] == person[4] and person[1] == person[11]
    assert person.group(5, 6, 7) == person.group(8, 9, 10) != ("017", "555", "7713")
    cards = re.fullmatch(r"Pay ((?:\d{4} ){3}\d{4}) or ((?:\d{4}-){3}\d{4}), number (\d{3}-\d{2}-\d{4})", new[1])
    assert cards and cards[1].replace(" ", "") == cards[2].replace("-", "") and cards[3] != "123-45-6789"
    digits = [int(c) for c in cards[1].replace(" ", "")][::-1]
    assert sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10
    mails = re.findall(r"[\w.]+@[\w.]+\.(?:com)", new[2])
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() != "the.72@mail3.example.com" and mails[0] != mails[1]
    assert re.search(r'token = "[0-9A-F]{40}"!! DE\d{20} госпожа [А-Я][а-я]+на [А-Я][а-я]+$', new[3])
    assert new[4].split()[1] == person[2] and new[4].split()[4].lower() == mails[0].lower()
    assert new[5] == texts[5] and [r["n_entities"] for r in got[:6]] == [4, 3, 3, 3, 2, 0]
    assert new[6:] == ODD


def test_surrogates_are_distinct_and_none_is_real(spark):
    r = random.Random(1)
    numbers = sorted({f"{r.randrange(10**6):06d}" for _ in range(3000)})
    # a small space: addresses of one letter and two digits collide, and meet real ones
    mails = [f"a{k:02d}@b.com" for k in range(100)]
    entities = spark.createDataFrame([("email", m, m[:-4]) for m in mails] + [("card", n, n) for n in numbers], "kind string, canon string, like string")
    from pyspark.sql import functions as F

    draws = surrogates.drawn(entities, "key").join(entities, ["kind", "canon"])
    digest = F.sha2(F.concat_ws("|", F.lit("key"), "kind", "canon", F.col("draw").cast("string")), 512)
    rows = draws.select("kind", "like", surrogates.surrogate(F.col("like"), F.col("kind"), digest).alias("new")).collect()
    assert len(rows) == 100 + len(numbers)
    for kind in ("email", "card"):
        new = [x["new"] for x in rows if x["kind"] == kind]
        assert len(set(new)) == len(new) and not set(new) & {x["like"] for x in rows if x["kind"] == kind}


def test_other_keys_give_other_surrogates(spark):
    docs = with_rows(documents(spark, ["call +1 (017) 555-7713"]), [(0, "call +1 (017) 555-7713"), (None, "mail a.b@c.org")])
    a, b = (sorted(r["text"] for r in surrogates.pseudonymised(docs, k).collect()) for k in "ab")
    assert len(a) == 3 and a[0] == a[1] and a != b
    assert surrogates.pseudonymised(documents(spark, []), "k").count() == 0


@pytest.mark.parametrize("length", [130, 5000])
def test_secrets_of_any_length_go(spark, length):
    secret = "a1b2c3d4" * (length // 8) + "e" * (length % 8)
    got = surrogates.pseudonymised(documents(spark, [f"key {secret} end", f"sk-{secret}"]), "k")
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert secret not in texts[0] and secret not in texts[1]
    assert len(texts[0]) == length + 8 and texts[0].startswith("key ") and texts[0].endswith(" end")


def test_samples_of_very_small_shares_hold_rows(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert ids.filter(toxicity.chosen("doc_id", 1.0)).count() == 200_000
    assert 150 < ids.filter(toxicity.chosen("doc_id", 1e-3)).count() < 250
    least = ids.selectExpr("min(shiftrightunsigned(xxhash64(doc_id), 2)) AS h").first()["h"]
    assert least / 2**62 < 1e-4 and ids.filter(toxicity.chosen("doc_id", (least + 4096) / 2**62)).count() >= 1


def test_all_words_of_a_class_are_read():
    page = "<div class='a b c d e f g sidebar'><p>menu words</p></div>"
    assert any("sidebar" in step for step in main_text.blocks_of(page)[0].path)
