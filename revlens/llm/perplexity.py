"""Quality rules: repetition and length rules, then language-specific perplexity bands.

The language model is a modified Kneser-Ney model of character n-grams inside words (with
marks for the start and the end of a word), one per language. Spark counts the words of the
whole corpus, cuts each distinct word into the longest n-gram that ends at each of its places,
and computes continuation counts of shorter ones, discounts and back-off weights by grouping.
An n-gram is grouped by its characters (21 bits each in two longs), so no two share a count,
however many there are. The result is sent to the tasks as arrays of 64-bit hashes in ascending
order with a weight each: 12 bytes per n-gram and per context. It grows with the number of
distinct n-grams of the corpus; the driver and each worker hold all of it.

A document's score is the mean negative log probability of a word, where a word counts once
in each block of BLOCK words: common words would otherwise hide junk, and counting each word
once in a whole text would raise the score with the length. A language's band
runs from its lower quartile less FENCE interquartile ranges (MIN_SPREAD at least) to its
upper quartile plus as much, over all documents that pass the rules; quartiles come from
counts of scores in steps of STEP, so no document is sorted. Documents outside are rejected.

Null texts count as empty and have no words: they fail the rules. A null language is a
language of its own. Texts are read whole; repeated rows give repeated results; an empty
table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import MEMORY, among, batch_rows, keyed_texts, mixed, stored, tidy, to_batches, window_hashes

ORDER = 5
#: Bits of a character in a packed n-gram (0: no character), and marks beyond all characters.
CHAR_BITS = 21
START, END = 0x110000, 0x110001
BLOCK = 128
FENCE = 2.0
MIN_SPREAD = 0.3
STEP = 0.01

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Words whose n-grams are looked up together; bounds memory, not results.
SCORED_AT_ONCE = 10_000
SYMBOLS = b"#*$%&|<>"

_STEP_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def _characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their marks, number of the word and start of the word for each."""
    texts = [w.decode("utf-8", "replace") for w in words]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    chars = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    chars[ends - lengths] = START
    chars[ends - 1] = END
    return chars, np.repeat(np.arange(len(texts)), lengths), np.repeat(ends - lengths, lengths)


def gram_hashes(words: list[bytes], lang: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (order, key, context key, suffix key, opens a word, number of the word).

    Keys are 64-bit hashes of the n-gram, of the n-gram without its last and without its first
    character. Unigrams have the empty context, whose key is that of the language.
    """
    chars, owner, start = _characters(words)
    seed = _seed(lang)
    chars = mixed(chars + seed)
    at = np.arange(len(chars))
    current = np.full(len(chars), seed)  # hash of the n-gram that ends at each place
    for order in range(1, ORDER + 1):
        previous = current
        shifted = np.r_[np.full(1, seed), previous[:-1]]
        current = mixed(shifted * _STEP_MULTIPLIER + chars + np.uint64(order))
        # the start mark is never predicted, only part of contexts
        ok = np.flatnonzero((at - start >= order - 1) & (at > start))
        # a start mark at the front: nothing can stand before it
        opens = at[ok] - start[ok] == order - 1
        yield order, current[ok], shifted[ok], previous[ok], opens, owner[ok]


def longest_grams(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones among the longest n-grams that end at each place: (hi, lo, number).

    ``lo`` holds the last three characters plus one each, ``hi`` those before. Shorter n-grams than
    ORDER open a word; all other shorter ones are the ends of longer ones.
    """
    chars, owner, start = _characters(words)
    at = np.arange(len(chars))

    def back(k: int) -> np.ndarray:
        """The characters ``k`` places before, plus one; 0 outside the word."""
        return np.where(at - start >= k, np.r_[np.zeros(k, np.uint64), chars[: len(chars) - k] + np.uint64(1)][: len(chars)], np.uint64(0))

    bits = np.uint64(CHAR_BITS)
    ends = np.flatnonzero(at > start)
    lo = ((back(2) << (bits + bits)) | (back(1) << bits) | back(0))[ends]
    hi = ((back(4) << bits) | back(3))[ends]
    order = np.lexsort((lo, hi))
    lo, hi, n = lo[order], hi[order], counts[owner[ends]][order]
    first = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])][: len(lo)])
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def packed_hashes(lang: np.ndarray, order: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The keys of ``gram_hashes`` for packed n-grams of 0 to ORDER characters, ``lang`` being the languages' keys."""
    bits, mask = np.uint64(CHAR_BITS), np.uint64((1 << CHAR_BITS) - 1)
    slots = [hi >> bits, hi & mask, lo >> (bits + bits), (lo >> bits) & mask, lo & mask]
    out = lang.copy()
    for k, slot in enumerate(slots):
        step = k + order - ORDER + 1  # the place of the character in its n-gram
        hashed = mixed(out * _STEP_MULTIPLIER + mixed(slot - np.uint64(1) + lang) + step.astype(np.uint64))
        out = np.where(step > 0, hashed, out)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])

    def flushed(counts: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            items = list(c.items())
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield to_batches(schema, ([lang] * len(part), [w for w, _ in part], [n for _, n in part]))

    counts: dict[bytes, Counter] = {}
    for batch in batches:
        for lang, body in batch_rows(batch, "lang_key", "body"):
            counts.setdefault(lang, Counter()).update(body.split())
        if sum(map(len, counts.values())) > MEMORY:
            yield from flushed(counts)
            counts = {}
    yield from flushed(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        by_lang: dict[bytes, tuple[list, list]] = {}
        for lang, word, n in batch_rows(batch, "lang", "word", "n"):
            words, counts = by_lang.setdefault(lang, ([], []))
            words.append(word)
            counts.append(n)
        for lang, (words, counts) in by_lang.items():
            hi, lo, n = longest_grams(words, np.array(counts, np.int64))
            yield to_batches(schema, (np.full(len(n), _seed(lang)).view(np.int64), hi.view(np.int64), lo.view(np.int64), n))


def _hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram_order", pa.int32()), ("key", pa.int64()), ("value", pa.float32())])
    for batch in batches:
        lang, length, hi, lo = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lang", "length", "hi", "lo"))
        key = packed_hashes(lang.view(np.uint64), length.astype(np.int64), hi.view(np.uint64), lo.view(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("gram_order")), pa.array(key.view(np.int64)), batch.column(batch.schema.get_field_index("value"))], schema=schema)


def _slot(k: int) -> int:
    """The least number that fills ``k`` characters of a long."""
    return 1 << CHAR_BITS * (k - 1)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang (key), gram_order, hi, lo, c: Kneser-Ney counts of all n-grams over all words of the corpus.

    The longest n-grams and those that open a word count as often as they occur, others once for
    every character that stands before them.
    """
    words = docs.mapInArrow(tidy(_count_words), "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    longest = words.mapInArrow(tidy(_count_grams), "lang long, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("c"))
    order = F.when(F.col("hi") >= _slot(2), 5).when(F.col("hi") > 0, 4).when(F.col("lo") >= _slot(3), 3).when(F.col("lo") >= _slot(2), 2).otherwise(1)
    longest = stored(longest.select("lang", order.alias("gram_order"), "hi", "lo", "c"), "grams")
    found, counts = longest.filter(F.col("gram_order") == ORDER), None
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            # without its first character: the slots from there on
            hi = F.col("hi").bitwiseAND(F.lit(_slot(max(1, k - 2)) - 1))
            lo = F.col("lo").bitwiseAND(F.lit(_slot(min(3, k) + 1) - 1))
            ends = found.groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c"))
            ends = ends.select("lang", F.lit(k).alias("gram_order"), "hi", "lo", "c")
            found = stored(ends.unionByName(longest.filter(F.col("gram_order") == k)), "grams")
        counts = found if counts is None else counts.unionByName(found)
    return counts


class Table:
    """Numbers by 64-bit hash, in ascending order of the hashes; ``missing`` for other hashes.

    Hashes are evenly spread: their first bits tell where to look, within a few places.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        self.keys = np.r_[keys, np.uint64(2**64 - 1)]
        self.values = np.r_[values, np.float32(missing)].astype(np.float32)
        self.missing = np.float32(missing)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __getitem__(self, wanted):
        key = np.atleast_1d(np.asarray(wanted, np.uint64))
        at = self.first[(key >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.keys[at] < key)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < key[left]]
        return np.where(self.keys[at] == key, self.values[at], self.missing).reshape(np.shape(wanted))


Tables = dict[int, tuple[Table, Table]]


class Model:
    """Arrays of n-gram hashes in ascending order with weights, and of contexts with back-off."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], backoff: dict[int, tuple[np.ndarray, np.ndarray]], floor: float):
        self.grams, self.backoff, self.floor = grams, backoff, floor

    def spread(self) -> Tables:
        """Weights and back-off of each order as tables; for the life of a task, not of a worker."""
        return {k: (Table(*self.grams[k], 0.0), Table(*self.backoff[k], 1.0)) for k in self.grams}

    def word_scores(self, words: list[bytes], lang: bytes, tables: Tables) -> np.ndarray:
        """Negative log probability of each word, its end mark included."""
        parts = [self._scores(words[k : k + SCORED_AT_ONCE], lang, tables) for k in range(0, len(words), SCORED_AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty(0)

    def _scores(self, words: list[bytes], lang: bytes, tables: Tables) -> np.ndarray:
        p, place = None, None
        for order, gram, context, _, _, owner in gram_hashes(words, lang):
            weights, backoffs = tables[order]
            weight, back = weights[gram].astype(np.float64), backoffs[context].astype(np.float64)
            if p is None:
                p, place = weight + back * self.floor, owner
                continue
            # n-grams of an order end at the last characters of each word: line them up
            sizes = np.bincount(place, minlength=len(words))
            sizes_now = np.bincount(owner, minlength=len(words))
            at = np.repeat(np.cumsum(sizes) - sizes_now, sizes_now) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes_now) - sizes_now, sizes_now)
            p[at] = weight + back * p[at]
        return np.bincount(place, weights=-np.log(np.maximum(p, 1e-12)), minlength=len(words))


def _with_discounts(counts: DataFrame) -> DataFrame:
    """``counts`` with the discount d of each n-gram and the number (kinds) of those of its language and order."""
    tally = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    n = [F.col(f"n{k}") for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], F.when(n[2] > 0, 3 - 4 * y * n[3] / n[2]).otherwise(0.9))
    told = (n[0] > 0) & (n[1] > 0)
    d = [F.when(told, F.least(F.greatest(f, F.lit(0.05)), F.lit(k - 0.05))).otherwise(other) for f, k, other in zip(found, (1, 2, 3), (0.5, 0.75, 0.9), strict=True)]
    each = counts.groupBy("lang", "gram_order").agg(*tally, F.count("*").alias("kinds"))
    each = each.select("lang", "gram_order", "kinds", *[c.alias(f"d{k}") for k, c in enumerate(d, 1)])
    discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(each, ["lang", "gram_order"]).withColumn("d", discount).drop("d1", "d2", "d3")


def fit(docs: DataFrame) -> Model:
    """Modified Kneser-Ney weights of all n-grams; grouping and joins run on Spark."""
    counts = gram_counts(docs)
    low, bits = F.col("hi").bitwiseAND(F.lit(_slot(2) - 1)), CHAR_BITS
    # without the last character
    first = [F.shiftright("hi", bits).alias("chi"), F.shiftright("lo", bits).bitwiseOR(F.shiftleft(low, 2 * bits)).alias("clo")]
    cut = stored(_with_discounts(counts).select("*", *first), "kn-counts")
    context = cut.groupBy("lang", "gram_order", "chi", "clo").agg(F.sum("c").alias("total"), F.sum("d").alias("spared"), F.max("kinds").alias("kinds"))
    kinds = cut.filter("gram_order = 1").agg(F.coalesce(F.max("kinds"), F.lit(0))).first()[0]
    weights = cut.join(context.drop("kinds"), ["lang", "gram_order", "chi", "clo"]).select(
        "lang", "gram_order", F.col("gram_order").alias("length"), "hi", "lo", ((F.col("c") - F.col("d")) / F.col("total")).cast("float").alias("value")
    )
    # what unigrams spare goes to the characters of the language alike; the floor is that of the language with most
    share = F.when(F.col("gram_order") == 1, F.lit(kinds + 1.0) / (F.col("kinds") + 1)).otherwise(1.0)
    back = context.select(
        "lang", "gram_order", (F.col("gram_order") - 1).alias("length"), F.col("chi").alias("hi"), F.col("clo").alias("lo"),
        (F.col("spared") / F.col("total") * share).cast("float").alias("value"),
    )

    def arrays(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found = df.mapInArrow(tidy(_hash_grams), "gram_order int, key long, value float").toArrow()
        order, key, value = (found.column(c).to_numpy() for c in ("gram_order", "key", "value"))
        out = {}
        for k in range(1, ORDER + 1):
            mine = order == k
            hashes = key[mine].view(np.uint64)
            by_key = np.argsort(hashes, kind="stable")
            out[k] = hashes[by_key], value[mine][by_key]
        return out

    return Model(arrays(weights), arrays(back), 1.0 / (kinds + 1))


class Scorer:
    """Word numbers and word scores, remembered per language."""

    def __init__(self, model: Model):
        self.model, self.tables = model, model.spread()
        self.known: dict[bytes, dict[bytes, int]] = {}
        self.scores: dict[bytes, np.ndarray] = {}

    def prepare(self, by_lang: dict[bytes, list[list[bytes]]]) -> None:
        """Make sure that all words of these documents are known."""
        if sum(map(len, self.known.values())) > MEMORY:
            self.known, self.scores = {}, {}
        for lang, docs in by_lang.items():
            known = self.known.setdefault(lang, {})
            first = len(known)
            new = [w for words in docs for w in words if w not in known and known.setdefault(w, len(known)) >= first]
            if new:
                scores = self.model.word_scores(new, lang, self.tables)
                self.scores[lang] = np.r_[self.scores.get(lang, np.empty(0)), scores]

    def numbers(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known[lang].__getitem__, words), np.int64, len(words))

    def score(self, lang: bytes, numbers: np.ndarray) -> float | None:
        """Mean score of the different words of each block."""
        if not len(numbers):
            return None
        blocks = np.arange(len(numbers)) // BLOCK
        different = np.unique(blocks * len(self.known[lang]) + numbers) % len(self.known[lang])
        return float(self.scores[lang][different].mean())


def repeated_words(numbers: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """How many items lie in a run of ``width`` items that occurs twice or more."""
    runs = window_hashes(numbers.astype(np.uint64), width)
    if len(runs) < 2:
        return 0
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.flatnonzero(np.isin(runs, twice))
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(body: bytes) -> int:
    seen, again = set(), 0
    for line in body.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return again


STATS = "doc_id long, lang_key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def statistics(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        schema = pa.schema([(f.split()[0], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[f.split()[1]]) for f in STATS.split(", ")])
        for batch in batches:
            rows = [(d, lang, body, body.split()) for d, lang, body in batch_rows(batch, "doc_id", "lang_key", "body")]
            by_lang: dict[bytes, list[list[bytes]]] = {}
            for _, lang, _, words in rows:
                by_lang.setdefault(lang, []).append(words)
            scorer.prepare(by_lang)
            out = []
            for d, lang, body, words in rows:
                numbers = scorer.numbers(lang, words)
                chars = len(b"".join(words).decode("utf-8", "replace"))
                score = scorer.score(lang, numbers)
                out.append((d, lang, len(words), chars, sum(body.count(s) for s in SYMBOLS), repeated_lines(body), repeated_words(numbers), score))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 8)

    return docs.mapInArrow(tidy(measured), STATS)


def bands(scored: DataFrame) -> DataFrame:
    """lang_key, lower, upper: quartiles from counts of scores, widened by the fence."""
    steps = scored.filter("NOT base_failed").groupBy("lang_key", F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang_key")
    upto = F.sum("n").over(by_lang.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    ranked = steps.select("lang_key", "step", upto.alias("upto"), F.sum("n").over(by_lang).alias("of"))

    def quartile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("of"), (F.col("step") + 0.5) * STEP))

    found = ranked.groupBy("lang_key").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_SPREAD)) * FENCE
    return found.select("lang_key", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the measured numbers, base_failed, kept, and the score with its band."""
    lang = F.coalesce(F.col(lang_col).cast("binary"), F.lit(b""))
    texts = keyed_texts(docs.withColumn("lang_key", lang), id_col, text_col, "lang_key")
    measured = stored(statistics(texts, fit(texts)), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = measured.withColumn("base_failed", failed)
    inside = F.coalesce(F.col("score").between(F.col("lower"), F.col("upper")), F.lit(False))
    return scored.join(bands(scored), "lang_key", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "score", "lower", "upper",
    )


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass the rules and the bands, with all their columns."""
    kept = quality(docs, id_col, text_col, lang_col).filter("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return among(docs, stored(kept, "passing"), id_col)
