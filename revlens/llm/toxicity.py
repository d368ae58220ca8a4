"""Toxicity scores of restored text: a noisy-channel decoder in front of a learned score.

A written word may hide the word that was meant behind digits and signs that look like
letters (l0ser), stretched letters (stuuupid), separators (i.d.i.o.t) or blanks between
single letters (i d i o t). Such a word becomes a lattice: at each written character the
letters it may stand for, or nothing, at a cost of its own. Viterbi decoding finds the
cheapest path under a character model of four letters. The model is counted by Spark over
all texts, on 28 symbols (letters, any other letter, the gap between words), so it has at
most 28**4 numbers, however large the corpus is. Words of letters alone pass unchanged.

The score is a logistic regression on the restored words of a text and on the beginnings of
these words, since insults come with many endings (each counts once, hashed to
2**FEATURE_BITS cells). It is fitted on labelled rows outside the held-out fold;
of these, at most about TRAIN_ROWS are taken, chosen by a hash of their id. Labels, language,
source and id are never inputs of a score.

Null texts count as empty; an empty text gets the score of no evidence. Texts are read
whole. Repeated rows give repeated results. Without any label, or with one kind of label, all
scores are the share of toxic labels. An empty table gives an empty table. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Remembered, batch_rows, keyed_texts, tidy, to_batches

FEATURE_BITS = 20
PREFIXES = (4, 5, 6, 7)
TRAIN_ROWS = 20_000
CHOSEN = 4096
MIN_ROWS = 5
THRESHOLD = 0.3
HELD_OUT = 2
FOLDS = 4

#: Fixed value: letters that signs and digits are written for.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "bg",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "+": "t",
    "(": "c",
    "€": "e",
    "|": "il",
}
#: Signs that may hide any letter.
HIDING = "*#%&"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs (negative log probabilities) of what a writer may do to a letter.
COST = {"same": 0.0, "lookalike": 1.0, "hidden": 3.0, "repeat": 0.5, "separator": 0.5}

GAP, OTHER, SYMBOLS, GRAM = 26, 27, 28, 4

_SYMBOL_OF_BYTE = np.full(256, OTHER, np.int64)
_SYMBOL_OF_BYTE[:128] = GAP
for _i, _c in enumerate(LETTERS):
    _SYMBOL_OF_BYTE[ord(_c)] = _SYMBOL_OF_BYTE[ord(_c.upper())] = _i

_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t][^\W_]){2,}(?!\S)")
_TRIM_FRONT = "\"'.,;:!?()[]{}<>-_=/\\|*#%&~`^+"
_TRIM_BACK = _TRIM_FRONT + "$@"


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**GRAM, np.int64)
    for batch in batches:
        for (body,) in batch_rows(batch, "body"):
            s = np.r_[[GAP] * (GRAM - 1), _SYMBOL_OF_BYTE[np.frombuffer(body, np.uint8)], [GAP]]
            # one gap between words, however many signs stand there
            s = np.r_[[GAP] * (GRAM - 2), s[np.r_[True, (s[1:] != GAP) | (s[:-1] != GAP)]]]
            code = np.zeros(max(0, len(s) - GRAM + 1), np.int64)
            for k in range(GRAM):
                code = code * SYMBOLS + s[k : k + len(code)]
            np.add(counts, np.bincount(code, minlength=len(counts)), out=counts) if len(code) > 20_000 else np.add.at(counts, code, 1)
    cells = np.flatnonzero(counts)
    for k in range(0, len(cells), 50_000):
        part = cells[k : k + 50_000]
        yield to_batches(pa.schema([("gram", pa.int32()), ("n", pa.int64())]), (part.astype(np.int32), counts[part]))


def character_costs(texts: DataFrame) -> np.ndarray:
    """Cost of each symbol after three others, from the counts of the whole corpus.

    Each order is smoothed by the next lower one, in proportion to how many different
    symbols follow a context.
    """
    found = texts.select("body").mapInArrow(_gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**GRAM)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape((SYMBOLS,) * GRAM)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, GRAM + 1):
        c = counts.sum(axis=tuple(range(GRAM - order)))
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = (c + kinds * p + 1e-9 * p) / (total + kinds + 1e-9)
    return -np.log(p).reshape(-1, SYMBOLS)


def options(word: str) -> list[list[tuple[int | None, float]]]:
    """The lattice: for each written character, letters (None: nothing) with costs."""
    out = []
    for k, c in enumerate(word):
        if c in LETTERS:
            ways = [(LETTERS.index(c), COST["same"])]
        elif c.isalpha():
            ways = [(OTHER, COST["same"])]
        else:
            ways = [(LETTERS.index(x), COST["lookalike"]) for x in LOOKALIKES.get(c, "")]
            if c in HIDING:
                ways += [(i, COST["hidden"]) for i in range(26)]
            ways.append((None, COST["separator"]))
        if k and c == word[k - 1]:
            ways.append((None, COST["repeat"]))
        out.append(ways)
    return out


def decoded(word: str, costs: np.ndarray) -> str:
    """The cheapest reading of a written word."""
    start = (GAP, GAP, GAP)
    paths: dict[tuple[int, int, int], tuple[float, str]] = {start: (0.0, "")}
    for k, ways in enumerate(options(word)):
        ahead: dict[tuple[int, int, int], tuple[float, str]] = {}
        for state, (cost, text) in paths.items():
            row = costs[(state[0] * SYMBOLS + state[1]) * SYMBOLS + state[2]]
            for symbol, extra in ways:
                if symbol is None:
                    after, total, longer = state, cost + extra, text
                else:
                    after = (state[1], state[2], symbol)
                    total = cost + extra + float(row[symbol])
                    longer = text + (word[k] if symbol == OTHER else LETTERS[symbol])
                if after not in ahead or total < ahead[after][0]:
                    ahead[after] = (total, longer)
        paths = ahead
    ends = [(cost + float(costs[(s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]][GAP]), text) for s, (cost, text) in paths.items()]
    return min(ends)[1]


def _stretched(word: str) -> bool:
    return any(word[k] == word[k + 1] == word[k + 2] for k in range(len(word) - 2))


def cells_of(word: str) -> tuple[int, ...]:
    """Feature cells of a restored word: the word and its beginnings."""
    if not word:
        return ()
    names = [word] + ["^" + word[:k] for k in PREFIXES if len(word) >= k]
    return tuple(zlib.crc32(x.encode()) & (1 << FEATURE_BITS) - 1 for x in names)


class Restorer:
    """Features of whole texts, by their restored words; of all cells or of chosen ones."""

    def __init__(self, costs: np.ndarray, chosen: frozenset[int] | None = None):
        self.costs, self.chosen = costs, chosen
        self.known = Remembered(self._cells)

    def restored(self, written: str) -> str:
        word = written.lower().lstrip(_TRIM_FRONT).rstrip(_TRIM_BACK)
        if not any(c.isalpha() for c in word):
            return ""
        if word.isalpha() and not _stretched(word):
            return word
        return decoded(word, self.costs)

    def _cells(self, written: str) -> tuple[int, ...]:
        cells = cells_of(self.restored(written))
        return cells if self.chosen is None else tuple(c for c in cells if c in self.chosen)

    def words(self, text: str) -> list[str]:
        """Written words; single letters with blanks between them become one word."""
        return _SPACED.sub(lambda m: re.sub(r"[ \t]", "", m[0]), text).split()

    def features(self, body: bytes) -> np.ndarray:
        found: set[int] = set()
        found.update(*map(self.known.__getitem__, set(self.words(body.decode("utf-8", "replace")))))
        return np.sort(np.fromiter(found, np.int64, len(found)))


def fitted(cell: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 300, penalty: float = 4e-4) -> tuple[np.ndarray, float]:
    """(weights of all cells, intercept) of a logistic regression with a lasso penalty.

    ``cell`` holds the cells of all rows, one row after the other; ``sizes`` how many each has.

    Only the CHOSEN cells whose shares among the two kinds of rows differ most, in standard
    errors, take part; accelerated proximal gradient steps.
    """
    weights = np.zeros(1 << FEATURE_BITS)
    share = float(labels.mean()) if len(labels) else 0.0
    share = min(max(share, 0.0), 1.0)
    if share in (0.0, 1.0):
        return weights, 40.0 if share else -40.0
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    size = 1 << FEATURE_BITS
    positive = np.bincount(cell[labels[owner] > 0], minlength=size)
    both = np.bincount(cell, minlength=size)
    expected = both * share
    z = np.where(both >= MIN_ROWS, np.abs(positive - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9)), 0)
    chosen = np.argsort(-z, kind="stable")[:CHOSEN]
    chosen = chosen[z[chosen] > 0]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    inside = np.flatnonzero(place[cell] >= 0)
    owner, column = owner[inside], place[cell[inside]]
    n, m = len(sizes), len(chosen)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=w[column], minlength=n)

    # step size from the largest singular value of the rows, by power iteration
    v = np.ones(m + 1)
    for _ in range(20):
        u = margins(v[:-1]) + v[-1]
        v = np.r_[np.bincount(column, weights=u[owner], minlength=m), u.sum()]
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 4.0 * n / max(top, 1e-9)
    w = look = np.zeros(m + 1)
    look[-1] = w[-1] = math.log(share / (1 - share))
    momentum = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(margins(look[:-1]) + look[-1])))
        error = (p - labels) / n
        gradient = np.r_[np.bincount(column, weights=error[owner], minlength=m), error.sum()]
        new = look - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty * share, 0)
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    weights[chosen] = w[:-1]
    return weights, float(w[-1])


def held_out(id_col: str) -> Column:
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def chosen(id_col: str, share: float) -> Column:
    """Whether a row belongs to a sample of this share, by 62 bits of its id's hash: no share is too small."""
    return F.shiftrightunsigned(F.xxhash64(id_col), 2) < F.lit(int(share * 2**62))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col)
    costs = spark.sparkContext.broadcast(character_costs(texts))

    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    # bounded by TRAIN_ROWS: small enough to send to every task
    sample = known.filter(chosen("doc_id", share))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs.value)
        schema = pa.schema([("label", pa.int32()), ("cells", pa.list_(pa.int32()))])
        for batch in batches:
            rows = [(label, restorer.features(body).astype(np.int32)) for label, body in batch_rows(batch, "label", "body")]
            yield to_batches(schema, zip(*rows, strict=True) if rows else [[]] * 2)

    train = texts.join(F.broadcast(sample), "doc_id").select(F.col("label").cast("int").alias("label"), "body").mapInArrow(tidy(features), "label int, cells array<int>").toArrow()
    cells = train.column("cells").combine_chunks()
    sizes = np.diff(cells.offsets.to_numpy()) if len(cells) else np.empty(0, np.int64)
    model = spark.sparkContext.broadcast(fitted(cells.flatten().to_numpy(), sizes, train.column("label").to_numpy().astype(float)))
    del train, cells

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model.value
        restorer = Restorer(costs.value, frozenset(np.flatnonzero(weights).tolist()))
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            out = []
            for d, body in batch_rows(batch, "doc_id", "body"):
                out.append((d, 1 / (1 + math.exp(-max(-60.0, min(60.0, float(weights[restorer.features(body)].sum()) + intercept))))))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 2)

    result = texts.mapInArrow(tidy(scored), "doc_id long, score double")
    return result.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
