"""Exact substring dedup: removes every word inside a window of words that occurs again.

Levels double: a window of the full length can only be repeated if its halves are, so the
windows of half the length come first, and only what is repeated there is extended to the
full length. At the half level not every window has to be looked at: each full window names
one of its half windows, the one with the smallest hash (the leftmost of equals). The choice
depends on the words alone, so two equal full windows name equal halves, and a text sends
about one half window for ten words through the shuffle, without losing a repeat.

1. Every text sends its named half windows; those that occur once alone are done.
2. Texts with survivors are read again; full windows that named a survivor are counted, a
   text with exact copies counting as often as it occurs.
3. Words in windows that occur twice or more are cut. Texts with exact copies need no more
   reading: all their windows are repeated.

Counting is grouped with map-side sums; positions are then found by joining the counts back,
so a window that a third of all texts share is one row on one side and can be split on the
other. Null texts count as empty. Texts shorter than a window keep everything. Repeated
rows are copies of each other. Empty tables give empty tables. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import batch_rows, dealt_anew, hashed, keyed_texts, signed, stored, to_batches, window_hashes, word_hashes

LENGTH = 35

#: Forgotten at the end of a task: an idle worker should be small.
_WORDS = word_hashes()


def half_of(length: int) -> int:
    return (length + 1) // 2


def leftmost_minima(x: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` items the place of its smallest, the leftmost of equals."""
    places, length = np.arange(len(x)), 1
    while length < span:
        step = min(length, span - length)
        left, right = places[: len(places) - step], places[step:]
        places = np.where(x[right] < x[left], right, left)
        length += step
    return places


def named_halves(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all half windows, place of the half window each full window names)."""
    if len(h) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    halves = window_hashes(h, half_of(length))
    return halves, leftmost_minima(halves, length - half_of(length) + 1)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first_level(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("all_sha256", pa.string()), ("halves", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, row, text, body in batch_rows(batch, "doc_id", "row_key", "text_key", "body"):
                words = body.split()
                halves, named = named_halves(hashed(words, _WORDS), length)
                places = np.unique(named)
                out.append((d, row, text, len(words), _digest(words), signed(halves[places]), places.astype(np.int32)))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 7)
        _WORDS.clear()

    return run, "doc_id long, row_key long, text_key long, n_words long, all_sha256 string, halves array<long>, places array<int>"


def _full_level(length: int):
    schema = pa.schema([("window", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body, alive, copies in batch_rows(batch, "row_key", "body", "alive", "copies"):
                h = hashed(body.split(), _WORDS)
                _, named = named_halves(h, length)
                starts = np.flatnonzero(np.isin(named, np.array(alive, np.int64)))
                windows = window_hashes(h, length)[starts]
                yield to_batches(schema, (signed(windows), np.full(len(starts), row), starts.astype(np.int32), np.full(len(starts), copies)))
        _WORDS.clear()

    return run, "window long, row_key long, start int, copies long"


def _cut(length: int):
    schema = pa.schema([("row_key", pa.int64()), ("cut_words", pa.int64()), ("cut_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, body, starts in batch_rows(batch, "row_key", "body", "starts"):
                words = body.split()
                gone = covered(np.array(starts, np.int64), length, len(words))
                out.append((row, int(gone.sum()), _digest([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 3)

    return run, "row_key long, cut_words long, cut_sha256 string"


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "body").alias("row_key"), F.xxhash64("body").alias("text_key"), "body")
    rows = stored(texts.mapInArrow(*_first_level(length)), "half-windows")
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("row_key").alias("row_key"))

    sent = rows.select("text_key", F.explode(F.arrays_zip("halves", "places")).alias("s")).select("text_key", "s.halves", "s.places")
    again = dealt_anew(sent.groupBy("halves").agg(F.count("*").alias("n")).filter("n > 1").select("halves"), "halves")
    alive = sent.join(again, "halves").groupBy("text_key").agg(F.collect_set("places").alias("alive"))
    alive = stored(alive.join(copies, "text_key").select("row_key", "alive", "copies"), "alive")

    # from here on one query: the texts are dealt out by row once and used for both joins
    keyed = texts.select("row_key", "body")
    full = keyed.join(alive, "row_key").mapInArrow(*_full_level(length))
    twice = dealt_anew(full.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window"), "window")
    starts = full.filter("copies = 1").join(twice, "window").groupBy("row_key").agg(F.collect_set("start").alias("starts"))
    cut = keyed.join(starts, "row_key").mapInArrow(*_cut(length)).groupBy("row_key").agg(F.first("cut_words").alias("cut_words"), F.first("cut_sha256").alias("cut_sha256"))

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = (F.col("copies") > 1) & (F.col("n_words") >= length)
    placed = rows.select("doc_id", "row_key", "text_key", "n_words", "all_sha256").join(copies.select("text_key", "copies"), "text_key").join(cut, "row_key", "left")
    return placed.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"),
    )
