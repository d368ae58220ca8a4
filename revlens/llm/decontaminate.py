"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case, with runs of blanks and ASCII punctuation as one blank. A
benchmark item longer than PART characters is searched as segments of PART characters, one
every STRIDE, so that every passage of PART + STRIDE - 1 characters holds a whole segment and
is found wherever it starts in the item, however long the item is. An item of up to SEGMENT
characters is searched as a whole besides: its edits may then lie anywhere. Two strings within k edits share at least
``length + 1 - q - k * q`` q-grams, and on diagonals (place in the text less place in the
segment) that lie at most k apart. So the q-grams a text shares with a segment are counted
in overlapping bands of diagonals, only bands that reach the bound are kept, and each of
their regions is verified by an alignment of the segment with that stretch of the text
alone, with free ends in the text.

Documents are scanned once per block of the benchmark and are never shuffled. The benchmark
is the stated query set: it goes to the executors in blocks of at most BLOCK characters, so
what is broadcast is bounded however large it is, and every block meets every document.

Null and empty texts and items match nothing, nor do items shorter than a q-gram. Texts are
read whole. Repeated documents and items give repeated results. An empty table on either
side gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import among, batch_rows, keyed_texts, stored, tidy, to_batches

Q = 8
EDIT_PERCENT = 8
SEGMENT = 128
PART, STRIDE = 64, 16
BLOCK = 1_000_000
_TABLE_BITS = 20

_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_BLANKED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_BASE = 0x9E3779B97F4A7C15

RESULT = "doc_id long, item_id long, edits int, matched_chars int, item_chars int"


def normalised(body: bytes) -> np.ndarray:
    """Code points of the text as it is compared."""
    text = body.decode("utf-8", "replace").lower().encode().translate(_BLANKED)
    text = b" ".join(text.split())
    if text.isascii():
        return np.frombuffer(text, np.uint8)
    return np.frombuffer(text.decode().encode("utf-32-le"), "<u4")


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit number for each q-gram (q a power of two), by joining halves."""
    if len(chars) < q:
        return np.empty(0, np.uint64)
    h, length, base = chars.astype(np.uint64) + np.uint64(1), 1, _BASE
    while length < q:
        h = h[:-length] * np.uint64(base) + h[length:]
        base = base * base % 2**64
        length *= 2
    return h


def _cell(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(_BASE)) >> np.uint64(64 - _TABLE_BITS)


class Index:
    """Segments of a block of the benchmark and the places of their q-grams."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        self.segments: list[tuple[int, int, np.ndarray]] = []  # item number, offset, characters
        grams, owners, places = [], [], []
        for number, (_, chars) in enumerate(items):
            last = max(0, len(chars) - PART)
            cuts = [(offset, PART) for offset in sorted({*range(0, last, STRIDE), last, max(0, last - PART)})]
            if len(chars) <= SEGMENT:
                cuts = [(0, SEGMENT), *(cuts if last else [])]
            for offset, size in cuts:
                part = chars[offset : offset + size]
                g = qgrams(part)
                if not len(g):
                    continue
                grams.append(g)
                owners.append(np.full(len(g), len(self.segments), np.int64))
                places.append(np.arange(len(g)))
                self.segments.append((number, offset, part))
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.r_[first, len(flat)]
        self.owner = np.concatenate(owners)[order] if grams else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if grams else np.empty(0, np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_cell(self.grams)] = True
        sizes = np.array([len(s[2]) for s in self.segments], np.int64)
        self.budget = sizes * EDIT_PERCENT // 100
        self.bound = np.maximum(sizes + 1 - Q - self.budget * Q, 1)

    def regions(self, chars: np.ndarray) -> Iterator[tuple[int, int]]:
        """(segment, first diagonal) of the bands that reach the bound of their segment."""
        h = qgrams(chars)
        at = np.flatnonzero(self.table[_cell(h)])
        if not len(at):
            return
        known = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[known] == h[at]
        at, known = at[real], known[real]
        many = self.first[known + 1] - self.first[known]
        entry = np.repeat(self.first[known], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        segment = self.owner[entry]
        diagonal = np.repeat(at, many) - self.place[entry] + SEGMENT
        half = self.budget[segment] + 1
        # a band spans two halves; each hit lies in two bands, so that k + 1 neighbouring
        # diagonals always share one
        band = diagonal // half
        keys = np.concatenate([segment << 40 | band + 1, segment << 40 | band])
        keys, counts = np.unique(keys, return_counts=True)
        segment, band = keys >> 40, (keys & (1 << 40) - 1) - 1
        good = counts >= self.bound[segment]
        for s, b in zip(segment[good].tolist(), band[good].tolist(), strict=True):
            yield s, b * int(self.budget[s] + 1) - SEGMENT

    def matches(self, chars: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, edits, matched characters of the item)."""
        best: dict[int, int] = {}
        for s, diagonal in self.regions(chars):
            if best.get(s) == 0:
                continue
            k = int(self.budget[s])
            edits = aligned(self.segments[s][2], chars, diagonal, 2 * (k + 1), k)
            if edits is not None:
                best[s] = min(edits, best.get(s, edits))
        found: dict[int, list[int]] = {}
        for s in best:
            found.setdefault(self.segments[s][0], []).append(s)
        out = []
        for number, parts in found.items():
            hit = np.zeros(len(self.items[number][1]), bool)
            for s in parts:
                _, offset, part = self.segments[s]
                hit[offset : offset + len(part)] = True
            out.append((number, min(best[s] for s in parts), int(hit.sum())))
        return out


def aligned(part: np.ndarray, chars: np.ndarray, diagonal: int, width: int, k: int) -> int | None:
    """Least edits that turn ``part`` into some stretch of ``chars``; None if above k.

    Only cells on ``width`` diagonals from ``diagonal`` on, and k more to either side, are
    computed. Places outside the text match nothing.
    """
    first, cells = diagonal - k, width + 2 * k
    stretch = np.full(len(part) + cells, -1, np.int64)
    low, high = max(0, first), min(len(chars), first + len(stretch))
    if low < high:
        stretch[low - first : high - first] = chars[low:high]
    windows = np.lib.stride_tricks.sliding_window_view(stretch[: len(part) + cells - 1], len(part))
    if (windows == part).all(axis=1).any():
        return 0
    steps = np.arange(cells)
    row = np.zeros(cells, np.int64)
    for i, c in enumerate(part.tolist()):
        down = row + (stretch[i : i + cells] != c)
        np.minimum(down[:-1], row[1:] + 1, out=down[:-1])
        row = np.minimum.accumulate(down - steps) + steps
        if row.min() > k:
            return None
    return int(row.min())


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items in blocks of at most BLOCK characters (one item at least)."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        chars = normalised(bytes(row["body"]))
        if block and size + len(chars) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row["doc_id"], chars))
        size += len(chars)
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and item found in it: edits of the best segment, characters matched."""
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col)
    results = []
    for block in _blocks(keyed_texts(benchmark, item_id_col, item_text_col)):
        shared = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("matched_chars", pa.int32()), ("item_chars", pa.int32())])
            for batch in batches:
                out = []
                for d, body in batch_rows(batch, "doc_id", "body"):
                    for number, edits, matched in index.matches(normalised(body)):
                        item_id, chars = index.items[number]
                        out.append((d, item_id, edits, matched, len(chars)))
                yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 5)

        results.append(texts.mapInArrow(tidy(searched), RESULT))
    if not results:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, results)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return among(docs, stored(found, "contaminated"), id_col, "left_anti")
