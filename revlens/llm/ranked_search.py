"""Ranked lexical search: the best documents for each item of a query set, by presence masks.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is
lower-cased. N counts the documents with a term, L all their terms, n one document's terms,
df the documents that hold a term, tf its occurrences in the document. The weight of a term
is w = floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is 50 + (50 * n * N) div L; its
score sums w * ((10^9 * tf) div (1000 * tf + 20 * m)) over the item's distinct terms.

The items go out in blocks of at most BLOCK term occurrences (one item at least). The texts
are cut into terms once per block; what is stored is, per document, n and the counts of the
block's terms. N, L and df are Spark aggregates of that table. Then every task searches its
documents batch by batch: an item's terms are bitmaps over the batch, whose columns are the
documents' masks of matched terms; documents of equal masks form a group; a group's maximum
score is the sum of the highest contribution each of its terms has in the batch. Groups are
scored from the highest maximum down, until the next maximum is below the score of the item's
``best``-th document so far, which no later document can reach. Each task returns at most
``best`` documents an item; they are ranked in two steps, by item and salt, then by item.

Equal scores are ranked by ascending id, null ids last. Null and empty texts have no term
and are no part of N. Every row counts as a document, rows with equal ids too; every row of
the query set is an item of its own. An item without terms, or whose terms no document holds,
returns no row. Empty tables give empty tables. Further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import batch_rows, keyed_texts, stored, tidy, to_batches

BEST = 50
#: Occurrences of terms in a block of items; bounds what is broadcast and what a task holds.
BLOCK = 1_000_000
#: Parts an item's candidates are ranked in before they meet.
SALTS = 64

RESULT = "item_id long, rank int, doc_id long, score long"

#: ASCII letters and digits as lower case, all other ASCII as blanks, the rest as it is.
_TERM_BYTES = bytes((chr(b).lower().encode()[0] if chr(b).isalnum() else 32) if b < 128 else b for b in range(256))


def terms(body: bytes) -> list[bytes]:
    return body.translate(_TERM_BYTES).split()


class Items:
    """A block of items: ids, the numbers of their terms, and the block's vocabulary."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, found in rows for t in found}))}
        self.terms = [np.array(sorted(self.vocabulary[t] for t in found), np.int64) for _, found in rows]


def _blocks(queries: DataFrame, most: int) -> Iterator[Items]:
    block, size = [], 0
    for row in queries.toLocalIterator():
        found = sorted(set(terms(bytes(row["body"]))))
        if block and size + len(found) > most:
            yield Items(block)
            block, size = [], 0
        block.append((row["doc_id"], found))
        size += len(found)
    if block:
        yield Items(block)


def _counted(shared):
    """doc_id, n, and the numbers and counts of the block's terms, of documents with a term."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.vocabulary.get
        for batch in batches:
            out = []
            for d, body in batch_rows(batch, "doc_id", "body"):
                words = terms(body)
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    out.append((d, len(words), list(found), list(found.values())))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 4)

    return run


class Ranking:
    """The best documents of one item so far."""

    def __init__(self, best: int):
        self.best = best
        self.scores, self.ids, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.missing, missing]
        order = np.lexsort((ids, missing, -scores))[: self.best]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]

    @property
    def least(self) -> int:
        """Scores below this cannot enter any more; scores of zero never do."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.best else 1


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal columns of a (terms, documents) bitmap: group of each column, a column per group."""
    packed = np.packbits(present, axis=0)
    packed = np.vstack([packed, np.zeros((-len(packed) % 8, packed.shape[1]), np.uint8)])
    words = np.ascontiguousarray(packed.T).view(np.uint64)
    group = np.zeros(len(words), np.int64)
    for k in range(words.shape[1]):
        _, part = np.unique(words[:, k], return_inverse=True)
        _, first, group = np.unique(group * (part.max() + 1) + part, return_index=True, return_inverse=True)
    return group, first


class Batch:
    """Documents of a batch with postings per term and the highest contribution of each term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, length: int):
        def column(name: str) -> pa.Array:
            return batch.column(batch.schema.get_field_index(name))

        ids = column("doc_id")
        self.missing = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.m = np.array([50 + 50 * n * documents // length for n in column("n").to_pylist()], np.int64)
        lists, counts = column("terms"), column("counts")
        owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        term, tf = np.asarray(lists.flatten()), np.asarray(counts.flatten())
        order = np.argsort(term, kind="stable")
        self.owner, self.tf, term = owner[order], tf[order], term[order]
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.weights = weights
        self.highest = np.zeros(len(weights), np.int64)
        if len(term):
            gained = weights[term] * (10**9 * self.tf // (1000 * self.tf + 20 * self.m[self.owner]))
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            self.highest[term[starts]] = np.maximum.reduceat(gained, starts)

    def search(self, item: np.ndarray, ranking: Ranking) -> None:
        item = item[self.first[item] < self.first[item + 1]]
        if not len(item):
            return
        counts = np.zeros((len(item), len(self.ids)), np.int64)
        for k, t in enumerate(item.tolist()):
            here = slice(self.first[t], self.first[t + 1])
            counts[k, self.owner[here]] = self.tf[here]
        present = counts > 0
        group, example = masks_of(present)
        # whole numbers below 2^53: exact, and one matrix product
        maximum = self.highest[item].astype(float) @ present[:, example].astype(float)
        by_group = np.argsort(group, kind="stable")
        first = np.searchsorted(group[by_group], np.arange(len(example) + 1))
        order = np.argsort(-maximum, kind="stable")
        reached = np.cumsum(np.diff(first)[order])  # documents in the groups up to each
        done, step = 0, ranking.best
        while done < len(order) and maximum[order[done]] >= ranking.least:
            end = int(np.searchsorted(reached, (reached[done - 1] if done else 0) + step)) + 1
            chosen = order[done:end]
            chosen = chosen[maximum[chosen] >= ranking.least]
            rows = np.concatenate([by_group[first[g] : first[g + 1]] for g in chosen])
            tf = counts[:, rows]
            scores = (self.weights[item][:, None] * (10**9 * tf // (1000 * tf + 20 * self.m[rows]))).sum(axis=0)
            good = scores >= ranking.least
            ranking.add(scores[good], self.ids[rows[good]], self.missing[rows[good]])
            done, step = end, 2 * step


def _searched(shared, weights: np.ndarray, documents: int, length: int, best: int):
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        rankings = [Ranking(best) for _ in items.ids]
        for batch in batches:
            rows = Batch(batch, weights, documents, length)
            for item, ranking in zip(items.terms, rankings, strict=True):
                rows.search(item, ranking)
        for number, (i, r) in enumerate(zip(items.ids, rankings, strict=True)):
            if n := len(r.scores):
                yield to_batches(schema, [[number] * n, [i] * n, pa.array(r.ids, mask=r.missing), r.scores])

    return run


def ranked(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    best: int = BEST,
    block: int = BLOCK,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above zero."""
    spark = docs.sparkSession
    texts, results = keyed_texts(docs, id_col, text_col), []
    for items in _blocks(keyed_texts(queries, item_id_col, item_text_col), block):
        shared = spark.sparkContext.broadcast(items)
        counted = texts.mapInArrow(tidy(_counted(shared)), "doc_id long, n long, terms array<int>, counts array<long>")
        counted = stored(counted, "term-counts")
        documents, length = counted.agg(F.count("n"), F.sum("n")).first()
        if not documents:
            continue
        # one row per term of the block
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(items.vocabulary), np.int64)
        for term, df in holding:
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        found = counted.mapInArrow(tidy(_searched(shared, weights, documents, length, best)), "item int, item_id long, doc_id long, score long")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= best)
        whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
        results.append(whole.select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], RESULT)
