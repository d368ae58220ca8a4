"""Best-fit packing of documents into sequences by minimum bin slack.

Documents become token ids (the library's ids, then one closing id). Only a document longer
than a sequence is cut, into pieces of the full length and a rest. Sequences are then filled
one kind at a time: the longest length that is left is fixed, and a subset-sum dynamic
program over bitsets finds the fullest combination of the lengths available. That
combination is removed as often as the counts allow, so the work on the driver depends on
the number of different lengths (at most the capacity), not on the number of documents.

Spark does the rest: tokenising, counting pieces by length, numbering the pieces of each
length (salted, so that a length shared by a third of all pieces is no single task), and
turning (length, number) into a sequence and a place in it.

Null texts count as empty: such a document is its closing id alone. Texts of any length are
read whole. Repeated rows are packed as often as they occur. An empty table gives an empty
table. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import batch_rows, byte_symbols, keyed_texts, stored, tidy, to_batches

CAPACITY = 2048
CLOSING_ID = 0

#: Pieces of one length are numbered in this many groups at least, and in larger numbers of
#: groups on larger tables, so that a group holds about GROUP_ROWS rows at most.
GROUPS = 64
GROUP_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Letters whose lower case does not depend on their neighbours, then ASCII signs.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\[-`{-~]*)")


class Ids:
    """Token ids of whole texts as bytes (unsigned little-endian 32-bit numbers).

    The vocabulary drops white space and never joins across it, so the ids of a text are
    those of its blank-separated chunks. A chunk of letters and then signs is two words to
    the vocabulary; they go straight to the library's model, in lower case and in its byte
    symbols, as its own preparation would do. Other chunks take the whole preparation. A
    task remembers chunks: those of the current generation, and those of the one before
    until they are used again.
    """

    LONGEST = 64
    GENERATION = 200_000

    def __init__(self, vocabulary_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_file)
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one word of the vocabulary's own splitting."""
        found = self.known.get(word) or self.before.get(word)
        if found is None:
            symbols = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.symbols)
            found = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(word) <= self.LONGEST:
                self.known[word] = found
        return found

    def _fresh(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        letters, signs = plain.groups()
        return self._word(letters.lower()) + self._word(signs) if signs else self._word(letters.lower())

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.GENERATION:
            self.known, self.before = {"": b""}, self.known
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split) - self.known.keys()
        known, before = self.known, self.before.get
        for chunk in new:
            known[chunk] = before(chunk) or self._fresh(chunk)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for chunk in new:
            if len(chunk) > self.LONGEST:
                del known[chunk]
        return out


def pieces(docs: DataFrame, vocabulary_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary_file)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            keys, bodies = [], []
            for d, b in batch_rows(batch, "doc_id", "body"):
                keys.append(d)
                bodies.append(b.decode("utf-8", "replace"))
            out = []
            for d, found in zip(keys, ids.of(bodies), strict=True):
                whole = found + closing
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    out.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 5)

    return keyed_texts(docs, id_col, text_col).mapInArrow(tidy(cut), PIECES)


def fullest(counts: np.ndarray, fixed: int, capacity: int) -> dict[int, int]:
    """The fullest sequence that holds a piece of length ``fixed``: {length: how many}.

    ``counts[n]`` pieces of length n are available, ``fixed`` among them. Bit s of a bitset
    says whether some combination has the sum s; the bitset after each length is kept to
    find the combination again.
    """
    room = capacity - fixed
    whole = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        many = min(int(counts[length]) - (length == fixed), room // length)
        before, taken = sums, 1
        while many > 0:  # one, two, four ... pieces of the length at a time
            taken = min(taken, many)
            sums |= (sums << (length * taken)) & whole
            many -= taken
            taken *= 2
        steps.append((length, before))
        if sums >> room & 1:
            break
    rest = sums.bit_length() - 1
    chosen = {fixed: 1}
    for length, before in reversed(steps):
        while not before >> rest & 1:
            rest -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def patterns(counts: np.ndarray, capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(how often, {length: how many}) until all pieces are placed, longest lengths first."""
    left = counts.copy()
    for fixed in range(capacity, 0, -1):
        while left[fixed]:
            chosen = fullest(left, fixed, capacity)
            often = min(int(left[length]) // many for length, many in chosen.items())
            for length, many in chosen.items():
                left[length] -= often * many
            yield often, chosen


def places(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, pieces per sequence, first sequence, first offset)."""
    out, sequence = [], 0
    used = np.zeros(capacity + 1, np.int64)
    for often, chosen in patterns(counts, capacity):
        offset = 0
        for length, many in chosen.items():
            first = int(used[length])
            used[length] += often * many
            out.append((length, first, int(used[length]), many, sequence, offset))
            offset += length * many
        sequence += often
    return out


def pack(docs: DataFrame, vocabulary_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module's text."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary_file, capacity, id_col, text_col), "pieces")
    groups = max(GROUPS, cut.count() // GROUP_ROWS)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    per_group = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most `capacity` rows, however large the table is
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_group.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    rows = places(counts, capacity)
    before = per_group.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    in_group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = (
        cut.withColumn("in_group", F.row_number().over(in_group) - 1)
        .join(before, ["length", "salt"])
        .withColumn("number", F.col("in_group") + F.col("before"))
    )
    # the table of places has a few rows per length; its size depends on the capacity only
    schema = "length long, first long, end long, many long, first_sequence long, first_offset long"
    where = spark.createDataFrame(rows, schema)
    within = F.col("number") - F.col("first")
    return (
        numbered.join(
            F.broadcast(where),
            (numbered["length"] == where["length"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")),
        )
        .drop(where["length"])
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.floor(within / F.col("many"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + F.pmod(within, F.col("many")) * F.col("length")).cast("long").alias("offset"),
        )
    )
