"""What the corpus operators share: stored intermediate tables, text batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import shared_folder

#: Words are separated by these characters and by no others.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: Distinct strings a worker remembers before it starts afresh. Bounds memory, not results.
MEMORY = 200_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def removed(table: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``table``, once nothing reads it any more; other tables stay."""
    path = getattr(table, "stored_at", None)
    if path:
        jvm = table.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Distinct ids up to this number are sent to all tasks (8 bytes each); more are joined by shuffle.
SENT_IDS = 500_000


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def among(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose id is among the distinct ``ids`` (or is not, by "left_anti").

    A null id is an id like any other.
    """
    name = free_name(df, "id")
    few = ids.select(F.col(on).alias(name))
    few = F.broadcast(few) if few.count() <= SENT_IDS else few
    return df.join(few, df[on].eqNullSafe(F.col(name)), how)


def dealt_anew(df: DataFrame, column: str) -> DataFrame:
    """The same rows, with the engine unaware that they are already dealt out by ``column``.

    Adaptive execution splits a hot key of a join only where both sides come straight from a
    shuffle; counts that have just been grouped by the key would not.
    """
    return df.withColumn(column, F.col(column).bitwiseXOR(F.lit(0).cast("long")))


def whole_text(column: str = "text") -> Column:
    """The text as bytes; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def keyed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator works on, under names of its own: extra columns of ``df`` cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body"), *[F.col(c) for c in more])


def batch_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over a task's batches; then what it freed goes back to the system.

    Python workers stay between tasks, and share an executor's memory with its JVM.
    """

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


class Remembered(dict):
    """A bounded memory of ``f``; it forgets everything when full, which changes no result."""

    def __init__(self, f, most: int = MEMORY):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value


def word_hashes() -> Remembered:
    """bytes -> 64-bit hash, equal in all processes."""
    return Remembered(xxhash.xxh3_64_intdigest)


def hashed(words: Sequence[bytes], memory: Remembered) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))


#: Odd 64-bit multipliers of the mixing steps; any odd values do.
_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_B
    x = (x ^ (x >> np.uint64(27))) * _MIX_A
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` items, in order; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: hashes of runs of 1, 2, 4 ... items, joined by the binary digits of the width
    total, power, length, start, bits = np.zeros(n, np.uint64), h, 1, 0, width
    while bits:
        if bits & 1:
            total = mixed(total * _MIX_A + power[start : start + n] + np.uint64(length))
            start += length
        bits >>= 1
        if bits:
            power = mixed(power[:-length] * _MIX_B + power[length:])
            length *= 2
    return total


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def to_batches(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 byte values in published byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
