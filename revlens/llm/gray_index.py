"""Near-duplicate documents by SimHash: a Hamming join over a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its
4-word shingles have it, repeats included (ASCII letters lower-cased; a document of fewer
words is one shingle). Fingerprints that differ in at most ``bits`` bits are linked.

The index holds distinct fingerprints only. The 64 bits are cut into ``bits + agree`` blocks;
two fingerprints within ``bits`` differences agree in ``agree`` blocks at least, so for every
choice of that many blocks (a turn) they are put in front and the fingerprints are sorted by
the rank of the rearranged code in the Gray sequence. Neighbours in that order differ in few
bits and share long patterns. An upper node is the pattern of the leading blocks; under it
lie leaves of up to LEAF neighbours, each with the mask of the bits all its codes share and
their values, and in a leaf, groups of GROUP neighbours with masks of their own. A search
goes down pairs of nodes: the differences of two patterns under both masks count for every
pair of codes below, and a pair of nodes beyond ``bits`` is dropped as a whole. ``agree``
grows with the number of fingerprints, so that an upper node holds few leaves at every size;
any value gives the same links.

Codes that meet in two leaves are reported as a star per connected group, never as all pairs,
so that a large group of near copies costs no square of rows. The sort deals distinct
(turn, rank) pairs by range: no key is hot. Components come from ``linking``.

Null and empty texts have no shingle: fingerprint zero, linked like any other. Texts are read
whole. A null id is never the smallest of its component; a component of null ids alone has a
null component_id. Rows with equal ids stay rows of their own. Empty tables give empty
tables. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import among, dealt_anew, keyed_texts, stored, tidy, to_batches
from revlens.llm.linking import components

SHINGLE = 4
SEED = 42
BITS = 4
#: Codes of a leaf, and of a group in it.
LEAF, GROUP = 512, 16
#: Blocks that agree, at most; 70 turns with four differences.
MOST_AGREE = 4

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_PLACE = np.arange(8) * 256


def shingle_digests(body: bytes) -> Iterator[bytes]:
    """The hashes of a text's shingles in order, repeats included, 65,536 at a time."""
    words = body.lower().split()
    if not words:
        return
    width = min(SHINGLE, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    firsts, lasts = starts[: len(words) - width + 1], ends[width - 1 :]
    for k in range(0, len(firsts), 65_536):
        cuts = map(slice, firsts[k : k + 65_536].tolist(), lasts[k : k + 65_536].tolist())
        yield b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, cuts), repeat(SEED)))


def fingerprint(body: bytes) -> int:
    """The 64 bits as an unsigned number."""
    total, ones = 0, np.zeros(64, np.int64)
    for digests in shingle_digests(body):
        octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        total += len(octets)
        ones += (np.bincount((octets + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        bodies = batch.column(batch.schema.get_field_index("body"))
        codes = np.fromiter((fingerprint(b.as_py()) for b in bodies), np.uint64, len(bodies))
        yield to_batches(schema, [ids, codes.view(np.int64)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a long) of every row."""
    return keyed_texts(docs, id_col, text_col).mapInArrow(tidy(_fingerprints), "doc_id long, fingerprint long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the binary-reflected Gray sequence."""
    rank = code.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class Turns:
    """The rearrangements of 64 bits: each puts another choice of ``agree`` blocks in front."""

    def __init__(self, bits: int, agree: int):
        blocks = bits + agree
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.blocks = [(edges[k], edges[k + 1] - edges[k]) for k in range(blocks)]
        self.choices = list(combinations(range(blocks), agree))

    def __len__(self) -> int:
        return len(self.choices)

    def front(self, turn: int) -> int:
        """Bits in the leading blocks."""
        return sum(self.blocks[b][1] for b in self.choices[turn])

    def arranged(self, code: np.ndarray, turn: int) -> np.ndarray:
        chosen = self.choices[turn]
        out, left = np.zeros_like(code), 64
        for b in [*chosen, *(b for b in range(len(self.blocks)) if b not in chosen)]:
            low, width = self.blocks[b]
            left -= width
            out |= (code >> np.uint64(low) & np.uint64((1 << width) - 1)) << np.uint64(left)
        return out


def agreeing_blocks(n: int, bits: int) -> int:
    """As many as leave an upper node about a leaf of ``n`` evenly spread codes."""
    for agree in range(1, MOST_AGREE):
        if n >> (agree * (64 // (bits + agree))) <= LEAF:
            return agree
    return MOST_AGREE


_SORTED = pa.schema([("turn", pa.int32()), ("upper", pa.int64()), ("rank", pa.int64()), ("code", pa.int64())])
_LEAVES = "turn int, upper long, first long, mask long, pattern long, codes array<long>"


def _ranked(turns: Turns):
    """Each code once per turn, with its upper node and its rank in an order of signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for turn in range(len(turns)):
                rank = gray_rank(turns.arranged(code, turn))
                upper = (rank >> np.uint64(64 - turns.front(turn))).astype(np.int64)
                place = (rank ^ np.uint64(1 << 63)).view(np.int64)
                yield to_batches(_SORTED, [np.full(len(code), turn, np.int32), upper, place, code.view(np.int64)])

    return run


def factored(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that all codes of a run share, and their values, per run."""
    every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return ~(every ^ some), every


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most LEAF neighbours under one upper node, of rows sorted by turn and rank."""
    schema = pa.schema([("turn", pa.int32()), ("upper", pa.int64()), ("first", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("codes", pa.list_(pa.int64()))])

    def written(turn, upper, code, starts) -> pa.RecordBatch:
        mask, pattern = factored(code.view(np.uint64), starts)
        offsets = pa.array(np.r_[starts, len(code)].astype(np.int32))
        codes = pa.ListArray.from_arrays(offsets, pa.array(code))
        return to_batches(schema, [turn[starts], upper[starts], code[starts], mask.view(np.int64), pattern.view(np.int64), codes])

    held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
    for batch in batches:
        new = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("turn", "upper", "code")]
        turn, upper, code = (np.concatenate(pair) for pair in zip(held, new, strict=True))
        if not len(code):
            continue
        changes = np.flatnonzero((turn[1:] != turn[:-1]) | (upper[1:] != upper[:-1])) + 1
        runs = np.r_[0, changes]
        place = np.arange(len(code)) - np.repeat(runs, np.diff(np.r_[runs, len(code)]))
        starts = np.flatnonzero(place % LEAF == 0)
        last = starts[-1]  # may go on in the next batch
        if len(starts) > 1:
            yield written(turn[:last], upper[:last], code[:last], starts[:-1])
        held = [turn[last:], upper[last:], code[last:]]
    if len(held[2]):
        yield written(*held, np.zeros(1, np.int64))


def near_pairs(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the codes of two leaves that differ in at most ``bits`` bits."""
    starts_a, starts_b = np.arange(0, len(a), GROUP), np.arange(0, len(b), GROUP)
    (mask_a, of_a), (mask_b, of_b) = factored(a, starts_a), factored(b, starts_b)
    apart = np.bitwise_count((of_a[:, None] ^ of_b[None, :]) & mask_a[:, None] & mask_b[None, :])
    ga, gb = np.nonzero(apart <= bits)
    steps = np.arange(GROUP)
    i = np.minimum(starts_a[ga][:, None] + steps, len(a) - 1)  # a short last group repeats its end
    j = np.minimum(starts_b[gb][:, None] + steps, len(b) - 1)
    g, x, y = np.nonzero(np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= bits)
    return i[g, x], j[g, y]


def star_links(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the links ``i``, ``j`` connect it with."""
    least = np.arange(n)
    while True:
        both = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _joined(bits: int):
    """(a, b): a star for every connected group of codes of two leaves, or of one (``other`` null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for mine, other in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("codes", "other")), strict=True):
                a = mine.values.to_numpy().view(np.uint64)
                b = other.values.to_numpy().view(np.uint64) if other.is_valid else a
                i, j = near_pairs(a, b, bits)
                nodes = a
                if other.is_valid:
                    nodes, j = np.concatenate([a, b]), j + len(a)
                least = star_links(len(nodes), i, j)
                leaf = np.flatnonzero(least != np.arange(len(nodes)))
                if len(leaf):
                    ends.append((nodes[leaf].view(np.int64), nodes[least[leaf]].view(np.int64)))
            if ends:
                yield to_batches(schema, [np.concatenate(e) for e in zip(*ends, strict=True)])

    return run


def hamming_links(codes: DataFrame, n: int, bits: int = BITS, agree: int | None = None) -> DataFrame:
    """(a, b): links that connect what pairs of the ``n`` distinct ``code`` values within ``bits`` connect."""
    turns = Turns(bits, agree or agreeing_blocks(n, bits))
    ranked = codes.select("code").mapInArrow(_ranked(turns), "turn int, upper long, rank long, code long")
    in_order = ranked.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    leaves = stored(in_order.mapInArrow(_leaves, _LEAVES), "gray-leaves")
    alone = leaves.filter(F.size("codes") > 1).select("codes", F.lit(None).cast("array<long>").alias("other"))
    other = leaves.select("turn", "upper", *[F.col(c).alias(f"{c}_") for c in ("first", "mask", "pattern", "codes")])
    shared = F.expr("bit_count((pattern ^ pattern_) & mask & mask_)")
    met = leaves.join(other, ["turn", "upper"]).filter((F.col("first") < F.col("first_")) & (shared <= bits))
    pairs = alone.unionByName(met.select("codes", F.col("codes_").alias("other")))
    return pairs.mapInArrow(tidy(_joined(bits)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per document."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    links = stored(hamming_links(classes, classes.count(), bits), "hamming-links")
    found = stored(components(links).select(F.col("id").alias("code"), "component"), "components")
    placed = classes.join(found, "code", "left").withColumn("component", F.coalesce("component", "code"))
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(dealt_anew(first, "component"), "component").select("code", "component_id"), "named")
    out = rows.join(named, rows["fingerprint"] == named["code"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows that share this id stay together; rows with a null id stay, since nothing names them.
    """
    kept = near_duplicates(docs, id_col, text_col, bits).filter(F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()))
    return among(docs, stored(kept.select(F.col("doc_id").alias(id_col)).distinct(), "kept"), id_col)
