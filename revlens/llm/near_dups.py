"""Near-duplicate documents: a MinHash join over posted signature coordinates.

A document is the set of its distinct 5-word shingles (ASCII letters lower-cased; a document
of fewer words is one shingle). Documents with equal sets form a class; only the smallest
document of a class takes part in what follows.

Each class has a signature of COORDINATES minima and is posted under every (coordinate,
value) pair. Two documents at similarity 0.75 agree in 48 of 64 coordinates on average;
fewer than MATCHES = 32 agree in three of a million such pairs. So pairs with fewer matches are
dropped, and by the prefix principle a class needs postings under its COORDINATES - MATCHES
+ 1 rarest pairs only: values nobody shares cost nothing, and values that very many share
(a passage in many texts) are skipped. Candidates come from stars around one member of each
posting (see ``linking``), must agree in MATCHES coordinates, and are confirmed on their full
sets. What is left are texts that share postings without being linked, such as copies that
have been edited too much; they may be many in one group. For these the prefix principle is
applied once more, to the shingles themselves: of a pair, the smaller set must have one of its
rarest seventh of shingles among the rarest quarter of the larger one. Texts whose common
part is too small name no candidates at all, however large their group.

Null and empty texts have no words: an empty set, linked with nothing. Texts are read whole.
Repeated ids are kept as rows; rows with equal ids and different sets count as one document
for linking, which takes the smallest set. Empty tables give empty tables. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import among, batch_rows, dealt_anew, hashed, keyed_texts, mixed, signed, stored, tidy, to_batches, window_hashes, word_hashes
from revlens.llm.linking import linked

SHINGLE = 5
SIMILARITY_PERCENT = 75
COORDINATES = 64
MATCHES = 32

_MULTIPLIERS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>"

#: Forgotten at the end of a task: an idle worker should be small.
_WORDS = word_hashes()


def shingle_set(body: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes in ascending order."""
    words = body.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashed(words, _WORDS)
    return np.unique(window_hashes(h, min(width, len(h))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, cut to 32 bits."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):  # bounded memory on very long texts
        part = shingles[k : k + 4096]
        np.minimum(out, (part[:, None] * _MULTIPLIERS[None, :]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for d, body in batch_rows(batch, "doc_id", "body"):
            s = shingle_set(body)
            digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
            out.append((d, len(s), int(digest[0]), int(digest[1]), signature(s) if len(s) else []))
        yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 5)
    _WORDS.clear()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        rows = [(d, signed(shingle_set(body))) for d, body in batch_rows(batch, "doc_id", "body")]
        for k in range(0, len(rows), 200):
            yield to_batches(schema, zip(*rows[k : k + 200], strict=True))
    _WORDS.clear()


def postings(classes: DataFrame) -> DataFrame:
    """(key, id): each class under the rarest of its coordinate-value pairs that others share."""
    posted = classes.select(F.col("doc_id").alias("id"), F.posexplode("signature").alias("at", "value")).select(
        "id", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")
    )
    shared = dealt_anew(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    mine = posted.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    # the COORDINATES - size(keys) values nobody shares come first in the order of rarity
    prefix = F.size("keys") - (MATCHES - 1)
    return mine.filter(prefix > 0).select("id", F.explode(F.slice("keys", 1, prefix)).alias("k")).select("k.key", "id")


def sharing_rare_shingles(sets: DataFrame, open_keys: DataFrame) -> DataFrame:
    """(a, b): pairs between components whose sets may overlap enough, by their rarest shingles."""
    items = open_keys.select("id", "component").distinct()
    rows = sets.join(items, "id").select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = dealt_anew(rows.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1"), "shingle")
    order = F.sort_array(F.collect_list(F.struct("texts", "shingle")))
    ranked = rows.join(shared, "shingle").groupBy("id", "component", "n").agg(order.alias("common"))
    ranked = stored(ranked, "rare-shingles")
    own = F.col("n") - F.size("common")  # shingles of no other text: the rarest of all

    def first(length: Column) -> DataFrame:
        """A set's rarest shingles with their place in the order of rarity (from 0)."""
        head = F.slice("common", 1, F.greatest(length - own, F.lit(0)).cast("int"))
        return ranked.select("id", "component", "n", own.alias("own"), F.posexplode(head).alias("at", "s")).select(
            "id", "component", "n", (F.col("own") + F.col("at")).alias("at"), "s.shingle"
        )

    s = SIMILARITY_PERCENT
    longer = first(F.col("n") - F.ceil(s * F.col("n") / 100) + 1).toDF("b", "cb", "nb", "pb", "shingle")
    smaller = first(F.col("n") - F.ceil(2 * s * F.col("n") / (100 + s)) + 1).toDF("a", "ca", "na", "pa", "shingle")
    sizes = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # the common part of these two must begin where enough of both sets is left
    least = F.ceil(s * (F.col("na") + F.col("nb")) / (100 + s))
    enough = (F.col("na") - F.col("pa") >= least) & (F.col("nb") - F.col("pb") >= least)
    near = sizes & (100 * F.col("na") >= s * F.col("nb")) & enough & (F.col("ca") != F.col("cb"))
    pairs = smaller.join(longer, "shingle").filter(near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    texts = keyed_texts(docs, id_col, text_col)
    rows = stored(texts.mapInArrow(tidy(_signed), SIGNED), "signatures")
    of_set = dealt_anew(rows.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id")), "set_a")
    classes = stored(
        rows.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "signature")).alias("first"))
        .select("first.doc_id", "n_shingles", "first.signature")
        .groupBy("doc_id").agg(F.min(F.struct("n_shingles", "signature")).alias("first")).select("doc_id", "first.*"),
        "classes",
    )
    keys = stored(postings(classes), "postings")
    posted = keys.select(F.col("id").alias("doc_id")).distinct()
    sets = among(texts, posted, "doc_id").mapInArrow(tidy(_sets), "id long, shingles array<long>")
    sets = stored(sets.groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
        b = classes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
        near_size = (100 * F.least("na", "nb")) >= SIMILARITY_PERCENT * F.greatest("na", "nb")
        matches = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
        likely = pairs.join(a, "a").join(b, "b").filter(near_size).filter(matches >= MATCHES).select("a", "b")
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
        common = F.size(F.array_intersect("xa", "xb"))
        both = likely.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("xa") + F.size("xb")).alias("total"))
        return both.filter(100 * F.col("common") >= SIMILARITY_PERCENT * (F.col("total") - F.col("common"))).select("a", "b")

    comps = linked(keys, verify, lambda open_keys: sharing_rare_shingles(sets, open_keys))
    with_class = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b"], "left")
    placed = with_class.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    if comps is not None:
        placed = placed.join(comps.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    else:
        placed = placed.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "class_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    Of a group the smallest id stays; rows that share this id stay together.
    """
    kept = near_duplicates(docs, id_col, text_col).filter(F.coalesce("kept", F.lit(True)))
    return among(docs, stored(kept.select(F.col("doc_id").alias(id_col)).distinct(), "kept"), id_col)
