"""Token counts of whole texts under a byte-level BPE vocabulary.

Pre-tokens are held as one ragged numpy array per batch. In each round every pre-token
finds its lowest-rank adjacent pair and joins all occurrences of that pair at once, from
the left; rounds go on until no pre-token has a known pair. The symbols left are the
tokens. Distinct chunks of text are counted once and remembered.

Nulls count as empty texts (0 bytes, 0 tokens); texts of any length are read whole; repeated
rows give repeated results; an empty table gives an empty table; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from revlens.llm.common import MEMORY, batch_rows, byte_symbols, keyed_texts, tidy, to_batches

#: Fixed value: the published splitting pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Merges:
    """The merge table as sorted arrays: pair of symbol ids -> rank and joined symbol id."""

    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.joined = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([ids[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pairs without a merge get the largest number."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each piece when no pair can be joined any more."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        out = np.ones(len(pieces), np.int64) * (lengths > 0)
        rows = np.flatnonzero(lengths > 1)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        owner = np.repeat(np.arange(len(rows)), lengths[rows])
        never = np.iinfo(np.int64).max
        while len(symbols):
            same = owner[1:] == owner[:-1]
            ranks = np.where(same, self.rank(symbols[:-1], symbols[1:]), never)
            best = np.full(len(rows), never)
            np.minimum.at(best, owner[:-1], ranks)
            # pieces without a known pair are done: note their size and take them out
            done = best == never
            if done.any():
                sizes = np.bincount(owner, minlength=len(rows))
                out[rows[done]] = sizes[done]
                stay = ~done[owner]
                new_owner = np.cumsum(~done) - 1
                rows, best = rows[~done], best[~done]
                symbols, owner, ranks = symbols[stay], new_owner[owner[stay]], ranks[stay[:-1]] if len(stay) else ranks
                if not len(symbols):
                    break
                ranks = ranks[: len(symbols) - 1]
                # a cut between two pieces may now hold a rank of a piece that left
                ranks = np.where(owner[1:] == owner[:-1], ranks, never)
            hit = np.flatnonzero(ranks == best[owner[:-1]])
            # in a run of overlapping hits (x x x) every second one counts, from the left
            first = np.r_[True, np.diff(hit) > 1]
            in_run = np.arange(len(hit)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            hit = hit[in_run % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.joined[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class Counter:
    """Counts tokens of texts, batch by batch."""

    def __init__(self, vocabulary_file: str):
        self.merges = Merges(vocabulary_file)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in self.merges.special)) if self.merges.special else None
        self.known: dict[str, int] = {}

    def _pieces(self, chunk: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a chunk and the number of special tokens in it."""
        if self.special is None or not self.special.search(chunk):
            return [p.encode() for p in self.pattern.findall(chunk)], 0
        parts = self.special.split(chunk)
        return [p.encode() for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Parts of a text that can be split into pre-tokens one by one.

        A single blank always starts a pre-token, so a text may be cut in front of it. A
        run of blanks belongs together; a text that holds one stays whole.
        """
        if "  " in text or not text:
            return [text] if text else []
        words = text.split(" ")
        return ([words[0]] if words[0] else []) + [" " + w for w in words[1:]]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.chunks(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        new = list(set().union(*split) - self.known.keys())
        fresh = {}
        pieces, owner, extra = [], [], np.zeros(len(new), np.int64)
        seen: dict[bytes, int] = {}
        for i, chunk in enumerate(new):
            found, extra[i] = self._pieces(chunk)
            for p in found:
                pieces.append(seen.setdefault(p, len(seen)))
                owner.append(i)
        if new:
            sizes = self.merges.count(list(seen))
            totals = np.bincount(np.array(owner, np.int64), weights=sizes[np.array(pieces, np.int64)] if pieces else None, minlength=len(new)).astype(np.int64) if owner else np.zeros(len(new), np.int64)
            fresh = dict(zip(new, (totals + extra).tolist(), strict=True))
        short = {c: n for c, n in fresh.items() if len(c) <= 64}
        self.known.update(short)
        if len(short) < len(fresh):
            return [sum(self.known[c] if c in self.known else fresh[c] for c in chunks) for chunks in split]
        known = self.known.__getitem__
        return [sum(map(known, chunks)) for chunks in split]


def token_counts(docs: DataFrame, vocabulary_file: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary_file)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        for batch in batches:
            rows = list(batch_rows(batch, "doc_id", "body"))
            tokens = counter.count([b.decode("utf-8", "replace") for _, b in rows])
            yield to_batches(schema, ([d for d, _ in rows], [len(b) for _, b in rows], tokens, [n > limit for n in tokens]))

    return keyed_texts(docs, id_col, text_col).mapInArrow(tidy(counted), SCHEMA)
