"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a slice of texts lie in one array of symbols.  In each round every
pre-token takes its own lowest-ranked pair and merges all its occurrences at once, from the left;
pre-tokens without a pair leave.  Surviving symbols are the tokens.  This gives the same tokens as
merging one pair at a time, because each merge makes a symbol of its own, so pairs with a new
symbol rank behind the merge that made it.

Counts of pre-tokens already met are kept in the task, up to ``MOST_KNOWN`` of them, then anew.
Null and empty texts have no tokens.  Rows are counted one by one, so repeated rows and ids need no
care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwise.llm.arrays import slices
from tillwise.llm.pretokens import Pieces, Scheme

MOST_KNOWN = 2_000_000
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Merges of a byte-level BPE file over ragged arrays."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("this kind of BPE is not supported")
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int64)
        self.final = np.array([vocabulary[s + suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        if len(set(made.tolist())) != len(made):
            raise ValueError("two merges make one symbol; ranks can not be synchronised")
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), at

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each of these non-empty pre-tokens."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = self.inner[raw]
        last = np.cumsum(size) - 1
        symbol[last] = self.final[raw[last]]
        piece = np.repeat(np.arange(len(size)), size)
        out = size.copy()
        while True:
            rank, at = self.ranks(symbol[:-1], symbol[1:])
            rank[piece[:-1] != piece[1:]] = NONE
            rank, at = np.r_[rank, NONE], np.r_[at, 0]
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.minimum.reduceat(rank, first) if len(first) else rank[:0]
            best = np.repeat(least, np.diff(np.r_[first, len(piece)]))
            hit = np.flatnonzero((rank == best) & (best != NONE))
            if not len(hit):
                return out
            # of overlapping occurrences, every other one from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[within % 2 == 0]
            symbol[hit] = self.made[at[hit]]
            np.subtract.at(out, piece[hit], 1)
            stay = best != NONE
            stay[hit + 1] = False
            symbol, piece = symbol[stay], piece[stay]


class Counter:
    """Counts tokens of texts; keeps what it has learnt about pre-tokens."""

    def __init__(self, path: str):
        self.scheme = Scheme(path)
        self.merger = Merger(self.scheme.spec)
        self.known: dict[int, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts, owner, specials = self.scheme.parts(texts)
        pieces = Pieces(parts, self.scheme.joined_space)
        h, first, back = np.unique(pieces.hash, return_index=True, return_inverse=True)
        keys = h.tolist()
        new = [k for k, x in enumerate(keys) if x not in self.known]
        if new:
            if len(self.known) + len(new) > MOST_KNOWN:
                self.known.clear()
                new = list(range(len(keys)))
            counts = self.merger.counts([pieces.text(first[k]).encode() for k in new])
            self.known.update(zip([keys[k] for k in new], counts.tolist()))
        each = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        total = np.bincount(owner[pieces.row], each[back], len(texts)).astype(np.int64)
        if specials:
            total += np.bincount(owner[[p - 1 for p, _ in specials]], minlength=len(texts))
        return total


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` without the text, with the tokens of each whole text by the tokenizer file."""
    kept = [c for c in docs.columns if c not in (text, name)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches, text):
            found = counter([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)],
                                             [*kept, name])

    return docs.select(*kept, text).mapInArrow(run, schema)
