"""BPE encoding and decoding with a contiguous rank array for each short pre-token.

A pre-token of up to ``SHORT`` bytes is a row of two arrays: the symbol of the part that begins at
each of its boundaries, and the rank of that part with the part behind it.  Until no part has a rank,
a row is scanned for its least rank (the leftmost one), the boundary behind that part is deleted by
moving the rest of the row up, and the ranks on both sides of the new part are looked up again.  Rows
of similar length are worked on together.  Scanning a longer pre-token over and over would take
the square of its length, so that one keeps its ranks in a heap, with the same merges.

Every distinct pre-token is encoded once in a task and kept, up to ``MOST_KNOWN`` of them; then only
those of the texts at hand stay.  Special strings inside texts become their own ids.

Null and empty texts have no ids, and no ids decode to an empty text.  Rows are encoded one by one, so
repeated rows and ids need no care; columns named like the new ones are replaced, others are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwise.llm.arrays import slices
from tillwise.llm.pretokens import Pieces, Scheme
from tillwise.llm.token_counts import byte_symbols

SHORT = 64
WIDTHS = (4, 8, 16, 32, SHORT)
MOST_KNOWN = 1_000_000
SLICE_BYTES = 2 << 20
NONE = np.iinfo(np.int32).max


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes ``begin[k] .. begin[k] + count[k]`` of all k, one after the other."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - count), count)


class RankArrays:
    """Encodes pre-tokens by the merges of a byte-level BPE file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("this kind of BPE is not supported")
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int32)
        self.final = np.array([vocabulary[s + suffix] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.key, self.by_key = key[order], order.astype(np.int32)
        self.rank_of = dict(zip(key.tolist(), range(len(key))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.by_key[at], NONE)

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte symbols of all pieces, the last of each as the end of a word, and their counts."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        out, last = self.inner[raw], np.cumsum(size) - 1
        out[last] = self.final[raw[last]]
        return out, size

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these non-empty pieces one after the other, and the number of each one's ids."""
        symbol, size = self.symbols(pieces)
        first, count = np.cumsum(size) - size, size.copy()
        out = symbol.copy()  # ids of a piece stand where its bytes begin
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            if len(rows):
                self._short(symbol, first[rows], size[rows], width, out, count, rows)
            low = width
        for k in np.flatnonzero(size > SHORT).tolist():
            ids = self._long(symbol[first[k]:first[k] + size[k]].tolist())
            out[first[k]:first[k] + len(ids)] = ids
            count[k] = len(ids)
        return out[ragged(first, count)], count

    def _short(self, symbol, first, size, width, out, count, rows) -> None:
        column = np.arange(width)
        held = column < size[:, None]
        part = np.where(held, symbol[np.minimum(first[:, None] + column, len(symbol) - 1)], 0)
        rank = np.full(part.shape, NONE, np.int32)
        pairs = held[:, 1:]
        rank[:, :-1][pairs] = self.ranks(part[:, :-1][pairs], part[:, 1:][pairs])
        size = size.copy()
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            best = rank[line, at]
            over = best == NONE
            if over.any():
                ended = column < size[over][:, None]
                out[ragged(first[over], size[over])] = part[over][ended]
                count[rows[over]] = size[over]
                stay = ~over
                rows, first, size, at, best = rows[stay], first[stay], size[stay], at[stay], best[stay]
                part, rank, line = part[stay], rank[stay], line[:len(rows)]
                if not len(rows):
                    return
            behind = column[:-1] > at[:, None]  # everything behind the deleted boundary moves up
            part[:, :-1] = np.where(behind, part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            part[line, at] = self.made[best]
            size -= 1
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(part[left, at[left] - 1], part[left, at[left]])
            right = at + 1 < size
            rank[line, at] = NONE
            right = np.flatnonzero(right)
            rank[right, at[right]] = self.ranks(part[right, at[right]], part[right, at[right] + 1])

    def _long(self, part: list[int]) -> list[int]:
        n, rank_of = len(part), self.rank_of
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank_of.get(part[k] << 32 | part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = ahead[k] if part[k] >= 0 else n
            if j >= n or rank_of.get(part[k] << 32 | part[j]) != r:
                continue  # one of the two parts has changed since
            part[k], part[j] = int(self.made[r]), -1
            ahead[k] = ahead[j]
            if ahead[k] < n:
                back[ahead[k]] = k
                if (r := rank_of.get(part[k] << 32 | part[ahead[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if back[k] >= 0 and (r := rank_of.get(part[back[k]] << 32 | part[k])) is not None:
                heapq.heappush(heap, (r, back[k]))
        return [p for p in part if p >= 0]


class Encoder:
    """Ids of texts; keeps the ids of pre-tokens it has met."""

    def __init__(self, path: str):
        self.scheme = Scheme(path)
        self.arrays = RankArrays(self.scheme.spec)
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.begin = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hash, keys)
        at[at == len(self.hash)] = 0
        return at, (self.hash[at] == keys) if len(self.hash) else np.zeros(len(keys), bool)

    def _learn(self, keys: np.ndarray, pieces: Pieces, first: np.ndarray) -> None:
        known = self._find(keys)[1]
        if known.all():
            return
        if len(self.hash) + len(keys) > MOST_KNOWN:
            self._forget()
            known[:] = False
        new = np.flatnonzero(~known)
        ids, count = self.arrays([pieces.text(k).encode() for k in first[new].tolist()])
        hashes = np.r_[self.hash, keys[new]]
        order = np.argsort(hashes, kind="stable")
        self.hash = hashes[order]
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(count) - count][order]
        self.count = np.r_[self.count, count][order]
        self.ids = np.r_[self.ids, ids]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        parts, owner, specials = self.scheme.parts(texts)
        pieces = Pieces(parts, self.scheme.joined_space)
        return self.ids_of(pieces, owner, specials, len(texts))

    def ids_of(self, pieces: Pieces, owner: np.ndarray, specials: list[tuple[int, int]],
               texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts already cut: their pre-tokens, the text of each part, special strings."""
        keys, first, back = np.unique(pieces.hash, return_index=True, return_inverse=True)
        self._learn(keys, pieces, first)
        at = self._find(keys)[0][back]
        begin, count, row, ids = self.begin[at], self.count[at], owner[pieces.row], self.ids
        if specials:
            before, special = np.array(specials, np.int64).T
            place = np.searchsorted(pieces.row, before)
            begin = np.insert(begin, place, len(ids) + np.arange(len(special)))
            count = np.insert(count, place, 1)
            row = np.insert(row, place, owner[before - 1])
            ids = np.r_[ids, special.astype(np.int32)]
        return ids[ragged(begin, count)], np.bincount(row, count, texts).astype(np.int64)


class Decoder:
    """Texts of ids, as the file's decoder joins them."""

    def __init__(self, path: str):
        spec = Scheme(path).spec
        kind = spec["decoder"] and spec["decoder"]["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError("this kind of decoder is not supported")
        names = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.joined = kind is None  # without a decoder, tokens stand apart by one space
        self.names = np.full(max(names.values()) + 1, "" if self.joined else b"", object)
        if self.joined:
            for name, k in names.items():
                self.names[k] = name
            return
        byte = {s: b for b, s in enumerate(byte_symbols())}
        for name, k in names.items():
            known = all(c in byte for c in name)
            self.names[k] = bytes(byte[c] for c in name) if known else name.encode()

    def __call__(self, ids: np.ndarray) -> str:
        names = self.names[ids].tolist()
        return " ".join(names) if self.joined else b"".join(names).decode("utf-8", "replace")


def _others(df: DataFrame, *replaced: str) -> list[str]:
    return [c for c in df.columns if c not in replaced]


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids",
                 n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` without the text, with its ids as little-endian unsigned 32-bit numbers in one
    binary, and their number."""
    kept = _others(docs, text, ids, n_tokens)
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.BinaryType()),
                           T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, text, SLICE_BYTES):
            found, count = encoder([t or "" for t in batch.column(text).to_pylist()])
            ends = np.r_[0, np.cumsum(count)] * 4
            packed = pa.Array.from_buffers(pa.large_binary(), len(count), [
                None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], packed.cast(pa.binary()), pa.array(count)],
                [*kept, ids, n_tokens])

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed ids; no ids are an empty text."""
    kept = _others(df, text)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(path)
        for batch in slices(batches, ids, SLICE_BYTES):
            texts = [decode(np.frombuffer(b or b"", "<u4")) for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())],
                                             [*kept, text])

    return df.select(*kept).mapInArrow(run, schema)
