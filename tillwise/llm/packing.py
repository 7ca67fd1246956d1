"""Packing of documents into sequences along a Hilbert curve.

A document's hashed pre-tokens are projected to a few dimensions by fixed random numbers; the
direction of the sum, on a grid, gives a Hilbert key, so documents with similar words lie near each
other on the curve.  Documents are sorted by range of the key, and each range packs its token
stream into full sequences, cutting documents where a sequence ends.  What is left at the end of a
range is cut into sequences whose lengths are powers of two, so nothing is padded.

Tokens are written once to the shared folder, in two bytes each if the vocabulary allows it: sampling
the ranges and sorting read them from there.
Equal keys are split by id and by row, so a large group of copies is spread over ranges.

A null or empty text has only the end token.  Repeated rows and ids are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrays import slices
from tillwise.llm.bpe_codec import Encoder as RankEncoder
from tillwise.llm.pretokens import Pieces, Scheme
from tillwise.llm.staging import Scratch

DIMENSIONS, BITS = 4, 15
HASHED = 1 << 12
SLICE_BYTES = 2 << 20
#: Bytes of ids in a batch of pieces.
BATCH_BYTES = 8 << 20
_DIRECTIONS = np.random.RandomState(15).normal(size=(HASHED, DIMENSIONS))

TOKENS = "doc_id long, row long, key long, ids binary, doc_tokens long"
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long")


class Encoder(RankEncoder):
    """Token ids of texts, equal to those of the tokenizers library, and the sums of the texts' directions."""

    def with_directions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, their numbers, and each text's sum of directions."""
        parts, owner, specials = self.scheme.parts(texts)
        pieces = Pieces(parts, self.scheme.joined_space)
        ids, count = self.ids_of(pieces, owner, specials, len(texts))
        slot = (pieces.hash % np.uint64(HASHED)).astype(np.int64)
        row = owner[pieces.row]
        sums = np.stack([np.bincount(row, _DIRECTIONS[:, d][slot], len(texts)) for d in range(DIMENSIONS)], 1)
        return ids, count, sums.astype(np.float64)

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and the sums."""
        ids, count, sums = self.with_directions(texts)
        return np.split(ids, np.cumsum(count)[:-1]) if len(texts) else [], sums


def hilbert_keys(sums: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each direction, on a grid of ``BITS`` bits a dimension."""
    length = np.sqrt((sums ** 2).sum(1, keepdims=True))
    unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    return grid_keys(np.minimum(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1).T.copy())


def grid_keys(x: np.ndarray) -> np.ndarray:
    """Hilbert keys of grid points, one row for each dimension.

    The grid point's bits are turned into the curve's transposed index dimension by dimension, from
    the highest bit: where a bit is set the lower bits of the first axis are inverted, where it is
    clear they are exchanged with those of that axis; Gray decoding follows.
    """
    for b in range(BITS - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(DIMENSIONS):
            swap = np.where(x[d] >> b & 1, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(x[d] >> b & 1, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, DIMENSIONS):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(BITS - 1, 0, -1):
        turn = np.where(x[-1] >> b & 1, turn ^ ((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for d in range(DIMENSIONS):
            key = key << 1 | (x[d] >> b & 1)
    return key


def id_type(path: str, end: int) -> str:
    spec = Scheme(path).spec
    ids = [end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]
    return "<u2" if max(ids) < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Ids of each document with the end token, as little-endian numbers, and its key."""
    kind = id_type(path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = Encoder(path), TaskContext.get().partitionId() << 33
        for batch in slices(batches, size=SLICE_BYTES):
            found, count, sums = encode.with_directions([t or "" for t in batch.column("text").to_pylist()])
            n = len(count)
            stop = np.cumsum(count + 1)
            ids = np.full(stop[-1], end, kind)  # the end tokens stay
            inner = np.ones(len(ids), bool)
            inner[stop - 1] = False
            ids[inner] = found
            ends = np.r_[0, stop] * ids.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(row, row + n)), pa.array(hilbert_keys(sums)),
                 packed.cast(pa.binary()), pa.array(count + 1)],
                ["doc_id", "row", "key", "ids", "doc_tokens"])
            row += n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Fills sequences with a stream of documents and returns the pieces of closed ones."""

    def __init__(self, first_id: int, size: int):
        self.sequence, self.size, self.open, self.used = first_id, size, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // 4, 0, []
        while start < total:
            n = min(total - start, self.size - self.used)
            self.open.append((doc_id, start, n, ids[4 * start:4 * (start + n)], total))
            self.used, start = self.used + n, start + n
            if self.used == self.size:
                out += self._close(self.open)
                self.open, self.used = [], 0
        return out

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for piece in pieces:
            out.append((*piece, self.sequence, offset))
            offset += piece[2]
        self.sequence += 1
        return out

    def finish(self) -> list[tuple]:
        """Close what is left as sequences with lengths of powers of two."""
        out, rest = [], list(reversed(self.open))
        for room in powers(self.used):
            taken = []
            while room:
                doc_id, start, n, ids, total = rest.pop()
                k = min(n, room)
                taken.append((doc_id, start, k, ids[:4 * k], total))
                if k < n:
                    rest.append((doc_id, start + k, n - k, ids[4 * k:], total))
                room -= k
            out += self._close(taken)
        self.open, self.used = [], 0
        return out


def pack(docs: DataFrame, path: str, scratch: Scratch, size: int = 1024, end: int = 0) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    tokens = scratch.table(tokenized(docs, path, end), "tokens", compression="zstd")
    kind = id_type(path, end)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, size)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        out, held = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                raw = np.frombuffer(ids.as_buffer(), kind).astype("<u4").tobytes()
                out += packer.add(doc_id, raw)
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield rows(out)
                    out, held = [], 0
        yield rows(out + packer.finish())

    return (tokens.repartitionByRange("key", "doc_id", "row")
            .sortWithinPartitions("key", "doc_id", "row")
            .select("doc_id", "ids").mapInArrow(run, PIECES))
