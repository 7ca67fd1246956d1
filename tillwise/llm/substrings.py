"""Removal of repeated word windows, with a count-min sketch before the exact grouping.

First pass: the windows of each partition go into a sketch of two rows of counters that saturate at
two, the only count asked about.  A partition sketch travels as the sorted numbers of its cells
(gaps, a byte or so each) or as bits where that is shorter, and sketches are merged cell block by
cell block.  The merged sketch never counts too few, so a window that starts in two places is always
estimated as repeated.

Second pass: only windows estimated as repeated are grouped exactly, by a 96-bit hash: the smallest
document id of each hash is found with map-side combining, and joined back to the windows.  Windows
that also start in a document with a smaller id are removed.

The sketch has about six cells for each window, rounded up to a power of two, and at most
``most_cells``; beyond that it lets more windows through to the exact grouping, never fewer.  It is a file
of a bit a cell in the shared folder, which the tasks of a machine map together.

Null and empty texts have no words.  A null id counts as larger than any other.  Rows with equal ids
do not remove each other's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.arrays import Words, mix, slices, window_hashes
from tillwise.llm.shared_files import mapped, put
from tillwise.llm.staging import Scratch

SIZE = 13
ROWS = 2
BLOCK_CELLS = 1 << 20
FLUSH = 4_000_000
SLICE_BYTES = 2 << 20
#: Bytes a word takes with its separator, to size the sketch.
WORD_BYTES = 6
#: Removed stretches are broadcast up to this many bytes; beyond it the texts are shuffled.
BROADCAST_BYTES = 64 << 20
LAST = np.iinfo(np.int64).max


def sketch_cells(docs: DataFrame, most_cells: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = max(BLOCK_CELLS * ROWS, 6 * size // WORD_BYTES)
    return min(most_cells, 1 << (wanted - 1).bit_length())


def cells_of(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each hash in each row, numbered inside its row."""
    width = np.uint64(cells // ROWS)
    return [(mix(h + np.uint64(r)) % width).astype(np.uint32) for r in range(ROWS)]


def packed(at: np.ndarray) -> bytes:
    """Sorted cells of a block as gaps of one byte, 255 for 255 cells more; or as bits."""
    gaps = np.diff(at, prepend=-1) - 1
    more = gaps // 255
    if len(at) + int(more.sum()) >= BLOCK_CELLS // 8:
        bits = np.zeros(BLOCK_CELLS, bool)
        bits[at] = True
        return np.packbits(bits).tobytes()
    out = np.full(len(at) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(content: bytes) -> np.ndarray:
    raw = np.frombuffer(content, np.uint8)
    if len(raw) == BLOCK_CELLS // 8:
        return np.unpackbits(raw).astype(bool)
    bits = np.zeros(BLOCK_CELLS, bool)
    step = np.where(raw == 255, 255, raw.astype(np.int64) + 1)
    bits[np.cumsum(step)[raw != 255] - 1] = True
    return bits


def partition_sketches(docs: DataFrame, cells: int) -> DataFrame:
    """``block, once, twice``: cells met, and cells met twice or more, of runs of each partition."""
    schema = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(ROWS)], 0

        def flush(r: int) -> pa.RecordBatch:
            at = np.concatenate(held[r])
            held[r].clear()
            at.sort()
            new = np.ones(len(at), bool)
            np.not_equal(at[1:], at[:-1], out=new[1:])
            again = at[~new]
            again = again[np.r_[True, again[1:] != again[:-1]]] if len(again) else again
            at = at[new]
            own = at // BLOCK_CELLS
            block = own[np.r_[True, own[1:] != own[:-1]]].astype(np.int64)
            part = [[packed((x[i:j] - np.uint32(b * BLOCK_CELLS)).astype(np.int64)) for b, i, j in zip(
                block, np.searchsorted(x, block * BLOCK_CELLS), np.searchsorted(x, (block + 1) * BLOCK_CELLS))]
                    for x in (at, again)]
            first = r * (cells // ROWS // BLOCK_CELLS)
            return pa.RecordBatch.from_arrays(
                [pa.array((block + first).astype(np.int32)), pa.array(part[0], pa.binary()),
                 pa.array(part[1], pa.binary())], schema=schema)

        for batch in slices(batches, size=SLICE_BYTES):
            words = Words(batch.column("text"))
            at = words.windows(SIZE)
            if len(at):
                for r, cell in enumerate(cells_of(window_hashes(words.hash, at, SIZE), cells)):
                    held[r].append(cell)
                size += len(at)
            if size >= FLUSH:
                yield from map(flush, range(ROWS))
                size = 0
        if size:
            yield from map(flush, range(ROWS))

    return docs.select("text").mapInArrow(run, "block int, once binary, twice binary")


def merged_sketch(sketches: DataFrame) -> DataFrame:
    """``block, often``: cells that count two or more over all partitions, packed.

    Blocks arrive together and in order, and each is merged as a stream of two bit sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, once, twice = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()),
                                               "often": [packed(np.flatnonzero(twice))]})

        for batch in batches:
            for b, o, t in zip(*[c.to_pylist() for c in batch.columns]):
                if b != block:
                    if block is not None:
                        yield row()
                    block, once, twice = b, np.zeros(BLOCK_CELLS, bool), np.zeros(BLOCK_CELLS, bool)
                met = unpacked(o)
                twice |= once & met
                twice |= unpacked(t)
                once |= met
        if block is not None:
            yield row()

    return (sketches.repartition("block").sortWithinPartitions("block")
            .mapInArrow(run, "block int, often binary"))


def write_sketch(sketch: DataFrame, cells: int, folder: str) -> None:
    """The merged sketch as a file of bits, of ``cells`` / 8 bytes, in the shared folder; one task lays
    its blocks side by side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(cells // 8, np.uint8)
        for batch in batches:
            for block, content in zip(*[batch.column(c).to_pylist() for c in ("block", "often")]):
                at = block * (BLOCK_CELLS // 8)
                bits[at:at + BLOCK_CELLS // 8] = np.packbits(unpacked(content))
        put(folder, "sketch", memoryview(bits))
        yield pa.RecordBatch.from_pydict({"bytes": [len(bits)]})

    sketch.coalesce(1).mapInArrow(run, "bytes long").collect()


def estimated_repeats(docs: DataFrame, folder: str, cells: int) -> DataFrame:
    """``h, x, doc, tag`` of each window whose cells all count two or more.

    ``x`` holds the second hash in its low half and the window's place in the high half, so what is
    random in a row stands together and the rest of it compresses away.
    """
    kinds = {"h": pa.int64(), "x": pa.int64(), "doc": pa.int64(), "tag": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = mapped(folder, "sketch")
        for batch in slices(batches, size=SLICE_BYTES):
            words = Words(batch.column("text"))
            at = words.windows(SIZE)
            h = window_hashes(words.hash, at, SIZE)
            often = np.ones(len(at), bool)
            for r, cell in enumerate(cells_of(h, cells)):
                cell = cell.astype(np.int64) + r * (cells // ROWS)
                often &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            at, h = at[often], h[often]
            second = window_hashes(words.hash, at, SIZE, 1) >> np.uint64(32)
            row = words.row[at]
            place = (at - words.first[row]).astype(np.uint64) << np.uint64(32)
            columns = [h.view(np.int64), (place | second).view(np.int64),
                       batch.column("doc").to_numpy()[row], batch.column("tag").to_numpy()[row]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return keyed(docs).mapInArrow(run, "h long, x long, doc long, tag int")


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with their id, largest if null, and a tag that tells rows with the same id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"),
                       F.hash("text").alias("tag"), "text")


def repeated_stretches(docs: DataFrame, scratch: Scratch, most_cells: int) -> DataFrame:
    """``doc, tag, stretches``: starts and ends, in words, of what repeats a smaller id."""
    cells = sketch_cells(docs, most_cells)
    sketch = scratch.table(merged_sketch(partition_sketches(docs, cells)), "sketch")
    folder = f"{scratch.folder}/bits"
    write_sketch(sketch, cells, folder)
    scratch.drop("sketch")
    windows = estimated_repeats(docs, folder, cells)
    second = F.col("x").bitwiseAND(0xFFFFFFFF)
    first = windows.groupBy(F.col("h").alias("g"), second.alias("g2")).agg(
        F.min("doc").alias("first"))
    found = (windows.join(first, (F.col("h") == F.col("g")) & (second == F.col("g2")))
             .where("doc > first")
             .select("doc", "tag", F.shiftright("x", 32).cast("int").alias("pos")))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column("at"):
                at = np.sort(at.values.to_numpy())
                gap = np.flatnonzero(np.diff(at) > SIZE)
                start, end = at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]] + SIZE
                out.append(np.stack([start, end], 1).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(out, pa.list_(pa.int32()))],
                ["doc", "tag", "stretches"])

    return scratch.table(
        found.groupBy("doc", "tag").agg(F.collect_set("pos").alias("at"))
        .mapInArrow(join_up, "doc long, tag int, stretches array<int>"), "stretches")


def kept_texts(words: Words, stretches: list) -> tuple[list[bytes], np.ndarray]:
    """Words outside the stretches of each text, one space between them; and the removed counts."""
    change = np.zeros(len(words) + 1, np.int32)
    for r, at in enumerate(stretches):
        if at:
            at = np.asarray(at) + words.first[r]
            change[at[::2]] += 1
            change[at[1::2]] -= 1
    keep = np.cumsum(change[:-1]) == 0
    gone = np.bincount(words.row[~keep], minlength=words.rows)
    start, end, row = words.start[keep], words.end[keep], words.row[keep]
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # one separator after each kept word that has a byte of its own text behind it
    gap = end[end < words.offsets[row + 1]]
    data = words.data.copy()
    data[gap] = 0x20
    inside[gap] = True
    cut = np.r_[0, np.cumsum(inside)][words.offsets]
    flat = data[inside].tobytes()
    return [flat[a:b].rstrip(b" ") for a, b in zip(cut[:-1], cut[1:])], gone


def remove_repeats(docs: DataFrame, scratch: Scratch, most_cells: int = 1 << 31) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of each document; reads ``scratch``."""
    stretches = repeated_stretches(docs, scratch, most_cells)
    size = stretches.agg((F.sum(F.size("stretches")) * 4 + F.count(F.lit(1)) * 64).alias("n")).first()["n"]
    if (size or 0) <= BROADCAST_BYTES:
        stretches = F.broadcast(stretches)
    texts = keyed(docs).join(stretches, ["doc", "tag"], "left").select("doc", "text", "stretches")
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()),
        ("kept_text", T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            words = Words(batch.column("text"))
            kept, gone = kept_texts(words, batch.column("stretches").to_pylist())
            doc = batch.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64(), mask=doc == LAST), pa.array(words.count, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [f.name for f in schema.fields])

    return texts.mapInArrow(run, schema)
