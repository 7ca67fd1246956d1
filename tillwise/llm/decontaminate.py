"""Benchmark passages in training documents, by a distributed positional inverted index.

The index is kept by segments, runs of whole documents: for each segment one row of word positions
for each term, and one row with the segment's documents.  A phrase is looked up from its rarest
term: that term names the segments, its postings give the starts, and the postings of the phrase's
other terms, shifted by their place and taken in order of rarity, cut them down until none is left
or the phrase is found.  Within ``slop`` words of their place, the same terms give proximity
matches.

Terms are 64-bit hashes of lower-cased words.  A phrase is each run of ``size`` words of an item,
or the whole item if it has fewer.  Null and empty items have no phrase; an item without id makes
its phrases known but is listed nowhere; repeated items count once.  Null and empty documents have
no words.  Documents are told by row, so repeated ids and rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrays import ALNUM, Words, slices
from tillwise.llm.staging import Scratch, estimated_rows

SEGMENT_BYTES = 8 << 20
#: The terms of all phrases are broadcast, to index no others, up to this many (8 bytes each).
BROADCAST_TERMS = 4_000_000

INDEX = ("segment long, term long, positions binary, doc_id array<long>, print array<long>, "
         "n_words array<long>")
MATCHES = ("doc_id long, print long, n_words long, n_hit long, items array<long>, "
           "near_items array<long>")


def phrases(items: DataFrame, size: int = 10) -> DataFrame:
    """``terms, items``: each distinct phrase with the ids of the items that hold it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), ALNUM, lower=True)
            term = words.hash.view(np.int64)
            ids, ends = batch.column("item_id").to_pylist(), words.first
            out = [(ids[r], term[k:min(k + size, ends[r + 1])].tolist())
                   for r in range(words.rows) if words.count[r]
                   for k in range(ends[r], max(ends[r] + 1, ends[r + 1] - size + 1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.list_(pa.int64()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        cut, "item_id long, terms array<long>")
    return rows.groupBy("terms").agg(F.collect_set("item_id").alias("items"))


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The index of ``docs`` (doc_id, text); with a vocabulary, a sorted array, of its terms only."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        terms_known = None if known is None else known.value
        schema = pa.schema([
            ("segment", pa.int64()), ("term", pa.int64()), ("positions", pa.binary()),
            ("doc_id", pa.list_(pa.int64())), ("print", pa.list_(pa.int64())),
            ("n_words", pa.list_(pa.int64()))])
        for batch in slices(batches, size=SEGMENT_BYTES):
            words = Words(batch.column("text"), ALNUM, lower=True)
            term = words.hash.view(np.int64)
            at = np.arange(len(term), dtype=np.int32)
            if terms_known is not None:
                near = np.minimum(np.searchsorted(terms_known, term), max(0, len(terms_known) - 1))
                at = at[terms_known[near] == term] if len(terms_known) else at[:0]
            at = at[np.argsort(term[at], kind="stable")]
            first = np.flatnonzero(np.r_[True, np.diff(term[at]) != 0]) if len(at) else at
            offsets = np.r_[first, len(at)].astype(np.int32) * 4
            lists = pa.BinaryArray.from_buffers(
                pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(at.astype(np.int32))])
            n = len(first)
            nothing = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(term[at[first]]), lists, nothing, nothing,
                 nothing], schema=schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([batch.column("print").to_pylist()], pa.list_(pa.int64())),
                 pa.array([words.count], pa.list_(pa.int64()))], schema=schema)
            number += 1

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print")) \
        .mapInArrow(index, INDEX)


def by_rarity(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Phrases whose terms all occur: ``rarest`` and ``plan``, terms and places, rarest first."""
    counts = index.where("term is not null").groupBy("term").agg(
        F.sum(F.octet_length("positions")).alias("n"))
    places = wanted.select("terms", F.posexplode("terms").alias("place", "term"))
    plan = F.sort_array(F.collect_list(F.struct("n", "place", "term")))
    ordered = places.join(counts, "term").groupBy("terms").agg(plan.alias("plan"))
    ordered = ordered.where(F.size("plan") == F.size("terms"))
    return wanted.join(ordered, "terms").select(
        "items", "plan", F.col("plan")[0]["term"].alias("rarest"))


def shifted(starts: np.ndarray, places: list[tuple[int, int]], postings: dict, slop: int,
            low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The starts that have every term within ``slop`` of its place, inside ``low`` to ``high``."""
    for term, place in places:
        if not len(starts):
            break
        at = postings[term] if term in postings else starts[:0]
        first = np.searchsorted(at, np.maximum(starts + place - slop, low))
        found = first < len(at)
        found[found] = at[first[found]] <= np.minimum(starts + place + slop, high)[found]
        starts, low, high = starts[found], low[found], high[found]
    return starts


def match_segment(plans: pa.Table, rows: pa.Table, slop: int) -> pa.Table:
    """Matches in one segment, one row for each of its documents."""
    postings, head = {}, None
    for row in rows.to_pylist():
        if row["term"] is None:
            head = row
        else:
            postings[row["term"]] = np.frombuffer(row["positions"], np.int32).astype(np.int64)
    count = np.array(head["n_words"], np.int64)
    first = np.r_[0, np.cumsum(count)]
    ends = first[1:]
    step = np.zeros(first[-1] + 1, np.int32)
    items = [set() for _ in count]
    near = [set() for _ in count]
    for row in plans.to_pylist():
        plan = [(p["term"], p["place"]) for p in row["plan"]]
        term, place = plan[0]
        at = postings[term]
        doc = np.searchsorted(ends, at, side="right")
        low, high = first[doc], ends[doc] - 1
        starts = at - place
        whole = (starts >= low) & (starts + len(plan) - 1 <= high)
        exact = shifted(starts[whole], plan[1:], postings, 0, low[whole], high[whole])
        np.add.at(step, exact, 1)
        np.add.at(step, exact + len(plan), -1)
        for d in np.unique(np.searchsorted(ends, exact, side="right")).tolist():
            items[d].update(row["items"])
        if slop:
            # the rarest term keeps its place, so its document bounds the others
            close = shifted(starts, plan[1:], postings, slop, low, high)
            for d in np.unique(np.searchsorted(ends, close + place, side="right")).tolist():
                near[d].update(row["items"])
    hits = np.r_[0, np.cumsum(np.cumsum(step[:-1]) > 0)]
    return pa.table({
        "doc_id": pa.array(head["doc_id"], pa.int64()), "print": pa.array(head["print"], pa.int64()),
        "n_words": pa.array(count), "n_hit": pa.array(hits[ends] - hits[first[:-1]], pa.int64()),
        "items": pa.array([sorted(s) for s in items], pa.list_(pa.int64())),
        "near_items": pa.array([sorted(s) for s in near], pa.list_(pa.int64()))})


def find_items(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = 10,
               slop: int = 2) -> DataFrame:
    """One row for each document: words, words inside exact matches, items matched exactly and
    within ``slop``.  The index is written to ``scratch``, which its result reads."""
    wanted = scratch.table(phrases(items, size), "phrases")
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    vocabulary = None
    if estimated_rows(terms, BROADCAST_TERMS) <= BROADCAST_TERMS:
        vocabulary = np.sort(np.array([r["term"] for r in terms.collect()], np.int64))
    index = scratch.table(build_index(docs, vocabulary), "index")
    if vocabulary is None:
        index = index.join(terms, "term", "left_semi").select(index.columns).unionByName(
            index.where("term is null"))
    plans = by_rarity(wanted, index)
    segments = index.where("term is not null").select(F.col("term").alias("rarest"), "segment")
    looked_up = plans.join(segments, "rarest").select("segment", "plan", "items")
    lists = index.withColumnRenamed("segment", "own").groupBy("own")
    return looked_up.groupBy("segment").cogroup(lists).applyInArrow(
        lambda left, right: match_segment(left, right, slop), MATCHES)
