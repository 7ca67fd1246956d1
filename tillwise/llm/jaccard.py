"""Near-duplicate texts: a Jaccard join of word shingles along chosen paths.

Texts with equal shingle sets are one class.  Each class has a min-hash sketch, and one coordinate
of it is one sampled shingle.  A run splits all classes on one sampled coordinate, so classes that
share the sampled shingle stay together; large buckets are split again on ``branches`` coordinates
that their path samples, and so on.  Splitting ends where a bucket is small, where it hardly shrinks
(its members are alike) or at ``depth``.  Final buckets are compared by brute force with the whole
shingle sets; a large one is cut into blocks and each pair of blocks is a task's work, so no task
holds a group of unbounded size.  Runs are repeated until a pair at the threshold has met with
probability ``recall``.

A pair that meets in several buckets counts in the first of them only, so links are counted
without listing pairs, and each bucket returns one row a member: its links and the smallest member
it is connected with.  Classes are then joined into connected components.

Words are runs of other than white space; a text of fewer words than a shingle has one shingle of
all of them.  Null and empty texts have no shingles: no links, and a class of their own each.  A
null id counts as larger than any other.  Rows with equal texts are copies whatever their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrays import Words, mix, slices, window_hashes
from tillwise.llm.components import components
from tillwise.llm.staging import Scratch

SIZE = 5
COORDINATES = 64
SMALL = 64
BLOCK = 1024
SHRINK = 0.7
#: Columns of the membership matrix that are held at a time.
CHUNK = 1 << 13
#: Classes to compare are broadcast up to this many bytes; beyond it the texts are shuffled.
BROADCAST_BYTES = 64 << 20
LAST = np.iinfo(np.int64).max
_random = np.random.RandomState(8)
_TIMES = (_random.randint(0, 1 << 31, COORDINATES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _random.randint(0, 1 << 31, COORDINATES).astype(np.uint32)


class Shingles:
    """Distinct shingle hashes of the texts of a slice, ascending within each text."""

    def __init__(self, column: pa.Array, size: int):
        words = Words(column)
        at = words.windows(size)
        hashes, rows = [window_hashes(words.hash, at, size)], [words.row[at]]
        for n in range(1, size):
            row = np.flatnonzero(words.count == n)
            hashes.append(window_hashes(words.hash, words.first[row], n))
            rows.append(row)
        h, row = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
        self.hash, self.row = h[new], row[new]
        self.count = np.bincount(self.row, minlength=words.rows)
        self.first = np.r_[0, np.cumsum(self.count)]

    def sums(self, which: int) -> np.ndarray:
        """A 64-bit digest of each set."""
        total = np.r_[np.uint64(0), np.cumsum(mix(self.hash + np.uint64(which)))]
        return (total[self.first[1:]] - total[self.first[:-1]]).view(np.int64)

    def sketches(self) -> np.ndarray:
        """One row of min-hash values for each text that has shingles."""
        low = (self.hash >> np.uint64(32)).astype(np.uint32)
        first = self.first[:-1][self.count > 0]
        out = np.empty((len(first), COORDINATES), np.uint32)
        for k in range(COORDINATES if len(first) else 0):
            v = low * _TIMES[k] + _PLUS[k]
            v = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[:, k] = np.minimum.reduceat(v ^ (v >> np.uint32(13)), first)
        return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"),
                       F.xxhash64("text").alias("print"), "text")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """``doc, print, a, b, sketch`` of each row; (a, b) is the class, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = Shingles(batch.column("text"), size)
            empty = sets.count == 0
            found = sets.sketches()
            sketch = np.full(len(empty), None, object)
            sketch[~empty] = [row.tobytes() for row in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("print"), pa.array(sets.sums(1), mask=empty),
                 pa.array(sets.sums(2), mask=empty), pa.array(sketch, pa.binary())],
                ["doc", "print", "a", "b", "sketch"])

    return keyed(docs).mapInArrow(run, "doc long, print long, a long, b long, sketch binary")


def runs_for(threshold: Fraction, recall: float, branches: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    A pair keeps together along a path if at any node one of ``branches`` samples is shared; the
    chance over any depth is the fixed point of p = 1 - (1 - t p)^branches.
    """
    t, p = float(threshold), 1.0
    for _ in range(100):
        p = 1 - (1 - t * p) ** branches
    return math.ceil(math.log(1 - recall) / math.log(1 - t * p))


def split(rows: DataFrame, picks: int) -> DataFrame:
    """Children of ``node, parent, a, b, sketch``: the path extended by sampled shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32) \
                .reshape(-1, COORDINATES)
            for k in range(picks):
                # samples of a node differ: they walk through the coordinates by an odd step
                seed = mix(node)
                at = (seed + np.uint64(k) * ((seed >> np.uint64(20)) | np.uint64(1))) \
                    % np.uint64(COORDINATES)
                value = sketch[np.arange(len(node)), at.astype(np.int64)].astype(np.uint64)
                child = mix(mix(node + at) + value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), batch.column("size"), batch.column("a"),
                     batch.column("b")], ["node", "parent", "a", "b"])

    return rows.select("node", "size", "a", "b", "sketch").mapInArrow(
        run, "node long, parent long, a long, b long")


def final_buckets(classes: DataFrame, scratch: Scratch, runs: int, branches: int,
                  depth: int) -> DataFrame:
    """``node, size, a, b``: buckets of two or more classes to compare."""
    total = classes.count()
    rows = split(classes.withColumn("node", F.lit(1).cast("long"))
                 .withColumn("size", F.lit(total).cast("long")), runs)
    parts, level = [], 1
    while True:
        counts = rows.groupBy(F.col("node").alias("n")).agg(F.count(F.lit(1)).alias("size")) \
            .where("size > 1")
        sized = scratch.table(rows.join(counts, F.col("node") == F.col("n")).drop("n"),
                              f"level-{level}")
        done = (F.col("size") <= SMALL) | (F.col("size") >= SHRINK * F.col("parent"))
        if level >= depth:
            done = F.lit(True)
        parts.append(sized.where(done).select("node", "size", "a", "b"))
        rest = sized.where(~done)
        if rest.isEmpty():
            break
        rows = split(rest.join(classes.select("a", "b", "sketch"), ["a", "b"]), branches)
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.dropDuplicates(["node", "a", "b"])
    # buckets with the same members are compared once
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "a", "b")).alias(f"x{k}") for k in (1, 2)]
    alike = out.groupBy("node").agg(*digest, F.count(F.lit(1)).alias("size")) \
        .groupBy("x1", "x2", "size").agg(F.min("node").alias("node"))
    return scratch.table(out.drop("size").join(alike.select("node", "size"), "node"), "buckets")


def with_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``a, b, nodes, shingles``: whole sets of the classes to compare, from their first texts."""
    bound = members.agg((F.count(F.lit(1)) * 80 + F.sum(F.size("nodes")) * 16).alias("n")).first()["n"]
    if (bound or 0) <= BROADCAST_BYTES:
        members = F.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = Shingles(batch.column("text"), size)
            # two texts with one id and fingerprint are told apart by their classes
            own = (sets.sums(1) == batch.column("a").to_numpy()) \
                & (sets.sums(2) == batch.column("b").to_numpy())
            content = [sets.hash[i:j].tobytes() for i, j in zip(sets.first[:-1], sets.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("nodes"),
                 pa.array(content, pa.binary())], ["a", "b", "nodes", "shingles"]
            ).filter(pa.array(own))

    node = "array<struct<node:long,size:long>>"
    return keyed(docs).join(members, ["doc", "print"]).select("a", "b", "nodes", "text").mapInArrow(
        run, f"a long, b long, nodes {node}, shingles binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from a membership matrix taken a few columns at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = (count > 1) & (count < n)
    place = np.cumsum(shared) - 1
    held = shared[column]
    row, column = row[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.full((n, n), int((count == n).sum()), np.int64) if n > 1 else np.zeros((1, 1), np.int64)
    for low in range(0, int(shared.sum()), CHUNK):
        i, j = np.searchsorted(column, [low, low + CHUNK])
        part = np.zeros((n, min(CHUNK, int(shared.sum()) - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each one is connected with."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare_bucket(table: pa.Table, threshold: Fraction) -> pa.Table:
    """Links and local root of each member of a bucket, or of a pair of its blocks."""
    rows = {}
    for row in table.to_pylist():
        rows.setdefault((row["a"], row["b"]), row)
    keys = sorted(rows)
    rows = [rows[k] for k in keys]
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    both = intersections(sets)
    p, q = threshold.numerator, threshold.denominator
    linked = both * (p + q) >= p * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    counted = linked.copy()
    here = rows[0]["node"]
    earlier: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for node in r["nodes"]:
            if node < here:
                earlier.setdefault(node, []).append(i)
    for at in earlier.values():
        if len(at) > 1:
            counted[np.ix_(at, at)] = False
    block = np.array([r["block"] for r in rows])
    if rows[0]["one"] != rows[0]["two"]:
        counted &= block[:, None] != block[None, :]
        linked &= block[:, None] != block[None, :]
    root = local_roots(linked)
    return pa.table({"a": [k[0] for k in keys], "b": [k[1] for k in keys],
                     "links": pa.array(counted.sum(1), pa.int64()),
                     "root_a": [keys[r][0] for r in root], "root_b": [keys[r][1] for r in root]})


def jaccard_classes(docs: DataFrame, scratch: Scratch, threshold: Fraction = Fraction(4, 5),
                    size: int = SIZE, recall: float = 0.999, branches: int = 3,
                    depth: int = 8) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, print, class_id, copy_id, n_links, is_first``.

    ``class_id`` is the smallest id of the component, ``copy_id`` that of the texts with the same
    shingles, ``n_links`` the number of other shingle sets at or above the threshold.  ``print`` is
    the text's fingerprint, and ``is_first`` marks the smallest (id, fingerprint) of a component.
    The result is a table of ``scratch``; what led to it lies in a folder of its own and is dropped.
    """
    result, scratch = scratch, Scratch(docs.sparkSession)
    rows = scratch.table(sketched(docs, size), "sketches")
    first = F.min(F.struct("doc", "print", "sketch"))
    classes = scratch.table(rows.where("a is not null").groupBy("a", "b").agg(first.alias("r"))
                            .select("a", "b", "r.*"), "classes")
    runs = runs_for(threshold, recall, branches)
    buckets = final_buckets(classes, scratch, runs, branches, depth)
    members = (buckets.groupBy("a", "b").agg(F.collect_set(F.struct("node", "size")).alias("nodes"))
               .join(classes.select("a", "b", "doc", "print"), ["a", "b"]))
    sets = with_sets(docs, scratch.table(members, "members"), size)
    blocks = F.ceil(F.col("n.size") / BLOCK).cast("int")
    grid = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("one"), F.greatest(k, F.col("block")).alias("two")))
    placed = (sets.select("a", "b", "shingles", F.transform("nodes", lambda n: n["node"]).alias("nodes"),
                          F.explode("nodes").alias("n"))
              .withColumn("block", F.pmod(F.xxhash64("a", "b"), blocks).cast("int"))
              .select("a", "b", "shingles", "nodes", F.col("n.node").alias("node"), "block",
                      F.explode(grid).alias("g"))
              .select("a", "b", "shingles", "nodes", "node", "block", "g.one", "g.two"))
    compared = scratch.table(placed.groupBy("node", "one", "two").applyInArrow(
        lambda t: compare_bucket(t, threshold),
        "a long, b long, links long, root_a long, root_b long"), "compared")
    links = compared.groupBy("a", "b").agg(F.sum("links").alias("n_links"))
    key = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    joined = components(compared.select(key("a", "b").alias("u"), key("root_a", "root_b").alias("v")),
                        scratch)
    root = classes.join(joined.select("u.a", "u.b", F.col("v").alias("root")), ["a", "b"], "left") \
        .select("a", "b", "doc", "print", F.coalesce("root", key("a", "b")).alias("root"))
    smallest = root.groupBy("root").agg(F.min(F.struct("doc", "print")).alias("first"))
    told = (root.drop("print").join(smallest, "root").join(links, ["a", "b"], "left")
            .select("a", "b", F.col("doc").alias("copy_doc"), "first",
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    real = lambda c: F.when(F.col(c) != int(LAST), F.col(c))
    alone = F.col("a").isNull()
    out = result.table(rows.drop("sketch").join(told, ["a", "b"], "left").select(
        real("doc").alias("doc_id"), "print",
        F.when(alone, real("doc")).otherwise(real("first.doc")).alias("class_id"),
        F.when(alone, real("doc")).otherwise(real("copy_doc")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.struct("doc", "print") == F.col("first"))).alias("is_first")), "classes")
    scratch.drop()
    return out


def one_of_each(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each class its first row, and all texts
    without shingles."""
    rows = jaccard_classes(docs, scratch, **options)
    near = lambda t: (F.col("doc_id").eqNullSafe(t["_doc"])
                      & (F.xxhash64("text") == t["_print"]))
    names = [F.col("doc_id").alias("_doc"), F.col("print").alias("_print")]
    left = docs.join(gone := rows.where(~F.col("is_first")).select(*names).distinct(), near(gone),
                     "left_anti")
    # repeated rows of one id and text are all first; one of them stays
    again = (rows.where("is_first").groupBy("doc_id", "print")
             .count().where("count > 1").select(*names))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    single = left.join(again, near(again) & words, "left_anti")
    several = left.where(words).join(again, near(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several)
