"""Exact centroid clustering by Shallot search, in whole numbers.

Every vector keeps, from round to round, its nearest centroid, the second-nearest one of its last
search, an upper bound of its distance to the nearest and a lower bound of its distance to any
other.  Centroids that move shift the bounds.  While the upper bound stays under the lower one,
the nearest centroid is known; if not, the upper bound is made exact and tried once more.  A
vector that fails both is searched for: distances to the two remembered centroids are taken, the
search starts from the closer one and walks its neighbours by their distance from it.  A centroid
can only be among the two nearest if it lies within the distance to the start plus that to the
second-nearest so far, so this ball shrinks as nearer centroids are found, and the walk ends when the
next neighbour lies outside.  All comparisons of a search are between squared distances in whole numbers;
bounds are rounded outwards, so ties always come to a search, and the smaller number wins.

The vectors with their bounds are a table, written anew in each round; sums of components are
aggregated in Spark, and the driver sees one row for each centroid.

Vectors with another number of components than ``size``, or with a null or non-finite one, are left
out.  So are those with a component beyond what squared distances in 64 bits allow (131 072 for 64
components at scale 1024).  Where fewer than ``k`` vectors are left, each starts a centroid; of no vectors the
result has no rows.  Equal vectors and repeated ids are rows of their own; a null id is never drawn as
a first centroid unless ids run out.  Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.staging import Scratch

ROWS = 8192
#: Relative room for the rounding of square roots and of sums of bounds.
ROOM = 1e-9
STATE = [T.StructField("cluster", T.IntegerType()), T.StructField("second", T.IntegerType()),
         T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()),
         T.StructField("distance", T.LongType())]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Centroids:
    """Centroids of a round, how far each moved, and their neighbours by distance."""

    point: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        k = len(self.point)
        gap = np.sqrt(np.stack([squared(self.point, p) for p in self.point]).astype(np.float64))
        gap[np.arange(k), np.arange(k)] = -1  # each is its own first neighbour
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(gap, self.order, 1)
        # the farthest that any other centroid moved
        far = np.argsort(self.moved)
        others = np.where(np.arange(k) == far[-1], self.moved[far[-2]] if k > 1 else 0.0, self.moved[far[-1]])
        self.others = others * (1 + ROOM)
        self.moved = self.moved * (1 + ROOM)

    def search(self, x: np.ndarray, near: np.ndarray, second: np.ndarray):
        """Nearest and second-nearest centroids of the vectors, with squared distances."""
        best, next_ = squared(x, self.point[near]), squared(x, self.point[second])
        swap = (next_ < best) | ((next_ == best) & (second < near))
        near, second = np.where(swap, second, near), np.where(swap, near, second)
        best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
        home, known = near.copy(), second.copy()
        reach = np.sqrt(best.astype(np.float64))
        open_ = np.arange(len(x))
        for j in range(len(self.point) - 1):
            ball = (reach[open_] + np.sqrt(next_[open_].astype(np.float64))) * (1 + ROOM)
            open_ = open_[self.gap[home[open_], j] <= ball]
            if not len(open_):
                break
            other = self.order[home[open_], j]
            fresh = other != known[open_]
            at, other = open_[fresh], other[fresh]
            d = squared(x[at], self.point[other])
            first = (d < best[at]) | ((d == best[at]) & (other < near[at]))
            behind = ~first & ((d < next_[at]) | ((d == next_[at]) & (other < second[at])))
            won = at[first]
            second[won], next_[won] = near[won], best[won]
            near[won], best[won] = other[first], d[first]
            second[at[behind]], next_[at[behind]] = other[behind], d[behind]
        return near, second, best, next_

    def assign(self, x: np.ndarray, near, second, upper, lower):
        """State of the vectors in this round, from that of the round before."""
        near, second = near.copy(), second.copy()
        upper, lower = upper + self.moved[near], lower - self.others[near]
        distance = squared(x, self.point[near])
        sure = upper * (1 + ROOM) < lower * (1 - ROOM)
        exact = np.sqrt(distance.astype(np.float64))
        upper = np.where(sure, upper, exact)
        rest = np.flatnonzero(~sure & ~(upper * (1 + ROOM) < lower * (1 - ROOM)))
        if len(rest):
            a, b, d, e = self.search(x[rest], near[rest], second[rest])
            near[rest], second[rest], distance[rest] = a, b, d
            upper[rest], lower[rest] = np.sqrt(d.astype(np.float64)), np.sqrt(e.astype(np.float64))
            if len(self.point) == 1:
                lower[rest] = np.inf
        return near, second, upper, lower, distance


def whole_vectors(vectors: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    """Rows that can be clustered, their components as floor(scale * x)."""
    most = 1 << int((62 - math.log2(size)) / 2 - 1)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < most))
    parts = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    held = vectors.withColumn(vector, F.col(vector).cast("array<double>")).where(F.size(vector) == size)
    return held.where(usable).withColumn(vector, parts)


def first_centroids(vectors: DataFrame, id_: str, vector: str, k: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes of seed and id; of equal ids, by their components."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256)
    rows = vectors.select(vector, drawn.alias("drawn")).orderBy(F.asc_nulls_last("drawn"), vector).limit(k)
    return np.array([r[vector] for r in rows.collect()], np.int64)


def assigned(table: DataFrame, id_: str, vector: str, centroids: Centroids) -> DataFrame:
    """``table`` with the state of its vectors for these centroids."""
    schema = T.StructType([table.schema[id_], table.schema[vector], *STATE])
    names, size, many = schema.names, centroids.point.shape[1], len(centroids.point) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                n = batch.num_rows
                x = batch.column(vector).flatten().to_numpy().reshape(n, size).astype(np.int64)
                if "upper" in batch.schema.names:
                    state = [batch.column(f.name).to_numpy() for f in STATE[:4]]
                else:
                    state = [np.zeros(n, np.int32), np.full(n, int(many), np.int32), np.full(n, np.inf),
                             np.zeros(n)]
                state = centroids.assign(x, *state)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_), batch.column(vector),
                     *[pa.array(s.astype(t)) for s, t in zip(state, ("i4", "i4", "f8", "f8", "i8"))]], names)

    return table.mapInArrow(run, schema)


def moved_centroids(table: DataFrame, vector: str, old: np.ndarray) -> np.ndarray:
    """Floors of the means of each centroid's vectors; a centroid without any stays."""
    sums = [F.sum(F.col(vector)[i].cast("long")).alias(f"s{i}") for i in range(old.shape[1])]
    new = old.copy()
    for row in table.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(old.shape[1])]
    return new


def cluster(vectors: DataFrame, scratch: Scratch, k: int = 8, rounds: int = 10, size: int = 64,
            scale: int = 1024, seed: int = 3, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable vector its id, ``cluster`` and squared ``distance``, with its cluster's ``centroid``
    and ``cluster_inertia`` and the ``inertia`` of all."""
    spark = vectors.sparkSession
    table = scratch.table(whole_vectors(vectors.select(id_, vector), vector, size, scale), "whole")
    point = first_centroids(table, id_, vector, k, seed)
    if not len(point):
        return table.selectExpr(f"`{id_}`", "0 cluster", "0L distance", f"`{vector}` centroid",
                                "0L cluster_inertia", "0L inertia").where("false")
    moved = np.zeros(len(point))
    for r in range(rounds + 1):
        table = scratch.table(assigned(table, id_, vector, Centroids(point, moved)), f"round{r}")
        scratch.drop("whole" if r == 0 else f"round{r - 1}")
        if r == rounds:
            break
        old, point = point, moved_centroids(table, vector, point)
        moved = np.sqrt(squared(point, old).astype(np.float64))
    inertia = {r["cluster"]: r["inertia"] for r in
               table.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    rows = [(c, p, inertia.get(c, 0), total) for c, p in enumerate(point.tolist())]
    about = spark.createDataFrame(
        rows, "cluster int, centroid array<int>, cluster_inertia long, inertia long")
    # one row for each centroid
    return table.select(id_, "cluster", "distance").join(F.broadcast(about), "cluster") \
        .select(id_, "cluster", "distance", "centroid", "cluster_inertia", "inertia")
