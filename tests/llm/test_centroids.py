"""Clusters beside plain rounds over all centroids."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF, same

SCHEMA = "vec_id long, embedding array<double>, cluster string, centroid int, label int"


def plain(rows, k=8, rounds=10, size=64):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest), vector by vector."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
            and all(-(1 << 27) < 1024 * x < 1 << 27 for x in v)]
    drawn = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    point = [v for _, v in sorted(kept, key=drawn)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(point))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, g in groups.items():
            point[c] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, c in found:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in point]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in found]


def query_rows(df):
    from pyspark.sql import functions as F

    listed = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256))


def test_query(spark, duck):
    from compare import compare
    from tillwise.llm.queries import ORACLE, QUERIES

    out = QUERIES["op11_shallot_clusters"](spark, SF)
    rows = [(r["vec_id"], list(r["embedding"]))
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(out, plain(rows))
    assert compare(out, duck, ORACLE["op11_shallot_clusters"]) == "EXACT"


def messy_vectors():
    rng = np.random.RandomState(4)
    rows = [(k, [float(x) for x in np.round(rng.randn(6) * 2) / 4]) for k in range(300)]  # many ties
    rows += [(k % 5, rows[0][1]) for k in range(200)]  # one very common vector, repeated ids
    rows += [(None, rows[1][1]), (None, None), (1000, None), (1001, []), (1002, [1.0] * 5), (1003, [1.0] * 7),
             (1004, [1.0] * 5 + [None]), (1005, [float("nan")] * 6), (1006, [float("inf")] + [0.0] * 5),
             (1007, [1e300] * 6), (1008, [-0.0] * 6), (1009, [60_000.0] * 6), (1010, [-60_000.0] * 6)]
    return rows


@pytest.mark.parametrize("k", [1, 2, 8, 40])
def test_unusual_vectors(spark, scratch, k):
    from tillwise.llm.centroids import cluster

    rows = messy_vectors()
    df = spark.createDataFrame([(i, v, "x", 7, None) for i, v in rows], SCHEMA)
    out = cluster(df, scratch, k=k, rounds=4, size=6)
    assert out.columns == ["vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia"]
    expected = plain(rows, k, 4, 6)
    assert len(expected) > 500
    same(query_rows(out), expected)


def test_few_and_no_vectors(spark, scratch):
    from tillwise.llm.centroids import cluster
    from tillwise.llm.staging import Scratch

    rows = [(1, [0.5] * 6), (2, [0.25] * 6), (3, None)]
    out = cluster(spark.createDataFrame([(i, v, "x", 7, None) for i, v in rows], SCHEMA), scratch, size=6)
    same(query_rows(out), plain(rows, 8, 10, 6))
    none = cluster(spark.createDataFrame([], SCHEMA), Scratch(spark), size=6)
    assert none.columns == out.columns and none.count() == 0


def test_search_leaves_centroids_out():
    """The walk finds the two nearest of all centroids and measures only some of them."""
    import tillwise.llm.centroids as C

    rng = np.random.RandomState(7)
    point = rng.randint(-2000, 2000, (60, 4)).astype(np.int64)
    point[10] = point[3]
    x = np.r_[point[rng.randint(0, 60, 3000)] + rng.randint(-40, 40, (3000, 4)), point]
    all_ = ((x[:, None] - point) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(60), all_.shape), all_))[:, :2]
    measured, squared = [], C.squared
    c = C.Centroids(point, np.zeros(60))
    C.squared = lambda a, b: measured.append(len(a)) or squared(a, b)
    try:
        near, second, d, e = c.search(x, rng.randint(0, 30, len(x)), rng.randint(30, 60, len(x)))
        far = sum(measured)
        measured.clear()
        again = c.search(x, near, second)
    finally:
        C.squared = squared
    assert (near == order[:, 0]).all() and (second == order[:, 1]).all()
    assert (d == all_.min(1)).all() and (e == np.sort(all_, 1)[:, 1]).all()
    assert (again[0] == near).all() and (again[1] == second).all()
    # from remembered centroids few others are measured
    assert sum(measured) < 0.3 * 60 * len(x) and sum(measured) < far
