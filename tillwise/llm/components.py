"""Connected components of an edge table, by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours until each vertex points at the smallest
one of its component.  Neighbours are never gathered: minima are aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.staging import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: each vertex with an edge and the smallest vertex ``v`` < ``u`` of its component."""
    edges = scratch.table(edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    before, turn = None, 0
    while (now := _signature(edges)) != before:
        before, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.where("v > u").join(least, F.col("u") == F.col("w"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = (large.join(least, F.col("u") == F.col("w"))
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                         .alias("e")).select("e.u", "e.v").where("u != v").distinct())
        edges = scratch.table(small, f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
    return edges
