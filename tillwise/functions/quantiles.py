"""Exact quantiles (linear interpolation) that scale.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.  It is used
where a distinct count of the values, or the size of the largest group, has shown that buffer to be
small.  Otherwise the same answer comes from narrowing: approximate quantiles cut the values into ranges of similar size, ranges are
counted exactly, only those that hold a wanted rank stay, and the cut is repeated inside them; ranks
are read off the values left.  Cuts go by rank, so values of very different scales are cut as evenly
as any.  NULL and NaN are no values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import col

#: Distinct values of all groups and columns that one aggregate may hold (about 50 bytes each).
DIRECT_VALUES = 1_000_000
#: Rows of the largest group, times columns, up to which every group is aggregated at once.
GROUP_VALUES = 10_000
BUCKETS = 32
LEVELS = 3


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    direct_values: int = DIRECT_VALUES,
) -> DataFrame:
    """One row per group; each named column becomes array<double> aligned with ``probs``."""
    value = lambda c: F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    df = df.select(*by, *[value(c).alias(c) for c in columns])
    row = df.agg(*[F.approx_count_distinct(F.struct(*by, col(c)), 0.05).alias(f"n{k}")
                   for k, c in enumerate(columns)]).first() if direct_values else None
    if row is not None and sum(row) <= direct_values:
        return _direct(df, columns, probs, by)
    if row is not None and by:
        # a buffer holds the values of one group, and a task that meets many groups sorts them
        sizes = df.groupBy(*by).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) * len(columns) <= GROUP_VALUES:
            return _direct(df, columns, probs, by)
    return _narrowed(df, columns, probs, list(by))


def _direct(df, columns, probs, by):
    p = F.array(*[F.lit(float(x)) for x in probs])
    return df.groupBy(*by).agg(*[F.percentile(col(c), p).alias(c) for c in columns])


def _narrowed(df, columns, probs, by):
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("_c"), col(c).cast("double").alias("_v"))
                      for c in columns])
        ).alias("_x"),
    ).select(*by, "_x._c", "_x._v").where(F.col("_v").isNotNull())
    top = [*by, "_c"]

    ranks = long.groupBy(*top).agg(F.count("*").alias("_n"))
    wanted = ranks.select(
        *top, F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"), "_n"
    ).select(*top, "_i", ((F.col("_n") - 1) * F.col("_p")).alias("_h"))
    edges = wanted.select(
        *top, F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_r")
    ).distinct()

    cur, path = long.withColumn("_base", F.lit(0).cast("long")), []
    for level in range(LEVELS):
        keys, b = [*top, *path], f"_b{level}"
        span = cur.groupBy(*keys).agg(F.approx_percentile("_v", F.array(*[
            F.lit(k / BUCKETS) for k in range(1, BUCKETS)]), F.lit(1000)).alias("_cuts"))
        cur = _attach(cur, span, keys).withColumn(
            b, F.size(F.filter("_cuts", lambda e: e <= F.col("_v")))).drop("_cuts")
        counts = cur.groupBy(*keys, b, "_base").agg(F.count("*").alias("_k"))
        w = Window.partitionBy(*keys).orderBy(b)
        counts = counts.withColumn(
            "_start", F.col("_base") + F.sum("_k").over(w) - F.col("_k"))
        keep = (
            counts.join(edges, top)
            .where((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_k")))
            .select(*keys, b, F.col("_start")).distinct()
        )
        path.append(b)
        cur = cur.drop("_base").join(keep, [*top, *path]).withColumnRenamed("_start", "_base")

    values = cur.groupBy(*top, *path, "_base", "_v").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*top, *path).orderBy("_v")
    values = values.withColumn("_start", F.col("_base") + F.sum("_k").over(w) - F.col("_k"))
    at = values.join(edges, top).where(
        (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_k"))
    ).select(*top, "_r", "_v")

    low = at.select(*top, F.col("_r").alias("_rl"), F.col("_v").alias("_vl"))
    high = at.select(*top, F.col("_r").alias("_rh"), F.col("_v").alias("_vh"))
    q = (
        wanted.withColumn("_rl", F.floor("_h")).withColumn("_rh", F.ceil("_h"))
        .join(low, [*top, "_rl"]).join(high, [*top, "_rh"])
        .withColumn("_q", F.when(F.col("_rl") == F.col("_rh"), F.col("_vl")).otherwise(
            (F.col("_rh") - F.col("_h")) * F.col("_vl") + (F.col("_h") - F.col("_rl")) * F.col("_vh")))
    )
    out = q.groupBy(*top).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("_qs"))
    return out.groupBy(*by).agg(
        *[F.any_value(F.when(F.col("_c") == c, F.col("_qs")), True).alias(c) for c in columns]
    )


def _attach(df, span, keys):
    """Join the per-group range; AQE broadcasts it when its measured size allows."""
    return df.join(span, keys)


def median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact medians as plain doubles."""
    q = quantiles(df, columns, [0.5], by)
    return q.select(*by, *[col(c)[0].alias(c) for c in columns])
