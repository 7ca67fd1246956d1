"""Lags inside a group that stay parallel when one group holds most of the rows.

A window over ``group`` alone sorts a hot group in one task.  Here the rows are cut into ranges of
similar size by (group, order, row id), so a group, a day or an hour that holds most rows is spread over
as many ranges as its share; lags inside a range come from a window over (group, range), and the
first rows of a range take theirs from a carry table holding the last rows of the ranges before
it.  The carry table has one row per (group, range); with no group that is one row per range, a fixed
number.

Range bounds come from a sample of the rows of fixed size, drawn by hash, and are a literal of fixed
size in the plan.  They decide sizes only, never results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, count_at_most

ROW_ID_SPAN = 1_000_000
#: Ranges for each shuffle partition, and sampled rows for each range.
RANGES, SAMPLED = 4, 16


def range_number(df: DataFrame, keys: Sequence[str]) -> Column:
    """The range of each row among ranges of similar size, ascending by the keys; their values are
    unique or nearly so."""
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[col(c).alias(f"k{k}") for k, c in enumerate(keys)])
    drawn = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(n * SAMPLED)
    step = F.greatest(F.lit(1), F.floor(F.size("s") / n).cast("int"))
    found = drawn.agg(F.sort_array(F.collect_list("k")).alias("s")).select(
        F.filter("s", lambda _, i: i % step == step - 1).alias("s"))
    written = found.select(F.to_json("s")).first()[0]
    # sorted again, because some types lose digits in writing
    bounds = F.sort_array(F.from_json(F.lit(written), found.schema["s"].dataType))
    return count_at_most(bounds, key, 2 * n)


def sliced_lags(
    df: DataFrame,
    group: Sequence[str],
    order_col: str,
    row_id: str,
    values: Sequence[str],
    offsets: Sequence[int],
    slice_unit: str | None = None,
) -> DataFrame:
    """Add ``{value}__lag{k}`` for every value and offset; order is (order_col, row_id).

    ``row_id`` must be a unique whole number; rows with NULL order or group are not expected.
    ``slice_unit``, any unit of ``date_trunc``, asks for calendar slices instead of ranges; a single
    date is cut further by ranges of ``row_id``, which is the order inside it.
    """
    depth = max(offsets)
    day = col(order_col)
    by_row = slice_unit == "DAY" and dict(df.dtypes)[order_col] == "date"
    slice_key = range_number(df, [*group, order_col, row_id]) if slice_unit is None else F.struct(
        F.date_trunc(slice_unit, day).alias("t"),
        (F.floor(col(row_id) / ROW_ID_SPAN) if by_row else F.lit(0)).cast("long").alias("r"),
    )
    base = df.withColumn("_sl", slice_key)
    keys = [*group, "_sl"]
    order = [col(order_col), col(row_id)]
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)

    inner = base.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_cnt", F.count(F.lit(1)).over(whole))
    for v in values:
        for k in offsets:
            inner = inner.withColumn(f"{v}__lag{k}", F.lag(col(v), k).over(w))

    # the last `depth` rows of each slice, newest first
    tail = (
        inner.where(F.col("_rn") > F.col("_cnt") - depth)
        .groupBy(*keys)
        .agg(F.reverse(F.array_sort(F.collect_list(
            F.struct(F.col("_rn").alias("rn"), *[col(v).alias(v) for v in values])))).alias("_tail"))
    )
    before = Window.partitionBy(*group).orderBy("_sl").rowsBetween(-depth, -1)
    carry = tail.select(*keys, F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(before))),
                                       1, depth).alias("_carry"))
    out = inner.join(carry, keys, "left")
    for v in values:
        for k in offsets:
            reach = F.lit(k) - F.col("_rn") + 1          # position in the carry, newest = 1
            old = F.get(F.col("_carry"), reach - 1)[v]
            out = out.withColumn(
                f"{v}__lag{k}",
                F.when(F.col("_rn") > k, col(f"{v}__lag{k}")).otherwise(old))
    return out.drop("_sl", "_rn", "_cnt", "_carry")
