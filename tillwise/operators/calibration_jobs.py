"""Calibrators of all users and model kinds at once: fitted in one run of jobs, applied as of a knot.

*Fit.*  Pairs with equal predictions meet in one weighted cell.  Cells are cut into ranges of similar
size by (user, kind, prediction), so a user with most of the pairs is spread over many tasks and
small users share one.  Each range pools adjacent violators into blocks of rising means.  Pooling
ranges and then their blocks gives the same fit as pooling all cells, and a block whose mean is not
under any mean of its user in earlier ranges, nor over any in later ones, is final.  Only the other
blocks, those around the range borders, are pooled again: together where they are few, else pairs of
ranges at a time, which halves the number of ranges in each round.

*Apply.*  Different predictions and knots are ordered together in ranges of similar size; a prediction
takes the last knot before it and the next one behind it from its range, or from a carry table with one row per
(user, kind, range).  Neither a plan nor a row holds an array of knots.

Pairs without user or kind, or that are not finite, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import clip, col, mean_of
from tillwise.functions.lags import range_number
from tillwise.operators.calibrate import (
    MIN_CLASSES, MIN_DISTINCT, MIN_ISOTONIC, MIN_REGRESSION, apply_calibrator,
)
from tillwise.session import checkpointed

KEYS = ["user_id", "model_kind"]
#: Blocks at range borders that are pooled in one round, a proven bound; beyond it, in rounds by pairs.
FEW_BLOCKS = 200_000


@dataclass
class Calibrators:
    """``table``: one row per user and kind (what was fitted or why not, line, metrics);
    ``knots``: rows (user_id, model_kind, x, y) of the isotonic ones."""

    table: DataFrame
    knots: DataFrame


def violators_pooled(group: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """First member, sum and weight of the blocks, with rising means in each group."""
    first, sums, weights, owner = [], [], [], []
    for k, (g, s, w) in enumerate(zip(group.tolist(), total.tolist(), weight.tolist())):
        at = k
        while first and owner[-1] == g and sums[-1] * w > s * weights[-1]:
            s, w = s + sums.pop(), w + weights.pop()
            at = first.pop()
            owner.pop()
        first.append(at)
        sums.append(s)
        weights.append(w)
        owner.append(g)
    return np.array(first, np.int64), np.array(sums, float), np.array(weights, float)


def _pooled(cells: DataFrame, by: str) -> DataFrame:
    """Blocks of the cells of each range; ``cells``: keys, low, high, total, weight and the range."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*KEYS, "low"], ignore_index=True)
        group = part.groupby(KEYS, sort=False).ngroup().to_numpy()
        first, total, weight = violators_pooled(group, part["total"].to_numpy(), part["weight"].to_numpy())
        out = part.iloc[first].reset_index(drop=True)
        out["high"] = part["high"].to_numpy()[np.r_[first[1:], len(part)] - 1]
        return out.assign(total=total, weight=weight)

    return cells.groupBy(by).applyInPandas(run, cells.schema)


def isotonic_blocks(cells: DataFrame) -> DataFrame:
    """(keys, low, high, mean) of the isotonic fit of every key; ``cells`` are rows (keys, prediction,
    total, weight) with unique predictions."""
    cells = cells.select(*KEYS, F.col("prediction").alias("low"), F.col("prediction").alias("high"),
                         "total", "weight")
    cells = cells.withColumn("range", range_number(cells, [*KEYS, "low"]))
    mean = F.col("total") / F.col("weight")
    blocks, final = _pooled(cells, "range"), []
    before = Window.partitionBy(*KEYS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*KEYS).orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    while True:
        blocks = checkpointed(blocks)
        # one row for each key and range
        ends = blocks.groupBy(*KEYS, "range").agg(F.min(mean).alias("least"), F.max(mean).alias("most"))
        ends = ends.select(*KEYS, "range", F.max("most").over(before).alias("most_before"),
                           F.min("least").over(behind).alias("least_behind")) \
            .where("most_before IS NOT NULL OR least_behind IS NOT NULL")
        marked = blocks.join(ends, [*KEYS, "range"], "left").withColumn("open", F.coalesce(
            mean < F.col("most_before"), F.lit(False)) | F.coalesce(mean > F.col("least_behind"), F.lit(False)))
        marked = checkpointed(marked.select(*blocks.columns, "open"))
        final.append(marked.where("NOT open").drop("open"))
        left = marked.where("open").drop("open")
        n = left.count()
        if not n:
            break
        if n <= FEW_BLOCKS:
            final.append(checkpointed(_pooled(left.withColumn("range", F.pmod(F.xxhash64(*KEYS), F.lit(64)).cast("int")),
                                              "range")))
            break
        blocks = _pooled(left.withColumn("range", F.floor(F.col("range") / 2).cast("int")), "range")
    out = final[0]
    for part in final[1:]:
        out = out.unionByName(part)
    return out.select(*KEYS, "low", "high", mean.alias("mean"))


def fit_calibrators(pairs: DataFrame) -> Calibrators:
    """Calibrators of all users and kinds from rows (user_id, model_kind, prediction, actual).

    Kind churn: isotonic in 0 to 1, from 50 pairs of both classes; other kinds: isotonic from
    100 pairs with 10 different predictions, else a line, from 30 pairs.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    churn = F.col("model_kind") == "churn"
    pairs = pairs.select(*KEYS, F.col("prediction").cast("double").alias("prediction"),
                         F.col("actual").cast("double").alias("actual")).dropna(subset=KEYS)
    pairs = pairs.where(finite("prediction") & finite("actual")).withColumn(
        "prediction", F.when(churn, clip("prediction", 0.0, 1.0)).otherwise(F.col("prediction") + 0.0))
    cells = checkpointed(pairs.groupBy(*KEYS, "prediction").agg(
        F.sum("actual").alias("total"), F.count("*").cast("double").alias("weight")))
    distinct = cells.groupBy(*KEYS).agg(F.count("*").alias("n_distinct"))
    stats = pairs.groupBy(*KEYS).agg(
        F.count("*").alias("n_samples"), F.sum("actual").alias("positive"),
        F.regr_slope("actual", "prediction").alias("slope"),
        F.regr_intercept("actual", "prediction").alias("intercept"), F.avg("actual").alias("level"))
    n, positive = F.col("n_samples"), F.col("positive")
    kind = F.when(churn & (n < MIN_CLASSES) | ~churn & (n < MIN_REGRESSION), "refused: too few pairs") \
        .when(churn & ((positive == 0) | (positive == n)), "refused: one class") \
        .when(churn | (n >= MIN_ISOTONIC) & (F.col("n_distinct") >= MIN_DISTINCT), "isotonic").otherwise("linear")
    # predictions that are all the same have no slope
    kinds = checkpointed(stats.join(distinct, KEYS).select(
        *KEYS, kind.alias("calibrator_kind"), "n_samples", "n_distinct",
        F.when(churn, F.col("positive") / n).alias("positive_rate"),
        F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "level").alias("intercept")))
    chosen = cells.join(kinds.where("calibrator_kind = 'isotonic'").select(*KEYS), KEYS, "left_semi")
    blocks = isotonic_blocks(chosen)
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    knots = blocks.select(*KEYS, F.explode(ends).alias("x"), F.col("mean").alias("y"))
    knots = checkpointed(knots.withColumn("y", F.when(churn, clip("y", 0.0, 1.0)).otherwise(F.col("y"))))
    fitted = apply_all(pairs, Calibrators(kinds, knots), value_only=True)
    error = lambda p: F.when(churn, F.pow(p - F.col("actual"), 2)).otherwise(F.abs(F.col("actual") - p))
    gain = fitted.groupBy(*KEYS).agg(mean_of(error(F.col("prediction"))).alias("b"),
                                     mean_of(error(F.col("calibrated"))).alias("a"))
    table = kinds.join(gain, KEYS).select(
        *KEYS, "calibrator_kind", "n_samples", F.round("positive_rate", 4).alias("positive_rate"),
        "intercept", "slope", *[F.when(~F.startswith("calibrator_kind", F.lit("refused")), e).alias(name)
                                for name, e in (
            ("error_before", F.round("b", 4)), ("error_after", F.round("a", 4)),
            ("improvement_pct", F.round(100 * (F.col("b") - F.col("a")) / F.greatest(F.col("b"), F.lit(1e-9)), 2)))])
    return Calibrators(checkpointed(table), knots)


def knots_around(scored: DataFrame, knots: DataFrame, x: str) -> DataFrame:
    """``scored`` with ``_below``, the last knot (x, y) at or before its ``x``, and ``_above``, the next.

    Each different (user, kind, x) is looked up once and joined back.
    """
    knot = "struct<x:double,y:double>"
    asked = scored.select(*KEYS, col(x).cast("double").alias("_x")).dropna().distinct()
    every = asked.select("*", F.lit(1).alias("_tag"), F.lit(None).cast(knot).alias("_knot")).unionByName(
        knots.select(*KEYS, F.col("x").alias("_x"), F.lit(0).alias("_tag"), F.struct("x", "y").alias("_knot")))
    every = every.withColumn("_range", range_number(every, [*KEYS, "_x", "_tag"]))
    place = [*KEYS, "_range"]
    w = Window.partitionBy(*place).orderBy("_x", "_tag")
    inner = every.withColumns({
        "_below": F.last("_knot", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_above": F.first("_knot", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    # one row for each key and range
    ends = every.groupBy(*place).agg(F.min("_knot").alias("first"), F.max("_knot").alias("last"))
    by_key = Window.partitionBy(*KEYS).orderBy("_range")
    carry = ends.select(
        *place, F.last("last", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"),
        F.first("first", ignorenulls=True).over(by_key.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    found = inner.where("_tag = 1").join(carry, place, "left").select(
        *KEYS, "_x", F.coalesce("_below", "_prior").alias("_below"), F.coalesce("_above", "_next").alias("_above"))
    return scored.withColumn("_x", col(x).cast("double")).join(found, [*KEYS, "_x"], "left").drop("_x")


def between(x: Column, below: Column, above: Column) -> Column:
    """The value at x of the line between two knots; flat beyond the ends; NULL without knots."""
    line = below["y"] + (above["y"] - below["y"]) * F.try_divide(x - below["x"], above["x"] - below["x"])
    return F.when(below.isNull(), above["y"]).when(above.isNull() | (below["x"] == x), below["y"]).otherwise(line)


def apply_all(scored: DataFrame, fitted: Calibrators, raw: str = "prediction", value_only: bool = False) -> DataFrame:
    """Each row, with its user and kind, through that calibrator; a row without one, or without a
    finite raw value, keeps it.  ``value_only`` leaves values outside the range of their kind."""
    lines = fitted.table.where("calibrator_kind = 'linear'").select(*KEYS, "intercept", "slope")
    x = col(raw).cast("double")
    around = knots_around(scored, fitted.knots, raw).join(lines, KEYS, "left")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    value = F.when(fine, F.coalesce(F.col("intercept") + F.col("slope") * x,
                                    between(x, F.col("_below"), F.col("_above"))))
    out = F.coalesce(value, x) if value_only else apply_calibrator(value, raw, F.col("model_kind"))
    return around.select(*[col(c) for c in scored.columns], out.alias("calibrated"))
