"""Calibrators: collect pairs, fit, apply, per user and model kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import clip, col, count_at_most, mean_of

# Sizes a calibrator needs (fixed values)
MIN_REGRESSION, MIN_CLASSES, MIN_ISOTONIC, MIN_DISTINCT, SAMPLE = 30, 50, 100, 10, 5000


def collect_calibration_pairs(scored: DataFrame, prediction: str, actual: str, key: str,
                              churn: bool = False, sample: int | None = None) -> DataFrame:
    """All scored rows with an actual, as (prediction, actual).

    A ``sample`` bounds the rows a churn calibrator, a classifier, is fitted on: that many rows in
    the order of a hash of the key, taken before rows without an actual drop out.  Regression
    calibrators always read all rows.
    """
    if sample is not None and not churn:
        raise ValueError("only a churn calibrator may be fitted on a sample")
    h = F.md5(col(key).cast("string"))
    picked = scored.select(col(key).alias("k"), col(prediction).cast("double").alias("prediction"),
                           col(actual).try_cast("double").alias("actual"))
    if sample is not None:
        picked = picked.orderBy(h, "k").limit(sample)
    a = F.col("actual")
    if churn:
        whole = a.cast("int")
        a = F.when(whole.isin(0, 1), whole).otherwise((a >= 0.5).cast("int")).cast("double")
    return picked.where(F.col("actual").isNotNull() & F.col("prediction").isNotNull()).select(
        "prediction", a.alias("actual"))


def _finite(pairs: DataFrame) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return pairs.where(ok("prediction") & ok("actual"))


@dataclass
class Calibrator:
    """Knots of a piecewise-linear map; between knots it interpolates, outside it clips
    (isotonic) or extends (linear)."""

    kind: str
    xs: list[float]
    ys: list[float]
    metrics: dict[str, float]

    def column(self, raw) -> Column:
        x = col(raw).cast("double")
        if self.kind == "linear":
            return self.ys[0] + self.ys[1] * x
        return interpolate(x, F.array(*[F.lit(v) for v in self.xs]), F.array(*[F.lit(v) for v in self.ys]))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Value at x of the line through the knots, found by bisection; flat beyond the ends."""
    below = count_at_most(xs, x)
    lo, hi = F.get(xs, below - 1), F.get(xs, below)
    a, b = F.get(ys, below - 1), F.get(ys, below)
    inside = F.when(lo == x, a).otherwise(a + (b - a) * F.try_divide(x - lo, hi - lo))
    return F.when(below == 0, F.get(ys, F.lit(0))).when(below == F.size(xs), F.get(ys, F.size(ys) - 1)
                                                          ).otherwise(inside)


def fit_regression_calibrator(pairs: DataFrame) -> Calibrator:
    """Isotonic with enough distinct pairs, else a straight line; refuses under 30 pairs."""
    p = _finite(pairs)
    s = p.agg(F.count("*").alias("n"), F.count_distinct("prediction").alias("d")).first()
    if s.n < MIN_REGRESSION:
        raise ValueError(f"need at least {MIN_REGRESSION} pairs to fit a regression calibrator; got {s.n}")
    if s.n >= MIN_ISOTONIC and s.d >= MIN_DISTINCT:
        cal = _isotonic(p)
    else:
        vec = VectorAssembler(inputCols=["prediction"], outputCol="features").transform(p)
        m = LinearRegression(labelCol="actual", predictionCol="fitted", solver="normal").fit(vec)
        cal = Calibrator("linear", [], [float(m.intercept), float(m.coefficients[0])], {})
    err = p.agg(mean_of(F.abs(F.col("actual") - F.col("prediction"))).alias("b"),
                mean_of(F.abs(F.col("actual") - cal.column("prediction"))).alias("a")).first()
    cal.metrics = _gain(s.n, "mae", err.b, err.a)
    return cal


def fit_classification_calibrator(pairs: DataFrame) -> Calibrator:
    """Isotonic map of probabilities; needs 50 pairs and both classes."""
    p = _finite(pairs).withColumn("prediction", clip("prediction", 0.0, 1.0))
    s = p.agg(F.count("*").alias("n"), F.sum("actual").alias("pos")).first()
    if s.n < MIN_CLASSES:
        raise ValueError(f"need at least {MIN_CLASSES} pairs to fit a churn calibrator; got {s.n}")
    if s.pos in (0, s.n):
        raise ValueError("cannot fit a churn calibrator: the labels are all 0 or all 1")
    cal = _isotonic(p)
    cal.ys = [min(1.0, max(0.0, v)) for v in cal.ys]
    sq = lambda c: mean_of(F.pow(c - F.col("actual"), 2))
    err = p.agg(sq(F.col("prediction")).alias("b"), sq(cal.column("prediction")).alias("a")).first()
    cal.metrics = {**_gain(s.n, "brier", err.b, err.a), "positive_rate": round(s.pos / s.n, 4)}
    return cal


def _gain(n, name, before, after) -> dict[str, float]:
    return {"n_samples": n, f"{name}_before": round(before, 4), f"{name}_after": round(after, 4),
            "improvement_pct": round(100 * (before - after) / max(before, 1e-9), 2)}


def _isotonic(p: DataFrame) -> Calibrator:
    # equal predictions meet in one weighted row first, on the map side
    rows = p.groupBy("prediction").agg(mean_of(F.col("actual")).alias("actual"),
                                       F.count("*").cast("double").alias("weight"))
    m = IsotonicRegression(featuresCol="prediction", labelCol="actual", predictionCol="fitted",
                           weightCol="weight").fit(rows)
    return Calibrator("isotonic", [float(v) for v in m.boundaries], [float(v) for v in m.predictions], {})


def apply_calibrator(value: Column, raw, model_kind) -> Column:
    """Calibrated value in the range of its kind; the raw value where it is not finite."""
    kind = model_kind if isinstance(model_kind, Column) else F.lit(model_kind)
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    out = F.when(kind == "churn", clip(value, 0.0, 1.0)).when(
        kind.isin("revenue", "growth"), F.greatest(value, F.lit(0.0))).otherwise(value)
    return F.when(good, out).otherwise(col(raw).cast("double"))


def calibrator_row(spark, user_id: int, model_kind: str, cal: Calibrator) -> DataFrame:
    """A calibrator as a table row, to store and to join by user."""
    return spark.createDataFrame(
        [(user_id, model_kind, cal.kind, cal.xs, cal.ys)],
        "user_id long, model_kind string, calibrator_kind string, xs array<double>, ys array<double>")


def apply_calibrators(scored: DataFrame, calibrators: DataFrame, raw: str = "prediction") -> DataFrame:
    """Each row through the active calibrator of its user and model kind; none keeps the raw value."""
    j = scored.join(calibrators.select("user_id", "model_kind", "calibrator_kind", "xs", "ys"),
                    ["user_id", "model_kind"], "left")
    x = col(raw).cast("double")
    value = F.when(F.col("calibrator_kind") == "linear", F.get("ys", F.lit(0)) + F.get("ys", F.lit(1)) * x) \
        .when(F.col("calibrator_kind").isNotNull(), interpolate(x, F.col("xs"), F.col("ys")))
    return j.withColumn("calibrated", apply_calibrator(value, raw, F.col("model_kind"))).drop(
        "calibrator_kind", "xs", "ys")
