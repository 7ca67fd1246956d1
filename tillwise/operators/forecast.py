"""Forecasts per series: seasonal decomposition and model-driven recursion.

Series are monthly tables, so a series is as long as its calendar; series are independent and
spread over the cluster by their keys.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import lookup, ratio
from tillwise.functions.vocab import SEASONAL_INDEX
from tillwise.session import checkpointed

MIN_POINTS = 6           # fixed value
BAND_80 = 1.2815515655446004   # normal quantile of an 80 % band (fixed value)


def _month_number(c) -> Column:
    """Months since the year 2000; a small number keeps the line fit well conditioned."""
    return (F.year(c) - 2000) * 12 + F.month(c)


def fit_seasonal(monthly: DataFrame, by: tuple[str, ...], month: str = "month_key",
                 value: str = "monthly_revenue", mode: str = "additive") -> DataFrame:
    """Per series and calendar month: line through the series and the mean deviation from it.

    Additive deviations are differences, multiplicative ones are ratios.  Series of fewer than
    six points give nothing.
    """
    t = _month_number(month)
    s = monthly.where(F.col(month).isNotNull() & F.col(value).isNotNull()).select(
        *by, F.col(month).alias("m"), t.cast("double").alias("t"),
        F.col(value).cast("double").alias("y"))
    line = s.groupBy(*by).agg(
        F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("base"),
        F.count("*").alias("n"), F.max("m").alias("last")).where(F.col("n") >= MIN_POINTS)
    fit = s.join(line, list(by)).withColumn("trend", F.col("base") + F.col("slope") * F.col("t"))
    dev = F.col("y") - F.col("trend") if mode == "additive" else ratio("y", "trend")
    season = fit.withColumn("dev", dev).groupBy(*by, F.month("m").alias("cal")).agg(
        F.avg("dev").alias("effect"))
    back = fit.withColumn("cal", F.month("m")).join(season, [*by, "cal"])
    value_of = F.col("trend") + F.col("effect") if mode == "additive" \
        else F.col("trend") * F.col("effect")
    spread = back.groupBy(*by).agg(F.stddev_pop(F.col("y") - value_of).alias("sd"))
    effects = season.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("cal", "effect"))).alias("effects"))
    return line.join(effects, list(by)).join(spread, list(by))


def forecast_seasonal(monthly: DataFrame, by: tuple[str, ...], horizon: int = 12,
                      month: str = "month_key", value: str = "monthly_revenue",
                      mode: str = "additive") -> DataFrame:
    """The next ``horizon`` months of every series, with an 80 % band."""
    fit = fit_seasonal(monthly, by, month, value, mode)
    neutral = 0.0 if mode == "additive" else 1.0
    rows = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    rows = rows.withColumn("at", F.add_months("last", F.col("step")))
    trend = F.col("base") + F.col("slope") * _month_number("at")
    effect = F.coalesce(F.try_element_at("effects", F.month("at")), F.lit(neutral))
    y = trend + effect if mode == "additive" else trend * effect
    return rows.select(*by, F.date_format("at", "yyyy-MM").alias("month"),
                       y.alias("predicted_revenue"), (y - BAND_80 * F.col("sd")).alias("lower_80"),
                       (y + BAND_80 * F.col("sd")).alias("upper_80"))


def seasonal_holdout(monthly: DataFrame, by: tuple[str, ...], hold: int = 3,
                     month: str = "month_key", value: str = "monthly_revenue",
                     mode: str = "multiplicative") -> DataFrame:
    """Actual and forecast of each series' last months, fitted without them."""
    w = Window.partitionBy(*by).orderBy(F.desc(month))
    m = monthly.withColumn("_back", F.row_number().over(w))
    fc = forecast_seasonal(m.where(F.col("_back") > hold).drop("_back"), by, hold, month, value, mode)
    test = m.where(F.col("_back") <= hold).select(
        *by, F.date_format(month, "yyyy-MM").alias("month"), F.col(value).alias("actual"))
    return test.join(fc, [*by, "month"])


def growth_actual_series(monthly: DataFrame, by: tuple[str, ...] = (), month: str = "month_key",
                         value: str = "monthly_revenue") -> DataFrame:
    """Actual months of each series with a note where a forecast is not possible."""
    n = F.count("*").over(Window.partitionBy(*by))
    return monthly.where(F.col(month).isNotNull()).select(
        *by, F.date_format(month, "yyyy-MM").alias("month"),
        F.round(F.col(value), 2).alias("actual_revenue"),
        F.when(n < MIN_POINTS, F.concat(
            F.lit("Forward forecast requires ≥6 months of data; found "), n.cast("string"),
            F.lit(". Forecast skipped."))).alias("forecast_note"))


# Recursion with a trained model -------------------------------------------------------------

def forecast_revenue_recursive(last_rows: DataFrame, model: PipelineModel,
                               by: tuple[str, ...], steps: int = 12) -> DataFrame:
    """Feed each prediction back as lags and rolling means, one month further per step.

    ``last_rows`` holds the last observed row of every series; step 1 predicts that row itself.
    """
    cur, out = last_rows.withColumn("_seen", F.col("net_revenue").cast("double")), None
    for step in range(1, steps + 1):
        scored = checkpointed(model.transform(cur).drop("features"))
        one = scored.select(*by, F.lit(step).alias("step"), F.col("prediction").alias("forecast"))
        out = one if out is None else out.unionByName(one)
        nxt = F.when(F.col("month") == 12, 1).otherwise(F.col("month") + 1).cast("int")
        keep = [c for c in scored.columns if c in cur.columns]
        cur = scored.select(*keep, "prediction", nxt.alias("_m"))
        new = {"year": F.col("year") + F.when(F.col("_m") == 1, 1).otherwise(0), "month": F.col("_m"),
               "quarter": F.floor((F.col("_m") - 1) / 3) + 1,
               "seasonal_index": lookup(F.col("_m"), SEASONAL_INDEX, 1.0),
               "week_of_year": F.least(F.lit(52), F.floor((F.col("_m") - 1) * 4.33) + 1),
               "day_of_week": F.lit(0), "revenue_lag_7d": F.col("_seen"),
               "revenue_lag_30d": F.col("_seen"), "revenue_roll_7d": F.col("prediction"),
               "revenue_roll_30d": F.col("prediction"), "revenue_roll_90d": F.col("prediction"),
               "_seen": F.col("prediction")}
        kinds = dict(cur.dtypes)
        cur = cur.withColumns({c: v.cast(kinds[c]) for c, v in new.items() if c in kinds}).drop(
            "prediction", "_m")
    return out


def forecast_growth_recursive(monthly: DataFrame, model: PipelineModel, by: tuple[str, ...],
                              horizon: Column | int | None = None) -> DataFrame:
    """Walk each monthly series forward; the horizon may differ by series (a column).

    Without one a series goes a third of its months forward, at least one month and at most six.
    """
    hist = monthly.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("month_label", "monthly_revenue"))),
                    lambda x: x["monthly_revenue"]).alias("_hist"),
        F.max_by(F.struct(*[c for c in monthly.columns if c not in by]), "month_label").alias("_r"))
    cur = hist.select(*by, "_hist", "_r.*")
    if horizon is None:
        horizon = F.least(F.lit(6), F.greatest(F.lit(1), F.floor(F.size("_hist") / 3)))
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    cur, out = checkpointed(cur.withColumn("_h", h)), None
    for step in range(1, max(1, cur.agg(F.max("_h")).first()[0] or 0) + 1):
        scored = checkpointed(model.transform(cur.where(F.col("_h") >= step)).drop("features"))
        nxt = F.add_months("month_label", 1)
        one = scored.select(*by, F.date_format(nxt, "yyyy-MM").alias("period"),
                            F.round("prediction", 2).alias("forecast"))
        out = one if out is None else out.unionByName(one)
        back = lambda k: F.get(F.col("_hist"), F.greatest(F.size("_hist") - k, F.lit(0)))
        m, p = F.month(nxt), F.col("prediction")
        new = {"month_label": nxt, "month_num": m, "year_num": F.year(nxt),
               "sin_m": F.sin(2 * F.pi() * m / 12), "cos_m": F.cos(2 * F.pi() * m / 12),
               "monthly_revenue": p, "lag_1_rev": back(1), "lag_2_rev": back(2),
               "lag_3_rev": back(3), "lag_12_rev": back(12),
               "yoy_growth": (p - back(12)) / F.greatest(F.lit(1.0), F.abs(back(12))),
               "_hist": F.array_append("_hist", p)}
        kinds = dict(scored.dtypes)
        cur = scored.withColumns({c: v.cast(kinds[c]) for c, v in new.items() if c in kinds}).drop(
            "prediction")
    return out
