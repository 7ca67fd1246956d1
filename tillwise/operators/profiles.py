"""Fitness profiles of revenue and growth data: one aggregate, then rules as columns.

Both take ``by`` keys, so one job profiles any number of datasets.

The message texts are fixed values that reports are compared by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, days_between, ratio, text_array, warnings_array
from tillwise.functions.quantiles import quantiles
from tillwise.operators.aggregates import valid_rows

# Limits of the revenue profile (fixed values)
MIN_DAYS, MIN_ROWS, MIN_COVERAGE, HIGH_VARIATION = 90, 500, 30.0, 1.5
# Limits of the growth profile (fixed values)
MIN_MONTHS, CYCLE_MONTHS, FULL_MONTHS, MAX_HORIZON = 6, 12, 24, 12

NO_DATA = "insufficient_data"


def say(template: str, *parts) -> Column:
    """Text with parts filled in; ``{}`` marks a part (already text or number)."""
    pieces, out = template.split("{}"), []
    for k, piece in enumerate(pieces):
        if piece:
            out.append(F.lit(piece))
        if k < len(parts):
            p = parts[k]
            out.append((p if isinstance(p, Column) else F.lit(p)).cast("string"))
    return F.concat(*out)


def fixed(c, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(c).cast("double"))


def grouped(c) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(col(c).cast("double"), 0)


def whole(c) -> Column:
    return F.floor(c).cast("int")


def revenue_profile(df: DataFrame, date: str = "order_date", amount: str = "net_revenue",
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Is this revenue table fit to model, at which grain, and with what confidence?"""
    rows = valid_rows(df, date, amount).select(
        *by, col(date).alias("_d"), col(amount).alias("_a"))
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"),
        F.count_distinct(F.col("_d").cast("date")).alias("days"),
        F.sum("_a").cast("double").alias("total"), F.max(F.col("_a").cast("double")).alias("top"),
        F.stddev_samp(F.col("_a").cast("double")).alias("sd"),
    )
    q = quantiles(rows, ["_a"], [0.10, 0.50, 0.90, 0.99], by)
    if by:
        agg = agg.join(q.withColumnRenamed("_a", "q"), list(by), "left")
    else:
        agg = agg.withColumn("q", q.select("_a").scalar())
    s = agg.withColumn("span", F.coalesce(days_between("first", "last"), F.lit(0)).cast("int"))
    s = s.withColumn("cover", F.least(F.lit(100.0), ratio("days", F.col("span") + 1) * 100))
    s = s.withColumn("cov", F.col("sd") / F.greatest(F.col("total") / F.col("n"), F.lit(1e-9)))

    reason = (
        F.when(F.col("n") == 0, F.lit("No valid rows after parsing dates and dropping null amounts."))
        .when(F.col("span") < MIN_DAYS, say("Span of {} days is below minimum {}.",
                                            F.col("span"), MIN_DAYS))
        .when(F.col("n") < MIN_ROWS, say("Only {} transactions; need at least {}.",
                                         grouped("n"), MIN_ROWS))
        .when(F.col("cover") < MIN_COVERAGE, say("Day coverage of {}% is below {}%.",
                                                 fixed("cover", 1), MIN_COVERAGE))
    )
    s = s.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    grain = F.when(F.col("span") >= 540, "monthly").when(F.col("span") >= 180, "weekly").otherwise("daily")
    months = ((F.year("last") - F.year("first")) * 12 + F.month("last") - F.month("first") + 1).cast("int")
    s = s.withColumns({"grain": grain, "months": months})

    strong = (F.col("span") >= 540) & (F.col("cov") <= HIGH_VARIATION) & (F.col("cover") >= 70)
    suitable = F.array(
        say("{} aggregate revenue forecasting (use the aggregator helper)", F.initcap("grain")),
        F.lit("Identifying revenue drivers via feature importance"),
        F.lit("Detecting seasonality and trend changes over time"))
    unsuitable = F.array_compact(F.array(
        say("Quoting individual order values precisely (CoV={} → noisy at row level)", fixed("cov", 2)),
        F.lit("Forecasting categories or regions absent from the training data"),
        F.when(F.col("months") < 24,
               F.lit("Year-over-year growth claims (less than 24 months of history)"))))
    notes = warnings_array(
        (F.col("cov") > HIGH_VARIATION, say(
            "Order sizes vary widely (coefficient of variation = {}). Per-transaction MAPE will be "
            "naturally high — only aggregate ({}) forecasts will look clean on dashboards.",
            fixed("cov", 2), F.col("grain"))),
        (F.col("months") < 12, say(
            "Only {} months of data — yearly seasonality cannot be modelled reliably yet.",
            F.col("months"))),
        (F.col("cover") < 70, say(
            "Day coverage is {}% — there are gaps in the transactional history. Aggregate to weekly "
            "or monthly to smooth them.", fixed("cover", 0))))
    text = say(
        "This dataset spans {} days ({} to {}) with {} transactions and ${} total revenue. Order "
        "sizes have a coefficient of variation of {}, meaning per-transaction predictions are "
        "naturally noisy. The model is best used at the '{}' aggregation grain for executive "
        "reporting; per-row predictions remain valid for relative ranking but should not be quoted "
        "as absolute order values.",
        F.col("span"), F.col("first").cast("date"), F.col("last").cast("date"), grouped("n"),
        grouped("total"), fixed("cov", 2), F.col("grain"))
    refusal = say(
        "Revenue dataset cannot be profiled reliably: {} The revenue model should be skipped for "
        "this dataset and the report should disclose this clearly.", F.col("reason"))

    if_ok = lambda c, d=None: F.when(ok, c) if d is None else F.when(ok, c).otherwise(d)
    per_day = lambda c: F.round(ratio(c, F.greatest("days", F.lit(1))), 2)
    return s.select(
        *by,
        F.when(~ok, NO_DATA).when(F.col("span") >= 365, "acceptable")
        .otherwise("acceptable_minimum").alias("strategy"),
        F.when(~ok, "low").when(strong, "high").otherwise("medium").alias("confidence"),
        F.when(ok, text).otherwise(refusal).alias("definition"),
        if_ok(suitable, F.array().cast("array<string>")).alias("suitable_for"),
        if_ok(unsuitable, text_array(["Any revenue forecasting until more data accumulates"]))
        .alias("not_suitable_for"),
        F.col("span").alias("data_span_days"),
        if_ok(F.col("first").cast("date").cast("string")).alias("first_date"),
        if_ok(F.col("last").cast("date").cast("string")).alias("last_date"),
        F.col("n").alias("total_transactions"),
        if_ok(F.round("total", 2), F.lit(0.0)).alias("total_revenue"),
        if_ok(F.col("days"), F.lit(0)).alias("days_with_data"),
        if_ok(F.round("cover", 2), F.lit(0.0)).alias("coverage_pct"),
        if_ok(per_day("n"), F.lit(0.0)).alias("avg_transactions_per_day"),
        if_ok(per_day("total"), F.lit(0.0)).alias("avg_revenue_per_day"),
        *[if_ok(F.round(F.col("q")[k], 2)).alias(f"transaction_{p}")
          for k, p in enumerate(("p10", "p50", "p90", "p99"))],
        if_ok(F.round("top", 2)).alias("transaction_max"),
        if_ok(F.round("cov", 4)).alias("coefficient_of_variation"),
        if_ok(F.col("grain")).alias("recommended_aggregation"),
        if_ok(F.col("months")).alias("monthly_periods_available"),
        if_ok(whole(F.col("span") / 7) + 1).alias("weekly_periods_available"),
        if_ok(F.when(F.col("span") >= 365, 0.80).otherwise(0.70)).alias("train_test_split_ratio"),
        if_ok(notes, F.array(F.coalesce("reason", F.lit("")),
                             F.lit("Revenue model NOT recommended for this dataset.")))
        .alias("warnings"),
    )


def growth_profile(monthly: DataFrame, period: str = "month_label",
                   revenue: str = "monthly_revenue", by: tuple[str, ...] = ()) -> DataFrame:
    """How far may this monthly series be forecast?  Input has one row per month."""
    rev = F.coalesce(col(revenue), F.lit(0.0))
    s = monthly.where(col(period).isNotNull()).groupBy(*by).agg(
        F.count("*").cast("int").alias("n"), F.count_if(rev > 0).cast("int").alias("pos"),
        F.min(col(period)).alias("first"), F.max(col(period)).alias("last"),
        F.sum(rev).alias("total"), F.median(rev).alias("mid"),
        F.min(rev).alias("low"), F.max(rev).alias("high"))
    n, zero = F.col("n"), F.col("n") - F.col("pos")
    full, some = n >= FULL_MONTHS, n >= MIN_MONTHS
    test = F.when(full, F.least(F.lit(6), F.greatest(F.lit(4), whole(n / 6)))).otherwise(
        F.least(F.lit(4), F.greatest(F.lit(2), whole(n / 5))))
    s = s.withColumn("test", F.when(some, test).otherwise(0))
    s = s.withColumn("train", F.when(some, n - F.col("test")).otherwise(0))
    s = s.withColumn("h", F.when(full, F.least(F.lit(MAX_HORIZON), F.greatest(
        F.lit(3), whole(F.col("train") / 3)))).when(n >= 18, 6).when(n >= CYCLE_MONTHS, 3)
        .when(some, 2).otherwise(0))
    reason = F.when(n == 0, F.lit("No valid rows after parsing periods.")).otherwise(say(
        "Only {} months of history; need at least {}.", n, MIN_MONTHS))
    a, b = F.date_format("first", "yyyy-MM"), F.date_format("last", "yyyy-MM")
    text = (
        F.when(full, say(
            "This dataset has {} months of history ({} to {}), enough for full forecasting with "
            "year-over-year comparisons. Recommended split: {} months for training, {} for test. "
            "Forecasts up to {} months ahead are defensible; beyond that the model would be "
            "extrapolating.", n, a, b, F.col("train"), F.col("test"), F.col("h")))
        .when(some, say(
            "This dataset has {} months of history — enough for directional forecasting only. "
            "Recommended split: {} months train, {} test. Forecasts up to {} months ahead are "
            "usable for trajectory (up/flat/down), but the specific values should NOT be used as "
            "targets for budgets, hiring, or contracts. Re-train as full-forecasting once {} months "
            "of history are available.", n, F.col("train"), F.col("test"), F.col("h"), FULL_MONTHS))
        .otherwise(say(
            "Growth dataset cannot be modelled: {} The growth model should be skipped for this "
            "dataset and the report should disclose this clearly.", reason)))
    good = (
        F.when(full, F.array(
            say("Forecasting up to {} months ahead", F.col("h")),
            F.lit("Year-over-year growth claims"), F.lit("Seasonal pattern identification"),
            F.lit("Budget and capacity planning conversations")))
        .when(some, F.array(
            say("Trajectory direction (up/flat/down) {} months ahead", F.col("h")),
            F.lit("Internal sanity-check forecasts")))
        .otherwise(F.array().cast("array<string>")))
    bad = (
        F.when(full, F.array(
            say("Forecasts beyond {} months (extrapolation, not prediction)", F.col("h")),
            F.lit("Hiring or contract commitments without human review")))
        .when(some, F.array(
            F.lit("Specific monthly targets quoted to stakeholders"),
            F.lit("Year-over-year growth claims"),
            F.lit("Budget commitments, hiring decisions, supplier contracts"),
            say("Forecasts beyond {} months", F.col("h"))))
        .otherwise(text_array(["Any forward-looking growth claims"])))
    gaps = zero > n * 0.1
    notes = (
        F.when(full, warnings_array((gaps, say(
            "{} of {} months have zero or missing revenue — investigate before trusting the "
            "forecast.", zero, n))))
        .when(some, warnings_array(
            (F.lit(True), say("Only {} months of history — forecasts are directional, not "
                              "committal numbers.", n)),
            (F.lit(True), F.lit("Year-over-year claims are NOT supported (need 24+ months).")),
            (gaps, say("{} of {} months have zero or missing revenue.", zero, n))))
        .otherwise(F.array(reason, F.lit("Growth model NOT recommended for this dataset."))))
    stat = lambda c: F.when(some, F.round(c, 2)).otherwise(0.0)
    return s.select(
        *by,
        F.when(full, "full_forecasting").when(some, "directional_only").otherwise(NO_DATA)
        .alias("strategy"),
        F.when(n >= 36, "high").when(full, "medium").otherwise("low").alias("confidence"),
        text.alias("definition"), good.alias("suitable_for"), bad.alias("not_suitable_for"),
        n.alias("months_of_history"),
        F.when(some, F.col("pos")).otherwise(0).alias("months_with_revenue"),
        F.when(some, zero).otherwise(0).alias("months_zero_or_missing"),
        F.when(some, a).alias("first_period"), F.when(some, b).alias("last_period"),
        stat("total").alias("total_revenue"), stat("mid").alias("median_monthly_revenue"),
        stat("low").alias("min_monthly_revenue"), stat("high").alias("max_monthly_revenue"),
        (n >= CYCLE_MONTHS).alias("has_full_seasonal_cycle"), full.alias("has_yoy_capability"),
        F.col("h").alias("safe_horizon_months"),
        F.col("train").alias("recommended_train_months"),
        F.col("test").alias("recommended_test_months"), notes.alias("warnings"))
