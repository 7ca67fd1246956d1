"""Churn labels whose rule adapts to the length of history.

540 days or more: forward holdout.  180 to 539: each customer's own cadence.  Less: no labels.
The strategy is a column, so one job labels any number of datasets (``by`` keys), each under
the rule its own history allows.

The message texts are fixed values that reports are compared by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, days_between, mean_of, one_row, ratio, warnings_array
from tillwise.functions.quantiles import median
from tillwise.operators.aggregates import valid_rows
from tillwise.operators.profiles import NO_DATA, fixed, say, whole

# Labelling limits (fixed values)
FORWARD_DAYS, ADAPTIVE_DAYS, MIN_COHORT = 540, 180, 50
CADENCE_FACTOR, CADENCE_CAP, BAND = 3, 365, (2, 60)

FORWARD, ADAPTIVE = "forward_holdout", "adaptive_threshold"


def churn_customers(df: DataFrame, customer: str, date: str, amount: str | None = None,
                    category: str | None = None, by: tuple[str, ...] = (),
                    strategy: str | None = None, as_of_cutoff: bool = False) -> DataFrame:
    """Every customer with features, strategy, eligibility and label (NULL when not eligible).

    ``as_of_cutoff`` measures the features on rows up to the holdout cutoff only, so they do not
    see the window the label comes from.
    """
    rows = valid_rows(df, date, keys=(customer,))
    rows = rows.select(
        *by, col(customer).alias("customer_id"), col(date).cast("timestamp_ntz").alias("_d"),
        *([col(amount).alias("_a")] if amount else []),
        *([col(category).alias("_c")] if category else []))
    span = rows.groupBy(*by).agg(F.min("_d").alias("_min"), F.max("_d").alias("_max"))
    span = span.withColumn("_span", F.coalesce(days_between("_min", "_max"), F.lit(0)).cast("int"))
    span = span.withColumn("_hold", F.least(F.lit(180), F.greatest(
        F.lit(90), whole(F.col("_span") / 6))))
    auto = F.when(F.col("_span") >= FORWARD_DAYS, FORWARD).when(
        F.col("_span") >= ADAPTIVE_DAYS, ADAPTIVE).otherwise(NO_DATA)
    span = span.withColumn("strategy", F.lit(strategy) if strategy else auto)
    back = F.make_dt_interval(days=F.col("_hold"))
    span = span.withColumn("_cut", F.col("_max") - back).withColumn("_new", F.col("_cut") - back)
    if by:
        rows = rows.join(span, list(by))
    else:
        rows = rows.withColumn("_p", one_row(span)).select(
            *[c for c in rows.columns], "_p.*")

    seen = F.when(F.col("_d") <= F.col("_cut"), F.lit(True)) if as_of_cutoff else F.lit(True)
    inside = lambda c: F.when(seen, F.col(c))
    aggs = [F.min("_d").alias("_first"), F.max("_d").alias("_last"), F.count("*").alias("_n"),
            F.min(inside("_d")).alias("first_order"), F.max(inside("_d")).alias("last_order"),
            F.count(inside("_d")).alias("total_orders"),
            F.count_if(F.col("_d") > F.col("_cut")).alias("orders_after")]
    if amount:
        aggs += [F.sum(inside("_a")).cast("double").alias("total_spent"),
                 mean_of(inside("_a")).alias("avg_order_value")]
    if category:
        aggs.append(F.count_distinct(inside("_c")).alias("unique_categories"))
    fixed_cols = ["strategy", "_span", "_hold", "_cut", "_new", "_max"]
    cust = rows.groupBy(*by, "customer_id").agg(
        *aggs, *[F.any_value(c).alias(c) for c in fixed_cols])

    cust = cust.withColumn("customer_tenure_days", days_between("first_order", "last_order"))
    gap = F.when(F.col("total_orders") > 1,
                 ratio("customer_tenure_days", F.col("total_orders") - 1))
    cust = cust.withColumn("avg_days_between_orders", F.when(
        F.col("strategy") == ADAPTIVE, F.when(gap.isNotNull(), F.greatest(gap, F.lit(1.0))))
        .otherwise(gap))
    cust = cust.withColumn("days_since_last_order", days_between("_last", "_max"))
    cust = cust.withColumn("personal_threshold", F.when(
        F.col("strategy") == ADAPTIVE,
        F.when(F.col("avg_days_between_orders").isNotNull(), F.least(
            F.col("avg_days_between_orders") * CADENCE_FACTOR, F.lit(float(CADENCE_CAP))))))
    one_time = F.col("_n") == 1
    recent = F.col("_first") > F.col("_new")
    in_reach = F.col("personal_threshold") <= days_between("_first", "_max")
    eligible = F.when(F.col("strategy") == FORWARD, ~one_time & ~recent).when(
        F.col("strategy") == ADAPTIVE, ~one_time & in_reach).otherwise(F.lit(False))
    cust = cust.withColumn("one_time", one_time).withColumn(
        "eligible", F.coalesce(eligible, F.lit(False)))
    cust = cust.withColumn("too_new", F.when(F.col("strategy") == FORWARD, recent & ~one_time)
                           .when(F.col("strategy") == ADAPTIVE, ~one_time & ~F.col("eligible"))
                           .otherwise(F.lit(False)))
    label = F.when(F.col("strategy") == FORWARD, F.col("orders_after") == 0).otherwise(
        F.col("days_since_last_order") > F.col("personal_threshold"))
    return cust.withColumn("is_churned", F.when(F.col("eligible"), label.cast("int")))


def churn_labels(customers: DataFrame) -> DataFrame:
    """The labelled cohort."""
    return customers.where("eligible").drop(
        "_first", "_last", "_n", "_span", "_hold", "_cut", "_new", "_max", "one_time", "eligible",
        "too_new")


def churn_report(customers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, rate, the exact definition used and plausibility warnings, per dataset."""
    s = customers.groupBy(*by).agg(
        F.any_value("strategy").alias("strategy"), F.any_value("_span").alias("span"),
        F.any_value("_hold").alias("hold"),
        F.date_format(F.any_value("_cut"), "yyyy-MM-dd").alias("cut"),
        F.date_format(F.any_value("_max"), "yyyy-MM-dd").alias("last"),
        F.count("*").alias("total"), F.count_if("one_time").alias("once"),
        F.count_if("too_new").alias("fresh"), F.count_if("eligible").alias("cohort"),
        F.count_if(F.col("is_churned") == 1).alias("churned"))
    mid = median(customers.where(~F.col("one_time")), ["avg_days_between_orders"], by)
    if by:
        s = s.join(mid.withColumnRenamed("avg_days_between_orders", "mid"), list(by), "left")
    else:
        s = s.withColumn("mid", mid.scalar())
    s = s.withColumn("rate", F.coalesce(ratio("churned", "cohort") * 100, F.lit(0.0)))
    fwd, ada = F.col("strategy") == FORWARD, F.col("strategy") == ADAPTIVE
    text = (
        F.when(fwd, say(
            "A customer is labelled 'churned' if they had at least one order before {} and made no "
            "orders during the {}-day observation window from {} to {}. One-time buyers and "
            "customers acquired too recently to observe a full holdout window are excluded from "
            "the trained population.", F.col("cut"), F.col("hold"), F.col("cut"), F.col("last")))
        .when(ada, say(
            "A customer with multiple orders is labelled 'churned' if their days-since-last-order "
            "exceeds {}× their personal average inter-purchase interval, capped at {} days. The "
            "median interval across all repeat customers in this dataset is {} days. One-time "
            "buyers and customers whose threshold exceeds the observable history are excluded.",
            CADENCE_FACTOR, CADENCE_CAP, fixed(F.coalesce("mid", F.lit(0.0)), 0)))
        .otherwise(say(
            "Dataset spans only {} days. A defensible churn label requires at least {} days of "
            "transactional history. No labels were produced; the churn model should be skipped for "
            "this dataset and the report should disclose this clearly.", F.col("span"),
            ADAPTIVE_DAYS)))
    return s.select(
        *by, "strategy",
        F.when(fwd, "high").when(ada, "medium").otherwise("low").alias("confidence"),
        text.alias("definition"), F.col("span").alias("data_span_days"),
        F.col("total").alias("total_customers"), F.col("once").alias("one_time_buyers"),
        (F.col("total") - F.col("once")).alias("repeat_customers"),
        F.col("fresh").alias("new_customers"), F.col("cohort").alias("eligible_customers"),
        F.col("churned").alias("churned_customers"), F.round("rate", 2).alias("churn_rate_pct"),
        F.when(fwd, F.col("cut")).alias("cutoff_date"),
        F.when(fwd, F.col("hold")).alias("holdout_window_days"),
        F.when(ada, F.round(F.coalesce("mid", F.lit(0.0)), 1)).alias("median_ipi_days"),
        F.when(ada, F.lit(CADENCE_FACTOR)).alias("threshold_multiplier"),
        F.when(ada, F.lit(CADENCE_CAP)).alias("threshold_max_days"),
        churn_warnings(F.col("strategy"), F.col("span"), F.col("cohort"), F.col("rate"))
        .alias("warnings"))


def churn_warnings(strategy, span, cohort, rate):
    """Plausibility notes: small cohort, rate outside the usual band, weak strategy."""
    none, ada = strategy == NO_DATA, strategy == ADAPTIVE
    return warnings_array(
        (none, say("Need ≥ {} days of data; got {}.", ADAPTIVE_DAYS, span)),
        (none, F.lit("Churn model NOT trained for this dataset.")),
        (~none & (cohort < MIN_COHORT), say(
            "Eligible cohort is {} — below the {}-customer minimum for a stable model. Treat "
            "outputs as exploratory.", cohort, MIN_COHORT)),
        (~none & ((rate < BAND[0]) | (rate > BAND[1])), say(
            "Churn rate of {}% is outside the typical {}–{}% band. Investigate the data before "
            "acting on results.", fixed(rate, 1), *BAND)),
        (ada, F.lit("Adaptive threshold is a heuristic. Re-train with forward-holdout as soon as "
                    "18+ months of data are available.")))
