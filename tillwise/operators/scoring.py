"""Columns on scored rows: risk level, recency adjustment, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import bucket_label, col, mean_of
from tillwise.functions.vocab import RISK_STEPS


def risk_level(p) -> Column:
    return bucket_label(p, RISK_STEPS, "low")


def recency_adjust(p, gap="avg_days_between_orders", tenure="customer_tenure_days") -> Column:
    """Probability of leaving in the next 90 days, by how tenure compares with cadence."""
    base, g, t = col(p), F.coalesce(col(gap), F.lit(0.0)), F.coalesce(col(tenure), F.lit(0))
    health = F.least(F.try_divide(t.cast("double"), g * 3), F.lit(2.0))
    return F.when((g <= 0) | (t <= 0), base).when(health > 1.0, base * 0.85).when(
        health < 0.5, F.least(base * 1.15, F.lit(0.999))).otherwise(base)


def score_churn_rows(df: DataFrame, probability: str) -> DataFrame:
    """Adjusted probability and risk level of every customer."""
    adj = recency_adjust(probability)
    return df.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.round(adj, 4).alias("churn_probability"),
        F.round(col(probability), 4).alias("base_probability"),
        risk_level(adj).alias("risk_level"), F.lit(90).alias("horizon_days"))


def risk_counts(scored: DataFrame) -> DataFrame:
    """Customers per risk level; levels without customers count 0."""
    levels = ("high", "medium", "low")
    counts = scored.agg(*[F.count_if(F.col("risk_level") == v).alias(v) for v in levels])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(v).alias("risk_level"), F.col(v).alias("customers")) for v in levels])).alias("r")
    ).select("r.*")


def segment_risk(scored: DataFrame, segment: str = "customer_segment",
                 probability: str = "churn_prob") -> DataFrame:
    return scored.groupBy(col(segment).alias("customer_segment")).agg(
        mean_of(probability).alias("churn_prob")).orderBy(F.desc("churn_prob"))


def monthly_predicted_revenue(scored: DataFrame, date: str,
                              prediction: str = "prediction") -> DataFrame:
    """Predicted revenue per month; a failed prediction (NULL) counts as 0 and is reported."""
    p = F.coalesce(col(prediction), F.lit(0).cast(dict(scored.dtypes)[prediction]))
    return scored.where(col(date).isNotNull()).groupBy(
        F.date_format(col(date), "yyyy-MM").alias("month")).agg(
        F.round(F.sum(p).cast("double"), 2).alias("predicted_revenue"),
        F.count(F.lit(1)).alias("n_rows"), F.count_if(col(prediction).isNull()).alias("errors"))


def prediction_totals(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    p = F.coalesce(col(prediction), F.lit(0).cast(dict(scored.dtypes)[prediction]))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(col(prediction).isNull()).alias("errors"),
        F.round(F.coalesce(F.sum(p).cast("double"), F.lit(0.0)), 2).alias("total_predicted"),
        F.round(F.coalesce(mean_of(p), F.lit(0.0)), 2).alias("avg_row_predicted"))
