"""Dashboard numbers: KPIs, revenue trend, top categories, currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import any_word_pattern, col, mean_of
from tillwise.functions.vocab import CURRENCY_CODES, TABLE_REGIONS, TEXT_REGIONS
from tillwise.operators.aggregates import valid_rows

DEFAULT_CURRENCY = "EGP"


def dashboard_kpis(df: DataFrame, revenue: str | None, customer: str | None,
                   order: str | None = None) -> DataFrame:
    """Distinct customers and orders, mean and total revenue; a missing column gives 0."""
    money = col(revenue).try_cast("double") if revenue and dict(df.dtypes)[revenue] == "string" \
        else (col(revenue) if revenue else None)
    zero = F.lit(0.0)
    return df.agg(
        (F.count_distinct(col(customer)) if customer else F.lit(0)).cast("long")
        .alias("total_customers"),
        (F.count_distinct(col(order)) if order else F.count(F.lit(1))).cast("long")
        .alias("total_orders"),
        (F.round(F.coalesce(mean_of(money), zero), 2) if revenue else zero)
        .alias("avg_order_value"),
        (F.round(F.coalesce(F.sum(money).cast("double"), zero), 2) if revenue else zero)
        .alias("total_revenue"))


def revenue_trend(df: DataFrame, revenue: str, date: str, periods: int = 12) -> DataFrame:
    """Revenue of the last ``periods`` months that have any."""
    return valid_rows(df, date, revenue).groupBy(
        F.date_format(col(date), "yyyy-MM").alias("period")).agg(
        F.round(F.sum(col(revenue)).cast("double"), 2).alias("revenue")
    ).orderBy(F.desc("period")).limit(periods).orderBy("period")


def top_categories(df: DataFrame, category: str, revenue: str | None = None,
                   n: int = 5) -> DataFrame:
    """Top categories by revenue, or by rows when there is no revenue column."""
    if revenue:
        value = F.round(F.sum(col(revenue)).cast("double"), 2)
        df = valid_rows(df, amount=revenue)
    else:
        value = F.count(F.lit(1)).cast("double")
    return df.where(col(category).isNotNull()).groupBy(
        col(category).cast("string").alias("category")).agg(value.alias("revenue")).orderBy(
        F.desc("revenue"), "category").limit(n)


def currency_from_table(df: DataFrame) -> DataFrame:
    """Currency of a table from a currency column, else place names, else the default."""
    codes = [c for c in df.columns if "currency" in c.lower()]
    places = [c for c in df.columns
              if any(k in c.lower() for k in ("region", "city", "country", "shipping"))]
    aggs = [F.min(F.upper(col(c).cast("string"))).alias(f"code{k}") for k, c in enumerate(codes)]
    for k, c in enumerate(places):
        for r, (_, words) in enumerate(TABLE_REGIONS):
            aggs.append(F.bool_or(F.lower(col(c).cast("string")).rlike(any_word_pattern(words)))
                        .alias(f"place{k}_{r}"))
    if not aggs:
        return df.agg(F.lit(DEFAULT_CURRENCY).alias("currency"))
    picks = [F.when(F.length(f"code{k}") == 3, F.col(f"code{k}")) for k in range(len(codes))]
    picks += [F.when(F.col(f"place{k}_{r}"), F.lit(cur)) for k in range(len(places))
              for r, (cur, _) in enumerate(TABLE_REGIONS)]
    return df.agg(*aggs).select(F.coalesce(*picks, F.lit(DEFAULT_CURRENCY)).alias("currency"))


def currency_from_text(text) -> Column:
    """Currency a text speaks of: a code token, else place names."""
    t = F.lower(col(text))
    out = None
    for code in CURRENCY_CODES:
        hit = t.rlike(f"( {code}[ .,])|(^{code} )|( {code}$)")
        out = F.when(hit, code.upper()) if out is None else out.when(hit, code.upper())
    for cur, words in TEXT_REGIONS:
        out = out.when(t.rlike(any_word_pattern(words)), cur)
    return out.otherwise("the local currency")
