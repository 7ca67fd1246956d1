"""Customer, daily and monthly aggregates of an order table.

All are plain grouped aggregates: Spark combines on the map side first, so one customer or
one day holding a third of the rows costs no more than any other.  Means are sum / count, so
decimal money gives the same digits in any row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import bucket_label, clip, col, days_between, lookup, mean_of, ratio, scalar
from tillwise.functions.vocab import COST_RATIO, SEASONAL_INDEX, SEGMENT_STEPS
from tillwise.sources.staging import Scratch


def valid_rows(df: DataFrame, date: str | None = None, amount: str | None = None,
               keys: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows whose date or amount cannot be read, or whose key is missing."""
    out = df
    if date:
        kind = dict(df.dtypes)[date]
        if kind == "string":
            out = out.withColumn(date, F.try_to_timestamp(col(date)))
        out = out.where(col(date).isNotNull())
    if amount:
        if dict(df.dtypes)[amount] == "string":
            out = out.withColumn(amount, col(amount).try_cast("double"))
        out = out.where(col(amount).isNotNull())
    for k in keys:
        out = out.where(col(k).isNotNull())
    return out


def customer_summary(df: DataFrame, customer: str, date: str, amount: str | None = None,
                     category: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per customer: first, last, orders, spend, categories, tenure and mean gap."""
    aggs = [F.min(col(date)).alias("first_order"), F.max(col(date)).alias("last_order"),
            F.count(col(date)).alias("total_orders")]
    if amount:
        aggs += [F.sum(col(amount)).cast("double").alias("total_spent"),
                 mean_of(amount).alias("avg_order_value")]
    if category:
        aggs.append(F.count_distinct(col(category)).alias("unique_categories"))
    out = valid_rows(df, date, keys=(customer,)).groupBy(
        *[col(b) for b in by], col(customer).alias("customer_id")).agg(*aggs)
    tenure = days_between("first_order", "last_order")
    return out.withColumn("customer_tenure_days", tenure).withColumn(
        "avg_days_between_orders",
        F.when(F.col("total_orders") > 1,
               ratio("customer_tenure_days", F.col("total_orders") - 1)))


def customer_aggregate(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Per customer, from whichever roles the table has; missing roles take neutral values."""
    cid = roles["customer_id"]
    has = lambda r: roles.get(r) in df.columns
    amount, date = roles.get("amount"), roles.get("date")
    aggs = [F.count(F.lit(1)).alias("total_orders")]
    if has("amount"):
        a = col(amount)
        if dict(df.dtypes)[amount] == "string":
            a = a.try_cast("double")
        aggs += [F.sum(a).cast("double").alias("total_spent"), mean_of(a).alias("avg_order_value")]
    if has("date"):
        d = col(date)
        if dict(df.dtypes)[date] == "string":
            d = F.try_to_timestamp(d)
        aggs += [F.min(d).alias("_first"), F.max(d).alias("_last")]
    if has("quantity"):
        aggs.append(F.sum(col(roles["quantity"]).try_cast("double")).alias("total_items"))
    if has("is_returned"):
        aggs.append(mean_of(col(roles["is_returned"]).try_cast("double")).alias("return_rate"))
    if has("rating"):
        aggs.append(mean_of(col(roles["rating"]).try_cast("double")).alias("avg_rating_given"))
    if has("category"):
        aggs.append(F.count_distinct(col(roles["category"])).alias("unique_categories"))
    g = df.where(col(cid).isNotNull()).groupBy(col(cid).alias("customer_id")).agg(*aggs)

    spent = F.col("total_spent") if has("amount") else F.lit(0.0)
    if has("date"):
        tenure = F.greatest(days_between("_first", "_last"), F.lit(1)).cast("long")
        per_day = ratio(spent, tenure)
        gap = ratio(tenure, F.greatest(F.col("total_orders") - 1, F.lit(1)))
    else:
        tenure, per_day, gap = F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select(
        "customer_id", "total_orders",
        zero(spent).alias("total_spent"),
        zero(F.col("avg_order_value") if has("amount") else F.lit(0.0)).alias("avg_order_value"),
        F.coalesce(tenure, F.lit(0)).cast("long").alias("customer_tenure_days"),
        zero(per_day).alias("spend_per_day"),
        zero(gap).alias("avg_days_between_orders"),
        zero((F.col("total_items") if has("quantity") else F.col("total_orders")).cast("double"))
        .alias("total_items"),
        zero(F.col("return_rate") if has("is_returned") else F.lit(0.0)).alias("return_rate"),
        zero(F.col("avg_rating_given") if has("rating") else F.lit(4.0)).alias("avg_rating_given"),
        (F.col("unique_categories") if has("category") else F.lit(1)).cast("long")
        .alias("unique_categories"),
        zero(spent * 2).alias("predicted_clv"),
    )


def customer_features(df: DataFrame, row_id: str = "order_id") -> DataFrame:
    """Customer table measured from a snapshot one day after the last order.

    One aggregate, so a caller that does not use a column does not pay for it.
    """
    snapshot = scalar(df, F.date_add(F.max("order_date"), 1))
    g = df.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count("order_id").alias("total_orders"),
        F.sum("net_revenue").cast("double").alias("total_spent"),
        mean_of("net_revenue").alias("avg_order_value"),
        F.sum("quantity_sold").cast("long").alias("total_items"),
        mean_of("rating").alias("avg_rating_given"),
        F.sum("is_returned").cast("long").alias("return_count"),
        F.count_distinct("product_category").alias("unique_categories"),
        F.min_by("customer_region", F.struct("order_date", row_id)).alias("preferred_region"),
    )
    return (
        g.withColumn("customer_tenure_days", F.date_diff(snapshot, "first_order_date"))
        .withColumn("days_since_last_order", F.date_diff(snapshot, "last_order_date"))
        .withColumn("avg_days_between_orders", F.round(
            ratio("customer_tenure_days", F.greatest("total_orders", F.lit(1))), 1))
        .withColumn("return_rate", F.round(ratio("return_count", "total_orders"), 4))
        .withColumn("spend_per_day", F.round(ratio(
            "total_spent", F.when(F.col("customer_tenure_days") == 0, 1)
            .otherwise(F.col("customer_tenure_days"))), 4))
    )


def churn_rule_label(cust: DataFrame, window_days: int = 90) -> DataFrame:
    """1 when the last order is more than ``window_days`` old."""
    return cust.withColumn(
        "is_churned", (F.col("days_since_last_order") > window_days).cast("int"))


def churn_risk_score(cust: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Weighted mix of recency, frequency, returns, rating and cadence, in 0..1.

    Given the order lines, the greatest order count comes from a plain count of them instead of
    from the whole customer table.
    """
    counts = cust if orders is None else orders.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"))
    most = scalar(counts, F.max("total_orders"))
    score = (
        0.30 * clip(F.col("days_since_last_order") / 180, 0.0, 1.0)
        + 0.25 * (1 - ratio("total_orders", most))
        + 0.20 * F.col("return_rate")
        + 0.15 * (1 - F.col("avg_rating_given") / 5)
        + 0.10 * clip(F.col("avg_days_between_orders") / 60, 0.0, 1.0)
    )
    return cust.withColumn("churn_risk_score", clip(F.round(score, 4), 0.0, 1.0))


def clv_estimate(cust: DataFrame, rate: float = 0.10, years: int = 3) -> DataFrame:
    """Order value x orders per year x years, discounted once."""
    gap = F.when(F.col("avg_days_between_orders") == 0, 365.0).otherwise(
        F.col("avg_days_between_orders"))
    return cust.withColumn("predicted_clv", F.round(
        F.col("avg_order_value") * (365 / gap) * years / (1 + rate), 2))


def customer_segment(cust: DataFrame, orders: str = "total_orders") -> DataFrame:
    return cust.withColumn("customer_segment", bucket_label(orders, SEGMENT_STEPS, "New"))


def full_customer_table(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Features, label, score, value and segment in one lazy plan.

    With ``scratch`` the features are stored there, and the greatest order count is read from them.
    """
    cust = customer_features(df)
    if scratch is not None:
        cust, df = scratch.table(cust, "customers"), None
    return customer_segment(clv_estimate(churn_risk_score(churn_rule_label(cust), df)))


# Order-level columns -----------------------------------------------------------------------

def order_date_features(df: DataFrame, date: str = "order_date") -> DataFrame:
    d = col(date)
    wd = F.weekday(d)
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d), "day_of_week": wd,
        "is_weekend": (wd >= 5).cast("int"),
        "seasonal_index": lookup(F.month(d), SEASONAL_INDEX),
    })


def cost_ratio_lookup(df: DataFrame, table: dict | None = None,
                      category: str = "product_category") -> DataFrame:
    """Cost share of price by category; unknown categories give NULL."""
    return df.withColumn("cogs_ratio", lookup(category, table or COST_RATIO))


def margin_features(df: DataFrame) -> DataFrame:
    """Cost, profit and margin from price, cost ratio, quantity and revenue.

    Decimal prices stay decimal, so cents are exact.
    """
    cost = F.round(F.col("price") * F.col("cogs_ratio") * F.col("quantity_sold"), 2)
    out = df.withColumn("cost_of_goods", cost)
    out = out.withColumn("gross_profit", F.round(
        F.col("total_revenue") - F.col("cost_of_goods"), 2))
    return out.withColumn("gross_margin_pct", F.round(ratio("gross_profit", "total_revenue"), 4))


def refund_net_revenue(df: DataFrame, share: str = "0.90") -> DataFrame:
    """Refund 90 % of a returned line; net is what stays."""
    money = F.col("total_revenue")
    refund = F.round(F.col("is_returned") * money * F.lit(share).cast("decimal(3,2)"), 2)
    return df.withColumn("refund_amount", refund).withColumn(
        "net_revenue", F.round(money - F.col("refund_amount"), 2))


# Calendar series ---------------------------------------------------------------------------

def daily_rollup(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per calendar day, also where orders carry a time of day."""
    return df.groupBy(*by, col("order_date").cast("date").alias("order_date")).agg(
        F.sum("net_revenue").alias("daily_revenue"),
        F.count("order_id").alias("daily_orders"),
        F.sum("quantity_sold").cast("long").alias("daily_items"),
    )


def daily_rolling(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lags and rolling means over the daily table (one row per day, never the orders)."""
    w = Window.partitionBy(*by).orderBy("order_date")
    rows = lambda n: w.rowsBetween(1 - n, 0)
    roll = lambda c, n: F.round(
        ratio(F.sum(c).over(rows(n)), F.count(c).over(rows(n))), 2)
    lag = lambda n: F.lag(F.col("daily_revenue").cast("double"), n).over(w)
    return daily.withColumns({
        "revenue_lag_7d": lag(7), "revenue_lag_30d": lag(30),
        "revenue_roll_7d": roll("daily_revenue", 7),
        "revenue_roll_30d": roll("daily_revenue", 30),
        "revenue_roll_90d": roll("daily_revenue", 90),
        "orders_roll_7d": roll("daily_orders", 7),
        "revenue_yoy_growth": F.round(ratio(
            F.col("daily_revenue").cast("double") - lag(365), lag(365)), 4),
    })


DAILY_FEATURES = ["revenue_lag_7d", "revenue_lag_30d", "revenue_roll_7d", "revenue_roll_30d",
                  "revenue_roll_90d", "orders_roll_7d", "revenue_yoy_growth"]


def backfill_lags(daily: DataFrame, columns=("revenue_lag_7d", "revenue_lag_30d",
                                             "revenue_yoy_growth"),
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Next known value in date order, then 0; on the daily table, before any join."""
    w = Window.partitionBy(*by).orderBy("order_date").rowsBetween(0, Window.unboundedFollowing)
    return daily.withColumns({
        c: F.coalesce(F.first(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})


def monthly_aggregate(df: DataFrame, date: str, amount: str,
                      by: tuple[str, ...] = ()) -> DataFrame:
    """Per month present: revenue and orders."""
    return valid_rows(df, date, amount).groupBy(
        *by, F.trunc(col(date), "month").alias("month_key")).agg(
        F.sum(col(amount)).cast("double").alias("monthly_revenue"),
        F.count(col(amount)).alias("monthly_orders"))


def monthly_lags(monthly: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row lags, growth and a three-row mean; missing values become 0."""
    w = Window.partitionBy(*by).orderBy("month_key")
    rev, three = F.col("monthly_revenue"), w.rowsBetween(-2, 0)
    lag = lambda n: F.lag("monthly_revenue", n).over(w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return monthly.select(
        *by, "month_key", "monthly_revenue", "monthly_orders",
        zero(lag(1)).alias("lag_1_rev"), zero(lag(2)).alias("lag_2_rev"),
        zero(lag(12)).alias("lag_12_rev"),
        zero(ratio(rev - lag(1), lag(1))).alias("mom_growth"),
        zero(ratio(rev - lag(12), lag(12))).alias("yoy_growth"),
        zero(F.when(F.count(rev).over(three) == 3, F.avg(rev).over(three)))
        .alias("3m_rolling_avg"),
        F.month("month_key").alias("month_num"), F.quarter("month_key").alias("quarter_num"),
    )


def monthly_growth_table(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (year, month): revenue, orders, distinct customers, mean order value."""
    return df.groupBy(*by, F.year("order_date").alias("year"),
                      F.month("order_date").alias("month")).agg(
        F.sum("net_revenue").cast("double").alias("monthly_revenue"),
        F.count("order_id").alias("monthly_orders"),
        F.count_distinct("customer_id").alias("new_customers"),
        mean_of("net_revenue").alias("avg_order_value"),
    ).withColumn("month_label", F.make_date("year", "month", F.lit(1)))


def monthly_growth_features(monthly: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Month and year growth, three-month mean and its projection."""
    w = Window.partitionBy(*by).orderBy("month_label")
    rev = F.col("monthly_revenue")
    change = lambda n: F.round(
        ratio(rev, F.lag(rev, n).over(w)) - 1, 4)
    out = monthly.withColumn("mom_growth", change(1)).withColumn("yoy_growth", change(12))
    out = out.withColumn("revenue_3m_avg", F.round(F.avg(rev).over(w.rowsBetween(-2, 0)), 2))
    return out.withColumn("revenue_3m_forecast", F.round(
        F.col("revenue_3m_avg") * (1 + F.coalesce("mom_growth", F.lit(0.0))), 2))


def trainer_monthly_lags(monthly: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lags filled with the series mean, calendar numbers and seasonal terms."""
    w = Window.partitionBy(*by).orderBy("month_label")
    mean = F.avg("monthly_revenue").over(Window.partitionBy(*by))
    out = monthly
    for n in (1, 2, 3, 12):
        out = out.withColumn(f"lag_{n}_rev", F.coalesce(F.lag("monthly_revenue", n).over(w), mean))
    m = F.month("month_label")
    return out.withColumns({"month_num": m, "year_num": F.year("month_label"),
                            "sin_m": F.sin(2 * F.pi() * m / 12),
                            "cos_m": F.cos(2 * F.pi() * m / 12)})


def period_start(date, grain: str):
    """Day, week (ending on and labelled by its Monday) or first of month."""
    d = col(date).cast("date")
    if grain == "daily":
        return d
    if grain == "weekly":
        return F.next_day(F.date_sub(d, 1), "MO")
    if grain == "monthly":
        return F.trunc(d, "month")
    raise ValueError("grain must be daily, weekly or monthly")


def resample_series(df: DataFrame, date: str, amount: str, grain: str = "monthly") -> DataFrame:
    """Revenue, count and mean per period; empty periods do not appear."""
    return valid_rows(df, date, amount).groupBy(period_start(date, grain).alias("period")).agg(
        F.sum(col(amount)).cast("double").alias("revenue"),
        F.count(col(amount)).alias("transactions"),
        mean_of(amount).alias("avg_transaction_value"))


def transactions_to_monthly(df: DataFrame, date: str, amount: str,
                            by: tuple[str, ...] = ()) -> DataFrame:
    """Month-start sums with empty months kept as 0."""
    sums = valid_rows(df, date, amount).groupBy(
        *by, F.trunc(col(date), "month").alias("month_label")).agg(
        F.sum(col(amount)).cast("double").alias("monthly_revenue"))
    span = sums.groupBy(*by).agg(F.min("month_label").alias("a"), F.max("month_label").alias("b"))
    months = span.where(F.col("a").isNotNull()).select(
        *by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month_label"))
    return months.join(sums, [*by, "month_label"], "left").select(
        *by, "month_label", F.coalesce("monthly_revenue", F.lit(0.0)).alias("monthly_revenue"))


# Joins back --------------------------------------------------------------------------------

CUSTOMER_JOIN = ["customer_tenure_days", "days_since_last_order", "total_orders",
                 "avg_order_value", "return_rate", "customer_segment", "predicted_clv",
                 "churn_risk_score", "is_churned"]


def join_customer_features(orders: DataFrame, cust: DataFrame) -> DataFrame:
    """Nine customer features back onto every order (left join; skew handled by AQE)."""
    return orders.join(cust.select("customer_id", *CUSTOMER_JOIN), "customer_id", "left")


def join_daily_features(orders: DataFrame, daily: DataFrame) -> DataFrame:
    """Seven daily features by order date.

    The daily side is cut to one row per calendar day, a proven bound, so it is broadcast.
    """
    days = daily.groupBy(col("order_date").cast("date").alias("_day")).agg(
        *[F.any_value(c).alias(c) for c in DAILY_FEATURES])
    return orders.join(F.broadcast(days), col("order_date").cast("date") == F.col("_day"),
                       "left").drop("_day")


REVENUE_TASK = ["order_date", "year", "month", "quarter", "week_of_year", "day_of_week",
                "is_weekend", "seasonal_index", "product_id", "product_category",
                "customer_region", "price", "discount_percent", "quantity_sold",
                "discounted_price", "total_revenue", "net_revenue", "cost_of_goods",
                "gross_profit", "gross_margin_pct", "is_returned", "refund_amount",
                "payment_method", "rating", "review_count"]
CHURN_TASK = ["customer_id", "preferred_region", "customer_tenure_days", "total_orders",
              "total_spent", "avg_order_value", "avg_days_between_orders",
              "days_since_last_order", "return_rate", "total_items", "avg_rating_given",
              "unique_categories", "spend_per_day", "churn_risk_score", "customer_segment",
              "predicted_clv", "is_churned"]
GROWTH_TASK = ["year", "month", "monthly_revenue", "monthly_orders", "new_customers",
               "avg_order_value", "month_label", "mom_growth", "yoy_growth",
               "revenue_3m_avg", "revenue_3m_forecast"]


def task_datasets(sales: DataFrame, cost_table: dict | None = None, scratch: Scratch | None = None
                  ) -> dict[str, DataFrame]:
    """The three training tables: revenue, churn and growth.

    Each scans the lines, some more than once.  With ``scratch`` the lines are stored there first, so
    the joins and money columns behind them are computed once and a scan reads the columns it needs.
    """
    if scratch is not None:
        sales = scratch.table(sales, "lines")
    lines = margin_features(cost_ratio_lookup(order_date_features(sales), cost_table))
    daily = daily_rolling(daily_rollup(sales))
    return {
        "revenue": join_daily_features(lines.select(*REVENUE_TASK), daily),
        "churn": full_customer_table(sales, scratch).select(*CHURN_TASK),
        "growth": monthly_growth_features(monthly_growth_table(sales)).select(*GROWTH_TASK),
    }


def behaviour_segments(cust: DataFrame) -> DataFrame:
    """Four behaviour splits of a customer table: frequency, cadence, value and breadth."""
    from tillwise.functions.quantiles import quantiles

    q = quantiles(cust, ["avg_days_between_orders", "predicted_clv"], [0.5, 0.75])
    mid = q.select(F.col("avg_days_between_orders")[0]).scalar()
    top = q.select(F.col("predicted_clv")[1]).scalar()
    return cust.withColumns({
        "frequency_group": F.when(F.col("total_orders") >= 3, "frequent")
        .when(F.col("total_orders") == 1, "single").otherwise("occasional"),
        "cadence_group": F.when(F.col("avg_days_between_orders") < mid, "engaged")
        .when(F.col("avg_days_between_orders") > mid, "at_risk").otherwise("middle"),
        "value_group": F.when(F.col("predicted_clv") >= top, "high_clv").otherwise("average_clv"),
        "breadth_group": F.when(F.col("unique_categories") <= 1, "focused")
        .when(F.col("unique_categories") >= 3, "diverse").otherwise("mixed"),
    })
