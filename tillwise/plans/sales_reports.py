"""Registered queries: aggregates, calendar series and customer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.operators import aggregates as A
from tillwise.plans.inputs import rounded, with_views
from tillwise.plans.registry import query

ROLES = {"customer_id": "customer_id", "date": "order_date", "amount": "total_revenue",
         "quantity": "quantity_sold", "category": "product_category",
         "is_returned": "is_returned", "rating": "rating"}

MONTHLY = """
WITH m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_key,
                  CAST(SUM(amount) AS DOUBLE) AS monthly_revenue,
                  COUNT(amount) AS monthly_orders FROM tx GROUP BY 1)
"""


@query("customer_summary", with_views("""
SELECT customer_id, MIN(order_date) AS first_order, MAX(order_date) AS last_order,
       COUNT(*) AS total_orders, CAST(SUM(amount) AS DOUBLE) AS total_spent,
       CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_order_value,
       COUNT(DISTINCT category) AS unique_categories,
       date_diff('day', MIN(order_date), MAX(order_date)) AS customer_tenure_days,
       CASE WHEN COUNT(*) > 1 THEN CAST(date_diff('day', MIN(order_date), MAX(order_date)) AS DOUBLE)
            / (COUNT(*) - 1) END AS avg_days_between_orders
FROM tx GROUP BY customer_id"""))
def _(i):
    return A.customer_summary(i.view("tx"), "customer_id", "order_date", "amount", "category")


CUSTOMER_AGG_SQL = """
SELECT customer_id, total_orders, total_spent, total_spent / total_orders AS avg_order_value,
       tenure AS customer_tenure_days, total_spent / tenure AS spend_per_day,
       CAST(tenure AS DOUBLE) / GREATEST(total_orders - 1, 1) AS avg_days_between_orders,
       total_items, return_rate, avg_rating_given, unique_categories,
       total_spent * 2 AS predicted_clv
FROM (SELECT customer_id, COUNT(*) AS total_orders,
             CAST(SUM(total_revenue) AS DOUBLE) AS total_spent,
             GREATEST(date_diff('day', MIN(order_date), MAX(order_date)), 1) AS tenure,
             CAST(SUM(quantity_sold) AS DOUBLE) AS total_items,
             CAST(SUM(is_returned) AS DOUBLE) / COUNT(*) AS return_rate,
             CAST(SUM(rating) AS DOUBLE) / COUNT(*) AS avg_rating_given,
             COUNT(DISTINCT product_category) AS unique_categories
      FROM sales GROUP BY customer_id)"""


@query("customer_aggregate", with_views(CUSTOMER_AGG_SQL))
def _(i):
    return A.customer_aggregate(i.view("sales"), ROLES)


@query("align_group_columns", with_views("""
SELECT customer_id, COUNT(*) AS total_orders, 0.0 AS total_spent, 0.0 AS avg_order_value,
       CAST(0 AS BIGINT) AS customer_tenure_days, 0.0 AS spend_per_day,
       0.0 AS avg_days_between_orders, CAST(COUNT(*) AS DOUBLE) AS total_items,
       CAST(SUM(is_returned) AS DOUBLE) / COUNT(*) AS return_rate,
       4.0 AS avg_rating_given, CAST(1 AS BIGINT) AS unique_categories, 0.0 AS predicted_clv
FROM sales GROUP BY customer_id"""), DOUBLE="total_spent avg_order_value spend_per_day avg_days_between_orders avg_rating_given predicted_clv")
def _(i):
    return A.customer_aggregate(i.view("sales"), {"customer_id": "customer_id",
                                                  "is_returned": "is_returned"})


FEATURES_SQL = f"""
f AS (
  SELECT g.*, date_diff('day', first_order_date, snap) AS customer_tenure_days,
         date_diff('day', last_order_date, snap) AS days_since_last_order,
         {rounded("CAST(date_diff('day', first_order_date, snap) AS DOUBLE) / GREATEST(total_orders, 1)", 1)}
           AS avg_days_between_orders,
         {rounded("CAST(return_count AS DOUBLE) / total_orders", 4)} AS return_rate,
         {rounded("total_spent / date_diff('day', first_order_date, snap)", 4)} AS spend_per_day
  FROM (SELECT customer_id, MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
               COUNT(order_id) AS total_orders, CAST(SUM(net_revenue) AS DOUBLE) AS total_spent,
               CAST(SUM(net_revenue) AS DOUBLE) / COUNT(*) AS avg_order_value,
               CAST(SUM(quantity_sold) AS BIGINT) AS total_items,
               CAST(SUM(rating) AS DOUBLE) / COUNT(*) AS avg_rating_given,
               CAST(SUM(is_returned) AS BIGINT) AS return_count,
               COUNT(DISTINCT product_category) AS unique_categories,
               arg_min(customer_region, order_date) AS preferred_region
        FROM sales GROUP BY customer_id) g
  CROSS JOIN (SELECT MAX(order_date) + 1 AS snap FROM sales) p
)"""


@query("customer_features_full", with_views(f"WITH {FEATURES_SQL.strip()} SELECT * FROM f"), INT="customer_tenure_days days_since_last_order")
def _(i):
    return A.customer_features(i.view("sales"))


@query("churn_rule_label", with_views(f"""WITH {FEATURES_SQL.strip()}
SELECT customer_id, days_since_last_order,
       CASE WHEN days_since_last_order > 90 THEN 1 ELSE 0 END AS is_churned FROM f"""), INT="days_since_last_order")
def _(i):
    return A.churn_rule_label(A.customer_features(i.view("sales"))).select(
        "customer_id", "days_since_last_order", "is_churned")


@query("churn_risk_score", with_views(f"""WITH {FEATURES_SQL.strip()}
SELECT customer_id, LEAST(GREATEST(ROUND(
    0.30 * LEAST(GREATEST(days_since_last_order / 180.0::DOUBLE, 0.0), 1.0)
  + 0.25 * (1 - total_orders::DOUBLE / (SELECT MAX(total_orders) FROM f))
  + 0.20 * return_rate + 0.15 * (1 - avg_rating_given / 5.0::DOUBLE)
  + 0.10 * LEAST(GREATEST(avg_days_between_orders / 60.0::DOUBLE, 0.0), 1.0), 4), 0.0), 1.0)
  AS churn_risk_score FROM f"""))
def _(i):
    sales = i.view("sales")
    return A.churn_risk_score(A.customer_features(sales), sales).select(
        "customer_id", "churn_risk_score")


@query("clv_estimate", with_views(f"""WITH {FEATURES_SQL.strip()}
SELECT customer_id, ROUND(avg_order_value * (365 / CASE WHEN avg_days_between_orders = 0
       THEN 365.0 ELSE avg_days_between_orders END) * 3 / (1 + 0.1::DOUBLE), 2) AS predicted_clv
FROM f"""))
def _(i):
    return A.clv_estimate(A.customer_features(i.view("sales"))).select(
        "customer_id", "predicted_clv")


SEGMENT_SQL = """CASE WHEN total_orders >= 15 THEN 'VIP' WHEN total_orders >= 8 THEN 'Loyal'
            WHEN total_orders >= 3 THEN 'Regular' ELSE 'New' END"""


@query("customer_segment", with_views(f"""
SELECT customer_segment, COUNT(*) AS customers, CAST(SUM(total_orders) AS BIGINT) AS orders
FROM (SELECT customer_id, COUNT(*) AS total_orders, {SEGMENT_SQL} AS customer_segment
      FROM tx GROUP BY customer_id) GROUP BY 1"""))
def _(i):
    per = A.customer_summary(i.view("tx"), "customer_id", "order_date")
    return A.customer_segment(per).groupBy("customer_segment").agg(
        F.count("*").alias("customers"), F.sum("total_orders").alias("orders"))


@query("behaviour_segments", with_views(f"""
WITH c AS ({CUSTOMER_AGG_SQL.strip()}),
q AS (SELECT quantile_cont(avg_days_between_orders, 0.5) AS mid,
             quantile_cont(predicted_clv, 0.75) AS top FROM c)
SELECT customer_id,
  CASE WHEN total_orders >= 3 THEN 'frequent' WHEN total_orders = 1 THEN 'single'
       ELSE 'occasional' END AS frequency_group,
  CASE WHEN avg_days_between_orders < mid THEN 'engaged'
       WHEN avg_days_between_orders > mid THEN 'at_risk' ELSE 'middle' END AS cadence_group,
  CASE WHEN predicted_clv >= top THEN 'high_clv' ELSE 'average_clv' END AS value_group,
  CASE WHEN unique_categories <= 1 THEN 'focused' WHEN unique_categories >= 3 THEN 'diverse'
       ELSE 'mixed' END AS breadth_group
FROM c, q"""))
def _(i):
    return A.behaviour_segments(A.customer_aggregate(i.view("sales"), ROLES)).select(
        "customer_id", "frequency_group", "cadence_group", "value_group", "breadth_group")


# Order-level -------------------------------------------------------------------------------

SEASON_SQL = """CASE month(order_date) WHEN 1 THEN 0.75 WHEN 2 THEN 0.78 WHEN 3 THEN 0.85
 WHEN 4 THEN 0.90 WHEN 5 THEN 0.92 WHEN 6 THEN 0.88 WHEN 7 THEN 0.87 WHEN 8 THEN 0.91
 WHEN 9 THEN 0.95 WHEN 10 THEN 1.00 WHEN 11 THEN 1.25 ELSE 1.30 END::DOUBLE"""
COST_SQL = """CASE product_category WHEN 'Electronics' THEN 0.65 WHEN 'Fashion' THEN 0.45
 WHEN 'Books' THEN 0.35 WHEN 'Sports' THEN 0.50 WHEN 'Beauty' THEN 0.40
 WHEN 'Home & Kitchen' THEN 0.55 END::DECIMAL(3,2)"""


@query("order_date_features", with_views(f"""
SELECT order_id, year(order_date) AS year, month(order_date) AS month,
       quarter(order_date) AS quarter, weekofyear(order_date) AS week_of_year,
       isodow(order_date) - 1 AS day_of_week,
       CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       {SEASON_SQL} AS seasonal_index FROM tx"""), INT="year month quarter week_of_year day_of_week")
def _(i):
    return A.order_date_features(i.view("tx")).select(
        "order_id", "year", "month", "quarter", "week_of_year", "day_of_week", "is_weekend",
        "seasonal_index")


@query("category_lookup_map", with_views(f"""
SELECT product_category, month(order_date) AS month, CAST({COST_SQL} AS DOUBLE) AS cogs_ratio,
       {SEASON_SQL} AS seasonal_index, COUNT(*) AS order_lines FROM sales GROUP BY ALL"""), INT="month")
def _(i):
    df = A.order_date_features(A.cost_ratio_lookup(i.view("sales"))).withColumn(
        "cogs_ratio", F.col("cogs_ratio").cast("double"))
    return df.groupBy("product_category", "month", "cogs_ratio", "seasonal_index").agg(
        F.count("*").alias("order_lines"))


@query("margin_features", with_views(f"""
SELECT order_id, product_id, quantity_sold, CAST(cost_of_goods AS DOUBLE) AS cost_of_goods,
       CAST(total_revenue - cost_of_goods AS DOUBLE) AS gross_profit,
       {rounded("CAST(total_revenue - cost_of_goods AS DOUBLE) / NULLIF(CAST(total_revenue AS DOUBLE), 0)", 4)}
         AS gross_margin_pct
FROM (SELECT *, ROUND(price * {COST_SQL} * quantity_sold, 2) AS cost_of_goods FROM sales)"""))
def _(i):
    return A.margin_features(A.cost_ratio_lookup(i.view("sales"))).select(
        "order_id", "product_id", "quantity_sold", F.col("cost_of_goods").cast("double"),
        F.col("gross_profit").cast("double"), "gross_margin_pct")


@query("refund_net_revenue", with_views("""
SELECT customer_region, is_returned, COUNT(*) AS order_lines,
       CAST(SUM(refund_amount) AS DOUBLE) AS refund_amount,
       CAST(SUM(net_revenue) AS DOUBLE) AS net_revenue
FROM sales GROUP BY customer_region, is_returned"""))
def _(i):
    df = A.refund_net_revenue(i.view("sales").drop("refund_amount", "net_revenue"))
    return df.groupBy("customer_region", "is_returned").agg(
        F.count("*").alias("order_lines"),
        F.sum("refund_amount").cast("double").alias("refund_amount"),
        F.sum("net_revenue").cast("double").alias("net_revenue"))


def _money(df):
    return df.withColumn("daily_revenue", F.col("daily_revenue").cast("double"))


# Calendar series ---------------------------------------------------------------------------

DAILY_SQL = """
d AS (SELECT order_date, SUM(net_revenue) AS cents, CAST(SUM(net_revenue) AS DOUBLE) AS daily_revenue,
             COUNT(order_id) AS daily_orders, CAST(SUM(quantity_sold) AS BIGINT) AS daily_items
      FROM sales GROUP BY order_date)"""


def _roll(c, n):
    frame = f"OVER (ORDER BY order_date ROWS {n - 1} PRECEDING)"
    return rounded(f"CAST(SUM({c}) {frame} AS DOUBLE) / COUNT({c}) {frame}", 2)


ROLL_SQL = f"""
r AS (SELECT order_date, daily_revenue, daily_orders, daily_items,
        LAG(daily_revenue, 7) OVER w AS revenue_lag_7d,
        LAG(daily_revenue, 30) OVER w AS revenue_lag_30d,
        {_roll("cents", 7)} AS revenue_roll_7d, {_roll("cents", 30)} AS revenue_roll_30d,
        {_roll("cents", 90)} AS revenue_roll_90d, {_roll("daily_orders", 7)} AS orders_roll_7d,
        {rounded("(daily_revenue - LAG(daily_revenue, 365) OVER w) / NULLIF(LAG(daily_revenue, 365) OVER w, 0)", 4)}
          AS revenue_yoy_growth
      FROM d WINDOW w AS (ORDER BY order_date))"""


@query("daily_rollup", with_views(f"WITH {DAILY_SQL.strip()} SELECT * EXCLUDE (cents) FROM d"))
def _(i):
    return _money(A.daily_rollup(i.view("sales")))


@query("daily_rolling", with_views(f"WITH {DAILY_SQL.strip()}, {ROLL_SQL.strip()} SELECT * FROM r"))
def _(i):
    return _money(A.daily_rolling(A.daily_rollup(i.view("sales"))))


@query("backfill_lags", with_views(f"""WITH {DAILY_SQL.strip()}, {ROLL_SQL.strip()}
SELECT order_date,
  COALESCE(FIRST_VALUE(revenue_lag_7d IGNORE NULLS) OVER w, 0) AS revenue_lag_7d,
  COALESCE(FIRST_VALUE(revenue_lag_30d IGNORE NULLS) OVER w, 0) AS revenue_lag_30d,
  COALESCE(FIRST_VALUE(revenue_yoy_growth IGNORE NULLS) OVER w, 0) AS revenue_yoy_growth
FROM r WINDOW w AS (ORDER BY order_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def _(i):
    return A.backfill_lags(A.daily_rolling(A.daily_rollup(i.view("sales")))).select(
        "order_date", "revenue_lag_7d", "revenue_lag_30d", "revenue_yoy_growth")


@query("monthly_aggregate", with_views(MONTHLY + "SELECT * FROM m"))
def _(i):
    return A.monthly_aggregate(i.view("tx"), "order_date", "amount")


@query("monthly_lags", with_views(MONTHLY + """
SELECT month_key, monthly_revenue, monthly_orders,
  COALESCE(LAG(monthly_revenue) OVER w, 0) AS lag_1_rev,
  COALESCE(LAG(monthly_revenue, 2) OVER w, 0) AS lag_2_rev,
  COALESCE(LAG(monthly_revenue, 12) OVER w, 0) AS lag_12_rev,
  COALESCE((monthly_revenue - LAG(monthly_revenue) OVER w)
           / NULLIF(LAG(monthly_revenue) OVER w, 0), 0) AS mom_growth,
  COALESCE((monthly_revenue - LAG(monthly_revenue, 12) OVER w)
           / NULLIF(LAG(monthly_revenue, 12) OVER w, 0), 0) AS yoy_growth,
  ROUND(CASE WHEN ROW_NUMBER() OVER w >= 3 THEN AVG(monthly_revenue)
       OVER (ORDER BY month_key ROWS 2 PRECEDING) ELSE 0 END, 4) AS "3m_rolling_avg",
  month(month_key) AS month_num, quarter(month_key) AS quarter_num
FROM m WINDOW w AS (ORDER BY month_key)"""), INT="month_num quarter_num")
def _(i):
    out = A.monthly_lags(A.monthly_aggregate(i.view("tx"), "order_date", "amount"))
    return out.withColumn("3m_rolling_avg", F.round("3m_rolling_avg", 4))


GROWTH_SQL = """
g AS (SELECT year(order_date) AS year, month(order_date) AS month,
        CAST(SUM(net_revenue) AS DOUBLE) AS monthly_revenue, COUNT(order_id) AS monthly_orders,
        COUNT(DISTINCT customer_id) AS new_customers,
        CAST(SUM(net_revenue) AS DOUBLE) / COUNT(*) AS avg_order_value,
        MAKE_DATE(year(order_date), month(order_date), 1) AS month_label
      FROM sales GROUP BY ALL),
h AS (SELECT *, ROUND(monthly_revenue / LAG(monthly_revenue) OVER w - 1, 4) AS mom_growth,
        ROUND(monthly_revenue / LAG(monthly_revenue, 12) OVER w - 1, 4) AS yoy_growth,
        ROUND(AVG(monthly_revenue) OVER (ORDER BY month_label ROWS 2 PRECEDING), 2)
          AS revenue_3m_avg
      FROM g WINDOW w AS (ORDER BY month_label)),
p AS (SELECT *, ROUND(revenue_3m_avg * (1 + COALESCE(mom_growth, 0)), 2) AS revenue_3m_forecast
      FROM h)"""


@query("monthly_growth_table", with_views(f"WITH {GROWTH_SQL.strip()} SELECT * FROM g"), INT="year month")
def _(i):
    return A.monthly_growth_table(i.view("sales"))


@query("monthly_growth_features", with_views(f"WITH {GROWTH_SQL.strip()} SELECT * FROM p"), INT="year month")
def _(i):
    return A.monthly_growth_features(A.monthly_growth_table(i.view("sales")))


@query("trainer_monthly_lags", with_views(f"""WITH {GROWTH_SQL.strip()},
k AS (SELECT *, (SELECT AVG(monthly_revenue) FROM g) AS mean FROM g)
SELECT month_label,
  ROUND(COALESCE(LAG(monthly_revenue) OVER w, mean), 2) AS lag_1_rev,
  ROUND(COALESCE(LAG(monthly_revenue, 2) OVER w, mean), 2) AS lag_2_rev,
  ROUND(COALESCE(LAG(monthly_revenue, 3) OVER w, mean), 2) AS lag_3_rev,
  ROUND(COALESCE(LAG(monthly_revenue, 12) OVER w, mean), 2) AS lag_12_rev,
  month(month_label) AS month_num, year(month_label) AS year_num,
  ROUND(sin(2 * pi() * month(month_label) / 12), 6) + 0 AS sin_m,
  ROUND(cos(2 * pi() * month(month_label) / 12), 6) + 0 AS cos_m
FROM k WINDOW w AS (ORDER BY month_label)"""), INT="month_num year_num")
def _(i):
    out = A.trainer_monthly_lags(A.monthly_growth_table(i.view("sales")))
    return out.select("month_label", *[F.round(f"lag_{n}_rev", 2).alias(f"lag_{n}_rev")
                                       for n in (1, 2, 3, 12)], "month_num", "year_num",
                      (F.round("sin_m", 6) + 0).alias("sin_m"),
                      (F.round("cos_m", 6) + 0).alias("cos_m"))


def _resample_sql(period):
    return with_views(f"""
SELECT {period} AS period, CAST(SUM(amount) AS DOUBLE) AS revenue, COUNT(amount) AS transactions,
       CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_transaction_value
FROM tx GROUP BY 1""")


@query("resample_series_daily", _resample_sql("order_date"))
def _(i):
    return A.resample_series(i.view("tx"), "order_date", "amount", "daily")


@query("resample_series_weekly", _resample_sql(
    "CAST(order_date + CAST((8 - isodow(order_date)) % 7 AS INT) AS DATE)"))
def _(i):
    return A.resample_series(i.view("tx"), "order_date", "amount", "weekly")


@query("resample_series", _resample_sql("CAST(date_trunc('month', order_date) AS DATE)"))
def _(i):
    return A.resample_series(i.view("tx"), "order_date", "amount", "monthly")


@query("transactions_to_monthly", with_views("""
WITH t AS (SELECT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS m,
                  CAST(SUM(amount) AS DOUBLE) AS r FROM tx GROUP BY ALL),
s AS (SELECT customer_id, CAST(UNNEST(generate_series(MIN(m), MAX(m), INTERVAL 1 MONTH)) AS DATE)
        AS month_label FROM t GROUP BY customer_id)
SELECT s.customer_id, s.month_label, COALESCE(r, 0) AS monthly_revenue
FROM s LEFT JOIN t ON s.customer_id = t.customer_id AND s.month_label = t.m"""))
def _(i):
    return A.transactions_to_monthly(i.view("tx"), "order_date", "amount", ("customer_id",))


# Joins and exports -------------------------------------------------------------------------

SCORED_SQL = f"""
c AS (SELECT f.*, CASE WHEN days_since_last_order > 90 THEN 1 ELSE 0 END AS is_churned,
   LEAST(GREATEST(ROUND(0.30 * LEAST(GREATEST(days_since_last_order / 180.0::DOUBLE, 0.0), 1.0)
  + 0.25 * (1 - total_orders::DOUBLE / (SELECT MAX(total_orders) FROM f))
  + 0.20 * return_rate + 0.15 * (1 - avg_rating_given / 5.0::DOUBLE)
  + 0.10 * LEAST(GREATEST(avg_days_between_orders / 60.0::DOUBLE, 0.0), 1.0), 4), 0.0), 1.0)
   AS churn_risk_score,
   ROUND(avg_order_value * (365 / CASE WHEN avg_days_between_orders = 0 THEN 365.0
     ELSE avg_days_between_orders END) * 3 / (1 + 0.1::DOUBLE), 2) AS predicted_clv,
   {SEGMENT_SQL} AS customer_segment FROM f)"""


@query("join_customer_features", with_views(f"""WITH {FEATURES_SQL.strip()}, {SCORED_SQL.strip()}
SELECT s.order_id, s.product_id, s.quantity_sold, c.customer_tenure_days, c.days_since_last_order,
  c.total_orders, c.avg_order_value, c.return_rate, c.customer_segment, c.predicted_clv,
  c.churn_risk_score, c.is_churned FROM sales s LEFT JOIN c ON s.customer_id = c.customer_id"""), INT="customer_tenure_days days_since_last_order")
def _(i):
    sales = i.view("sales")
    return A.join_customer_features(
        sales.select("order_id", "product_id", "quantity_sold", "customer_id"),
        A.full_customer_table(sales)).drop("customer_id")


@query("join_daily_features", with_views(f"""WITH {DAILY_SQL.strip()}, {ROLL_SQL.strip()}
SELECT s.order_id, s.product_id, s.quantity_sold, r.revenue_lag_7d, r.revenue_lag_30d,
  r.revenue_roll_7d, r.revenue_roll_30d, r.revenue_roll_90d, r.orders_roll_7d,
  r.revenue_yoy_growth FROM sales s LEFT JOIN r ON s.order_date = r.order_date"""))
def _(i):
    sales = i.view("sales")
    return A.join_daily_features(
        sales.select("order_id", "product_id", "quantity_sold", "order_date"),
        A.daily_rolling(A.daily_rollup(sales))).drop("order_date")


@query("export_task_datasets", with_views(f"""
WITH {FEATURES_SQL.strip()}, {SCORED_SQL.strip()}, {DAILY_SQL.strip()}, {ROLL_SQL.strip()},
{GROWTH_SQL.strip()}
SELECT 'revenue' AS dataset, COUNT(*) AS row_count, CAST(32 AS BIGINT) AS column_count,
       (SELECT CAST(SUM(net_revenue) AS DOUBLE) FROM sales) AS total
FROM sales s LEFT JOIN r ON s.order_date = r.order_date
UNION ALL SELECT 'churn', COUNT(*), 17, CAST(SUM(total_orders) AS DOUBLE) FROM c
UNION ALL SELECT 'growth', COUNT(*), 11, CAST(SUM(monthly_orders) AS DOUBLE) FROM p"""))
def _(i):
    from tillwise.sources.staging import Scratch
    from tillwise.sources.tables import export_task_datasets

    where, scratch = i.scratch(), Scratch(i.spark)
    export_task_datasets(A.task_datasets(i.view("sales"), scratch=scratch), where)
    scratch.drop()
    out, spark = None, i.spark
    for name, total in (("revenue", F.sum("net_revenue")), ("churn", F.sum("total_orders")),
                        ("growth", F.sum("monthly_orders"))):
        df = spark.read.parquet(f"{where}/{name}")
        one = df.agg(F.count("*").alias("row_count"), total.cast("double").alias("total")).select(
            F.lit(name).alias("dataset"), "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"), "total")
        out = one if out is None else out.unionByName(one)
    return out


