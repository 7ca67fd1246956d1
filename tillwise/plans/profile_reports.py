"""Registered queries: profiles, churn labels and dashboard numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.operators import aggregates as A
from tillwise.operators import churn as C
from tillwise.operators import dashboard as D
from tillwise.operators import profiles as P
from tillwise.plans.inputs import rounded, with_views
from tillwise.plans.registry import query


def _flat(df):
    """Lists as text, so rows compare by value."""
    return df.select(*[F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c)
                       for c, t in df.dtypes])


def _profile_sql(src, by="", group=""):
    return f"""
WITH s0 AS (SELECT {by} COUNT(*) AS n, MIN(order_date) AS a, MAX(order_date) AS b,
   COUNT(DISTINCT order_date) AS days, CAST(SUM(amount) AS DOUBLE) AS total,
   CAST(MAX(amount) AS DOUBLE) AS top, stddev_samp(CAST(amount AS DOUBLE)) AS sd,
   quantile_cont(CAST(amount AS DOUBLE), [0.1, 0.5, 0.9, 0.99]) AS q FROM {src} {group}),
s AS (SELECT *, date_diff('day', a, b) AS span, sd / (total / n) AS cov,
   LEAST(100.0, days::DOUBLE / (date_diff('day', a, b) + 1) * 100) AS cover,
   (year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS months,
   CASE WHEN date_diff('day', a, b) >= 540 THEN 'monthly'
        WHEN date_diff('day', a, b) >= 180 THEN 'weekly' ELSE 'daily' END AS grain FROM s0),
z AS (SELECT *, CASE WHEN span < 90 THEN 'Span of ' || span || ' days is below minimum 90.'
   WHEN n < 500 THEN 'Only ' || format('{{:,}}', n) || ' transactions; need at least 500.'
   WHEN cover < 30 THEN 'Day coverage of ' || format('{{:.1f}}', cover) || '% is below 30.0%.' END
   AS reason FROM s)
SELECT {by}
 CASE WHEN reason IS NOT NULL THEN 'insufficient_data' WHEN span >= 365 THEN 'acceptable'
      ELSE 'acceptable_minimum' END AS strategy,
 CASE WHEN reason IS NOT NULL THEN 'low' WHEN span >= 540 AND cov <= 1.5 AND cover >= 70
      THEN 'high' ELSE 'medium' END AS confidence,
 CASE WHEN reason IS NOT NULL THEN 'Revenue dataset cannot be profiled reliably: ' || reason ||
   ' The revenue model should be skipped for this dataset and the report should disclose this clearly.'
 ELSE 'This dataset spans ' || span || ' days (' || a || ' to ' || b || ') with ' ||
   format('{{:,}}', n) || ' transactions and $' || format('{{:,}}', CAST(ROUND(total) AS BIGINT)) ||
   ' total revenue. Order sizes have a coefficient of variation of ' || format('{{:.2f}}', cov) ||
   ', meaning per-transaction predictions are naturally noisy. The model is best used at the '''
   || grain || ''' aggregation grain for executive reporting; per-row predictions remain valid '
   || 'for relative ranking but should not be quoted as absolute order values.' END AS definition,
 CASE WHEN reason IS NOT NULL THEN '' ELSE upper(grain[1]) || grain[2:] ||
   ' aggregate revenue forecasting (use the aggregator helper) | Identifying revenue drivers via '
   || 'feature importance | Detecting seasonality and trend changes over time' END AS suitable_for,
 CASE WHEN reason IS NOT NULL THEN 'Any revenue forecasting until more data accumulates'
   ELSE 'Quoting individual order values precisely (CoV=' || format('{{:.2f}}', cov) ||
   ' → noisy at row level) | Forecasting categories or regions absent from the training data' ||
   CASE WHEN months < 24 THEN ' | Year-over-year growth claims (less than 24 months of history)'
   ELSE '' END END AS not_suitable_for,
 CAST(span AS INT) AS data_span_days,
 CASE WHEN reason IS NULL THEN CAST(a AS VARCHAR) END AS first_date,
 CASE WHEN reason IS NULL THEN CAST(b AS VARCHAR) END AS last_date,
 n AS total_transactions,
 CASE WHEN reason IS NULL THEN total ELSE 0.0 END AS total_revenue,
 CASE WHEN reason IS NULL THEN days ELSE 0 END AS days_with_data,
 CASE WHEN reason IS NULL THEN {rounded("cover", 2)} ELSE 0.0 END AS coverage_pct,
 CASE WHEN reason IS NULL THEN {rounded("n::DOUBLE / days", 2)} ELSE 0.0 END AS avg_transactions_per_day,
 CASE WHEN reason IS NULL THEN {rounded("total / days", 2)} ELSE 0.0 END AS avg_revenue_per_day,
 CASE WHEN reason IS NULL THEN {rounded("q[1]", 2)} END AS transaction_p10,
 CASE WHEN reason IS NULL THEN {rounded("q[2]", 2)} END AS transaction_p50,
 CASE WHEN reason IS NULL THEN {rounded("q[3]", 2)} END AS transaction_p90,
 CASE WHEN reason IS NULL THEN {rounded("q[4]", 2)} END AS transaction_p99,
 CASE WHEN reason IS NULL THEN top END AS transaction_max,
 CASE WHEN reason IS NULL THEN {rounded("cov", 4)} END AS coefficient_of_variation,
 CASE WHEN reason IS NULL THEN grain END AS recommended_aggregation,
 CAST(CASE WHEN reason IS NULL THEN months END AS INT) AS monthly_periods_available,
 CAST(CASE WHEN reason IS NULL THEN span // 7 + 1 END AS INT) AS weekly_periods_available,
 CASE WHEN reason IS NULL THEN CASE WHEN span >= 365 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END END
   AS train_test_split_ratio,
 CASE WHEN reason IS NOT NULL THEN reason || ' | Revenue model NOT recommended for this dataset.'
   ELSE concat_ws(' | ',
   CASE WHEN cov > 1.5 THEN 'Order sizes vary widely (coefficient of variation = ' ||
     format('{{:.2f}}', cov) || '). Per-transaction MAPE will be naturally high — only aggregate ('
     || grain || ') forecasts will look clean on dashboards.' END,
   CASE WHEN months < 12 THEN 'Only ' || months || ' months of data — yearly seasonality cannot be '
     || 'modelled reliably yet.' END,
   CASE WHEN cover < 70 THEN 'Day coverage is ' || format('{{:.0f}}', cover) || '% — there are gaps '
     || 'in the transactional history. Aggregate to weekly or monthly to smooth them.' END) END
   AS warnings
FROM z"""


@query("revenue_profile", with_views(_profile_sql("tx")))
def _(i):
    return _flat(P.revenue_profile(i.view("tx"), "order_date", "amount"))


TENANT = """
tenant AS (SELECT c_mktsegment AS dataset, t.* FROM tx t JOIN customer ON customer_id = c_custkey
 UNION ALL SELECT 'short ' || c_mktsegment, t.* FROM tx_short t JOIN customer ON customer_id = c_custkey
 UNION ALL SELECT 'tiny ' || c_mktsegment, t.* FROM tx_tiny t JOIN customer ON customer_id = c_custkey)"""


def _tenants(i):
    return i.sql(with_views("WITH " + TENANT.strip() + " SELECT * FROM tenant"))


def _tenant_sql(body):
    return with_views("WITH " + TENANT.strip() + ",\n" + body.strip()[5:])


@query("revenue_profile_by_dataset", _tenant_sql(
    _profile_sql("tenant", "dataset,", "GROUP BY dataset")))
def _(i):
    return _flat(P.revenue_profile(_tenants(i), "order_date", "amount", ("dataset",)))


GROWTH_PROFILE = """
WITH m AS (SELECT c_custkey AS k, c_mktsegment AS dataset FROM customer),
t AS (SELECT dataset, CAST(date_trunc('month', order_date) AS DATE) AS m,
      CAST(SUM(amount) AS DOUBLE) AS r FROM tenant GROUP BY ALL),
sp AS (SELECT dataset, CAST(UNNEST(generate_series(MIN(m), MAX(m), INTERVAL 1 MONTH)) AS DATE) AS m
      FROM t GROUP BY dataset),
f AS (SELECT sp.dataset, sp.m, COALESCE(r, 0) AS r FROM sp LEFT JOIN t USING (dataset, m)),
s AS (SELECT dataset, COUNT(*) AS n, COUNT(*) FILTER (r > 0) AS pos, MIN(m) AS a, MAX(m) AS b,
      SUM(r) AS total, median(r) AS mid, MIN(r) AS low, MAX(r) AS high FROM f GROUP BY dataset),
u AS (SELECT *, CASE WHEN n >= 24 THEN LEAST(6, GREATEST(4, n // 6)) WHEN n >= 6
      THEN LEAST(4, GREATEST(2, n // 5)) ELSE 0 END AS test FROM s),
v AS (SELECT *, CASE WHEN n >= 6 THEN n - test ELSE 0 END AS train FROM u),
w AS (SELECT *, CASE WHEN n >= 24 THEN LEAST(12, GREATEST(3, train // 3)) WHEN n >= 18 THEN 6
      WHEN n >= 12 THEN 3 WHEN n >= 6 THEN 2 ELSE 0 END AS h FROM v)
SELECT dataset,
 CASE WHEN n >= 24 THEN 'full_forecasting' WHEN n >= 6 THEN 'directional_only'
      ELSE 'insufficient_data' END AS strategy,
 CASE WHEN n >= 36 THEN 'high' WHEN n >= 24 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN n >= 24 THEN 'This dataset has ' || n || ' months of history (' || strftime(a, '%Y-%m')
   || ' to ' || strftime(b, '%Y-%m') || '), enough for full forecasting with year-over-year '
   || 'comparisons. Recommended split: ' || train || ' months for training, ' || test ||
   ' for test. Forecasts up to ' || h || ' months ahead are defensible; beyond that the model '
   || 'would be extrapolating.'
  WHEN n >= 6 THEN 'This dataset has ' || n || ' months of history — enough for directional '
   || 'forecasting only. Recommended split: ' || train || ' months train, ' || test ||
   ' test. Forecasts up to ' || h || ' months ahead are usable for trajectory (up/flat/down), but '
   || 'the specific values should NOT be used as targets for budgets, hiring, or contracts. '
   || 'Re-train as full-forecasting once 24 months of history are available.'
  ELSE 'Growth dataset cannot be modelled: Only ' || n || ' months of history; need at least 6. '
   || 'The growth model should be skipped for this dataset and the report should disclose this '
   || 'clearly.' END AS definition,
 CAST(n AS INT) AS months_of_history,
 CAST(CASE WHEN n >= 6 THEN pos ELSE 0 END AS INT) AS months_with_revenue,
 CAST(CASE WHEN n >= 6 THEN n - pos ELSE 0 END AS INT) AS months_zero_or_missing,
 CASE WHEN n >= 6 THEN $R(mid) ELSE 0 END AS median_monthly_revenue,
 CASE WHEN n >= 6 THEN $R(low) ELSE 0 END AS min_monthly_revenue,
 CASE WHEN n >= 6 THEN $R(high) ELSE 0 END AS max_monthly_revenue,
 n >= 12 AS has_full_seasonal_cycle, n >= 24 AS has_yoy_capability,
 CAST(h AS INT) AS safe_horizon_months, CAST(train AS INT) AS recommended_train_months,
 CAST(test AS INT) AS recommended_test_months,
 CASE WHEN n >= 24 THEN CASE WHEN n - pos > n * 0.1 THEN (n - pos) || ' of ' || n || ' months have '
   || 'zero or missing revenue — investigate before trusting the forecast.' ELSE '' END
  WHEN n >= 6 THEN concat_ws(' | ', 'Only ' || n || ' months of history — forecasts are '
   || 'directional, not committal numbers.',
   'Year-over-year claims are NOT supported (need 24+ months).',
   CASE WHEN n - pos > n * 0.1 THEN (n - pos) || ' of ' || n || ' months have zero or missing revenue.' END)
  ELSE 'Only ' || n || ' months of history; need at least 6. | Growth model NOT recommended for '
   || 'this dataset.' END AS warnings
FROM w"""


for _c in ("mid", "low", "high"):
    GROWTH_PROFILE = GROWTH_PROFILE.replace(f"$R({_c})", rounded(_c, 2))


@query("growth_profile", _tenant_sql(GROWTH_PROFILE))
def _(i):
    monthly = A.transactions_to_monthly(_tenants(i), "order_date", "amount", ("dataset",))
    out = _flat(P.growth_profile(monthly, by=("dataset",)))
    return out.drop("suitable_for", "not_suitable_for", "first_period", "last_period",
                    "total_revenue")


# Churn -------------------------------------------------------------------------------------

def _churn_sql(src, tail):
    return f"""
WITH p AS (SELECT MAX(order_date) AS mx, date_diff('day', MIN(order_date), MAX(order_date)) AS span
           FROM {src}),
h AS (SELECT *, CAST(LEAST(180, GREATEST(90, span // 6)) AS INT) AS hold FROM p),
c AS (SELECT customer_id, MIN(order_date) AS f, MAX(order_date) AS l, COUNT(*) AS n,
        COUNT(*) FILTER (order_date > mx - hold) AS orders_after,
        CAST(SUM(amount) AS DOUBLE) AS total_spent,
        CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_order_value,
        COUNT(DISTINCT category) AS unique_categories,
        any_value(mx) AS mx, any_value(hold) AS hold, any_value(span) AS span
      FROM {src}, h GROUP BY customer_id),
g AS (SELECT *, date_diff('day', f, l) AS tenure,
        CASE WHEN n > 1 THEN date_diff('day', f, l)::DOUBLE / (n - 1) END AS gap,
        CASE WHEN n > 1 THEN GREATEST(date_diff('day', f, l)::DOUBLE / (n - 1), 1.0) END AS agap
      FROM c),
t AS (SELECT *, LEAST(agap * 3, 365.0) AS threshold, date_diff('day', l, mx) AS recency FROM g)
{tail}"""


FORWARD_COLS = ["customer_id", "first_order", "last_order", "total_orders", "total_spent",
                "avg_order_value", "unique_categories", "customer_tenure_days",
                "avg_days_between_orders", "orders_after", "days_since_last_order", "is_churned"]


def _dates(df):
    return df.withColumns({"first_order": F.col("first_order").cast("date"),
                           "last_order": F.col("last_order").cast("date")})


@query("churn_label_forward_holdout", with_views(_churn_sql("tx", """
SELECT customer_id, f AS first_order, l AS last_order, n AS total_orders, total_spent,
  avg_order_value, unique_categories, tenure AS customer_tenure_days,
  gap AS avg_days_between_orders, orders_after, recency AS days_since_last_order,
  CASE WHEN orders_after = 0 THEN 1 ELSE 0 END AS is_churned
FROM t WHERE n > 1 AND f <= mx - hold - hold""")))
def _(i):
    cust = C.churn_customers(i.view("tx"), "customer_id", "order_date", "amount", "category",
                             strategy=C.FORWARD)
    return _dates(C.churn_labels(cust)).select(*FORWARD_COLS)


@query("churn_label_as_of_cutoff", with_views("""
WITH p AS (SELECT MAX(order_date) AS mx, CAST(LEAST(180, GREATEST(90,
     date_diff('day', MIN(order_date), MAX(order_date)) // 6)) AS INT) AS hold FROM tx),
c AS (SELECT customer_id, MIN(order_date) AS f, COUNT(*) AS n,
        COUNT(*) FILTER (order_date > mx - hold) AS after,
        COUNT(*) FILTER (order_date <= mx - hold) AS total_orders,
        CAST(SUM(amount) FILTER (order_date <= mx - hold) AS DOUBLE) AS total_spent,
        any_value(mx - hold - hold) AS newest FROM tx, p GROUP BY customer_id)
SELECT customer_id, total_orders, total_spent, CASE WHEN after = 0 THEN 1 ELSE 0 END AS is_churned
FROM c WHERE n > 1 AND f <= newest"""))
def _(i):
    cust = C.churn_customers(i.view("tx"), "customer_id", "order_date", "amount",
                             strategy=C.FORWARD, as_of_cutoff=True)
    return C.churn_labels(cust).select("customer_id", "total_orders", "total_spent", "is_churned")


@query("join_orders_after_cutoff", with_views(_churn_sql("tx", """
SELECT customer_id, n AS total_orders, orders_after FROM t""")))
def _(i):
    return C.churn_customers(i.view("tx"), "customer_id", "order_date").select(
        "customer_id", "total_orders", "orders_after")


@query("churn_label_adaptive", with_views(_churn_sql("tx_short", """
SELECT customer_id, f AS first_order, l AS last_order, n AS total_orders, total_spent,
  avg_order_value, unique_categories, tenure AS customer_tenure_days,
  agap AS avg_days_between_orders, threshold AS personal_threshold,
  recency AS days_since_last_order,
  CASE WHEN recency > threshold THEN 1 ELSE 0 END AS is_churned
FROM t WHERE n > 1 AND threshold <= date_diff('day', f, mx)""")))
def _(i):
    cust = C.churn_customers(i.view("tx_short"), "customer_id", "order_date", "amount",
                             "category", strategy=C.ADAPTIVE)
    cols = [c if c != "orders_after" else "personal_threshold" for c in FORWARD_COLS]
    return _dates(C.churn_labels(cust)).select(*cols)


@query("churn_label_refuse", with_views(_churn_sql("tx_tiny", """
SELECT 'insufficient_data' AS strategy, 'low' AS confidence, CAST(any_value(span) AS INT)
  AS data_span_days, COUNT(*) AS total_customers, COUNT(*) FILTER (n = 1) AS one_time_buyers,
  COUNT(*) FILTER (n > 1) AS repeat_customers, CAST(0 AS BIGINT) AS eligible_customers,
  'Need ≥ 180 days of data; got ' || any_value(span) ||
  '. | Churn model NOT trained for this dataset.' AS warnings FROM t""")))
def _(i):
    cust = C.churn_customers(i.view("tx_tiny"), "customer_id", "order_date")
    return _flat(C.churn_report(cust)).select(
        "strategy", "confidence", "data_span_days", "total_customers", "one_time_buyers",
        "repeat_customers", "eligible_customers", "warnings")


ROUTER = """
WITH p AS (SELECT dataset, MAX(order_date) AS mx,
             date_diff('day', MIN(order_date), MAX(order_date)) AS span FROM tenant GROUP BY dataset),
h AS (SELECT *, CAST(LEAST(180, GREATEST(90, span // 6)) AS INT) AS hold,
        CASE WHEN span >= 540 THEN 'forward_holdout' WHEN span >= 180 THEN 'adaptive_threshold'
        ELSE 'insufficient_data' END AS strategy FROM p),
c AS (SELECT dataset, customer_id, MIN(order_date) AS f, MAX(order_date) AS l, COUNT(*) AS n,
        COUNT(*) FILTER (order_date > mx - hold) AS after, any_value(mx) AS mx,
        any_value(hold) AS hold, any_value(span) AS span, any_value(strategy) AS strategy
      FROM tenant JOIN h USING (dataset) GROUP BY dataset, customer_id),
g AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN strategy = 'adaptive_threshold'
        THEN GREATEST(date_diff('day', f, l)::DOUBLE / (n - 1), 1.0)
        ELSE date_diff('day', f, l)::DOUBLE / (n - 1) END END AS gap FROM c),
t AS (SELECT *, LEAST(gap * 3, 365.0) AS threshold, date_diff('day', l, mx) AS recency FROM g),
e AS (SELECT *, CASE strategy WHEN 'forward_holdout' THEN n > 1 AND f <= mx - hold - hold
        WHEN 'adaptive_threshold' THEN n > 1 AND threshold <= date_diff('day', f, mx)
        ELSE FALSE END AS ok FROM t),
r AS (SELECT dataset, any_value(strategy) AS strategy, any_value(span) AS span,
        any_value(hold) AS hold, any_value(mx) AS mx, COUNT(*) AS total,
        COUNT(*) FILTER (n = 1) AS once,
        COUNT(*) FILTER (CASE strategy WHEN 'forward_holdout' THEN n > 1 AND f > mx - hold - hold
          WHEN 'adaptive_threshold' THEN n > 1 AND NOT ok ELSE FALSE END) AS fresh,
        COUNT(*) FILTER (ok) AS cohort,
        COUNT(*) FILTER (ok AND CASE strategy WHEN 'forward_holdout' THEN after = 0
          ELSE recency > threshold END) AS churned,
        median(gap) FILTER (n > 1) AS mid FROM e GROUP BY dataset),
w AS (SELECT *, COALESCE(churned::DOUBLE / NULLIF(cohort, 0) * 100, 0) AS rate FROM r)
"""

ROUTER_TAIL = f"""
SELECT dataset, strategy, CASE strategy WHEN 'forward_holdout' THEN 'high'
   WHEN 'adaptive_threshold' THEN 'medium' ELSE 'low' END AS confidence,
 CASE strategy WHEN 'forward_holdout' THEN
   'A customer is labelled ''churned'' if they had at least one order before ' || (mx - hold) ||
   ' and made no orders during the ' || hold || '-day observation window from ' || (mx - hold) ||
   ' to ' || mx || '. One-time buyers and customers acquired too recently to observe a full '
   || 'holdout window are excluded from the trained population.'
  WHEN 'adaptive_threshold' THEN
   'A customer with multiple orders is labelled ''churned'' if their days-since-last-order '
   || 'exceeds 3× their personal average inter-purchase interval, capped at 365 days. The median '
   || 'interval across all repeat customers in this dataset is ' ||
   CAST(CAST(ROUND(mid) AS BIGINT) AS VARCHAR) || ' days. One-time buyers and customers whose '
   || 'threshold exceeds the observable history are excluded.'
  ELSE 'Dataset spans only ' || span || ' days. A defensible churn label requires at least 180 days '
   || 'of transactional history. No labels were produced; the churn model should be skipped for '
   || 'this dataset and the report should disclose this clearly.' END AS definition,
 CAST(span AS INT) AS data_span_days, total AS total_customers, once AS one_time_buyers,
 total - once AS repeat_customers, fresh AS new_customers, cohort AS eligible_customers,
 churned AS churned_customers, {rounded("rate", 2)} AS churn_rate_pct,
 CASE WHEN strategy = 'forward_holdout' THEN CAST(mx - hold AS VARCHAR) END AS cutoff_date,
 CASE WHEN strategy = 'forward_holdout' THEN hold END AS holdout_window_days,
 CASE WHEN strategy = 'adaptive_threshold' THEN {rounded("mid", 1)} END AS median_ipi_days
FROM w"""


@query("churn_strategy_router", _tenant_sql(ROUTER + ROUTER_TAIL))
def _(i):
    cust = C.churn_customers(_tenants(i), "customer_id", "order_date", by=("dataset",))
    return C.churn_report(cust, ("dataset",)).drop(
        "warnings", "threshold_multiplier", "threshold_max_days")


@query("churn_plausibility", _tenant_sql(ROUTER + """
SELECT dataset, concat_ws(' | ',
 CASE WHEN strategy = 'insufficient_data' THEN 'Need ≥ 180 days of data; got ' || span || '.' END,
 CASE WHEN strategy = 'insufficient_data' THEN 'Churn model NOT trained for this dataset.' END,
 CASE WHEN strategy != 'insufficient_data' AND cohort < 50 THEN 'Eligible cohort is ' || cohort ||
   ' — below the 50-customer minimum for a stable model. Treat outputs as exploratory.' END,
 CASE WHEN strategy != 'insufficient_data' AND (rate < 2 OR rate > 60) THEN 'Churn rate of ' ||
   format('{:.1f}', rate) || '% is outside the typical 2–60% band. Investigate the data before '
   || 'acting on results.' END,
 CASE WHEN strategy = 'adaptive_threshold' THEN 'Adaptive threshold is a heuristic. Re-train with '
   || 'forward-holdout as soon as 18+ months of data are available.' END) AS warnings
FROM w"""))
def _(i):
    cust = C.churn_customers(_tenants(i), "customer_id", "order_date", by=("dataset",))
    return _flat(C.churn_report(cust, ("dataset",)).select("dataset", "warnings"))


# Dashboard ---------------------------------------------------------------------------------

@query("dashboard_kpis", with_views(f"""
SELECT COUNT(DISTINCT customer_id) AS total_customers, COUNT(DISTINCT order_id) AS total_orders,
 {rounded("CAST(SUM(total_revenue) AS DOUBLE) / COUNT(*)", 2)} AS avg_order_value,
 CAST(SUM(total_revenue) AS DOUBLE) AS total_revenue FROM sales"""))
def _(i):
    return D.dashboard_kpis(i.view("sales"), "total_revenue", "customer_id", "order_id")


@query("revenue_trend", with_views("""
SELECT strftime(order_date, '%Y-%m') AS period, CAST(SUM(amount) AS DOUBLE) AS revenue
FROM tx GROUP BY 1 ORDER BY 1 DESC LIMIT 12"""))
def _(i):
    return D.revenue_trend(i.view("tx"), "amount", "order_date")


@query("top_categories", with_views("""
SELECT product_category AS category, CAST(SUM(net_revenue) AS DOUBLE) AS revenue
FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(i):
    return D.top_categories(i.view("sales"), "product_category", "net_revenue")


@query("top_categories_by_rows", with_views("""
SELECT status AS category, CAST(COUNT(*) AS DOUBLE) AS revenue FROM tx GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(i):
    return D.top_categories(i.view("tx"), "status")


PLACES = """
SELECT o_orderkey, CASE WHEN c_nationkey % 5 = 0 THEN 'Dubai Marina' WHEN c_nationkey % 5 = 1
  THEN 'Lyon' ELSE n_name END AS ship_city, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query("currency_from_table", f"""
SELECT CASE WHEN bool_or(regexp_matches(lower(ship_city), 'egypt|cairo|alexandria|giza|hurghada'))
  THEN 'EGP' WHEN bool_or(regexp_matches(lower(ship_city), 'uae|dubai|abu dhabi|sharjah'))
  THEN 'AED' ELSE 'other' END AS currency FROM ({PLACES})""")
def _(i):
    return D.currency_from_table(i.sql(PLACES))
