"""Registered queries: splits, models, metrics, scoring, calibration, forecasts.

Training queries use the operators' own numbers of trees, depths and steps; they read the whole tables.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tillwise.operators import aggregates as A
from tillwise.operators import calibrate as B
from tillwise.operators import calibration_jobs as J
from tillwise.operators import churn as C
from tillwise.operators import forecast as X
from tillwise.operators import learn as L
from tillwise.operators import scoring as S
from tillwise.plans.inputs import rounded, with_views
from tillwise.plans.registry import query
from tillwise.session import checkpointed

AS_OF = datetime.date(2001, 8, 15)


@query("label_encode", with_views("""
WITH p AS (SELECT product_category, dense_rank() OVER (ORDER BY product_category) - 1 AS a FROM (SELECT DISTINCT product_category FROM sales)),
r AS (SELECT customer_region, dense_rank() OVER (ORDER BY customer_region) - 1 AS b FROM (SELECT DISTINCT customer_region FROM sales))
SELECT product_category, customer_region, CAST(a AS INT) AS product_category_code, CAST(b AS INT) AS customer_region_code, COUNT(*) AS order_lines
FROM sales JOIN p USING (product_category) JOIN r USING (customer_region) GROUP BY ALL"""))
def _(i):
    cols = ["product_category", "customer_region"]
    return L.label_encode(i.view("sales").select(*cols), cols).groupBy(
        *cols, *[f"{c}_code" for c in cols]).agg(F.count("*").alias("order_lines"))


@query("standard_scale", with_views("""
SELECT order_id, ROUND((amount::DOUBLE - m) / s, 6) AS amount FROM tx, (SELECT AVG(amount::DOUBLE) AS m, stddev_pop(amount::DOUBLE) AS s FROM tx)"""))
def _(i):
    tx = i.view("tx").select("order_id", "amount")
    return L.standard_scale(tx, L.fit_scaler(tx, ["amount"])).withColumn("amount", F.round("amount", 6))


@query("temporal_split", with_views("""
WITH d AS (SELECT order_date, COUNT(*) AS k FROM tx GROUP BY 1), r AS (SELECT order_date, SUM(k) OVER (ORDER BY order_date) AS seen, SUM(k) OVER () AS n FROM d),
c AS (SELECT MIN(order_date) AS cut FROM r WHERE seen >= GREATEST(FLOOR(n * 0.8::DOUBLE), 1))
SELECT order_id, order_date <= cut AS is_train FROM tx, c"""))
def _(i):
    return L.temporal_split(i.view("tx"), "order_date", 0.8).select("order_id", "is_train")


@query("last_months_split", with_views("""
WITH m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_key FROM tx GROUP BY 1)
SELECT month_key, ROW_NUMBER() OVER (ORDER BY month_key DESC) > LEAST(6, GREATEST(1, (SELECT COUNT(*) FROM m) // 4)) AS is_train FROM m"""))
def _(i):
    m = A.monthly_aggregate(i.view("tx"), "order_date", "amount")
    return L.last_months_split(m, "month_key", 6).select("month_key", "is_train")


@query("random_split", with_views("""
SELECT customer_id, CAST('0x' || substr(md5('42:' || customer_id), 1, 8) AS BIGINT) % 100 < 80 AS is_train
FROM (SELECT DISTINCT customer_id FROM tx)"""))
def _(i):
    return L.random_split(i.view("tx").select("customer_id").distinct(), "customer_id")


PRED = """
SELECT o_orderkey, o_custkey, o_orderpriority AS series, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderkey % 90 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS actual,
  CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE CAST(CAST(o_totalprice * (80 + o_orderkey % 41) / 100 AS DECIMAL(18,0)) AS DECIMAL(18,2)) END AS predicted,
  (o_orderkey * 37 % 1000) / CAST(1000 AS DOUBLE) AS score, CAST(CASE WHEN o_orderkey * 7 % 100 < o_orderkey * 37 % 1000 / 10 THEN 1 ELSE 0 END AS INT) AS label
FROM orders"""


def _r(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("regression_metrics", f"""
WITH p AS (SELECT series, actual AS y, predicted::DOUBLE AS p FROM ({PRED}) WHERE predicted IS NOT NULL)
SELECT series, ROUND(sqrt(AVG((y - p) * (y - p))), 4) AS rmse, ROUND(AVG(ABS(y - p)), 4) AS mae,
  ROUND(1 - SUM((y - p) * (y - p)) / (var_pop(y) * COUNT(*)), 4) AS r2, ROUND(AVG(ABS((y - p) / NULLIF(y, 0))) * 100, 4) AS mape_pct,
  ROUND(AVG(ABS(y - p) / NULLIF((ABS(y) + ABS(p)) / 2, 0)) * 100, 4) AS smape_pct, ROUND(AVG(p - y), 4) AS bias, COUNT(*) AS n_rows FROM p GROUP BY series""")
def _(i):
    return _r(L.regression_metrics(i.sql(PRED).where("predicted is not null"), "actual", "predicted", ("series",)))


@query("classification_metrics", f"""
WITH p AS (SELECT score, label FROM ({PRED})), r AS (SELECT label, rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM p),
a AS (SELECT (SUM(rk) FILTER (label = 1) - COUNT(*) FILTER (label = 1) * (COUNT(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
  / (COUNT(*) FILTER (label = 1)::DOUBLE * COUNT(*) FILTER (label = 0)) AS auc FROM r),
c AS (SELECT COUNT(*) FILTER (score >= 0.5 AND label = 1) AS tp, COUNT(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  COUNT(*) FILTER (score < 0.5 AND label = 1) AS fn, COUNT(*) AS n, AVG(label) AS br FROM p)
SELECT ROUND(auc, 6) AS roc_auc, ROUND(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, ROUND(tp / (tp + fp)::DOUBLE, 6) AS precision,
  ROUND(tp / (tp + fn)::DOUBLE, 6) AS recall, ROUND(br, 6) AS base_rate, n AS n_rows FROM a, c""")
def _(i):
    return _r(L.classification_metrics(i.sql(PRED), "label", "score"), 6)


# Training and scoring (rows only) -----------------------------------------------------------

def _revenue_table(i):
    """The revenue training table with lags filled backwards on the daily table."""
    sales = i.view("sales")
    daily = A.backfill_lags(A.daily_rolling(A.daily_rollup(sales)))
    return checkpointed(A.join_daily_features(A.order_date_features(sales), daily))


def _churn_table(i):
    tx = i.view("tx")
    lab = C.churn_labels(C.churn_customers(tx, "customer_id", "order_date", "amount", "category",
                                           as_of_cutoff=True))
    return checkpointed(lab.na.fill(0.0, ["avg_days_between_orders"]))


def _growth_table(i):
    return checkpointed(A.trainer_monthly_lags(A.monthly_growth_features(
        A.monthly_growth_table(i.view("sales")))))


@query("train_revenue_model")
def _(i):
    return L.train_revenue_model(_revenue_table(i)).metrics


@query("train_churn_model")
def _(i):
    return L.train_churn_model(_churn_table(i)).metrics


@query("train_growth_model")
def _(i):
    return L.train_growth_model(_growth_table(i)).metrics


@query("feature_importance")
def _(i):
    return L.train_churn_model(_churn_table(i)).importances


@query("score_revenue")
def _(i):
    trained = L.train_revenue_model(_revenue_table(i))
    sales = i.view("sales").select("order_id", "quantity_sold", "price", "discount_percent", "order_date")
    mapping = {**L.mapping_of("revenue"), "month": "_from_date:order_date",
               "quarter": "_from_date:order_date", "seasonal_index": None, "gross_margin_pct": None}
    scored = L.score_revenue(sales, mapping, trained, AS_OF, ("order_id", "order_date"))
    return S.monthly_predicted_revenue(scored, "order_date")


@query("score_churn")
def _(i):
    from tillwise.plans.sales_reports import ROLES

    trained = L.train_churn_model(_churn_table(i))
    cust = A.customer_aggregate(i.view("sales"), ROLES)
    scored = L.score_churn(cust, L.mapping_of("churn"), trained, AS_OF,
                           ("customer_id", "avg_days_between_orders", "customer_tenure_days"))
    return S.score_churn_rows(scored, "churn_prob")


@query("score_growth")
def _(i):
    trained = L.train_growth_model(_growth_table(i))
    m = A.monthly_lags(A.monthly_aggregate(i.view("tx"), "order_date", "amount"))
    return L.score_growth(m, L.mapping_of("growth"), trained, AS_OF, ("month_key",))


@query("forecast_revenue_recursive")
def _(i):
    table = _revenue_table(i)
    trained = L.train_revenue_model(table)
    last = table.groupBy("customer_region").agg(F.max_by(
        F.struct(*[c for c in table.columns if c != "customer_region"]),
        F.struct("order_date", "order_id", "product_id")).alias("r")).select("customer_region", "r.*")
    return X.forecast_revenue_recursive(last, trained.model, ("customer_region",))


@query("forecast_growth_recursive")
def _(i):
    trained = L.train_growth_model(_growth_table(i))
    by = ("customer_region",)
    m = A.trainer_monthly_lags(A.monthly_growth_features(
        A.monthly_growth_table(i.view("sales"), by), by), by).na.fill(0.0)
    return X.forecast_growth_recursive(m, trained.model, by)


# Scored tables ------------------------------------------------------------------------------

RISK = "CASE WHEN {p} >= 0.7 THEN 'high' WHEN {p} >= 0.4 THEN 'medium' ELSE 'low' END"
CUST = """
SELECT customer_id, COUNT(*) AS n, GREATEST(date_diff('day', MIN(order_date), MAX(order_date)), 1) AS tenure,
  GREATEST(date_diff('day', MIN(order_date), MAX(order_date)), 1)::DOUBLE / GREATEST(COUNT(*) - 1, 1) AS gap,
  (customer_id * 37 % 1000) / 1000.0::DOUBLE AS p FROM tx GROUP BY customer_id"""
ADJ = """CASE WHEN gap <= 0 OR tenure <= 0 THEN p WHEN LEAST(tenure / (gap * 3), 2.0) > 1 THEN p * 0.85
  WHEN LEAST(tenure / (gap * 3), 2.0) < 0.5 THEN LEAST(p * 1.15, 0.999) ELSE p END"""


def _scored(i):
    from tillwise.operators.aggregates import customer_aggregate

    c = customer_aggregate(i.view("tx"), {"customer_id": "customer_id", "date": "order_date"})
    return c.withColumn("p", (F.col("customer_id") * 37 % 1000) / F.lit(1000.0))


@query("recency_adjust", with_views(f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, {rounded("a", 4)} AS churn_probability, p AS base_probability,
  {RISK.format(p="a")} AS risk_level, CAST(90 AS INT) AS horizon_days FROM (SELECT *, CAST({ADJ} AS DOUBLE) AS a FROM ({CUST}))"""))
def _(i):
    return S.score_churn_rows(_scored(i), "p")


@query("risk_level", f"""
SELECT o_orderkey, {RISK.format(p="score")} AS risk_level FROM ({PRED})""")
def _(i):
    return i.sql(PRED).select("o_orderkey", S.risk_level("score").alias("risk_level"))


@query("risk_counts", with_views(f"""
SELECT risk_level, COUNT(*) AS customers FROM (SELECT {RISK.format(p="a")} AS risk_level FROM (SELECT {ADJ} AS a FROM ({CUST}))) GROUP BY 1"""))
def _(i):
    return S.risk_counts(S.score_churn_rows(_scored(i), "p"))


@query("segment_risk", f"""
SELECT CASE WHEN n >= 15 THEN 'VIP' WHEN n >= 8 THEN 'Loyal' WHEN n >= 3 THEN 'Regular' ELSE 'New' END AS customer_segment,
  ROUND(AVG(p), 9) AS churn_prob FROM ({with_views(CUST)}) GROUP BY 1""")
def _(i):
    return S.segment_risk(A.customer_segment(_scored(i)), probability="p").withColumn(
        "churn_prob", F.round("churn_prob", 9))


@query("monthly_predicted_revenue", f"""
SELECT strftime(order_date, '%Y-%m') AS month, CAST(SUM(COALESCE(predicted, 0)) AS DOUBLE) AS predicted_revenue,
  COUNT(*) AS n_rows, COUNT(*) FILTER (predicted IS NULL) AS errors FROM ({PRED}) GROUP BY 1""")
def _(i):
    return S.monthly_predicted_revenue(i.sql(PRED), "order_date", "predicted")


@query("prediction_totals", f"""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (predicted IS NULL) AS errors, CAST(SUM(COALESCE(predicted, 0)) AS DOUBLE) AS total_predicted,
  {rounded("CAST(SUM(COALESCE(predicted, 0)) AS DOUBLE) / COUNT(*)", 2)} AS avg_row_predicted FROM ({PRED})""")
def _(i):
    return S.prediction_totals(i.sql(PRED), "predicted")


# Calibration --------------------------------------------------------------------------------

PAIRS = f"""(SELECT predicted::DOUBLE AS prediction, actual FROM ({PRED}) WHERE predicted IS NOT NULL)"""


@query("collect_calibration_pairs", f"SELECT * FROM {PAIRS}")
def _(i):
    return B.collect_calibration_pairs(i.sql(PRED), "predicted", "actual", "o_orderkey")


@query("fit_linear_calibrator", f"""
WITH p AS (SELECT CAST(o_orderkey % 7 * 1000 AS DOUBLE) AS x, o_totalprice AS y FROM orders),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p)
SELECT 'linear' AS kind, COUNT(*) AS n_samples, ROUND(AVG(ABS(y - x)), 2) AS mae_before, ROUND(AVG(ABS(y - (a + b * x))), 2) AS mae_after FROM p, m""")
def _(i):
    pairs = i.table("orders").select((F.col("o_orderkey") % 7 * 1000).cast("double").alias("prediction"),
                                     F.col("o_totalprice").alias("actual"))
    cal = B.fit_regression_calibrator(pairs)
    m = cal.metrics
    return i.spark.createDataFrame(
        [(cal.kind, m["n_samples"], round(m["mae_before"], 2), round(m["mae_after"], 2))],
        "kind string, n_samples long, mae_before double, mae_after double")


@query("fit_regression_calibrator")
def _(i):
    cal = B.fit_regression_calibrator(B.collect_calibration_pairs(
        i.sql(PRED), "predicted", "actual", "o_orderkey"))
    return B.calibrator_row(i.spark, 1, "revenue", cal)


@query("fit_classification_calibrator")
def _(i):
    cal = B.fit_classification_calibrator(B.collect_calibration_pairs(
        i.sql(PRED), "score", "label", "o_orderkey", churn=True))
    return B.calibrator_row(i.spark, 1, "churn", cal)


CALS = """
SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'churn' ELSE 'growth' END AS model_kind,
  CASE user_id % 5 WHEN 4 THEN 'linear' ELSE 'isotonic' END AS calibrator_kind, CAST(user_id % 10 AS DOUBLE) AS lo FROM events WHERE user_id % 7 <> 0 GROUP BY user_id"""
SCORED = """
SELECT event_id, user_id, CASE user_id % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'churn' ELSE 'growth' END AS model_kind, value AS prediction FROM events"""


@query("apply_calibrator", f"""
WITH c AS ({CALS}), j AS (SELECT s.*, c.calibrator_kind AS ck, lo FROM ({SCORED}) s LEFT JOIN c USING (user_id, model_kind)),
v AS (SELECT *, CASE WHEN ck IS NULL THEN prediction WHEN ck = 'linear' THEN lo - 5 + 0.5 * prediction
   WHEN prediction < lo THEN -2.0 WHEN prediction < lo + 10 THEN -2 + 12 * (prediction - lo) / 10.0
   WHEN prediction < lo + 40 THEN 10 + 20 * (prediction - lo - 10) / 30.0 ELSE 30.0 END AS y FROM j)
SELECT event_id, ROUND(CASE WHEN ck IS NULL THEN prediction WHEN model_kind = 'churn' THEN LEAST(GREATEST(y, 0.0), 1.0) ELSE GREATEST(y, 0.0) END, 6) AS calibrated FROM v""")
def _(i):
    lo = F.col("lo")
    cals = i.sql(CALS).withColumns({
        "xs": F.when(F.col("calibrator_kind") == "linear", F.array().cast("array<double>")).otherwise(
            F.array(lo, lo + 10, lo + 40)),
        "ys": F.when(F.col("calibrator_kind") == "linear", F.array(lo - 5, F.lit(0.5))).otherwise(
            F.array(F.lit(-2.0), F.lit(10.0), F.lit(30.0)))})
    return B.apply_calibrators(i.sql(SCORED), cals).select(
        "event_id", F.round("calibrated", 6).alias("calibrated"))


# Calibrators of every supplier at once: by kind, quantities against prices, or discounts against returns
USER_PAIRS = """
SELECT l_orderkey, l_linenumber, l_suppkey AS user_id,
  CASE l_suppkey % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'churn' ELSE 'growth' END AS model_kind,
  CASE WHEN l_suppkey % 3 = 1 THEN l_discount * 11 - 0.05 WHEN l_suppkey % 8 = 5 THEN floor(l_quantity / 9)
       ELSE l_quantity END AS prediction,
  CASE WHEN l_suppkey % 15 = 1 THEN 1.0 WHEN l_suppkey % 3 = 1 THEN CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END
       ELSE floor(l_extendedprice / 100) - floor(400 * l_tax) END AS actual FROM lineitem"""
USER_FITS = f"""
p AS (SELECT l_orderkey, l_linenumber, user_id, model_kind, CAST(prediction AS DOUBLE) AS prediction, CAST(actual AS DOUBLE) AS y, CAST(CASE WHEN model_kind = 'churn'
        THEN LEAST(GREATEST(prediction, 0.0), 1.0) ELSE prediction END AS DOUBLE) AS x FROM ({USER_PAIRS})),
c AS (SELECT user_id, model_kind, x, SUM(y) AS s, COUNT(*) AS w FROM p GROUP BY ALL),
k AS (SELECT user_id, model_kind, COUNT(*) AS n, SUM(y) AS pos, COUNT(DISTINCT x) AS d, regr_slope(y, x) AS slope,
        regr_intercept(y, x) AS intercept FROM p GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < CASE model_kind WHEN 'churn' THEN 50 ELSE 30 END THEN 'refused: too few pairs'
        WHEN model_kind = 'churn' AND pos IN (0, n) THEN 'refused: one class'
        WHEN model_kind = 'churn' OR (n >= 100 AND d >= 10) THEN 'isotonic' ELSE 'linear' END AS calibrator_kind FROM k),
a AS (SELECT user_id, model_kind, x, SUM(s) OVER o AS cs, SUM(w) OVER o AS cw, SUM(s) OVER o - s AS bs, SUM(w) OVER o - w AS bw
      FROM c SEMI JOIN (SELECT user_id, model_kind FROM t WHERE calibrator_kind = 'isotonic') i USING (user_id, model_kind)
      WINDOW o AS (PARTITION BY user_id, model_kind ORDER BY x)),
m AS (SELECT f.user_id, f.model_kind, f.x AS low, l.x, MIN((l.cs - f.bs) / (l.cw - f.bw)) OVER (
        PARTITION BY f.user_id, f.model_kind, f.x ORDER BY l.x DESC) AS least
      FROM a f JOIN a l ON f.user_id = l.user_id AND f.model_kind = l.model_kind AND f.x <= l.x),
g AS (SELECT user_id, model_kind, x, MAX(least) AS fit FROM m GROUP BY ALL),
v AS (SELECT p.*, calibrator_kind, CASE calibrator_kind WHEN 'isotonic' THEN fit WHEN 'linear' THEN intercept + slope * p.x
        ELSE p.x END AS fitted FROM p JOIN t USING (user_id, model_kind) LEFT JOIN g USING (user_id, model_kind, x))"""


@query("fit_user_calibrators", f"""
WITH {USER_FITS}, e AS (SELECT user_id, model_kind, calibrator_kind, COUNT(*) AS n_samples,
  AVG(CASE model_kind WHEN 'churn' THEN pow(x - y, 2) ELSE ABS(y - x) END) AS b,
  AVG(CASE model_kind WHEN 'churn' THEN pow(fitted - y, 2) ELSE ABS(y - fitted) END) AS a FROM v GROUP BY ALL)
SELECT user_id, model_kind, calibrator_kind, n_samples, CASE WHEN calibrator_kind NOT LIKE 'refused%' THEN ROUND(b, 4) END AS error_before,
  CASE WHEN calibrator_kind NOT LIKE 'refused%' THEN ROUND(a, 4) END AS error_after FROM e""")
def _(i):
    table = J.fit_calibrators(i.sql(USER_PAIRS)).table
    return table.select("user_id", "model_kind", "calibrator_kind", "n_samples", "error_before", "error_after")


@query("apply_user_calibrators", f"""
WITH {USER_FITS}
SELECT l_orderkey, l_linenumber, user_id, ROUND(CASE WHEN calibrator_kind LIKE 'refused%' THEN prediction
  WHEN model_kind = 'churn' THEN LEAST(GREATEST(fitted, 0.0), 1.0) ELSE GREATEST(fitted, 0.0) END, 6) AS calibrated
FROM v""")
def _(i):
    pairs = i.sql(USER_PAIRS).withColumn("prediction", F.col("prediction").cast("double"))
    return J.apply_all(pairs, J.fit_calibrators(pairs)).select(
        "l_orderkey", "l_linenumber", "user_id", F.round("calibrated", 6).alias("calibrated"))


# Forecasts ----------------------------------------------------------------------------------

def _seasonal_sql(dev, value, fitted):
    return with_views(f"""
WITH s AS (SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS m, CAST(SUM(amount) AS DOUBLE) AS y FROM tx GROUP BY ALL),
t AS (SELECT *, CAST((year(m) - 2000) * 12 + month(m) AS DOUBLE) AS t FROM s),
l AS (SELECT category, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, MAX(m) AS last FROM t GROUP BY 1 HAVING COUNT(*) >= 6),
e AS (SELECT category, month(m) AS cal, AVG({dev}) AS eff FROM t JOIN l USING (category) GROUP BY ALL),
d AS (SELECT t.category, stddev_pop(y - ({fitted})) AS sd FROM t JOIN l ON t.category = l.category
  JOIN e ON e.category = t.category AND e.cal = month(t.m) GROUP BY 1),
h AS (SELECT category, a, b, sd, CAST(last + to_months(CAST(k AS INT)) AS DATE) AS dt FROM l JOIN d USING (category), range(1, 13) r(k))
SELECT category, strftime(dt, '%Y-%m') AS month, ROUND({value}, 1) AS predicted_revenue,
  ROUND({value} - 1.2815515655446004 * sd, 0) AS lower_80, ROUND({value} + 1.2815515655446004 * sd, 0) AS upper_80
FROM (SELECT h.*, a + b * ((year(dt) - 2000) * 12 + month(dt)) AS tr, eff FROM h JOIN e ON h.category = e.category AND month(dt) = e.cal)""")


for _mode, _dev, _val, _fit in (("additive", "y - (a + b * t)", "tr + eff", "a + b * t + eff"),
                                ("multiplicative", "y / (a + b * t)", "tr * eff", "(a + b * t) * eff")):
    @query("forecast_seasonal" + ("" if _mode == "additive" else "_multiplicative"), _seasonal_sql(_dev, _val, _fit))
    def _(i, mode=_mode):
        m = A.monthly_aggregate(i.view("tx"), "order_date", "amount", ("category",))
        return X.forecast_seasonal(m, ("category",), mode=mode).select(
            "category", "month", F.round("predicted_revenue", 1).alias("predicted_revenue"),
            F.round("lower_80", 0).alias("lower_80"), F.round("upper_80", 0).alias("upper_80"))


@query("seasonal_holdout", with_views("""
WITH s0 AS (SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS m, CAST(SUM(amount) AS DOUBLE) AS y FROM tx GROUP BY ALL),
s1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY m DESC) AS back FROM s0),
t AS (SELECT *, CAST((year(m) - 2000) * 12 + month(m) AS DOUBLE) AS t FROM s1),
l AS (SELECT category, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, MAX(m) AS last FROM t WHERE back > 3 GROUP BY 1),
e AS (SELECT category, month(m) AS cal, AVG(y / (a + b * t)) AS eff FROM t JOIN l USING (category) WHERE back > 3 GROUP BY ALL),
p AS (SELECT t.category, y, (a + b * t.t) * eff AS p FROM t JOIN l ON t.category = l.category
  JOIN e ON e.category = t.category AND e.cal = month(t.m) WHERE back <= 3 AND t.m <= last + INTERVAL 3 MONTH)
SELECT category, ROUND(sqrt(AVG((y - p) * (y - p))), 0) AS rmse, ROUND(AVG(ABS(y - p)), 0) AS mae, ROUND(AVG(ABS((y - p) / y)) * 100, 3) AS mape_pct, COUNT(*) AS n_rows
FROM p GROUP BY category"""))
def _(i):
    m = A.monthly_aggregate(i.view("tx"), "order_date", "amount", ("category",))
    got = L.regression_metrics(X.seasonal_holdout(m, ("category",)), "actual", "predicted_revenue", ("category",))
    return got.select("category", F.round("rmse", 0).alias("rmse"), F.round("mae", 0).alias("mae"), F.round("mape_pct", 3).alias("mape_pct"), "n_rows")


@query("growth_actual_series", with_views("""
WITH m AS (SELECT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS k, CAST(SUM(amount) AS DOUBLE) AS r FROM tx GROUP BY ALL)
SELECT customer_id, strftime(k, '%Y-%m') AS month, r AS actual_revenue, CASE WHEN COUNT(*) OVER (PARTITION BY customer_id) < 6
  THEN 'Forward forecast requires ≥6 months of data; found ' || COUNT(*) OVER (PARTITION BY customer_id) || '. Forecast skipped.' END AS forecast_note FROM m"""))
def _(i):
    m = A.monthly_aggregate(i.view("tx"), "order_date", "amount", ("customer_id",))
    return X.growth_actual_series(m, ("customer_id",))
