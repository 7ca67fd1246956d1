"""Registered queries: name rules over column catalogues, mapping, registry tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tillwise.functions.vocab import (
    DASHBOARD_CANDIDATES, FEATURE_SYNONYMS, MODEL_FEATURES, ROLE_SYNONYMS, TOPIC_WORDS,
)
from tillwise.operators import catalog as K
from tillwise.operators import mapping as M
from tillwise.operators import records as R
from tillwise.plans.inputs import VIEWS, with_views
from tillwise.plans.registry import query

# Column names of uploaded files: each customer is one upload, each order one column
NAMES = ("customer_id,Order Date,order_amount,Qty,Category,is_returned,rating,total_units,"
         "Unit Price,discount_pct,season,profit_margin,order_month,fiscal_quarter,tenure,orders,"
         "lifetime_value,aov,days_between,returns_rate,sku_count,review_score,category_count,"
         "daily_spend,clv,revenue,prev_month_revenue,mom,yoy,signup_date,invoice_date,created_at,"
         "notes,status,Gender,country,lag_1_total_revenue_egp,days_since_last_order_date,"
         "order_date_month,product_name,internet_usage,user id,ref_code,SKU Code,start_date,"
         "end_dt,birth_date,payment_method,cart_size,tax_vat")

VIEWS["headers"] = f"""
SELECT upload_id, column_name, MIN(seq) AS position FROM (
  SELECT o_custkey AS upload_id, o_orderkey AS seq,
         split_part('{NAMES}', ',', CAST((o_orderkey * 7 + o_custkey) % 50 + 1 AS INT)) AS column_name
  FROM orders) h GROUP BY upload_id, column_name
"""
VIEWS["catalog"] = """
SELECT upload_id, column_name, position,
       CASE WHEN position % 4 = 0 THEN 'text' WHEN position % 4 = 1 THEN 'date' ELSE 'numeric' END
         AS column_type,
       column_name LIKE 'lag\\_%' ESCAPE '\\' AS is_lag,
       column_name IN ('order_date_month', 'days_since_last_order_date') AS is_date_part,
       column_name = 'revenue' AS is_target
FROM headers
"""
VIEWS["catalog"] = VIEWS["catalog"].replace(
    "column_name LIKE 'lag\\_%' ESCAPE '\\'", "substr(column_name, 1, 4) = 'lag_'")


def _headers(i):
    return i.sql(VIEWS["headers"])


def _catalog(i):
    return i.sql(with_views("SELECT * FROM catalog").replace(
        "WITH catalog AS", f"WITH headers AS ({VIEWS['headers'].strip()}), catalog AS"))


def _sql(body):
    """Views that other views use come first."""
    pre = f"headers AS ({VIEWS['headers'].strip()})"
    if "catalog" in body:
        pre += f", catalog AS ({VIEWS['catalog'].strip()})"
    body = body.strip()
    return f"WITH {pre}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {pre} {body}"


ID_RX = "^(id|code|no|num|number|key|ref)$|_(id|code|no|num|number|key|ref)$|^(id|code|no|num|number|key|ref)_"
MONEY_RX = ("price|revenue|balance|cost|amount|salary|wage|pay|benefit|fee|income|profit|total|"
            "gross|net|earnings|spend|sales|invoice|rate|charge|value|discount|tax|penalty|fine|"
            "installment|emi|budget|commission|expense|capital|loan|debt|bonus|incentive|deposit|"
            "allowance|fare|funding")


@query("detect_id_columns", _sql(f"""
SELECT upload_id, column_name,
  regexp_matches(replace(lower(column_name), ' ', '_'), '{ID_RX}') AS is_id FROM headers"""))
def _(i):
    return K.detect_id_columns(_headers(i)).drop("position")


@query("classify_monetary", _sql(f"""
SELECT upload_id, column_name,
  regexp_matches(replace(lower(column_name), ' ', '_'), '{MONEY_RX}') AS is_monetary FROM headers"""))
def _(i):
    return K.classify_monetary(_headers(i)).drop("position")


DISPLAY = """array_to_string(list_transform(string_split_regex(
  CASE WHEN regexp_matches(column_name, '(?i)^lag_(\\d+)_(.+)$')
    THEN regexp_extract(column_name, '(?i)^lag_(\\d+)_(.+)$', 2) || ' (Lag ' ||
         regexp_extract(column_name, '(?i)^lag_(\\d+)_(.+)$', 1) || ')'
    ELSE trim(replace(column_name, '_', ' ')) END, '\\s+'),
  lambda w: CASE WHEN length(w) <= 3 AND upper(w) IN ('EGP','USD','ID','SKU','SLA','QTY','VAT')
    THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"""


@query("display_name", _sql(f"""
SELECT column_name, {DISPLAY} AS display_name, COUNT(*) AS uploads FROM headers
GROUP BY column_name"""))
def _(i):
    return _headers(i).groupBy("column_name", K.display_name("column_name").alias(
        "display_name")).agg(F.count("*").alias("uploads"))


@query("column_catalog", _sql(f"""
SELECT upload_id, column_name, column_type,
  regexp_matches(replace(lower(column_name), ' ', '_'), '{MONEY_RX}') AS is_monetary,
  is_target, is_lag, is_lag OR is_date_part AS is_engineered,
  {DISPLAY} || CASE WHEN is_target THEN ' ★ Target' WHEN is_lag THEN ''
     WHEN is_date_part THEN ' (Engineered)' ELSE '' END AS display_name,
  CASE WHEN is_date_part THEN 'none' WHEN is_lag THEN 'avg' WHEN column_type = 'numeric' THEN 'sum'
     ELSE 'count_distinct' END AS agg_default FROM catalog"""))
def _(i):
    return K.column_catalog(_catalog(i))


@query("topics_from_columns", _sql(
    "SELECT upload_id, array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN bool_or(regexp_matches(lower(column_name), '{'|'.join(w)}')) THEN '{t}' END"
        for t, w in TOPIC_WORDS.items())
    + "], lambda x: x IS NOT NULL), '; ') AS topics FROM headers GROUP BY upload_id"))
def _(i):
    return K.topics_from_columns(_headers(i)).select(
        "upload_id", F.array_join("topics", "; ").alias("topics"))


# The vocabularies as SQL rows, for the twins
def _vocab_rows(entries):
    return ", ".join("('%s', '%s', %s, %s)" % (t, w, "NULL" if e is None else e,
                                               "NULL" if p is None else p)
                     for t, w, e, p in entries)


NORM = "trim(regexp_replace(lower(column_name), '[^a-z0-9]', '_', 'g'), '_')"


def _match_sql(entries, norm=NORM):
    return f"""
WITH v(target, word, er, pr) AS (VALUES {_vocab_rows(entries)}),
n AS (SELECT upload_id, {norm} AS nm, MIN(position) AS pos, arg_max(column_name, position) AS column_name
      FROM headers GROUP BY ALL),
hit AS (SELECT upload_id, target, column_name, pos,
          CASE WHEN nm = word AND er IS NOT NULL THEN er
               WHEN pr IS NOT NULL AND (contains(nm, word) OR contains(word, nm)) THEN pr END AS r
        FROM n, v),
best AS (SELECT upload_id, target, arg_min(column_name, (r, pos)) AS column_name, MIN(r) AS r
         FROM hit WHERE r IS NOT NULL GROUP BY ALL)"""


def _mapping_sql(kind):
    entries = []
    for f in MODEL_FEATURES[kind]:
        entries.append((f, f, 0, 1000))
        entries += [(f, s, 1 + 2 * k, 2 + 2 * k) for k, s in enumerate(FEATURE_SYNONYMS.get(f, []))]
    feats = ", ".join(f"('{f}')" for f in MODEL_FEATURES[kind])
    return _match_sql(entries) + f""",
dt AS (SELECT upload_id, arg_min(column_name, position) AS d FROM headers
  WHERE regexp_matches({NORM}, 'date|created_at|timestamp|month_label') GROUP BY 1),
mp AS (SELECT u.upload_id, f.feature,
   CASE WHEN b.column_name IS NULL AND d IS NOT NULL AND feature IN ('month', 'quarter')
        THEN '_from_date:' || d ELSE b.column_name END AS source_column,
   CASE WHEN b.column_name IS NULL THEN CASE WHEN d IS NOT NULL AND feature IN ('month', 'quarter')
          THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END
        WHEN r = 0 THEN 1.0::DOUBLE WHEN r = 1000 THEN 0.6::DOUBLE WHEN r % 2 = 1 THEN 0.9::DOUBLE
        ELSE 0.75::DOUBLE END AS confidence
 FROM (SELECT DISTINCT upload_id FROM headers) u CROSS JOIN (VALUES {feats}) f(feature)
 LEFT JOIN best b ON b.upload_id = u.upload_id AND b.target = f.feature
 LEFT JOIN dt ON dt.upload_id = u.upload_id)"""


for _kind in MODEL_FEATURES:
    _name = "suggest_mapping" if _kind == "revenue" else f"suggest_mapping_{_kind}"

    @query(_name, _sql(_mapping_sql(_kind) + " SELECT * FROM mp"))
    def _(i, kind=_kind):
        return K.suggest_mapping(_headers(i), kind)


@query("unmapped_columns", _sql(_mapping_sql("churn") + """
SELECT upload_id, column_name FROM headers h WHERE NOT EXISTS (SELECT 1 FROM mp
  WHERE mp.upload_id = h.upload_id AND mp.source_column = h.column_name)"""))
def _(i):
    h = _headers(i)
    return K.unmapped_columns(h, K.suggest_mapping(h, "churn")).drop("position")


@query("missing_features", _sql(_mapping_sql("churn") + """
SELECT upload_id, feature FROM mp WHERE source_column IS NULL"""))
def _(i):
    return K.missing_features(K.suggest_mapping(_headers(i), "churn"))


def _plain(w):
    return w.lower().replace("_", "")


@query("detect_roles", _sql(_match_sql(
    [(r, s, k, 1000 + k) for r, ws in ROLE_SYNONYMS.items() for k, s in enumerate(ws)])
    + " SELECT upload_id, target AS role, column_name FROM best"))
def _(i):
    return K.detect_roles(_headers(i))


@query("detect_dashboard_columns", _sql(_match_sql(
    [(r, _plain(s), k, None) for r, ws in DASHBOARD_CANDIDATES.items() for k, s in enumerate(ws)],
    "regexp_replace(lower(column_name), '[_ -]', '', 'g')")
    + " SELECT upload_id, target AS metric, column_name FROM best"))
def _(i):
    return K.detect_dashboard_columns(_headers(i))


@query("find_date_column", _sql(f"""
SELECT upload_id, arg_min(column_name, position) AS date_column FROM headers
WHERE regexp_matches({NORM}, 'date|created_at|timestamp|month_label') GROUP BY 1"""))
def _(i):
    return K.find_date_column(_headers(i))


# Mapping to model inputs --------------------------------------------------------------------

AS_OF = datetime.date(2001, 8, 15)
MESSY = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 11 = 0 THEN 'n.a'
            ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS Qty,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS OrderAmount,
       l_discount AS Disc, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate END AS ShipDate
FROM lineitem"""
MAPPING = {"quantity_sold": "Qty", "price": "OrderAmount", "discount_percent": "Disc",
           "seasonal_index": None, "gross_margin_pct": "NotThere",
           "month": "_from_date:ShipDate", "quarter": "_from_date:ShipDate"}
MAPPED_SQL = f"""
m AS (SELECT l_orderkey, l_linenumber, COALESCE(TRY_CAST(NULLIF(Qty, '') AS DOUBLE), 1.0) AS quantity_sold,
  COALESCE(OrderAmount, 0.0) AS price, COALESCE(Disc, 0.0) AS discount_percent,
  1.0::DOUBLE AS seasonal_index, 0.3::DOUBLE AS gross_margin_pct,
  COALESCE(CAST(month(ShipDate) AS DOUBLE), 8.0) AS month,
  COALESCE(CAST(quarter(ShipDate) AS DOUBLE), 3.0) AS quarter FROM ({MESSY}))"""


@query("apply_mapping", f"WITH {MAPPED_SQL.strip()} SELECT * FROM m")
def _(i):
    return M.apply_mapping(i.sql(MESSY), MAPPING, "revenue", AS_OF, ("l_orderkey", "l_linenumber"))


@query("pad_revenue_features", f"""WITH {MAPPED_SQL.strip()}
SELECT *, 2001.0::DOUBLE AS year, 33.0::DOUBLE AS week_of_year, 2.0::DOUBLE AS day_of_week,
  0.0::DOUBLE AS is_weekend, 0.0::DOUBLE AS product_category,
  price * (1 - discount_percent / 100) AS discounted_price, price * (1 - gross_margin_pct) AS cost_of_goods,
  4.0::DOUBLE AS rating, 5.0::DOUBLE AS review_count, 0.0::DOUBLE AS revenue_lag_7d FROM m""")
def _(i):
    m = M.apply_mapping(i.sql(MESSY), MAPPING, "revenue", AS_OF, ("l_orderkey", "l_linenumber"))
    return M.pad_revenue_features(m, MODEL_FEATURES["revenue"] + [
        "year", "week_of_year", "day_of_week", "is_weekend", "product_category",
        "discounted_price", "cost_of_goods", "rating", "review_count", "revenue_lag_7d"], AS_OF)


@query("pad_zero_features", f"""
SELECT l_orderkey, l_linenumber, COALESCE(TRY_CAST(NULLIF(Qty, '') AS DOUBLE), 0.0) AS Qty,
  COALESCE(OrderAmount, 0.0) AS OrderAmount, 0.0::DOUBLE AS total_items FROM ({MESSY})""")
def _(i):
    return M.pad_zero_features(i.sql(MESSY), ["Qty", "OrderAmount", "total_items"]).select(
        "l_orderkey", "l_linenumber", "Qty", "OrderAmount", "total_items")


# Registry tables ----------------------------------------------------------------------------

UPLOADS = """
SELECT event_id AS upload_id, user_id, ts AS uploaded_at,
       CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ''
            ELSE concat('cleaned_upload_', CAST(event_id AS STRING)) END AS table_name,
       concat(event_type, '-report_q', CAST(event_id % 4 AS STRING), '.csv') AS file_name,
       CASE WHEN event_type = 'view' THEN 'erp' ELSE 'file' END AS category,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'failed'
            ELSE 'completed' END AS status,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(FLOOR(value * 100) AS BIGINT) END AS rows_count
FROM events"""
PREDICTIONS = """
SELECT event_id AS prediction_id, user_id, event_id % 997 AS upload_id, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'revenue' WHEN 'click' THEN 'churn'
            WHEN 'purchase' THEN 'growth' ELSE 'other' END AS model_kind,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'click' THEN (event_id % 1000) / 1000.0
            ELSE value * 37 END AS value
FROM events"""
PREDICTIONS = PREDICTIONS.replace("/ 1000.0", "/ CAST(1000 AS DOUBLE)")
VERSIONS = """
SELECT event_id AS mapping_id, event_id AS calibrator_id, event_id % 997 AS upload_id, user_id,
       CASE event_type WHEN 'view' THEN 'revenue' WHEN 'click' THEN 'churn' ELSE 'growth' END
         AS model_kind, ts AS created_at FROM events WHERE event_type <> 'error'"""


@query("latest_upload_per_user", f"""
WITH u AS ({UPLOADS}), ok AS (SELECT * FROM u WHERE table_name IS NOT NULL AND table_name <> ''),
o AS (SELECT user_id, arg_max(upload_id, (uploaded_at, upload_id)) AS id FROM ok GROUP BY user_id)
SELECT c.user_id, COALESCE(o.id, (SELECT arg_max(upload_id, (uploaded_at, upload_id)) FROM ok)) AS upload_id
FROM (SELECT c_custkey AS user_id FROM customer) c LEFT JOIN o ON c.user_id = o.user_id""")
def _(i):
    users = i.table("customer").select(F.col("c_custkey").alias("user_id"))
    return R.latest_upload_per_user(i.sql(UPLOADS), users).select("user_id", "upload_id")


@query("latest_active_version", f"""
WITH v AS ({VERSIONS})
SELECT mapping_id, upload_id, model_kind,
  ROW_NUMBER() OVER (PARTITION BY upload_id, model_kind ORDER BY created_at DESC, mapping_id DESC) = 1
    AS is_active FROM v""")
def _(i):
    return R.mark_active(i.sql(VERSIONS), ["upload_id", "model_kind"], "created_at",
                         "mapping_id").select("mapping_id", "upload_id", "model_kind", "is_active")


@query("join_upload_history", f"""
WITH v AS ({VERSIONS}), p AS ({PREDICTIONS}),
m AS (SELECT upload_id, model_kind, arg_max(mapping_id, (created_at, mapping_id)) AS mapping_id
      FROM v GROUP BY ALL),
c AS (SELECT user_id, model_kind, arg_max(calibrator_id, (created_at, calibrator_id)) AS calibrator_id
      FROM v GROUP BY ALL)
SELECT prediction_id, COALESCE(CAST(mapping_id AS DOUBLE), -1) AS mapping_id,
  COALESCE(CAST(calibrator_id AS DOUBLE), -1) AS calibrator_id
FROM p LEFT JOIN m USING (upload_id, model_kind) LEFT JOIN c USING (user_id, model_kind)""")
def _(i):
    v = i.sql(VERSIONS)
    out = R.join_upload_history(i.sql(PREDICTIONS), v, v)
    miss = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c)
    return out.select("prediction_id", miss("mapping_id"), miss("calibrator_id"))


@query("history_top_n", f"""
SELECT user_id, prediction_id, model_kind FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, prediction_id DESC) AS rn FROM ({PREDICTIONS})) WHERE rn <= 50""")
def _(i):
    return R.history_top_n(i.sql(PREDICTIONS), 50, "created_at", "prediction_id").select(
        "user_id", "prediction_id", "model_kind")


@query("prediction_summary", f"""
SELECT prediction_id, CASE WHEN value IS NULL THEN 'Prediction completed.'
 WHEN model_kind = 'revenue' THEN 'Predicted revenue: $' || format('{{:,.2f}}', value)
 WHEN model_kind = 'churn' THEN 'Churn risk: ' || CASE WHEN value >= 0.7 THEN 'high'
   WHEN value >= 0.4 THEN 'medium' ELSE 'low' END || ' (' || format('{{:.1f}}', value * 100) || '%)'
 WHEN model_kind = 'growth' THEN '3-month forecast: $' || format('{{:,.2f}}', value)
 ELSE 'Prediction completed.' END AS summary FROM ({PREDICTIONS})""")
def _(i):
    from tillwise.operators.scoring import risk_level

    return i.sql(PREDICTIONS).select("prediction_id", R.prediction_summary(
        "model_kind", "value", risk_level("value")).alias("summary"))


@query("list_datasets", f"""
SELECT upload_id AS id, array_to_string(list_transform(string_split(regexp_replace(
   regexp_replace(file_name, '\\.[^.]*$', ''), '[-_]', ' ', 'g'), ' '),
   lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, file_name AS file, table_name,
   COALESCE(rows_count, 0) AS rows, COALESCE(status, 'completed') AS status, user_id
FROM ({UPLOADS})""")
def _(i):
    return R.list_datasets(i.sql(UPLOADS)).drop("uploaded_at")


@query("sync_stats", f"""
SELECT strftime(MAX(uploaded_at) FILTER (status = 'completed'), '%Y-%m-%d %H:%M:%S') AS last_sync,
  COUNT(*) AS uploads FROM ({UPLOADS}) WHERE category = 'erp'""")
def _(i):
    return R.sync_stats(i.sql(UPLOADS)).select(
        F.date_format("last_sync", "yyyy-MM-dd HH:mm:ss").alias("last_sync"), "uploads")


@query("catalog_upsert", _sql("""
SELECT upload_id, column_name, CASE WHEN position % 3 = 0 THEN 'boolean' ELSE column_type END
  AS column_type FROM catalog"""))
def _(i):
    old = _catalog(i).select("upload_id", "column_name", "column_type",
                             F.lit(1).alias("revision"), "position")
    new = old.where("position % 3 = 0").withColumns(
        {"column_type": F.lit("boolean"), "revision": F.lit(2)})
    return R.upsert(old, new, ["upload_id", "column_name"], ["revision"]).drop(
        "revision", "position")


@query("delete_dataset_rows", f"""
SELECT prediction_id, upload_id FROM ({PREDICTIONS}) WHERE upload_id NOT IN
  (SELECT upload_id FROM ({UPLOADS}) WHERE status = 'failed')""")
def _(i):
    gone = i.sql(UPLOADS).where("status = 'failed'")
    return R.delete_dataset_rows(i.sql(PREDICTIONS), gone).select("prediction_id", "upload_id")


@query("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def _(i):
    return R.preview_rows(i.table("orders"), ["o_orderkey"], 800)


@query("preview_counts", with_views("""
WITH c AS (SELECT DISTINCT customer_id FROM tx),
m AS (SELECT DISTINCT date_trunc('month', order_date) AS k FROM tx)
SELECT 'cleaned' AS view, COUNT(*) AS total_rows,
  'order_id, customer_id, order_date, amount, category, status' AS columns FROM tx
UNION ALL SELECT 'customer', COUNT(*), 'customer_id, first_order, last_order, total_orders, '
  || 'customer_tenure_days, avg_days_between_orders' FROM c
UNION ALL SELECT 'monthly', COUNT(*), 'month_key, monthly_revenue, monthly_orders' FROM m"""))
def _(i):
    from tillwise.operators import aggregates as A

    tx = i.view("tx")
    return R.preview_counts({
        "cleaned": tx, "customer": A.customer_summary(tx, "customer_id", "order_date"),
        "monthly": A.monthly_aggregate(tx, "order_date", "amount")})


@query("aggregate_rows_preview", with_views("""
SELECT CAST(m AS VARCHAR) AS label, CAST(n AS VARCHAR) AS orders FROM (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, COUNT(*) AS n FROM tx GROUP BY 1)
ORDER BY m LIMIT 500"""))
def _(i):
    from tillwise.operators import aggregates as A

    out = R.aggregate_rows_preview(
        A.monthly_aggregate(i.view("tx"), "order_date", "amount"), "month_key")
    return out.select("label", F.col("features")["monthly_orders"].alias("orders"))
