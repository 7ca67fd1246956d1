"""Registered queries: type detection, cleaning, laws, date features, quality."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tillwise.functions.vocab import DATE_PLACEHOLDERS, PLACEHOLDERS
from tillwise.operators import cleaning as C
from tillwise.operators import coltypes as Y
from tillwise.operators import features as X
from tillwise.operators import laws as L
from tillwise.operators import quality as Q
from tillwise.operators.coltypes import TypePlan
from tillwise.operators.rules import apply_rules
from tillwise.plans.inputs import rounded, with_views
from tillwise.plans.registry import query

# Raw text table with every kind of written value
RAW = """
SELECT concat(' ', CAST(o_orderkey AS STRING), ' ') AS order_id,
  CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' WHEN o_orderkey % 9 = 1 THEN 'soon'
       WHEN o_orderkey % 4 = 0 THEN concat(substr(d, 6, 2), '/', substr(d, 9, 2), '/', substr(d, 1, 4))
       ELSE d END AS order_day,
  CASE WHEN o_orderkey % 100 < 35 THEN d ELSE 'pending' END AS maybe_day,
  CASE WHEN o_orderkey % 50 = 0 THEN 'twelve' WHEN o_orderkey % 5 = 0 THEN concat('$', m)
       WHEN o_orderkey % 5 = 1 THEN concat(m, '%') ELSE m END AS amount_txt,
  CASE WHEN o_orderkey % 10 < 3 THEN 'n.a.' ELSE m END AS mixed_txt,
  concat(CAST(o_orderkey % 9 + 1 AS STRING), '.234,56') AS eu_txt,
  CASE WHEN o_orderkey % 2 = 0 THEN ' Yes' ELSE 'no' END AS is_gift,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS flag01,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL
       WHEN o_orderkey % 8 = 1 THEN ' ?? ' ELSE concat('  ', o_orderpriority, '  Class ') END AS class_txt,
  year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS ymd_day,
  CAST(o_orderkey % 40 AS DOUBLE) AS whole_dbl, o_totalprice AS frac_dbl
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
             CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS m FROM orders) t
"""
RAW_TEXT = ["order_day", "maybe_day", "amount_txt", "mixed_txt", "eu_txt", "is_gift", "flag01",
            "class_txt"]


def _in(words):
    return ", ".join("'" + w + "'" for w in words)


def _profile(i, columns):
    return Y.decide_types(Y.type_profile(i.sql(RAW).select(*columns)))


def _per_column(cols, body):
    return f"WITH raw AS ({RAW}) " + " UNION ALL ".join(
        body.replace("$C", c) for c in cols)


DUCK_DATE = ("CASE WHEN regexp_matches(trim($C), '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN "
             "try_strptime(trim($C), '%Y-%m-%d') WHEN regexp_matches(trim($C), "
             "'^\\d{1,2}/\\d{1,2}/\\d{4}$') THEN try_strptime(trim($C), '%m/%d/%Y') END")
STRIP = "trim(regexp_replace(regexp_replace($C, '[,%]', '', 'g'), '[$€£¥₹]', '', 'g'))"
DUCK_NUM = f"TRY_CAST(CASE WHEN lower({STRIP}) = 'twelve' THEN '12' ELSE {STRIP} END AS DOUBLE)"


@query("detect_dates", _per_column(RAW_TEXT, f"""
SELECT '$C' AS column_name, COUNT(*) FILTER (real) AS n_checked,
  COUNT(*) FILTER (real AND dt IS NOT NULL) AS n_dates,
  COUNT(*) FILTER (real AND dt IS NOT NULL) >= 0.4 * COUNT(*) FILTER (real) AS is_date
FROM (SELECT $C IS NOT NULL AND lower(trim($C)) NOT IN ({_in(DATE_PLACEHOLDERS)}) AS real,
             {DUCK_DATE} AS dt FROM raw)"""))
def _(i):
    return _profile(i, RAW_TEXT).select(
        "column_name", "n_checked", "n_dates",
        (F.col("detected_type") == "date").alias("is_date"))


# The day of each order, written in one of many forms; of the last four, a month or an hour is all that is said
WRITTEN_DAYS = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 16 AS form, year(o_orderdate) AS y,
  month(o_orderdate) AS m, day(o_orderdate) AS n,
  split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',',
             CAST(month(o_orderdate) AS INT)) AS long_name FROM orders"""
WRITTEN = f"""
SELECT o_orderkey, form, d, y, m, CASE form WHEN 0 THEN CAST(d AS STRING) WHEN 1 THEN concat(y, '/', m, '/', n)
  WHEN 2 THEN concat(m, '/', n, '/', y) WHEN 3 THEN concat(n, ' ', long_name, ' ', y)
  WHEN 4 THEN concat(long_name, ' ', n, ', ', y) WHEN 5 THEN concat(n, '-', substr(long_name, 1, 3), '-', y)
  WHEN 6 THEN CAST(y * 10000 + m * 100 + n AS STRING) WHEN 7 THEN concat(CAST(d AS STRING), 'T00:00:00')
  WHEN 8 THEN concat('Mon, ', n, ' ', substr(long_name, 1, 3), ' ', y) WHEN 9 THEN concat('Tuesday, ', long_name, ' ', n, ', ', y)
  WHEN 10 THEN concat(y, '.', m, '.', n) WHEN 11 THEN concat(n, 'th ', long_name, ' ', y)
  WHEN 12 THEN substr(CAST(d AS STRING), 1, 7) WHEN 13 THEN concat(m, '/', y) WHEN 14 THEN concat(long_name, ' ', y)
  ELSE concat(CAST(d AS STRING), 'T10') END AS written FROM ({WRITTEN_DAYS})"""


@query("read_written_dates", f"""
SELECT o_orderkey, CASE WHEN form BETWEEN 12 AND 14 THEN CAST(make_date(y, m, 1) AS TIMESTAMP)
  WHEN form = 15 THEN d + INTERVAL 10 HOUR ELSE CAST(d AS TIMESTAMP) END AS day FROM ({WRITTEN_DAYS})""")
def _(i):
    return i.sql(WRITTEN).select("o_orderkey", Y.parse_date("written").alias("day"))


@query("detect_numeric", _per_column(["maybe_day", "amount_txt", "mixed_txt", "is_gift", "flag01",
                                      "class_txt"], f"""
SELECT '$C' AS column_name, COUNT($C) AS n_values, COUNT(num) AS n_numbers,
  COUNT(num) >= 0.8 * COUNT($C) AS is_numeric FROM (SELECT $C, {DUCK_NUM} AS num FROM raw)"""))
def _(i):
    return _profile(i, ["maybe_day", "amount_txt", "mixed_txt", "is_gift", "flag01", "class_txt"]).select(
        "column_name", "n_values", "n_numbers",
        (F.col("detected_type") == "numeric").alias("is_numeric"))


@query("detect_european_decimal", _per_column(["amount_txt", "eu_txt", "mixed_txt"], """
SELECT '$C' AS column_name, COUNT(*) FILTER (regexp_matches(b, '^-?(\\d{1,3}\\.)*\\d{1,3},\\d+$')) AS n_eu,
  COUNT(*) FILTER (regexp_matches(b, '^-?(\\d{1,3},)*\\d{1,3}\\.\\d+$')) AS n_us,
  COUNT(*) FILTER (regexp_matches(b, '^-?(\\d{1,3}\\.)*\\d{1,3},\\d+$'))
    > COUNT(*) FILTER (regexp_matches(b, '^-?(\\d{1,3},)*\\d{1,3}\\.\\d+$')) AS is_european
FROM (SELECT regexp_replace(trim($C), '[$€£¥₹\\s]', '', 'g') AS b FROM raw)"""))
def _(i):
    return _profile(i, ["amount_txt", "eu_txt", "mixed_txt"]).select(
        "column_name", "n_eu", "n_us", "is_european")


@query("detect_boolean", _per_column(["is_gift", "class_txt", "maybe_day"], """
SELECT '$C' AS column_name, COUNT($C) AS n_values,
  COUNT(*) FILTER (lower(trim($C)) IN ('true','yes','1','صح','نعم','false','no','0','غلط','لا')) AS n_bool,
  COUNT(*) FILTER (lower(trim($C)) IN ('true','yes','1','صح','نعم','false','no','0','غلط','لا'))
    = COUNT($C) AS is_boolean FROM raw"""))
def _(i):
    return _profile(i, ["is_gift", "class_txt", "maybe_day"]).select(
        "column_name", "n_values", "n_bool",
        (F.col("detected_type") == "boolean").alias("is_boolean"))


@query("detect_yyyymmdd", _per_column(["ymd_day", "whole_dbl", "frac_dbl"], """
SELECT '$C' AS column_name, COUNT(*) FILTER ($C BETWEEN 19000101 AND 21001231) AS n_ymd_range,
  COUNT(*) FILTER ($C BETWEEN 19000101 AND 21001231 AND
    try_strptime(CAST(CAST($C AS BIGINT) AS VARCHAR), '%Y%m%d') IS NOT NULL) AS n_ymd,
  COUNT(*) FILTER ($C BETWEEN 19000101 AND 21001231) >= 0.8 * COUNT($C) AS is_ymd FROM raw"""))
def _(i):
    return _profile(i, ["ymd_day", "whole_dbl", "frac_dbl"]).select(
        "column_name", "n_ymd_range", "n_ymd", "is_ymd")


@query("detect_integer_intent", _per_column(["whole_dbl", "frac_dbl"], """
SELECT '$C' AS column_name, COUNT(*) FILTER ($C = floor($C)) AS n_whole,
  bool_and($C = floor($C)) AS is_integer FROM raw"""))
def _(i):
    return _profile(i, ["whole_dbl", "frac_dbl"]).select(
        "column_name", "n_whole", "is_integer")


@query("cast_types", f"""
SELECT trim(order_id) AS order_id, strftime({DUCK_DATE.replace("$C", "order_day")}, '%Y-%m-%d') AS order_day,
  maybe_day, {DUCK_NUM.replace("$C", "amount_txt")} AS amount_txt, mixed_txt,
  CAST(replace(replace(eu_txt, '.', ''), ',', '.') AS DOUBLE) AS eu_txt,
  trim(is_gift) = 'Yes' AS is_gift, CAST(flag01 AS DOUBLE) AS flag01, class_txt,
  strftime(strptime(CAST(ymd_day AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS ymd_day, whole_dbl, frac_dbl
FROM ({RAW})""")
def _(i):
    raw = i.sql(RAW)
    out = Y.cast_types(raw, Y.plan_types(raw))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("order_day", "ymd_day")})


@query("redetect_dates", f"""
SELECT trim(order_id) AS order_id, strftime({DUCK_DATE.replace("$C", "late_day")}, '%Y-%m-%d') AS late_day
FROM (SELECT order_id, CASE WHEN maybe_day = 'pending' THEN NULL ELSE maybe_day END AS late_day
      FROM ({RAW}))""")
def _(i):
    raw = i.sql(RAW).select(F.trim("order_id").alias("order_id"), F.when(
        F.col("maybe_day") != "pending", F.col("maybe_day")).alias("late_day"))
    out, _plan = Y.redetect_dates(raw, TypePlan({"order_id": "id", "late_day": "text"}))
    return out.withColumn("late_day", F.date_format("late_day", "yyyy-MM-dd"))


@query("text_normalise", f"""
SELECT trim(order_id) AS order_id,
  lower(trim(regexp_replace(class_txt, '\\s+', ' ', 'g'))) AS class_txt FROM ({RAW})""")
def _(i):
    raw = i.sql(RAW).select("order_id", "class_txt")
    return C.text_normalise(raw, TypePlan({"order_id": "id", "class_txt": "text"}))


@query("garbage_to_null", f"""
SELECT order_id, CASE WHEN lower(t) NOT IN ({_in(PLACEHOLDERS)}) THEN t END AS class_txt
FROM (SELECT order_id, trim(class_txt) AS t FROM ({RAW}))""")
def _(i):
    raw = i.sql(RAW).select("order_id", F.trim("class_txt").alias("class_txt"))
    return C.garbage_to_null(raw, ["class_txt"])


DUPES = """
SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders
UNION ALL SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 29 = 0"""


@query("dedup_rows", f"SELECT DISTINCT * FROM ({DUPES})")
def _(i):
    return C.dedup_rows(i.sql(DUPES))


PEOPLE = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'male' WHEN 2 THEN 'f' ELSE 'mrs.' END
  AS gender, CASE c_custkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'wed' ELSE 'it is complicated' END
  AS marital_status, CASE c_nationkey % 5 WHEN 0 THEN 'egypt' WHEN 1 THEN 'uk' WHEN 2 THEN 'deu'
  WHEN 3 THEN 'peru' ELSE NULL END AS country, c_name AS country_guide,
  lower(c_mktsegment) AS gender_note
FROM customer"""


@query("standardise_categories", f"""
SELECT c_custkey, CASE WHEN gender IN ('m', 'male') THEN 'male' ELSE 'female' END AS gender,
  CASE marital_status WHEN 's' THEN 'single' WHEN 'wed' THEN 'married' ELSE marital_status END
    AS marital_status, CASE country WHEN 'egypt' THEN '5' WHEN 'uk' THEN '3' WHEN 'deu' THEN '2'
    ELSE country END AS country, country_guide, gender_note FROM ({PEOPLE})""")
def _(i):
    return C.standardise_categories(i.sql(PEOPLE), [
        "gender", "marital_status", "country", "country_guide", "gender_note"])


# Order lines with missing cells, negatives, outliers and bad dates
LINES = """
SELECT l_orderkey AS order_key, l_linenumber AS line_no,
  CASE WHEN l_linenumber % 7 = 0 OR l_orderkey % 13 = 0 THEN NULL
       WHEN l_orderkey % 17 = 0 THEN -l_quantity WHEN l_orderkey % 101 = 0 THEN l_quantity * 100
       ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 34 = 0 THEN -l_extendedprice
       ELSE l_extendedprice END AS total_amount,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN 900.5
       ELSE (l_partkey % 50) * 0.5 END AS mass_kg,
  CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_returnflag END AS sparse_note,
  CASE WHEN l_orderkey % 10 = 3 THEN NULL WHEN l_returnflag = 'R' THEN 'returned' ELSE 'shipped' END
    AS ship_state,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linenumber % 3 = 0 END AS gift_wrap,
  CASE WHEN l_orderkey % 23 = 0 THEN DATE '1850-01-01' WHEN l_orderkey % 19 = 0
       THEN CAST(l_shipdate AS DATE) + 9 ELSE CAST(l_shipdate AS DATE) END AS start_date,
  CASE WHEN l_orderkey % 29 = 0 THEN DATE '2222-02-02' ELSE CAST(l_shipdate AS DATE) + 5 END AS end_date
FROM lineitem"""
LINES = LINES.replace("900.5", "CAST(900.5 AS DOUBLE)").replace("* 0.5", "* CAST(0.5 AS DOUBLE)")
LINE_PLAN = TypePlan(
    {"order_key": "id", "line_no": "id", "quantity": "numeric", "total_amount": "numeric",
     "mass_kg": "numeric", "sparse_note": "text", "ship_state": "text", "gift_wrap": "boolean",
     "start_date": "date", "end_date": "date"}, integers={"quantity"})
IDS = "order_key, line_no"


@query("fit_mask", with_views("""
WITH cut AS (SELECT order_date AS c FROM tx ORDER BY order_date
  LIMIT 1 OFFSET (SELECT CAST(FLOOR(COUNT(*) * 0.7) AS BIGINT) - 1 FROM tx))
SELECT order_id, order_date <= c AS is_fit FROM tx, cut"""))
def _(i):
    tx = i.view("tx")
    return tx.select("order_id", C.fit_mask(tx, 0.7, "order_date").alias("is_fit"))


def _impute_sql(where="", quantity=True):
    q = "COALESCE(quantity, mq)" if quantity else "quantity"
    return f"""
WITH l AS ({LINES}), f AS (SELECT * FROM l {where}),
s AS (SELECT median(quantity) AS mq, median(mass_kg) AS mk,
        (SELECT ship_state FROM f WHERE ship_state IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS ms,
        (SELECT gift_wrap FROM f WHERE gift_wrap IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS mg
      FROM f)
SELECT {IDS}, {q} AS quantity, total_amount, COALESCE(mass_kg, mk) AS mass_kg, sparse_note,
  COALESCE(ship_state, ms) AS ship_state, COALESCE(gift_wrap, mg) AS gift_wrap FROM l, s"""


@query("impute_missing", _impute_sql("WHERE order_key % 10 < 8"))
def _(i):
    df = i.sql(LINES)
    model = C.fit_imputer(df, LINE_PLAN, F.col("order_key") % 10 < 8)
    return C.impute_missing(df, model).drop("start_date", "end_date")


@query("target_exclusion", _impute_sql(quantity=False))
def _(i):
    df = i.sql(LINES)
    return C.impute_missing(df, C.fit_imputer(df, LINE_PLAN, target="quantity")).drop(
        "start_date", "end_date")


@query("missing_report", f"WITH l AS ({LINES}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS missing, "
    f"ROUND(COUNT(*) FILTER ({c} IS NULL)::DOUBLE / COUNT(*) * 100, 2) AS pct, '{s}' AS strategy FROM l"
    for c, s in (("quantity", "median"), ("total_amount", "kept missing: monetary"),
                 ("mass_kg", "median"), ("sparse_note", "skipped: sparse"),
                 ("ship_state", "mode"), ("gift_wrap", "mode"))))
def _(i):
    df = i.sql(LINES)
    return C.missing_report(df, C.fit_imputer(df, LINE_PLAN))


NEG = f"""
WITH l AS ({LINES}),
e AS (SELECT *, quantity < 0 AND NOT (COALESCE(total_amount < 0, FALSE)
        OR COALESCE(regexp_matches(ship_state, '(?i)return|refund|cancel|void|revers|credit|chargeback'), FALSE)
        OR COALESCE(regexp_matches(sparse_note, '(?i)return|refund|cancel|void|revers|credit|chargeback'), FALSE))
      AS bad FROM l)"""


@query("validate_non_negative", NEG + f""",
m AS (SELECT median(CASE WHEN NOT COALESCE(bad, FALSE) THEN quantity END) AS mq FROM e)
SELECT {IDS}, total_amount, COALESCE(CASE WHEN NOT COALESCE(bad, FALSE) THEN quantity END, mq) AS quantity
FROM e, m""")
def _(i):
    df = i.sql(LINES)
    return C.validate_non_negative(df, C.fit_non_negative(df, LINE_PLAN)).select(
        "order_key", "line_no", "total_amount", "quantity")


@query("sign_report", NEG + """
SELECT 'quantity' AS column_name, COUNT(*) FILTER (quantity < 0) AS negative_values,
  COUNT(*) FILTER (quantity < 0 AND NOT bad) AS kept_as_return, COUNT(*) FILTER (bad) AS replaced FROM e""")
def _(i):
    df = i.sql(LINES)
    return C.sign_report(df, C.fit_non_negative(df, LINE_PLAN))


@query("validate_date_order", f"""
WITH l AS ({LINES})
SELECT {IDS}, CASE WHEN start_date > end_date THEN NULL ELSE start_date END AS start_date,
  CASE WHEN start_date > end_date THEN NULL ELSE end_date END AS end_date FROM l""")
def _(i):
    return C.validate_date_order(i.sql(LINES), ["start_date", "end_date"]).select(
        "order_key", "line_no", "start_date", "end_date")


AS_OF = datetime.date(2001, 12, 31)


@query("validate_date_range", f"""
WITH l AS ({LINES})
SELECT {IDS}, CASE WHEN start_date BETWEEN DATE '1900-01-01' AND DATE '2011-12-31' THEN start_date END AS start_date,
  CASE WHEN end_date BETWEEN DATE '1900-01-01' AND DATE '2011-12-31' THEN end_date END AS end_date FROM l""")
def _(i):
    return C.validate_date_range(i.sql(LINES), ["start_date", "end_date"], AS_OF).select(
        "order_key", "line_no", "start_date", "end_date")


@query("derive_total_sales", f"""
SELECT {IDS}, quantity, unit_sales, unit_sales * quantity AS "Total Sales"
FROM (SELECT *, mass_kg * 2 AS unit_sales FROM ({LINES}))""")
def _(i):
    df = i.sql(LINES).select("order_key", "line_no", "quantity",
                             (F.col("mass_kg") * 2).alias("unit_sales"))
    return C.derive_total_sales(df, ["quantity", "unit_sales"])


CAPS = f"""
WITH l AS ({LINES}),
q AS (SELECT quantile_cont(quantity, [0.25, 0.75]) AS a, quantile_cont(mass_kg, [0.25, 0.75]) AS b,
   abs(skewness(quantity)) AS sa, abs(skewness(mass_kg)) AS sb FROM l WHERE order_key % 10 < 8),
m AS (SELECT *, CASE WHEN sa >= 2 THEN 3.0 WHEN sa >= 1 THEN 2.0 ELSE 1.5 END::DOUBLE AS ma,
   CASE WHEN sb >= 2 THEN 3.0 WHEN sb >= 1 THEN 2.0 ELSE 1.5 END::DOUBLE AS mb FROM q),
c AS (SELECT floor(a[1] - ma * (a[2] - a[1])) AS qlo, ceil(a[2] + ma * (a[2] - a[1])) AS qhi,
   b[1] - mb * (b[2] - b[1]) AS klo, b[2] + mb * (b[2] - b[1]) AS khi FROM m)"""


@query("cap_outliers_iqr", CAPS + f"""
SELECT {IDS}, CASE WHEN quantity IS NOT NULL THEN round(least(greatest(quantity, qlo), qhi)) END AS quantity,
  CASE WHEN mass_kg IS NOT NULL THEN least(greatest(mass_kg, klo), khi) END AS mass_kg, total_amount
FROM l, c""")
def _(i):
    df = i.sql(LINES)
    bounds = C.fit_outlier_bounds(df, LINE_PLAN, F.col("order_key") % 10 < 8)
    return C.cap_outliers_iqr(df, bounds, LINE_PLAN.integers).select(
        "order_key", "line_no", "quantity", "mass_kg", "total_amount")


@query("outlier_report", CAPS + """
SELECT * FROM (SELECT 'quantity' AS column_name, COUNT(*) FILTER (quantity < qlo) AS low,
  COUNT(*) FILTER (quantity > qhi) AS high FROM l, c
UNION ALL SELECT 'mass_kg', COUNT(*) FILTER (mass_kg < klo), COUNT(*) FILTER (mass_kg > khi) FROM l, c)
WHERE low + high > 0""")
def _(i):
    df = i.sql(LINES)
    return C.outlier_report(df, C.fit_outlier_bounds(
        df, LINE_PLAN, F.col("order_key") % 10 < 8)).drop("lower_cap", "upper_cap")


@query("clip_series_iqr", with_views(f"""
WITH m AS (SELECT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS month_key,
             CAST(SUM(amount) AS DOUBLE) AS r FROM tx GROUP BY ALL),
q AS (SELECT customer_id, quantile_cont(r, [0.25, 0.75]) AS q FROM m GROUP BY 1)
SELECT customer_id, month_key, ROUND(LEAST(GREATEST(r, q[1] - (q[2] - q[1]) * 1.5), q[2] + (q[2] - q[1]) * 1.5), 6)
  AS monthly_revenue FROM m JOIN q USING (customer_id)"""))
def _(i):
    from tillwise.operators.aggregates import monthly_aggregate

    m = monthly_aggregate(i.view("tx"), "order_date", "amount", ("customer_id",)).drop("monthly_orders")
    return C.clip_series_iqr(m, by=("customer_id",)).select(
        "customer_id", "month_key", F.round("monthly_revenue", 6).alias("monthly_revenue"))


@query("narrow_types", """
SELECT CAST(p_partkey AS INT) AS p_partkey, CAST(p_size AS SMALLINT) AS p_size, p_retailprice,
  CAST(CAST(p_size AS FLOAT) / 2 AS FLOAT) AS half_size FROM part""")
def _(i):
    df = i.table("part").select("p_partkey", "p_size", "p_retailprice",
                                (F.col("p_size") / 2).alias("half_size"))
    out = C.narrow_types(df)
    kinds = dict(out.dtypes)
    assert kinds["p_size"] == "smallint" and kinds["p_retailprice"] == "double", kinds
    return out.withColumn("p_partkey", F.col("p_partkey").cast("int"))


# Laws ---------------------------------------------------------------------------------------

LAW_ROWS = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_orderkey % 31 = 1 THEN NULL ELSE l_quantity END AS units,
  CASE WHEN l_orderkey % 31 = 2 THEN NULL ELSE p_retailprice END AS unit_price,
  CASE WHEN l_orderkey % 31 = 3 THEN NULL ELSE l_quantity * p_retailprice END AS gross_value,
  CASE WHEN l_orderkey % 31 = 4 THEN NULL ELSE l_discount END AS rebate,
  CASE WHEN l_orderkey % 31 = 5 THEN NULL ELSE l_tax END AS levy,
  CASE WHEN l_orderkey % 31 = 6 THEN NULL ELSE l_discount + l_tax END AS both_shares
FROM lineitem JOIN part ON l_partkey = p_partkey"""
LAW_COLS = ["units", "unit_price", "gross_value", "rebate", "levy", "both_shares"]


def _law_sql():
    order = {c: k for k, c in enumerate(LAW_COLS)}
    values = ", ".join(f"('{c}', {k})" for c, k in order.items())
    pick = lambda a: "CASE " + " ".join(f"WHEN {a} = {k} THEN {c}" for c, k in order.items()) + " END"
    return f"""
WITH r AS ({LAW_ROWS}), n(name, k) AS (VALUES {values}),
tr AS (SELECT a.name AS base_a, a.k AS i, b.name AS base_b, b.k AS j, c.name AS derived, c.k AS z FROM n a, n b, n c
       WHERE a.k <> b.k AND a.k <> c.k AND b.k <> c.k),
v AS (SELECT base_a, i, base_b, j, derived, {pick("i")} AS x, {pick("j")} AS y, {pick("z")} AS w FROM r, tr),
k AS (SELECT *, GREATEST(ABS(w), 1e-9) AS s FROM v WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL),
o AS (SELECT base_a, base_b, derived, i, j, bool_or(w < 0) AS can_be_negative, COUNT(*) AS n,
   COUNT(*) FILTER (ABS(y) > 1e-9) AS nd,
   COUNT(*) FILTER (ABS(w - (x + y)) / s < 1e-4) AS ha, COUNT(*) FILTER (ABS(w - (x - y)) / s < 1e-4) AS hs,
   COUNT(*) FILTER (ABS(w - x * y) / s < 1e-4) AS hm,
   COUNT(*) FILTER (ABS(y) > 1e-9 AND ABS(w - x / NULLIF(y, 0)) / s < 1e-4) AS hd FROM k GROUP BY ALL),
u AS (SELECT base_a, base_b, derived, can_be_negative, 'addition' AS op, n AS support, ha AS h FROM o WHERE i < j
 UNION ALL SELECT base_a, base_b, derived, can_be_negative, 'subtraction', n, hs FROM o
 UNION ALL SELECT base_a, base_b, derived, can_be_negative, 'multiplication', n, hm FROM o WHERE i < j
 UNION ALL SELECT base_a, base_b, derived, can_be_negative, 'division', nd, hd FROM o)
SELECT base_a, base_b, derived, op, {rounded("h::DOUBLE / support", 5)} AS confidence, support, can_be_negative
FROM u WHERE support >= 50 AND h >= 0.99 * support"""


@query("law_discovery", _law_sql())
def _(i):
    return L.law_discovery(i.sql(LAW_ROWS), LAW_COLS).drop("seq")


def _resolution_sql():
    """All laws found, the better ones first for each derived column, then one form of each family."""
    at = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(LAW_COLS)) + " END"
    return f"""
WITH c AS (SELECT *, (({at("base_a")} * {len(LAW_COLS)} + {at("base_b")}) * {len(LAW_COLS)} + {at("derived")}) * 4
    + CASE op WHEN 'addition' THEN 0 WHEN 'subtraction' THEN 1 WHEN 'multiplication' THEN 2 ELSE 3 END AS seq,
    CASE op WHEN 'multiplication' THEN 3 WHEN 'addition' THEN 2 WHEN 'subtraction' THEN 1 ELSE 0 END AS rank,
    CASE WHEN op IN ('addition', 'subtraction') THEN 'additive' ELSE 'multiplicative' END AS family,
    list_sort([base_a, base_b, derived]) AS members FROM ({_law_sql()})),
p AS (SELECT *, row_number() OVER (PARTITION BY derived ORDER BY confidence DESC, rank DESC, seq) AS place,
    MIN(seq) OVER (PARTITION BY derived) AS first_seq FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY members, family, place = 1
    ORDER BY CASE WHEN op IN ('addition', 'multiplication') THEN 0 ELSE 1 END, first_seq) AS form FROM p)
SELECT base_a, base_b, derived, op, CASE WHEN place > 1 THEN 'displaced' WHEN form > 1 THEN 'rearrangement' ELSE 'kept' END
  AS outcome FROM f"""


@query("law_resolution", _resolution_sql())
def _(i):
    return L.law_resolution(L.law_discovery(i.sql(LAW_ROWS), LAW_COLS)).select(
        "base_a", "base_b", "derived", "op", "outcome")


LAWS = [L.Law("units", "unit_price", "gross_value", "multiplication", False),
        L.Law("rebate", "levy", "both_shares", "addition", False)]


@query("relational_impute", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  COALESCE(units, round_even(CASE WHEN gross_value / unit_price >= 0 THEN gross_value / unit_price END, 0)) AS units,
  COALESCE(unit_price, CASE WHEN gross_value / NULLIF(units, 0) >= 0 THEN gross_value / NULLIF(units, 0) END) AS unit_price,
  COALESCE(gross_value, units * unit_price) AS gross_value,
  COALESCE(rebate, CASE WHEN both_shares - levy >= 0 THEN both_shares - levy END) AS rebate,
  COALESCE(levy, CASE WHEN both_shares - rebate >= 0 THEN both_shares - rebate END) AS levy,
  COALESCE(both_shares, rebate + levy) AS both_shares FROM ({LAW_ROWS})""")
def _(i):
    df = i.sql(LAW_ROWS)
    laws = L.kept_laws(L.law_resolution(L.law_discovery(df, LAW_COLS)))
    return L.relational_impute(df, laws, {"units"})


@query("constraint_sync", f"""
SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(gross_value, units * unit_price) AS gross_value,
  COALESCE(rebate, 0.01::DOUBLE) AS rebate, COALESCE(both_shares, rebate + levy) AS both_shares
FROM ({LAW_ROWS})""")
def _(i):
    out = L.constraint_sync(i.sql(LAW_ROWS), LAWS, {"rebate": "cast(0.01 as double)", "absent": "1"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "gross_value", "rebate",
                      "both_shares")


@query("custom_rule_impute", f"""
SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(gross_value, units * unit_price) AS gross_value,
  units * unit_price - rebate AS net_value FROM ({LAW_ROWS})""")
def _(i):
    out, errors = L.custom_rule_impute(i.sql(LAW_ROWS), {
        "gross_value": "units * unit_price",
        "net_value": lambda df: df["units"] * df["unit_price"] - df["rebate"],
        "broken": "no_such_column + 1"})
    assert [e[0] for e in errors] == ["broken"], errors
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "gross_value", "net_value")


FAULTY_ROWS = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS gross, CAST(l_linenumber - 1 AS DOUBLE) AS earlier,
  CASE WHEN l_orderkey % 7 = 0 THEN 'n/a' WHEN l_orderkey % 7 = 1 THEN NULL
       ELSE CAST(l_suppkey AS VARCHAR(20)) END AS supplier_text,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS units FROM lineitem"""
RULES = {"per_line": "gross / earlier", "supplier": "cast(supplier_text as double)",
         "units": lambda df: df["gross"] / df["earlier"] + df["supplier"],
         "small": "cast(l_orderkey * 1000000 as int)", "broken": "no_such_column + 1"}
FAULTY = f"""
SELECT l_orderkey, l_linenumber, per_line, supplier, coalesce(units, per_line + supplier) AS units, units AS units_given,
  supplier_text, CASE WHEN l_orderkey * 1000000 <= 2147483647 THEN CAST(l_orderkey * 1000000 AS INT) END AS small
FROM (SELECT *, gross / NULLIF(earlier, 0) AS per_line, TRY_CAST(supplier_text AS DOUBLE) AS supplier
      FROM ({FAULTY_ROWS}))"""


@query("custom_rule_rows", f"SELECT * EXCLUDE (units_given, supplier_text) FROM ({FAULTY})")
def _(i):
    """Rules that raise on some rows fill all others."""
    run = apply_rules(i.sql(FAULTY_ROWS), RULES)
    return run.data.select("l_orderkey", "l_linenumber", "per_line", "supplier", "units", "small")


@query("custom_rule_report", f"""
WITH f AS ({FAULTY})
SELECT 'per_line' AS rule, 0::BIGINT AS given, COUNT(per_line) AS filled, 0::BIGINT AS empty,
  COUNT(*) - COUNT(per_line) AS failed, NULL::VARCHAR AS error FROM f
UNION ALL SELECT 'supplier', 0, COUNT(supplier), COUNT(*) - COUNT(supplier_text),
  COUNT(*) FILTER (supplier IS NULL AND supplier_text IS NOT NULL), NULL FROM f
UNION ALL SELECT 'units', COUNT(units_given), COUNT(units) - COUNT(units_given),
  COUNT(*) FILTER (units IS NULL AND per_line IS NOT NULL),
  COUNT(*) FILTER (units IS NULL AND per_line IS NULL), NULL FROM f
UNION ALL SELECT 'small', 0, COUNT(small), 0, COUNT(*) - COUNT(small), NULL FROM f
UNION ALL SELECT 'broken', 0, 0, 0, 0, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'""")
def _(i):
    return apply_rules(i.sql(FAULTY_ROWS), RULES).report()


@query("custom_rule_failed_rows", f"""
WITH f AS ({FAULTY})
SELECT 'per_line' AS rule, l_orderkey, l_linenumber FROM f WHERE per_line IS NULL
UNION ALL SELECT 'supplier', l_orderkey, l_linenumber FROM f WHERE supplier IS NULL AND supplier_text IS NOT NULL
UNION ALL SELECT 'units', l_orderkey, l_linenumber FROM f WHERE units IS NULL AND per_line IS NULL
UNION ALL SELECT 'small', l_orderkey, l_linenumber FROM f WHERE small IS NULL""")
def _(i):
    return apply_rules(i.sql(FAULTY_ROWS), RULES).failed_rows("l_orderkey", "l_linenumber")


# Date features ------------------------------------------------------------------------------

HOLES = """
SELECT o_orderkey AS row_num, o_orderpriority AS priority, o_totalprice AS amount,
  CAST(o_orderkey % 37 AS DOUBLE) AS boxes,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_day,
  CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) - 9 END AS due_day
FROM orders"""


@query("date_parts", f"""
SELECT row_num, COALESCE(year(order_day), -1) AS "order_day_Year", COALESCE(month(order_day), -1) AS "order_day_Month",
  COALESCE(day(order_day), -1) AS "order_day_Day", COALESCE(isodow(order_day) - 1, -1) AS "order_day_DayOfWeek",
  COALESCE(quarter(order_day), -1) AS "order_day_Quarter",
  COALESCE(CAST(isodow(order_day) >= 6 AS INT), -1) AS "order_day_Is_Weekend",
  COALESCE(CAST(order_day = last_day(order_day) AS INT), -1) AS "order_day_Is_MonthEnd",
  COALESCE(dayname(order_day), 'Unknown') AS "order_day_DayName",
  COALESCE(CASE WHEN month(order_day) IN (12, 1, 2) THEN 'Winter' WHEN month(order_day) <= 5 THEN 'Spring'
   WHEN month(order_day) <= 8 THEN 'Summer' WHEN order_day IS NOT NULL THEN 'Autumn' END, 'Unknown') AS "order_day_Season"
FROM ({HOLES})""", INT="order_day_Year order_day_Month order_day_Day order_day_DayOfWeek order_day_Quarter")
def _(i):
    return X.date_parts(i.sql(HOLES).select("row_num", "order_day"), "order_day").drop("order_day")


@query("date_deltas", f"""
SELECT row_num, CAST(COALESCE(date_diff('day', order_day, due_day), -1) AS INT) AS due_day_days_from_order_day
FROM ({HOLES})""")
def _(i):
    return X.date_deltas(i.sql(HOLES), "order_day", ["due_day"]).select(
        "row_num", "due_day_days_from_order_day")


@query("select_primary_date", f"""
SELECT 'order_day' AS column_name, 2 + COUNT(order_day)::DOUBLE / COUNT(*) AS score FROM ({HOLES})
UNION ALL SELECT 'due_day', COUNT(due_day)::DOUBLE / COUNT(*) FROM ({HOLES})""")
def _(i):
    return X.primary_date_scores(i.sql(HOLES), ["due_day", "order_day"]).drop("position")


@query("select_group_column", """
SELECT 'p_type' AS column_name, COUNT(DISTINCT p_type) AS unique_values, 10 + 3 AS score FROM part
UNION ALL SELECT 'p_brand', COUNT(DISTINCT p_brand), 10 FROM part""")
def _(i):
    return X.group_column_scores(i.table("part"), ["p_name", "p_brand", "p_type"]).select(
        "column_name", "unique_values", "score")


LAG_SQL = f"""
WITH h AS ({HOLES}), k AS (SELECT * FROM h WHERE order_day IS NOT NULL)
SELECT row_num, CAST(COALESCE(date_diff('day', LAG(order_day) OVER w, order_day), -1) AS INT) AS days_since_last_order_day,
  COALESCE(LAG(amount) OVER w, -1) AS lag_1_amount, COALESCE(LAG(amount, 3) OVER w, -1) AS lag_3_amount,
  COALESCE(LAG(boxes) OVER w, -1) AS lag_1_boxes, COALESCE(LAG(boxes, 3) OVER w, -1) AS lag_3_boxes
FROM k WINDOW w AS ($P ORDER BY order_day, row_num)
UNION ALL SELECT row_num, -1, -1, -1, -1, -1 FROM h WHERE order_day IS NULL"""


@query("group_lag_features", LAG_SQL.replace("$P", "PARTITION BY priority"))
def _(i):
    return X.group_lag_features(i.sql(HOLES), "order_day", "row_num", ["amount", "boxes"],
                                "priority").drop("priority", "amount", "boxes", "order_day", "due_day")


@query("global_lag_features", LAG_SQL.replace("$P", ""))
def _(i):
    return X.group_lag_features(i.sql(HOLES), "order_day", "row_num", ["amount", "boxes"]).drop(
        "priority", "amount", "boxes", "order_day", "due_day")


@query("group_gap_days", f"""
WITH h AS ({HOLES}), k AS (SELECT * FROM h WHERE order_day IS NOT NULL)
SELECT row_num, CAST(COALESCE(date_diff('day', LAG(order_day) OVER (PARTITION BY priority ORDER BY order_day, row_num),
  order_day), -1) AS INT) AS days_since_last_order_day FROM k
UNION ALL SELECT row_num, -1 FROM h WHERE order_day IS NULL""")
def _(i):
    return X.group_gap_days(i.sql(HOLES), "order_day", "row_num", "priority").select(
        "row_num", "days_since_last_order_day")


# Quality ------------------------------------------------------------------------------------

@query("null_and_shape_metrics", f"""
SELECT COUNT(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns, COUNT(*) * 10 AS n_cells,
  COUNT(*) FILTER (quantity IS NULL) + COUNT(*) FILTER (total_amount IS NULL) + COUNT(*) FILTER (mass_kg IS NULL)
  + COUNT(*) FILTER (sparse_note IS NULL) + COUNT(*) FILTER (ship_state IS NULL)
  + COUNT(*) FILTER (gift_wrap IS NULL) AS null_cells, CAST(2 AS BIGINT) AS text_columns FROM ({LINES})""")
def _(i):
    return Q.null_and_shape_metrics(i.sql(LINES))


KEYS = """
SELECT CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 2 * CAST(o_orderkey % 3 = 0 AS INT)
  END AS order_id, o_custkey AS cust_key FROM orders"""


def _pk_sql(c):
    return f"""SELECT '{c}' AS column_name, CAST(COALESCE(SUM(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count,
  CAST(COALESCE(SUM(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_count,
  (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM g_{c} WHERE n > 1 AND v IS NOT NULL ORDER BY v LIMIT 10))
  AS sample_duplicates FROM g_{c}"""


@query("pk_integrity", f"""
WITH k AS ({KEYS}), g_order_id AS (SELECT CAST(order_id AS VARCHAR) AS v, COUNT(*) AS n FROM k GROUP BY 1),
g_cust_key AS (SELECT CAST(cust_key AS VARCHAR) AS v, COUNT(*) AS n FROM k GROUP BY 1)
{_pk_sql("order_id")} UNION ALL {_pk_sql("cust_key")}""")
def _(i):
    return Q.pk_integrity(i.sql(KEYS), ["order_id", "cust_key"])


@query("encoding_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS unique_values, CASE WHEN COUNT(DISTINCT {c}) <= 10
 THEN 'One-Hot Encoding' WHEN COUNT(DISTINCT {c}) <= 50 THEN 'Label Encoding' ELSE 'Target Encoding / Drop' END
 AS recommendation FROM part""" for c in ("p_type", "p_brand", "p_name")))
def _(i):
    return Q.encoding_report(i.table("part"), ["p_type", "p_brand", "p_name"])


CORR = """
SELECT l_quantity AS quantity, l_extendedprice AS price, l_quantity * l_quantity * l_quantity AS cube,
  l_discount AS discount, CAST(3 AS DOUBLE) AS constant FROM lineitem"""


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"


@query("correlation_pairs", f"""
WITH c AS ({CORR}), r AS (SELECT *, {_rank("quantity")}, {_rank("price")}, {_rank("cube")}, {_rank("discount")} FROM c),
p AS ({" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, abs(corr({a}, {b})) AS p, abs(corr(r_{a}, r_{b})) AS s FROM r"
 for k, a in enumerate(("quantity", "price", "cube", "discount"))
 for b in ("quantity", "price", "cube", "discount")[k + 1:])})
SELECT col_a, col_b, ROUND(p, 3) AS pearson, ROUND(s, 3) AS spearman,
  CASE WHEN p >= s THEN 'pearson' ELSE 'spearman' END AS method FROM p WHERE p >= 0.85 OR s >= 0.85""")
def _(i):
    return Q.correlation_pairs(i.sql(CORR), ["quantity", "price", "cube", "discount", "constant"])


@query("quality_score", f"""
WITH l AS ({LINES}), b AS (SELECT COUNT(*) AS n,
  COUNT(*) FILTER (quantity IS NULL) + COUNT(*) FILTER (mass_kg IS NULL) + COUNT(*) FILTER (ship_state IS NULL)
  + COUNT(*) FILTER (gift_wrap IS NULL) AS filled,
  COUNT(*) FILTER (total_amount IS NULL) + COUNT(*) FILTER (sparse_note IS NULL) AS stays FROM l),
d AS (SELECT COUNT(*) AS u FROM (SELECT DISTINCT * FROM l))
SELECT {rounded("GREATEST(0, 100 - ((filled + stays)::DOUBLE / (n * 10) * 150 + (n - u)::DOUBLE / n * 150 + 2 * 5))", 1)} AS before,
  {rounded("LEAST(100, GREATEST(0, 100 - (stays::DOUBLE / (n * 10) * 200 + 2 + 0.5)))", 1)} AS after FROM b, d""")
def _(i):
    df = i.sql(LINES)
    raw = Q.null_and_shape_metrics(df)
    distinct = C.dedup_rows(df).agg(F.count("*").alias("u"))
    clean = C.impute_missing(df, C.fit_imputer(df, LINE_PLAN))
    after = Q.null_and_shape_metrics(clean).select(F.col("null_cells").alias("na"),
                                                   F.col("n_cells").alias("ca"))
    s = raw.withColumns({"u": distinct.scalar(), "na": after.select("na").scalar(),
                         "ca": after.select("ca").scalar()})
    b, a = Q.quality_score(F.col("null_cells"), F.col("n_cells"), F.col("n_rows") - F.col("u"),
                           F.col("n_rows"), 2, 0, F.col("na"), F.col("ca"), 1, 1, 0, 0)
    return s.select(b.alias("before"), a.alias("after"))


def _clean_run(i):
    from tillwise.plans.clean_table import clean_table

    raw = i.sql(RAW).withColumn("line", F.trim("order_id").cast("long"))
    return clean_table(raw, AS_OF, row_id="line")


@query("clean_table")
def _(i):
    return _clean_run(i).data


@query("clean_table_report")
def _(i):
    return _clean_run(i).report
