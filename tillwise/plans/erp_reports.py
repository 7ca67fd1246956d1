"""Registered queries: ERP records, file sources and sinks, incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.operators import aggregates as A
from tillwise.operators import erp as E
from tillwise.plans.inputs import with_views
from tillwise.plans.registry import query
from tillwise.sources import tables as S

ORDERS = """
SELECT o_orderkey AS id, concat('S', CAST(o_orderkey AS STRING)) AS name,
  CASE WHEN o_orderkey % 20 = 0 THEN 'false' ELSE concat('[', CAST(o_custkey AS STRING), ', "Buyer ', CAST(o_custkey AS STRING), '"]') END AS partner_id,
  CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_totalprice END AS amount_total, floor(o_totalprice) * 1.0 AS amount_untaxed,
  o_totalprice - floor(o_totalprice) AS amount_tax, CAST(o_orderdate AS STRING) AS date_order,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'sale' ELSE 'draft' END AS state,
  '[2, "North"]' AS team_id, CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE '[7, "Sam"]' END AS user_id,
  CAST(o_orderdate AS STRING) AS create_date, CAST(o_orderdate AS STRING) AS write_date
FROM orders""".replace("floor(o_totalprice) * 1.0", "CAST(floor(o_totalprice) AS DOUBLE)")
INVOICES = """
SELECT o_orderkey + 10000000 AS id, concat('INV', CAST(o_orderkey AS STRING)) AS name,
  concat('[', CAST(o_custkey AS STRING), ', "Buyer ', CAST(o_custkey AS STRING), '"]') AS partner_id,
  o_totalprice AS amount_total, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS amount_untaxed,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS invoice_date, CASE WHEN o_orderkey % 2 = 0 THEN 'paid' ELSE 'not_paid' END AS payment_state,
  CASE WHEN o_orderkey % 7 = 0 THEN 'draft' ELSE 'posted' END AS state,
  CASE o_orderkey % 4 WHEN 0 THEN 'out_invoice' WHEN 1 THEN 'out_refund' ELSE 'in_invoice' END AS move_type,
  CAST(o_orderdate AS STRING) AS create_date, CAST(o_orderdate AS STRING) AS write_date FROM orders"""
LEADS = """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'false' ELSE concat('[', CAST(c_custkey AS STRING), ', "', c_name, '"]') END AS partner_id,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS expected_revenue, CAST(c_custkey % 100 AS DOUBLE) AS probability,
  concat('[', CAST(c_custkey % 4 AS STRING), ', "Stage ', CAST(c_custkey % 4 AS STRING), '"]') AS stage_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2000-02-03 04:05:06' END AS date_open, '[7, "Sam"]' AS user_id, 'false' AS team_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'lead' ELSE 'opportunity' END AS type, c_custkey % 11 <> 0 AS active,
  '1999-09-09 09:09:09' AS create_date, concat('200', CAST(c_custkey % 2 AS STRING), '-01-01 00:00:00') AS write_date FROM customer"""
PARTNERS = """
SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 3 AS INT) AS customer_rank,
  concat('[', CAST(n_nationkey AS STRING), ', "', n_name, '"]') AS country_id,
  CASE WHEN c_custkey % 9 = 0 THEN 'false' ELSE concat('[1, "', c_mktsegment, '"]') END AS industry_id,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS is_company, c_custkey % 13 <> 0 AS active,
  '1999-09-09 09:09:09' AS create_date, '1999-09-09 09:09:09' AS write_date
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

ID = "CAST(NULLIF(regexp_extract({c}, '^\\[(\\d+)', 1), '') AS BIGINT)"
NAME = "NULLIF(regexp_extract({c}, '\"(.*)\"', 1), '')"


def ref(c):
    return ID.format(c=c), NAME.format(c=c)


def _orders_sql(cols="*"):
    return f"""SELECT 'sale.order' AS source, id AS order_id, name AS order_name, date_order AS order_date,
 COALESCE(amount_total, 0) AS amount, amount_untaxed, amount_tax, state, CAST(NULL AS VARCHAR) AS payment_state,
 {ref("partner_id")[0]} AS customer_id, {ref("partner_id")[1]} AS customer_name, {ref("user_id")[0]} AS salesperson_id,
 {ref("user_id")[1]} AS salesperson_name, {ref("team_id")[0]} AS team_id, {ref("team_id")[1]} AS team_name,
 CAST(NULL AS DOUBLE) AS expected_revenue, CAST(NULL AS DOUBLE) AS probability, CAST(NULL AS VARCHAR) AS stage, create_date
 FROM ({ORDERS}) WHERE state IN ('sale', 'done')"""


INV_SQL = f"""SELECT 'account.move' AS source, id AS order_id, name AS order_name, invoice_date AS order_date,
 COALESCE(amount_total, 0) AS amount, COALESCE(amount_untaxed, 0) AS amount_untaxed,
 COALESCE(amount_total, 0) - COALESCE(amount_untaxed, 0) AS amount_tax, state, payment_state,
 {ref("partner_id")[0]} AS customer_id, {ref("partner_id")[1]} AS customer_name, CAST(NULL AS BIGINT) AS salesperson_id,
 CAST(NULL AS VARCHAR) AS salesperson_name, CAST(NULL AS BIGINT) AS team_id, CAST(NULL AS VARCHAR) AS team_name,
 CAST(NULL AS DOUBLE) AS expected_revenue, CAST(NULL AS DOUBLE) AS probability, CAST(NULL AS VARCHAR) AS stage, create_date
 FROM ({INVOICES}) WHERE state = 'posted' AND move_type IN ('out_invoice', 'out_refund')"""
LEAD_SQL = f"""SELECT 'crm.lead' AS source, id AS order_id, name AS order_name, COALESCE(date_open, create_date) AS order_date,
 COALESCE(expected_revenue, 0) AS amount, COALESCE(expected_revenue, 0) AS amount_untaxed, 0.0::DOUBLE AS amount_tax,
 CASE WHEN type = 'lead' THEN 'lead' ELSE 'opportunity' END AS state, CAST(NULL AS VARCHAR) AS payment_state,
 {ref("partner_id")[0]} AS customer_id, {ref("partner_id")[1]} AS customer_name, {ref("user_id")[0]} AS salesperson_id,
 {ref("user_id")[1]} AS salesperson_name, {ref("team_id")[0]} AS team_id, {ref("team_id")[1]} AS team_name,
 COALESCE(expected_revenue, 0) AS expected_revenue, COALESCE(probability, 0) AS probability, {ref("stage_id")[1]} AS stage, create_date
 FROM ({LEADS}) WHERE active"""
# whole numbers that may be missing are compared as doubles
NULLABLE = ["customer_id", "salesperson_id", "team_id"]


def _loose(sql):
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NULLABLE)}) FROM ({sql})"


def _dbl(df):
    return df.withColumns({c: F.col(c).cast("double") for c in NULLABLE})


def _scan(i, kind, **kw):
    src = {"orders": ORDERS, "invoices": INVOICES, "leads": LEADS, "partners": PARTNERS}[kind]
    return E.erp_scan(i.sql(src), kind, **kw)


for _kind, _src, _cond in (("leads", LEADS, "active"), ("orders", ORDERS, "state IN ('sale', 'done')"),
                           ("invoices", INVOICES, "state = 'posted' AND move_type IN ('out_invoice', 'out_refund')"),
                           ("partners", PARTNERS, "active AND customer_rank > 0")):
    @query(f"erp_scan_{_kind}", f"SELECT * FROM ({_src}) WHERE {_cond}")
    def _(i, kind=_kind):
        return _scan(i, kind)


@query("erp_incremental_since", f"""
WITH o AS ({ORDERS}), n AS ({INVOICES}), l AS ({LEADS})
SELECT 'orders' AS kind, id FROM o WHERE state IN ('sale', 'done') AND date_order >= '2001-01-15 00:00:00'
UNION ALL SELECT 'invoices', id FROM n WHERE state = 'posted' AND move_type IN ('out_invoice', 'out_refund') AND invoice_date >= '2001-01-15'
UNION ALL SELECT 'leads', id FROM l WHERE active AND write_date >= '2001-01-15 00:00:00'""")
def _(i):
    out = None
    for kind in ("orders", "invoices", "leads"):
        since = F.lit("2001-01-15 00:00:00")
        if kind == "invoices":
            since = F.lit("2001-01-15")
        src = {"orders": ORDERS, "invoices": INVOICES, "leads": LEADS}[kind]
        df = i.sql(src)
        if kind == "invoices":
            df = df.withColumn("invoice_date", F.col("invoice_date").cast("date"))
        one = E.erp_scan(df, kind, since=since).select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("erp_model_counts", f"""
SELECT 'leads' AS model, COUNT(*) AS records FROM ({LEADS}) WHERE active
UNION ALL SELECT 'orders', COUNT(*) FROM ({ORDERS}) WHERE state IN ('sale', 'done')
UNION ALL SELECT 'invoices', COUNT(*) FROM ({INVOICES}) WHERE move_type IN ('out_invoice', 'out_refund')
UNION ALL SELECT 'partners', COUNT(*) FROM ({PARTNERS}) WHERE customer_rank > 0""")
def _(i):
    return E.erp_model_counts({"leads": i.sql(LEADS), "orders": i.sql(ORDERS),
                               "invoices": i.sql(INVOICES), "partners": i.sql(PARTNERS)})


@query("erp_preview", f"""
SELECT id, name, date_order FROM ({ORDERS}) WHERE state IN ('sale', 'done') ORDER BY date_order DESC, id DESC LIMIT 20""")
def _(i):
    return E.erp_preview(i.sql(ORDERS), "orders", 20).select("id", "name", "date_order")


@query("erp_many_to_one", f"""
SELECT id, COALESCE({ref("partner_id")[0]}, -1) AS partner, COALESCE({ref("partner_id")[1]}, '') AS partner_name FROM ({ORDERS})""")
def _(i):
    return i.sql(ORDERS).select("id", F.coalesce(E.ref_id("partner_id"), F.lit(-1)).alias("partner"),
                                F.coalesce(E.ref_name("partner_id"), F.lit("")).alias("partner_name"))


@query("erp_normalise_orders", _loose(_orders_sql()))
def _(i):
    return _dbl(E.erp_normalise_orders(_scan(i, "orders")))


@query("erp_normalise_invoices", _loose(INV_SQL))
def _(i):
    return _dbl(E.erp_normalise_invoices(_scan(i, "invoices")))


@query("erp_normalise_leads", _loose(LEAD_SQL))
def _(i):
    return _dbl(E.erp_normalise_leads(_scan(i, "leads")))


def _all(i):
    return E.erp_union(_scan(i, "orders"), _scan(i, "invoices"), _scan(i, "leads"))


UNION = f"{_orders_sql()} UNION ALL {INV_SQL} UNION ALL {LEAD_SQL}"


@query("erp_union", f"""
SELECT source, state, COUNT(*) AS records, COUNT(customer_id) AS with_customer,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM ({UNION}) GROUP BY ALL""")
def _(i):
    return _all(i).groupBy("source", "state").agg(
        F.count("*").alias("records"), F.count("customer_id").alias("with_customer"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@query("erp_partner_enrich", f"""
SELECT u.source, u.order_id, {NAME.format(c="country_id")} AS country, {NAME.format(c="industry_id")} AS industry,
  CASE WHEN p.id IS NULL THEN 'unknown' ELSE CAST(COALESCE(is_company, FALSE) AS VARCHAR) END AS company
FROM ({UNION}) u LEFT JOIN ({PARTNERS}) p ON u.customer_id = p.id""")
def _(i):
    return E.erp_partner_enrich(_all(i), i.sql(PARTNERS)).select(
        "source", "order_id", "country", "industry",
        F.coalesce(F.col("is_company").cast("string"), F.lit("unknown")).alias("company"))


@query("erp_derived_columns", f"""
SELECT source, order_id, strftime(CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS order_date,
  month(CAST(order_date AS TIMESTAMP)) AS month, quarter(CAST(order_date AS TIMESTAMP)) AS quarter,
  year(CAST(order_date AS TIMESTAMP)) AS year, CAST(1 AS INT) AS quantity_sold, amount AS price FROM ({UNION})""", INT="month quarter year")
def _(i):
    out = E.erp_derived_columns(_all(i)).select(
        "source", "order_id", "order_date", "month", "quarter", "year", "quantity_sold", "price")
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))


@query("drop_invalid_rows", """
SELECT o_orderkey, CAST(d AS DATE) AS d, CAST(a AS DOUBLE) AS a FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS d,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS a FROM orders) WHERE d IS NOT NULL AND a IS NOT NULL""")
def _(i):
    raw = i.sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'soon'
      ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS d,
      CASE WHEN o_orderkey % 5 = 0 THEN 'n.a.' ELSE CAST(o_totalprice AS STRING) END AS a FROM orders""")
    return A.valid_rows(raw, "d", "a").withColumn("d", F.col("d").cast("date"))


# Streams, sources and sinks -----------------------------------------------------------------

@query("erp_incremental_stream", f"""
SELECT id, state, write_date FROM ({ORDERS}) WHERE state IN ('sale', 'done')""")
def _(i):
    from tillwise.streaming.incremental import sync_new_files, synced_records

    base, df = i.scratch(), i.sql(ORDERS)
    landing, out, marks = f"{base}/landing", f"{base}/out", f"{base}/marks"
    early = F.col("date_order") < "1999-01-01"
    df.where(early).write.mode("append").parquet(landing)
    sync_new_files(i.spark, landing, df.schema, out, marks, "orders")
    df.where(~early).write.mode("append").parquet(landing)
    sync_new_files(i.spark, landing, df.schema, out, marks, "orders")
    return synced_records(i.spark, out).select("id", "state", "write_date")


@query("read_csv_encoded", """
SELECT c_custkey, 'caf' || chr(233) || ' ' || c_mktsegment AS label, c_acctbal FROM customer""")
def _(i):
    from tillwise.sources.tables import read_csv_encoded

    path = i.scratch()
    df = i.table("customer").select("c_custkey", F.concat(
        F.lit("café "), "c_mktsegment").alias("label"), "c_acctbal")
    df.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv_encoded(i.spark, path, "c_custkey long, label string, c_acctbal double")


@query("erp_snapshot_stream", f"""
SELECT id, state, write_date FROM ({ORDERS}) WHERE state IN ('sale', 'done')""")
def _(i):
    """Two loads and a repeated one into a snapshot in buckets."""
    from tillwise.streaming.incremental import merge_batch, snapshot_records, sync_snapshot

    base, df = i.scratch(), i.sql(ORDERS)
    landing, out, marks = f"{base}/landing", f"{base}/out", f"{base}/marks"
    early = F.col("date_order") < "1999-01-01"
    df.where(early).write.mode("append").parquet(landing)
    sync_snapshot(i.spark, landing, df.schema, out, marks, "orders", buckets=8)
    df.where(~early).write.mode("append").parquet(landing)
    sync_snapshot(i.spark, landing, df.schema, out, marks, "orders", buckets=8)
    merge_batch(df.where("state IN ('sale', 'done') AND id % 50 = 0"), 2, out, buckets=8)  # sent again
    return snapshot_records(i.spark, out, df.schema).select("id", "state", "write_date")


CHARSET_LABELS = {"UTF-8": "上海 naïve, עמדה", "ISO-8859-1": "crème brûlée", "windows-1252": "“5 €” – naïve",
                  "windows-1256": "عميل جديد, پاريس", "UTF-16LE": "مرحبا ج 上", "UTF-16BE": "Њ 上海"}


@query("read_csv_charsets", f"""
SELECT c_custkey, CASE c_custkey % 6 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(CHARSET_LABELS.values()))}
  END || ' ' || c_mktsegment AS label, c_acctbal FROM customer""")
def _(i):
    """A folder of files in six charsets, read together."""
    path = i.scratch()
    for k, (charset, label) in enumerate(CHARSET_LABELS.items()):
        some = i.table("customer").where(F.col("c_custkey") % 6 == k).select(
            "c_custkey", F.concat(F.lit(label + " "), "c_mktsegment").alias("label"), "c_acctbal")
        S.write_csv_encoded(some, path, charset, "append")
    return S.read_csv_encoded(i.spark, path, "c_custkey long, label string, c_acctbal double")


@query("file_charsets", """
SELECT * FROM (VALUES ('ISO-8859-1'), ('UTF-16BE'), ('UTF-16LE'), ('UTF-8'), ('windows-1252'), ('windows-1256')) t(charset)
WHERE EXISTS (SELECT 1 FROM customer)""")
def _(i):
    from tillwise.sources.charsets import file_charsets

    path = i.scratch()
    for k, (charset, label) in enumerate(CHARSET_LABELS.items()):
        some = i.table("customer").where(F.col("c_custkey") % 6 == k).select(
            "c_custkey", F.concat(F.lit(label + " "), "c_mktsegment").alias("label"))
        S.write_csv_encoded(some, path, charset, "append")
    return file_charsets(i.spark, path).select("charset").distinct()


@query("write_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(i):
    path = i.scratch()
    S.write_csv(i.table("part").select("p_partkey", "p_name", "p_retailprice"), path)
    return S.read_csv_encoded(i.spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("write_cleaned", "SELECT o_orderkey, o_totalprice, CAST(4 AS INT) AS upload_id FROM orders")
def _(i):
    path = i.scratch()
    df = i.table("orders").select("o_orderkey", "o_totalprice")
    S.write_cleaned(df, path, 4)
    try:
        S.write_cleaned(df, path, 4)
    except Exception as e:  # noqa: BLE001 - the second write has to fail
        assert "PATH_ALREADY_EXISTS" in str(e)
    else:
        raise AssertionError("an existing cleaned table was overwritten")
    return S.read_table(i.spark, path)


@query("read_table", "SELECT o_orderstatus, COUNT(*) AS orders FROM orders GROUP BY 1")
def _(i):
    return S.read_table(i.spark, f"{i.dir}/orders.parquet").groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"))


@query("write_aggregates", with_views("""
SELECT 'customer' AS view, COUNT(DISTINCT customer_id) AS row_count FROM tx
UNION ALL SELECT 'monthly', COUNT(DISTINCT date_trunc('month', order_date)) FROM tx"""))
def _(i):
    path, tx = i.scratch(), i.view("tx")
    for _again in range(2):
        S.write_aggregates(A.customer_summary(tx, "customer_id", "order_date"),
                           A.monthly_aggregate(tx, "order_date", "amount"), path)
    count = lambda v: i.spark.read.parquet(f"{path}/{v}").agg(
        F.count("*").alias("row_count")).select(F.lit(v).alias("view"), "row_count")
    return count("customer").unionByName(count("monthly"))


@query("write_report_json", """
SELECT o_orderstatus, COUNT(*) AS orders, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 1.5::DOUBLE END AS score
FROM orders GROUP BY 1""")
def _(i):
    path = i.scratch()
    rep = i.table("orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders")).withColumn(
        "score", F.when(F.col("o_orderstatus") == "F", float("nan")).otherwise(1.5))
    S.write_report_json(rep, path)
    return S.read_data_report(i.spark, path, "o_orderstatus string, orders long, score double", False)


@query("read_documents", "SELECT 'policies' AS category, text FROM benchmark WHERE trim(text) <> ''")
def _(i):
    path = i.scratch()
    i.table("benchmark").select("item_id", "text").write.partitionBy("item_id").option(
        "lineSep", "\u0001").text(path)
    out = S.read_documents(i.spark, path, "policies")
    return out.select("category", F.regexp_replace("text", "\u0001$", "").alias("text"))


@query("read_data_report", """
SELECT o_orderpriority AS dataset, COUNT(*) AS row_count, 'ready' AS status FROM orders GROUP BY 1""")
def _(i):
    path = i.scratch()
    assert S.read_data_report(i.spark, path) is None
    rep = i.table("orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.count("*").alias("row_count"))
    S.write_report_json(rep, path)
    return S.read_data_report(i.spark, path, "dataset string, row_count long", False).withColumn(
        "status", F.lit("ready"))
