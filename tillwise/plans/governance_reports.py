"""Registered queries: rules over evaluation runs.

One run per customer: its metrics are arithmetic on the customer's key and balance, so every
rule meets every branch and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.operators import governance as G
from tillwise.operators import profiles as P
from tillwise.operators import retrieval as V
from tillwise.plans.inputs import rounded
from tillwise.plans.profile_reports import _tenant_sql, _tenants
from tillwise.plans.registry import query
from tillwise.plans.text_reports import CHUNKS
from tillwise.session import checkpointed, spread
from tillwise.sources.tables import EVAL_SCHEMA, latest_eval_run, read_eval_runs, write_eval_runs

RUNS = """
SELECT CAST(k AS STRING) AS run_id, k, CAST(CASE WHEN k % 10 = 0 THEN 0.97 ELSE (35 + k % 60) / CAST(100 AS DOUBLE) END AS DOUBLE) AS r2,
  CAST((k * 7) % 80 AS DOUBLE) AS mape, CASE k % 4 WHEN 0 THEN 900 WHEN 1 THEN 8000 ELSE 25000 END AS n_rows,
  CAST(ABS(c_acctbal) AS DECIMAL(12,2)) AS base, k % 3 = 0 AS is_flat, k % 5 = 1 AS leaky,
  CASE k % 4 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS rev_conf, k % 8 = 3 AS cov_warned,
  (60 + k % 35) / CAST(100 AS DOUBLE) AS auc, CAST((k * 11) % 70 AS DOUBLE) AS churn_rate, CASE k % 3 WHEN 0 THEN 900 ELSE 6505 END AS c_rows,
  CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS lab_conf, k % 5 = 3 AS rate_warned,
  (50 + k % 50) / CAST(100 AS DOUBLE) AS g_r2, CAST(10 + k % 30 AS INT) AS months, CAST(3 + k % 6 AS INT) AS tests,
  CAST(2 + k % 12 AS INT) AS horizon, CASE WHEN k % 2 = 0 THEN CAST(6 AS INT) END AS safe, CAST(1 + k % 200 AS INT) AS factor
FROM (SELECT c_custkey + 1 AS k, c_acctbal FROM customer) c"""


#: Runs of a task, at least and at most; each costs a good part of a millisecond.
RUN_ROWS = 1_000, 20_000


def runs(i):
    """The flat view as nested evaluation runs."""
    c, s, lit = F.col, F.struct, F.lit
    d = c("base").cast("double")
    fc = F.when(c("is_flat"), F.array(d + 1000, d + 1000.5, d + 1001)).otherwise(
        F.array(d + 500, d + 900, d + 700))
    report = lambda conf, warns: F.when(conf.isNotNull(), s(
        lit("acceptable").alias("strategy"), conf.alias("confidence"),
        F.concat(lit("Report of run "), c("run_id"), lit(". Second line. Third.")).alias("definition"),
        F.when(c("k") % 2 == 0, F.array(lit("Totals"), lit("Trends"))).alias("suitable_for"),
        F.when(c("k") % 3 == 0, F.array(lit("Single orders"))).alias("not_suitable_for"),
        warns.alias("warnings"), c("safe").alias("safe_horizon_months")))
    none = F.array().cast("array<string>")
    top = F.array(s(lit("price").alias("feature"), lit("0.5").alias("importance")),
                  s(F.when(c("leaky"), "Refund_Amount").otherwise("month").alias("feature"),
                    lit("0.2").alias("importance")))
    points = F.transform(F.sequence(lit(1), c("horizon")), lambda m: s(
        F.concat(lit("2002-"), F.lpad(m.cast("string"), 2, "0")).alias("period"),
        ((d + 705) * c("factor")).alias("forecast")))
    flat = spread(i.sql(RUNS), *RUN_ROWS)
    df = flat.select(
        "run_id",
        F.when(c("k") % 29 != 0, s(
            c("r2").alias("R2"), c("mape").alias("MAPE_pct"), c("n_rows").alias("train_rows"),
            lit(10).alias("test_rows"), fc.alias("12_period_forecast"), top.alias("top_features"),
            report(c("rev_conf"), F.when(c("cov_warned"), F.array(
                lit("High Coefficient of Variation here"))).otherwise(none)).alias("data_profile"))
               ).alias("revenue_model"),
        s(c("auc").alias("ROC_AUC"), c("churn_rate").alias("churn_rate_pct"),
          c("c_rows").alias("train_rows"), lit(5).alias("test_rows"),
          report(c("lab_conf"), F.when(c("rate_warned"), F.array(lit("Churn RATE is odd")))
                 .otherwise(none)).alias("labelling")).alias("churn_model"),
        s(c("g_r2").alias("R2"), c("months").alias("train_months"), c("tests").alias("test_months"),
          c("horizon").alias("forecast_horizon_months"), points.alias("forecast"),
          points.alias("12_month_forecast"),
          report(F.when(c("safe").isNotNull(), lit("medium")), none).alias("data_profile"))
        .alias("growth_model"))
    # the fixed run schema: absent fields become NULL
    return df.select("run_id", F.from_json(F.to_json(F.struct("revenue_model", "churn_model",
                                                              "growth_model")), EVAL_SCHEMA)
                     .alias("r")).select("run_id", "r.*")


WARN_SQL = f"""
f AS (SELECT *, k % 29 <> 0 AS has_rev, base::DOUBLE AS d,
   CASE WHEN is_flat THEN base::DOUBLE + 1000.5 ELSE base::DOUBLE + 700 END AS mean0,
   CASE WHEN is_flat THEN (base::DOUBLE + 1001) - (base::DOUBLE + 1000) ELSE (base::DOUBLE + 900) - (base::DOUBLE + 500) END AS span0,
   (base::DOUBLE + 705) * factor AS gmean, safe IS NOT NULL AND horizon <= safe AS certified,
   COALESCE(lab_conf = 'high', FALSE) AND NOT rate_warned AS vouched,
   rev_conf IS NOT NULL AND cov_warned AS cov_said FROM r),
w AS (SELECT *, concat_ws(' ## ',
  CASE WHEN has_rev AND r2 >= 0.95 THEN '1 ' || format('{{:.4f}}', r2) END,
  CASE WHEN has_rev AND span0 / mean0 < 0.02 THEN '2 ' || format('{{:.2f}}', span0) END,
  CASE WHEN has_rev AND leaky THEN '3 refund_amount' END,
  CASE WHEN churn_rate >= 40 AND NOT vouched THEN '4 ' || format('{{:.1f}}', churn_rate) END,
  CASE WHEN horizon > months / 2.0 AND NOT certified THEN '5 ' || horizon || ' ' || months END,
  CASE WHEN has_rev AND (gmean / mean0 > 100 OR gmean / mean0 < 0.01) THEN '6' END,
  CASE WHEN has_rev AND mape >= 30 AND r2 >= 0.7 AND NOT cov_said THEN '7 ' || format('{{:.1f}} {{:.3f}}', mape, r2) END) AS ws FROM f)"""


def _codes(w):
    """A warning as its number and its leading figures, for comparison with the twin."""
    ex = lambda p, g=1: F.regexp_extract(w, p, g)
    return (
        F.when(w.contains("Revenue model R²"), F.concat(F.lit("1 "), ex(r"is (\S+?)\*\*")))
        .when(w.contains("unusually flat"), F.concat(F.lit("2 "), ex(r"range \$(\S+) ")))
        .when(w.contains("target-leakage features"), F.concat(F.lit("3 "), ex(r"model\*\*: (\S+)\. ")))
        .when(w.contains("unusually high"), F.concat(F.lit("4 "), ex(r"rate of (\S+)%")))
        .when(w.contains("horizon is large"), F.concat(
            F.lit("5 "), ex(r"\((\d+) months"), F.lit(" "), ex(r"from (\d+) months")))
        .when(w.contains("Scale mismatch"), F.lit("6"))
        .when(w.contains("Revenue MAPE"), F.concat(F.lit("7 "), ex(r"is (\S+)%"), F.lit(" "),
                                                   ex(r"but R² is (\S+?)\.\*\*"))))


@query("eval_warnings", f"WITH r AS ({RUNS}), {WARN_SQL.strip()} SELECT run_id, ws AS warnings FROM w")
def _(i):
    return G.eval_warnings(runs(i)).select(
        "run_id", F.array_join(F.transform("warnings", _codes), " ## ").alias("warnings"))


LEVEL_SQL = """
l AS (SELECT *, has_rev AND (r2 >= 0.95 OR leaky) AS leak,
  CASE WHEN lab_conf = 'high' AND NOT rate_warned THEN 1 ELSE 0 END AS can_lift,
  CASE WHEN churn_rate >= 40 THEN 'low' WHEN auc >= 0.8 AND c_rows >= 5000 THEN 'high' WHEN auc >= 0.7 THEN 'medium' ELSE 'low' END AS c0 FROM f),
v AS (
 SELECT run_id, k, 'revenue' AS model, rev_conf AS conf, CASE WHEN r2 >= 0.95 THEN 'low' WHEN n_rows < 5000 OR r2 < 0.4 THEN 'low'
   WHEN n_rows >= 20000 AND r2 BETWEEN 0.65 AND 0.94 AND mape < 30 AND NOT leak THEN 'high' ELSE 'medium' END AS lv FROM l WHERE has_rev
 UNION ALL SELECT run_id, k, 'churn', lab_conf, CASE WHEN can_lift = 1 AND c0 = 'low' THEN
   CASE WHEN auc >= 0.8 AND c_rows >= 5000 THEN 'high' WHEN auc >= 0.7 THEN 'medium' ELSE c0 END ELSE c0 END FROM l
 UNION ALL SELECT run_id, k, 'growth', CASE WHEN safe IS NOT NULL THEN 'medium' END, CASE WHEN months < 24 OR tests < 6 THEN 'low'
   WHEN g_r2 >= 0.7 THEN 'medium' ELSE 'low' END FROM l),
x AS (SELECT run_id, k, model, conf, CASE WHEN conf IS NULL THEN lv WHEN 'low' IN (lv, conf) THEN 'low'
   WHEN 'medium' IN (lv, conf) THEN 'medium' ELSE 'high' END AS level FROM v)"""


@query("model_confidence", f"""WITH r AS ({RUNS}), {WARN_SQL.strip()}, {LEVEL_SQL.strip()}
SELECT run_id, model, level, CAST(CASE WHEN conf IS NULL THEN 1 ELSE 2 END AS INT) AS n_reasons,
  conf IS NOT NULL AND k % 2 = 0 AS report_scope FROM x""")
def _(i):
    return G.model_confidence(runs(i)).select(
        "run_id", "model", "level", F.size("reasons").alias("n_reasons"),
        (F.col("use_for") == "Totals; Trends").alias("report_scope"))


@query("decision_gates", f"""WITH r AS ({RUNS}), {WARN_SQL.strip()}, {LEVEL_SQL.strip()}
SELECT run_id, CASE model WHEN 'revenue' THEN 'Pricing & revenue optimisation' WHEN 'churn' THEN 'Customer retention campaigns'
   ELSE 'Growth & capacity planning' END AS decision, CASE model WHEN 'churn' THEN 'high' ELSE 'medium' END AS impact, level,
  CASE level WHEN 'high' THEN '✅ Proceed' WHEN 'medium' THEN '⚠️ Pilot only' ELSE CASE model WHEN 'churn' THEN '🚨 Escalate' ELSE '❌ Block' END END AS gate,
  CASE WHEN conf IS NOT NULL THEN CASE level WHEN 'high' THEN 'High confidence, well-validated.' WHEN 'medium' THEN
     CASE model WHEN 'churn' THEN 'Medium confidence, high impact -- validate at small scale before full rollout.' ELSE 'Validate at small scale before full rollout.' END
     ELSE CASE model WHEN 'churn' THEN 'Low confidence on a HIGH-impact decision -- requires human review before any commitment.'
       ELSE 'Address the underlying limitation before acting.' END END || ' Report of run ' || run_id || '. Second line.' END AS rationale FROM x""")
def _(i):
    conf = checkpointed(G.model_confidence(runs(i)))  # read twice
    reported = F.startswith(F.col("reasons")[0], F.lit("Report of run"))
    keep = conf.select("run_id", "model", reported.alias("reported"))
    return G.decision_gates(conf).join(keep, ["run_id", "model"]).select(
        "run_id", "decision", "impact", "level", "gate",
        F.when(F.col("reported"), F.col("rationale")).alias("rationale"))


@query("kpi_snapshot", f"""
SELECT run_id, CASE WHEN k % 29 <> 0 THEN mape END AS revenue_mape, CASE WHEN k % 29 <> 0 THEN r2 END AS revenue_r2,
  auc AS churn_roc_auc, churn_rate AS churn_rate_pct, g_r2 AS growth_r2, CAST(horizon AS INT) AS growth_points FROM ({RUNS})""")
def _(i):
    return G.kpi_snapshot(runs(i)).select(
        "run_id", "revenue_mape", "revenue_r2", "churn_roc_auc", "churn_rate_pct", "growth_r2",
        F.size("growth_forecast_12").alias("growth_points"))


def _provenance_sql(conf, horizon):
    return f"""CASE WHEN {conf} IS NOT NULL THEN E'Data behind this metric:\\n- Strategy: acceptable  (data confidence: ' || {conf} || E')\\n- Definition: Report of run ' || run_id
  || '. Second line. Third.' || {horizon} || CASE WHEN k % 2 = 0 THEN E'\\n- SUITABLE FOR: Totals; Trends' ELSE '' END
  || CASE WHEN k % 3 = 0 THEN E'\\n- NOT SUITABLE FOR: Single orders' ELSE '' END || E'\\n\\n' ELSE '' END"""


SAFE_SQL = "CASE WHEN safe IS NOT NULL THEN E'\\n- Defensible forecast horizon: ' || safe || ' months' ELSE '' END"


@query("format_model_facts", f"""
WITH r AS (SELECT *, CAST(base AS DOUBLE) AS d FROM ({RUNS}))
SELECT run_id, 'churn' AS model, {_provenance_sql("lab_conf", "''")}
  || E'CUSTOMER CHURN MODEL (classification):\\n- Dataset churn rate: ' || churn_rate || E'%\\n- ROC-AUC: ' || auc
  || E' (>0.8 is strong)\\n- F1 score: N/A\\n- Precision: N/A\\n- Recall: N/A\\n- Trained on ' || format('{{:,}}', c_rows) || ' customers, tested on 5' AS facts
FROM r
UNION ALL SELECT run_id, 'revenue', {_provenance_sql("rev_conf", SAFE_SQL)}
  || E'REVENUE FORECAST MODEL (gradient-boosted regression):\\n- Target: revenue\\n- MAPE: ' || mape
  || E'% (lower is better; <5% is excellent)\\n- R squared: ' || r2 || E'\\n- RMSE: N/A\\n- Forecast bias: N/A\\n- Trained on '
  || format('{{:,}}', n_rows) || E' rows, tested on 10\\n- Next 12 periods forecast: avg $'
  || format('{{:,.2f}}', CASE WHEN is_flat THEN d + 1000.5 ELSE d + 700 END) || '/period, range $'
  || format('{{:,.2f}}', CASE WHEN is_flat THEN d + 1000 ELSE d + 500 END) || '-$'
  || format('{{:,.2f}}', CASE WHEN is_flat THEN d + 1001 ELSE d + 900 END)
  || E'\\n- Top 5 revenue drivers: price (0.5), ' || CASE WHEN leaky THEN 'Refund_Amount' ELSE 'month' END || ' (0.2)'
FROM r WHERE k % 29 <> 0
UNION ALL SELECT run_id, 'growth', {_provenance_sql("CASE WHEN safe IS NOT NULL THEN 'medium' END", SAFE_SQL)}
  || E'GROWTH FORECAST MODEL:\\n- Target: growth\\n- MAPE: N/A%\\n- R squared: ' || g_r2 || E'\\n- RMSE: N/A\\n- Trained on '
  || months || ' months, tested on ' || tests || E'\\n- Next ' || horizon || E' months forecast:\\n'
  || array_to_string(list_transform(range(1, horizon + 1), lambda m: '    2002-' || lpad(CAST(m AS VARCHAR), 2, '0') || ': $'
     || format('{{:,.0f}}', (d + 705) * factor)), E'\\n')
FROM r""")
def _(i):
    return G.format_model_facts(runs(i))


@query("ingest_kpi_snapshot", f"""
WITH {CHUNKS.strip()}
SELECT 'run ' || run_id AS source, 'ml_results' AS category, COUNT(*) AS chunks FROM ({RUNS}) GROUP BY 1
UNION ALL SELECT source, lang, COUNT(*) FROM ch GROUP BY ALL""")
def _(i):
    docs = i.table("documents")
    old = V.ingest_documents(docs.select("source", F.col("lang").alias("category"), "text"), "2001-01-01 00:00:00")
    text = V.snapshot_text(runs(i), "2001-12-31").withColumn(
        "label", F.concat(F.lit("run "), "run_id"))
    stale = V.ingest_documents(text.select(F.col("label").alias("source"), F.lit("ml_results").alias(
        "category"), "text"), "2001-06-01 00:00:00")
    out = V.ingest_kpi_snapshot(old.unionByName(stale), text, F.col("label"), "2001-12-31 00:00:00")
    return out.groupBy("source", "category").agg(F.count("*").alias("chunks"))


@query("read_eval_runs", """
SELECT '1995_' || s_suppkey AS run_id, ROUND(s_acctbal / 10000, 4) AS r2, CAST(s_nationkey AS INT) AS months FROM supplier
ORDER BY '1995_' || s_suppkey DESC LIMIT 1""")
def _(i):
    path = i.scratch()
    write_eval_runs(spread(i.table("supplier"), *RUN_ROWS).select(
        F.concat(F.lit("1995_"), "s_suppkey").alias("version"),
        F.to_json(F.struct(
            F.struct(F.round(F.col("s_acctbal") / 10000, 4).alias("R2")).alias("revenue_model"),
            F.struct(F.col("s_nationkey").alias("train_months")).alias("growth_model"))).alias("body")), path)
    return latest_eval_run(read_eval_runs(i.spark, path)).select(
        "run_id", F.col("revenue_model.R2").alias("r2"),
        F.col("growth_model.train_months").alias("months"))


BLOCKS = """
SELECT CASE part.p_partkey % 6 WHEN 0 THEN 'key_partners' WHEN 1 THEN 'cost_structure' WHEN 2 THEN 'channels' WHEN 3 THEN 'key_resources'
  WHEN 4 THEN 'customer_segments' ELSE 'revenue_streams' END AS block_id, p_partkey, p_partkey % 400 AS context_chars,
  p_size % 4 AS chunks_used, p_size % 3 AS n_sources FROM part"""


@query("block_confidence", f"""
SELECT p_partkey, CASE WHEN context_chars < 200 OR g = 1 THEN 'low' WHEN g = 2 THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT *, CASE WHEN n_sources <= 1 AND block_id IN ('key_partners', 'key_activities', 'cost_structure', 'key_resources')
   THEN GREATEST(b - 1, 1) ELSE b END AS g FROM (SELECT *, CASE WHEN chunks_used >= 2 THEN 3 WHEN chunks_used = 1 THEN 2 ELSE 1 END AS b
   FROM ({BLOCKS})))""")
def _(i):
    return G.block_confidence(i.sql(BLOCKS)).select("p_partkey", "confidence")


@query("skip_when_insufficient", _tenant_sql("""
WITH s AS (SELECT dataset, date_diff('day', MIN(order_date), MAX(order_date)) AS span, COUNT(*) AS n,
  COUNT(DISTINCT order_date)::DOUBLE / (date_diff('day', MIN(order_date), MAX(order_date)) + 1) * 100 AS cover
  FROM tenant GROUP BY dataset)
SELECT dataset, CASE WHEN span < 90 OR n < 500 OR cover < 30 THEN 'skipped_insufficient_data' ELSE 'ready' END AS status FROM s"""))
def _(i):
    t = _tenants(i)
    reports = P.revenue_profile(t, "order_date", "amount", ("dataset",))
    return G.skip_when_insufficient(t.select("dataset").distinct(), reports).select("dataset", "status")


@query("top_features", f"""
SELECT model, feature, importance, CAST(rn AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model
  ORDER BY importance DESC, feature) AS rn FROM (SELECT model, feature,
  {rounded("n::DOUBLE / SUM(n) OVER (PARTITION BY model)", 6)} AS importance
  FROM (SELECT c_mktsegment AS model, n_name AS feature, COUNT(*) AS n FROM customer
    JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL))) WHERE rn <= 10""")
def _(i):
    c = i.table("customer").join(i.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = c.groupBy(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("feature")).agg(
        F.count("*").alias("n"))
    total = n.groupBy("model").agg(F.sum("n").alias("t"))
    return G.top_features(n.join(total, "model").select(
        "model", "feature", F.round(F.col("n") / F.col("t"), 6).alias("importance")))
