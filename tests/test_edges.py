"""Edge cases on small hand-made frames."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tillwise.functions import text as T
from tillwise.operators import aggregates as A
from tillwise.operators import catalog as K
from tillwise.operators import churn as C
from tillwise.operators import cleaning as L
from tillwise.operators import coltypes as Y
from tillwise.operators import mapping as M
from tillwise.operators import retrieval as V
from tillwise.operators.scoring import recency_adjust, risk_level

D = datetime.date


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_types_of_written_values(spark):
    rows = [("1", "yes", "5 Jan 2020", "ten", f"{k}.5", "x") for k in range(3)]
    rows += [("0", "No", "2020-02-03T04:05:06Z", "$1,234.5", "n/a", "y")]
    df = spark.createDataFrame(rows, ["flag", "gift", "day", "price", "share", "ref_code"])
    plan = Y.plan_types(df)
    assert plan.types == {"flag": "numeric", "gift": "boolean", "day": "date", "price": "numeric",
                          "share": "text", "ref_code": "id"}
    got = Y.cast_types(df, plan).orderBy("price").collect()
    assert got[-1].price == 1234.5 and got[0].price == 10.0
    assert got[-1].day == datetime.datetime(2020, 2, 3, 4, 5, 6)


@pytest.mark.parametrize("dates, kind", [(4, "date"), (3, "text")])
def test_date_threshold(spark, dates, kind):
    rows = [("2020-01-01",)] * dates + [("word",)] * (10 - dates) + [("N/A",)] * 5
    assert Y.plan_types(spark.createDataFrame(rows, ["c"])).types["c"] == kind


@pytest.mark.parametrize("numbers, kind", [(8, "numeric"), (7, "text")])
def test_number_threshold(spark, numbers, kind):
    rows = [("12",)] * numbers + [("word",)] * (10 - numbers)
    assert Y.plan_types(spark.createDataFrame(rows, ["c"])).types["c"] == kind


def test_european_numbers(spark):
    df = spark.createDataFrame([("1.234,56",), ("7,5",)], ["c"])
    out = Y.cast_types(df, Y.plan_types(df)).orderBy("c").collect()
    assert [r.c for r in out] == [7.5, 1234.56]


def test_customer_edges(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), 5.0), (2, D(2020, 1, 1), 1.0), (2, D(2020, 1, 1), 3.0),
                                (None, D(2020, 1, 1), 9.0)], "customer_id int, order_date date, amount double")
    s = {r.customer_id: r for r in A.customer_summary(df, "customer_id", "order_date", "amount").collect()}
    assert s[1].avg_days_between_orders is None and s[2].avg_days_between_orders == 0.0 and len(s) == 2
    g = {r.customer_id: r for r in A.customer_aggregate(
        df, {"customer_id": "customer_id", "date": "order_date", "amount": "amount"}).collect()}
    assert (g[1].customer_tenure_days, g[1].avg_days_between_orders, g[1].avg_rating_given) == (1, 1.0, 4.0)
    assert set(g) == {1, 2}


def test_months(spark):
    df = spark.createDataFrame([(D(2020, 1, 5), 2.0), (D(2020, 3, 9), 0.0), (D(2020, 4, 1), 4.0)],
                               "d date, a double")
    full = A.transactions_to_monthly(df, "d", "a").orderBy("month_label").collect()
    assert [r.monthly_revenue for r in full] == [2.0, 0.0, 0.0, 4.0]
    lags = A.monthly_lags(A.monthly_aggregate(df, "d", "a")).orderBy("month_key").collect()
    assert [r.lag_1_rev for r in lags] == [0.0, 2.0, 0.0]      # row lags skip the missing month
    assert lags[2].mom_growth == 0.0                            # growth over zero


def test_week_label(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 1.0), (D(2024, 1, 8), 1.0)],
                               "d date, a double")
    got = A.resample_series(df, "d", "a", "weekly").orderBy("period").collect()
    assert [(r.period, r.transactions) for r in got] == [(D(2024, 1, 1), 1), (D(2024, 1, 8), 2)]


def test_churn_strategies(spark):
    def run(days):
        rows = [(1, D(2020, 1, 1)), (1, D(2020, 1, 1) + datetime.timedelta(days=days))]
        df = spark.createDataFrame(rows, "customer_id int, order_date date")
        return C.churn_report(C.churn_customers(df, "customer_id", "order_date")).first().strategy

    assert [run(d) for d in (179, 180, 539, 540)] == [
        "insufficient_data", "adaptive_threshold", "adaptive_threshold", "forward_holdout"]


def test_risk_and_recency(spark):
    assert [one(spark, risk_level(F.lit(p))) for p in (0.39, 0.4, 0.7)] == ["low", "medium", "high"]
    adj = lambda p, g, t: one(spark, recency_adjust(F.lit(p), F.lit(g), F.lit(t)))
    assert adj(0.5, 10.0, 100) == 0.425 and adj(0.5, 0.0, 100) == 0.5
    assert adj(0.9, 100.0, 10) == 0.999 and adj(0.5, 10.0, 20) == 0.5


def test_names(spark):
    label = lambda c, **k: one(spark, K.display_name(F.lit(c), **k))
    assert label("Total_Revenue") == "Total Revenue" and label("vat_rate") == "VAT Rate"
    assert label("lag_1_total_egp", is_lag=F.lit(True)) == "Total_egp (lag 1)"
    assert label("order_date_month", is_engineered=F.lit(True)) == "Order Date Month (Engineered)"
    assert label("next_sales", is_target=F.lit(True)) == "Next Sales ★ Target"


def test_mapping(spark):
    df = spark.createDataFrame([(299.0, "3", "2024-06-15"), (None, "x", None)],
                               "OrderAmount double, Qty string, OrderDate string")
    m = {"price": "OrderAmount", "quantity_sold": "Qty", "month": "_from_date:OrderDate",
         "quarter": "_from_date:OrderDate", "gross_margin_pct": "absent"}
    a, b = M.apply_mapping(df, m, "revenue", D(2020, 11, 2)).collect()
    assert (a.price, a.quantity_sold, a.month, a.quarter, a.gross_margin_pct) == (299.0, 3.0, 6.0, 2.0, 0.3)
    assert (b.price, b.quantity_sold, b.month, b.quarter) == (0.0, 1.0, 11.0, 4.0)


@pytest.mark.parametrize("n, count", [(0, 0), (5, 0), (400, 1), (401, 2), (720, 2), (721, 3)])
def test_chunk_counts(spark, n, count):
    text = " ".join(["word"] * n)
    got = V.chunk_text(spark.createDataFrame([(1, text)], ["k", "text"])).orderBy("chunk_idx").collect()
    assert len(got) == count
    if n > 400:
        assert sum(len(r.text.split()) for r in got) == n + 80 * (count - 1)


def test_trim(spark):
    no_end = "x" * 1300
    assert one(spark, T.trim_at_sentence(F.lit(no_end))) == "x" * 1200 + " ..."
    text = "a" * 800 + ". " + "b" * 600
    assert one(spark, T.trim_at_sentence(F.lit(text))) == "a" * 800 + ". ..."
    assert one(spark, T.trim_at_sentence(F.lit("short"))) == "short"


def test_bullets(spark):
    raw = "- X is 5 [observed], suggesting y [inferred]\n- It seems to grow [derived]\n- no"
    df = spark.createDataFrame([(1, raw, "Channels"), (2, "", "Channels")], ["k", "raw", "t"])
    got = V.parse_evidence_tags(df, "k", "raw", "t").orderBy("k", "bullet").collect()
    assert [(r.k, r.text, r.tag) for r in got][:2] == [
        (1, "X is 5 , suggesting y.", "inferred"), (1, "It seems to grow.", "inferred")]
    assert got[2].tag == "observed" and "claims about Channels" in got[2].text


def test_outlier_edges(spark):
    plan = Y.TypePlan({"flat": "numeric", "few": "numeric", "wide": "numeric"})
    df = spark.createDataFrame([(5.0, float(k) if k < 9 else None, float(k)) for k in range(12)],
                               "flat double, few double, wide double")
    assert set(L.fit_outlier_bounds(df, plan)) == {"wide"}


def test_cleaning_is_stable_and_learns_from_fit_rows_only(spark):
    plan = Y.TypePlan({"boxes": "numeric", "kind": "text"})
    rows = [(k, float(k % 9) if k % 5 else None, "a" if k % 3 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, boxes double, kind string")
    fit = F.col("k") < 60
    model = L.fit_imputer(df, plan, fit)
    once = L.impute_missing(df, model)
    assert L.fit_imputer(once, plan, fit).fills == {}
    other = df.withColumn("boxes", F.when(fit, F.col("boxes")).otherwise(F.col("boxes") * 1000))
    assert L.fit_imputer(other, plan, fit).fills == model.fills
    bounds = L.fit_outlier_bounds(once, plan, fit)
    assert L.fit_outlier_bounds(L.impute_missing(other, model), plan, fit) == bounds


def test_eval_runs_from_files(spark, tmp_path):
    from tillwise.operators.governance import eval_warnings, model_confidence
    from tillwise.sources.tables import latest_eval_run, read_eval_runs

    for version, r2 in (("20260101_000000", 0.5), ("20260301_000000", 0.97)):
        body = {"revenue_model": {"R2": r2, "MAPE_pct": 12.0, "train_rows": 30000,
                                  "12_period_forecast": [5.0, 9.0]},
                "churn_model": {"status": "skipped_insufficient_data"}}
        (tmp_path / f"evaluation_results_v{version}.json").write_text(json.dumps(body, indent=2))
    runs = read_eval_runs(spark, str(tmp_path))
    assert latest_eval_run(runs).first().run_id == "20260301_000000"
    warned = {r.run_id: len(r.warnings) for r in eval_warnings(runs).collect()}
    assert warned == {"20260101_000000": 0, "20260301_000000": 1}
    levels = {(r.run_id[4:6], r.model): r.level for r in model_confidence(runs).collect()}
    assert levels[("03", "revenue")] == "low" and levels[("01", "revenue")] == "medium"
    assert levels[("01", "churn")] == "low" and ("01", "growth") not in levels


def test_absent_report_and_bad_rule(spark, tmp_path):
    from tillwise.operators.laws import custom_rule_impute
    from tillwise.sources.tables import read_data_report

    assert read_data_report(spark, str(tmp_path / "none")) is None
    df = spark.createDataFrame([(10.0, 3.0, 4.0, None)],
                               "Unit_Price double, Quantity double, Discount double, Total double")
    out, errors = custom_rule_impute(df, {"Total": "Unit_Price * Quantity - Discount", "Bad": "nope + 1"})
    assert out.first().Total == 26.0 and [e[0] for e in errors] == ["Bad"]


def test_clean_table_run(spark):
    from tillwise.plans.clean_table import clean_table

    rows = [(k, f" {'M' if k % 2 else 'female'} ", f"2024-{k % 12 + 1:02d}-{k % 27 + 1:02d}",
             str(k % 9) if k % 11 else "N/A", float(k % 40), k % 9 * float(k % 40)) for k in range(300)]
    raw = spark.createDataFrame(rows, ["order_id", "gender", "order_date", "units", "weight", "load_cost"])
    raw = raw.withColumn("line", F.col("order_id")).union(raw.limit(1).withColumn("line", F.col("order_id")))
    run = clean_table(raw, D(2025, 1, 1), row_id="line")
    assert run.data.count() == 300
    assert {r.gender for r in run.data.select("gender").distinct().collect()} == {"male", "female"}
    assert "order_date_Season" in run.data.columns and "lag_3_weight" in run.data.columns
    found = {(r.finding, r.subject) for r in run.report.collect()}
    assert ("duplicates", "rows") in found and ("score", "after") in found
    assert any(w.derived == "load_cost" for w in run.laws)


def test_other_time_zone_changes_nothing(spark):
    from tillwise.operators.features import date_deltas

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        read = lambda v: one(spark, Y.parse_date(F.lit(v)))
        assert read("2024-03-10T12:00:00+02:00") == datetime.datetime(2024, 3, 10, 10)
        assert read("2024-3-10 02:30:00") == datetime.datetime(2024, 3, 10, 2, 30)
        assert read("3/4/2024") == datetime.datetime(2024, 3, 4) and read("20240304") == datetime.datetime(2024, 3, 4)
        df = spark.createDataFrame([(D(2024, 3, 9), D(2024, 3, 12)), (D(2024, 3, 12), D(2024, 3, 9))],
                                   "a date, b date")
        assert sorted(r.b_days_from_a for r in date_deltas(df, "a", ["b"]).collect()) == [-3, 3]
        part = df.limit(1).select((F.col("a").cast("timestamp_ntz")).alias("a"), (
            F.col("a").cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(1))).alias("b"))
        assert date_deltas(part, "a", ["b"]).first().b_days_from_a == -1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_written_dates(spark):
    from tillwise.operators.coltypes import parse_date

    day = datetime.datetime(2024, 3, 5)
    forms = {"March 5, 2024": day, "5 March 2024": day, "05-Mar-2024": day, "Mar 5 2024": day,
             "2024.03.05": day, "20240305": day, "03/05/24": day, "mar 5 2024": day,
             "15/03/2024": datetime.datetime(2024, 3, 15), "31/12/99": datetime.datetime(1999, 12, 31),
             "2024-03-05 10:00 PM": datetime.datetime(2024, 3, 5, 22),
             "2024-03-05 10:11:12.5+02:00": datetime.datetime(2024, 3, 5, 8, 11, 12, 500000),
             "2024-03": datetime.datetime(2024, 3, 1), "3/2024": datetime.datetime(2024, 3, 1),
             "March 2024": datetime.datetime(2024, 3, 1), "mar-2024": datetime.datetime(2024, 3, 1),
             "2024 Mar 5": day, "Mon, 05 Mar 2024": day, "Tuesday, March 5, 2024": day, "wed 2024-03-05": day,
             "2024-03-05T10": datetime.datetime(2024, 3, 5, 10),
             "Sunday 03/05/2024 1:05 pm": datetime.datetime(2024, 3, 5, 13, 5),
             "2024-13": None, "2024.03": None, "0999-10": None, "Marchers 2024": None, "Monday": None, "1234": None,
             "13/13/2024": None, "5 foo 2024": None, "march": None, "12": None, "1.5": None, "": None}
    df = spark.createDataFrame([(k,) for k in forms], "s string")
    assert {r.s: r.d for r in df.select("s", parse_date("s").alias("d")).collect()} == forms


def test_spearman_with_gaps(spark):
    import itertools

    import pandas as pd

    from tillwise.operators import quality

    rows = [(float(k) if k % 3 else None, float(k * k) if k % 5 else None, float(-k) if k % 2 else None,
             float(k % 7)) for k in range(60)]
    got = quality.spearman(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd"))
    want = pd.DataFrame(rows, columns=list("abcd")).corr("spearman")
    assert all(abs(got[p] - want.loc[p]) < 1e-9 for p in itertools.combinations("abcd", 2))
    apart = [(float(k), None, float(k)) if k % 2 else (None, float(k), float(k)) for k in range(20)]
    got = quality.spearman(spark.createDataFrame(apart, "a double, b double, c double"), list("abc"))
    assert got["a", "c"] == got["b", "c"] == 1.0 and got["a", "b"] is None


def test_not_a_number(spark):
    from tillwise.functions.quantiles import quantiles

    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (2.0,)], "v double")
    assert L.nth_smallest(df, "v", 2) == 2.0
    assert [quantiles(df, ["v"], [0.5], direct_values=n).first().v[0] for n in (10, 0)] == [2.0, 2.0]


def test_laws_among_many_columns(spark):
    from tillwise.operators import laws

    names = [f"m{k}" for k in range(20)]
    rows = []
    for k in range(120):
        r = [float((k * (7 + j) + j * j) % 101 + j / 7) for j in range(20)]
        rows.append((*r[:19], r[17] + r[18]))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    assert len(laws.eligible_columns(df, names)) == 20
    kept = laws.kept_laws(laws.law_resolution(laws.law_discovery(df, names)))
    assert [(w.base_a, w.op, w.base_b, w.derived) for w in kept] == [("m17", "addition", "m18", "m19")]


def test_csv_charset_for_each_file(spark, tmp_path):
    from tillwise.sources.tables import read_csv_encoded

    (tmp_path / "a.csv").write_bytes("k,v\n1,é\n".encode())
    (tmp_path / "b c.csv").write_bytes("k,v\n2,é\n".encode("latin-1"))
    rows = read_csv_encoded(spark, str(tmp_path), "k int, v string").collect()
    assert {(r.k, r.v) for r in rows} == {(1, "é"), (2, "é")}


def test_search_skips_missing_vectors(spark):
    from tillwise.operators.retrieval import semantic_search

    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id int, embedding array<double>")
    assert [(r.question_id, r.chunk_id) for r in semantic_search(chunks, asked).collect()] == [(1, "a")]
