"""The paths meant for large input give the same answers as the direct ones."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwise.functions import lags
from tillwise.functions.lags import sliced_lags
from tillwise.functions.quantiles import quantiles
from tillwise.operators import calibrate, cleaning, laws, learn, quality


def test_narrowed_quantiles(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.random() * 1e6, 7.0, rng.gauss(0, 1), None]))
            for g in ("a", "b") for _ in range(3000)] + [("one", 3.5), ("flat", 2.0), ("flat", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("w", F.col("v") * 2)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for by in ((), ("g",)):
        a = {r[0] if by else 0: r for r in quantiles(df, ["v", "w"], probs, by).collect()}
        b = {r[0] if by else 0: r for r in quantiles(df, ["v", "w"], probs, by, direct_values=0).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert np.allclose(a[k].v, b[k].v) and np.allclose(a[k].w, b[k].w)


def test_sliced_lags_with_a_hot_group(spark, monkeypatch):
    rng = random.Random(2)
    day = datetime.date(2020, 1, 1)
    rows = [(k, "hot" if k % 3 else f"g{k % 50}", day + datetime.timedelta(days=rng.randrange(400)),
             rng.random()) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, d date, v double")
    w = Window.partitionBy("g").orderBy("d", "id")
    want = df.select("id", F.lag("v", 1).over(w).alias("a"), F.lag("v", 3).over(w).alias("b"))
    monkeypatch.setattr(lags, "ROW_ID_SPAN", 500)
    stamped = df.withColumn("ts", (F.col("d").cast("timestamp") + F.make_dt_interval(
        secs=F.col("id") * 7919 % 86400)).cast("timestamp_ntz"))
    by_time = Window.partitionBy("g").orderBy("ts", "id")
    late = stamped.select("id", F.lag("v", 1).over(by_time).alias("a"))
    got = sliced_lags(stamped, ["g"], "ts", "id", ["v"], (1,), "DAY").join(late, "id")
    assert got.where(~F.col("v__lag1").eqNullSafe(F.col("a"))).count() == 0
    for unit in ("MONTH", "DAY"):
        got = sliced_lags(df, ["g"], "d", "id", ["v"], (1, 3), unit)
        diff = got.join(want, "id").where(
            ~F.col("v__lag1").eqNullSafe(F.col("a")) | ~F.col("v__lag3").eqNullSafe(F.col("b")))
        assert got.count() == 4000 and diff.count() == 0


def test_lags_inside_one_hour(spark):
    """A group, and no group at all, whose rows share one hour are spread over many ranges of like size."""
    from tillwise.functions.lags import range_number
    from tillwise.operators.features import group_lag_features

    df = spark.range(20_000).selectExpr(
        "id * 7919 % 20011 as row", "if(id % 10 < 7, 'hot', concat('g', id % 40)) as g", "double(id % 977) as v",
        "timestamp_ntz'2024-03-05 10:00:00' + make_dt_interval(0, 0, 0, id % 1800) as t")
    for keys, hot in ((["g", "t", "row"], "g = 'hot'"), (["t", "row"], "true")):
        sizes = [r["count"] for r in df.withColumn("r", range_number(df, keys)).where(hot).groupBy("r").count().collect()]
        assert len(sizes) > 16 and max(sizes) < 3 * sum(sizes) / len(sizes)
    for group in ("g", None):
        w = Window.partitionBy(*([group] if group else [])).orderBy("t", "row")
        want = df.select("row", F.coalesce(F.lag("v", 1).over(w), F.lit(-1.0)).alias("a"),
                         F.coalesce(F.lag("v", 3).over(w), F.lit(-1.0)).alias("b"))
        got = group_lag_features(df, "t", "row", ["v"], group).join(want, "row")
        assert got.count() == 20_000 and got.where("lag_1_v <> a or lag_3_v <> b").count() == 0
    # equal times, null values, a single row and no rows
    same = spark.createDataFrame([(k, None if k == 1 else float(k), datetime.date(2024, 1, 1)) for k in range(4)],
                                 "row long, v double, t date")
    got = {r["row"]: (r["lag_1_v"], r["lag_3_v"]) for r in group_lag_features(same, "t", "row", ["v"]).collect()}
    assert got == {0: (-1.0, -1.0), 1: (0.0, -1.0), 2: (-1.0, -1.0), 3: (2.0, 0.0)}
    assert group_lag_features(same.limit(1), "t", "row", ["v"]).count() == 1
    assert group_lag_features(same.where("row > 9"), "t", "row", ["v"]).count() == 0


def test_count_at_most(spark):
    from tillwise.functions.exprs import count_at_most

    df = spark.range(-1, 12).selectExpr("id as x", "array(1, 3, 3, 7, 9) as a", "array_repeat(0, 0) as e")
    for r in df.select("x", count_at_most(F.col("a"), F.col("x"), 5).alias("n"),
                       count_at_most(F.col("e"), F.col("x"), 5).alias("z")).collect():
        assert r.n == sum(v <= r.x for v in (1, 3, 3, 7, 9)) and r.z == 0


def test_nth_smallest(spark):
    rng = random.Random(3)
    vals = [rng.randrange(500) for _ in range(2000)]
    df = spark.createDataFrame([(v, datetime.date(2000, 1, 1) + datetime.timedelta(days=v)) for v in vals],
                               "v int, d date")
    for n in (1, 2, 777, 2000):
        assert cleaning.nth_smallest(df, "v", n, buckets=7) == sorted(vals)[n - 1]
        assert cleaning.nth_smallest(df, "d", n, buckets=50) == \
            datetime.date(2000, 1, 1) + datetime.timedelta(days=sorted(vals)[n - 1])


def test_law_pruning_changes_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        a, b, c = float(rng.randrange(1, 50)), round(rng.random() * 9 + 1, 2), float(rng.randrange(-40, 40))
        noise = 0.5 if k % 150 == 0 else 0.0
        rows.append((a, b, a * b + noise, c, a - c))
    df = spark.createDataFrame(rows, "a double, b double, ab double, c double, diff double")
    cols = ["a", "b", "ab", "c", "diff"]
    whole = sorted(map(tuple, laws.law_discovery(df, cols).collect()))
    monkeypatch.setattr(laws, "TESTS_PER_PASS", 40)
    assert sorted(map(tuple, laws.law_discovery(df, cols).collect())) == whole
    kept = {(w.base_a, w.op, w.base_b, w.derived) for w in laws.kept_laws(
        laws.law_resolution(laws.law_discovery(df, cols)))}
    assert ("a", "multiplication", "b", "ab") in kept and len(kept) == 2


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 900).astype(float), "b": rng.normal(size=900)})
    pdf["c"] = pdf.a ** 3 + rng.normal(size=900) * 100
    got = quality.spearman(spark.createDataFrame(pdf), ["a", "b", "c"])
    ranks = pdf.rank()
    for (x, y), v in got.items():
        assert abs(v - ranks[x].corr(ranks[y])) < 1e-9


def _pava(x, y):
    order = np.argsort(x, kind="stable")
    blocks = []
    for v in pd.Series(y[order]).groupby(x[order]).agg(["mean", "size"]).itertuples():
        blocks.append([v.mean, v.size, [v.Index]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            m2, n2, i2 = blocks.pop()
            m1, n1, i1 = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, i1 + i2])
    return {k: m for m, _, ks in blocks for k in ks}


def test_isotonic_calibrator_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 60, 400) / 10
    y = x * 2 + rng.normal(size=400) * 3
    pairs = spark.createDataFrame(pd.DataFrame({"prediction": x, "actual": y}))
    cal = calibrate.fit_regression_calibrator(pairs)
    want = _pava(x, y)
    got = pairs.select("prediction", cal.column("prediction").alias("c")).distinct().collect()
    assert cal.kind == "isotonic" and all(abs(want[r.prediction] - r.c) < 1e-9 for r in got)


def test_calibrator_sizes(spark):
    import pytest

    def pairs(n, distinct):
        return spark.createDataFrame([(float(k % distinct), float(k)) for k in range(n)],
                                     "prediction double, actual double")

    with pytest.raises(ValueError):
        calibrate.fit_regression_calibrator(pairs(29, 29))
    assert calibrate.fit_regression_calibrator(pairs(30, 30)).kind == "linear"
    assert calibrate.fit_regression_calibrator(pairs(99, 99)).kind == "linear"
    assert calibrate.fit_regression_calibrator(pairs(100, 9)).kind == "linear"
    assert calibrate.fit_regression_calibrator(pairs(100, 10)).kind == "isotonic"
    with pytest.raises(ValueError):
        calibrate.fit_classification_calibrator(pairs(60, 60).withColumn("actual", F.lit(1.0)))


def test_auc_by_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(2), rng.randrange(10) / 10) for _ in range(300)]
    m = learn.classification_metrics(spark.createDataFrame(rows, "label int, p double"), "label", "p").first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(m.roc_auc - want) < 1e-9


def test_search_in_batches(spark, monkeypatch):
    from tillwise.operators import retrieval

    rng = np.random.default_rng(8)
    vec = rng.normal(size=(200, 8))
    chunks = spark.createDataFrame([(k, [float(v) for v in vec[k]]) for k in range(200)],
                                   "chunk_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(q, [float(v) for v in vec[q] + 0.1]) for q in range(30)],
                                  "question_id long, embedding array<double>")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    monkeypatch.setattr(retrieval, "QUESTIONS_PER_BATCH", 7)
    got = retrieval.semantic_search(chunks, asked, n=4).collect()
    for q in range(30):
        v = vec[q] + 0.1
        sim = unit @ (v / np.linalg.norm(v))
        want = [k for k in np.argsort(-sim)[:4] if sim[k] >= 0.25]
        assert [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.rank)] == want


def test_laws_are_those_of_testing_every_triple(spark):
    """Sparse columns, copies of columns, zeros, signs, tiny and missing values, and noise."""
    rng = random.Random(8)
    rows = []
    for k in range(3000):
        a, b = rng.choice([0.0, rng.uniform(-50, 50)]), float(rng.randrange(1, 9))
        c = rng.choice([None, rng.uniform(1, 100)])
        few = rng.uniform(1, 9) if k % 30 == 0 else None
        rows.append((a, b, a + b, a * b, c, None if c is None else c / b, a + b if k % 200 else a + b + 1, a, few,
                     None if few is None else few - b, 1e-10 * b, 2e-10 * b, float("nan") if k % 50 == 0 else b - a,
                     rng.gauss(0, 1e3)))
    names = ["a", "b", "total", "area", "c", "rate", "nearly", "copy", "few", "less", "tiny", "twice", "odd", "noise"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    tests = [(i, j, k, o) for i in range(14) for j in range(14) for k in range(14) if len({i, j, k}) == 3
             for o, op in enumerate(laws.OPS) if i < j or op in ("subtraction", "division")]
    want = set()
    for start in range(0, len(tests), 3000):
        want |= {tuple(r) for r in laws._law_rows(df, names, tests[start:start + 3000]).collect()}
    got = {tuple(r) for r in laws.law_discovery(df, names).collect()}
    assert got == want and len(got) > 20
    assert {("few", "b", "less", "subtraction"), ("a", "b", "nearly", "addition")} <= {r[1:5] for r in got}


def test_label_codes_without_a_list(spark):
    """Very many labels, a hot one, missing and unseen ones, two columns with the same labels."""
    rows = [("hot" if k % 3 else f"l{k * 7919 % 9973:05d}", f"l{k % 7}" if k % 11 else None, k) for k in range(20_000)]
    df = spark.createDataFrame(rows, "a string, b string, k int")
    got = learn.label_encode(df, ["a", "b"])
    assert got.columns == ["a", "b", "k", "a_code", "b_code"]
    want = {c: {v: n for n, v in enumerate(sorted({r[i] for r in rows} - {None}))} for i, c in enumerate("ab")}
    for r in got.collect():
        assert r.a_code == want["a"][r.a] and r.b_code == want["b"].get(r.b, 7)
    other = spark.createDataFrame([("hot", "new"), (None, "l3"), ("", "l0")], "a string, b string")
    found = learn.label_encode(other, ["a", "b"], learn.label_codes(df, ["a", "b"]))
    n = len(want["a"])
    assert {(r.a, r.a_code, r.b_code) for r in found.collect()} == {("hot", want["a"]["hot"], 7), (None, n, 3), ("", n, 0)}
    none = learn.label_encode(df.limit(0), ["a"])
    assert none.count() == 0


def test_quantiles_of_many_small_groups_in_one_aggregate(spark, monkeypatch):
    from tillwise.functions import quantiles as Q

    df = spark.range(400).selectExpr("id % 100 AS g", "CAST(id * id % 37 AS DOUBLE) AS v")
    want = {r.g: r.v for r in Q._narrowed(df, ["v"], [0.25, 0.75], ["g"]).collect()}
    monkeypatch.setattr(Q, "_narrowed", lambda *_a: 1 / 0)
    got = Q.quantiles(df, ["v"], [0.25, 0.75], ["g"], direct_values=10)
    assert {r.g: r.v for r in got.collect()} == want
    monkeypatch.setattr(Q, "GROUP_VALUES", 3)
    with pytest.raises(ZeroDivisionError):  # a group of more rows goes the other way
        Q.quantiles(df, ["v"], [0.25, 0.75], ["g"], direct_values=10)


def test_runs_of_one_file_over_all_cores(spark, tmp_path):
    from tillwise.plans.governance_reports import RUN_ROWS, runs
    from tillwise.plans.inputs import Inputs

    n = RUN_ROWS[0] * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, 1).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal").write.parquet(
        f"{tmp_path}/customer.parquet")
    assert runs(Inputs(spark, str(tmp_path))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_run_files_in_one_folder(spark, tmp_path):
    from tillwise.sources.tables import latest_eval_run, read_eval_runs, write_eval_runs

    df = spark.createDataFrame([(v, f'{{"revenue_model": {{"R2": {r}}}}}') for v, r in (
        ("1995_1", 0.5), ("1995_2", 0.25), ("1995_2", 0.25), (None, 0.75))], "version string, body string")
    folder = f"{tmp_path}/runs"
    assert write_eval_runs(df, folder) == 4
    assert len([f for f in (tmp_path / "runs").iterdir() if f.suffix == ".json"]) == 4
    got = read_eval_runs(spark, folder).selectExpr("run_id", "revenue_model.R2 AS r2")
    assert sorted(got.collect()) == [("", 0.75), ("1995_1", 0.5), ("1995_2", 0.25), ("1995_2", 0.25)]
    assert latest_eval_run(got).first() == ("1995_2", 0.25)


def test_clean_table_spreads_a_table_of_one_file(spark, monkeypatch):
    from tillwise.plans import clean_table as P

    def stop(df):
        raise StopIteration(df.rdd.getNumPartitions(), df.count())

    monkeypatch.setattr(P, "checkpointed", stop)
    monkeypatch.setattr(P, "TASK_ROWS", (100, 1000))
    n = 100 * spark.sparkContext.defaultParallelism
    raw = spark.range(0, n, 1, 1).selectExpr("CAST(id AS STRING) AS order_id", "CAST(id % 9 AS STRING) AS units")
    with pytest.raises(StopIteration) as got:
        P.clean_table(raw, datetime.date(2025, 1, 1))
    assert got.value.args == (spark.sparkContext.defaultParallelism, n)


def test_exported_tables_share_their_lines(spark, monkeypatch, tmp_path):
    """The lines are computed once for the three tables, which are those of a plan without stored lines."""
    from decimal import Decimal

    from tillwise.operators.aggregates import task_datasets
    from tillwise.plans.inputs import Inputs
    from tillwise.plans.registry import QUERIES
    from tillwise.session import checkpoint_folder
    import tillwise.plans.sales_reports  # noqa: F401

    rng, day = random.Random(3), datetime.date(2020, 1, 1)
    money = lambda: Decimal(rng.randrange(100_000)) / 100
    rows = [(k, None if k % 17 == 0 else k % 7, None if k % 19 == 0 else day + datetime.timedelta(days=rng.randrange(500)),
             k % 11, rng.choice(["Books", "Beauty", "Unknown", None]), "EU" if k % 7 else "ASIA", "cash",
             money(), 5.0, rng.randrange(1, 9), rng.random(), money(), k % 2, 1 + k % 5, k % 40,
             money(), None if k % 23 == 0 else money()) for k in range(300)]
    rows += rows[:20]
    plain = spark.createDataFrame(rows, """order_id long, customer_id long, order_date date, product_id long,
        product_category string, customer_region string, payment_method string, price decimal(12,2),
        discount_percent double, quantity_sold int, discounted_price double, total_revenue decimal(18,2),
        is_returned int, rating int, review_count int, refund_amount decimal(18,2), net_revenue decimal(18,2)""")
    made = spark.sparkContext.accumulator(0)

    def note(v):
        made.add(1)
        return v

    lines = plain.withColumn("order_date", F.udf(note, "date")("order_date"))
    monkeypatch.setattr(Inputs, "view", lambda self, name: lines)
    monkeypatch.setattr(Inputs, "scratch", lambda self: str(tmp_path))
    got = {r.dataset: r for r in QUERIES["export_task_datasets"](spark, "").collect()}
    assert made.value == len(rows)
    assert got["revenue"].row_count == len(rows) and got["churn"].row_count == 8
    for name, want in task_datasets(plain).items():
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.dtypes == want.dtypes and got[name].column_count == len(want.columns)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    store = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    kept = store.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(store, "tillwise-*/lines"))
    assert len(kept) == 0
