"""Calibrators of many users at once, beside row-by-row fits."""

import random

import numpy as np
import pytest

SCHEMA = "user_id long, model_kind string, prediction double, actual double"


def pools(pairs):
    """Sorted (x, fitted) of a plain isotonic fit: repeated passes until no neighbour falls."""
    cells = {}
    for x, y in pairs:
        cells.setdefault(x, []).append(y)
    blocks = [[sum(v), len(v), [x]] for x, v in sorted(cells.items())]
    k = 0
    while k + 1 < len(blocks):
        a, b = blocks[k], blocks[k + 1]
        if a[0] / a[1] > b[0] / b[1]:
            blocks[k:k + 2] = [[a[0] + b[0], a[1] + b[1], a[2] + b[2]]]
            k = max(k - 1, 0)
        else:
            k += 1
    return [(x, s / n) for s, n, xs in blocks for x in xs]


def fitted(spark, rows):
    from tillwise.operators.calibration_jobs import apply_all, fit_calibrators

    df = spark.createDataFrame(rows, SCHEMA)
    found = fit_calibrators(df)
    table = {(r["user_id"], r["model_kind"]): r for r in found.table.collect()}
    out = {}
    for r in apply_all(df, found).collect():
        out.setdefault((r["user_id"], r["model_kind"]), {})[r["prediction"]] = r["calibrated"]
    return table, out, found


def same_as_plain(rows, table, out):
    groups = {}
    for u, k, x, y in rows:
        groups.setdefault((u, k), []).append((x, y))
    n = 0
    for key, pairs in groups.items():
        if table[key]["calibrator_kind"] == "isotonic":
            n += 1
            want = dict(pools(pairs))
            assert out[key].keys() == want.keys()
            assert np.allclose([out[key][x] for x in want], np.maximum(list(want.values()), 0))
    return n


@pytest.mark.parametrize("few", [200_000, 0])
def test_many_users_and_a_hot_one(spark, monkeypatch, few):
    """Users of all sizes; one with most pairs; falling, sawtooth and noisy shapes; with and without the
    round for few blocks."""
    import tillwise.operators.calibration_jobs as C

    monkeypatch.setattr(C, "FEW_BLOCKS", few)
    rng = random.Random(6)
    rows = []
    for u in range(300):
        shape = u % 4
        for _ in range(rng.choice([20, 40, 110, 150])):
            x = round(rng.random() * 40, 1)
            y = {0: x + rng.gauss(0, 9), 1: 50 - x, 2: x % 7, 3: 3.0}[shape]
            rows.append((u, "revenue", x, y))
    for k in range(9000):
        rows.append((999, "growth", float(k), float(k % 1500) + k / 50 + rng.gauss(0, 5)))
    rows += [(999, "churn", rng.random(), 0.0) for _ in range(3000)]
    rows = [(u, m, x, float(rng.random() < x) if m == "churn" else y) for u, m, x, y in rows]
    table, out, found = fitted(spark, rows)
    assert same_as_plain(rows, table, out) > 100
    kinds = {r["calibrator_kind"] for r in table.values()}
    assert kinds == {"isotonic", "linear", "refused: too few pairs"}
    for (u, m), r in table.items():
        if r["calibrator_kind"] == "linear":
            xs, ys = np.array([(x, y) for a, b, x, y in rows if (a, b) == (u, m)]).T
            b, a = np.polyfit(xs, ys, 1)
            assert np.isclose(r["slope"], b, atol=1e-6) and np.isclose(r["intercept"], a, atol=1e-6)
        if r["calibrator_kind"] == "isotonic":
            fit = dict(pools([(x, y) for a, b, x, y in rows if (a, b) == (u, m)]))
            loss = (lambda d: d * d) if m == "churn" else abs
            mine = [(loss(y - x), loss(y - fit[x])) for a, b, x, y in rows if (a, b) == (u, m)]
            assert np.allclose([r["error_before"], r["error_after"]], np.mean(mine, 0), atol=1e-4)


def test_unusual_pairs(spark):
    rows = [(1, "churn", 2.0 if k % 2 else -1.0, float(k % 2)) for k in range(60)]  # outside 0 to 1
    rows += [(2, "churn", k / 60, 1.0) for k in range(60)] + [(3, "revenue", 5.0, float(k)) for k in range(200)]
    rows += [(None, "revenue", 1.0, 1.0), (4, None, 1.0, 1.0), (5, "revenue", float("nan"), 1.0),
             (6, "revenue", None, 1.0), (7, "growth", float("inf"), 1.0)]
    rows += [(8, "revenue", float(k), -50.0) for k in range(40)]
    table, out, found = fitted(spark, rows)
    assert set(table) == {(1, "churn"), (2, "churn"), (3, "revenue"), (8, "revenue")}
    assert table[1, "churn"]["calibrator_kind"] == "isotonic" and out[1, "churn"] == {2.0: 1.0, -1.0: 0.0}
    assert table[2, "churn"]["calibrator_kind"] == "refused: one class" and out[2, "churn"][0.5] == 0.5
    # one prediction: a level line; a value under zero is clipped for revenue
    assert np.isclose(out[3, "revenue"][5.0], 99.5) and set(out[8, "revenue"].values()) == {0.0}
    assert out[6, "revenue"] == {None: None} and out[7, "growth"] == {float("inf"): float("inf")}
    assert np.isnan(list(out[5, "revenue"].values())[0]) and out[None, "revenue"] == {1.0: 1.0}


def test_no_pairs(spark):
    table, out, found = fitted(spark, [])
    assert table == {} and out == {} and found.knots.count() == 0


def test_number_of_jobs_does_not_grow_with_users(spark):
    from tillwise.operators.calibration_jobs import fit_calibrators

    def jobs(users):
        rows = spark.range(users * 120).selectExpr(
            f"id % {users} as user_id", "'revenue' as model_kind", f"double(id div {users}) as prediction",
            f"double(hash(id) % 100 + id div {users}) as actual")
        group = f"fit-{users}"
        spark.sparkContext.setJobGroup(group, "")
        found = fit_calibrators(rows)
        assert found.table.where("calibrator_kind = 'isotonic'").count() == users
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        few, many = jobs(20), jobs(1000)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 8


def test_many_knots(spark):
    """100 000 knots of one user: the plan stays small and values are those of a plain lookup."""
    from pyspark.sql import functions as F
    from tillwise.operators.calibration_jobs import Calibrators, apply_all

    knots = spark.range(100_000).selectExpr("7L user_id", "'revenue' model_kind", "double(id) x", "double(id * id) y")
    table = spark.createDataFrame([(7, "revenue", "isotonic", 0.0, 0.0)],
                                  "user_id long, model_kind string, calibrator_kind string, intercept double, slope double")
    scored = spark.range(20_000).selectExpr("id", "7L user_id", "'revenue' model_kind", "id * 6.0 - 500.75 prediction")
    scored = scored.unionByName(scored.limit(1).withColumn("user_id", F.lit(8).cast("long")))
    df = apply_all(scored, Calibrators(table, knots))
    # of fixed size, apart from the range bounds of eight partitions
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    xs, ys = np.arange(100_000.0), np.arange(100_000.0) ** 2
    rows = df.collect()
    assert len(rows) == 20_001
    for r in rows:
        x = float(r["prediction"])
        assert np.isclose(r["calibrated"], np.interp(x, xs, ys) if r["user_id"] == 7 else x)


def test_scores_are_calibrated(spark):
    from tillwise.operators.calibration_jobs import fit_calibrators
    from tillwise.operators.learn import calibrated_scores

    pairs = spark.createDataFrame([(1, "revenue", float(k), 3.0 * k) for k in range(120)], SCHEMA)
    scored = spark.createDataFrame([(1, 10.5, "a"), (2, 10.5, "b"), (1, None, "c")],
                                   "customer long, prediction double, model_kind string")
    out = calibrated_scores(scored, "revenue", fit_calibrators(pairs), "customer")
    assert out.columns == ["customer", "prediction", "model_kind", "calibrated"]
    assert {r["model_kind"]: r["calibrated"] for r in out.collect()} == {"a": 31.5, "b": 10.5, "c": None}
