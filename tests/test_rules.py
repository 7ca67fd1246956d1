"""User rules on rows that they can not be evaluated on."""

import datetime

import pytest
from pyspark.sql import functions as F

ROWS = [(1, 10.0, 2.0, "4", None), (2, 10.0, 0.0, "x", None), (3, None, 1.0, "7", None), (4, 8.0, 4.0, None, None),
        (5, 8.0, 0.0, "2", 99.0), (6, 6.0, 3.0, "1e400", None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "k int, a double, b double, t string, out double")


def values(data, name):
    return {r["k"]: r[name] for r in data.select("k", name).collect()}


def counts(run):
    return {r["rule"]: (r["given"], r["filled"], r["empty"], r["failed"], r["error"]) for r in run.report().collect()}


def test_bad_rows_cost_their_own_cells(df):
    from tillwise.operators.rules import apply_rules

    run = apply_rules(df, {"out": "a / b", "number": "cast(t as double)", "small": "cast(k * 1000000000 as int)",
                           "third": "array(a, b)[k]", "gone": "nothing + 1", "torn": "a +",
                           "odd": lambda d: d["absent"], "key": lambda d: {}["x"]})
    assert run.data.columns == [*df.columns, "number", "small", "third"]
    assert values(run.data, "out") == {1: 5.0, 2: None, 3: None, 4: 2.0, 5: 99.0, 6: 2.0}
    assert values(run.data, "number") == {1: 4.0, 2: None, 3: 7.0, 4: None, 5: 2.0, 6: float("inf")}
    assert values(run.data, "small") == {1: 1_000_000_000, 2: 2_000_000_000, **{k: None for k in (3, 4, 5, 6)}}
    assert values(run.data, "third") == {1: 2.0, **{k: None for k in (2, 3, 4, 5, 6)}}
    found = counts(run)
    assert found["out"] == (1, 3, 1, 1, None) and found["number"] == (0, 4, 1, 1, None)
    assert found["small"] == (0, 2, 0, 4, None) and found["third"] == (0, 1, 0, 5, None)
    assert {r for r, c in found.items() if c[4]} == {"gone", "torn", "odd", "key"}
    assert found["key"][4] == "KeyError"
    failed = {(r["rule"], r["k"]) for r in run.failed_rows("k").collect()}
    assert failed == {("out", 2), ("number", 2), *[("small", k) for k in (3, 4, 5, 6)],
                      *[("third", k) for k in (2, 3, 4, 5, 6)]}


def test_rules_that_share_a_failing_part(df):
    """What several rules have in common is not computed ahead of them."""
    from tillwise.operators.rules import apply_rules

    run = apply_rules(df, {"x": "a / b + 1", "y": "a / b * 2", "z": "a / b * 2 + 1", "out": "a / b"})
    assert values(run.data, "x") == {1: 6.0, 2: None, 3: None, 4: 3.0, 5: None, 6: 3.0}
    assert values(run.data, "z")[1] == 11.0 and values(run.data, "out")[5] == 99.0
    assert run.data.where("x > 0 and y > 0").count() == 3


def test_constants_nan_and_order(df):
    from tillwise.operators.rules import apply_rules

    run = apply_rules(df, {"one": "1", "never": "1 / 0", "nan": "double('NaN')", "out": F.col("one") * 2.0,
                           "whole": "array(1)"})
    row = run.data.where("k = 1").first()
    assert (row.one, row.never, row.nan, row.out, row.whole) == (1, None, None, 2.0, [1])
    assert counts(run)["never"][3] == 6 and counts(run)["nan"][2] == 6


def test_no_rules(df):
    from tillwise.operators.rules import apply_rules

    run = apply_rules(df, {})
    assert run.data.columns == df.columns and run.report().count() == 0 and run.failed_rows("k").count() == 0


def test_python_rules_are_isolated(spark):
    from tillwise.operators.rules import PythonRule, apply_rules

    def share(rows):
        if (rows["b"] == 0).any():
            raise ZeroDivisionError
        return rows["a"] / rows["b"]

    df = spark.range(3000).selectExpr("id as k", "double(id) as a", "double(id % 500) as b", "if(id = 7, 1d, null) out")
    run = apply_rules(df, {"out": PythonRule(share, ["a", "b"]), "more": "out + 1",
                           "text": PythonRule(lambda r: r["k"].map(lambda k: None if k == 1 else f"n{k}"), ["k"], "string")})
    assert counts(run)["out"] == (1, 2993, 0, 6, None) and counts(run)["text"] == (0, 2999, 1, 0, None)
    assert {r["k"] for r in run.failed_rows("k").where("rule = 'out'").collect()} == set(range(0, 3000, 500))
    row = run.data.where("k = 1001").first()
    assert (row.out, row.more, row.text) == (1001.0, 1002.0, "n1001")


def test_cleaning_goes_on(spark):
    from tillwise.plans.clean_table import clean_table

    rows = [(k, f"2024-{k % 12 + 1:02d}-{k % 27 + 1:02d}", float(k % 40), float(k % 5),
             None if k % 3 else 1.0, "bad" if k % 10 == 0 else str(k)) for k in range(200)]
    raw = spark.createDataFrame(rows, ["line", "order_date", "weight", "boxes", "share", "code"])
    run = clean_table(raw, datetime.date(2025, 1, 1), lags=False,
                      rules={"share": "weight / boxes", "broken": "nope"})
    found = {(r.finding, r.subject): r.value for r in run.report.collect()}
    assert found["rule failed on rows", "share"] > 0 and found["rule filled", "share"] > 0
    assert found["rule error", "broken"] == 1.0 and run.data.count() == 200
