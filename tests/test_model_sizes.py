"""Registered model queries ask the operators for their whole default job."""

import pytest
from conftest import SF

import __spark_entry__ as entry


class Asked(Exception):
    """Carries the keywords of the first training call."""


@pytest.mark.parametrize("name", [
    "train_revenue_model", "train_churn_model", "train_growth_model", "feature_importance",
    "score_revenue", "score_churn", "score_growth", "forecast_revenue_recursive",
    "forecast_growth_recursive"])
def test_default_trees(spark, monkeypatch, name):
    from tillwise.plans import model_reports as M

    def asked(_table, *args, **kw):
        raise Asked(args, kw)

    for model in ("revenue", "churn", "growth"):
        monkeypatch.setattr(M.L, f"train_{model}_model", asked)
        monkeypatch.setattr(M, f"_{model}_table", lambda i: None)
    with pytest.raises(Asked) as got:
        entry.queries()[name](spark, SF)
    assert got.value.args == ((), {})


def test_twelve_steps(spark, monkeypatch):
    from types import SimpleNamespace

    from tillwise.plans import model_reports as M

    table = spark.createDataFrame([("r", "2001-01-01", 1, 1)],
                                  "customer_region string, order_date string, order_id int, product_id int")
    monkeypatch.setattr(M, "_revenue_table", lambda i: table)
    monkeypatch.setattr(M.L, "train_revenue_model", lambda *_a, **_k: SimpleNamespace(model=None))
    monkeypatch.setattr(M.X, "forecast_revenue_recursive", lambda *a, steps=12: steps)
    assert entry.queries()["forecast_revenue_recursive"](spark, SF) == 12


def test_training_rows_over_all_cores(spark, monkeypatch):
    """A large table in one partition is trained on by all cores; a small one stays as it lies."""
    from pyspark.sql import functions as F

    from tillwise.operators import learn as L

    def fit(_self, train):
        raise Asked(train.rdd.getNumPartitions(), train.count())

    monkeypatch.setattr(L.Pipeline, "fit", fit)
    cores = spark.sparkContext.defaultParallelism
    for n, tasks in ((100, 1), (L.TASK_ROWS * cores * 2, cores)):
        table = spark.range(0, n, 1, 1).select(
            F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("order_date"),
            F.col("id").cast("string").alias("customer_region"), F.col("id").alias("price"),
            F.col("id").alias("net_revenue"))
        with pytest.raises(Asked) as got:
            L.train_revenue_model(table)
        assert got.value.args == (tasks, n * 8 // 10)
