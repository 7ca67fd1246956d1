"""Plan checks: pruned scans, pushed filters, limits before the shuffle."""

import re

import pytest
from conftest import SF

import __spark_entry__ as entry
from tillwise.operators.aggregates import monthly_aggregate, monthly_lags

QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [
    ("dashboard_kpis", {"l_orderkey", "l_extendedprice", "l_discount"}),
    ("top_categories", {"l_extendedprice", "l_discount", "l_returnflag"}),
])
def test_pruned_scan(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    read = set(re.findall(r"(l_\w+):", scan[scan.index("ReadSchema"):]))
    assert columns <= read and not read & {"l_shipdate", "l_linestatus", "l_suppkey", "l_tax"}


def test_filter_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderdate >= '2000-08-01'")
    plan = plan_of(monthly_lags(monthly_aggregate(orders, "o_orderdate", "o_totalprice")))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["history_top_n"](spark, SF))
    assert plan.index("Partial") > plan.index("Exchange hashpartitioning")


def test_windows_over_orders_are_partitioned(spark):
    """A lag without a group still runs over time slices, not over one partition."""
    plan = plan_of(QUERIES["global_lag_features"](spark, SF))
    scan_side = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "SinglePartition" not in scan_side
