"""A published 24-month series: its derived columns and its profile."""

from decimal import Decimal

from pyspark.sql import functions as F

from tillwise.operators.aggregates import monthly_growth_features
from tillwise.operators.profiles import growth_profile

# month, revenue, month growth, year growth, 3-month mean, projection (fixed values)
SERIES = """
2022-01 1320194.83 - - 1320194.83 1320194.83
2022-02 1168247.8 -0.1151 - 1244221.32 1101011.45
2022-03 1313740.22 0.1245 - 1267394.28 1425184.87
2022-04 1259671.38 -0.0412 - 1247219.8 1195834.34
2022-05 1290951.36 0.0248 - 1288120.99 1320066.39
2022-06 1264561.87 -0.0204 - 1271728.2 1245784.94
2022-07 1255860.07 -0.0069 - 1270457.77 1261691.61
2022-08 1363968.22 0.0861 - 1294796.72 1406278.72
2022-09 1311487.4 -0.0385 - 1310438.56 1259986.68
2022-10 1221934.22 -0.0683 - 1299129.95 1210399.37
2022-11 1190211.65 -0.026 - 1241211.09 1208939.6
2022-12 1270917.64 0.0678 - 1227687.84 1310925.08
2023-01 1362415.7 0.072 0.032 1274515.0 1366280.08
2023-02 1152602.69 -0.154 -0.0134 1261978.68 1067633.96
2023-03 1270507.44 0.1023 -0.0329 1261841.94 1390928.37
2023-04 1224157.64 -0.0365 -0.0282 1215755.92 1171380.83
2023-05 1333946.83 0.0897 0.0333 1276203.97 1390679.47
2023-06 1302724.09 -0.0234 0.0302 1286942.85 1256828.39
2023-07 1344204.68 0.0318 0.0703 1326958.53 1369155.81
2023-08 1299398.77 -0.0333 -0.0473 1315442.51 1271638.27
2023-09 1249973.76 -0.038 -0.0469 1297859.07 1248540.43
2023-10 1334103.65 0.0673 0.0918 1294492.06 1381611.38
2023-11 1236407.32 -0.0732 0.0388 1273494.91 1180275.08
2023-12 1244166.21 0.0063 -0.021 1271559.06 1279569.88
"""
ROWS = [line.split() for line in SERIES.strip().splitlines()]


def _monthly(spark):
    return spark.createDataFrame([(r[0] + "-01", float(r[1])) for r in ROWS],
                                 "m string, monthly_revenue double").select(
        F.to_date("m").alias("month_label"), "monthly_revenue")


def test_growth_features(spark):
    got = monthly_growth_features(_monthly(spark)).orderBy("month_label").collect()
    num = lambda s: None if s == "-" else float(s)
    for g, r in zip(got, ROWS):
        assert [g.mom_growth, g.yoy_growth, g.revenue_3m_avg, g.revenue_3m_forecast] == \
            [num(x) for x in r[2:]], r[0]


def test_growth_profile(spark):
    g = growth_profile(_monthly(spark)).first()
    assert (g.strategy, g.confidence) == ("full_forecasting", "medium")
    assert g.definition == (
        "This dataset has 24 months of history (2022-01 to 2023-12), enough for full forecasting "
        "with year-over-year comparisons. Recommended split: 20 months for training, 4 for test. "
        "Forecasts up to 6 months ahead are defensible; beyond that the model would be "
        "extrapolating.")
    assert g.total_revenue == float(sum(Decimal(r[1]) for r in ROWS)) == 30586355.44
    assert (g.median_monthly_revenue, g.min_monthly_revenue, g.max_monthly_revenue) == \
        (1270712.54, 1152602.69, 1363968.22)
    assert (g.safe_horizon_months, g.recommended_train_months, g.recommended_test_months) == (6, 20, 4)
    assert g.warnings == []


def test_holdout_window(spark):
    """A 729-day span gives a 121-day holdout and its cutoff."""
    from tillwise.operators.churn import churn_customers, churn_report

    df = spark.createDataFrame([(1, "2022-01-01"), (1, "2023-12-31"), (2, "2022-03-01"), (2, "2022-04-01")],
                               "customer_id long, order_date string")
    r = churn_report(churn_customers(df, "customer_id", "order_date")).first()
    assert (r.data_span_days, r.holdout_window_days, r.cutoff_date) == (729, 121, "2023-09-01")
    assert (r.eligible_customers, r.churned_customers) == (2, 1)
