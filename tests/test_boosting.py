"""Boosted trees grown in one stage: Spark's own model, in a few jobs."""

import numpy as np
import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tillwise.operators import boosting as B
from tillwise.operators import learn as L


def _rows(spark, n, parts=1):
    k = F.col("id")
    kind = F.when(k % 7 == 0, "c").when(k % 3 == 0, "a").otherwise("b")
    return spark.range(0, n, 1, parts).select(
        F.date_add(F.lit("2001-01-01").cast("date"), (k % 400).cast("int")).alias("order_date"),
        kind.alias("product_category"), kind.alias("customer_region"), (k * 7919 % 1009 / 10).alias("price"),
        (k * 31 % 10).alias("discount_percent"), (k % 50).cast("int").alias("quantity_sold"),
        (k % 400 % 12).cast("int").alias("month"), F.lit(1.0).alias("rating"),
        F.when(k % 5 != 0, k * 104729 % 997 - 400.0).otherwise(0.0).alias("revenue_lag_7d"),
        (k * 7919 % 1009 / 10 * (k % 50) + k % 400 % 12 * 300 + k * 48271 % 2003).alias("net_revenue"))


def _features(df):
    codes = StringIndexer(inputCol="product_category", outputCol="code", stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df).transform(df)
    cols = ["price", "code", "discount_percent", "quantity_sold", "month", "rating", "revenue_lag_7d"]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(codes).withColumn(
        "label", F.col("net_revenue"))


def test_same_trees_as_spark(spark):
    asked = dict(maxIter=3, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    for n in (1, 9, 24_000):   # from 10 000 rows on thresholds come from a sample
        rows = _features(_rows(spark, n))
        want, got = GBTRegressor(**asked), B.BoostedRegressor(**asked)
        if n == 1:                  # fewer rows than categories: Spark's own refusal
            for which in (want, got):
                with pytest.raises(IllegalArgumentException, match="maxBins"):
                    which.fit(rows)
            continue
        want, got = want.fit(rows), got.fit(rows)
        assert want.toDebugString.split("\n")[1:] == got.toDebugString.split("\n")[1:]
        assert want.featureImportances == got.featureImportances
        a, b = ([r.prediction for r in m.transform(rows).orderBy("price", "order_date", "net_revenue").collect()]
                for m in (want, got))
        np.testing.assert_allclose(a, b, rtol=1e-12)


def test_jobs_do_not_grow_with_the_trees(spark):
    rows = _rows(spark, 900).cache()
    rows.count()
    spark.sparkContext.setJobGroup("boosting", "jobs of one training")
    try:
        L.train_revenue_model(rows, trees=8)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) < 30


def test_many_partitions(spark):
    """More partitions than tasks, an empty one among them, fit as well as one."""
    rows = _features(_rows(spark, 6_000))
    asked = dict(maxIter=8, maxDepth=4, seed=42)
    error = [F.avg(F.abs(F.col("prediction") - F.col("label")))]
    one, many = (B.BoostedRegressor(**asked).fit(r).transform(rows).agg(*error).first()[0]
                 for r in (rows, rows.repartition(11).union(rows.limit(0))))
    assert abs(one - many) < 0.05 * one


def test_sums_of_joined_inputs(monkeypatch):
    """Inputs that take few values together are summed together and give the same sums."""
    rng, n = np.random.default_rng(1), 3_000
    day = rng.integers(0, 90, n)
    bins = np.stack([day % 7, day // 7, rng.integers(0, 4, n), rng.integers(0, 32, n)]).astype(np.uint8)
    grower = B.Grower([np.arange(s - 1) + 0.5 for s in (7, 13, 4, 32)], [7, 13, 4, 32], 3, 1, 0.1, 0.8, 4, 42, 1, 0.0)
    sums = []
    for least in (1, n + 1):
        monkeypatch.setattr(B, "JOINED_FROM", least)
        monkeypatch.setattr(B, "MOST_CODES", 100)
        part = B.Part.__new__(B.Part)
        part.g, part.number, part.label = grower, 0, np.arange(n) % 977.0
        part.load(bins)
        part.begin(0)
        part.slot = np.arange(len(part.y)) % 3
        sums.append(part.sums(3))
        assert len(part.groups) == (3 if least == 1 else 4)
    np.testing.assert_allclose(*sums)
