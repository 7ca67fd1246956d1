"""Encoding, splits, training, metrics and scoring on pyspark.ml."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, ratio, scalar
from tillwise.functions.lags import range_number
from tillwise.functions.vocab import (
    CHURN_MODEL_INPUTS, GROWTH_MODEL_INPUTS, MODEL_FEATURES, REVENUE_MODEL_INPUTS,
)
from tillwise.operators.boosting import BoostedRegressor
from tillwise.operators.calibration_jobs import Calibrators, apply_all
from tillwise.operators.mapping import apply_mapping, pad_revenue_features, pad_zero_features
from tillwise.session import spread


# Preparation --------------------------------------------------------------------------------

def label_encoder(df: DataFrame, columns: Sequence[str]):
    """Integer per category in sorted order; unseen values get the next number."""
    return StringIndexer(inputCols=list(columns), outputCols=[f"{c}_code" for c in columns],
                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, label, code): the labels of each column numbered from 0 in sorted order.

    Different labels are cut into ranges of similar size and numbered inside them; a range begins at
    the number of labels of its column in the ranges before it.  No label list reaches the driver.
    """
    labels = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), col(c).cast("string").alias("label")) for c in columns])).alias("x")).select(
        "x.*").where("label IS NOT NULL").distinct()
    labels = labels.withColumn("range", range_number(labels, ["column_name", "label"]))
    sizes = labels.groupBy("column_name", "range").agg(F.count("*").alias("n"))
    # one row for each column and range
    before = Window.partitionBy("column_name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("column_name", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("column_name", "range").orderBy("label"))
    return labels.withColumn("place", inside).join(starts, ["column_name", "range"]).select(
        "column_name", "label", (F.col("start") + F.col("place") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """``df`` with an integer for each category in sorted order.

    ``codes``: those of other rows, for instance the training rows; a value they do not hold, or a
    missing one, gets the next number.
    """
    codes = label_codes(df, columns) if codes is None else codes
    for c in columns:
        own = codes.where(F.col("column_name") == c)
        unseen = own.agg(F.count("*").cast("int")).scalar()
        found = own.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        df = df.join(found, col(c).cast("string") == F.col("_label"), "left").withColumn(
            f"{c}_code", F.coalesce("_code", unseen)).drop("_label", "_code")
    return df


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, from the training rows."""
    row = train.agg(*[F.struct(F.avg(col(c).cast("double")).alias("m"),
                               F.stddev_pop(col(c).cast("double")).alias("s")).alias(f"c{k}")
                      for k, c in enumerate(columns)]).first()
    return {c: (row[k].m, row[k].s or 1.0) for k, c in enumerate(columns)}


def standard_scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (col(c).cast("double") - m) / s for c, (m, s) in scaler.items()})


def temporal_split(df: DataFrame, date: str, share: float = 0.80) -> DataFrame:
    """``is_train`` for the first share of rows by date; a day never straddles the cut.

    The cut comes from running counts over the table of days, not from a sort of the rows.
    """
    days = df.where(col(date).isNotNull()).groupBy(col(date).cast("date").alias("d")).agg(
        F.count("*").alias("k"))
    run = days.withColumn("seen", F.sum("k").over(Window.orderBy("d")))
    total = scalar(days, F.sum("k"))
    cut = run.where(F.col("seen") >= F.greatest(F.floor(total * F.lit(share)), F.lit(1))).agg(
        F.min("d")).scalar()
    return df.withColumn("is_train", F.coalesce(col(date).cast("date") <= cut, F.lit(False)))


def last_months_split(df: DataFrame, month: str, keep: int = 4) -> DataFrame:
    """``is_train`` for all but the last months: ``keep`` of them, at most a quarter."""
    w = Window.orderBy(F.desc(month))
    n = scalar(df, F.count("*"))
    hold = F.least(F.lit(keep), F.greatest(F.lit(1), F.floor(n / 4)))
    return df.withColumn("is_train", F.row_number().over(w) > hold)


def random_split(df: DataFrame, key: str, share: int = 80, seed: int = 42) -> DataFrame:
    """``is_train`` by a hash of the key: stable under any partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), 1, 8), 16, 10)
    return df.withColumn("is_train", h.cast("long") % 100 < share)


# Training -----------------------------------------------------------------------------------

#: Training rows of a task, at least and at most: boosting scans them at every level of every tree.
TASK_ROWS, MOST_ROWS = 20_000, 500_000


@dataclass
class Trained:
    """A fitted model with its inputs, metrics (one row) and importances."""

    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    importances: DataFrame


def _zeroed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(col(f).cast("double"), F.lit(0.0)) for f in features})


def _importances(spark, model, features, name) -> DataFrame:
    rows = [(name, f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def train_revenue_model(df: DataFrame, share: float = 0.80, trees: int = 300, depth: int = 6,
                        rate: float = 0.08) -> Trained:
    """Boosted regression of net revenue on inputs known before the outcome."""
    cats = [c for c in ("product_category", "customer_region", "payment_method") if c in df.columns]
    feats = [f for f in REVENUE_MODEL_INPUTS if f in df.columns]
    rows = _zeroed(temporal_split(df, "order_date", share), [f for f in feats if f not in cats])
    rows = rows.withColumn("label", F.col("net_revenue").cast("double"))
    used = [f"{f}_code" if f in cats else f for f in feats]
    train = spread(rows.where("is_train"), TASK_ROWS, MOST_ROWS)
    steps = Pipeline(stages=[
        StringIndexer(inputCols=cats, outputCols=[f"{c}_code" for c in cats],
                      stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=used, outputCol="features"),
        BoostedRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
                         featureSubsetStrategy="0.8", seed=42)])
    model = steps.fit(train)
    test = model.transform(rows.where(~F.col("is_train")))
    return Trained(model, feats, regression_metrics(test, "label", "prediction"),
                   _importances(df.sparkSession, model.stages[-1], feats, "revenue"))


def train_churn_model(df: DataFrame, trees: int = 300, depth: int = 4, rate: float = 0.1,
                      key: str = "customer_id") -> Trained:
    """Boosted classification of labelled customers; recency and risk score stay out (leakage)."""
    cats = [c for c in ("customer_segment", "preferred_region") if c in df.columns]
    feats = [f for f in CHURN_MODEL_INPUTS if f in df.columns]
    rows = _zeroed(random_split(df, key), [f for f in feats if f not in cats])
    rows = rows.withColumn("label", F.col("is_churned").cast("double"))
    train = spread(rows.where("is_train"), TASK_ROWS, MOST_ROWS)
    pos = train.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    weight = (pos.n - pos.p) / pos.p if pos.p else 1.0
    train = train.withColumn("weight", F.when(F.col("label") == 1, float(weight)).otherwise(1.0))
    used = [f"{f}_code" if f in cats else f for f in feats]
    stages = [VectorAssembler(inputCols=used, outputCol="features"),
              GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", weightCol="weight", seed=42)]
    if cats:
        stages.insert(0, StringIndexer(inputCols=cats, outputCols=[f"{c}_code" for c in cats],
                                       stringOrderType="alphabetAsc", handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(train)
    test = churn_probability(model.transform(rows.where(~F.col("is_train")).withColumn("weight", F.lit(1.0))))
    return Trained(model, feats, classification_metrics(test, "label", "churn_prob"),
                   _importances(df.sparkSession, model.stages[-1], feats, "churn"))


def train_growth_model(monthly: DataFrame, holdout: int = 4, trees: int = 100, depth: int = 3,
                       rate: float = 0.05) -> Trained:
    """Boosted regression of the three-month projection; the last months are held out."""
    feats = [f for f in GROWTH_MODEL_INPUTS if f in monthly.columns]
    rows = _zeroed(last_months_split(monthly, "month_label", holdout), feats)
    rows = rows.withColumn("label", F.col("revenue_3m_forecast").cast("double"))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=feats, outputCol="features"),
        GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
                     featureSubsetStrategy="0.8", seed=42)]).fit(spread(rows.where("is_train"), TASK_ROWS, MOST_ROWS))
    test = model.transform(rows.where(~F.col("is_train")))
    return Trained(model, feats, regression_metrics(test, "label", "prediction"),
                   _importances(monthly.sparkSession, model.stages[-1], feats, "growth"))


def churn_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("churn_prob", vector_to_array("probability")[1])


# Metrics ------------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, predicted: str,
                       by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, MAE, R², MAPE (zero actuals left out), sMAPE and bias, in one aggregate."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    e = y - p
    half = (F.abs(y) + F.abs(p)) / 2
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.coalesce(F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100, F.lit(0.0))
        .alias("mape_pct"),
        F.coalesce(F.avg(F.when(half != 0, F.abs(e) / F.nullif(half, F.lit(0.0)))) * 100, F.lit(0.0))
        .alias("smape_pct"),
        F.avg(p - y).alias("bias"), F.count(F.lit(1)).alias("n_rows"))


def classification_metrics(df: DataFrame, label: str, probability: str,
                           threshold: float = 0.5) -> DataFrame:
    """ROC-AUC, F1, precision, recall and base rate.

    The area is exact: Spark sorts the distinct scores across the cluster.
    """
    pairs = df.select(col(label).cast("double").alias("label"),
                      col(probability).cast("double").alias("score"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(pairs)
    hit = F.col("score") >= threshold
    pos = F.col("label") == 1
    c = pairs.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                  F.count_if(~hit & pos).alias("fn"), F.count(F.lit(1)).alias("n_rows"),
                  F.avg("label").alias("base_rate"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.select(
        F.lit(auc).alias("roc_auc"),
        zero(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        zero(ratio("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        zero(ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"), "base_rate", "n_rows")


# Scoring ------------------------------------------------------------------------------------

def _mapped(df, mapping, kind, as_of, keep, categories=()):
    """Model inputs plus the kept columns as one struct, so names cannot clash; and the table's own
    categories, which the mapping to numbers leaves out."""
    given = [(c, mapping.get(c) or c) for c in categories if (mapping.get(c) or c) in df.columns]
    held = df.withColumns({"_keep": F.struct(*[col(k) for k in keep]), "_given": F.struct(
        F.lit(0).alias("none"), *[col(src).cast("string").alias(c) for c, src in given])})
    return apply_mapping(held, mapping, kind, as_of, ("_keep", "_given")), {c for c, _ in given}


def _category(trained: Trained, name: str, given: set[str]):
    """A category as given; where it is missing, the one with code 0."""
    zero = ""
    for stage in trained.model.stages:
        if isinstance(stage, StringIndexerModel) and name in stage.getInputCols():
            zero = next(iter(stage.labelsArray[stage.getInputCols().index(name)]), "")
    return F.coalesce(F.col("_given")[name], F.lit(zero)) if name in given else F.lit(zero)


def score_revenue(df: DataFrame, mapping: dict, trained: Trained, as_of: datetime.date,
                  keep: tuple[str, ...] = (), calibrators: Calibrators | None = None) -> DataFrame:
    """Map, pad and predict every row in one plan; ``keep`` columns come along.

    With ``calibrators``, and ``user_id`` among the kept columns, ``calibrated`` is added.
    """
    cats = [c for c in ("product_category", "customer_region", "payment_method")
            if c in trained.features]
    mapped, given = _mapped(df, mapping, "revenue", as_of, keep, cats)
    padded = pad_revenue_features(mapped, trained.features, as_of)
    padded = padded.withColumns({c: _category(trained, c, given) for c in cats}) if cats else padded
    out = trained.model.transform(padded).select("_keep.*", "prediction")
    return calibrated_scores(out, "revenue", calibrators) if calibrators else out


def score_churn(df: DataFrame, mapping: dict, trained: Trained, as_of: datetime.date,
                keep: tuple[str, ...] = (), calibrators: Calibrators | None = None) -> DataFrame:
    cats = [c for c in ("customer_segment", "preferred_region") if c in trained.features]
    mapped, given = _mapped(df, mapping, "churn", as_of, keep, cats)
    padded = pad_zero_features(mapped, [f for f in trained.features if f not in cats])
    padded = padded.withColumns({**{c: _category(trained, c, given) for c in cats},
                                 "weight": F.lit(1.0)})
    out = churn_probability(trained.model.transform(padded)).select("_keep.*", "churn_prob")
    return calibrated_scores(out, "churn", calibrators, raw="churn_prob") if calibrators else out


def score_growth(df: DataFrame, mapping: dict, trained: Trained, as_of: datetime.date,
                 keep: tuple[str, ...] = (), calibrators: Calibrators | None = None) -> DataFrame:
    mapped, _given = _mapped(df, mapping, "growth", as_of, keep)
    padded = pad_zero_features(mapped, trained.features)
    out = trained.model.transform(padded).select("_keep.*", "prediction")
    return calibrated_scores(out, "growth", calibrators) if calibrators else out


def calibrated_scores(scored: DataFrame, model_kind: str, fitted: Calibrators, user: str = "user_id",
                      raw: str = "prediction") -> DataFrame:
    """``scored`` with ``calibrated``, each row through the active calibrator of its user for this kind."""
    rows = scored.select(F.struct(*[col(c) for c in scored.columns]).alias("_scored"), col(user).cast("long").alias(
        "user_id"), F.lit(model_kind).alias("model_kind"), col(raw).alias("_raw"))
    return apply_all(rows, fitted, "_raw").select("_scored.*", "calibrated")


def mapping_of(model_kind: str) -> dict[str, str]:
    """Identity mapping for tables that already use the model's names."""
    return {f: f for f in MODEL_FEATURES[model_kind]}
