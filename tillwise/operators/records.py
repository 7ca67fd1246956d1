"""Registry tables: latest versions, upserts, deletes, histories.

"Latest per key" is ``max_by`` over a struct, combined on the map side, so a key with a third of
all rows is no hot spot.  Top-n per key filters ``row_number() <= n``, which Spark limits before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import col


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values in each key (add a unique tie-breaker)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str],
           order: Sequence[str]) -> DataFrame:
    """Insert or replace by key; of equal order values the new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [*order, "_new"]).drop("_new")


def latest_upload_per_user(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's newest upload that has a table; users without one get the newest of all."""
    ready = uploads.where(F.col("table_name").isNotNull() & (F.col("table_name") != ""))
    pick = F.max_by(F.struct("upload_id", "table_name", "uploaded_at"),
                    F.struct("uploaded_at", "upload_id"))
    own = ready.groupBy("user_id").agg(pick.alias("own"))
    anyone = ready.agg(pick.alias("a")).scalar()
    return users.select("user_id").join(own, "user_id", "left").select(
        "user_id", F.coalesce("own", anyone).alias("u")).select(
        "user_id", "u.upload_id", "u.table_name", "u.uploaded_at")


def mark_active(versions: DataFrame, keys: Sequence[str], created: str, row_id: str) -> DataFrame:
    """Flag the newest version of each key; all others are retired."""
    newest = versions.groupBy(*keys).agg(F.max(F.struct(created, row_id)).alias("_top"))
    return versions.join(newest, list(keys)).withColumn(
        "is_active", F.struct(created, row_id) == F.col("_top")).drop("_top")


def delete_source(chunks: DataFrame, source) -> DataFrame:
    """Chunks without those of a source (a name) or of a table of sources."""
    if isinstance(source, DataFrame):
        return chunks.join(source.select("source"), "source", "left_anti")
    return chunks.where(col("source") != F.lit(source))


def delete_dataset_rows(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of mappings, predictions or uploads without those of deleted uploads."""
    return rows.join(deleted.select("upload_id"), "upload_id", "left_anti")


def history_top_n(rows: DataFrame, n: int, created: str, row_id: str,
                  by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Newest ``n`` rows of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(created), F.desc(row_id))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def friendly_name(file_name) -> Column:
    """``customer-churn-q1.csv`` -> ``Customer Churn Q1``."""
    f = col(file_name)
    base = F.regexp_replace(f, r"(?<=[^.])\.[^.]*$", "")
    return F.when(f.isNull() | (f == ""), "Unknown").otherwise(
        F.initcap(F.regexp_replace(base, "[-_]", " ")))


def list_datasets(uploads: DataFrame) -> DataFrame:
    """All uploads, newest first, with display names."""
    return uploads.select(
        F.col("upload_id").alias("id"), friendly_name("file_name").alias("name"),
        F.col("file_name").alias("file"), "table_name",
        F.coalesce("rows_count", F.lit(0)).alias("rows"),
        F.coalesce("status", F.lit("completed")).alias("status"), "user_id", "uploaded_at",
    ).orderBy(F.desc("uploaded_at"), F.desc("id"))


def join_upload_history(predictions: DataFrame, mappings: DataFrame,
                        calibrators: DataFrame) -> DataFrame:
    """Predictions with the active mapping of their upload and the active calibrator of their user."""
    m = latest_per_key(mappings, ["upload_id", "model_kind"], ["created_at", "mapping_id"]).select(
        "upload_id", "model_kind", "mapping_id")
    c = latest_per_key(calibrators, ["user_id", "model_kind"], ["created_at", "calibrator_id"]).select(
        "user_id", "model_kind", "calibrator_id")
    return predictions.join(m, ["upload_id", "model_kind"], "left").join(
        c, ["user_id", "model_kind"], "left")


def prediction_summary(kind="kind", value="value", risk="risk_level") -> Column:
    """One line of text per prediction."""
    v = col(value)
    money = F.format_number(v, 2)
    return (
        F.when(v.isNull(), F.lit("Prediction completed."))
        .when(col(kind) == "revenue", F.concat(F.lit("Predicted revenue: $"), money))
        .when(col(kind) == "churn", F.concat(
            F.lit("Churn risk: "), F.coalesce(col(risk), F.lit("unknown")), F.lit(" ("),
            F.format_string("%.1f", v * 100), F.lit("%)")))
        .when(col(kind) == "growth", F.concat(F.lit("3-month forecast: $"), money))
        .otherwise(F.lit("Prediction completed.")))


def sync_stats(uploads: DataFrame, category: str = "erp") -> DataFrame:
    """Last completed sync and number of synced uploads."""
    return uploads.where(F.col("category") == category).agg(
        F.max(F.when(F.col("status") == "completed", F.col("uploaded_at"))).alias("last_sync"),
        F.count("*").alias("uploads"))


def aggregate_rows_preview(df: DataFrame, label: str, n: int = 500) -> DataFrame:
    """First rows of an aggregate as (label, map of features)."""
    pairs = []
    for c in df.columns:
        pairs += [F.lit(c), col(c).cast("string")]
    return df.orderBy(col(label)).limit(n).select(
        F.coalesce(col(label).cast("string"), F.lit("?")).alias("label"),
        F.create_map(*pairs).alias("features"))


def preview_rows(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """First rows (1..500) in a stated order."""
    return df.orderBy(*[col(c) for c in order]).limit(max(1, min(n, 500)))


def preview_counts(views: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each view of a dataset."""
    out = None
    for name, df in views.items():
        one = df.agg(F.count("*").alias("total_rows")).select(
            F.lit(name).alias("view"), "total_rows",
            F.lit(", ".join(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out
