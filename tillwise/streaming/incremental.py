"""Incremental loads of landed files with Structured Streaming.

Each run reads only the files that arrived since the last one (the checkpoint remembers), and
stops.  A restart after a failure resumes from the checkpoint; a batch that is replayed is
overwritten under its own batch id, so no row is taken twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.operators.erp import base_filter
from tillwise.operators.records import latest_per_key


def sync_new_files(spark: SparkSession, landing: str, schema, out: str, checkpoint: str,
                   kind: str | None = None, files_per_batch: int = 1000) -> None:
    """Take new landed Parquet files into ``out``, filtered to one record kind if named."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    if kind:
        src = src.where(base_filter(kind))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (src.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def synced_records(spark: SparkSession, out: str, key: str = "id", changed: str = "write_date"
                   ) -> DataFrame:
    """Newest version of every record taken so far; re-sent records collapse."""
    rows = spark.read.option("basePath", out).parquet(out)
    return latest_per_key(rows, [key], [changed, "batch"]).drop("batch")




# A keyed snapshot in hash buckets -----------------------------------------------------------

def _versions(spark: SparkSession, out: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, of batches before one if that is given; at most one entry a
    bucket."""
    try:
        log = spark.read.schema("bucket int, version long").parquet(f"{out}/log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    if before is not None:
        log = log.where(F.col("version") < before)
    return {r["bucket"]: r["version"] for r in log.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _bucket_path(out: str, version: int, bucket: int) -> str:
    return f"{out}/data/version={version}/bucket={bucket}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def merge_batch(batch: DataFrame, batch_id: int, out: str, key: str = "id", changed: str = "write_date",
                buckets: int = 64) -> None:
    """Put the newest records of a batch into the snapshot under ``out``.

    Only the buckets that the batch's keys fall into are read and written, under the batch's id as
    their version; a log entry then makes them current.  A batch that is replayed reads the
    versions before it and writes the same again.  Of equal change times the later batch wins.
    The version before the current one stays until the bucket is written again.
    """
    spark = batch.sparkSession
    new = batch.withColumns({"_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"),
                             "_batch": F.lit(batch_id).cast("long")})
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return
    current = _versions(spark, out, batch_id)
    old = [_bucket_path(out, current[b], b) for b in touched if b in current]
    rows = new.drop("_bucket")
    if old:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
    newest = latest_per_key(rows, [key], [changed, "_batch"]).withColumn(
        "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/version={batch_id}")
    spark.createDataFrame([(b, batch_id) for b in touched], "bucket int, version long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
    # what the versions just replaced had replaced themselves is of no more use, not even for a replay
    log = spark.read.schema("bucket int, version long").parquet(f"{out}/log")
    for r in log.groupBy("bucket").agg(F.sort_array(F.collect_list("version"), asc=False).alias("v")).collect():
        if r["bucket"] in touched and len(r["v"]) > 2:
            _delete(spark, _bucket_path(out, r["v"][2], r["bucket"]))


def sync_snapshot(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, kind: str | None = None,
                  key: str = "id", changed: str = "write_date", buckets: int = 64,
                  files_per_batch: int = 1000) -> None:
    """Take new landed Parquet files into a snapshot with one row for each key."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    if kind:
        src = src.where(base_filter(kind))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            merge_batch(batch, batch_id, out, key, changed, buckets)
        finally:
            batch.unpersist()

    q = (src.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def snapshot_records(spark: SparkSession, out: str, schema) -> DataFrame:
    """The snapshot's rows: the current version of each bucket, nothing else is read."""
    paths = [_bucket_path(out, v, b) for b, v in sorted(_versions(spark, out).items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)
