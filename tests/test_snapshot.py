"""The keyed snapshot: buckets, replays, ties, missing keys."""

import glob
import os

from pyspark.sql import functions as F

SCHEMA = "id long, state string, write_date string"


def written(out):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{out}/data/*/*/*.parquet")}


def rows(spark, out):
    from tillwise.streaming.incremental import snapshot_records

    return {r["id"]: (r["state"], r["write_date"]) for r in snapshot_records(spark, out, SCHEMA).collect()}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    from tillwise.streaming.incremental import merge_batch

    out = str(tmp_path / "out")
    assert rows(spark, out) == {}
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    merge_batch(frame([(k, "a", "2024-01-01") for k in range(200)] + [(None, "n", "2024-01-01")]), 0, out, buckets=8)
    first = written(out)
    assert len(first) == 8 and len(rows(spark, out)) == 201
    one = frame([(7, "b", "2024-02-01"), (7, "old", "2023-01-01"), (7, "c", "2024-02-02")])
    merge_batch(one, 1, out, buckets=8)
    added = {p for p in written(out) if p not in first}
    assert len(added) == 1 and "version=1/" in added.pop() and set(first) <= set(written(out))
    assert rows(spark, out)[7] == ("c", "2024-02-02") and len(rows(spark, out)) == 201
    # the same batch again, an equal change time from a later batch, an older one
    merge_batch(one, 1, out, buckets=8)
    assert rows(spark, out)[7] == ("c", "2024-02-02") and len(rows(spark, out)) == 201
    merge_batch(frame([(7, "d", "2024-02-02"), (8, "x", "2023-01-01")]), 2, out, buckets=8)
    got = rows(spark, out)
    assert got[7] == ("d", "2024-02-02") and got[8] == ("a", "2024-01-01") and got[None] == ("n", "2024-01-01")
    # versions that were replaced twice are gone
    merge_batch(frame([(7, "e", "2024-03-01")]), 3, out, buckets=8)
    bucket = spark.range(7, 8).select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).first().b
    assert len(glob.glob(f"{out}/data/*/bucket={bucket}")) == 2
    assert rows(spark, out)[7] == ("e", "2024-03-01") and len(rows(spark, out)) == 201
    merge_batch(frame([]), 4, out, buckets=8)
    assert len(rows(spark, out)) == 201


def test_stream_resumes(spark, tmp_path):
    from tillwise.streaming.incremental import sync_snapshot

    landing, out, marks = (str(tmp_path / n) for n in ("landing", "out", "marks"))
    for start in (0, 50):
        spark.range(start, start + 100).selectExpr("id", "'s' || id AS state", f"'2024-01-{start + 10}' AS write_date") \
            .write.mode("append").parquet(landing)
        for _ in range(2):  # a run without new files changes nothing
            sync_snapshot(spark, landing, SCHEMA, out, marks, buckets=4)
    got = rows(spark, out)
    assert len(got) == 150 and got[49] == ("s49", "2024-01-10") and got[50] == ("s50", "2024-01-60")
