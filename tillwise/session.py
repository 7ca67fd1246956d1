"""Session settings.

Only settings that change results or planning are set here; master, memory and the
checkpoint folder belong to the cluster.  ``spark.checkpoint.dir`` is read from the
session; only a local master, where all tasks see the same disk, may do without it.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

PLANNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLANNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; on a local master a temporary one will do."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tillwise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df, eager: bool = True):
    """Cut lineage through reliable storage, so a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def spread(df, least: int, most: int, rows: int | None = None):
    """``df`` over all cores where its rows are many: at least ``least`` rows a task, at most ``most``.

    For rows that cost much each, or are scanned often, out of a table that few tasks read.  One too
    small for two tasks stays as it is.  ``rows``: their number, where it is known.
    """
    n = df.count() if rows is None else rows
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, n // least), n // most)
    return df.repartition(tasks) if tasks > 1 else df
