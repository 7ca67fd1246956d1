"""Intermediate tables in the shared folder that the session names.

Such a table outlives a lost executor and is computed once, however often it is read.  Callers
drop their scratch folder when nothing reads it any more.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from tillwise.session import checkpoint_folder


#: Spark's setting to delete an execution's shuffle files when the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A fresh folder beside the session's checkpoints.

    Once a table is written nothing reads the shuffles behind it, so they go at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/tillwise-{uuid.uuid4().hex}"
        atexit.register(self._drop_at_exit)

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _drop_at_exit(self) -> None:
        """Results are read from here while the program runs; nothing stays behind it."""
        with contextlib.suppress(Py4JError, OSError):
            self.drop()


def estimated_rows(df: DataFrame, most: int) -> int:
    """Rows of a table, counted no further than ``most`` + 1: a check before a broadcast."""
    return df.limit(most + 1).count()
