"""Registered queries: a Spark callable and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, **kinds: str):
    """Register ``fn(inputs) -> DataFrame`` under ``name``; ``kinds`` casts columns of the twin."""

    def wrap(fn):
        from tillwise.plans.inputs import Inputs, typed

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = typed(sql, **kinds) if kinds else sql.strip()
        return fn

    return wrap
