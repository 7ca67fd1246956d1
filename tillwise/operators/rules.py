"""User equations that fill missing cells, evaluated so that a bad row costs only its own cell.

A rule is SQL text, a Column, a function from the DataFrame to a Column, or a ``PythonRule``.  A rule that
does not resolve is skipped and reported.  One that resolves is evaluated on the rows whose cell is
missing; a row on which it raises (a zero divisor, a text that is no number, an overflow, an index
beyond an array) keeps its NULL and is counted as failed, apart from rows whose outcome is NULL.

Columns are evaluated inside Spark's own try expression, as part of the generated code.  It stands in
a branch of a CASE, because expressions that several rules share are otherwise computed ahead of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col

GIVEN, FILLED, EMPTY, FAILED = range(4)


@dataclass(frozen=True)
class PythonRule:
    """A function of a pandas frame with the columns ``inputs``, giving one value for each row.

    A batch on which it raises is halved until the rows at fault stand alone.
    """

    function: Callable[[pd.DataFrame], pd.Series]
    inputs: Sequence[str]
    type: str = "double"

    def column(self, type_: str) -> Column:
        """struct(v, failed) of each row, v cast to ``type_``."""
        function, own = self.function, self.type

        @F.pandas_udf(f"v {own}, failed boolean")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                values = pd.Series([None] * len(rows), dtype=object)
                failed = pd.Series(False, index=range(len(rows)))
                spans = [(0, len(rows))] if len(rows) else []
                while spans:
                    a, b = spans.pop()
                    try:
                        part = rows.iloc[a:b].reset_index(drop=True)
                        found = pd.Series(function(part), index=part.index)
                        found = found.astype(object).where(found.notna(), None)
                        values.iloc[a:b] = found.to_numpy()
                    except Exception:  # whatever a user's function raises, the row is at fault
                        if b - a == 1:
                            failed.iloc[a] = True
                        else:
                            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
                yield pd.DataFrame({"v": values, "failed": failed})

        out = run(F.struct(*[col(c) for c in self.inputs]))
        return F.struct(out["v"].cast(type_).alias("v"), out["failed"].alias("failed"))


def attempted(df: DataFrame, value: Column) -> Column:
    """struct(v) of a value, or NULL on rows where its evaluation raises."""
    jvm = df.sparkSession._jvm.org.apache.spark.sql
    convert = jvm.classic.ExpressionUtils
    tried = jvm.catalyst.expressions.TryEval(convert.expression(F.struct(value.alias("v"))._jc))
    return type(value)(convert.column(tried))


def references(df: DataFrame, value: Column) -> list[str]:
    """Columns of ``df`` that a value reads."""
    found = df.select(value.alias("x"))._jdf.queryExecution().analyzed().references().toSeq()
    return [found.apply(k).name() for k in range(found.size())]


@dataclass
class RuleRun:
    """``data`` with its cells filled; ``errors`` of rules that do not resolve; what became of the rows."""

    data: DataFrame
    errors: list[tuple[str, str]]
    states: DataFrame = field(repr=False)
    names: list[str]

    def report(self) -> DataFrame:
        """Per rule the rows that had a value, were filled, stay NULL, or failed, and the error of a
        rule that was skipped."""
        schema = "rule string, error string"
        skipped = self.data.sparkSession.createDataFrame(self.errors, schema).select(
            "rule", *[F.lit(0).cast("long").alias(c) for c in ("given", "filled", "empty", "failed")], "error")
        if not self.names:
            return skipped
        counts = self.states.agg(*[F.count_if(F.col(f"__rule{k}") == s).alias(f"n{k}_{s}")
                                   for k in range(len(self.names)) for s in range(4)])
        rows = F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), *[F.col(f"n{k}_{s}").alias(c) for s, c in
                     enumerate(("given", "filled", "empty", "failed"))])
            for k, name in enumerate(self.names)])).alias("r")
        return counts.select(rows).select("r.*", F.lit(None).cast("string").alias("error")).unionByName(skipped)

    def failed_rows(self, *keys: str) -> DataFrame:
        """The rows on which rules failed, by their key columns."""
        if not self.names:
            return self.states.select(F.lit(None).cast("string").alias("rule"), *[col(c) for c in keys]) \
                .where("false")
        hit = F.array_compact(F.array(*[F.when(F.col(f"__rule{k}") == FAILED, F.lit(n))
                                        for k, n in enumerate(self.names)]))
        return self.states.select(F.explode(hit).alias("rule"), *[col(c) for c in keys])


def _resolved(df: DataFrame, rule) -> Column:
    if callable(rule) and not isinstance(rule, Column):
        rule = rule(df)
    return F.expr(rule) if isinstance(rule, str) else rule


def _tried(df: DataFrame, name: str, rule) -> tuple[Column, str]:
    """The outcome of a rule on the rows of ``df`` whose cell is missing, a struct with v, and its type.

    Of a ``PythonRule`` it says whether the row failed; else it is NULL where evaluation raises.
    """
    given = dict(df.dtypes).get(name)
    if isinstance(rule, PythonRule):
        tried = rule.column(given or rule.type)
        df.select(tried)
        return tried, given or rule.type
    value = _resolved(df, rule)
    type_ = given or df.select(value.alias("x")).dtypes[0][1]
    value = value.cast(type_) if given else value
    df.select(value)
    if type_ in ("double", "float"):
        value = F.nanvl(value, F.lit(None).cast(type_))
    if given:
        missing = col(name).isNull()
    else:  # a condition that is always true, and that is kept
        read = references(df, value)
        missing = col(read[0]).isNull() | col(read[0]).isNotNull() if read else F.lit(True)
    return F.when(missing, attempted(df, value)), type_


def apply_rules(df: DataFrame, rules: dict) -> RuleRun:
    """Fill NULLs of the columns the rules name, or create the columns, one rule after the other.

    A rule sees what the rules before it have filled.  NaN counts as missing in what a rule gives.
    """
    errors, names, original = [], [], list(df.columns)
    for name, rule in rules.items():
        try:
            tried, type_ = _tried(df, name, rule)
        except (AnalysisException, ParseException) as e:
            errors.append((name, e.getCondition() or "ANALYSIS_ERROR"))
            continue
        except Exception as e:  # a user's function may raise anything
            errors.append((name, type(e).__name__))
            continue
        mark, out = f"__rule{len(names)}", F.col("__tried")
        old = col(name) if name in df.columns else F.lit(None).cast(type_)
        failed = out["failed"] if isinstance(rule, PythonRule) else out.isNull()
        state = F.when(old.isNotNull(), GIVEN).when(failed, FAILED).when(out["v"].isNull(), EMPTY).otherwise(FILLED)
        df = df.withColumn("__tried", tried).withColumns({mark: state, name: F.coalesce(old, out["v"])}) \
            .drop("__tried")
        names.append(name)
        if name not in original:
            original.append(name)
    data = df.drop(*[f"__rule{k}" for k in range(len(names))])
    return RuleRun(data.select(*[col(c) for c in original]), errors, df, names)


def custom_rule_impute(df: DataFrame, rules: dict) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The filled data and the rules that do not resolve."""
    run = apply_rules(df, rules)
    return run.data, run.errors
