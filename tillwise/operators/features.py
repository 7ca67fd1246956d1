"""Date parts, date gaps and lags per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, days_between
from tillwise.functions.lags import sliced_lags
from tillwise.functions.vocab import (
    ENTITY_WORDS, GROUP_WORDS_HIGH, GROUP_WORDS_LOW, PRIMARY_DATE_WORDS,
)
from tillwise.operators.cleaning import low_cardinality

LAG_KEY_WORDS = ["id", "code", "index", "num", "no", "number", "key"]   # fixed values


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(
        month.isin(6, 7, 8), "Summer").when(month.isNotNull(), "Autumn")


def date_parts(df: DataFrame, date: str) -> DataFrame:
    """Nine calendar columns; -1 and "Unknown" where the date is missing."""
    d, p = col(date), date.replace(" ", "_")
    num = lambda e: F.coalesce(e.cast("int"), F.lit(-1))
    text = lambda e: F.coalesce(e, F.lit("Unknown"))
    wd = F.weekday(d)
    return df.withColumns({
        f"{p}_Year": num(F.year(d)), f"{p}_Month": num(F.month(d)), f"{p}_Day": num(F.day(d)),
        f"{p}_DayOfWeek": num(wd), f"{p}_Quarter": num(F.quarter(d)),
        f"{p}_Is_Weekend": num(wd >= 5),
        f"{p}_Is_MonthEnd": num(d.cast("date") == F.last_day(d)),
        f"{p}_DayName": text(F.date_format(d, "EEEE")), f"{p}_Season": text(season(F.month(d))),
    })


def date_deltas(df: DataFrame, primary: str, others: Sequence[str]) -> DataFrame:
    """Whole days from the primary date to each other date, floored; -1 where either is missing."""
    p = primary.replace(" ", "_")
    start = col(primary).cast("timestamp_ntz")

    def delta(c):
        d = days_between(primary, c).cast("int")
        early = start + F.make_dt_interval(days=d) > col(c).cast("timestamp_ntz")
        return F.coalesce(F.when(early, d - 1).otherwise(d), F.lit(-1)).cast("int")

    new = {f"{c.replace(' ', '_')}_days_from_{p}": delta(c) for c in others}
    return df.withColumns(new) if new else df


def primary_date_scores(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Two points per hint word in the name plus the share of known values."""
    items = []
    for k, c in enumerate(dates):
        words = sum(2 for w in PRIMARY_DATE_WORDS if w in c.lower().replace(" ", "_"))
        share = F.count(col(c)) / F.greatest(F.count(F.lit(1)), F.lit(1))
        items.append(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("position"),
                              (F.lit(float(words)) + share).alias("score")).alias(f"c{k}"))
    return df.agg(*items).select(F.explode(F.array(
        *[F.col(f"c{k}") for k in range(len(items))])).alias("x")).select("x.*")


def select_primary_date(df: DataFrame, dates: Sequence[str]) -> str:
    return primary_date_scores(df, dates).orderBy(F.desc("score"), "position").first().column_name


def group_column_scores(df: DataFrame, text: Sequence[str]) -> DataFrame:
    """Candidates for the grouping column, best first.

    An entity word wins outright; otherwise columns of 2 to 50 values score by their names.
    Wide columns are told apart by a sketch and never counted exactly.
    """
    text = [c for c in text if c in df.columns]
    schema = "column_name string, position int, entity boolean, unique_values long, score int"
    if not text:
        return df.sparkSession.createDataFrame([], schema)
    varied = df.agg(*[(F.min(col(c)) < F.max(col(c))).alias(f"c{k}")
                      for k, c in enumerate(text)]).first()
    small = low_cardinality(df, list(text), 50)
    rows = []
    for k, c in enumerate(text):
        name, n = c.lower(), small.get(c)
        entity = any(w in name.replace(" ", "_") for w in ENTITY_WORDS) and bool(varied[k])
        score = None
        if n is not None and n >= 2:
            score = (sum(10 for w in GROUP_WORDS_HIGH if w in name)
                     - sum(5 for w in GROUP_WORDS_LOW if w in name) + (3 if 3 <= n <= 20 else 0))
        if entity or score is not None:
            rows.append((c, k, entity, n, score))
    return df.sparkSession.createDataFrame(rows, schema).orderBy(
        F.desc("entity"), F.when(F.col("entity"), F.col("position")), F.desc("score"), "position")


def select_group_column(df: DataFrame, text: Sequence[str]) -> str | None:
    best = group_column_scores(df, text).first()
    if best is None or (not best.entity and (best.score is None or best.score <= -1)):
        return None
    return best.column_name


def unique_name(base: str, taken) -> str:
    if base not in taken:
        return base
    k = 2
    while f"{base}_{k}" in taken:
        k += 1
    return f"{base}_{k}"


def lag_value_columns(numeric: Sequence[str], ids: Sequence[str] = ()) -> list[str]:
    return [c for c in numeric if c not in ids and not any(w in c.lower() for w in LAG_KEY_WORDS)]


def group_lag_features(df: DataFrame, date: str, row_id: str, values: Sequence[str],
                       group: str | None = None, slice_unit: str | None = None) -> DataFrame:
    """Days since the previous row of the group and lags 1 and 3; -1 where there is none.

    Rows without a date or group get -1 everywhere.  A group, or a moment, that holds most rows is cut
    into ranges of similar size, so it never lands in one task; ``slice_unit`` asks for calendar slices.
    """
    taken = set(df.columns)
    gap = unique_name(f"days_since_last_{date.lower().replace(' ', '_')}", taken)
    taken.add(gap)
    names: dict[tuple[str, int], str] = {}
    for c in values:
        for k in (1, 3):
            n = unique_name(f"lag_{k}_{c.lower().replace(' ', '_')}", taken)
            names[c, k] = n
            taken.add(n)
    known = col(date).isNotNull()
    if group:
        known = known & col(group).isNotNull()
    keys = [group] if group else []
    lagged = sliced_lags(df.where(known).withColumn("_day", col(date)), keys, date, row_id,
                         ["_day", *values], (1, 3), slice_unit)
    miss = lambda e, t: F.coalesce(e.cast(t), F.lit(-1).cast(t))
    out = lagged.select(
        *[col(c) for c in df.columns], miss(days_between("_day__lag1", "_day"), "int").alias(gap),
        *[miss(col(f"{c}__lag{k}"), "double").alias(n) for (c, k), n in names.items()])
    rest = df.where(~F.coalesce(known, F.lit(False))).select(
        *[col(c) for c in df.columns], F.lit(-1).alias(gap),
        *[F.lit(-1.0).alias(n) for n in names.values()])
    return out.unionByName(rest)


def group_gap_days(df: DataFrame, date: str, row_id: str, group: str | None = None,
                   slice_unit: str | None = None) -> DataFrame:
    return group_lag_features(df, date, row_id, [], group, slice_unit)
