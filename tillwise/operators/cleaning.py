"""Cleaning steps: text, duplicates, imputation, business rules, outliers, narrow types.

Steps that need statistics have a ``fit_*`` half, one small aggregate over the fit rows, and an
apply half, a pure projection.  Fitted values are a handful per column.
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import anchored_pattern, any_word_pattern, clip, col, edge_pattern, lookup
from tillwise.functions.quantiles import quantiles
from tillwise.functions.vocab import (
    BIRTH_WORDS, CATEGORY_DOMAINS, END_WORDS, ID_WORDS_WIDE, MONEY_WORDS, NON_NEGATIVE_WORDS,
    PLACEHOLDERS, QUANTITY_WORDS, RETURN_MONEY_WORDS, RETURN_WORDS, SALES_WORDS, START_WORDS,
)
from tillwise.operators.coltypes import TypePlan, is_numeric, keeps_case
from tillwise.operators.quality import distinct_counts

SPARSE_SHARE, MAX_CATEGORIES = 0.30, 20      # fixed values
FUTURE_YEARS = 10


def _snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def _hits(name: str, pattern: str) -> bool:
    return re.search(pattern, _snake(name)) is not None


def is_money(name: str) -> bool:
    return _hits(name, any_word_pattern(MONEY_WORDS))


def is_key(name: str) -> bool:
    return _hits(name, edge_pattern(ID_WORDS_WIDE))


# Text and duplicates ------------------------------------------------------------------------

def normalise_text(c, keep_case: bool = False) -> Column:
    """Trim, collapse white space, lower-case unless the column keeps its case."""
    t = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return t if keep_case else F.lower(t)


def placeholder_to_null(c) -> Column:
    x = col(c)
    return F.when(~F.lower(x).isin(PLACEHOLDERS), x)


def text_normalise(df: DataFrame, plan: TypePlan) -> DataFrame:
    """Normal form of text and identifier columns; identifiers keep their case."""
    out = {c: normalise_text(c, keeps_case(c) or c in plan.ids)
           for c in [*plan.ids, *plan.text] if dict(df.dtypes)[c] == "string"}
    return df.withColumns(out) if out else df


def garbage_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Placeholder texts become NULL."""
    return df.withColumns({c: placeholder_to_null(c) for c in columns}) if columns else df


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates collapse to one row (combined on the map side)."""
    return df.dropDuplicates()


def low_cardinality(df: DataFrame, columns: list[str], limit: int) -> dict[str, int]:
    """Exact distinct counts of the columns that have at most ``limit`` values."""
    if not columns:
        return {}
    counts = distinct_counts(df, columns).where(F.col("unique_values") <= limit).collect()
    return {r["column_name"]: r["unique_values"] for r in counts}


def category_domains(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Domain of each column to standardise: few values, a matching name and a known value."""
    named = {c: [d for d, (words, _) in CATEGORY_DOMAINS.items()
                 if _hits(c, any_word_pattern(words))] for c in columns if not is_key(c)}
    named = {c: ds for c, ds in named.items() if ds}
    small = low_cardinality(df, list(named), MAX_CATEGORIES)
    tests = [(c, d) for c in small for d in named[c]]
    if not tests:
        return {}
    row = df.agg(*[F.bool_or(F.lower(F.trim(col(c))).isin(list(CATEGORY_DOMAINS[d][1])))
                   .alias(f"t{k}") for k, (c, d) in enumerate(tests)]).first()
    chosen: dict[str, str] = {}
    for k, (c, d) in enumerate(tests):
        if row[k] and c not in chosen:
            chosen[c] = d
    return chosen


def standardise_categories(df: DataFrame, columns: list[str],
                           domains: dict[str, str] | None = None) -> DataFrame:
    """Gender, marital status and country to canonical values."""
    chosen = category_domains(df, columns) if domains is None else domains
    new = {c: F.coalesce(lookup(F.lower(F.trim(col(c))), CATEGORY_DOMAINS[d][1]), col(c))
           for c, d in chosen.items()}
    return df.withColumns(new) if new else df


# Fit rows -----------------------------------------------------------------------------------

def nth_smallest(df: DataFrame, order: str, n: int, buckets: int = 4096):
    """Exact n-th smallest value (1-based) of a number, date or time column.

    Counts per equal-width bucket narrow the range until one value is left; each round is one
    map-side combined job that returns one row.
    """
    kind = dict(df.dtypes)[order]
    x = col(order)
    if kind == "date":
        x = F.unix_date(x).cast("double")
    elif kind.startswith("timestamp"):
        x = F.unix_micros(x.cast("timestamp")).cast("double")
    else:
        x = x.cast("double")
    cur, left = df.select(x.alias("v"), col(order).alias("o")).where(
        F.col("v").isNotNull() & ~F.isnan("v")), n
    before = None
    while True:
        s = cur.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("o").alias("o"),
                    F.count("v").alias("k")).first()
        if s.lo is None or s.lo == s.hi:
            return s.o
        if s.k == before:   # values too close for another split
            return cur.groupBy("v").agg(F.count("*").alias("k"), F.min("o").alias("o")).withColumn(
                "upto", F.sum("k").over(Window.orderBy("v"))).where(F.col("upto") >= left).orderBy(
                "v").first().o
        before = s.k
        b = F.least(F.lit(buckets - 1), F.floor(
            (F.col("v") - F.lit(s.lo)) / F.lit(s.hi - s.lo) * buckets)).cast("int")
        cur = cur.withColumn("b", b)
        seen, pick = 0, None
        for r in cur.groupBy("b").agg(F.count("*").alias("k")).orderBy("b").collect():
            if seen + r.k >= left:
                pick, left = r.b, left - seen
                break
            seen += r.k
        if pick is None:
            raise ValueError("n is larger than the number of rows")
        cur = cur.where(F.col("b") == pick).drop("b")


def fit_mask(df: DataFrame, share: float | None = None, order: str | None = None,
             where: Column | None = None) -> Column:
    """Rows that statistics may be learnt from: all, a predicate, or the first share in order.

    Spark has no load order, so a share needs an ``order`` column; ties stay together.
    """
    if where is not None:
        return F.coalesce(where, F.lit(False))
    if share is None:
        return F.lit(True)
    if not 0.0 < share <= 1.0:
        raise ValueError("share must be in (0, 1]")
    if order is None:
        raise ValueError("a share of the rows needs an order column")
    n = max(1, int(df.count() * share))
    return F.coalesce(col(order) <= F.lit(nth_smallest(df, order, n)), F.lit(False))


# Imputation ---------------------------------------------------------------------------------

@dataclass
class ImputeModel:
    """Fill value and reason per column with missing cells."""

    rows: int
    fills: dict[str, object] = field(default_factory=dict)
    report: list[tuple[str, int, float, str]] = field(default_factory=list)


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, lowest on ties, from counts of (column, value).

    The counts shuffle by value, so no task holds all values of a column.
    """
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in columns])).alias("x")
    ).select("x.*").where(F.col("v").isNotNull())
    counts = long.groupBy("c", "v").agg(F.count("*").alias("k"))
    top = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("k"), "v")).alias("v"))
    return {r.c: r.v for r in top.collect()}


def fit_imputer(df: DataFrame, plan: TypePlan, fit: Column | None = None,
                target: str | None = None) -> ImputeModel:
    """Choose per column: skip, keep missing (money), median, mode or "Unknown"."""
    kinds = dict(df.dtypes)
    head = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(col(c).isNull()).alias(f"m{k}") for k, c in enumerate(df.columns)]).first()
    model = ImputeModel(head.n)
    numeric, other = [], []
    for k, c in enumerate(df.columns):
        missing = head[k + 1]
        if not missing or c == target or c in plan.ids or is_key(c):
            continue
        if plan.types.get(c) == "date" or kinds[c].startswith(("date", "timestamp")):
            continue
        share = missing / head.n
        note = lambda s, c=c, m=missing, p=share: model.report.append(
            (c, m, round(p * 100, 2), s))
        if share > SPARSE_SHARE:
            note("skipped: sparse")
        elif is_numeric(kinds[c]) and is_money(c):
            note("kept missing: monetary")
        elif is_numeric(kinds[c]):
            numeric.append(c)
            note("median")
        else:
            other.append(c)
            note("mode")
    rows = df if fit is None else df.where(fit)
    if numeric:
        q = quantiles(rows, numeric, [0.5]).first()
        for c in numeric:
            if q[c] is not None and q[c][0] is not None:
                model.fills[c] = q[c][0]
    modes = most_frequent(rows, other)
    for c in other:
        if c in modes:
            model.fills[c] = modes[c] == "true" if kinds[c] == "boolean" else modes[c]
        else:
            model.fills[c] = False if kinds[c] == "boolean" else "Unknown"
            model.report = [(n, m, p, "unknown" if n == c and kinds[c] != "boolean" else
                             "false" if n == c else s) for n, m, p, s in model.report]
    return model


def impute_missing(df: DataFrame, model: ImputeModel) -> DataFrame:
    kinds = dict(df.dtypes)
    new = {c: F.coalesce(col(c), F.lit(v).cast(kinds[c]) if kinds[c] != "int" else F.lit(v))
           for c, v in model.fills.items()}
    return df.withColumns(new) if new else df


def missing_report(df: DataFrame, model: ImputeModel) -> DataFrame:
    """Count, percent and strategy of every column with missing cells."""
    return df.sparkSession.createDataFrame(
        model.report, "column_name string, missing long, pct double, strategy string")


# Business rules -----------------------------------------------------------------------------

@dataclass
class SignModel:
    """Per non-negative column: counts and the fill for erroneous negatives."""

    legit: Column
    counts: dict[str, tuple[int, int, int]]
    fills: dict[str, float]


def return_evidence(money: list[str], text: list[str]) -> Column:
    """The row shows a return: a negative money value or a return word in any text."""
    out = F.lit(False)
    for c in money:
        out = out | F.coalesce(col(c) < 0, F.lit(False))
    rx = "(?i)" + any_word_pattern(RETURN_WORDS)
    for c in text:
        out = out | F.coalesce(col(c).cast("string").rlike(rx), F.lit(False))
    return out


def fit_non_negative(df: DataFrame, plan: TypePlan, fit: Column | None = None) -> SignModel:
    """Count negatives of quantity-like columns, split into returns and errors, and fit fills."""
    cols = [c for c in plan.numeric if c in df.columns
            and _hits(c, any_word_pattern(NON_NEGATIVE_WORDS))]
    money = [c for c in plan.numeric if c in df.columns
             and any(w in c.lower() for w in RETURN_MONEY_WORDS)]
    text = [c for c in [*plan.ids, *plan.text] if c in df.columns]
    legit = {c: return_evidence([m for m in money if m != c], text) for c in cols}
    model = SignModel(F.lit(False), {}, {})
    if not cols:
        return model
    aggs = []
    for k, c in enumerate(cols):
        aggs += [F.count_if(col(c) < 0).alias(f"n{k}"),
                 F.count_if((col(c) < 0) & ~legit[c]).alias(f"e{k}")]
    row = df.agg(*aggs).first()
    model.counts = {c: (row[f"n{k}"], row[f"n{k}"] - row[f"e{k}"], row[f"e{k}"])
                    for k, c in enumerate(cols) if row[f"n{k}"]}
    wrong = [c for c, (_, _, e) in model.counts.items() if e]
    if wrong:
        rows = (df if fit is None else df.where(fit)).select(
            *[F.when(~F.coalesce((col(c) < 0) & ~legit[c], F.lit(False)), col(c)).alias(c)
              for c in wrong])
        q = quantiles(rows, wrong, [0.5]).first()
        model.fills = {c: q[c][0] for c in wrong}
    model.legit = legit
    return model


def validate_non_negative(df: DataFrame, model: SignModel) -> DataFrame:
    """Erroneous negatives, and any other missing cell of such a column, take the fit median."""
    new = {}
    for c, fill in model.fills.items():
        bad = F.coalesce((col(c) < 0) & ~model.legit[c], F.lit(False))
        new[c] = F.coalesce(F.when(~bad, col(c)), F.lit(fill).cast(dict(df.dtypes)[c]))
    return df.withColumns(new) if new else df


def sign_report(df: DataFrame, model: SignModel) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(c, n, k, e) for c, (n, k, e) in model.counts.items()],
        "column_name string, negative_values long, kept_as_return long, replaced long")


def date_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """(start, end) pairs among date columns, by anchored name words."""
    start, end = anchored_pattern(START_WORDS), anchored_pattern(END_WORDS)
    return [(s, e) for s in columns if _hits(s, start) for e in columns
            if e != s and _hits(e, end)]


def validate_date_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """A start after its end makes both NULL."""
    for s, e in date_pairs(columns):
        bad = F.coalesce(col(s) > col(e), F.lit(False))
        df = df.withColumns({s: F.when(~bad, col(s)), e: F.when(~bad, col(e))})
    return df


def validate_date_range(df: DataFrame, columns: list[str], as_of: datetime.date,
                        years: int = FUTURE_YEARS) -> DataFrame:
    """Dates before 1900 or too far ahead (birth dates: after ``as_of``) become NULL."""
    new = {}
    for c in columns:
        ahead = 0 if any(w in _snake(c) for w in BIRTH_WORDS) else years
        top = F.add_months(F.lit(as_of), 12 * ahead).cast("timestamp_ntz")
        d = col(c).cast("timestamp_ntz")
        low = F.lit(datetime.date(1900, 1, 1)).cast("timestamp_ntz")
        new[c] = F.when((d >= low) & (d <= top), col(c))
    return df.withColumns(new) if new else df


def total_sales_columns(df: DataFrame, numeric: list[str]) -> tuple[str, str] | None:
    """First sales-like and first quantity-like numeric column, identifiers excluded."""
    ids, sales, qty = (anchored_pattern(w) for w in (ID_WORDS_WIDE, SALES_WORDS, QUANTITY_WORDS))
    pool = [c for c in df.columns if c in numeric and c != "Total Sales" and not _hits(c, ids)]
    s = next((c for c in pool if _hits(c, sales)), None)
    q = next((c for c in pool if c != s and _hits(c, qty)), None)
    return (s, q) if s and q else None


def derive_total_sales(df: DataFrame, numeric: list[str]) -> DataFrame:
    pair = total_sales_columns(df, numeric)
    if "Total Sales" in df.columns or pair is None:
        return df
    return df.withColumn("Total Sales", col(pair[0]) * col(pair[1]))


# Outliers and types -------------------------------------------------------------------------

def fit_outlier_bounds(df: DataFrame, plan: TypePlan, fit: Column | None = None,
                       target: str | None = None) -> dict[str, tuple[float, float]]:
    """Caps per numeric column, wider for skewed ones; money, keys and the target are exempt."""
    cols = [c for c in plan.numeric if c in df.columns and c != target and c not in plan.ids
            and not is_key(c) and not is_money(c)]
    if not cols:
        return {}
    rows = df if fit is None else df.where(fit)
    q = quantiles(rows, cols, [0.25, 0.75]).first()
    s = rows.agg(*[F.count(col(c)).alias(f"n{k}") for k, c in enumerate(cols)],
                 *[F.skewness(col(c).cast("double")).alias(f"s{k}") for k, c in enumerate(cols)]
                 ).first()
    out = {}
    for k, c in enumerate(cols):
        n = s[f"n{k}"]
        if n < 10:
            continue
        q1, q3 = q[c]
        iqr = q3 - q1
        if iqr == 0:
            continue
        skew = abs((s[f"s{k}"] or 0.0) * math.sqrt(n * (n - 1)) / (n - 2))
        m = 3.0 if skew >= 2.0 else 2.0 if skew >= 1.0 else 1.5
        lo, hi = q1 - m * iqr, q3 + m * iqr
        out[c] = (math.floor(lo), math.ceil(hi)) if c in plan.integers else (lo, hi)
    return out


def cap_outliers_iqr(df: DataFrame, bounds: dict[str, tuple[float, float]],
                     integers: set[str] = frozenset()) -> DataFrame:
    kinds = dict(df.dtypes)
    new = {}
    for c, (lo, hi) in bounds.items():
        v = clip(c, F.lit(lo).cast(kinds[c]), F.lit(hi).cast(kinds[c]))
        new[c] = F.bround(v, 0) if c in integers else v
    return df.withColumns(new) if new else df


def outlier_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values below and above the caps, for columns that have any."""
    spark = df.sparkSession
    schema = "column_name string, low long, high long, lower_cap double, upper_cap double"
    if not bounds:
        return spark.createDataFrame([], schema)
    items = [F.struct(F.lit(c).alias("column_name"), F.count_if(col(c) < lo).alias("low"),
                      F.count_if(col(c) > hi).alias("high"),
                      F.lit(round(float(lo), 4)).alias("lower_cap"),
                      F.lit(round(float(hi), 4)).alias("upper_cap")).alias(f"c{k}")
             for k, (c, (lo, hi)) in enumerate(bounds.items())]
    return df.agg(*items).select(F.explode(F.array(
        *[F.col(f"c{k}") for k in range(len(items))])).alias("x")).select("x.*").where(
        F.col("low") + F.col("high") > 0)


def clip_series_iqr(series: DataFrame, column: str = "monthly_revenue",
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Clip a series to 1.5 interquartile ranges around its middle half."""
    q = quantiles(series, [column], [0.25, 0.75], by)
    if by:
        out = series.join(q.withColumnRenamed(column, "_q"), list(by))
    else:
        out = series.withColumn("_q", q.select(col(column)).scalar())
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    span = (hi - lo) * 1.5
    return out.withColumn(column, clip(column, lo - span, hi + span)).drop("_q")


def narrow_types(df: DataFrame) -> DataFrame:
    """Whole numbers to the smallest fitting type, other numbers to float unless money."""
    ints = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    new: dict[str, Column] = {c: col(c).cast("float") for c, t in df.dtypes
                              if t == "double" and not is_money(c)}
    if ints:
        aggs = []
        for k, c in enumerate(ints):
            aggs += [F.min(col(c)).alias(f"a{k}"), F.max(col(c)).alias(f"b{k}")]
        row = df.agg(*aggs).first()
        for k, c in enumerate(ints):
            lo, hi = row[f"a{k}"], row[f"b{k}"]
            if lo is None:
                continue
            if lo >= -32768 and hi <= 32767:
                new[c] = col(c).cast("smallint")
            elif lo >= -2147483648 and hi <= 2147483647:
                new[c] = col(c).cast("int")
    return df.withColumns(new) if new else df
