"""Quality measures: shape, key integrity, encoding advice, correlation, score."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import col
from tillwise.session import checkpointed

HIGH_CORRELATION = 0.85   # fixed value
PAIRS_PER_JOB = 200
RANGES = 64


def null_and_shape_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells and text columns, in one aggregate."""
    nulls = sum((F.count_if(col(c).isNull()) for c in df.columns[1:]),
                F.count_if(col(df.columns[0]).isNull()))
    width = len(df.columns)
    text = sum(1 for _, t in df.dtypes if t == "string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("null_cells")).select(
        "n_rows", F.lit(width).cast("long").alias("n_columns"),
        (F.col("n_rows") * width).alias("n_cells"), "null_cells",
        F.lit(text).cast("long").alias("text_columns"))


def pk_integrity(df: DataFrame, ids: list[str], examples: int = 10) -> DataFrame:
    """Per identifier column: missing cells, rows in duplicate groups, sample duplicates.

    Counts per value combine on the map side; missing keys count as duplicates of each other.
    """
    out = None
    for c in ids:
        counts = df.groupBy(col(c).cast("string").alias("v")).agg(F.count("*").alias("k"))
        one = counts.agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("null_count"),
            F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicate_count"))
        sample = counts.where((F.col("k") > 1) & F.col("v").isNotNull()).orderBy("v").limit(
            examples).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("s"))
        one = one.select(F.lit(c).alias("column_name"), "null_count", "duplicate_count",
                         sample.scalar().alias("sample_duplicates"))
        out = one if out is None else out.unionByName(one)
    return out


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values per column from (column, value) groups."""
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), col(c).cast("string").alias("v")) for c in columns]))
        .alias("x")).select("x.*")
    return long.groupBy("column_name", "v").agg(F.lit(1).alias("one")).groupBy("column_name").agg(
        F.count("v").alias("unique_values"))


def encoding_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """How to encode each text column for a model."""
    n = F.col("unique_values")
    return distinct_counts(df, columns).withColumn(
        "recommendation", F.when(n <= 10, "One-Hot Encoding").when(n <= 50, "Label Encoding")
        .otherwise("Target Encoding / Drop"))


# Correlation --------------------------------------------------------------------------------

def _varied(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[(F.min(col(c)) < F.max(col(c))).alias(f"c{k}")
                   for k, c in enumerate(columns)]).first()
    return [c for k, c in enumerate(columns) if row[k]]


def _corr_rows(df: DataFrame, columns: list[str], names: dict[str, str]) -> dict:
    pairs = list(itertools.combinations(columns, 2))
    out = {}
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[start:start + PAIRS_PER_JOB]
        row = df.agg(*[F.corr(col(names[a]).cast("double"), col(names[b]).cast("double"))
                       .alias(f"p{k}") for k, (a, b) in enumerate(part)]).first()
        out.update({p: row[k] for k, p in enumerate(part)})
    return out


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank table (column, value, average rank) of several columns, no global sort in one task.

    Equal values collapse to one row first.  The distinct values of a column are cut into ranges
    of similar size, ranked inside their range and shifted by the rows before it.
    """
    cells = df.select(F.explode(F.array(*[F.struct(
        F.lit(k).alias("c"), col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
        .alias("x")).select("x.*")
    counts = cells.groupBy("c", "v").agg(F.count("*").alias("k"))
    cuts = counts.groupBy("c").agg(F.approx_percentile(
        "v", F.array(*[F.lit(p / RANGES) for p in range(1, RANGES)]), F.lit(1000)).alias("cuts"))
    counts = counts.join(F.broadcast(cuts), "c")       # one row per column
    counts = counts.withColumn("b", F.size(F.filter("cuts", lambda e: e <= F.col("v")))).drop("cuts")
    totals = counts.groupBy("c", "b").agg(F.sum("k").alias("t"))
    w = Window.partitionBy("c").orderBy("b")
    shift = totals.select("c", "b", (F.sum("t").over(w) - F.col("t")).alias("s"))
    within = Window.partitionBy("c", "b").orderBy("v")
    return counts.join(F.broadcast(shift), ["c", "b"]).select(   # at most RANGES rows per column
        "c", "v", (F.col("s") + F.sum("k").over(within) - F.col("k") + (F.col("k") + 1) / 2).alias("r"))


def spearman(df: DataFrame, columns: list[str]) -> dict:
    """Rank correlation of each pair of columns on the rows where both are known.

    Pairs of columns that are known on the same rows share their ranks: columns are grouped by the
    rows they are missing on, and a pair from two groups gets ranks of its own.
    """
    full = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                       for c in columns])
    row = full.agg(*[F.bit_xor(F.when(F.col(f"`{c}`").isNull(), F.xxhash64(*[
        F.col(f"`{x}`") for x in columns]))).alias(f"x{k}") for k, c in enumerate(columns)],
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    gaps = {c: (row[f"n{k}"], row[f"x{k}"]) for k, c in enumerate(columns)}
    out = {}
    for gap in dict.fromkeys(gaps.values()):
        own = [c for c in columns if gaps[c] == gap]
        if len(own) > 1:
            out.update(_spearman_known(full.select(*[col(c) for c in own]), own))
    for a, b in itertools.combinations(columns, 2):
        if gaps[a] != gaps[b]:
            out.update(_spearman_known(full.select(col(a), col(b)), [a, b]))
    return out


def _spearman_known(df: DataFrame, columns: list[str]) -> dict:
    """All pairs of columns that are missing on the same rows, or one pair."""
    full = df.dropna()
    ranks = checkpointed(average_ranks(full, columns))
    out = full
    for k, c in enumerate(columns):
        out = out.join(ranks.where(F.col("c") == k).select(
            F.col("v").alias(f"_v{k}"), F.col("r").alias(f"_r{k}")), col(c) == F.col(f"_v{k}"))
    return _corr_rows(out, columns, {c: f"_r{k}" for k, c in enumerate(columns)})


def correlation_pairs(df: DataFrame, columns: list[str],
                      threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs whose Pearson or Spearman correlation is high in size."""
    schema = "col_a string, col_b string, pearson double, spearman double, method string"
    use = _varied(df, columns) if len(columns) >= 2 else []
    rows = []
    if len(use) >= 2:
        p = _corr_rows(df, use, {c: c for c in use})
        s = spearman(df, use)
        for a, b in itertools.combinations(use, 2):
            pa, sa = abs(p[a, b] or 0.0), abs(s[a, b] or 0.0)
            if pa >= threshold or sa >= threshold:
                rows.append((a, b, round(pa, 3), round(sa, 3), "pearson" if pa >= sa else "spearman"))
    return df.sparkSession.createDataFrame(rows, schema)


# Score --------------------------------------------------------------------------------------

def quality_score(before_nulls, before_cells, duplicates, before_rows, outlier_columns,
                  untyped_columns, after_nulls, after_cells, sparse_columns, violations,
                  high_pairs, rule_errors) -> tuple[Column, Column]:
    """(before, after) scores out of 100 from counts given as columns or numbers."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    part = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    before = 100 - (part(before_nulls, before_cells) * 150 + part(duplicates, before_rows) * 150
                    + c(outlier_columns) * 5 + c(untyped_columns) * 5)
    after = 100 - (part(after_nulls, after_cells) * 200 + c(sparse_columns) * 2
                   + c(violations) * 0.5 + c(high_pairs) + c(rule_errors) * 3)
    zero, top = F.lit(0.0), F.lit(100.0)
    return F.round(F.greatest(zero, before), 1), F.round(F.least(top, F.greatest(zero, after)), 1)
