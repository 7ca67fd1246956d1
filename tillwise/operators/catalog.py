"""Rules that read column names, over a catalogue table (one row per column per dataset).

A catalogue row is (upload_id, column_name, position).  Vocabularies are small fixed lists, so
they travel inside the plan as literal arrays: every row emits only the words it matches and the
best match is a map-side combined ``min_by``.  No join with the vocabulary, no pairs of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import any_word_pattern, col, edge_pattern, snake, table_literal
from tillwise.functions.vocab import (
    DASHBOARD_CANDIDATES, DATE_HINTS, FEATURE_SYNONYMS, ID_WORDS, MODEL_FEATURES, MONEY_WORDS,
    NAME_ACRONYMS, ROLE_SYNONYMS, TOPIC_WORDS,
)


def schema_columns(df: DataFrame, upload_id: int) -> DataFrame:
    """Catalogue rows of one DataFrame, read from its schema."""
    kinds = {"string": "text", "boolean": "boolean", "date": "date", "timestamp": "date",
             "timestamp_ntz": "date"}
    rows = [(upload_id, n, k, kinds.get(t, "numeric" if t.split("(")[0] in (
        "tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else "text"))
        for k, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(
        rows, "upload_id long, column_name string, position long, column_type string")


def norm_name(c="column_name") -> Column:
    """Lower case, every other character an underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def squashed_name(c="column_name") -> Column:
    return F.regexp_replace(F.lower(col(c)), "[_ -]", "")


def is_id_name(c="column_name") -> Column:
    return snake(c).rlike(edge_pattern(ID_WORDS))


def is_money_name(c="column_name") -> Column:
    """Substring rule, so "net" also hits "internet"; kept as the default vocabulary."""
    return snake(c).rlike(any_word_pattern(MONEY_WORDS))


def detect_id_columns(columns: DataFrame) -> DataFrame:
    return columns.withColumn("is_id", is_id_name())


def classify_monetary(columns: DataFrame) -> DataFrame:
    return columns.withColumn("is_monetary", is_money_name())


def display_name(name, is_lag=None, is_engineered=None, is_target=None) -> Column:
    """Readable label of a column name; engineered and target columns carry a mark."""
    n = col(name)
    lag = r"(?i)^lag_(\d+)_(.+)$"
    base = F.when(n.rlike(lag), F.concat(
        F.regexp_extract(n, lag, 2), F.lit(" (Lag "), F.regexp_extract(n, lag, 1), F.lit(")"))
    ).otherwise(F.trim(F.replace(n, F.lit("_"), F.lit(" "))))

    def label(w):
        up = F.upper(w)
        return F.when((F.length(w) <= 3) & up.isin(NAME_ACRONYMS), up).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    words = F.array_join(F.transform(F.split(base, r"\s+"), label), " ")
    no = F.lit(False)
    return F.when(is_target if is_target is not None else no,
                  F.concat(words, F.lit(" ★ Target"))).when(
        is_lag if is_lag is not None else no, words).when(
        is_engineered if is_engineered is not None else no,
        F.concat(words, F.lit(" (Engineered)"))).otherwise(words)


def column_catalog(columns: DataFrame) -> DataFrame:
    """Type, flags, label and default aggregate of each column.

    Input adds ``column_type``, ``is_lag``, ``is_date_part`` and ``is_target``.
    """
    lag, part, target = F.col("is_lag"), F.col("is_date_part"), F.col("is_target")
    return columns.select(
        "upload_id", "column_name", F.coalesce("column_type", F.lit("text")).alias("column_type"),
        is_money_name().alias("is_monetary"), target.alias("is_target"), lag.alias("is_lag"),
        (lag | part).alias("is_engineered"),
        display_name("column_name", lag, lag | part, target).alias("display_name"),
        F.when(part, "none").when(lag, "avg").when(F.col("column_type") == "numeric", "sum")
        .otherwise("count_distinct").alias("agg_default"))


def topics_from_columns(columns: DataFrame) -> DataFrame:
    """Topic labels of each dataset by words in its column names."""
    flags = [F.bool_or(F.lower(col("column_name")).rlike(any_word_pattern(w))).alias(f"t{k}")
             for k, w in enumerate(TOPIC_WORDS.values())]
    out = columns.groupBy("upload_id").agg(*flags)
    return out.select("upload_id", F.array_compact(F.array(*[
        F.when(F.col(f"t{k}"), F.lit(t)) for k, t in enumerate(TOPIC_WORDS)])).alias("topics"))


# Matching names to a vocabulary -------------------------------------------------------------

def _words(entries) -> Column:
    """(target, word, rank and score of an exact and of a partial match) rows as a literal."""
    return table_literal(entries, "target string, word string, exact_rank int, part_rank int, "
                                  "exact_score double, part_score double")


def _best(columns: DataFrame, entries, norm: Column) -> DataFrame:
    """Best (column, score) per dataset and target.

    Lower rank wins, then the earlier column.  A NULL rank switches that kind of match off.
    Columns with one normalised name count once: first position, last spelling.
    """
    named = columns.withColumn("_n", norm).groupBy("upload_id", "_n").agg(
        F.min("position").alias("_pos"), F.max_by("column_name", "position").alias("column_name"))
    hit = F.filter(_words(entries), lambda w: F.when(
        F.col("_n") == w["word"], w["exact_rank"].isNotNull() | w["part_rank"].isNotNull()).otherwise(
        w["part_rank"].isNotNull() & (F.contains(F.col("_n"), w["word"])
                                      | F.contains(w["word"], F.col("_n")))))
    rows = named.select("upload_id", "_n", "_pos", "column_name", F.explode(hit).alias("w"))
    exact = (F.col("_n") == F.col("w.word")) & F.col("w.exact_rank").isNotNull()
    rank = F.when(exact, F.col("w.exact_rank")).otherwise(F.col("w.part_rank"))
    score = F.when(exact, F.col("w.exact_score")).otherwise(F.col("w.part_score"))
    return rows.groupBy("upload_id", F.col("w.target").alias("target")).agg(
        F.min_by(F.struct("column_name", score.alias("score")), F.struct(rank, "_pos")).alias("m")
    ).select("upload_id", "target", "m.column_name", "m.score")


def _py_norm(w: str) -> str:
    return "".join(ch.lower() if ch.isalnum() else "_" for ch in w).strip("_")


def find_date_column(columns: DataFrame) -> DataFrame:
    """First column of each dataset whose name holds a date hint."""
    hint = any_word_pattern(DATE_HINTS)
    return columns.where(norm_name().rlike(hint)).groupBy("upload_id").agg(
        F.min_by("column_name", "position").alias("date_column"))


def suggest_mapping(columns: DataFrame, model_kind: str) -> DataFrame:
    """Per dataset and model input: the source column and a score, NULL and 0 when none fits."""
    entries = []
    for f in MODEL_FEATURES[model_kind]:
        entries.append((f, _py_norm(f), 0, 1000, 1.0, 0.6))
        for k, s in enumerate(FEATURE_SYNONYMS.get(f, [])):
            entries.append((f, _py_norm(s), 1 + 2 * k, 2 + 2 * k, 0.9, 0.75))
    best = _best(columns, entries, norm_name())
    every = columns.select("upload_id").distinct().select(
        "upload_id", F.explode(F.array(*[F.lit(f) for f in MODEL_FEATURES[model_kind]]))
        .alias("target"))
    full = every.join(best, ["upload_id", "target"], "left").join(
        find_date_column(columns), "upload_id", "left")
    derived = F.col("column_name").isNull() & F.col("date_column").isNotNull() \
        & F.col("target").isin("month", "quarter")
    return full.select(
        "upload_id", F.col("target").alias("feature"),
        F.when(derived, F.concat(F.lit("_from_date:"), F.col("date_column")))
        .otherwise(F.col("column_name")).alias("source_column"),
        F.when(derived, 0.9).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"))


def unmapped_columns(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Columns no model input uses."""
    used = mapping.where(F.col("source_column").isNotNull()).select(
        "upload_id", F.col("source_column").alias("column_name"))
    return columns.join(used, ["upload_id", "column_name"], "left_anti")


def missing_features(mapping: DataFrame) -> DataFrame:
    return mapping.where(F.col("source_column").isNull()).select("upload_id", "feature")


def detect_roles(columns: DataFrame) -> DataFrame:
    """Order-table role of columns: any exact name first, then a part of a name."""
    entries = [(r, _py_norm(s), k, 1000 + k, 1.0, 0.5)
               for r, names in ROLE_SYNONYMS.items() for k, s in enumerate(names)]
    return _best(columns, entries, norm_name()).select(
        "upload_id", F.col("target").alias("role"), "column_name")


def detect_dashboard_columns(columns: DataFrame) -> DataFrame:
    """Dashboard metric columns; case, ``_``, space and ``-`` do not count."""
    squash = lambda w: w.lower().replace("_", "").replace(" ", "").replace("-", "")
    entries = [(r, squash(s), k, None, 1.0, None)
               for r, names in DASHBOARD_CANDIDATES.items() for k, s in enumerate(names)]
    return _best(columns, entries, squashed_name()).select(
        "upload_id", F.col("target").alias("metric"), "column_name")
