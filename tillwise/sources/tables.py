"""Reads and writes: encoded CSV, documents, evaluation runs, reports, cleaned tables."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.exprs import col
from tillwise.session import checkpointed
from tillwise.sources import charsets as H
from tillwise.sources.shared_files import put

_TOP = "array<struct<feature:string,importance:string>>"
_REPORT = ("strategy:string,confidence:string,definition:string,suitable_for:array<string>,"
           "not_suitable_for:array<string>,warnings:array<string>")
_PROFILE = (f"struct<{_REPORT},recommended_aggregation:string,coefficient_of_variation:double,"
            "safe_horizon_months:int,recommended_test_months:int,train_test_split_ratio:double>")
_LABELS = (f"struct<{_REPORT},total_customers:bigint,one_time_buyers:bigint,new_customers:bigint,"
           "eligible_customers:bigint,churned_customers:bigint,cutoff_date:string,"
           "holdout_window_days:int,median_ipi_days:double>")
_POINTS = "array<struct<period:string,forecast:double>>"
EVAL_SCHEMA = (
    f"revenue_model struct<status:string,RMSE:double,MAE:double,MAPE_pct:double,sMAPE_pct:double,"
    f"R2:double,forecast_bias:double,target:string,train_rows:bigint,test_rows:bigint,"
    f"`12_period_forecast`:array<double>,top_features:{_TOP},data_profile:{_PROFILE}>, "
    f"churn_model struct<status:string,ROC_AUC:double,F1_Score:double,Precision:double,"
    f"Recall:double,churn_rate_pct:double,train_rows:bigint,test_rows:bigint,"
    f"top_features:{_TOP},labelling:{_LABELS}>, "
    f"growth_model struct<status:string,RMSE:double,MAE:double,MAPE_pct:double,R2:double,"
    f"target:string,train_months:int,test_months:int,forecast_horizon_months:int,"
    f"forecast:{_POINTS},`12_month_forecast`:{_POINTS},top_features:{_TOP},data_profile:{_PROFILE}>, "
    f"prophet_model struct<MAPE_pct:double>")


#: Files that are named to the reader where only some of a folder are meant; beyond, all are read and
#: joined with those that are meant.
NAMED_FILES = 1000
#: Files in a table of charsets that is broadcast to the reading tasks.
BROADCAST_FILES = 100_000


def _csv_reader(spark: SparkSession, schema, charset: str, multi_line: bool):
    r = spark.read.options(header=True, encoding=charset, multiLine=multi_line, escape='"')
    return r.schema(schema) if schema else r.option("inferSchema", True)


def _header(name: str, charsets: list[str]) -> str:
    """A column name that was read as ISO-8859-1, in the first of the charsets that can hold it."""
    raw = name.encode("latin-1", "ignore")
    for charset in sorted(charsets, key=lambda c: c != "UTF-8"):
        try:
            return raw.decode(charset).lstrip("\ufeff")
        except UnicodeDecodeError:
            continue
    return name


def read_csv_encoded(spark: SparkSession, path: str, schema=None, encoding: str | None = None,
                     multi_line: bool = False) -> DataFrame:
    """CSV with header, each file in its own charset: UTF-8, ISO-8859-1, windows-1252, windows-1256
    or UTF-16; ``encoding`` names one for all.

    Files in one byte a character and UTF-8 files go through one scan, whose text columns are
    decoded row by row; files in two bytes are read by Spark's own decoder.  Give a schema for large input;
    without one, types are inferred by an extra pass.  ``multi_line``: quoted cells hold line ends.
    """
    if encoding:
        charset, table, count = H.canonical(encoding), None, {}
        count = {charset: 1}
        if charset not in H.CHARSETS:
            return _csv_reader(spark, schema, encoding, multi_line).csv(path)
    else:
        table = checkpointed(H.file_charsets(spark, path))
        count = {r["charset"]: r["n"] for r in table.groupBy("charset").agg(F.count("*").alias("n")).collect()}
    narrow, wide = [c for c in count if c not in H.WIDE], [c for c in count if c in H.WIDE]
    parts = []
    if narrow or not count:
        own, some = path, None
        if wide:
            own, some = _files(path, table.where(~F.col("charset").isin(*H.WIDE)), sum(count[c] for c in narrow))
            if schema is None and some is not None:
                raise ValueError("give a schema for that many files in different charsets")
        raw = _csv_reader(spark, schema, H.LATIN1, multi_line).csv(own)
        names = raw.columns if schema else [_header(c, narrow) for c in raw.columns]
        text = [c for c, t in raw.dtypes if t == "string"]
        if len(narrow) <= 1 and some is None:
            charset = (narrow or [H.UTF8])[0]
        else:
            raw = _join_files(raw.select("*", F.col("_metadata.file_path").alias("_file")),
                              table.where(~F.col("charset").isin(*H.WIDE)), sum(count.values()))
            charset = F.col("_charset")
        parts.append(raw.select(*[
            (H.decoded(col(c), charset) if c in text else col(c)).alias(n)
            for c, n in zip([c for c in raw.columns if c != "_charset"], names)]))
    for charset in wide:
        own, some = path, None
        if len(count) > 1:
            own, some = _files(path, table.where(F.col("charset") == charset), count[charset])
        raw = _csv_reader(spark, schema, charset, True).csv(own)
        names = [c.lstrip("\ufeff") for c in raw.columns]
        if some is not None:
            raw = _join_files(raw.select("*", F.col("_metadata.file_path").alias("_file")), some, count[charset])
        parts.append(raw.select(*[col(c).alias(n) for c, n in zip(raw.columns, names)]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=schema is None)
    return out


def _files(path: str, files: DataFrame, n: int):
    """What to read for these files: their paths, if they are few, or the folder and the files to join."""
    if n > NAMED_FILES:
        return path, files
    return [unquote(r["file"]) for r in files.select("file").collect()], None


def _join_files(rows: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Rows of the files, with their charset last."""
    files = files.select(F.col("file").alias("_file"), F.col("charset").alias("_charset"))
    if n <= BROADCAST_FILES:
        files = F.broadcast(files)
    return rows.join(files, "_file").select(*[col(c) for c in rows.columns if c != "_file"], "_charset")


def read_documents(spark: SparkSession, path: str, category: str = "general") -> DataFrame:
    """txt, md, csv and json files as text documents named after their file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True,
                            pathGlobFilter="*.{txt,md,csv,json}")
    return files.select(
        F.col("_metadata.file_name").alias("source"), F.lit(category).alias("category"),
        F.col("value").alias("text")).where(F.trim("text") != "")


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    return (spark.read.parquet(name_or_path) if "/" in name_or_path
            else spark.table(name_or_path))


def read_eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """All evaluation runs (one JSON file each) with the version in their path as run_id."""
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path).select(
        F.regexp_extract("_metadata.file_path", r"_v(\d+_\d+)", 1).alias("run_id"), "*")


def write_eval_runs(runs: DataFrame, folder: str) -> int:
    """One JSON file for each row of ``runs`` (version, body), named after its version; their number.

    The tasks write the files themselves.  A writer with a partition per run would make a folder for
    each and move every file once more in the driver.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for version, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = "evaluation_results" if version is None else f"evaluation_results_v{version}"
                put(folder, f"{name}.{task}-{n}.json", body.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return runs.select("version", "body").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def latest_eval_run(runs: DataFrame) -> DataFrame:
    """The run with the greatest version."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "run_id").alias("r")).select("r.*")


def read_data_report(spark: SparkSession, path: str, schema: str | None = None,
                     one_per_file: bool = True) -> DataFrame | None:
    """The report beside a dataset, or None when there is none."""
    try:
        r = spark.read.option("multiLine", one_per_file)
        return r.schema(schema).json(path) if schema else r.json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_cleaned(df: DataFrame, path: str, upload_id: int | None = None) -> None:
    """A new cleaned table; fails when it exists."""
    out = df if upload_id is None else df.withColumn("upload_id", F.lit(upload_id))
    w = out.write.mode("errorifexists")
    (w.partitionBy("upload_id") if upload_id is not None else w).parquet(path)


def write_aggregates(customer: DataFrame | None, monthly: DataFrame | None, folder: str) -> None:
    """Customer and monthly tables, replaced when present."""
    for name, df in (("customer", customer), ("monthly", monthly)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_csv_encoded(df: DataFrame, path: str, encoding: str, mode: str = "errorifexists") -> None:
    """CSV with header in one of the charsets that ``read_csv_encoded`` reads.

    A character that the charset does not have becomes a question mark.
    """
    charset = H.canonical(encoding)
    writer_charset = charset
    if charset in (H.WESTERN, H.ARABIC):  # their bytes are written as those of ISO-8859-1
        image = lambda c: F.decode(H.encoded(c, charset), H.LATIN1)
        df = df.select(*[(image(col(c)) if t == "string" else col(c)).alias(c) for c, t in df.dtypes])
        writer_charset = H.LATIN1
    df.write.mode(mode).options(header=True, escape='"', encoding=writer_charset).csv(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """A report as JSON lines; NaN becomes null."""
    clean = report.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if t in ("double", "float") else col(c)
        for c, t in report.dtypes])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_task_datasets(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """The three training tables side by side."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.options(header=True, escape='"')
        w.format(fmt).save(f"{folder}/{name}")
