"""Training-data pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it leaves; the last returns
pieces of sequences.  ``run`` writes every stage's documents as Parquet and reads them for the next.
Rows are told by id and text, so null and repeated ids are documents of their own; columns that
``documents`` does not have are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.decontaminate import find_items
from tillwise.llm.jaccard import one_of_each
from tillwise.llm.packing import pack
from tillwise.llm.pii import personal_data
from tillwise.llm.queries import table, tokenizer_file
from tillwise.llm.staging import Scratch
from tillwise.llm.toxicity import fit, score_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the model's cut; it learns from their labels."""
    docs = docs.select(*COLUMNS)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).where(~(F.col("toxicity") >= model.cut)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return one_of_each(docs.select(*COLUMNS), Scratch(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark phrase."""
    docs = docs.select(*COLUMNS)
    found = find_items(docs, table(spark, sf_dir, "benchmark"), Scratch(spark), slop=0)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_print"))
    return docs.join(hit, same, "left_anti")


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data."""
    found = personal_data(docs.select(*COLUMNS), redact=True)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) \
        .select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = pack(docs, tokenizer_file("byte_bpe_50k.json"), Scratch(spark))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("jaccard_join", near_duplicates),
          ("decontamination", decontamination), ("personal_data", personal_data_removal),
          ("packing", packing)]

#: Trained scores and tokenizers have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
