"""Chunk tables and search over them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions import text as T
from tillwise.functions.exprs import col
from tillwise.functions.vocab import TOPIC_WORDS
from tillwise.operators.records import delete_source, upsert

QUESTIONS_PER_BATCH = 2048      # bounds what one task holds; more questions run in more batches


def chunk_text(docs: DataFrame, text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    """One row per chunk with its index; other columns are kept."""
    rest = [c for c in docs.columns if c != text]
    split = docs.select(*rest, T.words(text).alias("_words"))
    return split.select(*rest, F.posexplode(T.chunks(F.col("_words"), size, overlap))
                        .alias("chunk_idx", "text"))


def ingest_documents(docs: DataFrame, ingested, source: str = "source",
                     category: str = "category", text: str = "text") -> DataFrame:
    """Chunks with id and metadata, ready to upsert."""
    part = docs.select(col(source).alias("source"), col(category).alias("category"),
                       col(text).alias("text"))
    return chunk_text(part).select(
        T.chunk_id("source", "chunk_idx", "text").alias("chunk_id"), "text", "source", "category",
        "chunk_idx", F.lit(ingested).cast("timestamp_ntz").alias("ingested"))


def chunk_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["chunk_id"], ["ingested"])


def kb_stats(chunks: DataFrame) -> DataFrame:
    """Chunk counts in total, per source and per category, as rows."""
    kind = F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")),
        F.struct(F.lit("source").alias("kind"), col("source").alias("name")),
        F.struct(F.lit("category").alias("kind"), col("category").alias("name"))))
    return chunks.select(kind.alias("k")).groupBy("k.kind", "k.name").agg(
        F.count("*").alias("chunks"))


def semantic_search(chunks: DataFrame, questions: DataFrame, n: int = 5,
                    min_relevance: float = 0.25) -> DataFrame:
    """Exact cosine search: (question_id, chunk_id, relevance, rank) of the best ``n`` per question.

    ``chunks`` has chunk_id, embedding and, when questions name one, category; ``questions`` has
    question_id, embedding and optionally category; rows without an embedding take no part.  Questions go to the tasks in batches of a
    fixed size; each Arrow batch of chunks is one matrix product and keeps its best ``n`` per
    question, so the shuffle carries candidates, never all pairs.
    """
    chunks, questions = (t.where(col("embedding").isNotNull()) for t in (chunks, questions))
    total = questions.count()
    batches = max(1, -(-total // QUESTIONS_PER_BATCH))
    bucket = F.pmod(F.xxhash64("question_id"), F.lit(batches))
    found = None
    for b in range(batches):
        part = _search_batch(chunks, questions.where(bucket == b), n, min_relevance)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("question_id").orderBy(F.desc("relevance"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _search_batch(chunks, questions, n, min_relevance):
    import numpy as np
    import pandas as pd

    has_cat = "category" in questions.columns and "category" in chunks.columns
    rows = questions.select("question_id", "embedding", *(["category"] if has_cat else [])).collect()
    ids = [r.question_id for r in rows]
    cats = [r.category if has_cat else None for r in rows]
    q = np.array([r.embedding for r in rows], dtype="float64").reshape(len(rows), -1)
    if len(rows):
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not ids:
                continue
            m = np.stack(pdf["embedding"].to_numpy()).astype("float64")
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            sim = m @ q.T
            if has_cat:
                own = pdf["category"].to_numpy()
                for k, c in enumerate(cats):
                    if c is not None:
                        sim[own != c, k] = -2.0
            keys, out = pdf["chunk_id"].to_numpy(), []
            for k, qid in enumerate(ids):
                s = sim[:, k]
                good = np.flatnonzero(s >= min_relevance)
                if not len(good):
                    continue
                order = good[np.lexsort((keys[good], -s[good]))[:n]]
                out.append(pd.DataFrame({"question_id": qid, "chunk_id": keys[order],
                                         "relevance": s[order]}))
            if out:
                yield pd.concat(out)

    kinds = dict(chunks.dtypes)
    schema = (f"question_id {dict(questions.dtypes)['question_id']}, chunk_id {kinds['chunk_id']}, "
              "relevance double")
    cols = ["chunk_id", "embedding"] + (["category"] if has_cat else [])
    return chunks.select(*cols).mapInPandas(search, schema)


def build_context(hits: DataFrame, chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """The kept chunks of each question as one text with source and relevance headers.

    Each question has at most the few chunks the search kept.
    """
    part = F.concat(
        F.lit("[Source: "), F.coalesce("source", F.lit("?")), F.lit(" | Relevance: "),
        F.round(F.col("relevance") * 100, 1).cast("string"), F.lit("%]\n"),
        T.trim_at_sentence("text", limit))
    rows = chunks.select("chunk_id", "text", "source").join(hits, "chunk_id")
    return rows.withColumn("part", part).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "part", "source"))).alias("p")).select(
        "question_id",
        F.array_join(F.transform("p", lambda x: x["part"]), "\n\n---\n\n").alias("context"),
        F.array_join(F.transform("p", lambda x: x["source"]), ", ").alias("sources"),
        F.size("p").alias("chunks_used"))


def reuse_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Earlier answer of each question with the same role and category, newest first."""
    key = T.answer_key("question", "role", "category")
    kept = answers.withColumn("cache_key", key).groupBy("cache_key").agg(
        F.max_by("answer", F.struct("created_at", "answer")).alias("answer"))
    return questions.withColumn("cache_key", key).join(kept, "cache_key", "left")


def parse_evidence_tags(answers: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """Bullet rows of each answer; an answer without bullets gets the fixed fallback."""
    none = F.struct(F.concat(
        F.lit("The uploaded data does not directly support claims about "), col(title),
        F.lit(". Upload more relevant data to populate this block.")).alias("text"),
        F.lit("observed").alias("tag"))
    b = T.evidence_bullets(text)
    return answers.select(col(key), F.posexplode(
        F.when(F.size(b) > 0, b).otherwise(F.array(none))).alias("bullet", "b")).select(
        col(key), "bullet", "b.text", "b.tag")


def dataset_text_profile(df: DataFrame, name: str, order: list[str], max_columns: int = 20,
                         max_numeric: int = 8, max_text: int = 3, sample_rows: int = 10) -> DataFrame:
    """A dataset as searchable text: topics, shape, number ranges, top values, first rows.

    It is a summary for people: so many columns, numeric and text columns and rows are shown.
    """
    names = df.columns
    low = " ".join(c.lower() for c in names)
    topics = [t for t, ws in TOPIC_WORDS.items() if any(w in low for w in ws)]
    num = [c for c, t in df.dtypes if t.split("(")[0] in
           ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")][:max_numeric]
    txt = [c for c, t in df.dtypes if t == "string"][:max_text]
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    aggs = [F.format_number(F.count(F.lit(1)), 0).alias("n")]
    for k, c in enumerate(num):
        aggs.append(F.concat(F.lit(f"  {c}: min="), two(F.min(col(c))), F.lit(" max="),
                             two(F.max(col(c))), F.lit(" mean="), two(F.avg(col(c)))).alias(f"m{k}"))
    one = df.agg(*aggs)
    for k, c in enumerate(txt):
        top = df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(
            F.count("*").alias("k")).orderBy(F.desc("k"), "v").limit(3)
        line = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct((-F.col("k")).alias("o"), "v", "k"))),
            lambda x: F.concat(x["v"], F.lit("("), x["k"].cast("string"), F.lit(")"))), ", ").alias("s"))
        one = one.withColumn(f"t{k}", F.concat(F.lit(f"TOP {c}: "), line.scalar()))
    head = df.orderBy(*[col(c) for c in order]).limit(sample_rows).select(
        F.concat_ws(" | ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in names]).alias("r"),
        F.struct(*[col(c).alias(f"k{j}") for j, c in enumerate(order)]).alias("o"))
    sample = head.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))),
                                               lambda x: x["r"]), "\n").alias("s"))
    lines = [F.lit(f"Dataset: {name}"),
             F.lit("This file contains data about: "
                   + (", ".join(topics) if topics else "general business activity") + "."),
             F.lit("Topics: " + ("; ".join(topics) if topics else "general business data") + "."),
             F.concat(F.lit("Shape: "), F.col("n"), F.lit(f" rows x {len(names)} columns")),
             F.lit("Columns: " + ", ".join(names[:max_columns])), F.lit("")]
    if num:
        lines += [F.lit("NUMERIC SUMMARY:"), *[F.col(f"m{k}") for k in range(len(num))], F.lit("")]
    lines += [F.col(f"t{k}") for k in range(len(txt))]
    lines += [F.lit(""), F.lit(f"SAMPLE (first {sample_rows} rows):"), sample.scalar()]
    return one.select(F.lit(name).alias("source"), F.concat_ws("\n", *lines).alias("text"))


def snapshot_text(runs: DataFrame, as_of: str) -> DataFrame:
    """Headline metrics of evaluation runs as text, one row per run."""
    r, c, g = "revenue_model.", "churn_model.", "growth_model."
    s = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("None"))
    names = lambda x: F.array_join(F.transform(F.slice(F.col(x), 1, 5), lambda f: f["feature"]), ", ")
    fc = F.col("revenue_model.`12_period_forecast`")
    mean = F.aggregate(fc, F.lit(0.0), lambda a, b: a + b) / F.size(fc)
    return runs.select("run_id", F.concat_ws(
        "", F.lit(f"Model performance -- {as_of}\n\n"),
        F.lit("REVENUE: MAPE="), s(r + "MAPE_pct"), F.lit("%  R2="), s(r + "R2"), F.lit("  Bias="),
        s(r + "forecast_bias"), F.lit("\n"),
        F.when(F.size(r + "top_features") > 0, F.concat(
            F.lit("Revenue drivers: "), names(r + "top_features"), F.lit("\n"))),
        F.when(F.size(fc) > 0, F.concat(F.lit("12-period avg forecast: $"),
                                        F.format_number(mean, 2), F.lit("\n"))),
        F.lit("\nCHURN: ROC-AUC="), s(c + "ROC_AUC"), F.lit("  Rate="), s(c + "churn_rate_pct"),
        F.lit("%\n"),
        F.when(F.size(c + "top_features") > 0, F.concat(
            F.lit("Churn predictors: "), names(c + "top_features"), F.lit("\n"))),
        F.lit("\nGROWTH: MAPE="), s(g + "MAPE_pct"), F.lit("%  R2="), s(g + "R2"), F.lit("\n"),
    ).alias("text"))


def ingest_kpi_snapshot(chunks: DataFrame, text: DataFrame, label, ingested) -> DataFrame:
    """Replace the snapshot chunks of a label by those of a fresh text.

    ``label`` is a name, or a column of ``text`` when many snapshots are refreshed at once.
    """
    fresh = text.withColumn("source", F.lit(label) if isinstance(label, str) else label)
    new = ingest_documents(fresh.withColumn("category", F.lit("ml_results")), ingested)
    return delete_source(chunks, fresh.select("source").distinct()).select(
        *new.columns).unionByName(new)


def hashed_vectors(df: DataFrame, text: str = "text", size: int = 1 << 15) -> DataFrame:
    """TF-IDF vectors of texts, unit length, where no embedding column exists."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    steps = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\W+"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_n")])
    return steps.fit(df).transform(df).withColumn(
        "embedding", vector_to_array("_n", "float32")).drop("_w", "_tf", "_idf", "_n")
