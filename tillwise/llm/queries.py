"""Registered queries over whole tables; each applies one operator and derives its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def corpus_query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@corpus_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text measures, base rules and host verdicts."""
    from tillwise.llm.quality import judge_hosts

    return judge_hosts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_docs", "host_failed", "host_rate", "host_rejected")


@corpus_query
def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written to the shared folder and read back; the digest outlives the archives."""
    from tillwise.llm.staging import Scratch
    from tillwise.llm.warc import read_archives, write_archives
    from tillwise.session import checkpointed

    scratch = Scratch(spark)
    folder = f"{scratch.folder}/archives"
    scratch.table(write_archives(table(spark, sf_dir, "pages"), folder), "manifest")
    records = checkpointed(read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"))
    scratch.drop()
    return records


@corpus_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of personal data in each text."""
    from tillwise.llm.pii import BASE_KINDS, KINDS, personal_data, spans_text

    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(spans_text(BASE_KINDS), 256).alias("base_sha256"),
        spans_text(KINDS).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0))
        .alias("top_score"))


def fold(folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % folds


@corpus_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model from the labels outside fold 0 of 5."""
    from tillwise.llm.toxicity import fit, score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(fold(5) != 0), table(spark, sf_dir, "labels"))
    return score_texts(docs, model, "score").select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@corpus_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of ten words in all documents."""
    from tillwise.llm.decontaminate import find_items
    from tillwise.llm.staging import Scratch

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                       Scratch(spark))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"))


@corpus_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that start in an earlier document, removed from all documents."""
    from tillwise.llm.staging import Scratch
    from tillwise.llm.substrings import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@corpus_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents: shingles of five words, 0.8 or more."""
    from tillwise.llm.jaccard import jaccard_classes
    from tillwise.llm.staging import Scratch

    return jaccard_classes(table(spark, sf_dir, "documents"), Scratch(spark)).drop("print")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@corpus_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text by the lower-casing word BPE."""
    from tillwise.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(docs, tokenizer_file("word_bpe_49k.json")).withColumn(
        "over_limit", F.col("n_tokens") > 2048)


@corpus_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens along the curve."""
    from tillwise.llm.packing import pack
    from tillwise.llm.staging import Scratch

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), Scratch(spark))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@corpus_query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a trigram model of the texts outside fold 0 of 10."""
    from tillwise.llm.ngram_lm import score, train
    from tillwise.llm.staging import Scratch

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (fold(10) == 0).alias("held_out"), "text")
    model = train(docs.where(~F.col("held_out")), Scratch(spark), order=3)
    return score(docs, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long")
        .alias("train_tokens"), "base_score", "score")


@corpus_query
def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts by the lower-casing word BPE, and the texts that the ids decode to."""
    from tillwise.llm.bpe_codec import decode_ids, encode_texts

    path = tokenizer_file("word_bpe_49k.json")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return decode_ids(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def periodic_tail():
    """The text with a periodic tail where crc32 of the id ends in 0: with g = crc32 / 10 and n words,
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), all in whole
    numbers.  A row without an id stays as it is."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    altered = F.expr("""
        array_join(transform(sequence(0, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')""")
    hash_ = F.crc32(F.col("doc_id").cast("string"))

    def apply(docs: DataFrame) -> DataFrame:
        ten = docs.select("doc_id", "text", F.when(hash_ % 10 == 0, F.floor(hash_ / 10)).alias("g"))
        cut = ten.withColumn("words", F.when(F.col("g").isNotNull(), words)) \
            .withColumn("n", F.size("words")) \
            .withColumn("a", F.expr("if(n > 0, g % n, null)")) \
            .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
        return cut.select("doc_id", F.when(F.col("n") > 0, altered).otherwise(F.col("text")).alias("text"))

    return apply


@corpus_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts, a tenth of them with a periodic tail; digests of runs and collapsed texts."""
    from tillwise.llm.runs import find_runs

    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text").transform(periodic_tail()))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@corpus_query
def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    from tillwise.llm.centroids import cluster
    from tillwise.llm.staging import Scratch

    found = cluster(table(spark, sf_dir, "embeddings"), Scratch(spark), k=8, rounds=10)
    listed = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(listed, 256).alias("centroid_sha256"))


def _clusters_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Plain rounds: every vector against every centroid, means by component."""
    steps = [f"""
        v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
            list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
            FROM embeddings WHERE len(embedding) = {size}
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS cluster, vec FROM (
            SELECT sha256('3:' || vec_id) AS h, vec FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (SELECT r, vec_id, v.vec, cluster, CAST(list_sum(list_transform(
            range(1, {size + 1}), lambda i: (v.vec[i] - c.vec[i]) * (v.vec[i] - c.vec[i]))) AS BIGINT) AS distance
            FROM v CROSS JOIN c{i} c
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
        c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{i} c LEFT JOIN (
            SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS vec FROM (
                SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                    SELECT cluster, unnest(vec) AS x, unnest(range({size})) AS i FROM a{i})
                GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return f"""WITH {",".join(steps)}
        SELECT vec_id, a.cluster, distance,
            CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.vec, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


ORACLE["op11_shallot_clusters"] = _clusters_sql()
