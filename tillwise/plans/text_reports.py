"""Registered queries: chunks, search, question and answer rules."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tillwise.functions import text as T
from tillwise.functions.vocab import (
    CURRENCY_CODES, HEDGES, INTENT_WORDS, LEAK_MARKERS, LEAK_OPENINGS, STRONG_HEDGES, TEXT_REGIONS,
)
from tillwise.operators import records as R
from tillwise.operators import retrieval as V
from tillwise.operators.dashboard import currency_from_text
from tillwise.plans.registry import query

WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
NOW = datetime.datetime(2001, 12, 31)

CHUNKS = f"""
c0 AS (SELECT doc_id, source, lang, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS w FROM documents),
c1 AS (SELECT doc_id, source, lang, list_filter(list_transform(range(0, CASE WHEN len(w) <= 400 THEN 1
    ELSE 1 + CAST(CEIL((len(w) - 400) / 320.0) AS BIGINT) END),
    lambda k: array_to_string(w[k * 320 + 1 : k * 320 + 400], ' ')), lambda t: length(t) > 30) AS c
  FROM c0 WHERE len(w) > 0),
ch AS (SELECT doc_id, source, lang, CAST(k - 1 AS INT) AS chunk_idx, c[k] AS text
  FROM (SELECT doc_id, source, lang, c, UNNEST(range(1, len(c) + 1)) AS k FROM c1))"""
IDS = "source || '_' || chunk_idx || '_' || substr(md5(source || '_' || chunk_idx || '_' || substr(text, 1, 50)), 1, 8)"


@query("chunk_text", f"WITH {CHUNKS.strip()} SELECT doc_id, chunk_idx, text FROM ch")
def _(i):
    return V.chunk_text(i.table("documents").select("doc_id", "text"))


@query("chunk_id", f"WITH {CHUNKS.strip()} SELECT doc_id, chunk_idx, {IDS} AS chunk_id FROM ch")
def _(i):
    ch = V.chunk_text(i.table("documents").select("doc_id", "source", "text"))
    return ch.select("doc_id", "chunk_idx", T.chunk_id("source", "chunk_idx", "text").alias("chunk_id"))


def _docs(i):
    return i.table("documents").select(
        F.concat_ws("-", "source", "doc_id").alias("source"), F.col("lang").alias("category"), "text")


DOCS_SQL = CHUNKS.replace("source, lang, list_filter", "source || '-' || doc_id AS source, lang, list_filter", 1)


@query("ingest_documents", f"""WITH {DOCS_SQL.strip()}
SELECT {IDS} AS chunk_id, source, lang AS category, chunk_idx, md5(text) AS text FROM ch""")
def _(i):
    return V.ingest_documents(_docs(i), NOW).select(
        "chunk_id", "source", "category", "chunk_idx", F.md5("text").alias("text"))


@query("chunk_upsert", f"""WITH {DOCS_SQL.strip()}
SELECT {IDS} AS chunk_id, CASE WHEN lang = 'en' THEN 'updated' ELSE lang END AS category FROM ch""")
def _(i):
    old = V.ingest_documents(_docs(i), NOW)
    new = old.where("category = 'en'").withColumns({
        "category": F.lit("updated"),
        "ingested": F.lit(NOW + datetime.timedelta(days=1)).cast("timestamp_ntz")})
    return V.chunk_upsert(old, new).select("chunk_id", "category")


@query("delete_source", f"""WITH {CHUNKS.strip()}
SELECT source, COUNT(*) AS chunks FROM ch WHERE source NOT IN ('src1', 'src2') GROUP BY source""")
def _(i):
    ch = V.chunk_text(i.table("documents").select("doc_id", "source", "text"))
    gone = R.delete_source(ch, i.spark.createDataFrame([("src1",)], "source string"))
    return R.delete_source(gone, "src2").groupBy("source").agg(F.count("*").alias("chunks"))


@query("kb_stats", f"""WITH {CHUNKS.strip()}
SELECT 'total' AS kind, 'all' AS name, COUNT(*) AS chunks FROM ch
UNION ALL SELECT 'source', source, COUNT(*) FROM ch GROUP BY source
UNION ALL SELECT 'category', lang, COUNT(*) FROM ch GROUP BY lang""")
def _(i):
    ch = V.chunk_text(i.table("documents").select("source", F.col("lang").alias("category"), "text"))
    return V.kb_stats(ch)


QUESTION_VECTORS = """
q0 AS (SELECT label, AVG(CAST(v AS DOUBLE)) AS v, k FROM (SELECT label, UNNEST(embedding) AS v,
        UNNEST(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY label, k),
q AS (SELECT label, list(v ORDER BY k) AS qv FROM q0 GROUP BY label)"""
HITS = """
s AS (SELECT q.label AS question_id, vec_id AS chunk_id,
        list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS rel FROM embeddings e, q $W),
h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY rel DESC, chunk_id) AS rank
      FROM s WHERE rel >= $M)"""


def _questions(i):
    e = i.table("embeddings")
    long = e.select("label", F.posexplode("embedding").alias("k", "v"))
    mean = long.groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy(F.col("label").alias("question_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("embedding"))


def _chunks(i):
    return i.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding",
                                        F.col("label").alias("category"))


def _hits_sql(where, least):
    return QUESTION_VECTORS.strip() + "," + HITS.replace("$W", where).replace("$M", str(least))


@query("semantic_search", f"""WITH {_hits_sql("", 0.25)}
SELECT question_id, chunk_id, CAST(rank AS INT) AS rank, ROUND(rel, 6) AS relevance FROM h WHERE rank <= 5""")
def _(i):
    return V.semantic_search(_chunks(i), _questions(i)).withColumn(
        "relevance", F.round("relevance", 6))


@query("semantic_search_by_category", f"""WITH {_hits_sql("WHERE e.label = q.label", -1)}
SELECT question_id, chunk_id, CAST(rank AS INT) AS rank, ROUND(rel, 6) AS relevance FROM h WHERE rank <= 10""")
def _(i):
    q = _questions(i).withColumn("category", F.col("question_id"))
    return V.semantic_search(_chunks(i), q, n=10, min_relevance=-1.0).withColumn(
        "relevance", F.round("relevance", 6))


TRIM = """CASE WHEN length(text) <= 1200 THEN text
 WHEN p1 > 720 THEN trim(substr(text, 1, p1 + 1), E' \\t\\n\\r') || ' ...'
 WHEN p2 > 720 THEN trim(substr(text, 1, p2 + 1), E' \\t\\n\\r') || ' ...'
 WHEN p3 > 720 THEN trim(substr(text, 1, p3 + 1), E' \\t\\n\\r') || ' ...'
 WHEN p4 > 720 THEN trim(substr(text, 1, p4 + 1), E' \\t\\n\\r') || ' ...'
 ELSE trim(substr(text, 1, 1200), E' \\t\\n\\r') || ' ...' END"""
_LAST = "CASE WHEN contains(substr(text, 1, 1200), {s}) THEN length(substr(text, 1, 1200)) - length(string_split(substr(text, 1, 1200), {s})[-1]) - 2 ELSE -1 END"
POS = ", ".join(f"{_LAST.format(s=s)} AS p{k}" for k, s in enumerate(
    ("'. '", "E'.\\n'", "'! '", "'? '"), 1))


@query("trim_at_sentence", f"""
SELECT doc_id, {TRIM} AS text FROM (SELECT doc_id, text, {POS} FROM documents)""")
def _(i):
    return i.table("documents").select("doc_id", T.trim_at_sentence("text").alias("text"))


@query("build_context", f"""WITH {_hits_sql("", 0.25)},
k AS (SELECT doc_id, source, {TRIM} AS text FROM (SELECT doc_id, source, text, {POS} FROM documents))
SELECT question_id, string_agg('[Source: ' || source || ' | Relevance: ' || ROUND(rel * 100, 1) || E'%]\\n' || text,
   E'\\n\\n---\\n\\n' ORDER BY rank) AS context, string_agg(source, ', ' ORDER BY rank) AS sources,
   CAST(COUNT(*) AS INT) AS chunks_used FROM h JOIN k ON chunk_id = doc_id WHERE rank <= 5 GROUP BY question_id""")
def _(i):
    hits = V.semantic_search(_chunks(i), _questions(i))
    docs = i.table("documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return V.build_context(hits, docs)


# Questions and answers ----------------------------------------------------------------------

ASKED = """
SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'ops' ELSE NULL END AS category,
  concat(CASE (conv_id * 3 + turn) % 12 WHEN 0 THEN 'Hello ' WHEN 1 THEN 'What is our Churn rate for '
   WHEN 2 THEN 'Show the sales forecast of ' WHEN 3 THEN 'monthly growth and revenue forecast ' WHEN 4 THEN 'How accurate is '
   WHEN 5 THEN 'What drives ' WHEN 6 THEN ' Thanks' WHEN 7 THEN 'so how are you' WHEN 8 THEN 'great'
   WHEN 9 THEN 'prices in Cairo, EGP 5 ' WHEN 10 THEN 'paid 7 usd. near London ' ELSE '' END,
   CASE WHEN (conv_id * 3 + turn) % 12 IN (6, 7, 8) THEN '' ELSE text END) AS question
FROM conversations"""
REPLIES = """
SELECT conv_id, turn, role, CASE (conv_id + turn) % 9 WHEN 0 THEN concat('<think>plan it', chr(10), 'now</think>', text)
   WHEN 1 THEN concat('We need to write ', text) WHEN 2 THEN concat('half a thought </think> ', text)
   WHEN 3 THEN concat('The rest. Let me see. Step 1: we must act. ', text) WHEN 4 THEN 'Short.' WHEN 5 THEN '  '
   WHEN 6 THEN concat(' okay, ', text) WHEN 7 THEN concat('It would be good and may be so: ', text) ELSE text END AS answer
FROM conversations"""


def _any(words):
    return "|".join(w.replace("-", "\\-") for w in words)


@query("intent_route", f"SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN regexp_matches(lower(question), '{_any(w)}') THEN '{n}'" for n, w in INTENT_WORDS.items())
    + f" END AS intent FROM ({ASKED})")
def _(i):
    return i.sql(ASKED).select("conv_id", "turn", T.intent_route("question").alias("intent"))


@query("casual_message", f"""
SELECT conv_id, turn, length(q) > 0 AND length(q) < 80 AND regexp_matches(q,
 '(?i)^\\s*(hi|hello|hey|yo|sup|howdy|hola|salam|salaam)\\b|^\\s*good\\s*(morning|afternoon|evening|night)|\\bhow\\s+are\\s+you\\b|\\bhow''?s?\\s+it\\s+going\\b|\\bwhat''?s?\\s+up\\b|^\\s*thanks?\\b|^\\s*thank\\s+you\\b|^\\s*(ok|okay|cool|nice|great|awesome|got\\s+it)\\s*$|^\\s*who\\s+are\\s+you\\b|^\\s*what\\s+can\\s+you\\s+do\\b|^\\s*help\\s*$')
 AS is_casual FROM (SELECT conv_id, turn, trim(question, E' \\n\\t') AS q FROM ({ASKED}))""")
def _(i):
    return i.sql(ASKED).select("conv_id", "turn", T.casual_message("question").alias("is_casual"))


CLEAN = """trim(regexp_replace(regexp_replace(answer, '(?is)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g'),
  '(?is)^.*</think>', ''), E' \\n\\t')"""
_q = lambda ws: "|".join(w.replace("'", "''") for w in ws)
LEAK = f"""(regexp_matches(lower(ltrim($T, E' \\n\\t')), '^({_q(LEAK_OPENINGS)})') OR """ + " + ".join(
    "contains(lower(substr($T, 1, 600)), '{}')::INT".format(m.replace("'", "''")) for m in LEAK_MARKERS) + " >= 3)"


@query("strip_reasoning", f"SELECT conv_id, turn, {CLEAN} AS answer FROM ({REPLIES})")
def _(i):
    return i.sql(REPLIES).select("conv_id", "turn", T.strip_reasoning("answer").alias("answer"))


@query("reasoning_leak", f"""
SELECT conv_id, turn, {LEAK.replace("$T", "answer")} AS is_leak,
 CASE WHEN trim(answer) = '' THEN 'empty response' WHEN length(c) < 30
   THEN 'response too short after stripping reasoning tags' WHEN {LEAK.replace("$T", "c")}
   THEN 'response is chain-of-thought, not finished prose' END AS verdict
FROM (SELECT *, {CLEAN} AS c FROM ({REPLIES}))""")
def _(i):
    return i.sql(REPLIES).select("conv_id", "turn", T.reasoning_leak("answer").alias("is_leak"),
                                 T.answer_verdict("answer").alias("verdict"))


@query("speculation_flag", f"""
SELECT conv_id, turn, regexp_matches(' ' || lower(answer) || ' ', '{_q(HEDGES)}') AS hedged FROM ({REPLIES})""")
def _(i):
    return i.sql(REPLIES).select("conv_id", "turn", T.speculation_flag("answer").alias("hedged"))


@query("currency_from_text", "SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN regexp_matches(t, '( {c}[ .,])|(^{c} )|( {c}$)') THEN '{c.upper()}'" for c in CURRENCY_CODES)
    + " " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{c}'" for c, w in TEXT_REGIONS)
    + f" ELSE 'the local currency' END AS currency FROM (SELECT *, lower(question) AS t FROM ({ASKED}))")
def _(i):
    return i.sql(ASKED).select("conv_id", "turn", currency_from_text("question").alias("currency"))


@query("answer_cache_key", f"""
WITH q AS (SELECT a.*, md5(question || '|' || role || '|' || COALESCE(category, '_')) AS cache_key FROM ({ASKED}) a),
k AS (SELECT cache_key, arg_max(conv_id * 100 + turn, (conv_id, turn)) AS answer FROM q GROUP BY cache_key)
SELECT q.conv_id, q.turn, q.cache_key, k.answer FROM q JOIN k USING (cache_key)""")
def _(i):
    asked = i.sql(ASKED)
    answers = asked.select("question", "role", "category", (F.col("conv_id") * 100 + F.col("turn"))
                           .alias("answer"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"))
    return V.reuse_answers(asked, answers).select("conv_id", "turn", "cache_key", "answer")


BULLETS = """
SELECT conv_id, turn, role, CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN ' - a ' ELSE concat(
  '- Revenue is 5 [observed] in ', role, chr(10), '2) Churn is Likely high [Derived], so x [inferred]..', chr(10), chr(10),
  '* ', replace(substr(text, 1, 60), chr(10), ' '), '  [OBSERVED]', chr(10), '• it seems to grow ; [observed]', chr(10),
  '- abc', chr(10), CASE WHEN conv_id % 3 = 0 THEN '' ELSE '  - see [note] for more [assumption]!' END, chr(10), '- no tag here…') END AS raw
FROM conversations"""
BULLET_SQL = f"""
WITH a AS ({BULLETS}),
l AS (SELECT conv_id, turn, role, list_transform(string_split(raw, chr(10)), lambda x: trim(x, E' \\t')) AS ls FROM a),
m AS (SELECT conv_id, turn, role, list_filter(list_transform(ls, lambda t:
   CASE WHEN regexp_matches(t, '^(- |\\* |• )') OR (length(t) > 2 AND regexp_matches(t, '^\\d[.):]'))
     THEN trim(substr(t, 3), E' \\t') ELSE t END), lambda t: length(t) >= 5) AS ls FROM l),
p AS (SELECT conv_id, turn, role, ls, UNNEST(range(1, LEAST(len(ls), 4) + 1)) AS k FROM m),
x AS (SELECT conv_id, turn, k, ls[k] AS line,
   list_filter(list_transform(regexp_extract_all(ls[k], '\\[([a-zA-Z]+)\\]', 1), lambda g: lower(g)),
     lambda g: g IN ('observed', 'derived', 'inferred', 'assumption')) AS tags,
   regexp_replace(array_to_string(list_filter(string_split_regex(regexp_replace(ls[k],
     '(?i)\\[(observed|derived|inferred|assumption)\\]', '', 'g'), '{WS}'), lambda w: w <> ''), ' '), '[ .,;:…]+$', '') AS body FROM p),
y AS (SELECT conv_id, turn, k, CASE WHEN body = '' OR regexp_matches(body, '[.!?]$') THEN body ELSE body || '.' END AS text,
   COALESCE(tags[-1], 'inferred') AS tag FROM x)
SELECT conv_id, turn, CAST(k - 1 AS INT) AS bullet, text, CASE WHEN tag IN ('observed', 'derived')
   AND regexp_matches(' ' || lower(text) || ' ', '{_q(STRONG_HEDGES)}') THEN 'inferred' ELSE tag END AS tag FROM y
UNION ALL SELECT conv_id, turn, 0, 'The uploaded data does not directly support claims about ' || role ||
 '. Upload more relevant data to populate this block.', 'observed' FROM m WHERE len(ls) = 0"""


@query("parse_evidence_tags", BULLET_SQL)
def _(i):
    rows = i.sql(BULLETS).withColumn("key", F.struct("conv_id", "turn"))
    return V.parse_evidence_tags(rows, "key", "raw", "role").select(
        "key.conv_id", "key.turn", "bullet", "text", "tag")


def _top(c):
    return (f"(SELECT 'TOP {c}: ' || string_agg(v || '(' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, "
            f"COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3))")


def _range(c):
    return f"'  {c}: min=' || format('{{:.2f}}', MIN({c})::DOUBLE) || ' max=' || format('{{:.2f}}', MAX({c})::DOUBLE) || ' mean=' || format('{{:.2f}}', AVG({c}))"


@query("dataset_text_profile", f"""
SELECT 'orders' AS source, concat_ws(chr(10), 'Dataset: orders',
 'This file contains data about: order transactions and ecommerce activity, product catalogue and pricing.',
 'Topics: order transactions and ecommerce activity; product catalogue and pricing.',
 'Shape: ' || format('{{:,}}', COUNT(*)) || ' rows x 6 columns',
 'Columns: o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority', '', 'NUMERIC SUMMARY:',
 {_range("o_orderkey")}, {_range("o_custkey")}, {_range("o_totalprice")}, '', {_top("o_orderstatus")}, {_top("o_orderpriority")},
 '', 'SAMPLE (first 10 rows):', (SELECT string_agg(concat_ws(' | ', o_orderkey, o_custkey, o_orderstatus, o_totalprice,
   o_orderdate, o_orderpriority), chr(10) ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10))) AS text
FROM orders""")
def _(i):
    return V.dataset_text_profile(i.table("orders"), "orders", ["o_orderkey"])


@query("hashed_vectors")
def _(i):
    return V.hashed_vectors(i.table("documents").select("doc_id", "text"), size=1 << 12).select(
        "doc_id", F.size("embedding").alias("width"))
