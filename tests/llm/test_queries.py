"""Registered queries and pipeline stages beside plain versions, over whole small tables."""

import hashlib
import os
import zlib

import brute
import numpy as np
import pytest
from conftest import SF, pairs, same

import corpus_pipeline as pipeline
from tillwise.llm.queries import QUERIES


def columns(df, names):
    return df.select(*names.split())


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join("/opt/tokenizers", name))


def test_op1(spark, docs):
    out = QUERIES["op1_quality_rules"](spark, SF)
    same(columns(out, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed"),
         brute.measures(pairs(docs)))


def test_op2(spark, docs):
    same(columns(QUERIES["op2_substring_dedup"](spark, SF), "doc_id n_words n_removed kept_sha256"),
         brute.substrings(pairs(docs)))


def test_op3(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = columns(QUERIES["op3_decontamination"](spark, SF), "doc_id n_words n_hit n_items items_sha256 contaminated")
    same(out, brute.decontamination(pairs(docs), items))


def test_op4(spark):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for p, b in rows:
        if len(b) >= 1000:
            last[b] = max(p, last.get(b, p))
    expected = [(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, p) != p else "response",
                 last[b] if last.get(b, p) != p else None) for p, b in rows]
    same(columns(QUERIES["op4_warc_dictionary"](spark, SF),
                 "page_id payload_bytes payload_digest record_type refers_to"), expected)


def test_op5(spark, docs):
    out = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert set(out) == {d for d, _ in pairs(docs)}
    for d, r in out.items():
        assert r["held_out"] == (brute.fold(d, 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op6(spark, docs):
    same(columns(QUERIES["op6_jaccard_join"](spark, SF), "doc_id class_id copy_id n_links"),
         brute.classes(pairs(docs)))


def test_op7(spark, docs):
    same(columns(QUERIES["op7_personal_data"](spark, SF), "doc_id n_email n_ip n_card n_phone base_sha256"),
         brute.personal(pairs(docs)))


def test_op8(spark, docs):
    library, expected = tokenizer("word_bpe_49k.json"), []
    for d, t in pairs(docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((d, len((t or "").encode()), n, n > 2048))
    same(columns(QUERIES["op8_token_counts"](spark, SF), "doc_id n_bytes n_tokens over_limit"), expected)


def packed(rows, pieces, size=1024):
    """Every id of every document lies in one piece, and sequences have no gap and no bad length."""
    library, sequences, found = tokenizer("byte_bpe_50k.json"), {}, {}
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"]
        assert len(own) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        found.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(found) == set(ids)
    for spans in [*found.values(), *sequences.values()]:
        at = 0
        for begin, n in sorted(spans):
            assert begin == at and n > 0
            at += n
    assert all(sum(map(len, [ids[d]])) == sum(n for _, n in s) for d, s in found.items())
    for spans in sequences.values():
        n = sum(k for _, k in spans)
        assert n == size or n & (n - 1) == 0 and n < size


def test_op10(spark, docs):
    packed(pairs(docs), QUERIES["op10_packing"](spark, SF).collect())


# The pipeline ---------------------------------------------------------------------------------

def first_of_classes(rows):
    """The rows that the Jaccard stage keeps: of each class its smallest id, and texts without words."""
    kept = {}
    for (d, t), (_, c, _copy, _n) in zip(rows, brute.classes(rows)):
        if brute.words(t):
            kept.setdefault(c, d)
            kept[c] = min(kept[c], d)
    return sorted([d for d, t in rows if not brute.words(t)] + list(kept.values()))


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_jaccard_stage(spark, docs):
    out = pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == pipeline.COLUMNS and ids(out) == first_of_classes(pairs(docs))


def test_decontamination_stage(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(r[0] for r in brute.decontamination(pairs(docs), items) if not r[-1])
    out = pipeline.decontamination(spark, docs, SF)
    assert out.columns == pipeline.COLUMNS and ids(out) == clean and len(clean) < docs.count()


def test_toxicity_stage(spark, docs):
    from tillwise.llm.toxicity import fit, score_texts

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs.select(*pipeline.COLUMNS), labels)
    assert 0 < model.cut <= 0.5
    kept = sorted(r["doc_id"] for r in score_texts(docs, model).collect() if r["toxicity"] < model.cut)
    out = pipeline.toxicity(spark, docs, SF)
    assert out.columns == pipeline.COLUMNS and ids(out) == kept
    # nearly all ordinary texts stay
    ordinary = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(ordinary & set(kept)) > 0.9 * len(ordinary)


@pytest.mark.parametrize("name", ["messy", "empty"])
@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_on_unusual_rows(request, spark, stage, name):
    docs = request.getfixturevalue(name)
    out = pipeline.STAGES[stage][1](spark, docs, SF)
    n = out.count()
    if stage < 4:
        assert out.columns == pipeline.COLUMNS and n <= docs.count()
    assert (n > 0) == (name == "messy")


def test_run(spark, docs):
    """The stages one after the other, from documents to pieces of sequences."""
    left = docs
    for _name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
    rows = pairs(left)
    out = pipeline.run(spark, SF).collect()
    packed(rows, out)
    assert 0 < len(rows) < docs.count()
