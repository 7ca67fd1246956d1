"""Each operator beside its plain version: on a given table, on messy rows, on an empty table."""

import hashlib
import os

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, pairs, same
from pyspark.sql import functions as F

TABLES = ["docs", "messy", "empty"]


@pytest.fixture(params=TABLES)
def any_docs(request):
    return request.getfixturevalue(request.param)


def test_quality(any_docs):
    from tillwise.llm.quality import judge_hosts

    out = judge_hosts(any_docs)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed"), brute.measures(pairs(any_docs)))
    assert out.where("kept and base_failed").count() == 0


def test_hosts_are_shrunk_and_rejected(spark):
    from tillwise.llm.quality import judge_hosts

    good = " ".join(f"word{k}" for k in range(20))
    rows = [(k, good if k % 10 else "short", "fine") for k in range(60)]
    rows += [(100 + k, "short" if k % 10 else good, "bad") for k in range(60)]
    rows += [(200, "short", "tiny"), (201, good, "tiny")]
    rows += [(300 + 10 * h + k, good if k else "short", f"h{h}") for h in range(6) for k in range(10)]
    out = judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    rate = {r["source"]: r for r in out.select("source", "host_rate", "host_rejected").distinct().collect()}
    assert rate["bad"]["host_rejected"] and not rate["fine"]["host_rejected"]
    assert rate["tiny"]["host_rate"] < 0.5 < rate["bad"]["host_rate"]
    kept = {r["doc_id"] for r in out.where("kept").collect()}
    assert 1 in kept and 100 not in kept and 201 in kept


def test_substrings(any_docs, scratch):
    from tillwise.llm.substrings import remove_repeats

    out = remove_repeats(any_docs, scratch)
    same(out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256)),
         brute.substrings(pairs(any_docs)))


def test_substrings_with_a_full_sketch(docs, scratch):
    """A sketch that is far too small lets everything through and changes nothing."""
    from tillwise.llm.substrings import BLOCK_CELLS, ROWS, remove_repeats

    out = remove_repeats(docs, scratch, most_cells=BLOCK_CELLS * ROWS)
    same(out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256)),
         brute.substrings(pairs(docs)))


def test_sketch_blocks_round_trip():
    from tillwise.llm.substrings import BLOCK_CELLS, packed, unpacked

    rng = np.random.RandomState(1)
    for n in (0, 1, 500, 60_000, 400_000):
        at = np.sort(rng.choice(BLOCK_CELLS, n, replace=False))
        assert (np.flatnonzero(unpacked(packed(at))) == at).all()


def digest(found):
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(ids, 256),
                        F.col("n_hit") > 0)


@pytest.mark.parametrize("bound", [None, 0])
def test_decontamination(spark, any_docs, scratch, monkeypatch, bound):
    import tillwise.llm.decontaminate as D

    if bound is not None:  # the way without a broadcast vocabulary
        monkeypatch.setattr(D, "BROADCAST_TERMS", bound)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame(
        [(900, "one two"), (901, None), (902, ""), (None, "line a"), (900, "one two"),
         (903, "W0 w858 w707 w556 w405 w254 w103 w961 w810 w659 w508 w357")], "item_id long, text string"))
    found = D.find_items(any_docs, items, scratch)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    same(digest(found), brute.decontamination(pairs(any_docs), rows))
    assert found.where("size(array_except(items, near_items)) > 0").count() == 0


def test_proximity(spark, scratch):
    from tillwise.llm.decontaminate import find_items

    docs = spark.createDataFrame([(1, "alpha beta so gamma delta"), (2, "alpha beta gamma delta"),
                                  (3, "alpha one two three beta gamma delta"), (4, "gamma delta"),
                                  (5, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    out = {r["doc_id"]: (r["items"], r["near_items"]) for r in find_items(docs, items, scratch, slop=1).collect()}
    assert out == {1: ([], [7]), 2: ([7], [7]), 3: ([], []), 4: ([], []), 5: ([], [])}


def test_no_items(spark, docs, scratch):
    from tillwise.llm.decontaminate import find_items

    out = find_items(docs, spark.createDataFrame([], "item_id long, text string"), scratch)
    assert out.count() == docs.count() and out.where("n_hit > 0").count() == 0


PAGES = [(1, "u1", "a" * 1500), (2, "u2", "a" * 1500), (3, None, "a" * 1500), (4, "u\r\n4", "b" * 20),
         (5, "u", "b" * 20), (6, "u", None), (7, "u", ""), (None, "u", "a" * 1500), (None, "u", None),
         (8, "u", "é" * 500), (9, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "c" * 999), (11, "u", "c" * 999),
         (12, "u", "<p>\r\n\r\n</p>" * 90_000)]


def warc_expected(rows):
    out = []
    raw = [(p, (h or "").encode()) for p, _u, h in rows]
    for p, b in raw:
        same_ = [q for q, c in raw if c == b and len(b) >= 1000 and q is not None]
        other = bool(same_) and max(same_) != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response",
                    max(same_) if other else None))
    return out


@pytest.mark.parametrize("rows", [PAGES, []])
@pytest.mark.parametrize("bound", [None, -1])
def test_warc(spark, scratch, rows, bound, monkeypatch):
    import tillwise.llm.warc as A

    if bound is not None:
        monkeypatch.setattr(A, "BROADCAST_ROWS", bound)
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "page_id long, url string, html string, b int, newest string")
    folder = f"{scratch.folder}/archives"
    scratch.table(A.write_archives(pages, folder), "manifest")
    if rows:
        out = A.read_archives(spark, folder)
        same(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
             warc_expected(rows))
        assert out.where("not intact").count() == 0


def test_archive_dictionary():
    from tillwise.llm.warc import archive, record, records_of

    html = [f"<html><head><title>Page {k}</title></head><body>{'common text ' * 40}{k}</body></html>" .encode()
            for k in range(300)]
    made = [record(k, "u", h, hashlib.sha1(h).hexdigest(), len(h), None) for k, h in enumerate(html)]
    content = archive(made)
    size = int.from_bytes(content[4:8], "little")
    assert content[:4] == bytes.fromhex("5d2a4d18") and size > 256
    assert [b for _, b in records_of(content)] == html
    import zstandard
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in made)
    assert len(content) - size < plain / 2


def test_toxicity(spark):
    from tillwise.llm.toxicity import fit, score_texts

    rng = np.random.RandomState(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "ll")]
    texts = []
    for k in range(1200):
        w = list(rng.choice(vocabulary, 60))
        if k % 6 == 0:
            for at in rng.choice(60, 6, replace=False):
                w[at] = ["wretched", "vermin", "hateful"][at % 3]
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame([*texts, (5000, None), (5001, ""), (None, "x"), (5000, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(0, 1200, 2)] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    model = fit(docs, labels)
    out = {r["doc_id"]: r["toxicity"] for r in score_texts(docs, model).where("doc_id < 1200").collect()}
    held = [k for k in range(1, 1200, 2)]
    wrong = sum((out[k] >= 0.5) != (k % 6 == 0) for k in held) + sum(
        (out[k] >= 0.5) != (k % 6 == 0) for k in range(0, 1200, 2))
    assert wrong <= 12
    odd = score_texts(docs, model).where("doc_id >= 5000 or doc_id is null").collect()
    assert len(odd) == 4 and all(0 <= r["toxicity"] <= 1 for r in odd)


def test_toxicity_without_labels(spark, messy, empty):
    from tillwise.llm.toxicity import fit, score_texts

    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(messy, none)
    assert {r["toxicity"] for r in score_texts(messy, model).collect()} == {0.5}
    assert score_texts(empty, model).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert fit(messy, one).share == 1.0


def test_jaccard(any_docs, scratch):
    from tillwise.llm.jaccard import jaccard_classes

    out = jaccard_classes(any_docs, scratch).select("doc_id", "class_id", "copy_id", "n_links")
    same(out, brute.classes(pairs(any_docs)))


def near_copies(n, words=150, seed=3):
    rng = np.random.RandomState(seed)
    base = [f"w{x}" for x in rng.randint(0, 10**6, words)]
    out = []
    for _ in range(n):
        w = list(base)
        w[rng.randint(words)] = f"c{rng.randint(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,block,shared", [(64, 1024, False), (4, 16, False), (4, 16, True)])
def test_jaccard_large_buckets(spark, scratch, monkeypatch, small, block, shared):
    """Groups larger than a block, and a passage that splits many unlike texts again."""
    import tillwise.llm.jaccard as J

    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    texts = near_copies(90)
    if shared:
        rng = np.random.RandomState(9)
        passage = " ".join(f"p{k}" for k in range(60))
        texts += [passage + " " + " ".join(f"u{x}" for x in rng.randint(0, 10**7, 40)) for _ in range(200)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.jaccard_classes(docs, scratch).select("doc_id", "class_id", "copy_id", "n_links")
    same(out, brute.classes(rows))


def test_one_of_each(messy, empty, scratch):
    from tillwise.llm.jaccard import one_of_each

    docs = messy.select("doc_id", "text", "lang")
    kept = pairs(one_of_each(docs, scratch))
    rows = pairs(messy)
    expected = {c for d, c, _, _ in brute.classes(rows)}
    worded = [(d, t) for d, t in kept if brute.words(t)]
    assert len(worded) == len({c for (d, t), (_, c, _, _) in zip(rows, brute.classes(rows)) if brute.words(t)})
    assert {d for d, _ in kept} <= expected | {None}
    assert sum(not brute.words(t) for _, t in kept) == sum(not brute.words(t) for _, t in rows)
    assert one_of_each(empty.select("doc_id", "text"), scratch.__class__(messy.sparkSession)).count() == 0


def test_components(spark, scratch):
    from tillwise.llm.components import components

    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 102), (102, 100), (7, 7)]
    out = {r["u"]: r["v"] for r in components(spark.createDataFrame(chain, "u long, v long"), scratch).collect()}
    assert out == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in (101, 102, 103)}}


def test_personal_data(any_docs):
    from tillwise.llm.pii import BASE_KINDS, personal_data, spans_text

    found = personal_data(any_docs)
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    same(found.select("doc_id", *map(count, BASE_KINDS), F.sha2(spans_text(BASE_KINDS), 256)), brute.personal(pairs(any_docs)))


def test_personal_data_added_and_redacted(messy):
    from tillwise.llm.pii import find_spans, personal_data

    text = next(r["text"] for r in messy.where("doc_id = 12").collect())
    kinds = [k for k, *_ in find_spans(text, 0.5)]
    assert kinds.count("iban") == 1 and {"email", "ip", "card", "phone"} <= set(kinds)
    out = personal_data(messy, redact=True)
    clean = next(r["text"] for r in out.where("doc_id = 12").collect())
    assert "<EMAIL>" in clean and "<IBAN>" in clean and "host.example" not in clean
    assert {(r["doc_id"], r["text"]) for r in out.where("doc_id in (4, 5, 7)").collect()} == \
        {(4, None), (5, ""), (7, "one two")}


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join("/opt/tokenizers", name))


def test_token_counts(any_docs):
    from tillwise.llm.token_counts import count_tokens

    out = count_tokens(any_docs.select("doc_id", "text"), "/opt/tokenizers/word_bpe_49k.json")
    library = tokenizer("word_bpe_49k.json")
    same(out, [(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(any_docs)])


POOL = ["'s", "'re", " 'll", "'", "''", "a", "B", "Ω", "Σ", "İ", " ", "  ", "\n", "\t", "1", "23", "½", "!", "...",
        "<|endoftext|>", "<|startoftext|>", "é", "é", " ", " ", "x'd", "I'VE", "aaaa", "<|"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_and_merges(name):
    from tillwise.llm.packing import Encoder
    from tillwise.llm.token_counts import Counter

    rng = np.random.RandomState(2)
    texts = ["".join(rng.choice(POOL, rng.randint(0, 12))) for _ in range(3000)]
    ids = [e.ids for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]
    path = os.path.join("/opt/tokenizers", name)
    assert Counter(path)(texts).tolist() == [len(i) for i in ids]
    assert [r.tolist() for r in Encoder(path)(texts)[0]] == ids


def test_language_model(any_docs, scratch):
    from tillwise.llm.ngram_lm import score, train

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 == 0
    model = train(any_docs.where(~held), scratch)
    rows = pairs(any_docs)
    expected, total = brute.language_model(rows, [(d, t) for d, t in rows if brute.fold(d, 10)])
    assert model.train_tokens == total
    got = score(any_docs, model).select("doc_id", "n_tokens", "n_known", "base_score", "score").collect()
    key = lambda r: (repr(r[0]), r[1], r[2], round(r[3], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9)


def test_language_model_spread_contexts(docs, scratch, monkeypatch):
    """Many parts, and frequent contexts spread over them."""
    import tillwise.llm.ngram_lm as L

    monkeypatch.setattr(L, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(L, "SAMPLE", 1.0)
    model = L.train(docs, scratch)
    assert model.bits > 2 and len(model.hot) > 5
    rows = pairs(docs)
    expected, _ = brute.language_model(rows, rows)
    got = {r["doc_id"]: r["score"] for r in L.score(docs, model).collect()}
    assert all(np.isclose(got[d], s) for d, *_, s in expected)


def check_packing(rows, pieces, size=1024):
    library, ids = tokenizer("byte_bpe_50k.json"), {}
    for d, t in rows:
        full = tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)
        ids.setdefault(d, []).append(full)
    for d in ids:
        own = [p for p in pieces if p["doc_id"] == d]
        assert sum(p["length"] for p in own) == sum(map(len, ids[d]))
        for p in own:
            got = tuple(np.frombuffer(p["ids"], "<u4").tolist())
            assert any(f[p["start"]:p["start"] + p["length"]] == got and len(f) == p["doc_tokens"] for f in ids[d])
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0


def test_packing(any_docs, scratch):
    from tillwise.llm.packing import pack

    pieces = pack(any_docs, "/opt/tokenizers/byte_bpe_50k.json", scratch).collect()
    check_packing(pairs(any_docs), pieces)


def test_hilbert_neighbours():
    """Along the curve, grid points one apart are one step apart in space."""
    import tillwise.llm.packing as P

    side = 8
    old, P.BITS = P.BITS, 3
    try:
        grid = np.stack(np.meshgrid(*[np.arange(side)] * P.DIMENSIONS, indexing="ij"), -1).reshape(-1, P.DIMENSIONS)
        keys = P.grid_keys(grid.T.copy())
    finally:
        P.BITS = old
    assert len(set(keys.tolist())) == len(grid)
    along = grid[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_words_of_slices():
    from tillwise.llm.arrays import Words, slices

    texts = pa.array(["a b", None, "", "c  d\te", " f", "é" * 70_000 + " g", "h"])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = list(slices(iter([batch]), size=10))
    assert sum(p.num_rows for p in parts) == 7
    got = [n for p in parts for n in Words(p.column(0)).count.tolist()]
    assert got == [2, 0, 0, 3, 1, 2, 1]
    whole = Words(texts)
    assert (np.concatenate([Words(p.column(0)).hash for p in parts]) == whole.hash).all()
    assert len(set(whole.hash.tolist())) == 9
