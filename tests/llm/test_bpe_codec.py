"""Encoding and decoding beside the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF, pairs, same

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)), public_tokenizers.path(name)


def expected(tokenizer, rows):
    out = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("name", ["docs", "messy", "empty"])
def test_codec(request, name, file):
    from pyspark.sql import functions as F
    from tillwise.llm.bpe_codec import decode_ids, encode_texts

    docs = request.getfixturevalue(name)
    tokenizer, path = library(file)
    coded = decode_ids(encode_texts(docs, path), path)
    assert coded.columns == [c for c in docs.columns if c not in ("text", "n_tokens")] + [
        "ids", "n_tokens", "decoded"]
    same(coded.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)),
         expected(tokenizer, pairs(docs)))


def test_query(spark, docs):
    from tillwise.llm.queries import QUERIES

    out = QUERIES["op13_bpe_codec"](spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same(out, expected(library(FILES[0])[0], pairs(docs)))


@pytest.mark.parametrize("file", FILES)
def test_random_strings(file, monkeypatch):
    """Long pre-tokens, special strings, marks, and a store that is often forgotten."""
    import tillwise.llm.bpe_codec as B

    monkeypatch.setattr(B, "MOST_KNOWN", 300)
    tokenizer, path = library(file)
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "ing", " ", "'s", "É", "中", "😀", "<|endoftext|>", "1", "٣", "\n", "́",
                "Σ", "İ", "-", "\xa0", "w" * 70, "ab" * 50, "aaa"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(600)]
    texts += ["x" * 5000, "".join(rng.choices("abcdef", k=3000)), "<|endoftext|>" * 3, ""]
    encode, decode = B.Encoder(path), B.Decoder(path)
    for a in range(0, len(texts), 50):
        ids, count = encode(texts[a:a + 50])
        ends = np.r_[0, np.cumsum(count)]
        for k, text in enumerate(texts[a:a + 50]):
            right = tokenizer.encode(text, add_special_tokens=False).ids
            mine = ids[ends[k]:ends[k + 1]]
            assert mine.tolist() == right
            assert decode(mine) == tokenizer.decode(right, skip_special_tokens=False)


def test_undecodable_ids_and_nulls(spark):
    from tillwise.llm.bpe_codec import decode_ids

    tokenizer, path = library(FILES[1])
    ids = [tokenizer.encode("é", add_special_tokens=False).ids[0]], [10_000, 188, 222], []
    rows = [(k, bytearray(np.array(i, "<u4").tobytes())) for k, i in enumerate(ids)] + [(9, None)]
    out = decode_ids(spark.createDataFrame(rows, "doc_id long, ids binary"), path)
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == {
        **{k: tokenizer.decode(i, skip_special_tokens=False) for k, i in enumerate(ids)}, 9: ""}
