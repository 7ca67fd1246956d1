"""The language model of order three beside a plain one."""

import collections
import math

import brute
import numpy as np
import pytest
from conftest import SF, pairs
from pyspark.sql import functions as F


def trigrams(rows, train):
    """(doc_id, tokens, score) by adjusted counts, gram by gram."""
    tokens = lambda t: brute.words((t or "").translate(brute.LOWER)) + [None]
    grams = lambda t: [tuple(w[max(0, i - 2):i + 1]) for w in [["<s>", *tokens(t)]]
                       for i in range(1, len(w))]
    top = collections.Counter(g for _d, t in train for g in grams(t))
    count = {3: {g: c for g, c in top.items() if len(g) == 3}}
    count[2] = {g: c for g, c in top.items() if len(g) == 2}
    count[2].update(collections.Counter(g[1:] for g in count[3]))
    count[1] = collections.Counter(g[1:] for g in count[2])

    def discounts(counts):
        n = collections.Counter(min(c, 5) for c in counts)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return [0, *(min(max(x, 0.01 * (k + 1)), k + 0.99) for k, x in enumerate(raw))]

    less = {k: discounts(count[k].values()) for k in count}
    total, free = collections.Counter(), collections.Counter()
    for k in count:
        for g, c in count[k].items():
            total[g[:-1]] += c
            free[g[:-1]] += less[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        if not total[g[:-1]]:
            return p(g[1:])
        c = count[len(g)].get(g, 0)
        return (c - less[len(g)][min(c, 3)] + free[g[:-1]] * p(g[1:])) / total[g[:-1]]

    return [(d, len(grams(t)), sum(math.log10(p(g)) for g in grams(t))) for d, t in rows]


def same_scores(got, expected):
    key = lambda r: (repr(r[0]), r[1], round(r[2], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and np.isclose(a[2], b[2], rtol=1e-9)


@pytest.mark.parametrize("name", ["docs", "messy", "empty"])
def test_trigrams(request, scratch, name, monkeypatch):
    import tillwise.llm.ngram_lm as L

    monkeypatch.setattr(L, "PART_BYTES", 1 << 16)
    monkeypatch.setattr(L, "SAMPLE", 1.0)
    docs = request.getfixturevalue(name)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 == 0
    model = L.train(docs.where(~held), scratch, order=3)
    rows = pairs(docs)
    expected = trigrams(rows, [(d, t) for d, t in rows if brute.fold(d, 10)])
    same_scores(L.score(docs, model).select("doc_id", "n_tokens", "score").collect(), expected)


def test_query_uses_two_words_of_context(spark, docs):
    from tillwise.llm.queries import QUERIES

    rows = pairs(docs)
    expected = trigrams(rows, [(d, t) for d, t in rows if brute.fold(d, 10)])
    got = QUERIES["op9_language_model"](spark, SF).select("doc_id", "n_tokens", "score").collect()
    same_scores(got, expected)


def test_hashes_that_agree_in_their_first_bits():
    import tillwise.llm.ngram_lm as L

    random = np.random.RandomState(2)
    key = random.randint(0, 1 << 62, 3000).astype(np.uint64) >> np.uint64(40) << np.uint64(40)
    key = np.r_[key, key[::3] + np.uint64(1), key[::5] + np.uint64(2), key[::-2]]
    order, out = L.ascending(key)
    assert np.array_equal(np.sort(order), np.arange(len(key)))
    assert np.array_equal(out, np.sort(key)) and np.array_equal(key[order], out)
    kinds, where, of = L.distinct(key)
    assert np.array_equal(kinds, np.unique(key))
    assert np.array_equal(key[where], kinds) and np.array_equal(kinds[of], key)
    for k in range(3):
        assert [len(x) for x in L.distinct(key[:k])] == [k, k, k]

    kinds = np.unique(L.mix(np.arange(5000, dtype=np.uint64)))
    count = random.randint(1, 600, len(kinds)).astype(np.uint64)
    shuffled = random.permutation(len(kinds))
    packed = L.packed_counts(kinds[shuffled], count[shuffled])
    assert packed == L.packed_counts(kinds, count)
    asked = np.r_[kinds, kinds[::7] ^ np.uint64(1 << 61)][random.permutation(len(kinds) + len(kinds[::7]))]
    found, = L.CountFile(np.frombuffer(packed, np.uint8)).counts_of(asked)
    known = dict(zip(kinds.tolist(), count.tolist()))
    assert found.tolist() == [known.get(k, 0) for k in asked.tolist()]


def test_grams_of_a_part_stand_together():
    import tillwise.llm.ngram_lm as L

    random = np.random.RandomState(3)
    some = random.randint(0, 1 << 62, 40).astype(np.uint64) * np.uint64(4)
    context, token, left = (np.r_[some, mark][random.randint(0, 41, 20_000)]
                            for mark in (L.BEGIN, L.END, L.BEGIN))
    for bits in (0, 1, 5):
        part = L.part_of(context, token, np.sort(some[:3]), bits)
        order = L.gram_order(part, context, token, left, bits)
        assert np.array_equal(np.sort(order), np.arange(len(part)))
        grams = [x[order] for x in (part, context, token, left)]
        for k in (1, 2, 3, 4):
            assert len(L.runs(*grams[:k])) == len(set(zip(*(x.tolist() for x in grams[:k]))))


def test_a_gram_that_comes_twice_in_a_text_slice_is_looked_up_once(scratch, docs, monkeypatch):
    import pyarrow as pa

    import tillwise.llm.ngram_lm as L
    from tillwise.llm.arrays import Words

    model = L.train(docs.where("text is not null").limit(20), scratch, order=3)
    text = docs.where("length(text) > 200").first()["text"]
    asked, counts_of = [], L.CountFile.counts_of
    monkeypatch.setattr(L.CountFile, "counts_of",
                        lambda self, key, columns=1: asked.append(len(key)) or counts_of(self, key, columns))
    scores = []
    for copies in (1, 50):
        asked.clear()
        scores.append(L.Scorer(model)(Words(pa.array([text] * copies), lower=True)))
        scores[-1]["asked"] = sum(asked)
    assert np.array_equal(scores[1]["score"], np.repeat(scores[0]["score"], 50))
    assert scores[1]["asked"] < 25 * scores[0]["asked"]
