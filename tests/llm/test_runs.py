"""Periodic runs beside a search of every period."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import SF, pairs, same


def runs(w, least=12):
    """(start, length, period) of all runs: the stretches where words a period apart are equal."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def digest(d, w):
    found = runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


def altered(d, w):
    h, n = zlib.crc32(str(d).encode()), len(w)
    if d is None or h % 10 or not n:
        return w
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_query(spark, docs):
    from tillwise.llm.queries import QUERIES

    out = QUERIES["op12_periodic_runs"](spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    expected = [digest(d, altered(d, brute.words(t))) for d, t in pairs(docs) if len(t or "") < 30_000]
    rows = {r[0]: tuple(r) for r in out.collect()}
    assert len(rows) == docs.count() and len(expected) > 150
    assert sum(e[1] > 0 for e in expected) > 5
    for e in expected:
        assert rows[e[0]] == e


@pytest.mark.parametrize("name", ["messy", "empty"])
def test_unusual_rows(request, name):
    from tillwise.llm.runs import find_runs

    docs = request.getfixturevalue(name)
    out = find_runs(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["n_words", "runs", "collapsed"]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    expected = []
    for d, t in pairs(docs):
        w = brute.words(t)
        # words of the two longest texts do not repeat soon enough to be worth every period
        found = runs(w) if len(w) < 10_000 else [x for x in runs(w[:50]) if x]
        expected.append((d, len(w), found, collapsed(w, found)))
    short = lambda rows: sorted((r for r in rows if r[1] < 10_000), key=repr)
    assert short(got) == short(expected)


def test_long_texts(spark):
    """One word over and over, a period of thousands of words, and a text without repeats."""
    from tillwise.llm.runs import find_runs

    period = [f"w{k}" for k in range(7001)]
    texts = ["x " * 60_000, " ".join(period * 5), " ".join(f"u{k}" for k in range(50_000))]
    out = find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()}
    assert got == {0: ([(0, 60_000, 1)], "x"), 1: ([(0, 35_005, 7001)], " ".join(period)), 2: ([], texts[2])}


def test_random_words():
    """Few words, planted periods, Fibonacci and Thue-Morse words; texts do not mix."""
    from tillwise.llm.runs import runs_of

    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.choice([0, 1, 2, 11, 12, 13, 24, 30, 100, 250]), rng.choice([1, 2, 2, 3, 10, 50])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 6 else 0):
                p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
                for i in range(a, min(n, a + rng.randint(1, 4 * p))):
                    w[i] = w[a + (i - a) % p]
            if rng.random() < 0.2:
                a, b = [0], [0, 1]
                while len(b) < n:
                    a, b = b, b + (a if k > 2 else [1 - x for x in b])
                w = b[:n]
            texts.append(w)
        size = [len(w) for w in texts]
        text = np.repeat(np.arange(len(texts)), size)
        flat = np.array([x for w in texts for x in w], np.int64)
        found = runs_of(np.unique(flat + 1000 * text, return_inverse=True)[1], text, 12)
        at = np.r_[0, np.cumsum(size)]
        for k, w in enumerate(texts):
            mine = [(s - at[k], e - s, q) for t, s, e, q in found.tolist() if t == k]
            assert mine == runs(w)


def test_grammar_derives_the_text():
    """Every nonterminal has the same words wherever it derives, and no pair of symbols is left twice."""
    from tillwise.llm.runs import Grammar

    rng = np.random.RandomState(2)
    word = np.r_[np.tile(rng.randint(0, 40, 60), 6), rng.randint(0, 6, 500)]
    g = Grammar(word, np.zeros(len(word), np.int64))
    assert len(g.low) > 20
    for rule, place in zip(g.owner, g.place):
        size = g.high[rule] - g.low[rule]
        assert (word[place:place + size] == word[g.low[rule]:g.high[rule]]).all()
    left = [tuple(word[a:b]) for a, b in zip(g.start, np.r_[g.start[1:], len(word)])]
    assert sum(map(len, left)) == len(word) and len(left) < 0.6 * len(word)
