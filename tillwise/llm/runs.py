"""Periodic runs of words, found in grammar-compressed texts.

A run is a stretch of words with smallest period q, at least two periods and ``least`` words long,
that no neighbouring word extends.  Every text of a slice is compressed by Re-Pair over its word
ids: each round replaces, in all texts at once, the pairs that occur more often in their text than
every pair they overlap (of equally frequent ones, a random one goes first), until no pair occurs
twice.  A balanced tree over what is left gives the start rule its boundaries.

A run lies across the boundary of exactly one nonterminal or tree node that holds it whole.  So the
runs across each boundary are computed once, inside the words of one derivation, and translated to
every place the nonterminal derives; a place that cuts a run off gives a part of it, and of the
intervals with one period only the maximal ones stay.  A run that reaches a period beyond its
boundary repeats the word there, which gives the candidate periods; how far a period holds on
both sides is found by bisection over 62-bit prefix hashes of the words.

A boundary can only be crossed by a run where pairs of words around it repeat, ``least`` / 2 - 1 of
them in a row, so other boundaries are passed over.

Null and empty texts have no words and no runs.  Texts are worked on one by one, so repeated rows and
ids need no care; columns named like the new ones are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwise.llm.arrays import Words, mix, slices
from tillwise.llm.bpe_codec import ragged

#: Words of nodes that are looked at together.
CHUNK = 1 << 21
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_183_186_591, 921_428_927)


class Grammar:
    """Re-Pair over the texts of a slice.

    ``word``: word ids, different in each text; ``text``: the text of each word.  Nonterminals are
    given by the words of their first derivation: ``low``, ``middle``, ``high``; ``owner`` and
    ``place`` list where each of them derives.  ``start`` holds the first words of the symbols left
    in texts that hold any nonterminal.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray):
        n = len(word)
        nodes, owners, places, left = [], [], [], []
        symbol, begin, end = word.astype(np.int64), np.arange(n), np.arange(1, n + 1)
        fresh, made = int(word.max(initial=-1)) + 1, 0
        texts = int(text[-1]) + 1 if n else 0
        ruled = np.zeros(texts, bool)
        while len(symbol) > 1:
            chosen, pair = self._round(symbol, text)
            if not len(chosen):
                break
            kinds, first, rule = np.unique(pair, return_index=True, return_inverse=True)
            nodes.append(np.c_[begin[chosen], begin[chosen + 1], end[chosen + 1]][first])
            owners.append(made + rule)
            places.append(begin[chosen])
            made += len(kinds)
            symbol[chosen] = fresh + rule
            fresh += len(kinds)
            end[chosen] = end[chosen + 1]
            going = np.zeros(texts, bool)
            going[text[chosen]] = True
            ruled |= going
            stay = going[text]
            left.append(begin[~stay & ruled[text]])
            stay[chosen + 1] = False
            symbol, begin, end, text = symbol[stay], begin[stay], end[stay], text[stay]
        left.append(begin[ruled[text]])
        join = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
        table = join(nodes).reshape(-1, 3)
        self.low, self.middle, self.high = table.T
        self.owner, self.place = join(owners), join(places)
        self.start = np.sort(join(left))

    @staticmethod
    def _round(symbol: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair is to be replaced, and which pair that is."""
        at = np.flatnonzero(text[:-1] == text[1:])
        key = symbol[at] << 32 | symbol[at + 1]
        # of overlapping occurrences of a pair of equal symbols, every other one counts
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        counted = (np.arange(len(at)) - head) % 2 == 0
        at, key = at[counted], key[counted]
        kinds, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = count.astype(np.uint64) << np.uint64(36) | mix(kinds.astype(np.uint64)) >> np.uint64(28)
        rank[count < 2] = 0
        weight = np.zeros(len(symbol) + 2, np.uint64)
        weight[at + 1] = rank[kind]
        own, before, behind = weight[at + 1], weight[at], weight[at + 2]
        chosen = (own > 0) & (own > before) & (own >= behind)
        at, kind = at[chosen], kind[chosen]
        again = np.bincount(kind, minlength=len(kinds))[kind] > 1
        return at[again], kind[again]

    def tree(self, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """(low, middle, high) of the balanced tree's nodes over the symbols left, of those whose
        middle is a word ``wanted``.  A symbol's number in its text tells the node it splits: the
        largest power of two in the number is half of the node's symbols."""
        owner = text[self.start]
        symbol = np.flatnonzero(wanted[self.start])
        own = owner[symbol]
        head, stop = np.searchsorted(owner, own), np.searchsorted(owner, own, side="right")
        half = (symbol - head) & (head - symbol)
        symbol, own, stop, half = (a[half > 0] for a in (symbol, own, stop, half))
        beyond = symbol + half
        last = np.searchsorted(text, own, side="right")
        high = np.where(beyond < stop, self.start[np.minimum(beyond, len(self.start) - 1)], last) \
            if len(symbol) else last
        return np.c_[self.start[symbol - half], self.start[symbol], high].astype(np.int64)


class Prefixes:
    """Equal stretches of words by two prefix hashes modulo primes."""

    def __init__(self, word: np.ndarray):
        n, self.word = len(word), word
        values = mix(word.astype(np.uint64) + np.uint64(1))
        self.parts = []
        for prime, base in zip(PRIMES, BASES):
            p = np.uint64(prime)
            power = np.ones(n + 1, np.uint64)
            known = 1
            while known <= n:  # powers by doubling
                take = min(known, n + 1 - known)
                power[known:known + take] = power[:take] * np.uint64(pow(base, known, prime)) % p
                known += take
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values % p * power[:n] % p, out=total[1:])
            self.parts.append((p, power, total % p))

    def equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from x and from y (y >= x) are equal."""
        out = np.ones(len(x), bool)
        for p, power, total in self.parts:
            one = (total[x + size] + p - total[x]) % p * power[y - x] % p
            out &= one == (total[y + size] + p - total[y]) % p
        return out

    def _longest(self, most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            held = equal(open_, middle)
            low[open_[held]] = middle[held]
            high[open_[~held]] = middle[~held] - 1
        return low

    def ahead(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from x and y on, ``most`` of them at most."""
        return self._longest(most, lambda k, m: self.equal(x[k], y[k], m))

    def back(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words before x and y."""
        return self._longest(most, lambda k, m: self.equal(x[k] - m, y[k] - m, m))


def repeating(word: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Pairs of neighbouring words, by their first, in a row of ``least`` / 2 - 1 pairs that all
    occur again in their text."""
    n, need = len(word), (least + 1) // 2 - 1
    out = np.zeros(n, bool)
    if n < 2:
        return out
    at = np.flatnonzero(text[:-1] == text[1:])
    _, kind, count = np.unique(word[at].astype(np.int64) << 32 | word[at + 1], return_inverse=True,
                               return_counts=True)
    again = np.zeros(n + 2, np.int8)
    again[at[count[kind] > 1] + 1] = 1
    step = np.diff(again)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    held = end - begin >= need
    out[ragged(begin[held], (end - begin)[held])] = True
    return out


def crossing(nodes: np.ndarray, word: np.ndarray, prefixes: Prefixes, least: int) -> np.ndarray:
    """(node, start, end, period) of the runs inside each node's words that cross its middle."""
    out, size = [np.zeros((0, 4), np.int64)], nodes[:, 2] - nodes[:, 0]
    first = 0
    while first < len(nodes):
        total = np.cumsum(size[first:first + CHUNK])
        last = first + max(1, int(np.searchsorted(total, CHUNK, side="right")))
        out.append(_crossing(nodes[first:last], word, prefixes, least) + [first, 0, 0, 0])
        first = last
    return np.concatenate(out)


def _crossing(nodes: np.ndarray, word: np.ndarray, prefixes: Prefixes, least: int) -> np.ndarray:
    size = nodes[:, 2] - nodes[:, 0]
    node = np.repeat(np.arange(len(nodes)), size)
    at = ragged(nodes[:, 0], size)
    low, middle, high = nodes[node].T
    # a run that reaches a period to the right repeats the word before the middle there; one that
    # reaches a period to the left repeats the word behind it
    right = at >= middle
    x, y = np.where(right, middle - 1, at), np.where(right, at, middle)
    hit = np.flatnonzero((word[x] == word[y]) & (2 * (y - x) <= high - low))
    node, x, y, low, high = node[hit], x[hit], y[hit], low[hit], high[hit]
    end = len(word) - 1
    beside = ((x > low) & (word[x - 1] == word[y - 1])) | \
        ((y + 1 < high) & (word[np.minimum(x + 1, end)] == word[np.minimum(y + 1, end)]))
    node, x, y, low, high = (a[beside] for a in (node, x, y, low, high))
    begin = x - prefixes.back(x, y, x - low)
    stop = y + 1 + prefixes.ahead(x + 1, y + 1, high - y - 1)
    period = y - x
    long = stop - begin >= np.maximum(least, 2 * period)
    found = np.c_[node, begin, stop, period][long]
    # multiples of a run's period span the same words; the smallest is the period
    found = found[np.lexsort(found.T[::-1])]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    return found[fresh]


def runs_of(word: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """(text, start, end, period) of all runs, in this order but by period behind the start; words
    are numbered over all texts."""
    grammar = Grammar(word, text)
    hot = np.r_[False, False, repeating(word, text, least), False]
    warm = hot[:-2] | hot[1:-1] | hot[2:]  # by a middle: one of the pairs around it repeats so
    prefixes = Prefixes(word)
    rules = np.c_[grammar.low, grammar.middle, grammar.high].astype(np.int64).reshape(-1, 3)
    live = np.flatnonzero(warm[rules[:, 1]] & (rules[:, 2] - rules[:, 0] >= least))
    found = crossing(rules[live], word, prefixes, least)
    # to all places that the nonterminals derive
    order = np.argsort(grammar.owner, kind="stable")
    owner, place = grammar.owner[order], grammar.place[order]
    rule = live[found[:, 0]]
    begin = np.searchsorted(owner, rule)
    count = np.searchsorted(owner, rule, side="right") - begin
    shift = place[ragged(begin, count)] - np.repeat(rules[rule, 0], count)
    derived = np.repeat(found[:, 1:], count, axis=0) + np.c_[shift, shift, np.zeros_like(shift)]
    nodes = grammar.tree(text, warm)
    nodes = nodes[nodes[:, 2] - nodes[:, 0] >= least]
    spans = np.r_[derived, crossing(nodes, word, prefixes, least)[:, 1:]].astype(np.int64)
    return maximal(np.c_[text[spans[:, 0]], spans])


def maximal(spans: np.ndarray) -> np.ndarray:
    """Spans (text, start, end, period) that no other of their text and period contains."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((-spans[:, 2], spans[:, 1], spans[:, 3], spans[:, 0]))]
    change = (spans[1:, [0, 3]] != spans[:-1, [0, 3]]).any(1)
    group = np.r_[0, np.cumsum(change)]
    end = spans[:, 2] + group * (spans[:, 2].max() + 1)
    reach = np.maximum.accumulate(end)
    spans = spans[np.r_[True, end[1:] > reach[:-1]]]
    return spans[np.lexsort((spans[:, 3], spans[:, 1], spans[:, 0]))]


def collapsed(words: Words, runs: np.ndarray) -> pa.Array:
    """The texts' words joined by one space, without those behind the first period of a run."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 1] + runs[:, 3], 1)
    np.add.at(depth, runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    row = words.row[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = row[1:] != row[:-1]
    size = words.end[kept] - words.start[kept] + ~last
    data = words.data[np.minimum(ragged(words.start[kept], size), max(len(words.data) - 1, 0))]
    data[(np.cumsum(size) - 1)[~last]] = 0x20
    ends = np.r_[0, np.cumsum(np.bincount(row, size, words.rows))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), words.rows, [
        None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` without the text, with ``n_words``, its ``runs`` (start and length in words, period)
    by start and period, and its ``collapsed`` text: words behind a run's first period are left out."""
    new = ["n_words", "runs", "collapsed"]
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(batch.column(text))
            own = words.hash ^ mix(words.row.astype(np.uint64))  # texts share no word
            word = np.unique(own, return_inverse=True)[1]
            runs = runs_of(word, words.row, least)
            start = runs[:, 1] - words.first[runs[:, 0]]
            ends = np.r_[0, np.cumsum(np.bincount(runs[:, 0], minlength=words.rows))]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])],
                ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(words.count.astype(np.int64)), listed,
                 collapsed(words, runs)], [*kept, *new])

    return docs.select(*kept, text).mapInArrow(run, schema)
