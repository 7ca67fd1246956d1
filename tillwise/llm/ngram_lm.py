"""Interpolated modified Kneser-Ney n-gram model of order two or three: counted in Spark, kept as
sorted hash arrays, memory-mapped by the tasks that score.

Counting.  Runs of tokens of each task are counted as (left, context, token) triples, context being
the word before the token and left the word before that (order three only), and sent in packed arrays
to parts by hash of the context; contexts that a small sample shows to be frequent are spread by token
too, so a part is bounded whatever the words' frequencies.  With every left word of a pair in one part,
its number of kinds is known there.  Parts merge their triples and write sorted arrays of hashes with
counts to the shared folder: pairs, and triples for order three.  What tokens and the contexts of
triples need is written as sorted arrays too; tokens and contexts whose followers are spread are summed
by hash in a second exchange.  Order three is
counted in ``PASSES`` passes over the texts, each for its share of the parts, so that the exchanges do
not lie on the disks at once.  Nothing is pruned.

Scoring.  Tasks map the arrays, look up the distinct tokens and pairs of a slice of texts once and its
triples, and combine

    p(w | t, u) = (c(t, u, w) - D3(c)) / c(t, u) + g3(t, u) * p(w | u),
    p(w | u) = (k(u, w) - D2(k)) / k(u) + g2(u) * q(w),
    q(w) = (k(w) - D1(k)) / K + g1 / (V + 1)

with k the distinct words before a gram and k(u), K their sums, the usual three discounts of each order
from the counts of counts, and g the mass they free; an unseen context leaves the order below, an unseen
token its uniform share.  Pairs that begin a text have no word before them and keep their counts, as do
all pairs in a model of order two, which stops at p(w | u).

Tokens are lower-cased words by 64-bit hash and one end token for each text.  Null and empty texts
have the end token only; with nothing to learn from, every token has probability 1 / (V + 1) = 1.
Repeated rows count again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.arrays import Words, mix, slices
from tillwise.llm.shared_files import mapped, put
from tillwise.llm.staging import Scratch

#: The mark before a text, the end token, and what stands before the mark.
BEGIN, END, NONE = np.uint64(2), np.uint64(1), np.uint64(0)
FLUSH = 2_000_000
PART_BYTES = 16 << 20
PASSES = 4
#: A context with at least this share of a sample of the texts is spread over the parts.
HOT_SHARE, SAMPLE = 0.002, 0.02

GRAMS = ("part long, context binary, followers binary, token binary, lefts binary, left binary, "
         "count binary")
PARTIAL = ("level int, part long, token binary, total binary, n1 binary, n2 binary, n3 binary, "
           "before binary, occurs binary, kinds array<long>")
TOKENS = "tokens long, total long, before array<long>"


@dataclass
class Model:
    """Where the arrays lie, and the numbers that hold for all of them."""

    folder: str
    bits: int
    hot: np.ndarray
    discounts: np.ndarray
    token_discounts: np.ndarray
    triple_discounts: np.ndarray
    train_tokens: int
    vocabulary: int
    contexts: int
    token_mass: float
    order: int


def token_pairs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and row of every token, ends included."""
    n = len(words) + words.rows
    token, context = np.empty(n, np.uint64), np.empty(n, np.uint64)
    end = words.first[1:] + np.arange(words.rows)
    at = np.arange(len(words)) + words.row
    token[at], token[end] = words.hash | np.uint64(4), END  # hashes stay clear of the two marks
    context[1:] = token[:-1]
    context[np.r_[0, end[:-1] + 1][:words.rows]] = BEGIN
    return context, token, np.repeat(np.arange(words.rows), words.count + 1)


def lefts_of(context: np.ndarray) -> np.ndarray:
    """The word before each context word: the last position's context, nothing before the mark."""
    left = np.r_[NONE, context[:-1]][:len(context)]
    return np.where(context == BEGIN, NONE, left)


def is_hot(context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(context), bool)
    return hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context


def part_of(context: np.ndarray, token: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(context), np.int64)
    by = mix(context)
    if len(hot):
        by = np.where(is_hot(context, hot), mix(context * np.uint64(3) + token), by)
    return (by >> np.uint64(64 - bits)).astype(np.int64)


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(context) * np.uint64(0xD6E8FEB86659FD93) + token)


def token_keys(token: np.ndarray) -> np.ndarray:
    """Spread the two marks too, whose own bits would fall together; other bits than a part's."""
    return mix(token + np.uint64(1))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, for sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, new])


def order_of(key: np.ndarray) -> np.ndarray:
    """Order by the first bits of hashes, equal ones as they stand: a sort of values that carry their place
    in the last bits takes a fifth of the time of ``argsort``."""
    spare = np.uint64(max(len(key) - 1, 1).bit_length())
    placed = key >> spare << spare | np.arange(len(key), dtype=np.uint64)
    placed.sort()
    return (placed & ((np.uint64(1) << spare) - np.uint64(1))).astype(np.int64)


def ascending(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending order of spread hashes, and the hashes in it."""
    order = order_of(key)
    out = key[order]
    if (out[1:] < out[:-1]).any():  # a few that differ in the last bits only
        again = np.argsort(out, kind="stable")
        order, out = order[again], out[again]
    return order, out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, where each stands, and the place of every hash among them."""
    order, out = ascending(key)
    first = runs(out)
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    return out[first], order[first], of


def order_by(part: np.ndarray) -> np.ndarray:
    """Ascending order by part, equal ones as they stand; small numbers take less time."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def gram_order(part: np.ndarray, context: np.ndarray, token: np.ndarray, left: np.ndarray,
               bits: int) -> np.ndarray:
    """Order that brings parts together, in them equal contexts, tokens and left words.  Runs of words that
    agree in their first bits may be broken up; they are merged with their part."""
    order = order_of(token >> np.uint64(44) << np.uint64(44) | left >> np.uint64(20))
    by = context >> np.uint64(bits)
    if bits:
        by |= part.astype(np.uint64) << np.uint64(64 - bits)
    return order[order_of(by[order])]


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def hot_contexts(docs: DataFrame) -> np.ndarray:
    """Frequent tokens of a sample; they only decide where pairs are counted, not what counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            token = token_pairs(Words(batch.column("text"), lower=True))[0]
            kind, n = np.unique(token, return_counts=True)
            often = n >= len(token) * HOT_SHARE
            yield pa.RecordBatch.from_pydict({"token": kind[often].view(np.int64),
                                              "n": n[often], "share": n[often] / len(token)})

    top = docs.sample(SAMPLE, seed=5).mapInArrow(run, "token long, n long, share double") \
        .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(500)
    return np.sort(np.array([r["token"] for r in top.collect()], np.int64).view(np.uint64))


def counted_grams(docs: DataFrame, hot: np.ndarray, bits: int, order: int, turn: int,
                  turns: int) -> DataFrame:
    """Packed counts of runs of tokens, one row for each part whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            part, context, token, left = (np.concatenate(x) for x in zip(*held))
            at = gram_order(part, context, token, left, bits)
            part, context, token, left = part[at], context[at], token[at], left[at]
            first = runs(part, context, token, left)
            count = np.diff(np.r_[first, len(token)]).astype(np.uint32)
            part, context, token, left = part[first], context[first], token[first], left[first]
            cut = runs(part)
            rows = []
            for i, j in zip(cut, np.r_[cut[1:], len(part)]):
                pair = runs(context[i:j], token[i:j])
                begin = runs(context[i:j][pair])
                lefts = np.diff(np.r_[pair, j - i]).astype(np.uint32).tobytes() if order > 2 else b""
                rows.append((int(part[i]), context[i:j][pair][begin].tobytes(),
                             np.diff(np.r_[begin, len(pair)]).astype(np.uint32).tobytes(),
                             token[i:j][pair].tobytes(), lefts,
                             left[i:j].tobytes() if order > 2 else b"", count[i:j].tobytes()))
            kinds = [pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["part", "context", "followers", "token", "lefts", "left", "count"])

        for batch in slices(batches):
            context, token, _row = token_pairs(Words(batch.column("text"), lower=True))
            left = lefts_of(context) if order > 2 else np.zeros(len(context), np.uint64)
            grams = part_of(context, token, hot, bits), context, token, left
            if turns > 1:
                mine = grams[0] % turns == turn
                grams = tuple(g[mine] for g in grams)
            held.append(grams)
            size += len(grams[0])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, GRAMS)


def stacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in column.to_pylist()])


def bucket_bits(n: int) -> int:
    return max(1, (max(n, 1) // 8).bit_length())


def packed_counts(key: np.ndarray, *counts: np.ndarray) -> bytes:
    """Hashes, sorted here if they are not: bucket ends by their top bits, then the next 32 bits, then
    counts."""
    if (key[1:] < key[:-1]).any():
        at, key = ascending(key)
        counts = [count[at] for count in counts]
    bits = bucket_bits(len(key))
    ends = np.searchsorted(key >> np.uint64(64 - bits), np.arange(1 << bits), side="right")
    low = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    large, small = [], []
    for count in counts:
        small.append(np.minimum(count, 255).astype(np.uint8))
        over = np.flatnonzero(count >= 255)
        large += [over.astype(np.uint64), count[over].astype(np.uint64)]
    head = np.array([len(key), bits, len(counts), *[len(x) for x in large[::2]]], np.uint64)
    return b"".join(x.tobytes() for x in (head, *large, ends.astype(np.uint32), low, *small))


class CountFile:
    """Lookups in a mapped array of hashes with counts."""

    def __init__(self, raw: np.ndarray):
        self.n, raw = 0, raw.view(np.ndarray)  # indexing a ``memmap`` costs more
        if not len(raw):
            return
        self.n, self.bits, columns = (int(x) for x in raw[:24].view(np.uint64))
        at = 24

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            part, at = raw[at:at + size].view(kind), at + size
            return part

        self.large = [(take(int(n), np.uint64), take(int(n), np.uint64)) for n in take(columns, np.uint64)]
        self.ends = take(1 << self.bits, np.uint32)
        self.low = take(self.n, np.uint32)
        self.small = [take(self.n, np.uint8) for _ in range(columns)]

    def counts_of(self, key: np.ndarray, columns: int = 1) -> list[np.ndarray]:
        """Counts of hashes, 0 where there is none."""
        if not self.n:
            return [np.zeros(len(key))] * columns
        bucket = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        want = (key << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32)
        last = self.ends[bucket].astype(np.int64)
        low = np.where(bucket > 0, self.ends[np.maximum(bucket - 1, 0)], 0).astype(np.int64)
        step = 1 << int((last - low).max(initial=0)).bit_length() >> 1
        while step:
            probe = low + (step - 1)
            low += ((probe < last) & (self.low.take(probe, mode="clip") < want)) * np.int64(step)
            step >>= 1
        at = np.minimum(low, self.n - 1)
        found = (low < last) & (self.low[at] == want)
        return [self._column(k, at, found) for k in range(columns)]

    def _column(self, k: int, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        out = np.where(found, self.small[k][at], 0).astype(np.float64)
        big = np.flatnonzero(out == 255)
        if len(big):
            place, counts = self.large[k]
            out[big] = counts[np.searchsorted(place, at[big].astype(np.uint64))]
        return out


def kinds_of(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)] + [len(count)]


def follower_sums(count: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each context: the sum of its counts, and how many are one, two, and more."""
    return [summed(x.astype(np.uint64), first) for x in (count, count == 1, count == 2, count >= 3)]


def context_sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order, key = ascending(key)
    first = runs(key)
    return key[first], follower_sums(count[order], first)


def merge_grams(table: pa.Table, folder: str, bits: int, hot: np.ndarray, order: int) -> pa.Table:
    """Write one part's grams; return what it knows about contexts and tokens, by their parts."""
    part = table.column("part")[0].as_py()
    context = np.repeat(stacked(table.column("context"), np.uint64),
                        stacked(table.column("followers"), np.uint32))
    token, count = stacked(table.column("token"), np.uint64), stacked(table.column("count"), np.uint32)
    rows = []
    if order > 2:
        lefts, left = stacked(table.column("lefts"), np.uint32), stacked(table.column("left"), np.uint64)
        context, token = np.repeat(context, lefts), np.repeat(token, lefts)
        at, key = ascending(pair_keys(pair_keys(left, context), token))
        context, token, left, count = context[at], token[at], left[at], count[at]
        first = runs(key, context, token, left)
        count = summed(count.astype(np.uint64), first)
        key, context, token, left = key[first], context[first], token[first], left[first]
        real = left != NONE
        above, kinds = pair_keys(left[real], context[real]), kinds_of(count[real])
        put(folder, f"triples-{part}.bin", packed_counts(key[real], count[real]))
        spread = is_hot(context[real], hot)
        key, sums = context_sums(above[~spread], count[real][~spread])  # all their followers are here
        once = sums[0] == 1  # most of them, and nothing else to tell
        put(folder, f"once-{part}.bin", packed_counts(key[once], sums[0][once]))
        put(folder, f"contexts-{part}.bin", packed_counts(key[~once], *[x[~once] for x in sums]))
        rows += packed_sums(2, *context_sums(above[spread], count[real][spread]), bits)
    else:
        kinds = [0] * 5
    at, key = ascending(pair_keys(context, token))
    context, token, count = context[at], token[at], count[at].astype(np.uint64)
    first = runs(key, context, token)
    lefts = np.diff(np.r_[first, len(key)]).astype(np.uint64)
    key, context, token, count = key[first], context[first], token[first], summed(count, first)
    occurs = count
    if order > 2:
        # all that stands before a pair is here; before the mark there is nothing to tell apart
        count = np.where(context == BEGIN, occurs, lefts)
    put(folder, f"pairs-{part}.bin", packed_counts(key, count))
    kinds = kinds_of(count) + kinds
    at, _ = ascending(token_keys(context))
    context, count = context[at], count[at]
    begin = runs(context)
    at, _ = ascending(token_keys(token))
    token, occurs = token[at], occurs[at]
    first = runs(token)
    every = np.union1d(context[begin], token[first])
    columns = [np.zeros(len(every), np.uint64) for _ in range(6)]
    at = np.searchsorted(every, context[begin])
    for column, values in zip(columns, follower_sums(count, begin)):
        column[at] = values
    at = np.searchsorted(every, token[first])
    columns[4][at] = np.diff(np.r_[first, len(token)])
    columns[5][at] = summed(occurs, first)
    rows += packed_sums(1, every, columns, bits)
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 7, pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*[
        (*row, kinds if n == 0 else [0] * 10) for n, row in enumerate(rows)]), types)],
        names=["level", "part", "token", "total", "n1", "n2", "n3", "before", "occurs", "kinds"])


def packed_sums(level: int, key: np.ndarray, columns: list[np.ndarray], bits: int) -> list[tuple]:
    """Rows of ``PARTIAL`` but for the kinds, one for each part that the keys belong to."""
    to = part_of(key, key, key[:0], bits)
    order = np.argsort(to, kind="stable")
    cut = runs(to[order])
    pack = lambda k, c: c.astype(np.uint64 if k in (0, 5) else np.uint32).tobytes()
    return [(level, int(to[order[i]]), key[order[i:j]].tobytes(),
             *[pack(k, c[order[i:j]]) for k, c in enumerate(columns)], *[b""] * (6 - len(columns)))
            for i, j in zip(cut, np.r_[cut[1:], len(key)])]


def merge_sums(table: pa.Table, folder: str) -> pa.Table:
    """Write one part's tokens, or its contexts of triples that were spread: hash, sum over followers,
    followers of each count; of tokens also distinct contexts and count."""
    level, part = (table.column(c)[0].as_py() for c in ("level", "part"))
    token = stacked(table.column("token"), np.uint64)
    order, key = ascending(token_keys(token) if level == 1 else token)
    first = runs(key)
    key, token = key[first], token[order][first]
    columns = [summed(stacked(table.column(c), np.uint64 if c in ("total", "occurs") else np.uint32)[order]
                      .astype(np.uint64), first)
               for c in ("total", "n1", "n2", "n3", "before", "occurs")[:6 if level == 1 else 4]]
    name = "tokens" if level == 1 else "spread"
    put(folder, f"{name}-{part}.bin", packed_counts(key, *columns))
    known, total, kinds = 0, 0, [0] * 5
    if level == 1:
        before, occurs = columns[4:]
        known, total = int(((token != BEGIN) & (before > 0)).sum()), int(occurs.sum())
        kinds = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int(before.sum())]
    return pa.table({"tokens": [known], "total": [total], "before": pa.array([kinds], pa.list_(pa.int64()))})


def discounts_of(kinds: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of things counted once to four times."""
    n1, n2, n3, n4 = kinds[:4]
    if not (n1 and n2 and n3):
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(raw, [0.01, 0.02, 0.03], [0.99, 1.99, 2.99])


def train(docs: DataFrame, scratch: Scratch, order: int = 2) -> Model:
    """Count ``docs`` (text) and write the model's arrays to the scratch folder."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: only 2 and 3 can be counted")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, (int(size) * (order - 1) // PART_BYTES).bit_length())
    hot, folder = hot_contexts(docs.select("text")), f"{scratch.folder}/model"
    turns = min(PASSES, 1 << bits) if order > 2 else 1
    partial = None
    for turn in range(turns):
        some = scratch.table(
            counted_grams(docs, hot, bits, order, turn, turns).groupBy("part").applyInArrow(
                lambda t: merge_grams(t, folder, bits, hot, order), PARTIAL), f"partial-{turn}",
            compression="zstd")
        partial = some if partial is None else partial.unionByName(some)
    sums = list(partial.agg(*[F.coalesce(F.sum(F.col("kinds")[k]), F.lit(0)).alias(f"k{k}")
                              for k in range(10)]).first())
    discounts = discounts_of(sums[:5])
    totals = scratch.table(partial.drop("kinds").groupBy("level", "part").applyInArrow(
        lambda t: merge_sums(t, folder), TOKENS), "totals").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "total")],
            *[F.coalesce(F.sum(F.col("before")[k]), F.lit(0)).alias(f"k{k}") for k in range(5)]).first()
    for turn in range(turns):
        scratch.drop(f"partial-{turn}")
    kinds = [totals[f"k{k}"] for k in range(5)]
    lower = discounts_of(kinds)
    more = totals["tokens"] - kinds[0] - kinds[1]
    freed = lower @ [kinds[0], kinds[1], more] / kinds[4] if kinds[4] else 1.0
    return Model(folder, bits, hot, discounts, lower, discounts_of(sums[5:]), totals["total"],
                 totals["tokens"], kinds[4], float(freed), order)


class Scorer:
    """Token probabilities by the mapped arrays; files are opened when first asked."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}

    def file(self, kind, name: str):
        if name not in self.files:
            self.files[name] = kind(mapped(self.model.folder, name))
        return self.files[name]

    def by_part(self, part: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cut = runs(part)
        return zip(part[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(part)].tolist())

    def counts(self, name: str, part: np.ndarray, key: np.ndarray, columns: int = 1) -> list[np.ndarray]:
        """Counts of these hashes in the parts' files of that name."""
        order = order_by(part)
        part, key = part[order], key[order]
        out = [np.zeros(len(key)) for _ in range(columns)]
        for p, i, j in self.by_part(part):
            found = self.file(CountFile, f"{name}-{p}.bin").counts_of(key[i:j], columns)
            for column, values in zip(out, found):
                column[order[i:j]] = values
        return out

    def __call__(self, words: Words) -> dict[str, np.ndarray]:
        m = self.model
        context, token, row = token_pairs(words)
        # distinct tokens and the mark, then distinct pairs; a pair is the next token's context of two words
        kinds, where, of = distinct(token_keys(np.r_[token, BEGIN]))
        kind = np.r_[token, BEGIN][where]
        total, *follow, before, occurs = self.counts(
            "tokens", part_of(kind, kind, kind[:0], m.bits), kinds, 6)
        freed = m.discounts @ np.stack(follow) / np.maximum(total, 1)
        c = occurs[of[:-1]]
        base = np.log10((c + 0.1) / (m.train_tokens + 0.1 * (m.vocabulary + 1)))
        share = lambda n, d: np.where(n > 0, n - d[np.clip(n, 1, 3).astype(np.int64) - 1], 0)
        lower = share(before, m.token_discounts) / max(m.contexts, 1) + m.token_mass / (m.vocabulary + 1)
        pairs, where, pair = distinct(pair_keys(context, token))
        second, last = of[where], np.where(context[where] == BEGIN, of[-1], of[where - 1])
        begins, ends = context[where], token[where]
        part = part_of(begins, ends, m.hot, m.bits)
        count, = self.counts("pairs", part, pairs)
        upper = share(count, m.discounts) / np.maximum(total[last], 1)
        p = np.where(total[last] > 0, upper + freed[last] * lower[second], lower[second])[pair]
        if m.order > 2:
            found = [np.zeros(len(pairs)) for _ in range(4)]
            spread, goes_on = is_hot(ends, m.hot), ends != END
            for name, which in (("contexts", np.flatnonzero(~spread & goes_on)),
                                ("spread", np.flatnonzero(spread & goes_on))):
                by = pairs[which] if name == "spread" else ends[which]
                by = part_of(by, by, by[:0], m.bits)
                for column, values in zip(found, self.counts(name, by, pairs[which], 4)):
                    column[which] = values
                if name == "contexts":
                    rest = found[0][which] == 0
                    which = which[rest]
                    once, = self.counts("once", by[rest], pairs[which])
                    for column in found[:2]:
                        column[which] = once
            total, *follow = found
            freed = m.triple_discounts @ np.stack(follow) / np.maximum(total, 1)
            inner = np.flatnonzero(context != BEGIN)
            inner = inner[total[pair[inner - 1]] > 0]
            above = pair[inner - 1]
            triples, = self.counts("triples", part[pair[inner]], pair_keys(pairs[above], token[inner]))
            upper = share(triples, m.triple_discounts) / np.maximum(total[above], 1)
            p[inner] = upper + freed[above] * p[inner]
        sums = lambda x: np.bincount(row, x, words.rows)
        return {"n_tokens": words.count + 1, "n_known": sums(c > 0).astype(np.int64),
                "base_score": sums(base), "score": sums(np.log10(p))}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the text, with tokens, known tokens, the unigram base and the model's score."""
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()),
           ("score", T.DoubleType())]
    kept = [c for c in docs.columns if c not in ("text", *(n for n, _ in new))]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(*f) for f in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            found = scorer(Words(batch.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(found[n]) for n, _ in new]],
                [*kept, *[n for n, _ in new]])

    return docs.select(*kept, "text").mapInArrow(run, schema)
