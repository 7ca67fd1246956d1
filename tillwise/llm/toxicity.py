"""Toxicity by compression distance: which of two dictionaries shortens a window of words more.

The ordinary Zstandard dictionary is trained on windows of ordinary texts.  The toxic one is trained
on the words of toxic texts that hold byte n-grams far more frequent there than in ordinary texts,
and keeps the ordinary dictionary's content as its tail, so a window compresses differently under
the two only where toxic content helps.  Every window of every text is compressed with both; a
text's counts of windows beyond difference thresholds, its mean and its largest difference enter a
logistic calibration fitted on texts that did not take part in the dictionaries.

Training reads a bounded sample, at most ``per_class`` labelled texts of each class, each of at
most ``longest`` characters, chosen by hash of the id; half of them train the dictionaries and half
calibrate.  Class weights come from counts over all labelled rows.  Scoring reads whole texts.

Null and empty texts have no windows and score like any text without findings.  With no labelled
row of a class the score is the share of toxic labels (0.5 without labels).  Rows are scored one by
one; a repeated label row counts again, and the largest label of an id holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.arrays import _LETTER, NON_SPACE, Words, slices, window_hashes

WINDOW, STEP = 6, 3
GRAMS = range(4, 9)
THRESHOLDS = (1, 2, 3, 4, 6)


@dataclass
class Model:
    """Dictionary contents and the calibration; without ``weights`` every score is ``share``.

    ``cut``: the score from which on a text is to be rejected.
    """

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None
    share: float
    cut: float = 0.5


def prepared(texts: list[str]) -> Words:
    words = Words(pa.array(texts, pa.large_string()), lower=True)
    words.data = np.where(NON_SPACE[words.data], words.data, np.uint8(0x20))
    return words


def byte_grams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start byte and hash of each n-gram with white space at its ends at most."""
    spaces = np.r_[0, np.cumsum(words.data == 0x20)]
    row = np.repeat(np.arange(words.rows), np.diff(words.offsets))
    for k in GRAMS:
        n = len(words.data) - k + 1
        if n > 0:
            at = np.flatnonzero((row[:n] == row[k - 1:])
                                & (spaces[k - 1:k - 1 + n] == spaces[1:n + 1]))
            yield at, window_hashes(_LETTER[words.data], at, k)


def added(total: tuple[np.ndarray, np.ndarray], seen: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts of values so far, with those of some more values."""
    if not seen:
        return total
    h, c = np.unique(np.concatenate(seen), return_counts=True)
    h, c = np.concatenate([total[0], h]), np.concatenate([total[1], c])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else h.astype(np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts and the number of texts with each."""
    total, seen = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
    for first in range(0, len(texts), 200):
        words = prepared(texts[first:first + 200])
        row = np.repeat(np.arange(words.rows), np.diff(words.offsets)).astype(np.uint64)
        for at, h in byte_grams(words):
            order = np.lexsort((row[at], h))
            h, r = h[order], row[at][order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
            seen.append(h[new])
        if len(seen) > 20:
            total, seen = added(total, seen), []
    return added(total, seen)


def marked_words(toxic: list[str], ordinary: list[str], least_z: float = 5.0,
                 least_ratio: float = 4.0) -> dict[bytes, int]:
    """Words of toxic texts with an n-gram that marks the class, and the texts that hold each."""
    (h1, c1), (h0, c0) = gram_counts(toxic), gram_counts(ordinary)
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))
    at = np.minimum(np.searchsorted(h0, h1), max(0, len(h0) - 1))
    b = np.where(h0[at] == h1, c0[at], 0) if len(h0) else np.zeros(len(h1))
    share = (c1 + b) / (n1 + n0)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    marks = h1[((c1 / n1 - b / n0) / spread > least_z) & (c1 / n1 > least_ratio * b / n0)]
    found: dict[bytes, int] = {}
    for text in toxic:
        words, own = prepared([text]), set()
        for at, h in byte_grams(words):
            hit = at[np.isin(h, marks)]
            # an n-gram may begin with the space before its word
            own.update(np.searchsorted(words.end, hit + 1, side="right").tolist())
        data = words.data.tobytes()
        for w in {data[words.start[i]:words.end[i]] for i in own if i < len(words)}:
            found[w] = found.get(w, 0) + 1
    return found


def trained_content(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; all of them if they are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def compressors(model: Model):
    import zstandard

    out = []
    for content in (model.toxic + model.ordinary, model.ordinary):
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=16, search_log=6, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
            write_dict_id=False)
        data = zstandard.ZstdCompressionDict(content or b" " * 8,
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings))
    return out


def window_differences(words: Words, pair) -> tuple[np.ndarray, np.ndarray]:
    """Row of each window, and by how many bytes the toxic dictionary shortens it more."""
    import zstandard

    within = np.arange(len(words)) - words.first[words.row]
    first = np.flatnonzero((within % STEP == 0) & ((within == 0) | (
        words.first[words.row + 1] - words.first[words.row] - within > WINDOW - STEP)))
    if not len(first):
        return first, first
    last = np.minimum(first + WINDOW, words.first[words.row[first] + 1]) - 1
    spans = np.stack([words.start[first], words.end[last] - words.start[first]], 1).astype(np.uint64)
    held = zstandard.BufferWithSegments(words.data.tobytes(), spans.tobytes())
    sizes = [np.fromiter(map(len, squeeze.multi_compress_to_buffer(held)), np.int64, len(first))
             for squeeze in pair]
    return words.row[first], sizes[1] - sizes[0]


def features(words: Words, pair) -> np.ndarray:
    """One row of features for each text of the slice."""
    row, gain = window_differences(words, pair)
    n = np.bincount(row, minlength=words.rows)
    out = np.zeros((words.rows, 4 + 2 * len(THRESHOLDS)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.bincount(row, gain, words.rows) / np.maximum(n, 1)
    top = np.full(words.rows, -8)
    np.maximum.at(top, row, gain)
    out[:, 2] = np.where(n, top, 0)
    out[:, 3] = np.bincount(row, np.maximum(gain, 0) ** 2, words.rows) / np.maximum(n, 1)
    for k, t in enumerate(THRESHOLDS):
        beyond = np.bincount(row[gain >= t], minlength=words.rows)
        out[:, 4 + 2 * k] = beyond / np.maximum(n, 1)
        out[:, 5 + 2 * k] = np.log1p(beyond)
    return out


def text_features(texts: list[str], pair) -> np.ndarray:
    return np.concatenate([features(prepared(texts[k:k + 200]), pair)
                           for k in range(0, len(texts), 200)])


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, for features with a leading one."""
    mean, std = np.average(x, 0, weight), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    ridge = np.diag([1e-6] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge @ w
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, slope)
    w[1:] /= std
    w[0] -= mean @ w[1:]
    return w


def labelled(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> DataFrame:
    """At most ``per_class`` texts of each class, by hash of the id; the largest label of an id
    holds.  Ids are chosen without the texts, and only the chosen texts are gathered."""
    best = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg((F.max("toxic") == 1).alias("is_toxic")))
    fit_rows = docs.select("doc_id", "text").where(F.length("text").between(1, longest))
    order = F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")
    known = fit_rows.select("doc_id").join(best, "doc_id")
    ids = [known.where(F.col("is_toxic") == kind).orderBy(*order).limit(per_class).distinct()
           for kind in (True, False)]
    chosen = F.broadcast(ids[0].unionAll(ids[1]))  # at most 2 * per_class rows
    texts = fit_rows.join(chosen, "doc_id")
    parts = [texts.where(F.col("is_toxic") == kind).orderBy(*order, F.xxhash64("text"))
             .limit(per_class) for kind in (True, False)]
    return parts[0].unionAll(parts[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, longest: int = 40_000,
        dictionary_bytes: int = 32 << 10, toxic_bytes: int = 16 << 10, most_lost: float = 0.02) -> Model:
    """A model from labelled texts; see the module's text for what it reads.

    Its cut is 0.5, or lower where fewer than ``most_lost`` of the ordinary texts of the calibration half
    would be rejected by that.  The bounded sample is worked on in one task.
    """
    counts = {bool(r["toxic"]): r["n"] for r in labels.join(docs.select("doc_id"), "doc_id")
              .where(F.col("toxic").isNotNull()).groupBy((F.col("toxic") == 1).alias("toxic"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(True, 0) / total if total else 0.5
    rows = labelled(docs, labels, per_class, longest).select(
        "text", "is_toxic", F.xxhash64("doc_id", F.lit(11)).alias("drawn"), "doc_id", F.xxhash64("text").alias("print"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for text, kind, *order in zip(*[c.to_pylist() for c in batch.columns]):
                texts[kind].append((*order, text))
        texts = {kind: [row[-1] for row in sorted(found)] for kind, found in texts.items()}
        if min(map(len, texts.values())) >= 2:
            model = fitted(texts, share, dictionary_bytes, toxic_bytes, most_lost)
            yield pa.RecordBatch.from_pydict({
                "toxic": pa.array([model.toxic], pa.binary()), "ordinary": pa.array([model.ordinary], pa.binary()),
                "weights": [model.weights.tolist()], "cut": [float(model.cut)]})

    found = rows.coalesce(1).mapInArrow(
        run, "toxic binary, ordinary binary, weights array<double>, cut double").first()
    if found is None:
        return Model(b"", b"", None, share)
    return Model(bytes(found["toxic"]), bytes(found["ordinary"]), np.array(found["weights"]), share, found["cut"])


def fitted(texts: dict[bool, list[str]], share: float, dictionary_bytes: int, toxic_bytes: int,
           most_lost: float) -> Model:
    """A model from texts of both classes: every other one trains the dictionaries, the rest calibrates."""
    train, hold = ({kind: t[k::2] for kind, t in texts.items()} for k in (0, 1))
    found = marked_words(train[True], train[False])
    toxic = [b" " + w + b" " for w, n in found.items() for _ in range(min(n, 20))]
    ordinary = []
    for text in train[False]:
        w = prepared([text])
        data = w.data.tobytes()
        ordinary += [data[w.start[i]:w.end[min(i + WINDOW, len(w)) - 1]]
                     for i in range(0, len(w), WINDOW)]
    tail = trained_content(ordinary, dictionary_bytes)
    # words that mark most texts come last, nearest to the window
    words = b"".join(sorted(set(toxic), key=lambda s: (found[s.strip()], s)))[-toxic_bytes:]
    model = Model(words, tail, None, share)
    pair = compressors(model)
    x = np.concatenate([text_features(hold[kind], pair) for kind in (True, False)])
    y = np.r_[np.ones(len(hold[True])), np.zeros(len(hold[False]))]
    weight = np.where(y == 1, share / len(hold[True]), (1 - share) / len(hold[False])) * len(y)
    model.weights = calibrated(x, y, weight)
    model.cut = min(0.5, float(np.quantile(chances(x, model)[y == 0], 1 - most_lost)))
    return model


def chances(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[1:] + model.weights[0], -30, 30)))


def scores(words: Words, model: Model, pair) -> np.ndarray:
    if model.weights is None:
        return np.full(words.rows, model.share)
    return chances(features(words, pair), model)


def score_texts(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text; it takes the place of a column of
    that name."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(shared.value)
        for batch in slices(batches):
            words = Words(batch.column("text"), lower=True)
            words.data = np.where(NON_SPACE[words.data], words.data, np.uint8(0x20))
            found = scores(words, shared.value, pair)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)],
                                             [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
