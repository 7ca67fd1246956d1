"""Spark's boosted regression trees, grown by one set of tasks that keep their rows.

``pyspark.ml`` starts some ten jobs for each tree, which takes longer than the work in them.  Here the
rows are cut into bins once and written to the shared folder; then one barrier stage grows all trees.
Its tasks keep their rows, write their sums for each level of a tree to the shared folder, read those of
the others and choose the same splits.  Thresholds, samples of rows and inputs, gains, ties and pruned
leaves follow Spark's, so over one partition the model is the same to the last digit; over several,
sums are added in the order of the partitions, where Spark adds them as they arrive.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.sources import shared_files
from tillwise.sources.staging import Scratch

EPSILON = 2.220446049250313e-16
INVALID = -1.7976931348623157e308      # gain of a split that is not allowed
M64, M32 = (1 << 64) - 1, (1 << 32) - 1
LANES = 4096
#: Inputs that take few values together are summed together, in partitions from so many rows on.
JOINED_FROM, MOST_CODES = 1 << 16, 4096

NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>,
rawCount: bigint, gain: double, leftChild: int, rightChild: int,
split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


# Random numbers as the JVM draws them -----------------------------------------------------------

def _murmur(data: bytes, seed: int) -> int:
    turn = lambda x, k: (x << k | x >> (32 - k)) & M32
    h = seed
    for i in range(0, len(data), 4):
        k = turn(int.from_bytes(data[i:i + 4], "little") * 0xcc9e2d51 & M32, 15) * 0x1b873593 & M32
        h = (turn(h ^ k, 13) * 5 + 0xe6546b64) & M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85ebca6b & M32
    h = (h ^ h >> 13) * 0xc2b2ae35 & M32
    return h ^ h >> 16


def _step(s):
    """The next state of the xorshift generator, of a number or an array of them."""
    keep = M64 if isinstance(s, int) else np.uint64(M64)
    s = s ^ s << 21 & keep
    s = s ^ s >> 35
    return s ^ s << 4 & keep


def _first(seed: int) -> int:
    data = (seed & M64).to_bytes(8, "big")
    low = _murmur(data, 0x3c074a61)
    return _step(_murmur(data, low) << 32 | low)


class _Jumps:
    """Tables that move many states 2^k steps on at once: the step is linear over bits."""

    def __init__(self):
        self.columns, self.tables = [np.array([_step(1 << j) for j in range(64)], np.uint64)], []

    def move(self, states: np.ndarray, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            bits, table = self.columns[-1].reshape(8, 8), np.zeros((8, 256), np.uint64)
            for j in range(8):
                table[:, np.arange(256) >> j & 1 == 1] ^= bits[:, j, None]
            self.tables.append(table)
            self.columns.append(self._apply(self.columns[-1], table))
        return self._apply(states, self.tables[k])

    @staticmethod
    def _apply(states, table):
        parts = states.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        out = table[0][parts[:, 0]]
        for b in range(1, 8):
            out ^= table[b][parts[:, b]]
        return out


_JUMPS = _Jumps()


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first ``n`` doubles of Spark's ``XORShiftRandom`` with that seed, drawn in lanes side by side."""
    k = max(0, (2 * n // LANES).bit_length())
    states, jump = np.array([_first(seed)], np.uint64), k
    while len(states) << k < 2 * n:
        states, jump = np.concatenate([states, _JUMPS.move(states, jump)]), jump + 1
    lanes = np.empty((1 << k, len(states)), np.uint64)
    for i in range(1 << k):
        lanes[i], states = states, _step(states)
    pairs = lanes.T.reshape(-1)[:2 * n].reshape(-1, 2)
    return ((pairs[:, 0] & np.uint64((1 << 26) - 1)) << np.uint64(27) | pairs[:, 1] & np.uint64((1 << 27) - 1)) * 2.0 ** -53


def _longs(seed: int):
    """The longs of ``java.util.Random``."""
    s, signed = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, lambda x: x - (x >> 31 << 32)
    while True:
        two = []
        for _ in range(2):
            s = (s * 0x5DEECE66D + 0xB) & (1 << 48) - 1
            two.append(signed(s >> 16))
        yield (two[0] << 32) + two[1]


def _chosen(inputs: int, n: int, seed: int) -> list[int]:
    """A reservoir sample of ``n`` inputs, in its order."""
    kept = list(range(n))
    for item, u in zip(range(n, inputs), uniforms(seed, inputs - n)):
        at = int(u * (item + 1))
        if at < n:
            kept[at] = item
    return kept


# Bins -------------------------------------------------------------------------------------------

def thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most about ``most`` thresholds of an input from a sample of its values; ``expected``: rows of the sample."""
    values, counts = np.unique(values[values != 0], return_counts=True)
    counts = counts.astype(float)
    if expected - counts.sum() > EPSILON * len(values) * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - counts.sum())
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = expected / (most + 1)
    out, seen, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


@dataclass
class Grower:
    """What is the same in all tasks: how inputs are cut and how trees grow."""

    cuts: list                 # thresholds of each input; None for one of categories
    bins: list[int]
    depth: int
    trees: int
    rate: float
    share: float               # of rows for each tree
    used: int                  # inputs of each node
    seed: int
    least_rows: int
    least_gain: float
    width: int = field(init=False)

    def __post_init__(self):
        self.width = max(max(self.bins), 2)
        self.kinds = np.array([c is None for c in self.cuts])
        self.splits = np.array(self.bins) - 1

    def binned(self, x: np.ndarray) -> np.ndarray:
        kind = np.uint8 if self.width <= 256 else np.uint16
        return np.stack([(v if c is None else np.searchsorted(c, v)).astype(kind) for c, v in zip(self.cuts, x.T)])

    def search(self, sums: np.ndarray, subsets: np.ndarray, own: list, root: bool) -> list[dict]:
        """The best split of each node from its sums (nodes, inputs, bins, 3); ``own``: the node's (n, sum, squares)."""
        nodes = np.arange(len(sums))
        order = np.broadcast_to(np.arange(self.width), sums.shape[:3]).copy()
        for f in np.flatnonzero(self.kinds):
            n, s = sums[:, f, :, 0], sums[:, f, :, 1]
            mean = np.where(n != 0, s / np.where(n != 0, n, 1), -INVALID)
            mean[:, self.bins[f]:] = np.inf
            order[:, f] = np.argsort(mean, axis=1, kind="stable")
            sums[:, f] = np.take_along_axis(sums[:, f], order[:, f, :, None], 1)
        total = np.cumsum(sums, axis=2)[nodes[:, None], subsets]      # (nodes, places of inputs, bins, 3)
        left, right = total[:, :, :-1], total[:, :, -1:] - total[:, :, :-1]
        splits = self.splits[subsets]
        able = splits > 0
        if root:
            at = int(np.argmax(able[0]))
            own = [left[0, at, 0] + right[0, at, 0] if able[0, at] else total[0, 0, -1]]
        own = np.array(own)
        impurity = _variance(own)
        n = left[..., 0] + right[..., 0]
        safe = np.where(n > 0, n, 1)
        gain = impurity[:, None, None] - left[..., 0] / safe * _variance(left) - right[..., 0] / safe * _variance(right)
        bad = (left[..., 0] < self.least_rows) | (right[..., 0] < self.least_rows) | (gain < self.least_gain)
        gain = np.where(np.arange(self.width - 1) < splits[..., None], np.where(bad, INVALID, gain), -np.inf)
        best = gain.reshape(len(sums), -1).argmax(1)
        place, cut = best // (self.width - 1), best % (self.width - 1)
        out = []
        for i in range(len(sums)):
            p, c = int(place[i]), int(cut[i])
            f, g = int(subsets[i, p]), float(gain[i, p, c])
            node = {"own": own[i], "gain": g, "impurity": float(impurity[i]) if g > INVALID else -1.0}
            if g > 0:
                node |= {"input": f, "cut": c, "left": left[i, p, c], "right": right[i, p, c], "goes": order[i, f, :c + 1]}
            out.append(node)
        return out

    def tree(self, m: int, level_sums) -> list[dict]:
        """Nodes of one tree; ``level_sums`` gives the sums of a level's nodes and takes the splits found there."""
        nodes, draw = [{}], _longs(self.seed + m)
        open_nodes = [0]
        for level in range(self.depth + 1):
            if not open_nodes:
                break
            inputs = len(self.bins)
            subsets = np.array([_chosen(inputs, self.used, next(draw)) if self.used < inputs else range(inputs)
                                for _ in open_nodes])
            found = self.search(level_sums(len(open_nodes)), subsets, [nodes[i].get("own") for i in open_nodes], level == 0)
            stack, goes = [], []
            for i, split in zip(open_nodes, found):
                if level == self.depth:
                    split.pop("input", None)
                nodes[i].update(split)
                if "input" not in split:
                    goes.append(None)
                    continue
                ends = []
                for side in ("left", "right"):
                    impurity = float(_variance(split[side]))
                    nodes.append({"own": split[side], "impurity": impurity})
                    nodes[i][f"{side}_child"] = len(nodes) - 1
                    ends.append(level + 1 == self.depth or abs(impurity) < EPSILON)
                    if not ends[-1]:
                        stack.insert(0, len(nodes) - 1)
                goes.append((split, nodes[i]["left_child"], nodes[i]["right_child"]))
            place = {node: k for k, node in enumerate(stack)}
            level_sums(None, [g and (g[0]["input"], g[0]["goes"], place.get(g[1], -1), place.get(g[2], -1)) for g in goes])
            open_nodes = stack
        for node in nodes:
            n, s, _ = node["own"]
            node["value"] = float(s / n) if n else 0.0
        return nodes


def _variance(sums: np.ndarray) -> np.ndarray:
    n, s, squares = sums[..., 0], sums[..., 1], sums[..., 2]
    safe = np.where(n == 0, 1, n)
    return np.where(n == 0, 0.0, (squares - s * s / safe) / safe)


# Tasks ------------------------------------------------------------------------------------------

def joined(bins: np.ndarray, sizes: list[int], most: int) -> tuple[np.ndarray, list[list[int]], list[np.ndarray]]:
    """Inputs in groups that take at most ``most`` values together: the rows' codes of each group, the inputs
    of each group, and the bin of each input for each code of its group."""
    codes, groups, bin_of = [], [], [None] * len(bins)
    for f, size in enumerate(sizes):
        for k, group in enumerate(groups):
            now = len(bin_of[group[0]])
            both = codes[k] * size + bins[f]
            seen = np.bincount(both, minlength=now * size) > 0
            if (n := int(seen.sum())) <= most:
                codes[k] = (np.cumsum(seen) - 1)[both]
                of = np.flatnonzero(seen)
                for g in group:
                    bin_of[g] = bin_of[g][of // size]
                bin_of[f] = of % size
                group.append(f)
                break
        else:
            codes.append(bins[f].astype(np.intp))
            groups.append([f])
            bin_of[f] = np.arange(size)
    return np.array(codes, np.int32), groups, bin_of


class Part:
    """The rows of one partition."""

    def __init__(self, grower: Grower, number: int, folder: str):
        self.g, self.number = grower, number
        self.label = shared_files.mapped(folder, f"label-{number}").view(np.float64)
        self.load(shared_files.mapped(folder, f"bins-{number}").view(
            np.uint8 if grower.width <= 256 else np.uint16).reshape(len(grower.bins), -1))

    def load(self, bins: np.ndarray) -> None:
        self.value, sizes = np.zeros(len(self.label)), self.g.bins
        if len(self.label) >= JOINED_FROM:
            self.codes, self.groups, self.bin_of = joined(bins, sizes, MOST_CODES)
        else:
            self.codes, self.groups, self.bin_of = bins, [[f] for f in range(len(bins))], [*map(np.arange, sizes)]
        self.group_of = np.zeros(len(bins), np.intp)
        for k, group in enumerate(self.groups):
            self.group_of[group] = k
        # of each input: its codes in the order of their bins, where each bin begins, and the bins
        self.by_bin = []
        for of in self.bin_of:
            order = np.argsort(of, kind="stable")
            bins, starts = np.unique(of[order], return_index=True)
            self.by_bin.append((order, starts, bins))
        self.most = max(map(len, self.bin_of))

    def begin(self, m: int) -> None:
        """Draw the rows of tree ``m``."""
        rows = np.flatnonzero(uniforms(self.g.seed + m + self.number + 1, len(self.label)) < self.g.share) \
            if self.g.share < 1 else np.arange(len(self.label))
        self.mine = np.take(self.codes, rows, axis=1)
        self.y = self.label[rows] if m == 0 else 2.0 * (self.label[rows] - self.value[rows])
        self.squares, self.slot = self.y * self.y, np.zeros(len(rows), np.intp)

    def sums(self, nodes: int) -> np.ndarray:
        """(nodes, inputs, bins, 3): rows, and the sums of their labels and squares."""
        out = np.zeros((3, nodes, len(self.group_of), self.g.width))
        for group, codes in zip(self.groups, self.mine):
            n = len(self.bin_of[group[0]])
            key = self.slot * n + codes
            found = np.stack([np.bincount(key, weights, nodes * n) for weights in (None, self.y, self.squares)])
            found = found.reshape(3, nodes, n)
            for f in group:
                order, starts, bins = self.by_bin[f]
                out[:, :, f, bins] = np.add.reduceat(found[:, :, order], starts, 2) if len(group) > 1 else found
        return np.ascontiguousarray(np.moveaxis(out, 0, -1))

    def _moves(self, inputs: list, goes: list, other: list) -> tuple[np.ndarray, np.ndarray]:
        """For each node the group of its input, and where each code of that group goes."""
        table = np.empty((len(inputs), self.most), np.intp)
        for i, (f, left, to) in enumerate(zip(inputs, goes, other)):
            here = np.full(self.g.width, to[1])
            here[left] = to[0]
            bins = self.bin_of[f]
            table[i, :len(bins)] = here[bins]
        return self.group_of[inputs], table

    def split(self, goes: list) -> None:
        """Move the drawn rows to their nodes of the next level; those in leaves are done."""
        groups, table = self._moves([g[0] if g else 0 for g in goes], [g[1] if g else [] for g in goes],
                                    [g[2:] if g else (-1, -1) for g in goes])
        nxt = table[self.slot, self.mine[groups[self.slot], np.arange(len(self.slot))]]
        keep = nxt >= 0
        if not keep.all():
            rows = np.flatnonzero(keep)
            self.mine, self.y, self.squares, nxt = (
                np.take(self.mine, rows, axis=1), self.y[rows], self.squares[rows], nxt[rows])
        self.slot = nxt

    def add(self, nodes: list[dict], weight: float) -> None:
        """Add the tree's value to every row."""
        groups, table = self._moves([n.get("input", 0) for n in nodes], [n.get("goes", []) for n in nodes],
                                    [(n.get("left_child", i), n.get("right_child", i)) for i, n in enumerate(nodes)])
        self.value += np.array([n["value"] for n in nodes])[_leaves(groups, table, self.codes, self.g.depth)] * weight


def _leaves(groups: np.ndarray, table: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row: ``groups`` names the row of ``codes`` that a node looks at, ``table`` where it leads."""
    width, n = table.shape[1], codes.shape[1]
    codes, table, every = codes.reshape(-1), table.reshape(-1), np.arange(n)
    starts, at = groups * n, np.zeros(n, np.intp)
    for _ in range(depth):
        at = table.take(at * width + codes.take(starts.take(at) + every))
    return at


def _exchange(sums: np.ndarray, folder: str, name: str, old: str | None, task: int, tasks: int) -> np.ndarray:
    """The sums of all tasks, added in the order of the tasks.

    When all have written theirs, all have read those of ``old``.
    """
    if tasks == 1:
        return sums
    shared_files.put(folder, f"{name}-{task}", sums.tobytes())
    total = None
    for other in range(tasks):
        while not len(got := shared_files.mapped(folder, f"{name}-{other}")):
            time.sleep(0.0005)
        got = got.view(np.float64).reshape(sums.shape)
        total = got.copy() if total is None else np.add(total, got, out=total)
    if old:
        shared_files.drop(folder, f"{old}-{task}")
    return total


def _grow(grower: Grower, folder: str, numbers: list[int]):
    """The body of a barrier task: all trees, from the rows of its partitions."""
    def run(_rows):
        context = BarrierTaskContext.get()
        task, tasks = context.partitionId(), len(context.getTaskInfos())
        parts = [Part(grower, n, folder) for n in numbers[task::tasks]]
        # another folder where the stage runs again
        sums_at, old, trees = f"{folder}/sums-{min(context.allGather(str(context.taskAttemptId())))}", None, []
        for m in range(grower.trees):
            for part in parts:
                part.begin(m)
            level = 0

            def level_sums(nodes, goes=None, m=m):
                nonlocal level, old
                if goes is not None:
                    for part in parts:
                        part.split(goes)
                    return None
                total = parts[0].sums(nodes)
                for part in parts[1:]:
                    total += part.sums(nodes)
                name, level = f"{m}-{level}", level + 1
                total = _exchange(total, sums_at, name, old, task, tasks)
                old = name
                return total

            nodes = grower.tree(m, level_sums)
            for part in parts:
                part.add(nodes, grower.rate if m else 1.0)
            if task == 0:
                trees.append(nodes)
        return [(0, trees)] if task == 0 else []
    return run


# The estimator ----------------------------------------------------------------------------------

class BoostedRegressionModel(GBTRegressionModel):
    """Spark's model, which predicts a batch of rows tree by tree instead of a row at a time."""

    grower: Grower
    forest: list       # of each tree: the input of each node, where each bin leads, the values

    def _transform(self, dataset: DataFrame) -> DataFrame:
        grower, forest = self.grower, self.forest

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            value = np.zeros(len(x))
            if len(x):
                bins = grower.binned(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
                for m, (inputs, table, values) in enumerate(forest):
                    leaves = _leaves(inputs.astype(np.intp), table.astype(np.intp), bins, grower.depth)
                    value += values[leaves] * (grower.rate if m else 1.0)
            return pa.array(value)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))


def _flat(nodes: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.min_scalar_type(len(nodes))
    inputs = np.array([n.get("input", 0) for n in nodes], np.min_scalar_type(max(n.get("input", 0) for n in nodes)))
    table = np.repeat(np.arange(len(nodes), dtype=kind)[:, None], width, 1)
    for i, n in enumerate(nodes):
        if "input" in n:
            table[i] = n["right_child"]
            table[i, n["goes"]] = n["left_child"]
    return inputs, table, np.array([n["value"] for n in nodes])


class BoostedRegressor(GBTRegressor):
    """``GBTRegressor`` whose trees grow in one stage; the model holds Spark's and is saved as such.

    Weights, validation rows, other losses, and sessions whose number of executors changes, are left to Spark.
    """

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        spark, context = dataset.sparkSession, dataset.sparkSession.sparkContext
        core = context._jsc.sc()
        slots = core.maxNumConcurrentTasks(core.resourceProfileManager().defaultResourceProfile())
        attrs = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        kinds = {a["idx"]: len(a.get("vals", ())) or a.get("num_vals", 0) for a in attrs.get("nominal", ())}
        kinds |= {a["idx"]: 2 for a in attrs.get("binary", ())}
        if (slots < 1 or min(kinds.values(), default=2) < 2 or self.isDefined("weightCol")
                or self.isDefined("validationIndicatorCol") or self.getLossType() != "squared"
                or self.getMinWeightFractionPerNode() or not self.getMaxIter()
                or (context.getConf().get("spark.dynamicAllocation.enabled") or "false") == "true"):
            return super()._fit(dataset)
        y = F.col(self.getLabelCol()).cast("double")
        refused = lambda why: F.raise_error(F.lit(f"Labels MUST NOT be {why}"))
        table = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"),
            F.when(y.isNull() | F.isnan(y), refused("Null or NaN")).when(
                F.abs(y) == float("inf"), refused("Infinity")).otherwise(y).alias("y"))
        # one RDD for all passes, so a shuffle before them runs once
        rows = table._jdf.toJavaRDD()
        framed = lambda r: DataFrame(spark._jsparkSession.createDataFrame(r, table._jdf.schema()), spark)
        n, most = rows.count(), self.getMaxBins()
        if not n or max(kinds.values(), default=0) > min(most, n):
            return super()._fit(dataset)
        seed, fraction = self.getSeed(), min(1.0, max(most * most, 10_000) / n)
        if fraction < 1:
            first = _first(seed) & M32
            sample = framed(rows.sample(False, fraction, first - (first >> 31 << 32)))
        else:
            sample = framed(rows)
        x = sample.select("x").toArrow().column(0).combine_chunks()
        inputs = len(framed(rows).first().x)
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)
        cuts = [None if f in kinds else thresholds(x[:, f], fraction * n, min(most, n) - 1) for f in range(inputs)]
        grower = Grower(cuts, [kinds.get(f) or len(c) + 1 for f, c in enumerate(cuts)], self.getMaxDepth(),
                        self.getMaxIter(), self.getStepSize(), self.getSubsamplingRate(),
                        _inputs_of_a_node(self.getFeatureSubsetStrategy(), inputs), seed,
                        self.getMinInstancesPerNode(), self.getMinInfoGain())
        scratch = Scratch(spark)
        try:
            folder = scratch.folder
            numbers = [r.part for r in framed(rows).mapInArrow(_bin(grower, folder), "part int").collect()]
            numbers = sorted(set(numbers))
            # a barrier stage before a shuffle can run again; one that gives the result cannot
            trees = context.parallelize(range(t := min(slots, len(numbers))), t).barrier().mapPartitions(
                _grow(grower, folder, numbers)).partitionBy(1).values().first()
            return self._model(trees, grower, f"{folder}/model", spark)
        finally:
            scratch.drop()

    def _model(self, trees: list, grower: Grower, path: str, spark) -> GBTRegressionModel:
        """The trees in the format of Spark's saved models, read as such."""
        head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        given = lambda values: {p.name: v for p, v in values.items()}
        whole = head | {"class": "org.apache.spark.ml.regression.GBTRegressionModel",
                        "uid": self.uid, "paramMap": given(self._paramMap), "defaultParamMap": given(self._defaultParamMap),
                        "numFeatures": len(grower.bins), "numTrees": len(trees)}
        one = head | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "defaultParamMap": {},
                      "paramMap": {"maxDepth": grower.depth, "seed": grower.seed}}
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(m, json.dumps(one | {"uid": f"{self.uid}_{m}"}), grower.rate if m else 1.0)
                               for m in range(len(trees))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(
            f"{path}/treesMetadata")
        spark.createDataFrame([(m, r) for m, nodes in enumerate(trees) for r in _saved(nodes, grower)],
                              NODES, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
        model = GBTRegressionModel.load(path)
        model.__class__ = BoostedRegressionModel
        model.grower, model.forest = grower, [_flat(nodes, grower.width) for nodes in trees]
        return model


def _inputs_of_a_node(strategy: str, inputs: int) -> int:
    named = {"auto": inputs, "all": inputs, "sqrt": np.ceil(np.sqrt(inputs)), "onethird": np.ceil(inputs / 3.0),
             "log2": max(1, np.ceil(np.log2(inputs)))}
    if strategy.lower() in named:
        return int(named[strategy.lower()])
    return min(int(strategy), inputs) if strategy.isdigit() else int(np.ceil(float(strategy) * inputs))


def _bin(grower: Grower, folder: str):
    def run(batches):
        bins, labels = [], []
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if not np.isfinite(x).all():
                raise ValueError("Vector values MUST NOT be NaN or Infinity")
            if b.num_rows:
                bins.append(grower.binned(x))
                labels.append(b.column(1).to_numpy(zero_copy_only=False))
        if labels:
            part = TaskContext.get().partitionId()
            shared_files.put(folder, f"bins-{part}", np.concatenate(bins, axis=1).tobytes())
            shared_files.put(folder, f"label-{part}", np.concatenate(labels).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])
    return run


def _saved(nodes: list[dict], grower: Grower) -> list[tuple]:
    """Nodes in the order of a walk; two leaves of one value are one."""
    pruned = {}

    def leaf(i: int) -> bool:
        if "input" not in nodes[i]:
            return True
        if i not in pruned:
            a, b = nodes[i]["left_child"], nodes[i]["right_child"]
            pruned[i] = all([leaf(a), leaf(b)]) and value(a) == value(b)
        return pruned[i]

    def value(i: int) -> float:
        while "input" in nodes[i]:
            i = nodes[i]["left_child"]
        return nodes[i]["value"]

    out = []

    def walk(i: int) -> int:
        node, at = nodes[i], len(out)
        out.append(None)
        n, s, squares = (float(v) for v in node["own"])
        if leaf(i):
            out[at] = (at, value(i), node["impurity"], [n, s, squares], int(n), -1.0, -1, -1, (-1, [], -1))
            return at
        f = node["input"]
        split = (f, [float(v) for v in node["goes"]], grower.bins[f]) if grower.cuts[f] is None \
            else (f, [float(grower.cuts[f][node["cut"]])], -1)
        ends = walk(node["left_child"]), walk(node["right_child"])
        out[at] = (at, node["value"], node["impurity"], [n, s, squares], int(n), node["gain"], *ends, split)
        return at

    walk(0)
    return out
