"""Arithmetic laws between columns: find them, settle conflicts, fill missing members.

Every row is laid out once as an array of the eligible columns.  A slice of the rows shows which
triples of columns may be laws, by looking results up among the row's values; the triples that are left
are a literal inside the plan, each row tests each of them, and the counts per triple are combined on
the map side.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, table_literal
from tillwise.operators.cleaning import is_key
from tillwise.operators.rules import custom_rule_impute

# Thresholds of a law (fixed values)
CONFIDENCE, SUPPORT, EPSILON, FLOOR = 0.99, 50, 1e-4, 1e-9
OPS = ["addition", "subtraction", "multiplication", "division"]
SIGN = {"addition": "+", "subtraction": "−", "multiplication": "×", "division": "÷"}
PRIORITY = {"multiplication": 3, "addition": 2, "subtraction": 1, "division": 0}
PREFERRED = ["addition", "multiplication"]


@dataclass(frozen=True)
class Law:
    base_a: str
    base_b: str
    derived: str
    op: str
    can_be_negative: bool
    confidence: float = 1.0
    support: int = 0

    def formula(self) -> Column:
        a, b = col(self.base_a).cast("double"), col(self.base_b).cast("double")
        return {"addition": a + b, "subtraction": a - b, "multiplication": a * b,
                "division": F.try_divide(a, b)}[self.op]

    def solve_a(self) -> Column:
        d, b = col(self.derived).cast("double"), col(self.base_b).cast("double")
        return {"addition": d - b, "subtraction": d + b, "multiplication": F.try_divide(d, b),
                "division": d * b}[self.op]

    def solve_b(self) -> Column:
        d, a = col(self.derived).cast("double"), col(self.base_a).cast("double")
        return {"addition": d - a, "subtraction": a - d, "multiplication": F.try_divide(d, a),
                "division": F.try_divide(a, d)}[self.op]


def eligible_columns(df: DataFrame, numeric: Sequence[str], target: str | None = None,
                     ids: Sequence[str] = ()) -> list[str]:
    """Numeric, not an identifier or the target, not constant; fullest first."""
    cols = [c for c in numeric if c in df.columns and c not in ids and c != target and not is_key(c)]
    if not cols:
        return []
    row = df.agg(*[F.struct(F.count(col(c)).alias("n"), F.min(col(c)).alias("lo"),
                            F.max(col(c)).alias("hi")).alias(f"c{k}")
                   for k, c in enumerate(cols)]).first()
    varied = [(c, row[k].n) for k, c in enumerate(cols) if row[k].lo != row[k].hi]
    return [c for c, _ in sorted(varied, key=lambda t: -t[1])]


#: Slices of the pruning pass, and triples tested in one pass (a plan literal)
SLICES, TESTS_PER_PASS = 24, 6000
#: Width of the buckets of ln|value| in which a result is looked up: a little over the tolerance, so that
#: a hit lies in its bucket or in the next on either side; and a number above all bucket numbers.
BUCKET, BUCKETS = 1.1 * EPSILON, 10_000_000
#: Values under this size share a bucket, and results under its 1.5-fold are looked up there too.
TINY = 2 * FLOOR


def law_discovery(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every x op y = z among the columns that holds on the rows given.

    A law may miss at most 1 % of the rows it applies to, so on a hash slice of the rows it must hold
    on all but that many.  There every x op y of a row is looked up among the row's values, which
    shows all laws with a hit at the price of the pairs, not the triples, of columns.  The few tests
    whose columns are too empty for the slice to show them are tried one by one.  What is left is
    counted over the whole table; the outcome is that of testing every triple on every row.
    """
    cols = list(columns)
    tests = [(i, j, k, o) for i, j, k in itertools.permutations(range(len(cols)), 3)
             for o, op in enumerate(OPS) if i < j or op in ("subtraction", "division")]
    if not tests:
        return _law_rows(df, cols, [])
    in_slice = F.pmod(F.xxhash64(*[col(c) for c in cols]), F.lit(SLICES)) == 0
    part = df.where(in_slice)
    sizes = df.select(in_slice.alias("s"), *[F.abs(col(c).cast("double")).alias(f"v{k}") for k, c in enumerate(cols)])
    row = sizes.agg(F.count("*").alias("n"), F.count_if("s").alias("m"), *[F.struct(
        F.count(v).alias("n"),
        F.count_if(F.col("s") & (F.col(v).isNull() | F.isnan(v) | (F.col(v) >= 1e150))).alias("gone"),
        F.count_if(F.col("s") & (F.col(v) <= FLOOR)).alias("zero")).alias(f"c{v[1:]}")
        for v in sizes.columns[1:]]).first()
    stats, m = [row[f"c{k}"] for k in range(len(cols))], row["m"]

    def least_hits(i, j, k, o):
        """Hits of a law on the slice: its rows there, at least, less the misses allowed to it."""
        rows = m - sum(stats[x].gone for x in (i, j, k)) - (stats[j].zero if OPS[o] == "division" else 0)
        return rows - (1 - CONFIDENCE) * min(stats[x].n for x in (i, j, k))

    hits = {(r.i, r.j, r.k, r.o): r["count"] for r in _slice_hits(part, cols).collect()}
    left, unseen = [], []
    for t in tests:
        need = least_hits(*t)
        if need <= 0:
            unseen.append(t)
        elif hits.get(t, 0) >= need:
            left.append(t)
    for start in range(0, len(unseen), TESTS_PER_PASS):
        some = unseen[start:start + TESTS_PER_PASS]
        misses = _law_counts(part, cols, some).where(
            F.col("n") - F.col("h") > row["n"] * (1 - CONFIDENCE)).select("q").collect()
        gone = {r.q for r in misses}
        left += [t for q, t in enumerate(some) if q not in gone]
    left.sort()
    out = _law_rows(df, cols, left[:TESTS_PER_PASS])
    for start in range(TESTS_PER_PASS, len(left), TESTS_PER_PASS):
        out = out.unionByName(_law_rows(df, cols, left[start:start + TESTS_PER_PASS]))
    return out


def _buckets(x: np.ndarray, tiny: float) -> np.ndarray:
    """Numbers of the buckets of values; 0 for those under ``tiny``."""
    size = np.abs(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        number = np.floor(np.log(size) / BUCKET) + BUCKETS
    return np.where(size < tiny, 0, np.where(x < 0, number + 2 * BUCKETS, number)).astype(np.int64)


def _slice_hits(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, k, o) and the rows on which column i op column j is column k."""
    width = len(cols)
    i, j = np.array(list(itertools.permutations(range(width), 2))).T
    o = np.repeat(np.arange(len(OPS)), len(i))
    i, j = np.tile(i, len(OPS)), np.tile(j, len(OPS))
    asked = (i < j) | np.isin(o, [OPS.index("subtraction"), OPS.index("division")])
    i, j, o = i[asked], j[asked], o[asked]
    code = (i * width + j) * len(OPS) + o
    rows_at_once = max(1, (1 << 19) // len(i))

    def look_up(v: np.ndarray) -> np.ndarray:
        """Codes of the laws that hold, one for each row they hold on."""
        n = len(v)
        with np.errstate(all="ignore"):
            x, y = v[:, i], v[:, j]
            r = np.select([o == 0, o == 1, o == 2], [x + y, x - y, x * y],
                          x / np.where(np.abs(y) > FLOOR, y, np.nan))
        row, at = np.nonzero(np.isfinite(r))
        r = r[row, at]
        shelf = row.astype(np.int64) << 27
        held = np.isfinite(v)
        kept_row, kept_col = np.nonzero(held)
        key = (kept_row.astype(np.int64) << 27) + _buckets(v[held], TINY)
        order = np.argsort(key)
        key, kept_col = key[order], kept_col[order]
        found = []
        low = shelf + _buckets(r, 0.0)
        small = np.flatnonzero(np.abs(r) < 1.5 * TINY)
        every = np.arange(len(r))
        for which, first, last in ((every, low - 1, low + 1), (small, shelf[small], shelf[small])):
            begin, end = np.searchsorted(key, first), np.searchsorted(key, last, side="right")
            hit = np.flatnonzero(end > begin)
            many = (end - begin)[hit]
            place = np.repeat(begin[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            source, k = np.repeat(which[hit], many), kept_col[place]
            z = v[row[source], k]
            good = (np.abs(z - r[source]) / np.maximum(np.abs(z), FLOOR) < EPSILON) \
                & (k != i[at[source]]) & (k != j[at[source]])
            # a value may lie on both shelves; each (row, law) counts once
            found.append((row[source] * len(i) + at[source])[good] * width + k[good])
        hits = np.unique(np.concatenate(found))
        return code[hits // width % len(i)] * width + hits % width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            for first in range(0, len(v), rows_at_once):
                laws, count = np.unique(look_up(v[first:first + rows_at_once]), return_counts=True)
                total.update(dict(zip(laws.tolist(), count.tolist())))
        yield pa.RecordBatch.from_pydict({"law": pa.array(list(total), pa.int64()),
                                          "n": pa.array(list(total.values()), pa.int64())})

    values = df.select(*[col(c).cast("double").alias(f"v{k}") for k, c in enumerate(cols)])
    law = F.col("law")
    each = lambda over: F.floor(law / over)
    return values.mapInArrow(run, "law long, n long").groupBy("law").agg(F.sum("n").alias("count")).select(
        each(width * width * len(OPS)).cast("int").alias("i"),
        (each(width * len(OPS)) % width).cast("int").alias("j"), (law % width).cast("int").alias("k"),
        (each(width) % len(OPS)).cast("int").alias("o"), "count")


def _result(o: Column, x: Column, y: Column) -> Column:
    return F.when(o == 0, x + y).when(o == 1, x - y).when(o == 2, x * y).otherwise(
        x / F.when(F.abs(y) > FLOOR, y))


def _law_counts(df: DataFrame, cols: Sequence[str], tests) -> DataFrame:
    """Per test (numbered): rows it applies to, rows it holds on, any negative result."""
    lit = table_literal([(q, *t) for q, t in enumerate(tests)], "q int, i int, j int, k int, o int")
    rows = df.select(F.array(*[col(c).cast("double") for c in cols]).alias("v"))
    t = rows.select("v", F.explode(lit).alias("t")).select(
        F.col("t.q").alias("q"), F.col("t.o").alias("o"), F.get("v", "t.i").alias("x"),
        F.get("v", "t.j").alias("y"), F.get("v", "t.k").alias("z"))
    t = t.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    x, y, z, o = F.col("x"), F.col("y"), F.col("z"), F.col("o")
    res = F.abs(z - _result(o, x, y)) / F.greatest(F.abs(z), F.lit(FLOOR))
    ok = res.isNotNull() & ~F.isnan(res) & (res < F.lit(float("inf")))
    return t.select("q", ok.alias("ok"), (res < EPSILON).alias("hit"), (z < 0).alias("neg")).groupBy(
        "q").agg(F.count_if("ok").alias("n"), F.count_if(F.col("ok") & F.col("hit")).alias("h"),
                 F.bool_or("neg").alias("neg"))


def _law_rows(df: DataFrame, cols: Sequence[str], tests) -> DataFrame:
    schema = ("seq int, base_a string, base_b string, derived string, op string, "
              "confidence double, support long, can_be_negative boolean")
    if not tests:
        return df.sparkSession.createDataFrame([], schema)
    width = len(cols)
    lit = table_literal([((((i * width) + j) * width + k) * len(OPS) + o, cols[i], cols[j], cols[k], OPS[o])
                         for i, j, k, o in tests],
                        "seq int, base_a string, base_b string, derived string, op string")
    found = _law_counts(df, cols, tests).where(
        (F.col("n") >= SUPPORT) & (F.col("h") >= F.col("n") * CONFIDENCE))
    return found.select(F.get(lit, "q").alias("t"), "n", "h", "neg").select(
        "t.*", F.round(F.col("h") / F.col("n"), 5).alias("confidence"), F.col("n").alias("support"),
        F.col("neg").alias("can_be_negative"))


def law_resolution(candidates: DataFrame) -> DataFrame:
    """One law per derived column, one per set of columns and family; losers say why.

    Better confidence wins, then × over + over − over ÷, then the earlier test.  Rearrangements
    of one law collapse to its + or × form where that exists.
    """
    rank = F.create_map(*itertools.chain(*[(F.lit(k), F.lit(v)) for k, v in PRIORITY.items()]))
    w = Window.partitionBy("derived").orderBy(
        F.desc("confidence"), F.desc(rank[F.col("op")]), F.asc("seq"))
    c = candidates.withColumns({
        "place": F.row_number().over(w),
        "first_seq": F.min("seq").over(Window.partitionBy("derived")),
        "family": F.when(F.col("op").isin("addition", "subtraction"), "additive")
        .otherwise("multiplicative"),
        "members": F.array_join(F.array_sort(F.array("base_a", "base_b", "derived")), ","),
    })
    v = Window.partitionBy("members", "family", F.col("place") == 1).orderBy(
        F.desc(F.col("op").isin(*PREFERRED).cast("int")), F.asc("first_seq"))
    c = c.withColumn("form", F.row_number().over(v))
    return c.select(
        "seq", "base_a", "base_b", "derived", "op", "confidence", "support", "can_be_negative",
        F.when(F.col("place") > 1, "displaced").when(F.col("form") > 1, "rearrangement")
        .otherwise("kept").alias("outcome"))


def kept_laws(resolved: DataFrame) -> list[Law]:
    """The surviving laws as plan-building metadata (at most one per column)."""
    return [Law(r.base_a, r.base_b, r.derived, r.op, r.can_be_negative, r.confidence, r.support)
            for r in resolved.where("outcome = 'kept'").orderBy("seq").collect()]


def _fill(df: DataFrame, name: str, value: Column, integers) -> Column:
    if name in integers:
        value = F.bround(value, 0)
    return F.coalesce(col(name), value.cast(dict(df.dtypes)[name]))


def relational_impute(df: DataFrame, laws: Sequence[Law], integers: set[str] = frozenset(),
                      target: str | None = None) -> DataFrame:
    """Fill the one missing member of each law.

    A negative result is refused unless the law has shown negatives; inverses never give one.
    """
    for law in laws:
        new = {}
        f = law.formula()
        if law.derived != target:
            new[law.derived] = _fill(df, law.derived, f if law.can_be_negative else
                                     F.when(f >= 0, f), integers)
        for name, inverse in ((law.base_a, law.solve_a()), (law.base_b, law.solve_b())):
            if name != target:
                new[name] = _fill(df, name, F.when(inverse >= 0, inverse), integers)
        df = df.withColumns(new)
    return df


def constraint_sync(df: DataFrame, laws: Sequence[Law], rules: dict | None = None,
                    integers: set[str] = frozenset()) -> DataFrame:
    """Fill derived cells that are still missing where both bases are known, then the rules."""
    for law in laws:
        df = df.withColumn(law.derived, _fill(df, law.derived, law.formula(), integers))
    return custom_rule_impute(df, {c: r for c, r in (rules or {}).items() if c in df.columns})[0] \
        if rules else df
