"""Small column builders shared by every operator."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    """A column by exact name (names may hold spaces or dots) or the column itself."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def days_between(start, end) -> Column:
    """Whole elapsed days, floored towards zero; NULL when either side is NULL."""
    return F.timestamp_diff("DAY", col(start), col(end))


def ratio(a, b) -> Column:
    """a / b as double; NULL when b is 0 or either is NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def mean_of(c) -> Column:
    """Mean as exact sum / count: with decimal input it does not depend on row order."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def clip(c, low=None, high=None) -> Column:
    """Clamp without turning NULL into a bound (least/greatest skip NULLs)."""
    x = col(c)
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def bucket_label(c, steps: Iterable[tuple[float, str]], otherwise: str) -> Column:
    """Label by the first lower bound reached; ``steps`` run from the highest bound down."""
    out = None
    for bound, label in steps:
        cond = col(c) >= F.lit(bound)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct column (an uncorrelated scalar subquery)."""
    return df.select(F.struct("*")).scalar()


def scalar(df: DataFrame, agg: Column) -> Column:
    """One aggregate of ``df`` as a column usable in any other DataFrame."""
    return df.agg(agg).scalar()


def size_estimate(df: DataFrame) -> int:
    """Bytes the plan reads, from the optimizer's statistics of its scans.

    The check behind every choice of a plan that only suits small input.  Scans are summed
    because the estimate of a join is the product of its sides unless statistics exist.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


# Name matching ---------------------------------------------------------------------------

def _alt(words: Iterable[str]) -> str:
    out = []
    for w in words:
        out.append("".join("\\" + ch if not (ch.isalnum() or ch in "_ ") else ch for ch in w))
    return "|".join(out)


def edge_pattern(words: Iterable[str]) -> str:
    """Regex: the name equals, starts or ends with a word at an underscore boundary."""
    a = _alt(words)
    return f"^({a})$|_({a})$|^({a})_"


def anchored_pattern(words: Iterable[str]) -> str:
    """Regex: as ``edge_pattern`` and also in the middle between underscores."""
    a = _alt(words)
    return f"(^|_)({a})(_|$)"


def any_word_pattern(words: Iterable[str]) -> str:
    """Regex: any of the words anywhere (plain substring)."""
    return _alt(words)


def snake(c) -> Column:
    """Lower-case a name and turn spaces into underscores."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("_"))


def warnings_array(*pairs: tuple[Column, Column]) -> Column:
    """Messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in pairs]))


def text_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lookup(key, table: dict, default=None) -> Column:
    """Value of a small fixed table, as a literal map inside code generation."""
    items: list[Column] = []
    for k, v in table.items():
        items += [F.lit(k), F.lit(v)]
    # try_element_at: a missing key is NULL, never an error under ANSI rules
    found = F.try_element_at(F.create_map(*items), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def table_literal(rows: Iterable[tuple], schema: str) -> Column:
    """A small fixed table as one array-of-structs literal (folded when the plan is built).

    ``schema`` reads like ``"q int, word string"``.
    """
    names = [part.split()[0] for part in schema.split(",")]
    data = json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False)
    return F.from_json(F.lit(data), f"array<struct<{','.join(':'.join(p.split()) for p in schema.split(','))}>>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def count_at_most(ascending: Column, value: Column, most: int | None = None) -> Column:
    """How many elements of an ascending array are at most ``value``, by bisection.

    ``most``: a size that the array does not exceed, else its own size; the steps are its binary digits.
    """
    def step(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        under = F.get(ascending, middle) <= value
        return F.when(s["low"] >= s["high"], s).when(under, F.struct(
            (middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high"))
    steps = F.length(F.bin(F.size(ascending))) if most is None else F.lit(max(1, int(most).bit_length()))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["low"])
