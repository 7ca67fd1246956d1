"""The whole cleaning of one table, from raw cells to features, report and score."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators import cleaning as C
from tillwise.operators import features as X
from tillwise.operators import laws as L
from tillwise.operators import quality as Q
from tillwise.operators.coltypes import TypePlan, cast_types, is_numeric, plan_types, redetect_dates
from tillwise.operators.rules import apply_rules
from tillwise.session import checkpointed, spread

#: Rows of a task, at least and at most; every step parses or tests all cells of a row.
TASK_ROWS = 20_000, 200_000


@dataclass
class CleanRun:
    """Cleaned table, types, and one report row per finding."""

    data: DataFrame
    plan: TypePlan
    report: DataFrame
    laws: list[L.Law]


def clean_table(raw: DataFrame, as_of: datetime.date, row_id: str | None = None,
                target: str | None = None, fit: Column | None = None,
                rules: dict | None = None, lags: bool = True) -> CleanRun:
    """Type, clean, impute, validate, cap, and add date and lag features.

    The typed and normalised rows are written once (a checkpoint); each statistics step after it
    is one aggregate over that copy, and the steps themselves are projections.  Lag features
    need ``row_id``, a unique whole-number column that settles the order of equal dates.
    """
    report: list[tuple[str, str, float]] = []
    before = Q.null_and_shape_metrics(raw).first()
    raw = spread(raw, *TASK_ROWS, before.n_rows)

    plan = plan_types(raw)
    df = C.dedup_rows(cast_types(raw, plan))
    df = C.garbage_to_null(C.text_normalise(df, plan), [*plan.ids, *plan.text])
    df = checkpointed(spread(df, *TASK_ROWS, before.n_rows))  # the rows of every step after it
    rows = df.count()
    report.append(("duplicates", "rows", float(before.n_rows - rows)))

    df = C.standardise_categories(df, plan.text)
    df, plan = redetect_dates(df, plan)
    untyped = sum(1 for c, t in raw.dtypes if t == "string" and plan.types[c] not in ("text", "id"))

    numeric = L.eligible_columns(df if fit is None else df.where(fit), plan.numeric, target, plan.ids)
    laws: list[L.Law] = []
    if len(numeric) >= 3:
        known = df if fit is None else df.where(fit)
        laws = L.kept_laws(L.law_resolution(L.law_discovery(known, numeric)))
    df = L.relational_impute(df, laws, plan.integers, target)
    report += [("law", f"{w.base_a} {L.SIGN[w.op]} {w.base_b} = {w.derived}", w.confidence) for w in laws]
    run = apply_rules(df, rules or {})
    df, errors = run.data, run.errors
    for r in run.report().collect() if rules else []:
        report += [("rule error", r.rule, 1.0)] if r.error else [
            ("rule filled", r.rule, float(r.filled)), ("rule failed on rows", r.rule, float(r.failed))]

    imputer = C.fit_imputer(df, plan, fit, target)
    df = C.impute_missing(df, imputer)
    report += [(f"missing ({s})", c, float(m)) for c, m, _, s in imputer.report]
    sparse = sum(1 for r in imputer.report if r[3].startswith("skipped"))

    signs = C.fit_non_negative(df, plan, fit)
    df = C.validate_non_negative(df, signs)
    report += [("negative replaced", c, float(e)) for c, (_, _, e) in signs.counts.items()]
    df = C.validate_date_range(C.validate_date_order(df, plan.dates), plan.dates, as_of)
    df = L.constraint_sync(df, laws, rules, plan.integers)
    df = C.derive_total_sales(df, plan.numeric)

    bounds = C.fit_outlier_bounds(df, plan, fit, target)
    capped = {r.column_name: r.low + r.high for r in C.outlier_report(df, bounds).collect()}
    df = C.cap_outliers_iqr(df, {c: b for c, b in bounds.items() if c in capped}, plan.integers)
    df = L.constraint_sync(df, laws, rules, plan.integers)
    report += [("outliers capped", c, float(n)) for c, n in capped.items()]

    df = checkpointed(df)
    original = [c for c in raw.columns if c in df.columns]
    after = Q.null_and_shape_metrics(df.select(*[F.col(f"`{c}`") for c in original])).first()
    usable = [c for c in original if is_numeric(dict(df.dtypes)[c]) and c not in plan.ids]
    pairs = Q.correlation_pairs(df, usable).collect() if len(usable) >= 2 else []
    report += [("high correlation", f"{p.col_a} / {p.col_b}", max(p.pearson, p.spearman)) for p in pairs]

    broken = sum(1 for c in signs.counts)
    b, a = Q.quality_score(before.null_cells, before.n_cells, before.n_rows - rows, before.n_rows,
                           len(capped), untyped, after.null_cells, after.n_cells, sparse, broken,
                           len(pairs), len(errors))
    score = df.sparkSession.range(1).select(b.alias("b"), a.alias("a")).first()
    report += [("score", "before", score.b), ("score", "after", score.a)]

    if plan.dates:
        primary = X.select_primary_date(df, plan.dates)
        group = X.select_group_column(df, plan.text)
        values = X.lag_value_columns([c for c in plan.numeric if c in df.columns], plan.ids)
        df = X.date_deltas(X.date_parts(df, primary), primary, [d for d in plan.dates if d != primary])
        if lags and row_id and values:
            df = X.group_lag_features(df, primary, row_id, values, group)
    out = df.sparkSession.createDataFrame(report, "finding string, subject string, value double")
    return CleanRun(df, plan, out, laws)
