"""Rules over evaluation runs: warnings, confidence, decision gates, facts as text.

Input rows follow the nested run schema (``sources.tables.EVAL_SCHEMA``) plus ``run_id``; every
rule is a column expression, so any number of runs is judged in one job.

The message texts are fixed values that reports are compared by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.exprs import text_array, warnings_array
from tillwise.functions.vocab import (
    DECISION_IMPACT, DECISION_LABEL, GATES, HARD_BLOCKS, REVENUE_LEAKS,
)
from tillwise.operators.profiles import NO_DATA, fixed, grouped, say

REV, CHURN, GROW = "revenue_model", "churn_model", "growth_model"


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def _warned(report: str, word: str) -> Column:
    """The report itself carries a warning with this word."""
    return F.coalesce(F.exists(F.col(f"{report}.warnings"),
                               lambda w: F.contains(F.lower(w), F.lit(word))), F.lit(False))


def _n(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _money2(c: Column) -> Column:
    return F.format_number(c, 2)


def growth_forecast() -> Column:
    """Forecast points of a run, whichever of the two names holds them."""
    a, b = F.col(f"{GROW}.forecast"), F.col(f"{GROW}.12_month_forecast")
    return F.when(F.size(a) > 0, a).otherwise(b)


def _facts() -> dict[str, Column]:
    fc = F.col(f"{REV}.12_period_forecast")
    gf = F.transform(growth_forecast(), lambda p: p["forecast"])
    top = F.transform(F.slice(F.col(f"{REV}.top_features"), 1, 5), lambda f: F.lower(f["feature"]))
    return {
        "_r2": _n(f"{REV}.R2"), "_mape": _n(f"{REV}.MAPE_pct"), "_rows": _n(f"{REV}.train_rows"),
        "_fc": fc, "_fc_n": F.coalesce(F.size(fc), F.lit(0)), "_gf": gf,
        "_gf_n": F.greatest(F.coalesce(F.size(gf), F.lit(0)), F.lit(0)),
        "_leaks": F.array_sort(F.array_intersect(top, text_array(REVENUE_LEAKS))),
        "_rate": _n(f"{CHURN}.churn_rate_pct"), "_auc": _n(f"{CHURN}.ROC_AUC"),
        "_crows": _n(f"{CHURN}.train_rows"), "_gr2": _n(f"{GROW}.R2"),
        "_months": F.coalesce(F.col(f"{GROW}.train_months"), F.lit(0)),
        "_tests": F.coalesce(F.col(f"{GROW}.test_months"), F.lit(0)),
    }


def eval_warnings(runs: DataFrame) -> DataFrame:
    """Statistically implausible numbers of each run, in plain words."""
    return _with_warnings(runs).select("run_id", "warnings")


def _with_warnings(runs: DataFrame) -> DataFrame:
    """The runs with their facts and a ``warnings`` column, in one projection."""
    r = runs.withColumns(_facts())
    have = lambda m: F.col(m).isNotNull()
    lo, hi = F.array_min("_fc"), F.array_max("_fc")
    r = r.withColumns({"_mean": F.when(F.col("_fc_n") > 0, _mean(F.col("_fc"))), "_range": hi - lo,
                       "_gmean": F.when(F.col("_gf_n") > 0, _mean(F.col("_gf")))})
    mean, gmean = F.col("_mean"), F.col("_gmean")
    spread = F.coalesce(F.try_divide(F.col("_range"), mean), F.lit(0.0))
    lab, prof = f"{CHURN}.labelling", f"{GROW}.data_profile"
    vouched = F.coalesce(F.col(f"{lab}.confidence") == "high", F.lit(False)) & ~_warned(lab, "rate")
    safe = F.col(f"{GROW}.forecast_horizon_months") <= F.col(f"{prof}.safe_horizon_months")
    certified = F.coalesce(safe, F.lit(False)) & ~_warned(prof, "horizon")
    scale = F.try_divide(gmean, mean)
    r2, mape = F.col("_r2"), F.col("_mape")
    messages = warnings_array(
        (have(REV) & (r2 >= 0.95), say(
            "**Revenue model R² is {}** — values above 0.95 in real-world business data almost "
            "always indicate target leakage. Inspect the top features for any column that is "
            "computed from or alongside revenue.", fixed(r2, 4))),
        (have(REV) & (F.col("_fc_n") >= 2) & (spread < 0.02), say(
            "**Revenue forecast is unusually flat** (range ${} on a mean of ${}). The model may be "
            "predicting the mean rather than capturing real time-series signal.",
            fixed(F.col("_range"), 2), _money2(mean))),
        (have(REV) & (F.size("_leaks") > 0), say(
            "**Likely target-leakage features in revenue model**: {}. These are typically computed "
            "from or alongside revenue, so the model may be solving an arithmetic identity rather "
            "than forecasting.", F.array_join("_leaks", ", "))),
        (have(CHURN) & (F.col("_rate") >= 40) & ~vouched, say(
            "**Churn rate of {}% is unusually high.** Real ecommerce churn typically sits at 5–25% "
            "annually, SaaS at 2–8% monthly. Review the churn-label definition: a too-short "
            "inactivity window will overcount seasonal buyers as churned.", fixed(F.col("_rate"), 1))),
        (have(GROW) & (F.col("_months") > 0) & (F.col("_gf_n") > F.col("_months") / 2) & ~certified, say(
            "**Growth forecast horizon is large relative to training data** ({} months forecast "
            "from {} months of history). Treat anything past the first 3–6 months as "
            "low-confidence.", F.col("_gf_n"), F.col("_months"))),
        (F.coalesce((mean != 0) & (gmean != 0) & ((scale > 100) | (scale < 0.01)), F.lit(False)), say(
            "**Scale mismatch between revenue and growth models.** The revenue model forecasts "
            "**${} per transaction** (each prediction = one order); the growth model forecasts "
            "**${} per month** (each prediction = an entire month's revenue). The {}x gap is NOT a "
            "model error -- it's that the two models answer different questions. Use the revenue "
            "model for per-order pricing and discount decisions; use the growth model for monthly "
            "budgeting and capacity planning. To bridge them: the revenue model's per-transaction "
            "average should reconcile approximately to the growth model when multiplied by your "
            "monthly order count (e.g. ${} per order x ~{} orders/month ≈ ${}/month). If that "
            "reconciliation doesn't hold, one of the models needs investigation.",
            _money2(mean), _money2(gmean), grouped(scale), grouped(mean),
            F.format_number(F.floor(scale), 0), grouped(gmean))),
        (have(REV) & (mape >= 30) & (r2 >= 0.7)
         & ~_warned(f"{REV}.data_profile", "coefficient of variation"), say(
            "**Revenue MAPE is {}% but R² is {}.** On per-transaction data with mixed order sizes, "
            "high MAPE is expected (small orders inflate the metric). Combined with a healthy R² of "
            "{}, the model is fitting well in absolute terms -- treat MAE and sMAPE as the primary "
            "error metrics, not MAPE.", fixed(mape, 1), fixed(r2, 3), fixed(r2, 3))))
    return r.withColumn("warnings", messages)


def _pick(*branches, default):
    """First branch whose condition holds; each branch is (level, reason, use_for, do_not)."""
    out = None
    for cond, value in branches:
        s = F.struct(F.lit(value[0]).alias("level"), value[1].alias("reason"),
                     F.lit(value[2]).alias("use_for"), F.lit(value[3]).alias("do_not_use_for"))
        out = F.when(cond, s) if out is None else out.when(cond, s)
    v = default
    return out.otherwise(F.struct(F.lit(v[0]).alias("level"), v[1].alias("reason"),
                                  F.lit(v[2]).alias("use_for"), F.lit(v[3]).alias("do_not_use_for")))


def _revenue_rule(leak: Column) -> Column:
    r2, mape, rows = F.col("_r2"), F.col("_mape"), F.col("_rows")
    n, a, b = grouped(rows), fixed(r2, 3), fixed(mape, 1)
    solid = (rows >= 20000) & r2.between(0.65, 0.94) & ~leak
    return _pick(
        (r2 >= 0.95, ("low", say(
            "R² of {} is suspiciously high -- possible target leakage. Treat all revenue numbers as "
            "provisional until features are re-audited.", fixed(r2, 4)),
            "Nothing until the leakage suspicion is resolved.",
            "Any revenue forecasting, target-setting, or pricing decision -- numbers are likely a "
            "near-tautology.")),
        ((rows < 5000) | (r2 < 0.4), ("low", say(
            "Only {} training rows / R² of {}. Forecasts are directional at best.", n, a),
            "Rough trend estimation only.", "Any decision involving real budget or staff time.")),
        (solid & (mape < 30), ("high", say(
            "Trained on {} rows with R² of {} and MAPE of {}%. Reliable in aggregate AND on "
            "individual rows.", n, a, b),
            "Both aggregate revenue planning AND per-transaction predictions (e.g. dynamic pricing).",
            "Decisions that require causal interpretation -- feature importance is correlation, not "
            "causation.")),
        (solid, ("medium", say(
            "Trained on {} rows with R² of {} -- aggregate forecasts are reliable. However, MAPE of "
            "{}% means per-transaction predictions are noisy: small orders carry large percentage "
            "errors.", n, a, b),
            "Aggregate revenue planning over weeks or months (totals, averages, trends).",
            "Per-order pricing, quoting individual transaction values, or any decision that hinges "
            "on a single row's predicted revenue.")),
        default=("medium", say(
            "Trained on {} rows, R² of {}, MAPE {}%. Acceptable for aggregate planning, not for "
            "per-row decisions.", n, a, b),
            "High-level aggregate planning.", "Per-row decisions or causal explanations."))


_RANK_USE = ("Ranking customers by churn risk for retention campaigns. Top-decile prioritisation is "
             "reliable.")
_RANK_NOT = ("Treating individual probability scores as exact (e.g. '73% chance of churn') -- AUC "
             "measures ranking, not calibration.")
_SEG_USE = "Broad high-risk vs low-risk segmentation for experimentation."
_SEG_NOT = "Fine-grained risk rankings or claims about exact churn probabilities."


def _churn_rule() -> Column:
    auc, rate, rows = F.col("_auc"), F.col("_rate"), F.col("_crows")
    return _pick(
        (rate >= 40, ("low", say(
            "Churn rate of {}% is implausibly high; the churn-label rule almost certainly "
            "overcounts seasonal buyers. Even an AUC of {} is not enough to redeem this -- the "
            "model is sorting on a flawed target. Resolve this before acting on any churn-related "
            "recommendation.", fixed(rate, 1), fixed(auc, 3)),
            "Sanity-checking the churn-label rule itself (the high rate IS the diagnostic).",
            "Customer-level retention targeting, retention budget allocation, or any segmentation "
            "that uses the model's risk scores. Output is unreliable until the label rule is fixed.")),
        ((auc >= 0.80) & (rows >= 5000), ("high", say(
            "AUC of {} on {} training customers; strong discriminator with a plausible churn rate.",
            fixed(auc, 3), grouped(rows)), _RANK_USE, _RANK_NOT)),
        (auc >= 0.70, ("medium", say(
            "AUC of {} is decent. Treat individual risk scores as directional rather than precise.",
            fixed(auc, 3)), _SEG_USE, _SEG_NOT)),
        default=("low", say(
            "AUC of {} is weak -- the model barely outperforms random for ranking customers by churn "
            "risk.", fixed(auc, 3)),
            "Hypothesis generation only; treat output as exploratory.",
            "Any production retention decision -- ranking is too close to random."))


def _growth_rule() -> Column:
    r2, m, t = F.col("_gr2"), F.col("_months"), F.col("_tests")
    return _pick(
        ((m < 24) | (t < 6), ("low", say(
            "Trained on only {} months and tested on {} -- less than one full seasonal cycle. A "
            "high test-set R² on this little data ({}) is not statistically meaningful: it could "
            "equally reflect the model picking up signal OR luck on a small holdout.", m, t, fixed(r2, 3)),
            "Directional sense of trajectory (up / flat / down) for next 1-3 months only.",
            "Budget commitments, hiring decisions, supplier contracts, or any specific monthly "
            "figure as a target. Re-evaluate after 24+ months of training data and 6+ test months "
            "exist.")),
        (r2 >= 0.7, ("medium", say(
            "Trained on {} months, R² of {}. Reasonable for short-horizon planning (3-6 months "
            "out); not for year-end commitments.", m, fixed(r2, 3)),
            "Quarterly capacity and budget planning over a 3-6 month horizon.",
            "Year-end commitments or any planning horizon longer than 6 months.")),
        default=("low", say(
            "R² of {} on {} months is weak. Treat the 12-month forecast as a placeholder.",
            fixed(r2, 3), m), "Trend direction only.", "Any specific monthly figure for planning."))


def _level_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "low", 1).otherwise(2)


def model_confidence(runs: DataFrame) -> DataFrame:
    """Level, reasons and scope per run and model; the data report can lower a level.

    Only a high-confidence labelling without rate warnings can lift churn's "low".
    """
    r = _with_warnings(runs)
    leak = F.contains(F.lower(F.array_join("warnings", " ")), F.lit("leakage"))
    rep = "strategy", "confidence", "definition", "suitable_for", "not_suitable_for"
    lab = f"{CHURN}.labelling"

    def item(model, block, report, rule):
        has = F.col(report).isNotNull()
        return F.when(F.col(block).isNotNull(), F.struct(
            F.lit(model).alias("model"), rule.alias("h"), has.alias("has_report"),
            *[F.col(f"{report}.{f}").alias(f) for f in rep]))

    rows = r.select(
        "run_id", "_auc", "_rate", "_crows", _warned(lab, "rate").alias("_rate_warned"),
        F.explode(F.array_compact(F.array(
            item("revenue", REV, f"{REV}.data_profile", _revenue_rule(leak)),
            item("churn", CHURN, lab, _churn_rule()),
            item("growth", GROW, f"{GROW}.data_profile", _growth_rule())))).alias("m")
    ).select("run_id", "_auc", "_rate", "_crows", "_rate_warned", "m.*")

    auc = F.col("_auc")
    lift = ((F.col("model") == "churn") & F.col("has_report") & (F.col("confidence") == "high")
            & (F.col("h.level") == "low") & ~F.col("_rate_warned"))
    strong, fair = (auc >= 0.80) & (F.col("_crows") >= 5000), auc >= 0.70
    lift = F.coalesce(lift, F.lit(False))
    level = F.when(lift & strong, "high").when(lift & fair, "medium").otherwise(F.col("h.level"))
    own = F.when(lift & strong, say(
        "AUC of {} on {} training customers; strong discriminator. Churn rate of {}% is an observed "
        "business outcome on a labeller-validated cohort, not a measurement artefact.",
        fixed(auc, 3), grouped("_crows"), fixed("_rate", 1))).when(lift & fair, say(
            "AUC of {} on a labeller-validated cohort. Treat individual risk scores as directional.",
            fixed(auc, 3))).otherwise(F.col("h.reason"))
    known = F.col("has_report") & F.col("confidence").isNotNull()
    low = F.least(_level_rank(level), _level_rank(F.col("confidence")))
    final = F.when(~known, level).when(low == 3, "high").when(low == 2, "medium").otherwise("low")
    use = F.when(lift & strong, _RANK_USE).otherwise(F.col("h.use_for"))
    dont = F.when(lift & strong, _RANK_NOT).otherwise(F.col("h.do_not_use_for"))
    return rows.select(
        "run_id", "model", final.alias("level"),
        F.array_compact(F.array(F.when(F.col("has_report") & (F.col("definition") != ""),
                                       F.col("definition")), own)).alias("reasons"),
        F.when(F.size("suitable_for") > 0, F.array_join("suitable_for", "; ")).otherwise(use)
        .alias("use_for"),
        F.when(F.size("not_suitable_for") > 0, F.array_join("not_suitable_for", "; "))
        .otherwise(dont).alias("do_not_use_for"))


def decision_gates(confidence: DataFrame) -> DataFrame:
    """Verdict per decision from confidence and impact, with a short rationale."""
    def table(values):
        items = []
        for k, v in values.items():
            items += [F.lit(k), F.lit(v)]
        return F.create_map(*items)

    impact = F.coalesce(F.try_element_at(table(DECISION_IMPACT), F.col("model")), F.lit("medium"))
    key = F.concat_ws("/", "level", impact)
    gate = F.try_element_at(table({"/".join(k): v[0] for k, v in GATES.items()}), key)
    why = F.try_element_at(table({"/".join(k): v[1] for k, v in GATES.items()}), key)
    full = F.trim(F.array_join("reasons", " "))
    two = F.trim(F.substring_index(full, ". ", 2))
    two = F.when((two != "") & ~F.endswith(two, F.lit(".")), F.concat(two, F.lit("."))).otherwise(two)
    cut = F.when(F.length(two) > 300, F.concat(F.rtrim(F.substring(two, 1, 297)), F.lit("...")))
    text = F.concat(why, F.lit(" "), F.coalesce(cut, two))
    return confidence.select(
        "run_id", "model", F.try_element_at(table(DECISION_LABEL), F.col("model")).alias("decision"),
        impact.alias("impact"), "level", gate.alias("gate"),
        F.trim(F.translate(text, "|\n", "/ ")).alias("rationale"))


def block_confidence(blocks: DataFrame) -> DataFrame:
    """How well retrieval supports each canvas block.

    Input: block_id, context_chars, chunks_used and n_sources (sources in the whole store).
    """
    used = F.col("chunks_used")
    base = F.when(used >= 2, 3).when(used == 1, 2).otherwise(1)
    hard = F.col("block_id").isin(HARD_BLOCKS) & (F.col("n_sources") <= 1)
    rank = F.when(F.col("context_chars") < 200, 1).when(hard, F.greatest(base - 1, F.lit(1))).otherwise(base)
    return blocks.withColumn("confidence", F.when(rank == 3, "high").when(rank == 2, "medium")
                             .otherwise("low"))


def skip_when_insufficient(datasets: DataFrame, reports: DataFrame, key: str = "dataset") -> DataFrame:
    """Datasets with a training status; no report means proceed."""
    rep = reports.select(key, "strategy", "definition")
    skip = F.coalesce(F.col("strategy") == NO_DATA, F.lit(False))
    return datasets.join(rep, key, "left").select(
        *datasets.columns, F.when(skip, "skipped_insufficient_data").otherwise("ready").alias("status"),
        F.when(skip, F.col("definition")).alias("reason"))


def kpi_snapshot(runs: DataFrame) -> DataFrame:
    """Twelve headline numbers of each run."""
    return runs.select(
        "run_id", F.col(f"{REV}.MAPE_pct").alias("revenue_mape"), F.col(f"{REV}.R2").alias("revenue_r2"),
        F.col(f"{REV}.MAE").alias("revenue_mae"), F.col(f"{REV}.forecast_bias").alias("forecast_bias"),
        F.col(f"{CHURN}.ROC_AUC").alias("churn_roc_auc"), F.col(f"{CHURN}.F1_Score").alias("churn_f1"),
        F.col(f"{CHURN}.churn_rate_pct").alias("churn_rate_pct"),
        F.col(f"{GROW}.MAPE_pct").alias("growth_mape"), F.col(f"{GROW}.R2").alias("growth_r2"),
        F.col("prophet_model.MAPE_pct").alias("prophet_mape"),
        F.col(f"{REV}.12_period_forecast").alias("revenue_forecast_12"),
        F.col(f"{GROW}.12_month_forecast").alias("growth_forecast_12"))


def top_features(importances: DataFrame, n: int = 10, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Most important features of each model."""
    w = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# Facts as text (the labels of its lines are fixed values) -------------------------------------

def _shown(c: str, missing: str = "N/A") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def _provenance(report: str, labelling: bool) -> Column:
    f = lambda n: F.col(f"{report}.{n}")
    line = lambda label, n: F.when(f(n).isNotNull(), F.concat(F.lit(f"- {label}: "), f(n).cast("string")))
    num = lambda label, n: F.when(f(n).isNotNull(), F.concat(F.lit(f"- {label}: "), grouped(f(n))))
    lines = [F.lit("Data behind this metric:"),
             F.when(f("strategy").isNotNull() | f("confidence").isNotNull(), say(
                 "- Strategy: {}  (data confidence: {})", _shown(f"{report}.strategy", "None"),
                 _shown(f"{report}.confidence", "None"))),
             line("Definition", "definition")]
    if labelling:
        lines += [num("Total customers", "total_customers"),
                  num("One-time buyers (excluded)", "one_time_buyers"),
                  num("Too new to label (excluded)", "new_customers"),
                  num("Eligible cohort labelled", "eligible_customers"),
                  num("Labelled as churned", "churned_customers"),
                  F.when(f("cutoff_date").isNotNull(), say(
                      "- Holdout cutoff date: {}  (observation window: {} days)", f("cutoff_date"),
                      _shown(f"{report}.holdout_window_days", "?"))),
                  F.when(f("median_ipi_days").isNotNull(), say(
                      "- Median inter-purchase interval: {} days", f("median_ipi_days")))]
    else:
        lines += [line("Recommended aggregation grain", "recommended_aggregation"),
                  F.when(f("safe_horizon_months").isNotNull(), say(
                      "- Defensible forecast horizon: {} months", f("safe_horizon_months"))),
                  F.when(f("coefficient_of_variation").isNotNull(), say(
                      "- Per-row coefficient of variation: {}  (higher = noisier per-row predictions, "
                      "normal for mixed order sizes)", f("coefficient_of_variation")))]
    lists = [F.when(F.size(f(n)) > 0, F.concat(F.lit(f"- {label}: "), F.array_join(f(n), "; ")))
             for label, n in (("SUITABLE FOR", "suitable_for"), ("NOT SUITABLE FOR", "not_suitable_for"))]
    return F.when(F.col(report).isNotNull(), F.concat(F.concat_ws("\n", *lines, *lists), F.lit("\n\n")))


def _drivers(c: str) -> Column:
    return F.array_join(F.transform(F.slice(F.col(c), 1, 5), lambda f: F.concat(
        f["feature"], F.lit(" ("), f["importance"], F.lit(")"))), ", ")


def format_model_facts(runs: DataFrame) -> DataFrame:
    """One text of facts per run and model, with where the data came from."""
    fc, gf = F.col(f"{REV}.12_period_forecast"), growth_forecast()
    rows = lambda m, n: F.coalesce(grouped(F.col(f"{m}.{n}")), F.lit("?"))
    top = lambda m, label: F.when(F.size(f"{m}.top_features") > 0, F.concat(
        F.lit(f"- Top 5 {label}: "), _drivers(f"{m}.top_features")))
    rev = F.concat_ws(
        "\n", F.lit("REVENUE FORECAST MODEL (gradient-boosted regression):"),
        say("- Target: {}", _shown(f"{REV}.target", "revenue")),
        say("- MAPE: {}% (lower is better; <5% is excellent)", _shown(f"{REV}.MAPE_pct")),
        say("- R squared: {}", _shown(f"{REV}.R2")), say("- RMSE: {}", _shown(f"{REV}.RMSE")),
        say("- Forecast bias: {}", _shown(f"{REV}.forecast_bias")),
        say("- Trained on {} rows, tested on {}", rows(REV, "train_rows"), rows(REV, "test_rows")),
        F.when(F.size(fc) > 0, say(
            "- Next 12 periods forecast: avg ${}/period, range ${}-${}", _money2(_mean(fc)),
            _money2(F.array_min(fc)), _money2(F.array_max(fc)))),
        top(REV, "revenue drivers"))
    churn = F.concat_ws(
        "\n", F.lit("CUSTOMER CHURN MODEL (classification):"),
        say("- Dataset churn rate: {}%", _shown(f"{CHURN}.churn_rate_pct")),
        say("- ROC-AUC: {} (>0.8 is strong)", _shown(f"{CHURN}.ROC_AUC")),
        say("- F1 score: {}", _shown(f"{CHURN}.F1_Score")),
        say("- Precision: {}", _shown(f"{CHURN}.Precision")),
        say("- Recall: {}", _shown(f"{CHURN}.Recall")),
        say("- Trained on {} customers, tested on {}", rows(CHURN, "train_rows"), rows(CHURN, "test_rows")),
        top(CHURN, "churn predictors"))
    horizon = F.coalesce(F.col(f"{GROW}.forecast_horizon_months"), F.size(gf))
    shown = F.slice(gf, F.lit(1), F.greatest(horizon, F.lit(0)))
    grow = F.concat_ws(
        "\n", F.lit("GROWTH FORECAST MODEL:"), say("- Target: {}", _shown(f"{GROW}.target", "growth")),
        say("- MAPE: {}%", _shown(f"{GROW}.MAPE_pct")), say("- R squared: {}", _shown(f"{GROW}.R2")),
        say("- RMSE: {}", _shown(f"{GROW}.RMSE")),
        say("- Trained on {} months, tested on {}", _shown(f"{GROW}.train_months", "?"),
            _shown(f"{GROW}.test_months", "?")),
        F.when(F.size(gf) > 0, F.concat(
            say("- Next {} months forecast:\n", F.size(shown)),
            F.array_join(F.transform(shown, lambda p: F.concat(
                F.lit("    "), p["period"], F.lit(": $"), F.format_number(p["forecast"], 0))), "\n"))),
        top(GROW, "growth drivers"))
    part = lambda m, rep, lab, text: F.when(F.col(m).isNotNull(), F.struct(
        F.lit(m.split("_")[0]).alias("model"),
        F.concat(F.coalesce(_provenance(rep, lab), F.lit("")), text).alias("facts")))
    return runs.select("run_id", F.explode(F.array_compact(F.array(
        part(REV, f"{REV}.data_profile", False, rev), part(CHURN, f"{CHURN}.labelling", True, churn),
        part(GROW, f"{GROW}.data_profile", False, grow)))).alias("x")).select("run_id", "x.*")
