"""Rules on whole texts, judged together for each host.

Failures of the rules are summed by host.  A host with few documents has an unsure rate, so rates
are shrunk by a beta prior fitted to the rates of all hosts (method of moments).  A document is
kept if it passes the base rules and its host's shrunk rate is at most ``worst_rate``.

Null text has no words.  A null host is a host of its own.  Rows are judged one by one, so repeated
rows and ids need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.session import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def text_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def repeated_words(hashes: Column) -> Column:
    """Words in windows found twice or more, given the hashes of a text's windows.

    Positions are sorted by hash, equal neighbours are repeats, and each repeat adds the words up
    to the next one.  Texts whose windows all differ are told apart first, by a distinct count.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        hits = let(pairs, lambda p: F.filter(F.transform(p, lambda x, i: F.when(
            (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"])),
            lambda x: x.isNotNull()))
        return let(F.sort_array(hits), lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))
               .otherwise(F.lit(0)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word and symbol counts in place of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    windows = lambda w: F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(
            F.array().cast("array<bigint>"))
    found = let(text_words(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(windows(w)).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))
    out = docs.select(*[c for c in docs.columns if c != text], found.alias("_words"),
                      let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
                      .cast("long").alias("n_dup_lines"), symbols.cast("long").alias("n_symbols"))
    kept = [c for c in out.columns if c not in ("_words", "n_dup_lines", "n_symbols")]
    return out.select(*kept, "_words.n_words", "_words.word_chars", "n_symbols", "n_dup_lines",
                      "_words.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Named failures: too few words, repeats, odd word lengths, symbols, repeated lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"few_words": F.col("n_words") < 10,
            "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
            "word_length": ~(F.col("word_chars") / n).between(2, 15),
            "symbols": F.col("n_symbols") > 0.2 * n,
            "repeated_lines": F.col("n_dup_lines") * 20 > n}


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """Documents, failures by rule, the shrunk failure rate of each host, and the prior.

    The prior's mean is the rate over all documents; its strength, in pseudo-documents, follows
    from the variance of the hosts' rates beyond chance and is kept within 1 and 10 000.
    """
    failed = rules()
    any_rule = F.lit(False)
    for rule in failed.values():
        any_rule = any_rule | rule
    counts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(any_rule.cast("long")).alias("host_failed"),
        *[F.sum(rule.cast("long")).alias(f"host_{name}") for name, rule in failed.items()])
    rate = F.col("host_failed") / F.col("host_docs")
    prior = counts.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("d"),
                       F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("noise"))
    mean = F.col("f") / F.col("d")
    chance = mean * (1 - mean)
    # v = chance * (noise + (1 - noise) / (s + 1)): sampling noise plus the spread between hosts
    spread = F.greatest(F.col("v") - chance * F.col("noise"), F.lit(0.0))
    strength = F.when(spread > 0, chance * (1 - F.col("noise")) / spread - 1)
    prior = prior.select(F.coalesce(mean, F.lit(0.0)).alias("prior_rate"), F.least(F.lit(1e4), F.greatest(
        F.lit(1.0), F.coalesce(strength, F.lit(1e4)))).alias("prior_docs"))
    return counts.join(F.broadcast(prior), F.lit(True)).withColumn(  # one row
        "host_rate", (F.col("host_failed") + F.col("prior_rate") * F.col("prior_docs"))
        / (F.col("host_docs") + F.col("prior_docs")))


def judge_hosts(docs: DataFrame, host: str = "source", text: str = "text",
                worst_rate: float = 0.5) -> DataFrame:
    """``docs`` without the text, with measures, the host's numbers, ``base_failed`` and ``kept``.

    Texts are read once: the measures, a few numbers a document, are checkpointed, since both the
    hosts' sums and the documents' verdicts need them.
    """
    own = [c for c in docs.columns if c in (host, text, "doc_id")]
    measured = checkpointed(measures(docs.select(*own), text))
    hosts = host_rates(measured, host).select(
        "host", "host_docs", "host_failed", "host_rate",
        (F.col("host_rate") > worst_rate).alias("host_rejected"))
    return (measured.join(hosts, F.col(host).eqNullSafe(F.col("host")))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
            .drop("host"))
