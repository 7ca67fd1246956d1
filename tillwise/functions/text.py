"""Text columns: chunks, trimming, routing of questions, checks of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.exprs import any_word_pattern, col
from tillwise.functions.vocab import (
    CASUAL_PATTERNS, EVIDENCE_TAGS, HEDGES, INTENT_WORDS, LEAK_MARKERS, LEAK_OPENINGS,
    STRONG_HEDGES,
)

# White space of every script
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(k) for k in range(0x2000, 0x200b))
SPACE = r"(?U)\s+"


def strip(c) -> Column:
    """Without white space (of any script) at either end."""
    return F.trim(col(c), F.lit(BLANKS))


def words(c) -> Column:
    """Words of a text; none for a text of white space."""
    return F.array_remove(F.split(col(c), SPACE), "")


def chunks(w: Column, size: int = 400, overlap: int = 80) -> Column:
    """Windows of ``size`` words; the last one reaches the end; short scraps are dropped.

    ``w`` should be a stored column of words, because each window reads it.
    """
    step = max(1, size - overlap)
    n = F.size(w)
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1),
                      lambda k: F.array_join(F.slice(w, k * step + 1, F.lit(size)), " "))
    return F.when(n > 0, F.filter(cut, lambda t: F.length(t) > 30))


def chunk_id(source, idx, text) -> Column:
    """source_idx_hash, the hash over source, index and the first 50 characters."""
    s, k = col(source), col(idx).cast("string")
    digest = F.md5(F.concat_ws("_", s, k, F.substring(col(text), 1, 50)))
    return F.concat_ws("_", s, k, F.substring(digest, 1, 8))


def trim_at_sentence(c, limit: int = 1200) -> Column:
    """At most ``limit`` characters, cut at the last sentence end past 60 %."""
    t = col(c)
    cut = F.substring(t, 1, limit)
    back = F.reverse(cut)
    out = None
    for sep in (". ", ".\n", "! ", "? "):
        at = F.locate(sep[::-1], back)                     # 1-based from the end
        pos = F.length(cut) - at - 1                       # 0-based start of the separator
        hit = (at > 0) & (pos > limit * 0.6)
        value = F.concat(strip(F.substr(cut, F.lit(1), pos + 1)), F.lit(" ..."))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(F.length(t) <= limit, t).otherwise(
        out.otherwise(F.concat(strip(cut), F.lit(" ..."))))


def intent_route(c) -> Column:
    """First intent whose keyword occurs; NULL for a general question."""
    t, out = F.lower(col(c)), None
    for name, keys in INTENT_WORDS.items():
        hit = t.rlike(any_word_pattern(keys))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def casual_message(c) -> Column:
    t = strip(F.coalesce(col(c), F.lit("")))
    return (F.length(t) > 0) & (F.length(t) < 80) & t.rlike("(?i)" + "|".join(CASUAL_PATTERNS))


def strip_reasoning(c) -> Column:
    """Without think blocks; text before a closing tag that was never opened goes too."""
    t = F.regexp_replace(col(c), r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return strip(F.regexp_replace(t, r"(?is)^.*</think>", ""))


def reasoning_leak(c) -> Column:
    """The text opens with, or is dense with, visible self-talk."""
    t = col(c)
    head = F.lower(F.ltrim(t, F.lit(BLANKS)))
    opens = head.rlike("^(" + any_word_pattern(LEAK_OPENINGS) + ")")
    early = F.lower(F.substring(t, 1, 600))
    hits = sum((F.contains(early, F.lit(m)).cast("int") for m in LEAK_MARKERS), F.lit(0))
    return F.coalesce(opens | (hits >= 3), F.lit(False))


def answer_verdict(c) -> Column:
    """NULL when an answer is fit to use, else the reason to reject it."""
    clean = strip_reasoning(c)
    return (
        F.when(col(c).isNull() | (strip(c) == ""), "empty response")
        .when(F.length(clean) < 30, "response too short after stripping reasoning tags")
        .when(reasoning_leak(clean), "response is chain-of-thought, not finished prose"))


def speculation_flag(c) -> Column:
    return F.concat(F.lit(" "), F.lower(col(c)), F.lit(" ")).rlike(any_word_pattern(HEDGES))


def strong_speculation(c) -> Column:
    return F.concat(F.lit(" "), F.lower(col(c)), F.lit(" ")).rlike(any_word_pattern(STRONG_HEDGES))


def evidence_bullets(c, keep: int = 4) -> Column:
    """Bullet lines as an array of (text, tag): last known tag wins, "inferred" without one.

    Strong hedging demotes observed and derived claims.
    """
    def bare(line):
        t = strip(line)
        mark = t.rlike(r"^(- |\* |• )")
        number = t.rlike(r"^\d[.):]") & (F.length(t) > 2)
        return strip(F.when(mark | number, F.substr(t, F.lit(3))).otherwise(t))

    tags = "|".join(EVIDENCE_TAGS)

    def parsed(line):
        found = F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"\[([a-zA-Z]+)\]"), F.lit(1)),
                                     F.lower), lambda x: x.isin(EVIDENCE_TAGS))
        text = F.array_join(words(F.regexp_replace(line, rf"(?i)\[({tags})\]", "")), " ")
        text = F.regexp_replace(text, r"[ .,;:…]+$", "")
        text = F.when((text == "") | text.rlike(r"[.!?]$"), text).otherwise(
            F.concat(text, F.lit(".")))
        tag = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("inferred"))
        tag = F.when(tag.isin("observed", "derived") & strong_speculation(text), "inferred").otherwise(tag)
        return F.struct(text.alias("text"), tag.alias("tag"))

    lines = F.filter(F.transform(F.split(col(c), "\n"), bare), lambda t: F.length(t) >= 5)
    return F.slice(F.transform(lines, parsed), 1, keep)


def answer_key(question, role, category) -> Column:
    """Same question, role and category give the same key."""
    return F.md5(F.concat_ws("|", col(question), col(role), F.coalesce(col(category), F.lit("_"))))
