"""Personal data in texts: expressions propose spans, checksums confirm them, context scores them.

Base kinds (email, ip, card, phone) are found leftmost and without overlap per kind; spans that
fail their check are dropped and not tried again.  One more kind is added by the same method:
``iban``, cut to its country's length (of an unlisted country: to any group's end, the longest first)
and confirmed by mod-97, so that what follows an account number does not hide it.  A span's score starts from its kind and rises where one of the
kind's context words stands within ``CONTEXT`` code points; added kinds need a score of at least
``least_score`` and may not overlap base spans, and base spans always stay.  Offsets are code
points, ends exclusive.

Every expression is read in time linear in the text: local parts of addresses are found backwards
from the "@", digit runs are entered only at their first digit, and repeats are possessive.
Null text has no spans.  Rows are read one by one, so repeated rows and ids need no care.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban"]
CONTEXT = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
#: Characters of an account number of each country, without blanks (fixed values).
IBAN_LENGTHS = {country: int(n) for n, countries in (line.split(":") for line in """
15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV
22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST
26:IS TR|27:BI DJ FR GR IT MC MR SM|28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA
30:JO KW MU YE|31:MT SC|32:LC|33:RU""".strip().replace("\n", "|").split("|")) for country in countries.split()}
NOT_DIGIT = re.compile(r"[^0-9]")

#: Score without context, gain by context, and the context words of each kind (fixed values).
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3),
          "iban": (0.7, 0.3)}
NEAR = {"email": r"mail|contact|write|kontakt|correo|courriel",
        "ip": r"\bip\b|address|host|server|adresse|direcci",
        "card": r"card|visa|credit|karte|carte|tarjeta|payment",
        "phone": r"phone|call|\btel|mobile|fax|telefon|ruf|llam",
        "iban": r"iban|bank|account|konto|compte|cuenta"}
NEAR = {kind: re.compile(words, re.IGNORECASE) for kind, words in NEAR.items()}


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        # local parts hold no "@", so nothing before this one can begin a later match
        done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed account numbers, leftmost and without overlap."""
    done = 0
    for m in IBAN.finditer(text):
        start, limit = m.span(1)
        if start < done:
            continue
        at = [k for k in range(start, limit) if text[k] != " "]
        length = IBAN_LENGTHS.get(text[start:start + 2])
        for n in [length] if length else range(len(at), 14, -1):
            if n > len(at):
                continue
            end = at[n - 1] + 1
            after = text[end:end + 1]
            if not (after.isascii() and after.isalnum()) and mod97(text[start:end]):
                yield start, end
                done = end
                break


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind in the order of ``KINDS``, ascending."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for start, end in ibans(text):
        yield "iban", start, end


def scored(text: str, kind: str, start: int, end: int) -> float:
    base, gain = SCORES[kind]
    near = NEAR[kind].search(text, max(0, start - CONTEXT), start) \
        or NEAR[kind].search(text, end, min(len(text), end + CONTEXT))
    return base + gain if near else base


def find_spans(text: str, least_score: float) -> list[tuple[str, int, int, float]]:
    """Base spans, and added spans with a sufficient score that overlap no base span."""
    out, taken, reach = [], None, None
    for kind, start, end in proposals(text):
        score = scored(text, kind, start, end)
        if kind not in BASE_KINDS:
            if taken is None:  # base spans by start, with the furthest end so far
                taken = sorted((s, e) for _, s, e, _ in out)
                reach = list(itertools.accumulate((e for _, e in taken), max))
            before = bisect.bisect_left(taken, (end,))
            if score < least_score or before and reach[before - 1] > start:
                continue
        out.append((kind, start, end, score))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with spans replaced by their kind; of overlapping spans the earlier one names it."""
    parts, at = [], 0
    for kind, start, end, _score in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("score", pa.float64())]))


def personal_data(docs: DataFrame, text: str = "text", least_score: float = 0.5,
                  redact: bool = False) -> DataFrame:
    """``docs`` with ``pii_spans``; with ``redact`` the text has placeholders for its spans,
    without it the text column is dropped."""
    docs = docs.drop("pii_spans")
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in docs.columns if c != text or redact]
                          + [T.StructField("pii_spans", T.ArrayType(SPAN))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = [find_spans(t, least_score) if t else [] for t in texts]
            columns = {c: batch.column(c) for c in kept}
            if redact:
                columns[text] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)],
                                         batch.column(text).type)
            columns["pii_spans"] = pa.array(
                [[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields],
                                             [f.name for f in schema.fields])

    return docs.select(*kept, text).mapInArrow(scan, schema)


def spans_text(kinds: list[str]):
    """``kind:start:end`` of the spans of these kinds, comma-joined in found order."""
    wanted = F.filter("pii_spans", lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
