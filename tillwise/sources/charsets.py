"""Charsets of text files, found from byte statistics, and their decoding inside Spark.

One scan over the lines of all files gives each file's statistics: its first bytes, NUL bytes, lines that are
not UTF-8, bytes of the C1 range, and two kinds of words, those of Latin letters with an accented one
among them and those made of high bytes only, which are Arabic letters in windows-1256.  The
outcome is a table of files; only the number of files of each charset comes to the driver.

Bytes are decoded as ISO-8859-1 first, which keeps each byte as one character; a table from byte to
character then gives the characters of the other one-byte charsets, and UTF-8 is decoded from the
same bytes.  All of it is built from Spark's own functions.
"""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTF8, LATIN1, WESTERN, ARABIC, LITTLE, BIG = CHARSETS = [
    "UTF-8", "ISO-8859-1", "windows-1252", "windows-1256", "UTF-16LE", "UTF-16BE"]
WIDE = [LITTLE, BIG]
#: A file whose bytes are NUL by this share at least is written in two bytes a character.
NUL_SHARE = 0.02
#: Bytes that are Arabic or Persian letters in windows-1256, as a class of ISO-8859-1 characters.
ARABIC_BYTES = "\\x81\\x8D\\x8E\\x90\\x98\\x9A\\x9F\\xAA\\xC0-\\xD6\\xD8-\\xDF\\xE1\\xE3-\\xE6\\xEC\\xED\\xF0-\\xF3\\xF5\\xF6\\xF8\\xFA"
LETTERS = "A-Za-z\\x80-\\xFF"
ARABIC_WORD = f"(?<![{LETTERS}])[{ARABIC_BYTES}]{{2,}}(?![{LETTERS}])"
WESTERN_WORD = "[A-Za-z][\\xC0-\\xFF]|[\\xC0-\\xFF][A-Za-z]"


def canonical(name: str) -> str:
    """The charset's name here; any name that Python knows for it will do."""
    found = codecs.lookup(name).name
    for charset in CHARSETS:
        if codecs.lookup(charset).name == found:
            return charset
    return {"utf-8-sig": UTF8, "utf-16": LITTLE}.get(found, name)


def upper_half(charset: str) -> tuple[str, str]:
    """Characters of ISO-8859-1 and those that the same bytes stand for in a one-byte charset."""
    pairs = []
    for byte in range(0x80, 0x100):
        try:
            char = bytes([byte]).decode(charset)
        except UnicodeDecodeError:  # an unused byte stays a control character
            continue
        if char != chr(byte):
            pairs.append((chr(byte), char))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decoded(latin: Column, charset: Column | str) -> Column:
    """The text of bytes that were read as ISO-8859-1, in a one-byte charset or UTF-8."""
    if isinstance(charset, str):
        if charset == UTF8:
            return F.decode(F.encode(latin, LATIN1), UTF8)
        return latin if charset == LATIN1 else F.translate(latin, *upper_half(charset))
    out = F.when(charset == UTF8, decoded(latin, UTF8))
    for one in (WESTERN, ARABIC):
        out = out.when(charset == one, decoded(latin, one))
    return out.otherwise(latin)


def encoded(text: Column, charset: str) -> Column:
    """The bytes of a text in any of the charsets; of a character it does not have, a question mark."""
    if charset in (UTF8, *WIDE):
        return F.encode(text, charset)
    if charset != LATIN1:
        low, high = upper_half(charset)
        gone = "".join(c for c in low if c not in high)  # taken by other characters
        text = F.translate(text, high + gone, low + "?" * len(gone))
    return F.encode(F.regexp_replace(text, "[^\\x00-\\xFF]", "?"), LATIN1)


def file_charsets(spark: SparkSession, path: str) -> DataFrame:
    """Per file its charset, with the statistics that decide it; an empty file is UTF-8."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("bytes"), F.is_valid_utf8("value").alias("valid"),
        F.monotonically_increasing_id().alias("place"))
    latin = F.decode("bytes", LATIN1)
    nul = F.length(latin) - F.length(F.translate(latin, "\0", ""))
    high = F.when(~F.col("valid"), latin)  # the words of lines that are UTF-8 say nothing
    stats = lines.groupBy("file").agg(
        F.min_by(F.when(F.col("block") == 0, F.substring("bytes", 1, 64)),
                 F.when(F.col("block") == 0, F.col("place"))).alias("head"),
        F.sum(F.length("bytes")).alias("n_bytes"), F.sum(nul).alias("n_nul"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.coalesce(F.sum(F.regexp_count(high, F.lit("[\\x80-\\x9F]"))), F.lit(0)).alias("n_c1"),
        F.coalesce(F.sum(F.regexp_count(high, F.lit(ARABIC_WORD))), F.lit(0)).alias("n_arabic"),
        F.coalesce(F.sum(F.regexp_count(high, F.lit(WESTERN_WORD))), F.lit(0)).alias("n_western"))
    mark = F.hex(F.substring("head", 1, 2))
    wide = F.col("n_nul") >= F.greatest(F.col("n_bytes") * NUL_SHARE, F.lit(1))
    # without a mark, ASCII characters of the head have their NUL behind (little end first) or before
    pairs = F.sequence(F.lit(1), F.lit(63), F.lit(2))
    at = lambda k: F.hex(F.substring(F.col("head"), k, F.lit(1)))
    low = F.size(F.filter(pairs, lambda k: at(k) == "00"))
    behind = F.size(F.filter(pairs, lambda k: at(k + 1) == "00"))
    charset = F.when(mark == "FFFE", LITTLE).when(mark == "FEFF", BIG) \
        .when(wide & (behind >= low), LITTLE).when(wide, BIG) \
        .when(F.col("n_invalid") == 0, UTF8) \
        .when(F.col("n_arabic") > F.col("n_western"), ARABIC) \
        .when(F.col("n_c1") > 0, WESTERN).otherwise(LATIN1)
    return stats.select("file", charset.alias("charset"), "n_bytes", "n_nul", "n_invalid", "n_c1",
                        "n_arabic", "n_western")
