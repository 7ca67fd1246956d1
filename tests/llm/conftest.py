import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, toxicity string, "
          "n_tokens string, pii_spans int, print string, node int, kept string, score string")


def messy_rows():
    """Null, repeated and clashing values, empty and very long texts, copies and near copies."""
    base = " ".join(f"w{k * 7919 % 1009}" for k in range(120))
    near = base.replace("w7 ", "other ", 1)
    long = " ".join(f"t{k * k % 5003}" for k in range(30_000))
    letters = "x" * 300_000 + " end"
    personal = ("Mail a.b+c@host.example.org, ip 10.0.0.255 or 1.2.3.456.7, card 4539 5787 6362 1486, "
                "call +1 (212) 555-0100; IBAN DE89 3704 0044 0532 0130 00 " + "9" * 50)
    texts = [(1, base), (1, base), (1, near), (2, base), (None, base), (3, near + " tail"), (4, None),
             (5, ""), (None, None), (6, " \t\n\x0b\x0c\r "), (7, "one two"), (8, "one two"),
             (9, long), (10, long + " more"), (11, letters), (12, personal), (13, "@" * 3000 + "a@b.c"),
             (14, "line a\nline a\n\nline b\n"), (15, "Ünï cödé 中文 😀 Σ word's <|endoftext|> x"),
             (16, base + "\n" + base), (17, "1.2.3.4" * 30), (18, "a " * 400), (19, "é" * 50)]
    return [(d, t, None if d == 2 else "en", ["hot", None, "s1"][k % 3], None, "x", "y", 3, "z", 1, "k", "s")
            for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def scratch(spark):
    from tillwise.llm.staging import Scratch

    s = Scratch(spark)
    yield s
    s.drop()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(df, expected):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(map(tuple, expected), key=repr)
