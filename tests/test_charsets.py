"""Charsets of files, found and decoded."""

import pytest
from pyspark.sql import functions as F

ROWS = {
    "utf8.csv": ("utf-8", ["naïve café", "مرحبا بالعالم", "plain"]),
    "marked.csv": ("utf-8-sig", ["Größe", "上海", "x"]),
    "latin 1.csv": ("latin-1", ["café crème", "señor", "plain"]),
    "western.csv": ("cp1252", ["price 5 €", "“quoted”", "naïve – yes"]),
    "arabic.csv": ("cp1256", ["مرحبا بالعالم", "عميل جديد", "شركة النور"]),
    "little.csv": ("utf-16", ["مرحبا, بالعالم", "上海 ج", "plain"]),
    "bare.csv": ("utf-16-le", ["上上上", "Њ jeem ج", "plain"]),
    "big.csv": ("utf-16-be", ["مرحبا", "上海", "plain"]),
}
FOUND = {"utf8.csv": "UTF-8", "marked.csv": "UTF-8", "latin 1.csv": "ISO-8859-1", "western.csv": "windows-1252",
         "arabic.csv": "windows-1256", "little.csv": "UTF-16LE", "bare.csv": "UTF-16LE", "big.csv": "UTF-16BE"}


def write(folder, names, end="\n"):
    expected = set()
    for f, name in enumerate(names):
        charset, texts = ROWS[name]
        lines = ["k,v"] + [f'{10 * f + k},"{t}"' for k, t in enumerate(texts)]
        (folder / name).write_bytes((end.join(lines) + end).encode(charset))
        expected |= {(10 * f + k, t) for k, t in enumerate(texts)}
    return expected


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_all_charsets_in_one_folder(spark, tmp_path, end):
    from tillwise.sources.charsets import file_charsets
    from tillwise.sources.tables import read_csv_encoded

    expected = write(tmp_path, list(ROWS), end)
    found = file_charsets(spark, str(tmp_path)).collect()
    assert {r["file"].split("/")[-1].replace("%20", " "): r["charset"] for r in found} == FOUND
    rows = read_csv_encoded(spark, str(tmp_path), "k int, v string").collect()
    assert {(r.k, r.v) for r in rows} == expected and len(rows) == len(expected)
    rows = read_csv_encoded(spark, str(tmp_path)).collect()  # types and names found
    assert {(r.k, r.v) for r in rows} == expected


@pytest.mark.parametrize("name", list(ROWS))
def test_one_charset_found_and_named(spark, tmp_path, name):
    from tillwise.sources.tables import read_csv_encoded

    expected = write(tmp_path, [name])
    for encoding in (None, ROWS[name][0]):
        if name == "little.csv" and encoding:
            continue  # a mark that is told to be part of the text is not asked for
        rows = read_csv_encoded(spark, str(tmp_path), "k int, v string", encoding).collect()
        assert {(r.k, r.v) for r in rows} == expected


def test_without_named_files_and_without_broadcast(spark, tmp_path, monkeypatch):
    import tillwise.sources.tables as S

    monkeypatch.setattr(S, "NAMED_FILES", 0)
    monkeypatch.setattr(S, "BROADCAST_FILES", 0)
    expected = write(tmp_path, list(ROWS))
    rows = S.read_csv_encoded(spark, str(tmp_path), "k int, v string").collect()
    assert {(r.k, r.v) for r in rows} == expected and len(rows) == len(expected)


def test_names_quotes_and_empty_files(spark, tmp_path):
    from tillwise.sources.tables import read_csv_encoded

    (tmp_path / "a.csv").write_bytes('رقم,"اسم, كامل"\n1,"نص ""طويل"", هنا"\n2,\n'.encode("cp1256"))
    rows = read_csv_encoded(spark, str(tmp_path))
    assert rows.columns == ["رقم", "اسم, كامل"]
    assert [tuple(r) for r in rows.orderBy("رقم").collect()] == [(1, 'نص "طويل", هنا'), (2, None)]
    (tmp_path / "b.csv").write_bytes(b"")
    assert read_csv_encoded(spark, str(tmp_path), "k int, v string").count() == 2


def test_a_charset_is_told_from_all_lines(spark, tmp_path):
    """The only line that tells stands far behind the first ones, in another split."""
    from tillwise.sources.charsets import file_charsets

    plain = "".join(f"{k},plain ascii text\n" for k in range(60_000))
    (tmp_path / "a.csv").write_bytes(("k,v\n" + plain).encode() + "9,عميل قديم\n".encode("cp1256"))
    (tmp_path / "b.csv").write_bytes(("k,v\n" + plain).encode() + "9,café\n".encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = file_charsets(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 1
        assert {r["file"][-5:]: r["charset"] for r in found.collect()} == {
            "a.csv": "windows-1256", "b.csv": "ISO-8859-1"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_paths_on_the_driver(spark, tmp_path):
    from tillwise.sources.tables import read_csv_encoded

    write(tmp_path, ["utf8.csv", "arabic.csv", "latin 1.csv", "western.csv"])
    df = read_csv_encoded(spark, str(tmp_path), "k int, v string")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "BroadcastHashJoin" in plan and "Python" not in plan


def test_encoded_is_the_inverse(spark):
    from tillwise.sources.charsets import ARABIC, LATIN1, WESTERN, decoded, encoded

    texts = {ARABIC: "مرحبا پچژ – café", WESTERN: "€ “x” Ž", LATIN1: "é"}
    for charset, text in texts.items():
        df = spark.createDataFrame([(text,)], "t string").select(encoded(F.col("t"), charset).alias("b"))
        row = df.select("b", decoded(F.decode("b", LATIN1), charset).alias("t"),
                        decoded(F.decode("b", LATIN1), F.lit(charset)).alias("u")).first()
        assert bytes(row.b) == text.encode(charset) and row.t == row.u == text


def test_characters_a_charset_does_not_have(spark):
    from tillwise.sources.charsets import ARABIC, LATIN1, WESTERN, encoded

    text = "ñ ¤ 上 é € ع"
    for charset in (ARABIC, WESTERN, LATIN1):
        row = spark.createDataFrame([(text,)], "t string").select(encoded(F.col("t"), charset).alias("b")).first()
        assert bytes(row.b) == text.encode(charset, "replace")
