"""Account numbers before other capital words, numbers and dates."""

import pytest

DE, GB = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"


@pytest.mark.parametrize("text, found", [
    ("IBAN DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]),
    (f"{DE} BIC X", [DE]), (f"{GB} 2024-01-02", [GB]), (f"{GB} I sent", [GB]), (f"{GB} 2500 EUR", [GB]),
    (f"{DE} {GB} BIC COBADEFFXXX", [DE, GB]), (f"AB12 CDEF GH34 IJKL {DE} OK", [DE]), (f"{DE}.", [DE]),
    (f"{DE}0", []), (f"{DE}x", []), (f"x{DE}", []), ("DE88370400440532013000 BIC X", []),
    ("ZZ65 1234 5678 9012 BIC", ["ZZ65 1234 5678 9012"])])
def test_ibans(text, found):
    from tillwise.llm.pii import find_spans, redacted

    spans = find_spans(text, 0.5)
    assert [text[s:e] for kind, s, e, _ in spans if kind == "iban"] == found
    out = redacted(text, [s for s in spans if s[0] == "iban"])
    assert not any(iban in out for iban in found) and out.count("<IBAN>") == len(found)


def test_pipeline_stage_redacts(spark):
    from corpus_pipeline import COLUMNS, personal_data_removal

    docs = spark.createDataFrame([(1, f"IBAN {DE} BIC COBADEFFXXX", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    row = personal_data_removal(spark, docs, "").select(*COLUMNS).first()
    assert row["text"] == "IBAN <IBAN> BIC COBADEFFXXX" and row["n_chars"] == len(row["text"])
