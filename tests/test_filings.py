import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import filings
from quillgraph.functions.issuer import BOND_MARKS, GLUED_FORMS, SECURITY_WORDS, issuer_name

NAMES = ("LAKEMONT MILLS", "Harrow & Pike", "ORCHARD VALLEY WTR", "TESSELLATE", "Juniper Rail Co.")


@pytest.mark.parametrize("name", NAMES)
def test_what_follows_a_name_is_taken_off(name):
    for word in sorted(SECURITY_WORDS):
        assert issuer_name(f"{name} {word}") == name
        assert issuer_name(f"{name} {word.upper()} {word},") == name
    for mark in sorted(BOND_MARKS):
        assert issuer_name(f"{name} {mark} whatever 7") == name
    for tail in ("Due June 2031", "2.5% bonds", "11 % x", "OID x", "REG S x", "DTD0601", "FC0901", "CALL@100", "6/1/31 x", "SERIES B", "CLASS AA", "(ADR (NEW))", "refunding x", "2031 DB 2029", "   $5"):
        assert issuer_name(f"{name} {tail}") == name, tail
    for lead in ("* ", "-- ", "***"):
        assert issuer_name(lead + name) == name


@pytest.mark.parametrize("form", sorted(GLUED_FORMS))
def test_run_on_names_are_taken_apart(form):
    assert issuer_name(f"TESSELLATE{form}") == f"TESSELLATE {GLUED_FORMS[form]}"
    assert issuer_name(f"TESSELLATE{form}PAIREDCTF") == f"TESSELLATE {GLUED_FORMS[form]}"


def test_issuer_edges():
    assert [issuer_name(x) for x in (None, "", "  ", "***", "Com")] == ["", "", "", "", "Com"]
    assert issuer_name("MILL CTF PRTNRSHP CTF PARTN") == "MILL CTF PARTN" and issuer_name("APPLE COMPUTER INC COM") == "APPLE INC"
    assert issuer_name("LODGE TRUST REIT II") == "LODGE TRUST REIT II" and issuer_name("LODGE TRUST A B") == "LODGE TRUST"
    assert issuer_name("broken (bracket") == "broken (bracket" and issuer_name("odd )") == "odd )"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Mill", "LAKE", "com", "CL", "A", "DB", "2025", "(x)", "4.5%", "SER", "DUE", "PARTN", "***", "  ", "REG", "S"]), max_size=8))
def test_issuer_of_an_issuer_is_itself(words):
    once = issuer_name(" ".join(words))
    assert issuer_name(once) == once
    assert once == once.strip()


def test_issuer_column(spark):
    df = spark.createDataFrame([(1, "LAKEMONT MILLS COM"), (2, None)], "i int, d string")
    assert [r["x"] for r in df.orderBy("i").select(filings.issuer(F.col("d")).alias("x")).collect()] == ["LAKEMONT MILLS", ""]


def test_rows_of_a_periodic_report(spark):
    text = "\n".join([
        "Page 3", "7", "LAKEMONT MILLS COM", "   purchase  4/05/2024  no  $1,001 - $15,000", "HARROW  SALE 4/06/2024 $15,001 \u2013 $50,000", "",
        "JUNIPER qqqqqqqq 4/07/2024 yes Over $50,000,000", "TESSELLATE sale 4/8/24 $1,001 - $15,000", "TESSELLATE sale 4/8/2024 $1,001 - $15,001", "x $1,001 - $15,000 and more",
    ])
    docs = spark.createDataFrame([(1, "cover\f" + text), (2, None), (3, "")], "doc_id long, text string")
    got = filings.transactions(docs).orderBy("at").collect()
    assert [(r["page"], r["row_index"], r["transaction_type"], r["trade_date"], r["amount_band"], r["confidence"]) for r in got] == [
        (2, 8, "purchase", "4/05/2024", "$1,001 - $15,000", "high"), (2, 8, "sale", "4/06/2024", "$15,001 - $50,000", "high"), (2, 8, None, "4/07/2024", "Over $50,000,000", "low"),
    ]
    assert got[0]["description"] == "LAKEMONT MILLS COM" and got[1]["description"].endswith("HARROW") and got[2]["reason"] == "type_not_recognized"
    summary = {r["transaction_type"]: (r["high"], r["low"], r["total"]) for r in filings.confidence_summary(filings.transactions(docs).fillna("?", ["transaction_type"]), "transaction_type").collect()}
    assert summary == {"purchase": (1, 0, 1), "sale": (1, 0, 1), "?": (0, 1, 1), None: (2, 1, 3)}
    edges = filings.traded_edges(filings.transactions(docs).withColumn("filer", F.lit("f")), "filer").collect()
    assert len(edges) == 2 and ("LAKEMONT MILLS", 1001, "1#page=2") in [(e["target"], e["bounds"]["low"], e["citation_url"]) for e in edges]
