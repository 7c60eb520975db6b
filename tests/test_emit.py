import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.annual import annual
from quillgraph.operators import emit

TEXT = "\n".join([
    "Part 1: Filer's Positions Held Outside", "1.  Lakemont Club L.L.C.      Town, ST    LLC   Member   1/2000   Present", "2.",
]) + "\f" + "\n".join([
    "Part 6: Other Assets and Income", "INVESTMENT ACCOUNT #7", "1   LAKEMONT MILLS COM    N/A    $1,001 - $15,000   Dividends   $201 - $1,000",
    "2   STATE OF OZ REV BOND    N/A    $15,001 - $50,000   Interest   None (or less than $201)", "3   no band here",
]) + "\f" + "\n".join([
    "Part 7: Transactions", "1   LAKEMONT MILLS COM   Purchase   1/2/2024   $1,001 - $15,000", "2   LAKEMONT MILLS   Sale   2/2/2024   $15,001 - $50,000",
]) + "\f" + "\n".join([
    "Part 9: Gifts", "1.  Somebody   a watch",
]) + "\f" + "\n".join([
    "Part 8: Liabilities", "1.  Ann Poe          Litigation      Over $50,000,000   2023   N/A   on appeal", "2.  Harrow Bank          Mortgage     $50,001 - $100,000   2012   3.5%  30 years",
    "3.  City of Lake Revenue      Tax   $0 - $200   2020",
])


@pytest.mark.parametrize(("name", "org", "creditor"), [
    ("Sinclair Poe", "organization", "person"), ("ACME, INC", "organization", "organization"), ("Board of Trade", "agency", "agency"), ("Co. of Ann", "organization", "organization"),
    ("Coinbase", "organization", "person"), ("Visalia Poe", "organization", "person"), ("VISA", "organization", "organization"), ("Dashboard Ann", "agency", "agency"),
])
def test_kinds_of_names(spark, name, org, creditor):
    row = spark.range(1).select(emit.org_type(F.lit(name)).alias("o"), emit.creditor_type(F.lit(name)).alias("c")).first()
    assert (row["o"], row["c"]) == (org, creditor)


def test_columns_of_positions_and_debts(spark):
    row = spark.range(1).select(
        emit.position_org(F.lit("  A Club   Town")).alias("p"), emit.position_org(F.lit("Alone")).alias("q"), emit.liability_lead(F.lit("A  B     Loan; x")).alias("l"),
        emit.liability_lead(F.lit("A  B")).alias("m"), emit.liability_tail(F.lit("2019 4.25% x 5%")).alias("t"), emit.liability_tail(F.lit("due 1999 soon")).alias("u"), emit.liability_tail(F.lit("")).alias("v"),
    ).first()
    assert (row["p"], row["q"], tuple(row["l"]), tuple(row["m"])) == ("A Club", "Alone", ("A  B", "Loan; x"), ("A  B", None))
    assert (tuple(row["t"]), tuple(row["u"]), tuple(row["v"])) == (("2019", "4.25%", "x 5%"), ("1999", None, "soon"), (None, None, None))


@pytest.fixture(scope="module")
def run(spark):
    rows = annual(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")).withColumn("row", F.concat_ws("/", "part", F.col("row_index").cast("string")))
    rows = rows.cache()
    filings = spark.createDataFrame([(1, "F", "oge_278e", "https://filings.example/1.pdf", "0123456789abcdef99")], "doc_id long, filer string, form_type string, url string, digest string")
    entities = spark.createDataFrame([("m", "Lakemont Mills", "organization"), ("p", "Harrow Bank", "person")], "id string, name string, type string")
    edges = spark.createDataFrame([("F", "m", "traded", "published", None)], "source_id string, target_id string, relation string, publication_state string, batch_id string")
    cites = spark.createDataFrame([("traded|F|m", "part_7_transactions/1")], "edge_id string, disclosure_row_id string")
    return rows, filings, entities, edges, cites


def test_each_part_says_its_own(run):
    new, after, cited = emit.emitted(*run, "b9")
    e = {(r["relation"], r["target_id"]): r for r in after.collect()}
    names = {r["id"]: (r["name"], r["type"], r["surface_mode"]) for r in new.collect()}
    assert sorted(names.values()) == [
        ("Ann Poe", "person", "suppress"), ("City of Lake", "agency", "open"), ("Harrow Bank", "organization", "open"), ("Lakemont Club L.L.C.", "organization", "open"), ("STATE OF OZ", "agency", "open")]
    assert sorted(k for k, _ in e) == ["held_position", "holds_asset", "holds_asset", "income_from", "owes", "owes", "owes", "traded"]
    traded = e["traded", "m"]
    assert (traded["publication_state"], traded["batch_id"], traded["made"]) == ("published", None, False)
    assert json.loads(traded["metadata"])["transaction_type"] == "sale" and json.loads(e["income_from", "m"]["metadata"])["band_low"] == "201"
    owed = {names[t][0]: json.loads(r["metadata"]) for (k, t), r in e.items() if k == "owes"}
    assert owed["Ann Poe"] | {"part": 0} == {"amount_band": "Over $50,000,000", "band_low": "50000001", "liability_type": "Litigation", "year_incurred": "2023", "rate": "N/A", "term": "on appeal", "part": 0}
    got = {(r["edge_id"].split("|")[0], r["disclosure_row_id"], r["citation_url"], r["citation_ref"]) for r in cited.collect()}
    assert ("traded", "part_7_transactions/2", "https://filings.example/1.pdf#page=3", "0123456789abcdef::part_7_transactions::row2::p3") in got and len(got) == 8


def test_a_second_run_adds_nothing(spark, run):
    rows, filings, entities, edges, cites = run
    new, after, cited = emit.emitted(*run, "b9")
    known = entities.unionByName(new.select("id", "name", "type"))
    new2, after2, cited2 = emit.emitted(rows, filings, known, edges.unionByName(after.filter("made").select(*edges.columns)), cites.unionByName(cited.select(*cites.columns)), "b10")
    assert new2.count() == 0 and cited2.count() == 0 and after2.filter("made").count() == 0
    assert {r["batch_id"] for r in after2.collect()} == {None, "b9"}
