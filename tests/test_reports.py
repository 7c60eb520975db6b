import pytest

from quillgraph.model import Graph
from quillgraph.operators import edges, flow, graph, scrutiny

E = "id string, name string, type string, surface_mode string, publication_state string"
X = "id string, source_id string, target_id string, relation string, weight double, publication_state string"


@pytest.fixture(scope="module")
def g(spark):
    e = spark.createDataFrame([("f", "Filer", "person", "open", "published"), ("o", "Org", "organization", "open", "published"), ("h", "Hidden", "person", "alias", "published"),
                               ("s", "Gone", "person", "suppress", "published"), ("t", "Later", "organization", "open", "staged"), ("b1", "HR 12 Farm Act", "bill", "open", "published"), ("b2", "HR 3 Farm Aid", "bill", "open", "published")], E)
    x = spark.createDataFrame([("1", "f", "o", "traded", None, "published"), ("2", "f", "h", "owes", None, "published"), ("3", "f", "s", "owes", None, "published"), ("4", "f", "t", "traded", None, "published"),
                               ("5", "o", "f", "holds_asset", None, "published"), ("6", "f", "o", "owes", None, "staged")], X)
    c = spark.createDataFrame([("c1", "1", "oge_278t", "u1", "r2", 9, "row1"), ("c2", "1", "oge_278e", "u2", "r1", 9, "row2"), ("c3", "1", "oge_278t", "u3", None, None, "row9"), ("c4", "1", "fec_filing", "u4", "r", 1, None)]
                              + [(f"d{i}", str(i), "oge_278e", "u", "r", 1, "row1") for i in range(2, 7)], "id string, edge_id string, kind string, citation_url string, citation_ref string, page int, disclosure_row_id string")
    a = spark.createDataFrame([("b1", "congress.bill", "hr12-118", "HR 12")], "canonical_id string, source_system string, source_id string, surface_name string")
    return Graph(e, a, x, c)


def test_receipts_stand_by_page_and_only_between_open_ends(spark, g):
    rows = spark.createDataFrame([("row1", '{"transaction_type": "sale", "trade_date": "1/2/2024"}'), ("row2", "no json")], "id string, parsed string")
    ids = spark.createDataFrame([("f",), ("h",)], "id string")
    got = {(r["id"], r["edge_id"]): r for r in graph.receipts(g, ids, rows).collect()}
    assert set(got) == {("f", "1"), ("f", "5")}
    one = got["f", "1"]
    assert [(r["url"], r["page"]) for r in one["receipts"]] == [("u3", None), ("u2", 9), ("u1", 9)]
    assert [tuple(t) for t in one["transactions"]] == [(None, None, None, 9, "u2"), ("sale", "1/2/2024", None, 9, "u1")]
    assert got["f", "5"]["transactions"] == [] and set(r["edge_id"] for r in graph.receipts(g, ids, rows, preview=True).collect()) == {"1", "4", "5", "6"}


def test_a_bill_by_identifier_or_by_a_name_that_only_one_has(g):
    found = lambda text: [r["id"] for r in flow.bill_of(g.entities, g.aliases, text).collect()]
    assert found(" HR12-118 ") == ["b1"] and found("farm aid") == ["b2"] and found("farm") == found("") == found("nothing") == []


def test_nothing_sums_to_zero(spark):
    rows = spark.createDataFrame([], "entity string, contributed double, contracts double")
    assert [tuple(r) for r in flow.rollup(rows).collect()] == [(0.0, 0.0, 0)]


def test_registered_lobbyists_are_public_in_either_spelling(spark):
    people = spark.createDataFrame([(i, i, "person") for i in "abc"], "id string, name string, type string")
    aliases = spark.createDataFrame([("a", "senate_lda.registrant", "1"), ("b", "senate.lda.registrant", "2"), ("c", "news", "3")], "canonical_id string, source_system string, source_id string")
    assert {r["canonical_id"]: r["classification"] for r in scrutiny.verdicts(people, aliases).collect()} == {"a": "public", "b": "public", "c": "private"}


def test_a_hot_artifact_is_dealt_to_many_tasks(spark):
    """Pairs of parts are what the join goes by: no key holds more than a chunk with a chunk."""
    from pyspark.sql import functions as F

    hot = spark.range(1500).select(F.lit(1).alias("artifact_id"), F.format_string("%05d", "id").alias("canonical_id"))
    cold = spark.createDataFrame([(2, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "x"), (4, None)], "artifact_id int, canonical_id string")
    pairs = edges.mention_pairs(hot.unionByName(cold), chunk=100)
    assert pairs.filter("artifact_id = 1").count() == pairs.filter("artifact_id = 1").distinct().count() == 1500 * 1499 // 2
    assert [tuple(r) for r in pairs.filter("artifact_id > 1").collect()] == [(2, "a", "b")]
    plan = edges.mention_pairs(hot.unionByName(cold), chunk=100)._jdf.queryExecution().toString()
    assert "pa" in plan and "pb" in plan and "CartesianProduct" not in plan


def test_backfill_attaches_aliases_and_citations(spark):
    e = spark.createDataFrame([("w1", "One", "concept"), ("w2", "Two", "event"), ("w3", "Three", "concept"), ("p", "P", "person")], "id string, name string, type string")
    x = spark.createDataFrame([("w3", "p")], "source_id string, target_id string")
    a = spark.createDataFrame([("w2", "mention", "7")], "canonical_id string, source_system string, source_id string")
    m = spark.createDataFrame([(1, "w1"), (1, "w3"), (2, "w1"), (2, "w2"), (3, "w3"), (3, "p")], "artifact_id int, canonical_id string")
    art = spark.createDataFrame([(1, "news", "slug-1"), (1, "news", "slug-2")], "artifact_id int, kind string, slug string")
    assert [tuple(r) for r in edges.backfill_aliases(e, x, a, m).collect()] == [("w1", "mention", "1", "One")]
    got = {(r["edge_id"], r["citation_url"], r["citation_ref"]) for r in edges.backfill_citations(e, x, m, art, "https://r").collect()}
    assert got == {("mentioned_with|w1|w3", "https://r/slug-1", "1"), ("mentioned_with|w1|w2", "ref://artifact/2", "2")}


@pytest.mark.parametrize("name", ["dossier_receipts", "dossier_transactions"])
def test_lines_that_are_there_twice_are_cited_twice(spark, tmp_path, name):
    """Repeated lines, alike or with another flag, in tables that the SQL reads too."""
    import duckdb
    from pyspark.sql import functions as F

    from quillgraph.plans import registry
    from quillgraph.plans.views import STAR, table

    from .conftest import SF

    lines = table(spark, SF, "lineitem")
    other = lines.filter("l_linenumber % 2 = 0").limit(400).withColumn("l_returnflag", F.when(F.col("l_returnflag") == "A", "R").otherwise("A"))
    lines.unionByName(lines.limit(400)).unionByName(other).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in STAR:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path / t}.parquet{'/*.parquet' if t == 'lineitem' else ''}'")
    # lines that differ in their flag alone tie in the order of the SQL, so which of them is first is open
    columns = "id, relation, other, " + ("kind, url, ref, page" if name == "dossier_receipts" else "type, date, amount_band, page, url")
    want = con.sql(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
