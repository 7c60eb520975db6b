import json
import random
import urllib.error

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.model import Graph
from quillgraph.operators import dedup, edges, flow, gates, graph, scrutiny
from quillgraph.operators.components import connected_components, extend_components
from quillgraph.sources import files, rest
from quillgraph.streaming import events


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Acme, Inc.", "acme"), ("Société Générale S.A.", "societe generale s a"), ("LLC", "llc"), ("Inc. Co", "inc co"), ("  A   B  Ltd ", "a b"), ("Foo Corp Company", "foo"), ("", "")],
)
def test_normalize_name(spark, raw, want):
    assert one(spark, X.normalize_name(F.col("n")), n=raw) == want


def test_labels_never_show_hidden_names(spark):
    rows = [("a-1", "Open Name", "open"), ("b-22334455", "Secret Name", "alias"), ("c-3", "Gone Name", "suppress")]
    e = spark.createDataFrame(rows, "id string, name string, surface_mode string").withColumn("type", F.lit("person"))
    got = {r["id"]: r["label"] for r in gates.shown(e).collect()}
    assert got == {"a-1": "Open Name", "b-22334455": "Private donor #b2233445"}


def test_bands_are_complete(spark):
    for band, (low, high) in X.BANDS.items():
        assert tuple(one(spark, X.band_bounds(F.col("b")), b=band)) == (low, high)
    assert one(spark, X.band_bounds(F.col("b")), b="$9 - $10") is None


def test_small_functions(spark):
    assert one(spark, X.transaction_type(F.col("t")), t="Purchas3") == "purchase"
    assert one(spark, X.transaction_type(F.col("t")), t="dividend") is None
    assert one(spark, X.identity_key(F.col("s"), F.col("i")), s="sec.cik", i=" 000123 ") == "sec_cik:123"
    assert one(spark, X.identity_key(F.col("s"), F.col("i")), s="fec.committee", i="C123") is None
    assert one(spark, X.identity_key(F.col("s"), F.col("i")), s="fec.affiliated_committee", i="C00000001") is None
    assert one(spark, X.last_first(F.col("n")), n="Ann Van Doe") == "DOE, ANN VAN"
    assert one(spark, X.notes_value(F.col("n"), "party"), n="state=NY;party=Democratic") == "Democratic"
    assert one(spark, X.vote_direction(F.col("v")), v="Present") is None
    assert one(spark, X.party(F.col("v")), v="dfl") == "Democratic"
    assert one(spark, X.accession_url("u", F.col("c"), F.col("a")), c="0012", a="1-2-3") == "u/12/123/1-2-3-index.htm"
    assert one(spark, X.uuid_of(F.col("u")), u="ref://news/0123abcd-0123-0123-0123-0123456789ab") == "0123abcd-0123-0123-0123-0123456789ab"
    assert one(spark, X.recipient_type(F.col("t")), t="") == "organization"


def test_components_on_random_graphs(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(999, 999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in list(parent)}
    df = spark.createDataFrame(links, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    half = connected_components(spark.createDataFrame(links[:60], "src long, dst long"))
    assert {r["node"]: r["component"] for r in extend_components(half, spark.createDataFrame(links[60:], "src long, dst long")).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


def test_upsert_policies(spark):
    old = spark.createDataFrame([("a", "b", "r", 5.0), ("x", "y", "r", 1.0)], "source_id string, target_id string, relation string, weight double")
    new = spark.createDataFrame([("a", "b", "r", 1, 2.0), ("a", "b", "r", 1, 2.0), ("a", "b", "r", 2, None), ("n", "m", "r", 9, 3.0)], "source_id string, target_id string, relation string, ref long, amount double")
    got = lambda p: {r["source_id"]: r["weight"] for r in edges.upsert(old, new, p).collect()}
    assert got("sum") == {"a": 9.0, "x": 1.0, "n": 3.0}
    assert got("first_sighting") == {"a": 7.0, "x": 1.0, "n": 3.0}
    assert got("count_refs") == {"a": 7.0, "x": 1.0, "n": 1.0}
    assert got("constant") == {"a": 1.0, "x": 1.0, "n": 1.0}
    with pytest.raises(ValueError):
        edges.upsert(old, new, "other")


@pytest.fixture(scope="module")
def small(spark):
    e = [("p1", "Rep One", "person", "open", "published"), ("k1", "One Committee", "pac", "open", "published"), ("d1", "Acme PAC", "pac", "open", "published"),
         ("o1", "Acme", "organization", "open", "published"), ("o2", "Beta", "organization", "alias", "published"), ("o3", "Gamma", "organization", "suppress", "published"),
         ("a1", "Agency", "agency", "open", "published"), ("s1", "Staged", "organization", "open", "staged")]
    x = [("e1", "d1", "k1", "contributes_to", 10.0), ("e2", "d1", "o1", "affiliated_with", None), ("e3", "d1", "o2", "affiliated_with", None), ("e4", "k1", "p1", "affiliated_with", None),
         ("e5", "o1", "a1", "holds_contract", 7.0), ("e6", "o3", "p1", "contributes_to", 3.0), ("e7", "o3", "a1", "holds_contract", 2.0), ("e8", "o2", "p1", "contributes_to", -1.0),
         ("e9", "o1", "o1", "affiliated_with", 1.0)]
    ent = spark.createDataFrame(e, "id string, name string, type string, surface_mode string, publication_state string").withColumn("batch_id", F.lit("b"))
    ed = spark.createDataFrame(x, "id string, source_id string, target_id string, relation string, weight double").withColumn("publication_state", F.lit("published")).withColumn("batch_id", F.lit("b"))
    al = spark.createDataFrame([("p1", "party", "Democratic", "Rep One"), ("p1", "bioguide", "M1", "Rep One"), ("o1", "mention", "m1", "Acme Inc")], "canonical_id string, source_system string, source_id string, surface_name string")
    ci = spark.createDataFrame([("c1", "e5", "article_permalink", "u1"), ("c2", "e1", "fec_filing", "")], "id string, edge_id string, kind string, citation_url string")
    return Graph(ent, al, ed, ci, spark.createDataFrame([("p1", "public")], "canonical_id string, classification string"))


def test_model1_moves_committee_money_and_hides_the_suppressed(small):
    got = [tuple(r) for r in flow.model1(small, "Democratic").collect()]
    assert got == [("o1", "Acme", "organization", 10.0, 7.0)]


def test_subgraph_needs_citations_and_open_ends(spark, small):
    start = spark.createDataFrame([("o1",)], "id string")
    nodes, ed = graph.subgraph(small, start, 2)
    assert {r["id"] for r in nodes.collect()} == {"o1", "a1"}
    assert {r["id"] for r in ed.collect()} == {"e5"}
    hidden, _ = graph.subgraph(small, spark.createDataFrame([("o3",)], "id string"), 1)
    assert hidden.count() == 0
    out = json.loads(graph.cytoscape(nodes, ed).first()["graph"])
    assert len(out["nodes"]) == 2 and out["edges"][0]["data"]["source"] == "o1"


def test_dossier_and_search_gates(small):
    assert graph.dossier(small, "o3").count() == 0 and graph.dossier(small, "s1").count() == 0
    row = graph.dossier(small, "o1").first()
    assert row["articles"] == ["u1"] and "holds_contract" in json.loads(row["connections"])
    assert graph.search(small, "gamma").count() == 0 and graph.search(small, "staged").count() == 0
    assert [r["id"] for r in graph.search(small, "acme").collect()][0] == "o1"
    assert graph.search(small, "staged", preview=True).count() == 1


def test_merge_keeps_invariants_and_is_idempotent(spark, small):
    m = spark.createDataFrame([("d1", "k1"), ("o3", "o1")], "id string, survivor string")
    out = dedup.merge(small, m)
    assert {r["id"] for r in out.entities.collect()} == {"p1", "k1", "o1", "o2", "o3", "a1", "s1"}  # o3 is stricter and stays
    assert out.edges.filter("id = 'e1'").count() == 0  # a self-loop that the merge made
    assert out.edges.filter("id = 'e9'").count() == 1  # one that was there before
    again = dedup.merge(out, m)
    assert sorted(map(str, again.edges.select("id", "weight").collect())) == sorted(map(str, out.edges.select("id", "weight").collect()))


def test_type_gate(spark):
    cases = [("person", "organization", False, False), ("person", "unknown", False, False), ("pac", "organization", False, False), ("organization", "concept", False, True),
             ("agency", "unknown", False, True), ("person", "person", False, False), ("person", "person", True, True), ("person", "candidate", True, True),
             ("candidate", "organization", True, False), ("pac", "unknown", False, False), ("pac", "pac", False, True), ("person", "pac", True, False), ("organization", "pac", True, True)]
    df = spark.createDataFrame(cases, "a string, b string, i boolean, w boolean")
    assert df.filter(dedup.types_agree(F.col("a"), F.col("b"), F.col("i")) != F.col("w")).count() == 0


def test_scrutiny_fails_closed(small):
    got = {r["canonical_id"]: r["decision"] for r in scrutiny.verdicts(small.entities, small.aliases.filter("source_system <> 'bioguide'")).collect()}
    assert got["p1"] == "suppress" and got["o1"] == "surface"


def test_publish_is_blocked_until_all_are_decided(small):
    e, _, lacking = dedup.publish(small.entities, small.edges, small.scrutiny, "b")
    assert lacking.count() == 7 and e.filter("publication_state = 'staged'").count() == 1
    e, _, lacking = dedup.publish(small.entities, small.edges, small.entities.select(F.col("id").alias("canonical_id")), "b")
    assert lacking.count() == 0 and e.filter("publication_state = 'staged'").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("H1AB00001|2024|2024|C00000001|H|P|1\njunk\n\nX|2024|2024|C00000001|H|P|1\nH1AB00001|2024|2024|H1AB00001|H|P|1\n")
    assert [tuple(r) for r in files.linkage(spark, str(tmp_path / "l.txt"), 2024).collect()] == [("H1AB00001", "C00000001", "P", 2024)]
    (tmp_path / "v.xml").write_text('<rollcall><recorded-vote><legislator name-id="M1" party="D" state="NY">Doe</legislator><vote>Aye</vote></recorded-vote><recorded-vote><legislator name-id="M2" party="R" state="TX">Roe</legislator><vote>No</vote></recorded-vote></rollcall>')
    assert {tuple(r) for r in files.roll_call(spark, str(tmp_path / "v.xml")).collect()} == {("M1", "Aye"), ("M2", "No")}
    (tmp_path / "r.json").write_text(json.dumps([{"id": {"bioguide": "M1"}, "name": {"first": "Ann", "last": "Doe", "nickname": "Annie"}, "terms": [{"start": "2021", "party": "Democrat"}, {"start": "2019", "party": "X"}]}]))
    r = files.roster(spark, str(tmp_path / "r.json")).first()
    assert r["label"] == "Ann Doe" and r["party"] == "Democratic" and r["variants"] == ["Ann", "Doe", "Annie", "Doe, Ann", "Ann Doe", "Annie Doe"] and r["candidates"] == []
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1", "name": "N", "formerNames": [{"name": "Old"}], "filings": {"recent": {"form": ["10-K", "ZZ", "8-K"], "accessionNumber": ["a", "b"], "filingDate": ["1", "2", "3"]}}}))
    assert [r["accession"] for r in files.submissions(spark, str(tmp_path / "s.json")).collect()] == ["a"]
    assert files.former_names(spark, str(tmp_path / "s.json")).first()["name"] == "Old"
    (tmp_path / "a.json").write_text('{"Award ID": "A1", "Total Obligated Amount": "x", "Award Amount": "12.5"}\n{"Award ID": "A2"}\n')
    assert [r["obligation"] for r in files.awards(spark, str(tmp_path / "a.json")).orderBy("award").collect()] == [12.5, None]


def test_rest_backs_off_and_ends(spark):
    waits, answers = [], [429, 404]

    def opener(url):
        code = answers.pop(0)
        raise urllib.error.HTTPError(url, code, "", {"Retry-After": "3"}, None)

    assert rest.fetch("u", opener, sleep=waits.append) is None and waits == [3.0]
    assert [(p.first, p.last) for p in rest.PagedReader({"url": "u", "pages": "25"}).partitions()] == [(1, 11), (11, 21), (21, 26)]


def test_streams_agree_with_batches(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), df.schema)
    for fn, name in ((events.tumbling, "t"), (events.sliding, "s")):
        q = fn(stream, lateness="60 days").writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, fn(df).collect()))


def test_fold_is_compatibility_decomposition(spark):
    import unicodedata

    from quillgraph.functions.text import fold

    names = ["Nguyễn Thị", "Čeněk ǍǏǑ", "ﬁne ﬂow", "ＦＵＬＬ width", "Ⅷ ½", "e\u0301t\u00e9", "Straße Łódź", "ｶﾅ", "№ 5™", "plain", "", "ĳssel Ǆ", "한글 names"]
    want = {n: "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)).lower() for n in names}
    got = {r["n"]: r["f"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", fold(F.col("n")).alias("f")).collect()}
    assert got == want


def test_a_second_run_of_the_same_records_changes_nothing(spark):
    kind = "source_id string, target_id string, relation string, ref string, amount double, at int"
    old = spark.createDataFrame([("a", "b", "r", 7.0)], "source_id string, target_id string, relation string, weight double")
    rows = [("a", "b", "r", "1", 5.0, 2), ("a", "b", "r", "1", 9.0, 1), ("a", "b", "r", "2", None, 1), ("c", "d", "r", "1", 5.0, 1), ("c", "d", "r", "1", 5.0, 2), ("e", "f", "r", None, 4.0, 1)]
    new = spark.createDataFrame(rows, kind)
    for policy, want in (("first_sighting", {"a": 16.0, "c": 5.0, "e": 0.0}), ("count_refs", {"a": 9.0, "c": 1.0, "e": 0.0})):
        show = lambda df: {r["source_id"]: r["weight"] for r in df.collect()}
        once = edges.upsert(old, new, policy, order="at")
        assert show(once) == want
        ledger = edges.counted(None, new)
        assert show(edges.upsert(once, new, policy, ledger, order="at")) == want
        more = spark.createDataFrame([("a", "b", "r", "3", 1.0, 1), ("a", "b", "r", "1", 100.0, 1)], kind)
        assert show(edges.upsert(once, more, policy, ledger, order="at"))["a"] == want["a"] + 1.0
        assert edges.counted(ledger, more).count() == ledger.count() + 1


def test_edges_are_made_once_for_both_ends(spark):
    """Incidence, invariants and what rests on them read the edges in one scan, whatever the edges took to make."""
    from quillgraph.model import Graph
    from quillgraph.operators import dedup
    from quillgraph.operators.edges import incident

    rows = [("1", "a", "b"), ("2", "a", "a"), ("3", None, "b"), ("4", "c", None), ("4", "c", "d"), (None, "x", "y")]
    edges = spark.createDataFrame(rows, "id string, source_id string, target_id string").groupBy("id", "source_id", "target_id").count()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(incident(edges)).count("Aggregate") == 1
    got = sorted((str(r["id"]), str(r["node"]), str(r["other"])) for r in incident(edges).collect())
    assert got == sorted([("1", "a", "b"), ("1", "b", "a"), ("2", "a", "a"), ("3", "None", "b"), ("4", "c", "None"), ("4", "c", "d"), ("4", "d", "c"), ("None", "x", "y"), ("None", "y", "x")])
    cites = spark.createDataFrame([("1",), ("1",), ("4",), ("9",), ("9",), (None,)], "edge_id string")
    ids = spark.createDataFrame([("e",)], "id string")
    g = Graph(ids, ids.limit(0), edges, cites)
    # two edges bear the id 4; an edge without an id has no citation, nor a citation without one an edge
    want = {"entities": 1, "aliases": 0, "edges": 6, "citations": 6, "uncited_edges": 3, "orphan_citations": 3, "self_loops": 1}
    assert {r["name"]: r["value"] for r in dedup.invariants(g).collect()} == want
    assert plan(dedup.invariants(g)).count("count(1) AS count") <= 1
    none = Graph(ids, ids, edges.limit(0), cites.limit(0))
    assert {r["value"] for r in dedup.invariants(none).filter("name NOT IN ('entities', 'aliases')").collect()} == {0}
