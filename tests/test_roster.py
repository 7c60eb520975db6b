import random

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import crosswalk, resolve, roster, scrutiny

M = "member string, label string, candidates array<string>, variants array<string>, party string, at int"
E = "id string, name string, type string, surface_mode string"
A = "canonical_id string, source_system string, source_id string, surface_name string"


def plain(members, entities, aliases):
    """By evidence, then by members in order: each takes the first entity that is left."""
    held, out = {}, {}
    for c, s, i, _ in aliases:
        held.setdefault(c, set()).add((s, i))
    taken = set()
    for level in range(3):
        for member, label, candidates, _, _, _ in sorted(members, key=lambda m: (m[5], m[0])):
            if level == 0:
                found = [c for c in sorted(held) if ("bioguide", member) in held[c]]
            elif level == 1:
                found = [c for x in candidates for c in sorted(held) if ("fec.candidate", x) in held[c]]
            else:
                found = [i for i, name, kind, mode in sorted(entities) if name.lower() == label.lower() and kind == "person" and mode == "open"
                         and all(s == "bioguide" and x == member for s, x in held.get(i, ()) if s in roster.AUTHORITATIVE)]
            free = [c for c in found if c not in taken]
            if member not in out and free:
                out[member] = (free[0], roster.HOW[level])
                taken.add(free[0])
    return {m[0]: out.get(m[0], (None, "created")) for m in members}


def check(spark, members, entities, aliases):
    got = roster.resolve_roster(spark.createDataFrame(members, M), spark.createDataFrame(entities, E), spark.createDataFrame(aliases, A)).collect()
    assert {r["member"]: (None if r["how"] == "created" else r["id"], r["how"]) for r in got} == plain(members, entities, aliases)
    ids = [r["id"] for r in got]
    assert len(set(ids)) == len(ids) == len(members)
    return {r["member"]: (r["id"], r["how"]) for r in got}


def test_contested_entities(spark):
    e = [("1", "Ann Lee", "person", "open"), ("2", "Ann Lee", "person", "open"), ("3", "Bo Ray", "person", "suppress"), ("4", "Cy Poe", "organization", "open"), ("5", "Dee Fox", "person", "open"),
         ("6", "Eve Oak", "person", "open"), ("7", "Else", "person", "open")]
    a = [("5", "sec.cik", "9", ""), ("6", "bioguide", "M6", ""), ("7", "fec.candidate", "H7", ""), ("7", "bioguide", "M9", "")]
    m = [("M1", "Ann Lee", [], [], None, 1), ("M2", "ann lee", [], [], None, 2), ("M3", "Ann Lee", [], [], None, 3), ("M4", "Bo Ray", [], [], None, 4), ("M5", "Cy Poe", [], [], None, 5),
         ("M6", "Nobody", ["H7"], [], None, 6), ("M7", "Dee Fox", [], [], None, 7), ("M8", "Eve Oak", ["H7", "H8"], [], None, 8), ("M9", "Any", [], [], None, 9)]
    got = check(spark, m, e, a)
    assert got["M1"] == ("1", "name_fragment") and got["M2"] == ("2", "name_fragment") and got["M3"][1] == got["M8"][1] == "created" and got["M9"] == ("7", "bioguide")
    why = roster.refusals(spark.createDataFrame(m, M), spark.createDataFrame(e, E), spark.createDataFrame(a, A))
    assert {r["reason"]: r["pairs"] for r in why.collect()} == {"surface_mode_not_open": 1, "type_not_person": 1, "foreign_external_id:sec.cik": 1, "foreign_bioguide": 1}


def test_random_rosters(spark):
    rng = random.Random(2)
    for seed in range(2):
        e = [(str(i), f"name {rng.randrange(8)}", rng.choice(["person", "person", "pac"]), rng.choice(["open", "open", "alias"])) for i in range(40)]
        a = list({(str(rng.randrange(40)), s, f"{s[0]}{rng.randrange(25)}", "") for s in ("bioguide", "fec.candidate", "sec.cik") for _ in range(14)})
        m = [(f"b{i}", f"Name {rng.randrange(8)}", [f"f{rng.randrange(25)}" for _ in range(rng.randrange(3))], [], None, rng.randrange(9)) for i in range(30)]
        check(spark, m, e, a)


def test_aliases_are_added_once(spark):
    m = spark.createDataFrame([("M1", "Ann Lee", ["H1"], ["Ann Lee", "LEE, ANN"], "Democratic", 1)], M)
    e, a = spark.createDataFrame([("1", "Ann Lee", "person", "open")], E), spark.createDataFrame([("1", "news", "x", "Ann")], A)
    new = roster.roster_aliases(roster.resolve_roster(m, e, a), m, a)
    assert {(r["canonical_id"], r["source_system"], r["source_id"]) for r in new.collect()} == {
        ("1", "bioguide", "M1"), ("1", "fec.candidate", "H1"), ("1", "party", "M1"), ("1", roster.VARIANTS, "M1:ann-lee"), ("1", roster.VARIANTS, "M1:lee-ann")}
    both = a.unionByName(new)
    again = roster.resolve_roster(m, e, both)
    assert [(r["id"], r["how"]) for r in again.collect()] == [("1", "bioguide")] and roster.roster_aliases(again, m, both).count() == 0


def test_bridges(spark):
    a = [("m1", "fec.candidate", "H1", ""), ("m1", "fec.candidate", "S1", ""), ("m2", "fec.candidate", "H2", ""), ("m3", "fec.candidate", "H3", ""), ("m4", "fec.candidate", "H3", ""),
         ("k1", "fec.committee", "C1", ""), ("k1", "fec.disbursement.recipient", "C1", ""), ("k2", "fec.committee", "C2", ""), ("k3", "fec.committee", "C3", ""), ("k4", "fec.committee", "C3", ""),
         ("m2", "fec.committee", "C5", ""), ("k6", "fec.committee", "C6", ""), ("k7", "fec.committee", "C7", "")]
    links = [("C1", "S1", "D", 2018), ("C1", "H1", "P", 2020), ("C1", "H1", "P", 2022), ("C2", "H1", "P", 2020), ("C2", "H2", "J", 2020), ("C3", "H1", "P", 2020), ("C4", "H1", "P", 2020),
             ("C5", "H2", "A", 2020), ("C6", "H3", "P", 2020), ("C7", "H2", None, 2020), ("C8", "H9", "P", 2020), ("C9", None, "P", 2020)]
    edges = spark.createDataFrame([("k7", "m2", "affiliated_with")], "source_id string, target_id string, relation string")
    got = roster.committee_bridge(spark.createDataFrame(links, "committee string, candidate string, designation string, cycle int"), spark.createDataFrame(a, A), edges).collect()
    assert {r["committee"]: r["status"] for r in got} == {
        "C1": "new", "C2": "ambiguous_member", "C3": "ambiguous_committee", "C4": "not_in_graph", "C5": "self", "C6": "ambiguous_member", "C7": "reused"}
    one = next(r for r in got if r["committee"] == "C1")
    assert (one["source_id"], one["target_id"], one["candidate"], one["designation"], one["cycles"]) == ("k1", "m1", "H1", "P", [2018, 2020, 2022])


def test_spellings_of_a_member(spark):
    row = spark.range(1).select(
        X.name_variants(F.lit("Bernard"), F.lit("Oak "), F.lit("J."), F.lit("Bernie"), F.lit("Bernard Oak"), F.lit("Jr."), F.expr("array(named_struct('first', null, 'last', 'Elm'), named_struct('first', 'Ben', 'last', ''))")).alias("a"),
        X.name_variants(F.lit(None), F.lit("Oak"), F.lit(""), F.lit(None), F.lit(None)).alias("b"), X.designation_label(F.lit("D")).alias("c"), X.designation_label(F.lit("Q")).alias("d"),
        X.contributor_type(F.lit("Super fund")).alias("e"), X.contributor_type(F.lit(None)).alias("f"),
    ).first()
    assert row["a"] == ["Bernard Oak", "Bernard", "Oak", "J.", "Bernie", "Jr.", "Oak, Bernard", "Bernie Oak", "Bernard J. Oak", "Bernard Elm"]
    assert (row["b"], row["c"], row["d"], row["e"], row["f"]) == (["Oak"], "leadership PAC", "Q", "pac", "organization")


def test_types_follow_most_hints(spark):
    e = spark.createDataFrame([("1", "unknown"), ("2", "unknown"), ("3", "person"), ("4", "unknown"), ("5", "unknown")], "id string, type string")
    a = spark.createDataFrame([("1", "Event"), ("1", "event "), ("1", "concept"), ("2", "concept"), ("2", None), ("2", ""), ("3", "event"), ("4", "person")], "canonical_id string, kind_hint string")
    after = resolve.retyped(e, a)
    assert {r["id"]: r["type"] for r in after.collect()} == {"1": "event", "2": "unknown", "3": "person", "4": "unknown", "5": "unknown"}
    assert {r["type"]: tuple(r)[1:] for r in resolve.type_shares(e, after).collect()} == {"unknown": (4, 3, 80.0, 60.0), "person": (1, 1, 20.0, 20.0), "event": (0, 1, 0.0, 20.0)}


def test_the_first_list_counts(spark):
    one, two = spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("a", 0), ("b", 5), ("b", 4)], "id string, n int")
    assert sorted(map(tuple, resolve.first_of(one, two).collect())) == [("a", 1), ("b", 4)]


def test_votes_make_an_edge_a_direction(spark):
    v = spark.createDataFrame([("M1", "b", "Yea", "r2", "u2", 2), ("M1", "b", "aye", "r1", "u1", 1), ("M1", "b", "No", "r3", "u3", 3), ("M1", "b", "Present", "r4", "u4", 0), ("M2", "b", "Yea", "r1", "u1", 1), ("M3", "b", "Nay", "r1", "u1", 1)],
                              "member string, bill string, vote string, ref string, url string, at int")
    a = spark.createDataFrame([("1", "bioguide", "M1", ""), ("3", "bioguide", "M3", "")], A)
    x = spark.createDataFrame([("3", "b", "voted_against")], "source_id string, target_id string, relation string")
    assert {tuple(r) for r in resolve.vote_edges(v, a, x).collect()} == {("1", "b", "voted_for", "r1", "u1"), ("1", "b", "voted_against", "r3", "u3")}


def test_curated_queues_by_exact_name(spark):
    e = spark.createDataFrame([("1", "Ann", "person"), ("2", "Ann", "person"), ("3", "Ann", "organization"), ("4", "Mill", "organization"), ("5", "Oak", "organization")], "id string, name string, type string")
    x = spark.createDataFrame([("2", "5", "lobbies"), ("2", "4", "affiliated_with")], "source_id string, target_id string, relation string")
    c = spark.createDataFrame([("Ann", "Mill", "u", "r"), ("Ann", "Oak", "u", "r"), ("Ann", "mill", "u", "r"), ("Bo", "Mill", "u", "r")], "person string, company string, citation_url string, citation_ref string")
    assert {(r["person"], r["company"]): (r["source_id"], r["target_id"], r["status"]) for r in resolve.affiliations(c, e, x).collect()} == {
        ("Ann", "Mill"): ("2", "4", "reused"), ("Ann", "Oak"): ("2", "5", "new"), ("Ann", "mill"): ("2", None, "company_not_found"), ("Bo", "Mill"): (None, "4", "person_not_found")}
    q = spark.createDataFrame([(1, None, None, "5", "4")], "id long, from_id string, to_id string, from_id_frozen string, to_id_frozen string")
    m = spark.createDataFrame([("Oak", "Mill", "a"), ("Mill", "Ann", "b"), ("Mill", "Oak", "c"), ("Mill", "Nobody", "d"), ("Ann", "Ann", "e")], "from_name string, to_name string, reason string")
    assert {(r["from_name"], r["to_name"]): r["status"] for r in crosswalk.queued(m, q, e, x).collect()} == {
        ("Oak", "Mill"): "skipped_existing", ("Mill", "Ann"): "queued", ("Mill", "Oak"): "skipped_existing", ("Mill", "Nobody"): "skipped_missing", ("Ann", "Ann"): "skipped_missing"}


def test_sweeps_decide_once(spark):
    e = spark.createDataFrame([(i, i, "person", "b1" if i < "c" else "b2") for i in "abcd"] + [("o", "o", "pac", "b1")], "id string, name string, type string, batch_id string")
    a = spark.createDataFrame([("b", "bioguide", "M", ""), ("d", "bioguide", "N", "")], A)
    log = spark.createDataFrame([("a", "scrutiny.llm.v1"), ("b", "by hand")], "canonical_id string, decided_by string")
    near = spark.createDataFrame([("d",)], "id string")
    run = lambda **k: {r["canonical_id"]: r["decision"] for r in scrutiny.sweep(e, a, log, **k)[0].collect()}
    assert run() == {"b": "surface", "c": "suppress", "d": "surface"} and run(batch="b1") == {"b": "surface"} and set(run(members=True)) == {"b", "d"}
    assert set(run(limit=2, near=near)) == {"d", "b"} and run(limit=1) == {"b": "surface"}
    assert tuple(scrutiny.sweep(e, a, log, classifier=lambda r: F.lit("unknown"))[1].first()) == (3, 2, 1, 0)
