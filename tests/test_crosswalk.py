import random

from quillgraph.model import Graph
from quillgraph.operators import crosswalk

Q = "id long, from_id string, to_id string, reason string, applied_at timestamp"
E = "id string, name string, type string, surface_mode string, publication_state string, batch_id string"


def entities(spark, modes):
    return spark.createDataFrame([(i, i, "organization", m, "published", "b") for i, m in modes.items()], E)


def brute(rows, modes):
    rank = {"open": 0, "alias": 1, "suppress": 2}
    verdict, link = {}, {}
    for i, a, b in sorted(rows):
        if a not in modes or b not in modes:
            verdict[i] = "missing"
        elif a == b:
            verdict[i] = "same"
        elif rank[modes[a]] > rank[modes[b]]:
            verdict[i] = "refused"
        elif a in link:
            verdict[i] = "duplicate"
        else:
            verdict[i], link[a] = "apply", (b, i)
    for start in list(link):
        seen, x = [], start
        while x in link and x not in seen:
            seen.append(x)
            x = link[x][0]
        if seen and x == start:
            last = max(seen, key=lambda n: link[n][1])
            verdict[link.pop(last)[1]] = "cycle"
    out = {}
    for i, a, _ in rows:
        x = a
        while verdict[i] == "apply" and x in link:
            x = link[x][0]
        out[i] = (verdict[i], x if verdict[i] == "apply" else None)
    return out


def test_chains_refusals_and_cycles(spark):
    modes = dict.fromkeys("abcdefghij", "open") | {"s": "suppress", "t": "suppress", "l": "alias"}
    rows = [(1, "a", "b"), (2, "b", "c"), (3, "d", "e"), (4, "e", "d"), (5, "s", "c"), (6, "f", "s"), (7, "s", "t"), (8, "l", "s"), (9, "x", "a"), (10, "g", None), (11, "h", "h"),
            (12, "a", "i"), (13, "i", "d"), (14, "l", "j"), (15, "c", "l")]
    got = crosswalk.plan(spark.createDataFrame([(*r, "why", None) for r in rows], Q), entities(spark, modes))
    want = brute(rows, modes)
    assert {r["id"]: (r["verdict"], r["survivor"]) for r in got.collect()} == want
    assert want[1] == ("apply", "t") and want[4] == ("cycle", None) and want[5] == ("refused", None) and want[13] == ("apply", "e")
    assert {r["verdict"]: r["rows"] for r in crosswalk.dry_run(got).collect()}["refused"] == 2


def test_random_queues(spark):
    rng = random.Random(4)
    modes = {f"n{i}": rng.choice(["open", "open", "open", "alias", "suppress"]) for i in range(80)}
    rows = [(i, f"n{rng.randrange(85)}", f"n{rng.randrange(85)}") for i in range(160)] + [(1000 + i, f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [(2000 + i, f"l{i}", f"l{i + 1}") for i in range(40)]
    modes |= {f"c{i}": "open" for i in range(9)} | {f"l{i}": "open" for i in range(41)}
    got = crosswalk.plan(spark.createDataFrame([(*r, None, None) for r in rows], Q), entities(spark, modes))
    assert {r["id"]: (r["verdict"], r["survivor"]) for r in got.collect()} == brute(rows, modes)


def test_applied_rows_are_frozen_and_a_rerun_finds_nothing(spark):
    e = entities(spark, {"a": "open", "b": "open", "c": "open", "s": "suppress"})
    al = spark.createDataFrame([("a", "x", "1", "A"), ("b", "x", "2", "B")], "canonical_id string, source_system string, source_id string, surface_name string")
    ed = spark.createDataFrame([("1", "a", "s", "lobbies", 2.0), ("2", "b", "s", "lobbies", 3.0)], "id string, source_id string, target_id string, relation string, weight double")
    ci = spark.createDataFrame([("k1", "1", "u1"), ("k2", "2", "u2")], "id string, edge_id string, citation_url string")
    sc = spark.createDataFrame([("a", "private"), ("b", "public")], "canonical_id string, classification string")
    queue = spark.createDataFrame([(1, "a", "b", "same firm", None), (2, "b", "c", "renamed", None), (3, "s", "c", "no", None)], Q)
    planned = crosswalk.plan(queue, e)
    g, after = crosswalk.apply(Graph(e, al, ed, ci, sc), queue, planned, "2026-01-02 00:00:00")
    assert {r["id"] for r in g.entities.collect()} == {"c", "s"}
    assert [(r["source_id"], r["weight"]) for r in g.edges.collect()] == [("c", 5.0)] and g.citations.select("edge_id").distinct().count() == 1
    assert {r["canonical_id"] for r in g.scrutiny.collect()} == {"c"} and {r["canonical_id"] for r in g.aliases.collect()} == {"c"}
    kept = {r["id"]: (r["from_id_frozen"], r["to_id_frozen"], r["applied_at"] is not None) for r in after.collect()}
    assert kept == {1: ("a", "b", True), 2: ("b", "c", True), 3: (None, None, False)}
    assert [r["verdict"] for r in crosswalk.plan(after, g.entities).collect()] == ["refused"]


def test_empty_queue(spark):
    assert crosswalk.plan(spark.createDataFrame([], Q), entities(spark, {"a": "open"})).collect() == []
