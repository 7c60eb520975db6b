from pyspark.sql import functions as F

from quillgraph.operators import resolve, vectors
from quillgraph.sources import files


def test_a_near_vector_needs_a_shared_word_and_persons_more(spark):
    kind = "id long, name string, type string, embedding array<double>"
    known = spark.createDataFrame([(1, "Acme Mills", "organization", [1.0, 0.0]), (2, "Ann Lee", "person", [1.0, 0.0]), (3, "Far Off", "organization", [0.0, 1.0]), (4, "No Vector", "organization", None)], kind)
    asked = spark.createDataFrame([
        (10, "ACME Rail", "organization", [0.9, 0.3]), (11, "Other Name", "organization", [1.0, 0.0]), (12, "Ann Poe", "person", [0.88, 0.475]), (13, "Ann Poe", "person", [1.0, 0.1]),
        (14, "no vector, Inc.", "organization", None), (15, "Far off", "organization", [1.0, 0.1]), (16, "Far Off", "agency", [0.0, 1.0]), (17, "", "organization", [0.0, 0.0]),
    ], "tag long, name string, type string, embedding array<double>")
    got = {r["tag"]: (r["id"], r["how"]) for r in resolve.resolve_vector(asked, known).collect()}
    none = (None, None)
    assert got == {10: (1, "vector"), 11: none, 12: none, 13: (2, "vector"), 14: (4, "name"), 15: (3, "name"), 16: none, 17: none}


def test_nearest_by_small_chunks_is_exact(spark):
    rows = [(i, i % 2, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)] + [(99, 0, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    show = lambda d: sorted(map(tuple, d.select("a", "b", "similarity", "rank").collect()))
    assert show(vectors.nearest(df, "label", 5, chunk=7)) == show(vectors.nearest(df, "label", 5))
    assert 99 not in {r[0] for r in show(vectors.nearest(df, "label", 5))}


def test_upsert_makes_one_entity_for_equal_records(spark):
    e = spark.createDataFrame([("a", "Acme", "organization")], "id string, name string, type string")
    al = spark.createDataFrame([("a", "sys", "1", "Acme")], "canonical_id string, source_system string, source_id string, surface_name string")
    new = spark.createDataFrame([("sys", "1", "Else", "pac"), ("sys", "2", "ACME, Inc.", "organization"), ("sys", "3", "New Co", "pac"), ("two", "9", "NEW", "pac"), ("two", None, None, "pac")], "system string, source_id string, name string, type string")
    got = resolve.upsert_entities(new, e, al)
    rows = {(r["system"], r["source_id"]): (r["id"], r["how"]) for r in got.collect()}
    assert rows["sys", "1"] == ("a", "alias") and rows["sys", "2"] == ("a", "name") and rows["sys", "3"] == rows["two", "9"] and rows["two", None][1] == "new"
    assert resolve.new_entities(got).count() == 2 and resolve.new_aliases(got, al).count() == 4


def test_seeds(spark):
    one = files.anchors(spark, [{"label": "B", "entity_type": "person", "priority_domain": "x", "committee_ids": ["C1"]}, {"label": "A", "entity_type": "agency", "priority_domain": "y"}])
    two = files.anchors(spark, [{"label": "B", "entity_type": "person", "priority_domain": "y"}])
    both = resolve.replace_seeds(one, two)
    assert {r["priority_domain"]: r["n"] for r in resolve.seeds_per_domain(both).collect()} == {"y": 2}
    assert [r["label"] for r in resolve.seeds(one).collect()] == ["A", "B"] and resolve.seeds(one, holding="committee_ids", persons=False).count() == 0
    assert resolve.seeds(one, domains=["x"], types=["person"]).count() == 1 and resolve.seeds(one, but=("x",)).count() == 1
    assert resolve.recipient_key(F.lit(None), F.lit(" "), F.lit(3)) is not None


def test_chunks_of_a_large_block_are_dealt_once(spark):
    """Exact in small blocks, large ones and with ids of either kind; a chunk of a large block is not copied for each other one."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 7 == 0], [0.0] * 3 if i == 11 else rng.normal(size=3).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, block string, embedding array<double>")
    unit = {i: np.array(e) / max(np.linalg.norm(e), 1e-9) for i, _, e in rows}
    pairs = {(i, j, round(float(unit[i] @ unit[j]), 9)) for i, a, _ in rows for j, b, _ in rows if a == b and i != j and 11 not in (i, j)}
    near = vectors.within(df, "block", 0.8, chunk=6)
    got = [tuple(r) for r in near.collect()]
    close = lambda rows: sorted((a, b, round(s, 7)) for a, b, s in rows)
    assert close(got) == close(p for p in pairs if p[2] >= 0.8)
    assert "CartesianProduct" in near._jdf.queryExecution().executedPlan().toString()
    others = df.filter("id % 3 = 0").withColumn("id", F.concat(F.lit("k"), "id"))
    show = lambda d: sorted((r["a"], r["b"], round(r["similarity"], 7), r["rank"]) for r in d.collect())
    for kwargs in ({}, {"among": others}, {"minimum": 0.9}):
        few, all_ = vectors.nearest(df, "block", 2, chunk=4, **kwargs), vectors.nearest(df, "block", 2, **kwargs)
        assert "CartesianProduct" in few._jdf.queryExecution().executedPlan().toString() and show(few) == show(all_)
