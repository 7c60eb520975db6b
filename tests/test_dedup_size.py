"""Dedup over names that very many bear: what is accepted is linked by few pairs, what is told is counted by kinds."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_name
from quillgraph.operators import dedup
from quillgraph.operators.components import connected_components

E = "id string, name string, norm string, type string, surface_mode string, publication_state string"
A = "canonical_id string, source_system string, source_id string, surface_name string"


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(5)
    names = ["red bolt", "hot ring", "new anvil", "12", "lone"]
    types, modes = ["person", "candidate", "unknown", "organization", "pac", "concept", None], ["open", "open", "alias", None]
    rows = []
    for i in range(160):
        name = rng.choice(names[:4])
        rows.append((f"e{i:03d}", name, name, rng.choice(types), rng.choice(modes), rng.choice(["published", "staged"])))
    rows += [("solo", "lone", "lone", "pac", "open", "published"), ("gone", "old bolt", "old bolt", "pac", "open", "published")]
    had = [(f"e{i:03d}", "sec.former_name", str(k), f"{rng.choice(names[:4])} Inc") for k, i in enumerate(rng.choices(range(160), k=60))]
    had += [("solo", "sec.former_name", "s", "Lone"), ("nobody", "sec.former_name", "n", "red bolt"), ("gone", "news", "g", "red bolt")]
    return spark.createDataFrame(rows, E), spark.createDataFrame(had, A)


def _brute(crowd):
    """Pairs of a former and a present bearer of a name, of unlike ids, each once."""
    entities, aliases = crowd
    rows = {r["id"]: r for r in entities.collect()}
    had = aliases.filter("source_system = 'sec.former_name'").select("canonical_id", normalize_name(F.col("surface_name")).alias("n")).collect()
    return {(min(a["canonical_id"], i), max(a["canonical_id"], i), a["n"]) for a in had for i, r in rows.items() if r["norm"] == a["n"] and a["n"] != "12" and i != a["canonical_id"]}


def test_former_names_give_every_pair_once(crowd):
    entities, aliases = crowd
    got = [(r["a"], r["b"], r["evidence"]) for r in dedup.former_name_pairs(aliases, entities).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(crowd)
    parts = dedup._former_met(dedup._former_members(aliases, entities), each=50)
    assert {(min(r["x"], r["id"]), max(r["x"], r["id"]), r["norm"]) for r in parts.collect()} == set(got) and parts.count() == len(got)


def test_links_hold_together_what_accepted_pairs_do(crowd):
    entities, aliases = crowd
    pairs = dedup.former_name_pairs(aliases, entities)
    gated = dedup.gate(pairs, entities)
    inline = dedup.former_name_gated(aliases, entities)
    assert sorted(map(str, gated.collect())) == sorted(map(str, inline.collect()))
    accepted = gated.filter("outcome = 'accept'")
    links = dedup.former_name_links(aliases, entities)
    of = lambda df: {tuple(r) for r in connected_components(df.select("a", "b"), "a", "b").collect()}
    assert of(links) == of(accepted)
    assert all(r["a"] < r["b"] for r in links.collect())


def test_links_grow_with_members_not_with_their_square(spark):
    rows = [(f"e{i:04d}", "red bolt", "red bolt", "organization", "open", "published") for i in range(1200)]
    entities = spark.createDataFrame(rows, E)
    aliases = spark.createDataFrame([(f"e{i:04d}", "sec.former_name", str(i), "Red Bolt Inc") for i in range(0, 1200, 2)], A)
    links = dedup.former_name_links(aliases, entities)
    assert links.count() < 2 * 1200
    assert {r["component"] for r in connected_components(links, "a", "b").collect()} == {"e0000"}
    told = {(r["rule"], r["outcome"]): r["n"] for r in dedup.reasons(aliases, entities).collect()}
    assert told["sec_former_name", "accept"] == 600 * 600 + 600 * 599 // 2


def test_reasons_are_those_of_every_pair(spark, crowd):
    entities, aliases = crowd
    more = spark.createDataFrame([(f"p{i}", n, n, t, "open", "published") for i, (n, t) in enumerate(
        [("palantir technologies", "organization")] * 3 + [("palantir technologies in", "organization")] * 2 + [("palantir technologies mangled", "pac")] * 2)], E)
    entities = entities.unionByName(more)
    pairs = dedup.ext_id_pairs(aliases).unionByName(dedup.former_name_pairs(aliases, entities)).unionByName(dedup.exact_name_pairs(entities))
    pairs = pairs.unionByName(dedup.squashed_pairs(entities)).unionByName(dedup.prefix_pairs(entities))
    want = Counter((r["rule"], r["outcome"], r["reason"]) for r in dedup.gate(pairs, entities).collect())
    got = {(r["rule"], r["outcome"], r["reason"]): r["n"] for r in dedup.reasons(aliases, entities).collect()}
    assert got == want and want["prefix_variant_curated", "accept", None] == 6
    assert {r["rule"] for r in dedup.prefix_pairs(entities, curated_only=True).collect()} == {"prefix_variant_curated"}


def _dealt(spark):
    """Rows that all stages so far have written to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))


def test_a_name_of_many_bearers_is_dealt_by_its_bearers_not_by_its_pairs(spark):
    rows = [(f"e{i:04d}", "red bolt", "red bolt", "organization", "open", "published") for i in range(1500)]
    aliases = spark.createDataFrame([(r[0], "sec.former_name", r[0], "Red Bolt Inc") for r in rows], A)
    members = dedup._former_members(aliases, spark.createDataFrame(rows, E))
    before = _dealt(spark)
    assert dedup._former_met(members, each=2500).count() == 1500 * 1499 // 2
    # 900 blocks, of 30 by 30 pieces: a bearer travels to 30 of them as either side, not to all 900
    assert _dealt(spark) - before < 1500 * 100
