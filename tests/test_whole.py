"""Registered queries over all rows of the smallest tables, against plain Python."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_name
from quillgraph.model import Graph
from quillgraph.plans import group_ef, registry
from quillgraph.plans.views import graph, table, view

from .conftest import SF

QUERIES = registry.queries()


def test_isolated_backfill_reads_every_artifact(spark):
    ends = {i for e in view(spark, SF, "v_edge").collect() for i in (e["source_id"], e["target_id"])}
    lone = {e["id"] for e in view(spark, SF, "v_entity").collect() if e["type"] in ("event", "concept") and e["id"] not in ends}
    held = defaultdict(set)
    for m in view(spark, SF, "v_mention").collect():
        held[m["artifact_id"]].add(m["canonical_id"])
    want = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b and (a in lone or b in lone))
    got = {(r["source_id"], r["target_id"]): r["weight"] for r in QUERIES["isolated_backfill"](spark, SF).collect()}
    assert got == want


def test_dedup_plan_holds_prefix_variants(spark):
    rows = view(spark, SF, "v_twin").withColumn("norm", normalize_name(F.col("name"))).collect()
    fits = lambda s, t: len(s) >= 12 and any("a" <= c <= "z" for c in s) and t.startswith(s + " ") and len(t) - len(s) <= 10
    want = {(min(x["id"], y["id"]), max(x["id"], y["id"])) for x in rows for y in rows if fits(x["norm"], y["norm"])}
    got = QUERIES["dedup_pairs"](spark, SF).filter("rule = 'prefix_variant'").collect()
    assert want and {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert "accept" not in {r["outcome"] for r in got}
    counts = Counter(r["outcome"] for r in got)
    told = Counter()
    for r in QUERIES["reason_histogram"](spark, SF).filter("rule = 'prefix_variant'").collect():
        told[r["outcome"]] += r["n"]
    assert told == counts


def test_dedup_plan_holds_former_names_and_review(spark, monkeypatch):
    """Names of five entities: a former name, a tail under review, a reviewed tail."""
    names = {"a": "Old Widgets", "b": "New Gadgets", "p": "Palantir Technologies", "q": "Palantir Technologies in", "r": "Palantir Technologies mangled"}
    types = {"a": "organization", "b": "bill"}
    entities = spark.createDataFrame([(i, n, types.get(i, "organization"), "open", "published") for i, n in names.items()], "id string, name string, type string, surface_mode string, publication_state string")
    aliases = spark.createDataFrame([("b", "sec.former_name", "1", "OLD WIDGETS")], "canonical_id string, source_system string, source_id string, surface_name string")
    g = graph(spark, SF)
    monkeypatch.setattr(group_ef, "_twins", lambda s, d: Graph(entities, aliases, g.edges, g.citations, g.scrutiny))
    got = {(r["a"], r["b"], r["rule"], r["outcome"]) for r in QUERIES["dedup_pairs"](spark, SF).collect()}
    # an identifier stands behind a former name: the types need not be equal
    assert got == {("a", "b", "sec_former_name", "accept"), ("p", "q", "prefix_variant_curated", "accept"), ("p", "r", "prefix_variant", "review_rule")}


def test_cosine_top1_matches_every_row(spark):
    rows = [(r["vec_id"], r["label"], np.array(r["embedding"], np.float64)) for r in table(spark, SF, "embeddings").collect()]
    want = set()
    for i, label, x in rows:
        norm = lambda y: np.sqrt((x @ x) * (y @ y))  # noqa: B023, E731
        near = [(-round(float(x @ y / norm(y)), 9), j) for j, other, y in rows if j != i and other == label and norm(y) > 0]
        if near and -min(near)[0] >= (0.24 if label == 0 else 0.2):
            want.add((i, min(near)[1]))
    got = [(r["a"], r["b"]) for r in QUERIES["cosine_top1"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) and {a % 2 for a, _ in got} == {0, 1}
