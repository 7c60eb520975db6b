"""Entity deduplication: candidate pairs, gates, clusters, survivors, prediction, merge."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import identity_key, lookup, name_is_evidence, normalize_name, squash, squash_is_evidence
from ..model import NAMESPACE_TYPE, TYPE_AUTHORITY, Graph
from ..storage import materialize
from .components import connected_components
from .edges import incident
from .vectors import nearest

#: Rules on by default; "prefix_variant" and "vector" must be asked for.
DEFAULT_RULES = ("ext_id", "sec_former_name", "exact_name", "squashed_name", "prefix_variant_curated")
#: Rules backed by an identifier: their clusters pass the looser type gate.
ID_RULES = ("ext_id", "sec_former_name")
PERSON_SIDE = ("person", "candidate")
PREFIX_MIN, PREFIX_TAIL, VECTOR_MIN = 12, 10, 0.93
# Prefix variants (short, long) reviewed by hand, which merge by default.
PREFIX_CURATED = (("palantir technologies", "palantir technologies in"), ("palantir technologies", "palantir technologies inclass"))
# Squashed names of concepts that are not organisations.
CONCEPT_NOT_ORG = ("401k", "adr", "aietf", "chipmakers")


def profile(g: Graph) -> DataFrame:
    """Entities with norm, edge and alias counts and namespaces: one row each, three grouped joins.

    Names that were normalised before (a column ``norm``) are taken as they are.
    """
    degree = incident(g.edges.select("source_id", "target_id")).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("edge_count"))
    ns = lookup_namespace(F.col("source_system"))
    names = g.aliases.groupBy(F.col("canonical_id").alias("id")).agg(F.count("*").alias("alias_count"), F.array_sort(F.collect_set(ns)).alias("namespaces"))
    e = g.entities if "norm" in g.entities.columns else g.entities.withColumn("norm", normalize_name(F.col("name")))
    return e.join(degree, "id", "left").join(names, "id", "left").withColumns({
        "edge_count": F.coalesce("edge_count", F.lit(0)), "alias_count": F.coalesce("alias_count", F.lit(0)),
        "namespaces": F.coalesce("namespaces", F.array().cast("array<string>")),
    })


def lookup_namespace(system: Column) -> Column:
    from ..model import IDENTITY_NAMESPACES

    return lookup(IDENTITY_NAMESPACES, system)


def star_pairs(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """Pairs (a, b, rule, evidence) from the smallest id of each key to the others: no group is paired through."""
    lead = rows.groupBy(key).agg(F.min("id").alias("a"), F.countDistinct("id").alias("n")).filter("n > 1")
    return rows.join(lead, key).filter("id <> a").select("a", F.col("id").alias("b"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("evidence")).distinct()


def ext_id_pairs(aliases: DataFrame) -> DataFrame:
    keyed = aliases.select(F.col("canonical_id").alias("id"), identity_key(F.col("source_system"), F.col("source_id")).alias("key")).filter("key IS NOT NULL").distinct()
    return star_pairs(keyed, "key", "ext_id")


def _attributes(side: str) -> list[Column]:
    """What the gate reads of an entity, as the columns of one side of a pair."""
    return [F.col("surface_mode").alias(f"m{side}"), F.col("publication_state").alias(f"p{side}"), F.col("type").alias(f"t{side}")]


def _former_members(aliases: DataFrame, entities: DataFrame, *carried: str) -> DataFrame:
    """norm, id, former, named and carried columns: who once had a name, and who has it now; one row each.

    Names that nobody had, or that nobody has, make no pair and are left out. Written, as pairs read it from both sides.
    """
    former = aliases.filter("source_system = 'sec.former_name'").select(normalize_name(F.col("surface_name")).alias("norm"), F.col("canonical_id").alias("id"))
    former = former.filter(name_is_evidence(F.col("norm")))
    if carried:
        former = former.join(entities.select("id", *carried).hint("merge"), "id")
    now = entities.select("norm", "id", *carried).join(former.select("norm").distinct(), "norm", "left_semi")
    both = former.select("norm", "id", *carried, F.lit(True).alias("former"), F.lit(False).alias("named"))
    both = both.unionByName(now.select("norm", "id", *carried, F.lit(False).alias("former"), F.lit(True).alias("named")))
    return materialize(both.groupBy("norm", "id", *carried).agg(F.bool_or("former").alias("former"), F.bool_or("named").alias("named")))


def _former_met(members: DataFrame, *carried: str, each: int | None = None) -> DataFrame:
    """Every pair of one who had a name (x and the carried columns with x) and another who has it, once.

    Of two who both had and have the name the smaller id is x, so no pair comes twice and none are compared. Those
    who had a name and those who have it are cut into pieces of some ``side`` ids, and any two pieces meet in a block
    of about ``each`` pairs: a frequent name is many tasks' work, and a row travels once for each piece of the other
    side, so what is dealt grows with the pairs by ``2 / side`` of a row each.
    """
    n = members.groupBy("norm").agg(F.count_if("former").alias("f"), F.count_if("named").alias("e")).withColumn("pairs", F.col("f") * F.col("e")).filter("pairs > 0")
    total = n.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    # many blocks for few cores, but no block so small that rows travel more often than they must
    each = each or max(500_000, min(total // 400, 16_000_000))
    tasks, side = max(1, min(total // (2 * each) + 1, 20_000)), max(1, isqrt(each))
    pieces = lambda c: F.ceil(F.col(c) / side).cast("int")
    rows = members.join(n.select("norm", pieces("f").alias("fs"), pieces("e").alias("es")), "norm")
    own, met = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    as_x = [F.col(c).alias(f"{c}_x") for c in carried]
    block = ["norm", "fp", "ep"]
    had = rows.filter("former").select("norm", F.col("id").alias("x"), F.col("named").alias("both_x"), *as_x, own("fs").alias("fp"), met("es").alias("ep"))
    has = rows.filter("named").select("norm", "id", F.col("former").alias("both"), *carried, own("es").alias("ep"), met("fs").alias("fp"))
    pairs = had.repartition(tasks, *block).hint("merge").join(has.repartition(tasks, *block), block)
    return pairs.filter("id <> x AND NOT (both AND both_x AND x > id)")


def former_name_pairs(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    met = _former_met(_former_members(aliases, entities))
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), F.lit("sec_former_name").alias("rule"), F.col("norm").alias("evidence"))


_GATED = ("surface_mode", "publication_state", "type")


def former_name_gated(aliases: DataFrame, entities: DataFrame, rules=DEFAULT_RULES, person_unknown: bool = False) -> DataFrame:
    """What :func:`gate` says of :func:`former_name_pairs`: both ends bring what it reads along, so pairs are not joined again."""
    met = _former_met(_former_members(aliases, entities, *_GATED), *_GATED)
    first = F.col("x") < F.col("id")
    ends = [F.when(first, F.col(f"{c}_x")).otherwise(F.col(c)).alias(f"{c[0]}a") for c in _GATED] + [F.when(first, F.col(c)).otherwise(F.col(f"{c}_x")).alias(f"{c[0]}b") for c in _GATED]
    rows = met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), F.lit("sec_former_name").alias("rule"), F.col("norm").alias("evidence"), *ends)
    return _judged(rows.withColumnsRenamed({"sa": "ma", "sb": "mb"}), rules, person_unknown).select("a", "b", "rule", "evidence", "outcome", "reason")


def _former_kinds(members: DataFrame) -> DataFrame:
    """norm, mode, state and type of those who had a name (a) and have it (b), by kinds: ``fa``, ``eb`` how many, ``low_a``
    and ``low_b`` the smallest ids, ``pairs`` the pairs between them, two of whom both had and have it counted half
    in each order."""
    per = members.groupBy("norm", *_GATED).agg(
        F.count_if("former").alias("f"), F.count_if("named").alias("e"), F.count_if(F.col("former") & F.col("named")).alias("both"),
        F.min(F.when(F.col("former"), F.col("id"))).alias("low_f"), F.min(F.when(F.col("named"), F.col("id"))).alias("low_e"))
    side = lambda s, n, low: per.filter(f"{n} > 0").select("norm", *_attributes(s), F.col(n).alias(f"{n}{s}"), F.col("both").alias(f"both_{s}"), F.col(low).alias(f"low_{s}"))
    same = F.col("ma").eqNullSafe(F.col("mb")) & F.col("pa").eqNullSafe(F.col("pb")) & F.col("ta").eqNullSafe(F.col("tb"))
    itself = F.when(same, F.col("both_a")).otherwise(0)
    twice = F.col("both_a") * F.col("both_b") - itself
    return side("a", "f", "low_f").join(side("b", "e", "low_e"), "norm").withColumns({
        "rule": F.lit("sec_former_name"), "pairs": F.col("fa") * F.col("eb") - itself - twice / 2})


def former_name_links(aliases: DataFrame, entities: DataFrame, rules=DEFAULT_RULES, person_unknown: bool = False) -> DataFrame:
    """Accepted pairs that hold together just what all accepted pairs of :func:`former_name_pairs` do, a few for each entity.

    The gate reads mode, state and type alone, so it says the same of all pairs of two kinds of one name. Where it
    accepts them, everyone of the one kind is paired with everyone else of the other: that is connected,
    as are the smallest id of each kind with its own, and the two smallest with one another.
    """
    members = _former_members(aliases, entities, *_GATED)
    met = _judged(_former_kinds(members), rules, person_unknown).filter("outcome = 'accept' AND (fa > 1 OR eb > 1 OR low_a <> low_b)")
    met = materialize(met.select("norm", "ma", "pa", "ta", "low_a", "mb", "pb", "tb", "low_b"))
    row = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    links = met.select(*row("low_a", "low_b"))
    for s, flag in (("a", "former"), ("b", "named")):
        kind = met.select("norm", F.struct(F.col(f"m{s}").alias("m"), F.col(f"p{s}").alias("p"), F.col(f"t{s}").alias("t")).alias("kind"), F.col(f"low_{s}").alias("low")).distinct()
        own = members.filter(flag).select("norm", "id", F.struct(F.col("surface_mode").alias("m"), F.col("publication_state").alias("p"), F.col("type").alias("t")).alias("kind"))
        links = links.unionByName(own.join(kind, ["norm", "kind"]).select(*row("low", "id")))
    return links.filter("a <> b").distinct().select("a", "b", F.lit("sec_former_name").alias("rule"), F.lit("accept").alias("outcome"))


def exact_name_pairs(entities: DataFrame) -> DataFrame:
    return star_pairs(entities.filter(name_is_evidence(F.col("norm"))), "norm", "exact_name")


def squashed_pairs(entities: DataFrame) -> DataFrame:
    rows = entities.filter(squash_is_evidence(F.col("norm"))).withColumn("squashed", squash(F.col("norm")))
    return star_pairs(rows, "squashed", "squashed_name")


def _prefix_met(entities: DataFrame, curated_only: bool = False) -> DataFrame:
    """norm, ln and how far both are evidence: a name and one that goes on from it, each two once."""
    names = entities.select("norm").filter(F.length("norm") >= PREFIX_MIN).distinct()
    if curated_only:
        names = names.filter(F.col("norm").isin(*{n for pair in PREFIX_CURATED for n in pair}))
    cuts = F.transform(F.split("norm", " "), lambda t, i: F.array_join(F.slice(F.split("norm", " "), F.lit(1), i + 1), " "))
    longs = names.select(F.col("norm").alias("ln"), F.explode(cuts).alias("norm"))
    longs = longs.filter((F.col("norm") != F.col("ln")) & (F.length("norm") >= PREFIX_MIN) & (F.length("ln") - F.length("norm") <= PREFIX_TAIL)).distinct()
    hit = longs.join(names.filter(name_is_evidence(F.col("norm"))), "norm")
    curated = F.lit(False)
    for short, long in PREFIX_CURATED:
        curated = curated | ((F.col("norm") == short) & (F.col("ln") == long))
    hit = hit.withColumn("rule", F.when(curated, "prefix_variant_curated").otherwise("prefix_variant"))
    return hit.filter("rule = 'prefix_variant_curated'") if curated_only else hit


def prefix_pairs(entities: DataFrame, curated_only: bool = False) -> DataFrame:
    """A name that goes on from another at a word boundary by at most ten characters.

    The long side generates its own token prefixes and joins on equality: no range join. Names meet first, then
    those who have them. ``curated_only``: those that were reviewed by hand alone, which is what can be accepted.
    """
    e = entities.select("id", "norm").distinct()
    hit = _prefix_met(entities, curated_only).join(e, "norm").join(e.select(F.col("id").alias("l"), F.col("norm").alias("ln")), "ln")
    return hit.select(F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b"), "rule", F.col("norm").alias("evidence"))


def vector_pairs(vectors: DataFrame, block: str, k: int = 8, minimum: float = VECTOR_MIN) -> DataFrame:
    """The k nearest within a block (type and name block, say) at or above a similarity, from (id, embedding, block)."""
    return nearest(vectors, block, k, minimum)


def type_conflict(a: Column, b: Column, by_id: Column, person_unknown: bool = False) -> Column:
    """Why two types may not become one entity; null if they may.

    By name: never with a person on either side, be it two persons (``person_unknown`` allows a person and
    an unknown); else equal types, and unknown with any but pac, and organization with concept. By
    identifier: all but a person or candidate with something known that is neither.
    """
    one = lambda t: (a == t) | (b == t)
    lifted = one("unknown") & (a != b) if person_unknown else F.lit(False)
    org = ((a == "organization") & (b == "concept")) | ((a == "concept") & (b == "organization"))
    named = (
        F.when(one("person"), F.when(~lifted, "person_name")).when(a == b, F.lit(None).cast("string")).when(one("pac"), "pac_cross_type")
        .when(~one("unknown") & ~org, "incompatible_type")
    )
    mismatch = a.isin(*PERSON_SIDE) != b.isin(*PERSON_SIDE)
    return F.when(by_id, F.when((a != b) & ~one("unknown") & mismatch, "ext_id_person_mismatch")).otherwise(named)


def types_agree(a: Column, b: Column, by_id: Column, person_unknown: bool = False) -> Column:
    return type_conflict(a, b, by_id, person_unknown).isNull()


def _judged(rows: DataFrame, rules=DEFAULT_RULES, person_unknown: bool = False) -> DataFrame:
    """Outcome and reason of rows with a rule and both ends' mode (ma, mb), state (pa, pb) and type (ta, tb)."""
    conflict = type_conflict(F.col("ta"), F.col("tb"), F.col("rule").isin(*ID_RULES), person_unknown)
    outcome = (
        F.when(F.col("ma") != F.col("mb"), "skip_surface")
        .when(F.col("pa") != F.col("pb"), "skip_publication")
        .when(conflict.isNotNull(), "review_type")
        .when(~F.col("rule").isin(*rules), "review_rule")
        .otherwise("accept")
    )
    reason = (
        F.when(outcome == "skip_surface", "surface_mode_straddle").when(outcome == "skip_publication", "publication_state_straddle")
        .when(outcome == "review_type", conflict).when(outcome == "review_rule", F.concat(F.lit("rule_not_enabled:"), "rule"))
    )
    return rows.withColumns({"outcome": outcome, "reason": reason})


def gate(pairs: DataFrame, entities: DataFrame, rules=DEFAULT_RULES, person_unknown: bool = False) -> DataFrame:
    """Each pair with its outcome (skip_surface, skip_publication, review_type, review_rule or accept) and reason."""
    # a written table is packed: what its files take says little of what its rows take in a driver that broadcasts them
    at = lambda s: entities.select(F.col("id").alias(s), *_attributes(s)).hint("merge")
    rows = pairs.join(at("a"), "a").join(at("b"), "b")
    return _judged(rows, rules, person_unknown).select("a", "b", "rule", "evidence", "outcome", "reason")


def reasons(aliases: DataFrame, entities: DataFrame, rules=DEFAULT_RULES, person_unknown: bool = False) -> DataFrame:
    """rule, outcome, reason, n: how many pairs of all rules the gate accepts, and why it does not the others.

    Pairs of a name's former and present bearers, and of the bearers of two names, grow with the square of their
    number, but the gate says the same of all of two kinds: they are counted by kinds, and none is made.
    """
    pairs = ext_id_pairs(aliases).unionByName(exact_name_pairs(entities)).unionByName(squashed_pairs(entities))
    by = ("rule", "outcome", "reason")
    few = gate(pairs, entities, rules, person_unknown).groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    former = _judged(_former_kinds(_former_members(aliases, entities, *_GATED)), rules, person_unknown).filter("pairs > 0")
    kinds = entities.groupBy("norm", *_GATED).agg(F.count("*").alias("n"))
    side = lambda s, norm: kinds.select(F.col("norm").alias(norm), *_attributes(s), F.col("n").alias(f"n{s}"))
    longer = _judged(_prefix_met(entities).join(side("a", "norm"), "norm").join(side("b", "ln"), "ln"), rules, person_unknown)
    out = few.unionByName(former.groupBy(*by).agg(F.sum("pairs").alias("n"))).unionByName(longer.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("n")))
    return out.groupBy(*by).agg(F.sum("n").cast("long").alias("n"))


def clusters(gated: DataFrame, entities: DataFrame, person_unknown: bool = False) -> DataFrame:
    """id, cluster, refused: components of accepted pairs; one whose members' types conflict is refused whole.

    The looser gate holds only if every link of the cluster is by identifier. Instead of comparing members
    pair by pair, the distinct types of a cluster are compared (13 at most), and a type with itself where
    it has two members.
    """
    accepted = gated.filter("outcome = 'accept'")
    comp = connected_components(accepted.select("a", "b"), "a", "b")
    members = comp.join(entities.select(F.col("id").alias("node"), "type"), "node")
    by_id = accepted.join(comp.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.bool_and(F.col("rule").isin(*ID_RULES)).alias("by_id"))
    kinds = members.groupBy("component", "type").agg(F.count("*").alias("n"))
    pairs = kinds.alias("x").join(kinds.alias("y"), "component").filter("x.type < y.type OR (x.type = y.type AND x.n > 1)").join(by_id, "component")
    bad = pairs.groupBy("component").agg(F.bool_or(~types_agree(F.col("x.type"), F.col("y.type"), F.col("by_id"), person_unknown)).alias("refused"))
    return members.join(bad, "component", "left").select(F.col("node").alias("id"), F.col("component").alias("cluster"), F.coalesce("refused", F.lit(False)).alias("refused"))


def survivors(clustered: DataFrame, entities: DataFrame, concept_to_org: bool = True) -> DataFrame:
    """cluster, survivor, type, conflict, id for every member of an accepted cluster.

    Survivor: an identifier first, then most edges, most aliases, the oldest (``created_at``, where the
    entities have it), then the smallest id. Type: the one real type if there is but one; none at all, what
    the identifiers stand for; organization over concept unless a member's name is no organisation; else the
    survivor's type (the strongest, if that is unknown), flagged.
    """
    rows = clustered.filter("NOT refused").join(entities, "id")
    created = F.col("created_at") if "created_at" in entities.columns else F.lit(None).cast("timestamp")
    order = W.partitionBy("cluster").orderBy(F.desc(F.size("namespaces") > 0), F.desc("edge_count"), F.desc("alias_count"), created.asc_nulls_last(), "id")
    ranked = rows.withColumn("rn", F.row_number().over(order))
    real = F.array_sort(F.collect_set(F.when(F.col("type") != "unknown", F.col("type"))))
    per = ranked.groupBy("cluster").agg(
        F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("survivor"), F.max(F.when(F.col("rn") == 1, F.col("type"))).alias("own"),
        F.bool_or(squash(F.col("norm")).isin(*CONCEPT_NOT_ORG)).alias("denied"), real.alias("types"),
        F.array_distinct(F.flatten(F.collect_set("namespaces"))).alias("spaces"),
    )
    both = F.array_join("types", ",") == "concept,organization"
    org = both & ~F.col("denied") if concept_to_org else F.lit(False)
    strongest = F.array_max(F.transform("types", lambda t: F.struct(lookup(TYPE_AUTHORITY, t).alias("w"), t.alias("t"))))["t"]
    kind = (
        F.when(F.size("types") == 0, F.coalesce(namespace_type(F.col("spaces")), F.lit("unknown"))).when(F.size("types") == 1, F.get("types", 0))
        .when(org, F.lit("organization")).when((F.col("own") == "unknown") & both, F.lit("concept")).when(F.col("own") == "unknown", strongest)
        .otherwise(F.col("own"))
    )
    flagged = (F.size("types") > 1) & ~org
    return ranked.select("id", "cluster").join(per.select("cluster", "survivor", kind.alias("type"), flagged.alias("conflict")), "cluster")


def namespace_type(namespaces: Column) -> Column:
    out = F.lit(None).cast("string")
    for ns, t in reversed(NAMESPACE_TYPE.items()):
        out = F.when(F.array_contains(namespaces, ns), F.lit(t)).otherwise(out)
    return out


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced through (id, survivor); original ends kept as os, ot."""
    s = mapping.select(F.col("id").alias("source_id"), F.col("survivor").alias("ns"))
    t = mapping.select(F.col("id").alias("target_id"), F.col("survivor").alias("nt"))
    rows = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return rows.withColumns({
        "os": F.col("source_id"), "ot": F.col("target_id"), "source_id": F.coalesce("ns", "source_id"), "target_id": F.coalesce("nt", "target_id"),
    }).drop("ns", "nt")


def merge_edges(edges: DataFrame, mapping: DataFrame, policy: str = "sum") -> DataFrame:
    """The merged edge table: id, source_id, target_id, relation, weight, old_ids.

    Edges that meet become one with the smallest id; weights are summed, or with policy "keep" that of the
    kept edge stays. Self-loops that the merge makes are dropped, others stay.
    """
    moved = remap(edges, mapping).filter("NOT (source_id = target_id AND os <> ot)")
    weight = F.sum("weight") if policy == "sum" else F.min_by("weight", "id")
    return moved.groupBy("source_id", "target_id", "relation").agg(F.min("id").alias("id"), weight.alias("weight"), F.array_sort(F.collect_set("id")).alias("old_ids"))


def merge_citations(citations: DataFrame, merged: DataFrame) -> DataFrame:
    """Citations under the merged edges; those of dropped self-loops go."""
    to = merged.select(F.col("id").alias("new_edge"), F.explode("old_ids").alias("edge_id"))
    return citations.join(to, "edge_id").withColumn("edge_id", F.col("new_edge")).drop("new_edge")


def merge(g: Graph, mapping: DataFrame, policy: str = "sum") -> Graph:
    """A new snapshot with every id of (id, survivor) merged: edges, citations, aliases, scrutiny, entities.

    A pair whose dropped side is stricter than its survivor is refused (it stays as it is).
    """
    rank = lambda c: F.when(F.col(c) == "suppress", 2).when(F.col(c) == "alias", 1).otherwise(0)
    drop = g.entities.select("id", rank("surface_mode").alias("dr"))
    keep = g.entities.select(F.col("id").alias("survivor"), rank("surface_mode").alias("kr"))
    allowed = mapping.filter("id <> survivor").join(drop, "id").join(keep, "survivor").filter("dr <= kr").select("id", "survivor")
    merged = merge_edges(g.edges, allowed, policy)
    move = lambda df, c: df.join(allowed.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("survivor", c)).drop("survivor")
    kept = g.edges.select("id", *[c for c in g.edges.columns if c not in ("id", "source_id", "target_id", "relation", "weight")])
    return Graph(
        g.entities.join(allowed.select("id"), "id", "left_anti"), move(g.aliases, "canonical_id").dropDuplicates(["canonical_id", "source_system", "source_id"]),
        merged.drop("old_ids").join(kept, "id"), merge_citations(g.citations, merged), move(g.scrutiny, "canonical_id") if g.scrutiny is not None else None,
    )


def predict(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: edges before, self-loops the merge makes, collisions, edges after."""
    moved = remap(edges, mapping)
    loops = F.sum(F.when((F.col("source_id") == F.col("target_id")) & (F.col("os") != F.col("ot")), 1).otherwise(0))
    per = moved.groupBy("source_id", "target_id", "relation").agg(F.count("*").alias("n"), F.coalesce(loops, F.lit(0)).alias("l"))
    stay = F.col("n") - F.col("l")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.coalesce(F.sum("l"), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.greatest(stay - 1, F.lit(0))), F.lit(0)).alias("collisions"), F.coalesce(F.sum(F.least(stay, F.lit(1))), F.lit(0)).alias("after"),
    )


def member_plan(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Fragments of members: id, member, outcome, from nodes (id, norm, type, surface_mode, publication_state,
    namespaces) and member name variants (member, surface_mode, publication_state, norm)."""
    foreign = ("bioguide", "fec_candidate", "fec_committee", "sec_cik")
    owners = members.groupBy("norm").agg(F.countDistinct("member").alias("owners"), F.min("member").alias("member"))
    state = members.select("member", F.col("surface_mode").alias("mm"), F.col("publication_state").alias("mp")).distinct()
    rows = nodes.join(owners, "norm").join(state, "member").filter("id <> member")
    outcome = (
        F.when(F.col("owners") > 1, "ambiguous").when(~F.col("type").isin("person", "unknown"), "type")
        .when(F.arrays_overlap("namespaces", F.array(*map(F.lit, foreign))), "foreign_id").when(F.col("surface_mode") != F.col("mm"), "surface")
        .when(F.col("publication_state") != F.col("mp"), "publication").when(~_person_evidence(), "weak_name").otherwise("accept")
    )
    return rows.select("id", "member", outcome.alias("outcome"))


def _person_evidence() -> Column:
    from ..functions.text import person_is_evidence

    return person_is_evidence(F.col("norm"))


def publish(entities: DataFrame, edges: DataFrame, scrutiny: DataFrame, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and edges with the batch published, and the batch's entities without a decision.

    While any entity lacks a decision nothing changes: the flip is a join with that (empty or one-row) verdict.
    """
    mine = entities.filter(F.col("batch_id") == batch)
    lacking = mine.join(scrutiny.select(F.col("canonical_id").alias("id")), "id", "left_anti").select("id")
    blocked = lacking.agg((F.count("*") > 0).alias("blocked")).withColumn("_k", F.lit(1))

    def flip(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_k", F.lit(1)).join(F.broadcast(blocked), "_k")
        state = F.when((F.col("batch_id") == batch) & ~F.col("blocked"), F.lit("published")).otherwise(F.col("publication_state"))
        return rows.withColumn("publication_state", state).drop("_k", "blocked")

    return flip(entities), flip(edges), lacking


def unpublish(df: DataFrame, batch: str) -> DataFrame:
    return df.withColumn("publication_state", F.when(F.col("batch_id") == batch, F.lit("staged")).otherwise(F.col("publication_state")))


def invariants(g: Graph) -> DataFrame:
    """name, value: counts that a merge must keep or explain. Edges and citations are read once and meet by edge."""
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
    edges = g.edges.groupBy("id").agg(F.count("*").alias("e"), F.count_if(F.col("source_id") == F.col("target_id")).alias("loops"))
    cites = g.citations.groupBy("edge_id").agg(F.count("*").alias("c"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = {
        "edges": total("e"), "citations": total("c"), "uncited_edges": total(F.when(F.col("c").isNull(), F.col("e"))),
        "orphan_citations": total(F.when(F.col("e").isNull(), F.col("c"))), "self_loops": total("loops"),
    }
    wide = edges.join(cites, F.col("id") == F.col("edge_id"), "full_outer").agg(*[v.alias(k) for k, v in counts.items()])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in counts])))
    return one("entities", g.entities).unionByName(one("aliases", g.aliases)).unionByName(rows)


def postconditions(before: DataFrame, after: DataFrame, dropped: int) -> DataFrame:
    """One row of booleans over two invariant tables."""
    wide = before.select("name", F.col("value").alias("b")).join(after.select("name", F.col("value").alias("a")), "name")
    at = lambda c, n: F.max(F.when(F.col("name") == n, F.col(c)))
    return wide.agg(
        (at("a", "entities") == at("b", "entities") - dropped).alias("entities_ok"), (at("a", "orphan_citations") <= at("b", "orphan_citations")).alias("no_new_orphans"),
        (at("a", "uncited_edges") <= at("b", "uncited_edges")).alias("no_new_uncited"), (at("a", "self_loops") <= at("b", "self_loops")).alias("no_new_loops"),
    )


def repair_plan(entities: DataFrame, issuer: Column) -> DataFrame:
    """id, survivor of fragments with one normalised issuer name and type; persons are left alone; open, then
    oldest (``created_at``, where the entities have it), then the smallest id survives."""
    rows = entities.filter("type <> 'person'").withColumn("key", issuer).filter("key <> ''")
    created = F.col("created_at") if "created_at" in entities.columns else F.lit(None).cast("timestamp")
    order = W.partitionBy("key", "type").orderBy(F.desc(F.col("surface_mode") == "open"), created.asc_nulls_last(), "id")
    first = rows.withColumn("survivor", F.first("id").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return first.filter("id <> survivor").select("id", "survivor")
