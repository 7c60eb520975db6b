"""Names and vectors to entities, entities to be kept or made, and the small lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from .edges import incident
from .vectors import nearest

#: Least cosine similarity of a match by vector, and what a person needs beyond it.
THRESHOLD, PERSON_MARGIN = 0.86, 0.04


def resolve_vector(asked: DataFrame, entities: DataFrame, threshold: float = THRESHOLD, margin: float = PERSON_MARGIN) -> DataFrame:
    """tag, id, how of asked (tag, name, type, embedding) among entities (id, name, type, embedding).

    The nearest entity of the type counts if it is near enough and shares a word of its normalised name with
    the asked one; otherwise the entity of that type with just the normalised name, of several the smallest id;
    otherwise none. Tags are distinct; a null embedding goes by name alone.
    """
    mine = asked.withColumn("norm", normalize_name(F.col("name")))
    known = entities.select(F.col("id").alias("hit"), normalize_name(F.col("name")).alias("hit_norm"), F.col("type").alias("hit_type"))
    found = nearest(asked.select(F.col("tag").alias("id"), "embedding", "type"), "type", 1, among=entities.select("id", "embedding", "type"))
    need = threshold + F.when(F.col("type") == "person", margin).otherwise(0.0)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    near = found.select(F.col("a").alias("tag"), F.col("b").alias("hit"), "similarity").join(mine.select("tag", "type", "norm"), "tag").join(known, "hit")
    near = near.filter((F.col("similarity") >= need) & F.arrays_overlap(words("norm"), words("hit_norm"))).select("tag", F.col("hit").alias("by_vector"))
    exact = known.filter("hit_norm <> ''").groupBy(F.col("hit_norm").alias("norm"), F.col("hit_type").alias("type")).agg(F.min("hit").alias("by_name"))
    rows = mine.select("tag", "type", "norm").join(near, "tag", "left").join(exact, ["norm", "type"], "left")
    how = F.when(F.col("by_vector").isNotNull(), "vector").when(F.col("by_name").isNotNull(), "name")
    return rows.select("tag", F.coalesce("by_vector", "by_name").alias("id"), how.alias("how"))


def upsert_entities(incoming: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """system, source_id, id, how of incoming records (system, source_id, name, type).

    An entity that already has the alias (how: alias), else one of the type with the same normalised name
    (name), else a new one (new) whose id follows from type and name, so that equal records and reruns make
    one entity. Without a name the alias stands for it. Of several the smallest id; null keys find nothing.
    """
    asked = incoming.withColumn("norm", normalize_name(F.col("name")))
    by_alias = aliases.groupBy(F.col("source_system").alias("system"), "source_id").agg(F.min("canonical_id").alias("by_alias"))
    by_name = entities.select("id", "type", normalize_name(F.col("name")).alias("norm")).filter("norm <> ''").groupBy("type", "norm").agg(F.min("id").alias("by_name"))
    made = F.when(F.col("norm") != "", F.concat_ws("|", "type", "norm")).otherwise(F.concat_ws("|", "type", "system", "source_id"))
    rows = asked.join(by_alias, ["system", "source_id"], "left").join(by_name, ["type", "norm"], "left")
    how = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    new = F.concat(F.lit("new:"), F.substring(F.sha2(made, 256), 1, 16))
    return rows.select("system", "source_id", F.coalesce("by_alias", "by_name", new).alias("id"), how.alias("how"), "name", "type")


def new_entities(resolved: DataFrame) -> DataFrame:
    """id, name, type of the entities that :func:`upsert_entities` makes: one a new id, the first name by order."""
    return resolved.filter("how = 'new'").groupBy("id", "type").agg(F.min("name").alias("name"))


def new_aliases(resolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (canonical_id, source_system, source_id, surface_name) that the incoming records add."""
    rows = resolved.groupBy(F.col("id").alias("canonical_id"), F.col("system").alias("source_system"), "source_id").agg(F.min("name").alias("surface_name"))
    return rows.join(aliases.select("canonical_id", "source_system", "source_id"), ["canonical_id", "source_system", "source_id"], "left_anti")


def seed_persons(entities: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """id, name of persons with a seeded name (names: name) and a biographical id."""
    official = aliases.filter("source_system = 'bioguide'").select(F.col("canonical_id").alias("id"))
    return entities.filter("type = 'person'").join(names.select("name"), "name", "left_semi").join(official, "id", "left_semi").select("id", "name").distinct()


def most_connected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """norm, id: of the entities with one normalised name the one with most edges, then the smallest id."""
    degree = incident(edges.select("source_id", "target_id")).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"))
    rows = entities.select("id", normalize_name(F.col("name")).alias("norm")).filter("norm <> ''").join(degree, "id", "left")
    return rows.groupBy("norm").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), F.col("id"))).alias("b")).select("norm", F.col("b.id").alias("id"))


def unbridged_receivers(aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """committee, id: entities with a committee id that receive contributions and are affiliated with nobody."""
    held = aliases.filter("source_system = 'fec.committee'").select(F.col("source_id").alias("committee"), F.col("canonical_id").alias("id"))
    paid = edges.filter("relation = 'contributes_to'").select(F.col("target_id").alias("id"))
    tied = edges.filter("relation = 'affiliated_with'").select(F.col("source_id").alias("id"))
    return held.join(paid, "id", "left_semi").join(tied, "id", "left_anti").select("committee", "id").distinct()


def split_committees(aliases: DataFrame, systems: tuple[str, str] = ("fec.committee", "fec.disbursement.recipient")) -> DataFrame:
    """source_id, ids: one committee id that two alias systems give to different entities."""
    rows = aliases.filter(F.col("source_system").isin(*systems)).groupBy("source_id").agg(
        F.countDistinct("source_system").alias("s"), F.array_sort(F.collect_set("canonical_id")).alias("ids")
    )
    return rows.filter((F.col("s") > 1) & (F.size("ids") > 1)).select("source_id", "ids")


def distinct_targets(edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """One row: targets, the number of different targets of some relations."""
    return edges.filter(F.col("relation").isin(*relations)).agg(F.countDistinct("target_id").alias("targets"))


def vote_counts(edges: DataFrame, aliases: DataFrame, party: str) -> DataFrame:
    """bill, yes, of_party: different yes voters of each bill, and those of a party."""
    mine = aliases.filter((F.col("source_system") == "party") & (F.col("source_id") == party)).select(F.col("canonical_id").alias("source_id"), F.lit(True).alias("p")).distinct()
    rows = edges.filter("relation = 'voted_for'").join(mine, "source_id", "left")
    return rows.groupBy(F.col("target_id").alias("bill")).agg(F.countDistinct("source_id").alias("yes"), F.countDistinct(F.when(F.col("p"), F.col("source_id"))).alias("of_party"))


def first_match(found: DataFrame, tokens: list[str]) -> DataFrame:
    """The first row of each key (key, query_at, row_at, name) whose name holds any token, whatever its case; in order of query, then row."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.upper("name").contains(t.upper())
    order = W.partitionBy("key").orderBy("query_at", "row_at")
    return found.filter(hit).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def recipient_key(committee: Column, candidate: Column, sub: Column) -> Column:
    """Committee id, else candidate id, else ``unknown-`` and the record's own number; blanks count as missing."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(full(committee), full(candidate), F.concat(F.lit("unknown-"), sub.cast("string")))


def replace_seeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Curated seeds after an upsert by (label, entity_type): a new row replaces the old one whole."""
    return old.join(new.select("label", "entity_type"), ["label", "entity_type"], "left_anti").unionByName(new)


def seeds(anchors: DataFrame, domains: list[str] | None = None, types: list[str] | None = None, holding: str | None = None, persons: bool = True, but: tuple[str, ...] = ()) -> DataFrame:
    """Seeds of some domains and types, with a list that is not empty (``holding``), by label; persons or domains may be left out."""
    rows = anchors if domains is None else anchors.filter(F.col("priority_domain").isin(*domains))
    rows = rows if types is None else rows.filter(F.col("entity_type").isin(*types))
    rows = rows if holding is None else rows.filter(F.size(holding) > 0)
    rows = rows if persons else rows.filter("entity_type <> 'person'")
    rows = rows.filter(~F.coalesce(F.col("priority_domain").isin(*but), F.lit(False))) if but else rows
    return rows.orderBy("label", "entity_type")


def seeds_per_domain(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("priority_domain").agg(F.count("*").alias("n"))


def retyped(entities: DataFrame, aliases: DataFrame, types: tuple[str, ...] = ("event", "concept")) -> DataFrame:
    """Entities with the type of those that have none (unknown) set to what most of their aliases hint at, if that is
    one of ``types``. Blank hints count as a kind of their own; of equals the first by name."""
    hint = F.lower(F.trim(F.coalesce("kind_hint", F.lit(""))))
    n = aliases.groupBy(F.col("canonical_id").alias("id"), hint.alias("kind")).agg(F.count("*").alias("n"))
    best = n.groupBy("id").agg(F.min_by("kind", F.struct((-F.col("n")).alias("n"), F.col("kind"))).alias("kind"))
    new = F.when((F.col("type") == "unknown") & F.col("kind").isin(*types), F.col("kind")).otherwise(F.col("type"))
    return entities.join(best, "id", "left").withColumn("type", new).select(*entities.columns)


def type_shares(before: DataFrame, after: DataFrame) -> DataFrame:
    """type, before, after, before_percent, after_percent: entities by type in two snapshots, and their share of all,
    to one decimal; null for an empty snapshot."""
    n = lambda df, name: df.groupBy("type").agg(F.count("*").alias(name))
    both = n(before, "before").join(n(after, "after"), "type", "full_outer").select("type", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    total = both.agg(F.sum("before").alias("tb"), F.sum("after").alias("ta"))
    share = lambda c, t: F.when(F.col(t) > 0, F.round(100 * F.col(c) / F.col(t), 1))
    return both.join(F.broadcast(total)).select("type", "before", "after", share("before", "tb").alias("before_percent"), share("after", "ta").alias("after_percent"))


def first_of(*frames: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several lists, one a key: that of the first list which has it, and there the smallest."""
    rest = [c for c in frames[0].columns if c != key]
    rows = None
    for i, df in enumerate(frames):
        one = df.select(key, F.struct(F.lit(i).alias("_i"), *rest).alias("_r"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min("_r").alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def vote_edges(votes: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id, relation, citation_ref, citation_url of vote edges that are not there yet.

    ``votes``: member (bioguide), bill (entity), vote, ref, url, at. Only votes with a direction make an edge, one a
    member, bill and direction, cited by its first vote (``at``, then ref); members who are no entity make none, of
    several entities with one id the smallest.
    """
    from ..functions.text import vote_direction

    who = aliases.filter("source_system = 'bioguide'").groupBy(F.col("source_id").alias("member")).agg(F.min("canonical_id").alias("source_id"))
    cast = votes.withColumn("relation", vote_direction(F.col("vote"))).filter("relation IS NOT NULL AND bill IS NOT NULL").join(who, "member")
    first = F.min(F.struct("at", "ref", "url")).alias("f")
    made = cast.groupBy("source_id", F.col("bill").alias("target_id"), "relation").agg(first)
    there = edges.select("source_id", "target_id", "relation")
    return made.join(there, ["source_id", "target_id", "relation"], "left_anti").select("source_id", "target_id", "relation", F.col("f.ref").alias("citation_ref"), F.col("f.url").alias("citation_url"))


def by_exact_name(labels: DataFrame, entities: DataFrame, edges: DataFrame, type_: str | None = None) -> DataFrame:
    """label, id: the entity (of a type, if one is given) that bears just this name; of several the one with most edges,
    a self-loop counting twice, then the smallest id. Labels that nobody bears are left out."""
    asked = labels.select("label").filter("label IS NOT NULL").distinct()
    pool = entities if type_ is None else entities.filter(F.col("type") == type_)
    hit = asked.join(pool.select(F.col("name").alias("label"), "id"), "label")
    # ends are counted where they are read, then by id: only counts meet the hits
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("n")).join(hit.select("id"), "id", "left_semi")
    best = F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), F.col("id"))).alias("b")
    return hit.join(degree, "id", "left").groupBy("label").agg(best).select("label", F.col("b.id").alias("id"))


def affiliations(curated: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """person, company, source_id, target_id, citation_url, citation_ref, status of curated affiliations (person, company,
    citation_url, citation_ref): new, reused (the edge is there), company_not_found or person_not_found."""
    who = by_exact_name(curated.select(F.col("person").alias("label")), entities, edges, "person").select(F.col("label").alias("person"), F.col("id").alias("source_id"))
    what = by_exact_name(curated.select(F.col("company").alias("label")), entities, edges, "organization").select(F.col("label").alias("company"), F.col("id").alias("target_id"))
    there = edges.filter("relation = 'affiliated_with'").select("source_id", "target_id", F.lit(True).alias("there")).distinct()
    rows = curated.join(who, "person", "left").join(what, "company", "left").join(there, ["source_id", "target_id"], "left")
    status = F.when(F.col("source_id").isNull(), "person_not_found").when(F.col("target_id").isNull(), "company_not_found").when(F.col("there"), "reused").otherwise("new")
    return rows.select("person", "company", "source_id", "target_id", "citation_url", "citation_ref", status.alias("status"))
