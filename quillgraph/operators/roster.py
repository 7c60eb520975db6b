"""Members of a roster to entities, and committees to members through their candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DESIGNATION_RANK, lookup, normalize_name
from ..storage import materialize

# Identifiers that name one real entity, and the systems that hold committee ids.
AUTHORITATIVE = ("bioguide", "fec.candidate", "fec.committee", "fec.affiliated_committee", "sec.cik", "senate_lda.registrant")
COMMITTEE_SYSTEMS = ("fec.disbursement.recipient", "fec.committee", "fec.affiliated_committee")
# The system of a member's further spellings.
VARIANTS = "congress.legislators"
#: Evidence from strong to weak.
HOW = ("bioguide", "fec.candidate", "name_fragment")


def name_refusal(type_: Column, mode: Column, bioguides: Column, systems: Column, member: Column) -> Column:
    """Why a member may not be attached to an entity by name alone; null if it may.

    The weakest evidence passes only for a person who is public already and bears no other identifier."""
    foreign = F.array_min(F.filter(systems, lambda s: (s != "bioguide") & s.isin(*AUTHORITATIVE)))
    return (
        F.when(type_ != "person", "type_not_person").when(mode != "open", "surface_mode_not_open")
        .when((F.size(bioguides) > 0) & (F.size(F.array_except(bioguides, F.array(member))) > 0), "foreign_bioguide")
        .when(foreign.isNotNull(), F.concat(F.lit("foreign_external_id:"), foreign))
    )


def options(members: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """member, at, level, place, entity, refusal: all entities that a member (member, label, candidates, at) may be.

    level: 0 by bioguide, 1 by one of its candidate ids (place: which), 2 by exact normalised name, of several
    the smallest id first. Refused names are told, with the reason.
    """
    held = aliases.filter(F.col("source_system").isin(*AUTHORITATIVE)).select("canonical_id", "source_system", "source_id")
    none = F.lit(None).cast("string")
    by = lambda system: held.filter(F.col("source_system") == system).select(F.col("canonical_id").alias("entity"), F.col("source_id").alias("key"))
    own = members.withColumn("key", F.col("member")).join(by("bioguide"), "key").select("member", "at", F.lit(0).alias("level"), F.lit(0).alias("place"), "entity", none.alias("refusal"))
    asked = members.select("member", "at", F.posexplode("candidates").alias("place", "key"))
    ran = asked.join(by("fec.candidate"), "key").select("member", "at", F.lit(1).alias("level"), "place", "entity", none.alias("refusal"))
    per = held.groupBy(F.col("canonical_id").alias("id")).agg(
        F.collect_set("source_system").alias("systems"), F.collect_set(F.when(F.col("source_system") == "bioguide", F.col("source_id"))).alias("bioguides"))
    named = members.select("member", "at", normalize_name(F.col("label")).alias("norm")).filter("norm <> ''")
    known = entities.select("id", "type", "surface_mode", normalize_name(F.col("name")).alias("norm")).filter("norm <> ''").join(per, "id", "left")
    empty = F.array().cast("array<string>")
    why = name_refusal(F.col("type"), F.col("surface_mode"), F.coalesce("bioguides", empty), F.coalesce("systems", empty), F.col("member"))
    same = named.join(known, "norm").select("member", "at", F.lit(2).alias("level"), F.lit(0).alias("place"), F.col("id").alias("entity"), why.alias("refusal"))
    return own.unionByName(ran).unionByName(same)


def assign(offers: DataFrame) -> DataFrame:
    """member, entity, level: each member its first option that no better claim takes, one member an entity.

    Members propose in the order of their options (level, place, entity), an entity keeps the claim of the
    strongest evidence, then of the earliest member (``at``, then id), and the others go on to their next option,
    until nobody is turned away: as many rounds as a member has options, at most.
    """
    offers = materialize(offers.select("member", "at", "entity", F.struct("level", "place", "entity").alias("rank")).groupBy("member", "at", "entity").agg(F.min("rank").alias("rank")))
    open_ = offers
    while True:
        first = open_.groupBy("member", "at").agg(F.min("rank").alias("rank"))
        claims = first.select("member", "at", "rank.entity", "rank.level", "rank")
        best = claims.groupBy("entity").agg(F.min(F.struct("level", "at", "member")).alias("best")).select("entity", F.col("best.member").alias("winner"))
        judged = materialize(claims.join(best, "entity"))
        lost = judged.filter("member <> winner").select("member", "entity")
        if lost.isEmpty():
            return judged.select("member", "entity", "level")
        open_ = materialize(open_.join(lost, ["member", "entity"], "left_anti"))


def resolve_roster(members: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """member, id, how of every member (member, label, candidates, at): bioguide, fec.candidate, name_fragment, or
    created, with a steady id of its own.

    An entity serves one member; who loses a contested one goes on to weaker evidence, and is created in the end.
    Members are distinct; ties of ``at`` go by member.
    """
    found = assign(options(members, entities, aliases).filter("refusal IS NULL"))
    rows = members.select("member").join(found, "member", "left")
    how = F.coalesce(F.get(F.array(*map(F.lit, HOW)), F.col("level")), F.lit("created"))
    return rows.select("member", F.coalesce("entity", F.concat(F.lit("new:"), F.substring(F.sha2(F.concat(F.lit("bioguide|"), "member"), 256), 1, 16))).alias("id"), how.alias("how"))


def refusals(members: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """reason, pairs: how often a name match was refused, and why."""
    return options(members, entities, aliases).filter("refusal IS NOT NULL").groupBy(F.col("refusal").alias("reason")).agg(F.count("*").alias("pairs"))


def roster_aliases(resolved: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (canonical_id, source_system, source_id, surface_name) that a roster (member, label, candidates, variants,
    party) adds: its identifiers, its spellings and its party. What is there already is not added again."""
    at = resolved.select("member", F.col("id").alias("canonical_id")).join(members, "member")
    row = lambda system, key, name, df=at: df.select("canonical_id", F.lit(system).alias("source_system"), key.alias("source_id"), name.alias("surface_name"))
    label, member = F.col("label"), F.col("member")
    rows = row("bioguide", member, label)
    rows = rows.unionByName(row("fec.candidate", F.col("x"), label, at.withColumn("x", F.explode("candidates"))))
    rows = rows.unionByName(row(VARIANTS, F.concat_ws(":", "member", F.replace(normalize_name(F.col("x")), F.lit(" "), F.lit("-"))), F.col("x"), at.withColumn("x", F.explode("variants"))))
    rows = rows.unionByName(row("party", member, F.col("party"), at.filter("party IS NOT NULL")))
    have = aliases.select("source_system", "source_id").filter(F.col("source_system") != "party").distinct()
    party = aliases.filter("source_system = 'party'").select("canonical_id", "source_system", "source_id")
    fresh = rows.join(have, ["source_system", "source_id"], "left_anti").join(party, ["canonical_id", "source_system", "source_id"], "left_anti")
    return fresh.groupBy("canonical_id", "source_system", "source_id").agg(F.min("surface_name").alias("surface_name"))


def committee_bridge(links: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """committee, source_id, target_id, candidate, designation, cycles, status of every committee that linkage rows
    (committee, candidate, designation, cycle) lead to a member.

    Candidates become members through their aliases, committees entities through theirs. new: the edge is made.
    reused: it is there and stays as it is. self: both ends are one entity, which says nothing. ambiguous_member:
    the committee's candidates belong to several members, or one candidate to several entities.
    ambiguous_committee: several entities bear the committee's id. not_in_graph: none does. Of a committee's rows the
    best designation, then the newest cycle stands for it; all its cycles are kept. Null ids lead nowhere.
    """
    member = aliases.filter("source_system = 'fec.candidate'").select(F.col("source_id").alias("candidate"), F.col("canonical_id").alias("member")).distinct()
    held = aliases.filter(F.col("source_system").isin(*COMMITTEE_SYSTEMS) & F.col("source_id").startswith("C"))
    held = held.groupBy(F.col("source_id").alias("committee")).agg(F.countDistinct("canonical_id").alias("holders"), F.min("canonical_id").alias("source_id"))
    rank = lookup(DESIGNATION_RANK, F.col("designation"), F.lit(9))
    best = F.min(F.struct(rank.alias("r"), (-F.col("cycle")).alias("c"), F.coalesce("designation", F.lit("")).alias("d"), "candidate", "designation"))
    per = links.join(member, "candidate").groupBy("committee").agg(
        F.countDistinct("member").alias("members"), F.min("member").alias("member"), best.alias("b"), F.array_sort(F.collect_set("cycle")).alias("cycles"))
    there = edges.filter("relation = 'affiliated_with'").select("source_id", F.col("target_id").alias("member"), F.lit(True).alias("there")).distinct()
    out = per.join(held, "committee", "left").join(there, ["source_id", "member"], "left")
    status = (
        F.when(F.col("members") > 1, "ambiguous_member").when(F.col("holders").isNull(), "not_in_graph").when(F.col("holders") > 1, "ambiguous_committee")
        .when(F.col("source_id") == F.col("member"), "self").when(F.col("there"), "reused").otherwise("new")
    )
    sure = status.isin("new", "reused", "self")
    return out.select(
        "committee", F.when(sure, F.col("source_id")).alias("source_id"), F.when(sure, F.col("member")).alias("target_id"), F.col("b.candidate").alias("candidate"),
        F.col("b.designation").alias("designation"), "cycles", status.alias("status"))
