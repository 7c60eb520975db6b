"""Money-flow attribution: contributors through sponsors to contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import materialize
from .gates import label_of, published


def party_recipients(g: Graph, party: str) -> DataFrame:
    """id: members of a party and the committees affiliated with them."""
    members = g.aliases.filter((F.col("source_system") == "party") & (F.col("source_id") == party)).select(F.col("canonical_id").alias("id"))
    return _with_committees(g, members)


def _with_committees(g: Graph, members: DataFrame) -> DataFrame:
    pacs = g.entities.filter("type = 'pac'").select(F.col("id").alias("source_id"))
    bridge = g.edges.filter("relation = 'affiliated_with'").join(members.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    committees = bridge.join(pacs, "source_id", "left_semi").select(F.col("source_id").alias("id"))
    return members.union(committees).distinct()


def contributions(edges: DataFrame, recipients: DataFrame) -> DataFrame:
    """source_id, total given to the recipients; a null weight adds nothing."""
    given = edges.filter("relation = 'contributes_to'").join(recipients.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return given.groupBy("source_id").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))


def sponsors(g: Graph) -> DataFrame:
    """pac, sponsor: the organisation that a committee is affiliated with; of several the smallest id."""
    orgs = g.entities.filter("type = 'organization'").select(F.col("id").alias("target_id"))
    aff = g.edges.filter("relation = 'affiliated_with'").join(orgs, "target_id", "left_semi")
    return aff.groupBy(F.col("source_id").alias("pac")).agg(F.min("target_id").alias("sponsor"))


def attribute(totals: DataFrame, sponsor: DataFrame) -> DataFrame:
    """entity, contributed: a committee's positive total goes to its sponsor, one hop."""
    moved = totals.join(sponsor, totals["source_id"] == sponsor["pac"], "left")
    to = F.when((F.col("total") > 0) & F.col("sponsor").isNotNull(), F.col("sponsor")).otherwise(F.col("source_id"))
    return moved.groupBy(to.alias("entity")).agg(F.sum("total").alias("contributed"))


def without_members(totals: DataFrame, aliases: DataFrame) -> DataFrame:
    members = aliases.filter("source_system = 'bioguide'").select(F.col("canonical_id").alias("entity"))
    return totals.join(members, "entity", "left_anti")


def contracts(edges: DataFrame, relation: str = "holds_contract", agencies: DataFrame | None = None) -> DataFrame:
    held = edges.filter(F.col("relation") == relation)
    if agencies is not None:
        held = held.join(agencies.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return held.groupBy(F.col("source_id").alias("entity")).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("contracts"))


def _rank(g: Graph, recipients: DataFrame, contracted: DataFrame, limit: int, preview: bool) -> DataFrame:
    edges = published(g.edges, preview)
    given = without_members(attribute(contributions(edges, recipients), sponsors(Graph(g.entities, g.aliases, edges, g.citations))), g.aliases)
    both = given.join(contracted, "entity").filter("contributed > 0 AND contracts > 0")
    named = published(g.entities, preview).filter("surface_mode <> 'suppress'").select(F.col("id").alias("entity"), "type", label_of().alias("label"))
    out = both.join(named, "entity").select(
        "entity", "label", "type", F.round("contributed", 2).alias("contributed"), F.round("contracts", 2).alias("contracts")
    )
    return out.orderBy(F.desc("contracts"), F.desc("contributed"), "entity").limit(limit)


def model1(g: Graph, party: str, limit: int = 50, preview: bool = False) -> DataFrame:
    """Organisations that gave to a party's members and hold contracts, largest contracts first."""
    edges = published(g.edges, preview)
    gated = Graph(g.entities, g.aliases, edges, g.citations)
    return _rank(g, party_recipients(gated, party), contracts(edges), limit, preview)


def voters(g: Graph, bill: str, party: str | None = None) -> DataFrame:
    yes = g.edges.filter((F.col("relation") == "voted_for") & (F.col("target_id") == bill)).select(F.col("source_id").alias("id"))
    if party:
        ids = g.aliases.filter((F.col("source_system") == "party") & (F.col("source_id") == party)).select(F.col("canonical_id").alias("id"))
        yes = yes.join(ids, "id", "left_semi")
    return yes.distinct()


def scope_agencies(entities: DataFrame, substrings: list[str]) -> DataFrame:
    """Agencies whose lower-cased name holds any of the substrings; none if there are no substrings."""
    hit = F.lit(False)
    for s in substrings:
        hit = hit | F.lower("name").contains(s.lower())
    return entities.filter((F.col("type") == "agency") & hit)


def model2(g: Graph, bill: str, scope: list[str], party: str | None = None, limit: int = 50, preview: bool = False) -> DataFrame:
    """The same for the yes voters of a bill, with contracts of the agencies in the bill's scope."""
    edges = published(g.edges, preview)
    gated = Graph(g.entities, g.aliases, edges, g.citations)
    recipients = _with_committees(gated, voters(gated, bill, party))
    return _rank(g, recipients, contracts(edges, agencies=scope_agencies(g.entities, scope)), limit, preview)


def captured_total(g: Graph, ids: DataFrame) -> DataFrame:
    """entity, captured, has_pac: everything that an entity and its committees gave, whoever received it."""
    own = ids.select(F.col("id").alias("entity"), F.col("id").alias("source_id"))
    theirs = g.edges.filter("relation = 'affiliated_with'").select(F.col("target_id").alias("entity"), "source_id").join(ids.withColumnRenamed("id", "entity"), "entity", "left_semi")
    pacs = g.entities.filter("type = 'pac'").select(F.col("id").alias("source_id"), F.lit(True).alias("pac"))
    pairs = own.union(theirs).distinct().join(pacs, "source_id", "left")
    given = g.edges.filter("relation = 'contributes_to'").groupBy("source_id").agg(F.sum("weight").alias("w"))
    return pairs.join(given, "source_id", "left").groupBy("entity").agg(
        F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 2).alias("captured"), F.coalesce(F.bool_or("pac"), F.lit(False)).alias("has_pac")
    )


def top_citations(edges: DataFrame, citations: DataFrame, n: int) -> DataFrame:
    """Per source entity the n citations of its heaviest edges, each URL once, empty URLs never."""
    joined = citations.filter("coalesce(citation_url, '') <> ''").join(edges.select(F.col("id").alias("edge_id"), "source_id", "weight"), "edge_id")
    return best_citations(joined, n)


def best_citations(joined: DataFrame, n: int, source: str = "source_id") -> DataFrame:
    """The same of citations that have met their edges (with source_id and weight). ``source``: a column that tells sources
    apart as source_id does; rows that are dealt by it stay where they are."""
    order = [F.coalesce("weight", F.lit(0.0)).desc(), F.col("edge_id"), F.col("id"), F.col("citation_url"), F.col("kind")]
    once = joined.withColumn("_u", F.row_number().over(W.partitionBy(source, "citation_url").orderBy(*order))).filter("_u = 1")
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.select("source_id", "rank", "citation_url", "kind", "edge_id")


def bill_of(entities: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """id of the bill that a text names: the one with that identifier, else the only bill whose name holds the text,
    whatever its case. No row if there is none, or several by name; of several by identifier the smallest id."""
    bills = entities.filter("type = 'bill'").select("id", "name")
    known = aliases.filter((F.col("source_system") == "congress.bill") & (F.lower(F.trim("source_id")) == text.strip().lower())).select(F.col("canonical_id").alias("id"))
    by_id = bills.join(known, "id", "left_semi").agg(F.min("id").alias("id"), F.lit(1).alias("p")).filter("id IS NOT NULL")
    hit = bills.filter(F.lower("name").contains(text.strip().lower())) if text.strip() else bills.limit(0)
    by_name = hit.agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("id", F.lit(2).alias("p"))
    return by_id.unionByName(by_name).agg(F.min_by("id", "p").alias("id")).filter("id IS NOT NULL")


def rollup(rows: DataFrame) -> DataFrame:
    """One row over the rows that are returned: total_contributed, total_contracts, entities. Zero for none.

    ``rows`` should be a written table (:func:`report` gives one), or the limit is worked out once more."""
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return rows.agg(total("contributed").alias("total_contributed"), total("contracts").alias("total_contracts"), F.count("*").alias("entities"))


def report(g: Graph, rows: DataFrame, recipients: DataFrame, per_side: int = 3, preview: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a model with ``captured`` and ``has_pac``, their best citations (entity, side, rank, citation_url), and
    the totals. The ranked and limited rows are written once, and all three read them from there, so captured
    money and citations are looked up for what is returned alone.

    Contracts are cited by the entity's own edges, contributions by those of the sources whose money it was given
    credit for, to these recipients.
    """
    rows = materialize(rows)
    ids = rows.select(F.col("entity").alias("id"))
    edges = published(g.edges, preview)
    gated = Graph(g.entities, g.aliases, edges, g.citations)
    full = rows.join(captured_total(gated, ids), "entity", "left")
    own = edges.filter("relation = 'holds_contract'").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    totals = contributions(edges, recipients)
    moved = totals.join(sponsors(gated), totals["source_id"] == F.col("pac"), "left")
    credit = moved.select("source_id", F.when((F.col("total") > 0) & F.col("sponsor").isNotNull(), F.col("sponsor")).otherwise(F.col("source_id")).alias("entity"))
    credit = credit.join(rows.select("entity"), "entity", "left_semi")
    given = edges.filter("relation = 'contributes_to'").join(recipients.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    given = given.join(credit, "source_id").withColumn("source_id", F.col("entity"))
    side = lambda held, name: top_citations(held, g.citations, per_side).select(F.col("source_id").alias("entity"), F.lit(name).alias("side"), "rank", "citation_url")
    return full, side(own, "contracts").unionByName(side(given, "contributions")), rollup(rows)
