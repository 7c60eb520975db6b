"""Graph queries: importance, bounded subgraphs, resolve, search, dossier, Cytoscape output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import kind_type, normalize_name
from ..model import DISCLOSURE_RELATIONS, Graph
from ..storage import materialize
from .edges import incident
from .gates import cited, label_of, published


def importance(g: Graph, preview: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """node, edges, citations, importance over published incident edges; of some ids alone, if given, whose
    edges and citations are then the only ones that are counted."""
    inc = incident(published(g.edges, preview).select("id", "source_id", "target_id"))
    cites = g.citations.select(F.col("edge_id").alias("id"))
    if ids is not None:
        inc = inc.join(ids.select(F.col("id").alias("node")), "node", "left_semi")
        cites = cites.join(inc.select("id"), "id", "left_semi")
    per = cites.groupBy("id").agg(F.count("*").alias("c"))
    return inc.join(per, "id", "left").groupBy("node").agg(
        F.count("*").alias("edges"), F.coalesce(F.sum("c"), F.lit(0)).alias("citations")
    ).withColumn("importance", F.col("edges") + F.col("citations"))


def neighbourhood(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """id, hop of everything within ``hops`` of the start ids. Each frontier is written once, not collected."""
    seen = frontier = materialize(start.select("id", F.lit(0).alias("hop")).distinct())
    inc = incident(edges.select("source_id", "target_id")).select("node", "other")
    for hop in range(1, max(hops, 1) + 1):
        reached = inc.join(frontier.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
        frontier = materialize(reached.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def subgraph(g: Graph, start: DataFrame, hops: int = 1, preview: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, hop) and edges around the start ids, over published and cited edges.

    Staged and suppressed nodes are left out, with every edge that touches one; so is a start that
    may not be shown, and then nothing is returned.
    """
    allowed = published(g.entities, preview).filter("surface_mode <> 'suppress'").select("id", "type", label_of().alias("label"))
    start = start.join(allowed, "id", "left_semi")
    # every hop and the edges inside read the cited edges: they are worked out once
    edges = materialize(cited(published(g.edges, preview), g.citations).select("id", "source_id", "target_id", "relation", "weight"))
    near = neighbourhood(start, edges, hops)
    nodes = near.join(allowed, "id")
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, inside.select("id", "source_id", "target_id", "relation", "weight")


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of JSON, for a bounded subgraph: {nodes: [{data}], edges: [{data}]}."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(F.struct("id", "label", "type").alias("data")))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.struct("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", "weight").alias("data")))).alias("edges"))
    one = F.lit(1).alias("_k")
    return n.select(one, "nodes").join(e.select(one, "edges"), "_k").select(F.to_json(F.struct("nodes", "edges")).alias("graph"))


def resolve(tags: DataFrame, g: Graph, preview: bool = False) -> DataFrame:
    """tag, id, label, how: a tag's entity by mention alias, then name, then any alias, then none.

    Repeated tags count once; suppressed and staged entities do not resolve; of several the smallest id.
    """
    asked = tags.select("tag").distinct().withColumn("norm", normalize_name(F.col("tag")))
    allowed = published(g.entities, preview).filter("surface_mode <> 'suppress'")
    surface = g.aliases.select("canonical_id", "source_system", normalize_name(F.col("surface_name")).alias("norm"))
    m = surface.filter("source_system = 'mention'").select("norm", F.col("canonical_id").alias("id"), F.lit(1).alias("p"))
    n = allowed.select(normalize_name(F.col("name")).alias("norm"), "id", F.lit(2).alias("p"))
    a = surface.filter("source_system <> 'mention'").select("norm", F.col("canonical_id").alias("id"), F.lit(3).alias("p"))
    found = asked.join(m.union(n).union(a), "norm").join(allowed.select("id", label_of().alias("label")), "id")
    best = found.groupBy("tag").agg(F.min(F.struct("p", "id", "label")).alias("b"))
    how = F.when(F.col("b.p") == 1, "mention").when(F.col("b.p") == 2, "name").when(F.col("b.p") == 3, "alias")
    return asked.join(best, "tag", "left").select("tag", F.col("b.id").alias("id"), F.col("b.label").alias("label"), how.alias("how"))


def lag_fill(tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """New entities for unresolved event and concept tags (tag, kind_hint): id from type and name."""
    todo = tags.join(resolved.filter("id IS NULL").select("tag"), "tag", "left_semi")
    typed = todo.select("tag", kind_type(F.col("kind_hint")).alias("type"), normalize_name(F.col("tag")).alias("norm")).filter("type IN ('event', 'concept') AND norm <> ''")
    return typed.groupBy("type", "norm").agg(F.min("tag").alias("name")).select(
        F.concat(F.lit("new:"), F.substring(F.sha2(F.concat_ws("|", "type", "norm"), 256), 1, 16)).alias("id"), "name", "norm", "type"
    )


def search(g: Graph, q: str, limit: int = 20, preview: bool = False) -> DataFrame:
    """Ranked search: exact 5, prefix 4, substring 3, alias prefix 2, alias substring 1; +2 for sources
    of disclosure edges; then importance, then label."""
    q = q.strip().lower()
    allowed = published(g.entities, preview).filter("surface_mode <> 'suppress'")
    name = F.lower("name")
    by_name = allowed.select("id", F.when(name == q, 5).when(name.startswith(q), 4).when(name.contains(q), 3).alias("tier"))
    surface = F.lower("surface_name")
    by_alias = g.aliases.select(F.col("canonical_id").alias("id"), F.when(surface.startswith(q), 2).when(surface.contains(q), 1).alias("tier"))
    # few: written, so that importance is counted for them alone and their own plan is not repeated
    hits = materialize(by_name.union(by_alias).filter("tier IS NOT NULL").groupBy("id").agg(F.max("tier").alias("tier")))
    filers = published(g.edges, preview).filter(F.col("relation").isin(*DISCLOSURE_RELATIONS)).select(F.col("source_id").alias("id")).distinct().withColumn("boost", F.lit(2))
    weight = importance(g, preview, hits).select(F.col("node").alias("id"), "importance")
    rows = hits.join(allowed.select("id", "type", label_of().alias("label")), "id").join(filers, "id", "left").join(weight, "id", "left")
    return rows.select(
        "id", "label", "type", (F.col("tier") + F.coalesce("boost", F.lit(0))).alias("tier"), F.coalesce("importance", F.lit(0)).alias("importance")
    ).orderBy(F.desc("tier"), F.desc("importance"), "label", "id").limit(limit)


def connections(g: Graph, ids: DataFrame, preview: bool = False) -> DataFrame:
    """Dossier rows: id, relation, other, label, weight, citations, rank; weights only if both ends are open."""
    allowed = published(g.entities, preview).filter("surface_mode <> 'suppress'").select("id", "surface_mode", label_of().alias("label"))
    inc = incident(published(g.edges, preview).select(F.col("id").alias("edge_id"), "source_id", "target_id", "relation", "weight"))
    mine = inc.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    n = g.citations.groupBy("edge_id").agg(F.count("*").alias("c"))
    me, you = allowed.select(F.col("id").alias("node"), F.col("surface_mode").alias("m1")), allowed.select(F.col("id").alias("other"), F.col("surface_mode").alias("m2"), "label")
    rows = mine.join(me, "node").join(you, "other").join(n, "edge_id", "left").select(
        F.col("node").alias("id"), "relation", "other", "label", "edge_id", F.when((F.col("m1") == "open") & (F.col("m2") == "open"), F.col("weight")).alias("weight"),
        F.coalesce("c", F.lit(0)).alias("citations"),
    )
    order = W.partitionBy("id", "relation").orderBy(F.desc("citations"), F.coalesce("weight", F.lit(0.0)).desc(), "label", "edge_id")
    return rows.withColumn("rank", F.row_number().over(order))


def receipts(g: Graph, ids: DataFrame, rows: DataFrame, preview: bool = False, kinds: tuple[str, ...] = ("oge_278e", "oge_278t")) -> DataFrame:
    """id, relation, other, edge_id, receipts, transactions of the dossiers of some ids.

    Receipts (kind, url, ref, page) stand in order of page, then ref, null first; both ends have to be open, or a
    page would tell who a hidden one is. Traded edges have a transaction for each receipt whose filing row
    is known: type, date and band out of its ``parsed`` JSON (``rows``: id, parsed; of several of one id the smallest), read
    as a variant, so a field that is absent, or JSON that is none, gives null. Edges without receipts are left out.
    """
    open_ = published(g.entities, preview).filter("surface_mode = 'open'").select("id")
    edges = published(g.edges, preview).select(F.col("id").alias("edge_id"), "source_id", "target_id", "relation")
    mine = incident(edges).join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    mine = mine.join(open_.withColumnRenamed("id", "node"), "node", "left_semi").join(open_.withColumnRenamed("id", "other"), "other", "left_semi")
    cites = g.citations.filter(F.col("kind").isin(*kinds)).select("edge_id", "kind", "citation_url", "citation_ref", "page", "disclosure_row_id")
    # a row that is there twice is still one row: joined as it is, it would repeat every receipt that names it
    parsed = rows.groupBy(F.col("id").alias("disclosure_row_id")).agg(F.min("parsed").alias("parsed")).select("disclosure_row_id", F.try_parse_json("parsed").alias("p"), F.lit(True).alias("known"))
    told = mine.join(cites, "edge_id").join(parsed, "disclosure_row_id", "left")
    field = lambda name: F.try_variant_get("p", f"$.{name}", "string")
    deal = F.struct(field("transaction_type").alias("type"), field("trade_date").alias("date"), field("amount_band").alias("amount_band"), "page", F.col("citation_url").alias("url"))
    told = told.select("node", "relation", "other", "edge_id", F.struct(
        F.coalesce("page", F.lit(0)).alias("at"), F.coalesce("citation_ref", F.lit("")).alias("by"),
        F.struct("kind", F.col("citation_url").alias("url"), F.col("citation_ref").alias("ref"), "page").alias("receipt"),
        F.when((F.col("relation") == "traded") & F.col("known"), deal).alias("deal"),
    ).alias("r"))
    per = told.groupBy("node", "relation", "other", "edge_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return per.select(
        F.col("node").alias("id"), "relation", "other", "edge_id", F.col("r.receipt").alias("receipts"), F.filter("r.deal", lambda x: x.isNotNull()).alias("transactions"))


def dossier(g: Graph, id_: str, preview: bool = False, per_relation: int = 50) -> DataFrame:
    """One row: id, label, type, prominence, articles, connections (JSON by relation). No row if not to be shown."""
    spark = g.entities.sparkSession
    ids = spark.createDataFrame([(id_,)], "id string")
    me = published(g.entities, preview).filter((F.col("id") == id_) & (F.col("surface_mode") != "suppress")).select("id", label_of().alias("label"), "type")
    rows = connections(g, ids, preview).filter(F.col("rank") <= per_relation)
    packed = rows.groupBy("id", "relation").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "label", "weight", "citations"))).alias("c"))
    nested = packed.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "c"))))).alias("connections"))
    edges = published(g.edges, preview).filter((F.col("source_id") == id_) | (F.col("target_id") == id_)).select(F.col("id").alias("edge_id"))
    articles = g.citations.filter("kind = 'article_permalink'").join(edges, "edge_id", "left_semi").select(F.lit(id_).alias("id"), "citation_url").distinct()
    urls = articles.groupBy("id").agg(F.array_sort(F.collect_list("citation_url")).alias("articles"))
    degree = edges.agg(F.count("*").alias("prominence")).select(F.lit(id_).alias("id"), "prominence")
    return me.join(degree, "id", "left").join(urls, "id", "left").join(nested, "id", "left")
