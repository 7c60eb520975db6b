"""Reports over returned rows, receipts of dossiers, citations of co-occurrence, rebuilt relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Graph
from ..operators import edges, flow, graph
from ..sinks import snapshot
from ..storage import materialize
from .group_cd import RECIPIENTS, SPONSORED
from .group_ef import _RANK, MODEL1, MODEL2, _published_edges
from .views import duck, table, view
from .views import graph as load


def _report(s, d):
    g = load(s, d)
    # written once: the model and its report read the edges some ten times
    g = Graph(g.entities, g.aliases, materialize(g.edges.select("id", "source_id", "target_id", "relation", "weight", "publication_state")), g.citations)
    gated = Graph(g.entities, g.aliases, g.edges.filter("publication_state = 'published'"), g.citations)
    return flow.report(g, flow.model1(g, "Democratic"), flow.party_recipients(gated, "Democratic"))


def _rollup(s, d, rows):
    return flow.rollup(materialize(rows))


_TOTALS = "SELECT round(coalesce(sum(contributed), 0), 2) AS total_contributed, round(coalesce(sum(contracts), 0), 2) AS total_contracts, count(*) AS entities FROM ({})"
_BASE = f"""WITH pe AS (SELECT * FROM v_edge WHERE publication_state = 'published'), {_published_edges(RECIPIENTS)}, {_published_edges(SPONSORED)},
  con AS (SELECT source_id AS entity, sum(weight) AS contracts FROM pe WHERE relation = 'holds_contract' GROUP BY 1), res AS ({_RANK})"""
_CAPTURED = _BASE + """, ps AS (SELECT entity, entity AS source_id FROM res UNION SELECT target_id, source_id FROM pe WHERE relation = 'affiliated_with' AND target_id IN (SELECT entity FROM res)),
  w AS (SELECT source_id, sum(weight) AS w FROM pe WHERE relation = 'contributes_to' GROUP BY 1),
  cap AS (SELECT entity, round(coalesce(sum(w), 0), 2) AS captured, coalesce(bool_or(e.type = 'pac'), false) AS has_pac FROM ps LEFT JOIN w USING (source_id) LEFT JOIN v_entity e ON e.id = ps.source_id GROUP BY 1)
  SELECT res.*, captured, has_pac FROM res LEFT JOIN cap USING (entity)"""
_CITED = _BASE + """, cr AS (SELECT source_id, CASE WHEN total > 0 AND sponsor IS NOT NULL THEN sponsor ELSE source_id END AS entity FROM tot LEFT JOIN sp ON pac = source_id),
  hd AS (SELECT source_id AS entity, 'contracts' AS side, id AS edge_id, weight FROM pe WHERE relation = 'holds_contract' AND source_id IN (SELECT entity FROM res)
    UNION ALL SELECT cr.entity, 'contributions', pe.id, weight FROM pe JOIN cr ON cr.source_id = pe.source_id WHERE relation = 'contributes_to' AND target_id IN (SELECT id FROM rec) AND cr.entity IN (SELECT entity FROM res)),
  j AS (SELECT hd.*, c.citation_url, c.id AS cid, c.kind FROM hd JOIN v_citation c USING (edge_id) WHERE coalesce(c.citation_url, '') <> ''),
  u AS (SELECT *, row_number() OVER (PARTITION BY side, entity, citation_url ORDER BY coalesce(weight, 0) DESC, edge_id, cid, citation_url, kind) AS rn FROM j),
  r AS (SELECT *, row_number() OVER (PARTITION BY side, entity ORDER BY coalesce(weight, 0) DESC, edge_id, cid, citation_url, kind) AS rank FROM u WHERE rn = 1)
  SELECT entity, side, rank, citation_url FROM r WHERE rank <= 3"""


def _disclosed(s, d):
    """Suppliers that traded in parts and owe customers, cited by pages of filings, with the filings' rows."""
    # written once with numbers for keys: edges, citations and filing rows all read it
    f = materialize(view(s, d, "v_fact").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "l_quantity", "l_returnflag", "o_orderdate"))
    traded = F.concat(F.lit("W:"), F.col("l_partkey").cast("string"))
    owed = F.concat(F.lit("C:"), F.col("o_custkey").cast("string"))
    me, deal = F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")), F.col("l_linenumber") % 2 == 0
    rows = f.select(
        me.alias("source_id"), F.when(deal, traded).otherwise(owed).alias("target_id"), F.when(deal, "traded").otherwise("owes").alias("relation"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "l_quantity").alias("row"), F.when(F.col("l_quantity") > 5, F.col("l_linenumber")).cast("int").alias("page"), "l_returnflag", "l_quantity", "o_orderdate",
    ).withColumn("edge_id", F.concat_ws("|", "relation", "source_id", "target_id"))
    # lines that agree in all that a reference shows may still say different things: a filing's row has them all in its id
    own = F.concat_ws("-", "row", "l_returnflag", F.date_format("o_orderdate", "yyyy-MM-dd"))
    edges = rows.select(F.col("edge_id").alias("id"), "source_id", "target_id", "relation").distinct().withColumns({"weight": F.lit(None).cast("double"), "publication_state": F.lit("published"), "batch_id": F.lit("b")})
    cites = rows.select(
        F.concat(F.lit("x"), "row").alias("id"), "edge_id", F.when(F.col("l_returnflag") == "A", "oge_278t").when(F.col("l_returnflag") == "R", "oge_278e").otherwise("fec_filing").alias("kind"),
        F.concat(F.lit("https://filings.example/#page="), F.coalesce(F.col("page").cast("string"), F.lit(""))).alias("citation_url"), F.col("row").alias("citation_ref"), own.alias("disclosure_row_id"), "page")
    parsed = F.when(F.col("l_quantity") % 7 == 0, "{not json").otherwise(F.to_json(F.struct(F.col("l_returnflag").alias("transaction_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("trade_date"), F.when(F.col("l_quantity") % 5 > 0, F.lit("$0 - $200")).alias("amount_band"))))
    known = rows.filter("l_quantity % 11 > 0").select(own.alias("id"), parsed.alias("parsed"))
    return Graph(view(s, d, "v_entity"), view(s, d, "v_alias"), edges, cites), known


def _receipts(s, d, what):
    g, known = _disclosed(s, d)
    out = graph.receipts(g, view(s, d, "v_entity").filter("id LIKE 'S:%'").select("id"), known)
    x = F.posexplode(what)
    at = out.select("id", "relation", "other", x.alias("place", "x"))
    if what == "receipts":
        return at.select("id", "relation", "other", F.col("place").cast("long").alias("place"), "x.kind", "x.url", "x.ref", "x.page")
    return at.select("id", "relation", "other", F.col("place").cast("long").alias("place"), "x.type", "x.date", "x.amount_band", "x.page", "x.url")


_DISCLOSED = """t AS (SELECT 'S:' || l_suppkey::VARCHAR AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'W:' || l_partkey::VARCHAR ELSE 'C:' || o_custkey::VARCHAR END AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'traded' ELSE 'owes' END AS relation,
    concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, o_custkey::VARCHAR, l_quantity::VARCHAR) AS row, CASE WHEN l_quantity > 5 THEN l_linenumber END::INT AS page,
    CASE l_returnflag WHEN 'A' THEN 'oge_278t' WHEN 'R' THEN 'oge_278e' END AS kind, l_returnflag, l_quantity, o_orderdate FROM v_fact),
  ok AS (SELECT id FROM v_entity WHERE publication_state = 'published' AND surface_mode = 'open'),
  rc AS (SELECT *, 'https://filings.example/#page=' || coalesce(page::VARCHAR, '') AS url, row_number() OVER w - 1 AS place, l_quantity % 11 > 0 AS known FROM t
    WHERE kind IS NOT NULL AND source IN (SELECT id FROM ok) AND target IN (SELECT id FROM ok) WINDOW w AS (PARTITION BY source, target, relation ORDER BY coalesce(page, 0), row))"""

def _artifacts(s, d):
    """Orders as artifacts; some have no slug yet, some are not known."""
    o = table(s, d, "orders").filter("o_orderstatus <> 'P'")
    slug = F.when(F.col("o_orderstatus") == "F", F.concat(F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("-"), F.col("o_orderkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("artifact_id"), F.lit("news").alias("kind"), slug.alias("slug"))


_ARTIFACTS = "ar AS (SELECT o_orderkey AS artifact_id, CASE WHEN o_orderstatus = 'F' THEN lower(substr(o_orderpriority, 3, 20)) || '-' || o_orderkey::VARCHAR END AS slug FROM orders WHERE o_orderstatus <> 'P')"
_URL = """CASE WHEN coalesce(ar.slug, '') <> '' THEN 'https://read.example/' || ar.slug ELSE 'ref://' || CASE WHEN ar.artifact_id IS NULL THEN 'artifact' ELSE 'news' END || '/' || p.artifact_id::VARCHAR END"""


def _cited_pairs(s, d):
    """Two runs: the first has cited the artifacts of small ids, the second cites the others."""
    m, a = view(s, d, "v_mention"), _artifacts(s, d)
    old = edges.pair_citations(m.filter("artifact_id < 500"), a, "https://before.example")
    return edges.pair_citations(m, a, "https://read.example", old)


def _rebuilt(s, d):
    """Contracts wiped and ingested again from the orders of the last years."""
    f, old, cites = view(s, d, "v_fact").filter("o_orderdate >= '1995-01-01'"), view(s, d, "v_edge"), view(s, d, "v_citation")
    part = lambda c: F.concat(F.lit("B:"), c)
    new = f.groupBy(part("p_brand").alias("source_id"), F.concat(F.lit("P:"), "o_orderpriority").alias("target_id")).agg(F.sum("amt").cast("double").alias("weight"))
    new = new.select(F.concat_ws("|", F.lit("holds_contract"), "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("holds_contract").alias("relation"), "weight")
    was = old.select(*new.columns)
    after, _ = snapshot.replaced(was, cites, "holds_contract", new, cites.limit(0))
    return snapshot.changes(was, after, "relation")


QUERIES = {
    "pair_citations": (
        _cited_pairs,
        duck(f"""WITH {_ARTIFACTS}, m AS (SELECT DISTINCT artifact_id, canonical_id FROM v_mention), p AS (SELECT a.artifact_id, a.canonical_id AS s, b.canonical_id AS t FROM m a JOIN m b ON a.artifact_id = b.artifact_id AND a.canonical_id < b.canonical_id)
          SELECT 'mentioned_with|' || s || '|' || t AS edge_id, 'article_permalink' AS kind, {_URL} AS citation_url, p.artifact_id::VARCHAR AS citation_ref FROM p LEFT JOIN ar ON ar.artifact_id = p.artifact_id WHERE p.artifact_id >= 500"""),
    ),
    "rebuild_changes": (
        _rebuilt,
        duck("""WITH b AS (SELECT relation, count(*) AS n FROM v_edge GROUP BY 1), a AS (SELECT relation, n FROM b WHERE relation <> 'holds_contract'
            UNION ALL SELECT 'holds_contract', count(*) FROM (SELECT DISTINCT p_brand, o_orderpriority FROM v_fact WHERE o_orderdate >= DATE '1995-01-01'))
          SELECT coalesce(b.relation, a.relation) AS relation, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.relation = b.relation"""),
    ),
    "flow_model1_rollup": (lambda s, d: _report(s, d)[2], _TOTALS.format(MODEL1)),
    "flow_model2_rollup": (lambda s, d: _rollup(s, d, flow.model2(load(s, d), "P:1-URGENT", ["1", "2"])), _TOTALS.format(MODEL2)),
    "flow_model1_captured": (lambda s, d: _report(s, d)[0], duck(_CAPTURED)),
    "flow_model1_citations": (lambda s, d: _report(s, d)[1], duck(_CITED)),
    "dossier_receipts": (
        lambda s, d: _receipts(s, d, "receipts"),
        duck(f"WITH {_DISCLOSED} SELECT source AS id, relation, target AS other, place, kind, url, row AS ref, page FROM rc"),
    ),
    "dossier_transactions": (
        lambda s, d: _receipts(s, d, "transactions"),
        duck(f"""WITH {_DISCLOSED} SELECT source AS id, relation, target AS other, row_number() OVER (PARTITION BY source, target, relation ORDER BY place) - 1 AS place, CASE WHEN l_quantity % 7 > 0 THEN l_returnflag END AS type,
          CASE WHEN l_quantity % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN l_quantity % 7 > 0 AND l_quantity % 5 > 0 THEN '$0 - $200' END AS amount_band, page, url FROM rc WHERE known AND relation = 'traded'"""),
    ),
}
