"""Rosters, committee bridges and parties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, resolve, roster, scrutiny
from ..storage import materialize
from .group_ab import norm_sql
from .views import duck, edge_keys, table, view

#: Candidate ids: a supplier's own, one that a committee bears, and one that two suppliers bear.
_CANDIDATES = """SELECT 'S:' || CAST(s_suppkey AS VARCHAR(20)) AS canonical_id, 'fec.candidate' AS source_system, 'H' || CAST(s_suppkey AS VARCHAR(20)) AS source_id, s_name AS surface_name FROM {supplier}
  UNION ALL SELECT 'K:' || CAST(s_suppkey AS VARCHAR(20)), 'fec.candidate', 'Z' || CAST(s_suppkey AS VARCHAR(20)), s_name FROM {supplier}
  UNION ALL SELECT 'S:' || CAST(s_suppkey + d AS VARCHAR(20)), 'fec.candidate', 'Y' || CAST(s_suppkey AS VARCHAR(20)), s_name FROM {supplier} CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) t"""


def _aliases(s, d):
    return view(s, d, "v_twin_alias").unionByName(s.sql(_CANDIDATES, supplier=table(s, d, "supplier")))


def _links(s, d):
    li, o = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("cycle"))
    k = F.col("l_suppkey")
    kind = F.when(k % 7 == 3, F.concat(F.lit("Z"), k)).when(k % 11 == 5, F.concat(F.lit("Y"), k)).when((k % 5 == 1) & (F.col("l_linenumber") == 3), F.concat(F.lit("H"), k + 1)).otherwise(F.concat(F.lit("H"), k))
    number = F.when(k % 13 == 6, k + 50000000).otherwise(k + 10000000)
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("C"), number).alias("committee"), kind.alias("candidate"), F.element_at(F.array(*map(F.lit, "PADJU")), (F.col("l_orderkey") % 5 + 1).cast("int")).alias("designation"), "cycle")


_BRIDGE = f"""al AS (SELECT * FROM v_twin_alias UNION ALL {_CANDIDATES.replace('{supplier}', 'supplier')}),
  ln AS (SELECT 'C' || (CASE WHEN l_suppkey % 13 = 6 THEN l_suppkey + 50000000 ELSE l_suppkey + 10000000 END)::VARCHAR AS committee, year(o_orderdate) AS cycle, substr('PADJU', (l_orderkey % 5 + 1)::INT, 1) AS designation,
    CASE WHEN l_suppkey % 7 = 3 THEN 'Z' || l_suppkey::VARCHAR WHEN l_suppkey % 11 = 5 THEN 'Y' || l_suppkey::VARCHAR WHEN l_suppkey % 5 = 1 AND l_linenumber = 3 THEN 'H' || (l_suppkey + 1)::VARCHAR ELSE 'H' || l_suppkey::VARCHAR END AS candidate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  mb AS (SELECT ln.*, canonical_id AS member FROM ln JOIN al ON source_system = 'fec.candidate' AND source_id = candidate),
  pr AS (SELECT committee, count(DISTINCT member) AS members, min(member) AS member, list_sort(list(DISTINCT cycle)) AS cycles,
    arg_min(struct_pack(c := candidate, d := designation), (CASE designation WHEN 'P' THEN 0 WHEN 'A' THEN 1 WHEN 'D' THEN 2 WHEN 'J' THEN 3 WHEN 'U' THEN 4 ELSE 9 END, -cycle, designation, candidate)) AS b FROM mb GROUP BY 1),
  hd AS (SELECT source_id AS committee, count(DISTINCT canonical_id) AS holders, min(canonical_id) AS source FROM al WHERE source_system IN ('fec.disbursement.recipient', 'fec.committee', 'fec.affiliated_committee') AND source_id LIKE 'C%' GROUP BY 1),
  st AS (SELECT pr.*, source, CASE WHEN members > 1 THEN 'ambiguous_member' WHEN holders IS NULL THEN 'not_in_graph' WHEN holders > 1 THEN 'ambiguous_committee' WHEN source = member THEN 'self'
    WHEN EXISTS (SELECT 1 FROM v_edge e WHERE e.relation = 'affiliated_with' AND e.source_id = source AND e.target_id = member) THEN 'reused' ELSE 'new' END AS status FROM pr LEFT JOIN hd USING (committee))
  SELECT committee, CASE WHEN status IN ('new', 'reused', 'self') THEN source END AS source_id, CASE WHEN status IN ('new', 'reused', 'self') THEN member END AS target_id, b.c AS candidate, b.d AS designation,
    array_to_string(cycles, ',') AS cycles, status FROM st"""


def _members(s, d):
    """Two members a supplier under its name, the first with candidate ids, and one a customer, some known already."""
    p, c = table(s, d, "supplier"), table(s, d, "customer")
    ids = F.array(F.concat(F.lit("Y"), "s_suppkey"), F.concat(F.lit("H"), "s_suppkey"))
    first = p.select(F.concat(F.lit("A"), "s_suppkey").alias("member"), F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 3 == 0, ids).otherwise(F.array().cast("array<string>")).alias("candidates"), F.col("s_suppkey").alias("at"))
    second = p.select(F.concat(F.lit("B"), "s_suppkey").alias("member"), F.upper("s_name").alias("label"), F.array(F.concat(F.lit("Y"), F.col("s_suppkey") - 1)).alias("candidates"), (F.col("s_suppkey") % 50).alias("at"))
    third = c.select(F.concat(F.lit("M"), "c_custkey").alias("member"), F.col("c_name").alias("label"), F.array().cast("array<string>").alias("candidates"), F.lit(0).cast("long").alias("at"))
    return first.unionByName(second).unionByName(third)


_MEMBERS = f"""al AS MATERIALIZED (SELECT * FROM v_twin_alias UNION ALL {_CANDIDATES.replace('{supplier}', 'supplier')}),
  mem AS (SELECT 'A' || s_suppkey::VARCHAR AS member, s_name AS label, CASE WHEN s_suppkey % 3 = 0 THEN ['Y' || s_suppkey::VARCHAR, 'H' || s_suppkey::VARCHAR] ELSE [] END AS candidates, s_suppkey AS pos FROM supplier
    UNION ALL SELECT 'B' || s_suppkey::VARCHAR, upper(s_name), ['Y' || (s_suppkey - 1)::VARCHAR], s_suppkey % 50 FROM supplier UNION ALL SELECT 'M' || c_custkey::VARCHAR, c_name, [], 0 FROM customer),
  ent AS MATERIALIZED (SELECT id, type, surface_mode, {norm_sql('name')} AS norm FROM v_twin),
  hold AS MATERIALIZED (SELECT canonical_id AS id, list(DISTINCT source_system) AS systems, list(DISTINCT source_id) FILTER (source_system = 'bioguide') AS bios FROM al
    WHERE source_system IN ('bioguide', 'fec.candidate', 'fec.committee', 'fec.affiliated_committee', 'sec.cik', 'senate_lda.registrant') GROUP BY 1),
  off AS (SELECT member, pos, 0 AS level, 0 AS place, canonical_id AS entity FROM mem JOIN al ON source_system = 'bioguide' AND source_id = member
    UNION ALL SELECT member, pos, 1, i, canonical_id FROM (SELECT member, pos, candidates, unnest(range(1, len(candidates) + 1)) AS i FROM mem) JOIN al ON source_system = 'fec.candidate' AND source_id = candidates[i]
    UNION ALL SELECT member, pos, 2, 0, ent.id FROM mem JOIN ent ON ent.norm = {norm_sql('label')} AND ent.norm <> '' LEFT JOIN hold ON hold.id = ent.id
      WHERE type = 'person' AND surface_mode = 'open' AND (bios IS NULL OR bios = [member]) AND (systems IS NULL OR systems = ['bioguide'])),
  stp AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY level, pos, member) AS n FROM (SELECT member, pos, level, list(entity ORDER BY place, entity) AS opts FROM off GROUP BY 1, 2, 3)),
  wlk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS taken, []::VARCHAR[] AS served, NULL::VARCHAR AS member, NULL::VARCHAR AS entity, NULL::INT AS level
    UNION ALL SELECT n, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, CASE WHEN got IS NULL THEN served ELSE list_append(served, member) END, member, got, level FROM (
      SELECT s.n, s.member, s.level, w.taken, w.served, CASE WHEN list_contains(w.served, s.member) THEN NULL ELSE list_filter(s.opts, lambda x: NOT list_contains(w.taken, x))[1] END AS got FROM wlk w JOIN stp s ON s.n = w.n + 1))
  SELECT mem.member, coalesce(g.entity, 'new:' || substr(sha256('bioguide|' || mem.member), 1, 16)) AS id, CASE g.level WHEN 0 THEN 'bioguide' WHEN 1 THEN 'fec.candidate' WHEN 2 THEN 'name_fragment' ELSE 'created' END AS how
  FROM mem LEFT JOIN (SELECT * FROM wlk WHERE entity IS NOT NULL) g ON g.member = mem.member"""

def _records(s, d):
    """Committee records of suppliers, half without a party, and candidate records of some."""
    p = table(s, d, "supplier")
    k = F.col("s_suppkey")
    ids = F.array(*[F.concat(F.lit("H"), k + i) for i in (0, 1, 2)])
    com = p.select(F.concat(F.lit("C"), k + 10000000).alias("fec_id"), F.when(k % 4 == 0, "REP").when(k % 4 == 1, " dem").alias("party"), F.when(k % 5 != 0, ids).alias("candidate_ids"))
    can = p.select(F.concat(F.lit("H"), k).alias("fec_id"), F.when(k % 3 == 0, "DFL").when(k % 3 == 1, "GRE").otherwise("rep").alias("party"))
    return com, can


_PARTIES = """al AS (SELECT * FROM v_twin_alias),
  td AS (SELECT fec_id, min(canonical_id) AS canonical_id FROM (SELECT canonical_id, min(source_id) AS fec_id FROM al WHERE source_system IN ('fec.committee', 'fec.disbursement.recipient')
    AND canonical_id NOT IN (SELECT canonical_id FROM al WHERE source_system = 'party') GROUP BY 1) WHERE fec_id NOT IN (SELECT source_id FROM al WHERE source_system = 'party') GROUP BY 1),
  own AS (SELECT 'C' || (s_suppkey + 10000000)::VARCHAR AS fec_id, CASE s_suppkey % 4 WHEN 0 THEN 'Republican' WHEN 1 THEN 'Democratic' END AS party, s_suppkey AS k FROM supplier),
  can AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Democratic' WHEN 2 THEN 'Republican' END AS party FROM supplier),
  far AS (SELECT own.fec_id, arg_min(can.party, can.k) AS party FROM own JOIN can ON can.k IN (own.k, own.k + 1) AND can.party IS NOT NULL WHERE own.party IS NULL AND own.k % 5 <> 0 GROUP BY 1)
  SELECT td.canonical_id, td.fec_id AS source_id, coalesce(own.party, far.party) AS party FROM td JOIN own USING (fec_id) LEFT JOIN far USING (fec_id) WHERE coalesce(own.party, far.party) IS NOT NULL"""

def _hints(s, d):
    """Entities of no type, one a part, and their mentions' hints as aliases."""
    e = table(s, d, "part").select(F.concat(F.lit("W:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "unknown").otherwise("topic").alias("type"))
    a = table(s, d, "lineitem").select(F.concat(F.lit("W:"), "l_partkey").alias("canonical_id"), F.when(F.col("l_returnflag") == "A", " Event").when(F.col("l_returnflag") == "R", "concept").when(F.col("l_linenumber") > 4, "person").alias("kind_hint"))
    return e, a


def _retyped(s, d):
    e, a = _hints(s, d)
    return resolve.type_shares(e, resolve.retyped(e, a))


_RETYPED = """WITH e AS (SELECT 'W:' || p_partkey::VARCHAR AS id, CASE WHEN p_size > 25 THEN 'unknown' ELSE 'topic' END AS type FROM part),
  n AS (SELECT 'W:' || l_partkey::VARCHAR AS id, CASE WHEN l_returnflag = 'A' THEN 'event' WHEN l_returnflag = 'R' THEN 'concept' WHEN l_linenumber > 4 THEN 'person' ELSE '' END AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2),
  b AS (SELECT id, kind FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, kind) = 1),
  a AS (SELECT CASE WHEN type = 'unknown' AND kind IN ('event', 'concept') THEN kind ELSE type END AS type FROM e LEFT JOIN b USING (id)),
  x AS (SELECT type, count(*) AS n FROM e GROUP BY 1), y AS (SELECT type, count(*) AS n FROM a GROUP BY 1)
  SELECT coalesce(x.type, y.type) AS type, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, round(100 * coalesce(x.n, 0) / (SELECT count(*) FROM e), 1) AS before_percent, round(100 * coalesce(y.n, 0) / (SELECT count(*) FROM e), 1) AS after_percent
  FROM x FULL JOIN y ON x.type = y.type"""


def _vote_edges(s, d):
    """Customers with an official id vote on the priorities of their orders, line by line."""
    li, o = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    v = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("M"), "o_custkey").alias("member"), F.concat(F.lit("P:"), "o_orderpriority").alias("bill"), F.when(F.col("l_returnflag") == "A", "Aye").when(F.col("l_returnflag") == "R", "NAY").otherwise("Present").alias("vote"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string")).alias("ref"), F.col("o_orderdate").alias("at")).withColumn("url", F.concat(F.lit("https://votes.example/"), "ref"))
    have = v.filter("at < '1993-01-01' AND vote = 'NAY'").select(F.concat(F.lit("C:"), F.substring("member", 2, 20)).alias("source_id"), F.col("bill").alias("target_id"), F.lit("voted_against").alias("relation"))
    return resolve.vote_edges(v, view(s, d, "v_alias"), have)


_VOTES = """WITH v AS (SELECT 'C:' || o_custkey::VARCHAR AS source_id, 'M' || o_custkey::VARCHAR AS member, 'P:' || o_orderpriority AS target_id, CASE l_returnflag WHEN 'A' THEN 'voted_for' WHEN 'R' THEN 'voted_against' END AS relation,
    lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber::VARCHAR AS ref, o_orderdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT v.source_id, v.target_id, v.relation, arg_min(ref, (at, ref)) AS citation_ref, 'https://votes.example/' || arg_min(ref, (at, ref)) AS citation_url FROM v
  WHERE relation IS NOT NULL AND member IN (SELECT source_id FROM v_alias WHERE source_system = 'bioguide')
    AND NOT EXISTS (SELECT 1 FROM v w WHERE w.at < DATE '1993-01-01' AND w.relation = 'voted_against' AND w.source_id = v.source_id AND w.target_id = v.target_id AND w.relation = v.relation) GROUP BY 1, 2, 3"""

def _affiliations(s, d):
    """Suppliers' names with brands: some of either are nobody's, some affiliations are there."""
    p, b = table(s, d, "supplier"), table(s, d, "customer")
    k = F.col("s_suppkey")
    rows = p.select(F.when(k % 6 == 5, F.concat("s_name", F.lit(" Jr."))).otherwise(F.col("s_name")).alias("person"), F.concat(F.lit("Brand#"), k % 30 + 1).alias("company"))
    rows = rows.unionByName(b.select(F.col("c_name").alias("person"), F.concat(F.lit("Brand#"), F.col("c_custkey") % 20 + 1).alias("company")))
    rows = rows.withColumns({"citation_url": F.lit("https://registry.example"), "citation_ref": F.concat_ws(":", "person", "company")})
    # written once: degrees and the affiliations that are there all read the edges
    e = materialize(edge_keys(s, d))
    have = e.unionByName(e.filter("relation = 'voted_for'").withColumns({"relation": F.lit("affiliated_with"), "target_id": F.lit("B:Brand#12")}))
    return resolve.affiliations(rows, view(s, d, "v_twin"), have).select("person", "company", "source_id", "target_id", "status")


_AFFILIATED = """WITH ev AS MATERIALIZED (SELECT source_id, target_id, relation FROM v_edge UNION ALL SELECT source_id, 'B:Brand#12', 'affiliated_with' FROM v_edge WHERE relation = 'voted_for'),
  dg AS (SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM ev UNION ALL SELECT target_id FROM ev) GROUP BY 1),
  nm AS MATERIALIZED (SELECT name, type, id FROM v_twin LEFT JOIN dg ON node = id QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY coalesce(n, 0) DESC, id) = 1),
  cu AS (SELECT CASE WHEN s_suppkey % 6 = 5 THEN s_name || ' Jr.' ELSE s_name END AS person, 'Brand#' || (s_suppkey % 30 + 1)::VARCHAR AS company FROM supplier UNION ALL SELECT c_name, 'Brand#' || (c_custkey % 20 + 1)::VARCHAR FROM customer)
  SELECT person, company, p.id AS source_id, o.id AS target_id, CASE WHEN p.id IS NULL THEN 'person_not_found' WHEN o.id IS NULL THEN 'company_not_found'
    WHEN EXISTS (SELECT 1 FROM ev WHERE relation = 'affiliated_with' AND source_id = p.id AND target_id = o.id) THEN 'reused' ELSE 'new' END AS status
  FROM cu LEFT JOIN nm p ON p.name = person AND p.type = 'person' LEFT JOIN nm o ON o.name = company AND o.type = 'organization'"""


def _sweep(s, d):
    """Persons on whom no sweep has decided, those decided by hand among them."""
    log = view(s, d, "v_scrutiny").withColumn("decided_by", F.when(F.col("classification") == "public", "scrutiny.llm.v2").otherwise("by hand"))
    return scrutiny.sweep(view(s, d, "v_entity"), view(s, d, "v_alias"), log)[1]


QUERIES = {
    "affiliation_seeds": (_affiliations, duck(_AFFILIATED)),
    "scrutiny_sweep": (
        _sweep,
        duck("""WITH p AS (SELECT id, id IN (SELECT canonical_id FROM v_alias WHERE source_system IN ('bioguide', 'fec.committee', 'fec.candidate')) AS known FROM v_entity
            WHERE type = 'person' AND id NOT IN (SELECT canonical_id FROM v_scrutiny WHERE classification = 'public'))
          SELECT count(*) AS examined, count(*) FILTER (known) AS kept_open, 0::BIGINT AS aliased, count(*) FILTER (NOT known) AS suppressed FROM p"""),
    ),
    "retyped_shares": (_retyped, _RETYPED),
    "vote_edges": (_vote_edges, duck(_VOTES.replace(" at ", " day ").replace("(at,", "(day,").replace("w.at", "w.day").replace("AS at FROM", "AS day FROM"))),
    "party_enrichment": (
        lambda s, d: enrich.party_aliases(view(s, d, "v_twin_alias"), *_records(s, d)).select("canonical_id", "source_id", F.col("surface_name").alias("party")),
        duck(f"WITH {_PARTIES}"),
    ),
    "roster_resolve": (lambda s, d: roster.resolve_roster(_members(s, d), view(s, d, "v_twin"), _aliases(s, d)), duck(f"WITH RECURSIVE {_MEMBERS}")),
    "committee_bridge": (
        lambda s, d: roster.committee_bridge(_links(s, d), _aliases(s, d), view(s, d, "v_edge")).withColumn("cycles", F.array_join(F.col("cycles").cast("array<string>"), ",")),
        duck(f"WITH {_BRIDGE}"),
    ),
}
