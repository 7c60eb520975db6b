"""Composite operators and scalar functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text as X
from ..model import ENTITY_TYPES, Graph
from ..operators import dedup, flow, graph, scrutiny
from ..storage import materialize
from .group_ab import _LABEL, norm_sql
from .group_cd import RECIPIENTS, SPONSORED
from .views import duck, table, view
from .views import graph as load

_GATED = """e AS (SELECT * FROM v_edge WHERE publication_state = 'published')"""
_RANK = f"""SELECT r.entity, n.label, n.type, round(contributed, 2) AS contributed, round(contracts, 2) AS contracts FROM att r JOIN con USING (entity)
  JOIN (SELECT id AS entity, type, {_LABEL} AS label FROM v_entity WHERE publication_state = 'published' AND surface_mode <> 'suppress') n USING (entity)
  WHERE contributed > 0 AND contracts > 0 AND entity NOT IN (SELECT canonical_id FROM v_alias WHERE source_system = 'bioguide')
  ORDER BY contracts DESC, contributed DESC, entity LIMIT 50"""


def _published_edges(sql: str) -> str:
    """The attribution CTEs over published edges only."""
    return sql.replace("FROM v_edge", "FROM pe").replace("pe e JOIN", "pe e JOIN")


MODEL1 = duck(f"""WITH pe AS (SELECT * FROM v_edge WHERE publication_state = 'published'), {_published_edges(RECIPIENTS)}, {_published_edges(SPONSORED)},
  con AS (SELECT source_id AS entity, sum(weight) AS contracts FROM pe WHERE relation = 'holds_contract' GROUP BY 1) {_RANK}""")

_VOTERS = """m AS (SELECT source_id AS id FROM v_edge WHERE relation = 'voted_for' AND target_id = 'P:1-URGENT' AND publication_state = 'published'),
  rec AS (SELECT id FROM m UNION SELECT e.source_id FROM v_edge e JOIN v_entity p ON p.id = e.source_id AND p.type = 'pac' WHERE e.relation = 'affiliated_with' AND e.target_id IN (SELECT id FROM m))"""
MODEL2 = duck(f"""WITH pe AS (SELECT * FROM v_edge WHERE publication_state = 'published'), {_published_edges(_VOTERS)}, {_published_edges(SPONSORED)},
  ag AS (SELECT id FROM v_entity WHERE type = 'agency' AND (contains(lower(name), '1') OR contains(lower(name), '2'))),
  con AS (SELECT source_id AS entity, sum(weight) AS contracts FROM pe WHERE relation = 'holds_contract' AND target_id IN (SELECT id FROM ag) GROUP BY 1) {_RANK}""")


def _start(spark):
    return spark.createDataFrame([("C:2",), ("B:Brand#12",)], "id string")


def _subgraph(s, d, hops):
    nodes, _ = graph.subgraph(load(s, d), _start(s), hops)
    return nodes.select("id", "hop", "label")


def _subgraph_edges(s, d):
    return graph.subgraph(load(s, d), _start(s), 1)[1].select("id", "weight")


_WALK = f"""ok AS (SELECT id, {_LABEL} AS label FROM v_entity WHERE publication_state = 'published' AND surface_mode <> 'suppress'),
  ce AS (SELECT id, source_id, target_id, weight FROM v_edge WHERE publication_state = 'published' AND id IN (SELECT edge_id FROM v_citation)),
  inc AS (SELECT source_id AS a, target_id AS b FROM ce UNION SELECT target_id, source_id FROM ce),
  h0 AS (SELECT id FROM ok WHERE id IN ('C:2', 'B:Brand#12')), h1 AS (SELECT DISTINCT b AS id FROM inc WHERE a IN (SELECT id FROM h0)),
  h2 AS (SELECT DISTINCT b AS id FROM inc WHERE a IN (SELECT id FROM h1))"""


def _twins(s, d):
    """The graph with entities that share names or identifiers across types."""
    g = load(s, d)
    return Graph(view(s, d, "v_twin"), view(s, d, "v_twin_alias"), g.edges, g.citations, g.scrutiny)


def _named(s, d):
    """The twins with their names normalised once: five rules and the gate read them from the written table."""
    g = _twins(s, d)
    return g, materialize(g.entities.withColumn("norm", X.normalize_name(F.col("name"))))


def _plan(s, d):
    """All pairs with what the gate says of them."""
    g, named = _named(s, d)
    pairs = dedup.ext_id_pairs(g.aliases).unionByName(dedup.exact_name_pairs(named)).unionByName(dedup.squashed_pairs(named)).unionByName(dedup.prefix_pairs(named))
    return dedup.gate(pairs, named).unionByName(dedup.former_name_gated(g.aliases, named))


def _accepted(s, d):
    """The graph, its entities with their names normalised, and accepted pairs that hold together what all accepted pairs do."""
    g, named = _named(s, d)
    pairs = dedup.ext_id_pairs(g.aliases).unionByName(dedup.exact_name_pairs(named)).unionByName(dedup.squashed_pairs(named)).unionByName(dedup.prefix_pairs(named, curated_only=True))
    accepted = dedup.gate(pairs, named).filter("outcome = 'accept'").select("a", "b", "rule", "outcome").unionByName(dedup.former_name_links(g.aliases, named))
    return g, named, materialize(accepted)


_KEY = """CASE source_system WHEN 'sec.cik' THEN 'sec_cik:' || regexp_replace(source_id, '^0+', '') WHEN 'fec.committee' THEN 'fec_committee:' || source_id WHEN 'bioguide' THEN 'bioguide:' || source_id END"""
#: Why two types may not merge, by name and by identifier, as the rules state them.
_BY_NAME = """CASE WHEN {0} = 'person' OR {1} = 'person' THEN 'person_name' WHEN {0} = {1} THEN NULL WHEN {0} = 'pac' OR {1} = 'pac' THEN 'pac_cross_type'
  WHEN {0} = 'unknown' OR {1} = 'unknown' THEN NULL WHEN least({0}, {1}) = 'concept' AND greatest({0}, {1}) = 'organization' THEN NULL ELSE 'incompatible_type' END"""
_BY_ID = """CASE WHEN {0} = {1} OR {0} = 'unknown' OR {1} = 'unknown' THEN NULL WHEN ({0} IN ('person', 'candidate')) <> ({1} IN ('person', 'candidate')) THEN 'ext_id_person_mismatch' END"""
_PAIRS = f"""en AS (SELECT *, {norm_sql('name')} AS norm FROM v_twin),
  keyed AS (SELECT DISTINCT canonical_id AS id, {_KEY} AS key, 'ext_id' AS rule FROM v_twin_alias WHERE source_system IN ('fec.committee', 'bioguide') OR (source_system = 'sec.cik' AND regexp_replace(source_id, '^0+', '') <> '')
    UNION ALL SELECT id, norm, 'exact_name' FROM en WHERE length(norm) >= 3 AND regexp_matches(norm, '[a-z]')
    UNION ALL SELECT id, replace(norm, ' ', ''), 'squashed_name' FROM en WHERE length(replace(norm, ' ', '')) >= 6 AND NOT regexp_matches(norm, '[0-9]')),
  lead AS (SELECT rule, key, min(id) AS a FROM keyed GROUP BY 1, 2),
  former AS (SELECT DISTINCT canonical_id AS x, {norm_sql('surface_name')} AS norm FROM v_twin_alias WHERE source_system = 'sec.former_name'),
  stems AS (SELECT id, norm AS full_norm, array_to_string(string_split(norm, ' ')[1:i], ' ') AS norm FROM en, range(1, 40) t(i) WHERE i < len(string_split(norm, ' '))),
  pairs AS (SELECT DISTINCT a, k.id AS b, rule, key AS evidence FROM keyed k JOIN lead USING (rule, key) WHERE k.id <> a
    UNION SELECT least(id, x), greatest(id, x), 'sec_former_name', norm FROM former JOIN en USING (norm) WHERE id <> x AND length(norm) >= 3 AND regexp_matches(norm, '[a-z]')
    UNION SELECT least(en.id, l.id), greatest(en.id, l.id), 'prefix_variant', norm FROM stems l JOIN en USING (norm)
      WHERE en.id <> l.id AND length(norm) >= 12 AND length(full_norm) - length(norm) <= 10 AND regexp_matches(norm, '[a-z]')),
  gated AS (SELECT p.*, x.type AS tx, y.type AS ty, CASE WHEN rule IN ('ext_id', 'sec_former_name') THEN {_BY_ID.format('x.type', 'y.type')} ELSE {_BY_NAME.format('x.type', 'y.type')} END AS conflict,
    CASE WHEN x.surface_mode <> y.surface_mode THEN 'skip_surface' WHEN x.publication_state <> y.publication_state THEN 'skip_publication' WHEN conflict IS NOT NULL THEN 'review_type'
      WHEN rule = 'prefix_variant' THEN 'review_rule' ELSE 'accept' END AS outcome,
    CASE outcome WHEN 'skip_surface' THEN 'surface_mode_straddle' WHEN 'skip_publication' THEN 'publication_state_straddle' WHEN 'review_type' THEN conflict WHEN 'review_rule' THEN 'rule_not_enabled:' || rule END AS reason
    FROM pairs p JOIN en x ON x.id = a JOIN en y ON y.id = b)"""
_COMP = f"""{_PAIRS}, l AS (SELECT a AS u, b AS v FROM gated WHERE outcome = 'accept' UNION SELECT b, a FROM gated WHERE outcome = 'accept'),
  walk AS (SELECT DISTINCT u AS id, u AS r FROM l UNION SELECT l.v, walk.r FROM walk JOIN l ON l.u = walk.id), comp AS (SELECT id, min(r) AS cluster FROM walk GROUP BY 1),
  rules AS (SELECT cluster, bool_and(rule IN ('ext_id', 'sec_former_name')) AS by_id FROM gated JOIN comp ON comp.id = a WHERE outcome = 'accept' GROUP BY 1),
  bad AS (SELECT DISTINCT cluster FROM comp c1 JOIN comp c2 USING (cluster) JOIN rules USING (cluster) JOIN en x ON x.id = c1.id JOIN en y ON y.id = c2.id
    WHERE c1.id < c2.id AND CASE WHEN by_id THEN {_BY_ID.format('x.type', 'y.type')} ELSE {_BY_NAME.format('x.type', 'y.type')} END IS NOT NULL)"""


def _reasons(s, d):
    g, named = _named(s, d)
    return dedup.reasons(g.aliases, named)


def _survivors(s, d):
    g, named, accepted = _accepted(s, d)
    # the rules and the gate read names, types and modes; counts serve the survivors alone
    rows = dedup.profile(Graph(named, g.aliases, g.edges, g.citations, g.scrutiny))
    return dedup.survivors(dedup.clusters(accepted, named), rows).select("id", "cluster", "survivor", "type", "conflict")


def _type_gate(s, d):
    """Every pair of types, by name and by identifier."""
    types = F.array(*map(F.lit, ENTITY_TYPES))
    pairs = table(s, d, "region").filter("r_regionkey = 0").select(F.explode(types).alias("a")).select("a", F.explode(types).alias("b"))
    why = lambda by_id: dedup.type_conflict(F.col("a"), F.col("b"), F.lit(by_id))
    return pairs.select("a", "b", why(False).alias("by_name"), why(True).alias("by_id"))


def _components(s, d):
    _, named, accepted = _accepted(s, d)
    return dedup.clusters(accepted, named).select("id", "cluster", "refused")


_SURVIVORS = f"""{_COMP}, deg AS (SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM v_edge UNION ALL SELECT target_id FROM v_edge WHERE source_id <> target_id) GROUP BY 1),
          al AS (SELECT canonical_id, count(*) AS m, list(DISTINCT source_system) AS sys FROM v_twin_alias GROUP BY 1),
          r AS (SELECT en.id, cluster, en.type, replace(norm, ' ', '') AS sq, coalesce(sys, []) AS sys, row_number() OVER (PARTITION BY cluster ORDER BY list_has_any(coalesce(sys, []), ['sec.cik', 'fec.committee', 'bioguide']) DESC, coalesce(n, 0) DESC, coalesce(m, 0) DESC, en.id) AS rn
            FROM comp JOIN en USING (id) LEFT JOIN deg ON node = en.id LEFT JOIN al ON canonical_id = en.id WHERE cluster NOT IN (SELECT cluster FROM bad)),
          c AS (SELECT cluster, max(id) FILTER (rn = 1) AS survivor, max(type) FILTER (rn = 1) AS own, list_sort(list(DISTINCT type) FILTER (type <> 'unknown')) AS ts, bool_or(sq IN ('401k', 'adr', 'aietf', 'chipmakers')) AS denied,
            list_distinct(flatten(list(sys))) AS sys FROM r GROUP BY 1)"""
_SURVIVOR_ROWS = """SELECT id, r.cluster, survivor, CASE WHEN ts IS NULL THEN CASE WHEN list_contains(c.sys, 'sec.cik') THEN 'organization' WHEN list_contains(c.sys, 'fec.committee') THEN 'pac' WHEN list_contains(c.sys, 'bioguide') THEN 'person' ELSE 'unknown' END
              WHEN len(ts) = 1 THEN ts[1] WHEN ts = ['concept', 'organization'] AND NOT denied THEN 'organization' WHEN own = 'unknown' AND ts = ['concept', 'organization'] THEN 'concept' ELSE own END AS type,
            coalesce(len(ts) > 1 AND NOT (ts = ['concept', 'organization'] AND NOT denied), false) AS conflict
          FROM r JOIN c USING (cluster)"""


def _mapping(s, d):
    """What the dedup plan's clusters make of the twins: every member but the survivor, to the survivor."""
    return materialize(_survivors(s, d).filter("id <> survivor").select("id", "survivor"))


_MAP = f"""{_SURVIVORS}, mp AS MATERIALIZED (SELECT r.id, survivor, CASE e.surface_mode WHEN 'suppress' THEN 2 WHEN 'alias' THEN 1 ELSE 0 END AS dr, CASE f.surface_mode WHEN 'suppress' THEN 2 WHEN 'alias' THEN 1 ELSE 0 END AS kr
    FROM r JOIN c USING (cluster) JOIN en e ON e.id = r.id JOIN en f ON f.id = survivor WHERE r.id <> survivor),
  mv AS (SELECT e.id, coalesce(s.survivor, source_id) AS s, coalesce(t.survivor, target_id) AS t, source_id AS os, target_id AS ot, relation, weight FROM v_edge e
    LEFT JOIN {{0}} s ON s.id = source_id LEFT JOIN {{0}} t ON t.id = target_id)"""
_ALLOWED = "(SELECT * FROM mp WHERE dr <= kr)"
_POST = f"""{_MAP.format(_ALLOWED)}, me AS (SELECT min(id) AS id, s, t, list(id) AS old FROM mv WHERE NOT (s = t AND os <> ot) GROUP BY s, t, relation),
  mc AS (SELECT me.id AS edge_id FROM (SELECT id, unnest(old) AS was FROM me) me JOIN v_citation ON edge_id = was)
  SELECT (SELECT count(*) FROM v_twin WHERE id NOT IN (SELECT id FROM {_ALLOWED})) = (SELECT count(*) FROM v_twin) - (SELECT count(*) FROM mp) AS entities_ok,
    (SELECT count(*) FROM mc WHERE edge_id NOT IN (SELECT id FROM me)) <= (SELECT count(*) FROM v_citation WHERE edge_id NOT IN (SELECT id FROM v_edge)) AS no_new_orphans,
    (SELECT count(*) FROM me WHERE id NOT IN (SELECT edge_id FROM mc)) <= (SELECT count(*) FROM v_edge WHERE id NOT IN (SELECT edge_id FROM v_citation)) AS no_new_uncited,
    (SELECT count(*) FROM me WHERE s = t) <= (SELECT count(*) FROM v_edge WHERE source_id = target_id) AS no_new_loops"""


def _merged(s, d):
    out = dedup.merge(_twins(s, d), _mapping(s, d))
    return out.edges.select("id", "source_id", "target_id", F.round("weight", 2).alias("weight"))


def _verdict(s, d):
    g = load(s, d)
    return scrutiny.verdicts(g.entities, g.aliases).select("canonical_id", "classification", "decision")


def _modes(s, d):
    g = load(s, d)
    v = scrutiny.verdicts(g.entities, g.aliases)
    return scrutiny.surface_modes(v, g.edges, g.citations)


_VERDICT = """vd AS (SELECT id AS canonical_id, CASE WHEN type <> 'person' OR id IN (SELECT canonical_id FROM v_alias WHERE source_system IN ('fec.committee', 'fec.candidate', 'bioguide', 'senate.lda.registrant', 'corporate.registry.officer', 'corporate.registry.exec')) THEN 'public' ELSE 'private' END AS classification FROM v_entity)"""


def _publish(s, d, batch, out):
    g = load(s, d)
    decided = g.scrutiny if batch != "b1" else g.entities.select(F.col("id").alias("canonical_id"))
    return dedup.publish(g.entities, g.edges, decided, batch)[out].groupBy("batch_id", "publication_state").agg(F.count("*").alias("n"))


def _post(s, d):
    g, m = _twins(s, d), _mapping(s, d)
    return dedup.postconditions(dedup.invariants(g), dedup.invariants(dedup.merge(g, m)), m.count())


def _names(s, d):
    return table(s, d, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit(", Inc. & Co")).alias("raw"))


QUERIES = {
    "flow_model1": (lambda s, d: flow.model1(load(s, d), "Democratic"), MODEL1),
    "flow_model2": (lambda s, d: flow.model2(load(s, d), "P:1-URGENT", ["1", "2"]), MODEL2),
    "subgraph_1hop": (partial(_subgraph, hops=1), duck(f"WITH {_WALK}, w AS (SELECT id, 0 AS h FROM h0 UNION ALL SELECT id, 1 FROM h1) SELECT w.id, min(h)::INT AS hop, any_value(label) AS label FROM w JOIN ok USING (id) GROUP BY 1")),
    "subgraph_2hop": (partial(_subgraph, hops=2), duck(f"WITH {_WALK}, w AS (SELECT id, 0 AS h FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) SELECT w.id, min(h)::INT AS hop, any_value(label) AS label FROM w JOIN ok USING (id) GROUP BY 1")),
    "subgraph_edges": (
        _subgraph_edges,
        duck(f"WITH {_WALK}, w AS (SELECT id FROM h0 UNION SELECT id FROM h1), i AS (SELECT id FROM w JOIN ok USING (id)) SELECT id, weight FROM ce WHERE source_id IN (SELECT id FROM i) AND target_id IN (SELECT id FROM i)"),
    ),
    "dossier_connections": (
        lambda s, d: graph.connections(load(s, d), view(s, d, "v_entity").filter("type = 'organization'").select("id")).select("id", "relation", "other", "label", "weight", "citations", "rank"),
        duck(f"""WITH ok AS (SELECT id, surface_mode AS sm, {_LABEL} AS label FROM v_entity WHERE publication_state = 'published' AND surface_mode <> 'suppress'),
          i AS (SELECT id, source_id AS node, target_id AS other, relation, weight FROM v_edge WHERE publication_state = 'published'
            UNION ALL SELECT id, target_id, source_id, relation, weight FROM v_edge WHERE publication_state = 'published' AND source_id <> target_id),
          c AS (SELECT edge_id, count(*) AS c FROM v_citation GROUP BY 1),
          r AS (SELECT node AS id, relation, other, y.label, i.id AS e, CASE WHEN x.sm = 'open' AND y.sm = 'open' THEN weight END AS weight, coalesce(c, 0) AS citations
            FROM i JOIN ok x ON x.id = node JOIN ok y ON y.id = other LEFT JOIN c ON edge_id = i.id WHERE node IN (SELECT id FROM v_entity WHERE type = 'organization'))
          SELECT id, relation, other, label, weight, citations, row_number() OVER (PARTITION BY id, relation ORDER BY citations DESC, coalesce(weight, 0) DESC, label, e) AS rank FROM r"""),
    ),
    "dedup_pairs": (lambda s, d: _plan(s, d).select("a", "b", "rule", "outcome", "reason"), duck(f"WITH {_PAIRS} SELECT a, b, rule, outcome, reason FROM gated")),
    "reason_histogram": (_reasons, duck(f"WITH {_PAIRS} SELECT rule, outcome, reason, count(*) AS n FROM gated GROUP BY ALL")),
    "type_gate": (
        _type_gate,
        f"""WITH t AS (SELECT unnest([{', '.join(f"'{t}'" for t in ENTITY_TYPES)}]) AS type) SELECT x.type AS a, y.type AS b, {_BY_NAME.format('x.type', 'y.type')} AS by_name, {_BY_ID.format('x.type', 'y.type')} AS by_id
          FROM t x, t y, region WHERE r_regionkey = 0""",
    ),
    "dedup_components": (_components, duck(f"WITH RECURSIVE {_COMP} SELECT id, cluster, cluster IN (SELECT cluster FROM bad) AS refused FROM comp")),
    "dedup_survivors": (
        _survivors,
        duck(f"WITH RECURSIVE {_SURVIVORS} {_SURVIVOR_ROWS}"),
    ),
    "dedup_predict": (
        lambda s, d: dedup.predict(view(s, d, "v_edge"), _mapping(s, d)),
        duck(f"""WITH RECURSIVE {_MAP.format('mp')}, g AS (SELECT count(*) AS n, count(*) FILTER (s = t AND os <> ot) AS l FROM mv GROUP BY s, t, relation)
          SELECT sum(n)::BIGINT AS before, sum(l)::BIGINT AS self_loops, sum(greatest(n - l - 1, 0))::BIGINT AS collisions, sum(least(n - l, 1))::BIGINT AS after FROM g"""),
    ),
    "merge_aggregate": (
        _merged,
        duck(f"""WITH RECURSIVE {_MAP.format(_ALLOWED)} SELECT min(id) AS id, s AS source_id, t AS target_id, round(sum(weight), 2) AS weight FROM mv WHERE NOT (s = t AND os <> ot) GROUP BY s, t, relation"""),
    ),
    "merge_keep_weight": (
        lambda s, d: dedup.merge_edges(view(s, d, "v_edge"), _mapping(s, d), "keep").select("id", "weight"),
        duck(f"WITH RECURSIVE {_MAP.format('mp')} SELECT min(id) AS id, arg_min(weight, id) AS weight FROM mv WHERE NOT (s = t AND os <> ot) GROUP BY s, t, relation"),
    ),
    "merge_citations": (
        lambda s, d: dedup.merge(_twins(s, d), _mapping(s, d)).citations.groupBy("edge_id").agg(F.count("*").alias("n")),
        duck(f"""WITH RECURSIVE {_MAP.format(_ALLOWED)}, g AS (SELECT id, min(id) OVER (PARTITION BY s, t, relation) AS to_id FROM mv WHERE NOT (s = t AND os <> ot))
          SELECT to_id AS edge_id, count(*) AS n FROM v_citation c JOIN g ON g.id = c.edge_id GROUP BY 1"""),
    ),
    "publish_batch": (
        lambda s, d: _publish(s, d, "b1", 0),
        duck("SELECT batch_id, CASE batch_id WHEN 'b1' THEN 'published' ELSE publication_state END AS publication_state, count(*) AS n FROM v_entity GROUP BY 1, 2"),
    ),
    "publish_blocked": (lambda s, d: _publish(s, d, "b2", 1), duck("SELECT batch_id, publication_state, count(*) AS n FROM v_edge GROUP BY 1, 2")),
    "publish_lacking": (
        lambda s, d: dedup.publish(view(s, d, "v_entity"), view(s, d, "v_edge"), view(s, d, "v_scrutiny"), "b2")[2],
        duck("SELECT id FROM v_entity WHERE batch_id = 'b2' AND id NOT IN (SELECT canonical_id FROM v_scrutiny)"),
    ),
    "unpublish_batch": (
        lambda s, d: dedup.unpublish(view(s, d, "v_edge"), "b3").groupBy("batch_id", "publication_state").agg(F.count("*").alias("n")),
        duck("SELECT batch_id, CASE batch_id WHEN 'b3' THEN 'staged' ELSE publication_state END AS publication_state, count(*) AS n FROM v_edge GROUP BY 1, 2"),
    ),
    "invariants": (
        lambda s, d: dedup.invariants(load(s, d)),
        duck("""SELECT 'entities' AS name, count(*) AS value FROM v_entity UNION ALL SELECT 'edges', count(*) FROM v_edge UNION ALL SELECT 'citations', count(*) FROM v_citation
          UNION ALL SELECT 'aliases', count(*) FROM v_alias UNION ALL SELECT 'uncited_edges', count(*) FROM v_edge WHERE id NOT IN (SELECT edge_id FROM v_citation)
          UNION ALL SELECT 'orphan_citations', count(*) FROM v_citation WHERE edge_id NOT IN (SELECT id FROM v_edge) UNION ALL SELECT 'self_loops', count(*) FROM v_edge WHERE source_id = target_id"""),
    ),
    "postconditions": (_post, duck(f"WITH RECURSIVE {_POST}")),
    "scrutiny_verdicts": (_verdict, duck(f"WITH {_VERDICT} SELECT canonical_id, classification, CASE classification WHEN 'public' THEN 'surface' ELSE 'suppress' END AS decision FROM vd")),
    "surface_modes": (
        _modes,
        duck(f"""WITH {_VERDICT}, c AS (SELECT source_id AS n FROM v_edge WHERE id IN (SELECT edge_id FROM v_citation) UNION SELECT target_id FROM v_edge WHERE id IN (SELECT edge_id FROM v_citation))
          SELECT canonical_id, CASE WHEN classification = 'public' THEN 'open' WHEN canonical_id IN (SELECT n FROM c) THEN 'alias' ELSE 'suppress' END AS surface_mode FROM vd"""),
    ),
    "scrutiny_priority": (
        lambda s, d: scrutiny.priority(
            scrutiny.pending(view(s, d, "v_entity").filter("type = 'person'"), view(s, d, "v_scrutiny")), graph.neighbourhood(_start(s), view(s, d, "v_edge"), 1), 100).select("id"),
        duck("""WITH h AS (SELECT target_id AS id FROM v_edge WHERE source_id IN ('C:2', 'B:Brand#12') UNION SELECT source_id FROM v_edge WHERE target_id IN ('C:2', 'B:Brand#12') UNION SELECT 'C:2')
          SELECT id FROM v_entity WHERE type = 'person' AND id NOT IN (SELECT canonical_id FROM v_scrutiny) ORDER BY CASE WHEN id IN (SELECT id FROM h) THEN 0 ELSE 1 END, k, id LIMIT 100"""),
    ),
    "vector_candidates": (
        lambda s, d: dedup.vector_pairs(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), "label", 8, 0.3).select("a", "b", "rank"),
        """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
          SELECT a, b, rank FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM s WHERE s >= 0.3) WHERE rank <= 8""",
    ),
    # scalar functions
    "normalize_name": (lambda s, d: _names(s, d).select("c_custkey", X.normalize_name(F.col("raw")).alias("norm")), f"SELECT c_custkey, {norm_sql('(c_name || $$, Inc. & Co$$)')} AS norm FROM customer"),
    "squash_key": (lambda s, d: table(s, d, "part").select("p_partkey", X.squash(F.lower("p_name")).alias("sq")), "SELECT p_partkey, replace(lower(p_name), ' ', '') AS sq FROM part"),
    "slug_key": (lambda s, d: table(s, d, "part").select("p_partkey", X.slug(F.lit("M1"), F.lower("p_name")).alias("slug")), "SELECT p_partkey, substr('M1:' || replace(lower(p_name), ' ', '-'), 1, 64) AS slug FROM part"),
    "public_alias": (lambda s, d: table(s, d, "customer").select("c_custkey", X.public_alias(F.col("c_name")).alias("alias")), "SELECT c_custkey, 'Private donor #' || substr(replace(c_name, '-', ''), 1, 8) AS alias FROM customer"),
    "permalink_url": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", X.permalink("https://news.example", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.lit("news"), F.col("o_orderkey").cast("string")).alias("url")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'https://news.example/' || o_orderpriority ELSE 'ref://news/' || o_orderkey::VARCHAR END AS url FROM orders",
    ),
    "levenshtein_repair": (
        lambda s, d: table(s, d, "events").select("event_id", X.transaction_type(F.col("event_type")).alias("kind")),
        """SELECT event_id, CASE WHEN event_type IN ('purchase', 'sale', 'exchange') THEN event_type WHEN levenshtein(event_type, 'purchase') <= 3 THEN 'purchase'
          WHEN levenshtein(event_type, 'sale') <= 3 THEN 'sale' WHEN levenshtein(event_type, 'exchange') <= 3 THEN 'exchange' END AS kind FROM events""",
    ),
    "band_bounds": (
        lambda s, d: _bands(s, d),
        "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1001 WHEN 2 THEN 15001 WHEN 3 THEN 50000001 WHEN 4 THEN 0 END::BIGINT AS low, CASE l_linenumber WHEN 1 THEN 15000 WHEN 2 THEN 50000 WHEN 3 THEN -1 WHEN 4 THEN 200 END::BIGINT AS high FROM lineitem WHERE l_linenumber <= 4",
    ),
    "cik_pad": (lambda s, d: table(s, d, "customer").select("c_custkey", X.cik_padded(F.col("c_custkey")).alias("cik")), "SELECT c_custkey, lpad(regexp_replace(c_custkey::VARCHAR, '^0+', ''), 10, '0') AS cik FROM customer"),
    "json_props": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    ),
    "title_agency": (lambda s, d: table(s, d, "region").select("r_regionkey", X.title_words(F.col("r_name")).alias("name")), "SELECT r_regionkey, upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS name FROM region WHERE NOT contains(r_name, ' ') UNION ALL SELECT r_regionkey, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') FROM region WHERE contains(r_name, ' ')"),
    "last_first": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.last_first(F.col("p_name")).alias("name")),
        r"SELECT p_partkey, CASE WHEN contains(trim(p_name), ' ') THEN regexp_replace(upper(trim(p_name)), '^(.*)\s+(\S+)$', '\2, \1') ELSE upper(trim(p_name)) END AS name FROM part",
    ),
    "heal_citations": (
        lambda s, d: _healed(s, d),
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://news.example/' || o_orderpriority ELSE 'ref://news/' || o_orderkey::VARCHAR END AS citation_url FROM orders",
    ),
}


def _bands(s, d):
    from ..functions.text import band_bounds

    band = F.element_at(F.create_map(*[F.lit(x) for kv in {1: "$1,001 – $15,000", 2: "$15,001 - $50,000", 3: "Over $50,000,000", 4: "None (or less than $201)"}.items() for x in kv]), F.col("l_linenumber"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", band_bounds(band).alias("b")).filter("b IS NOT NULL").select("l_orderkey", "l_linenumber", "b.low", F.coalesce("b.high", F.lit(-1)).alias("high"))


def _healed(s, d):
    from ..operators.edges import heal_citations

    o = table(s, d, "orders")
    cites = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ref://news/"), F.col("o_orderkey").cast("string")).alias("citation_url"))
    slugs = o.filter("o_orderkey % 3 = 0").select(F.concat(F.lit("ref://news/"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("slug"))
    return heal_citations(cites, slugs, "https://news.example")
