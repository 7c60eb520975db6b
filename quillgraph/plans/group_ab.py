"""Gates, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, edges, gates, graph, vectors
from .views import duck, edge_keys, table, view
from .views import graph as load

_LABEL = "CASE surface_mode WHEN 'open' THEN name WHEN 'alias' THEN 'Private donor #' || substr(replace(id, '-', ''), 1, 8) END"
_NORM = "regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), '( (incorporated|corporation|company|limited|inc|corp|co|llc|llp|lp|ltd|plc|gmbh|sa|nv|pac))+$', '')"


def norm_sql(column: str) -> str:
    return _NORM.format(column)


def _entities(spark, sf):
    return view(spark, sf, "v_entity")


QUERIES = {
    "published_entities": (
        lambda s, d: gates.published(_entities(s, d)).select("id", "name", "type"),
        duck("SELECT id, name, type FROM v_entity WHERE publication_state = 'published'"),
    ),
    "published_or_null": (
        lambda s, d: gates.published_or_null(_entities(s, d).withColumn("publication_state", F.when(F.col("k") % 5 != 0, F.col("publication_state")))).select("id"),
        duck("SELECT id FROM v_entity WHERE coalesce(CASE WHEN k % 5 <> 0 THEN publication_state END, 'published') = 'published'"),
    ),
    "preview_gate": (
        lambda s, d: gates.published(_entities(s, d), gates.preview_allowed("t", "t")).groupBy("publication_state").agg(F.count("*").alias("n")),
        duck("SELECT publication_state, count(*) AS n FROM v_entity GROUP BY 1"),
    ),
    "public_label": (
        lambda s, d: gates.shown(_entities(s, d)),
        duck(f"SELECT id, type, {_LABEL} AS label FROM v_entity WHERE surface_mode <> 'suppress'"),
    ),
    "search_name_substring": (
        lambda s, d: _entities(s, d).filter(F.lower("name").contains("er#00000001")).select("id", "name"),
        duck("SELECT id, name FROM v_entity WHERE contains(lower(name), 'er#00000001')"),
    ),
    "search_prefix": (
        lambda s, d: _entities(s, d).filter(F.col("name").ilike("brand#1%")).select("id", "name"),
        duck("SELECT id, name FROM v_entity WHERE name ILIKE 'brand#1%'"),
    ),
    "multi_substring_scope": (
        lambda s, d: _scope(s, d),
        duck("SELECT id, name FROM v_entity WHERE type = 'agency' AND (contains(lower(name), '1') OR contains(lower(name), 'an'))"),
    ),
    "regex_identity_key": (
        lambda s, d: view(s, d, "v_alias").select("canonical_id", X.identity_key(F.col("source_system"), F.col("source_id")).alias("key")).filter("key IS NOT NULL"),
        duck(r"""SELECT canonical_id, key FROM (SELECT canonical_id, CASE
          WHEN source_system = 'sec.cik' AND regexp_matches(regexp_replace(source_id, '^0+', ''), '^\d{1,10}$') THEN 'sec_cik:' || regexp_replace(source_id, '^0+', '')
          WHEN source_system = 'fec.committee' AND regexp_matches(source_id, '^C\d{8}$') THEN 'fec_committee:' || source_id
          WHEN source_system = 'bioguide' AND source_id <> '' THEN 'bioguide:' || source_id END AS key FROM v_alias) WHERE key IS NOT NULL"""),
    ),
    "evidence_filter": (
        lambda s, d: _entities(s, d).withColumn("norm", X.normalize_name(F.col("name"))).select(
            "id", X.name_is_evidence(F.col("norm")).alias("name_ok"), X.person_is_evidence(F.col("norm")).alias("person_ok"), X.squash_is_evidence(F.col("norm")).alias("squash_ok")),
        duck(f"""WITH n AS (SELECT id, {norm_sql('name')} AS norm FROM v_entity)
          SELECT id, length(norm) >= 3 AND regexp_matches(norm, '[a-z]') AS name_ok,
          length(norm) >= 3 AND regexp_matches(norm, '[a-z]') AND len(list_filter(string_split(norm, ' '), lambda x: length(x) >= 2)) >= 2 AS person_ok,
          length(replace(norm, ' ', '')) >= 6 AND NOT regexp_matches(norm, '[0-9]') AS squash_ok FROM n"""),
    ),
    "projectable_set": (
        lambda s, d: gates.projectable(_entities(s, d)).select("id"),
        duck("SELECT id FROM v_entity WHERE surface_mode <> 'suppress' AND publication_state <> 'staged'"),
    ),
    "projection_edges": (
        lambda s, d: gates.projected(_entities(s, d), view(s, d, "v_edge"))[1].select("id", "weight"),
        duck("""WITH p AS (SELECT id FROM v_entity WHERE surface_mode <> 'suppress' AND publication_state <> 'staged')
          SELECT id, weight FROM v_edge WHERE publication_state <> 'staged' AND source_id IN (SELECT id FROM p) AND target_id IN (SELECT id FROM p)"""),
    ),
    "projection_prune": (
        lambda s, d: gates.prune(_entities(s, d).select("id"), gates.projectable(_entities(s, d)).select("id")),
        duck("SELECT id FROM v_entity WHERE surface_mode = 'suppress' OR publication_state = 'staged'"),
    ),
    "both_open_edges": (
        lambda s, d: gates.both_open(view(s, d, "v_edge"), _entities(s, d)).select("id", "weight"),
        duck("SELECT e.id, e.weight FROM v_edge e JOIN v_entity a ON a.id = source_id JOIN v_entity b ON b.id = target_id WHERE a.surface_mode = 'open' AND b.surface_mode = 'open'"),
    ),
    "agency_whitelist": (
        lambda s, d: _agency(s, d),
        "SELECT n_nationkey, coalesce(CASE WHEN contains(upper(n_name), '_1') THEN '_1' WHEN contains(upper(n_name), '2') THEN '2' END, nullif(n_name, ''), 'UNKNOWN') AS agency FROM nation",
    ),
    # joins
    "alias_entity_inner": (
        lambda s, d: view(s, d, "v_alias").join(_entities(s, d).withColumnRenamed("id", "canonical_id"), "canonical_id").groupBy("source_system", "type").agg(F.count("*").alias("n")),
        duck("SELECT source_system, type, count(*) AS n FROM v_alias JOIN v_entity ON canonical_id = id GROUP BY 1, 2"),
    ),
    "citation_edge_inner": (
        lambda s, d: view(s, d, "v_citation").join(view(s, d, "v_edge").select(F.col("id").alias("edge_id"), "relation"), "edge_id").groupBy("relation", "kind").agg(F.count("*").alias("n")),
        duck("SELECT relation, kind, count(*) AS n FROM v_citation c JOIN v_edge e ON c.edge_id = e.id GROUP BY 1, 2"),
    ),
    "incident_edges": (
        lambda s, d: edges.incident(view(s, d, "v_edge")).groupBy("node").agg(F.count("*").alias("n")),
        duck("SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM v_edge UNION ALL SELECT target_id FROM v_edge WHERE source_id <> target_id) GROUP BY 1"),
    ),
    "unscrutinised_anti": (
        lambda s, d: _entities(s, d).filter("id LIKE 'C:%'").join(view(s, d, "v_scrutiny").withColumnRenamed("canonical_id", "id"), "id", "left_anti").select("id"),
        duck("SELECT id FROM v_entity e WHERE id LIKE 'C:%' AND NOT EXISTS (SELECT 1 FROM v_scrutiny s WHERE s.canonical_id = e.id)"),
    ),
    "uncited_edges_anti": (
        lambda s, d: view(s, d, "v_edge").join(view(s, d, "v_citation").select(F.col("edge_id").alias("id")), "id", "left_anti").select("id"),
        duck("SELECT id FROM v_edge WHERE id NOT IN (SELECT edge_id FROM v_citation)"),
    ),
    "orphan_citations_anti": (
        lambda s, d: view(s, d, "v_citation").join(view(s, d, "v_edge").filter("publication_state = 'published'").select(F.col("id").alias("edge_id")), "edge_id", "left_anti").select("id"),
        duck("SELECT id FROM v_citation WHERE edge_id NOT IN (SELECT id FROM v_edge WHERE publication_state = 'published')"),
    ),
    "cited_edges_semi": (
        lambda s, d: gates.cited(view(s, d, "v_edge"), view(s, d, "v_citation")).select("id"),
        duck("SELECT id FROM v_edge WHERE id IN (SELECT edge_id FROM v_citation)"),
    ),
    "entity_counts_left": (
        lambda s, d: dedup.profile(load(s, d)).select("id", "edge_count", "alias_count"),
        duck("""SELECT id, coalesce(n, 0) AS edge_count, coalesce(m, 0) AS alias_count FROM v_entity
          LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM v_edge UNION ALL SELECT target_id FROM v_edge WHERE source_id <> target_id) GROUP BY 1) ON node = id
          LEFT JOIN (SELECT canonical_id, count(*) AS m FROM v_alias GROUP BY 1) ON canonical_id = id"""),
    ),
    "identity_self_join": (
        lambda s, d: dedup.ext_id_pairs(view(s, d, "v_alias")),
        duck("""WITH k AS (SELECT DISTINCT canonical_id, CASE source_system WHEN 'sec.cik' THEN 'sec_cik:' || regexp_replace(source_id, '^0+', '')
            WHEN 'fec.committee' THEN 'fec_committee:' || source_id WHEN 'bioguide' THEN 'bioguide:' || source_id END AS evidence
            FROM v_alias WHERE source_system <> 'sec.cik' OR regexp_replace(source_id, '^0+', '') <> ''),
          m AS (SELECT evidence, min(canonical_id) AS a FROM k WHERE evidence IS NOT NULL GROUP BY 1)
          SELECT DISTINCT a, canonical_id AS b, 'ext_id' AS rule, evidence FROM k JOIN m USING (evidence) WHERE canonical_id <> a"""),
    ),
    "prefix_join": (
        lambda s, d: dedup.prefix_pairs(dedup.profile(load(s, d))),
        duck(f"""WITH e AS (SELECT id, {norm_sql('name')} AS norm FROM v_entity)
          SELECT DISTINCT least(s.id, l.id) AS a, greatest(s.id, l.id) AS b, 'prefix_variant' AS rule, s.norm AS evidence
          FROM e s JOIN e l ON starts_with(l.norm, s.norm || ' ') AND length(l.norm) - length(s.norm) <= 10
          WHERE length(s.norm) >= 12 AND regexp_matches(s.norm, '[a-z]') AND s.id <> l.id"""),
    ),
    "pair_self_join": (
        lambda s, d: edges.cooccurrence(view(s, d, "v_mention")).select("source_id", "target_id", "weight"),
        duck("""WITH m AS (SELECT DISTINCT artifact_id, canonical_id FROM v_mention)
          SELECT a.canonical_id AS source_id, b.canonical_id AS target_id, count(*) AS weight FROM m a JOIN m b ON a.artifact_id = b.artifact_id AND a.canonical_id < b.canonical_id GROUP BY 1, 2"""),
    ),
    "isolated_anti": (
        lambda s, d: edges.isolated(_entities(s, d), view(s, d, "v_edge")).select("id"),
        duck("SELECT id FROM v_entity WHERE id NOT IN (SELECT source_id FROM v_edge UNION SELECT target_id FROM v_edge)"),
    ),
    "isolated_backfill": (
        lambda s, d: edges.isolated_backfill(_entities(s, d), edge_keys(s, d).filter("relation <> 'x'"), view(s, d, "v_mention")),
        duck("""WITH l AS (SELECT id FROM v_entity WHERE type IN ('event', 'concept') AND id NOT IN (SELECT source_id FROM v_edge UNION SELECT target_id FROM v_edge)),
          m AS (SELECT DISTINCT artifact_id, canonical_id FROM v_mention)
          SELECT a.canonical_id AS source_id, b.canonical_id AS target_id, count(*) AS weight FROM m a JOIN m b ON a.artifact_id = b.artifact_id AND a.canonical_id < b.canonical_id
          WHERE a.canonical_id IN (SELECT id FROM l) OR b.canonical_id IN (SELECT id FROM l) GROUP BY 1, 2"""),
    ),
    "lateral_topk": (
        lambda s, d: _topk(s, d),
        """WITH v AS (SELECT vec_id AS id, label, embedding FROM embeddings),
          s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id),
          r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM s)
          SELECT a, b, rank FROM r WHERE rank <= 8""",
    ),
    "former_name_join": (
        lambda s, d: dedup.former_name_pairs(
            view(s, d, "v_alias").filter("source_system = 'mention'").withColumn("source_system", F.lit("sec.former_name")), view(s, d, "v_entity").withColumn("norm", X.normalize_name(F.col("name")))).select("a", "b"),
        duck(f"""WITH e AS (SELECT id, {norm_sql('name')} AS norm FROM v_entity), f AS (SELECT canonical_id, {norm_sql('surface_name')} AS norm FROM v_alias WHERE source_system = 'mention')
          SELECT DISTINCT least(id, canonical_id) AS a, greatest(id, canonical_id) AS b FROM e JOIN f USING (norm) WHERE id <> canonical_id AND length(norm) >= 3 AND regexp_matches(norm, '[a-z]')"""),
    ),
    "resolve_batch": (
        lambda s, d: graph.resolve(_tags(s, d), load(s, d)).select("tag", "id", "how"),
        duck(f"""WITH t AS (SELECT DISTINCT p_name AS tag FROM part UNION SELECT n_name FROM nation UNION SELECT p_type FROM part),
          n AS (SELECT tag, {norm_sql('tag')} AS norm FROM t), ok AS (SELECT * FROM v_entity WHERE publication_state = 'published' AND surface_mode <> 'suppress'),
          c AS (SELECT {norm_sql('surface_name')} AS norm, canonical_id AS id, CASE source_system WHEN 'mention' THEN 1 ELSE 3 END AS p FROM v_alias UNION ALL SELECT {norm_sql('name')}, id, 2 FROM ok),
          r AS (SELECT tag, c.id, p, row_number() OVER (PARTITION BY tag ORDER BY p, c.id) AS rn FROM n JOIN c USING (norm) JOIN ok ON ok.id = c.id)
          SELECT n.tag, r.id, CASE p WHEN 1 THEN 'mention' WHEN 2 THEN 'name' WHEN 3 THEN 'alias' END AS how FROM n LEFT JOIN r ON r.tag = n.tag AND rn = 1"""),
    ),
    "lag_fill": (
        lambda s, d: _fill(s, d),
        duck(f"""WITH t AS (SELECT DISTINCT p_type AS tag FROM part), n AS (SELECT tag, {norm_sql('tag')} AS norm FROM t),
          k AS (SELECT {norm_sql('surface_name')} AS norm FROM v_alias JOIN v_entity ON id = canonical_id WHERE publication_state = 'published' AND surface_mode <> 'suppress'
            UNION SELECT {norm_sql('name')} FROM v_entity WHERE publication_state = 'published' AND surface_mode <> 'suppress')
          SELECT norm, min(tag) AS name, 'concept' AS type FROM n WHERE norm NOT IN (SELECT norm FROM k) GROUP BY norm"""),
    ),
}


def _scope(s, d):
    from ..operators.flow import scope_agencies

    return scope_agencies(_entities(s, d), ["1", "an"]).select("id", "name")


def _agency(s, d):
    n = table(s, d, "nation")
    up = F.upper("n_name")
    hit = F.when(up.contains("_1"), "_1").when(up.contains("2"), "2")
    return n.select("n_nationkey", F.coalesce(hit, F.nullif(F.col("n_name"), F.lit("")), F.lit("UNKNOWN")).alias("agency"))


def _topk(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return vectors.nearest(v, "label", 8).select("a", "b", "rank")


def _tags(s, d):
    p, n = table(s, d, "part"), table(s, d, "nation")
    return p.select(F.col("p_name").alias("tag")).union(n.select("n_name")).union(p.select("p_type"))


def _fill(s, d):
    tags = table(s, d, "part").select(F.col("p_type").alias("tag"), F.lit("concept").alias("kind_hint")).distinct()
    return graph.lag_fill(tags, graph.resolve(tags, load(s, d))).select("norm", "name", "type")
