"""Resolving, upserts and lookups around entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve
from .group_ab import norm_sql
from .views import duck, table, view


def _asked(s, d):
    """Vectors pushed aside a little, under another name."""
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    kind = F.when(F.col("label") == 0, "person").otherwise("concept")
    moved = F.concat(F.array(F.get("e", 0) + 0.5), F.slice("e", F.lit(2), F.size("e") - 1))
    asked = v.select(F.col("vec_id").alias("tag"), F.concat(F.lit("Name "), F.col("vec_id") * 7 % 50, F.lit(" of "), F.col("label")).alias("name"), kind.alias("type"), moved.alias("embedding"))
    known = v.select(F.col("vec_id").alias("id"), F.concat(F.lit("N"), F.col("vec_id") % 50, F.when(F.col("vec_id") % 3 == 0, " name, Inc.").otherwise("")).alias("name"), kind.alias("type"), F.col("e").alias("embedding"))
    named = known.unionByName(known.select((F.col("id") + 1000000).alias("id"), F.concat(F.lit("NAME "), F.col("id") % 20, F.lit(" OF 1 CORP")).alias("name"), "type", F.lit(None).cast("array<double>").alias("embedding")))
    return asked, named


def _incoming(s, d):
    sup, part = table(s, d, "supplier"), table(s, d, "part")
    rows = sup.select(F.lit("fec.committee").alias("system"), F.concat(F.lit("C"), (F.col("s_suppkey") * 2 + 10000000).cast("string")).alias("source_id"), F.concat("s_name", F.lit(" COMMITTEE")).alias("name"), F.lit("pac").alias("type"))
    for system, name in (("catalog", F.concat(F.upper("p_name"), F.lit(" Inc."))), ("series", F.concat(F.lit("series "), "p_brand")), ("blank", F.lit(None).cast("string"))):
        rows = rows.unionByName(part.select(F.lit(system).alias("system"), F.col("p_partkey").cast("string").alias("source_id"), name.alias("name"), F.lit("concept").alias("type")))
    return rows


def _upserted(s, d):
    return resolve.upsert_entities(_incoming(s, d), view(s, d, "v_entity"), view(s, d, "v_alias"))


_INCOMING = f"""inc AS (SELECT *, coalesce({norm_sql('name')}, '') AS norm FROM (SELECT 'fec.committee' AS system, 'C' || (s_suppkey * 2 + 10000000)::VARCHAR AS source_id, s_name || ' COMMITTEE' AS name, 'pac' AS type FROM supplier
    UNION ALL SELECT 'catalog', p_partkey::VARCHAR, upper(p_name) || ' Inc.', 'concept' FROM part UNION ALL SELECT 'series', p_partkey::VARCHAR, 'series ' || p_brand, 'concept' FROM part UNION ALL SELECT 'blank', p_partkey::VARCHAR, NULL, 'concept' FROM part)),
  ba AS (SELECT source_system AS system, source_id, min(canonical_id) AS a FROM v_alias GROUP BY 1, 2),
  bn AS (SELECT type, {norm_sql('name')} AS norm, min(id) AS b FROM v_entity WHERE {norm_sql('name')} <> '' GROUP BY 1, 2),
  res AS (SELECT i.*, coalesce(a, b, 'new:' || substr(sha256(CASE WHEN i.norm <> '' THEN i.type || '|' || i.norm ELSE i.type || '|' || i.system || '|' || i.source_id END), 1, 16)) AS id,
    CASE WHEN a IS NOT NULL THEN 'alias' WHEN b IS NOT NULL THEN 'name' ELSE 'new' END AS how
    FROM inc i LEFT JOIN ba ON ba.system = i.system AND ba.source_id = i.source_id LEFT JOIN bn ON bn.type = i.type AND bn.norm = i.norm)"""


def _split(s, d):
    a = view(s, d, "v_alias")
    paid = table(s, d, "supplier").select(
        F.concat(F.lit("C:"), "s_suppkey").alias("canonical_id"), F.lit("fec.disbursement.recipient").alias("source_system"),
        F.concat(F.lit("C"), (F.col("s_suppkey") * 3 + 10000000).cast("string")).alias("source_id"), F.col("s_name").alias("surface_name"),
    )
    return resolve.split_committees(a.unionByName(paid)).select("source_id", F.array_join("ids", ",").alias("ids"))


QUERIES = {
    "resolve_vector": (
        lambda s, d: resolve.resolve_vector(*_asked(s, d)),
        f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, CASE WHEN label = 0 THEN 'person' ELSE 'concept' END AS type FROM embeddings),
          q AS (SELECT vec_id AS tag, 'Name ' || (vec_id * 7 % 50)::VARCHAR || ' of ' || label::VARCHAR AS name, type, list_concat([e[1] + 0.5], e[2:]) AS e FROM v),
          k AS (SELECT vec_id AS id, 'N' || (vec_id % 50)::VARCHAR || CASE WHEN vec_id % 3 = 0 THEN ' name, Inc.' ELSE '' END AS name, type, e FROM v
            UNION ALL SELECT vec_id + 1000000, 'NAME ' || (vec_id % 20)::VARCHAR || ' OF 1 CORP', type, NULL FROM v),
          s AS (SELECT tag, id, q.type, {norm_sql('q.name')} AS qn, {norm_sql('k.name')} AS kn, round(list_cosine_similarity(q.e, k.e), 9) AS sim FROM q JOIN k ON q.type = k.type AND k.e IS NOT NULL),
          t AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sim DESC, id) AS rn FROM s),
          n AS (SELECT tag, id FROM t WHERE rn = 1 AND sim >= CASE type WHEN 'person' THEN 0.86 + 0.04 ELSE 0.86 END AND list_has_any(string_split(qn, ' '), string_split(kn, ' '))),
          x AS (SELECT type, {norm_sql('name')} AS norm, min(id) AS id FROM k GROUP BY 1, 2)
          SELECT q.tag, coalesce(n.id, x.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'vector' WHEN x.id IS NOT NULL THEN 'name' END AS how
          FROM q LEFT JOIN n USING (tag) LEFT JOIN x ON x.type = q.type AND x.norm = {norm_sql('q.name')}""",
    ),
    "upsert_entities": (lambda s, d: _upserted(s, d).select("system", "source_id", "id", "how"), duck(f"WITH {_INCOMING} SELECT system, source_id, id, how FROM res")),
    "upsert_new_entities": (lambda s, d: resolve.new_entities(_upserted(s, d)), duck(f"WITH {_INCOMING} SELECT id, type, min(name) AS name FROM res WHERE how = 'new' GROUP BY 1, 2")),
    "upsert_new_aliases": (
        lambda s, d: resolve.new_aliases(_upserted(s, d), view(s, d, "v_alias")),
        duck(f"""WITH {_INCOMING} SELECT id AS canonical_id, system AS source_system, source_id, min(name) AS surface_name FROM res r
          WHERE NOT EXISTS (SELECT 1 FROM v_alias a WHERE a.canonical_id = r.id AND a.source_system = r.system AND a.source_id = r.source_id) GROUP BY 1, 2, 3"""),
    ),
    "seed_persons": (
        lambda s, d: resolve.seed_persons(view(s, d, "v_entity"), view(s, d, "v_alias"), table(s, d, "customer").select(F.col("c_name").alias("name"))),
        duck("SELECT DISTINCT id, name FROM v_entity WHERE type = 'person' AND name IN (SELECT c_name FROM customer) AND id IN (SELECT canonical_id FROM v_alias WHERE source_system = 'bioguide')"),
    ),
    "most_connected": (
        lambda s, d: resolve.most_connected(view(s, d, "v_twin"), view(s, d, "v_edge")),
        duck(f"""WITH g AS (SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM v_edge UNION ALL SELECT target_id FROM v_edge WHERE source_id <> target_id) GROUP BY 1),
          e AS (SELECT id, {norm_sql('name')} AS norm, coalesce(n, 0) AS n FROM v_twin LEFT JOIN g ON node = id)
          SELECT norm, id FROM (SELECT norm, id, row_number() OVER (PARTITION BY norm ORDER BY n DESC, id) AS rn FROM e WHERE norm <> '') WHERE rn = 1"""),
    ),
    "unbridged_receivers": (
        lambda s, d: resolve.unbridged_receivers(view(s, d, "v_twin_alias"), view(s, d, "v_edge").unionByName(
            view(s, d, "v_edge").filter("relation = 'contributes_to' AND target_id LIKE 'K:%'").withColumn("target_id", F.replace("target_id", F.lit("K:"), F.lit("X:"))))),
        duck("""WITH r AS (SELECT target_id AS id FROM v_edge WHERE relation = 'contributes_to' UNION SELECT replace(target_id, 'K:', 'X:') FROM v_edge WHERE relation = 'contributes_to' AND target_id LIKE 'K:%')
          SELECT DISTINCT source_id AS committee, canonical_id AS id FROM v_twin_alias WHERE source_system = 'fec.committee' AND canonical_id IN (SELECT id FROM r)
            AND canonical_id NOT IN (SELECT source_id FROM v_edge WHERE relation = 'affiliated_with')"""),
    ),
    "split_committees": (
        _split,
        duck("""WITH a AS (SELECT canonical_id, source_system, source_id FROM v_alias WHERE source_system = 'fec.committee'
            UNION ALL SELECT 'C:' || s_suppkey::VARCHAR, 'fec.disbursement.recipient', 'C' || (s_suppkey * 3 + 10000000)::VARCHAR FROM supplier)
          SELECT source_id, array_to_string(list_sort(list(DISTINCT canonical_id)), ',') AS ids FROM a GROUP BY 1 HAVING count(DISTINCT source_system) > 1 AND count(DISTINCT canonical_id) > 1"""),
    ),
    "distinct_targets": (
        lambda s, d: resolve.distinct_targets(view(s, d, "v_edge"), ("holds_contract", "voted_for")),
        duck("SELECT count(DISTINCT target_id) AS targets FROM v_edge WHERE relation IN ('holds_contract', 'voted_for')"),
    ),
    "vote_counts": (
        lambda s, d: resolve.vote_counts(view(s, d, "v_edge"), view(s, d, "v_alias"), "Democratic"),
        duck("""SELECT target_id AS bill, count(DISTINCT source_id) AS yes, count(DISTINCT source_id) FILTER (source_id IN (SELECT canonical_id FROM v_alias WHERE source_system = 'party' AND source_id = 'Democratic')) AS of_party
          FROM v_edge WHERE relation = 'voted_for' GROUP BY 1"""),
    ),
    "first_match": (
        lambda s, d: resolve.first_match(table(s, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("query_at"), F.col("p_partkey").alias("row_at"), F.col("p_name").alias("name")), ["er", "AN"]),
        """SELECT p_brand AS key, p_size AS query_at, p_partkey AS row_at, p_name AS name FROM part WHERE contains(upper(p_name), 'ER') OR contains(upper(p_name), 'AN')
          QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1""",
    ),
    "recipient_key": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", resolve.recipient_key(
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" "), F.col("o_orderkey")).alias("key")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'unknown-' || o_orderkey::VARCHAR END AS key FROM orders",
    ),
}
