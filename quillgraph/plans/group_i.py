"""Incremental resolving, merges from a queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosswalk, mentions
from .group_ab import norm_sql
from .views import duck, table, view

_KIND = "CASE label WHEN 0 THEN 'person' WHEN 1 THEN ' Org ' WHEN 2 THEN 'gizmo' ELSE 'concept' END"
_TYPE = "CASE label WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'unknown' ELSE 'concept' END"


def _mentioned(s, d):
    """Four mentions of every vector, each pushed further aside and under another name; those of one label have none."""
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    moved = F.concat(F.array(F.get("e", 0) + F.col("j") * 0.3), F.slice("e", F.lit(2), F.size("e") - 1))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Tag ", "the ", "TAG ", "Other "))), F.col("j") + 1), F.col("vec_id") % 60, F.lit(", Inc."))
    return v.select(
        (((F.col("vec_id") + F.col("j")) % 4) * 1000000000 + F.col("vec_id")).alias("id"), name.alias("name"), F.expr(_KIND).alias("kind"), F.when(F.col("label") != 8, moved).alias("embedding"))


def _known(s, d):
    """The vectors of one label, and names without a vector."""
    v = table(s, d, "embeddings").filter("label IN (3, 4)")
    return v.select(F.concat(F.lit("E:"), "vec_id").alias("id"), F.concat(F.lit("tag "), F.col("vec_id") % 60).alias("name"), F.expr(_TYPE).alias("type"),
        F.when(F.col("label") == 3, F.col("embedding").cast("array<double>")).alias("embedding"))


_SQL = f"""WITH RECURSIVE m AS (SELECT ((vec_id + j) % 4) * 1000000000 + vec_id AS id, {_TYPE} AS type, {norm_sql("name")} AS norm, CASE WHEN label <> 8 THEN e END AS e FROM (
    SELECT vec_id, label, j, ['Tag ', 'the ', 'TAG ', 'Other '][j + 1] || (vec_id % 60)::VARCHAR || ', Inc.' AS name, list_concat([embedding[1]::DOUBLE + j * 0.3], embedding[2:]::DOUBLE[]) AS e
    FROM embeddings, range(4) t(j))),
  k AS (SELECT 'E:' || vec_id::VARCHAR AS id, {norm_sql("'tag ' || (vec_id % 60)::VARCHAR")} AS norm, {_TYPE} AS type, CASE WHEN label = 3 THEN embedding::DOUBLE[] END AS e FROM embeddings WHERE label IN (3, 4)),
  r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS n FROM m WHERE e IS NOT NULL),
  p AS MATERIALIZED (SELECT a.n, 0 AS later, NULL::BIGINT AS made, k.id AS known, round(list_cosine_similarity(a.e, k.e), 9) AS sim, list_has_any(string_split(a.norm, ' '), string_split(k.norm, ' ')) AS shares, a.type
      FROM r a JOIN k ON a.type = k.type AND k.e IS NOT NULL
    UNION ALL SELECT a.n, 1, b.n, NULL::VARCHAR, round(list_cosine_similarity(a.e, b.e), 9), list_has_any(string_split(a.norm, ' '), string_split(b.norm, ' ')), a.type FROM r a JOIN r b ON a.type = b.type AND b.n < a.n),
  c AS MATERIALIZED (SELECT n, list(struct_pack(sim := sim, made := made, known := known, shares := shares) ORDER BY sim DESC, later, known, made) AS near FROM p WHERE sim >= CASE type WHEN 'person' THEN 0.86 + 0.04 ELSE 0.86 END GROUP BY n),
  x AS MATERIALIZED (SELECT r.n, coalesce(c.near, []) AS near, (SELECT min(k.id) FROM k WHERE k.type = r.type AND k.norm = r.norm) AS by_name,
      coalesce((SELECT list(q.n ORDER BY q.n) FROM r q WHERE q.type = r.type AND q.norm = r.norm AND q.n < r.n), []) AS alike FROM r LEFT JOIN c ON c.n = r.n),
  w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS made, NULL::VARCHAR AS how, NULL::VARCHAR AS known, NULL::BIGINT AS maker
    UNION ALL SELECT y.n, CASE WHEN y.how = 'new' THEN list_append(y.made, y.n) ELSE y.made END, y.how, CASE y.how WHEN 'vector' THEN y.best.known WHEN 'name' THEN y.by_name END,
      CASE y.how WHEN 'new' THEN y.n WHEN 'vector' THEN y.best.made WHEN 'name' THEN CASE WHEN y.by_name IS NULL THEN y.named END END
    FROM (SELECT z.*, CASE WHEN best.shares THEN 'vector' WHEN by_name IS NOT NULL OR named IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM (
      SELECT x.n, w.made, x.by_name, list_filter(x.near, lambda q: q.made IS NULL OR list_contains(w.made, q.made))[1] AS best, list_filter(x.alike, lambda q: list_contains(w.made, q))[1] AS named
      FROM w JOIN x ON x.n = w.n + 1) z) y)
  SELECT r.id, r.type, coalesce(w.known, 'new:' || q.id::VARCHAR) AS entity, w.how FROM w JOIN r ON r.n = w.n LEFT JOIN r q ON q.n = w.maker
  UNION ALL SELECT id, type, NULL, 'skipped' FROM m WHERE e IS NULL"""

def _queue(s, d):
    """Each customer into the one of half its number (long chains), suppliers into no entity, nations in a round."""
    c, p, n = table(s, d, "customer"), table(s, d, "supplier"), table(s, d, "nation")
    rows = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("C:"), "c_custkey").alias("from_id"), F.concat(F.lit("C:"), F.expr("c_custkey div 2")).alias("to_id"))
    rows = rows.unionByName(p.select((-F.col("s_suppkey")).alias("id"), F.concat(F.lit("C:"), "s_suppkey").alias("from_id"), F.concat(F.lit("K:"), "s_suppkey").alias("to_id")))
    rows = rows.unionByName(n.select((F.col("n_nationkey") + 1000000000).cast("long").alias("id"), F.concat(F.lit("N:"), "n_nationkey").alias("from_id"), F.concat(F.lit("N:"), (F.col("n_nationkey") + 7) % 25).alias("to_id")))
    return rows.withColumn("applied_at", F.lit(None).cast("timestamp"))


_QUEUE = """q AS (SELECT c_custkey AS id, 'C:' || c_custkey::VARCHAR AS from_id, 'C:' || (c_custkey // 2)::VARCHAR AS to_id FROM customer
    UNION ALL SELECT -s_suppkey, 'C:' || s_suppkey::VARCHAR, 'K:' || s_suppkey::VARCHAR FROM supplier
    UNION ALL SELECT n_nationkey + 1000000000, 'N:' || n_nationkey::VARCHAR, 'N:' || ((n_nationkey + 7) % 25)::VARCHAR FROM nation),
  md AS MATERIALIZED (SELECT id, CASE surface_mode WHEN 'suppress' THEN 2 WHEN 'alias' THEN 1 ELSE 0 END AS m FROM v_entity),
  j AS (SELECT q.*, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN from_id = to_id THEN 'same' WHEN a.m > b.m THEN 'refused' END AS v FROM q LEFT JOIN md a ON a.id = from_id LEFT JOIN md b ON b.id = to_id),
  l AS MATERIALIZED (SELECT id, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY id) AS rn FROM j WHERE v IS NULL) WHERE rn = 1),
  reach AS (SELECT from_id AS x, to_id AS y FROM l UNION SELECT reach.x, l.to_id FROM reach JOIN l ON l.from_id = reach.y),
  cut AS MATERIALIZED (SELECT max(l.id) AS id FROM reach a JOIN reach b ON b.x = a.y AND b.y = a.x JOIN l ON l.from_id = a.y WHERE a.x IN (SELECT x FROM reach WHERE x = y) GROUP BY a.x),
  l2 AS MATERIALIZED (SELECT * FROM l WHERE id NOT IN (SELECT id FROM cut)),
  walk AS (SELECT from_id AS x, to_id AS y FROM l2 UNION ALL SELECT walk.x, l2.to_id FROM walk JOIN l2 ON l2.from_id = walk.y),
  fin AS (SELECT x, y FROM walk WHERE y NOT IN (SELECT from_id FROM l2))
  SELECT j.id, j.from_id, j.to_id, CASE WHEN v IS NOT NULL THEN v WHEN j.id IN (SELECT id FROM cut) THEN 'cycle' WHEN j.id IN (SELECT id FROM l2) THEN 'apply' ELSE 'duplicate' END AS verdict,
    CASE WHEN j.id IN (SELECT id FROM l2) THEN fin.y END AS survivor FROM j LEFT JOIN fin ON fin.x = j.from_id"""

QUERIES = {
    "crosswalk_plan": (lambda s, d: crosswalk.plan(_queue(s, d), view(s, d, "v_entity")), duck(f"WITH RECURSIVE {_QUEUE}")),
    "resolve_mentions": (lambda s, d: mentions.resolve_mentions(_mentioned(s, d), _known(s, d)), _SQL),
}
