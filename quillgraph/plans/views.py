"""Graph tables derived from the star tables, in SQL that Spark and DuckDB read alike.

Names in braces are the star tables: DataFrames in Spark, views in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import materialize

_GATES = """CASE k % 11 WHEN 0 THEN 'suppress' WHEN 1 THEN 'alias' ELSE 'open' END AS surface_mode,
  CASE WHEN k % 13 = 0 THEN 'staged' ELSE 'published' END AS publication_state, 'b' || CAST(k % 5 AS VARCHAR(8)) AS batch_id"""

VIEWS = {
    "v_fact": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderpriority, o_orderdate, p_brand, p_name, c_nationkey,
  l_quantity, l_returnflag, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amt, CAST(l_extendedprice AS DECIMAL(18,4)) AS price
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey""",
    "v_entity": f"""SELECT id, name, lower(name) AS lname, type, k, {_GATES} FROM (
  SELECT 'S:' || CAST(s_suppkey AS VARCHAR(20)) AS id, s_name AS name, 'person' AS type, s_suppkey AS k FROM {{supplier}}
  UNION ALL SELECT 'K:' || CAST(s_suppkey AS VARCHAR(20)), s_name || ' Committee', 'pac', s_suppkey + 1 FROM {{supplier}}
  UNION ALL SELECT 'C:' || CAST(c_custkey AS VARCHAR(20)), c_name, CASE WHEN c_custkey % 3 = 0 THEN 'pac' ELSE 'person' END, c_custkey FROM {{customer}}
  UNION ALL SELECT DISTINCT 'B:' || p_brand, p_brand, 'organization', CAST(2 AS BIGINT) FROM {{part}}
  UNION ALL SELECT 'N:' || CAST(n_nationkey AS VARCHAR(20)), n_name, 'agency', CAST(n_nationkey + 2 AS BIGINT) FROM {{nation}}
  UNION ALL SELECT DISTINCT 'P:' || o_orderpriority, o_orderpriority, 'bill', CAST(2 AS BIGINT) FROM {{orders}}
  UNION ALL SELECT 'W:' || CAST(p_partkey AS VARCHAR(20)), p_name, 'concept', p_partkey FROM {{part}}) u""",
    "v_alias": """SELECT 'S:' || CAST(s_suppkey AS VARCHAR(20)) AS canonical_id, 'party' AS source_system,
    CASE s_nationkey % 3 WHEN 0 THEN 'Republican' WHEN 1 THEN 'Democratic' ELSE 'Independent' END AS source_id, s_name AS surface_name FROM {supplier}
  UNION ALL SELECT 'C:' || CAST(c_custkey AS VARCHAR(20)), 'bioguide', 'M' || CAST(c_custkey AS VARCHAR(20)), c_name FROM {customer} WHERE c_custkey % 17 = 0
  UNION ALL SELECT 'K:' || CAST(s_suppkey AS VARCHAR(20)), 'fec.committee', 'C' || CAST(10000000 + s_suppkey AS VARCHAR(20)), s_name FROM {supplier}
  UNION ALL SELECT 'C:' || CAST(c_custkey AS VARCHAR(20)), 'sec.cik', '000' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS VARCHAR(20)), c_name FROM {customer}
  UNION ALL SELECT 'W:' || CAST(p_partkey AS VARCHAR(20)), 'mention', 'm' || CAST(p_partkey AS VARCHAR(20)), p_name FROM {part}""",
    "v_edge": f"""SELECT relation || '|' || source_id || '|' || target_id AS id, source_id, target_id, relation, weight, {_GATES} FROM (
  SELECT 'C:' || CAST(o_custkey AS VARCHAR(20)) AS source_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'K:' ELSE 'S:' END || CAST(l_suppkey AS VARCHAR(20)) AS target_id, 'contributes_to' AS relation,
    CAST(round(sum(amt), 2) AS DOUBLE) AS weight, max(o_custkey + l_suppkey) AS k FROM v_fact GROUP BY 1, 2
  UNION ALL SELECT 'B:' || p_brand, 'N:' || CAST(c_nationkey AS VARCHAR(20)), 'holds_contract', CAST(round(sum(price), 2) AS DOUBLE),
    CAST(max(c_nationkey) + 1 AS BIGINT) FROM v_fact GROUP BY 1, 2
  UNION ALL SELECT 'K:' || CAST(s_suppkey AS VARCHAR(20)), 'S:' || CAST(s_suppkey AS VARCHAR(20)), 'affiliated_with', CAST(1 AS DOUBLE), s_suppkey FROM {{supplier}}
  UNION ALL SELECT 'C:' || CAST(c_custkey AS VARCHAR(20)), 'B:Brand#' || CAST(c_custkey % 20 + 1 AS VARCHAR(20)), 'affiliated_with', CAST(1 AS DOUBLE), c_custkey
    FROM {{customer}} WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'C:' || CAST(c_custkey AS VARCHAR(20)), 'B:Brand#' || CAST(c_custkey * 7 % 20 + 1 AS VARCHAR(20)), 'affiliated_with', CAST(1 AS DOUBLE), c_custkey
    FROM {{customer}} WHERE c_custkey % 9 = 0 AND c_custkey % 20 <> c_custkey * 7 % 20
  UNION ALL SELECT 'S:' || CAST(l_suppkey AS VARCHAR(20)), 'P:' || o_orderpriority,
    CASE WHEN sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) >= sum(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) THEN 'voted_for' ELSE 'voted_against' END,
    CAST(1 AS DOUBLE), max(l_suppkey) FROM v_fact GROUP BY 1, 2) u""",
    "v_citation": """SELECT 'x' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS id,
    'contributes_to|C:' || CAST(o_custkey AS VARCHAR(20)) || '|' || CASE WHEN l_linenumber % 2 = 0 THEN 'K:' ELSE 'S:' END || CAST(l_suppkey AS VARCHAR(20)) AS edge_id,
    CASE l_returnflag WHEN 'A' THEN 'fec_filing' WHEN 'R' THEN 'usaspending_award' ELSE 'article_permalink' END AS kind,
    'https://filings.example/' || CAST(l_partkey % 40 AS VARCHAR(20)) || '/' || CAST(l_suppkey AS VARCHAR(20)) AS citation_url,
    CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS citation_ref, CAST(l_linenumber AS INT) AS page FROM v_fact WHERE l_quantity >= 10""",
    "v_scrutiny": """SELECT 'C:' || CAST(c_custkey AS VARCHAR(20)) AS canonical_id, CASE WHEN c_custkey % 2 = 0 THEN 'public' ELSE 'private' END AS classification
  FROM {customer} WHERE c_custkey % 7 <> 0""",
    "v_mention": """SELECT l_orderkey AS artifact_id, 'W:' || CAST(l_partkey AS VARCHAR(20)) AS canonical_id,
    CASE l_returnflag WHEN 'A' THEN 'event' WHEN 'R' THEN 'topic' ELSE 'concept' END AS kind_hint, l_linenumber AS seq FROM {lineitem}""",
}
#: Entities and aliases with twins: persons and others that bear one another's names or identifiers.
_TWIN_TYPE = "CASE {0} % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'candidate' WHEN 2 THEN 'unknown' WHEN 3 THEN 'organization' WHEN 4 THEN 'pac' ELSE 'concept' END"
VIEWS["v_twin"] = f"""SELECT id, name, lname, type, k, surface_mode, publication_state, batch_id FROM v_entity
  UNION ALL SELECT 'X:' || CAST(s_suppkey AS VARCHAR(20)), s_name, lower(s_name), {_TWIN_TYPE.format('s_suppkey')}, s_suppkey, {_GATES.replace('k %', 's_suppkey %')} FROM {{supplier}}
  UNION ALL SELECT 'Y:' || CAST(p_partkey AS VARCHAR(20)), p_name, lower(p_name), {_TWIN_TYPE.format('p_partkey')}, p_partkey, {_GATES.replace('k %', 'p_partkey %')} FROM {{part}}"""
VIEWS["v_twin_alias"] = """SELECT canonical_id, source_system, source_id, surface_name FROM v_alias
  UNION ALL SELECT 'X:' || CAST(s_suppkey AS VARCHAR(20)), 'fec.committee', 'C' || CAST(10000000 + s_suppkey AS VARCHAR(20)), s_name FROM {supplier} WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'Y:' || CAST(p_partkey AS VARCHAR(20)), 'sec.former_name', 'f' || CAST(p_partkey AS VARCHAR(20)), p_name || ' Inc' FROM {part} WHERE p_partkey % 5 = 0"""
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(sql: str) -> list[str]:
    """Views that a statement uses, and those that they use, in order of definition."""
    named = lambda text: {v for v in VIEWS if re.search(rf"\b{v}\b", text)}
    used, todo = set(), named(sql)
    while todo:
        used |= todo
        todo = set().union(*(named(VIEWS[v]) for v in todo)) - used
    return [v for v in VIEWS if v in used]


def duck(sql: str) -> str:
    """A statement over the views as one DuckDB query (further CTEs may follow ``WITH``)."""
    ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in STAR})})" for v in _needs(sql)]
    rest = sql.strip()
    if rest[:5].upper() == "WITH ":
        head, rest = ("WITH RECURSIVE ", rest[15:]) if rest[5:15].upper() == "RECURSIVE " else ("WITH ", rest[5:])
        return head + ",\n".join([*ctes, rest]) if ctes else head + rest
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + rest


def _ordered(sql: str) -> str:
    """The same joins with customers met by orders: their key does not deal every line of the orders once more."""
    return sql.replace(
        "JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey",
        "JOIN (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, c_nationkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey) oc ON l_orderkey = o_orderkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the tables that it reads are opened."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _needs(VIEWS[name]) if v != name)
    sql = _ordered((f"WITH {ctes}\n" if ctes else "") + VIEWS[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR if "{%s}" % t in sql}
    return spark.sql(sql, **tables)


def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, relation of ``v_edge``: its branches read a written table of the facts' keys, joined once.

    Weights are not worked out.
    """
    keys = view(spark, sf_dir, "v_fact").select("l_linenumber", "l_suppkey", "o_custkey", "o_orderpriority", "p_brand", "c_nationkey", "l_returnflag")
    none = F.lit(None).cast("decimal(18,4)")
    facts = materialize(keys).withColumns({"amt": none, "price": none})
    sql = re.sub(r"\bv_fact\b", "{v_fact}", VIEWS["v_edge"])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR if "{%s}" % t in sql}
    return spark.sql(sql, v_fact=facts, **tables).select("source_id", "target_id", "relation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(*(view(spark, sf_dir, v) for v in ("v_entity", "v_alias", "v_edge", "v_citation", "v_scrutiny")))
