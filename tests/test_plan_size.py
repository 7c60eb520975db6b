"""Plans that must not grow: how often a query reads and deals the largest table."""

import re

from pyspark.sql import functions as F

from quillgraph.functions import annual
from quillgraph.operators import edges, emit
from quillgraph.plans import registry

from .conftest import SF


def scans(df, column="l_"):
    """Scans of the table whose columns begin so, and exchanges, in the plan as it is made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"FileScan parquet \[{column}", plan)), len(re.findall(r"Exchange hashpartitioning", plan))


def test_filings_read_the_facts_once_and_stay_with_their_supplier(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # lines by order and part, orders by customer and number, customers, parts, then facts by supplier
        lines, dealt = scans(registry.queries()["annual_rows"](spark, SF))
        assert lines == 1 and dealt <= 8
        lines, dealt = scans(registry.queries()["filing_observations"](spark, SF))
        assert lines == 1 and dealt <= 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filing_rows_are_read_once_and_say_no_more_than_is_asked(spark):
    rows = annual.annual(spark.createDataFrame([(1, "Part 6: Other Assets\n1  A    $1,001 - $15,000")], "doc_id long, text string")).withColumn("row", F.lit("r"))
    plan = emit.observations(rows, "doc_id").select("relation", "type", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    # the grammar's bands are matched in one place: 3 parts of a row, what follows its first band, 3 columns of a trade
    assert plan.count("(?s)^(.*?)(") <= 10 and plan.count("(?Uis)^(.*?)(") <= 10
    assert "StructsToJson" not in plan


def test_best_citations_join_the_facts_once_and_stay_with_their_customer(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # lines by order and part, orders by customer and number, customers, parts, then facts by customer
        lines, dealt = scans(registry.queries()["top_citations"](spark, SF))
        assert lines == 1 and dealt <= 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_backfill_and_affiliations_join_the_facts_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # orders are not met again: edges come from a written table of keys
        for name in ("isolated_backfill", "affiliation_seeds"):
            assert not scans(registry.queries()[name](spark, SF), "o_orderkey")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_long_and_short_artifacts_with_a_mark(spark):
    rows = [(a, f"e{i:02d}", i == 3) for a, n in ((1, 9), (2, 4), (3, 1)) for i in range(n)] * 2 + [(None, "e01", False), (1, None, False)]
    m = spark.createDataFrame(rows, "artifact_id long, canonical_id string, lone boolean")
    want = sorted((a, f"e{i:02d}", f"e{j:02d}") for a, n in ((1, 9), (2, 4)) for i in range(n) for j in range(i + 1, n))
    for chunk in (3, 2048):
        assert sorted(map(tuple, edges.mention_pairs(m, chunk).collect())) == want
        assert sorted(map(tuple, edges._pairs(m, chunk, "lone").collect())) == [w for w in want if "e03" in w]
