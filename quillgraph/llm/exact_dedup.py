"""Exact deduplication by progressive refinement (DataFrame operations only).

Rows are grouped by normalised length, then by the hash of a prefix, then by the hash of the full
text. Only rows whose (length, prefix) group has another member reach the full hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, numbered, text_or_empty

#: Code points of the normalised text that the second level hashes.
PREFIX = 256


def normalised(column: str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), f"[{WS}]++", "")


def _full_hash(column: str = "text") -> Column:
    return F.sha2(normalised(column).cast("binary"), 256)


def refine(rows: DataFrame, digest: bool) -> DataFrame:
    """One slim row per row of ``rows`` (row, doc_id, text): row, doc_id, keep_id, group_size, kept, full_hash.

    Of equal texts the row with most code points stays, then the smallest doc_id (null last), then the
    first row. All empty and null texts are equal to one another. Repeated rows are equal texts. An
    empty table gives an empty one.

    ``digest``: the caller wants the full hash of every row, singletons too, so the one scan takes
    it along; ``row`` may then be any number made in that scan. Otherwise the full content is hashed in
    a second scan, for surviving groups only, and ``rows`` must be a written table (:func:`common.numbered`).
    Groups are only ever counted and reduced by partial aggregates; joins back go by the group's
    key, which AQE splits when one group is hot.
    """
    norm = normalised()
    columns = [
        F.col("row"),
        F.col("doc_id"),
        F.length(text_or_empty()).alias("code_points"),
        F.length(norm).alias("len"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"),
    ]
    slim = materialize(rows.select(*columns, *([_full_hash().alias("full_hash")] if digest else [])))
    by_len = slim.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len")
    by_prefix = (
        slim.join(by_len, "len", "left_semi").groupBy("len", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("len", "prefix")
    )
    survivors = slim.join(by_prefix, ["len", "prefix"], "left_semi")
    if not digest:
        # the second scan: full content of the surviving rows, which are shuffled once and hashed where they meet
        content = rows.select("row", "text").join(survivors.hint("merge"), "row")
        survivors = materialize(content.withColumn("full_hash", _full_hash()).drop("text"))
    best = F.min(F.struct((-F.col("code_points")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row").alias("r")))
    groups = survivors.groupBy("full_hash").agg(best.alias("b"), F.count("*").alias("group_size"))
    hit = (
        survivors.join(groups, "full_hash")
        .select(
            "row", "doc_id", F.col("b.i").alias("keep_id"), "group_size", (F.col("b.r") == F.col("row")).alias("kept"), "full_hash"
        )
    )
    alone = slim.join(by_prefix, ["len", "prefix"], "left_anti").select(
        "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        (F.col("full_hash") if digest else F.lit(None).cast("string")).alias("full_hash"),
    )
    return hit.unionByName(alone)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns; see
    :func:`refine` for nulls, empty texts, ties and repeated rows."""
    rows, row = numbered(docs)
    plan = refine(rows.select(F.col(row).alias("row"), "doc_id", "text"), digest=False)
    # texts meet the plan in one way at every size: sorted by row, spilling if need be, nothing broadcast
    dropped = plan.filter("NOT kept").select(F.col("row").alias(row)).hint("merge")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document.

    Null, empty and blank texts are one group; of equal texts the one with most code points stays, then
    the smallest doc_id (null last), then the first row; repeated rows give repeated rows. The numbers
    that tell rows apart are made in the one scan and written with the rest.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return refine(rows, digest=True).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("full_hash").alias("text_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, doc_id ASC NULLS LAST) AS k,
        first_value(doc_id) OVER (PARTITION BY h ORDER BY c DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM d)
SELECT doc_id, keep_id, n::BIGINT AS group_size, (k = 1) AS kept, h AS text_sha256 FROM r
"""
