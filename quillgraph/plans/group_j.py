"""Annual filings, made of the star tables as layout text, read back and emitted."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import annual as A
from ..operators import emit
from .views import duck, view

#: Rows of a supplier's filing: section, number n in it, page, and the columns as they are printed.
_BANDS = "CASE WHEN {0} < 10 THEN '$1,001 - $15,000' WHEN {0} < 20 THEN 'Over $5,000,000' WHEN {0} < 30 THEN 'None (or less than $1,001)' ELSE '$50,001 - $100,000' END"
ROWS = f"""fr AS (SELECT l_suppkey AS doc_id, part, n, p_name AS words, l_returnflag AS flag, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(l_quantity AS BIGINT) AS q, c_nationkey AS nk,
    o_custkey AS ck, p_brand AS brand, l_partkey AS pk FROM (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey, part ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey) AS n FROM (
      SELECT *, CASE WHEN l_linenumber = 1 THEN 6 WHEN l_linenumber <= 3 THEN 7 ELSE 8 END AS part FROM v_fact) a) b),
  pg AS (SELECT doc_id, part, CAST(floor((max(n) + 29) / 30) AS BIGINT) AS pages FROM fr GROUP BY doc_id, part),
  fp AS (SELECT fr.*, CAST(floor((n - 1) / 30) AS BIGINT) AS own_page, CAST(floor((n - 1) / 30) + 1 + coalesce((SELECT sum(pages) FROM pg WHERE pg.doc_id = fr.doc_id AND pg.part < fr.part), 0) AS BIGINT) AS page,
    {_BANDS.format('q')} AS band, {_BANDS.format('(q * 7 + n) % 40')} AS band2, n % 17 = 0 AS broken FROM fr)"""


def _printed(s, d):
    """The rows of ``fp``. Facts are joined once and dealt by supplier once; all windows over a filing stay where its rows are."""
    c, page = F.col, lambda n: F.floor((n + 29) / 30).cast("long")
    part = F.when(c("l_linenumber") == 1, 6).when(c("l_linenumber") <= 3, 7).otherwise(8)
    fact = view(s, d, "v_fact").select(
        c("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber", c("l_partkey").alias("pk"), "l_quantity", c("o_custkey").alias("ck"), c("p_name").alias("words"),
        c("l_returnflag").alias("flag"), "o_orderdate", c("c_nationkey").alias("nk"), c("p_brand").alias("brand")).repartition("doc_id").withColumn("part", part)
    order = W.partitionBy("doc_id", "part").orderBy("l_orderkey", "l_linenumber", "pk", "l_quantity", "ck")
    held = W.partitionBy("doc_id", "part").orderBy("l_orderkey", "l_linenumber", "pk", "l_quantity", "ck").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = fact.withColumns({"n": F.row_number().over(order), "pages": page(F.count("*").over(held))})
    # each part's pages once, from its first row, for the parts that come after it
    before = W.partitionBy("doc_id").orderBy("part", "n").rowsBetween(W.unboundedPreceding, -1)
    first = F.sum(F.when(c("n") == 1, c("pages"))).over(before)
    rows = rows.withColumn("before", F.coalesce(F.when(c("n") == 1, first).otherwise(first - c("pages")), F.lit(0)))
    q, own = c("l_quantity").cast("long"), F.floor((c("n") - 1) / 30).cast("long")
    rows = rows.select(
        "doc_id", "part", "n", "words", "flag", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), q.alias("q"), "nk", "ck", "brand", "pk",
        own.alias("own_page"), (own + 1 + c("before")).alias("page"), (c("n") % 17 == 0).alias("broken"))
    return rows.withColumns({"band": F.expr(_BANDS.format("q")), "band2": F.expr(_BANDS.format("(q * 7 + n) % 40"))})


def _filings(s, d):
    """One layout text a supplier: pages of 30 rows, headings on every other page, accounts, wrapped and broken rows."""
    rows = _printed(s, d)
    c, band = F.col, F.when(F.col("broken"), "$9 - $10").otherwise(F.col("band"))
    number = c("n").cast("string")
    account = F.when(c("n") % 10 == 1, F.concat(F.lit("   INVESTMENT ACCOUNT #"), F.floor(c("n") / 10).cast("string"), F.lit("\n"))).otherwise("")
    asset = F.concat(account, number, F.lit("    "), c("words"), F.lit("     N/A     "), band, F.when(c("broken"), "").otherwise(F.concat(F.lit("   Dividends   "), c("band2"))))
    kind = F.when(c("flag") == "A", "Purchase").when(c("flag") == "R", "sale").otherwise("Exchange")
    gap = F.when(c("n") % 3 == 0, "\n          ").otherwise("    ")
    deal = F.concat(account, F.lit("  "), number, F.lit("   "), c("words"), gap, kind, F.lit("  "), F.concat_ws("/", "m", "d", "y"), F.lit("   "), band)
    who = F.when(c("nk") % 3 == 0, F.concat(F.lit("Ann Poe "), c("ck"))).when(c("nk") % 3 == 1, F.concat(F.lit("Bank of "), c("brand"))).otherwise(F.concat(F.lit("Department "), c("nk")))
    debt = F.concat(number, F.lit(". "), who, F.lit("      Loan     "), band, F.lit("   "), c("y").cast("string"), F.lit("   3.5%  on demand"))
    line = F.when(c("part") == 6, asset).when(c("part") == 7, deal).otherwise(debt)
    title = F.when(c("part") == 6, "Part 6: Other Assets and Income").when(c("part") == 7, "Part 7: Transactions").otherwise("Part 8: Liabilities")
    head = F.concat(F.lit("OGE Form 278e\n"), F.when(c("own_page") % 2 == 0, F.concat(F.lit(" "), title, F.lit("\n"))).otherwise(""), F.lit("  # Description   Value\n"))
    page = rows.groupBy("doc_id", "page").agg(F.min(head).alias("head"), F.array_join(F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))["line"], "\n").alias("body"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("page", F.concat("head", "body").alias("t"))))["t"], "\f")
    return page.groupBy("doc_id").agg(text.alias("text"))


def _annual(s, d):
    rows = A.annual(_filings(s, d))
    return rows.select("doc_id", "part", "page", "account_group", "row_index", "confidence", "reason", *A.FOUND)


_PART = "CASE part WHEN 6 THEN 'part_6_other_assets' WHEN 7 THEN 'part_7_transactions' ELSE 'part_8_liabilities' END"
_WHO = "CASE nk % 3 WHEN 0 THEN 'Ann Poe ' || ck::VARCHAR WHEN 1 THEN 'Bank of ' || brand ELSE 'Department ' || nk::VARCHAR END"
_ANNUAL = f"""SELECT doc_id, {_PART} AS part, page, CASE WHEN part < 8 THEN ((n - 1) // 10 * 10 + 1) // 10 END AS account_group, n AS row_index, CASE WHEN broken THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN broken THEN CASE part WHEN 7 THEN 'no_tail_type_date_band' ELSE 'no_value_band_matched' END END AS reason,
  CASE WHEN NOT broken AND part < 8 THEN words END AS description, CASE WHEN NOT broken AND part = 6 THEN 'N/A' END AS eif, CASE WHEN NOT broken AND part = 6 THEN band END AS value_band,
  CASE WHEN NOT broken AND part = 6 THEN 'Dividends' END AS income_type, CASE WHEN NOT broken AND part = 6 THEN band2 END AS income_band,
  CASE WHEN NOT broken AND part = 7 THEN CASE flag WHEN 'A' THEN 'purchase' WHEN 'R' THEN 'sale' ELSE 'exchange' END END AS transaction_type,
  CASE WHEN NOT broken AND part = 7 THEN CASE flag WHEN 'A' THEN 'Purchase' WHEN 'R' THEN 'sale' ELSE 'Exchange' END END AS transaction_raw,
  CASE WHEN NOT broken AND part = 7 THEN m::VARCHAR || '/' || d::VARCHAR || '/' || y::VARCHAR END AS trade_date, CASE WHEN NOT broken AND part > 6 THEN band END AS amount_band,
  CASE WHEN NOT broken AND part = 8 THEN {_WHO} || '      Loan' END AS lead, CASE WHEN NOT broken AND part = 8 THEN y::VARCHAR || '   3.5%  on demand' END AS tail FROM fp"""


def _emitted(s, d):
    """Relations, kinds and modes of what the filings say, with numbers of observations and of filings."""
    rows = A.annual(_filings(s, d)).withColumn("row", F.concat_ws("/", F.col("doc_id").cast("string"), "part", F.col("row_index").cast("string")))
    said = emit.observations(rows, "doc_id")
    return said.groupBy("relation", "type", "mode").agg(F.count("*").alias("observations"), F.countDistinct("doc_id").alias("filings"))


_EMITTED = f"""o AS (SELECT doc_id, 'holds_asset' AS relation, 'organization' AS type FROM fp WHERE part = 6 AND NOT broken
    UNION ALL SELECT doc_id, 'income_from', 'organization' FROM fp WHERE part = 6 AND NOT broken AND band2 NOT LIKE 'None%'
    UNION ALL SELECT doc_id, 'traded', 'organization' FROM fp WHERE part = 7 AND NOT broken
    UNION ALL SELECT doc_id, 'owes', CASE nk % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'agency' END FROM fp WHERE part = 8 AND NOT broken)
  SELECT relation, type, CASE type WHEN 'person' THEN 'suppress' ELSE 'open' END AS mode, count(*) AS observations, count(DISTINCT doc_id) AS filings FROM o GROUP BY 1, 2, 3"""

QUERIES = {
    "annual_rows": (_annual, duck(f"WITH {ROWS} {_ANNUAL}")),
    "filing_observations": (_emitted, duck(f"WITH {ROWS}, {_EMITTED}")),
}
