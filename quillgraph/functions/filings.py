"""Layout text of filings: periodic transaction reports as rows, and what rows give rise to.

All of it is Column expressions and windows over lines; only issuer names go through a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .issuer import issuer
from .text import BANDS, TRIVIAL_BANDS, band_bounds, band_dash, lookup, transaction_type

# Scanned spellings of transaction types.
SCANNED_TYPES = {
    "purchase": "purchase", "ourchase": "purchase", "ourchaso": "purchase", "purchaso": "purchase", "nurchase": "purchase", "nurchaso": "purchase",
    "nurchasc": "purchase", "purchasc": "purchase", "sale": "sale", "salo": "sale", "exchange": "exchange", "oxchange": "exchange",
}
BOILERPLATE = r"(?i)^(filer'?s name|page \d+|description\s+type|#\s+description|oge form|note:|endnotes?\b|u\.s\. office)"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page (from 1), at (line of the page), line: pages end at form feeds."""
    pages = docs.select(key, F.posexplode(F.split(text, "\f")).alias("p", "body"))
    return pages.select(key, (F.col("p") + 1).alias("page"), F.posexplode(F.split("body", r"\r?\n")).alias("at", "line"))


def row_end(line: Column) -> Column:
    """description, kind, date, band of a line that ends in a row's last columns; null for any other line.

    Read from the right: a known band, perhaps the late-notice column (yes or no), a date, a word for the kind.
    """
    text = F.rtrim(band_dash(line))
    # the longest band that ends the line, since some bands end in others
    band = F.coalesce(*[F.when(F.lower(text).endswith(" " + b.lower()), F.lit(b)) for b in sorted(BANDS, key=len, reverse=True)])
    rest = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(band)))
    words = F.split(rest, r"\s+")
    late = F.lower(F.element_at(words, -1)).isin("yes", "no")
    rest = F.when(late, F.regexp_replace(rest, r"\s*\S+$", "")).otherwise(rest)
    words = F.split(rest, r"\s+")
    date, kind = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    day = F.split(date, "/")
    digits = lambda i, least, most: F.get(day, i).rlike("^[0-9]+$") & F.length(F.get(day, i)).between(least, most)
    dated = (F.size(day) == 3) & digits(0, 1, 2) & digits(1, 1, 2) & digits(2, 4, 4)
    worded = kind.rlike("^[A-Za-z][A-Za-z0-9]*$") & F.length(kind).between(3, 18)
    own = F.trim(F.regexp_replace(rest, r"\S+\s+\S+$", ""))
    return F.when(band.isNotNull() & dated & worded, F.struct(own.alias("own"), F.lower(kind).alias("kind"), date.alias("date"), band.alias("band")))


def transactions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of periodic reports: key, page, at, row_index, description, transaction_type, trade_date, amount_band,
    confidence, reason.

    A row is a line that ends as :func:`row_end` says. What stands before that is its description, with up to
    three lines above it, back to a line that holds the row's number alone. A type too far from the known
    ones makes the row low, under the number before its own; nothing is guessed. Null and empty texts have no rows.
    """
    by_page, by_doc = W.partitionBy(key, "page").orderBy("at"), W.partitionBy(key).orderBy("page", "at")
    rows = lines_of(docs, key, text).withColumns({"clean": F.trim("line"), "end": row_end(F.col("line"))})
    # a line above counts if it is neither blank, nor boilerplate, nor behind a number line
    rows = rows.withColumns({f"a{k}": F.lag("clean", k).over(by_page) for k in (1, 2, 3)})
    is_number = lambda c: F.coalesce(F.col(c).rlike(r"^\d{1,9}$"), F.lit(False))
    usable = lambda c: F.when((F.coalesce(F.col(c), F.lit("")) != "") & ~F.coalesce(F.col(c).rlike(BOILERPLATE), F.lit(False)) & ~is_number(c), F.col(c))
    stop1, stop2 = is_number("a1"), is_number("a1") | is_number("a2")
    lead = F.array(F.when(~stop2, usable("a3")), F.when(~stop1, usable("a2")), usable("a1"), F.nullif(F.col("end.own"), F.lit("")))
    rows = rows.withColumn("description", F.array_join(F.filter(lead, lambda x: x.isNotNull()), " "))
    seen = F.when(is_number("a1"), F.col("a1")).when(is_number("a2"), F.col("a2")).when(is_number("a3"), F.col("a3")).cast("int")
    rows = rows.filter(F.col("end").isNotNull() & (F.col("description") != "")).withColumn("reset", seen)
    # numbering goes on from the last number line
    rows = rows.withColumn("block", F.sum(F.when(F.col("reset").isNotNull(), 1).otherwise(0)).over(by_doc))
    in_block = W.partitionBy(key, "block").orderBy("page", "at")
    kind = F.coalesce(lookup(SCANNED_TYPES, F.col("end.kind")), transaction_type(F.col("end.kind")))
    rows = rows.withColumns({"base": F.coalesce(F.first("reset").over(in_block), F.lit(0)) + F.row_number().over(in_block), "known": kind})
    return rows.select(
        key, "page", "at", (F.col("base") - F.col("known").isNull().cast("int")).alias("row_index"), "description", F.col("known").alias("transaction_type"),
        F.col("end.date").alias("trade_date"), F.col("end.band").alias("amount_band"), F.when(F.col("known").isNotNull(), "high").otherwise("low").alias("confidence"),
        F.when(F.col("known").isNull(), "type_not_recognized").alias("reason"),
    )


def confidence_summary(rows: DataFrame, part: str = "part") -> DataFrame:
    """High, low and total per part, and over all parts (part null)."""
    n = lambda c: F.count(F.when(F.col("confidence") == c, 1)).alias(c)
    return rows.rollup(part).agg(n("high"), n("low"), F.count("*").alias("total"))


def traded_edges(rows: DataFrame, filer: str, key: str = "doc_id") -> DataFrame:
    """Observations of traded edges of high rows: source, target (issuer), bounds, citation to the page."""
    good = rows.filter("confidence = 'high'")
    return good.select(
        F.col(filer).alias("source"), issuer(F.col("description")).alias("target"), F.lit("traded").alias("relation"), band_bounds(F.col("amount_band")).alias("bounds"),
        F.concat(F.col(key).cast("string"), F.lit("#page="), F.col("page")).alias("citation_url"), "row_index",
    )


def income_edge_allowed(band: Column) -> Column:
    return band.isNotNull() & (band != "") & ~band.isin(*TRIVIAL_BANDS)
