"""Annual filings: layout text to rows, part by part.

A filing is a run of pages of lines. The part, the account and the row that a line belongs to are carried
from line to line, and over page breaks, as windows over the filing's lines; each row's text is then read by
its part's own grammar. A row that the grammar does not read is low, with the reason; nothing is guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filings import SCANNED_TYPES
from .text import BANDS, lookup, transaction_type

# Names of the parts, and what their headings hold.
PARTS = {
    "part_1_positions": "Positions Held", "part_2_empl_assets": "Employment Assets", "part_3_agreements": "Employment Agreements", "part_4_comp_sources": "Sources of Compensation",
    "part_5_spouse_assets": "Spouse", "part_6_other_assets": "Other Assets", "part_7_transactions": "Transactions", "part_8_liabilities": "Liabilities", "part_9_gifts": "Gifts",
}
ASSETS = ("part_2_empl_assets", "part_5_spouse_assets", "part_6_other_assets")
GROUPED = (*ASSETS, "part_7_transactions")
# Types in the transactions part, and lines that are no content.
TYPES = ("purchase", "sale", "exchange", "S (partial)", "P (partial)", "ourchase", "ourchaso", "purchaso", "salo", "salo (partial)", "oxchange")
NOT_CONTENT = (
    r"^OGE Form 278e", r"^\s*Instructions for Part \d+", r"^\s*If you need more pages", r"^\s*Note: This is a public form", r"^\s*Filer's Name\s", r"^\s*I?Page Number",
    r"^\s*I?\s*Page \d+ of \d+", r"^\s*Part \d+:", r"^\s*#\s+(?:Description|Organization Name|Employer|Source Name|Creditor Name)",
)
NARRATIVE, STUB, NO_BAND, NO_TAIL = "narrative_part_not_structured_in_d1", "empty_row_stub", "no_value_band_matched", "no_tail_type_date_band"

_LINE_END = r"\r\n|[\n\r\x0B\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_ACCOUNT = r"(?U)^\s*INVESTMENT ACCOUNT #(\d+)\s*$"
_ROW = r"(?U)^\s{0,15}(\d+)(?:\.\s*|\s{2,})(.*)$"
_BAND = "|".join(map(re.escape, sorted(BANDS, key=len, reverse=True)))
_TAIL = rf"(?Uis)^(.*?)({'|'.join(map(re.escape, TYPES))})\s+(\d{{1,2}}/\d{{1,2}}/\d{{4}})\s+(?:(?:Yes|No)\s+)?({_BAND})\s*$"
#: What a part's grammar may find in a row.
FOUND = ("description", "eif", "value_band", "income_type", "income_band", "transaction_type", "transaction_raw", "trade_date", "amount_band", "lead", "tail")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _marked(docs: DataFrame, key: str, text: str, header: str | None) -> DataFrame:
    """Lines (key, page, at, line) of parts, with part, section (a run of pages of one part), account and block.

    A page's part is that of the first heading on it, by number of the part; without one the part goes on.
    A block begins at each row number; a new part or account ends it.
    """
    by_page, by_line = W.partitionBy(key).orderBy("page"), W.partitionBy(key).orderBy("page", "at")
    pages = docs.select(key, F.posexplode(F.split(text, "\f")).alias("p", "body")).withColumn("page", F.col("p") + 1)
    heading = F.coalesce(*[F.when(F.col("body").rlike(rf"(?Um)^\s*Part {i}: .*{title}"), F.lit(name)) for i, (name, title) in enumerate(PARTS.items(), 1)])
    pages = pages.withColumn("part", F.last(heading, ignorenulls=True).over(by_page))
    pages = pages.withColumn("opens", F.col("part").isNotNull() & ~F.col("part").eqNullSafe(F.lag("part").over(by_page)))
    pages = pages.withColumn("section", F.sum(F.col("opens").cast("int")).over(by_page)).filter("part IS NOT NULL")
    lines = pages.select(key, "page", "part", "section", F.posexplode(F.split("body", _LINE_END)).alias("at", "line"))
    noise = F.regexp_replace("line", r"(?U)\s+", "") == ""
    for pattern in (*NOT_CONTENT, *([header] if header else ())):
        noise = noise | F.col("line").rlike(f"(?U){pattern}")
    lines = lines.filter(~noise).withColumns({"account": F.try_to_number(_some(F.regexp_extract("line", _ACCOUNT, 1)), F.lit("9" * 18)).cast("long"), "row": F.col("line").rlike(_ROW)})
    new_section = ~F.col("section").eqNullSafe(F.lag("section").over(by_line))
    starts = F.col("row") | F.col("line").rlike(_ACCOUNT) | new_section
    in_section = W.partitionBy(key, "section").orderBy("page", "at")
    lines = lines.withColumns({"block": F.sum(starts.cast("int")).over(by_line), "account": F.last("account", ignorenulls=True).over(in_section)})
    return lines.withColumn("row", F.col("row") & ~F.col("line").rlike(_ACCOUNT))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", header: str | None = None) -> DataFrame:
    """Rows before their grammar: key, part, section, block, page (where the row starts), account_group, row_index, raw_text, rest."""
    lines = _marked(docs, key, text, header)
    bare = F.regexp_replace("line", r"(?U)\s+$", "")
    per = lines.groupBy(key, "part", "section", "block").agg(
        F.min(F.struct("page", "at", "row", "account", "line")).alias("first"),
        F.array_sort(F.collect_list(F.struct("page", "at", bare.alias("line")))).alias("all"),
    ).filter("first.row")
    joined = F.concat(F.array(F.regexp_extract("first.line", _ROW, 2)), F.transform(F.slice("all.line", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), _strip))
    return per.select(
        key, "part", "section", "block", "first.page", F.when(F.col("part").isin(*GROUPED), F.col("first.account")).alias("account_group"),
        F.regexp_extract("first.line", _ROW, 1).try_cast("long").alias("row_index"), F.array_join("all.line", "\n").alias("raw_text"), F.array_join(joined, " ").alias("rest"),
    )


def _read(rows: DataFrame) -> DataFrame:
    """Rows with what each part's grammar finds; null where the part has no such field or the row does not have it.

    What several fields are made of is a column first, so that no expression is matched once for each of them.
    """
    assets, deals, debts, posts = F.col("part").isin(*ASSETS), F.col("part") == "part_7_transactions", F.col("part") == "part_8_liabilities", F.col("part") == "part_1_positions"
    first, found = rf"(?s)^(.*?)({_BAND})(.*)$", F.col("band") != ""
    banded = lambda i: F.when(assets | debts, F.regexp_extract("rest", first, i))
    rows = rows.withColumns({"before": banded(1), "band": banded(2), "after": banded(3), "raw": F.when(deals, _some(F.regexp_extract("rest", _TAIL, 2)))})
    rows = rows.withColumns({"between": F.when(assets, F.regexp_extract("after", first, 1)), "second": F.when(assets, F.regexp_extract("after", first, 2))})
    mark, raw = r"(?U)\s{2,}(N/A|Yes|No)\s*$", F.col("raw")
    return rows.withColumns({
        "description": F.when(assets & found, _strip(F.regexp_replace("before", mark, ""))).when(deals & raw.isNotNull(), _strip(F.regexp_extract("rest", _TAIL, 1))),
        "eif": F.when(assets & found, _some(F.regexp_extract("before", mark, 1))),
        "value_band": F.when(assets, _some(F.col("band"))), "income_type": F.when(assets & (F.col("second") != ""), _some(_strip(F.col("between")))),
        "income_band": F.when(assets, _some(F.col("second"))),
        "transaction_type": F.when(deals, F.coalesce(lookup(SCANNED_TYPES, F.lower(raw)), transaction_type(raw), lookup({"s (partial)": "sale", "p (partial)": "purchase", "salo (partial)": "sale"}, F.lower(raw)))),
        "transaction_raw": raw, "trade_date": F.when(deals, _some(F.regexp_extract("rest", _TAIL, 3))),
        "amount_band": F.when(deals, _some(F.regexp_extract("rest", _TAIL, 4))).when(debts, _some(F.col("band"))),
        "lead": F.when(posts, _some(_strip(F.col("rest")))).when(debts & found, _strip(F.col("before"))), "tail": F.when(debts & found, _strip(F.col("after"))),
    })


def annual(docs: DataFrame, key: str = "doc_id", text: str = "text", header: str | None = None) -> DataFrame:
    """Rows of annual filings: key, part, page, account_group, row_index, raw_text, confidence, reason and the fields of
    FOUND, in no order.

    Lines of no part, lines before the first row number of a part or account, and page furniture belong to
    no row; ``header`` is a pattern of further furniture, such as the filer's own name. Parts 3, 4 and 9 are
    told in prose and always low. Null and empty texts have no rows; filings are told apart by ``key``, so rows
    with one key are read as one filing.
    """
    rows = _read(blocks(docs, key, text, header))
    assets, part = F.col("part").isin(*ASSETS), F.col("part")
    reason = (
        F.when(assets & F.col("value_band").isNull(), NO_BAND).when((part == "part_7_transactions") & F.col("transaction_raw").isNull(), NO_TAIL)
        .when((part == "part_8_liabilities") & F.col("amount_band").isNull(), NO_BAND).when((part == "part_1_positions") & F.col("lead").isNull(), STUB)
        .when(part.isin("part_3_agreements", "part_4_comp_sources", "part_9_gifts"), NARRATIVE)
    )
    return rows.select(
        key, "part", "page", "account_group", "row_index", "raw_text", F.when(reason.isNull(), "high").otherwise("low").alias("confidence"), reason.alias("reason"), *FOUND)
