"""Filing rows to edges: what each part's high rows say of the filer, resolved, upserted and cited."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.annual import ASSETS
from ..functions.filings import income_edge_allowed
from ..functions.issuer import issuer
from ..functions.text import band_bounds, normalize_name

# What marks a public body, wherever it stands, and an organisation, as whole words.
AGENCY_HINTS = (
    "ATTORNEY GENERAL", "DEPARTMENT", "BUREAU", "COMMISSION", "BOARD", "FEDERAL", "GOVERNMENT", "STATE OF", "COUNTY OF", "CITY OF", "GENERAL ASSEMBLY", "AUTHORITY",
)
ORG_HINTS = (
    "LLC", "L.L.C.", "INC", "INC.", "CORP", "CO.", "COMPANY", "TRUST", "BANK", "SAVINGS", "CREDIT", "PAC", "COMMITTEE", "FUND", "N.A.", "N.V.", "S.A.", "GROUP", "SYSTEMS", "HOLDINGS",
    "LTD", "LTD.", "PLC", "CAPITAL", "PARTNERS", "ASSOCIATES", "REIT", "ETF", "SHARES", "AMERICAN EXPRESS", "MASTERCARD", "VISA",
)
RELATION = {**dict.fromkeys(ASSETS, "holds_asset"), "part_1_positions": "held_position", "part_7_transactions": "traded", "part_8_liabilities": "owes"}
_AGENCY = "|".join(map(re.escape, AGENCY_HINTS))
_ORG = rf"(?:^|[^A-Z0-9])(?:{'|'.join(map(re.escape, ORG_HINTS))})(?:[^A-Z0-9]|$)"


def org_type(name: Column) -> Column:
    """agency where a hint of one stands anywhere in the name, else organization; never a person."""
    return F.when(F.upper(name).rlike(_AGENCY), "agency").otherwise("organization")


def creditor_type(name: Column) -> Column:
    """agency, organization, or person where nothing says otherwise: who is unknown is protected."""
    upper = F.upper(F.trim(name))
    return F.when(upper.rlike(_AGENCY), "agency").when(upper.rlike(_ORG), "organization").otherwise("person")


def position_org(lead: Column) -> Column:
    """The first column of a position: all before two blanks."""
    return F.trim(F.regexp_extract(F.trim(lead), r"(?Us)^(.+?)(?:\s{2,}|$)", 1))


def liability_lead(lead: Column) -> Column:
    """creditor and kind of a liability, four blanks apart."""
    at = r"(?Us)^(.+?)\s{4,}(.+)$"
    both = F.trim(lead).rlike(at)
    return F.struct(
        F.when(both, F.trim(F.regexp_extract(F.trim(lead), at, 1))).otherwise(F.trim(lead)).alias("creditor"),
        F.when(both, F.trim(F.regexp_extract(F.trim(lead), at, 2))).alias("kind"),
    )


def liability_tail(tail: Column) -> Column:
    """year, rate and term: the first year, the first rate, and what follows the rate (else the year, else all)."""
    some = lambda c: F.nullif(c, F.lit(""))
    year, rate = r"\b(19\d{2}|20\d{2})\b", r"(\d+(?:\.\d+)?%|N/A)"
    y, r = some(F.regexp_extract(tail, year, 1)), some(F.regexp_extract(tail, rate, 1))
    after = lambda p: F.regexp_extract(tail, rf"(?s)^.*?{p}(.*)$", 2)
    term = F.when(r.isNotNull(), after(rate)).when(y.isNotNull(), after(year)).otherwise(tail)
    return F.struct(y.alias("year"), r.alias("rate"), some(F.trim(term)).alias("term"))


def observations(rows: DataFrame, *keep: str) -> DataFrame:
    """What high rows say: row, relation, name, type, mode, metadata (JSON), and the rows' columns of ``keep``.

    ``rows`` are those of :func:`..functions.annual.annual` with an id ``row``. An asset says what is held and, where
    its income is more than trivial, what it yields; a position, a trade and a debt one thing each. Organisations
    go by issuer; creditors that may be persons keep their name and are suppressed. Rows without a name or a
    band say nothing. A band out of the known ones counts from 0.
    """
    part, name = F.col("part"), lambda c: F.coalesce(F.nullif(issuer(c), F.lit("")), c)
    # a number that Spark may not work out twice keeps the filters above the grammar, which is else matched for them once more
    high = rows.withColumn("read", F.monotonically_increasing_id()).filter((F.col("confidence") == "high") & (F.col("read") >= 0)).filter(part.isin(*RELATION))
    owed = F.when(part == "part_8_liabilities", F.struct(liability_lead(F.col("lead")).alias("l"), liability_tail(F.coalesce("tail", F.lit(""))).alias("t")))
    surface = F.when(part == "part_1_positions", position_org(F.col("lead"))).when(part == "part_8_liabilities", F.col("owed.l.creditor")).otherwise(F.trim("description"))
    high = high.withColumn("owed", owed).withColumn("surface", F.nullif(surface, F.lit("")))
    band = F.coalesce("value_band", "amount_band")
    high = high.filter(F.col("surface").isNotNull() & ((part == "part_1_positions") | band.isNotNull()) & ((part != "part_7_transactions") | F.col("transaction_type").isNotNull()))
    kind = F.when(part == "part_8_liabilities", creditor_type(F.col("surface")))
    # a person's name is no issuer's
    high = high.withColumn("kind", kind).withColumn("issued", name(F.when(F.col("kind").isNull() | (F.col("kind") != "person"), F.col("surface"))))
    high = high.withColumn("name", F.when(F.col("kind") == "person", F.col("surface")).otherwise(F.col("issued")))
    # a debt's type is told by the creditor's whole name, all others by the issuer's
    high = high.withColumn("type", F.coalesce("kind", org_type(F.col("issued"))))
    bounds = lambda b: (F.coalesce(band_bounds(b)["low"], F.lit(0)), band_bounds(b)["high"])
    (low, top), (ilow, itop) = bounds(band), bounds(F.col("income_band"))
    say = lambda **f: F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in f.items()], part))
    c = F.col
    said = (
        F.when(part.isin(*ASSETS), say(value_band=c("value_band"), band_low=low, band_high=top, eif=c("eif"), account_group=c("account_group")))
        .when(part == "part_7_transactions", say(transaction_type=c("transaction_type"), trade_date=c("trade_date"), amount_band=c("amount_band"), band_low=low, band_high=top, account_group=c("account_group")))
        .when(part == "part_8_liabilities", say(amount_band=c("amount_band"), band_low=low, band_high=top, liability_type=c("owed.l.kind"), year_incurred=c("owed.t.year"), rate=c("owed.t.rate"), term=c("owed.t.term")))
        .otherwise(say(raw_lead=F.trim("lead")))
    )
    relation = F.element_at(F.create_map(*[F.lit(x) for kv in RELATION.items() for x in kv]), part)
    yields = say(income_type=c("income_type"), income_band=c("income_band"), band_low=ilow, band_high=itop, account_group=c("account_group"))
    # metadata are made of rows that are there, and not at all where nobody asks for them
    both = F.array(relation, F.when(part.isin(*ASSETS) & income_edge_allowed(c("income_band")), F.lit("income_from")))
    out = high.withColumn("relation", F.explode(F.filter(both, lambda x: x.isNotNull())))
    out = out.withColumn("metadata", F.when(c("relation") == "income_from", yields).otherwise(said))
    mode = F.when(F.col("type") == "person", "suppress").otherwise("open")
    return out.select("row", "relation", "name", "type", mode.alias("mode"), "metadata", *keep)


def targets(said: DataFrame, entities: DataFrame) -> DataFrame:
    """name, type, mode, id, made of what observations name: the entity of the type with the same normalised name (of
    several the smallest id), else a new one of a steady id. A name without a word makes one of its own."""
    norm = F.coalesce(normalize_name(F.col("name")), F.lit(""))
    asked = said.select("name", "type", "mode").distinct().withColumn("norm", norm)
    known = entities.select("type", normalize_name(F.col("name")).alias("norm"), "id").filter("norm <> ''").groupBy("type", "norm").agg(F.min("id").alias("known"))
    key = F.concat_ws("|", "type", F.when(F.col("norm") != "", F.col("norm")).otherwise(F.concat(F.lit("|"), "name")))
    new = F.concat(F.lit("new:"), F.substring(F.sha2(key, 256), 1, 16))
    return asked.join(known, ["type", "norm"], "left").select("name", "type", "mode", F.coalesce("known", new).alias("id"), F.col("known").isNull().alias("made"))


def emitted(rows: DataFrame, filings: DataFrame, entities: DataFrame, edges: DataFrame, citations: DataFrame, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities, all edges of the filings as they are afterwards, and new citations.

    ``rows`` (with ``row`` and ``doc_id``) belong to ``filings`` (doc_id, filer, form_type, url, digest). New entities
    and edges are staged under the batch, persons suppressed from the start; an edge that is there keeps its state
    and takes the last row's metadata, field by field. A row is cited once an edge, so a second run adds nothing.
    """
    from .edges import KEY, merge_metadata

    said = observations(rows).join(rows.select("row", "doc_id", "page", "row_index", "part"), "row").join(filings, "doc_id")
    met = targets(said, entities)
    linked = said.join(met, ["name", "type", "mode"])
    # two spellings of one normalised name make one entity, under the first
    made = linked.filter("made").groupBy("id", "type").agg(F.min("name").alias("name"), F.max("mode").alias("surface_mode"))
    new = made.withColumns({"publication_state": F.lit("staged"), "batch_id": F.lit(batch)})
    keyed = linked.select(F.col("filer").alias("source_id"), F.col("id").alias("target_id"), "relation", "row", "metadata", "form_type", "url", "digest", "page", "row_index", "part")
    per = merge_metadata(keyed, list(KEY), "row")
    state = edges.select(*KEY, "publication_state", "batch_id", F.lit(True).alias("old"))
    after = per.join(state, list(KEY), "left").select(
        *KEY, "metadata", F.coalesce("publication_state", F.lit("staged")).alias("publication_state"),
        F.when(F.col("old"), F.col("batch_id")).otherwise(F.lit(batch)).alias("batch_id"), F.col("old").isNull().alias("made"),
    )
    ref = F.concat_ws("::", F.substring("digest", 1, 16), "part", F.concat(F.lit("row"), "row_index"), F.concat(F.lit("p"), "page"))
    cited = keyed.select(
        F.concat_ws("|", "relation", "source_id", "target_id").alias("edge_id"), F.when(F.col("form_type") == "oge_278t", "oge_278t").otherwise("oge_278e").alias("kind"),
        F.concat(F.col("url"), F.lit("#page="), "page").alias("citation_url"), ref.alias("citation_ref"), F.col("row").alias("disclosure_row_id"), "page",
    ).distinct()
    return new, after, cited.join(citations.select("edge_id", "disclosure_row_id"), ["edge_id", "disclosure_row_id"], "left_anti").select(*cited.columns)
