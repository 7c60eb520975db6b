"""Readers of the record formats that edges are derived from. All are plain Spark reads plus columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import label_or_parts, name_variants

# Filing forms that count.
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A", "DEF 14A", "S-1", "S-3", "S-4", "20-F")


def linkage(spark: SparkSession, path: str, cycle: int) -> DataFrame:
    """candidate, committee, designation, cycle of a pipe-delimited linkage file. Junk, short rows, odd ids
    and links of a committee to itself are dropped."""
    p = F.split("value", r"\|")
    rows = spark.read.text(path).filter(F.size(p) >= 7).select(F.trim(p[0]).alias("candidate"), F.trim(p[3]).alias("committee"), F.trim(p[5]).alias("designation"))
    return rows.filter(F.col("candidate").rlike("^[HSP][0-9A-Z]{8}$") & F.col("committee").rlike(r"^C\d{8}$") & (F.col("candidate") != F.col("committee"))).withColumn("cycle", F.lit(cycle))


ROLL_CALL = T.StructType([
    T.StructField("legislator", T.StructType([
        T.StructField("_name-id", T.StringType()), T.StructField("_party", T.StringType()), T.StructField("_state", T.StringType()), T.StructField("_VALUE", T.StringType()),
    ])),
    T.StructField("vote", T.StringType()),
])


def roll_call(spark: SparkSession, path: str) -> DataFrame:
    """member, vote of a roll-call document; a malformed one gives no rows."""
    rows = spark.read.format("xml").schema(ROLL_CALL).option("rowTag", "recorded-vote").option("mode", "DROPMALFORMED").load(path)
    return rows.select(F.col("legislator.`_name-id`").alias("member"), F.trim("vote").alias("vote")).filter("member IS NOT NULL AND member <> ''")


ROSTER = T.StructType([
    T.StructField("id", T.StructType([T.StructField("bioguide", T.StringType()), T.StructField("fec", T.ArrayType(T.StringType()))])),
    T.StructField("name", T.StructType([T.StructField(c, T.StringType()) for c in ("first", "last", "middle", "nickname", "suffix", "official_full")])),
    T.StructField("other_names", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("first", "last")]))),
    T.StructField("terms", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "start", "end", "state", "party", "district")]))),
])


def roster(spark: SparkSession, path: str) -> DataFrame:
    """member, label, variants, candidates and current term of a roster, one JSON record a line or an array.

    The current term is the one that starts last; party spellings are folded to one.
    """
    rows = spark.read.schema(ROSTER).option("multiLine", True).json(path).filter("id.bioguide IS NOT NULL")
    last = F.element_at(F.array_sort(F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["party"].alias("party"), t["state"].alias("state"), t["type"].alias("type")))), -1)
    n = "name."
    return rows.select(
        F.col("id.bioguide").alias("member"), label_or_parts(F.col(n + "official_full"), F.col(n + "first"), F.col(n + "last")).alias("label"),
        name_variants(F.col(n + "first"), F.col(n + "last"), F.col(n + "middle"), F.col(n + "nickname"), F.col(n + "official_full"), F.col(n + "suffix"), F.col("other_names")).alias("variants"),
        F.coalesce("id.fec", F.array().cast("array<string>")).alias("candidates"), last.alias("term"),
    ).withColumn("party", F.when(F.col("term.party") == "Democrat", "Democratic").otherwise(F.col("term.party")))


SUBMISSIONS = T.StructType([
    T.StructField("cik", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("formerNames", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "from", "to")]))),
    T.StructField("filings", T.StructType([T.StructField("recent", T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("form", "accessionNumber", "filingDate")]))])),
])


def submissions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """cik, name, form, accession, filed: parallel lists zipped to the shortest, listed forms only, the first
    ``limit`` kept ones of each issuer in their order."""
    r = "filings.recent."
    n = F.least(*[F.size(r + c) for c in ("form", "accessionNumber", "filingDate")])
    zipped = F.slice(F.arrays_zip(F.col(r + "form").alias("form"), F.col(r + "accessionNumber").alias("accession"), F.col(r + "filingDate").alias("filed")), F.lit(1), F.greatest(n, F.lit(0)))
    kept = F.filter(zipped, lambda x: x["form"].isin(*FORMS))
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path).select("cik", "name", F.explode(kept).alias("f")).select("cik", "name", "f.*")


def former_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path).select("cik", F.explode("formerNames.name").alias("name"))


AWARD = T.StructType([T.StructField(c, T.StringType()) for c in (
    "Award ID", "Recipient Name", "Awarding Agency", "Awarding Sub Agency", "generated_internal_id", "Total Obligated Amount", "Award Amount", "total_obligation", "obligated_amount",
)])


def awards(spark: SparkSession, path: str) -> DataFrame:
    """award, recipient, agency, sub_agency, obligation: the first amount that reads as a number; else null."""
    amount = F.coalesce(*[F.expr(f"try_cast(`{c}` AS double)") for c in ("Total Obligated Amount", "Award Amount", "total_obligation", "obligated_amount")])
    return spark.read.schema(AWARD).json(path).select(
        F.coalesce("generated_internal_id", "Award ID").alias("award"), F.col("Recipient Name").alias("recipient"), F.col("Awarding Agency").alias("agency"),
        F.col("Awarding Sub Agency").alias("sub_agency"), amount.alias("obligation"),
    )


LOBBYING = "filing_uuid string, client struct<id:string,name:string>, registrant struct<id:string,house_registrant_id:string,name:string>"


def lobbying(spark: SparkSession, path: str, client: str) -> DataFrame:
    """filing, client, registrant of filings whose client name holds a text, whatever its case."""
    rows = spark.read.schema(LOBBYING).json(path).filter(F.upper("client.name").contains(client.upper()))
    return rows.select(F.col("filing_uuid").alias("filing"), F.col("client.name").alias("client"), F.col("registrant.name").alias("registrant"), F.coalesce("registrant.house_registrant_id", "registrant.id").alias("registrant_id"))


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions with parsed vectors; rows without one are dropped, as the paged scan does."""
    rows = spark.read.parquet(path)
    if dict(rows.dtypes).get("tag_embedding") == "string":
        rows = rows.withColumn("tag_embedding", F.from_json("tag_embedding", "array<float>"))
    return rows.filter("tag_embedding IS NOT NULL")


def anchors(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Curated seeds; the last row of a (label, entity_type) replaces those before it."""
    lists = ("committee_ids", "candidate_ids", "recipient_names", "client_names", "name_variants")
    kinds = "label string, entity_type string, priority_domain string, sec_cik bigint, surface_mode string, notes string, " + ", ".join(f"{c} array<string>" for c in lists)
    last = {(r["label"], r["entity_type"]): r for r in rows}
    plain = [tuple(r.get(c) for c in ("label", "entity_type", "priority_domain", "sec_cik")) + (r.get("surface_mode", "open"), r.get("notes")) + tuple(list(r.get(c) or []) for c in lists) for r in last.values()]
    return spark.createDataFrame(plain, kinds)


def new_documents(incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """Files (path, content) not archived yet, by sha256; copies inside one delivery count once."""
    keyed = incoming.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    return keyed.join(archive.select("sha256"), "sha256", "left_anti")


def paged(df: DataFrame, offset: int, limit: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def to_json_lines(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r) for r in rows)
