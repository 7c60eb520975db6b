"""Parties of recipients that have none yet, from committee and candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import party

# The systems whose ids are looked up, and candidates that a committee is followed to.
SYSTEMS, FOLLOWED = ("fec.committee", "fec.disbursement.recipient"), 2
CONFIDENCE = 0.99


def record_kind(fec_id: Column) -> Column:
    """committee or candidate by the id's first letter, else null."""
    first = F.upper(F.substring(fec_id, 1, 1))
    return F.when(first == "C", "committee").when(first.isin("H", "S", "P"), "candidate")


def unclassified(aliases: DataFrame) -> DataFrame:
    """canonical_id, fec_id: entities with an id of SYSTEMS and no party, under the smallest of their ids.

    An id under which another entity has a party already is left out with its entity: two entities of one id
    are for the merge to mend. One row an id, the smallest entity's.
    """
    has = aliases.filter("source_system = 'party'")
    ids = aliases.filter(F.col("source_system").isin(*SYSTEMS) & F.col("source_id").isNotNull())
    open_ = ids.join(has.select("canonical_id"), "canonical_id", "left_anti").groupBy("canonical_id").agg(F.min("source_id").alias("fec_id"))
    free = open_.join(has.select(F.col("source_id").alias("fec_id")), "fec_id", "left_anti")
    return free.groupBy("fec_id").agg(F.min("canonical_id").alias("canonical_id")).select("canonical_id", "fec_id")


def parties(todo: DataFrame, committees: DataFrame, candidates: DataFrame) -> DataFrame:
    """fec_id, party, via of ids whose records tell one: own, or through a committee's candidates.

    ``committees``: fec_id, party, candidate_ids. ``candidates``: fec_id, party. A committee without a party of
    its own is followed to the first FOLLOWED of its candidates, the first that has a party counts. Of several
    records of an id the first party by name counts; codes without a party (see :func:`..functions.text.party`) are none.
    """
    asked = todo.select("fec_id").distinct().withColumn("kind", record_kind(F.col("fec_id"))).filter("kind IS NOT NULL")
    told = lambda df, kind: df.select("fec_id", F.lit(kind).alias("kind"), party(F.col("party")).alias("party")).groupBy("fec_id", "kind").agg(F.min("party").alias("party"))
    own = asked.join(told(committees, "committee").unionByName(told(candidates, "candidate")), ["fec_id", "kind"]).select("fec_id", "kind", "party")
    next_ = committees.join(own.filter("kind = 'committee' AND party IS NULL").select("fec_id"), "fec_id", "left_semi")
    hops = next_.select("fec_id", F.posexplode(F.slice(F.coalesce("candidate_ids", F.array().cast("array<string>")), 1, FOLLOWED)).alias("place", "candidate"))
    known = told(candidates, "candidate").filter("party IS NOT NULL").select(F.col("fec_id").alias("candidate"), F.col("party").alias("theirs"))
    far = hops.join(known, "candidate").groupBy("fec_id").agg(F.min(F.struct("place", "theirs")).alias("x")).select("fec_id", F.col("x.theirs").alias("party"), F.lit("candidate").alias("via"))
    return own.filter("party IS NOT NULL").select("fec_id", "party", F.lit("own").alias("via")).unionByName(far)


def party_aliases(aliases: DataFrame, committees: DataFrame, candidates: DataFrame) -> DataFrame:
    """Party aliases (canonical_id, source_system, source_id, surface_name, confidence) to add; a second run adds none."""
    todo = unclassified(aliases)
    found = todo.join(parties(todo, committees, candidates), "fec_id")
    return found.select("canonical_id", F.lit("party").alias("source_system"), F.col("fec_id").alias("source_id"), F.col("party").alias("surface_name"), F.lit(CONFIDENCE).alias("confidence"))
