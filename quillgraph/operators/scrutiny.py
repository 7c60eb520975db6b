"""Scrutiny: who may be shown, decided fail-closed and recorded row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alias systems that prove a public role; the registrant's in both its spellings.
PUBLIC_SIGNALS = ("fec.committee", "fec.candidate", "bioguide", "senate_lda.registrant", "senate.lda.registrant", "corporate.registry.officer", "corporate.registry.exec")


def verdicts(entities: DataFrame, aliases: DataFrame, classifier: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """canonical_id, classification, decision, signals.

    Only persons are examined; a public signal settles it; otherwise the classifier column, and without an
    answer private and suppress.
    """
    hard = aliases.filter(F.col("source_system").isin(*PUBLIC_SIGNALS)).groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.collect_set("source_system")).alias("signals"))
    rows = entities.join(hard, "id", "left")
    asked = classifier(rows) if classifier else F.lit(None).cast("string")
    label = F.when(F.col("type") != "person", "public").when(F.size("signals") > 0, "public").otherwise(F.coalesce(asked, F.lit("private")))
    decision = F.when(label == "public", "surface").when(label == "unknown", "aggregate").otherwise("suppress")
    return rows.select(F.col("id").alias("canonical_id"), label.alias("classification"), decision.alias("decision"), F.coalesce(F.concat_ws(",", "signals"), F.lit("")).alias("signals"))


def surface_modes(decided: DataFrame, edges: DataFrame, citations: DataFrame) -> DataFrame:
    """canonical_id, surface_mode: public is open, suppress with a cited edge is alias, suppress, else alias."""
    from .edges import incident
    from .gates import cited

    linked = incident(cited(edges, citations).select("source_id", "target_id")).select(F.col("node").alias("canonical_id")).distinct().withColumn("linked", F.lit(True))
    mode = (
        F.when(F.col("classification") == "public", "open").when((F.col("decision") == "suppress") & F.col("linked").isNull(), "suppress").otherwise("alias")
    )
    return decided.join(linked, "canonical_id", "left").select("canonical_id", mode.alias("surface_mode"))


def pending(entities: DataFrame, scrutiny: DataFrame, batch: str | None = None) -> DataFrame:
    todo = entities if batch is None else entities.filter(F.col("batch_id") == batch)
    return todo.join(scrutiny.select(F.col("canonical_id").alias("id")), "id", "left_anti")


def priority(todo: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """The next to examine: neighbourhood of what is shown first, then by key."""
    flag = near.select("id", F.lit(1).alias("near")).distinct()
    return todo.join(flag, "id", "left").orderBy(F.coalesce("near", F.lit(0)).desc(), "k", "id").limit(limit)


def sweep(entities: DataFrame, aliases: DataFrame, log: DataFrame, near: DataFrame | None = None, limit: int | None = None, batch: str | None = None, members: bool = False,
          classifier: Callable[[DataFrame], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions (canonical_id, classification, decision, signals) on persons that a former sweep has not decided on, and
    one row of counts: examined, kept_open, aliased, suppressed.

    ``log``: canonical_id, decided_by; only rows of a sweep (``scrutiny.llm.``) count as decided. A batch, or the
    members (persons with an official id), may be swept alone. With a limit those of ``near`` (id) come first, then the
    oldest (``created_at``, where the entities have it), then the smallest id. Nothing here opens anybody: see
    :func:`surface_modes`.
    """
    done = log.filter(F.col("decided_by").startswith("scrutiny.llm.")).select(F.col("canonical_id").alias("id"))
    todo = entities.filter("type = 'person'").join(done, "id", "left_anti")
    if batch is not None:
        todo = todo.filter(F.col("batch_id") == batch)
    if members:
        todo = todo.join(aliases.filter("source_system = 'bioguide'").select(F.col("canonical_id").alias("id")), "id", "left_semi")
    if limit is not None:
        flag = (todo.select("id").limit(0) if near is None else near.select("id")).distinct().withColumn("_near", F.lit(0))
        created = [F.col("created_at").asc_nulls_last()] if "created_at" in entities.columns else []
        todo = todo.join(flag, "id", "left").orderBy(F.coalesce("_near", F.lit(1)), *created, "id").limit(limit).drop("_near")
    decided = verdicts(todo, aliases, classifier)
    n = lambda d: F.count(F.when(F.col("decision") == d, 1))
    return decided, decided.agg(F.count("*").alias("examined"), n("surface").alias("kept_open"), n("aggregate").alias("aliased"), n("suppress").alias("suppressed"))
