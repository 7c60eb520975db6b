"""Privacy, lifecycle and citation gates: wrappers that every public read goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import public_label


def published(df: DataFrame, preview: bool = False) -> DataFrame:
    """Published rows; everything in an authorised preview."""
    return df if preview else df.filter(F.col("publication_state") == "published")


def published_or_null(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("publication_state", F.lit("published")) == "published")


def preview_allowed(token: str | None, header: str | None) -> bool:
    """Only a set token that the header equals opens the preview."""
    return bool(token) and token == header


def projectable(entities: DataFrame) -> DataFrame:
    return entities.filter((F.col("surface_mode") != "suppress") & (F.col("publication_state") != "staged"))


def projected(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge snapshot to project: no staged edge, both ends projectable."""
    v = projectable(entities)
    ids = v.select("id")
    e = edges.filter("publication_state <> 'staged'")
    e = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return v, e


def prune(projected_ids: DataFrame, projectable_ids: DataFrame) -> DataFrame:
    """Ids to delete from a projection: those that the truth no longer allows."""
    return projected_ids.join(projectable_ids, "id", "left_anti")


def cited(edges: DataFrame, citations: DataFrame) -> DataFrame:
    return edges.join(citations.select(F.col("edge_id").alias("id")), "id", "left_semi")


def shown(entities: DataFrame) -> DataFrame:
    """id, type, label of what may be shown; suppressed rows are gone."""
    return entities.filter("surface_mode <> 'suppress'").select("id", "type", label_of().alias("label"))


def label_of() -> Column:
    return public_label(F.col("surface_mode"), F.col("name"), F.lit(None).cast("string"), F.col("id"))


def both_open(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are open; for others no receipts may be shown."""
    ids = entities.filter("surface_mode = 'open'").select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
