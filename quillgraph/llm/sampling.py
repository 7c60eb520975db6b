"""Bounded, reproducible samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes


def labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int, salt: str) -> DataFrame:
    """At most ``limit`` labelled rows, chosen by a hash of doc_id: doc_id, text (bytes), y (0/1).

    Labels with a null id or value are left out; of several labels of one id the largest counts.
    Only ids are sorted (a top-k per task, then one of ``limit`` rows a task); the chosen ids are
    broadcast, which the limit bounds. Of several rows with one doc_id the smallest text is used, so
    that the limit bounds rows as well.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    clean = clean.filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = clean.orderBy(F.xxhash64(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def plain(docs: DataFrame, limit: int, salt: str, where=None) -> DataFrame:
    """At most ``limit`` documents by a hash of doc_id: doc_id, text (bytes); of one id the smallest text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = ids.filter("doc_id IS NOT NULL") if where is None else ids.filter("doc_id IS NOT NULL").filter(where)
    chosen = ids.dropDuplicates(["doc_id"]).orderBy(F.xxhash64(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
