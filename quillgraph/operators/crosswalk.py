"""Merges from a curated queue: one plan, for a dry run or to be applied.

The queue's rows (id, from_id, to_id, reason, applied_at) send one entity into another. Rows may chain (a to b, b
to c), so the entity that takes a row's place in the end is found by doubling pointers, and a refused link
ends the chain there: what was sent into its entity stays with that.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SURFACE_MODES, Graph
from ..storage import materialize
from .dedup import merge
from .resolve import by_exact_name


def _strictness(mode: str):
    at = F.array_position(F.array(*map(F.lit, SURFACE_MODES)), F.col(mode)).cast("int")
    return F.coalesce(at, F.lit(1))


def _doubled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each link (node, next, row) leads in the end, and the links that go round (node, row: the largest of
    the round).

    Pointers double until none moves. Those that still move when they span as many links as there are
    walk a round or into one; where they stand then are the rounds' own nodes.
    """
    total = links.count()
    at = materialize(links.select("node", F.col("next").alias("end"), F.col("row").alias("most")))
    span = 1
    while True:
        ahead = at.select(F.col("node").alias("end"), F.col("end").alias("further"), F.col("most").alias("more"))
        step = at.join(ahead, "end", "left")
        if span > total or step.filter("further IS NOT NULL").isEmpty():
            break
        at = materialize(step.select("node", F.coalesce("further", "end").alias("end"), F.greatest("most", "more").alias("most")))
        span *= 2
    lost = step.filter("further IS NOT NULL").select(F.col("end").alias("node")).distinct()
    return at, at.join(lost, "node", "left_semi").select("node", F.col("most").alias("row"))


def plan(queue: DataFrame, entities: DataFrame) -> DataFrame:
    """id, from_id, to_id, verdict, survivor of every pending row (``applied_at`` null).

    missing: an end is no entity (or null). same: both ends are one entity. refused: the entity that would go is
    stricter than the other, by surface mode. duplicate: an earlier row sends the same entity elsewhere.
    cycle: the last row (by id) of those that lead back to their start. apply: all others; ``survivor`` is
    the entity that the row's own ends up in, null for rows that are not applied. Verdicts hang on the row's own two
    ends, not on the order of the queue.
    """
    pending = queue.filter("applied_at IS NULL").select("id", "from_id", "to_id")
    mode = lambda side: entities.select(F.col("id").alias(f"{side}_id"), _strictness("surface_mode").alias(f"{side}_mode"))
    rows = pending.join(mode("from"), "from_id", "left").join(mode("to"), "to_id", "left")
    first = (
        F.when(F.col("from_mode").isNull() | F.col("to_mode").isNull(), "missing").when(F.col("from_id") == F.col("to_id"), "same")
        .when(F.col("from_mode") > F.col("to_mode"), "refused")
    )
    judged = rows.select("id", "from_id", "to_id", first.alias("verdict"))
    again = W.partitionBy("from_id", F.col("verdict").isNull()).orderBy("id")
    judged = judged.withColumn("verdict", F.when(F.col("verdict").isNull() & (F.row_number().over(again) > 1), "duplicate").otherwise(F.col("verdict")))
    judged = materialize(judged)
    links = judged.filter("verdict IS NULL").select(F.col("from_id").alias("node"), F.col("to_id").alias("next"), F.col("id").alias("row"))
    ends, rounds = _doubled(links)
    cut = materialize(rounds.join(links, ["node", "row"]).select("row"))
    if not cut.isEmpty():
        ends, _ = _doubled(materialize(links.join(cut, "row", "left_anti")))
    out = judged.join(cut.select(F.col("row").alias("id"), F.lit("cycle").alias("round")), "id", "left")
    out = out.join(ends.select(F.col("node").alias("from_id"), F.col("end").alias("survivor")), "from_id", "left")
    verdict = F.coalesce("verdict", "round", F.lit("apply"))
    return out.select("id", "from_id", "to_id", verdict.alias("verdict"), F.when(verdict == "apply", F.col("survivor")).alias("survivor"))


def dry_run(planned: DataFrame) -> DataFrame:
    """verdict, rows: what applying the plan would do."""
    return planned.groupBy("verdict").agg(F.count("*").alias("rows"))


def apply(g: Graph, queue: DataFrame, planned: DataFrame, at: str) -> tuple[Graph, DataFrame]:
    """The graph after all applied rows, and the queue with what they froze.

    Edges that meet add their weights, citations, aliases and scrutiny rows move to the survivor
    (:func:`.dedup.merge`). Applied rows keep their own two ends as ``from_id_frozen`` and ``to_id_frozen`` with the
    time ``at``; all others stay pending. A merge that would leave scrutiny rows without an entity raises.
    """
    done = planned.filter("verdict = 'apply'")
    merged = merge(g, done.select(F.col("from_id").alias("id"), "survivor"))
    merged = replace(merged, scrutiny=None if merged.scrutiny is None else materialize(merged.scrutiny))
    if merged.scrutiny is not None:
        lost = merged.scrutiny.join(merged.entities.select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti")
        before = g.scrutiny.join(g.entities.select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti")
        if lost.join(before, "canonical_id", "left_anti").count():
            raise ValueError("scrutiny rows would be left without an entity")
    frozen = done.select("id", F.col("from_id").alias("from_id_frozen"), F.col("to_id").alias("to_id_frozen"), F.to_timestamp(F.lit(at)).alias("now"))
    rest = [c for c in queue.columns if c not in ("from_id_frozen", "to_id_frozen", "applied_at")]
    kept = queue.select(*rest, F.col("applied_at").alias("before")).join(frozen, "id", "left")
    return merged, kept.select(*rest, "from_id_frozen", "to_id_frozen", F.coalesce("before", "now").alias("applied_at"))


def queued(curated: DataFrame, queue: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """from_name, to_name, reason, from_id, to_id, status of curated merges by exact name: queued, skipped_existing (the
    queue has a row for the entity, applied ones by what they froze), or skipped_missing. Of several rows for one
    entity the first by name counts; only ``queued`` rows are to be added."""
    find = lambda c: by_exact_name(curated.select(F.col(c).alias("label")), entities, edges)
    a = find("from_name").select(F.col("label").alias("from_name"), F.col("id").alias("from_id"))
    b = find("to_name").select(F.col("label").alias("to_name"), F.col("id").alias("to_id"))
    frozen = F.col("from_id_frozen") if "from_id_frozen" in queue.columns else F.lit(None).cast("string")
    have = queue.select(F.coalesce(frozen, "from_id").alias("from_id"), F.lit(True).alias("have")).distinct()
    rows = curated.join(a, "from_name", "left").join(b, "to_name", "left").join(have, "from_id", "left")
    missing = F.col("from_id").isNull() | F.col("to_id").isNull() | (F.col("from_id") == F.col("to_id"))
    first = F.row_number().over(W.partitionBy("from_id", missing).orderBy("from_name", "to_name"))
    status = F.when(missing, "skipped_missing").when(F.col("have") | (first > 1), "skipped_existing").otherwise("queued")
    return rows.select("from_name", "to_name", "reason", "from_id", "to_id", status.alias("status"))
