"""Incremental resolving: each mention sees the entities that earlier mentions have made.

Taken one by one, mentions need no more than a lookup each; taken at once, a mention's fate hangs on whether
earlier ones near to it, or of its name, make entities. So they are settled in rounds: a mention is
settled as soon as no undecided earlier one can change its outcome. The earliest undecided mention always is,
and so is at once every one whose name has an entity by then, or whose candidates all share a word with it;
what is left for later rounds are chains of unlike names with like vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_type, normalize_name
from ..storage import materialize
from .resolve import PERSON_MARGIN, THRESHOLD
from .vectors import nearest, within


def _words(name: str):
    return F.filter(F.split(name, " "), lambda w: w != "")


def _need(threshold: float, margin: float):
    return threshold + F.when(F.col("type") == "person", margin).otherwise(0.0)


def _variants(rows: DataFrame, entities: DataFrame, threshold: float, margin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions (id, type, norm, v) by variant, pairs of variants near enough (v, u, sim, shares), and each variant's
    nearest entity (v, known, known_sim, known_shares).

    A variant is one type, normalised name and vector; v is its first mention. Mentions of one variant are
    never paired with one another.
    """
    key = ["type", "norm", "embedding"]
    variants = materialize(rows.groupBy(*key).agg(F.min("id").alias("v")))
    mine = rows.join(variants, key).select("id", "type", "norm", "v")
    vectors = variants.select(F.col("v").alias("id"), "embedding", "type")
    names = variants.select("v", "type", "norm")
    near = within(vectors, "type", threshold).select(F.col("a").alias("v"), F.col("b").alias("u"), F.col("similarity").alias("sim"))
    other = names.select(F.col("v").alias("u"), F.col("norm").alias("other"))
    near = near.join(names, "v").filter(F.col("sim") >= _need(threshold, margin)).join(other, "u")
    near = near.select("v", "u", "sim", F.arrays_overlap(_words("norm"), _words("other")).alias("shares"))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    itself = variants.filter(length > 0).select("v", F.col("v").alias("u"), F.lit(1.0).alias("sim"), (F.col("norm") != "").alias("shares"))
    known = entities.select(F.col("id").alias("known"), normalize_name(F.col("name")).alias("known_norm"))
    best = nearest(vectors, "type", 1, threshold, among=entities.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "type"))
    best = best.select(F.col("a").alias("v"), F.col("b").alias("known"), F.col("similarity").alias("known_sim")).join(names, "v")
    best = best.filter(F.col("known_sim") >= _need(threshold, margin)).join(known, "known")
    fixed = best.select("v", "known", "known_sim", F.coalesce(F.arrays_overlap(_words("norm"), _words("known_norm")), F.lit(False)).alias("known_shares"))
    return materialize(mine), materialize(near.unionByName(itself)), materialize(fixed)


def _settle(open_: DataFrame, made: DataFrame, near: DataFrame, fixed: DataFrame) -> DataFrame:
    """Undecided mentions (id, type, norm, v) with what this round says of them: ``found``, ``makes`` or neither.

    The nearest candidate at a mention's time decides: an entity known before, then one made earlier, by order
    of making. An undecided earlier mention matters if it is at least as near.
    """
    first = open_.groupBy(F.col("v").alias("u")).agg(F.min("id").alias("first"))
    by_variant = made.groupBy(F.col("v").alias("u")).agg(F.min("id").alias("made"))
    group = open_.groupBy("type", "norm").agg(F.min("id").alias("group_first"))
    beside = near.join(first, "u", "left").join(by_variant, "u", "left").filter("first IS NOT NULL OR made IS NOT NULL")
    rows = open_.join(beside.select("v", "sim", "shares", "first", "made"), "v", "left")
    ready, may = F.col("made") < F.col("id"), F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    ready = F.coalesce(ready, F.lit(False))
    seen = rows.groupBy("id", "type", "norm", "v").agg(
        F.min(F.when(ready, F.struct((-F.col("sim")).alias("far"), F.lit(1).alias("later"), "made", "shares"))).alias("own"),
        F.max(F.when(may, F.col("sim"))).alias("may"), F.min(F.when(ready | may, F.col("shares"))).alias("all_share"),
    )
    old = F.when(F.col("known_sim").isNotNull(), F.struct((-F.col("known_sim")).alias("far"), F.lit(0).alias("later"), F.col("own.made").alias("made"), F.col("known_shares").alias("shares")))
    seen = seen.join(fixed, "v", "left").join(group, ["type", "norm"]).withColumn("best", F.least("own", old))
    has, share = F.col("best").isNotNull(), F.coalesce(F.col("best.shares"), F.lit(False))
    every = F.coalesce(F.col("all_share"), F.lit(True)) & F.coalesce(F.col("known_shares"), F.lit(True))
    final = F.col("may").isNull() | (has & (F.col("may") < -F.col("best.far")))
    return seen.select(
        "id", "type", "norm", "v", (has & (every | (final & share))).alias("found"),
        (final & ~share & ((F.col("norm") == "") | (F.col("group_first") == F.col("id")))).alias("makes"),
    )


def makers(mine: DataFrame, near: DataFrame, fixed: DataFrame, named: DataFrame) -> tuple[DataFrame, int]:
    """The mentions (id, type, norm, v) that make an entity, and the rounds that it took to know.

    ``named`` (type, norm): names that have an entity before the first mention.
    """
    made = materialize(mine.filter("norm = ''"))
    open_ = materialize(mine.filter("norm <> ''").join(named, ["type", "norm"], "left_anti"))
    # a mention without a word in its name shares none and has no name to be found by, unless a vector says so
    rounds = 0
    while not open_.isEmpty():
        said = materialize(_settle(open_, made, near, fixed))
        new = said.filter("makes").select("id", "type", "norm", "v")
        made = materialize(made.unionByName(new))
        rest = said.filter("NOT found AND NOT makes").select("id", "type", "norm", "v")
        open_ = materialize(rest.join(new.select("type", "norm"), ["type", "norm"], "left_anti"))
        rounds += 1
    return made, rounds


def resolve_mentions(mentions: DataFrame, entities: DataFrame, threshold: float = THRESHOLD, margin: float = PERSON_MARGIN) -> DataFrame:
    """id, type, entity, how of mentions (id, name, kind, embedding), taken in order of id, among entities
    (id, name, type, embedding) and those that earlier mentions make.

    how: vector (the nearest entity of the type is near enough, persons by more, and shares a word of its
    normalised name), name (an entity of the type has just the normalised name, of several the smallest id), new
    (neither: the mention makes the entity ``new:<id>`` with its name and vector), skipped (no vector). Equal
    similarities go to entities known before (smallest id), then to those made first. A name without a word
    shares none: such a mention always makes an entity. Ids are distinct.
    """
    rows = mentions.select(
        "id", kind_type(F.col("kind")).alias("type"), F.coalesce(normalize_name(F.col("name")), F.lit("")).alias("norm"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    rows = materialize(rows)
    mine, near, fixed = _variants(rows.filter("embedding IS NOT NULL"), entities, threshold, margin)
    by_name = materialize(entities.select("id", "type", normalize_name(F.col("name")).alias("norm")).filter("norm <> ''").groupBy("type", "norm").agg(F.min("id").cast("string").alias("by_name")))
    made, _ = makers(mine, near, fixed, by_name.select("type", "norm"))
    new_id = F.concat(F.lit("new:"), F.col("id").cast("string"))
    by_variant = made.groupBy(F.col("v").alias("u")).agg(F.min("id").alias("made"))
    own = mine.join(near.join(by_variant, "u"), "v").filter("made < id").groupBy("id").agg(
        F.min(F.struct((-F.col("sim")).alias("far"), "made", "shares")).alias("own"))
    of_name = made.filter("norm <> ''").groupBy("type", "norm").agg(F.min("id").alias("maker"))
    out = mine.join(own, "id", "left").join(fixed, "v", "left").join(by_name, ["type", "norm"], "left").join(of_name, ["type", "norm"], "left")
    out = out.join(made.select("id", F.lit(True).alias("makes")), "id", "left")
    old = F.coalesce(F.col("known_sim") >= -F.col("own.far"), F.col("known_sim").isNotNull())
    by_vector = F.when(old & F.col("known_shares"), F.col("known").cast("string")).when(~old & F.col("own.shares"), F.concat(F.lit("new:"), F.col("own.made").cast("string")))
    how = F.when(F.col("makes"), "new").when(by_vector.isNotNull(), "vector").otherwise("name")
    entity = F.when(F.col("makes"), new_id).otherwise(F.coalesce(by_vector, "by_name", F.concat(F.lit("new:"), F.col("maker").cast("string"))))
    skipped = rows.filter("embedding IS NULL").select("id", "type", F.lit(None).cast("string").alias("entity"), F.lit("skipped").alias("how"))
    return out.select("id", "type", entity.alias("entity"), how.alias("how")).unionByName(skipped)
