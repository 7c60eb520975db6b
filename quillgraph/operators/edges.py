"""Edges: incidence, upserts with weight policies, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("source_id", "target_id", "relation")


def incident(edges: DataFrame) -> DataFrame:
    """node, other, edge columns: each edge under both ends, a self-loop once. One scan: what made the edges is not made twice."""
    end = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    out, back = end("source_id", "target_id"), end("target_id", "source_id")
    ends = F.when(F.col("source_id") != F.col("target_id"), F.array(out, back)).otherwise(F.array(out))
    return edges.select(F.inline(ends), *edges.columns)


def counted(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """The ledger (KEY, ref) after a run: every reference that has been counted on an edge, once."""
    seen = new.select(*KEY, "ref").filter("ref IS NOT NULL")
    return (seen if ledger is None else seen.unionByName(ledger.select(*KEY, "ref"))).distinct()


def upsert(old: DataFrame, new: DataFrame, policy: str, ledger: DataFrame | None = None, order: str = "amount") -> DataFrame:
    """A new edge snapshot (KEY, weight) of old edges and new observations (KEY, ref, amount).

    sum: every observation adds. first_sighting: an amount counts once per edge and ref, that of the first
    observation by ``order`` (then the smallest) that has one. count_refs: the number of distinct refs is added. constant:
    weight 1. overwrite: the latest ref's amount. none: no weight at all. A null amount adds nothing.

    ``ledger`` (KEY, ref) holds what former runs have counted (:func:`counted`): first_sighting and count_refs
    pass it over, so running the same observations again changes nothing. An observation without a ref cannot be
    told apart from another: it makes the edge, but counts nothing under these two policies.
    """
    per = new.groupBy(*KEY)
    amount = F.coalesce(F.sum("amount"), F.lit(0.0))
    if policy in ("first_sighting", "count_refs"):
        refs = new.filter("ref IS NOT NULL")
        if ledger is not None:
            refs = refs.join(ledger.select(*KEY, "ref"), [*KEY, "ref"], "left_anti")
        first = F.min(F.when(F.col("amount").isNotNull(), F.struct(F.col(order).alias("o"), F.col("amount").alias("a"))))["a"]
        once = refs.groupBy(*KEY, "ref").agg(first.alias("amount"))
        fresh = once.groupBy(*KEY).agg((amount if policy == "first_sighting" else F.count("*")).cast("double").alias("add"))
        add = per.agg(F.lit(0.0).alias("none")).join(fresh, list(KEY), "left").select(*KEY, F.coalesce("add", "none").alias("add"))
    elif policy == "sum":
        add = per.agg(amount.alias("add"))
    elif policy == "overwrite":
        add = per.agg(F.max_by("amount", F.struct("ref", "amount")).alias("add"))
    elif policy in ("constant", "none"):
        add = per.agg(F.lit(1.0 if policy == "constant" else None).cast("double").alias("add"))
    else:
        raise ValueError(f"unknown weight policy: {policy}")
    joined = old.select(*KEY, "weight").join(add, list(KEY), "full_outer")
    if policy in ("constant", "none", "overwrite"):
        return joined.select(*KEY, F.coalesce("add", "weight").alias("weight"))
    both = F.coalesce("weight", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))
    return joined.select(*KEY, both.alias("weight"))


def merge_metadata(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """JSON object per key, the last write of each field winning, from rows (keys, order, metadata JSON)."""
    fields = rows.select(*keys, order, F.explode(F.from_json("metadata", "map<string,string>")).alias("k", "v"))
    last = fields.groupBy(*keys, "k").agg(F.max_by("v", order).alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("k", "v")))
    return last.groupBy(*keys).agg(F.to_json(F.map_from_entries(packed)).alias("metadata"))


def mention_pairs(mentions: DataFrame, chunk: int = 2048) -> DataFrame:
    """artifact_id, source_id < target_id: every two entities that an artifact mentions, once.

    Rows are dealt by artifact once, and those with one part meet there. A longer artifact's mentions are dealt to parts
    of about ``chunk`` by a hash of the entity, and parts meet in pairs, so an artifact with very many mentions is as
    many joins of bounded size and no task's alone. Null ids are no mentions.
    """
    return _pairs(mentions.select("artifact_id", "canonical_id"), chunk).select("artifact_id", "source_id", "target_id")


def _pairs(mentions: DataFrame, chunk: int, flag: str | None = None) -> DataFrame:
    """The pairs of :func:`mention_pairs`; with ``flag``, a boolean column by entity, those of which one end has it."""
    on = F.col(flag) if flag else F.lit(True)
    m = mentions.filter("artifact_id IS NOT NULL AND canonical_id IS NOT NULL").select("artifact_id", "canonical_id", on.alias("on"))
    m = m.repartition("artifact_id").distinct()
    dealt = m.join(m.groupBy("artifact_id").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")), "artifact_id")
    few, many = dealt.filter("parts = 1"), dealt.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("canonical_id"), F.col("parts")).cast("int"))
    a, b = [["artifact_id", F.col("canonical_id").alias(x), F.col("on").alias(f"on_{x}")] for x in "ab"]
    near = few.select(*a).join(few.select(*b), "artifact_id").filter("a < b")
    low = many.select(*a, F.col("part").alias("pa"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("pb"))
    high = many.select(*b, F.col("part").alias("pb"), F.explode(F.sequence(F.lit(0), "part")).alias("pa"))
    far = low.join(high, ["artifact_id", "pa", "pb"]).filter((F.col("pa") < F.col("pb")) | (F.col("a") < F.col("b")))
    met = near.unionByName(far.select(*near.columns)).filter("on_a OR on_b")
    return met.select("artifact_id", F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"))


def cooccurrence(mentions: DataFrame, minimum: int = 1, chunk: int = 2048) -> DataFrame:
    """source_id < target_id, weight = artifacts shared, at least ``minimum``.

    Pairs are generated inside an artifact only (:func:`mention_pairs`); partial counts are added before the shuffle.
    """
    pairs = mention_pairs(mentions, chunk)
    return pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("weight")).filter(F.col("weight") >= minimum)


def pair_citations(mentions: DataFrame, artifacts: DataFrame, base: str, old: DataFrame | None = None, relation: str = "mentioned_with", minimum: int = 1, chunk: int = 2048) -> DataFrame:
    """edge_id, kind, citation_url, citation_ref of co-occurrence edges: each artifact (artifact_id, kind, slug) that
    mentions both ends, by its permalink, once.

    Artifacts that are not known are cited by their id alone. ``old`` (edge_id, citation_ref): what a former run
    has cited is not cited again, whatever its address was then.
    """
    pairs = mention_pairs(mentions, chunk)
    if minimum > 1:
        pairs = pairs.join(cooccurrence(mentions, minimum, chunk).select("source_id", "target_id"), ["source_id", "target_id"], "left_semi")
    from ..functions.text import permalink

    known = artifacts.groupBy("artifact_id").agg(F.min_by("kind", F.coalesce("kind", F.lit(""))).alias("kind"), F.min("slug").alias("slug"))
    ref = F.col("artifact_id").cast("string")
    url = permalink(base, F.col("slug"), F.coalesce("kind", F.lit("artifact")), ref)
    out = pairs.join(known, "artifact_id", "left").select(
        F.concat_ws("|", F.lit(relation), "source_id", "target_id").alias("edge_id"), F.lit("article_permalink").alias("kind"), url.alias("citation_url"), ref.alias("citation_ref"))
    return out if old is None else out.join(old.select("edge_id", "citation_ref"), ["edge_id", "citation_ref"], "left_anti").select(*out.columns)


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return entities.join(ends, "id", "left_anti")


def isolated_backfill(entities: DataFrame, edges: DataFrame, mentions: DataFrame, types=("event", "concept")) -> DataFrame:
    """Co-occurrence edges with at least one end that has no edge yet."""
    lone = isolated(entities.filter(F.col("type").isin(*types)), edges).select(F.col("id").alias("canonical_id"), F.lit(True).alias("lone")).distinct()
    # the mark travels with the mention: pairs meet no further table
    marked = mentions.join(lone, "canonical_id", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))
    return _pairs(marked, 2048, "lone").groupBy("source_id", "target_id").agg(F.count("*").alias("weight"))


def _around(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """All mentions of the artifacts that mention any of the ids."""
    touched = mentions.join(ids.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").select("artifact_id").distinct()
    return mentions.join(touched, "artifact_id", "left_semi")


def backfill_citations(entities: DataFrame, edges: DataFrame, mentions: DataFrame, artifacts: DataFrame, base: str, types=("event", "concept")) -> DataFrame:
    """Citations of the edges that :func:`isolated_backfill` makes, as :func:`pair_citations` gives them."""
    lone = isolated(entities.filter(F.col("type").isin(*types)), edges).select("id")
    made = isolated_backfill(entities, edges, mentions, types).select(F.concat_ws("|", F.lit("mentioned_with"), "source_id", "target_id").alias("edge_id"))
    return pair_citations(_around(mentions, lone), artifacts, base).join(made, "edge_id", "left_semi")


def backfill_aliases(entities: DataFrame, edges: DataFrame, aliases: DataFrame, mentions: DataFrame, system: str = "mention", types=("event", "concept")) -> DataFrame:
    """canonical_id, source_system, source_id, surface_name: the alias of its mention for every isolated entity that is
    mentioned and has none of the system, under the first artifact by id; the name is the entity's own."""
    lone = isolated(entities.filter(F.col("type").isin(*types)), edges).select("id", "name")
    have = aliases.filter(F.col("source_system") == system).select(F.col("canonical_id").alias("id"))
    first = mentions.groupBy(F.col("canonical_id").alias("id")).agg(F.min("artifact_id").cast("string").alias("source_id"))
    rows = lone.join(have, "id", "left_anti").join(first, "id")
    return rows.select(F.col("id").alias("canonical_id"), F.lit(system).alias("source_system"), "source_id", F.col("name").alias("surface_name"))


def majority_kind(mentions: DataFrame) -> DataFrame:
    """The most frequent kind hint of each entity; of equals the first by name."""
    n = mentions.filter("kind_hint IS NOT NULL").groupBy("canonical_id", "kind_hint").agg(F.count("*").alias("n"))
    best = F.min_by("kind_hint", F.struct((-F.col("n")).alias("n"), F.col("kind_hint")))
    return n.groupBy("canonical_id").agg(best.alias("kind_hint"))


def heal_citations(citations: DataFrame, slugs: DataFrame, base: str) -> DataFrame:
    """Dead artifact URLs rewritten where the artifact's slug (id, slug) is known by now."""
    from ..functions.text import uuid_of

    key = F.coalesce(uuid_of(F.col("citation_url")), F.col("citation_url"))
    known = slugs.filter("slug IS NOT NULL AND slug <> ''").select(F.col("id").alias("_key"), F.col("slug").alias("_slug"))
    healed = citations.withColumn("_key", key).join(known, "_key", "left")
    url = F.coalesce(F.concat(F.lit(base + "/"), "_slug"), "citation_url")
    return healed.withColumn("citation_url", url).select(*citations.columns)


def best_designation(links: DataFrame) -> DataFrame:
    """Committee to member links (committee, member, designation, cycle): committees of one member only,
    the row of best rank and newest cycle, and all cycles. A committee linked to itself is ignored."""
    from ..functions.text import DESIGNATION_RANK, lookup

    rank = lookup(DESIGNATION_RANK, F.col("designation"), F.lit(9))
    rows = links.filter("committee <> member")
    one = rows.groupBy("committee").agg(
        F.countDistinct("member").alias("members"), F.min("member").alias("member"),
        F.min_by("designation", F.struct(rank, -F.col("cycle"), F.col("designation"))).alias("designation"),
        F.array_sort(F.collect_set("cycle")).alias("cycles"),
    )
    return one.filter("members = 1").drop("members")


def ambiguous_committees(links: DataFrame) -> DataFrame:
    return links.groupBy("committee").agg(F.countDistinct("member").alias("members")).filter("members > 1")


def top_per(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes each task to n rows a group before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
