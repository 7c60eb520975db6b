"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node of it.

    By contraction: every node points to its smallest neighbour if that is smaller, pointers are
    followed twice over, links are renamed to what their ends point to, and settled and repeated ones
    go. Each round leaves at most half of the nodes that still have links. Every round is written to
    the shared folder; nothing but one row of the emptiness test reaches the driver. Null endpoints
    link nothing; a node with self-loops only is a component of its own.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    links = materialize(raw.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    names = materialize(raw.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(MAX_ROUNDS):
        if links.limit(1).count() == 0:
            return names
        # u < v in every link, so a node's smallest neighbour matters only where it is the v of a link
        p = links.groupBy("v").agg(F.min("u").alias("p"))
        for _ in range(2):
            up = p.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            p = p.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        p = materialize(p)
        at = lambda c: p.select(F.col("v").alias(c), F.col("p").alias(f"{c}p"))
        moved = links.join(at("u"), "u", "left").join(at("v"), "v").select(F.coalesce("up", "u").alias("u"), F.col("vp").alias("v")).filter("u <> v")
        links = materialize(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        names = materialize(names.join(at("component"), "component", "left").select("node", F.coalesce("componentp", "component").alias("component")))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def extend_components(names: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components after further edges: only the components that these touch are worked on."""
    at = lambda c: names.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    lifted = edges.join(at(src), src, "left").join(at(dst), dst, "left").select(F.coalesce(f"_{src}", src).alias("u"), F.coalesce(f"_{dst}", dst).alias("v"))
    higher = connected_components(lifted, "u", "v")
    known = names.unionByName(higher.select("node", F.col("node").alias("component")).join(names, "node", "left_anti"))
    up = higher.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return known.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
