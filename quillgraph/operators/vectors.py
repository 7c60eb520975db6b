"""Nearest vectors by cosine, exactly: matrix products of chunk pairs, combined by a top-k.

Vectors of a block are dealt to chunks of bounded size, and chunks meet in pairs. A hot block is
many chunk pairs, never one task; every pair sends on k rows a vector at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a chunk, about, and rows of a chunk that are multiplied at a time. A task gets some PAIRS of chunks, which
#: bounds what it holds. In blocks of up to HOT chunks a chunk travels once for every other one; of larger blocks, the
#: LARGEST in number, chunks are dealt to partitions once, and each task fetches two of these (a Cartesian product).
CHUNK, ROWS, PAIRS, HOT, LARGEST = 4096, 512, 8, 4, 16
#: Similarities are rounded to nine digits; those below a bound by more than this stay below it.
SLACK = 1e-8


def _chunks(vectors: DataFrame, block: str, chunk: int) -> DataFrame:
    """block, part, ids, vs: chunks of a block, dealt by a hash of the id."""
    n = vectors.groupBy(block).agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    dealt = vectors.join(n, block).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    # in order of their ids: a task that runs again must make the same rows, as they are dealt by their content
    packed = dealt.groupBy(block, "part").agg(F.sort_array(F.collect_list(F.struct("id", "embedding"))).alias("rows"))
    return packed.select(F.col(block).alias("block"), "part", F.col("rows.id").alias("ids"), F.col("rows.embedding").alias("vs"))


def _unit(vs: pa.Array, n: int) -> np.ndarray:
    """The n vectors of a chunk as rows of length one; those without a length are zero."""
    m = vs.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _near(batches: Iterator[pa.RecordBatch], minimum: float, same: bool) -> Iterator[pa.RecordBatch]:
    """All pairs of two chunks that are near enough; where both are of one table, in both directions."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids_a, ids_b = batch.column("ids")[i].values, batch.column("ids_b")[i].values
            x, y = _unit(batch.column("vs").slice(i, 1), len(ids_a)), _unit(batch.column("vs_b").slice(i, 1), len(ids_b))
            both = same and batch.column("part")[i].as_py() != batch.column("part_b")[i].as_py()
            has_x, has_y = x.any(1), y.any(1)
            for at in range(0, len(x), ROWS):
                s = x[at : at + ROWS] @ y.T
                r, h = np.nonzero(s >= minimum - SLACK)
                s, r = np.round(s[r, h], 9), r + at
                near = (s >= minimum) & has_x[r] & has_y[h]
                a, b, s = ids_a.take(pa.array(r[near])), ids_b.take(pa.array(h[near])), pa.array(s[near])
                if same and not both:
                    other = pc.not_equal(a, b)
                    a, b, s = a.filter(other), b.filter(other), s.filter(other)
                if len(s):
                    yield pa.RecordBatch.from_arrays([a, b, s], names=["a", "b", "similarity"])
                    if both:
                        yield pa.RecordBatch.from_arrays([b, a, s], names=["a", "b", "similarity"])


def _best(batches: Iterator[pa.RecordBatch], k: int, minimum: float, same: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids_a, ids_b = batch.column("ids")[i].as_py(), batch.column("ids_b")[i].as_py()
            xs, y, b = _unit(batch.column("vs").slice(i, 1), len(ids_a)), _unit(batch.column("vs_b").slice(i, 1), len(ids_b)), np.array(ids_b)
            a, out, has_y = np.array(ids_a), [], y.any(1)
            for at in range(0, len(a), ROWS):
                s = xs[at : at + ROWS] @ y.T
                rows = np.flatnonzero((s >= minimum - SLACK).any(1))
                s, x, own = np.round(s[rows], 9), xs[at + rows], a[at + rows]
                if same:
                    s[own[:, None] == b[None, :]] = -2.0
                s[~x.any(1)] = -2.0
                s[:, ~has_y] = -2.0
                edge = np.partition(s, -min(k, len(b)), axis=1)[:, -min(k, len(b))] if len(b) else np.full(len(x), -1.0)
                least = np.maximum(edge, minimum)
                for r in np.flatnonzero((s >= least[:, None]).any(1)).tolist():
                    hit = np.flatnonzero(s[r] >= least[r])
                    hit = hit[np.lexsort((b[hit], -s[r, hit]))[:k]]
                    out += [(ids_a[at + rows[r]], b[h].item(), float(s[r, h])) for h in hit]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            kind, other = (batch.schema.field(c).type.value_type for c in ("ids", "ids_b"))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], other), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])


def _met(left: DataFrame, right: DataFrame, half: bool) -> DataFrame:
    """``right`` with its columns named apart, joined by the caller's ``left``; with ``half`` each two chunks meet once."""
    other = right.select(F.col("block").alias("block_b"), F.col("part").alias("part_b"), F.col("ids").alias("ids_b"), F.col("vs").alias("vs_b"))
    met = left.join(other.hint("shuffle_replicate_nl"), F.col("part") <= F.col("part_b")) if half else left.crossJoin(other.hint("shuffle_replicate_nl"))
    return met.select("part", "part_b", "ids", "vs", "ids_b", "vs_b")


def _dealt(chunks: DataFrame, n: int) -> DataFrame:
    """Chunks of one block, a few to a partition; each alone while there are few."""
    return chunks.repartition(max(1, min(n, 8), math.ceil(n / PAIRS**0.5)))


def _found(vectors: DataFrame, block: str, k: int | None, minimum: float, chunk: int, among: DataFrame | None) -> DataFrame:
    usable = lambda df: df.select("id", "embedding", block).filter("id IS NOT NULL AND embedding IS NOT NULL")
    same, half = among is None, among is None and k is None
    ours, theirs = usable(vectors), usable(vectors if same else among)
    held = lambda df, name: df.groupBy(block).agg(F.ceil(F.count("*") / chunk).alias(name))
    n = held(ours, "x").join(held(theirs, "y"), block)
    hot = n.filter(F.least("x", "y") > HOT).orderBy((-F.col("x") * F.col("y")), block).limit(LARGEST).collect()
    rest = lambda df: df.filter(~F.col(block).isin([r[block] for r in hot])) if hot else df
    left = _chunks(rest(ours), block, chunk)
    right = (left if same else _chunks(rest(theirs), block, chunk)).select("block", F.col("part").alias("part_b"), F.col("ids").alias("ids_b"), F.col("vs").alias("vs_b"))
    n = rest(n).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]
    tasks = max(1, min(n, 64), n // PAIRS)
    pairs = left.join(right, "block")
    pairs = (pairs.filter("part <= part_b") if half else pairs).repartition(tasks, "block", "part", "part_b").select("part", "part_b", "ids", "vs", "ids_b", "vs_b")
    for r in hot:
        own = lambda df: _chunks(df.filter(F.col(block) == F.lit(r[block])), block, chunk)  # noqa: B023, E731
        mine = _dealt(own(ours), r["x"])
        pairs = pairs.unionByName(_met(mine, mine if same else _dealt(own(theirs), r["y"]), half))
    a, b = dict(ours.dtypes)["id"], dict(theirs.dtypes)["id"]
    work = partial(_near, minimum=minimum, same=same) if k is None else partial(_best, k=k, minimum=minimum, same=same)
    return pairs.mapInArrow(work, f"a {a}, b {b}, similarity double")


def within(vectors: DataFrame, block: str, minimum: float, chunk: int = CHUNK) -> DataFrame:
    """a, b, similarity of all ordered pairs of a block that are at least so near; as many rows as there are such pairs."""
    return _found(vectors, block, None, minimum, chunk, None)


def nearest(vectors: DataFrame, block: str, k: int, minimum: float = -1.0, chunk: int = CHUNK, among: DataFrame | None = None) -> DataFrame:
    """a, b, similarity (rounded to nine digits), rank of the k nearest others of every vector within its block.

    ``vectors`` has id, embedding and the block column; so has ``among``, where neighbours are sought if it
    is given. Equal similarities go by b. Vectors without a
    length have no neighbours. A block of n vectors costs (n / chunk)^2 products of bounded size.
    """
    found = _found(vectors, block, k, minimum, chunk, among)
    order = W.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
