"""Near-duplicate detection by BagMinHash signatures of word shingles.

A document is the multiset of its five-word shingles; the similarity of two is the weighted Jaccard
(sum of the lesser counts over sum of the greater). Every shingle has a Poisson process over
(weight, time), laid out in dyadic blocks of weight: [0,1), [1,2), [2,4), [4,8) and so on, with
points thinned to the part below the shingle's count. Each point belongs to one of the signature's
registers, which keeps the earliest: two registers agree with probability equal to the similarity.
Bands of registers give candidates, and the multisets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, extend_components
from . import kernels as K
from .common import materialize, numbered, sliced, text_bytes
from .features import Slice

SHINGLE = 5
#: A pair at similarity 0.8 meets in some band with probability 1 - (1 - 0.8**6)**40 > 0.99999.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Similarity is at least NUM / DEN.
NUM, DEN = 4, 5
#: Texts that one copy of a hub's text is compared with, about.
PER_HUB = 500


def shingles(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, sorted by text, then shingle. A text of one to four words is one shingle."""
    h = s.hashes()
    grams = K.ngrams(h, SHINGLE, salt=5)
    at = np.flatnonzero(s.doc[: len(grams)] == s.doc[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    doc, g = s.doc[at], grams[at]
    short = np.flatnonzero((s.words > 0) & (s.words < SHINGLE))
    if len(short):
        own = [K.ngrams(h[s.first[d] : s.first[d + 1]], int(s.words[d]), salt=int(s.words[d]))[0] for d in short]
        doc, g = np.concatenate([doc, short]), np.concatenate([g, np.array(own, K.U)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])))) if len(g) else np.zeros(0, np.int64)
    return doc[new], g[new], np.diff(np.append(new, len(g)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from the upper 53 bits."""
    return ((h >> K.U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers, each the hash of its earliest point; rows of texts without shingles are 0."""
    sig = np.zeros(n * m, K.U)
    total = np.bincount(doc, weights=count, minlength=n)[:n]
    with np.errstate(divide="ignore"):
        limit = np.where(total > 0, (np.log(m) + 5.0) / total, 0.0)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        best = np.full(n * m, np.inf)
        block = 0
        d, g, w = doc[use], shingle[use], count[use]
        while len(d):
            low, size = (0, 1) if block == 0 else (1 << (block - 1), 1 << (block - 1))
            _block(d, g, w, block, low, size, limit, best, sig, m)
            go = w > low + size
            d, g, w, block = d[go], g[go], w[go], block + 1
        # texts with an empty register try again with more time: the points so far come out the same
        open_ = np.isinf(best.reshape(n, m)).any(1) & todo
        limit = np.where(open_, limit * 2, limit)
        todo = open_
    return sig.reshape(n, m)


def _block(d, g, w, block, low, size, limit, best, sig, m) -> None:
    """Points of one dyadic block of weight of all given shingles, up to each text's time limit."""
    h = K.mix(g + K.U(0x9E3779B97F4A7C15 * (block + 1) & 0xFFFFFFFFFFFFFFFF))
    x = np.zeros(len(d))
    cut = (w < low + size) if size > 1 else None
    while len(d):
        h = K.mix(h + K.U(0xD1B54A32D192ED03))
        x = x - np.log(_unit(h)) / (m * size)
        live = x <= limit[d]
        d, h, x, w = d[live], h[live], x[live], w[live]
        pick = K.mix(h ^ K.U(0xA0761D6478BD642F))
        slot = d * m + (pick >> K.U(40)).astype(np.int64) % m
        at, xs, hs = slot, x, h
        if cut is not None:
            cut = cut[live]
            place = low + _unit(K.mix(h ^ K.U(0xE7037ED1A0B428DB))) * size  # in (low, low + size]
            inside = ~cut | (place <= w)
            at, xs, hs = slot[inside], x[inside], h[inside]
        np.minimum.at(best, at, xs)
        first = best[at] == xs
        sig[at[first]] = hs[first]


def band_keys(sig: np.ndarray) -> np.ndarray:
    n = len(sig)
    parts = sig.reshape(n, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * K.U(0x9E3779B97F4A7C15), (n, BANDS)).copy()
    for k in range(ROWS):
        out = K.mix(out * K.U(0xC2B2AE3D27D4EB4F) + parts[:, :, k])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 2 << 20):
        s = Slice(batch.column("text").to_pylist())
        doc, g, count = shingles(s)
        keys = band_keys(signatures(doc, g, count, s.n))
        h = s.hashes()
        local = (np.arange(len(h)) - s.first[s.doc]).astype(np.uint64)
        ends = []
        for salt in (0x8BB84B93962EACC9, 0x4B33A62ED433D4A3):
            mixed = K.mix(h ^ ((local + K.U(1)) * K.U(salt)))
            total = np.zeros(s.n, np.uint64)
            full = np.flatnonzero(s.words > 0)
            if len(full):
                total[full] = np.add.reduceat(mixed, s.first[full])
            ends.append(K.mix(total + s.words.astype(np.uint64)).view(np.int64))
        weight = np.bincount(doc, weights=count, minlength=s.n)[: s.n].astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.where(weight > 0, BANDS, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("doc_id"), pa.array(ends[0]), pa.array(ends[1]), pa.array(weight),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[weight > 0].ravel())),
            ],
            names=["row", "doc_id", "s1", "s2", "n", "bands"],
        )


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose multisets overlap enough, from rows sorted by (hub, salt, kind): the hub's own text
    comes first, then those to hold against it, so one multiset at a time is kept."""
    hub, hub_g, hub_c, hub_n = None, np.zeros(0, K.U), np.zeros(0, np.int64), 0
    for batch in sliced(batches, "text"):
        doc, g, count = shingles(Slice(batch.column("text").to_pylist()))
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
        a, b = [], []
        for i, (h, kind, node) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("hub", "kind", "node")), strict=True)):
            own_g, own_c = g[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]
            if kind == 0:
                hub, hub_g, hub_c, hub_n = h, own_g.copy(), own_c.copy(), int(own_c.sum())
                continue
            if h != hub or not hub_n:
                continue
            at = np.minimum(np.searchsorted(hub_g, own_g), len(hub_g) - 1)
            same = hub_g[at] == own_g
            both = int(np.minimum(hub_c[at[same]], own_c[same]).sum())
            if DEN * both >= NUM * (hub_n + int(own_c.sum()) - both):
                a.append(min(hub, node))
                b.append(max(hub, node))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) at similarity 0.8 and above.

    Pairs are gathered by their first node, the hub, so its text travels once for up to PER_HUB others;
    a hub with more of them is dealt to several tasks, a copy of its text to each.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_HUB).cast("int").alias("salts"))
    dealt = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("node"))
    others = dealt.join(texts, "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "text")
    own = salts.withColumnRenamed("a", "node").join(texts, "node").select(
        F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "text"
    )
    side = own.unionByName(others).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return materialize(side.mapInArrow(_overlap, "a long, b long"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each multiset: every shingle with the number of its occurrence."""
    for batch in sliced(batches, "text", 1 << 20):
        doc, g, count = shingles(Slice(batch.column("text").to_pylist()))
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        e = K.mix(np.repeat(g, count) + nth.astype(np.uint64) * K.U(0x9E3779B97F4A7C15))
        node = batch.column("node").to_numpy()[np.repeat(doc, count)]
        for i in range(0, len(e), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 50_000]), pa.array(e[i : i + 50_000].view(np.int64))], names=["node", "e"])


def _prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of unlike labels that can be similar at all, from (node, n, label).

    Two multisets at similarity 4/5 share one of the n - ceil(4n/5) + 1 rarest elements of each (prefix
    filter, exact). What a text has to itself comes first in that order, so one that differs enough from
    all others has nothing left to share, or too little (position filter, exact too). Of each element, members outside its most frequent label are
    paired with members of other labels; members of one label never meet.
    """
    elements = materialize(texts.join(nodes, "node", "left_semi").mapInArrow(_elements, "node long, e long"))
    rare = elements.groupBy("e").agg(F.count("*").alias("df"))
    ordered = elements.join(rare, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    size = F.size("es")
    first = F.slice("es", F.lit(1), size - F.ceil(size * NUM / DEN).cast("int") + 1)
    prefix = ordered.select("node", F.posexplode(first).alias("p", "x")).filter("x.df > 1").select("node", F.col("x.e").alias("e"), "p")
    held = prefix.join(nodes, "node")
    per = held.groupBy("e", "label").agg(F.count("*").alias("k"))
    most = per.groupBy("e").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1").select("e", F.col("m.label").alias("major"))
    held = materialize(held.join(most, "e"))
    l, r = held.filter("label <> major").alias("l"), held.alias("r")
    # position filter: if this is the first element that the two share, at most this many follow it in both
    most_shared = F.least(F.col("l.n") - F.col("l.p"), F.col("r.n") - F.col("r.p"))
    close = F.lit(NUM + DEN) * most_shared >= F.lit(NUM) * (F.col("l.n") + F.col("r.n"))
    pairs = l.join(r, (F.col("l.e") == F.col("r.e")) & (F.col("l.label") != F.col("r.label")) & close)
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """One row per row of ``rows`` (row, doc_id, text): row, doc_id, class_id, class_size, kept.

    ``rows`` must be a written table whose ``row`` is unique, as :func:`common.numbered` gives. A class
    is a connected component of the pairs at similarity 0.8 and above; class_id is its smallest doc_id
    (null last), and the first row with that id is kept. Texts with equal word sequences are one
    node from the start, so copies never meet as pairs; all null, empty and blank texts are one class.
    A null doc_id is kept only in a class of null ids. An empty table gives an empty one.

    Candidates: every bucket compares its members with one leader, drawn anew per bucket, so that a
    group is linked through many leaders. Documents of buckets whose members are then still in different
    classes are compared through a prefix filter, which loses no pair.
    """
    texts = rows.select("row", text_bytes().alias("text"))
    ids = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    signed = materialize(ids.mapInArrow(_sign, "row long, doc_id long, s1 long, s2 long, n long, bands array<long>"))
    reps = materialize(signed.groupBy("s1", "s2").agg(F.min("row").alias("node")))
    bands = signed.join(reps.select(F.col("node").alias("row")), "row", "left_semi")
    members = bands.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    # a leader is drawn by the least of node xor hash(key): one long, from which the node comes back
    turn = F.xxhash64("key")
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("node").bitwiseXOR(turn)).alias("z")).filter("size > 1")
    met = materialize(members.join(buckets, "key").select("key", "node", F.col("z").bitwiseXOR(turn).alias("lead")))
    # only documents that meet another are read again
    mark = materialize(met.select(F.col("node").alias("row")).distinct())
    sizes = materialize(signed.join(mark, "row", "left_semi").select(F.col("row").alias("node"), "n"))
    texts = materialize(texts.join(mark, "row", "left_semi").withColumnRenamed("row", "node"))

    pairs = met.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    at = lambda c: sizes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    # sizes too far apart rule the similarity out
    fits = F.lit(DEN) * F.least("na", "nb") >= F.lit(NUM) * F.greatest("na", "nb")
    tested = materialize(pairs.join(at("a"), "a").join(at("b"), "b").filter(fits).select("a", "b"))
    labels = connected_components(_links(tested, texts), "a", "b")

    named = met.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    # all that is left: documents of unlike classes that share a bucket
    left = materialize(named.join(mixed, "key", "left_semi").select("node", "label").distinct().join(sizes, "node"))
    more = materialize(_prefix_pairs(left, texts).join(tested, ["a", "b"], "left_anti"))
    labels = extend_components(labels, _links(more, texts), "a", "b")

    node_of = signed.select("row", "doc_id", "s1", "s2").join(reps, ["s1", "s2"])
    placed = materialize(node_of.join(labels, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("class")))
    # least id, then least row with it: plain longs, so both are summed up before they travel
    heads = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    first = (F.col("doc_id") == F.col("class_id")) | (F.col("doc_id").isNull() & F.col("class_id").isNull())
    headed = placed.join(heads, "class")
    head = headed.filter(first).groupBy("class").agg(F.min("row").alias("head"))
    return headed.join(head, "class").select("row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("head")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each class, with all their columns; see :func:`classes`
    for nulls, empty texts, ties and repeated rows."""
    rows, row = numbered(docs)
    plan = classes(rows.select(F.col(row).alias("row"), "doc_id", "text"))
    # texts meet the plan in one way at every size: sorted by row, spilling if need be, nothing broadcast
    dropped = plan.filter("NOT kept").select(F.col("row").alias(row)).hint("merge")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every document. Null, empty and blank texts are one class;
    a null doc_id is greater than every other; of rows with the least id the first is kept; repeated rows
    give repeated rows. Extra columns are not read."""
    rows, row = numbered(docs.select("doc_id", "text"))
    return classes(rows.withColumnRenamed(row, "row")).select("doc_id", "class_id", "class_size", "kept")
