"""Prefix trie of conversations by an external mergesort that knows common prefixes.

1. Each conversation becomes the sequence of its turns' 128-bit hashes; equal sequences become one row.
2. The rows are dealt to ranges of the sequences' order. A range is sorted in runs (an Arrow batch each), whose
   entries carry the number of turns that they share with the entry before; a loser tree merges the runs
   and compares turns only where those numbers are equal, from there on.
3. The merged stream works a stack of open nodes: an entry closes all nodes deeper than what it shares with
   its predecessor, and a closed node is a finished row.
4. Nodes on the first and on the last sequence of a range may go on in its neighbours. They leave as two paths
   with what they hold so far, and the same stack joins the paths of FAN neighbours at a time until one group
   is left. A node's smallest conversation is then sent to the ranges whose finished nodes still wait for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .mixing import n_words

#: Conversations that open with the same other one, and at most so many turns of it.
FAMILY, HEAD = 20, 3
#: Bytes of a turn's hash, bytes of sequences in a range, ranges that are joined at a time, ids in a packed row.
TURN, RANGE_BYTES, FAN, PACK = 16, 8 << 20, 64, 512
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
NODES = [name for name, _ in NODE]
#: Finished nodes (kind 0), those that wait for their parent's conversation (1), and open paths (2).
OUT = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), *NODE,
    ("side", pa.int32()), ("path", pa.binary()), ("words", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())),
    ("open", pa.list_(pa.binary())),
])
OUT_SQL = (
    "kind int, part long, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, side int, path binary, words array<long>, sums array<long>, ends array<string>, open array<binary>"
)
ENDS_SQL = "path binary, words array<long>, n long, least long, ends string"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (hashes of its turns), words (of each turn's text) of every rebuilt conversation.

    The first h original turns of conversation c - c % 20 (never above c, negative ids too), then c's own after its first h; h is the checksum of c
    modulo 4. Turns go by ``turn`` (null first), equal ones by role, then text. Rows without a conv_id
    belong to no conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x"),
    ).filter("c IS NOT NULL")
    order = W.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    key = F.md5(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x").cast("binary"))
    placed = rows.select("c", F.row_number().over(order).alias("p"), key.alias("k"), n_words("x").alias("w"))
    own = placed.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "k", "w"))).alias("own"))
    heads = own.filter(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), F.slice("own", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    joined = own.withColumn("base", F.col("c") - F.pmod("c", F.lit(FAMILY))).withColumn("h", h).join(heads, "base", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    whole = joined.select("c", F.concat(head, rest).alias("all"))
    return whole.select(F.col("c").alias("conv_id"), F.unhex(F.array_join("all.k", "")).alias("path"), F.col("all.w").alias("words"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from its packed ids, which come in order; only the hash under way is held."""
    now = None
    for batch in batches:
        out = []
        for path, words, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "n", "least", "ids")), strict=True):
            if now and path == now[0]:
                now[2] += n
                now[4].update(b"," + ids.encode())
                continue
            if now:
                out.append(now)
            now = [path, words, n, least, hashlib.sha256(ids.encode())]
        yield _packed(out)
    if now:
        yield _packed([now])


def _packed(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([
        pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.int64()),
        pa.array(columns[3], pa.int64()), pa.array([d.hexdigest() for d in columns[4]], pa.string()),
    ], names=["path", "words", "n", "least", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences: path, words, n conversations, the smallest of them, and the digest of their ids.

    Ids meet in packs of neighbouring ids first, so that a sequence of very many conversations is one stream of
    packs and no group of theirs is ever held.
    """
    packs = convs.groupBy("path", F.floor(F.col("conv_id") / PACK).alias("pack")).agg(
        F.array_sort(F.collect_list("conv_id")).alias("ids"), F.first("words").alias("words")
    )
    rows = packs.select("path", "pack", "words", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return rows.repartition("path").sortWithinPartitions("path", "pack").mapInArrow(_digests, ENDS_SQL)


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share, ``known`` of which need no comparison."""
    most = min(len(a), len(b)) // TURN
    while known < most and a[known * TURN : (known + 1) * TURN] == b[known * TURN : (known + 1) * TURN]:
        known += 1
    return known


def run_of(entries: list[tuple]) -> list[tuple[int, tuple]]:
    """A sorted run: each entry (path first) with the turns that it shares with the one before."""
    entries.sort(key=lambda e: e[0])
    return [(common_turns(entries[i - 1][0], e[0]) if i else 0, e) for i, e in enumerate(entries)]


def merged(runs: list[list[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """All entries in order, each with the turns that it shares with the one before, by a loser tree.

    A place in the tree holds a run that lost there and the turns it shares with the winner that passed. A
    contender that shares more with that winner is smaller; only equal numbers need turns compared.
    """
    width = 1 << max(0, len(runs) - 1).bit_length()
    streams = [iter(r) for r in runs]
    heads: list[tuple | None] = [None] * width
    tree = [0] * width
    shared = [0] * width

    def pull(r: int) -> int:
        known, heads[r] = next(streams[r], (0, None)) if r < len(streams) else (0, None)
        return known

    def play(r: int, known: int, place: int) -> tuple[int, int]:
        """Run r, sharing ``known`` turns with the last winner, against the loser that waits at ``place``."""
        other, held = tree[place], shared[place]
        if heads[other] is None or (heads[r] is not None and known > held):
            return r, known
        if heads[r] is None or known < held:
            tree[place], shared[place] = r, known
            return other, held
        a, b = heads[r][0], heads[other][0]
        both = common_turns(a, b, known)
        if a <= b:
            shared[place] = both
            return r, known
        tree[place], shared[place] = r, both
        return other, held

    def build(place: int) -> tuple[int, int]:
        if place >= width:
            return place - width, pull(place - width)
        (left, known), (right, held) = build(2 * place), build(2 * place + 1)
        tree[place], shared[place] = right, held
        return play(left, known, place)

    winner, known = build(1)
    while heads[winner] is not None:
        yield known, heads[winner]
        known, place = pull(winner), (width + winner) // 2
        while place:
            winner, known = play(winner, known, place)
            place //= 2


class OpenPath:
    """The nodes on the way to the last entry. ``final``: no neighbour goes on with any of them."""

    #: What a node has gathered: conversations, the smallest of them, finished children, leaves, saved tokens.
    SUMS = 5

    def __init__(self, part: int, final: bool, named: bool):
        self.part, self.final, self.named = part, final, named
        self.stack: list[dict] = []
        self.first: list[dict] = []
        self.out: list[dict] = []

    def add(self, shared: int, path: bytes, words: list[int], sums: list[list], ends: list[str | None]) -> None:
        """An entry that shares so many turns with the one before; sums and digests per depth, from the root."""
        opening = not self.stack
        while len(self.stack) > shared + 1:
            self._close()
        for depth in range(len(self.stack), len(words) + 1):
            key = path[(depth - 1) * TURN : depth * TURN] if depth else b""
            name = hashlib.md5(self.stack[-1]["name"] + key).digest() if depth else b""
            node = {"name": name, "key": key, "words": words[depth - 1] if depth else 0, "sums": [0, None, 0, 0, 0], "ends": None, "first": opening and not self.final, "rows": []}
            self.stack.append(node)
        if opening:
            self.first = list(self.stack)
        for node, more, digest in zip(self.stack, sums, ends, strict=True):
            self._gather(node["sums"], more)
            node["ends"] = node["ends"] or digest

    @staticmethod
    def _gather(to: list, more: list) -> None:
        to[0] += more[0]
        to[1] = more[1] if to[1] is None else to[1] if more[1] is None else min(to[1], more[1])
        for i in (2, 3, 4):
            to[i] += more[i]

    def _close(self) -> None:
        node = self.stack.pop()
        if node["first"]:  # may have begun in the range before
            self._wait(node)
            return
        convs, least, children, leaves, saved = node["sums"]
        leaves, saved = leaves if children else 1, saved + (convs - 1) * node["words"]
        for row in node["rows"]:
            self.out.append(row | {"kind": 0, "parent_conv_id": least})
        node["rows"] = []
        row = dict(zip(NODES, (least, len(self.stack), None, convs, children, leaves, saved, node["ends"] or NO_ENDS), strict=True))
        row |= {"part": self.part, "node": node["name"] if self.named else None}
        if self.stack:
            above = self.stack[-1]
            above["rows"].append(row)
            self._gather(above["sums"], [convs, least, 1, leaves, saved])
        else:
            self.out.append(row | {"kind": 0})

    def _wait(self, node: dict) -> None:
        self.out += [row | {"kind": 1, "parent": node["name"]} for row in node["rows"]]
        node["rows"] = []

    def end(self) -> None:
        """No more entries: all nodes close, or the open paths leave."""
        if self.final:
            while self.stack:
                self._close()
            return
        for node in self.stack:
            self._wait(node)
        self._leave(0, self.first)
        if not all(node["first"] for node in self.stack):
            self._leave(1, self.stack)

    def _leave(self, side: int, nodes: list[dict]) -> None:
        mine = [n["first"] == (side == 0) for n in nodes]
        self.out.append({
            "kind": 2, "part": self.part, "side": side, "path": b"".join(n["key"] for n in nodes), "words": [n["words"] for n in nodes[1:]],
            "sums": [x for n, m in zip(nodes, mine, strict=True) for x in (n["sums"] if m else [0, None, 0, 0, 0])],
            "ends": [n["ends"] if m else None for n, m in zip(nodes, mine, strict=True)], "open": [n["name"] for n in nodes],
        })

    def batches(self, least: int = 10_000) -> Iterator[pa.RecordBatch]:
        while self.out and len(self.out) >= least:
            part, self.out = self.out[:10_000], self.out[10_000:]
            yield pa.RecordBatch.from_pylist(part, OUT)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and open paths of one range of sequences."""
    names = ("path", "words", "n", "least", "ends")
    runs = [run_of(list(zip(*(b.column(c).to_pylist() for c in names), strict=True))) for b in batches if b.num_rows]
    if not runs:
        return
    trie = OpenPath(TaskContext.get().partitionId(), final=False, named=False)
    for shared, (path, words, n, least, digest) in merged(runs):
        zeros: list[list] = [[0, None, 0, 0, 0]] * len(words)
        trie.add(shared, path, words, [*zeros, [n, least, 0, 0, 0]], [*[None] * len(words), digest])
        yield from trie.batches()
    trie.end()
    yield from trie.batches(1)


def _join(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
    """Nodes and open paths of groups of neighbouring ranges, whose own paths come in order."""
    trie, before = None, b""
    for batch in batches:
        for part, path, words, sums, ends in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "words", "sums", "ends")), strict=True):
            if trie is None or trie.part != part:
                if trie:
                    trie.end()
                    yield from trie.batches(1)
                trie, before = OpenPath(part, final, named=True), path
            step = OpenPath.SUMS
            trie.add(common_turns(before, path), path, words, [sums[i : i + step] for i in range(0, len(sums), step)], ends)
            before = path
            yield from trie.batches()
    if trie:
        trie.end()
        yield from trie.batches(1)


def _written(levels: Iterable[DataFrame]) -> DataFrame:
    out = None
    for i, level in enumerate(levels):
        level = level.withColumn("level", F.lit(i))
        out = level if out is None else out.unionByName(level)
    return out


def trie(turns: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A null role or text counts as empty, a null turn comes first, equal turns go by role and text,
    repeated rows are repeated turns; rows with a null conv_id belong to no conversation. An empty table
    has no nodes, further columns are not read. Turns are told apart by 128-bit hashes of role and text; those
    of one conversation are held together in a task, 16 bytes a turn.
    """
    found = materialize(sequences(rebuilt(turns)))
    size = found.agg(F.coalesce(F.sum(F.length("path") + 100), F.lit(0))).first()[0]
    levels = [materialize(found.repartitionByRange(max(1, -(-size // range_bytes)), "path").mapInArrow(_range, OUT_SQL))]
    while True:
        paths = levels[-1].filter("kind = 2")
        groups = (paths.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]) // fan + 1
        dealt = paths.withColumn("range", F.col("part")).withColumn("part", F.floor(F.col("part") / fan)).repartition(groups, "part")
        levels.append(materialize(dealt.sortWithinPartitions("part", "range", "side").mapInArrow(partial(_join, final=groups == 1), OUT_SQL)))
        if groups == 1:
            break
    rows = _written(levels)
    done = rows.filter("kind = 0")
    # who has a node open, and which conversation it turned out to have: a key has the children of one range at most
    least = done.filter("node IS NOT NULL").select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    least = least.unionByName(rows.filter("kind = 1 AND node IS NOT NULL").select(F.col("node").alias("parent"), F.col("conv_id").alias("found")))
    holders = rows.filter("kind = 2").select("level", "part", F.explode("open").alias("parent")).distinct()
    waiting = rows.filter("kind = 1").join(holders.join(least, "parent"), ["level", "part", "parent"])
    return done.select(*NODES).unionByName(waiting.withColumn("parent_conv_id", F.col("found")).select(*NODES))


def op12(turns: DataFrame) -> DataFrame:
    """The digest rows are the operator's own; see :func:`trie`."""
    return trie(turns)


ORACLE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, p, md5(length(r)::VARCHAR || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
s AS (SELECT c, max(p) AS n, c::VARCHAR AS s FROM k GROUP BY c),
h AS (SELECT c, n, xor(list_reduce([4294967295] || range(8 * length(s)), lambda a, i: xor((CASE WHEN i % 8 = 0 THEN xor(a, ord(substr(s, (i // 8 + 1)::INT, 1))) ELSE a END) >> 1,
    3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(a, ord(substr(s, (i // 8 + 1)::INT, 1))) ELSE a END) & 1))), 4294967295) % 4 AS h FROM s),
m AS (SELECT h.c, k.p, k.k, k.w FROM h JOIN k ON k.c = h.c - (h.c % 20 + 20) % 20 AND k.p <= h.h
    UNION ALL SELECT h.c, k.p - h.h + least(h.h, coalesce(b.n, 0)), k.k, k.w FROM h JOIN k ON k.c = h.c AND k.p > h.h LEFT JOIN h b ON b.c = h.c - (h.c % 20 + 20) % 20),
q AS (SELECT h.c, coalesce(string_agg(m.k, '' ORDER BY m.p), '') AS path, count(m.p) AS n FROM h LEFT JOIN m ON m.c = h.c GROUP BY h.c),
e AS (SELECT c, n, unnest(range(n + 1)) AS d, path FROM q),
v AS (SELECT left(path, (32 * d)::INT) AS node, d, min(c) AS c, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM e GROUP BY 1, 2),
wd AS (SELECT k, min(w) AS w FROM k GROUP BY k),
f AS (SELECT v.*, CASE WHEN d > 0 THEN left(node, (32 * d - 32)::INT) END AS parent, coalesce(wd.w, 0) * (n_convs - 1) AS saved FROM v LEFT JOIN wd ON d > 0 AND wd.k = right(node, 32)),
g AS (SELECT parent, count(*) AS n FROM f WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT f.saved, (g.n IS NULL)::INT AS leaf, left(f.node, (32 * a.i)::INT) AS above FROM (SELECT *, unnest(range(d + 1)) AS i FROM f) a JOIN f ON f.node = a.node LEFT JOIN g ON g.parent = f.node),
z AS (SELECT above, sum(saved) AS saved, sum(leaf) AS leaves FROM u GROUP BY above)
SELECT f.c::BIGINT AS conv_id, f.d::BIGINT AS depth, o.c::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs, coalesce(g.n, 0)::BIGINT AS n_children, z.leaves::BIGINT AS n_leaves,
    z.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f LEFT JOIN f o ON o.node = f.parent LEFT JOIN g ON g.parent = f.node JOIN z ON z.above = f.node
"""
