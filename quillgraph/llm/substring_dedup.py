"""Substring deduplication by difference-cover anchors.

Words are removed that lie in a window of WINDOW words whose sequence also starts in a document with
a smaller id. Positions whose index modulo 7 is 0, 1 or 3 form a difference cover: for any two
positions some shift below 7 brings both into it. So two equal windows of 13 words share an anchor,
an equal run of 7 words that begins at a cover position in both, within their first 7 words.

1. Texts are packed into chunks (a few MB each, compressed) and stored.
2. Anchor hashes go to buckets as packed arrays, one copy per hash and chunk, and come back for the
   chunks in which another chunk has them; those that a chunk holds twice itself need no trip.
3. Windows that begin up to 6 words before a shared anchor are hashed whole and sent to buckets the
   same way, one copy per hash and chunk with the smallest id. Answers are a bit per entry.
4. Each chunk marks its covered words and cuts them out.

Hot passages cost one entry per chunk, not one per occurrence, and no window or document pair is
ever enumerated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, sliced, text_bytes

WINDOW, ANCHOR, PERIOD = 13, 7, 7
COVER = (0, 1, 3)
#: Bytes of text in a chunk, one document at least, and packed entries in a bucket, about.
CHUNK_BYTES, BUCKET_ENTRIES = 2 << 20, 1_000_000
_NO_ID = np.iinfo(np.int64).max
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
OUT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Chunk:
    """Texts of a chunk; ids with a null sort last and never count as smaller than another."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.buf, self.begins = K.join(texts)
        self.starts, self.ends = K.spans(self.buf)
        self.doc = K.doc_of(self.starts, self.begins)
        self.hashes = K.word_hashes(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))

    @classmethod
    def unpack(cls, ids: bytes, sizes: bytes, blob: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(int(np.frombuffer(sizes, np.int64).sum()), 1))
        cuts = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64)))).tolist()
        return cls(np.frombuffer(ids, np.int64), [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def inside(self, at: np.ndarray, n: int) -> np.ndarray:
        """Those word positions from which n words of the same text follow."""
        at = at[at + n <= len(self.doc)]
        return at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word position of every anchor."""
        local = np.arange(len(self.doc)) - self.first[self.doc]
        at = self.inside(np.flatnonzero(np.isin(local % PERIOD, COVER)), ANCHOR)
        return K.ngrams(self.hashes, ANCHOR, salt=1)[at], at

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes (columns) and the position of every window whose first PERIOD words hold a shared anchor."""
        flags = np.zeros(len(self.doc) + 1, np.int32)
        np.add.at(flags, np.maximum(anchors - (PERIOD - 1), 0), 1)
        np.add.at(flags, anchors + 1, -1)
        at = self.inside(np.flatnonzero(np.cumsum(flags[:-1]) > 0), WINDOW)
        both = np.stack([K.ngrams(self.hashes, WINDOW, salt=2)[at], K.ngrams(self.hashes, WINDOW, salt=3)[at]], 1) if len(at) else np.zeros((0, 2), K.U)
        return both, at


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches, "text", chunk_bytes):
        ids = np.array([_NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
        texts = batch.column("text").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        words = sum(map(len, texts)) // 4
        yield pa.RecordBatch.from_pydict({
            "ids": [ids.tobytes()], "sizes": [sizes.tobytes()], "blob": [packer.compress(b"".join(texts))], "about": [words],
        })


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the values, and where each distinct one begins in it."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    return order, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the hashes that go to each bucket (hashes are sorted, buckets are ranges of them)."""
    bucket = ((hashes >> K.U(32)) * K.U(buckets) >> K.U(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        yield b, np.arange(cuts[b], cuts[b + 1])


def _send_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct anchor hashes of each chunk, by bucket, in order."""
    for batch in batches:
        for chunk, ids, sizes, blob in zip(*(batch.column(n).to_pylist() for n in ("chunk", "ids", "sizes", "blob")), strict=True):
            h = np.unique(Chunk.unpack(ids, sizes, blob).anchors()[0])
            rows = [(b, chunk, h[i].tobytes()) for b, i in _by_bucket(h, buckets)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "chunk", "data"), map(list, zip(*rows, strict=True)), strict=True)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows of a partition sorted by bucket, a bucket at a time."""
    now, chunks, data = None, [], []
    for batch in batches:
        for b, c, d in zip(*(batch.column(n).to_pylist() for n in ("bucket", "chunk", "data")), strict=True):
            if b != now:
                if data:
                    yield now, chunks, data
                now, chunks, data = b, [], []
            chunks.append(c)
            data.append(d)
    if data:
        yield now, chunks, data


def _bits(chunks: list[int], bucket: int, sizes: list[int], flags: np.ndarray) -> pa.RecordBatch:
    """One answer per chunk: a bit for each entry that it sent to the bucket, in its order."""
    cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    data = [np.uint8(-n % 8).tobytes() + np.packbits(flags[a:b]).tobytes() for n, a, b in zip(sizes, cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"chunk": chunks, "bucket": [bucket] * len(chunks), "data": data})


def _unbits(answers: list[bytes]) -> np.ndarray:
    """The answers of all buckets in order, as flags over everything that the chunk sent."""
    if not answers:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8, offset=1))[: (len(a) - 1) * 8 - a[0]] for a in answers]).astype(bool)


def _match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tells each chunk which of its anchors another chunk has."""
    for bucket, chunks, data in _buckets(batches):
        h = np.frombuffer(b"".join(data), K.U)
        order, first = _groups(h)
        count = np.diff(np.append(first, len(h)))
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(count > 1, count)
        yield _bits(chunks, bucket, [len(d) // 8 for d in data], shared)


#: A window on its way: 96 bits of hash, and the smallest id that has it in the chunk.
_WIN = np.dtype([("h", "<u8"), ("g", "<u4"), ("id", "<i8")])


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list[bytes], list[bytes]]]:
    """Each chunk of a partition sorted by (chunk, kind, bucket), with the answers on its anchors and windows."""
    now, got = None, {}
    for batch in batches:
        columns = ("chunk", "kind", "data", "ids", "sizes", "blob")
        for chunk, kind, data, *parts in zip(*(batch.column(n).to_pylist() for n in columns), strict=True):
            if chunk != now:
                now, got = chunk, {0: [], 1: []}
            if kind < 2:
                got[kind].append(data)
            else:
                yield chunk, Chunk.unpack(*parts), got[0], got[1]


class Candidates:
    """Windows of a chunk that may stand elsewhere too, given the answers on its anchors."""

    def __init__(self, c: Chunk, answers: list[bytes]):
        h, at = c.anchors()
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        # held by another chunk, or twice by this one
        shared = (_unbits(answers) | (count > 1))[back] if len(h) else np.zeros(0, bool)
        both, self.where = c.windows(at[shared])
        self.ids = c.ids[c.doc[self.where]]
        h, g = both[:, 0], (both[:, 1] >> K.U(32)).astype(np.uint32)
        order = np.lexsort((self.ids, g, h))
        sh, sg = h[order], g[order]
        new = np.concatenate(([True], (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1]))) if len(order) else np.zeros(0, bool)
        pick = order[new]
        self.sent = np.zeros(len(pick), _WIN)
        self.sent["h"], self.sent["g"], self.sent["id"] = h[pick], g[pick], self.ids[pick]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def covering(self, smaller: np.ndarray) -> np.ndarray:
        """Positions of windows that also start in a document with a smaller id, of this chunk or another."""
        if not len(self.where):
            return self.where
        return self.where[smaller[self.entry] | (self.sent["id"][self.entry] < self.ids)]


def _send_windows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One entry per distinct candidate window of each chunk, with the smallest id, by bucket."""
    for chunk, c, anchors, _ in _sections(batches):
        sent = Candidates(c, anchors).sent
        rows = [(b, chunk, sent[i].tobytes()) for b, i in _by_bucket(sent["h"], buckets)]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "chunk", "data"), map(list, zip(*rows, strict=True)), strict=True)))


def _match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tells each chunk which of its windows another chunk has under a smaller id."""
    for bucket, chunks, data in _buckets(batches):
        w = np.frombuffer(b"".join(data), _WIN)
        order = np.lexsort((w["id"], w["g"], w["h"]))
        s = w[order]
        new = np.concatenate(([True], (s["h"][1:] != s["h"][:-1]) | (s["g"][1:] != s["g"][:-1])))
        least = np.empty(len(w), np.int64)
        least[order] = s["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
        yield _bits(chunks, bucket, [len(d) // _WIN.itemsize for d in data], least < w["id"])


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for _, c, anchors, windows in _sections(batches):
        hit = Candidates(c, anchors).covering(_unbits(windows))
        edge = np.zeros(len(c.doc) + WINDOW + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        covered = np.cumsum(edge[: len(c.doc)]) > 0
        removed = np.bincount(c.doc[covered], minlength=len(c.texts))
        words = np.bincount(c.doc, minlength=len(c.texts))
        kept = []
        bounds = np.append(c.first, len(c.doc))
        for d, text in enumerate(c.texts):
            ws = text.split()
            if removed[d]:
                a, b = int(bounds[d]), int(bounds[d + 1])
                ws = [w for w, gone in zip(ws, covered[a:b].tolist(), strict=True) if not gone]
            kept.append(b" ".join(ws))
        ids = pa.array([None if i == _NO_ID else i for i in c.ids.tolist()], pa.int64())
        last = pa.array([k.decode("utf-8", "replace") for k in kept]) if texts else pa.array([hashlib.sha256(k).hexdigest() for k in kept])
        yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), last], schema=OUT)


def _beside(body: DataFrame, parts: int, *answers: DataFrame) -> DataFrame:
    """Chunks with the answers addressed to them, side by side in order: one exchange, no join of lists."""
    none = F.lit(None).cast("binary")
    out = body.select("chunk", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("bucket"), none.alias("data"), "ids", "sizes", "blob")
    for kind, a in enumerate(answers):
        out = out.unionByName(a.select("chunk", F.lit(kind).alias("kind"), "bucket", "data", none.alias("ids"), none.alias("sizes"), none.alias("blob")))
    return out.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")


def _run(docs: DataFrame, texts: bool, chunk_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    packed = rows.mapInArrow(partial(_pack, chunk_bytes=chunk_bytes), "ids binary, sizes binary, blob binary, about long")
    chunks = materialize(packed.withColumn("chunk", F.monotonically_increasing_id()), codec="uncompressed")
    n, words = chunks.agg(F.count("*"), F.coalesce(F.sum("about"), F.lit(0))).first()
    buckets = max(8, int(words * len(COVER) / PERIOD / BUCKET_ENTRIES) + 1)
    parts = max(8, min(n, int(words * 4 / (16 << 20)) + 1))
    body = chunks.select("chunk", "ids", "sizes", "blob")
    letter, answer = "bucket long, chunk long, data binary", "chunk long, bucket long, data binary"

    def answered(sent: DataFrame, match) -> DataFrame:
        # a bit an entry: small enough to keep, and used in both passes below
        return materialize(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(match, answer))

    anchors = answered(body.mapInArrow(partial(_send_anchors, buckets=buckets), letter), _match_anchors)
    windows = answered(_beside(body, parts, anchors).mapInArrow(partial(_send_windows, buckets=buckets), letter), _match_windows)
    return _beside(body, parts, anchors, windows).mapInArrow(partial(_cut, texts=texts), OUT_SQL)


def op8(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document.

    Null and empty texts have no words. A null doc_id is greater than every other; rows with the same
    doc_id remove nothing from one another. Repeated rows give repeated rows.
    """
    return _run(docs, texts=False, chunk_bytes=chunk_bytes)


def kept_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same with the kept words, joined by single spaces, in place of their digest (column ``kept``)."""
    return _run(docs, texts=True, chunk_bytes=chunk_bytes).withColumnRenamed("kept_sha256", "kept")
