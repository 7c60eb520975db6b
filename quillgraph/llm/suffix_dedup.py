"""Substring deduplication by suffix sorting.

Bytes are removed that lie in a string of LIMIT bytes which also starts anywhere else. A string's bucket is
the least hash of the GRAM-byte strings in it, so equal strings meet, and neighbouring strings of one bucket
travel as one piece of text.

1. Texts are packed into chunks (a few MB each, compressed) and stored.
2. The distinct bucket hashes of each chunk go out and come back with the news which of them another chunk has.
   Strings whose hash no other place has start nowhere else and are done.
3. Pieces with a shared hash are sent, one copy per text and chunk. Pieces that two chunks have are repeated
   whole; the suffixes of all others are sorted to LIMIT bytes (:mod:`.suffix_sort`). A hash that more than HOT
   chunks have could fill any task: its strings go out as 128-bit digests instead, dealt by digest.
4. Each chunk marks the strings that are repeated, covers them and cuts.

No pair of places or documents is ever enumerated. Letters hold one entry at least, so there are never more
of them than entries, however many chunks and buckets.
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
from .suffix_sort import SuffixSort

LIMIT, GRAM = 200, 64
#: Hashes in a window, windows that are hashed at a time, chunks above which a hash is hot.
SPAN, BLOCK, HOT = LIMIT - GRAM + 1, 1 << 17, 64
#: Bytes of text in a chunk (one document at least), and bytes of all texts for each bucket.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BODY = "ids array<long>, sizes array<long>, blob binary"
LETTER = "bucket long, kind int, chunk long, data binary"
#: What a chunk is told: of its hashes, of its pieces, of its digests.
HASHES, PIECES, DIGESTS = 0, 1, 2
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def least_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of LIMIT bytes the least hash of its GRAM-byte strings, and whether its first one has it."""
    n = max(0, len(buf) - LIMIT + 1)
    least, first = np.empty(n, K.U), np.empty(n, bool)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = buf[a : b + LIMIT - 1]
        p, q = K._powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, K.U)
        np.cumsum((part.astype(K.U) + K.U(1)) * p[: len(part)], out=sums[1:])
        grams = K.mix((sums[GRAM:] - sums[:-GRAM]) * q[: len(part) - GRAM + 1])
        # the least of each window: of the rest of its block and of the start of the next one
        grid = np.full(-(-len(grams) // SPAN) * SPAN, np.iinfo(K.U).max, K.U)
        grid[: len(grams)] = grams
        grid = grid.reshape(-1, SPAN)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least[a:b] = np.minimum(right[: b - a], left[SPAN - 1 : SPAN - 1 + b - a])
        first[a:b] = grams[: b - a] == least[a:b]
    return least, first


def digests(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each string of LIMIT bytes that starts at ``at`` (ascending)."""
    out = np.empty(len(at), _DIGEST)
    for field, base in (("a", 0x9E3779B97F4A7C15), ("b", 0xD1342543DE82EF95)):
        done = 0
        while done < len(at):
            a = int(at[done])
            upto = int(np.searchsorted(at, a + BLOCK))
            part = buf[a : int(at[upto - 1]) + LIMIT].astype(K.U) + K.U(1)
            p = np.full(len(part), base, K.U)
            p[0] = 1
            q = np.full(len(part), pow(base, -1, 1 << 64), K.U)
            q[0] = 1
            p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
            sums = np.concatenate((np.zeros(1, K.U), np.cumsum(part * p)))
            s = at[done:upto] - a
            out[field][done:upto] = K.mix((sums[s + LIMIT] - sums[s]) * q[s])
            done = upto
    return out


class Chunk:
    """Texts of a chunk, and the hashes of all strings of LIMIT bytes in them."""

    def __init__(self, ids: list, sizes: list[int], blob: bytes):
        self.ids, self.data = ids, _unzip(blob)
        self.buf = np.frombuffer(self.data, np.uint8)
        self.begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        least, first = least_hashes(self.buf)
        inside = np.zeros(len(least) + 2, bool)  # strings that end with their document, one off at each end
        for a, b in zip(self.begins[:-1].tolist(), self.begins[1:].tolist(), strict=True):
            inside[a + 1 : max(a, b - LIMIT + 1) + 1] = True
        changed = np.concatenate(([True], least[1:] != least[:-1], [True]))
        apart = np.concatenate(([True], first[:-1] | (least[1:] < least[:-1])))
        here, before, after = inside[1:-1], inside[:-2], inside[2:]
        # strings with one place of the least hash are neighbours; two places are two hashes, for they can be equal
        self.hashes, self.counts = np.unique(K.mix(least[here & (~before | apart[: len(least)])]), return_counts=True)
        self.starts = np.flatnonzero(here & (~before | changed[:-1]))
        self.stops = np.flatnonzero(here & (~after | changed[1:])) + 1
        self.run_hash = K.mix(least[self.starts])

    def told(self, answers: list[bytes]) -> None:
        """Keep the runs of strings that may start elsewhere too: ``pieces``, and the places of ``hot`` ones."""
        said = np.concatenate([np.frombuffer(_unzip(a), np.uint8) for a in answers]) if answers else np.zeros(0, np.uint8)
        said = np.maximum(said, self.counts > 1)
        of_run = said[np.searchsorted(self.hashes, self.run_hash)] if len(self.hashes) else np.zeros(0, np.uint8)
        runs = np.flatnonzero(of_run == 1)
        texts = [self.data[a : b + LIMIT - 1] for a, b in zip(self.starts[runs].tolist(), self.stops[runs].tolist(), strict=True)]
        keyed = list(zip(self.run_hash[runs].tolist(), texts, strict=True))
        self.pieces = sorted(set(keyed))
        place = {piece: i for i, piece in enumerate(self.pieces)}
        self.runs, self.piece_of = runs, np.array([place[x] for x in keyed], np.int64)
        hot = np.flatnonzero(of_run == 2)
        self.hot = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[hot].tolist(), self.stops[hot].tolist(), strict=True)]) if len(hot) else np.zeros(0, np.int64)
        self.sent, self.sent_of, self.sent_counts = np.unique(digests(self.buf, self.hot), return_inverse=True, return_counts=True)

    def repeated(self, pieces: list[bytes], hot: list[bytes]) -> np.ndarray:
        """Places whose strings also start elsewhere, given the answers on pieces and digests."""
        out = np.zeros(len(self.buf), bool)
        n = np.array([len(text) - LIMIT + 1 for _, text in self.pieces], np.int64)
        flags = np.concatenate([np.unpackbits(np.frombuffer(_unzip(a[8:]), np.uint8))[: int.from_bytes(a[:8], "little")] for a in pieces]).astype(bool) if pieces else np.zeros(0, bool)
        cuts = np.concatenate(([0], np.cumsum(n)))
        often = np.bincount(self.piece_of, minlength=len(n)) > 1
        for run, piece in zip(self.runs.tolist(), self.piece_of.tolist(), strict=True):
            a = self.starts[run]
            out[a : a + n[piece]] = True if often[piece] else flags[cuts[piece] : cuts[piece + 1]]
        if len(self.hot):
            said = np.concatenate([np.frombuffer(_unzip(a), np.uint8) for a in hot]).astype(bool)
            out[self.hot] = (said | (self.sent_counts > 1))[self.sent_of.ravel()]
        return out


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", chunk_bytes):
        texts = batch.column("text").to_pylist()
        sizes = [len(t) for t in texts]
        yield pa.RecordBatch.from_pydict({"ids": [batch.column("doc_id").to_pylist()], "sizes": [sizes], "blob": [_zip(b"".join(texts))], "total": [sum(sizes)]},
            schema=pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary()), ("total", pa.int64())]))


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of the ascending hashes that go to one bucket each."""
    if not len(hashes):
        return
    bucket = ((hashes >> K.U(32)) * K.U(buckets) >> K.U(32)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(new, [*new[1:], len(bucket)], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def _letters(rows: list[tuple]) -> pa.RecordBatch:
    buckets, kinds, chunks, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(chunks, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "chunk", "data"])


def _send_hashes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, *body in zip(*(batch.column(n).to_pylist() for n in ("chunk", "ids", "sizes", "blob")), strict=True):
            h = Chunk(*body).hashes
            yield _letters([(b, HASHES, number, h[at].tobytes()) for b, at in _by_bucket(h, buckets)])


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition, a key at a time, each as the columns after the keys."""
    now, rows = None, []
    for batch in batches:
        names = [*keys, *(n for n in batch.schema.names if n not in keys)]
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if row[: len(keys)] != now:
                if rows:
                    yield now, rows
                now, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield now, rows


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket's answer to each letter, entry by entry."""
    for (bucket, kind), rows in _groups(batches, "bucket", "kind"):
        if kind == PIECES:
            said = _match_pieces([d for _, d in rows])
        else:
            kept = [np.frombuffer(d, K.U if kind == HASHES else _DIGEST) for _, d in rows]
            _, back, count = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
            held = count[back.ravel()]  # a chunk sends each once
            flags = ((held > 1).astype(np.uint8) + (held > HOT)) if kind == HASHES else (held > 1).astype(np.uint8)
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in kept])))
            said = [_zip(flags[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield _letters([(bucket, kind, chunk, answer) for (chunk, _), answer in zip(rows, said, strict=True)])


def _open_pieces(letter: bytes) -> list[tuple[int, bytes]]:
    data = _unzip(letter)
    n = int.from_bytes(data[:8], "little")
    hashes, sizes = np.frombuffer(data, K.U, n, 8).tolist(), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    cuts = (8 + 16 * n + np.concatenate(([0], np.cumsum(sizes)))).tolist()
    return [(h, data[a:b]) for h, a, b in zip(hashes, cuts[:-1], cuts[1:], strict=True)]


def _match_pieces(letters: list[bytes]) -> list[bytes]:
    """For each letter a bit per string of its pieces: whether it starts elsewhere too."""
    sent = [_open_pieces(x) for x in letters]
    number: dict[tuple[int, bytes], int] = {}
    count, alike = [], {}
    for piece in (p for pieces in sent for p in pieces):
        at = number.setdefault(piece, len(number))
        if at == len(count):
            count.append(0)
            alike[piece[0]] = alike.get(piece[0], 0) + 1
        count[at] += 1
    # a piece alone with its hash that several chunks have needs no sort, nor does any other one meet it
    chosen = [(at, text) for (h, text), at in number.items() if alike[h] > 1 or count[at] == 1]
    size = np.array([len(text) - LIMIT + 1 for _, text in number], np.int64)
    begins = np.concatenate(([0], np.cumsum(size)))
    flags = np.zeros(int(begins[-1]), bool)
    if chosen:
        lengths = np.array([len(text) for _, text in chosen], np.int64)
        base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        mine = size[[at for at, _ in chosen]]
        at = np.repeat(base, mine) + np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
        hit = np.zeros(int(lengths.sum()), bool)
        hit[SuffixSort(b"".join(text for _, text in chosen), at, LIMIT).repeated()] = True
        for (which, _), a, n in zip(chosen, base.tolist(), mine.tolist(), strict=True):
            flags[begins[which] : begins[which + 1]] = hit[a : a + n]
    for which, n in enumerate(count):
        if n > 1:
            flags[begins[which] : begins[which + 1]] = True
    out = []
    for pieces in sent:
        bits = np.concatenate([flags[begins[i] : begins[i + 1]] for i in map(number.__getitem__, pieces)])
        out.append(len(bits).to_bytes(8, "little") + _zip(np.packbits(bits).tobytes()))
    return out


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, dict[int, list[bytes]]]]:
    """Each chunk of a partition with the answers to it, in the order of its entries."""
    for (number,), rows in _groups(batches, "chunk"):
        said: dict[int, list[bytes]] = {HASHES: [], PIECES: [], DIGESTS: []}
        for kind, _, data, *body in rows:
            if data is not None:
                said[kind].append(data)
            else:
                chunk = Chunk(*body)
        chunk.told(said[HASHES])
        yield number, chunk, said


def _send_strings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for number, chunk, _ in _told(batches):
        rows = []
        hashes = np.array([h for h, _ in chunk.pieces], K.U)
        for b, at in _by_bucket(hashes, buckets):
            texts = [text for _, text in chunk.pieces[at]]
            head = len(texts).to_bytes(8, "little") + hashes[at].tobytes() + np.array([len(t) for t in texts], np.int64).tobytes()
            rows.append((b, PIECES, number, _zip(head + b"".join(texts))))
        rows += [(b, DIGESTS, number, chunk.sent[at].tobytes()) for b, at in _by_bucket(chunk.sent["a"], buckets)]
        yield _letters(rows)


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for _, chunk, said in _told(batches):
        at = np.flatnonzero(chunk.repeated(said[PIECES], said[DIGESTS]))
        edge = np.zeros(len(chunk.buf) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LIMIT, -1)
        covered = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, a, b in zip(chunk.ids, chunk.begins[:-1].tolist(), chunk.begins[1:].tolist(), strict=True):
            gone = covered[a:b]
            removed = int(np.count_nonzero(gone))
            spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1)) if removed else 0
            kept = chunk.buf[a:b][~gone].tobytes() if removed else chunk.data[a:b]
            rows.append((i, b - a, removed, spans, kept.decode("utf-8", "replace") if texts else hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def _beside(body: DataFrame, parts: int, *answers: DataFrame) -> DataFrame:
    """Chunks with the answers addressed to them, in order: one exchange, no join of lists."""
    out = body.select("chunk", F.lit(9).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), "ids", "sizes", "blob")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ids", "array<long>"), ("sizes", "array<long>"), ("blob", "binary"))]
    for a in answers:
        out = out.unionByName(a.select("chunk", "kind", "bucket", "data", *none))
    return out.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")


def _run(docs: DataFrame, texts: bool, chunk_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    packed = rows.mapInArrow(partial(_pack, chunk_bytes=chunk_bytes), f"{BODY}, total long")
    chunks = materialize(packed.withColumn("chunk", F.monotonically_increasing_id()), codec="uncompressed")
    n, total = chunks.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    buckets = max(8, total // BUCKET_BYTES)
    parts = max(8, min(n, total // (8 << 20)))
    body = chunks.select("chunk", "ids", "sizes", "blob")

    def answered(sent: DataFrame) -> DataFrame:
        met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk")
        return materialize(met.mapInArrow(_match, LETTER))

    hashes = answered(body.mapInArrow(partial(_send_hashes, buckets=buckets), LETTER))
    strings = answered(_beside(body, parts, hashes).mapInArrow(partial(_send_strings, buckets=buckets), LETTER))
    return _beside(body, parts, hashes, strings).mapInArrow(partial(_cut, texts=texts), OUT_SQL)


def op11(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes of every document.

    Null and empty texts have no bytes; a null doc_id comes back as null. Repeated rows are texts like any
    others, so each removes the other. An empty table gives an empty one; further columns are not read.
    """
    return _run(docs, texts=False, chunk_bytes=chunk_bytes)


def kept_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same with the remaining bytes as text (column ``kept``) in place of their digest; characters of which
    only some bytes remain become U+FFFD."""
    return _run(docs, texts=True, chunk_bytes=chunk_bytes).withColumnRenamed("kept_sha256", "kept")
