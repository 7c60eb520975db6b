"""LM scoring by a gated recurrent model in numpy.

1. Texts are packed into chunks. Every chunk sends its distinct words with their training counts to
   buckets of the hash; the buckets add up and answer with the corpus counts.
2. The most frequent HEAD words form the model's vocabulary, in classes of equal size by rank; one
   more class holds all other words, which are drawn in it by their smoothed corpus counts.
3. The network is trained by truncated backpropagation on all training documents, each partition on
   its own and then averaged, in a few rounds. Each document belongs to one round: one pass in all.
4. Each document is read whole, in windows with the state carried across, and gets the sum of
   log10 P(class) + log10 P(word | class).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, sliced, text_bytes
from .substring_dedup import _buckets, _by_bucket

HEAD, CLASS_SIZE = 4096, 64
#: Further inputs, by hash, for words beyond the head; one more for the beginning of a document.
TAIL_INPUTS = 256
HIDDEN, EMBED, WINDOW, LANES = 32, 32, 16, 256
#: Each of ROUNDS rounds trains on its own part of the training documents; together they cover all.
ROUNDS, RATE, RATE_LANES, RATE_POWER = 4, 0.1, 16, 0.5
#: Least and most lanes of a training run, and the windows that it should have at least.
TRAIN_LANES, STEPS = (4, 256), 256
#: Where only the longest documents still run, a window has up to so many times WINDOW steps (8 gained less at one of four starting points on sf0.01).
STRETCH = 2
CHUNK_BYTES, BUCKET_ENTRIES = 12 << 20, 1_000_000
MODULUS, HELD_OUT = 7, 2
#: Training texts that a task gathers before it trains on them, about: more than a task's share of a round, so that one run's few
#: long documents are what is left at the end, not those of two.
TRAIN_BYTES = 16 << 20
#: Texts of a training task, about, where there are more than cores to train: wide windows cost less a token than narrow ones.
TASK_BYTES = 56 << 20
END = 0xE0D0E0D0E0D0E0D1
OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OUT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])


def crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


class Chunk:
    """Texts as token hashes: the words of each text, then one END."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        self.ids, self.n = ids, len(texts)
        buf, begins = K.join(texts)
        starts, ends = K.spans(buf)
        doc = K.doc_of(starts, begins)
        words = np.bincount(doc, minlength=self.n)[: self.n] if self.n else np.zeros(0, np.int64)
        self.sizes = words + 1
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)
        self.tokens = np.full(int(self.sizes.sum()), END, K.U)
        self.tokens[np.arange(len(starts)) + doc] = K.word_hashes(buf, starts, ends, lower=True)
        self.doc = np.repeat(np.arange(self.n), self.sizes)
        self.held = np.array([crc(i) % MODULUS == HELD_OUT for i in ids], bool)

    @classmethod
    def unpack(cls, ids: bytes, nulls: bytes, sizes: bytes, blob: bytes) -> Chunk:
        return cls(*unpack(ids, nulls, sizes, blob))


def unpack(ids: bytes, nulls: bytes, sizes: bytes, blob: bytes) -> tuple[list[int | None], list[bytes]]:
    lengths = np.frombuffer(sizes, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(int(lengths.sum()), 1))
    cuts = np.concatenate(([0], np.cumsum(lengths))).tolist()
    numbers = [None if z else i for i, z in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(nulls, bool).tolist(), strict=True)]
    return numbers, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_PARTS = ("ids", "nulls", "sizes", "blob")


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A partition's texts in chunks, which are filled across the borders of Arrow batches."""
    packer = zstandard.ZstdCompressor(level=1)
    ids, texts, held = [], [], 0

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "ids": [np.array([i or 0 for i in ids], np.int64).tobytes()], "nulls": [np.array([i is None for i in ids], bool).tobytes()],
            "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "blob": [packer.compress(b"".join(texts))], "about": [held // 5],
        })

    for batch in sliced(batches, "text", chunk_bytes):
        more = batch.column("text").to_pylist()
        size = sum(map(len, more))
        if texts and held + size > chunk_bytes:
            yield chunk()
            ids, texts, held = [], [], 0
        ids += batch.column("doc_id").to_pylist()
        texts += more
        held += size
    if texts:
        yield chunk()


def _distinct(tokens: np.ndarray) -> np.ndarray:
    """Distinct tokens in order; plain sorting is several times as fast as np.unique here."""
    s = np.sort(tokens)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _send_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, *parts in zip(*(batch.column(n).to_pylist() for n in ("chunk", *_PARTS)), strict=True):
            c = Chunk.unpack(*parts)
            h, known = _distinct(c.tokens), np.sort(c.tokens[~c.held[c.doc]])
            n = (np.searchsorted(known, h, "right") - np.searchsorted(known, h, "left")).astype(np.uint32)
            rows = [(b, chunk, h[i].tobytes() + n[i].tobytes()) for b, i in _by_bucket(h, buckets)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "chunk", "data"), map(list, zip(*rows, strict=True)), strict=True)))


def _add_counts(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """Per bucket: an answer to each chunk (totals in the order it sent), and a row with the bucket's
    own figures: distinct words, tokens, its most frequent words."""
    packer = zstandard.ZstdCompressor(level=1)
    for bucket, chunks, data in _buckets(batches):
        sizes = [len(d) // 12 for d in data]
        h = np.frombuffer(b"".join([d[: 8 * n] for d, n in zip(data, sizes, strict=True)]), K.U)
        n = np.frombuffer(b"".join([d[8 * n :] for d, n in zip(data, sizes, strict=True)]), np.uint32)
        words, back = np.unique(h, return_inverse=True)
        total = np.bincount(back, weights=n, minlength=len(words)).astype(np.uint64)
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        answers = [packer.compress(total[back[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        known = np.flatnonzero(total > 0)
        top = known[np.lexsort((words[known], -total[known].astype(np.int64)))[:head]]
        yield pa.RecordBatch.from_pydict({
            "chunk": [*chunks, -1], "bucket": [bucket] * (len(chunks) + 1), "data": [*answers, words[top].tobytes() + total[top].tobytes()],
            "distinct": [*[0] * len(chunks), len(known)], "total": [*[0] * len(chunks), int(total.sum())],
        })


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d in batch.column("data").to_pylist():
            half = len(d) // 2
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(d[:half], np.int64)), pa.array(np.frombuffer(d[half:], np.int64))], names=["h", "n"])


class Vocabulary:
    """Head words by rank, corpus totals, and the smoothing of everything else."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.counts = counts.astype(np.float64)
        self.order = np.argsort(hashes).astype(np.int32)
        self.sorted = hashes[self.order]
        self.size = len(hashes)
        self.classes = -(-self.size // CLASS_SIZE)
        # words beyond the head: c + 1 each, and one for every word never seen
        self.tail_total = (tokens - self.counts.sum()) + (distinct - self.size) + 1.0

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """Rank of a head word; -1 beyond the head."""
        if not self.size:
            return np.full(len(tokens), -1, np.int32)
        near = np.minimum(np.searchsorted(self.sorted, tokens), self.size - 1)
        return np.where(self.sorted[near] == tokens, self.order[near], np.int32(-1))

    def inputs(self, tokens: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, ids, self.size + (tokens >> K.U(56)).astype(np.int32) % TAIL_INPUTS)

    @property
    def begin(self) -> int:
        return self.size + TAIL_INPUTS


def _inverse_logit(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place: the gates' weights come negated."""
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class Network:
    """Gated recurrent units with a class-factored softmax."""

    NAMES = ("embed", "wx", "wh", "bx", "wc", "bc", "wo", "bo")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def new(cls, v: Vocabulary, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
        padded = np.zeros(v.classes * CLASS_SIZE)
        padded[: v.size] = v.counts
        per = padded.reshape(v.classes, CLASS_SIZE)
        mass = np.append(per.sum(1), max(v.tokens - v.counts.sum(), 1.0))
        with np.errstate(divide="ignore"):
            # words that pad out the last class can never be drawn
            share = per / np.maximum(per.sum(1, keepdims=True), 1e-9)
            bo = np.where(per > 0, np.log(np.maximum(share, 1e-30)), -1e9).astype(np.float32)
        return cls({
            "embed": f(0.1, v.size + TAIL_INPUTS + 1, EMBED), "wx": f(EMBED**-0.5, EMBED, 3 * HIDDEN), "wh": f(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN),
            "bx": np.zeros(3 * HIDDEN, np.float32), "wc": f(0.01, HIDDEN, v.classes + 1), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wo": f(0.01, v.classes, HIDDEN, CLASS_SIZE), "bo": bo.reshape(v.classes, CLASS_SIZE),
        })

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def pack(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(np.float32).tobytes()

    def like(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for n, a in zip(self.NAMES, self.arrays(), strict=True):
            out[n] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        return Network(out)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Both softmax levels' weights with the biases as a last row; states come with a last column of ones."""
        return np.concatenate((self.wc, self.bc[None])), np.concatenate((self.wo, self.bo[:, None]), axis=1)

    def gates(self, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What each input (of ``rows``, or all) adds to both gates (2 x inputs x HIDDEN) and to the candidate, and the state's
        weights for them; those of the gates negated."""
        emb = self.embed if rows is None else self.embed[rows]
        g = emb @ self.wx + self.bx
        two = lambda a: -np.stack((a[:, :HIDDEN], a[:, HIDDEN : 2 * HIDDEN]))
        return two(g), np.ascontiguousarray(g[:, 2 * HIDDEN :]), two(self.wh), np.ascontiguousarray(self.wh[:, 2 * HIDDEN :])


class Lanes:
    """Documents laid end to end in lanes of about equal length; a lane's state is reset at each start."""

    def __init__(self, sizes: np.ndarray, lanes: int):
        import heapq

        order = np.argsort(-sizes, kind="stable")
        lanes = max(1, min(lanes, len(sizes)))
        heap = [(0, k) for k in range(lanes)]
        self.of, self.at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for d in order.tolist():
            used, k = heapq.heappop(heap)
            self.of[d], self.at[d] = k, used
            heapq.heappush(heap, (used + int(sizes[d]), k))
        total = np.zeros(lanes, np.int64)
        for used, k in heap:
            total[k] = used
        # longest lanes first, so that the lanes still running are always a prefix
        rank = np.argsort(np.argsort(-total, kind="stable"), kind="stable")
        self.of = rank[self.of]
        self.total = np.sort(total)[::-1]

    def place(self, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step and lane of every token."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        local = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        return self.at[doc] + local, self.of[doc]


def _layout(sizes: np.ndarray, first: np.ndarray, inputs: np.ndarray, targets: np.ndarray, begin: int, lanes: int):
    """(steps x lanes) arrays: input, target token number (or -1), and whether the state starts anew."""
    plan = Lanes(sizes, lanes)
    step, lane = plan.place(first, sizes)
    shape = (int(plan.total[0]), len(plan.total))
    x, y, new = np.full(shape, begin, np.int32), np.full(shape, -1, np.int64), np.zeros(shape, bool)
    before = np.concatenate(([begin], inputs[:-1]))
    before[first] = begin
    x[step, lane], y[step, lane] = before, targets
    new[step[first], lane[first]] = True
    return x, y, new, plan.total


def log_likelihood(net: Network, v: Vocabulary, sizes: np.ndarray, first: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log P(class) + log P(word | class), natural, of every token; for words beyond the head the class alone."""
    x, y, new, total = _layout(sizes, first, v.inputs(tokens, ids), np.arange(len(tokens)), v.begin, LANES)
    by_gate, by_state, wg, ws = net.gates()
    out = np.zeros(len(tokens))
    lanes = x.shape[1]
    h = np.zeros((lanes, HIDDEN), np.float32)
    # the longest lanes come first, so that those still running are always a prefix
    running, starts = np.searchsorted(-total, -np.arange(len(x)), "left").tolist(), new.any(1).tolist()
    cls = np.where(ids >= 0, ids // CLASS_SIZE, v.classes)
    with np.errstate(over="ignore"):
        held, held_y, count = [], [], 0
        for t in range(len(x)):
            live = running[t]
            h = h[:live]
            if starts[t]:
                h = np.where(new[t, :live, None], np.float32(0), h)
            zr, n, gh = by_gate.take(x[t, :live], axis=1), by_state.take(x[t, :live], axis=0), h @ ws
            zr += h @ wg
            _inverse_logit(zr)
            gh *= zr[1]
            n += gh
            np.tanh(n, out=n)
            h = h - n
            h *= zr[0]
            h += n
            held.append(h)
            held_y.append(y[t, :live])
            count += live
            if count > 16384 or t == len(x) - 1:
                _emit(net, np.concatenate(held), np.concatenate(held_y), cls, ids, v, out)
                held, held_y, count = [], [], 0
    return out


#: Rows of logits that are worked off at a time, so that they stay in the cache.
BLOCK = 1024


def _emit(net, hs, ys, cls, ids, v, out) -> None:
    """log P(class) + log P(word | class) of the targets ``ys`` after the states ``hs``."""
    c = cls[ys]
    order = np.argsort(c.astype(np.int16), kind="stable")
    hs, ys, c = hs[order], ys[order], c[order]
    cuts = np.searchsorted(c, np.arange(v.classes + 1))
    n = int(cuts[-1])
    lp, bias, z = np.empty(len(c)), np.exp(net.bc), np.empty((min(BLOCK, len(c)), v.classes + 1), np.float32)
    for a in range(0, len(c), BLOCK):
        b = min(a + BLOCK, len(c))
        lp[a:b] = _log_share(hs[a:b], net.wc, net.bc, bias, c[a:b], z[: b - a])
    if n:
        word, words = ids[ys[:n]] % CLASS_SIZE, np.exp(net.bo)
        held = np.flatnonzero(np.diff(cuts))
        q = np.empty((int(np.diff(cuts).max()), CLASS_SIZE), np.float32)
        for k in held.tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            lp[a:b] += _log_share(hs[a:b], net.wo[k], net.bo[k], words[k], word[a:b], q[: b - a])
    out[ys] = lp


#: Logits are bounded sums and stay far below this; the bound keeps exp finite whatever the weights.
BOUND = np.float32(80)


def _bound(z: np.ndarray) -> None:
    """Logits that exceed BOUND, if there are any, are cut to it, in place."""
    if z.size and z.max() > BOUND:
        np.minimum(z, BOUND, out=z)


def _log_share(hs, w, b, exp_b, target, z) -> np.ndarray:
    """Logarithm of the target's softmax in each row; ``exp_b`` are the exponentials of the biases ``b``, ``z`` is scratch."""
    np.matmul(hs, w, out=z)
    _bound(z)
    own = z[np.arange(len(z)), target] + b[target]
    np.exp(z, out=z)
    return own - np.log((z @ exp_b).astype(np.float64) + 1e-30)


class Groups:
    """Equal keys of a window. The groups come largest first; ``of`` is each key's group."""

    #: Members from which on a product with ones adds them up.
    LONG = 12

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys.astype(np.int16), kind="stable")
        found = keys[self.order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        count = np.diff(np.append(first, len(keys)))
        largest = np.argsort(-count, kind="stable")
        self.first, self.count, self.keys = first[largest], count[largest], found[first[largest]]
        place = np.empty(len(first), np.int64)
        place[largest] = np.arange(len(first))
        self.of = np.empty(len(keys), np.int64)
        self.of[self.order] = np.repeat(place, count)

    def sums(self, *parts: np.ndarray) -> np.ndarray:
        """The sum of each group's rows of all parts, side by side: long groups by a product with ones, the others a member of each at a time."""
        rows = np.concatenate([p.take(self.order, axis=0) for p in parts], axis=1)
        out, ones = rows[self.first], np.ones(int(self.count[0]), np.float32)
        long, *more = np.searchsorted(-self.count, -np.arange(self.LONG, 0, -1), "left").tolist()
        for i, (a, n) in enumerate(zip(self.first[:long].tolist(), self.count[:long].tolist(), strict=True)):
            np.matmul(ones[:n], rows[a : a + n], out=out[i])
        for j, m in enumerate(reversed(more), 1):
            out[long:m] += rows[self.first[long:m] + j]
        return out


def lanes_for(tokens: int) -> int:
    """Lanes of a training run: as many as leave it STEPS windows, within bounds. Small runs need steps, large ones speed."""
    return int(min(max(tokens // (WINDOW * STEPS), TRAIN_LANES[0]), TRAIN_LANES[1]))


class Trainer:
    """AdaGrad on truncated backpropagation through windows of WINDOW steps."""

    def __init__(self, net: Network, v: Vocabulary):
        self.net, self.v = net, v
        # weights and biases of the softmax levels are one array each here; the network has views of them
        classes, words = net.joined()
        net.wc, net.bc, net.wo, net.bo = classes[:-1], classes[-1], words[:, :-1], words[:, -1]
        self.arrays = {"embed": net.embed, "wx": net.wx, "wh": net.wh, "bx": net.bx, "classes": classes, "words": words}
        self.acc = {n: np.full(a.shape, 1e-4, np.float32) for n, a in self.arrays.items()}
        self.seen = 0

    def fit(self, sizes: np.ndarray, first: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> None:
        v = self.v
        x, y, new, total = _layout(sizes, first, v.inputs(tokens, ids), np.arange(len(tokens)), v.begin, lanes_for(len(tokens)))
        cls = np.where(ids >= 0, ids // CLASS_SIZE, v.classes).astype(np.int32)
        word = (ids % CLASS_SIZE).astype(np.int32)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        # fewer, smoother steps may be longer
        self.rate = np.float32(RATE * (x.shape[1] / RATE_LANES) ** RATE_POWER)
        # the divisor is that of a full window: steps that few lanes still take move the weights little
        scale = np.float32(1.0 / (WINDOW * x.shape[1]))
        t = 0
        while t < len(x):
            live = int(np.searchsorted(-total, -t, "left"))  # lanes that have not ended: the longest come first
            # a window costs as much with few lanes as with many: what they lack in number they get in steps
            now = slice(t, t + WINDOW * min(x.shape[1] // live, STRETCH)), slice(live)
            h = self._window(x[now], y[now], new[now], h[:live], cls, word, scale)
            t = now[0].stop
        self.seen += len(tokens)

    def _window(self, x, y, new, h, cls, word, scale):
        net, H = self.net, HIDDEN
        T, B = x.shape
        # words repeat within a window: what an input adds to the gates is worked out once for each
        groups = Groups(x.ravel())
        place = groups.of
        by_gate, by_state, wg, ws = net.gates(groups.keys)
        zr, ns = by_gate.take(place, axis=1).reshape(2, T, B, H), by_state.take(place, axis=0).reshape(T, B, H)
        prev, hs, ghn = np.empty((T, B, H), np.float32), np.empty((T, B, H), np.float32), np.empty((T, B, H), np.float32)
        g2, g1 = np.empty((2, B, H), np.float32), np.empty((B, H), np.float32)
        starts = new.any(1).tolist()
        with np.errstate(over="ignore"):
            for t in range(T):
                if starts[t]:
                    h = np.where(new[t][:, None], np.float32(0), h)
                prev[t] = h
                gates, n, out = zr[:, t], ns[t], hs[t]
                gates += np.matmul(h, wg, out=g2)
                _inverse_logit(gates)
                n += np.multiply(gates[1], np.matmul(h, ws, out=ghn[t]), out=g1)
                np.tanh(n, out=n)
                np.subtract(h, n, out=out)
                out *= gates[0]
                out += n
                h = out
        flat, ys = hs.reshape(T * B, H), y.ravel()
        use = np.flatnonzero(ys >= 0)
        if not len(use):
            return h
        # targets in order of their class, so that each class is one block of rows
        c = cls[ys[use]]
        order = np.argsort(c.astype(np.int16), kind="stable")
        use, c = use[order], c[order]
        dflat = np.zeros_like(flat)
        hu = np.ones((len(use), H + 1), np.float32)
        hu[:, :H] = flat.take(use, axis=0)
        dflat[use], softmax = self._softmax(hu, c, word[ys[use]], scale)
        dg, dn, dnr = self._backward(dflat.reshape(T, B, H), prev, zr, ns, ghn, new, starts, wg, ws)
        # the slopes of equal inputs are added up first
        slopes, embedded = groups.sums(*dg, dn), net.embed[groups.keys]
        self._move("embed", slopes @ net.wx.T, groups.keys)
        before = prev.reshape(T * B, H).T
        g = {
            "wx": embedded.T @ slopes, "bx": slopes.sum(0), "wh": np.concatenate((*np.matmul(before, dg), before @ dnr), axis=1),
            "classes": softmax,
        }
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        for n, d in g.items():
            self._move(n, d * clip)
        return h

    def _softmax(self, hu, c, w, scale):
        """Gradient by the hidden states of both softmax levels; moves the words' weights, returns the gradient of the classes', the
        bias last. Exponentials stay as they are and the states, which are narrower, are divided by their sums."""
        net, v = self.net, self.v
        wc, wo = self.arrays["classes"], self.arrays["words"]
        dhu, g = np.empty((len(c), HIDDEN), np.float32), np.zeros_like(wc)
        z = np.empty((min(BLOCK, len(c)), wc.shape[1]), np.float32)
        for a in range(0, len(c), BLOCK):
            b = min(a + BLOCK, len(c))
            e = np.matmul(hu[a:b], wc, out=z[: b - a])
            part = self._slopes(e, c[a:b], scale)
            np.matmul(e, net.wc.T, out=dhu[a:b])
            dhu[a:b] *= part
            g += (hu[a:b] * part).T @ e
        cuts = np.searchsorted(c, np.arange(v.classes + 1))
        held = np.flatnonzero(np.diff(cuts))
        if len(held):
            blocks = [(k, int(cuts[k]), int(cuts[k + 1])) for k in held.tolist()]
            at = 0
            while at < len(blocks):
                # as many classes at a time as BLOCK rows hold, one at least
                lo, end = blocks[at][1], at + 1
                while end < len(blocks) and blocks[end][2] - lo <= BLOCK:
                    end += 1
                (last, _, hi), some, start = blocks[end - 1], blocks[at:end], blocks[at][0]
                q, back = np.empty((hi - lo, CLASS_SIZE), np.float32), np.empty((hi - lo, HIDDEN), np.float32)
                for k, a, b in some:
                    np.matmul(hu[a:b], wo[k], out=q[a - lo : b - lo])
                part = self._slopes(q, w[lo:hi], scale)
                rows, moved = hu[lo:hi] * part, np.zeros((last - start + 1, HIDDEN + 1, CLASS_SIZE), np.float32)
                for k, a, b in some:
                    np.matmul(q[a - lo : b - lo], net.wo[k].T, out=back[a - lo : b - lo])
                    np.matmul(rows[a - lo : b - lo].T, q[a - lo : b - lo], out=moved[k - start])
                back *= part
                dhu[lo:hi] += back
                self._move("words", moved, slice(start, last + 1))
                at = end
        return dhu, g

    @staticmethod
    def _slopes(z: np.ndarray, target: np.ndarray, scale) -> np.ndarray:
        """Slopes of the loss by each row's logits ``z``, in place, but for a factor that is returned as a column."""
        _bound(z)
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], np.float32) + np.float32(1e-30)
        z[np.arange(len(z)), target] -= total
        return (scale / total)[:, None]

    def _backward(self, dhs, prev, zr, ns, ghn, new, starts, wg, ws) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients by what the inputs add to both gates and to the candidate, and by what the state adds to it, through the window's
        steps back to front. Each step's arrays stay in the cache; ``zr``, ``ns`` and ``ghn`` are overwritten by the results."""
        T, B, H = dhs.shape
        back_g, back_s, dh = -wg.transpose(0, 2, 1), ws.T, np.zeros((B, H), np.float32)
        g2, g1 = np.empty((2, B, H), np.float32), np.empty((B, H), np.float32)
        one = np.float32(1)
        for t in range(T - 1, -1, -1):
            z, r, n, s = zr[0, t], zr[1, t], ns[t], ghn[t]
            dh += dhs[t]
            through = dh * z
            # by the update gate: dh (prev - n) z (1 - z)
            dz = np.subtract(prev[t], n, out=g1)
            np.multiply(n, n, out=n)
            np.subtract(one, n, out=n)
            np.subtract(one, z, out=z)
            dz *= z
            dz *= through
            # by the candidate: dh (1 - z) (1 - n^2)
            n *= z
            n *= dh
            z[...] = dz
            # by the reset gate: dn ghn r (1 - r); by the state's part of the candidate: dn r
            np.multiply(n, r, out=g1)
            np.subtract(one, r, out=r)
            r *= s
            r *= g1
            s[...] = g1
            dh = through
            np.matmul(zr[:, t], back_g, out=g2)
            dh += g2[0]
            dh += g2[1]
            dh += np.matmul(s, back_s, out=g1)
            if starts[t]:
                dh[new[t]] = 0
        return zr.reshape(2, T * B, H), ns.reshape(T * B, H), ghn.reshape(T * B, H)

    def _move(self, name: str, d: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """AdaGrad step on some rows of an array, or on all of it."""
        a, acc = self.arrays[name], self.acc[name]
        if isinstance(rows, slice):
            a, acc = a[rows], acc[rows]
            step = d * d
            acc += step
            np.sqrt(acc, out=step)
            np.divide(d, step, out=step)
            step *= self.rate
            a -= step
            return
        part = d * d
        part += acc[rows]
        acc[rows] = part
        np.sqrt(part, out=part)
        np.divide(d, part, out=part)
        part *= self.rate
        a[rows] -= part


def _train(batches: Iterator[pa.RecordBatch], net: Network, v: Vocabulary, turn: int, rounds: int = ROUNDS) -> Iterator[pa.RecordBatch]:
    """One model per partition, trained on its share of this round's documents."""
    trainer = Trainer(net.like(np.frombuffer(net.pack(), np.float32)), v)
    part, ids, texts, held = 0, [], [], 0

    def fit() -> None:
        c = Chunk(ids, texts)
        trainer.fit(c.sizes, c.first, c.tokens, v.ids(c.tokens))
        ids.clear()
        texts.clear()

    for batch in batches:
        for chunk, *parts in zip(*(batch.column(n).to_pylist() for n in ("chunk", *_PARTS)), strict=True):
            part = chunk
            for i, t in zip(*unpack(*parts), strict=True):
                k = crc(i)
                if k % MODULUS != HELD_OUT and k // MODULUS % rounds == turn:
                    ids.append(i)
                    texts.append(t)
                    held += len(t)
            # chunks are pooled, so that lanes are of about equal length
            if held > TRAIN_BYTES:
                fit()
                held = 0
    if ids:
        fit()
    if trainer.seen:
        yield pa.RecordBatch.from_pydict({"slot": [(part >> 33) % 16], "weight": [float(trainer.seen)], "model": [trainer.net.pack()]})


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted sum of a partition's models, one at a time."""
    total, weight = None, 0.0
    for batch in batches:
        for w, m in zip(batch.column("weight").to_pylist(), batch.column("model").to_pylist(), strict=True):
            a = np.frombuffer(m, np.float32).astype(np.float64) * w
            total = a if total is None else total + a
            weight += w
    if total is not None:
        yield pa.RecordBatch.from_pydict({"slot": [0], "weight": [weight], "model": [(total / weight).astype(np.float32).tobytes()]})


def train(chunks: DataFrame, v: Vocabulary, tasks: int, rounds: int = ROUNDS) -> Network:
    chunks = chunks.coalesce(tasks)
    net = Network.new(v)
    schema = "slot long, weight double, model binary"
    for turn in range(rounds):
        models = chunks.select("chunk", *_PARTS).mapInArrow(partial(_train, net=net, v=v, turn=turn, rounds=rounds), schema)
        # at most 16 averages reach the driver, whatever the number of partitions
        sums = models.repartition(16, "slot").mapInArrow(_average, schema).collect()
        if not sums:
            return net
        weight = sum(r["weight"] for r in sums)
        net = net.like(sum(np.frombuffer(r["model"], np.float32).astype(np.float64) * (r["weight"] / weight) for r in sums))
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Network, v: Vocabulary) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    now, got = None, []
    for batch in batches:
        for chunk, kind, data, *parts in zip(*(batch.column(n).to_pylist() for n in ("chunk", "kind", "data", *_PARTS)), strict=True):
            if chunk != now:
                now, got = chunk, []
            if kind == 0:
                got.append(unpacker.decompress(data))
                continue
            c = Chunk.unpack(*parts)
            words, back = np.unique(c.tokens, return_inverse=True)
            counts = np.frombuffer(b"".join(got), np.uint64)
            got = []
            ids, known, smooth = v.ids(words)[back], (counts > 0)[back], np.log10(counts + 1.0)[back]
            base = np.add.reduceat(smooth, c.first) - c.sizes * np.log10(v.tokens + v.distinct + 1.0)
            lp = log_likelihood(net, v, c.sizes, c.first, c.tokens, ids) / np.log(10)
            lp += np.where(ids < 0, smooth - np.log10(v.tail_total), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.sizes, pa.int64()),
                    pa.array(np.add.reduceat(known, c.first, dtype=np.int64)), pa.array(np.full(c.n, v.tokens), pa.int64()),
                    pa.array(base), pa.array(np.add.reduceat(lp, c.first)),
                ],
                schema=OUT,
            )


def op4(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Null and empty texts consist of the end token alone. A null doc_id counts as training. Without
    training documents every probability is 1 (scores 0). Repeated rows count and score repeatedly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    packed = rows.mapInArrow(partial(_pack, chunk_bytes=chunk_bytes), "ids binary, nulls binary, sizes binary, blob binary, about long")
    chunks = materialize(packed.withColumn("chunk", F.monotonically_increasing_id()), codec="uncompressed")
    n, words = chunks.agg(F.count("*"), F.coalesce(F.sum("about"), F.lit(0))).first()
    buckets = max(8, int(words / 2 / BUCKET_ENTRIES) + 1)
    parts = max(8, min(n, int(words * 5 / (16 << 20)) + 1))
    sent = chunks.select("chunk", *_PARTS).mapInArrow(partial(_send_counts, buckets=buckets), "bucket long, chunk long, data binary")
    added = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        partial(_add_counts, head=head), "chunk long, bucket long, data binary, distinct long, total long"
    )
    counted = materialize(added, codec="uncompressed")
    figures = counted.filter("chunk = -1")
    tokens, distinct = figures.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tops = figures.select("data").mapInArrow(_tops, "h long, n long").orderBy(F.desc("n"), "h").limit(head).collect()
    v = Vocabulary(np.array([r["h"] for r in tops], np.int64).view(np.uint64), np.array([r["n"] for r in tops], np.int64), tokens, distinct)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    net = train(chunks, v, max(cores, int(words * 5 / TASK_BYTES)))
    none = F.lit(None).cast("binary")
    own = chunks.select("chunk", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), none.alias("data"), *_PARTS)
    answers = counted.filter("chunk >= 0").select("chunk", F.lit(0).alias("kind"), "bucket", "data", *[none.alias(c) for c in _PARTS])
    side = own.unionByName(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return side.mapInArrow(partial(_score, net=net, v=v), OUT_SQL)
