"""Secret scans: fixed patterns plus a character convolutional network over further candidates.

The patterns' findings always stay. All other long runs of key characters are candidates; a network sees
each whole candidate with its surroundings and adds those above a calibrated threshold, set so that
a required share of labelled findings is recalled. It scores the patterns' findings too, for whoever
reviews them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced, text_bytes
from .quality_gam import platt

_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
#: Greedy runs, so asking for the least length at once gives the same findings as dropping short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "model")

#: Windows and characters that a local model trains on, about; models are averaged after each of ROUNDS passes over all
#: windows, fewer where more than a million would be read in all.
FIT_ROWS, FIT_CHARS, ROUNDS, FIT_READ = 4_000, 8 << 20, (4, 10), 1_000_000
#: Share of labelled findings that the threshold must recall. It is set at half the misses that this allows, so
#: that rows which set nothing meet it as well.
RECALL = 0.95
CONTEXT, WIDTH, FILTERS, SEGMENT = 24, 5, 24, 4096
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_model", pa.int64()), ("n_candidates", pa.int64()), ("scores", pa.string()),
])


def _found(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns' findings, in order of start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' findings, in order of start, then kind."""
    return [f[:3] for f in _found(text)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of 16 and more key characters, whatever they hold, that no base finding touches.

    Both lists go by start, so one walk suffices: of the base findings that begin before a run ends,
    the furthest end tells whether any of them touches it.
    """
    out, i, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= start:
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def _codes(s: str, shift: int) -> np.ndarray:
    raw = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return np.where(raw < 127, raw, 127).astype(np.int32) + shift


@dataclass
class Network:
    """Convolution by table look-up, maximum over the whole window, one dense output."""

    table: np.ndarray  # WIDTH x 256 x FILTERS; codes from 128 on are context
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    #: Windows that it was trained, calibrated and tried on.
    seen: int = 0

    @classmethod
    def new(cls, rng) -> Network:
        return cls(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)

    def pack(self) -> bytes:
        return np.concatenate([self.table.ravel(), self.bias, self.out, [np.float32(self.offset)]]).astype(np.float32).tobytes()

    def like(self, flat: np.ndarray) -> Network:
        flat, n = np.array(flat, np.float32), self.table.size
        return Network(flat[:n].reshape(self.table.shape).copy(), flat[n : n + FILTERS].copy(), flat[n + FILTERS : n + 2 * FILTERS].copy(), float(flat[-1]))

    def maps(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - WIDTH + 1
        z = self.table[0][codes[:n]]
        for k in range(1, WIDTH):
            z = z + self.table[k][codes[k : k + n]]
        return np.maximum(z + self.bias, 0)

    def pool(self, item: np.ndarray) -> np.ndarray:
        """Maximum over a window of any length, a segment at a time."""
        best = np.zeros(FILTERS, np.float32)
        for a in range(0, len(item) - WIDTH + 1, SEGMENT):
            best = np.maximum(best, self.maps(item[a : a + SEGMENT + WIDTH - 1]).max(0))
        return best

    def probability(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        a, b = self.scale
        z = np.array([float(self.pool(encode(w)) @ self.out) for w in windows]) + self.offset
        return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))


def encode(w: tuple[str, str, str]) -> np.ndarray:
    pad = np.zeros(WIDTH - 1, np.int32)
    return np.concatenate([_codes(w[0], 128), _codes(w[1], 0), _codes(w[2], 128), pad])


def generated(n: int = 1500, seed: int = 7) -> tuple[list[tuple[str, str, str]], list[int]]:
    """Labelled findings of known kinds: keys of common shapes, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = lower + lower.upper() + digits
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    syllables = ["the", "and", "ing", "er", "tion", "re", "con", "sta", "ver", "item", "file", "page", "data", "mail", "host", "lib"]
    word = lambda: "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 4)))
    prose = lambda: " ".join(word() for _ in range(6))
    windows, labels = [], []
    for _ in range(n):
        k = int(rng.integers(20, 60))
        kind = rng.integers(0, 7)
        secret = [
            lambda: draw("0123456789abcdef", k + 4),
            lambda: draw(alnum + "+/", k) + "=" * int(rng.integers(0, 3)),
            lambda: "ghp_" + draw(alnum, 36),
            lambda: "sk_live_" + draw(alnum, 24),
            lambda: "eyJ" + draw(alnum + "-_", k),
            lambda: "AKIA" + draw(lower.upper() + digits, 16),
            lambda: draw([lower, lower.upper(), lower + lower.upper()][rng.integers(0, 3)], k),
        ][kind]()
        lead = ["key: ", 'auth = "', "Bearer ", prose() + " ", "credential=", "\n"][rng.integers(0, 6)]
        windows.append(((prose() + " " + lead)[-CONTEXT:], secret, (['" ', " ", "\n", ", "][rng.integers(0, 4)] + prose())[:CONTEXT]))
        labels.append(1)
        kind = rng.integers(0, 9)
        plain_run = [
            lambda: f"{word()}-{word()}-{word()}-{draw(digits, 2)}",
            lambda: f"{word()}_{word()}_{draw(digits, int(rng.integers(4, 17)))}",
            lambda: f"20{draw(digits, 2)}-0{draw('123456789', 1)}-1{draw(digits, 1)}T{draw('012', 1)}{draw(digits, 1)}",
            lambda: f"/{word()}/{word()}/{word()}{draw(digits, 1)}/{word()}",
            lambda: word().title() + word().title() + word().title() + draw(digits, 2) + word().title(),
            lambda: word() * 4 + draw(digits, 1),
            lambda: "=" * 8 + word() + draw(digits, 2) + "-" * 10,
            lambda: "".join(word() for _ in range(5)),
            lambda: draw(digits, int(rng.integers(16, 24))),
        ][kind]()
        windows.append(((prose() + " ")[-CONTEXT:], plain_run, (" " + prose())[:CONTEXT]))
        labels.append(0)
    return windows, labels


def _descend(net: Network, items: list[np.ndarray], y: np.ndarray, w: np.ndarray, use: np.ndarray, rng, epochs: int, batch: int) -> None:
    """Adam on minibatches of the rows ``use``, weighted by ``w``; moves the network."""
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("table", "bias", "out")}
    t = 0
    for _ in range(epochs):
        rng.shuffle(use)
        for a in range(0, len(use), batch):
            rows = use[a : a + batch]
            pools, arg = np.zeros((len(rows), FILTERS), np.float32), np.zeros((len(rows), FILTERS), np.int64)
            for r, i in enumerate(rows):
                z = net.maps(items[i])
                arg[r] = z.argmax(0)
                pools[r] = z[arg[r], np.arange(FILTERS)]
            p = 1 / (1 + np.exp(-(pools @ net.out + net.offset)))
            d = (p - y[rows]) * w[rows] / len(rows)
            grads = {"out": pools.T @ d, "table": np.zeros_like(net.table), "bias": np.zeros(FILTERS, np.float32)}
            up = (d[:, None] * net.out[None, :]) * (pools > 0)
            grads["bias"] = up.sum(0)
            for k in range(WIDTH):
                code = np.stack([items[i][arg[r] + k] for r, i in enumerate(rows)])
                np.add.at(grads["table"][k], (code, np.broadcast_to(np.arange(FILTERS), code.shape)), up)
            t += 1
            for name, g in grads.items():
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, name)[...] -= (0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            net.offset -= 0.01 * float(d.sum())


def fit(windows: list[tuple[str, str, str]], labels: list[int], seed: int = 11, epochs: int = 10, batch: int = 128) -> Network:
    """Adam on minibatches; of every eight rows five train, two calibrate and set the threshold, one does neither.

    The threshold is 0.5 or, where that would miss more than half of what RECALL allows among the held-out
    secrets, the highest value that does not. Values too short for a candidate, which only the fixed
    patterns find and keep, do not set it.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    items = [encode(w) for w in windows]
    net = Network.new(rng)
    turn = np.arange(len(y)) % 8
    use = np.flatnonzero(turn < 5)
    _descend(net, items, y, np.ones(len(y)), use, rng, epochs, batch)
    held = np.flatnonzero((turn == 5) | (turn == 6))
    z = np.array([float(net.pool(items[i]) @ net.out) for i in held]) + net.offset
    net.scale = platt(z, y[held])
    a, b = net.scale
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    shown = np.array([bool(_CANDIDATE.fullmatch(windows[i][1])) for i in held], bool)
    positive = np.sort(p[(y[held] == 1) & shown])
    if len(positive):
        net.threshold = min(0.5, float(positive[int(np.floor((1 - RECALL) / 2 * len(positive)))]))
    return net


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the corpus: values that the fixed patterns found (y 1), and candidates, which they did not (y 0)."""
    for batch in sliced(batches, "text"):
        rows = []
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            found = _found(text)
            rows += [(*window(text, at, end), 1) for _, _, end, at in found]
            rows += [(*window(text, start, end), 0) for start, end in candidates(text, [f[:3] for f in found])]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["before", "value", "after", "y"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, str, str]], np.ndarray, np.ndarray]]:
    """slot, windows, labels and turns, one slot at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column("rows")[i].as_py()
            yield batch.column("slot")[i].as_py(), [(r["before"], r["value"], r["after"]) for r in rows], np.array([r["y"] for r in rows], float), np.array([r["turn"] for r in rows])


def _local(batches: Iterator[pa.RecordBatch], net: Network, by: tuple[float, float], turn: int) -> Iterator[pa.RecordBatch]:
    """A model per slot, after one pass over its rows that train."""
    for slot, windows, y, turns in _slots(batches):
        use, own = np.flatnonzero(turns < 5), net.like(np.frombuffer(net.pack(), np.float32))
        if len(use):
            items = [encode(w) if t < 5 else None for w, t in zip(windows, turns, strict=True)]
            _descend(own, items, y, np.where(y > 0, by[1], by[0]), use, np.random.default_rng((slot, turn)), 1, 128)
            yield pa.RecordBatch.from_pydict({"slot": [slot % 16], "weight": [float(len(use))], "model": [own.pack()]})


def _held(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """Scores of the rows that calibrate, in steps of 0.01, with their labels and whether they can be candidates."""
    for _, windows, y, turns in _slots(batches):
        at = np.flatnonzero((turns == 5) | (turns == 6))
        z = [int(np.floor(np.clip(float(net.pool(encode(windows[i])) @ net.out) + net.offset, -100, 100) * 100)) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()), pa.array(y[at].astype(np.int32)), pa.array([bool(_CANDIDATE.fullmatch(windows[i][1])) for i in at], pa.bool_())], names=["z", "y", "shown"])


def train(docs: DataFrame) -> Network:
    """Fit on generated rows and on all of the corpus's own: every finding of the patterns and every run that none of
    them found, whole, equal windows once. Runs count as no secrets; the few that are some are outweighed by the
    generated keys, and both labels weigh alike in all. Windows are dealt to slots by a hash; each slot trains a
    model of its own and the models are averaged, round by round. Of eight rows five train, two calibrate and set the
    threshold by counts over all slots (see :func:`fit`), in steps of 0.01 of the score. An empty table, or one without
    findings, leaves the generated rows."""
    from .lm_score import _average

    names = ("before", "value", "after", "y")
    found = docs.select(text_bytes().alias("text")).mapInArrow(_labelled, "before string, value string, after string, y int")
    windows, labels = generated()
    made = docs.sparkSession.createDataFrame([(*w, y) for w, y in zip(windows, labels, strict=True)], "before string, value string, after string, y int")
    rows = materialize(found.unionByName(made).distinct())
    n, ones, chars = rows.agg(F.count("*"), F.sum("y"), F.sum(F.length("value"))).first()
    by = (n / (2 * max(n - ones, 1)), n / (2 * max(ones, 1)))
    slots = 1 + max(n // FIT_ROWS, chars // FIT_CHARS)
    h = F.xxhash64(*names)
    dealt = rows.select(F.pmod(F.xxhash64(h), F.lit(slots)).alias("slot"), F.struct(h.alias("h"), *names, F.pmod(h, F.lit(8)).alias("turn")).alias("r"))
    # a slot is some megabytes; the files are read once a round and not dealt again
    read = materialize(dealt.repartition(min(slots, 512), "slot").groupBy("slot").agg(F.array_sort(F.collect_list("r")).alias("rows")))
    net = Network.new(np.random.default_rng(11))
    for turn in range(max(ROUNDS[0], min(ROUNDS[1], FIT_READ // n))):
        models = read.mapInArrow(partial(_local, net=net, by=by, turn=turn), "slot long, weight double, model binary")
        sums = models.repartition(16, "slot").mapInArrow(_average, "slot long, weight double, model binary").collect()
        total = sum(r["weight"] for r in sums)
        net = net.like(sum(np.frombuffer(r["model"], np.float32).astype(np.float64) * (r["weight"] / total) for r in sums))
    bins = read.mapInArrow(partial(_held, net=net), "z long, y int, shown boolean").groupBy("z", "y", "shown").count().orderBy("z", "y", "shown").collect()
    z, y, count = (np.array([r[c] for r in bins], float) for c in ("z", "y", "count"))
    net.scale = a, b = platt((z + 0.5) / 100, y, count * np.where(y > 0, by[1], by[0]))
    positive = [(r["z"], r["count"]) for r in bins if r["y"] and r["shown"]]
    allowed, below = int((1 - RECALL) / 2 * sum(c for _, c in positive)), 0
    for at, c in positive:
        below += c
        if below > allowed:
            net.threshold = min(0.5, float(1 / (1 + np.exp(-np.clip(a * at / 100 + b, -30, 30)))))
            break
    net.seen = n
    return net


def _scan(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        ids = batch.column("doc_id")
        texts = [raw.decode("utf-8", "replace") for raw in batch.column("text").to_pylist()]
        bases = [_found(t) for t in texts]
        extra = [candidates(t, [f[:3] for f in b]) for t, b in zip(texts, bases, strict=True)]
        windows = [window(t, at, end) for t, b, c in zip(texts, bases, extra, strict=True) for at, end in [*((f[3], f[2]) for f in b), *c]]
        score = iter(net.probability(windows).tolist()) if windows else iter(())
        rows = []
        for base, more in zip(bases, extra, strict=True):
            kept = [(s, k, e, next(score)) for s, k, e, _ in base]
            scored = [(s, 3, e, next(score)) for s, e in more]
            added = [x for x in scored if x[3] >= net.threshold]
            name = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
            kinds, spans = [k for _, k, _, _ in base], sorted(kept + added)
            rows.append((
                kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(name(kept).encode()).hexdigest(), name(spans), len(added), len(more),
                ",".join(f"{p:.3f}" for *_, p in spans),
            ))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(SCHEMA)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([ids, *columns], schema=SCHEMA)


def op6(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Counts of the fixed patterns, digest of their spans, and all spans, of every document.

    n_candidates: runs that the network judged; n_model: those that it added; scores: its probability for each
    span, in their order (a base finding is scored by its value and stays whatever the score). Null and
    empty texts have no spans (the digest is that of the empty string). Repeated rows give repeated rows. A null
    doc_id stays null. An empty table gives an empty one, further columns are not read. Positions are code
    points, ends exclusive.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(
        partial(_scan, net=net or train(docs)),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_candidates long, scores string",
    )
