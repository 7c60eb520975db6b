"""Quality rules: fixed base rules and a hashed n-gram logistic regression.

The regression sees hashed words and hashed four-byte character grams, each averaged over the text,
is fitted on labelled quality rows, calibrated on others, and scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes
from .features import Slice
from .quality_gam import platt
from .sampling import labelled

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 6_000
#: Calibrated probability of quality 1 from which a text that passes the base rules is kept.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BITS = 16
STEPS = 120
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64()),
])


def word_bins(s: Slice) -> np.ndarray:
    return (s.hashes(lower=True) >> np.uint64(64 - BITS)).astype(np.int32)


def char_bins(buf: np.ndarray) -> np.ndarray:
    """Bin of the four bytes that begin at each byte; the last three bytes have none."""
    b = buf.astype(np.uint32)
    gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return ((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Regression:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, s: Slice) -> np.ndarray:
        w = s.per_words(self.words[word_bins(s)]) / np.maximum(s.words, 1)
        if len(s.buf) < 4:
            return w + self.bias
        # grams that reach into the next text count for neither: a score is a function of its text alone
        values = np.zeros(len(s.buf), np.float32)
        values[:-3] = self.chars[char_bins(s.buf)]
        for k in (1, 2, 3):
            values[np.maximum(s.begins[1:] - k, 0)] = 0
        size = np.diff(s.begins)
        return w + np.add.reduceat(values, s.begins[:-1], dtype=np.float64) / size + self.bias

    def probability(self, s: Slice) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(s) + b, -30, 30)))


def _sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bins (words first, chars after them) and shares of each text, one text at a time as in scoring."""
    rows = []
    for t in texts:
        s = Slice([t])
        w, nw = np.unique(word_bins(s), return_counts=True)
        if len(s.buf) >= 4:
            c, nc = np.unique(char_bins(s.buf), return_counts=True)
        else:
            c, nc = np.zeros(0, np.int32), np.zeros(0, np.int64)
        rows.append((
            np.concatenate([w, c + (1 << BITS)]).astype(np.int32),
            np.concatenate([nw / max(int(s.words[0]), 1), nc / len(s.buf)]).astype(np.float32),
        ))
    return rows


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Regression:
    """Full-batch AdaGrad with L2, every fourth row kept for calibration. Without both classes: keep everything."""
    size = 1 << BITS
    zero = np.zeros(size, np.float32)
    if len(y) < 20 or y.min() == y.max():
        return Regression(zero, zero, 1.0 if not len(y) or y.max() > 0 else -1.0)
    hold = np.arange(len(y)) % 4 == 3
    use = np.flatnonzero(~hold)
    idx = np.concatenate([rows[i][0] for i in use])
    val = np.concatenate([rows[i][1] for i in use])
    own = np.repeat(np.arange(len(use)), [len(rows[i][0]) for i in use])
    # features are scaled by their root mean square so that rare and common grams learn alike
    rms = np.sqrt(np.bincount(idx, val * val, 2 * size) / len(use)) + 1e-4
    val = val / rms[idx].astype(np.float32)
    fy = y[use]
    w, acc, bias = np.zeros(2 * size), np.full(2 * size, 1e-8), float(np.log(fy.mean() / (1 - fy.mean())))
    for _ in range(STEPS):
        z = np.bincount(own, val * w[idx], len(use)) + bias
        r = (fy - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / len(use)
        g = np.bincount(idx, val * r[own], 2 * size) - 1e-5 * w
        acc += g * g
        w += 0.05 * g / np.sqrt(acc)
        bias += float(r.sum())
    w /= rms
    model = Regression(w[:size].astype(np.float32), w[size:].astype(np.float32), bias)
    z = np.array([float(np.dot(w[rows[i][0]], rows[i][1])) + bias for i in np.flatnonzero(hold)])
    model.scale = platt(z, y[hold])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows = _sparse(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([r[0].tobytes() for r in rows]), pa.array([r[1].tobytes() for r in rows])],
            names=["doc_id", "y", "bins", "shares"],
        )


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = FIT_ROWS) -> Regression:
    sample = labelled(docs, labels, target, limit, "rules:")
    table = sample.mapInArrow(_features, "doc_id long, y int, bins binary, shares binary").toArrow().sort_by("doc_id")
    rows = [
        (np.frombuffer(b.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.float32))
        for b, s in zip(table.column("bins"), table.column("shares"), strict=True)
    ]
    return fit(rows, table.column("y").to_numpy().astype(float))


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _judge(batches: Iterator[pa.RecordBatch], model: Regression) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        texts = batch.column("text").to_pylist()
        s = Slice(texts)
        repeat = s.repeated_words(s.hashes())
        failed = (s.words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * s.words)
        p = model.probability(s)
        columns = [
            s.words, s.word_code_points(), s.symbols(), [dup_lines(t) for t in texts], repeat, failed, ~failed & (p >= THRESHOLD), p
        ]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=SCHEMA)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, base verdict, calibrated probability and final verdict of every document.

    Null and empty texts have no words and fail. Repeated rows give repeated rows. A null doc_id stays
    null. Without labels of both classes the base rules alone decide. The probability depends on the
    text alone, whatever stands beside it in a batch.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(
        partial(_judge, model=model),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double",
    )


op9 = judge
