"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time in turn, adds up to one lookup table per
feature; the pairs with most remaining gain then get tables of their own. A text is scored by
adding up its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from .common import crc_mod, fresh, text_bytes
from .sampling import labelled

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: A text is kept from this probability on.
THRESHOLD = 0.7
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.12, 3, 6, 8, 40


@dataclass
class Additive:
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not self.edges:
            return out
        b = self.bins(x)
        for i, t in enumerate(self.tables):
            out += t[b[:, i]]
        for i, j, t in self.pairs:
            out += t[b[:, i] * PAIR_BINS // (BINS + 1), b[:, j] * PAIR_BINS // (BINS + 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        a, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + c, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with some leaves over ordered bins, by Newton gain."""
    lam, cuts = 1.0, [0, len(g)]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda s, e: (G[e] - G[s]) ** 2 / (H[e] - H[s] + lam)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                k = np.arange(s + 1, e)
                d = gain(s, k) + gain(k, e) - gain(s, e)
                i = int(np.argmax(d))
                if d[i] > best[0]:
                    best = (d[i], int(k[i]))
        if best[1] is None:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        out[s:e] = (G[e] - G[s]) / (H[e] - H[s] + lam)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Deterministic for given rows, whatever their order. No rows, or one class only: the smoothed prior for every text."""
    m = Additive(prior=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if len(y) < 20 or y.min() == y.max():
        return m
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order].astype(float)
    # every fourth row (by rank) is left out for calibration
    hold = np.arange(len(y)) % 4 == 3
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    m.edges = [np.unique(np.quantile(c, quantiles)) for c in x.T]
    m.tables = [np.zeros(BINS + 1) for _ in m.edges]
    b, fy = m.bins(x[~hold]), y[~hold]
    f = np.full(len(fy), m.prior)

    def gradient():
        p = 1 / (1 + np.exp(-f))
        return fy - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i in range(x.shape[1]):
            g, h = gradient()
            t = RATE * _tree(np.bincount(b[:, i], g, BINS + 1), np.bincount(b[:, i], h, BINS + 1), LEAVES)
            m.tables[i] += t
            f += t[b[:, i]]
    c = b * PAIR_BINS // (BINS + 1)
    g, h = gradient()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell = c[:, i] * PAIR_BINS + c[:, j]
            G, H = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
            gains.append((float((G**2 / (H + 5)).sum()), -i, -j))
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        m.pairs.append((-i, -j, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for i, j, table in m.pairs:
            g, h = gradient()
            G = np.zeros((PAIR_BINS, PAIR_BINS))
            H = np.zeros((PAIR_BINS, PAIR_BINS))
            np.add.at(G, (c[:, i], c[:, j]), g)
            np.add.at(H, (c[:, i], c[:, j]), h)
            # a tree of depth two: one cut along the first feature, one along the second below each side
            rows = _tree(G.sum(1), H.sum(1), 2)
            side = rows != rows[0]
            t = np.zeros_like(table)
            for part in (side, ~side):
                if part.any():
                    t[part] = _tree(G[part].sum(0), H[part].sum(0), 2)
            table += RATE * t
            f += RATE * t[c[:, i], c[:, j]]
    m.scale = platt(m.raw(x[hold]), y[hold])
    return m


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset that calibrate a score; (1, 0) if one class is missing. A row counts ``n`` times."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (n * (t - p) * z).sum() - 1e-3 * (a - 1), (n * (t - p)).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = float(a + np.clip(da, -1, 1)), float(b + np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .common import sliced

    for batch in sliced(batches, "text"):
        x = features.matrix(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(c) for c in x.T)], names=["y", *features.NAMES])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = FIT_ROWS) -> Additive:
    """Fit on at most ``limit`` labelled documents; those whose crc32(doc_id) mod 4 is 2 are never used."""
    usable = labels.filter(crc_mod("doc_id", 4) != 2)
    sample = labelled(docs, usable, target, limit, "gam:")
    schema = "y int, " + ", ".join(f"{n} double" for n in features.NAMES)
    table = sample.mapInArrow(_sample_features, schema).toArrow()
    x = np.column_stack([table.column(n).to_numpy() for n in features.NAMES]) if table.num_rows else np.zeros((0, len(features.NAMES)))
    return fit(x, table.column("y").to_numpy().astype(float))


def score_column(model: Additive, text: Column) -> Column:
    """Score of a column of UTF-8 bytes."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values, part, size = [], [], 0
            for t in texts.to_pylist():
                part.append(t or b"")
                size += len(part[-1])
                if size > 4 << 20:
                    values.append(model.score(features.matrix(part)))
                    part, size = [], 0
            if part:
                values.append(model.score(features.matrix(part)))
            yield pa.array(np.concatenate(values) if values else np.zeros(0), pa.float64())

    return score(text)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. Nulls are scored as empty texts."""
    name = fresh(docs, "_score")
    model = train(docs, labels)
    return docs.withColumn(name, score_column(model, text_bytes())).filter(F.col(name) >= threshold).drop(name)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored like any others, by the features of an empty text. A null doc_id stays null and is
    not held out, for its checksum is that of the empty text. Equal texts have equal scores whatever their ids,
    repeated rows give repeated rows. Without labels of both classes every text has the smoothed share of
    label 1. An empty table gives an empty one; further columns, whatever their names, are not read.
    """
    model = train(docs, labels)
    return docs.select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), score_column(model, text_bytes()).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
