import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import lm_score, mixing

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def base_brute(data):
    tokens = [(i, [*(t or "").encode().translate(LOW).split(), None]) for i, t in data]
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    c = Counter(w for i, ws in tokens if crc(i) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, crc(i) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]


def test_lm_base_matches_brute_force(docs, odd, empty):
    for df, size in ((docs, 100_000), (odd, 500)):
        data = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = lm_score.op4(df, chunk_bytes=size).collect()
        near = [(*tuple(r)[:5], round(r["base_score"], 6)) for r in got]
        assert sorted(map(str, near)) == sorted(map(str, base_brute(data)))
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm_score.op4(empty).collect() == []


def test_state_is_carried_and_order_does_not_matter():
    """Scores do not depend on how documents are dealt to lanes, and hold for texts longer than any window."""
    texts = [b"a b c " * 200, b"b a", b"", b"c c c a b " * 31]
    c = lm_score.Chunk([1, 2, 3, 4], texts)
    h, n = np.unique(c.tokens, return_counts=True)
    v = lm_score.Vocabulary(h, n, int(n.sum()), len(h))
    net = lm_score.Network.new(v)
    trainer = lm_score.Trainer(net, v)
    for _ in range(5):
        trainer.fit(c.sizes, c.first, c.tokens, v.ids(c.tokens))
    together = np.add.reduceat(lm_score.log_likelihood(net, v, c.sizes, c.first, c.tokens, v.ids(c.tokens)), c.first)
    for i, t in enumerate(texts):
        one = lm_score.Chunk([1], [t])
        alone = lm_score.log_likelihood(net, v, one.sizes, one.first, one.tokens, v.ids(one.tokens)).sum()
        assert alone == pytest.approx(together[i], rel=1e-4)


def test_probabilities_add_up():
    c = lm_score.Chunk([1], [b" ".join(b"w%d" % (i % 97) for i in range(3000))])
    h, n = np.unique(c.tokens, return_counts=True)
    order = np.lexsort((h, -n))[:70]
    v = lm_score.Vocabulary(h[order], n[order], int(n.sum()), len(h))
    net = lm_score.Network.new(v)
    rng = np.random.default_rng(0)
    hs = rng.standard_normal((1, lm_score.HIDDEN)).astype(np.float32)
    total = 0.0
    for w in range(v.size):
        out = np.zeros(1)
        lm_score._emit(net, hs, np.array([0]), np.array([w // lm_score.CLASS_SIZE]), np.array([w]), v, out)
        total += math.exp(out[0])
    out = np.zeros(1)
    lm_score._emit(net, hs, np.array([0]), np.array([v.classes]), np.array([-1]), v, out)
    rest = n[np.lexsort((h, -n))[70:]]
    total += math.exp(out[0]) * ((rest + 1).sum() + 1) / v.tail_total
    assert total == pytest.approx(1, abs=1e-3)


def test_model_beats_the_base_on_held_out_documents(spark):
    """By a quarter of a decade a token, and nearly every document."""
    got = lm_score.op4(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    tokens = sum(r["n_tokens"] for r in got)
    assert (sum(r["score"] for r in got) - sum(r["base_score"] for r in got)) / tokens > 0.25
    assert np.mean([r["score"] > r["base_score"] for r in got]) > 0.9


def test_lanes_grow_with_the_run():
    least, most = lm_score.TRAIN_LANES
    assert lm_score.lanes_for(0) == least and lm_score.lanes_for(10**9) == most
    assert lm_score.lanes_for(64 * lm_score.WINDOW * lm_score.STEPS) == 64


def test_gradients_match_differences():
    """One window, every array: the step that AdaGrad takes from a fresh start has the sign of the true slope."""
    rng = np.random.default_rng(2)
    c = lm_score.Chunk([1, 2], [b" ".join(b"w%d" % i for i in rng.integers(0, 150, 40)) for _ in range(2)])
    h, n = np.unique(c.tokens, return_counts=True)
    order = np.lexsort((h, -n))[:128]
    v = lm_score.Vocabulary(h[order], n[order], int(n.sum()), len(h))
    ids = v.ids(c.tokens)
    net = lm_score.Network.new(v)
    for a in net.arrays():
        a += (rng.standard_normal(a.shape) * 0.05 * (np.abs(a) < 1e8)).astype(np.float32)
    before = {k: a.copy() for k, a in zip(net.NAMES, net.arrays(), strict=True)}
    loss = lambda: -lm_score.log_likelihood(net, v, c.sizes, c.first, c.tokens, ids).sum()
    trainer = lm_score.Trainer(net, v)
    trainer.rate = np.float32(0.1)
    x, y, new, _ = lm_score._layout(c.sizes, c.first, v.inputs(c.tokens, ids), np.arange(len(c.tokens)), v.begin, 2)
    cls, word = np.where(ids >= 0, ids // lm_score.CLASS_SIZE, v.classes).astype(np.int32), (ids % lm_score.CLASS_SIZE).astype(np.int32)
    trainer._window(x, y, new, np.zeros((2, lm_score.HIDDEN), np.float32), cls, word, np.float32(1 / x.size))
    moved = {k: getattr(net, k) - before[k] for k in net.NAMES}
    for k in net.NAMES:
        getattr(net, k)[...] = before[k]
    for k in net.NAMES:
        a = getattr(net, k)
        for at in [tuple(i) for i in np.argwhere(np.abs(moved[k]) > np.quantile(np.abs(moved[k][moved[k] != 0]), 0.9))[:6]]:
            old, slope = a[at], []
            for d in (2e-2, -2e-2):
                a[at] = old + np.float32(d)
                slope.append(loss())
            a[at] = old
            assert (slope[0] - slope[1]) * moved[k][at] < 0, (k, at)


def test_rounds_train_on_every_training_document(docs):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in data], "text": [(t or "").encode() for _, t in data]})
    packed = [b.append_column("chunk", pa.array([k])) for k, b in enumerate(lm_score._pack(iter([rows]), 100_000))]
    c = lm_score.Chunk(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())
    h, n = np.unique(c.tokens[~c.held[c.doc]], return_counts=True)
    v = lm_score.Vocabulary(h[:200], n[:200], int(n.sum()), len(h))
    net = lm_score.Network.new(v)
    seen = [sum(b.column("weight")[0].as_py() for b in lm_score._train(iter(packed), net, v, turn)) for turn in range(lm_score.ROUNDS)]
    assert all(seen) and sum(seen) == n.sum()


def test_chunks_are_filled_across_batches():
    """Texts that come in small batches share chunks; none is lost and none exceeds the size but for a long text of its own."""
    rows = [(i, b"w%d " % i * 20) for i in range(50)] + [(50, b"long " * 500), (None, b"")]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": [t]}) for i, t in rows]
    packed = [b.to_pylist()[0] for b in lm_score._pack(iter(batches), 1000)]
    whole = [lm_score.unpack(*(b[n] for n in lm_score._PARTS)) for b in packed]
    assert [r for ids, texts in whole for r in zip(ids, texts, strict=True)] == rows
    assert len(packed) < 10 and all(len(texts) == 1 or sum(map(len, texts)) <= 1000 for _, texts in whole)


def test_a_few_long_documents_do_not_take_windows_of_their_own():
    """A task trains on its share of a round in one run, and what the longest documents leave at its end takes windows of more steps."""
    rng, sizes = np.random.default_rng(4), []
    rows = [(i, b" ".join(b"w%d" % w for w in rng.integers(0, 90, 9000 if i % 20 == 0 else 600))) for i in range(1500)]
    tokens = sum(1 + t.count(b" ") + 1 for i, t in rows if lm_score.crc(i) % 7 != 2 and lm_score.crc(i) // 7 % 4 == 0)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t * 8 for _, t in rows]})
    packed = [b.append_column("chunk", pa.array([k])) for k, b in enumerate(lm_score._pack(iter([batch]), 4 << 20))]
    c = lm_score.Chunk([1], [b" ".join(b"w%d" % i for i in range(90))])
    v = lm_score.Vocabulary(np.unique(c.tokens), np.ones(91, np.int64), tokens, 91)
    runs, fit, window = [], lm_score.Trainer.fit, lm_score.Trainer._window
    try:
        lm_score.Trainer.fit = lambda self, *a: runs.append(a) or fit(self, *a)
        lm_score.Trainer._window = lambda self, x, y, new, h, *a: sizes.append(x.shape) or h
        list(lm_score._train(iter(packed), lm_score.Network.new(v), v, 0))
    finally:
        lm_score.Trainer.fit, lm_score.Trainer._window = fit, window
    assert len(runs) == 1
    lanes = max(b for _, b in sizes)
    assert lanes <= lm_score.TRAIN_LANES[1] and any(2 * b <= lanes for _, b in sizes[:-1])
    assert all(t == 2 * lm_score.WINDOW for t, b in sizes[:-1] if 2 * b <= lanes)


def test_equal_inputs_are_added_up():
    rng = np.random.default_rng(5)
    for n in (1, 7, 4000):
        keys, rows = (rng.zipf(1.4, n) % 900).astype(np.int32), rng.standard_normal((n, 6)).astype(np.float32)
        g = lm_score.Groups(keys)
        want = np.zeros((len(g.keys), 6))
        np.add.at(want, g.of, rows)
        assert (g.keys[g.of] == keys).all() and len(np.unique(keys)) == len(g.keys)
        assert np.allclose(g.sums(rows[:, :2], rows[:, 2:]), want, atol=1e-3)


def test_training_runs_in_few_tasks(docs):
    """Many small partitions are pooled: as many local models a round as there are cores, and words counted alike."""
    chunks = []
    train = lm_score.train
    try:
        lm_score.train = lambda c, v, tasks: chunks.append((c, tasks)) or train(c, v, tasks)
        got = lm_score.op4(docs.repartition(30), chunk_bytes=20_000).collect()
    finally:
        lm_score.train = train
    (c, tasks), data = chunks[0], [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert c.coalesce(tasks).rdd.getNumPartitions() <= tasks == docs.sparkSession.sparkContext.defaultParallelism
    assert sorted(str((*tuple(r)[:5], round(r["base_score"], 6))) for r in got) == sorted(map(str, base_brute(data)))


def duck_mix(data):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    return con.sql(mixing.ORACLE).fetchall()


def test_mix_matches_sql(spark, docs, tmp_path):
    rng = np.random.default_rng(2)
    hot = [(i, "w " * int(rng.integers(0, 300)), "big") for i in range(300)] + [(i, "w " * 40, s) for i, s in zip(range(300, 309), "abcabcab", strict=False)]
    hot += [(400, None, None), (401, "x y z", None), (402, "", "none")]
    path = str(tmp_path / "hot.parquet")
    spark.createDataFrame(hot, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    for df in (docs, spark.read.parquet(path)):
        data = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        canon = lambda rs: sorted(str([x if not isinstance(x, float) else round(x, 3) for x in r]) for r in map(tuple, rs))
        assert canon(mixing.op3(df).collect()) == canon(duck_mix(data))


def test_mix_bounds_and_nearness(spark):
    got = mixing.op3(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(got.taken.sum() - got["size"].sum()) <= got["size"].max()


def test_mix_odd_inputs(odd, empty):
    got = mixing.op3(odd).collect()
    assert len(got) == odd.count()
    assert sorted(map(str, got)) == sorted(map(str, mixing.op3(odd).collect()))
    assert mixing.op3(empty).collect() == []
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 30), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights: a 1, b 2, c 3, null 1; a and c stop at three times their size
    left = 1540 - 30 - 90
    assert got["a"] == 30 and got["c"] == 90
    assert got["b"] == pytest.approx(left * 2 / 3) and got[None] == pytest.approx(left / 3)


def test_mix_comes_near_each_target(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), most=("size", "max"), target=("target", "max"))
    assert len(per) > 2 and (abs(per.taken - per.target) <= per.most + 1).all()


def test_mix_of_a_hundred_thousand_sources(spark, monkeypatch):
    """One document a source: all of them finish at the same few times, and no window holds them all."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", 500)
    n = 100_000
    docs = spark.range(n).select("id", mixing.F.col("id").alias("doc_id"), mixing.F.concat(mixing.F.lit("s"), "id").alias("source"), mixing.F.lit("a b c").alias("text"))
    got = mixing.op3(docs).toPandas()
    assert len(got) == n and set(got["taken"] % 3) == {0}
    assert got.taken.sum() == 3 * n and got.taken.max() <= 9
    assert np.isclose(got.target.sum(), 3 * n)
    order = sorted(f"s{i}" for i in range(n))
    want = {s: (i % 3 + 1) * 1.5 for i, s in enumerate(order)}
    assert all(np.isclose(t, want[f"s{i}"]) for i, t in zip(got.doc_id, got.target, strict=True))


def test_narrowing_gives_the_cut_of_a_full_sort(spark, docs, monkeypatch):
    plain = sorted(map(str, mixing.op3(docs).collect()))
    twice = docs.unionByName(docs).unionByName(docs)
    whole = sorted(map(str, mixing.op3(twice).collect()))
    monkeypatch.setattr(mixing, "EDGE_ROWS", 3)
    monkeypatch.setattr(mixing, "CELLS", 4)
    assert sorted(map(str, mixing.op3(docs).collect())) == plain
    assert sorted(map(str, mixing.op3(twice).collect())) == whole
