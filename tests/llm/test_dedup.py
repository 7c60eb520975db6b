import hashlib
from collections import Counter

import numpy as np

from quillgraph.llm import exact_dedup, near_dedup, substring_dedup
from quillgraph.llm import kernels as K


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def canon(rs):
    return sorted(map(str, map(tuple, rs)))


def near_brute(data):
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = []
    for t in [r[1] for r in data]:
        w = (t or "").encode().split()
        bags.append(Counter([tuple(w[p : p + 5]) for p in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]))
    where = {}
    for x, bag in enumerate(bags):
        for k in bag:
            where.setdefault(k, []).append(x)
    for a, b in {(x, y) for xs in where.values() for i, y in enumerate(xs) for x in xs[:i]}:
        both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if 5 * both >= 4 * either:
            parent[find(a)] = find(b)
    groups = {}
    for x in range(len(data)):
        groups.setdefault(find(x), []).append(x)
    out = []
    for xs in groups.values():
        key = lambda x: (data[x][0] is None, data[x][0] or 0)
        head = min(xs, key=key)
        out += [(data[x][0], data[head][0], len(xs), x == head) for x in xs]
    return canon(out)


def window_brute(data):
    never = 1 << 70
    first = {}
    split = [(never if i is None else i, i, (t or "").encode().split()) for i, t in [r[:2] for r in data]]
    for j, _, w in split:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, never + 1), j)
    out = []
    for j, i, w in split:
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < j:
                gone.update(range(p, p + 13))
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return canon(out)


def exact_brute(data):
    groups = {}
    for x, (_, t) in enumerate([r[:2] for r in data]):
        groups.setdefault(b"".join((t or "").encode().split()), []).append(x)
    out = []
    for norm, xs in groups.items():
        head = min(xs, key=lambda x: (-len(data[x][1] or ""), data[x][0] is None, data[x][0] or 0))
        out += [(data[x][0], data[head][0], len(xs), x == head, hashlib.sha256(norm).hexdigest()) for x in xs]
    return canon(out)


def test_near_matches_brute_force(docs, odd):
    for df in (docs, odd):
        assert canon(near_dedup.op2(df).collect()) == near_brute(rows(df))


def test_near_links_chains_and_large_groups(spark, tmp_path):
    """A chain of edits, whose ends are unlike, and a large group of near copies become one class each."""
    rng = np.random.default_rng(1)
    word = lambda: "w%d" % rng.integers(0, 10**9)
    base = [word() for _ in range(150)]
    data, text = [], list(base)
    for i in range(12):
        data.append((i, " ".join(text)))
        text = list(text)
        text[10 * i % 150] = word()
        text[(10 * i + 75) % 150] = word()
    other = [word() for _ in range(120)]
    for i in range(100, 260):
        text = list(other)
        text[int(rng.integers(0, 120))] = word()
        data.append((i, " ".join(text)))
    shared = [word() for _ in range(60)]
    data += [(i, " ".join(shared + [word() for _ in range(100)])) for i in range(300, 380)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(path)
    assert canon(near_dedup.op2(spark.read.parquet(path)).collect()) == near_brute(data)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    a, b = {k: 1 + k % 5 for k in range(60)}, {k: 1 + k % 7 for k in range(10, 70)}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(70)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(70))
    got = []
    for _ in range(80):
        g = rng.integers(0, 2**63, 70).astype(np.uint64)
        doc = np.array([0] * len(a) + [1] * len(b))
        sig = near_dedup.signatures(doc, np.concatenate([g[list(a)], g[list(b)]]), np.array([*a.values(), *b.values()]), 2)
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - true) < 4 * np.std(got) / len(got) ** 0.5


def test_window_removal_matches_brute_force(docs, odd):
    for df, size in ((docs, 50_000), (odd, 300)):
        assert canon(substring_dedup.op8(df, size).collect()) == window_brute(rows(df))


def test_kept_texts_agree_with_digests(docs):
    digests = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.op8(docs).collect()}
    for r in substring_dedup.kept_texts(docs).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == digests[r["doc_id"]]


def test_difference_cover():
    for d in range(7):
        assert any((a - b) % 7 == d for a in substring_dedup.COVER for b in substring_dedup.COVER)
    assert substring_dedup.ANCHOR + substring_dedup.PERIOD - 1 <= substring_dedup.WINDOW


def test_exact_matches_brute_force(docs, odd):
    for df in (docs, odd):
        assert canon(exact_dedup.op5(df).collect()) == exact_brute(rows(df))


def test_exact_filter_keeps_rows_and_columns(odd, odd_rows):
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    want = [eval(r)[:2] for r in exact_brute(odd_rows) if eval(r)[3]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(w[0]) for w in want)


def test_near_filter_keeps_rows_and_columns(odd, odd_rows):
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(eval(r)[3] for r in near_brute(odd_rows))


def test_empty_tables(empty):
    assert near_dedup.op2(empty).collect() == []
    assert substring_dedup.op8(empty).collect() == []
    assert exact_dedup.op5(empty).collect() == []
    assert exact_dedup.deduplicated(empty).collect() == []


def test_word_kernel_agrees_with_split():
    texts = ["a  b\tc", "", " x ", "é\x0b\x0cü", "tail"]
    buf, begins = K.join([t.encode() for t in texts])
    s, e = K.spans(buf)
    raw = buf.tobytes()
    assert [raw[a:b] for a, b in zip(s, e, strict=True)] == [w for t in texts for w in t.encode().split()]
    assert K.doc_of(s, begins).tolist() == [0, 0, 0, 2, 3, 3, 4]
    long = [b"x" * 300_000, b"y"]
    buf, _ = K.join(long * 2)
    h = K.word_hashes(buf, *K.spans(buf))
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_rows_keep_their_identity_when_files_are_packed_anew(spark, tmp_path):
    """Executors that come or go change how files are packed into tasks; the rows kept must not change."""
    from quillgraph.llm import mixing

    path = str(tmp_path / "many")
    data = [(i % 97, f"text number {i % 211} of some length " * (1 + i % 5), "abc"[i % 3]) for i in range(600)]
    spark.createDataFrame(data, "doc_id long, text string, source string").repartition(24).write.parquet(path)
    key = "spark.sql.leafNodeDefaultParallelism"
    for f in (exact_dedup.deduplicated, near_dedup.deduplicated, mixing.mixed_documents):
        got = []
        try:
            for before, after in ((24, 24), (24, 4)):
                spark.conf.set(key, before)
                out = f(spark.read.parquet(path))
                spark.conf.set(key, after)
                got.append(sorted(map(str, out.collect())))
        finally:
            spark.conf.unset(key)
        assert got[0] == got[1]
        if f is not mixing.mixed_documents:
            assert len(got[1]) == len({x for x in got[1]})


def test_keyless_and_empty_tables(spark, empty):
    keyless = spark.createDataFrame([(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, None, None)], "doc_id long, text string, source string")
    assert canon(near_dedup.op2(keyless).collect()) == near_brute(rows(keyless))
    assert near_dedup.deduplicated(keyless).count() == 2 and exact_dedup.deduplicated(keyless).count() == 2
    assert near_dedup.deduplicated(empty).collect() == []


def test_a_hub_with_many_partners_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "PER_HUB", 3)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(100)]
    data = []
    for i in range(60):
        text = list(base)
        text[int(rng.integers(0, 100))] = f"x{i}"
        data.append((i, " ".join(text)))
    assert canon(near_dedup.op2(spark.createDataFrame(data, "doc_id long, text string")).collect()) == near_brute(data)
