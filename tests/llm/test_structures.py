"""Suffix sorting, prefix trie and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import prefix_trie, spelling, suffix_dedup, suffix_sort


def canon(rows):
    return sorted(str(tuple(r)) for r in rows)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bytes_brute(data, limit=200):
    encoded = [(i, (t or "").encode()) for i, t in data]
    count = Counter(b[s : s + limit] for _, b in encoded for s in range(len(b) - limit + 1))
    out = []
    for i, b in encoded:
        gone, end = bytearray(len(b)), 0
        for s in range(len(b) - limit + 1):
            if count[b[s : s + limit]] > 1:
                at = max(s, end)
                gone[at : s + limit] = b"\1" * (s + limit - at)
                end = s + limit
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return canon(out)


def trie_brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += k not in children
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return canon(out)


def spelling_brute(data):
    count = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    cut = lambda w: [(i, w[:i] + w[i + 1 :]) for i in range(len(w))]
    gaps = defaultdict(set)
    for w in words:
        for i, g in cut(w):
            gaps[g].add((i, w))
    near = {}
    for w in words:
        near[w] = {x for i, g in cut(w) for j, x in gaps[g] if i == j and x != w}
        near[w] |= {x for _, x in gaps.get(w, ())} | {g for _, g in cut(w) if g in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return canon(out)


@pytest.mark.parametrize("small", [1 << 14, 40])
def test_suffixes_are_sorted(small, monkeypatch):
    monkeypatch.setattr(suffix_sort, "SMALL", small)
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 100, 3000).astype(np.uint8))
    text += text[100:900] + b"ab" * 300 + text[:50] + text[500:800] + b"z" * 700
    for limit in (200, 45, 7):
        done = suffix_sort.SuffixSort(text, np.arange(len(text) - limit + 1), limit)
        keys = [text[p : p + limit] for p in done.order.tolist()]
        assert keys == sorted(keys)
        assert done.same.tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(len(keys))]


def test_repeated_bytes_go_as_in_brute_force(docs, odd, empty):
    for df in (docs, odd):
        assert canon(suffix_dedup.op11(df).collect()) == bytes_brute(texts(df))
    assert suffix_dedup.op11(empty).collect() == []


def test_passages_that_all_chunks_have(spark):
    """A hash that more chunks have than HOT goes by digests; edits, inner repeats and long runs of one letter too."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    passage = [word() for _ in range(120)]
    data = [(i, " ".join([*[word() for _ in range(40)], *passage[: int(rng.integers(30, 120))], *[word() for _ in range(i % 50)]])) for i in range(150)]
    data += [(500, "a" * 1000), (501, "b" * 199), (502, "b" * 200), (503, "c" * 201), (504, "é" * 150), (505, "xé" + "é" * 130)]
    inner = " ".join(word() for _ in range(50))
    data += [(510, inner + " " + inner), (511, inner[5:]), (None, inner)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert canon(suffix_dedup.op11(df, chunk_bytes=1500).collect()) == bytes_brute(data)
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.kept_texts(df, chunk_bytes=1500).collect()}
    assert kept[501] == "b" * 199 and kept[502] == "b" * 200 and kept[503] == ""


def test_loser_tree_merges_runs_and_knows_what_is_shared():
    rng = np.random.default_rng(2)
    turn = lambda: bytes([int(rng.integers(0, 3))]) * prefix_trie.TURN
    for count in (1, 2, 3, 7):
        runs = [prefix_trie.run_of([(b"".join(turn() for _ in range(int(rng.integers(0, 6)))), i) for i in range(int(rng.integers(0, 40)))]) for _ in range(count)]
        got = list(prefix_trie.merged(runs))
        paths = [e[0] for _, e in got]
        assert paths == sorted(e[0] for r in runs for _, e in r)
        assert [k for k, _ in got] == [prefix_trie.common_turns(paths[i - 1], p) if i else 0 for i, p in enumerate(paths)]


def test_trie_matches_brute_force(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = trie_brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    for range_bytes, fan in ((8 << 20, 64), (1500, 3)):
        assert canon(prefix_trie.trie(turns, range_bytes, fan).collect()) == want


def test_trie_on_odd_conversations(spark):
    rows = [
        (0, 0, "user", "hello there"), (0, 1, "bot", None), (0, None, None, "first of all"), (0, 1, "bot", None), (0, 1, "a", "z"),
        (20, 0, "user", "x"), (21, 0, "user", "only"), (22, 5, "", ""), (23, 1, "user", "x y z"), (23, 1, "user", "x y z"),
        (47, 0, "user", "no base"), (48, 0, "user", "no base"), (None, 0, "user", "nobody"), (-3, 1, "u", "minus"), (-20, 0, "u", "m"), (9_000_000_000, 0, "user", "no base"),
    ] + [(c, t, "user", f"turn {t} of many") for c in range(60, 64) for t in range(90)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for name in ("path", "words", "part", "depth", "p", "n"):
        frame = frame.withColumn(name, frame["role"])
    for range_bytes, fan in ((8 << 20, 64), (300, 2)):
        assert canon(prefix_trie.op12(frame).collect() if fan == 64 else prefix_trie.trie(frame, range_bytes, fan).collect()) == trie_brute(rows)
    assert prefix_trie.op12(frame.limit(0)).collect() == []


def test_one_conversation_of_very_many(spark):
    """Ids of a sequence that all conversations share come in packs."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000) for t in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert canon(prefix_trie.op12(frame).collect()) == trie_brute(rows)


def test_spelling_matches_brute_force(spark, docs, odd, empty):
    for df in (docs, odd):
        want = spelling_brute(texts(df))
        assert canon(spelling.op13(df).collect()) == want
        assert canon(spelling.variants(df, group=20, shard=200).collect()) == want
    assert spelling.op13(empty).collect() == []


def test_spelling_forms_and_roots(spark):
    """Chains of forms, ties, halves that very many words share, letters outside ASCII."""
    counts = {"abcdefgh": 3000, "abcdefgi": 250, "abcdefxi": 20, "abcdefxj": 2, "abcdefg": 2, "tabcdefgh": 2, "étéàçèù": 20, "étéàçèu": 2, "zzzzzzzz": 20, "zzzzzzz": 2}
    counts |= {f"prefixed{a}{b}{c}": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "ab"}
    counts |= {f"{a}{b}suffixed": 30 if a == b else 2 for a in "abcdefgh" for b in "abcdefgh"}
    data = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = spelling_brute(data)
    for group in (20_000, 8, 2):
        assert canon(spelling.variants(df, group=group, shard=50).collect()) == want
    assert any("'abcdefxj'" in r and "'abcdefgh'" in r for r in want)
