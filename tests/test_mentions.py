"""Incremental resolving against a plain loop over the mentions."""

import numpy as np
import pytest

from quillgraph.functions.text import KINDS
from quillgraph.operators import mentions

M = "id long, name string, kind string, embedding array<double>"
E = "id string, name string, type string, embedding array<double>"


def one_by_one(rows, entities, threshold=0.86, margin=0.04):
    """Entities are kept in order: those known before by id, then those made."""
    norm = lambda n: " ".join((n or "").lower().split())
    unit = lambda v: None if v is None or not any(v) else np.array(v) / np.sqrt(np.dot(v, v))
    known = [(e[0], norm(e[1]), e[2], unit(e[3])) for e in sorted(entities)]
    out = {}
    for i, name, kind, vector in sorted(rows, key=lambda r: r[0]):
        if vector is None:
            out[i] = (None, "skipped")
            continue
        type_, mine, v = KINDS.get((kind or "").strip().lower(), "unknown"), norm(name), unit(vector)
        near = [(-round(float(e[3] @ v), 9), at) for at, e in enumerate(known) if e[2] == type_ and e[3] is not None and v is not None]
        best = min(near, default=None)
        need = threshold + (margin if type_ == "person" else 0)
        if best and -best[0] >= need and set(known[best[1]][1].split()) & set(mine.split()):
            out[i] = (known[best[1]][0], "vector")
            continue
        named = [e[0] for e in known if mine and e[2] == type_ and e[1] == mine]
        if named:
            out[i] = (named[0], "name")
        else:
            known.append((f"new:{i}", mine, type_, v))
            out[i] = (f"new:{i}", "new")
    return out


def got(spark, rows, entities):
    done = mentions.resolve_mentions(spark.createDataFrame(rows, M), spark.createDataFrame(entities, E)).collect()
    assert len(done) == len(rows)
    return {r["id"]: (r["entity"], r["how"]) for r in done}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_agree_with_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 4))
    word = lambda n: " ".join(rng.choice(["ann", "bo", "cy", "dee", "eve"], n, replace=False).tolist())
    vector = lambda: None if rng.random() < 0.05 else (centres[rng.integers(0, 6)] + rng.normal(size=4) * 0.35).tolist()
    entities = [(f"k{i}{t}", word(1), t, vector()) for i in range(6) for t in ("person", "concept")]
    kinds = ["person", "concept", "Person ", None]
    rows = [(int(i), word(int(rng.integers(1, 3))) if rng.random() > 0.03 else " ", kinds[rng.integers(0, 4)], vector()) for i in rng.permutation(140)]
    assert got(spark, rows, entities) == one_by_one(rows, entities)


def test_repeated_mentions_chains_and_ties(spark):
    """Copies of one mention, a chain of unlike names with like vectors, equal similarities, no length, no name."""
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    chain = [(100 + i, f"name{i}", "topic", turn(0.3 * i)) for i in range(12)]
    copies = [(i, "Same Thing", "org", [1.0, 0.2]) for i in range(40)] + [(i, "Same Other", "org", [1.0, 0.2]) for i in range(40, 60)]
    odd = [(200, "", "org", [1.0, 0.2]), (201, None, "org", [1.0, 0.2]), (202, "zero", "event", [0.0, 0.0]), (203, "zero", "event", [0.0, 0.0]), (204, "zero", "event", None),
           (205, "left", "place", [1.0, 0.0]), (206, "right", "place", [1.0, 0.0]), (207, "right", "place", [1.0, 0.0]), (208, "left right", "place", [1.0, 0.0])]
    rows = chain + copies + odd
    entities = [("a", "thing", "place", [1.0, 0.0]), ("b", "zero", "event", None)]
    assert got(spark, rows, entities) == one_by_one(rows, entities)
    assert got(spark, rows, [("z", "none", "pac", None)]) == one_by_one(rows, [("z", "none", "pac", None)])


def test_copies_take_few_rounds(spark):
    """A thousand mentions of one thing, in two spellings, are settled in two rounds."""
    rows = [(i, "big thing" if i % 2 else "thing", "org", [1.0, 0.01 * (i % 5)]) for i in range(1000)]
    df = spark.createDataFrame(rows, M)
    from pyspark.sql import functions as F

    plain = df.select("id", F.lit("organization").alias("type"), F.col("name").alias("norm"), "embedding")
    mine, near, fixed = mentions._variants(plain, spark.createDataFrame([], E), 0.86, 0.04)
    made, rounds = mentions.makers(mine, near, fixed, plain.select("type", "norm").limit(0))
    assert [r["id"] for r in made.collect()] == [0] and rounds <= 2


def test_empty_tables(spark):
    assert mentions.resolve_mentions(spark.createDataFrame([], M), spark.createDataFrame([], E)).collect() == []
