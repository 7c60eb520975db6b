import re
import shutil

import corpus_pipeline
from quillgraph.llm import bpe, mixing, quality_gam

from .test_dedup import exact_brute, near_brute, rows


def test_each_stage_against_a_plain_version(spark, docs, labels, tmp_path):
    """Stage by stage: what goes in, what must come out."""
    sf, at = "/root/testdata/sf0.001", docs
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "quality":
            assert ids == sorted(r["doc_id"] for r in quality_gam.op7(at, labels).filter("predicted = 1").collect())
        elif name == "exact":
            assert ids == sorted(eval(r)[0] for r in exact_brute(rows(at)) if eval(r)[3])
        elif name == "near":
            assert ids == sorted(eval(r)[0] for r in near_brute(rows(at)) if eval(r)[3])
        elif name == "mix":
            taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.op3(at).collect()}
            assert ids == sorted(d for d, n in taken.items() for _ in range(n))
        else:
            assert sorted(map(str, out.collect())) == sorted(map(str, bpe.op10(at).collect()))
            assert len(ids) == at.count()
        seen.append(name)
        at = out
    assert seen == ["quality", "exact", "near", "mix", "encode"]


def test_entry_lists_every_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names


def test_entry_without_the_optional_parts(tmp_path):
    """The rest imports when the optional folders are gone."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(x.startswith('op') or x == 'pipeline' for x in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, blanks, ties, repeated rows, a long text and clashing columns go through every stage; so does an empty table."""
    sf = "/root/testdata/sf0.001"
    for name, table in (("odd", odd), ("empty", empty)):
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, table, sf)
            path = str(tmp_path / name / stage)
            out.write.parquet(path)
            got = spark.read.parquet(path)
            if stage != "encode":
                assert got.columns == table.columns
            assert got.count() <= 3 * table.count()
            if stage == "encode":
                assert got.count() == table.count()


def test_entry_without_a_library(tmp_path):
    """A library that only the optional parts need may be absent: the other queries stay."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = (
        "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\n"
        "q = e.queries(); assert 'flow_model1' in q and 'op4_lm_score' not in q; e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
