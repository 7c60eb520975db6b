import pytest

from quillgraph.sinks import snapshot
from quillgraph.sinks.snapshot import Conflict, NothingUpstream, Snapshots

X, C = "id string, relation string, weight double", "id string, edge_id string"


@pytest.fixture()
def store(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/graph")
    assert s.version() == 0
    edges = spark.createDataFrame([("1", "lobbies", 1.0), ("2", "holds_contract", 5.0), ("3", "holds_contract", 6.0)], X)
    s.write("first", {"edges": edges, "citations": spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], C)}, {"edges": ["relation"]})
    return s


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def fresh(spark):
    return spark.createDataFrame([("9", "holds_contract", 7.0)], X), spark.createDataFrame([("z", "9")], C)


def test_a_driver_lost_between_stage_and_commit_changes_nothing(spark, store):
    bad = spark.createDataFrame([("7", "lobbies", 0.0)], X)
    store.stage("second", {"edges": bad})  # and here the driver is lost
    again = Snapshots(spark, store.root)
    assert again.version() == 1 and ids(again.read("edges")) == ["1", "2", "3"]
    more = again.read("edges").unionByName(bad.select("id", "weight", "relation"))
    assert again.write("second", {"edges": more}) == 2 and ids(again.read("edges")) == ["1", "2", "3", "7"]
    assert ids(again.read("citations")) == ["a", "b", "c"] and ids(again.read("edges", 1)) == ["1", "2", "3"]
    assert again.write("second", {"edges": bad}) == 2 and again.commit_of(2)["counts"] == {"edges": 4, "citations": 3}


def test_of_two_runs_from_one_snapshot_one_commits(spark, store):
    one, two = (store.stage(run, {"citations": fresh(spark)[1]}) for run in ("one", "two"))
    assert store.commit(one) == 2 and store.commit(one) == 2
    with pytest.raises(Conflict):
        store.commit(two)
    assert store.version() == 2 and store.commit_of(2)["run"] == "one"
    assert store.sweep() == 1 and ids(store.read("citations")) == ["z"] and ids(store.read("edges")) == ["1", "2", "3"]


def test_rebuild_is_one_commit(spark, store):
    got = snapshot.rebuild(store, "again", "holds_contract", lambda: 1, lambda: fresh(spark))
    assert {r["relation"]: (r["before"], r["after"], r["delta"]) for r in got.collect()} == {"lobbies": (1, 1, 0), "holds_contract": (2, 1, -1)}
    assert ids(store.read("edges")) == ["1", "9"] and ids(store.read("citations")) == ["a", "z"]
    same = snapshot.rebuild(store, "again", "holds_contract", lambda: 0, lambda: fresh(spark))
    assert store.version() == 2 and sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))


def test_a_rebuild_that_fails_wipes_nothing(spark, store):
    with pytest.raises(NothingUpstream):
        snapshot.rebuild(store, "none", "holds_contract", lambda: 0, lambda: fresh(spark))

    def broken():
        raise OSError("upstream went away")

    with pytest.raises(OSError):
        snapshot.rebuild(store, "lost", "holds_contract", lambda: 5, broken)
    assert store.version() == 1 and ids(store.read("edges")) == ["1", "2", "3"]


def test_changes_of_values_that_only_one_side_has(spark):
    a, b = spark.createDataFrame([("x",), ("x",), (None,)], "k string"), spark.createDataFrame([("y",), (None,), (None,)], "k string")
    assert {r["k"]: (r["before"], r["after"]) for r in snapshot.changes(a, b, "k").collect()} == {"x": (2, 0), "y": (0, 1), None: (1, 2)}
