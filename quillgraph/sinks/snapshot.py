"""Snapshots of a set of tables: staged, then committed at one stroke.

A commit is one small file, ``commits/<number>``, that names the folder of every table. Folders are written
first, under the run's own name, and nobody reads them before the commit names them; tables that a run leaves alone
keep their folder. So a driver that is lost while it writes leaves the last snapshot as it was, and the same run, started
again, writes its folders anew and commits. The commit file is created only if there is none of its number: of two
runs that start from one snapshot the second fails and has to start again. The file system has to move a file
at one stroke, as HDFS and local disks do.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another run has committed since this one read the tables."""


class NothingUpstream(RuntimeError):
    """The probe found no records: what there is would be wiped for nothing."""


@dataclass(frozen=True)
class Staged:
    """Tables that are written but not yet to be seen."""

    run: str
    base: int
    folders: dict[str, str]
    counts: dict[str, int]


class Snapshots:
    """The tables below ``root``, a path that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        folder = self._path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def commit_of(self, version: int) -> dict:
        """run, tables (folder by name) and counts of a commit; a half-written one is waited for by nobody and raises."""
        if not version:
            return {"run": None, "tables": {}, "counts": {}}
        stream = self._fs.open(self._path(f"{self.root}/commits/{version}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the last one if none is given."""
        tables = self.commit_of(self.version() if version is None else version)["tables"]
        return self.spark.read.parquet(f"{self.root}/{tables[table]}")

    def stage(self, run: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, base: int | None = None) -> Staged:
        """Write tables under the run's name. What a lost attempt of the run has left there is overwritten.

        ``base``: the snapshot that the tables were made from, the last one if none is given.
        """
        base = self.version() if base is None else base
        folders, counts = {}, {}
        for name, df in tables.items():
            folders[name] = f"data/{run}/{base + 1}/{name}"
            df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{self.root}/{folders[name]}")
            counts[name] = self.spark.read.parquet(f"{self.root}/{folders[name]}").count()
        return Staged(run, base, folders, counts)

    def commit(self, staged: Staged) -> int:
        """Make staged tables the current ones; the number of the commit. Doing it twice is doing it once."""
        last = self.commit_of(self.version())
        if last["run"] == staged.run and all(last["tables"].get(n) == f for n, f in staged.folders.items()):
            return self.version()
        before = self.commit_of(staged.base)
        text = json.dumps({"run": staged.run, "tables": before["tables"] | staged.folders, "counts": before["counts"] | staged.counts}, sort_keys=True)
        number = staged.base + 1
        try:
            if self.version() != staged.base:
                raise Conflict(f"snapshot {staged.base} is not the last one any more")
            # written aside and moved: a reader sees the whole file or none, and a rename onto a file fails
            aside = self._path(f"{self.root}/commits/.{number}-{staged.run}")
            out = self._fs.create(aside, True)
            out.write(bytearray(text.encode()))
            out.close()
            if self._fs.exists(self._path(f"{self.root}/commits/{number}")) or not self._fs.rename(aside, self._path(f"{self.root}/commits/{number}")):
                self._fs.delete(aside, False)
                raise Conflict(f"commit {number} is there already")
        except Exception as e:
            if isinstance(e, Conflict):
                raise
            raise Conflict(str(e)) from e
        return number

    def write(self, run: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
        """Stage and commit; a run whose commit is the last one already writes nothing."""
        last = self.version()
        if last and self.commit_of(last)["run"] == run:
            return last
        return self.commit(self.stage(run, tables, partition_by, last))

    def sweep(self) -> int:
        """Remove staged folders that no commit names; their number. Not to be run while another run is staging."""
        kept = {f for v in range(1, self.version() + 1) for f in self.commit_of(v)["tables"].values()}
        gone, data = 0, self._path(f"{self.root}/data")
        for run in self._fs.listStatus(data) if self._fs.exists(data) else ():
            for version in self._fs.listStatus(run.getPath()):
                for table in self._fs.listStatus(version.getPath()):
                    name = f"data/{run.getPath().getName()}/{version.getPath().getName()}/{table.getPath().getName()}"
                    if name not in kept:
                        gone += bool(self._fs.delete(table.getPath(), True))
        return gone


def replaced(edges: DataFrame, citations: DataFrame, relation: str, new_edges: DataFrame, new_citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and citations with all of one relation taken out, citations by their edge, and the new ones put in."""
    gone = edges.filter(F.col("relation") == relation).select(F.col("id").alias("edge_id"))
    kept = edges.filter(~F.col("relation").eqNullSafe(F.lit(relation))).unionByName(new_edges)
    return kept, citations.join(gone, "edge_id", "left_anti").select(*citations.columns).unionByName(new_citations)


def changes(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """by, before, after, delta: rows of two snapshots of a table by a column's values."""
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name)).withColumnRenamed(by, f"_{name}")
    a, b = n(before, "before"), n(after, "after")
    both = a.join(b, F.col("_before").eqNullSafe(F.col("_after")), "full_outer")
    was, now = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return both.select(F.when(F.col("before").isNotNull(), F.col("_before")).otherwise(F.col("_after")).alias(by), was.alias("before"), now.alias("after"), (now - was).alias("delta"))


def rebuild(store: Snapshots, run: str, relation: str, probe: Callable[[], int], ingest: Callable[[], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Wipe a relation and ingest it again, as one commit; changes of the edges by relation.

    The probe asks upstream for its number of records first, and none is an error; the ingest is written before
    anything is wiped, so a failure at any point leaves the last snapshot.
    """
    base = store.version()
    if base and store.commit_of(base)["run"] == run:  # done before: say what it did
        return changes(store.read("edges", base - 1), store.read("edges", base), "relation")
    if not probe():
        raise NothingUpstream(f"no records for {relation}")
    edges, citations = store.read("edges", base), store.read("citations", base)
    edges_after, citations_after = replaced(edges, citations, relation, *ingest())
    number = store.commit(store.stage(run, {"edges": edges_after, "citations": citations_after}, {"edges": ["relation"]}, base))
    return changes(store.read("edges", base), store.read("edges", number), "relation")
