"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Scratch folders by application; each is removed when its driver ends.
_roots: dict[tuple[str, str | None], str] = {}


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get(SETTING, None)
    key = context.applicationId, base
    if key not in _roots:
        if not base:
            if not re.match(r"local(\[|$)", context.master):
                # local folders would be written and read by each executor on its own
                raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quillgraph-{context.applicationId}")
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[key] = str(path)
    return _roots[key]


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``), removed when the driver ends.

    Only where that setting is absent and everything runs in one process (``local[N]``) is a temporary
    folder used; on a cluster its absence is an error.
    """
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
