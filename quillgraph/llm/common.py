"""Shared plumbing of the training-data operators: tables, checkpoints, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize  # noqa: F401  the operators take it from here

#: The six ASCII white-space characters, as the body of a character class.
WS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of the text, so Python workers decode only what they need."""
    return text_or_empty(name).cast("binary")


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the integer written as text, modulo m; a null id hashes as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that ``column`` (binary) holds about ``max_bytes`` in each; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written to the shared folder with a unique number per row, and that column's name.

    Numbers that are worked out anew in each scan move when executors come and go, since files are
    packed into tasks by the number of cores; here they are read back as they were written.
    """
    row = fresh(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id())), row
