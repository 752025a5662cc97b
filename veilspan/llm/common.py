"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only where it is unset and there are no executors
    on other machines, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it names the folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Spark's setting by which an execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and survives the loss of executors.

    What the write has shuffled goes at its end; the session's own setting is put back.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def digest_of(text: str) -> Column:
    """16 bytes: equal for equal texts, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def split_of_crc32(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has at most `rows` rows and about `most` bytes of the column (a single longer value
    stays whole)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = len(col)
        if n == 0:
            continue
        if n <= rows and col.nbytes <= most:
            yield batch
            continue
        sizes = [x or 0 for x in pa.compute.binary_length(col).to_pylist()]
        start = total = 0
        for i, size in enumerate(sizes):
            if i - start >= rows or total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def utf8(col: pa.Array) -> list[bytes]:
    """Each value in UTF-8; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]
