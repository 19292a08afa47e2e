"""Helpers shared by the training-data operators: table access, shared-folder tables, bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow slice together; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="fintally-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fintally-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Deletes the files behind a table that written() returned; a union of such tables loses all of them. Nothing may read it later."""
    spark, seen = df.sparkSession, set()
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("fintally-") and path.toString() not in seen:
            seen.add(path.toString())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """Size in bytes of the files behind a table that written() returned."""
    spark, total = df.sparkSession, 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a slice stay within limit bytes, whatever the batch size is."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < len(sizes):
            yield batch.slice(start)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1: rows that no model learns from. False for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
