"""Runs of a stream over all that its source has now."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints; a local one only where the session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="fintally-stream-")
    return f"{at.rstrip('/')}/fintally-stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame) -> DataFrame:
    """What an append-mode stream gives until its source is empty, as a table in the shared folder.

    Its checkpoint lies beside it: a run that is cut off goes on from there.
    """
    spark = stream.sparkSession
    at = folder(spark)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def arrivals(rows: DataFrame, batches: int, bucket: str) -> DataFrame:
    """A stream of rows that come in batches, by column bucket (0, 1, ...): each is written when the one before it is there."""
    spark = rows.sparkSession
    at = folder(spark)
    for k in range(batches):
        rows.where(f"{bucket} = {k}").drop(bucket).write.mode("append").parquet(at)
    kept = rows.drop(bucket).schema
    return spark.readStream.schema(kept).option("maxFilesPerTrigger", 8).parquet(at)
