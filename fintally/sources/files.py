"""Sources and sinks: integrity-checked files, tables in HTML, typed JSON, and precedence-aware upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checked_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, sha256, intact) of binary files against a manifest (name, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return files.join(F.broadcast(manifest), "name", "left").select("name", "found", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("intact"))


def html_rows(html: Column) -> Column:
    """array<array<string>> of the rows and cells of HTML tables, entities decoded, trimmed."""
    decode = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    cell = lambda c: F.trim(F.regexp_replace(decode(F.regexp_replace(c, "<[^>]*>", "")), r"\s+", " "))
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell))


def typed_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column under a schema; malformed rows are kept, marked, and null."""
    parsed = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_parsed", parsed).select("*", F.col("_parsed._corrupt").isNotNull().alias("malformed"), "_parsed.*").drop("_parsed", "_corrupt")


def upsert_mappings(known: DataFrame, new: DataFrame) -> DataFrame:
    """Mappings (tenant_id, label, node, source, usage_count) after an upsert: a human's is never overwritten by another source, use is counted."""
    a, b = known.alias("a"), new.alias("b")
    on = F.expr("a.tenant_id <=> b.tenant_id and a.label = b.label")
    keep = F.expr("b.label is null or (a.source = 'human' and b.source <> 'human')")
    pick = lambda c: F.when(keep & F.col("a.label").isNotNull(), F.col(f"a.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}")).alias(c)
    used = F.coalesce("a.usage_count", F.lit(0)) + F.col("b.label").isNotNull().cast("int")
    return a.join(b, on, "full_outer").select(F.coalesce("a.tenant_id", "b.tenant_id").alias("tenant_id"), F.coalesce("a.label", "b.label").alias("label"), pick("node"), pick("source"), used.alias("usage_count"))


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df over the partitions that it has rows of, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_new(df: DataFrame, path: str, *keys: str) -> None:
    """Appends the rows whose keys the table at path lacks."""
    known = df.sparkSession.read.parquet(path).select(*keys)
    df.join(known, [*keys], "left_anti").dropDuplicates([*keys]).write.mode("append").parquet(path)
