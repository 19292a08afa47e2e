"""The audit log: changes between two versions of a table, and a chain of hashes for each tenant.

A change feed is one full outer join. A chain is sequential by nature: a tenant's rows are sorted within one task and
read as a stream, of which the task holds the last hash only; tenants share no order and go to tasks by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(before: DataFrame, after: DataFrame, tenant: str, key: list[str]) -> DataFrame:
    """tenant_id, the key, action (INSERT, UPDATE, DELETE), before, after (JSON of the whole row) of each row that differs.

    A row is known by tenant and key, nulls included; of several rows of one key in a version the least JSON stands.
    """
    names = [tenant, *key]
    whole = F.to_json(F.struct(*after.columns), {"ignoreNullFields": "false"})
    old, new = (df.select(*after.columns).groupBy(*names).agg(F.min(whole).alias(side)) for df, side in ((before, "before"), (after, "after")))
    o = old.select(*(F.col(n).alias(f"_{n}") for n in names), "before")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    both = new.join(o, same, "full")
    picked = [F.when(F.col("after").isNull(), F.col(f"_{n}")).otherwise(F.col(n)).alias("tenant_id" if n == tenant else n) for n in names]
    action = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*picked, action.alias("action"), "before", "after")


def utc_text(at: Column) -> Column:
    """A TIMESTAMP_NTZ that holds UTC, with microseconds: no session setting changes it."""
    text = at.cast("string")
    return F.concat(F.translate(F.substring(text, 1, 19), " ", "T"), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z"))


def payload() -> Column:
    """What a log row commits to: its columns in a fixed order, joined by bars; nulls of actor, before and after are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", F.col("id").cast("string"), F.col("tenant_id").cast("string"), empty("actor_id"), "action", "table_name", "row_id", empty("before"), empty("after"), utc_text(F.col("created_at")))


def heads(log: DataFrame) -> DataFrame:
    """tenant_id, id and row_hash of each tenant's last row."""
    return log.groupBy("tenant_id").agg(F.max(F.struct("id", "row_hash")).alias("last")).select("tenant_id", "last.id", "last.row_hash")


def chained(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """rows (tenant_id, id, payload and others) with prev_hash and row_hash, in order of id.

    row_hash is the SHA-256 of the one before it and the payload; a tenant's first row has none before it, or the one of
    last (heads of the log that is carried on).
    """
    names = [c for c in rows.columns if c not in ("prev_hash", "row_hash")]
    given = rows.select(*names)
    if last is None:
        given = given.withColumn("_head", F.lit(None).cast("string"))
    else:
        # joined and not unioned: a union of inputs that are each dealt by tenant passes for dealt by tenant itself, and its
        # inputs' partitions are coalesced apart, so that a tenant's rows could be in two tasks
        begun = last.select(F.col("tenant_id").alias("_t"), F.col("row_hash").alias("_head"))
        given = given.join(begun, F.col("tenant_id").eqNullSafe(F.col("_t")), "left").drop("_t")
    fields = [given.schema[c] for c in names]
    schema = type(given.schema)(fields).add("prev_hash", "string").add("row_hash", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, held = object(), None
        for batch in batches:
            previous, own = [], []
            for t, text, head in zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "payload", "_head")), strict=True):
                if t != tenant:
                    tenant, held = t, head
                previous.append(held)
                held = hashlib.sha256(((held or "") + (text or "")).encode()).hexdigest()
                own.append(held)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(previous, pa.string()), pa.array(own, pa.string())], names=schema.fieldNames())

    ordered = given.repartition("tenant_id").sortWithinPartitions("tenant_id", "id")
    return ordered.mapInArrow(run, schema)


def appended(log: DataFrame | None, changed: DataFrame, key: list[str], table: str, actor: Column, at: Column) -> DataFrame:
    """Log rows of a change feed, numbered in order of the key behind each tenant's last one and chained to it."""
    last = heads(log) if log is not None else None
    number = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*key)).cast("long")
    rows = changed.withColumn("_n", number)
    if last is not None:
        rows = rows.join(last.select(F.col("tenant_id").alias("_t"), F.col("id").alias("_last")), F.col("tenant_id").eqNullSafe(F.col("_t")), "left")
        rows = rows.withColumn("_n", F.col("_n") + F.coalesce("_last", F.lit(0)))
    rows = rows.select("tenant_id", F.col("_n").alias("id"), actor.cast("string").alias("actor_id"), "action", F.lit(table).alias("table_name"), F.concat_ws("/", *(F.col(k).cast("string") for k in key)).alias("row_id"), "before", "after", at.alias("created_at"))
    return chained(rows.withColumn("payload", payload()), last)


def chain_breaks(log: DataFrame) -> DataFrame:
    """tenant_id, broken_at, reason: each tenant's first row whose prev_hash is not the hash stored before it, or whose row_hash is not that of its payload.

    log: tenant_id, id, payload, prev_hash, row_hash.
    """
    checked = log.withColumn("_prev", F.lag("row_hash").over(Window.partitionBy("tenant_id").orderBy("id")))
    own = F.sha2(F.concat(F.coalesce("_prev", F.lit("")), F.coalesce("payload", F.lit(""))), 256)
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("_prev")), "prev_hash").when(~F.col("row_hash").eqNullSafe(own), "row_hash")
    broken = checked.withColumn("reason", reason).where("reason is not null")
    return broken.groupBy("tenant_id").agg(F.min(F.struct("id", "reason")).alias("b")).select("tenant_id", F.col("b.id").alias("broken_at"), "b.reason")
