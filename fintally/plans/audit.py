"""Queries of the audit log over conversations, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fintally.model import table
from fintally.operators import audit

KEY = ["turn"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")


def _edited(turns: DataFrame) -> DataFrame:
    """The next version: every fifth turn gone, some texts longer, and a turn before the first one of every other conversation."""
    kept = turns.where("turn % 5 <> 4").withColumn("text", F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(' "!"\n'))).otherwise(F.col("text")))
    new = turns.where("turn = 0 and conv_id % 2 = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(None).cast("string").alias("text"))
    return kept.unionByName(new)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions' changes, the second ones chained to the first ones."""
    first = _turns(spark, sf_dir)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    begun = audit.appended(None, audit.changes(first.limit(0), first, "conv_id", KEY), KEY, "conversations", F.lit(None), at("2024-01-01 00:00:00"))
    edits = audit.changes(first, _edited(first), "conv_id", KEY)
    return begun.unionByName(audit.appended(begun, edits, KEY, "conversations", F.lit("editor"), at("2024-01-02 03:04:05.06")))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("tenant_id", "id", "actor_id", "action", "row_id", "before", "after", "payload", "prev_hash", "row_hash")


def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of a log that is whole for every fifth tenant; others have a changed payload, a lost row, or another hash in their middle."""
    log = _log(spark, sf_dir).select("tenant_id", "id", "payload", "prev_hash", "row_hash")
    n = F.count(F.lit(1)).over(Window.partitionBy("tenant_id"))
    middle, how = F.col("id") == F.floor(n / 2) + 1, F.col("tenant_id") % 5
    log = log.withColumn("hit", F.when(middle, how).otherwise(0)).where("hit <> 2")
    log = log.withColumn("payload", F.when(F.col("hit") == 1, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    log = log.withColumn("row_hash", F.when(F.col("hit") == 3, F.sha2("row_hash", 256)).otherwise(F.col("row_hash")))
    return audit.chain_breaks(log.withColumn("prev_hash", F.when(F.col("hit") == 4, F.lit(None)).otherwise(F.col("prev_hash"))))


QUERIES = {"e37_audit_log": captured, "w04_chain_breaks": breaks}

_JSON = "CAST(to_json({{'conv_id': conv_id, 'turn': turn, 'role': role, 'text': {t}}}) AS VARCHAR)"
_CHANGES = f"""v AS (SELECT conv_id, turn, min({_JSON.format(t="text")}) AS j, min({_JSON.format(t="CASE WHEN turn % 3 = 1 THEN text || ' \"!\"' || chr(10) ELSE text END")}) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, turn, 1 AS batch, 'INSERT' AS action, NULL AS before, j AS after FROM v
  UNION ALL SELECT conv_id, turn, 2, CASE WHEN turn % 5 = 4 THEN 'DELETE' ELSE 'UPDATE' END, j, CASE WHEN turn % 5 <> 4 THEN k END FROM v WHERE turn % 5 = 4 OR j <> k
  UNION ALL SELECT conv_id, -1, 2, 'INSERT', NULL, '{{"conv_id":' || conv_id || ',"turn":-1,"role":"system","text":null}}' FROM v WHERE turn = 0 AND conv_id % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY batch, turn) AS id, count(*) OVER (PARTITION BY conv_id) AS n FROM c)"""
_LOG = f"""{_CHANGES},
p AS (SELECT *, concat_ws('|', id, conv_id, CASE batch WHEN 1 THEN '' ELSE 'editor' END, action, 'conversations', turn, coalesce(before, ''), coalesce(after, ''),
  CASE batch WHEN 1 THEN '2024-01-01T00:00:00.000000Z' ELSE '2024-01-02T03:04:05.060000Z' END) AS payload FROM n),
h(conv_id, id, prev_hash, row_hash) AS (SELECT conv_id, id, CAST(NULL AS VARCHAR), sha256(payload) FROM p WHERE id = 1
  UNION ALL SELECT p.conv_id, p.id, h.row_hash, sha256(h.row_hash || p.payload) FROM h JOIN p ON p.conv_id = h.conv_id AND p.id = h.id + 1)"""
ORACLES = {
    "e37_audit_log": f"""WITH RECURSIVE {_LOG} SELECT p.conv_id AS tenant_id, p.id, CASE batch WHEN 2 THEN 'editor' END AS actor_id, action, CAST(turn AS VARCHAR) AS row_id, before, after, payload, prev_hash, row_hash
FROM p JOIN h ON h.conv_id = p.conv_id AND h.id = p.id""",
    # where a log was changed says where it breaks: at the row, or at the one behind a lost row
    "w04_chain_breaks": f"""WITH {_CHANGES}, t AS (SELECT DISTINCT conv_id, n, n // 2 + 1 AS p, conv_id % 5 AS how FROM n)
SELECT conv_id AS tenant_id, CASE how WHEN 2 THEN p + 1 ELSE p END AS broken_at, CASE WHEN how IN (1, 3) THEN 'row_hash' ELSE 'prev_hash' END AS reason
FROM t WHERE how IN (1, 3) OR how = 2 AND p < n OR how = 4 AND p > 1""",
}
