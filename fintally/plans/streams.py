"""Queries that run a stream over events that come out of order, with SQL twins over all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.model import table
from fintally.streaming import events, limits, runs

BATCHES, LIMIT, HOURS = 4, 2, 12


def _arriving(df: DataFrame) -> DataFrame:
    """Rows with a batch: by time, but for those that come up to nine hours later."""
    late = F.to_timestamp(F.col("ts")) + F.make_dt_interval(hours=F.col("event_id") % 10)
    return df.withColumn("batch", F.least(F.floor(F.greatest(F.datediff(late, F.lit("2024-01-01")), F.lit(0)) * BATCHES / 31), F.lit(BATCHES - 1)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.drained(limits.rate_limited(runs.arrivals(_arriving(_events(spark, sf_dir)), BATCHES, "batch"), LIMIT, HOURS * 3600))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every third one is sent again with the next batch."""
    first = _arriving(_events(spark, sf_dir))
    again = first.where("event_id % 3 = 0").withColumn("batch", F.least(F.col("batch") + 1, F.lit(BATCHES - 1)))
    stream = runs.arrivals(first.unionByName(again), BATCHES, "batch")
    return runs.drained(events.once(stream, late="31 days")).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events start a run that the odd one after them may finish."""
    e = _arriving(_events(spark, sf_dir)).withColumn("run_id", F.col("event_id") - F.col("event_id") % 2)
    start, finish = (runs.arrivals(e.where(f"event_id % 2 = {k}").select("run_id", "ts", "batch"), BATCHES, "batch") for k in (0, 1))
    return runs.drained(events.without_follow_up(start, finish, "3 minutes", "1 day")).select("run_id")


QUERIES = {"r01_rate_limit": limited, "r03_intake_once": once, "r07_orphan_runs": orphans}
_MS = "epoch_ms(CAST(ts AS TIMESTAMP))"
ORACLES = {
    "r01_rate_limit": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w(user_id, p, opened, used) AS (SELECT user_id, p, us, 1 FROM e WHERE p = 1
  UNION ALL SELECT e.user_id, e.p, CASE WHEN us - opened >= {HOURS * 3600 * 1000000} THEN us ELSE opened END, CASE WHEN us - opened >= {HOURS * 3600 * 1000000} THEN 1 ELSE used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.p = w.p + 1)
SELECT e.user_id, event_id, used <= {LIMIT} AS allowed FROM e JOIN w ON w.user_id = e.user_id AND w.p = e.p WHERE us // 1000 < (SELECT max({_MS}) - 86400000 FROM events)""",
    "r03_intake_once": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "r07_orphan_runs": f"""SELECT event_id AS run_id FROM events s WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id = s.event_id + 1 AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 3 MINUTE)
AND {_MS} < (SELECT least(max({_MS}) FILTER (event_id % 2 = 0), max({_MS}) FILTER (event_id % 2 = 1)) - 86400000 - 180000 FROM events)""",
}
