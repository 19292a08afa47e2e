"""Streaming analogues over an event stream: intake without repeats, daily windows, runs without follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events, errors and cents of each day; a day is given out when the watermark passes it."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    out = per.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("cents").alias("cents"))
    return out.select(F.to_date("w.start").cast("string").alias("day"), "n", "errors", "cents")


def without_follow_up(started: DataFrame, finished: DataFrame, grace: str = "3 minutes", late: str = "1 minute") -> DataFrame:
    """Runs that no finish follows within the grace time: a left outer join of two streams by watermark."""
    a = started.select(F.col("run_id"), F.col("ts").alias("began")).withWatermark("began", late)
    b = finished.select(F.col("run_id").alias("done_id"), F.col("ts").alias("ended")).withWatermark("ended", late)
    on = F.expr(f"run_id = done_id and ended >= began and ended <= began + interval {grace}")
    return a.join(b, on, "left_outer").where("done_id is null").select("run_id", "began")
