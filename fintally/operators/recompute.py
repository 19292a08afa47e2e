"""Recompute of the deals whose facts changed, and of nothing else.

A change feed of two versions of the facts names the deals; metrics are computed for each scenario from these deals'
facts alone, and replace their partitions. Open issues of these deals are resolved, the fresh ones added as open.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fintally.operators.audit import changes

PARTITIONS = ("deal_id", "scenario_id")


def changed_deals(before: DataFrame, after: DataFrame, key: list[str], deal: str = "deal_id") -> DataFrame:
    """deal_id of each deal with a fact that came, went or changed: the deals of the change feed of both versions.

    Rows are compared as they are, the least of several of a key. They are grouped and joined by deal and key, which
    needs no shuffle where the facts are dealt by deal. Rows without a deal are compared by the feed itself.
    """
    row = F.struct(*after.columns)
    old, new = (df.select(*after.columns).where(F.col(deal).isNotNull()).groupBy(deal, *key).agg(F.min(row).alias(side)) for df, side in ((before, "before"), (after, "after")))
    o = old.select(*(F.col(n).alias(f"_{n}") for n in (deal, *key)), "before")
    same = F.col(deal) == F.col(f"_{deal}")
    for n in key:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    both = new.join(o, same, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    known = both.select(F.coalesce(deal, f"_{deal}").alias("deal_id")).distinct()
    none = changes(*(df.where(F.col(deal).isNull()) for df in (before, after)), deal, key)
    return known.unionByName(none.select(F.col("tenant_id").alias("deal_id")).distinct())


def computed(facts: DataFrame, scenarios: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Metrics of facts (deal_id, ...) under each scenario, with scenario_id. A deal has them in every scenario."""
    return reduce(DataFrame.unionByName, (f(facts).withColumn("scenario_id", F.lit(name)) for name, f in scenarios.items()))


def recomputed(stored: DataFrame, facts: DataFrame, deals: DataFrame, scenarios: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The stored metrics with those of deals replaced: what a recompute of all facts would give."""
    fresh = computed(facts.join(deals, "deal_id", "left_semi"), scenarios)
    return stored.join(deals, "deal_id", "left_anti").unionByName(fresh)


def replace_partitions(fresh: DataFrame, deals: DataFrame, scenarios: list[str], path: str) -> None:
    """Writes fresh metrics over the partitions (deal_id, scenario_id) of deals; other partitions' files are not touched.

    A deal without a metric gets one row without one, as a partition that gets no row would keep its old files.
    """
    marks = deals.select("deal_id", F.explode(F.array(*map(F.lit, scenarios))).alias("scenario_id"))
    empty = marks.join(fresh.select(*PARTITIONS).distinct(), [*PARTITIONS], "left_anti")
    rows = fresh.unionByName(empty, allowMissingColumns=True)
    # the rows of a partition in one file
    rows.repartition(*PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def stored_metrics(partitions: DataFrame) -> DataFrame:
    """The metrics of a table that replace_partitions wrote."""
    return partitions.where("metric is not null")


def synced_issues(issues: DataFrame, fresh: DataFrame, deals: DataFrame, now: Column) -> DataFrame:
    """issues (deal_id, ..., status, resolved_at) after a recompute: the open ones of deals resolved, fresh ones open. None goes."""
    marked = issues.join(deals.withColumn("_hit", F.lit(True)), "deal_id", "left")
    closes = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "open")
    done = marked.withColumn("resolved_at", F.when(closes, now).otherwise(F.col("resolved_at"))).withColumn("status", F.when(closes, "resolved").otherwise(F.col("status"))).drop("_hit")
    return done.unionByName(fresh.withColumn("status", F.lit("open")).withColumn("resolved_at", F.lit(None).cast(issues.schema["resolved_at"].dataType)))
