"""Addback suggestions, confidence decisions and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUTO_ACCEPT, REJECT = 0.75, 0.3


def suggest_addbacks(best: DataFrame, rules: DataFrame) -> DataFrame:
    """A suggestion for each best fact of a ruled node that is not zero; income-side nodes are negated."""
    found = best.join(F.broadcast(rules), "node").where("value_cents <> 0")
    return found.select(F.col("id").alias("fact_id"), "entity_id", "period_label", "category", (F.col("value_cents") * F.col("sign")).alias("amount_cents"))


def decision(auto_accept: Column, reject: float = REJECT) -> Column:
    one, two, sure = F.col("path1_cents"), F.col("path2_cents"), F.col("confidence") >= auto_accept
    return (
        F.when(F.col("gate_blocked"), "review")
        .when(one.isNull() & two.isNull(), F.when(F.col("confidence") < reject, "reject").when(sure, "auto_accept").otherwise("review"))
        .when(one.eqNullSafe(two) & sure, "auto_accept")
        .otherwise("review")
    )


def _with_confidence(signals: DataFrame) -> DataFrame:
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    return signals.withColumn("confidence", F.least(clamp("path1_confidence"), clamp("path2_confidence")))


def score_fields(signals: DataFrame, auto_accept: float = AUTO_ACCEPT) -> DataFrame:
    """signals with confidence, decision and agreed_absent."""
    out = _with_confidence(signals).withColumn("decision", decision(F.lit(auto_accept)))
    return out.withColumn("agreed_absent", ~F.col("gate_blocked") & F.col("path1_cents").isNull() & F.col("path2_cents").isNull())


def threshold_sweep(signals: DataFrame, spark: SparkSession) -> DataFrame:
    """Accepted fields at each threshold from 0.30 to 0.95; one pass, a row of counters for each threshold."""
    points = range(30, 100, 5)
    scored = _with_confidence(signals)
    accepted = lambda p: decision(F.lit(p / 100.0)) == "auto_accept"
    counts = scored.agg(
        F.count("*").alias("n"),
        *(F.count_if(accepted(p)).alias(f"a{p}") for p in points),
        *(F.count_if(accepted(p) & F.col("path1_cents").isNotNull()).alias(f"v{p}") for p in points),
    )
    rows = [F.struct(F.lit(p).alias("threshold_points"), F.col(f"a{p}").alias("accepted"), F.col(f"v{p}").alias("accepted_values"), "n") for p in points]
    return counts.select(F.inline(F.array(*rows)))
