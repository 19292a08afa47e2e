"""Queries of the recompute of changed deals over lineitem and orders, with SQL twins that recompute everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.model import addbacks, facts
from fintally.operators import gates, ledger, recompute
from fintally.plans.underwriting import ORACLES as _UNDERWRITING

#: Replacement salaries of the scenarios, in cents; the first one is the run without a scenario.
SALARIES = {"none": 0, "salary": 8_500_000}
NOW = "2024-02-01 00:00:00"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts before and after: some deals' values differ, some have rejected facts, some have none left; a deal is an entity here."""
    f = facts(spark, sf_dir, by_entity=True).withColumn("deal_id", F.col("entity_id"))
    e = F.col("entity_id")
    value = F.when((e % 10 == 3) & (F.col("document_id") % 2 == 0), F.col("value_cents") + 12_345).otherwise(F.col("value_cents"))
    status = F.when((e % 10 == 7) & F.col("node").startswith("is."), F.lit("rejected")).otherwise(F.col("status"))
    return f, f.where(e % 25 != 4).withColumn("value_cents", value).withColumn("status", status)


def _scenarios(spark: SparkSession, sf_dir: str) -> dict:
    extra = addbacks(spark, sf_dir)

    def run(salary: int):
        def metrics(f: DataFrame) -> DataFrame:
            best = ledger.best_facts(f.where("status = 'accepted'"))
            return ledger.metrics(ledger.ledger(best), extra, replacement_salary_cents=salary).withColumn("deal_id", F.col("entity_id"))

        return metrics

    return {name: run(salary) for name, salary in SALARIES.items()}


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _versions(spark, sf_dir)
    runs = _scenarios(spark, sf_dir)
    deals = recompute.changed_deals(before, after, ["id"])
    out = recompute.recomputed(recompute.computed(before, runs), after, deals, runs)
    return out.select("scenario_id", "entity_id", "period_label", "metric", "kind", "cents", "mantissa", "scale")


def _identity(f: DataFrame) -> DataFrame:
    return gates.identity(ledger.best_facts(f.where("status <> 'rejected'"))).withColumn("deal_id", F.col("entity_id"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _versions(spark, sf_dir)
    deals = recompute.changed_deals(before, after, ["id"])
    stored = _identity(before).withColumn("status", F.lit("open")).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    fresh = _identity(after.join(deals, "deal_id", "left_semi"))
    out = recompute.synced_issues(stored, fresh, deals, F.lit(NOW).cast("timestamp_ntz"))
    return out.drop("deal_id").withColumn("resolved_at", F.col("resolved_at").cast("string"))


QUERIES = {"e29_recompute": metrics, "e29_issue_sync": issues}

_EDITED = """ranked AS (SELECT * REPLACE (CASE WHEN entity_id % 10 = 3 AND document_id % 2 = 0 THEN value_cents + 12345 ELSE value_cents END AS value_cents,
  CASE WHEN entity_id % 10 = 7 AND node LIKE 'is.%' THEN 'rejected' ELSE status END AS status) FROM ranked0 WHERE entity_id % 25 <> 4),"""
_after = lambda sql: sql.replace("ranked AS (", "ranked0 AS (", 1).replace("addbacks AS (", f"{_EDITED}\naddbacks AS (", 1)
_E02, _E12 = _UNDERWRITING["e02_core_metrics"], _UNDERWRITING["e12_gate_identity"]
_SALARY = SALARIES["salary"]
ORACLES = {
    "e29_recompute": f"""WITH t AS ({_after(_E02)}) SELECT 'salary' AS scenario_id, * FROM t
UNION ALL SELECT 'none', * REPLACE (CASE WHEN metric = 'cfads' THEN cents + {_SALARY} ELSE cents END AS cents) FROM t""",
    "e29_issue_sync": f"""WITH a AS ({_E12}), b AS ({_after(_E12)}), hit AS (SELECT DISTINCT entity_id FROM (
  SELECT entity_id, l_suppkey, l_partkey FROM (SELECT o_custkey AS entity_id, l_suppkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE entity_id % 25 = 4 OR entity_id % 10 = 3 AND l_suppkey % 2 = 0) UNION SELECT entity_id FROM ({{changed}}))
SELECT *, CASE WHEN entity_id IN (FROM hit) THEN 'resolved' ELSE 'open' END AS status, CASE WHEN entity_id IN (FROM hit) THEN '{NOW}' END AS resolved_at FROM a
UNION ALL SELECT *, 'open', NULL FROM b WHERE entity_id IN (FROM hit)""".replace(
        "{changed}", _after(_E12).split("best AS (", 1)[0].rstrip().rstrip(",") + " SELECT entity_id FROM ranked0 WHERE entity_id % 10 = 7 AND node LIKE 'is.%' AND status <> 'rejected'"
    ),
}
