"""Queries of a policy pack over the metrics of each entity's last year, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.operators import policy
from fintally.operators.policy import Rule
from fintally.plans import underwriting
from fintally.plans.portfolio import case, case_sql

TYPES, USES, REVIEWS = ("acquisition", "refinance", None), (["real_estate"], ["working_capital", "equipment"], [], None), ("reviewed", "reviewed", "draft", "reviewed", None)
# An example pack with every kind of threshold and condition.
RULES = (
    Rule("liquid", "current_ratio", "gte", ratio=(1250, 3)),
    Rule("leverage", "debt_to_tnw", "lte", ratio=(4, 0), amount_gt=20_000_000),
    Rule("leverage_small", "debt_to_tnw", "lte", bps=55_000, amount_lte=20_000_000),
    Rule("cash", "cfads", "gte", cents=15_000_000, deal_types=("acquisition",)),
    Rule("profit", "net_income", "gte", cents=0, use_of_proceeds=("equipment", "real_estate")),
    Rule("months", "current_ratio", "lte", months=2, deal_types=("refinance", "acquisition"), amount_gt=5_000_000),
    Rule("same", "working_capital", "eq", cents=0),
    Rule("wrong_kind", "cfads", "gte", ratio=(1, 0)),
    Rule("absent", "no_such_metric", "gte", cents=1, amount_gt=30_000_000),
)


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct("kind", "cents", "mantissa", "scale")
    metrics = underwriting.tall(spark, sf_dir).groupBy("entity_id", "period_label").agg(F.map_from_entries(F.collect_list(F.struct("metric", value))).alias("metrics"))
    last = metrics.groupBy("entity_id").agg(F.max_by("metrics", "period_label").alias("metrics"))
    e = F.col("entity_id")
    uses = F.when(e % 4 == 0, F.array(*map(F.lit, USES[0]))).when(e % 4 == 1, F.array(*map(F.lit, USES[1]))).when(e % 4 == 2, F.array().cast("array<string>"))
    return last.select(e.alias("deal_id"), case(e, TYPES).alias("deal_type"), (e * 100_000).alias("amount_cents"), uses.alias("use_of_proceeds"), case(e, REVIEWS).alias("review_status"), "metrics")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.evaluated(_deals(spark, sf_dir), list(RULES))


QUERIES = {"e08_pack_rules": lambda s, d: policy.rule_results(_done(s, d)), "e08_pack_outcomes": lambda s, d: policy.outcomes(_done(s, d))}


def _sql(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else str(v)


def _row(r: Rule) -> str:
    ratio = r.ratio or (r.bps is not None and (r.bps, 4)) or (r.months is not None and (r.months, 0)) or (None, None)
    return "(" + ", ".join(map(_sql, (r.id, r.metric, r.op, *ratio, r.cents, r.deal_types, r.amount_lte, r.amount_gt, r.use_of_proceeds))) + ")"


_EVALUATED = f"""t AS ({underwriting.ORACLES["e02_core_metrics"]}),
d AS (SELECT entity_id AS e, max(period_label) AS y, {case_sql("entity_id", TYPES)} AS deal_type, entity_id * 100000 AS amount, {case_sql("entity_id", REVIEWS)} AS review,
  CASE entity_id % 4 WHEN 0 THEN ['real_estate'] WHEN 1 THEN ['working_capital', 'equipment'] WHEN 2 THEN [] END AS uses FROM t GROUP BY entity_id),
r(rule, metric, op, m, s, c, types, lte, gt, for_uses) AS (VALUES {", ".join(map(_row, RULES))}),
a AS (SELECT d.e, r.*, t.kind, CASE t.kind WHEN 'cents' THEN t.cents ELSE t.mantissa END AS have, CASE t.kind WHEN 'cents' THEN 0 ELSE t.scale END AS hs,
  CASE t.kind WHEN 'cents' THEN r.c WHEN 'ratio' THEN r.m END AS want, CASE t.kind WHEN 'cents' THEN 0 WHEN 'ratio' THEN r.s END AS ws
  FROM d JOIN r ON (types IS NULL OR coalesce(list_contains(types, deal_type), false)) AND (lte IS NULL OR amount <= lte) AND (gt IS NULL OR amount > gt) AND (for_uses IS NULL OR coalesce(list_has_any(for_uses, uses), false))
  LEFT JOIN t ON t.entity_id = d.e AND t.period_label = d.y AND t.metric = r.metric),
g AS (SELECT *, CASE WHEN want IS NOT NULL AND have IS NOT NULL THEN greatest(hs, ws) END AS gs FROM a),
v AS (SELECT *, CAST(have AS HUGEINT) * CAST(10 ** (gs - hs) AS HUGEINT) - CAST(want AS HUGEINT) * CAST(10 ** (gs - ws) AS HUGEINT) AS diff FROM g),
z AS (SELECT e AS deal_id, rule, metric, CASE WHEN diff IS NULL THEN 'not_evaluable' WHEN op = 'gte' AND diff >= 0 OR op = 'lte' AND diff <= 0 OR op = 'eq' AND diff = 0 THEN 'pass' ELSE 'fail' END AS status,
  CAST(CASE op WHEN 'lte' THEN -diff ELSE diff END AS DECIMAL(38,0)) AS margin, CAST(gs AS INTEGER) AS margin_scale FROM v)"""
ORACLES = {
    "e08_pack_rules": f"WITH {_EVALUATED} SELECT * FROM z",
    "e08_pack_outcomes": f"""WITH {_EVALUATED} SELECT e AS deal_id, coalesce(review = 'reviewed', false) AS certifiable,
  CASE WHEN coalesce(review, '') <> 'reviewed' THEN 'not_certifiable' WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'not_evaluable') THEN 'incomplete' ELSE 'pass' END AS overall
FROM d LEFT JOIN z ON z.deal_id = d.e GROUP BY e, review""",
}
