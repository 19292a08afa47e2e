"""Queries of loan scenarios and line-by-line projections over lineitem, orders and customer, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.functions.money import from_double
from fintally.model import BEST_SQL, FACTS_SQL, half_even_sql, table
from fintally.operators import scenarios
from fintally.plans import underwriting

GROWTH = ((300, -150, 275), (0,))
KEYS = ("is.opex.rent", "is.opex.depreciation", "is.cogs", "is.other.interest_expense")
TREATMENTS = (None, None, "fixed", None, "excluded", "ratio")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight customers are a deal; its loan has no interest, and some are too small for a payment of a cent."""
    cells = underwriting.tall(spark, sf_dir).withColumn("deal_id", F.shiftright("entity_id", 3))
    d = F.col("deal_id")
    deals = table(spark, sf_dir, "customer").select(F.shiftright("c_custkey", 3).cast("long").alias("deal_id")).distinct().where(d % 11 != 5)
    loans = deals.select(
        "deal_id",
        F.when(d % 7 == 0, 5).otherwise(d * 1_000_003 + 90_000_000).cast("long").alias("principal_cents"),
        (d % 10 * 12 + 60).cast("int").alias("term_months"),
        F.array(F.struct(F.lit(1).alias("month"), F.lit(0).alias("bps"))).alias("steps"),
        (d % 5 * 3).cast("int").alias("interest_only"),
        F.when(d % 3 != 0, d * 100_000 + 7).alias("equity_injection_cents"),
        F.when(d % 4 != 0, d % 4 * 33_333_333).when(d % 8 == 0, 0).alias("project_cost_cents"),
        F.when(d % 2 == 0, 7500).alias("guaranty_bps"),
    )
    return scenarios.scenario_metrics(cells, loans)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of a customer's orders; those without an order have a base of 0."""
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.sum(from_double(F.col("o_totalprice"))).alias("r"))
    e = F.col("entity_id")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")).join(sums, "entity_id", "left").select(
        "entity_id", (e % 12 + 1).alias("months_covered"), F.coalesce("r", F.lit(0)).alias("revenue_cents"),
        F.when(e % 2 == 0, F.array(*map(F.lit, GROWTH[0]))).otherwise(F.array(*map(F.lit, GROWTH[1]))).alias("growth_bps"),
        F.when(e % 6 == 0, e * 1_000_001).alias("year1_revenue_cents"), F.when(e % 3 > 0, 8_500_000).alias("replacement_salary_cents"),
        F.when(e % 5 > 0, e % 5 * 1_234_567).when(e % 10 == 0, 0).alias("debt_service_cents"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each order of a customer, and one for each customer with a key beyond the others."""
    k = F.col("o_orderkey")
    key = F.concat(F.element_at(F.array(*map(F.lit, KEYS)), (k % 4 + 1).cast("int")), F.when(k % 4 % 2 == 0, F.concat(F.lit("."), k)).otherwise(""))
    treatment = F.element_at(F.array(*map(F.lit, TREATMENTS)), (F.shiftright(k, 2) % 6 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), k, key.alias("key"), F.floor(from_double(F.col("o_totalprice")) / 7).cast("long").alias("amount_cents"), treatment.alias("treatment"))
    alone = table(spark, sf_dir, "customer").where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("entity_id"), F.lit("is.opex.other").alias("key"), (F.col("c_custkey") * 1001).alias("amount_cents"), F.lit(None).cast("string").alias("treatment"))
    return orders.drop("o_orderkey").unionByName(alone)


QUERIES = {
    "e03_deal_metrics": _metrics,
    "e05_line_projection": lambda s, d: scenarios.projected_lines(_base(s, d), _lines(s, d)),
    "e05_year_projection": lambda s, d: scenarios.projected_years(_base(s, d), _lines(s, d)),
}

_ADS = f"12 * {half_even_sql('p', 'term - io')}"
_DEALS = f"""loan AS (SELECT d, CASE WHEN d % 7 = 0 THEN 5 ELSE d * 1000003 + 90000000 END AS p, d % 10 * 12 + 60 AS term, d % 5 * 3 AS io, CASE WHEN d % 3 <> 0 THEN d * 100000 + 7 END AS equity,
  CASE WHEN d % 4 <> 0 THEN d % 4 * 33333333 END AS cost FROM (SELECT DISTINCT c_custkey // 8 AS d FROM customer) WHERE d % 11 <> 5),
ads AS (SELECT *, {_ADS} AS ads FROM loan),
flow AS (SELECT d, entity_id, period_label, metric, cents, ads FROM tall JOIN ads ON entity_id // 8 = d WHERE metric IN ('cfads', 'personal_cash_flow') AND ads > 0)"""
_NONE = "NULL::BIGINT"
_ONE = lambda metric, value, scale, where="true": f"SELECT d AS deal_id, {_NONE} AS entity_id, NULL::VARCHAR AS period_label, '{metric}' AS metric, '{'cents' if scale is None else 'ratio'}' AS kind, {f'CAST({value} AS BIGINT)' if scale is None else _NONE} AS cents, {_NONE if scale is None else f'CAST({value} AS BIGINT)'} AS mantissa, {'NULL' if scale is None else scale}::INTEGER AS scale FROM ads WHERE {where}"
_STEP = lambda prev, bps: half_even_sql(f"CAST({prev} AS HUGEINT) * {10_000 + bps}", "10000")
_ORDER_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
_PROJECTED = f"""b AS (SELECT c_custkey AS e, c_custkey % 12 + 1 AS m, coalesce(r, 0) AS r FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum({_ORDER_CENTS}) AS BIGINT) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey),
y0 AS (SELECT *, {half_even_sql("CAST(r AS HUGEINT) * 12", "m")} AS v FROM b),
y1 AS (SELECT e, m, r, CASE WHEN e % 6 = 0 THEN e * 1000001 WHEN e % 2 = 0 THEN {_STEP("v", GROWTH[0][0])} ELSE v END AS v FROM y0),
y2 AS (SELECT e, m, r, {_STEP("v", GROWTH[0][1])} AS v FROM y1 WHERE e % 2 = 0), y3 AS (SELECT e, m, r, {_STEP("v", GROWTH[0][2])} AS v FROM y2),
years AS (SELECT 0 AS year, * FROM y0 UNION ALL SELECT 1, * FROM y1 UNION ALL SELECT 2, * FROM y2 UNION ALL SELECT 3, * FROM y3),
l AS (SELECT o_custkey AS e, {list(KEYS)}[o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 2 = 0 THEN '.' || o_orderkey ELSE '' END AS key, {_ORDER_CENTS} // 7 AS a,
  [{", ".join("NULL" if t is None else f"'{t}'" for t in TREATMENTS)}][o_orderkey // 4 % 6 + 1] AS t FROM orders UNION ALL SELECT c_custkey, 'is.opex.other', c_custkey * 1001, NULL FROM customer WHERE c_custkey % 9 > 0),
kept AS (SELECT e, key, a, coalesce(t, CASE WHEN key IN ({", ".join(f"'{k}'" for k in scenarios.EXCLUDED)}) THEN 'excluded' ELSE 'ratio' END) AS t FROM l),
amounts AS (SELECT e, year, key, CASE WHEN year = 0 OR t = 'fixed' THEN {half_even_sql("CAST(a AS HUGEINT) * 12", "m")} WHEN r = 0 THEN 0 ELSE {half_even_sql("CAST(a AS HUGEINT) * v", "nullif(r, 0)")} END AS amount FROM kept JOIN years USING (e) WHERE t <> 'excluded'),
totals AS (SELECT e, year, v, CAST(coalesce(spent, 0) AS BIGINT) AS spent, CAST(v - coalesce(spent, 0) - CASE WHEN e % 3 > 0 THEN 8500000 ELSE 0 END AS BIGINT) AS cfads, e % 5 * 1234567 AS owed FROM years LEFT JOIN (SELECT e, year, sum(amount) AS spent FROM amounts GROUP BY ALL) USING (e, year))"""
ORACLES = {
    "e03_deal_metrics": f"""WITH {FACTS_SQL},{BEST_SQL},{underwriting._METRICS_SQL},
{_DEALS} {_ONE("annual_debt_service", "ads", None)} UNION ALL {_ONE("loan_amount", "p", None)} UNION ALL {_ONE("term_months", "term", 0)}
UNION ALL {_ONE("equity_injection_pct", half_even_sql("equity * 10000", "cost"), 4, "cost > 0 AND equity IS NOT NULL")} UNION ALL {_ONE("sba_guaranty_pct", "7500", 4, "d % 2 = 0")}
UNION ALL SELECT d, entity_id, period_label, 'dscr_business', 'ratio', NULL, {half_even_sql("cents * 100", "ads")}, 2 FROM flow WHERE metric = 'cfads'
UNION ALL SELECT d, NULL, period_label, 'dscr_global', 'ratio', NULL, {half_even_sql("sum(cents) * 100", "any_value(ads)")}, 2 FROM flow GROUP BY d, period_label""",
    "e05_line_projection": f"WITH {_PROJECTED} SELECT e AS entity_id, CAST(year AS INTEGER) AS year, key, amount AS amount_cents FROM amounts",
    "e05_year_projection": f"WITH {_PROJECTED} SELECT e AS entity_id, CAST(year AS INTEGER) AS year, v AS revenue_cents, spent AS opex_cents, v - spent AS noi_cents, cfads AS cfads_cents, owed AS debt_service_cents, CASE WHEN owed > 0 THEN {half_even_sql('cfads * 100', 'owed')} END AS dscr_mantissa FROM totals",
}
