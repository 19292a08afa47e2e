"""Queries of reconciliation, write planning, policy, evaluation, spans and selections, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.functions.money import from_double
from fintally.model import BEST_SQL, FACTS_SQL, NODES, facts, half_even_sql, table
from fintally.operators import workflow
from fintally.plans import underwriting

DEBT_SERVICE = 12_000_000
# Rules of the example policy (id, metric, operator, threshold, most loan amount in cents).
RULES = (
    ("least_cash_flow", "cfads", "gte", 5_000_000, None),
    ("least_worth", "tangible_net_worth", "gte", 0, 20_000_000),
    ("most_personal_income", "personal_income_total", "lte", 9_000_000, None),
    ("no_goodwill_gap", "working_capital", "eq", 0, None),
)


def _path(spark: SparkSession, sf_dir: str, skipped: int, changed: int) -> DataFrame:
    """A reading of the total of each order: absent for some keys, another value for some, unreadable for some."""
    k = F.col("o_orderkey")
    cents = from_double(F.col("o_totalprice")) + F.when(k % changed == 0, 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").where(k % skipped != 0)
    return rows.select(F.col("o_custkey").alias("document_id"), k.alias("field"), cents.alias("cents"), (k % 17 != skipped).alias("readable"))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("field"))
    return workflow.reconcile(fields, _path(spark, sf_dir, 7, 1_000_003), _path(spark, sf_dir, 11, 5))


def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    live = table(spark, sf_dir, "orders").where(k % 3 != 0).select(
        F.col("o_custkey").alias("document_id"), k.alias("field"), F.concat(F.lit("f"), k).alias("fact_id"),
        (from_double(F.col("o_totalprice")) + F.when(k % 4 == 0, 100).otherwise(0)).alias("value_cents"), (k % 13 == 0).alias("human"),
    )
    return workflow.plan_writes(reconciled(spark, sf_dir), live)


def deal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deal for each entity: its loan amount, and the greatest value of each metric in cents."""
    per = underwriting.tall(spark, sf_dir).where("kind = 'cents'").groupBy("entity_id", "metric").agg(F.max("cents").alias("cents"))
    maps = per.groupBy(F.col("entity_id").alias("deal_id")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "cents"))).alias("metrics"))
    return maps.select("deal_id", (F.col("deal_id") % 10 * 5_000_000).alias("amount"), "metrics")


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.evaluate_policy(deal_metrics(spark, sf_dir), list(RULES))


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fields are the accepted facts, extracted ones those not rejected, by document, node and period."""
    f = facts(spark, sf_dir).select("document_id", "node", "period_label", "status", "value_cents")
    return workflow.score_extraction(f.where("status = 'accepted' and value_cents % 5 <> 0"), f.where("status <> 'rejected' and value_cents % 7 <> 0"), ["document_id", "node", "period_label"])


def bundle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each customer, a page for each order in key order; every fourth page is unresolved."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), k.alias("page"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("family"))


def dated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    year = F.when(k % 3 == 0, F.year("o_orderdate"))
    return workflow.inherit_year(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), k.alias("span"), year.alias("tax_year")))


def used_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.ancestors(underwriting.best(spark, sf_dir).where("value_cents > 0"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.trailing_load(table(spark, sf_dir, "events"), "user_id", "ts", 3600, 1)


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    sent = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    return workflow.digest(sent, asked, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ["error"])


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.element_at(F.array(*map(F.lit, (*workflow.DEAL_STATES, "unknown"))), (F.col("event_id") % 6 + 1).cast("int"))
    return workflow.furthest_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("deal_id"), step.alias("state")))


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against type names of the same part."""
    points = workflow.name_points(F.lower("p_name"), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", points.alias("points")).select("p_partkey", "points", workflow.band(F.col("points")).alias("band"))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open issues, and cash flow of the latest period that has any, of each deal (entity)."""
    issues = underwriting.all_issues(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("issues"))
    latest = underwriting.tall(spark, sf_dir).where("metric = 'cfads'").groupBy("entity_id").agg(F.max("period_label").alias("latest"), F.max_by("cents", "period_label").alias("cfads"))
    deals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    return deals.join(issues, "entity_id", "left").join(latest, "entity_id", "left").na.fill(0, ["issues"])


QUERIES = {
    "e19_reconcile": reconciled,
    "e20_write_plan": write_plan,
    "e03_scenario_metrics": lambda s, d: workflow.scenario_metrics(underwriting.tall(s, d), DEBT_SERVICE),
    "e08_policy": policy,
    "e08_policy_outcome": lambda s, d: workflow.policy_outcome(policy(s, d)),
    "j18_extraction_scores": extraction_scores,
    "t07_page_spans": lambda s, d: workflow.page_spans(bundle_pages(s, d)),
    "t08_bundle_years": dated_spans,
    "e27_used_nodes": used_nodes,
    "r02_trailing_load": peaks,
    "a25_digests": digests,
    "e38_deal_states": states,
    "t19_name_matches": name_matches,
    "a09_board": board,
}

_H = f"WITH {FACTS_SQL},{BEST_SQL}"
_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
_RECONCILED = f"""r0 AS (SELECT o_custkey AS document_id, o_orderkey AS field,
  CASE WHEN o_orderkey % 7 <> 0 THEN {_CENTS} + CASE WHEN o_orderkey % 1000003 = 0 THEN 1 ELSE 0 END END AS path1_cents,
  CASE WHEN o_orderkey % 11 <> 0 THEN {_CENTS} + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS path2_cents FROM orders),
reconciled AS (SELECT *, CASE WHEN (path1_cents IS NOT NULL AND field % 17 = 7) OR (path2_cents IS NOT NULL AND field % 17 = 11) THEN 'unreadable' WHEN path1_cents IS NULL AND path2_cents IS NULL THEN 'consensus_absent'
  WHEN path1_cents IS NULL OR path2_cents IS NULL THEN 'single_source' WHEN path1_cents = path2_cents THEN 'consensus' ELSE 'disagreement' END AS outcome FROM r0)"""
_MARGIN = {"gte": "{m} - {t}", "lte": "{t} - {m}", "eq": "-abs({m} - {t})"}
_POLICY = f"""deals AS (SELECT DISTINCT entity_id AS deal_id, entity_id % 10 * 5000000 AS amount FROM tall WHERE kind = 'cents'),
margins AS ({" UNION ALL ".join(f"SELECT deal_id, '{n}' AS rule, CAST({_MARGIN[o].format(m='m', t=t)} AS BIGINT) AS margin FROM deals LEFT JOIN (SELECT entity_id AS deal_id, max(cents) AS m FROM tall WHERE metric = '{c}' GROUP BY entity_id) USING (deal_id) {f'WHERE amount <= {most}' if most is not None else ''}" for n, c, o, t, most in RULES)}),
evaluated AS (SELECT deal_id, rule, CASE WHEN margin IS NULL THEN 'not_evaluable' WHEN margin >= 0 THEN 'pass' ELSE 'fail' END AS status, margin FROM margins)"""
_PREFIXES = sorted({".".join(n.split(".")[:k]) for n in NODES for k in range(1, n.count(".") + 2)})
ORACLES = {
    "e19_reconcile": f"WITH {_RECONCILED} SELECT * FROM reconciled",
    "e20_write_plan": f"""WITH {_RECONCILED}, live AS (SELECT o_orderkey AS field, 'f' || o_orderkey AS fact_id, {_CENTS} + CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END AS value_cents, o_orderkey % 13 = 0 AS human FROM orders WHERE o_orderkey % 3 <> 0),
p AS (SELECT r.*, fact_id, CASE WHEN coalesce(human, false) THEN 'human_decided' WHEN outcome = 'consensus_absent' THEN 'nothing' WHEN outcome <> 'consensus' THEN 'review' WHEN path1_cents = value_cents THEN 'unchanged' WHEN fact_id IS NULL THEN 'insert' ELSE 'supersede' END AS action FROM reconciled r LEFT JOIN live USING (field))
SELECT document_id, field, action, CASE WHEN action IN ('insert', 'supersede') THEN path1_cents END AS new_cents, CASE WHEN action = 'supersede' THEN fact_id END AS superseded_id FROM p""",
    "e03_scenario_metrics": f"""{_H},{underwriting._METRICS_SQL}, every AS (SELECT period_label, sum(cents) AS c FROM tall WHERE metric IN ('cfads', 'personal_cash_flow') GROUP BY period_label)
SELECT entity_id, period_label, 'dscr_business' AS metric, {half_even_sql("cents * 100", str(DEBT_SERVICE))} AS mantissa FROM tall WHERE metric = 'cfads'
UNION ALL SELECT NULL, period_label, 'dscr_global', {half_even_sql("c * 100", str(DEBT_SERVICE))} FROM every""",
    "e08_policy": f"{_H},{underwriting._METRICS_SQL},\n{_POLICY} SELECT * FROM evaluated",
    "e08_policy_outcome": f"{_H},{underwriting._METRICS_SQL},\n{_POLICY} SELECT deal_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'not_evaluable') THEN 'incomplete' ELSE 'pass' END AS overall, count(*) FILTER (status = 'pass') AS passed FROM evaluated GROUP BY deal_id",
    "j18_extraction_scores": f"""{_H}, w AS (SELECT document_id, node, period_label, sum(value_cents) AS v FROM ranked WHERE status = 'accepted' AND value_cents % 5 <> 0 GROUP BY ALL),
g AS (SELECT document_id, node, period_label, sum(value_cents) AS v FROM ranked WHERE status <> 'rejected' AND value_cents % 7 <> 0 GROUP BY ALL)
SELECT CASE WHEN g.document_id IS NULL THEN 'missed' WHEN w.document_id IS NULL THEN 'spurious' WHEN w.v = g.v THEN 'correct' ELSE 'wrong' END AS verdict, count(*) AS n
FROM w FULL JOIN g ON w.document_id = g.document_id AND w.node = g.node AND w.period_label = g.period_label GROUP BY 1""",
    "t07_page_spans": """WITH p AS (SELECT o_custkey AS b, o_orderkey AS page, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS f FROM orders),
known AS (SELECT *, lag(f) OVER (PARTITION BY b ORDER BY page) AS prev FROM p WHERE f IS NOT NULL), starts AS (SELECT b, page, f FROM known WHERE prev IS NULL OR prev <> f),
n AS (SELECT p.*, (SELECT count(*) FROM starts s WHERE s.b = p.b AND s.page <= p.page) AS span FROM p)
SELECT b AS bundle_id, span, min(page) AS page_start, max(page) AS page_end, max(f) AS family FROM n GROUP BY b, span""",
    "t08_bundle_years": """WITH s AS (SELECT o_custkey AS bundle_id, o_orderkey AS span, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END AS y FROM orders), u AS (SELECT bundle_id, min(y) AS y FROM s GROUP BY bundle_id HAVING count(DISTINCT y) = 1)
SELECT s.bundle_id, span, CAST(coalesce(s.y, u.y) AS INTEGER) AS tax_year FROM s LEFT JOIN u USING (bundle_id)""",
    "e27_used_nodes": f"{_H}, k(key) AS (VALUES {', '.join(f"('{p}')" for p in _PREFIXES)}), u AS (SELECT DISTINCT node FROM best WHERE value_cents > 0) SELECT key, CAST(length(key) - length(replace(key, '.', '')) AS INTEGER) AS depth, count(*) AS n_below FROM u JOIN k ON node = key OR starts_with(node, key || '.') GROUP BY key",
    "r02_trailing_load": """WITH s AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS load FROM events WHERE ts IS NOT NULL)
SELECT user_id, max(load) AS peak FROM s GROUP BY user_id HAVING max(load) > 1""",
    "a25_digests": "SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type <> 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY user_id",
    "e38_deal_states": f"SELECT user_id AS deal_id, {list(workflow.DEAL_STATES)}[max(event_id % 6) + 1] AS state FROM events WHERE event_id % 6 < 5 GROUP BY user_id",
    "a09_board": f"""{_H},{underwriting._METRICS_SQL},\n{underwriting._ISSUES}, i AS (SELECT entity_id, count(*) AS issues FROM issues GROUP BY ALL), l AS (SELECT entity_id, max(period_label) AS latest, max_by(cents, period_label) AS cfads FROM tall WHERE metric = 'cfads' GROUP BY ALL)
SELECT c_custkey AS entity_id, coalesce(issues, 0) AS issues, latest, cfads FROM customer LEFT JOIN i ON c_custkey = i.entity_id LEFT JOIN l ON c_custkey = l.entity_id""",
    "t19_name_matches": """WITH n AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part),
j AS (SELECT p_partkey, jaro_similarity(a, b) AS jaro, CASE WHEN a[1] IS DISTINCT FROM b[1] OR a = '' OR b = '' THEN 0 WHEN a[2] <> b[2] OR least(length(a), length(b)) < 2 THEN 1
  WHEN a[3] <> b[3] OR least(length(a), length(b)) < 3 THEN 2 WHEN a[4] <> b[4] OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS prefix FROM n WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT p_partkey, CAST(round_even((jaro + prefix * 0.1 * (1 - jaro)) * 10000, 0) AS INTEGER) AS points FROM j)
SELECT p_partkey, points, CASE WHEN points >= 9200 THEN 'high' WHEN points >= 7200 THEN 'mid' ELSE 'low' END AS band FROM part LEFT JOIN s USING (p_partkey)""",
}
