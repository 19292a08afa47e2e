"""Queries of the fact ledger, metrics, gates, addbacks and confidence, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.model import ADDBACK_RULES, BEST_SQL, FACTS_SQL, NODES, addbacks, facts, half_even_sql
from fintally.operators import gates, ledger, scoring

# Relations of nodes that stand for registry relations and flows (spec, kind, result, operands, tolerance, years).
SPECS = (
    ("opex_parts", "sum", "is.opex.total", ["is.opex.depreciation", "is.opex.amortization"], 100, None),
    ("gross", "difference", "is.gross_profit", ["is.revenue.total", "is.cogs.total"], 200, [1996, 1997, 1998]),
    ("income_flow", "flow", "is.net_income", ["pcf.income.wages"], 500, None),
)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.best_facts(facts(spark, sf_dir, by_entity=True).where("status = 'accepted'"))


def open_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.best_facts(facts(spark, sf_dir, by_entity=True).where("status <> 'rejected'"))


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.metrics(ledger.ledger(best(spark, sf_dir)), addbacks(spark, sf_dir), replacement_salary_cents=8_500_000)


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*SPECS], "spec string, kind string, result string, operands array<string>, tolerance_cents long, years array<int>")


def all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.run(facts(spark, sf_dir, by_entity=True), open_best(spark, sf_dir), NODES, specs(spark))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.suggest_addbacks(best(spark, sf_dir), spark.createDataFrame([*ADDBACK_RULES], "node string, category string, sign int"))


def new_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = addbacks(spark, sf_dir).select("entity_id", "period_label", "category").distinct()
    return suggestions(spark, sf_dir).join(known, ["entity_id", "period_label", "category"], "left_anti")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each lineitem row: the second differs, or one is absent, by fixed rules on the keys."""
    f = facts(spark, sf_dir)
    k = F.col("document_id") + F.col("value_cents")
    return f.select(
        F.col("id").alias("fact_id"),
        F.when(k % 7 != 0, F.col("value_cents")).alias("path1_cents"),
        F.when(k % 11 != 0, F.col("value_cents") + F.when(k % 5 == 0, 1).otherwise(0)).alias("path2_cents"),
        (F.pmod(k, F.lit(101)) / 100.0).alias("path1_confidence"),
        (F.pmod(k * 3, F.lit(101)) / 100.0).alias("path2_confidence"),
        (k % 13 == 0).alias("gate_blocked"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score_fields(signals(spark, sf_dir))
    return out.groupBy("decision", "agreed_absent").agg(F.count("*").alias("n"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("confidence_points"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.threshold_sweep(signals(spark, sf_dir), spark)


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity and node, a column for each fiscal year of its SQL twin: accepted facts only (see spread_cells)."""
    cells = best(spark, sf_dir).groupBy("entity_id", "node").pivot("period_label", [f"FY{y}" for y in range(1995, 2002)]).agg(F.max("value_cents"))
    return cells


def spread_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole spread in long rows: accepted facts before suggested ones, every period found."""
    return ledger.spread(facts(spark, sf_dir))


def verified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06: whether all values of a cell with a transcript equal it, in distinct values."""
    f = facts(spark, sf_dir).where("status <> 'rejected'")
    return f.groupBy("entity_id", "period_label", "node").agg(F.size(F.collect_set("value_cents")).cast("long").alias("n_values"), F.max((F.col("method") == "transcript").cast("int")).alias("has_transcript"))


_WIDE = ",\n".join(f"max(CASE WHEN node = '{n}' THEN value_cents END) AS \"{n}\"" for n in NODES)


def _section_sql(prefix: str) -> str:
    below = [f'"{n}"' for n in NODES if n.startswith(prefix + ".") and n != prefix + ".total"]
    total = f'"{prefix}.total"' if f"{prefix}.total" in NODES else "NULL"
    items = f"CASE WHEN coalesce({', '.join(below)}) IS NOT NULL THEN {' + '.join(f'coalesce({b}, 0)' for b in below)} END" if below else "NULL"
    return f"coalesce({total}, {items})"


_METRICS_SQL = f"""
wide AS (SELECT entity_id, period_label, {_WIDE} FROM best GROUP BY entity_id, period_label),
owner AS (SELECT entity_id, period_label, sum(amount_cents) AS owner FROM addbacks WHERE state = 'accepted'
  AND category NOT IN ('depreciation_amortization', 'interest') GROUP BY ALL),
s AS (SELECT w.*, owner, {_section_sql("is.revenue")} AS revenue_total, {_section_sql("is.cogs")} AS cogs, {_section_sql("is.opex")} AS opex, {_section_sql("is.other")} AS other,
  {_section_sql("bs.assets.current")} AS ca, {_section_sql("bs.liabilities.current")} AS cl, {_section_sql("bs.liabilities")} AS liab, {_section_sql("bs.equity")} AS eq,
  {_section_sql("pcf.income")} AS personal_income_total, {_section_sql("pcf.outflow")} AS personal_outflow_total
  FROM wide w LEFT JOIN owner USING (entity_id, period_label)),
g AS (SELECT *, coalesce("is.gross_profit", revenue_total - coalesce(cogs, 0)) AS gross_profit FROM s),
n AS (SELECT *, coalesce("is.net_income", gross_profit - coalesce(opex, 0) + coalesce(other, 0) - coalesce("is.income_tax", 0)) AS net_income FROM g),
e AS (SELECT *, net_income + coalesce("is.other.interest_expense", 0) + coalesce("is.income_tax", 0) + coalesce("is.opex.depreciation", 0) + coalesce("is.opex.amortization", 0) AS ebitda,
  ca - cl AS working_capital, eq - coalesce("bs.assets.other.goodwill", 0) AS tangible_net_worth,
  CASE WHEN personal_income_total IS NOT NULL OR personal_outflow_total IS NOT NULL THEN coalesce(personal_income_total, 0) - coalesce(personal_outflow_total, 0) END AS personal_cash_flow FROM n),
m AS (SELECT *, ebitda + coalesce(owner, 0) AS sde, ebitda + coalesce(owner, 0) - 8500000 AS cfads,
  CASE WHEN cl > 0 AND ca IS NOT NULL THEN {half_even_sql("ca * 100", "cl")} END AS current_ratio,
  CASE WHEN tangible_net_worth > 0 AND liab IS NOT NULL THEN {half_even_sql("liab * 100", "tangible_net_worth")} END AS debt_to_tnw FROM e),
tall AS ({" UNION ALL ".join([f"SELECT entity_id, period_label, '{c}' AS metric, 'cents' AS kind, CAST({c} AS BIGINT) AS cents, CAST(NULL AS BIGINT) AS mantissa, CAST(NULL AS INTEGER) AS scale FROM m WHERE {c} IS NOT NULL" for c in ("revenue_total", "gross_profit", "net_income", "ebitda", "sde", "cfads", "working_capital", "tangible_net_worth", "personal_income_total", "personal_outflow_total", "personal_cash_flow")] + [f"SELECT entity_id, period_label, '{c}', 'ratio', NULL, {c}, 2 FROM m WHERE {c} IS NOT NULL" for c in ("current_ratio", "debt_to_tnw")])})"""

_IDS = "array_to_string(list_sort(list_filter({0}, lambda x: x IS NOT NULL)), ',')"
_COLS = "'{0}' AS gate, '{1}' AS severity, {2} AS blocking, entity_id, period_label"
_G = {
    "g1": f"""g1 AS (SELECT {_COLS.format("G1", "error", "true")}, parent AS subject, {_IDS.format("ids")} AS fact_ids, CAST(abs(items - total) AS BIGINT) AS delta_cents FROM (
  SELECT entity_id, period_label, regexp_extract(node, '^(.*)\\.[^.]+$', 1) AS parent, max(CASE WHEN ends_with(node, '.total') THEN value_cents END) AS total,
  sum(CASE WHEN NOT ends_with(node, '.total') THEN value_cents END) AS items, list(id) AS ids FROM open_best GROUP BY ALL) WHERE abs(items - total) > 100)""",
    "g2": f"""g2 AS (SELECT {_COLS.format("G2", "error", "true")}, 'bs' AS subject, {_IDS.format("[ai, li, ei]")} AS fact_ids, CAST(abs(a - (l + q)) AS BIGINT) AS delta_cents FROM (
  SELECT entity_id, period_label, max(CASE WHEN node = 'bs.assets.total' THEN value_cents END) AS a, max(CASE WHEN node = 'bs.assets.total' THEN id END) AS ai,
  max(CASE WHEN node = 'bs.liabilities.total' THEN value_cents END) AS l, max(CASE WHEN node = 'bs.liabilities.total' THEN id END) AS li,
  max(CASE WHEN node = 'bs.equity.total' THEN value_cents END) AS q, max(CASE WHEN node = 'bs.equity.total' THEN id END) AS ei FROM open_best GROUP BY ALL) WHERE abs(a - (l + q)) > 200)""",
    "g3": f"""g3d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label, document_id ORDER BY created_at DESC, id DESC) AS p FROM ranked
  WHERE status <> 'rejected' AND node = 'is.net_income') WHERE p = 1),
g3 AS (SELECT 'G3' AS gate, 'error' AS severity, true AS blocking, a.entity_id, a.period_label, 'is.net_income' AS subject, {_IDS.format("[a.id, b.id]")} AS fact_ids, abs(a.value_cents - b.value_cents) AS delta_cents
  FROM g3d a JOIN g3d b ON a.entity_id = b.entity_id AND a.period_label = b.period_label AND a.document_id < b.document_id
  WHERE abs(a.value_cents - b.value_cents) > greatest(50000, abs(a.value_cents) // 100))""",
    "g4": "\n".join(
        f"""g4_{k} AS (SELECT 'G4' AS gate, 'error' AS severity, true AS blocking, r.entity_id, r.period_label, '{name}' AS subject, {_IDS.format("[r.id, " + ", ".join(f"o{i}.id" for i in range(len(ops))) + "]")} AS fact_ids,
  CAST(abs({(" - " if kind == "difference" else " + ").join(f"o{i}.value_cents" for i in range(len(ops)))} - r.value_cents) AS BIGINT) AS delta_cents FROM open_best r
  {" ".join(f"JOIN open_best o{i} ON o{i}.entity_id = r.entity_id AND o{i}.period_label = r.period_label AND o{i}.node = '{o}'" for i, o in enumerate(ops))}
  WHERE r.node = '{result}' {"AND r.period_label IN (" + ", ".join(f"'FY{y}'" for y in years) + ")" if years else ""}
  AND abs({(" - " if kind == "difference" else " + ").join(f"o{i}.value_cents" for i in range(len(ops)))} - r.value_cents) > {tolerance}),"""
        for k, (name, kind, result, ops, tolerance, years) in enumerate(SPECS)
    )
    + "\ng4 AS ("
    + " UNION ALL ".join(f"SELECT * FROM g4_{k}" for k in range(len(SPECS)))
    + ")",
    "g5": f"""g5t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label, node ORDER BY created_at, id) AS p FROM ranked WHERE status <> 'rejected' AND method = 'transcript') WHERE p = 1),
g5 AS (SELECT 'G5' AS gate, 'critical' AS severity, true AS blocking, f.entity_id, f.period_label, f.node AS subject, {_IDS.format("[f.id, t.id]")} AS fact_ids, abs(f.value_cents - t.value_cents) AS delta_cents
  FROM ranked f JOIN g5t t ON f.entity_id = t.entity_id AND f.period_label = t.period_label AND f.node = t.node
  WHERE f.status <> 'rejected' AND f.method <> 'transcript' AND f.value_cents <> t.value_cents)""",
    "g6": f"""g6y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, node, period_label ORDER BY created_at DESC, id DESC) AS p FROM ranked WHERE status <> 'rejected') WHERE p = 1),
g6l AS (SELECT *, CAST(substr(period_label, 3) AS INTEGER) AS y, lag(CAST(substr(period_label, 3) AS INTEGER)) OVER w AS py, lag(value_cents) OVER w AS pv, lag(id) OVER w AS pid FROM g6y
  WINDOW w AS (PARTITION BY entity_id, node ORDER BY CAST(substr(period_label, 3) AS INTEGER))),
g6 AS (SELECT {_COLS.format("G6", "warning", "false")}, node AS subject, {_IDS.format("[pid, id]")} AS fact_ids, abs(value_cents - pv) AS delta_cents FROM g6l
  WHERE y = py + 1 AND pv <> 0 AND CAST(abs(value_cents - pv) AS HUGEINT) * 10000 // abs(pv) > 20000)""",
}
_HEAD = f"WITH {FACTS_SQL},{BEST_SQL}"
_ISSUES = ",\n".join(_G.values()) + ",\nissues AS (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in _G) + ")"
_SUGGEST = (
    "rules(node, category, sign) AS (VALUES " + ", ".join(f"('{n}', '{c}', {s})" for n, c, s in ADDBACK_RULES) + "),\nsuggested AS (SELECT b.id AS fact_id, b.entity_id, b.period_label, r.category, b.value_cents * r.sign AS amount_cents FROM best b JOIN rules r USING (node) WHERE b.value_cents <> 0)"
)
_SIGNALS = """signals AS (SELECT id AS fact_id, CASE WHEN k % 7 <> 0 THEN value_cents END AS p1, CASE WHEN k % 11 <> 0 THEN value_cents + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END END AS p2,
  least(k % 101, (k * 3) % 101) AS points, k % 13 = 0 AS blocked FROM (SELECT *, document_id + value_cents AS k FROM ranked))"""
_DECIDE = """CASE WHEN blocked THEN 'review' WHEN p1 IS NULL AND p2 IS NULL THEN CASE WHEN points < 30 THEN 'reject' WHEN points >= {t} THEN 'auto_accept' ELSE 'review' END
  WHEN p1 IS NULL OR p2 IS NULL OR p1 <> p2 THEN 'review' WHEN points >= {t} THEN 'auto_accept' ELSE 'review' END"""

QUERIES = {
    "a01_best_facts": best,
    "e02_core_metrics": tall,
    "a04_global_cash_flow": lambda s, d: ledger.global_cash_flow(tall(s, d)),
    "e10_suggest_addbacks": suggestions,
    "j15_new_suggestions": new_suggestions,
    "e11_gate_subtotals": lambda s, d: gates.subtotals(open_best(s, d), NODES),
    "e12_gate_identity": lambda s, d: gates.identity(open_best(s, d)),
    "e13_gate_tie_out": lambda s, d: gates.tie_out(facts(s, d)),
    "e14_gate_relations": lambda s, d: gates.relations(open_best(s, d), specs(s)),
    "e15_gate_transcripts": lambda s, d: gates.transcripts(facts(s, d, by_entity=True)),
    "e16_gate_swings": lambda s, d: gates.swings(facts(s, d, by_entity=True)),
    "e17_all_issues": all_issues,
    "a12_blocked_facts": lambda s, d: gates.blocked(all_issues(s, d)),
    "e18_confidence": scored,
    "e34_threshold_sweep": sweep,
    "e25_spread": spread,
    "e25_spread_cells": spread_cells,
    "a06_transcript_cells": verified_cells,
}

_ISSUE_COLS = "gate, severity, blocking, entity_id, period_label, subject, fact_ids, delta_cents"
ORACLES = {
    "a01_best_facts": f"{_HEAD} SELECT entity_id, period_label, node, id, method, value_cents FROM best",
    "e02_core_metrics": f"{_HEAD},{_METRICS_SQL} SELECT * FROM tall",
    "a04_global_cash_flow": f"{_HEAD},{_METRICS_SQL} SELECT period_label, CAST(sum(cents) AS BIGINT) AS global_cash_flow FROM tall WHERE metric IN ('cfads', 'personal_cash_flow') GROUP BY period_label",
    "e10_suggest_addbacks": f"{_HEAD},\n{_SUGGEST} SELECT * FROM suggested",
    "j15_new_suggestions": f"{_HEAD},\n{_SUGGEST} SELECT * FROM suggested s WHERE NOT EXISTS (SELECT 1 FROM addbacks a WHERE a.entity_id = s.entity_id AND a.period_label = s.period_label AND a.category = s.category)",
    **{f"e1{i}_gate_{n}": f"{_HEAD},\n{_G[g]} SELECT {_ISSUE_COLS} FROM {g}" for i, g, n in ((1, "g1", "subtotals"), (2, "g2", "identity"), (3, "g3", "tie_out"), (4, "g4", "relations"), (5, "g5", "transcripts"), (6, "g6", "swings"))},
    "e17_all_issues": f"{_HEAD},\n{_ISSUES} SELECT {_ISSUE_COLS} FROM issues",
    "a12_blocked_facts": f"{_HEAD},\n{_ISSUES} SELECT DISTINCT unnest(string_split(fact_ids, ',')) AS fact_id FROM issues WHERE blocking",
    "e18_confidence": f"{_HEAD},\n{_SIGNALS} SELECT {_DECIDE.format(t=75)} AS decision, NOT blocked AND p1 IS NULL AND p2 IS NULL AS agreed_absent, count(*) AS n, CAST(sum(points) AS BIGINT) AS confidence_points FROM signals GROUP BY ALL",
    "e34_threshold_sweep": f"{_HEAD},\n{_SIGNALS}, t AS (SELECT unnest(range(30, 100, 5)) AS t) SELECT CAST(t AS INTEGER) AS threshold_points, count(*) FILTER (WHERE {_DECIDE.format(t='t')} = 'auto_accept') AS accepted, count(*) FILTER (WHERE {_DECIDE.format(t='t')} = 'auto_accept' AND p1 IS NOT NULL) AS accepted_values, count(*) AS n FROM signals, t GROUP BY t",
    "e25_spread_cells": f"{_HEAD} SELECT entity_id, node, period_label, id, method, status, value_cents FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, node, period_label ORDER BY status <> 'accepted', rank DESC, created_at, id) AS p FROM ranked WHERE status IN ('accepted', 'suggested')) WHERE p = 1",
    "e25_spread": f"{_HEAD} SELECT entity_id, node, " + ", ".join(f"max(CASE WHEN period_label = 'FY{y}' THEN value_cents END) AS \"FY{y}\"" for y in range(1995, 2002)) + " FROM best GROUP BY entity_id, node",
    "a06_transcript_cells": f"{_HEAD} SELECT entity_id, period_label, node, count(DISTINCT value_cents) AS n_values, max(CASE WHEN method = 'transcript' THEN 1 ELSE 0 END) AS has_transcript FROM ranked WHERE status <> 'rejected' GROUP BY ALL",
}
