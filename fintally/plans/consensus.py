"""Queries of readings with relations and their accuracy, over orders, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.functions.money import from_double
from fintally.model import table
from fintally.operators import consensus
from fintally.operators.consensus import POINTS, RATES, Relation

FIELDS = ["total", "goods", "tax", "discount", "due"]
RELATIONS = [Relation("total_of_parts", "sum", "total", ("goods", "tax"), 100), Relation("due_after_discount", "difference", "due", ("total", "discount"))]
OLD, NEW = 85, 60


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fields of each order's total that satisfy both relations: document_id, i (1 to 5), field, truth_cents."""
    t = from_double(F.col("o_totalprice"))
    tax, discount = F.pmod(t, F.lit(1009)), F.pmod(t, F.lit(499))
    values = F.array(t, t - tax, tax, discount, t - discount)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.posexplode(values).alias("i", "truth_cents"))
    return o.select("document_id", (F.col("i") + 1).alias("i"), F.element_at(F.array(*map(F.lit, FIELDS)), F.col("i") + 1).alias("field"), "truth_cents")


def _path(truth: DataFrame, path: int) -> DataFrame:
    """A reading: rows that are missing, blank or unreadable, values that both paths or one of them misread, by numbers of document and field."""
    k, i = F.col("document_id"), F.col("i")
    both = F.when((k % 6 == 0) & (i == 5), 250).when((k % 6 == 1) & (i == 1), 50).otherwise(0)
    one = F.when((k + i) % 17 == 3, 7).otherwise(0) if path == 2 else F.lit(0)
    missing: Column = ((k + i) % 13 < path) & (k % 2 == 0)
    blank = ((k + 3 * i) % 11 < path) & (k % 3 > 0)
    confidence = (k * path + i) % 50 / 100.0 + 0.5
    read = truth.where(~missing).withColumn("cents", F.when(~blank, F.col("truth_cents") + both + one))
    return read.select("document_id", "field", "cents", ((k + i) % 29 != 5 * path).alias("readable"), confidence.alias("confidence"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _truth(spark, sf_dir)
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    return consensus.readings(documents, _path(truth, 1), _path(truth, 2), FIELDS, RELATIONS)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.with_truth(_readings(spark, sf_dir), _truth(spark, sf_dir))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with a lower threshold and without the newest section, against the run before it."""
    section = F.element_at(F.array(*map(F.lit, ("real", "synthetic", "scanned"))), (F.col("document_id") % 3 + 1).cast("int"))
    judged = _judged(spark, sf_dir).withColumn("section", section)
    return consensus.findings(consensus.accuracy(judged, OLD), consensus.accuracy(judged.where("section <> 'scanned'"), NEW))


QUERIES = {
    "e19_relation_fields": lambda s, d: _readings(s, d).select("document_id", "field", "outcome", "value_cents", F.round(F.col("confidence") * 100).cast("int").alias("confidence_points"), "implicated"),
    "e19_relation_checks": lambda s, d: consensus.relation_checks(_readings(s, d), FIELDS[0]),
    "e34_sweep_accuracy": lambda s, d: consensus.sweep_accuracy(_judged(s, d)),
    "e34_wrong_fields": lambda s, d: consensus.wrong_at(_judged(s, d)),
    "e35_findings": _findings,
}

_T = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
_VALUES = dict(zip(FIELDS, ("t", "t - t % 1009", "t % 1009", "t % 499", "t - t % 499"), strict=True))


def _path_sql(path: int) -> str:
    one = " + CASE WHEN (k + i) % 17 = 3 THEN 7 ELSE 0 END" if path == 2 else ""
    both = "CASE WHEN k % 6 = 0 AND i = 5 THEN 250 WHEN k % 6 = 1 AND i = 1 THEN 50 ELSE 0 END"
    return f"""p{path} AS (SELECT k, field, CASE WHEN NOT ((k + 3 * i) % 11 < {path} AND k % 3 > 0) THEN v + {both}{one} END AS c, (k + i) % 29 <> {5 * path} AS ok, (k * {path} + i) % 50 + 50 AS conf
  FROM truth WHERE NOT ((k + i) % 13 < {path} AND k % 2 = 0))"""


_READ = f"""base AS (SELECT o_orderkey AS k, {_T} AS t FROM orders),
truth AS ({" UNION ALL ".join(f"SELECT k, {i} AS i, '{f}' AS field, {v} AS v FROM base" for i, (f, v) in enumerate(_VALUES.items(), 1))}),
{_path_sql(1)}, {_path_sql(2)},
r AS (SELECT truth.k, truth.field, truth.v, p1.c AS c1, p2.c AS c2, p1.conf AS f1, p2.conf AS f2, CASE WHEN NOT coalesce(p1.ok, true) OR NOT coalesce(p2.ok, true) THEN 'unreadable' WHEN p1.k IS NULL OR p2.k IS NULL THEN 'single_source'
  WHEN p1.c IS NULL AND p2.c IS NULL THEN 'consensus_absent' WHEN p1.c IS NULL OR p2.c IS NULL THEN 'single_source' WHEN p1.c = p2.c THEN 'consensus' ELSE 'disagreement' END AS outcome
  FROM truth LEFT JOIN p1 ON truth.k = p1.k AND truth.field = p1.field LEFT JOIN p2 ON truth.k = p2.k AND truth.field = p2.field),
g AS (SELECT k, field, CASE outcome WHEN 'consensus' THEN c1 WHEN 'consensus_absent' THEN 0 END AS g FROM r),
w AS (SELECT * FROM (PIVOT g ON field IN ({", ".join(f"'{f}'" for f in FIELDS)}) USING first(g) GROUP BY k)),
checks AS (SELECT k, 'total_of_parts' AS relation, abs(goods + tax - total) AS delta, 100 AS tolerance, ['total', 'goods', 'tax'] AS fields FROM w
  UNION ALL SELECT k, 'due_after_discount', abs(total - discount - due), 0, ['due', 'total', 'discount'] FROM w),
bad AS (SELECT DISTINCT k, unnest(fields) AS field FROM checks WHERE delta > tolerance),
judged AS (SELECT r.*, bad.k IS NOT NULL AS implicated, CASE WHEN bad.k IS NULL AND c1 IS NOT NULL AND c1 = c2 THEN least(f1, f2) ELSE -1 END AS sure FROM r LEFT JOIN bad ON r.k = bad.k AND r.field = bad.field)"""
_POINTS_SQL = f"pts(p) AS (VALUES {', '.join(f'({p})' for p in POINTS)})"


def _rate(n: str, d: str) -> str:
    """Half-even ten-thousandths of counts."""
    q, m = f"(10000 * ({n}) // ({d}))", f"(10000 * ({n}) % ({d}))"
    return f"CASE WHEN ({d}) > 0 THEN CAST({q} + CASE WHEN 2 * {m} > ({d}) OR (2 * {m} = ({d}) AND {q} % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) END"


def _accuracy_sql(threshold: int, where: str) -> str:
    right, sure = "coalesce(v = coalesce(c1, c2), false)", f"sure >= {threshold}"
    n = {"read": "coalesce(c1, c2) IS NOT NULL", "right_": f"coalesce(c1, c2) IS NOT NULL AND {right}", "labelled": "v IS NOT NULL", "sure_": sure, "sure_right": f"{sure} AND {right}"}
    pairs = (("right_", "read"), ("right_", "labelled"), ("sure_right", "sure_"), ("sure_right", "labelled"))
    rates = ", ".join(f"{_rate(c, d)} AS {m}" for m, (c, d) in zip(RATES, pairs, strict=True))
    return f"SELECT section, documents, {rates}, sure_ - sure_right AS wrong FROM (SELECT ['real', 'synthetic', 'scanned'][k % 3 + 1] AS section, count(DISTINCT k) AS documents, {', '.join(f'count(*) FILTER ({v}) AS {c}' for c, v in n.items())} FROM judged {where} GROUP BY 1)"


_FOUND = " UNION ALL ".join(f"SELECT b.section, '{m}' AS metric, b.{m} AS baseline, c.{m} AS current FROM b JOIN c USING (section) WHERE b.{m} IS NOT NULL AND (c.{m} IS NULL OR c.{m} < b.{m} - 20)" for m in RATES)
ORACLES = {
    "e19_relation_fields": f"WITH {_READ} SELECT k AS document_id, field, outcome, CASE WHEN outcome = 'consensus' THEN c1 END AS value_cents, CAST(CASE WHEN outcome LIKE 'consensus%' THEN least(f1, f2) ELSE 0 END AS INTEGER) AS confidence_points, implicated FROM judged",
    "e19_relation_checks": f"WITH {_READ} SELECT k AS document_id, relation, CASE WHEN delta IS NULL THEN 'skipped' WHEN delta <= tolerance THEN 'passed' ELSE 'violated' END AS status, CAST(coalesce(delta, 0) AS BIGINT) AS delta_cents FROM checks",
    "e34_sweep_accuracy": f"""WITH {_READ}, {_POINTS_SQL}, n AS (SELECT p, count(*) FILTER (sure >= p) AS accepted, count(*) FILTER (sure >= p AND v = c1) AS correct, count(v) AS labelled FROM judged, pts GROUP BY p)
SELECT p AS threshold_points, accepted, correct, {_rate("correct", "accepted")} AS precision_points, coalesce({_rate("correct", "labelled")}, 0) AS coverage_points FROM n""",
    "e34_wrong_fields": f"WITH {_READ}, {_POINTS_SQL} SELECT k AS document_id, field, max(p) AS threshold_points FROM judged JOIN pts ON sure >= p WHERE v IS DISTINCT FROM c1 GROUP BY ALL",
    "e35_findings": f"""WITH {_READ}, b AS ({_accuracy_sql(OLD, "")}), c AS ({_accuracy_sql(NEW, "WHERE k % 3 < 2")})
SELECT section, 'documents' AS metric, documents AS baseline, CAST(NULL AS BIGINT) AS current FROM b ANTI JOIN c USING (section) UNION ALL {_FOUND}
UNION ALL SELECT b.section, 'silent_wrong_count', b.wrong, c.wrong FROM b JOIN c USING (section) WHERE c.wrong > b.wrong UNION ALL SELECT section, 'silent_wrong_count', 0, wrong FROM c WHERE section = 'real' AND wrong > 0""",
}
