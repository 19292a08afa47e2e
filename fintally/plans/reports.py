"""Queries of read models, text operators and loans, with SQL twins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.functions.money import dollars, from_double, half_even
from fintally.model import BEST_SQL, FACTS_SQL, facts, half_even_sql, table
from fintally.operators import loans, matching, readmodels, text
from fintally.plans import underwriting


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction runs of events: a deal, a stage, pages from props, cost from value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("deal_id"),
        F.col("event_type").alias("stage"),
        (F.col("event_type") == "error").alias("failed"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("pages"),
        (from_double(F.coalesce("value", F.lit(0.0))) * 10_000).alias("cost_micro"),
        F.col("ts").alias("started_at"),
    )


_RUNS = """runs AS (SELECT user_id AS deal_id, event_type AS stage, event_type = 'error' AS failed, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS pages,
  CAST(CAST(coalesce(value, 0) AS DECIMAL(18,2)) * 100 AS BIGINT) * 10000 AS cost_micro, ts AS started_at FROM events)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.daily_usage(runs(spark, sf_dir), F.lit("2024-01-31").cast("date"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.review_queue(facts(spark, sf_dir), underwriting.all_issues(spark, sf_dir))


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.keyset_page(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 500, 50)


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 3).alias("tenant_id"), F.col("p_brand").alias("label"), F.when(F.col("p_size") % 5 == 0, "human").otherwise("llm").alias("source"),
        F.col("p_size").alias("usage_count"), F.col("p_type").alias("updated_at"), F.col("p_partkey").alias("id"),
    )
    return readmodels.best_mappings(rows)


_MAPPINGS = """m AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END AS tenant_id, p_brand AS label, CASE WHEN p_size % 5 = 0 THEN 'human' ELSE 'llm' END AS source,
  p_size AS usage_count, p_type AS updated_at, p_partkey AS id FROM part)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page spans of orders: two families, one document for each customer."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 23 + 1
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("family"), (F.col("o_orderkey") % 2 + 2020).alias("tax_year"), start.alias("page_start"), (start + F.col("o_orderkey") % 5).alias("page_end"))


_SPANS = "spans AS (SELECT o_orderkey AS id, o_custkey AS document_id, o_orderstatus AS family, o_orderkey % 2 + 2020 AS tax_year, o_orderkey % 23 + 1 AS page_start, o_orderkey % 23 + 1 + o_orderkey % 5 AS page_end FROM orders)"


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return readmodels.accuracy(d.select(F.col("lang").alias("form"), F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("quality"), F.when(F.col("n_chars") % 7 > 0, 1).otherwise(0).alias("predicted"), F.col("quality").alias("truth")))


# Forms of a printed amount (w: dollars, g: dollars with commas, p: with points, b: with blanks, c: two digits of
# cents, %: nothing), the sign and the power of ten that its cents are read with, or the null reason or rejection.
FORMS = (
    ("g.c", 1), ("$g.c", 1), ("($g.c)", -1), ("-g.c", -1), ("\u2212w.c", -1), ("\u2013g.c", -1), ("w.c-", -1), ("( w.c )", -1), ("p,c", 1), ("\u20acp,c", 1), ("w,c", 1), ("w.c", 1), ("(p,c)", -1), ("-$w.c", -1), ("w.c\u2014", -1), ("\u00a0g.c\u00a0", 1),
    ("g.c ", 1), ("\u2014", "dash"), ("---", "dash"), ("N/A", "na"), ("none", "na"), ("nil", "na"), (" ", "empty"), ("1.234", "ambiguous_separator"), ("-(w.c)", "conflicting_signs"), ("(w.c)-", "conflicting_signs"), ("-w.c-", "conflicting_signs"),
    ("w.c7", "too_many_decimals"), ("1.23.456", "malformed_grouping"), ("1,2,w", "malformed_grouping"), ("$(g.c)", "not_a_number"), ("w USD", "not_a_number"),
)


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of orders printed in 32 forms and read back."""
    cents = from_double(F.col("o_totalprice"))
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    whole = ((cents - cents % 100) / 100).cast("decimal(20,0)").cast("string")
    grouped = lambda mark: F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", mark)
    pieces = {"w": whole, "g": grouped(","), "p": grouped("."), "c": part}
    plain = {"USD", "none", "nil"}
    shown = lambda form: F.concat(*(F.lit(t) if t in plain else pieces.get(t, F.lit(t)) for t in re.findall("USD|none|nil|.", form)))
    k = F.col("o_orderkey") % len(FORMS)
    printed = reduce(lambda c, i: c.when(k == i, shown(FORMS[i][0])), range(1, len(FORMS)), F.when(k == 0, shown(FORMS[0][0])))
    got = text.normalize_amount(printed)
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("a")).select("o_orderkey", "a.*")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_label(F.concat(F.lit("4010  Total for "), "p_name", F.lit(" (net)"))).alias("label"))


def most_similar(customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The most similar supplier name of each customer name, of all suppliers (ties: least key); no row without a name."""
    c = customers.select("c_custkey", F.lower("c_name").alias("a")).where("a is not null")
    best = matching.nearest_names(c, suppliers.select(F.lower("s_name").alias("n"), F.col("s_suppkey").alias("key")))
    return c.join(best, "a").select("c_custkey", F.col("key").alias("s_suppkey"), "points")


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every customer whose key is divisible by 50; each is compared with all suppliers."""
    return most_similar(table(spark, sf_dir, "customer").where("c_custkey % 50 = 0"), table(spark, sf_dir, "supplier"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.scan_pii(table(spark, sf_dir, "documents"), "doc_id")


def quality_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(text.garbled(F.col("text")).alias("state")).agg(F.count("*").alias("n"))


def loan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    step = lambda m, bps: F.struct(F.lit(m).alias("month"), bps.cast("int").alias("bps"))
    return o.select(
        F.col("o_orderkey").alias("loan_id"), from_double(F.col("o_totalprice")).alias("principal_cents"), (F.col("o_orderkey") % 10 * 12 + 24).cast("int").alias("term_months"),
        F.array(step(1, F.col("o_custkey") % 1200), step(13, F.col("o_custkey") % 900 + 100)).alias("steps"), (F.col("o_orderkey") % 4).cast("int").alias("interest_only"),
    )


def amortization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loans.summaries(loan_rows(spark, sf_dir))


def proforma(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.sum(from_double(F.col("o_totalprice"))).alias("revenue_cents"))
    base = o.select("entity_id", (F.col("entity_id") % 12 + 1).alias("months_covered"), "revenue_cents", half_even(F.col("revenue_cents"), F.lit(3)).cast("long").alias("ratio_cents"), half_even(F.col("revenue_cents"), F.lit(8)).cast("long").alias("fixed_cents"), F.array(F.lit(300), F.lit(-150), F.lit(275)).alias("growth_bps"))
    return loans.project(base)


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dollars(from_double(F.col("o_totalprice")) * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)).alias("shown"))


QUERIES = {
    "a07_cost_by_deal": lambda s, d: readmodels.cost_by_deal(runs(s, d), 10_000_000),
    "a08_daily_usage": usage,
    "o01_review_queue": queue,
    "o02_audit_page": audit_page,
    "w01_best_mappings": mappings,
    "p08_redundant_spans": lambda s, d: readmodels.redundant_spans(spans(s, d)),
    "j11_overlapping_spans": lambda s, d: readmodels.overlapping_spans(spans(s, d)),
    "a17_accuracy": eval_cases,
    "t01_amounts": amounts,
    "t15_labels": labels_of,
    "t16_similar_names": similar,
    "t24_pii": pii,
    "t25_garbled": quality_of_pages,
    "e04_amortization": amortization,
    "e05_proforma": proforma,
    "p12_display": display,
}

_H = f"WITH {FACTS_SQL},{BEST_SQL}"
_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
_SHOWN = "CASE WHEN {c} < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0')"
_YEAR = lambda prev, bps: half_even_sql(f"{prev} * {10_000 + bps}", "10000")
ORACLES = {
    "a07_cost_by_deal": f"WITH {_RUNS}, p AS (SELECT deal_id, stage, count(*) n, count(*) FILTER (failed) f, sum(pages) pg, sum(cost_micro) c FROM runs GROUP BY ALL) SELECT deal_id, CAST(sum(n) AS BIGINT) AS runs, CAST(sum(f) AS BIGINT) AS failed, CAST(sum(pg) AS BIGINT) AS pages, CAST(sum(c) AS BIGINT) AS cost_micro, string_agg(stage || '=' || c, ',' ORDER BY stage || '=' || c) AS by_stage, sum(c) > 10000000 AS over_envelope FROM p GROUP BY deal_id",
    "a08_daily_usage": f"WITH {_RUNS}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(d.day AS VARCHAR) AS day, count(deal_id) AS runs, count(*) FILTER (failed) AS failed, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(cost_micro), 0) AS BIGINT) AS cost_micro FROM d LEFT JOIN runs ON CAST(started_at AS DATE) = d.day GROUP BY d.day",
    "o01_review_queue": f"{_H},\n{underwriting._ISSUES}, w AS (SELECT unnest(string_split(fact_ids, ',')) AS id, CASE severity WHEN 'critical' THEN 3 WHEN 'error' THEN 2 ELSE 1 END AS r FROM issues), x AS (SELECT id, max(r) AS r FROM w GROUP BY id) SELECT f.id, f.document_id, f.created_at, CAST(coalesce(x.r, 0) AS INTEGER) AS severity_rank FROM ranked f LEFT JOIN x USING (id) WHERE status = 'suggested' ORDER BY severity_rank DESC, document_id, created_at, id",
    "o02_audit_page": "SELECT event_id, user_id, event_type FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 51",
    "w01_best_mappings": f"WITH {_MAPPINGS} SELECT tenant_id, label, id, source, usage_count FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, label ORDER BY source = 'human' DESC, usage_count DESC, updated_at DESC, id DESC) AS p FROM m) WHERE p = 1",
    "p08_redundant_spans": f"WITH {_SPANS} SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans w WHERE w.document_id = s.document_id AND w.family = s.family AND w.tax_year = s.tax_year AND w.page_start <= s.page_start AND w.page_end >= s.page_end AND (w.page_end - w.page_start > s.page_end - s.page_start OR w.id < s.id))",
    "j11_overlapping_spans": f"WITH {_SPANS} SELECT * FROM spans s WHERE EXISTS (SELECT 1 FROM spans o WHERE o.document_id = s.document_id AND o.id <> s.id AND o.page_start <= s.page_end AND s.page_start <= o.page_end)",
    "a17_accuracy": "WITH c AS (SELECT lang AS form, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS quality, CASE WHEN n_chars % 7 > 0 THEN 1 ELSE 0 END AS predicted, l.quality AS truth FROM documents JOIN labels l USING (doc_id)), g AS (SELECT form, quality, grouping(form, quality) AS g, count(*) AS n, count(*) FILTER (predicted = 1) AS p, count(*) FILTER (predicted = 1 AND truth = 1) AS r, count(*) FILTER (truth = 1) AS a FROM c GROUP BY GROUPING SETS ((), (form), (quality))) SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'form' ELSE 'quality' END AS level, coalesce(form, quality, '') AS name, n, CASE WHEN p > 0 THEN r * 10000 // p END AS precision_points, CASE WHEN a > 0 THEN r * 10000 // a END AS recall_points FROM g",
    "t01_amounts": "SELECT o_orderkey, CASE {k} " .format(k=f"o_orderkey % {len(FORMS)}") + " ".join(f"WHEN {i} THEN {x} * {_CENTS}" for i, (_, x) in enumerate(FORMS) if x in (1, -1)) + " END AS cents, " + ", ".join(f"CASE o_orderkey % {len(FORMS)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, (_, x) in enumerate(FORMS) if isinstance(x, str) and (x in ("dash", "na", "empty")) == reason) + f" END AS {name}" for name, reason in (("null_reason", True), ("rejection", False))) + " FROM orders",
    "t15_labels": "SELECT p_partkey, 'total ' || trim(regexp_replace(lower(p_name || ' (net)'), '[^a-z0-9]+', ' ', 'g')) AS label FROM part",
    "t16_similar_names": "WITH p AS (SELECT c_custkey, s_suppkey, CAST((greatest(length(c_name), length(s_name)) - levenshtein(lower(c_name), lower(s_name))) * 10000 // greatest(length(c_name), length(s_name)) AS INTEGER) AS points FROM customer CROSS JOIN supplier WHERE c_custkey % 50 = 0) SELECT c_custkey, s_suppkey, points FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY points DESC, s_suppkey) AS r FROM p) WHERE r = 1",
    "t24_pii": "WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{s}' AS severity, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents" for k, s, p in (("ssn", "definite", text.SSN), ("ein", "definite", text.EIN), ("nine_digits", "possible", text.NINE))) + ") SELECT doc_id, kind, severity, regexp_replace(substr(m, 1, length(m) - 4), '[0-9]', '*', 'g') || right(m, 4) AS masked FROM h",
    "t25_garbled": "SELECT CASE WHEN text IS NULL OR length(trim(text)) < 40 THEN 'short' ELSE 'ok' END AS state, count(*) AS n FROM documents GROUP BY 1",
    "e05_proforma": f"""WITH b AS (SELECT o_custkey AS entity_id, sum({_CENTS}) AS r, o_custkey % 12 + 1 AS m FROM orders GROUP BY ALL),
a AS (SELECT entity_id, {half_even_sql("r * 12", "m")} AS y0, {half_even_sql(half_even_sql("r", "3") + " * 12", "m")} AS ratio, {half_even_sql(half_even_sql("r", "8") + " * 12", "m")} AS fixed FROM b),
y1 AS (SELECT *, {_YEAR("y0", 300)} AS y1 FROM a), y2 AS (SELECT *, {_YEAR("y1", -150)} AS y2 FROM y1), y3 AS (SELECT *, {_YEAR("y2", 275)} AS y3 FROM y2),
t AS (SELECT entity_id, 1 AS year, y1 AS rev, ratio, fixed, y0 FROM y3 UNION ALL SELECT entity_id, 2, y2, ratio, fixed, y0 FROM y3 UNION ALL SELECT entity_id, 3, y3, ratio, fixed, y0 FROM y3),
o AS (SELECT entity_id, year, rev, {half_even_sql("ratio * CAST(rev AS HUGEINT)", "y0")} + fixed AS opex FROM t)
SELECT entity_id, year, rev AS revenue_cents, opex AS opex_cents, rev - opex AS noi_cents, {half_even_sql("(rev - opex) * 10000", "rev")} AS margin_mantissa FROM o""",
    "p12_display": f"SELECT o_orderkey, {_SHOWN.format(c='c')} AS shown FROM (SELECT o_orderkey, {_CENTS} * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS c FROM orders)",
}
