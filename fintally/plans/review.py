"""Queries of corrections, transitions, portal states, tax spread and projection base, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.model import FACTS_SQL, NODES, facts, table
from fintally.operators import matching, review
from fintally.plans.portfolio import INVITES, NOW, K, case, case_sql, invites, orders

_F = f"WITH {FACTS_SQL}"
CORRECTED = ("12", "-7", "1.5", None, "", "99999999999999999999", "+3", "0012")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("n", F.unix_date(F.col("created_at").cast("date")) + F.col("document_id"))


_N = f"{_F}, n AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) + document_id AS n FROM ranked)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    name = F.when(n % 11 == 0, F.concat("id", F.lit("?"))).otherwise(F.col("id"))
    return _numbered(spark, sf_dir).where(n % 3 > 0).select(F.col("id").alias("request_id"), name.alias("fact_id"), case(n, CORRECTED).alias("corrected"))


_WANTED = f"{_N}, wanted AS (SELECT id AS request_id, CASE WHEN n % 11 = 0 THEN id || '?' ELSE id END AS fact_id, {case_sql('n', CORRECTED)} AS corrected FROM n WHERE n % 3 > 0)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three requests of a fact, the later ones by another reviewer."""
    n = F.col("n")
    each = _numbered(spark, sf_dir).select("id", "n", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i")).where(F.col("i") <= n % 4)
    return each.select(F.concat_ws("/", "id", "i").alias("request_id"), F.col("id").alias("fact_id"), ((n * F.col("i")) % 7).alias("at"), case(n + F.col("i"), ("accepted", "rejected", "deleted")).alias("target"))


_MOVES = f"{_N}, moves AS (SELECT id || '/' || i AS request_id, id AS fact_id, (n * i) % 7 AS asked_at, {case_sql('n + i', ('accepted', 'rejected', 'deleted'))} AS target FROM n, (VALUES (1), (2), (3)) v(i) WHERE i <= n % 4)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of which every third is overridden by a new one."""
    f, n = _numbered(spark, sf_dir), F.col("n")
    new = F.concat("id", F.lit("+"))
    old = f.select("id", F.when(n % 3 == 0, "overridden").otherwise(F.col("status")).alias("status"), "method", F.when(n % 3 == 0, new).alias("superseded_by"))
    made = f.where(n % 3 == 0).select(new.alias("id"), F.when(n % 5 == 0, "rejected").otherwise("accepted").alias("status"), F.lit("override").alias("method"), F.lit(None).cast("string").alias("superseded_by"))
    return old.union(made)


def reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _numbered(spark, sf_dir).where("n % 2 = 0").select(F.concat("id", F.lit("+")).alias("fact_id"))
    return review.reverted(_history(spark, sf_dir), asked)


def portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = orders(spark, sf_dir).select(F.col(K).alias("invite_id"), F.col("o_custkey").alias("user_id"))
    mine = invites(spark, sf_dir).join(users, "invite_id")
    rows = F.array(*(F.struct(F.lit(i).alias("item"), F.array(*map(F.lit, f)).cast("array<string>").alias("families")) for i, f in (("tax", ("f0", "f1")), ("bank", ("f2",)))))
    items = orders(spark, sf_dir).select(F.col(K).alias("invite_id"), F.inline(F.slice(rows, F.lit(1), (F.col(K) % 3).cast("int"))))
    lines = table(spark, sf_dir, "lineitem")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    uploads = lines.select(F.col("l_orderkey").alias("invite_id"), F.concat(F.lit("f"), part % 4).alias("family"), case(supplier, ("extracted", "extracted", "extracted", "processing", "extracted", "failed", "extracted", "uploaded")).alias("status"), case(F.floor(part / 4), ("clean", "clean", "clean", "infected", None, "failed")).alias("virus_scan"))
    requests = lines.where("l_suppkey % 9 = 0").select(F.col("l_orderkey").alias("invite_id"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"))
    return review.portal_states(mine, items, uploads, requests, F.lit(NOW).cast("timestamp"))


_PORTALS = f"""WITH {INVITES},
u AS (SELECT l_orderkey AS invite_id, 'f' || (l_partkey % 4) AS family, {case_sql('l_suppkey', ('extracted', 'extracted', 'extracted', 'processing', 'extracted', 'failed', 'extracted', 'uploaded'))} AS status,
  {case_sql('(l_partkey // 4)', ('clean', 'clean', 'clean', 'infected', None, 'failed'))} AS virus FROM lineitem),
mine AS (SELECT * FROM (SELECT o_custkey AS user_id, i.*, row_number() OVER (PARTITION BY o_custkey ORDER BY i.created_at DESC NULLS FIRST, invite_id DESC) AS place
  FROM invites i JOIN orders ON o_orderkey = invite_id WHERE status = 'active' AND revoked_at IS NULL AND expires_at > TIMESTAMP '{NOW}') WHERE place = 1),
c AS (SELECT user_id, invite_id, portal_status,
  (CASE WHEN invite_id % 3 >= 1 AND NOT EXISTS (SELECT 1 FROM u WHERE u.invite_id = m.invite_id AND family IN ('f0', 'f1')) THEN 1 ELSE 0 END)
  + (CASE WHEN invite_id % 3 >= 2 AND NOT EXISTS (SELECT 1 FROM u WHERE u.invite_id = m.invite_id AND family = 'f2') THEN 1 ELSE 0 END) AS unsatisfied FROM mine m),
f AS (SELECT invite_id, count(*) FILTER (status IN ('uploaded', 'processing')) AS processing, count(*) FILTER (status = 'failed' OR virus IN ('infected', 'failed')) AS replace FROM u GROUP BY ALL),
r AS (SELECT l_orderkey AS invite_id, count(*) AS requests FROM lineitem WHERE l_suppkey % 9 = 0 AND l_linestatus = 'O' GROUP BY ALL)
SELECT user_id, c.invite_id, CASE WHEN portal_status = 'complete' THEN 'complete' WHEN coalesce(requests, 0) > 0 THEN 'action_needed' WHEN unsatisfied > 0 THEN 'collecting' WHEN coalesce(processing, 0) > 0 THEN 'received' ELSE 'in_review' END AS status,
  CAST(unsatisfied AS BIGINT) AS unsatisfied, coalesce(requests, 0) AS requests, coalesce(replace, 0) AS replace FROM c LEFT JOIN f USING (invite_id) LEFT JOIN r USING (invite_id)"""

#: The registry: every node but each seventh is a line, six lines to a form.
META = [(node, i, f"F{i // 6}") for i, node in enumerate(NODES) if i % 7 != 6]


def tax_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumnRenamed("node", "field_id")
    # most facts have one of two values, so that transcripts and other methods meet
    value = F.when(F.col("document_id") % 5 > 0, F.lit(1000) + F.col("document_id") % 2).otherwise(F.col("value_cents"))
    return review.tax_spread(spark.createDataFrame(META, "field_id string, position int, family string"), f.withColumn("value_cents", value))


_META = ", ".join(f"('{n}', {i}, '{f}')" for n, i, f in META)
_TAX = f"""{_F}, meta(field_id, position, family) AS (VALUES {_META}),
k AS (SELECT entity_id, field_id, period_label, position, family, id, CASE WHEN document_id % 5 > 0 THEN 1000 + document_id % 2 ELSE value_cents END AS value_cents, method, status, rank, created_at
  FROM ranked JOIN meta ON node = field_id WHERE status <> 'rejected'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_id, period_label ORDER BY status, rank DESC, created_at, id) AS place FROM k) WHERE place = 1),
t AS (SELECT entity_id, field_id, period_label, value_cents FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_id, period_label ORDER BY created_at DESC, id DESC) AS place FROM k WHERE status = 'accepted' AND method = 'transcript') WHERE place = 1),
v AS (SELECT DISTINCT entity_id, field_id, period_label FROM t JOIN k USING (entity_id, field_id, period_label, value_cents) WHERE status = 'accepted' AND method <> 'transcript')
SELECT entity_id, position, 'line' AS kind, field_id AS key, period_label, id AS fact_id, CAST(value_cents AS BIGINT) AS value_cents, method, status, (entity_id, field_id, period_label) IN (SELECT (entity_id, field_id, period_label) FROM v) AS verified FROM b
UNION ALL SELECT entity_id, min(position), 'form', family, NULL, NULL, NULL, NULL, NULL, NULL FROM b GROUP BY entity_id, family"""

KINDS = ("guarantor", "applicant", "target", "spouse", "oc")


def projection_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    entities = table(spark, sf_dir, "customer").select(F.floor(k / 4).alias("deal_id"), k.alias("entity_id"), case(k, KINDS).alias("kind"))
    return review.projection_base(entities, facts(spark, sf_dir))


_BASE = f"""{_F}, target AS (SELECT deal_id, entity_id FROM (SELECT c_custkey // 4 AS deal_id, c_custkey AS entity_id, row_number() OVER (PARTITION BY c_custkey // 4 ORDER BY list_position(['target', 'applicant'], {case_sql('c_custkey', KINDS)}) NULLS LAST, c_custkey) AS place FROM customer) WHERE place = 1),
own AS (SELECT deal_id, f.* FROM facts f JOIN target USING (entity_id) WHERE status = 'accepted' AND node LIKE 'is.%'),
base AS (SELECT * FROM own o WHERE period_label = (SELECT max(period_label) FROM own p WHERE p.deal_id = o.deal_id)),
heads AS (SELECT deal_id, entity_id, period_label, CAST(coalesce(nullif(sum(value_cents) FILTER (node = 'is.revenue.total'), 0), sum(value_cents) FILTER (node LIKE 'is.revenue.%'), 0) AS BIGINT) AS revenue_cents FROM base GROUP BY ALL),
lines AS (SELECT deal_id, node, CAST(sum(value_cents) AS BIGINT) AS amount_cents, CASE WHEN split_part(node, '.', -1) IN ('depreciation', 'amortization', 'interest_expense', 'interest') THEN 'excluded' ELSE 'ratio' END AS treatment, count(*) AS n_sources
  FROM base WHERE (node LIKE 'is.opex.%' OR node LIKE 'is.other.%') AND node NOT LIKE '%.total' GROUP BY ALL HAVING sum(value_cents) <> 0)
SELECT h.deal_id, entity_id, period_label, revenue_cents, node, amount_cents, treatment, n_sources FROM heads h LEFT JOIN lines l ON h.deal_id = l.deal_id"""

FIRST, LAST = ("John", "Jane", "Jon", "Maria", "M", "Peter"), ("Smith", "Smyth", "Doe", "Garcia Lopez")
SHOPS = ("Acme Bakery LLC", "Acme Holdings dba Acme Bakery", "Blue River Co.", "Blue Rivers Inc")


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of each customer's document in its deal of eight, by printed name."""
    k = F.col("c_custkey")
    kind = case(k, ("guarantor", "target", "spouse", "applicant"))
    person = lambda at: F.concat_ws(" ", case(at, FIRST), case(F.floor(at / 2), LAST))
    of = lambda at, kind: F.when(kind.isin("guarantor", "spouse", "person"), person(at)).otherwise(case(F.floor(at / 3), SHOPS))
    customers = table(spark, sf_dir, "customer")
    entities = customers.select(F.floor(k / 8).alias("deal_id"), k.alias("entity_id"), kind.alias("kind"), of(k, kind).alias("name"))
    asked = case(F.floor(k / 2), ("person", "business"))
    named = customers.select(k.alias("document_id"), F.floor(k / 8).alias("deal_id"), asked.alias("kind"), of(k + 5, asked).alias("identity"))
    return matching.match_entities(named, entities)


QUERIES = {
    "e22_corrections": lambda s, d: review.corrections(facts(s, d), _wanted(s, d), True),
    "e39_transitions": lambda s, d: review.transitions(facts(s, d), _moves(s, d)),
    "e40_reverts": reverts,
    "e31_portal_states": portals,
    "e26_tax_spread": tax_spread,
    "e07_projection_base": projection_base,
    "t23_document_entities": document_entities,
}
_WHOLE = "regexp_full_match(corrected, '-?[0-9]+')"
ORACLES = {
    "e22_corrections": f"""{_WANTED}, a AS (SELECT w.*, f.status AS was, f.value_cents AS old, try_cast(corrected AS BIGINT) AS value FROM wanted w LEFT JOIN facts f ON f.id = w.fact_id),
r AS (SELECT *, CASE WHEN was IS NULL THEN 'unknown fact' WHEN was = 'rejected' THEN 'not correctable' WHEN NOT coalesce({_WHOLE}, false) THEN 'not whole cents' WHEN value IS NULL THEN 'out of range' END AS reason FROM a)
SELECT request_id, fact_id, reason, 'refused' AS action, was AS status, NULL AS method, NULL AS value_cents, NULL AS original_value_cents FROM r WHERE reason IS NOT NULL
UNION ALL SELECT request_id, fact_id, NULL, 'insert', 'accepted', 'override', value, old FROM r WHERE reason IS NULL
UNION ALL SELECT request_id, fact_id, NULL, 'patch', 'overridden', NULL, NULL, NULL FROM r WHERE reason IS NULL""",
    "e39_transitions": f"""{_MOVES}, o AS (SELECT fact_id, arg_min(target, row(asked_at, request_id)) AS target, count(*) AS n FROM moves GROUP BY ALL)
SELECT fact_id, CASE WHEN status = 'suggested' AND target <> 'deleted' THEN target ELSE status END AS status, n - CASE WHEN status = 'suggested' AND target <> 'deleted' THEN 1 ELSE 0 END AS conflicts FROM o JOIN facts ON id = fact_id""",
    "e40_reverts": f"""{_N} SELECT id, CASE WHEN n % 6 = 0 THEN 'accepted' WHEN n % 3 = 0 THEN 'overridden' ELSE status END AS status, method, CASE WHEN n % 3 = 0 AND n % 2 = 1 THEN id || '+' END AS superseded_by FROM n
UNION ALL SELECT id || '+', CASE WHEN n % 5 = 0 OR n % 2 = 0 THEN 'rejected' ELSE 'accepted' END, 'override', NULL FROM n WHERE n % 3 = 0""",
    "e31_portal_states": _PORTALS,
    "e26_tax_spread": _TAX,
    "e07_projection_base": _BASE,
}
