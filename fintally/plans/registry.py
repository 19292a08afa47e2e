"""Queries of span edits, registry entries by year, dense spreads and tolerant rows, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fintally.functions.money import from_double
from fintally.model import FACTS_SQL, NODES, facts, pick, table
from fintally.operators import ledger, registry, span_edits

FAMILIES = ("F", "O", "P")
BASE_YEAR, OTHER_YEARS = 1997, (1996, 1999)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages for each order of a customer (document), one fewer for some."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"))
    r = F.row_number().over(Window.partitionBy("document_id").orderBy("id"))
    o = o.withColumn("r", r).withColumn("page_start", F.col("r") * 10 - 9)
    short = (F.col("document_id") % 2 == 0) & (F.col("r") % 6 == 1)
    return o.withColumn("page_end", F.col("page_start") + F.when(short, 8).otherwise(9)).withColumn("confirmed", F.lit(True))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a span's number: split; merge into the one before; shrink; grow over that one; an impossible range. Late ones: of no span, and of a new span."""
    s = _spans(spark, sf_dir).withColumn("before", F.lag("id").over(Window.partitionBy("document_id").orderBy("r")))
    m, start, end = F.col("r") % 6, F.col("page_start"), F.col("page_end")
    made = s.select(
        "document_id",
        F.col("id").alias("edit_id"),
        F.when(m == 0, "split").when(m == 2, "merge").otherwise("edit").alias("kind"),
        F.col("id").alias("span_id"),
        F.when(m == 0, -F.col("id")).when(m == 2, F.col("before")).cast("long").alias("other_id"),
        F.when(m == 0, start + 4).when(m == 3, start + 2).when(m == 4, start - 5).when(m == 5, start).alias("page_start"),
        F.when(m.isin(3, 4), end).when(m == 5, start - 1).alias("page_end"),
        m.alias("m"),
    ).where("m <> 1").drop("m")
    again = made.where("kind = 'split'").select("document_id", (F.col("edit_id") + 1_000_000_000).alias("edit_id"), "kind", F.col("other_id").alias("span_id"), F.lit(7).cast("long").alias("other_id"), "page_start", "page_end")
    lost = made.where("kind = 'merge'").select("document_id", (F.col("edit_id") + 2_000_000_000).alias("edit_id"), "kind", F.lit(-1).cast("long").alias("span_id"), "other_id", "page_start", "page_end")
    return made.unionByName(again).unionByName(lost)


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_edits.edited(_spans(spark, sf_dir), _edits(spark, sf_dir))


def span_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    f = spans.select("document_id", F.col("id").alias("fact_id"), F.col("id").alias("span_id"), (F.col("id") % 9 + 1).alias("source_page"))
    return span_edits.rebased(f, spans, _done(spark, sf_dir))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    number = F.col("p_partkey") % 50
    named = p.select(pick(FAMILIES, F.col("p_partkey")).alias("family"), F.concat(F.lit("f"), number).alias("field_id"), F.col("p_size").cast("string").alias("line"), pick(NODES, number).alias("node"))
    return named.groupBy("family", "field_id").agg(F.min("line").alias("line"), F.min("node").alias("node")).withColumn("base_year", F.lit(BASE_YEAR))


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In other years some fields are dropped, some stand on another line; one year has fields of its own."""
    number = F.substring("field_id", 2, 2).cast("int")
    year = F.explode(F.array(*map(F.lit, OTHER_YEARS)))
    each = _base(spark, sf_dir).withColumn("year", year).withColumn("n", number + F.col("year") % 10)
    action = F.when(F.col("n") % 7 == 0, "drop").when(F.col("n") % 5 == 0, "renumber")
    changed = each.withColumn("action", action).where("action is not null")
    own = each.where((F.col("year") == OTHER_YEARS[1]) & (number < 3)).withColumn("field_id", F.concat(F.lit("new"), number)).withColumn("action", F.lit("add"))
    return changed.unionByName(own).select("family", "year", "field_id", "action", F.concat("line", F.lit("a")).alias("line"), "node")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of lineitem by what the registry says of their form, year and field."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    field = F.when(F.col("l_partkey") % 61 == 0, F.concat(F.lit("new"), F.col("l_partkey") % 4)).otherwise(F.concat(F.lit("f"), F.col("l_partkey") % 53))
    f = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("family"), "year", field.alias("field_id"), from_double(F.col("l_extendedprice")).alias("cents"))
    out = registry.placed(f, registry.entries(_base(spark, sf_dir), _overrides(spark, sf_dir)))
    return out.groupBy("family", "year", "field_id", "line", "node", "registered").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dense_spread(ledger.spread(facts(spark, sf_dir)), NODES)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some of them cut off, of another type, out of range, or not there."""
    e, m = table(spark, sf_dir, "events"), F.col("event_id") % 11
    text = F.when(m == 0, F.substring("props", 1, 4)).when(m == 1, F.lit(None)).when(m == 2, F.lit('{"k": "many"}')).when(m == 3, F.lit("[1]")).when(m == 4, F.lit("{}"))
    text = text.when(m == 5, F.concat(F.lit('{"k": -'), F.col("event_id"), F.lit("}"))).when(m == 6, F.lit("")).otherwise(F.col("props"))
    checks = {"no value": F.col("k").isNull(), "negative": F.col("k") < 0}
    return registry.tolerant(e.select("event_id", text.alias("raw")), "raw", "k int", checks).drop("raw")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested items of orders, some of them without a label, without a key, or no list at all."""
    m = F.col("o_orderkey") % 6
    first = F.concat(F.lit('{"key": "'), F.col("o_orderstatus"), F.lit('", "label": "'), F.col("o_orderpriority"), F.lit('"}'))
    text = F.when(m == 0, F.lit("{oops")).when(m == 1, F.lit(None)).when(m == 2, F.lit("[]")).when(m == 3, F.concat(F.lit("["), first, F.lit("]")))
    text = text.when(m == 4, F.concat(F.lit("["), first, F.lit(', {"key": " w2 ", "formFamilies": ["W2", 4, " "]}, {"label": "x"}, {"key": ""}, 7, {"key": 1, "label": " "}]'))).otherwise(F.lit('{"key": "a"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(registry.requested_items(text)).alias("at", "item")).select("o_orderkey", "at", "item.key", "item.label", F.array_join("item.families", ",").alias("families"))


QUERIES = {
    "e23_span_edits": lambda s, d: span_edits.spans_after(_done(s, d)),
    "e23_edit_outcomes": lambda s, d: span_edits.outcomes(_done(s, d)),
    "e23_fact_pages": span_facts,
    "j04_registry_fields": placed,
    "j19_dense_spread": grid,
    "t30_tolerant_rows": event_rows,
    "t28_requested_items": items,
}

_SPANS = """s0 AS (SELECT o_custkey AS document_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
s AS (SELECT *, CAST(r * 10 - 9 AS INTEGER) AS ps, CAST(r * 10 - CASE WHEN document_id % 2 = 0 AND r % 6 = 1 THEN 1 ELSE 0 END AS INTEGER) AS pe FROM s0),
n AS (SELECT *, lead(id) OVER w AS next_id, lead(pe) OVER w AS next_end, lag(id) OVER w AS before FROM s WINDOW w AS (PARTITION BY document_id ORDER BY r)),
m AS (SELECT *, r % 6 = 1 AND document_id % 2 = 1 AND next_id IS NOT NULL AS absorbs, r % 6 = 2 AND document_id % 2 = 1 AS gone FROM n)"""
_BASE = f"""b AS (SELECT {list(FAMILIES)}[p_partkey % 3 + 1] AS family, 'f' || (p_partkey % 50) AS field_id, p_partkey % 50 AS k, min(CAST(p_size AS VARCHAR)) AS line, min({list(NODES)}[p_partkey % 50 % {len(NODES)} + 1]) AS node FROM part GROUP BY ALL),
y AS (SELECT * FROM (VALUES ({BASE_YEAR}), ({OTHER_YEARS[0]}), ({OTHER_YEARS[1]})) t(year)),
r AS (SELECT family, year, field_id, CASE WHEN year <> {BASE_YEAR} AND (k + year % 10) % 5 = 0 THEN line || 'a' ELSE line END AS line, node FROM b, y WHERE year = {BASE_YEAR} OR (k + year % 10) % 7 <> 0
  UNION ALL SELECT family, {OTHER_YEARS[1]}, 'new' || k, line || 'a', node FROM b WHERE k < 3)"""
ORACLES = {
    "e23_span_edits": f"""WITH {_SPANS} SELECT document_id, id, CASE WHEN r % 6 = 3 THEN ps + 2 ELSE ps END AS page_start, CASE WHEN r % 6 = 0 THEN ps + 3 WHEN absorbs THEN next_end ELSE pe END AS page_end, true AS confirmed FROM m WHERE NOT gone
UNION ALL SELECT document_id, -id, ps + 4, pe, false FROM m WHERE r % 6 = 0""",
    "e23_edit_outcomes": f"""WITH {_SPANS} SELECT document_id, id AS edit_id, CASE r % 6 WHEN 2 THEN CASE WHEN gone THEN 'done' ELSE 'not adjacent' END WHEN 4 THEN 'overlap' WHEN 5 THEN 'invalid range' ELSE 'done' END AS outcome FROM m WHERE r % 6 <> 1
UNION ALL SELECT document_id, id + 1000000000, 'split page out of range' FROM m WHERE r % 6 = 0 UNION ALL SELECT document_id, id + 2000000000, 'unknown span' FROM m WHERE r % 6 = 2""",
    "e23_fact_pages": f"""WITH {_SPANS}, f AS (SELECT *, ps + id % 9 AS page FROM m)
SELECT document_id, id AS fact_id, CASE WHEN gone THEN before WHEN r % 6 = 0 AND page >= ps + 4 THEN -id ELSE id END AS span_id,
  page - CASE WHEN gone THEN ps - 10 WHEN r % 6 = 0 AND page >= ps + 4 THEN ps + 4 WHEN r % 6 = 3 THEN ps + 2 ELSE ps END + 1 AS source_page, page AS pdf_page FROM f""",
    "j04_registry_fields": f"""WITH {_BASE}, f AS (SELECT o_orderstatus AS family, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN l_partkey % 61 = 0 THEN 'new' || (l_partkey % 4) ELSE 'f' || (l_partkey % 53) END AS field_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT f.family, f.year, f.field_id, r.line, r.node, CASE WHEN r.line IS NOT NULL THEN 'yes' WHEN f.year IN (FROM y) THEN 'field' ELSE 'year' END AS registered, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
FROM f LEFT JOIN r ON r.family = f.family AND r.year = f.year AND r.field_id = f.field_id GROUP BY ALL""",
    "j19_dense_spread": f"""WITH {FACTS_SQL}, best AS (SELECT * FROM ranked WHERE status IN ('accepted', 'suggested') QUALIFY row_number() OVER (PARTITION BY entity_id, node, period_label ORDER BY status <> 'accepted', rank DESC, created_at, id) = 1),
p AS (SELECT DISTINCT entity_id, period_label FROM best), n AS (SELECT unnest({list(NODES)}) AS node)
SELECT p.entity_id, p.period_label, n.node, b.value_cents, b.status FROM p CROSS JOIN n LEFT JOIN best b ON b.entity_id = p.entity_id AND b.period_label = p.period_label AND b.node = n.node""",
    "t30_tolerant_rows": """SELECT event_id, CASE WHEN event_id % 11 > 6 THEN CAST(props ->> '$.k' AS INTEGER) END AS k,
  CASE event_id % 11 WHEN 1 THEN 'missing' WHEN 4 THEN 'no value' WHEN 5 THEN CASE WHEN event_id > 0 THEN 'negative' END WHEN 0 THEN 'malformed' WHEN 2 THEN 'malformed' WHEN 3 THEN 'malformed' WHEN 6 THEN 'malformed' END AS reason FROM events""",
    "t28_requested_items": """SELECT o_orderkey, CAST(0 AS INTEGER) AS at, o_orderstatus AS key, o_orderpriority AS label, '' AS families FROM orders WHERE o_orderkey % 6 IN (3, 4)
UNION ALL SELECT o_orderkey, 1, 'w2', 'w2', 'W2' FROM orders WHERE o_orderkey % 6 = 4 UNION ALL SELECT o_orderkey, 2, NULL, 'x', '' FROM orders WHERE o_orderkey % 6 = 4""",
}
