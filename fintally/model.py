"""Fixed values of the domain, and the facts that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.functions.money import from_double

# Authority of extraction methods; taxonomy nodes that lineitem rows are dealt to.
METHODS = ("vendor", "llm", "consensus", "transcript", "human", "override", "vendor")
RANK = {"vendor": 0, "llm": 0, "consensus": 1, "transcript": 2, "human": 3, "override": 4}
STATUS = {"N": "accepted", "A": "suggested", "R": "rejected"}
NODES = (
    "is.revenue.total",
    "is.revenue.product_sales",
    "is.revenue.services",
    "is.cogs.total",
    "is.cogs.materials",
    "is.gross_profit",
    "is.opex.total",
    "is.opex.depreciation",
    "is.opex.amortization",
    "is.opex.officer_comp",
    "is.opex.management_fees",
    "is.other.interest_expense",
    "is.other.one_time_items",
    "is.other.insurance_proceeds",
    "is.income_tax",
    "is.net_income",
    "bs.assets.total",
    "bs.assets.current.total",
    "bs.assets.other.goodwill",
    "bs.liabilities.total",
    "bs.liabilities.current.total",
    "bs.equity.total",
    "pcf.income.wages",
    "pcf.outflow.mortgage",
)
# Addback rules (node, category, sign).
ADDBACK_RULES = (
    ("is.opex.depreciation", "depreciation_amortization", 1),
    ("is.opex.amortization", "depreciation_amortization", 1),
    ("is.other.interest_expense", "interest", 1),
    ("is.opex.officer_comp", "officer_comp", 1),
    ("is.opex.management_fees", "discretionary", 1),
    ("is.other.one_time_items", "one_time", 1),
    ("is.other.insurance_proceeds", "one_time", -1),
    ("is.other.ppp_erc_grants", "one_time", -1),
)
CATEGORIES = ("depreciation_amortization", "interest", "officer_comp", "discretionary", "one_time", "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, rows: int) -> int:
    """Partitions of about so many rows each, and no fewer than its cores: for what grows behind a shuffle, so that no task spills.

    df is a table as it is read, whose files tell its rows.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str, *, by_entity: bool = False) -> DataFrame:
    """Facts of lineitem joined to orders: id, entity_id, period_label, node, method, status, document_id, value_cents, created_at, rank.

    With by_entity they are dealt by entity_id while they are still the keys of a fact, which ids, nodes and methods are
    made of behind the shuffle: what is grouped by entity and more needs no other one, and its readers share this one.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    cents = from_double(F.col("l_extendedprice")).alias("cents")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", cents)
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if by_entity:
        # no rows are combined before this shuffle, and what is made of them is wider: a task has a bounded share
        joined = joined.repartition(parts_of(table(spark, sf_dir, "lineitem"), 60_000), "o_custkey")
    method = pick(METHODS, F.col("l_linenumber"))
    return joined.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents").alias("id"),
        F.col("o_custkey").alias("entity_id"),
        F.concat(F.lit("FY"), "year").alias("period_label"),
        pick(NODES, F.col("l_partkey")).alias("node"),
        method.alias("method"),
        F.when(F.col("l_returnflag") == "N", "accepted").when(F.col("l_returnflag") == "A", "suggested").otherwise("rejected").alias("status"),
        F.col("l_suppkey").alias("document_id"),
        F.col("cents").alias("value_cents"),
        F.col("l_shipdate").alias("created_at"),
        rank(method).alias("rank"),
    )


def rank(method: Column) -> Column:
    return F.when(method == "override", 4).when(method == "human", 3).when(method == "transcript", 2).when(method == "consensus", 1).otherwise(0)


def addbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addbacks of discounted lineitem rows: entity_id, period_label, category, state, amount_cents."""
    lines, orders = table(spark, sf_dir, "lineitem").where("l_discount > 0"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("entity_id"),
        F.concat(F.lit("FY"), F.year("o_orderdate")).alias("period_label"),
        pick(CATEGORIES, F.col("l_partkey")).alias("category"),
        F.when(F.col("l_linestatus") == "F", "accepted").otherwise("suggested").alias("state"),
        from_double(F.col("l_extendedprice")).alias("amount_cents"),
    )


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The facts and addbacks in SQL, as the head of a query: WITH ..., then the query's own.
FACTS_SQL = f"""
facts0 AS (SELECT l.*, o.o_custkey, o.o_orderdate, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
facts AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) AS id, o_custkey AS entity_id,
  'FY' || year(o_orderdate) AS period_label, {_list(NODES)}[l_partkey % {len(NODES)} + 1] AS node,
  {_list(METHODS)}[l_linenumber % {len(METHODS)} + 1] AS method, {_case("l_returnflag", STATUS)} AS status,
  l_suppkey AS document_id, cents AS value_cents, l_shipdate AS created_at,
  list_position(['consensus', 'transcript', 'human', 'override'], {_list(METHODS)}[l_linenumber % {len(METHODS)} + 1]) AS rank0 FROM facts0),
ranked AS (SELECT *, coalesce(rank0, 0) AS rank FROM facts),
addbacks AS (SELECT o_custkey AS entity_id, 'FY' || year(o_orderdate) AS period_label, {_list(CATEGORIES)}[l_partkey % {len(CATEGORIES)} + 1] AS category,
  CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'suggested' END AS state, cents AS amount_cents FROM facts0 WHERE l_discount > 0)"""

BEST_SQL = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label, node ORDER BY rank DESC, created_at, id) AS place
  FROM ranked WHERE status = 'accepted') WHERE place = 1),
open_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label, node ORDER BY rank DESC, created_at, id) AS place
  FROM ranked WHERE status <> 'rejected') WHERE place = 1)"""


def half_even_sql(n: str, d: str) -> str:
    """Half-even n / d in SQL, over HUGEINT."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    whole, rest = f"(abs({n}) // abs({d}))", f"(abs({n}) % abs({d}))"
    up = f"CASE WHEN 2 * {rest} > abs({d}) OR (2 * {rest} = abs({d}) AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST((CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END) * ({whole} + {up}) AS BIGINT)"
