"""Best facts and the metric graph over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fintally.functions.money import decimal_ratio
from fintally.model import NODES


def best_facts(facts: DataFrame, *keys: str) -> DataFrame:
    """One fact for each key: the highest authority, then the oldest, then the least id. Combines map-side."""
    by = keys or ("entity_id", "period_label", "node")
    order = F.struct(-F.col("rank"), "created_at", "id")
    return facts.groupBy(*by).agg(F.min_by(F.struct("id", "method", "value_cents"), order).alias("best")).select(*by, "best.*")


def spread(facts: DataFrame) -> DataFrame:
    """A row for each entity, node and period found: the best accepted fact, else the best suggested one; other states never show."""
    open_facts = facts.where("status in ('accepted', 'suggested') and node is not null")
    order = F.struct(F.col("status") != "accepted", -F.col("rank"), "created_at", "id")
    found = open_facts.groupBy("entity_id", "node", "period_label").agg(F.min_by(F.struct("id", "method", "status", "value_cents"), order).alias("best"))
    return found.select("entity_id", "node", "period_label", "best.*")


def ledger(best: DataFrame, nodes: tuple[str, ...] = NODES) -> DataFrame:
    """A row for each (entity, period) with a column for each node, in one aggregation."""
    return best.groupBy("entity_id", "period_label").agg(*(F.max(F.when(F.col("node") == n, F.col("value_cents"))).alias(n) for n in nodes))


def _node(name: str, nodes: tuple[str, ...]) -> Column:
    return F.col(f"`{name}`") if name in nodes else F.lit(None).cast("long")


def _sum(columns: list[Column]) -> Column:
    """Sum of the columns that are not null; null if none is."""
    if not columns:
        return F.lit(None).cast("long")
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in columns))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def section(prefix: str, nodes: tuple[str, ...] = NODES) -> Column:
    """The stated total of a section, else the sum of every node below it (nested totals included)."""
    below = [n for n in nodes if n.startswith(f"{prefix}.") and n != f"{prefix}.total"]
    return F.coalesce(_node(f"{prefix}.total", nodes), _sum([_node(n, nodes) for n in below]))


def metrics(wide: DataFrame, addbacks: DataFrame, *, replacement_salary_cents: int = 0, nodes: tuple[str, ...] = NODES) -> DataFrame:
    """(entity_id, period_label, metric, kind, cents, mantissa, scale) of each ledger row; absent metrics have no row."""
    owner = addbacks.where("state = 'accepted' and category not in ('depreciation_amortization', 'interest')")
    owner = owner.groupBy("entity_id", "period_label").agg(F.sum("amount_cents").alias("owner"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    node = lambda n: _node(n, nodes)
    w = wide.join(owner, ["entity_id", "period_label"], "left")
    w = w.withColumns({"revenue_total": section("is.revenue", nodes), "cogs": section("is.cogs", nodes), "opex": section("is.opex", nodes), "other": section("is.other", nodes)})
    w = w.withColumn("gross_profit", F.coalesce(node("is.gross_profit"), F.col("revenue_total") - zero(F.col("cogs"))))
    pretax = F.coalesce(node("is.pretax_income"), F.col("gross_profit") - zero(F.col("opex")) + zero(F.col("other")))
    derived = F.when(F.col("gross_profit").isNotNull(), pretax - zero(node("is.income_tax")))
    w = w.withColumn("net_income", F.coalesce(node("is.net_income"), derived))
    bridge = ("is.other.interest_expense", "is.income_tax", "is.opex.depreciation", "is.opex.amortization")
    w = w.withColumn("ebitda", reduce(lambda a, n: a + zero(node(n)), bridge, F.col("net_income")))
    w = w.withColumn("sde", F.col("ebitda") + zero(F.col("owner"))).withColumn("cfads", F.col("sde") - replacement_salary_cents)
    w = w.withColumns({"ca": section("bs.assets.current", nodes), "cl": section("bs.liabilities.current", nodes), "liabilities": section("bs.liabilities", nodes)})
    w = w.withColumn("working_capital", F.col("ca") - F.col("cl"))
    w = w.withColumn("tangible_net_worth", section("bs.equity", nodes) - zero(node("bs.assets.other.intangibles")) - zero(node("bs.assets.other.goodwill")))
    w = w.withColumns({"personal_income_total": section("pcf.income", nodes), "personal_outflow_total": section("pcf.outflow", nodes)})
    some = F.coalesce("personal_income_total", "personal_outflow_total").isNotNull()
    w = w.withColumn("personal_cash_flow", F.when(some, zero(F.col("personal_income_total")) - zero(F.col("personal_outflow_total"))))
    ratio = lambda n, d: F.when(d > 0, decimal_ratio(n, F.when(d > 0, d), 2))
    w = w.withColumns({"current_ratio": ratio(F.col("ca"), F.col("cl")), "debt_to_tnw": ratio(F.col("liabilities"), F.col("tangible_net_worth"))})
    cents = ("revenue_total", "gross_profit", "net_income", "ebitda", "sde", "cfads", "working_capital", "tangible_net_worth", "personal_income_total", "personal_outflow_total", "personal_cash_flow")
    rows = [F.struct(F.lit(m).alias("metric"), F.lit("cents").alias("kind"), F.col(m).cast("long").alias("cents"), F.lit(None).cast("long").alias("mantissa"), F.lit(None).cast("int").alias("scale")) for m in cents]
    rows += [F.struct(F.lit(m).alias("metric"), F.lit("ratio").alias("kind"), F.lit(None).cast("long").alias("cents"), F.col(m).alias("mantissa"), F.lit(2).alias("scale")) for m in ("current_ratio", "debt_to_tnw")]
    tall = w.select("entity_id", "period_label", F.inline(F.array(*rows)))
    return tall.where("cents is not null or mantissa is not null")


def global_cash_flow(tall: DataFrame) -> DataFrame:
    """Cash flow of all entities for each period: cfads plus personal cash flow."""
    return tall.where("metric in ('cfads', 'personal_cash_flow')").groupBy("period_label").agg(F.sum("cents").alias("global_cash_flow"))
