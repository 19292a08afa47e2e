"""Metrics of a loan scenario, and the pro-forma projection of a base period line by line. Exact cents throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fintally.functions.money import decimal_ratio, half_even, times_ratio
from fintally.operators import loans

# Lines that a projection leaves out unless a person says otherwise, non-cash ones and the old debt's interest.
EXCLUDED = ("is.opex.depreciation", "is.opex.amortization", "is.other.interest_expense")


def scenario_metrics(cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """deal_id, entity_id, period_label, metric, kind, cents, mantissa and scale of each deal's scenario.

    cells: deal_id, entity_id, period_label, metric, cents (cfads and personal_cash_flow are used). scenarios, a row for each
    deal: deal_id, principal_cents, term_months, steps, interest_only, equity_injection_cents, project_cost_cents, guaranty_bps.
    Of the deal: annual_debt_service, loan_amount, term_months (scale 0), equity_injection_pct (scale 4, where a positive cost
    and an injection are known), sba_guaranty_pct (scale 4, where known). Where debt service is positive: dscr_business of each
    cell with cash flow, and dscr_global of all entities of a period. Deals without a scenario have no rows.
    """
    service = loans.summaries(scenarios.withColumnRenamed("deal_id", "loan_id")).select(F.col("loan_id").alias("deal_id"), F.col("annual_debt_service").alias("ads"))
    s = scenarios.join(service, "deal_id")
    cents = lambda m, c: F.struct(F.lit(m).alias("metric"), F.lit("cents").alias("kind"), c.cast("long").alias("cents"), F.lit(None).cast("long").alias("mantissa"), F.lit(None).cast("int").alias("scale"))
    ratio = lambda m, c, k: F.struct(F.lit(m).alias("metric"), F.lit("ratio").alias("kind"), F.lit(None).cast("long").alias("cents"), c.cast("long").alias("mantissa"), F.lit(k).alias("scale"))
    cost = F.when(F.col("project_cost_cents") > 0, F.col("project_cost_cents"))
    injected = F.when(cost.isNotNull() & F.col("equity_injection_cents").isNotNull(), decimal_ratio(F.col("equity_injection_cents"), F.coalesce(cost, F.lit(1)), 4))
    rows = [
        cents("annual_debt_service", F.col("ads")),
        cents("loan_amount", F.col("principal_cents")),
        ratio("term_months", F.col("term_months"), 0),
        F.when(injected.isNotNull(), ratio("equity_injection_pct", injected, 4)),
        F.when(F.col("guaranty_bps").isNotNull(), ratio("sba_guaranty_pct", F.col("guaranty_bps"), 4)),
    ]
    place = [F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("string").alias("period_label")]
    deal = s.select("deal_id", *place, F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    flows = cells.where("metric in ('cfads', 'personal_cash_flow') and cents is not null").join(s.where("ads > 0").select("deal_id", "ads"), "deal_id")
    own = flows.where("metric = 'cfads'").select("deal_id", "entity_id", "period_label", decimal_ratio(F.col("cents"), F.col("ads"), 2).alias("m"), F.lit("dscr_business").alias("name"))
    every = flows.groupBy("deal_id", "period_label").agg(F.sum("cents").alias("cents"), F.first("ads").alias("ads"))
    every = every.select("deal_id", F.lit(None).cast("long").alias("entity_id"), "period_label", decimal_ratio(F.col("cents"), F.col("ads"), 2).alias("m"), F.lit("dscr_global").alias("name"))
    covered = own.unionByName(every).select("deal_id", "entity_id", "period_label", F.col("name").alias("metric"), F.lit("ratio").alias("kind"), F.lit(None).cast("long").alias("cents"), F.col("m").alias("mantissa"), F.lit(2).alias("scale"))
    return deal.unionByName(covered)


def default_treatment(key: Column) -> Column:
    """`excluded` for non-cash lines and interest, else `ratio`; a start that a person edits."""
    return F.when(key.isin(*EXCLUDED), "excluded").otherwise("ratio")


def _years(base: DataFrame) -> DataFrame:
    """A row for each year of each base, 0 being the annualized base: entity_id, year, revenue_cents, of, months."""
    months, growth = F.col("months_covered"), F.col("growth_bps")
    checked = F.when(months.between(1, 12) & (F.size(growth) > 0), months).otherwise(F.raise_error(F.lit("months_covered must be 1 to 12, with one projected year at least")))
    b = base.withColumn("months", checked.cast("int")).withColumn("annual", times_ratio(F.col("revenue_cents"), F.lit(12), F.col("months")))
    grown = lambda cents, bps: times_ratio(cents, F.coalesce(bps, F.lit(0)) + 10_000, F.lit(10_000))
    first = F.coalesce("year1_revenue_cents", grown(F.col("annual"), growth[0]))
    later = F.aggregate(F.slice(growth, 2, F.size(growth)), F.array(F.col("annual"), first), lambda acc, g: F.array_append(acc, grown(F.element_at(acc, -1), g)))
    return b.select("entity_id", F.posexplode(later).alias("year", "revenue_cents"), F.col("revenue_cents").alias("of"), "months")


def projected_lines(base: DataFrame, lines: DataFrame) -> DataFrame:
    """entity_id, year (0: the annualized base), key and amount_cents of each line that is not excluded.

    base: entity_id, months_covered, revenue_cents, growth_bps array<int>, year1_revenue_cents (null: from growth). lines:
    entity_id, key, amount_cents over the base period, treatment (null: the key's own). `fixed` lines annualize and stay;
    `ratio` lines keep their share of the base's revenue, with no rounded percentage in between, and are 0 where that is 0.
    """
    own = F.coalesce("treatment", default_treatment(F.col("key")))
    kept = lines.withColumn("treatment", own).where("treatment <> 'excluded'").select("entity_id", "key", "amount_cents", "treatment")
    both = kept.join(_years(base), "entity_id")
    amount = F.col("amount_cents")
    annual = times_ratio(amount, F.lit(12), F.col("months"))
    share = F.when(F.col("of") == 0, 0).otherwise(half_even(amount.cast("decimal(38,0)") * F.col("revenue_cents"), F.when(F.col("of") == 0, 1).otherwise(F.col("of"))))
    return both.select("entity_id", "year", "key", F.when((F.col("year") == 0) | (F.col("treatment") == "fixed"), annual).otherwise(share).cast("long").alias("amount_cents"))


def projected_years(base: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each year of each base: revenue, operating expenses, NOI, CFADS, debt service, DSCR (scale 2; null without debt).

    base as for projected_lines, with replacement_salary_cents and debt_service_cents (null: none). A base without lines has years too.
    """
    spent = projected_lines(base, lines).groupBy("entity_id", "year").agg(F.sum("amount_cents").alias("opex_cents"))
    owed = base.select("entity_id", F.coalesce("replacement_salary_cents", F.lit(0)).alias("salary"), F.coalesce("debt_service_cents", F.lit(0)).alias("owed"))
    y = _years(base).join(spent, ["entity_id", "year"], "left").join(owed, "entity_id")
    y = y.withColumn("opex_cents", F.coalesce("opex_cents", F.lit(0))).withColumn("noi_cents", F.col("revenue_cents") - F.col("opex_cents"))
    y = y.withColumn("cfads_cents", F.col("noi_cents") - F.col("salary"))
    dscr = F.when(F.col("owed") != 0, decimal_ratio(F.col("cfads_cents"), F.when(F.col("owed") != 0, F.col("owed")).otherwise(1), 2))
    return y.select("entity_id", "year", "revenue_cents", "opex_cents", "noi_cents", "cfads_cents", F.col("owed").alias("debt_service_cents"), dscr.alias("dscr_mantissa"))
