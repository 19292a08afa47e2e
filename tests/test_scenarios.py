"""Scenario metrics and projections by hand."""

import pytest

from fintally.operators import loans, scenarios

SCENARIO = "deal_id long, principal_cents long, term_months int, steps array<struct<month: int, bps: int>>, interest_only int, equity_injection_cents long, project_cost_cents long, guaranty_bps int"
BASE = "entity_id long, months_covered int, revenue_cents long, growth_bps array<int>, year1_revenue_cents long, replacement_salary_cents long, debt_service_cents long"
LINE = "entity_id long, key string, amount_cents long, treatment string"


def test_scenario_metrics(spark):
    steps = [(1, 1050)]
    plans = [(1, 50_000_000, 120, steps, 0, 7_500_000, 75_000_000, 7500), (2, 100, 360, [(1, 0)], 0, 5, 0, None), (3, 10_000, 12, steps, 0, None, 10, None)]
    cells = [(1, 10, "FY2023", "cfads", 12_000_000), (1, 11, "FY2023", "cfads", -1_000_000), (1, 11, "FY2023", "personal_cash_flow", 500_000), (1, 12, "FY2022", "personal_cash_flow", 100), (1, 10, "FY2023", "ebitda", 1), (2, 20, "FY2023", "cfads", 5), (9, 90, "FY2023", "cfads", 5)]
    out = scenarios.scenario_metrics(spark.createDataFrame(cells, "deal_id long, entity_id long, period_label string, metric string, cents long"), spark.createDataFrame(plans, SCENARIO))
    got = {(r["deal_id"], r["entity_id"], r["period_label"], r["metric"]): (r["cents"], r["mantissa"], r["scale"]) for r in out.collect()}
    ads = 12 * loans.schedule(50_000_000, 120, steps)[0][1]
    ratio = lambda c: (None, loans.round_half_even(c * 100, ads), 2)
    third = 12 * loans.schedule(10_000, 12, steps)[0][1]
    assert got == {
        (1, None, None, "annual_debt_service"): (ads, None, None), (1, None, None, "loan_amount"): (50_000_000, None, None), (1, None, None, "term_months"): (None, 120, 0),
        (1, None, None, "equity_injection_pct"): (None, 1000, 4), (1, None, None, "sba_guaranty_pct"): (None, 7500, 4),
        (1, 10, "FY2023", "dscr_business"): ratio(12_000_000), (1, 11, "FY2023", "dscr_business"): ratio(-1_000_000), (1, None, "FY2023", "dscr_global"): ratio(11_500_000), (1, None, "FY2022", "dscr_global"): ratio(100),
        # nothing is owed, and the project costs nothing
        (2, None, None, "annual_debt_service"): (0, None, None), (2, None, None, "loan_amount"): (100, None, None), (2, None, None, "term_months"): (None, 360, 0),
        (3, None, None, "annual_debt_service"): (third, None, None), (3, None, None, "loan_amount"): (10_000, None, None), (3, None, None, "term_months"): (None, 12, 0),
    }


def years(spark, base, lines):
    df, l = spark.createDataFrame([base], BASE), spark.createDataFrame(lines, LINE)  # noqa: E741
    return {r["year"]: tuple(r)[2:] for r in scenarios.projected_years(df, l).collect()}, {(r["year"], r["key"]): r["amount_cents"] for r in scenarios.projected_lines(df, l).collect()}


def test_nine_months_with_every_treatment(spark):
    lines = [(1, "is.cogs", 300_000, None), (1, "is.opex.rent", 90_000, "fixed"), (1, "is.opex.depreciation", 50_000, None), (1, "is.opex.amortization", 10_000, "ratio"), (1, "is.opex.other", 5, "excluded")]
    total, line = years(spark, (1, 9, 900_000, [0, 1000], None, 100_000, 200_000), lines)
    assert line == {(0, "is.cogs"): 400_000, (1, "is.cogs"): 400_000, (2, "is.cogs"): 440_000, (0, "is.opex.rent"): 120_000, (1, "is.opex.rent"): 120_000, (2, "is.opex.rent"): 120_000, (0, "is.opex.amortization"): 13_333, (1, "is.opex.amortization"): 13_333, (2, "is.opex.amortization"): 14_667}
    assert total[1] == (1_200_000, 533_333, 666_667, 566_667, 200_000, 283) and total[2] == (1_320_000, 574_667, 745_333, 645_333, 200_000, 323) and len(total) == 3


def test_given_first_year_and_no_debt(spark):
    total, line = years(spark, (1, 12, 1000, [500, 500], 2000, None, None), [(1, "is.cogs", 333, "ratio")])
    assert total == {0: (1000, 333, 667, 667, 0, None), 1: (2000, 666, 1334, 1334, 0, None), 2: (2100, 699, 1401, 1401, 0, None)}


def test_no_revenue_and_no_lines(spark):
    total, line = years(spark, (1, 12, 0, [100], None, None, 50), [(1, "is.cogs", 333, "ratio"), (1, "is.opex.rent", 12, "fixed")])
    assert total[1] == (0, 12, -12, -12, 50, -24) and line[1, "is.cogs"] == 0
    assert years(spark, (1, 1, 10, [100], None, None, None), [(2, "is.cogs", 1, None)])[0] == {0: (120, 0, 120, 120, 0, None), 1: (121, 0, 121, 121, 0, None)}


@pytest.mark.parametrize(("months", "growth"), [(0, [1]), (13, [1]), (12, [])])
def test_refused_bases(spark, months, growth):
    with pytest.raises(Exception, match="months_covered"):
        years(spark, (1, months, 10, growth, None, None, None), [(1, "is.cogs", 1, None)])
