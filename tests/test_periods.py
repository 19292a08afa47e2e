"""Printed periods: headers, texts and columns of grids."""

import datetime

import pytest
from pyspark.sql import functions as F

from fintally.operators import periods, statements

HEADERS = {
    "FY2024": ("fiscal_year", "FY2024", "2024-01-01", "2024-12-31"),
    "2023": ("fiscal_year", "FY2023", "2023-01-01", "2023-12-31"),
    "FYE 2023": ("fiscal_year", "FY2023", "2023-01-01", "2023-12-31"),
    "Jan - Dec 2024": ("fiscal_year", "FY2024", "2024-01-01", "2024-12-31"),
    "January December 2024": ("fiscal_year", "FY2024", "2024-01-01", "2024-12-31"),
    "January through December 2024": ("fiscal_year", "FY2024", "2024-01-01", "2024-12-31"),
    "January 1 - June 30, 2025": ("interim", "2025-01..2025-06", "2025-01-01", "2025-06-30"),
    "January through June 30,2025": ("interim", "2025-01..2025-06", "2025-01-01", "2025-06-30"),
    "Jan 2025": ("interim", "2025-01", "2025-01-01", "2025-01-31"),
    " Feb.   2024 ": ("interim", "2024-02", "2024-02-01", "2024-02-29"),
    "Q1 2025": ("interim", "Q1 2025", "2025-01-01", "2025-03-31"),
    "3rd Quarter 2024": ("interim", "Q3 2024", "2024-07-01", "2024-09-30"),
    "TTM Jun 2025": ("ttm", "TTM 2025-06", "2024-07-01", "2025-06-30"),
    "TTM Dec 2025": ("ttm", "TTM 2025-12", "2025-01-01", "2025-12-31"),
    "Trailing Twelve Months ended June 30, 2025": ("ttm", "TTM 2025-06", "2024-07-01", "2025-06-30"),
    "As of Dec 31, 2024": ("fiscal_year", "As of 2024-12-31", "2024-12-31", "2024-12-31"),
    "June 30, 2025": ("interim", "As of 2025-06-30", "2025-06-30", "2025-06-30"),
    "April 1-30, 2025": ("interim", "2025-04", "2025-04-01", "2025-04-30"),
    "April 1-15, 2025": ("interim", "2025-04-01..2025-04-15", "2025-04-01", "2025-04-15"),
    "10/31/24": ("interim", "2024-10", "2024-10-01", "2024-10-31"),
    "02/28/2025": ("interim", "2025-02", "2025-02-01", "2025-02-28"),
    "For the Year Ended December 31, 2024": ("fiscal_year", "FY2024", "2024-01-01", "2024-12-31"),
    "Twelve Months Ended June 30, 2025": ("ttm", "TTM 2025-06", "2024-07-01", "2025-06-30"),
    "Fiscal Year Ended June 30, 2025": ("fiscal_year", "FYE 2025-06-30", "2024-07-01", "2025-06-30"),
    "Year Ended June 15, 2025": ("fiscal_year", "FYE 2025-06-15", "2024-06-16", "2025-06-15"),
    "Year Ended February 28, 2024": ("fiscal_year", "FYE 2024-02-28", "2023-02-01", "2024-02-28"),
    "PERIOD ENDED DECEMBER 31, 2024": ("fiscal_year", "FY2024", "2024-01-01", "2024-12-31"),
}
NO_HEADERS = ("Actual", "Budget", "% of Income", "", None, "Notes", "13 2024", "10/15/24", "13/31/24", "Period Ended June 30, 2025", "June 31, 2025", "Dec - Jan 2025", "April 15-1, 2025", "1989", "2101", "Q5 2024", "Janu 2025", "t-12 Jun 2024")
TEXTS = {
    "Profit and Loss\nJanuary December 2024": "FY2024",
    "Accrual Basis Thursday, February 6, 2025 02:13 PM GMT-05:00": None,
    "Printed Thursday, February 6, 2025 02:13 PM": None,
    "Acme Hotels & Resorts Inc.\nApril 1-30, 2025": "2025-04",
    "Acme Lodge\nProfit and Loss\nApril 2025": "2025-04",
    "Green Petroleum And Investment LLC Profit & Loss January through June 30,2025": "2025-01..2025-06",
    "Acme LLC Balance Sheet As of May 31, 2025 Accrual Basis": "As of 2025-05-31",
    "ACME HOTEL, LLC STATEMENT OF REVENUES & EXPENSES PERIOD ENDED DECEMBER 31, 2024": "FY2024",
    "Dec - Mar 2021": "2021-03",
    "as of June 31, 2025, and as of June 30, 2025": "As of 2025-06-30",
    "no dates here at all": None,
    None: None,
}


def test_headers(spark):
    df = spark.createDataFrame([(t,) for t in [*HEADERS, *NO_HEADERS]], "t string").select("t", periods.period_header(F.col("t")).alias("p"))
    for r in df.collect():
        got = r["p"] and (r["p"]["kind"], r["p"]["label"], str(r["p"]["start_date"]), str(r["p"]["end_date"]))
        assert got == HEADERS.get(r["t"]), r


def test_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", periods.period_in_text(F.col("t"))["label"].alias("label"))
    assert {r["t"]: r["label"] for r in df.collect()} == TEXTS


def bound(spark, headers, body=("1,000.00",), titles=(), labels=()):
    """Labels of the columns of one grid: a header row above rows of the same cells."""
    cells = [(1, 0, i + 1, h) for i, h in enumerate(headers) if h is not None] + [(1, r + 1, i + 1, t) for r, t in enumerate(body) for i in range(len(headers))]
    cells += [(1, r, 0, t) for r, t in enumerate(labels)]
    out = periods.bound_columns(
        spark.createDataFrame(cells, "grid_id long, row int, col int, text string"), spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "grid_id long, position int, text string")
    )
    return {r["col"]: r.asDict() for r in out.collect()}


MONTHS_24 = [f"{m} 2024" for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]
ROLLING = [f"{m} 2024" for m in ("Oct", "Nov", "Dec")] + [f"{m} 2025" for m in "Jan Feb Mar Apr May Jun Jul Aug Sep".split()]


@pytest.mark.parametrize(
    ("headers", "want"),
    [
        (["FY2024", "FY2023", "% Change"], ["FY2024", "FY2023", None]),
        (["FY2024", "Jan - Jun 2025", "TTM Jun 2025"], ["FY2024", "2025-01..2025-06", "TTM 2025-06"]),
        ([*ROLLING, "Total"], [None] * 12 + ["TTM 2025-09"]),
        ([*MONTHS_24, "TOTAL"], [None] * 12 + ["FY2024"]),
        (["Jan 2025", "Feb 2025", "Mar 2025", "Total"], [None] * 3 + ["2025-01..2025-03"]),
        (["Mar 2025", "Jan 2025", "Total for period", "Feb 2025"], [None, None, "2025-01..2025-03", None]),
        (["Jan 2025", "Mar 2025", "Total"], [None, None, None]),
        (["Jan 2025", "Jan 2025", "Total"], [None, None, None]),
        (["Jan 2025", "Feb 2025", "Budget", "Total"], [None] * 4),
        (["Jan 2025", "Total", "Total"], [None] * 3),
        (["FY2024", "Total"], [None, None]),
        (["Total"], [None]),
    ],
)
def test_columns(spark, headers, want):
    got = bound(spark, headers)
    assert list(got) and sorted(got) == list(range(1, len(headers) + 1))
    for i, label in enumerate(want):
        if label or headers[i].lower().startswith(("total", "budget", "%")):
            assert got[i + 1]["label"] == label and (label is None) == (got[i + 1]["source"] is None), got


def test_titles_and_scales(spark):
    one = bound(spark, [None], body=("870,626.12",), titles=("Acme LLC", "Balance Sheet (amounts in thousands)", "As of May 31, 2025", "As of May 31, 2026"))
    assert (one[1]["label"], one[1]["source"], one[1]["scale"], one[1]["header_rows"]) == ("As of 2025-05-31", "title", 1000, [])
    two = bound(spark, [None, None], titles=("January through June 30,2025",))
    assert two[1]["label"] is two[2]["label"] is None
    label_only = spark.createDataFrame([(1, 0, 1, "Equity"), (1, 1, 2, "$ 500.00"), (1, 2, 2, "97,185.57"), (1, 2, 0, "in millions"), (2, 9, 1, "x")], "grid_id long, row int, col int, text string")
    titles = spark.createDataFrame([(1, 0, "Balance Sheet As of May 31, 2025, in thousands")], "grid_id long, position int, text string")
    got = {(r["grid_id"], r["col"]): r for r in periods.bound_columns(label_only, titles).collect()}
    assert got[1, 2]["label"] == "As of 2025-05-31" and got[1, 1]["label"] is None and got[1, 2]["scale"] == 1_000_000 and got[2, 1]["label"] is None
    late = bound(spark, [None, "FY2020"], body=("x", "y", "Q1 2020", "z", "FY2019"))
    assert late[1]["label"] == "Q1 2020" and late[2]["label"] == "FY2020" and late[1]["header_rows"] == [0, 3] and late[1]["start_date"] == datetime.date(2020, 1, 1)
    assert bound(spark, [None], body=("a", "b", "c", "d", "e", "FY2019"))[1]["label"] is None


def test_structure_issues(spark):
    rows = [(1, n, "FY1", t, c) for n, t, c in [("is.net_income", "total", 500), ("is.revenue.total", "total", 1000), ("is.opex.total", "item", 200), ("is.opex.total", "item", 199), ("bs.assets.total", "total", 900), ("bs.liabilities.total", "total", 500), ("bs.equity.total", "total", 199)]]
    rows += [(2, n, "FY1", "total", c) for n, c in [("is.net_income", 500), ("is.revenue.total", 1000), ("is.opex.total", 400), ("bs.assets.total", 900), ("bs.liabilities.total", 500), ("bs.equity.total", 200), ("bs.total_liabilities_equity", 1101)]]
    rows += [(3, "x", "FY1", "subtotal", 5), (3, "x", "FY1", "total", 205), (3, "y", "FY1", "item", 5), (3, "y", "FY1", "item", 505), (4, "is.net_income", "FY1", "total", 5), (4, "bs.assets.total", "FY1", "total", 5)]
    got = statements.structure_issues(spark.createDataFrame(rows, "grid_id long, node string, period_label string, type string, value_cents long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "FY1", "G1", "is.net_income", 101), (1, "FY1", "G2", "bs", 201), (2, "FY1", "G2", "bs", 201), (3, "FY1", "G1", "x", 200)]


def test_words_of_grand_totals():
    for label in ("Net Income", "TOTAL ASSETS", "Total Liabilities and Equity", "total liabilities and stockholders' equity", "Total liabilities and members' equity", "Total equity and liabilities"):
        assert statements.GRAND.match(label), label
    for label in ("Grand total", "Total liabilities", "Total equity", "Total revenue", "Total liabilities and capital", "Total assetsx"):
        assert not statements.GRAND.match(label), label


def test_grids_are_dealt_before_they_are_read(spark):
    """Of few files few tasks would read all cells and titles; no cell is shuffled."""
    from fintally.plans import periods as plans

    plan = plans.columns(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan, plan
