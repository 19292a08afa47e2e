"""Queries of printed periods over orders' dates, with SQL twins that never parse: they compute each period from its date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.model import parts_of
from fintally.operators import periods
from fintally.plans.portfolio import K, case, case_sql, orders

#: Ways to print a date, by key: {M} and {MMM} the month, {d} and {L} the day and the last one, {y} the year.
FORMS = (
    "FY{y}", "{y}", "Q{q} {y}", "{q3} Quarter {y}", "{MMM} {y}", "{M} {y}", "Jan - {MMM} {y}", "January through {M} {L},{y}",
    "For the Year Ended {M} {L}, {y}", "Twelve Months Ended {M} {L}, {y}", "PERIOD ENDED {M} {d}, {y}", "As of {MMM}. {d}, {y}",
    "{M} {d}, {y}", "{mm}/{dd}/{yy}", "{M} 1-{L}, {y}", "{M} 1 – {d}, {y}", "TTM {MMM} {y}",
    "Trailing Twelve Months ended {M} {L}, {y}", "Dec - {MMM} {y}", "% of Income", "Fiscal Year Ended {M} {d}, {y}", "13 {y}", "{mm}/{L}/{y}",
)


def printed(day: Column, key: Column) -> Column:
    """The day as the key's form prints it."""
    text = case(key, FORMS)
    q = F.quarter(day)
    shown = {
        "{MMM}": F.date_format(day, "MMM"), "{M}": F.date_format(day, "MMMM"), "{d}": F.dayofmonth(day), "{L}": F.dayofmonth(F.last_day(day)), "{yy}": F.date_format(day, "yy"),
        "{y}": F.year(day), "{q3}": F.concat(q, case(q - 1, ("st", "nd", "rd", "th"))), "{q}": q, "{mm}": F.date_format(day, "MM"), "{dd}": F.date_format(day, "dd"),
    }
    for mark, value in shown.items():
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return text


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a day, which is the last of its month for every third key."""
    day = F.col("o_orderdate").cast("date")
    return orders(spark, sf_dir).select(K, "o_custkey", F.when(F.col(K) % 3 == 0, F.last_day(day)).otherwise(day).alias("day"))


def _shown(p: Column) -> list[Column]:
    return [p["kind"].alias("kind"), p["label"].alias("label"), p["start_date"].cast("string").alias("start_date"), p["end_date"].cast("string").alias("end_date")]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).withColumn("p", periods.period_header(printed(F.col("day"), F.col(K)))).select(K, *_shown(F.col("p")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a period and the date of printing."""
    title = F.concat(F.lit("Acme "), F.col("o_custkey"), F.lit(" LLC\nProfit & Loss "), printed(F.col("day"), F.col(K)), F.lit(" Accrual Basis Thursday, February 6, 2025 02:13 PM"))
    return _dated(spark, sf_dir).withColumn("p", periods.period_in_text(title)).select(K, *_shown(F.col("p")))


WIDTHS = (1, 3, 12, 12, 5, 13)
#: Grids of one task, or so.
GRIDS = 10_000


def grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A grid and its titles for each order, of six styles by key: months and their total; with a gap; of a calendar year;
    without headers, of one and of two columns; with a column that is no period. Orders are dealt by grid before they become
    cells and titles, whose reading is most of the work: so it has as many tasks as the grids need, not as few as the files have."""
    o = _dated(spark, sf_dir).select(F.col(K).alias("grid_id"), "day", (F.col(K) % 6).alias("style"), case(F.col(K) + F.col("o_custkey"), WIDTHS).alias("n"))
    o = o.repartition(parts_of(orders(spark, sf_dir), GRIDS), "grid_id")
    style, day = F.col("style"), F.col("day")
    start = F.trunc(F.when(style == 2, F.add_months(day, 1 - F.month(day))).otherwise(day), "month")
    n = F.when(style == 3, 1).when(style == 4, 2).otherwise(F.col("n"))
    month = lambda i: F.date_format(F.add_months(start, i + F.when((style == 1) & (i > 0), 1).otherwise(0)), "MMM yyyy")
    header = lambda i: F.when(style.isin(3, 4), F.lit("Amount")).when((style == 5) & (i == 0), F.lit("Budget")).otherwise(month(i))
    cell = lambda row, col, text: F.struct(F.lit(row).alias("row"), col.cast("int").alias("col"), text.alias("text"))
    cols = F.sequence(F.lit(0), n - 1)
    body = F.flatten(F.transform(cols, lambda i: F.array(cell(0, i + 1, header(i)), cell(1, i + 1, F.lit("1,000.00")), cell(2, i + 1, F.lit("(20)")))))
    total = F.when(~style.isin(3, 4), F.array(cell(0, n + 1, case(day.cast("date").substr(9, 2).cast("int"), ("Total", "TOTAL", " Total  Amount "))), cell(2, n + 1, F.lit("7")))).otherwise(F.array())
    labels = F.array(cell(0, F.lit(0), F.when(F.col("grid_id") % 10 == 0, F.lit("Amounts in millions")).otherwise(F.lit("Assets"))), cell(1, F.lit(0), F.lit("Cash")))
    blocks = F.array(F.when(F.col("grid_id") % 4 == 0, F.lit("Acme LLC (in thousands)")).otherwise(F.lit("Acme LLC")), F.concat(F.lit("Balance Sheet As of "), F.date_format(day, "MMM d, yyyy")), F.lit("As of May 1, 1999"))
    return o.select("grid_id", F.inline(F.concat(labels, body, total))), o.select("grid_id", F.posexplode(blocks).alias("position", "text"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.bound_columns(*grids(spark, sf_dir))
    return out.select("grid_id", "col", "kind", "label", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "source", "scale", F.size("header_rows").alias("header_rows"))


QUERIES = {"t02_period_headers": headers, "t03_periods_in_texts": texts, "t13_bound_columns": columns}

_DATED = f"""dated AS (SELECT *, last_day(day) AS eom, CAST(date_trunc('month', day) AS DATE) AS bom, year(day) AS y, strftime(day, '%Y-%m') AS ym FROM (
  SELECT {K}, o_custkey, {K} % {len(FORMS)} AS form, CASE WHEN {K} % 3 = 0 THEN last_day(o_orderdate) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders))"""
_PARTS = """CASE
  WHEN form IN (0, 1) OR form IN (6, 7, 8, 9) AND month(day) = 12 OR form IN (10, 20) AND strftime(day, '%m-%d') = '12-31' THEN {'kind': 'fiscal_year', 'label': 'FY' || y, 's': make_date(y, 1, 1), 'e': make_date(y, 12, 31)}
  WHEN form IN (2, 3) THEN {'kind': 'interim', 'label': 'Q' || quarter(day) || ' ' || y, 's': CAST(date_trunc('quarter', day) AS DATE), 'e': CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)}
  WHEN form IN (4, 5, 14, 22) OR form = 15 AND day = eom THEN {'kind': 'interim', 'label': ym, 's': bom, 'e': eom}
  WHEN form IN (6, 7) THEN {'kind': 'interim', 'label': y || '-01..' || ym, 's': make_date(y, 1, 1), 'e': eom}
  WHEN form = 8 THEN {'kind': 'fiscal_year', 'label': 'FYE ' || eom, 's': CAST(bom - INTERVAL 11 MONTH AS DATE), 'e': eom}
  WHEN form IN (9, 16, 17) THEN {'kind': 'ttm', 'label': 'TTM ' || ym, 's': CAST(bom - INTERVAL 11 MONTH AS DATE), 'e': eom}
  WHEN form IN (11, 12) THEN {'kind': CASE WHEN strftime(day, '%m-%d') = '12-31' THEN 'fiscal_year' ELSE 'interim' END, 'label': 'As of ' || day, 's': day, 'e': day}
  WHEN form = 13 AND day = eom THEN {'kind': 'interim', 'label': (2000 + y % 100) || strftime(day, '-%m'), 's': make_date(2000 + y % 100, month(day), 1), 'e': make_date(2000 + y % 100, month(day), day(day))}
  WHEN form = 15 THEN {'kind': 'interim', 'label': bom || '..' || day, 's': bom, 'e': day}
  WHEN form = 18 AND month(day) = 12 THEN {'kind': 'interim', 'label': ym || '..' || ym, 's': bom, 'e': eom}
  WHEN form = 20 THEN {'kind': 'fiscal_year', 'label': 'FYE ' || day, 'e': day, 's': CAST(CASE WHEN day = eom THEN bom - INTERVAL 11 MONTH
    WHEN day(day) + 1 > day(last_day(bom - INTERVAL 12 MONTH)) THEN bom - INTERVAL 12 MONTH ELSE bom - INTERVAL 12 MONTH + to_days(CAST(day(day) AS INTEGER)) END AS DATE)}
  END"""
_INSIDE = f"CASE WHEN form IN (0, 1, 2, 3, 12, 13, 22) THEN NULL WHEN form = 18 AND month(day) < 12 THEN {{'kind': 'interim', 'label': ym, 's': bom, 'e': eom}} ELSE {_PARTS} END"
_AS_TEXT = "p.kind AS kind, p.label AS label, CAST(p.s AS VARCHAR) AS start_date, CAST(p.e AS VARCHAR) AS end_date"
_GRIDS = f"""{_DATED}, g AS (SELECT {K} AS grid_id, {K} % 6 AS style, day, CAST(date_trunc(CASE WHEN {K} % 6 = 2 THEN 'year' ELSE 'month' END, day) AS DATE) AS start,
  CASE {K} % 6 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE {case_sql(f"{K} + o_custkey", WIDTHS)} END AS n, CASE WHEN {K} % 10 = 0 THEN 1000000 WHEN {K} % 4 = 0 THEN 1000 ELSE 1 END AS scale FROM dated),
c AS (SELECT *, unnest(range(1, n + 1 + CASE WHEN style IN (3, 4) THEN 0 ELSE 1 END)) AS col FROM g),
m AS (SELECT *, CAST(start + to_months(CAST(col - 1 + CASE WHEN style = 1 AND col > 1 THEN 1 ELSE 0 END AS INTEGER)) AS DATE) AS first_day, CAST(start + to_months(CAST(n - 1 AS INTEGER)) AS DATE) AS final FROM c)"""
_COLUMN = """CASE WHEN style = 3 OR style = 5 AND n = 1 AND col = 1 THEN {'kind': CASE WHEN strftime(day, '%m-%d') = '12-31' THEN 'fiscal_year' ELSE 'interim' END, 'label': 'As of ' || day, 's': day, 'e': day, 'source': 'title'}
  WHEN style = 4 OR style = 5 AND col IN (1, n + 1) OR style = 1 AND n > 1 AND col = n + 1 THEN NULL
  WHEN col <= n THEN {'kind': 'interim', 'label': strftime(first_day, '%Y-%m'), 's': first_day, 'e': last_day(first_day), 'source': 'header'}
  WHEN n = 12 AND month(start) = 1 THEN {'kind': 'fiscal_year', 'label': 'FY' || year(start), 's': start, 'e': last_day(final), 'source': 'total'}
  WHEN n = 12 THEN {'kind': 'ttm', 'label': 'TTM ' || strftime(final, '%Y-%m'), 's': start, 'e': last_day(final), 'source': 'total'}
  ELSE {'kind': 'interim', 'label': strftime(start, '%Y-%m') || '..' || strftime(final, '%Y-%m'), 's': start, 'e': last_day(final), 'source': 'total'} END"""
ORACLES = {
    "t02_period_headers": f"WITH {_DATED} SELECT {K}, {_AS_TEXT} FROM (SELECT {K}, {_PARTS} AS p FROM dated)",
    "t03_periods_in_texts": f"WITH {_DATED} SELECT {K}, {_AS_TEXT} FROM (SELECT {K}, {_INSIDE} AS p FROM dated)",
    "t13_bound_columns": f"""WITH {_GRIDS} SELECT grid_id, CAST(col AS INTEGER) AS col, {_AS_TEXT}, p.source AS source, CAST(scale AS INTEGER) AS scale,
  CAST(CASE WHEN style IN (3, 4) OR style = 5 AND n = 1 THEN 0 ELSE 1 END AS INTEGER) AS header_rows FROM (SELECT *, {_COLUMN} AS p FROM m)""",
}
