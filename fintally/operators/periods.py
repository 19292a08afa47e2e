"""Periods that statements print: of a header, inside a text, and of a grid's columns, the summing one included.

All of it is expressions and one grouping by grid; a header is read by the first form below that it fits as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fintally.functions.scalars import unit_scale

# Names of months, alone or with a dot; separators of ranges; words of spans; headers of summing columns.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = r"(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
TTM = rf"(?:ttm|trailing twelve months)(?: ended?)? {MONTH} ?(?:\d{{1,2}},? )?(\d{{4}})"
QUARTER = r"(?:q([1-4])|([1-4])(?:st|nd|rd|th) quarter) (\d{4})"
RANGE = rf"{MONTH} ?(?:\d{{1,2}},? ?)?(?:[-–]|through|thru|to|\s) ?{MONTH} ?(?:\d{{1,2}},? ?)?(\d{{4}})"
DAYS = rf"{MONTH} (\d{{1,2}})\s?[-–]\s?(\d{{1,2}}),? (\d{{4}})"
ONE_MONTH = rf"{MONTH} (\d{{4}})"
ENDED = rf"(?:for the )?((?:fiscal |calendar )?years?|twelve months|12 months|period) ended? {MONTH} (\d{{1,2}}),? (\d{{4}})"
AS_OF = rf"(?:as of )?{MONTH} (\d{{1,2}}),? (\d{{4}})"
MONTH_END = r"(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})"
YEAR = r"(?:fye? ?)?(\d{4})"
TOTAL = r"(?i)^\s*total(?:\s+(?:amount|column|for period))?\s*$"
YEARS = (1990, 2100)
#: Forms to look for inside a text, in this order: a date alone is a print date there and no period.
INSIDE = (RANGE, rf"as of {MONTH} \d{{1,2}},? \d{{4}}", TTM, ENDED, rf"\b{DAYS}\b", rf"\b{ONE_MONTH}\b")

#: What every form has, and amounts and most words lack.
DATED = r"\d{4}|/\d{2}"

#: Rows of a grid that may hold headers.
HEADER_ROWS = 5


def _first(year: Column, month: Column) -> Column:
    """The first day of a month; null if there is none."""
    return F.try_make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _ym(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def _span_label(start: Column, end: Column) -> Column:
    return F.concat(_ym(start), F.lit(".."), _ym(end))


def _period(kind: Column | str, label: Column, start: Column, end: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), label.alias("label"), start.alias("start_date"), end.alias("end_date"))


def period_header(text: Column) -> Column:
    """struct<kind, label, start_date, end_date> of a column header, null where it names no period.

    kind is fiscal_year, interim or ttm; a point in time starts and ends on its day.
    """
    # a lambda's body is interpreted: as generated code it would pass the size of a method
    return F.when(text.rlike(DATED), _once(F.trim(F.regexp_replace(F.lower(text), r"[\s\u00a0]+", " ")), _named))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), for which value is computed once, however often it is named there."""
    return F.transform(F.array(value), of)[0]


def _named(t: Column) -> Column:
    """period_header of a text in lower case, with one space between words."""
    fits = lambda pattern: t.rlike(f"^{pattern}$")
    part = lambda pattern, k: F.regexp_extract(t, f"^{pattern}$", k)
    number = lambda pattern, k: part(pattern, k).try_cast("int")
    month = lambda pattern, k: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part(pattern, k), 1, 3)).cast("int")
    fy = lambda year: _once(year, lambda y: _period("fiscal_year", F.concat(F.lit("FY"), y), _first(y, F.lit(1)), F.last_day(_first(y, F.lit(12)))))
    in_month = lambda first, d: d.between(1, F.dayofmonth(F.last_day(first)))

    ttm = F.last_day(_first(number(TTM, 2), month(TTM, 1)))
    q = F.coalesce(number(QUARTER, 1), number(QUARTER, 2))
    quarter = _first(number(QUARTER, 3), q * 3 - 2)
    since, until = _first(number(RANGE, 3), month(RANGE, 1)), _first(number(RANGE, 3), month(RANGE, 2))
    whole_year = (month(RANGE, 1) == 1) & (month(RANGE, 2) == 12)
    span = _once(F.struct(since.alias("since"), until.alias("until")), lambda r: _period("interim", _span_label(r["since"], r["until"]), r["since"], F.last_day(r["until"])))
    of_range = F.when(whole_year, fy(number(RANGE, 3))).otherwise(span)
    days = _first(number(DAYS, 4), month(DAYS, 1))
    day_1, day_2 = F.date_add(days, number(DAYS, 2) - 1), F.date_add(days, number(DAYS, 3) - 1)
    whole_month = (number(DAYS, 2) == 1) & (day_2 == F.last_day(days))
    days_fit = (number(DAYS, 2) >= 1) & (number(DAYS, 2) <= number(DAYS, 3)) & in_month(days, number(DAYS, 3))
    days_label = F.when(whole_month, _ym(days)).otherwise(F.concat(day_1.cast("string"), F.lit(".."), day_2.cast("string")))
    one = _first(number(ONE_MONTH, 2), month(ONE_MONTH, 1))

    words, ended_in = part(ENDED, 1), _first(number(ENDED, 4), month(ENDED, 2))
    ended = F.date_add(ended_in, number(ENDED, 3) - 1)
    rolling, year_end = words.isin("twelve months", "12 months"), (month(ENDED, 2) == 12) & (number(ENDED, 3) == 31)
    # the day after that of a year before; a leap day's is the first of its month
    year_before = F.add_months(ended_in, -12)
    day_after = F.when(in_month(year_before, number(ENDED, 3) + 1), F.date_add(year_before, number(ENDED, 3))).otherwise(year_before)
    began = F.when(ended == F.last_day(ended), F.add_months(F.date_add(ended, 1), -12)).otherwise(day_after)
    ended_label = F.when(rolling, F.concat(F.lit("TTM "), _ym(ended))).otherwise(F.concat(F.lit("FYE "), ended.cast("string")))
    of_span = F.when(year_end, fy(number(ENDED, 4))).when(words != "period", _period(F.when(rolling, "ttm").otherwise("fiscal_year"), ended_label, began, ended))

    as_of = F.date_add(_first(number(AS_OF, 3), month(AS_OF, 1)), number(AS_OF, 2) - 1)
    of_day = _once(as_of, lambda d: _period(F.when(F.date_format(d, "MM-dd") == "12-31", "fiscal_year").otherwise("interim"), F.concat(F.lit("As of "), d.cast("string")), d, d))
    year = number(MONTH_END, 3)
    numeric = _first(F.when(F.length(part(MONTH_END, 3)) == 2, year + 2000).otherwise(year), number(MONTH_END, 1))
    y = number(YEAR, 1)
    return (
        F.when(fits(TTM), _period("ttm", F.concat(F.lit("TTM "), _ym(ttm)), F.add_months(F.date_add(ttm, 1), -12), ttm))
        .when(fits(QUARTER), _period("interim", F.concat(F.lit("Q"), q, F.lit(" "), number(QUARTER, 3)), quarter, F.last_day(F.add_months(quarter, 2))))
        .when(fits(RANGE) & (since <= until), of_range)
        .when(fits(DAYS) & days_fit, _period("interim", days_label, day_1, day_2))
        .when(fits(ONE_MONTH), _once(one, lambda d: _period("interim", _ym(d), d, F.last_day(d))))
        .when(fits(ENDED) & in_month(ended_in, number(ENDED, 3)), of_span)
        .when(fits(AS_OF) & in_month(_first(number(AS_OF, 3), month(AS_OF, 1)), number(AS_OF, 2)), of_day)
        .when(fits(MONTH_END) & (number(MONTH_END, 2) == F.dayofmonth(F.last_day(numeric))), _period("interim", _ym(numeric), numeric, F.last_day(numeric)))
        .when(fits(YEAR) & y.between(*YEARS), fy(y))
    )


def period_in_text(text: Column) -> Column:
    """The period that a text mentions: of the first form of INSIDE with a match that names one, its first such match."""
    found = [F.regexp_extract_all(F.lower(text), F.lit(f"({form})"), F.lit(1)) for form in INSIDE]
    named = F.filter(F.transform(F.flatten(F.array(*found)), period_header), lambda p: p.isNotNull())
    return F.when(text.rlike(DATED), F.try_element_at(named, F.lit(1)))


def bound_columns(cells: DataFrame, titles: DataFrame) -> DataFrame:
    """(grid_id, col, kind, label, start_date, end_date, source, header_rows, scale) of every column of each grid.

    cells: grid_id, row, col, text, column 0 being the labels; titles: grid_id, position, text, the blocks of the grid's
    page. A column has its first header among the first rows (`header`). One column headed as a total, all others of
    which are whole months without gap or overlap, has their span (`total`). The only column, or the only one with two
    numbers or more, has what a title says (`title`). Others have none. scale is that of labels, then of titles.
    """
    order = F.dense_rank().over(Window.partitionBy("grid_id").orderBy("row"))
    read = cells.withColumn("_nth", order).withColumn("_p", F.when((F.col("_nth") <= HEADER_ROWS) & (F.col("col") > 0), period_header(F.col("text"))))
    said = unit_scale(F.col("text"))
    by_column = read.groupBy("grid_id", "col").agg(
        F.min_by(F.struct("_p.*"), F.when(F.col("_p").isNotNull(), F.col("row"))).alias("p"),
        F.min(F.when(F.col("_p").isNotNull(), F.col("row"))).alias("header_row"),
        F.count_if(F.col("text").rlike(r"\d")).alias("numbers"),
        F.collect_set(F.when((F.col("_nth") <= HEADER_ROWS) & F.col("text").rlike(TOTAL), F.col("row"))).alias("total_rows"),
        F.min(F.when((F.col("col") == 0) & (said > 1), F.struct("row", said.alias("scale")))).alias("said"),
    )
    columns = F.filter(F.array_sort(F.collect_list(F.struct("col", "p", "header_row", "numbers", "total_rows"))), lambda c: c["col"] > 0)
    grids = by_column.groupBy("grid_id").agg(columns.alias("columns"), F.min("said").alias("said"))
    blocks = titles.withColumn("_p", F.coalesce(period_header(F.col("text")), period_in_text(F.col("text"))))
    # the first block that says something, by its place; blocks never meet in one list
    blocks = blocks.groupBy("grid_id").agg(
        F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("position"))).alias("title"), F.min(F.when(said > 1, F.struct("position", said.alias("scale")))).alias("title_said")
    )
    grids = grids.join(blocks, "grid_id", "left")
    bound = lambda c: c["p"].isNotNull()
    header_rows = F.array_sort(F.array_distinct(F.transform(F.filter("columns", bound), lambda c: c["header_row"])))
    grids = grids.withColumn("header_rows", header_rows)
    totals = F.filter("columns", lambda c: ~bound(c) & F.arrays_overlap(c["total_rows"], F.col("header_rows")))
    grids = grids.withColumn("total", F.when(F.size(totals) == 1, totals[0]["col"]))
    months = F.transform(F.filter("columns", lambda c: c["col"] != F.col("total")), lambda c: _month_number(c["p"]))
    grids = grids.withColumn("months", F.array_sort(months))
    first, last, n = F.array_min("months"), F.array_max("months"), F.size("months")
    tiled = (n > 0) & ~F.exists("months", lambda m: m.isNull()) & (last - first + 1 == n) & (F.size(F.array_distinct("months")) == n)
    start, end = _first((first / 12).cast("int"), (first % 12 + 1).cast("int")), F.last_day(_first((last / 12).cast("int"), (last % 12 + 1).cast("int")))
    of_total = (
        F.when((n == 12) & (first % 12 == 0), _period("fiscal_year", F.concat(F.lit("FY"), F.year(start)), start, end))
        .when(n == 12, _period("ttm", F.concat(F.lit("TTM "), _ym(end)), start, end))
        .otherwise(_period("interim", _span_label(start, end), start, end))
    )
    numeric = F.filter("columns", lambda c: c["numbers"] >= 2)
    alone = F.when(F.size("columns") == 1, F.col("columns")[0]["col"]).when(F.size(numeric) == 1, numeric[0]["col"])
    grids = grids.select("grid_id", "columns", "header_rows", "total", F.when(tiled, of_total).alias("of_total"), alone.alias("alone"), "title", F.coalesce("said.scale", "title_said.scale", F.lit(1)).alias("scale"))
    each = grids.withColumn("c", F.explode("columns"))
    by_total, by_title = F.col("c.col") == F.col("total"), F.col("c.col") == F.col("alone")
    source = F.when(F.col("c.p").isNotNull(), "header").when(by_total & F.col("of_total").isNotNull(), "total").when(by_title & F.col("title").isNotNull(), "title")
    each = each.withColumn("source", source).withColumn("p", F.when(source == "header", F.col("c.p")).when(source == "total", F.col("of_total")).when(source == "title", F.col("title")))
    return each.select("grid_id", "c.col", "p.*", "source", "header_rows", "scale")


def _month_number(p: Column) -> Column:
    """Months since year 0 of a period that is one whole month, else null."""
    start, end = p["start_date"], p["end_date"]
    return F.when((F.dayofmonth(start) == 1) & (F.last_day(start) == end), F.year(start) * 12 + F.month(start) - 1)
