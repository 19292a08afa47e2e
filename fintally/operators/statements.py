"""Financial statements of laid-out cells: grids, row types by arithmetic, and facts of rows.

A grid's rows are read in order with running sums, which no frame expresses: they are read as a stream, sorted within their
task unless grids come whole, so that a task holds the sums of one grid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fintally.operators.text import normalize_amount

#: Sums equal within so many cents.
TOLERANCE = 100
TYPED = "grid_id long, row int, label string, type string, verified boolean"
#: Sides of a balance sheet are equal within so many cents.
BALANCE_TOLERANCE = 200
# Words that claim a total; the bottom line of an income statement.
TOTAL = re.compile(r"^(total|net (income|profit|loss)|gross profit)\b", re.IGNORECASE)
GRAND = re.compile(
    r"^(net (income|profit|loss)|total (assets|liabilities and (?:stockholders'?|owner'?s?|members'?)? ?equity|equity and liabilities))\b", re.IGNORECASE
)
BOTTOM = re.compile(r"^net (income|profit|loss)( ?/? ?\((loss|deficit)\))?\s*$", re.IGNORECASE)


def _label(first: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.transform(F.sort_array(first), lambda x: x["text"])))


def grid_rows(cells: DataFrame) -> DataFrame:
    """(grid_id, row, label, cells map<int, string>) of cells (grid_id, row, col, text): column 0 is the label, other columns go by their number."""
    first = F.collect_list(F.when(F.col("col") == 0, F.struct("col", "text")))
    others = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("col") > 0, F.struct("col", "text")))))
    return cells.groupBy("grid_id", "row").agg(_label(first).alias("label"), others.alias("cells"))


def rows_of_grids(grids: DataFrame) -> DataFrame:
    """grid_rows of grids (grid_id, cells array<struct<row, col, text>>) that come whole, in order of rows: nothing is dealt or sorted again.

    Cells may come in any order: they are sorted within their array, and each run of a row is cut out once.
    """
    at = lambda i: F.element_at("sorted", i)["row"]
    starts = F.filter(F.sequence(F.lit(1), F.size("sorted")), lambda i: (i == 1) | ~at(i).eqNullSafe(at(F.greatest(i - 1, F.lit(1)))))
    cut = lambda s, k: F.slice("sorted", s, F.coalesce(F.try_element_at("starts", k + 2), F.size("sorted") + 1) - s)
    pair = lambda c: F.struct(c["col"].alias("col"), c["text"].alias("text"))
    part = lambda cells, keep: F.transform(F.filter(cells, keep), pair)
    whole = grids.select("grid_id", F.sort_array("cells").alias("sorted")).select("*", F.when(F.size("sorted") > 0, starts).alias("starts"))
    # not an inner one, for which Spark would ask the list's size below, and so compute it twice
    runs = whole.select("grid_id", F.explode_outer(F.transform("starts", cut)).alias("run")).where("run is not null")
    others = F.map_from_entries(part(F.col("run"), lambda c: c["col"] > 0))
    return runs.select("grid_id", F.col("run")[0]["row"].alias("row"), _label(part(F.col("run"), lambda c: c["col"] == 0)).alias("label"), others.alias("cells"))


def typed_rows(rows: DataFrame, *, income: bool = False) -> DataFrame:
    """(grid_id, row, label, type, verified) of grid_rows.

    A row that sums the items above it is a subtotal, one that sums the subtotals a total, whatever its words say; words
    decide only where no sum does. A row without cells is a header, or a break without a label. Below the bottom line of
    an income statement all rows are supplemental.
    """
    # the rows of a grid follow each other in one task
    ordered = _read(rows).repartition("grid_id").sortWithinPartitions("grid_id", "row")
    return ordered.mapInArrow(_running(income), TYPED)


def typed_rows_of_grids(grids: DataFrame, *, income: bool = False) -> DataFrame:
    """typed_rows of grids as rows_of_grids takes them, whose rows follow each other as they are."""
    return _read(rows_of_grids(grids)).mapInArrow(_running(income), TYPED)


def _read(rows: DataFrame) -> DataFrame:
    """Rows with the numbers of their columns and the cents that are read there."""
    cents = F.transform(F.map_values("cells"), lambda v: normalize_amount(v)["cents"])
    return rows.select("grid_id", "row", "label", F.map_keys("cells").alias("cols"), cents.alias("cents"))


def _running(income: bool):
    """Types of rows in order, of Arrow batches of _read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            grids, rows, labels = (batch.column(k) for k in range(3))
            kinds, proofs = [], []
            for grid, label, cols, cents in zip(grids.to_pylist(), labels.to_pylist(), _lists(batch.column(3)), _lists(batch.column(4)), strict=True):
                if state is None or state.grid != grid:
                    state = Running(grid, income)
                values = {c: v for c, v in zip(cols, cents, strict=True) if v is not None}
                kind, verified = state.read(label, bool(cols), values)
                kinds.append(kind)
                proofs.append(verified)
            arrays = [grids, rows, labels, pa.array(kinds, pa.string()), pa.array(proofs, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["grid_id", "row", "label", "type", "verified"])

    return run


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, none for a null."""
    flat, ends = column.values.to_pylist(), column.offsets.to_pylist()
    return (flat[a:b] if valid else [] for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False))


class Running:
    """The sums of a grid's items since the last subtotal, and of its subtotals since the last total, by column."""

    def __init__(self, grid: int, income: bool):
        self.grid, self.income, self.below = grid, income, False
        self.items: dict[int, int] = {}
        self.subtotals: dict[int, int] = {}
        self.n_items = self.n_subtotals = 0

    @staticmethod
    def equal(values: dict[int, int], sums: dict[int, int]) -> bool:
        return all(abs(v - sums.get(c, 0)) <= TOLERANCE for c, v in values.items())

    @staticmethod
    def add(sums: dict[int, int], values: dict[int, int]) -> dict[int, int]:
        return {**sums, **{c: sums.get(c, 0) + v for c, v in values.items()}}

    def read(self, label: str, has_cells: bool, values: dict[int, int]) -> tuple[str, bool]:
        """Type of the next row, and whether its sum proves it."""
        if self.below:
            return "supplemental", False
        kind, verified = self.kind(label, has_cells, values)
        if kind in ("header", "subtotal"):
            if kind == "subtotal":
                self.subtotals, self.n_subtotals = self.add(self.subtotals, values), self.n_subtotals + 1
            self.items, self.n_items = {}, 0
        elif kind == "total":
            self.subtotals, self.n_subtotals = {}, 0
        elif kind == "item" and values:
            self.items, self.n_items = self.add(self.items, values), self.n_items + 1
        self.below = self.income and bool(values) and bool(BOTTOM.match(label.strip()))
        return kind, verified

    def kind(self, label: str, has_cells: bool, values: dict[int, int]) -> tuple[str, bool]:
        if not has_cells:
            return ("header" if label else "section_break"), False
        if values and self.n_items and self.equal(values, self.items):
            return "subtotal", True
        if values and self.n_subtotals and not self.n_items and self.equal(values, self.subtotals):
            return "total", True
        if values and (GRAND.match(label) or TOTAL.match(label)):
            return ("total" if GRAND.match(label) else "subtotal"), False
        return "item", False


def row_facts(values: DataFrame) -> DataFrame:
    """(grid_id, node, period_label, value_cents, source) that survive double counting, of (grid_id, node, period_label, type, value_cents).

    Of a node and period either the items or the stated total stays: totals that contradict each other give an issue and no
    value; items that exceed the total by over TOLERANCE stay, as the total is another one's; else the total does.
    """
    is_item = F.col("type") == "item"
    cells = values.groupBy("grid_id", "node", "period_label").agg(
        F.sum(F.when(is_item, F.col("value_cents"))).alias("items"), F.min(F.when(~is_item, F.col("value_cents"))).alias("low"), F.max(F.when(~is_item, F.col("value_cents"))).alias("high")
    )
    source = F.when(F.col("high") - F.col("low") > TOLERANCE, "conflict").when(F.col("high").isNull(), "items").when(F.col("items") > F.col("high") + TOLERANCE, "items").otherwise("total")
    out = cells.withColumn("source", source)
    value = F.when(F.col("source") == "items", F.col("items")).when(F.col("source") == "total", F.col("high"))
    return out.select("grid_id", "node", "period_label", value.alias("value_cents"), "source")


def structure_issues(values: DataFrame) -> DataFrame:
    """(grid_id, period_label, gate, subject, delta_cents) of values as row_facts takes them.

    G1: stated totals of one node that contradict each other (their range), and net income that is not revenue less
    expenses; G2: assets that are not the stated right side, or else liabilities and equity. The last two compare the
    values that survive double counting, where all that they need is there.
    """
    stated = values.where("type <> 'item'").groupBy("grid_id", "node", "period_label").agg((F.max("value_cents") - F.min("value_cents")).alias("delta"))
    conflicts = stated.where(F.col("delta") > TOLERANCE).select("grid_id", "period_label", F.lit("G1").alias("gate"), F.col("node").alias("subject"), F.col("delta").alias("delta_cents"))
    of = lambda node: F.max(F.when(F.col("node") == node, F.col("value_cents")))
    sides = {"net": "is.net_income", "revenue": "is.revenue.total", "expenses": "is.opex.total", "assets": "bs.assets.total", "right": "bs.total_liabilities_equity", "liabilities": "bs.liabilities.total", "equity": "bs.equity.total"}
    wide = row_facts(values).where(F.col("node").isin(*sides.values())).groupBy("grid_id", "period_label").agg(*(of(node).alias(name) for name, node in sides.items()))
    income = F.abs(F.col("revenue") - F.col("expenses") - F.col("net"))
    balance = F.abs(F.col("assets") - F.coalesce("right", F.col("liabilities") + F.col("equity")))
    issue = lambda delta, least, gate, subject: F.when(delta > least, F.struct(F.lit(gate).alias("gate"), F.lit(subject).alias("subject"), delta.alias("delta_cents")))
    found = F.array_compact(F.array(issue(income, TOLERANCE, "G1", "is.net_income"), issue(balance, BALANCE_TOLERANCE, "G2", "bs")))
    return conflicts.unionByName(wide.select("grid_id", "period_label", F.inline(found)))
