"""Data-quality gates over facts that are not rejected. Issues: gate, severity, blocking, entity, period, subject, ids, delta."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("entity_id", "period_label")


def _issue(df: DataFrame, gate: str, subject: Column, ids: Column, delta: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.lit(severity != "warning").alias("blocking"), *CELL, subject.alias("subject"), F.array_join(F.array_sort(F.filter(ids, F.isnotnull)), ",").alias("fact_ids"), delta.cast("long").alias("delta_cents"))


def subtotals(best: DataFrame, nodes: Iterable[str]) -> DataFrame:
    """G1: a stated total differs from the sum of its direct siblings by over 100 cents."""
    parents = sorted({n.rsplit(".", 1)[0] for n in nodes if n.endswith(".total")})
    parent = F.regexp_extract("node", r"^(.*)\.[^.]+$", 1)
    total = F.col("node").endswith(".total")
    cells = best.where(parent.isin(parents)).groupBy(*CELL, parent.alias("parent")).agg(
        F.max(F.when(total, F.col("value_cents"))).alias("total"), F.sum(F.when(~total, F.col("value_cents"))).alias("items"), F.collect_list("id").alias("ids")
    )
    delta = F.abs(F.col("items") - F.col("total"))
    return _issue(cells.where(delta > 100), "G1", F.col("parent"), F.col("ids"), delta)


def identity(best: DataFrame) -> DataFrame:
    """G2: assets differ from the stated right side, or from liabilities plus equity, by over 200 cents."""
    names = {"assets": "bs.assets.total", "both": "bs.total_liabilities_equity", "liabilities": "bs.liabilities.total", "equity": "bs.equity.total"}
    of = lambda n, c: F.max(F.when(F.col("node") == n, F.col(c)))
    cells = best.where(F.col("node").isin(*names.values())).groupBy(*CELL).agg(*(of(n, "value_cents").alias(k) for k, n in names.items()), *(of(n, "id").alias(f"{k}_id") for k, n in names.items()))
    delta = F.abs(F.col("assets") - F.coalesce("both", F.col("liabilities") + F.col("equity")))
    rest = F.array(F.when(F.col("both").isNull(), F.col("liabilities_id")), F.when(F.col("both").isNull(), F.col("equity_id")))
    return _issue(cells.where(delta > 200), "G2", F.lit("bs"), F.concat(F.array("assets_id", "both_id"), rest), delta)


def tie_out(facts: DataFrame, *, node: str = "is.net_income", floor_cents: int = 50_000, bps: int = 100) -> DataFrame:
    """G3: a node's values diverge between documents by more than the floor and the share of the first one's.

    Of a document the last fact counts (created_at, then id); the first of two documents is the one with the lesser id.
    """
    last = facts.where((F.col("status") != "rejected") & (F.col("node") == node)).groupBy(*CELL, "document_id").agg(F.max_by(F.struct("id", "value_cents"), F.struct("created_at", "id")).alias("f"))
    a, b = last.select(*CELL, F.col("document_id").alias("ad"), F.col("f").alias("a")), last.select(*CELL, F.col("document_id").alias("bd"), F.col("f").alias("b"))
    delta = F.abs(F.col("a.value_cents") - F.col("b.value_cents"))
    share = F.floor(F.abs(F.col("a.value_cents")) * bps / 10_000)
    pairs = a.join(b, [*CELL]).where((F.col("ad") < F.col("bd")) & (delta > F.greatest(F.lit(floor_cents), share)))
    return _issue(pairs, "G3", F.lit(node), F.array("a.id", "b.id"), delta)


def relations(best: DataFrame, specs: DataFrame) -> DataFrame:
    """G4: result differs from the sum or difference of all its operands by more than the tolerance.

    specs: spec, kind (sum, difference or flow), result, operands (array), tolerance_cents, years (array or null).
    """
    year = F.regexp_extract("period_label", r"^FY(\d{4})$", 1)
    parts = specs.select("*", F.posexplode("operands").alias("at", "node"))
    have = best.join(F.broadcast(parts), "node").where(F.col("years").isNull() | (year == "") | F.array_contains("years", F.when(year != "", year).cast("int")))
    sign = F.when((F.col("kind") == "difference") & (F.col("at") > 0), -1).otherwise(1)
    sums = have.groupBy(*CELL, "spec").agg(F.sum(F.col("value_cents") * sign).alias("computed"), F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    whole = sums.join(F.broadcast(specs.select("spec", "result", "tolerance_cents", F.size("operands").alias("needed"))), "spec").where("n = needed")
    result = best.select(*CELL, F.col("node").alias("result"), F.col("id").alias("result_id"), "value_cents")
    delta = F.abs(F.col("computed") - F.col("value_cents"))
    return _issue(whole.join(result, [*CELL, "result"]).where(delta > F.col("tolerance_cents")), "G4", F.col("spec"), F.concat("ids", F.array("result_id")), delta)


def transcripts(facts: DataFrame) -> DataFrame:
    """G5: a value contradicts the first transcript value of its cell and node."""
    # a window and no join: the facts are read once, and what is asked of the method stays behind their shuffle
    stated = F.when(F.col("method") == "transcript", F.struct("id", "value_cents"))
    order = F.when(F.col("method") == "transcript", F.struct("created_at", "id"))
    known = facts.where("status <> 'rejected'").withColumn("t", F.min_by(stated, order).over(Window.partitionBy(*CELL, "node")))
    against = known.where("method <> 'transcript' and value_cents <> t.value_cents")
    # a null of a cell's key equals none
    against = against.where("entity_id is not null and period_label is not null and node is not null")
    return _issue(against, "G5", F.col("node"), F.array("id", "t.id"), F.abs(F.col("value_cents") - F.col("t.value_cents")), "critical")


def swings(facts: DataFrame, *, band_bps: int = 20_000) -> DataFrame:
    """G6: a node moves by more than the band from one fiscal year to the next; of a year the last fact counts."""
    year = F.regexp_extract("period_label", r"^FY(\d{4})$", 1)
    last = facts.where((F.col("status") != "rejected") & (year != "")).groupBy("entity_id", "node", "period_label").agg(F.max_by(F.struct("id", "value_cents"), F.struct("created_at", "id")).alias("f"))
    last = last.withColumn("year", year.cast("int"))
    order = Window.partitionBy("entity_id", "node").orderBy("year")
    both = last.withColumns({"before": F.lag("f").over(order), "was": F.lag("year").over(order)}).where("year = was + 1 and before.value_cents <> 0")
    moved, base = F.abs(F.col("f.value_cents") - F.col("before.value_cents")), F.abs(F.col("before.value_cents"))
    big = (moved.cast("decimal(38,0)") * 10_000 - (moved.cast("decimal(38,0)") * 10_000) % base) / base > band_bps
    return _issue(both.where(big), "G6", F.col("node"), F.array("before.id", "f.id"), moved, "warning")


def run(facts: DataFrame, best: DataFrame, nodes: Iterable[str], specs: DataFrame) -> DataFrame:
    """All issues of all gates."""
    issues = [subtotals(best, nodes), identity(best), tie_out(facts), relations(best, specs), transcripts(facts), swings(facts)]
    out = issues[0]
    for more in issues[1:]:
        out = out.unionByName(more)
    return out


def blocked(issues: DataFrame) -> DataFrame:
    """Ids of facts in any blocking issue."""
    return issues.where("blocking").select(F.explode(F.split("fact_ids", ",")).alias("fact_id")).distinct()
