"""Reconciliation of two readings, write planning, policy rules, scenario metrics, evaluation, page spans and selections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fintally.functions.money import decimal_ratio

# Order of the states of a deal; a deal never goes back.
DEAL_STATES = ("created", "collecting", "processing", "in_review", "complete")


def reconcile(fields: DataFrame, path1: DataFrame, path2: DataFrame) -> DataFrame:
    """Each field of (document_id, field) with both readings (cents, readable) and an outcome.

    `unreadable` where a reading was rejected, `consensus_absent` where both are absent, `consensus` where they are equal,
    `single_source` where one is absent, else `disagreement`. A path without a row reads as absent.
    """
    one = path1.select("document_id", "field", F.col("cents").alias("path1_cents"), F.col("readable").alias("ok1"))
    two = path2.select("document_id", "field", F.col("cents").alias("path2_cents"), F.col("readable").alias("ok2"))
    both = fields.join(one, ["document_id", "field"], "left").join(two, ["document_id", "field"], "left")
    a, b = F.col("path1_cents"), F.col("path2_cents")
    outcome = (
        F.when(~F.coalesce("ok1", F.lit(True)) | ~F.coalesce("ok2", F.lit(True)), "unreadable")
        .when(a.isNull() & b.isNull(), "consensus_absent")
        .when(a.isNull() | b.isNull(), "single_source")
        .when(a == b, "consensus")
        .otherwise("disagreement")
    )
    return both.select("document_id", "field", "path1_cents", "path2_cents", outcome.alias("outcome"))


def plan_writes(reconciled: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each reconciled field, given the live fact of it (document_id, field, fact_id, value_cents, human).

    A field that a person decided is left alone, an equal value too; another agreed value is inserted, and supersedes the
    live fact if there is one; anything not agreed goes to review.
    """
    live = existing.select("document_id", "field", "fact_id", "value_cents", "human")
    found = reconciled.join(live, ["document_id", "field"], "left")
    action = (
        F.when(F.coalesce("human", F.lit(False)), "human_decided")
        .when(F.col("outcome") == "consensus_absent", "nothing")
        .when(F.col("outcome") != "consensus", "review")
        .when(F.col("path1_cents") == F.col("value_cents"), "unchanged")
        .when(F.col("fact_id").isNull(), "insert")
        .otherwise("supersede")
    )
    out = found.withColumn("action", action)
    return out.select("document_id", "field", "action", F.when(F.col("action").isin("insert", "supersede"), F.col("path1_cents")).alias("new_cents"), F.when(F.col("action") == "supersede", F.col("fact_id")).alias("superseded_id"))


def scenario_metrics(tall: DataFrame, annual_debt_service: int) -> DataFrame:
    """Debt service coverage at two decimals: of each cell (`dscr_business`), and of all entities of a period (`dscr_global`).

    No rows where nothing is owed.
    """
    if annual_debt_service <= 0:
        return tall.sparkSession.createDataFrame([], "entity_id long, period_label string, metric string, mantissa long")
    ratio = lambda c: decimal_ratio(c, F.lit(annual_debt_service), 2).alias("mantissa")
    own = tall.where("metric = 'cfads'").select("entity_id", "period_label", F.lit("dscr_business").alias("metric"), ratio(F.col("cents")))
    every = tall.where("metric in ('cfads', 'personal_cash_flow')").groupBy("period_label").agg(F.sum("cents").alias("cents"))
    return own.unionByName(every.select(F.lit(None).cast("long").alias("entity_id"), "period_label", F.lit("dscr_global").alias("metric"), ratio(F.col("cents"))))


def evaluate_policy(deals: DataFrame, rules: list[tuple[str, str, str, int, int | None]]) -> DataFrame:
    """deal_id, rule, status and signed margin of each rule (id, metric, gte/lte/eq, threshold, most amount or none).

    deals: deal_id, amount, metrics map<string, long>. A rule that is not for a deal of that amount has no row; a metric that
    is absent is `not_evaluable`. The margin is positive on the good side.
    """
    actual = lambda metric: F.col("metrics")[metric]
    each = []
    for name, metric, op, threshold, most in rules:
        margin = {"gte": actual(metric) - threshold, "lte": threshold - actual(metric), "eq": -F.abs(actual(metric) - threshold)}[op]
        status = F.when(margin.isNull(), "not_evaluable").when(margin >= 0, "pass").otherwise("fail")
        fits = F.lit(True) if most is None else F.coalesce(F.col("amount") <= most, F.lit(False))
        each.append(F.when(fits, F.struct(F.lit(name).alias("rule"), status.alias("status"), margin.cast("long").alias("margin"))))
    return deals.select("deal_id", F.inline(F.filter(F.array(*each), lambda r: r.isNotNull())))


def policy_outcome(evaluated: DataFrame) -> DataFrame:
    """`fail` if a rule fails, else `incomplete` if one cannot be evaluated, else `pass`, for each deal."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "not_evaluable", 1).otherwise(0))
    out = evaluated.groupBy("deal_id").agg(worst.alias("w"), F.count_if(F.col("status") == "pass").alias("passed"))
    return out.select("deal_id", F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "incomplete").otherwise("pass").alias("overall"), "passed")


def score_extraction(truth: DataFrame, extraction: DataFrame, keys: list[str]) -> DataFrame:
    """verdict and the number of keys with it: rows of one key add up; a sum is null only if all its values are."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum("value_cents").alias(name), F.lit(True).alias(f"has_{name}"))
    both = total(truth, "want").join(total(extraction, "got"), keys, "full")
    verdict = F.when(F.col("has_got").isNull(), "missed").when(F.col("has_want").isNull(), "spurious").when(F.col("want").eqNullSafe(F.col("got")), "correct").otherwise("wrong")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def regressions(baseline: DataFrame, current: DataFrame, tolerance_points: int = 20) -> DataFrame:
    """Rows of (level, name) whose precision or recall, in ten-thousandths, fell by more than the tolerance, or went away."""
    old = baseline.select("level", "name", F.col("precision_points").alias("p0"), F.col("recall_points").alias("r0"))
    both = old.join(current.select("level", "name", "precision_points", "recall_points"), ["level", "name"], "left")
    fell = lambda was, now: F.coalesce(F.col(was) - F.col(now) > tolerance_points, F.col(was).isNotNull())
    out = both.withColumns({"precision_fell": fell("p0", "precision_points"), "recall_fell": fell("r0", "recall_points")})
    return out.where("precision_fell or recall_fell").select("level", "name", "precision_fell", "recall_fell")


def page_spans(pages: DataFrame) -> DataFrame:
    """Logical documents of a bundle: runs of pages of one family; a page without a family belongs to the run before it.

    pages: bundle_id, page, family (null: unresolved). Leading unresolved pages are a span without a family.
    """
    w = Window.partitionBy("bundle_id").orderBy("page")
    known = F.last("family", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("family").isNotNull() & ~F.col("family").eqNullSafe(F.col("before"))
    flagged = pages.withColumn("before", known).withColumn("start", F.when(starts, 1).otherwise(0))
    numbered = flagged.withColumn("span", F.sum("start").over(w))
    return numbered.groupBy("bundle_id", "span").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.max("family").alias("family"))


def inherit_year(spans: DataFrame) -> DataFrame:
    """An undated span takes the year of its bundle, if all dated spans of the bundle have one year."""
    years = spans.groupBy("bundle_id").agg(F.min("tax_year").alias("least"), F.max("tax_year").alias("most"))
    found = spans.join(years, "bundle_id", "left")
    only = F.when(F.col("least") == F.col("most"), F.col("least"))
    return found.select(*[c for c in spans.columns if c != "tax_year"], F.coalesce("tax_year", only).alias("tax_year"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """Every node of `node` and all nodes above it, with depth (dots) and the number of given nodes at or below."""
    parts = F.split("node", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    each = nodes.select("node").distinct().select(F.explode(up).alias("key"))
    return each.groupBy("key").agg(F.count("*").alias("n_below")).select("key", (F.size(F.split("key", r"\.")) - 1).alias("depth"), "n_below")


def trailing_load(events: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Keys with more than `most` rows in some trailing window of so many seconds, and the largest number in one.

    Rows are counted by second first, so that a hot key's window holds a row for each second and not for each event.
    """
    per = events.where(F.col(at).isNotNull()).groupBy(key, F.unix_timestamp(at).alias("s")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("s").rangeBetween(-seconds, 0)
    return per.select(key, F.sum("n").over(w).alias("load")).groupBy(key).agg(F.max("load").alias("peak")).where(F.col("peak") > most)


def digest(notifications: DataFrame, opted_in: DataFrame, since: Column, immediate: list[str]) -> DataFrame:
    """Notifications of each recipient since a time, without the kinds that go out at once, to those who asked for it."""
    recent = notifications.where((F.col("created_at") >= since) & ~F.col("kind").isin(immediate))
    return recent.join(opted_in.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def furthest_state(steps: DataFrame, states: tuple[str, ...] = DEAL_STATES) -> DataFrame:
    """The furthest state that each deal has reached, whatever the order of its steps; unknown states don't count."""
    at = reduce(lambda c, s: c.when(F.col("state") == s, states.index(s)), states[1:], F.when(F.col("state") == states[0], 0))
    out = steps.select("deal_id", at.alias("at")).where("at is not null").groupBy("deal_id").agg(F.max("at").alias("at"))
    return out.select("deal_id", F.element_at(F.array(*map(F.lit, states)), F.col("at") + 1).alias("state"))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity: prefix weight 0.1, up to four characters."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            mine.append(c)
    if not mine:
        return 0.0
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(IntegerType())
def name_points(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Jaro-Winkler similarity in ten-thousandths; null where a name is."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else round(jaro_winkler(x, y) * 10_000) for x, y in zip(a, b, strict=True)], dtype="Int32")


def band(points: Column) -> Column:
    return F.when(points >= 9_200, "high").when(points >= 7_200, "mid").otherwise("low")
