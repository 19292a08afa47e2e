"""Selections, look-ups and roll-ups of the portfolio: filters, quotas, notifications, checklists, reminders, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filtered(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that meet every condition given: column -> value, list of values, (low, high) with an open end, or None for no condition."""
    tests = []
    for name, value in conditions.items():
        c = F.col(name)
        if isinstance(value, tuple):
            tests += [c >= value[0]] if value[0] is not None else []
            tests += [c < value[1]] if value[1] is not None else []
        elif value is not None:
            tests.append(c.isin(value) if isinstance(value, list) else c == value)
    return reduce(DataFrame.where, tests, df)


def scoped(df: DataFrame, tenant: object) -> DataFrame:
    """Rows of one tenant only; every read of tenant data goes through here."""
    return df.where(F.col("tenant_id") == F.lit(tenant))


def fact_periods(facts: DataFrame, periods: DataFrame) -> DataFrame:
    """Facts with the label of their period; `(unknown period)` where there is none."""
    return facts.join(periods.select("period_id", "label"), "period_id", "left").withColumn("period_label", F.coalesce("label", F.lit("(unknown period)"))).drop("label", "period_id")


def linked_addbacks(addbacks: DataFrame, facts: DataFrame, periods: DataFrame) -> DataFrame:
    """Addbacks with entity and period of their fact; those without a fact or period are dropped."""
    of = facts.select(F.col("id").alias("fact_id"), "entity_id", "period_id")
    return addbacks.join(of, "fact_id").join(periods.select("period_id", F.col("label").alias("period_label")), "period_id").drop("period_id")


def new_suggestions(suggested: DataFrame, known: DataFrame) -> DataFrame:
    """Suggestions whose (fact_id, category) is not an addback yet."""
    return suggested.join(known.select("fact_id", "category").distinct(), ["fact_id", "category"], "left_anti")


def notify(events: DataFrame, members: DataFrame, sent: DataFrame, least_tier: int) -> DataFrame:
    """(event_id, user_id) for every member of the tenant of sufficient tier, unless it was sent before.

    Events carry whom they were sent to, so that the pairs are shuffled neither for that nor to be told apart: events and
    members are distinct before they meet, and only users of several tenants can then make one pair twice.
    """
    sent_to = sent.groupBy("event_id").agg(F.collect_set("user_id").alias("_sent"))
    due = events.select("event_id", "tenant_id").distinct().join(sent_to, "event_id", "left")
    users = members.where(F.col("tier") >= least_tier).select("tenant_id", "user_id").where("tenant_id is not null").distinct()
    users = users.withColumn("_tenants", F.count(F.lit(1)).over(Window.partitionBy("user_id")))

    def pairs(some: DataFrame) -> DataFrame:
        return due.join(some, "tenant_id").where(~F.coalesce(F.array_contains("_sent", F.col("user_id")), F.lit(False))).select("event_id", "user_id")

    return pairs(users.where("_tenants = 1")).unionByName(pairs(users.where("_tenants > 1")).distinct())


def family(text: Column) -> Column:
    return F.upper(F.trim(text))


def outstanding(items: DataFrame, uploads: DataFrame) -> DataFrame:
    """Checklist items (invite_id, item, families) of which no family has been uploaded; one without a family stays open."""
    asked = items.select("invite_id", "item", F.explode("families").alias("f")).select("invite_id", "item", family(F.col("f")).alias("family"))
    met = asked.join(uploads.select("invite_id", family(F.col("family")).alias("family")).where("family <> ''").distinct(), ["invite_id", "family"], "left_semi")
    return items.select("invite_id", "item").join(met.select("invite_id", "item").distinct(), ["invite_id", "item"], "left_anti")


def quota(uploads: DataFrame, max_docs: int, max_bytes: int) -> DataFrame:
    """Documents and bytes of each deal, and whether a limit is passed."""
    out = uploads.groupBy("deal_id").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    return out.withColumn("over", (F.col("docs") > max_docs) | (F.col("bytes") > max_bytes))


def spend(deals: DataFrame, runs: DataFrame) -> DataFrame:
    """Cost of each deal, zero without runs."""
    cost = runs.groupBy("deal_id").agg(F.sum("cost_micro").alias("c"))
    return deals.join(cost, "deal_id", "left").select("deal_id", F.coalesce("c", F.lit(0)).cast("long").alias("cost_micro"))


def progress(facts: DataFrame) -> DataFrame:
    """Facts of each document by state, those that remain, and whether it is done."""
    of = lambda s: F.count_if(F.col("status") == s)
    out = facts.groupBy("document_id").agg(of("accepted").alias("accepted"), of("suggested").alias("suggested"), of("rejected").alias("rejected"))
    return out.withColumn("remaining", F.col("suggested")).withColumn("done", F.col("suggested") == 0)


def classification(cases: DataFrame) -> DataFrame:
    """total, correct, abstained and wrong of each expected family, and the least wrong document."""
    right, none = F.col("predicted") == F.col("expected"), F.col("predicted").isNull()
    wrong = ~F.coalesce(right, F.lit(False)) & ~none
    return cases.groupBy("expected").agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(none).alias("abstained"), F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col("document_id"))).alias("first_wrong"))


def autopsy(fields: DataFrame) -> DataFrame:
    """Missed and wrong fields of each kind: whole documents (all but one field or more missed), null truths, scattered, wrong.

    fields: document_id, truth_cents (null: labelled as absent), outcome (hit, missed or wrong).
    """
    per = fields.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "missed").alias("missed"))
    structural = (F.col("missed") > 0) & (F.col("missed") >= F.col("total") - 1)
    kind = (
        F.when(structural, F.when(F.col("outcome") == "missed", "whole_document"))
        .when((F.col("outcome") == "missed") & F.col("truth_cents").isNull(), "null_truth")
        .when(F.col("outcome") == "missed", "scattered")
        .when(F.col("outcome") == "wrong", "wrong")
    )
    return fields.join(per, "document_id").select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def signal_sweep(pages: DataFrame, sure: float = 0.9) -> DataFrame:
    """Each document's pages by detected family at or above a confidence: `wrong` for a family beside the expected one alone, `suspect` if some pages have another."""
    hits = pages.where((F.col("confidence") >= sure) & F.col("detected").isNotNull())
    other = F.count_if(F.col("detected") != F.col("expected"))
    out = hits.groupBy("document_id").agg(F.count("*").alias("pages"), other.alias("others"), F.count_distinct("detected").alias("families"))
    return out.withColumn("verdict", F.when(F.col("others") == 0, "right").when(F.col("others") == F.col("pages"), "wrong").otherwise("suspect"))


def spec_years(specs: DataFrame) -> DataFrame:
    """Gate specs that are equal but for the year, as one with its years."""
    return specs.groupBy("spec").agg(F.array_join(F.transform(F.array_sort(F.collect_set("tax_year")), lambda y: y.cast("string")), ",").alias("years"))


def latest_entries(registry: DataFrame) -> DataFrame:
    """The registry entry of the last year of each family."""
    return registry.groupBy("family").agg(F.max_by(F.struct("entry_id", "tax_year"), F.struct("tax_year", "entry_id")).alias("e")).select("family", "e.entry_id", "e.tax_year")


def base_lines(facts: DataFrame) -> DataFrame:
    """Pro-forma lines of an entity and period: expense nodes that are no totals, equal nodes added up, zero lines dropped."""
    lines = facts.where((F.col("node").startswith("is.opex.") | F.col("node").startswith("is.other.")) & ~F.col("node").endswith(".total"))
    return lines.groupBy("entity_id", "period_label", "node").agg(F.sum("value_cents").alias("amount_cents")).where("amount_cents <> 0")


def orphans(documents: DataFrame, now: Column, grace_minutes: int = 3, cap: int = 20) -> DataFrame:
    """The oldest uploaded documents that nothing has picked up, a batch of at most cap (the rest is of the next run)."""
    late = documents.where((F.col("status") == "uploaded") & (F.col("created_at") <= now - F.expr(f"INTERVAL {grace_minutes} MINUTES")))
    return late.orderBy("created_at", "id").limit(cap)


def chase(invites: DataFrame, now: Column, reminder_days: int = 7, grace_days: int = 14) -> DataFrame:
    """(invite_id, action): `expire` after the grace of a lapsed live invite, `remind` a claimed one that is due its only reminder, `problem` where a date is missing."""
    live = invites.where(F.col("revoked_at").isNull() & F.col("status").isin("pending", "active"))
    lapsed = F.col("expires_at") <= now
    days = F.timestamp_diff("DAY", F.col("created_at"), now)
    due = (F.col("status") == "active") & F.col("last_reminded_at").isNull() & ~F.col("portal_status").eqNullSafe(F.lit("complete"))
    action = (
        F.when(F.col("expires_at").isNull(), "problem")
        .when(lapsed, F.when(F.timestamp_diff("DAY", F.col("expires_at"), now) >= grace_days, "expire"))
        .when(due & F.col("created_at").isNull(), "problem")
        .when(due & (days >= reminder_days) & (F.col("n_items") > 0), "remind")
    )
    return live.select("invite_id", action.alias("action")).where("action is not null")


def policy_basis(tall: DataFrame, metric: str) -> DataFrame:
    """All cents metrics of the last period (by text order) in which an entity has the metric."""
    last = tall.where(F.col("metric") == metric).groupBy("entity_id").agg(F.max("period_label").alias("period_label"))
    return tall.where("kind = 'cents'").join(last, ["entity_id", "period_label"]).select("entity_id", "period_label", "metric", "cents")


def transcript_lines(lines: DataFrame, periods: DataFrame, fields: DataFrame) -> DataFrame:
    """Transcript lines (entity_id, tax_year, field, value_cents) bound to the period FY<year> of their entity; unknown fields are dropped."""
    of = periods.select("entity_id", F.regexp_extract("label", r"^FY(\d{4})$", 1).alias("y"), F.col("label").alias("period_label")).where("y <> ''")
    return lines.withColumn("y", F.col("tax_year").cast("string")).join(of, ["entity_id", "y"]).join(fields.select("field").distinct(), "field", "left_semi").select("entity_id", "period_label", "field", "value_cents")


def found_or_made(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids of (entity_id, label): the existing one, else one that follows from them."""
    asked = rows.select("entity_id", "label").distinct()
    made = F.sha2(F.concat_ws("|", "entity_id", "label"), 256)
    return asked.join(existing.select("entity_id", "label", "period_id"), ["entity_id", "label"], "left").select("entity_id", "label", F.coalesce("period_id", made).alias("period_id"), F.col("period_id").isNull().alias("made"))
