"""Corrections, guarded transitions and reverts of facts; portal states; the tax spread; the base of a projection.

Everything is equi-joins and grouped aggregates that combine before the shuffle. Cases: nulls in a compared column make a
request refused and never an error; repeated facts of one id are the caller's to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fintally.functions.scalars import treatment

PROCESSING, BROKEN = ("uploaded", "processing"), ("infected", "failed")


def corrections(facts: DataFrame, wanted: DataFrame, allow_accepted: bool = False) -> DataFrame:
    """The rows that corrections write: an override inserted and the old fact patched, or one refused row with its reason.

    facts: id, status, value_cents; wanted: request_id, fact_id, corrected (whole cents as text). The old value stays
    with the insert; suggested facts can be corrected, accepted ones only where that is allowed.
    """
    old = facts.select(F.col("id").alias("fact_id"), F.col("status").alias("_status"), F.col("value_cents").alias("_value"))
    asked = wanted.select("request_id", "fact_id", "corrected").join(old, "fact_id", "left")
    open_now = F.col("_status").isin("suggested", "accepted") if allow_accepted else F.col("_status") == "suggested"
    value = F.when(F.col("corrected").rlike(r"\A-?[0-9]+\z"), F.col("corrected").try_cast("bigint"))
    reason = (
        F.when(F.col("_status").isNull(), "unknown fact")
        .when(~open_now, "not correctable")
        .when(~F.coalesce(F.col("corrected").rlike(r"\A-?[0-9]+\z"), F.lit(False)), "not whole cents")
        .when(value.isNull(), "out of range")
    )
    none = F.lit(None).cast("bigint")
    row = lambda action, status, method, cents, was: F.struct(
        F.lit(action).alias("action"), status.alias("status"), method.alias("method"), cents.alias("value_cents"), was.alias("original_value_cents")
    )
    no_text = F.lit(None).cast("string")
    write = F.array(
        row("insert", F.lit("accepted"), F.lit("override"), value, F.col("_value")),
        row("patch", F.lit("overridden"), no_text, none, none),
    )
    refuse = F.array(row("refused", F.col("_status"), no_text, none, none))
    rows = asked.withColumn("reason", reason)
    return rows.select("request_id", "fact_id", "reason", F.inline(F.when(F.col("reason").isNull(), write).otherwise(refuse)))


def transitions(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """fact_id, status and conflicts of each fact asked for: the first request (at, request_id) moves a suggested fact, all others conflict.

    wanted: request_id, fact_id, at, target (accepted or rejected). An unknown fact has a null status.
    """
    first = wanted.groupBy("fact_id").agg(F.min_by("target", F.struct("at", "request_id")).alias("target"), F.count("*").alias("n"))
    now = first.join(facts.select(F.col("id").alias("fact_id"), F.col("status").alias("was")), "fact_id", "left")
    moves = F.coalesce((F.col("was") == "suggested") & F.col("target").isin("accepted", "rejected"), F.lit(False))
    return now.select("fact_id", F.when(moves, F.col("target")).otherwise(F.col("was")).alias("status"), (F.col("n") - moves.cast("int")).alias("conflicts"))


def reverted(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """facts (id, status, method, superseded_by) after reverts of the overrides whose id is in overrides.fact_id.

    The override is rejected, and the overridden fact that names it as its successor is accepted again. An override that
    nothing points to is left alone.
    """
    asked = facts.join(overrides.select(F.col("fact_id").alias("id")), "id", "left_semi")
    asked = asked.where("method = 'override'").select(F.col("id").alias("_new"))
    pairs = facts.join(asked, F.col("superseded_by") == F.col("_new")).select(F.col("id").alias("_old"), "_new")
    after = pairs.select(F.inline(F.array(F.struct(F.col("_old").alias("_id"), F.lit("accepted").alias("_status")), F.struct(F.col("_new").alias("_id"), F.lit("rejected").alias("_status")))))
    # dealt by id once: rows of an id are made distinct and joined where they are
    after = after.repartition("_id").distinct()
    joined = facts.join(after, F.col("id") == F.col("_id"), "left")
    return joined.select("id", F.coalesce("_status", "status").alias("status"), "method", F.when(~F.col("_status").eqNullSafe("accepted"), F.col("superseded_by")).alias("superseded_by"))


def portal_states(invites: DataFrame, items: DataFrame, uploads: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """user_id, invite_id, status and counts of each user's newest live invite; a missing creation time counts as newest.

    complete if so marked, else action_needed with open requests, collecting with unsatisfied items, received while
    files are processed, else in_review. Only the invite's own uploads satisfy its items.
    """
    live = invites.where((F.col("status") == "active") & F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    newest = F.max_by(F.struct("invite_id", "portal_status"), F.struct(F.col("created_at").isNull(), "created_at", "invite_id"))
    mine = live.groupBy("user_id").agg(newest.alias("i")).select("user_id", "i.*")
    given = uploads.select("invite_id", "family").distinct().withColumn("given", F.lit(True))
    each = items.select("invite_id", "item", F.explode_outer("families").alias("family")).join(given, ["invite_id", "family"], "left")
    each = each.groupBy("invite_id", "item").agg(F.coalesce(F.bool_or("given"), F.lit(False)).alias("satisfied"))
    wanted = each.groupBy("invite_id").agg(F.count_if(~F.col("satisfied")).alias("unsatisfied"))
    broken = F.coalesce(F.col("virus_scan").isin(*BROKEN), F.lit(False)) | F.coalesce(F.col("status") == "failed", F.lit(False))
    files = uploads.groupBy("invite_id").agg(F.count_if(F.col("status").isin(*PROCESSING)).alias("processing"), F.count_if(broken).alias("replace"))
    asked = requests.groupBy("invite_id").agg(F.count_if(F.col("status") == "open").alias("requests"))
    out = mine.join(wanted, "invite_id", "left").join(files, "invite_id", "left").join(asked, "invite_id", "left").na.fill(0, ["unsatisfied", "processing", "replace", "requests"])
    status = (
        F.when(F.col("portal_status") == "complete", "complete")
        .when(F.col("requests") > 0, "action_needed")
        .when(F.col("unsatisfied") > 0, "collecting")
        .when(F.col("processing") > 0, "received")
        .otherwise("in_review")
    )
    return out.select("user_id", "invite_id", status.alias("status"), "unsatisfied", "requests", "replace")


def tax_spread(meta: DataFrame, facts: DataFrame) -> DataFrame:
    """Long rows of the tax spread: a header of each form that has cells, and a row of each line and period.

    meta: field_id, position (the registry's order), family; facts: entity_id, field_id, period_label, id, value_cents,
    method, status, rank, created_at. Accepted facts come before suggested ones, then authority, then age. A cell is
    verified if an accepted fact of another method has the value of the newest accepted transcript.
    """
    cell = ["entity_id", "field_id", "period_label"]
    known = facts.where(F.col("status").isin("accepted", "suggested")).join(meta.select("field_id", "position", "family"), "field_id")
    accepted, transcript = F.col("status") == "accepted", F.col("method") == "transcript"
    best = F.min_by(F.struct("id", "value_cents", "method", "status"), F.struct(~accepted, -F.col("rank"), "created_at", "id"))
    sure = accepted & transcript
    tried = F.max_by(F.when(sure, F.col("value_cents")), F.when(sure, F.struct("created_at", "id")))
    cells = known.groupBy(*cell, "position", "family").agg(best.alias("b"), tried.alias("transcript_cents"))
    parsed = known.where(accepted & ~transcript).select(*cell, F.col("value_cents").alias("transcript_cents")).distinct().withColumn("same", F.lit(True))
    lines = cells.join(parsed, [*cell, "transcript_cents"], "left")
    lines = lines.select("entity_id", "position", F.lit("line").alias("kind"), F.col("field_id").alias("key"), "period_label", F.col("b.id").alias("fact_id"), F.col("b.value_cents").alias("value_cents"), F.col("b.method").alias("method"), F.col("b.status").alias("status"), F.coalesce("same", F.lit(False)).alias("verified"))
    heads = cells.groupBy("entity_id", "family").agg(F.min("position").alias("position")).withColumn("kind", F.lit("form")).withColumnRenamed("family", "key")
    return lines.unionByName(heads, allowMissingColumns=True)


def projection_base(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """The base of each deal's projection: a row for each expense line of the newest period of its target.

    entities: deal_id, entity_id, kind: the target, else the applicant, else the first. Revenue is the stated total, or
    the sum of all revenue lines where that is missing or zero. Totals and zero lines are left out; a base without a
    line has one row with null line columns.
    """
    rank = F.struct(F.col("kind") != "target", F.col("kind") != "applicant", "entity_id")
    target = entities.groupBy("deal_id").agg(F.min_by("entity_id", rank).alias("entity_id"))
    own = facts.where(F.col("status").isin("accepted", "overridden") & F.col("node").startswith("is.")).join(target, "entity_id")
    sums = own.groupBy("deal_id", "entity_id", "period_label", "node").agg(F.sum("value_cents").alias("amount_cents"), F.count("*").alias("n_sources"))
    newest = sums.groupBy("deal_id").agg(F.max("period_label").alias("period_label"))
    base = sums.join(newest, ["deal_id", "period_label"])
    sales = F.col("node").startswith("is.revenue.")
    total = F.sum(F.when(F.col("node") == "is.revenue.total", F.col("amount_cents")))
    revenue = F.when(total != 0, total).otherwise(F.coalesce(F.sum(F.when(sales, F.col("amount_cents"))), F.lit(0)))
    heads = base.groupBy("deal_id", "entity_id", "period_label").agg(revenue.alias("revenue_cents"))
    expense = (F.col("node").startswith("is.opex.") | F.col("node").startswith("is.other.")) & ~F.col("node").endswith(".total") & (F.col("amount_cents") != 0)
    lines = base.where(expense).select("deal_id", "node", "amount_cents", treatment(F.col("node")).alias("treatment"), "n_sources")
    return heads.join(lines, "deal_id", "left")
