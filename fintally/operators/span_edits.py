"""Edits of page spans: split, merge and edit, in order, and the facts of the spans after them.

The spans and edits of a document (one file, so as many spans as it has pages at most) are folded in one expression;
facts meet their document's spans in one join and keep the page of the file that they were read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<id: long, page_start: int, page_end: int, confirmed: boolean>"
STATE = f"struct<spans: array<{SPAN}>, absorbed: array<struct<id: long, into: long>>, log: array<struct<edit_id: long, outcome: string>>>"


def _span(spans: Column, of: Column) -> Column:
    return F.try_element_at(F.filter(spans, lambda s: s["id"] == of), F.lit(1))


def _with(s: Column, start: Column, end: Column, confirmed: Column | None = None) -> Column:
    values = {"id": s["id"], "page_start": start, "page_end": end, "confirmed": s["confirmed"] if confirmed is None else confirmed}
    return F.struct(*(v.alias(k) for k, v in values.items())).cast(SPAN)


def _outcome(state: Column, e: Column) -> Column:
    """`done`, or why the edit is refused."""
    spans = state["spans"]
    target, other = _span(spans, e["span_id"]), _span(spans, e["other_id"])
    lower, upper = F.least(target["page_start"], other["page_start"]), F.greatest(target["page_start"], other["page_start"])
    lower_end = F.when(target["page_start"] == lower, target["page_end"]).otherwise(other["page_end"])
    crossed = F.exists(spans, lambda s: (s["id"] != e["span_id"]) & (s["page_start"] <= e["page_end"]) & (e["page_start"] <= s["page_end"]))
    split = F.when(e["page_start"].isNull() | ~e["page_start"].between(target["page_start"] + 1, target["page_end"]), "split page out of range")
    split = split.when(e["other_id"].isNull() | other.isNotNull(), "id taken")
    merge = F.when(e["span_id"].eqNullSafe(e["other_id"]), "same span").when(other.isNull(), "unknown span").when(upper != lower_end + 1, "not adjacent")
    edit = F.when(F.coalesce((e["page_start"] < 1) | (e["page_end"] < e["page_start"]), F.lit(True)), "invalid range").when(crossed, "overlap")
    kinds = F.when(e["kind"] == "split", split).when(e["kind"] == "merge", merge).when(e["kind"] == "edit", edit).otherwise(F.lit("unknown kind"))
    return F.coalesce(F.when(target.isNull(), F.lit("unknown span")).otherwise(kinds), F.lit("done"))


def _step(state: Column, e: Column) -> Column:
    spans, absorbed = state["spans"], state["absorbed"]
    outcome = _outcome(state, e)
    target, other = _span(spans, e["span_id"]), _span(spans, e["other_id"])
    is_target = lambda s: s["id"] == e["span_id"]
    first_half = F.transform(spans, lambda s: F.when(is_target(s), _with(s, s["page_start"], e["page_start"] - 1)).otherwise(s))
    second_half = F.struct(e["other_id"].alias("id"), e["page_start"].alias("page_start"), target["page_end"].alias("page_end"), F.lit(False).alias("confirmed")).cast(SPAN)
    survivor = F.when(target["page_start"] <= other["page_start"], e["span_id"]).otherwise(e["other_id"])
    gone = F.when(target["page_start"] <= other["page_start"], e["other_id"]).otherwise(e["span_id"])
    end = F.greatest(target["page_end"], other["page_end"])
    merged = F.transform(F.filter(spans, lambda s: s["id"] != gone), lambda s: F.when(s["id"] == survivor, _with(s, s["page_start"], end)).otherwise(s))
    edited = F.transform(spans, lambda s: F.when(is_target(s), _with(s, e["page_start"], e["page_end"])).otherwise(s))
    done = outcome == "done"
    new_spans = F.when(done & (e["kind"] == "split"), F.concat(first_half, F.array(second_half))).when(done & (e["kind"] == "merge"), merged).when(done & (e["kind"] == "edit"), edited).otherwise(spans)
    moved = F.transform(absorbed, lambda a: F.struct(a["id"].alias("id"), F.when(a["into"] == gone, survivor).otherwise(a["into"]).alias("into")))
    new_absorbed = F.when(done & (e["kind"] == "merge"), F.concat(moved, F.array(F.struct(gone.alias("id"), survivor.alias("into"))))).otherwise(absorbed)
    log = F.concat(state["log"], F.array(F.struct(e["edit_id"].alias("edit_id"), outcome.alias("outcome"))))
    return F.struct(new_spans.alias("spans"), new_absorbed.alias("absorbed"), log.alias("log")).cast(STATE)


def edited(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """document_id, spans, absorbed, log: each document's spans after its edits, in order of edit_id.

    spans: document_id, id, page_start, page_end, confirmed. edits: document_id, edit_id, kind, span_id, other_id,
    page_start, page_end. A split keeps the pages before page_start and gives the others to the new span other_id, not
    confirmed; a merge joins neighbours into the lower one; an edit sets a span's pages. An edit that would make two
    spans share a page, or swallow a page of none, is refused and changes nothing.
    """
    s = spans.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "page_start", "page_end", "confirmed").cast(SPAN))).alias("given"))
    e = edits.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("edit_id", "kind", "span_id", "other_id", "page_start", "page_end"))).alias("edits"))
    both = s.join(e, "document_id", "left")
    begin = F.struct(F.col("given").alias("spans"), F.array().alias("absorbed"), F.array().alias("log")).cast(STATE)
    # a document without edits stays as it is
    state = F.when(F.col("edits").isNull(), begin).otherwise(F.aggregate("edits", begin, _step))
    return both.withColumn("state", state).select("document_id", "state.*")


def spans_after(done: DataFrame) -> DataFrame:
    return done.select("document_id", F.inline("spans"))


def outcomes(done: DataFrame) -> DataFrame:
    return done.select("document_id", F.inline("log"))


def rebased(facts: DataFrame, spans: DataFrame, done: DataFrame) -> DataFrame:
    """facts (document_id, fact_id, span_id, source_page) with span_id and source_page as they are after the edits, and pdf_page.

    pdf_page is page_start + source_page - 1 before and after. A fact goes to the span that has its page; where none
    has it, it stays with its own span or the one that absorbed it.
    """
    old = spans.select("document_id", F.col("id").alias("span_id"), F.col("page_start").alias("_start"))
    placed = facts.join(old, ["document_id", "span_id"]).withColumn("pdf_page", F.col("_start") + F.col("source_page") - 1)
    met = placed.join(done, "document_id")
    heir = F.coalesce(F.try_element_at(F.filter("absorbed", lambda a: a["id"] == F.col("span_id")), F.lit(1))["into"], F.col("span_id"))
    owner = F.try_element_at(F.filter("spans", lambda s: F.col("pdf_page").between(s["page_start"], s["page_end"])), F.lit(1))
    met = met.withColumn("_owner", F.coalesce(owner, _span(F.col("spans"), heir)))
    return met.select("document_id", "fact_id", F.col("_owner.id").alias("span_id"), (F.col("pdf_page") - F.col("_owner.page_start") + 1).alias("source_page"), "pdf_page")
