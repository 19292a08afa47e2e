"""Read models: roll-ups, queues, selections, spans, mappings and the audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_by_deal(runs: DataFrame, envelope_micro: int) -> DataFrame:
    """Runs, failures, pages, cost and the cost of each stage (stage=cost, comma-joined) of each deal; over its envelope or not."""
    per = runs.groupBy("deal_id", "stage").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.sum("pages").alias("pages"), F.sum("cost_micro").alias("cost"))
    stages = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", "cost"))), ",")
    out = per.groupBy("deal_id").agg(F.sum("n").alias("runs"), F.sum("failed").alias("failed"), F.sum("pages").alias("pages"), F.sum("cost").alias("cost_micro"), stages.alias("by_stage"))
    return out.withColumn("over_envelope", F.col("cost_micro") > envelope_micro)


def daily_usage(runs: DataFrame, end: Column, days: int = 30) -> DataFrame:
    """A row for each of the days before end, zero where nothing ran."""
    bounds = runs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), F.date_sub(end, 1))).alias("day"))
    per = runs.groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("runs"), F.count_if("failed").alias("failed"), F.sum("pages").alias("pages"), F.sum("cost_micro").alias("cost_micro"))
    return bounds.join(per, "day", "left").na.fill(0).withColumn("day", F.col("day").cast("string"))


def review_queue(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts under review with their place: worst severity first, then document, oldest, id."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "error", 2).otherwise(1)
    worst = issues.select(rank.alias("severity_rank"), F.explode(F.split("fact_ids", ",")).alias("id")).groupBy("id").agg(F.max("severity_rank").alias("severity_rank"))
    return facts.where("status = 'suggested'").join(worst, "id", "left").select("id", "document_id", "created_at", F.coalesce("severity_rank", F.lit(0)).alias("severity_rank")).orderBy(F.col("severity_rank").desc(), "document_id", "created_at", "id")


def keyset_page(df: DataFrame, id_col: str, cursor: int, size: int) -> DataFrame:
    """The page below a cursor, newest first; one row more than size tells that another page follows."""
    return df.where(F.col(id_col) < cursor).orderBy(F.col(id_col).desc()).limit(size + 1)


def best_mappings(mappings: DataFrame) -> DataFrame:
    """One mapping for each (tenant, label): human first, then most used, then newest, then the greatest id."""
    order = F.struct((F.col("source") == "human").cast("int"), "usage_count", "updated_at", "id")
    return mappings.groupBy("tenant_id", "label").agg(F.max_by(F.struct("id", "source", "usage_count"), order).alias("m")).select("tenant_id", "label", "m.*")


def redundant_spans(spans: DataFrame) -> DataFrame:
    """Spans without those that lie in a wider span of the same document, family and tax year, or equal one with a lesser id.

    One sweep: from left to right, wider ones first, a span goes if one before it reaches as far. Nulls of a key are alike.
    """
    order = Window.partitionBy("document_id", "family", "tax_year").orderBy("page_start", F.desc("page_end"), "id")
    reached = F.max("page_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reached", reached).where(~F.coalesce(F.col("_reached") >= F.col("page_end"), F.lit(False))).drop("_reached")


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans that share a page with another span of the document: one before them reaches them, or they reach the next one."""
    order = Window.partitionBy("document_id").orderBy("page_start", "page_end", "id")
    before = F.max("page_end").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("page_start")
    behind = F.lead("page_start").over(order) <= F.col("page_end")
    met = F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False))
    return spans.withColumn("_met", met).where("_met").drop("_met")


def accuracy(cases: DataFrame) -> DataFrame:
    """Precision and recall in ten-thousandths, overall, by form and by quality; null on a zero denominator."""
    n = lambda condition: F.count_if(F.expr(condition))
    out = cases.cube("form", "quality").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), n("predicted = 1").alias("positive"), n("predicted = 1 and truth = 1").alias("right"), n("truth = 1").alias("actual")
    ).where("g <> 0")
    rate = lambda d: F.when(F.col(d) > 0, F.floor(F.col("right") * 10_000 / F.col(d)).cast("long"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "form").otherwise("quality")
    return out.select(level.alias("level"), F.coalesce("form", "quality", F.lit("")).alias("name"), "n", rate("positive").alias("precision_points"), rate("actual").alias("recall_points"))
