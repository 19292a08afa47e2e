"""A registry of form fields by year, the facts that it places, dense spreads, and rows that may be malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """family, year, field_id, line, node: the fields of each form in each year that it is seeded for.

    base: family, base_year, field_id, line, node. overrides: family, year, field_id, action, line, node. A year has the
    base fields without those that it drops (`drop`), with other printed lines (`renumber`), and with its own (`add`).
    """
    years = base.select("family", F.col("base_year").alias("year")).unionByName(overrides.select("family", "year")).distinct()
    over = overrides.where("action in ('drop', 'renumber')").select("family", "year", "field_id", "action", F.col("line").alias("new_line"))
    kept = base.drop("base_year").join(years, "family").join(over, ["family", "year", "field_id"], "left").where("action is null or action <> 'drop'")
    kept = kept.select("family", "year", "field_id", F.coalesce("new_line", "line").alias("line"), "node")
    return kept.unionByName(overrides.where("action = 'add'").select("family", "year", "field_id", "line", "node"))


def placed(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """facts (family, year, field_id, ...) with line, node and registered: `yes`, `field` for a field that its form lacks that year, `year` for a form and year that is not seeded."""
    seeded = registry.select("family", "year").distinct().withColumn("_seeded", F.lit(True))
    known = facts.join(registry, ["family", "year", "field_id"], "left").join(seeded, ["family", "year"], "left")
    found = F.when(F.col("line").isNotNull() | F.col("node").isNotNull(), "yes").when(F.col("_seeded"), "field").otherwise("year")
    return known.withColumn("registered", found).drop("_seeded")


def scoped_specs(specs: DataFrame) -> DataFrame:
    """Specs (family, year, spec, kind, result, operands, tolerance_cents) by content, with the years that have it: a spec whose content differs between years gives several rows."""
    content = ["family", "spec", "kind", "result", "operands", "tolerance_cents"]
    return specs.groupBy(*content).agg(F.array_sort(F.collect_set("year")).alias("years"))


def dense_spread(cells: DataFrame, nodes: tuple[str, ...]) -> DataFrame:
    """entity_id, period_label, node, value_cents, status: a row for every node of every period of an entity, nulls where it has no fact.

    cells: ledger.spread(). The grid comes from one aggregation: a period's cells go into a map, which is read at each node.
    """
    periods = cells.groupBy("entity_id", "period_label").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("value_cents", "status")))).alias("found"))
    grid = periods.select("entity_id", "period_label", "found", F.explode(F.array(*map(F.lit, nodes))).alias("node"))
    cell = F.try_element_at("found", F.col("node"))
    return grid.select("entity_id", "period_label", "node", cell["value_cents"].alias("value_cents"), cell["status"].alias("status"))


def tolerant(df: DataFrame, column: str, schema: str, checks: dict[str, Column]) -> DataFrame:
    """df with the fields of a JSON column and reason: null for a row that is well formed, else why it is set aside.

    A row is set aside if its JSON is null, broken or no object of that schema, or by the first check that holds (null
    counts as not). Set-aside rows keep their column, and none of the fields.
    """
    parsed = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = df.withColumn("_p", parsed)
    broken = F.col("_p._corrupt").isNotNull() | F.col("_p").isNull() | ~F.col(column).rlike(r"^\s*\{")
    reason = F.when(F.col(column).isNull(), "missing").when(broken, "malformed")
    wide = read.select(*df.columns, "_p", F.col("_p.*")).drop("_corrupt")
    for name, holds in checks.items():
        reason = reason.when(F.coalesce(holds, F.lit(False)), name)
    names = [f for f in wide.columns if f not in df.columns and f != "_p"]
    marked = wide.withColumn("reason", reason)
    return marked.select(*df.columns, *(F.when(F.col("reason").isNull(), F.col(n)).alias(n) for n in names), "reason")


def requested_items(text: Column) -> Column:
    """array<struct<key, label, families>> of a JSON array of requested items; an empty one for any other text.

    An element that is no object, or has neither label nor key, is left out. The label is the key where there is none; a
    key or label that is no string is none, and so is a blank one. families are the strings of formFamilies, blanks left out.
    """
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    bare = lambda v: F.regexp_replace(F.try_variant_get(v, "$", "string"), r"^\s+|\s+$", "")
    member = lambda e, name: F.try_variant_get(e, f"$.{name}", "variant")
    read = lambda e, name: F.when(is_text(member(e, name)) & (bare(member(e, name)) != ""), bare(member(e, name)))
    every = lambda e: F.coalesce(F.try_variant_get(e, "$.formFamilies", "array<variant>"), F.array().cast("array<variant>"))
    families = lambda e: F.transform(F.filter(every(e), lambda f: is_text(f) & (bare(f) != "")), lambda f: F.try_variant_get(f, "$", "string"))
    given = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>"))
    items = F.transform(given, lambda e: F.struct(read(e, "key").alias("key"), F.coalesce(read(e, "label"), read(e, "key")).alias("label"), families(e).alias("families")))
    return F.filter(items, lambda i: i["label"].isNotNull())
