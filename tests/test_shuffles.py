"""Shuffles that queries share or do without."""

from pyspark.sql import functions as F

from fintally.model import facts
from fintally.operators import gates, matching, recompute, review, selections

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_transcripts_read_the_facts_once(spark):
    assert plan(gates.transcripts(facts(spark, SF, by_entity=True))).count("Join ") == 1
    rows = [("e", "FY1", "n", "a", "transcript", "accepted", 5, 2), ("e", "FY1", "n", "b", "transcript", "accepted", 7, 1), ("e", "FY1", "n", "c", "llm", "accepted", 5, 3), (None, "FY1", "n", "d", "transcript", "accepted", 1, 1), (None, "FY1", "n", "f", "llm", "accepted", 2, 1)]
    f = spark.createDataFrame(rows, "entity_id string, period_label string, node string, id string, method string, status string, value_cents long, created_at int")
    assert [(r["fact_ids"], r["delta_cents"]) for r in gates.transcripts(f).collect()] == [("b,c", 2)]


def test_ids_are_made_behind_the_shuffle_of_facts_by_entity(spark):
    text = facts(spark, SF, by_entity=True)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("concat_ws") < text.index("RepartitionByExpression")
    assert facts(spark, SF, by_entity=True).exceptAll(facts(spark, SF)).count() == 0


def test_changed_deals_of_nulls(spark):
    of = lambda rows: spark.createDataFrame(rows, "deal_id long, id string, v long")
    before, after = of([(1, None, 1), (1, "a", 2), (2, "a", 2), (None, "x", 1), (3, "c", None)]), of([(1, None, 1), (1, "a", 2), (2, "a", 3), (None, "x", 2), (3, "c", None), (4, None, None)])
    assert sorted((r[0] for r in recompute.changed_deals(before, after, ["id"]).collect()), key=str) == [2, 4, None]
    assert recompute.changed_deals(before, before, ["id"]).count() == 0


def test_notifications_are_not_shuffled(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    events = of([(1, 1), (1, 1), (1, 2), (2, 1), (None, 1), (3, None)], "event_id long, tenant_id long")
    members = of([(1, 10, 2), (1, 10, 3), (2, 10, 2), (1, 11, 2), (1, 12, 1), (2, None, 2), (None, 13, 2)], "tenant_id long, user_id long, tier int")
    got = selections.notify(events, members, of([(1, 11), (2, None), (None, 10)], "event_id long, user_id long"), 2)
    want = [(1, 10), (1, None), (2, 10), (2, 11), (None, 10), (None, 11)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert plan(got).count("LeftAnti") == 0


def test_equal_mappings_meet_no_label(spark):
    labels = spark.createDataFrame([(1, "net sales of goods")], "tenant_id long, label string")
    pool = spark.range(500).select(F.lit(1).cast("long").alias("tenant_id"), F.lit("net sales of goods").alias("known"), F.concat(F.lit("node"), "id").alias("node"), F.col("id").alias("position"))
    got = matching.map_labels(labels, pool, ["node7"])
    assert [tuple(r) for r in got.collect()] == [(1, "net sales of goods", "node499", "exact_tenant")]
    assert "max_by(struct(node" in got._jdf.queryExecution().optimizedPlan().toString()


def test_reverts_deal_what_they_change_by_id_once(spark):
    rows = [("a", "overridden", "llm", "a+"), ("b", "overridden", "llm", "a+"), ("a+", "accepted", "override", None), ("c", "accepted", "llm", None)]
    f = spark.createDataFrame(rows, "id string, status string, method string, superseded_by string").hint("merge")
    out = review.reverted(f, spark.createDataFrame([("a+",), ("a+",), ("c",)], "fact_id string"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "accepted", "llm", None), ("a+", "rejected", "override", None), ("b", "accepted", "llm", None), ("c", "accepted", "llm", None)]
    assert "hashpartitioning(_id" in (text := out._jdf.queryExecution().executedPlan().toString())
    assert "_status" not in "".join(line.split("hashpartitioning(")[1].split(")")[0] for line in text.splitlines() if "hashpartitioning(" in line)
