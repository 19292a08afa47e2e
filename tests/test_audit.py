"""The audit log and the recompute of changed deals."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from fintally.operators import audit, recompute

ROWS = "tenant string, k long, v string"


def test_changes(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 3, "n"), ("b", None, None), ("b", 4, "same")], ROWS)
    after = spark.createDataFrame([("a", 1, "x"), ("a", 2, "w"), (None, 3, None), ("b", 4, "same"), ("c", 5, 'q"\n')], ROWS)
    got = {(r["tenant_id"], r["k"]): (r["action"], r["before"], r["after"]) for r in audit.changes(before, after, "tenant", ["k"]).collect()}
    assert got == {
        ("a", 2): ("UPDATE", '{"tenant":"a","k":2,"v":"y"}', '{"tenant":"a","k":2,"v":"w"}'),
        (None, 3): ("UPDATE", '{"tenant":null,"k":3,"v":"n"}', '{"tenant":null,"k":3,"v":null}'),
        ("b", None): ("DELETE", '{"tenant":"b","k":null,"v":null}', None),
        ("c", 5): ("INSERT", None, '{"tenant":"c","k":5,"v":"q\\"\\n"}'),
    }
    assert audit.changes(after, after, "tenant", ["k"]).count() == 0 == audit.changes(after.limit(0), after.limit(0), "tenant", ["k"]).count()


def test_chain_is_carried_on_and_breaks_are_found(spark):
    at = F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz")
    first = spark.createDataFrame([("a", i, "x") for i in range(40)] + [("b", 1, None)], ROWS)
    second = first.withColumn("v", F.concat(F.lit("é "), F.col("k"))).unionByName(spark.createDataFrame([("c", 9, "new")], ROWS))
    none = first.limit(0)
    log = audit.appended(None, audit.changes(none, first, "tenant", ["k"]), ["k"], "t", F.lit(None), at)
    both = log.unionByName(audit.appended(log, audit.changes(first, second, "tenant", ["k"]), ["k"], "t", F.lit("me"), at))
    rows = sorted(both.collect(), key=lambda r: (r["tenant_id"], r["id"]))
    held = {}
    for r in rows:
        text = f"{r['id']}|{r['tenant_id']}|{r['actor_id'] or ''}|{r['action']}|t|{r['row_id']}|{r['before'] or ''}|{r['after'] or ''}|2024-01-02T03:04:05.500000Z"
        last, n = held.get(r["tenant_id"], (None, 0))
        assert (r["id"], r["payload"], r["prev_hash"]) == (n + 1, text, last)
        held[r["tenant_id"]] = (hashlib.sha256(((last or "") + text).encode()).hexdigest(), n + 1)
        assert r["row_hash"] == held[r["tenant_id"]][0]
    assert {t: n for t, (_, n) in held.items()} == {"a": 80, "b": 2, "c": 1}
    assert audit.chain_breaks(both).count() == 0
    table = spark.createDataFrame([(r["tenant_id"], r["id"], r["payload"], r["prev_hash"], r["row_hash"]) for r in rows], "tenant_id string, id long, payload string, prev_hash string, row_hash string")
    hit = (F.col("tenant_id") == "a") & (F.col("id") == 30)
    found = lambda df: [tuple(r) for r in audit.chain_breaks(df).collect()]
    assert found(table.withColumn("payload", F.when(hit, "forged").otherwise(F.col("payload")))) == [("a", 30, "row_hash")]
    assert found(table.where(~hit)) == [("a", 31, "prev_hash")]
    assert found(table.withColumn("row_hash", F.when(hit, None).otherwise(F.col("row_hash")))) == [("a", 30, "row_hash")]
    assert found(table.where("tenant_id <> 'a' or id > 1")) == [("a", 2, "prev_hash")]
    assert found(table.where("tenant_id <> 'b' or id < 2")) == []  # the end of a chain can go unseen


def test_a_tenants_rows_meet_its_head_however_partitions_are_coalesced(spark):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    held = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        noise = F.concat(*(F.sha2(F.concat_ws(":", "id", F.lit(i)), 256) for i in range(12)))
        first = spark.range(12_000).select((F.col("id") % 3000).alias("tenant"), F.col("id").alias("k"), noise.alias("v"))
        second = first.withColumn("v", F.when(F.col("k") % 3 == 0, "edited").otherwise(F.col("v")))
        log = audit.appended(None, audit.changes(first.limit(0), first, "tenant", ["k"]), ["k"], "t", F.lit(None), at)
        new = audit.appended(log, audit.changes(first, second, "tenant", ["k"]), ["k"], "t", F.lit("me"), at)
        assert new.agg(F.count("*"), F.count("prev_hash")).first()[:] == (4000, 4000)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def files(path, deal):
    return {p: p.stat().st_mtime_ns for p in Path(path).glob(f"deal_id={deal}/**/*.parquet")}


def test_partitions_of_other_deals_stay(spark, tmp_path):
    facts = spark.createDataFrame([(d, f"{d}-{i}", d * 100 + i) for d in (1, 2, 3) for i in range(3)], "deal_id long, id string, cents long")
    run = lambda add: lambda f: f.groupBy("deal_id").agg((F.sum("cents") + add).alias("cents")).withColumn("metric", F.lit("sum"))
    scenarios, path = {"none": run(0), "more": run(5)}, str(tmp_path / "metrics")
    every = recompute.changed_deals(facts.limit(0), facts, ["id"])
    recompute.replace_partitions(recompute.computed(facts, scenarios), every, [*scenarios], path)
    after = facts.where("deal_id <> 3").withColumn("cents", F.when(F.col("id") == "1-0", 7).otherwise(F.col("cents")))
    deals = recompute.changed_deals(facts, after, ["id"])
    assert sorted(r[0] for r in deals.collect()) == [1, 3]
    kept, old = files(path, 2), files(path, 1)
    recompute.replace_partitions(recompute.computed(after.join(deals, "deal_id", "left_semi"), scenarios), deals, [*scenarios], path)
    assert kept == files(path, 2) and kept and not set(old) & set(files(path, 1))
    show = lambda df: sorted(map(tuple, df.select("deal_id", "scenario_id", "metric", "cents").collect()))
    got = show(recompute.stored_metrics(spark.read.parquet(path)))
    assert got == show(recompute.computed(after, scenarios)) == show(recompute.recomputed(recompute.computed(facts, scenarios), after, deals, scenarios))


def test_issues_are_resolved_and_added(spark):
    old = spark.createDataFrame([(1, "G1", "open", None), (1, "G2", "resolved", "then"), (2, "G1", "open", None)], "deal_id long, gate string, status string, resolved_at string")
    fresh = spark.createDataFrame([(1, "G4")], "deal_id long, gate string")
    got = recompute.synced_issues(old, fresh, spark.createDataFrame([(1,)], "deal_id long"), F.lit("now"))
    assert sorted(tuple(r) for r in got.select("deal_id", "gate", "status", "resolved_at").collect()) == [(1, "G1", "resolved", "now"), (1, "G2", "resolved", "then"), (1, "G4", "open", None), (2, "G1", "open", None)]
