"""Streaming analogues against batch twins, and sources and sinks on small files."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fintally.sources import files
from fintally.streaming import events, limits, runs

T0 = datetime(2024, 1, 1)


def _stream(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def _run(spark, df, tmp_path, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_intake_and_days(spark, tmp_path):
    rows = [(i % 5, T0 + timedelta(hours=i), "error" if i % 3 == 0 else "view", 10) for i in range(10)]
    schema = "event_id long, ts timestamp, event_type string, cents long"
    src = _stream(spark, tmp_path, rows, schema, "in")
    assert sorted(r[0] for r in _run(spark, events.once(src), tmp_path, "intake")) == [0, 1, 2, 3, 4]
    assert _run(spark, events.daily(src), tmp_path, "days", "complete") == [("2024-01-01", 10, 4, 100)]


def limited_by_hand(rows, limit, us, passed):
    """Users' events in order of time and id, as one batch."""
    out, open_since = [], {}
    for user, event, at, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if at >= passed:
            continue
        opened, used = open_since.get(user, (None, 0))
        if opened is None or at - opened >= us:
            opened, used = at, 0
        open_since[user] = (opened, used + 1)
        out.append((user, event, used + 1 <= limit))
    return sorted(out)


def test_rate_limit_of_late_events(spark):
    rng = random.Random(3)
    rows = [(1, k, s * 1_000_000, 0) for k, s in enumerate([30, 50, 80, 95, 100])]
    rows += [(2 + rng.randrange(4), 10 + k, rng.randrange(4000) * 250_000, 0) for k in range(300)]
    # a batch comes up to 200 seconds after its time, in any order
    rows = [(u, e, at, min(3, (at // 1_000_000 + rng.randrange(200)) // 300)) for u, e, at, _ in rows] + [(9, 999, 5_000_000_000, 3), (None, 1, 0, 0), (3, 2, None, 0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, us long, batch int").withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = runs.drained(limits.rate_limited(runs.arrivals(df, 4, "batch"), limit=2, seconds=60, late="10 minutes"))
    given = [r for r in rows if r[0] is not None and r[2] is not None]
    assert sorted(tuple(r) for r in got.collect()) == limited_by_hand(given, 2, 60_000_000, 4_400_000_000)


def test_runs_without_follow_up_and_intake(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    started = spark.createDataFrame([(1, at(0), 0), (2, at(10), 0), (3, at(20), 1), (4, at(5000), 1)], "run_id long, ts timestamp, batch int")
    finished = spark.createDataFrame([(1, at(100), 1), (2, at(500), 0), (3, at(19), 0), (9, at(5000), 1)], "run_id long, ts timestamp, batch int")
    lost = runs.drained(events.without_follow_up(runs.arrivals(started, 2, "batch"), runs.arrivals(finished, 2, "batch"), "3 minutes", "10 minutes"))
    assert sorted(r["run_id"] for r in lost.collect()) == [2, 3]
    sent = spark.createDataFrame([(1, at(0), 0), (1, at(0), 1), (2, at(5), 1), (2, at(5), 1)], "event_id long, ts timestamp, batch int")
    assert sorted(r["event_id"] for r in runs.drained(events.once(runs.arrivals(sent, 2, "batch"))).collect()) == [1, 2]


def test_html_tables_and_json(spark):
    df = spark.createDataFrame([("<table><tr><th>A</th><td> 1&nbsp;&amp; <b>2</b></td></tr><tr><td></td></tr></table>", '{"x": 1}'), ("none", "{bad")], "html string, j string")
    assert [r[0] for r in df.select(files.html_rows(F.col("html"))).collect()] == [[["A", "1 & 2"], [""]], []]
    assert [(r["malformed"], r["x"]) for r in files.typed_json(df, "j", "x int").collect()] == [(False, 1), (True, None)]


def test_upserts_and_partitions(spark, tmp_path):
    schema = "tenant_id long, label string, node string, source string, usage_count int"
    known = spark.createDataFrame([(None, "rent", "a", "human", 3), (1, "fuel", "b", "llm", 1)], schema)
    new = spark.createDataFrame([(None, "rent", "z", "llm", 0), (1, "fuel", "c", "human", 0), (2, "new", "d", "llm", 0)], schema)
    got = {(r[0], r[1]): tuple(r)[2:] for r in files.upsert_mappings(known, new).collect()}
    assert got == {(None, "rent"): ("a", "human", 4), (1, "fuel"): ("c", "human", 2), (2, "new"): ("d", "llm", 1)}
    at = str(tmp_path / "t")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "deal long, v string"), at, "deal")
    files.replace_partitions(spark.createDataFrame([(2, "c")], "deal long, v string"), at, "deal")
    assert sorted((r["deal"], r["v"]) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c")]
