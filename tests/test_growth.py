"""What grows with larger tables: shorter ways give the results of the long ones."""

import random

from pyspark.sql import functions as F

from fintally import model
from fintally.operators import matching, statements, text
from fintally.plans import portfolio, reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_names_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_CHARS", 300)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé𝒳 ") for _ in range(rng.randrange(9)))
    customers = spark.createDataFrame([(k, word().upper() if k % 9 else None) for k in range(150)] + [(500, "Customer#000000123")], "c_custkey long, c_name string")
    suppliers = spark.createDataFrame([(1000 - k, word()) for k in range(200)] + [(7, None), (None, "bbbbbbbbbbbbb"), *((2000 + k, f"Supplier#{k:09d}") for k in range(300))], "s_suppkey long, s_name string")
    got = reports.most_similar(customers, suppliers)
    assert "levenshtein" not in plan(got)
    pairs = customers.where("c_name is not null").crossJoin(suppliers.where("s_name is not null")).select("c_custkey", "s_suppkey", text.similarity_points(F.lower("c_name"), F.lower("s_name")).alias("points"))
    want = pairs.groupBy("c_custkey").agg(F.min(F.struct(-F.col("points"), F.coalesce("s_suppkey", F.lit((1 << 63) - 1)), "s_suppkey")).alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1][2], -r[1][0]) for r in want.collect())


def test_rows_of_whole_grids_are_those_of_their_cells(spark):
    rng = random.Random(3)
    shown = ["1,234.50", "(12)", "-$7.1", "—", "", None, "n/a", "1.234", " 5 ", "12.345", "-(3)", "999999999999.99", "1234567890123", "(1,2,3)", "4.00"]
    cells = [(g, rng.randrange(-1, 7), c, ("Total" if rng.random() < 0.3 else f"x{g}") if c == 0 else rng.choice(shown)) for g in range(60) for c in range(4)]
    flat = spark.createDataFrame(sorted(set(cells), key=lambda _: rng.random()) + [(99, None, 1, "3"), (99, None, 0, "b")], "grid_id long, row int, col int, text string")
    whole = flat.groupBy("grid_id").agg(F.collect_list(F.struct("row", "col", "text")).alias("cells")).unionByName(spark.createDataFrame([(1000, []), (1001, None)], "grid_id long, cells array<struct<row: int, col: int, text: string>>"))
    shape = lambda rows: sorted((r["grid_id"], str(r["row"]), r["label"], sorted(r["cells"].items())) for r in rows.collect())
    assert shape(statements.rows_of_grids(whole)) == shape(statements.grid_rows(flat))
    want = sorted(map(str, statements.typed_rows(statements.grid_rows(flat)).collect()))
    assert sorted(map(str, statements.typed_rows_of_grids(whole).collect())) == want
    query = portfolio.QUERIES["t12_row_types"](spark, "/root/testdata/sf0.001")
    # one shuffle, of lines, which are grouped once; what they are laid out to is not dealt or sorted
    text_of = query._jdf.queryExecution().executedPlan().toString()
    assert text_of.count("Exchange ") == 1 and "Sort [" not in text_of and "keys=[grid_id" not in text_of


def test_common_amounts_are_read_as_all_others(spark):
    rng = random.Random(2)
    some = ["".join(rng.choice("0123456789012345,,..$()-—− \n'N/A") for _ in range(rng.randrange(9))) for _ in range(3000)]
    some += [f"{s}{w}{d}{e}" for w in ("0", "12", "1,234", "1234567", "999,999,999,999", "1,2345", "1234567890123456789") for s in ("", "-", "$", "-$", "$-", "(", "(-") for d in ("", ".", ".5", ".50", ".505", ",50") for e in ("", ")", "\n", "-")]
    df = spark.createDataFrame([(x,) for x in some] + [(None,)], "x string")
    for scale in (1, 1000):
        both = df.select("x", text.normalize_amount(F.col("x"), scale).alias("a"), text._any_amount(F.col("x"), scale, None).alias("b"))
        assert both.where("not (a <=> b)").collect() == []


def test_facts_by_entity_are_dealt_to_bounded_tasks(spark):
    assert model.parts_of(spark.range(1001), 100) == 11
    assert model.parts_of(spark.range(1001), 1000) == spark.sparkContext.defaultParallelism
    # a number that is given isn't coalesced to tasks that spill
    assert "REPARTITION_BY_NUM" in model.facts(spark, "/root/testdata/sf0.001", by_entity=True)._jdf.queryExecution().executedPlan().toString()
