"""Operators of the engine: money, ledger, gates, scoring, loans, text; and the SQL twins on the smallest tables."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fintally import catalog
from fintally.functions import money
from fintally.operators import gates, ledger, loans, matching, page_signals, review, scoring, statements, text, workflow

SF = "/root/testdata/sf0.001"


def test_half_even_matches_integers(spark):
    cases = [(n, d) for n in (*range(-25, 26), 10**24 + 5, -(10**24) - 5, 5 * 10**17) for d in (1, 2, 4, 10, -10, 7, 10**12)]
    rows = spark.createDataFrame([(str(n), str(d)) for n, d in cases], "n string, d string")
    got = [int(r[0]) for r in rows.select(money.half_even(F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)"))).collect()]
    assert got == [loans.round_half_even(n, d) for n, d in cases]


@settings(max_examples=40, deadline=None)
@given(st.integers(10_000, 50_000_000_000), st.integers(1, 300), st.integers(0, 2000), st.integers(0, 24))
def test_schedules_retire_the_loan(principal, term, bps, interest_only):
    interest_only = min(interest_only, term - 1)
    rows = loans.schedule(principal, term, [(1, bps)], interest_only)
    assert len(rows) == term and rows[-1][4] == 0
    assert sum(r[3] for r in rows) == principal
    assert all(pay == interest + down for _, pay, interest, down, _ in rows)


def test_schedule_errors():
    for bad in ((0, 12, [(1, 5)], 0), (1, 0, [(1, 5)], 0), (1, 12, [], 0), (1, 12, [(2, 5)], 0), (1, 12, [(1, 5), (1, 6)], 0), (1, 12, [(1, -5)], 0), (1, 12, [(1, 5)], 12)):
        with pytest.raises(ValueError):
            loans.schedule(*bad)


def test_metrics_by_hand(spark):
    nodes = ("is.net_income", "is.other.interest_expense", "is.income_tax", "is.opex.depreciation", "is.opex.amortization", "is.revenue.total", "is.cogs.total")
    values = {"is.net_income": 15_000_000, "is.other.interest_expense": 2_000_000, "is.opex.depreciation": 3_000_000}
    facts = [(f"f{i}", 1, "FY2024", n, "vendor", v, "2024-01-01", 0) for i, (n, v) in enumerate(values.items())]
    facts.append(("late", 1, "FY2024", "is.net_income", "llm", 1, "2025-01-01", 0))  # same authority, later
    df = spark.createDataFrame(facts, "id string, entity_id long, period_label string, node string, method string, value_cents long, created_at string, rank int")
    backs = spark.createDataFrame([(1, "FY2024", "officer_comp", "accepted", 8_500_000), (1, "FY2024", "interest", "accepted", 9), (1, "FY2024", "one_time", "suggested", 9)], "entity_id long, period_label string, category string, state string, amount_cents long")
    tall = ledger.metrics(ledger.ledger(ledger.best_facts(df), nodes), backs, replacement_salary_cents=6_000_000, nodes=nodes)
    got = {r["metric"]: r["cents"] for r in tall.collect()}
    assert got == {"net_income": 15_000_000, "ebitda": 20_000_000, "sde": 28_500_000, "cfads": 22_500_000}


def test_amounts_and_labels(spark):
    cases = {"$1,234.56": 123456, "(1,234)": -123400, "1.234,50": 123450, "12-": -1200, "—": None, "1.234": None, "": None, "-(5)": None, "abc": None, "1 234": 123400}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.normalize_amount(F.col("t")).alias("a")).collect()
    assert {r["t"]: r["a"]["cents"] for r in rows} == cases
    reasons = {r["t"]: (r["a"]["null_reason"], r["a"]["rejection"]) for r in rows}
    assert reasons["—"] == ("dash", None) and reasons["1.234"] == (None, "ambiguous_separator") and reasons["-(5)"] == (None, "conflicting_signs") and reasons[""] == ("empty", None)
    assert spark.range(1).select(text.normalize_label(F.lit("4010 Total for Rent & Lease"))).first()[0] == "total rent lease"


def test_confidence_decisions(spark):
    rows = [(5, 5, 0.9, 0.8, False), (5, 5, 0.9, 0.7, False), (5, 6, 1.0, 1.0, False), (None, 6, 1.0, 1.0, False), (None, None, 0.1, 1.0, False), (None, None, 0.8, 0.9, False), (5, 5, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "path1_cents long, path2_cents long, path1_confidence double, path2_confidence double, gate_blocked boolean")
    assert [r["decision"] for r in scoring.score_fields(df).collect()] == ["auto_accept", "review", "review", "review", "reject", "auto_accept", "review"]


def test_swings_need_adjacent_years(spark):
    rows = [("a", 1, f"FY{y}", "n", "vendor", "accepted", 1, v, y) for y, v in ((2000, 100), (2001, 500), (2003, 1), (2004, 2))]
    df = spark.createDataFrame(rows, "id string, entity_id long, period_label string, node string, method string, status string, document_id long, value_cents long, created_at int")
    assert [(r["period_label"], r["delta_cents"], r["blocking"]) for r in gates.swings(df).collect()] == [("FY2001", 400, False)]


def test_names_by_hand():
    for a, b, want in (("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.8133), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)):
        assert round(workflow.jaro_winkler(a, b), 4) == want


def test_write_plan_by_hand(spark):
    paths = "document_id long, field string, cents long, readable boolean"
    fields = spark.createDataFrame([(1, f) for f in "abcdefg"], "document_id long, field string")
    one = spark.createDataFrame([(1, f, 5, True) for f in "abcdf"] + [(1, "g", 5, False)], paths)
    two = spark.createDataFrame([(1, f, 5, True) for f in "abcfg"] + [(1, "d", 6, True)], paths)
    live = spark.createDataFrame([(1, "a", "fa", 5, False), (1, "b", "fb", 4, False), (1, "f", "ff", 4, True)], "document_id long, field string, fact_id string, value_cents long, human boolean")
    got = {r["field"]: (r["action"], r["new_cents"], r["superseded_id"]) for r in workflow.plan_writes(workflow.reconcile(fields, one, two), live).collect()}
    none = (None, None)
    assert got == {"a": ("unchanged", *none), "b": ("supersede", 5, "fb"), "c": ("insert", 5, None), "d": ("review", *none), "e": ("nothing", *none), "f": ("human_decided", *none), "g": ("review", *none)}


def test_spans_and_policy_by_hand(spark):
    pages = spark.createDataFrame([(1, p, f) for p, f in enumerate([None, "k1", None, "k1", "w2", None, "k1"], 1)], "bundle_id long, page long, family string")
    assert [tuple(r)[2:] for r in workflow.page_spans(pages).orderBy("page_start").collect()] == [(1, 1, None), (2, 4, "k1"), (5, 6, "w2"), (7, 7, "k1")]
    deals = spark.createDataFrame([(1, 10, {"dscr": 130}), (2, 90, {"dscr": 120}), (3, 10, {})], "deal_id long, amount long, metrics map<string, long>")
    got = workflow.evaluate_policy(deals, [("cover", "dscr", "gte", 125, None), ("small", "dscr", "lte", 200, 50)])
    assert {(r["deal_id"], r["rule"]): (r["status"], r["margin"]) for r in got.collect()} == {(1, "cover"): ("pass", 5), (1, "small"): ("pass", 70), (2, "cover"): ("fail", -5), (3, "cover"): ("not_evaluable", None), (3, "small"): ("not_evaluable", None)}
    assert {r["deal_id"]: r["overall"] for r in workflow.policy_outcome(got).collect()} == {1: "pass", 2: "fail", 3: "incomplete"}


def test_regressions_by_hand(spark):
    schema = "level string, name string, precision_points long, recall_points long"
    old = spark.createDataFrame([("all", "", 9900, 9900), ("form", "a", 9900, 9900), ("form", "b", 9900, None)], schema)
    new = spark.createDataFrame([("all", "", 9880, 9879), ("form", "b", 9950, None)], schema)
    assert {(r["level"], r["name"]): (r["precision_fell"], r["recall_fell"]) for r in workflow.regressions(old, new).collect()} == {("all", ""): (False, True), ("form", "a"): (True, True)}


def test_spread_shows_suggested_facts_and_every_period(spark):
    rows = [("a", "FY2030", "accepted", 0, 1), ("b", "FY2030", "suggested", 4, 2), ("c", "FY1980", "suggested", 0, 3), ("d", "FY1980", "suggested", 1, 4), ("e", "FY1980", "rejected", 4, 5), ("f", "TTM 2024-06", "overridden", 4, 6)]
    df = spark.createDataFrame([(i, 1, p, "is.net_income", "m", s, v, "2024", r) for i, p, s, r, v in rows], "id string, entity_id long, period_label string, node string, method string, status string, value_cents long, created_at string, rank int")
    assert {(r["period_label"], r["id"], r["status"], r["value_cents"]) for r in ledger.spread(df).collect()} == {("FY2030", "a", "accepted", 1), ("FY1980", "d", "suggested", 4)}


def test_similar_names_meet_every_supplier(spark):
    from fintally.plans import reports

    customers = spark.createDataFrame([(1, "Acme Bakery"), (12, "acme bakery"), (3, "Zeta Tools"), (4, None)], "c_custkey long, c_name string")
    suppliers = spark.createDataFrame([(7, "Acme Bakery"), (9, "ACME BAKERY"), (1, "Other"), (3, "Beta Tools"), (5, None)], "s_suppkey long, s_name string")
    assert sorted(map(tuple, reports.most_similar(customers, suppliers).collect())) == [(1, 7, 10_000), (3, 3, 9_000), (12, 7, 10_000)]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    if name not in catalog.oracle_sql():
        assert got.num_rows > 0
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.register("got", got)
    con.execute(f"create table want as {catalog.oracle_sql()[name]}")
    names = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    assert con.execute(f"select count(*) from want").fetchall() == [(got.num_rows,)]
    assert con.execute(f"select count(*) from (select {names} from want except all select {names} from got)").fetchall() == [(0,)]


# Printed amounts with their cents, or why there are none.
AMOUNTS = (
    ("(500)", -50000), ("(1,234.56)", -123456), ("($1,020.64)", -102064), ("−500", -50000), ("–500", -50000), ("500-", -50000), ("1,234.56-", -123456), ("( 500 )", -50000), ("-0", 0), ("(0.00)", 0),
    ("-(500)", "conflicting_signs"), ("(500)-", "conflicting_signs"), ("-500-", "conflicting_signs"), ("1.020,64", 102064), ("1.234.567,89", 123456789), ("10 000", 1000000), ("10 000", 1000000), ("1 234 567", 123456700),
    ("1'000", 100000), ("1'234'567", 123456700), ("10,50", 1050), ("10,5", 1050), ("€1.020,64", 102064), ("1,020", 102000), ("999,000", 99900000), ("1.020", "ambiguous_separator"), ("999.000", "ambiguous_separator"),
    ("1234.567", "too_many_decimals"), ("1.2345", "too_many_decimals"), ("1.234.567", 123456700), ("1.23.456", "malformed_grouping"), ("12.3456.78", "malformed_grouping"), ("", "empty"), ("   ", "empty"), ("-", "dash"), ("—", "dash"),
    ("---", "dash"), ("N/A", "na"), ("NA", "na"), ("none", "na"), ("0", 0), ("(0)", 0), ("1234.", 123400), ("123,", 12300), (".5", 50), ("$(1,234)", "not_a_number"), ("abc", "not_a_number"), ("9" * 25, "out_of_range"), (None, "empty"),
)


def test_amounts(spark):
    rows = spark.createDataFrame([(t, str(w)) for t, w in AMOUNTS], "t string, want string")
    got = rows.select("t", "want", text.normalize_amount(F.col("t")).alias("a")).collect()
    assert [(r["t"], str(next(x for x in (r["a"]["cents"], r["a"]["null_reason"], r["a"]["rejection"]) if x is not None))) for r in got] == [(r["t"], r["want"]) for r in got]


def test_amounts_of_cents_boxes_and_scales(spark):
    rows = spark.createDataFrame([("1,234", "56", 1), ("1,234", "", 1), ("1,234", "—", 1), ("1,234", "5", 1), ("1,234.56", "78", 1), ("1,234", "5x", 1), ("1,234", "123", 1), ("2.5", None, 1_000_000), ("(500)", None, 1000)], "t string, b string, s int")
    got = [tuple(r[0]) for r in rows.select(text.normalize_amount(F.col("t"), F.col("s"), F.col("b"))).collect()]
    assert [x[0] for x in got] == [123456, 123400, 123400, 123405, None, None, None, 250000000, -50000000]
    assert {x[2] for x in got[4:7]} == {"invalid_cents_box"}


def test_row_types(spark):
    lines = [("Revenue", {}), ("Rooms", {1: "100", 2: "—"}), ("Food", {1: "50"}), ("All of it", {1: "150"}), ("Rent", {1: "30"}), ("Wages", {1: "20"}), ("", {}), ("Total expenses", {1: "50"}), ("Everything", {1: "200"}), ("Net income", {1: "7"}), ("Depreciation", {1: "9"})]
    rows = spark.createDataFrame([(7, i, label, cells) for i, (label, cells) in enumerate(lines)], "grid_id long, row int, label string, cells map<int, string>")
    types = lambda **k: [(r["type"], r["verified"]) for r in statements.typed_rows(rows, **k).orderBy("row").collect()]
    want = ["header", "item", "item", "subtotal", "item", "item", "section_break", "subtotal", "total", "total"]
    assert [t for t, _ in types()] == [*want, "item"] and [t for t, _ in types(income=True)] == [*want, "supplemental"]
    assert [i for i, (_, sure) in enumerate(types()) if sure] == [3, 7, 8]


def test_names():
    score = lambda a, b: matching.token_score(a.split(), b.split())
    assert score("smith john", "john smith") == 1.0 and 0.72 <= score("john smith", "j smith") < 0.92
    assert score("john smith", "jon smith") >= 0.92 and score("john smith", "jane smith") < 0.72 and score("", "a") == 0.0
    forms = matching.business_forms
    assert forms("acme corp dba sunrise motel") == [["acme"], ["sunrise", "motel"]] and forms("acme corporation llc") == [["acme"]]


def test_fuzzy_candidates_equal_brute_force(spark):
    base = "interest expense on long term notes payable to the bank"
    known = [base[:n] for n in range(15, len(base), 3)]
    labels = [k for n in known for k in (n, n[:4] + "x" + n[5:], n[1:], "zz" + n, n[:7] + n[9:] + "qq", n[:3] + "ab" + n[3:])]
    got = {(r["label"], r["known"]) for r in matching.fuzzy_candidates(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in known], "known string")).collect()}
    every = spark.createDataFrame([(a, b) for a in set(labels) for b in known], "label string, known string").where("levenshtein(label, known) * 20 <= greatest(length(label), length(known))")
    assert got == {(r["label"], r["known"]) for r in every.collect()} and len(got) > len(known)


def test_entities_and_identities(spark):
    named = spark.createDataFrame([(1, 1, "business", "Acme Corp"), (2, 1, "person", "J Smith"), (3, 1, "trust", "Sunrise Motel"), (4, 2, "person", "nobody")], "document_id long, deal_id long, kind string, identity string")
    entities = spark.createDataFrame([(1, 10, "business", "ACME CORPORATION DBA Sunrise Motel"), (1, 11, "person", "John Smith"), (1, 12, "person", "John Smith")], "deal_id long, entity_id long, kind string, name string")
    assert sorted(tuple(r) for r in matching.match_entities(named, entities).collect()) == [(1, 10, 10_000), (2, 11, 8_900), (3, 10, 10_000)]
    seen = spark.createDataFrame([(1, 1, 2, "Acme Corp"), (1, 1, 1, "  "), (1, 2, 1, "Other"), (2, 1, 1, "ab")], "document_id long, field_order int, path int, value_text string")
    assert [tuple(r) for r in matching.pick_identity(seen).collect()] == [(1, "Other")]  # the first path goes first


def test_loan_summaries_equal_schedules(spark):
    rows = spark.createDataFrame([(1, 5_000_000, 60, [(1, 700), (13, 850)], 6), (2, 100_000, 12, [(1, 0)], 0)], "loan_id long, principal_cents long, term_months int, steps array<struct<month:int,bps:int>>, interest_only int")
    both = [sorted(tuple(r) for r in f.collect()) for f in (loans.summaries(rows), loans.debt_service(loans.amortize(rows), rows))]
    assert both[0] == both[1] and both[0][1] == (2, 99_996, 0)


def test_entity_of_the_identitys_kind(spark):
    named = spark.createDataFrame([(1, 1, "person", "John Smith"), (2, 1, "business", "Smith Bakery LLC"), (3, 1, "business", "zq"), (4, 2, "person", "Acme")], "document_id long, deal_id long, kind string, identity string")
    entities = spark.createDataFrame([(1, 10, "target", "John Smith"), (1, 11, "spouse", "Jon Smith"), (1, 12, "oc", "Smith Bakery Inc"), (2, 13, "target", "Acme")], "deal_id long, entity_id long, kind string, name string")
    got = {r["document_id"]: (r["entity_id"], r["points"]) for r in matching.match_entities(named, entities).collect()}
    assert got[1][0] == 11 and got[2] == (12, 10_000) and got[3] == (None, 0) and got[4] == (13, 10_000)


def test_page_signals_by_hand(spark):
    pages = {
        "Form 1120-S U.S. Income Tax Return OMB No. 1545-0123 For calendar year 2022": ("1120S", 2022, True, None, 9_800),
        "Form 1120-F foreign OMB No. 1545-0123 Schedule L Balance Sheets": (None, None, False, None, 0),
        "Form 1120Department of the Treasury": ("1120", None, False, None, 9_000),
        "Form 1040-SR page 2": ("1040", None, False, 2, 9_000),
        "Form 1040-NR": (None, None, False, None, 0),
        "(attach Form 4562) nothing": (None, None, False, None, 0),
        "attach\u00a0Form\u00a04562": (None, None, False, None, 0),
        "Schedule K-1 (Form 1065), box 1": ("1065", None, False, None, 9_000),  # a box of a K-1 is no K-1, but its form is printed
        "copy B OMB No. 1545-0008": ("W2", None, True, None, 9_500),
        "Acme Inc Statement of Revenue and Expenses": ("PNL", None, False, None, 7_500),
        "x" * 500 + " Form 1065": (None, None, False, None, 0),
        "": (None, None, False, None, 0),
    }
    rows = spark.createDataFrame([*pages.items(), (None, None)], "text string, want struct<a:string,b:int,c:boolean,d:int,e:int>")
    got = page_signals.page_signals(rows, "text", "want").drop("matched").collect()
    assert len(got) == len(pages) + 1
    for r in got:
        assert r["want"] is None and r["family"] is None or (r["family"], r["tax_year"], r["starts"], r["continuation_page"], r["confidence_bps"]) == tuple(r["want"]), r


def test_token_evidence_and_claims(spark):
    rows = [("x" * 450 + " Form 4562", "4562", "unanchored"), ("attach Form 4562 then x Form 4562", "4562", "anchored"), ("see Form 4562, attach Form 4562", "4562", "cited-only"), ("none", "4562", "absent"), (None, "4562", "absent"), ("Form 4562", "PNL", "absent"), ("Form 4562", None, "absent")]
    df = spark.createDataFrame(rows, "text string, family string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", page_signals.token_evidence(F.col("text"), F.col("family")).alias("got")).collect())
    prints = {"Schedule  K1 (Form 1120-S)": "K1_1120S", "schedule c (form 1040 or 1040-sr)": "1040_SCH_C", "Form W-2": "W2", "8949": None, None: None}
    df = spark.createDataFrame(list(prints.items()), "printed string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", page_signals.printed_family(F.col("printed")).alias("got")).collect())


def test_reverts_restore_the_original(spark):
    facts = spark.createDataFrame([("a", "overridden", "llm", "b"), ("b", "accepted", "override", None), ("c", "accepted", "override", None), ("d", "overridden", "llm", "e"), ("e", "accepted", "human", None)], "id string, status string, method string, superseded_by string")
    asked = spark.createDataFrame([("b",), ("b",), ("c",), ("e",), (None,)], "fact_id string")
    got = sorted(tuple(r) for r in review.reverted(facts, asked).collect())
    assert got == [("a", "accepted", "llm", None), ("b", "rejected", "override", None), ("c", "accepted", "override", None), ("d", "overridden", "llm", "e"), ("e", "accepted", "human", None)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**17), st.integers(1, 80), st.lists(st.tuples(st.integers(2, 90), st.integers(0, 130_000)), max_size=3, unique_by=lambda s: s[0]), st.integers(0, 2500), st.integers(0, 30)), max_size=6))
def test_summaries_equal_each_schedule(drawn):
    many = [(p, t, [(1, first), *sorted(rest)], min(free, t - 1)) for p, t, rest, first, free in drawn]
    each = [loans.schedule(*loan) for loan in many]
    assert loans.summarized(many) == [(12 * months[loan[3]][1], sum(m[2] for m in months)) for loan, months in zip(many, each, strict=True)]


@given(st.lists(st.tuples(st.integers(0, 10**18 - 1), st.integers(0, 10**18 - 1)), min_size=1))
def test_interests_are_exact(pairs):
    pairs = [*pairs, (1, loans.UNIT // 2), (3, loans.UNIT // 2)]
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert loans.interests(a, b).tolist() == [loans.round_half_even(x * y, loans.UNIT) for x, y in pairs]
