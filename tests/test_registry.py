"""Span edits, registry entries by year, dense spreads and tolerant rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fintally.operators import readmodels, registry, span_edits

SPANS = "document_id long, id long, page_start int, page_end int, confirmed boolean"
EDITS = "document_id long, edit_id long, kind string, span_id long, other_id long, page_start int, page_end int"


def by_hand(spans, edits):
    """One document's spans, outcomes and heirs, an edit at a time."""
    now, log, heirs = {i: [a, b, c] for i, a, b, c in spans}, [], {}
    for _, kind, i, other, a, b in sorted(edits, key=lambda e: e[0]):
        why = "done"
        if i not in now:
            why = "unknown span"
        elif kind == "split":
            if a is None or not now[i][0] < a <= now[i][1]:
                why = "split page out of range"
            elif other is None or other in now:
                why = "id taken"
            else:
                now[other] = [a, now[i][1], False]
                now[i][1] = a - 1
        elif kind == "merge":
            if i == other:
                why = "same span"
            elif other not in now:
                why = "unknown span"
            else:
                low, high = sorted((i, other), key=lambda x: now[x][0])
                if now[high][0] != now[low][1] + 1:
                    why = "not adjacent"
                else:
                    now[low][1] = now.pop(high)[1]
                    heirs = {k: low if v == high else v for k, v in heirs.items()} | {high: low}
        elif kind == "edit":
            if a is None or b is None or a < 1 or b < a:
                why = "invalid range"
            elif any(k != i and s[0] <= b and a <= s[1] for k, s in now.items()):
                why = "overlap"
            else:
                now[i][:2] = [a, b]
        else:
            why = "unknown kind"
        log.append(why)
    return {(k, *v) for k, v in now.items()}, log, heirs


IDS, PAGES = st.one_of(st.none(), st.integers(1, 9)), st.one_of(st.none(), st.integers(0, 26))
EDIT = st.tuples(st.sampled_from(["split", "merge", "merge", "edit", "move", None]), IDS, IDS, PAGES, PAGES)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(EDIT, max_size=12), min_size=1, max_size=30))
def test_edits_equal_one_at_a_time(spark, documents):
    start = [(k, k * 5 - 4, k * 5 - (k % 2), True) for k in range(1, 5)]
    spans = spark.createDataFrame([(d, *s) for d in range(len(documents)) for s in start], SPANS)
    edits = spark.createDataFrame([(d, n, *e) for d, es in enumerate(documents) for n, e in enumerate(es)], EDITS)
    done = span_edits.edited(spans, edits)
    facts = spark.createDataFrame([(d, s * 100 + p, s, p) for d in range(len(documents)) for s in range(1, 5) for p in (-1, 1, 3, 5)], "document_id long, fact_id long, span_id long, source_page int")
    moved = {}
    for r in span_edits.rebased(facts, spans, done).collect():
        moved.setdefault(r["document_id"], {})[r["fact_id"]] = (r["span_id"], r["source_page"], r["pdf_page"])
    for r in done.collect():
        want, log, heirs = by_hand(start, [(n, *e) for n, e in enumerate(documents[r["document_id"]])])
        got = {tuple(s) for s in r["spans"]}
        assert got == want and [x["outcome"] for x in r["log"]] == log
        pages = [p for _, a, b, _ in got for p in range(a, b + 1)]
        assert len(pages) == len(set(pages))
        assert len(moved[r["document_id"]]) == 16
        for fact, (span, source, page) in moved[r["document_id"]].items():
            first = {i: a for i, a, _, _ in start}[(fact + 1) // 100]
            own = {i: a for i, a, _, _ in got}
            assert page == own[span] + source - 1 == first + (-1 if fact % 100 == 99 else fact % 100) - 1
            holder = [i for i, a, b, _ in got if a <= page <= b]
            assert span == (holder[0] if holder else heirs.get((fact + 1) // 100, (fact + 1) // 100))


def test_registry_by_year(spark):
    base = spark.createDataFrame([("A", 2024, "x", "1", "n1"), ("A", 2024, "y", "2", None), ("B", 2023, "x", "9", "n2")], "family string, base_year int, field_id string, line string, node string")
    over = spark.createDataFrame([("A", 2022, "x", "drop", None, None), ("A", 2023, "y", "renumber", "2b", None), ("A", 2023, "z", "add", "3", "n3")], "family string, year int, field_id string, action string, line string, node string")
    got = registry.entries(base, over)
    rows = {("A", 2024, "x", "1", "n1"), ("A", 2024, "y", "2", None), ("A", 2022, "y", "2", None), ("A", 2023, "x", "1", "n1"), ("A", 2023, "y", "2b", None), ("A", 2023, "z", "3", "n3"), ("B", 2023, "x", "9", "n2")}
    assert {tuple(r) for r in got.collect()} == rows and got.count() == len(rows)
    facts = spark.createDataFrame([("A", 2023, "y"), ("A", 2022, "x"), ("A", 2021, "x"), (None, 2023, "x"), ("B", 2023, None)], "family string, year int, field_id string")
    found = [tuple(r) for r in registry.placed(facts, got).collect()]
    assert sorted(found, key=str) == sorted([("A", 2023, "y", "2b", None, "yes"), ("A", 2022, "x", None, None, "field"), ("A", 2021, "x", None, None, "year"), (None, 2023, "x", None, None, "year"), ("B", 2023, None, None, None, "field")], key=str)
    specs = spark.createDataFrame([("A", y, "total", "sum", "t", ["a", "b"] if y < 2023 else ["a", "b", "c"], 100) for y in (2024, 2021, 2022, 2023)], "family string, year int, spec string, kind string, result string, operands array<string>, tolerance_cents long")
    assert {(len(r["operands"]), tuple(r["years"])) for r in registry.scoped_specs(specs).collect()} == {(2, (2021, 2022)), (3, (2023, 2024))}


def test_dense_spread(spark):
    cells = spark.createDataFrame([(1, "a", "FY1", "i", "m", "accepted", 5), (1, "b", "FY2", "j", "m", "suggested", None), (2, "z", "FY1", "k", "m", "accepted", 1)], "entity_id long, node string, period_label string, id string, method string, status string, value_cents long")
    got = {(r["entity_id"], r["period_label"], r["node"]): (r["value_cents"], r["status"]) for r in registry.dense_spread(cells, ("a", "b")).collect()}
    assert got == {(1, "FY1", "a"): (5, "accepted"), (1, "FY1", "b"): (None, None), (1, "FY2", "a"): (None, None), (1, "FY2", "b"): (None, "suggested"), (2, "FY1", "a"): (None, None), (2, "FY1", "b"): (None, None)}
    assert registry.dense_spread(cells.limit(0), ("a",)).count() == 0


def test_tolerant_rows_add_up(spark):
    rows = ['{"k": 1, "s": "x"}', '{"k": -1}', "{}", "{oops", "", None, "[]", "null", '{"k": "a"}', '{"k": 2, "more": 1}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, j string")
    out = registry.tolerant(df, "j", "k int, s string", {"no k": F.col("k").isNull(), "negative": F.col("k") < 0})
    assert out.columns == ["i", "j", "k", "s", "reason"]
    got = {r["i"]: (r["k"], r["s"], r["reason"]) for r in out.collect()}
    bad = lambda why: (None, None, why)
    assert got == {0: (1, "x", None), 1: bad("negative"), 2: bad("no k"), 3: bad("malformed"), 4: bad("malformed"), 5: bad("missing"), 6: bad("malformed"), 7: bad("malformed"), 8: bad("malformed"), 9: (2, None, None)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"key": "a", "label": "A"}, {"key": " b "}, {"label": "C"}]', [("a", "A", []), ("b", "b", []), (None, "C", [])]),
        ('[1, null, "x", [], {}, {"key": " "}, {"key": 7, "label": true}]', []),
        ('[{"key": "a", "label": 3, "formFamilies": ["W2", "", 1, null, "1040"]}, {"key": "b", "formFamilies": "W2"}]', [("a", "a", ["W2", "1040"]), ("b", "b", [])]),
        ('{"key": "a"}', []),
        ("{bad", []),
        (None, []),
    ],
)
def test_requested_items(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(registry.requested_items(F.col("t")).alias("i")).first()["i"]
    assert [tuple(r) for r in got] == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("ab"), st.integers(2020, 2021), st.integers(1, 12), st.integers(0, 6)), max_size=60))
def test_sweeps_equal_pairs(spark, drawn):
    rows = [(i, d, f, y, a, a + n) for i, (d, f, y, a, n) in enumerate(drawn)]
    df = spark.createDataFrame(rows, "id long, document_id long, family string, tax_year int, page_start int, page_end int")
    inside = lambda s, w: w[1:4] == s[1:4] and w[4] <= s[4] and w[5] >= s[5] and (w[4:] != s[4:] or w[0] < s[0])
    assert {r["id"] for r in readmodels.redundant_spans(df).collect()} == {s[0] for s in rows if not any(inside(s, w) for w in rows)}
    assert {r["id"] for r in readmodels.overlapping_spans(df).collect()} == {s[0] for s in rows if any(o[0] != s[0] and o[1] == s[1] and o[4] <= s[5] and s[4] <= o[5] for o in rows)}
