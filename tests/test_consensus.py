"""Readings, relations and accuracy by hand."""

import pytest

from fintally.operators import consensus
from fintally.operators.consensus import Relation

READING = "document_id long, field string, cents long, readable boolean, confidence double"
FORM = ["a", "b", "c", "d"]
SUM = Relation("sum", "sum", "c", ("a", "b"), 1)
DIFFERENCE = Relation("difference", "difference", "d", ("a", "b"))


def read(spark, one, two, relations=(), documents=((1,),)):
    p1, p2 = (spark.createDataFrame([(1, f, c, ok, w) for f, (c, ok, w) in p.items()], READING) for p in (one, two))
    return consensus.readings(spark.createDataFrame(list(documents), "document_id long"), p1, p2, FORM, list(relations))


def good(**values):
    return {f: (v, True, 0.9) for f, v in values.items()}


def test_outcomes(spark):
    one = {"a": (5, True, 0.9), "b": (None, True, 0.7), "c": (5, True, 0.9), "x": (1, True, 1.0)}
    two = {"a": (5, True, 0.8), "b": (None, True, 0.9), "c": (6, True, 0.9)}
    got = {r["field"]: (r["outcome"], r["value_cents"], r["confidence"]) for r in read(spark, one, two).collect()}
    # a blank of both is agreed; a field that no path has is not
    assert got == {"a": ("consensus", 5, 0.8), "b": ("consensus_absent", None, 0.7), "c": ("disagreement", None, 0.0), "d": ("single_source", None, 0.0)}
    one, two = {"a": (5, True, 0.9), "b": (None, False, 0.9), "c": (None, True, 0.9), "d": (1, True, 0.9)}, {"b": (5, True, 0.9), "c": (None, True, 0.9), "d": (None, True, 0.9)}
    got = {r["field"]: r["outcome"] for r in read(spark, one, two).collect()}
    assert got == {"a": "single_source", "b": "unreadable", "c": "consensus_absent", "d": "single_source"}


@pytest.mark.parametrize(
    ("values", "states", "implicated"),
    [
        (good(a=7, b=3, c=10, d=4), {"sum": ("passed", 0), "difference": ("passed", 0)}, set()),
        (good(a=7, b=3, c=11, d=4), {"sum": ("passed", 1), "difference": ("passed", 0)}, set()),
        (good(a=7, b=3, c=12, d=4), {"sum": ("violated", 2), "difference": ("passed", 0)}, {"a", "b", "c"}),
        (good(a=7, b=3, c=10, d=-4), {"sum": ("passed", 0), "difference": ("violated", 8)}, {"a", "b", "d"}),
        (good(a=7, b=None, c=7, d=7), {"sum": ("passed", 0), "difference": ("passed", 0)}, set()),  # an agreed blank is a zero
        (good(a=7, c=7, d=9), {"sum": ("skipped", 0), "difference": ("skipped", 0)}, set()),  # no reading is none
    ],
)
def test_relations(spark, values, states, implicated):
    got = read(spark, values, values, (SUM, DIFFERENCE)).collect()
    assert {c["relation"]: (c["status"], c["delta_cents"]) for c in got[0]["checks"]} == states
    assert {r["field"] for r in got if r["implicated"]} == implicated


def test_relations_of_other_documents_and_of_none(spark):
    df = read(spark, good(a=1, b=1, c=9), good(a=1, b=1, c=9), (SUM,), ((1,), (2,)))
    assert {(r["document_id"], r["status"], r["delta_cents"]) for r in consensus.relation_checks(df, "a").collect()} == {(1, "violated", 7), (2, "skipped", 0)}
    assert consensus.relation_checks(read(spark, {}, {}), "a").count() == 0
    assert read(spark, good(a=1), {}, (SUM,), ()).count() == 0
    for bad in (("sum", "a", ("a", "b")), ("sum", "a", ()), ("product", "a", ("b",))):
        with pytest.raises(ValueError, match="relation"):
            Relation("x", *bad)


def judged(spark, one, two, truth, relations=()):
    return consensus.with_truth(read(spark, one, two, relations), spark.createDataFrame([(1, f, v) for f, v in truth.items()], "document_id long, field string, truth_cents long"))


def test_sweep_against_the_truth(spark):
    one = {"a": (5, True, 0.5), "b": (6, True, 0.95), "c": (None, True, 0.9)}
    df = judged(spark, one, one, {"a": 5, "b": 7, "c": None, "d": 1})
    got = {r["threshold_points"]: (r["accepted"], r["correct"], r["precision_points"], r["coverage_points"]) for r in consensus.sweep_accuracy(df).collect()}
    assert got[50] == (2, 1, 5000, 3333) and got[55] == got[95] == (1, 0, 0, 0) and len(got) == 14
    assert [tuple(r) for r in consensus.wrong_at(df).collect()] == [(1, "b", 95)]
    # what a violated relation implicates is never accepted; nothing accepted has no precision
    df = judged(spark, good(a=1, b=1, c=9), good(a=1, b=1, c=9), {"a": 1, "z": 4}, (SUM,))
    assert {tuple(r)[1:] for r in consensus.sweep_accuracy(df).collect()} == {(0, 0, None, 0)}


def test_findings(spark):
    columns = "section string, documents long, field_precision long, field_recall long, auto_accept_precision long, auto_accept_coverage long, silent_wrong_count long"
    run = lambda *rows: spark.createDataFrame(list(rows), columns)
    found = lambda old, new: sorted(tuple(r) for r in consensus.findings(old, new).collect())
    base = ("real", 9, 9900, 9900, 9900, None, 0)
    assert found(run(base), run(base)) == []
    assert found(run(base), run(("real", 9, 9880, 9879, None, 5000, 0))) == [("real", "auto_accept_precision", 9900, None), ("real", "field_recall", 9900, 9879)]
    assert found(run(base), run()) == [("real", "documents", 9, None)]
    # wrong values of the real section count against the run before and against none
    assert found(run(base), run((*base[:-1], 2))) == [("real", "silent_wrong_count", 0, 2)] * 2
    assert found(run((*base[:-1], 3)), run((*base[:-1], 3))) == [("real", "silent_wrong_count", 0, 3)]
    other = ("other", *base[1:-1])
    assert found(run((*other, 1)), run((*other, 1))) == [] and found(run((*other, 1)), run((*other, 2))) == [("other", "silent_wrong_count", 1, 2)]
    assert found(run(), run((*base[:-1], 1))) == [("real", "silent_wrong_count", 0, 1)] and found(run(), run((*other, 1))) == []
