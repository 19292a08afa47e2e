"""Two readings of a form's fields held against each other and against its relations, and their accuracy against the truth."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fintally.functions.money import decimal_ratio
from fintally.operators.scoring import REJECT, decision

#: Thresholds of the sweep, in hundredths.
POINTS = tuple(range(30, 100, 5))
RATES = ("field_precision", "field_recall", "auto_accept_precision", "auto_accept_coverage")


@dataclass(frozen=True)
class Relation:
    """result = sum or difference (the first operand less the others) of the operands, within tolerance cents; its fields are distinct."""

    id: str
    kind: str
    result: str
    operands: tuple[str, ...]
    tolerance: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("sum", "difference") or not self.operands or len(set(self.fields)) != len(self.fields):
            raise ValueError(f"relation {self.id}: sum or difference of one operand or more, and no field twice")

    @property
    def fields(self) -> tuple[str, ...]:
        return (self.result, *self.operands)

    def signs(self) -> dict[str, int]:
        """What each field adds to computed less stated."""
        return {f: -1 if i == 0 or (self.kind == "difference" and i > 1) else 1 for i, f in enumerate(self.fields)}


def readings(documents: DataFrame, path1: DataFrame, path2: DataFrame, names: list[str], relations: list[Relation]) -> DataFrame:
    """A row for each document and field of its form, with outcome, value and state of each relation.

    documents: document_id; paths: document_id, field, cents (null: blank), readable, confidence. `unreadable` where a
    reading was rejected; `consensus` where both have one value, which only then is value_cents; `consensus_absent` where both
    report a blank; `single_source` where a path has no row or one of them a blank; else `disagreement`. Fields that the form
    does not have are ignored; of repeated rows of a path the greatest counts. A blank that both report is a zero in relations;
    a relation with any other field that is not agreed is `skipped`.

    Everything of a document meets once, by its id: the shuffle serves the grouping and the relations, whose windows hold
    the fields of one form.
    """
    read = lambda df, k: df.select("document_id", "field", F.lit(k).alias("path"), F.struct("cents", "readable", "confidence").alias("reading"))
    asked = documents.select("document_id").select("document_id", F.explode(F.array(*map(F.lit, names))).alias("field"), F.lit(0).alias("path"))
    every = read(path1, 1).unionByName(read(path2, 2)).where(F.col("field").isin(names)).unionByName(asked, allowMissingColumns=True)
    of = lambda k: F.max(F.when(F.col("path") == k, F.col("reading")))
    rows = every.repartition("document_id").groupBy("document_id", "field").agg(of(1).alias("one"), of(2).alias("two"), F.count_if(F.col("path") == 0).alias("asked")).where("asked > 0")
    a, b = F.col("one.cents"), F.col("two.cents")
    outcome = (
        F.when(~F.coalesce("one.readable", F.lit(True)) | ~F.coalesce("two.readable", F.lit(True)), "unreadable")
        .when(F.col("one").isNull() | F.col("two").isNull(), "single_source")
        .when(a.isNull() & b.isNull(), "consensus_absent")
        .when(a.isNull() | b.isNull(), "single_source")
        .when(a == b, "consensus")
        .otherwise("disagreement")
    )
    sure = F.coalesce(F.col("outcome").isin("consensus", "consensus_absent"), F.lit(False))
    rows = rows.withColumn("outcome", outcome).withColumn("agreed", F.when(sure, F.coalesce(a, F.lit(0))))
    form = Window.partitionBy("document_id")
    states = []
    for r in relations:
        sign = reduce(lambda c, s: c.when(F.col("field") == s[0], s[1]), r.signs().items(), F)
        known = F.count(F.when(F.col("field").isin(*r.fields), F.col("agreed"))).over(form) == len(r.fields)
        delta = F.when(known, F.abs(F.sum(sign * F.col("agreed")).over(form))).otherwise(0)
        status = F.when(~known, "skipped").when(delta <= r.tolerance, "passed").otherwise("violated")
        states.append(F.struct(F.lit(r.id).alias("relation"), status.alias("status"), delta.cast("long").alias("delta_cents"), F.array(*map(F.lit, r.fields)).alias("fields")))
    checks = F.array(*states) if states else F.array().cast("array<struct<relation: string, status: string, delta_cents: long, fields: array<string>>>")
    return rows.withColumn("checks", checks).select(
        "document_id", "field", "outcome",
        F.when(F.col("outcome") == "consensus", a).alias("value_cents"),
        F.when(sure, F.least("one.confidence", "two.confidence")).otherwise(0.0).alias("confidence"),
        F.exists("checks", lambda c: (c["status"] == "violated") & F.array_contains(c["fields"], F.col("field"))).alias("implicated"),
        a.alias("path1_cents"), b.alias("path2_cents"),
        F.coalesce("one.confidence", F.lit(0.0)).alias("path1_confidence"), F.coalesce("two.confidence", F.lit(0.0)).alias("path2_confidence"),
        "checks",
    )


def relation_checks(read: DataFrame, first: str) -> DataFrame:
    """document_id, relation, status and delta_cents; first: any field of the form."""
    return read.where(F.col("field") == first).select("document_id", F.inline("checks")).drop("fields")


def with_truth(read: DataFrame, truth: DataFrame) -> DataFrame:
    """readings with truth_cents (document_id, field, truth_cents: a row for each field that is on the document), in one join.

    A field that a violated relation implicates is blocked, and never accepted by itself. A truth that no path was asked
    for has a row without readings.
    """
    both = read.drop("checks").join(truth.select("document_id", "field", "truth_cents", F.lit(True).alias("labelled")), ["document_id", "field"], "full")
    confidence = F.coalesce(F.least("path1_confidence", "path2_confidence"), F.lit(0.0))
    return both.withColumn("gate_blocked", F.coalesce("implicated", F.lit(False))).withColumn("confidence", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


def _accepted(points: int) -> Column:
    """Accepted with a value: two equal blanks are not counted."""
    return (decision(F.lit(points / 100.0), REJECT) == "auto_accept") & F.col("path1_cents").isNotNull()


def _right() -> Column:
    return F.coalesce(F.col("truth_cents") == F.coalesce("path1_cents", "path2_cents"), F.lit(False))


def sweep_accuracy(judged: DataFrame) -> DataFrame:
    """Accepted and correct fields of each threshold, precision (null where none is accepted) and coverage of all labelled fields in ten-thousandths.

    One pass over the rows of with_truth, two counters for each threshold.
    """
    counts = judged.agg(
        F.count_if(F.col("truth_cents").isNotNull()).alias("labelled"),
        *(F.count_if(_accepted(p)).alias(f"a{p}") for p in POINTS),
        *(F.count_if(_accepted(p) & _right()).alias(f"c{p}") for p in POINTS),
    )
    rate = lambda n, d: F.when(d > 0, decimal_ratio(n, F.when(d > 0, d).otherwise(1), 4))
    rows = [
        F.struct(F.lit(p).alias("threshold_points"), F.col(f"a{p}").alias("accepted"), F.col(f"c{p}").alias("correct"), rate(F.col(f"c{p}"), F.col(f"a{p}")).alias("precision_points"), F.coalesce(rate(F.col(f"c{p}"), F.col("labelled")), F.lit(0)).alias("coverage_points"))
        for p in POINTS
    ]
    return counts.select(F.inline(F.array(*rows)))


def wrong_at(judged: DataFrame) -> DataFrame:
    """Every wrong field that some threshold accepts, with the highest such threshold: lower ones accept it too."""
    highest = F.greatest(*(F.when(_accepted(p), p) for p in POINTS))
    return judged.where(~_right()).select("document_id", "field", highest.alias("threshold_points")).where("threshold_points is not null")


def accuracy(judged: DataFrame, threshold: int) -> DataFrame:
    """A row for each section: documents, four rates in ten-thousandths (null without a denominator) and the count of silent wrong values.

    judged: with_truth and a section. A silent wrong value was accepted at the threshold (hundredths) and is not the truth.
    """
    read, right, sure = F.coalesce("path1_cents", "path2_cents").isNotNull(), _right(), _accepted(threshold)
    n = judged.groupBy("section").agg(
        F.countDistinct("document_id").alias("documents"), F.count_if(read).alias("read"), F.count_if(read & right).alias("right"),
        F.count("truth_cents").alias("labelled"), F.count_if(sure).alias("sure"), F.count_if(sure & right).alias("sure_right"),
    )
    pairs = (("right", "read"), ("right", "labelled"), ("sure_right", "sure"), ("sure_right", "labelled"))
    rates = [F.when(F.col(d) > 0, decimal_ratio(F.col(c), F.when(F.col(d) > 0, F.col(d)).otherwise(1), 4)).alias(m) for m, (c, d) in zip(RATES, pairs, strict=True)]
    return n.select("section", "documents", *rates, (F.col("sure") - F.col("sure_right")).alias("silent_wrong_count"))


def findings(baseline: DataFrame, current: DataFrame, tolerance: int = 20, absolute: str = "real") -> DataFrame:
    """section, metric, baseline and current of every regression between two tables of accuracy().

    A section that is gone; a rate that fell by more than the tolerance (ten-thousandths) or is null now; silent wrong values
    that rose. In the section `absolute` any silent wrong value is a finding against 0, whatever the baseline has.
    """
    old, new = (df.select("section", F.struct("documents", *RATES, "silent_wrong_count").alias(k)) for df, k in ((baseline, "b"), (current, "c")))
    both = old.join(new, "section", "full")
    found = lambda when, metric, b, c: F.when(when, F.struct(F.lit(metric).alias("metric"), b.cast("long").alias("baseline"), c.cast("long").alias("current")))
    gone, here = F.col("c").isNull(), F.col("b").isNotNull() & F.col("c").isNotNull()
    wrong = F.col("c.silent_wrong_count")
    rows = [found(gone, "documents", F.col("b.documents"), F.lit(None))]
    for m in RATES:
        b, c = F.col(f"b.{m}"), F.col(f"c.{m}")
        rows.append(found(here & b.isNotNull() & F.coalesce(c < b - tolerance, F.lit(True)), m, b, c))
    rows.append(found(here & (wrong > F.col("b.silent_wrong_count")), "silent_wrong_count", F.col("b.silent_wrong_count"), wrong))
    rows.append(found((F.col("section") == absolute) & (wrong > 0), "silent_wrong_count", F.lit(0), wrong))
    return both.select("section", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
