"""Policy packs: rules with decimal thresholds and conditions, each deal's margins, and whether a pack may certify at all.

A pack's rules are a short list of fixed values and become one literal; a deal's rules are evaluated in its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest number of decimals of a threshold or a metric.
SCALE = 9
_EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Rule:
    """metric `gte`, `lte` or `eq` a ratio (mantissa, scale), a share in basis points, months, or cents; the first one given that has the metric's kind counts."""

    id: str
    metric: str
    op: str
    ratio: tuple[int, int] | None = None
    bps: int | None = None
    months: int | None = None
    cents: int | None = None
    deal_types: tuple[str, ...] | None = None
    amount_lte: int | None = None
    amount_gt: int | None = None
    use_of_proceeds: tuple[str, ...] | None = None

    def column(self) -> Column:
        long = lambda v: F.lit(v).cast("long")
        texts = lambda v: F.lit(None).cast("array<string>") if v is None else F.array(*map(F.lit, v)).cast("array<string>")
        limit = lambda v, scale: F.struct(long(v).alias("mantissa"), F.lit(scale).cast("int").alias("scale"))
        none = F.lit(None).cast("struct<mantissa: long, scale: int>")
        ratios = [(self.ratio, lambda v: limit(*v)), (self.bps, lambda v: limit(v, 4)), (self.months, lambda v: limit(v, 0))]
        of_ratio = next((f(v) for v, f in ratios if v is not None), none)
        return F.struct(
            F.lit(self.id).alias("rule"), F.lit(self.metric).alias("metric"), F.lit(self.op).alias("op"), of_ratio.alias("ratio"), (none if self.cents is None else limit(self.cents, 0)).alias("cents"),
            texts(self.deal_types).alias("deal_types"), long(self.amount_lte).alias("lte"), long(self.amount_gt).alias("gt"), texts(self.use_of_proceeds).alias("uses"),
        )


def _applies(r: Column) -> Column:
    """Whether a rule is for this deal; a deal without what a rule asks for is not."""
    held = lambda given, holds: given.isNull() | F.coalesce(holds, F.lit(False))
    amount = F.col("amount_cents")
    of_type, of_use = F.array_contains(r["deal_types"], F.col("deal_type")), F.arrays_overlap(r["uses"], F.col("use_of_proceeds"))
    return held(r["deal_types"], of_type) & held(r["lte"], amount <= r["lte"]) & held(r["gt"], amount > r["gt"]) & held(r["uses"], of_use)


def _at(value: Column, scale: Column) -> Column:
    """A decimal's mantissa at a scale that is not below its own."""
    powers = F.array(*(F.lit(10**k).cast(_EXACT) for k in range(SCALE + 1)))
    return value["mantissa"].cast(_EXACT) * F.element_at(powers, scale - value["scale"] + 1)


def _result(r: Column) -> Column:
    metric = F.try_element_at("metrics", r["metric"])
    is_ratio = metric["kind"] == "ratio"
    actual = F.when(is_ratio, F.struct(metric["mantissa"].alias("mantissa"), metric["scale"].alias("scale"))).otherwise(F.struct(metric["cents"].alias("mantissa"), F.lit(0).alias("scale")))
    wanted = F.when(is_ratio, r["ratio"]).when(metric["kind"] == "cents", r["cents"])
    scale = F.greatest(actual["scale"], wanted["scale"])
    known = wanted.isNotNull() & actual["mantissa"].isNotNull()
    diff = F.when(known, _at(actual, scale) - _at(wanted, scale))
    passes = F.when(r["op"] == "gte", diff >= 0).when(r["op"] == "lte", diff <= 0).otherwise(diff == 0)
    status = F.when(diff.isNull(), "not_evaluable").when(passes, "pass").otherwise("fail")
    margin = F.when(r["op"] == "lte", -diff).otherwise(diff)
    return F.struct(r["rule"].alias("rule"), r["metric"].alias("metric"), status.alias("status"), margin.cast(_EXACT).alias("margin"), F.when(known, scale).alias("margin_scale"))


def evaluated(deals: DataFrame, rules: list[Rule]) -> DataFrame:
    """deal_id, review_status, results array<struct<rule, metric, status, margin, margin_scale>> of each deal, its rules in their order.

    deals: deal_id, deal_type, amount_cents, use_of_proceeds (array), review_status (the pack's), metrics map<string,
    struct<kind, cents, mantissa, scale>>. A rule that is not for the deal has no result; one whose metric is absent, or
    of another kind, is `not_evaluable`. The margin is headroom above 0 and shortfall below, of `eq` the deviation.
    """
    pack = F.array(*(r.column() for r in rules))
    return deals.select("deal_id", "review_status", F.transform(F.filter(pack, _applies), _result).alias("results"))


def rule_results(done: DataFrame) -> DataFrame:
    return done.select("deal_id", F.inline("results"))


def outcomes(done: DataFrame) -> DataFrame:
    """deal_id, certifiable, overall: `not_certifiable` under a pack that is not reviewed, else `fail`, `incomplete` or `pass`."""
    has = lambda status: F.exists("results", lambda r: r["status"] == status)
    certifiable = F.coalesce(F.col("review_status") == "reviewed", F.lit(False))
    overall = F.when(~certifiable, "not_certifiable").when(has("fail"), "fail").when(has("not_evaluable"), "incomplete").otherwise("pass")
    return done.select("deal_id", certifiable.alias("certifiable"), overall.alias("overall"))
