"""Policy packs by hand."""

from fintally.operators import policy
from fintally.operators.policy import Rule

DEAL = "deal_id long, deal_type string, amount_cents long, use_of_proceeds array<string>, review_status string, metrics map<string, struct<kind: string, cents: long, mantissa: long, scale: int>>"
RATIO = lambda m, s: ("ratio", None, m, s)
CENTS = lambda c: ("cents", c, None, None)


def run(spark, rules, metrics, **deal):
    d = {"deal_type": "acquisition", "amount_cents": 100, "use_of_proceeds": ["equipment"], "review_status": "reviewed"} | deal
    df = spark.createDataFrame([(1, d["deal_type"], d["amount_cents"], d["use_of_proceeds"], d["review_status"], metrics)], DEAL)
    done = policy.evaluated(df, rules)
    got = [(r["rule"], r["status"], None if r["margin"] is None else int(r["margin"]), r["margin_scale"]) for r in policy.rule_results(done).collect()]
    return got, policy.outcomes(done).first()["overall"]


def test_thresholds_meet_at_one_scale(spark):
    rules = [Rule("a", "dscr", "gte", ratio=(115, 2)), Rule("b", "equity", "gte", bps=1000), Rule("c", "term", "lte", months=120), Rule("d", "cash", "gte", cents=50), Rule("e", "cash", "eq", cents=40)]
    got, overall = run(spark, rules, {"dscr": RATIO(1875, 3), "equity": RATIO(10, 2), "term": RATIO(1201, 1), "cash": CENTS(50)})
    assert got == [("a", "pass", 725, 3), ("b", "pass", 0, 4), ("c", "fail", -1, 1), ("d", "pass", 0, 0), ("e", "fail", 10, 0)] and overall == "fail"


def test_kinds_and_absent_metrics(spark):
    rules = [Rule("a", "cash", "gte", ratio=(1, 0)), Rule("b", "none", "gte", cents=1), Rule("c", "cash", "gte", ratio=(1, 0), cents=7)]
    got, overall = run(spark, rules, {"cash": CENTS(9)})
    assert got == [("a", "not_evaluable", None, None), ("b", "not_evaluable", None, None), ("c", "pass", 2, 0)] and overall == "incomplete"
    assert run(spark, rules[2:], None) == ([("c", "not_evaluable", None, None)], "incomplete")


def test_conditions(spark):
    rules = [Rule("type", "m", "gte", cents=1, deal_types=("refinance",)), Rule("small", "m", "gte", cents=1, amount_lte=100), Rule("large", "m", "gte", cents=1, amount_gt=100), Rule("use", "m", "gte", cents=1, use_of_proceeds=("land", "equipment"))]
    names = lambda **deal: [r[0] for r in run(spark, rules, {"m": CENTS(1)}, **deal)[0]]
    assert names() == ["small", "use"]
    assert names(deal_type="refinance", amount_cents=101, use_of_proceeds=[]) == ["type", "large"]
    assert names(deal_type=None, amount_cents=None, use_of_proceeds=None) == []
    assert run(spark, rules, {"m": CENTS(1)}, deal_type=None, amount_cents=None, use_of_proceeds=None)[1] == "pass"


def test_only_a_reviewed_pack_certifies(spark):
    rules = [Rule("a", "m", "gte", cents=5)]
    assert [run(spark, rules, {"m": CENTS(1)}, review_status=s)[1] for s in ("reviewed", "draft", None)] == ["fail", "not_certifiable", "not_certifiable"]
