"""What a page says of its form: printed form numbers, control numbers, statement titles, tax year, page numbers.

All rules are regular expressions inside one projection, so that pages are read once and nothing is shuffled. Cases: a
null text has no signal; an empty one neither; a text of any length is read whole, but identity counts in its head only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the head, where a form number is the page's identity, and before a match, where a citation is looked for.
HEAD, BEFORE = 400, 24

# Printed form numbers and titles, (pattern, family, label), the first that is no citation wins.
FORMS = (
    (r"schedule\s+k-?1\s*\(form\s+1120-?s\)(?!,?\s*box)", "K1_1120S", "k1-1120s"),
    (r"schedule\s+k-?1\s*\(form\s+1065\)(?!,?\s*box)", "K1_1065", "k1-1065"),
    (r"schedule\s+c\s*\(form\s+1040(?:\s+or\s+1040-?sr)?\)|profit or loss from business", "1040_SCH_C", "sch-c"),
    (r"schedule\s+e\s*\(form\s+1040(?:\s+or\s+1040-?sr)?\)|supplemental income and loss", "1040_SCH_E", "sch-e"),
    (r"schedule\s+f\s*\(form\s+1040(?:\s+or\s+1040-?sr)?\)|profit or loss from farming", "1040_SCH_F", "sch-f"),
    (r"schedule\s+1\s*\(form\s+1040(?:\s+or\s+1040-?sr)?\)", "1040_SCH_1", "sch-1"),
    (r"form\s+1125-?e\b", "1125E", "1125e"),
    (r"form\s+8825\b|rental real estate income and expenses of a partnership", "8825", "8825"),
    (r"form\s+4562(?![\d-])", "4562", "4562"),
    (r"form\s+4626(?![\d-])", "4626", "4626"),
    (r"form\s+1120-?s(?!f)(?![\d-])", "1120S", "1120s"),
    (r"form\s+1120(?!-?s\b)(?![\d-])(?!-[a-z])", "1120", "1120"),
    (r"form\s+1065(?![\d-])(?!-[a-z])", "1065", "1065"),
    (r"wage and tax statement", "W2", "w2"),
    (r"form\s+1040(?:-?sr)?(?![\d-])(?!-[a-z])(?!(?:a|ez)\b)", "1040", "1040"),
)
# Words before a form number that make it a citation.
CITATION = (
    r"\b(?:attach(?:ed|ment)?s?|from|see|per|refer(?:red)?|to|on|in|of|for|about|the|your|with|includes?|included"
    r"|reported|shown|enter(?:ed)?|filed?)[\s(:.,]*\z"
)
# Control numbers that name a form alone, and those that confirm one of a group.
CONTROL = r"omb\s+no\.?\s*(1545-\d{4})"
ALONE = {"1545-0008": "W2", "1545-0029": "W2"}
CONFIRMING = {
    "1545-0123": ("1120", "1120S", "1065", "1125E", "8825", "K1_1120S", "K1_1065", "4626"),
    "1545-0074": ("1040", "1040_SCH_1", "1040_SCH_C", "1040_SCH_E", "1040_SCH_F"),
}
# Titles of statements, and marks of printed forms, beside which no title counts.
STATEMENTS = (
    (r"debt schedule|schedule of (?:liabilities|debts|loans)", "DEBT_SCHEDULE", "debt-keyword"),
    (
        r"profit\s*(?:and|&)\s*loss|income statement|statement of operations|statement of revenues?\s*(?:and|&)\s*expenses",
        "PNL",
        "pnl-keyword",
    ),
    (r"balance sheet", "BALANCE_SHEET", "bs-keyword"),
)
PRINTED = r"\bform\s+\d{3,4}[a-z0-9-]*\b|\bomb\s+no\.|\bschedule\s+[a-z0-9-]+\s*\(form"
# Printed page numbers from 2 on; phrases of the tax year, in order.
CONTINUED = r"(?:^|\s)page\s+([2-9]\d?)(?:\s|\z)"
YEARS = (
    r"(?:calendar year|tax year|for the year|year beginning)\D{0,20}(20[12]\d)",
    r"(20[12]\d)[,.]?\s+(?:ending|or tax year)",
)
# Families without a printed number, and printed names of the others after upper-casing.
TITLED = ("PNL", "BALANCE_SHEET", "DEBT_SCHEDULE", "NON_FORM")
NAMES = {
    "1120": "1120", "1120S": "1120S", "1120-S": "1120S", "1065": "1065", "1040": "1040", "1040-SR": "1040",
    "4562": "4562", "4626": "4626", "8825": "8825", "1125E": "1125E", "1125-E": "1125E", "W2": "W2", "W-2": "W2",
    "SCHEDULE C": "1040_SCH_C", "SCHEDULE E": "1040_SCH_E", "SCHEDULE F": "1040_SCH_F", "SCHEDULE 1": "1040_SCH_1",
}

#: Stands before each match of a text.
_MARK = "\x01"


def _any_case(pattern: str) -> str:
    """A pattern for either case whose white space takes in no-break and wide blanks."""
    return "(?i)" + pattern.replace(r"\s", r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_any_case(pattern))


def _group(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    got = F.regexp_extract(text, _any_case(pattern), 1)
    return F.when(got != "", got)


def _cited(before: Column) -> Column:
    return _has(F.right(before, F.lit(BEFORE)), CITATION)


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def head_form(text: Column) -> Column:
    """struct(family, label) of the first form whose number or title stands in the head and is no citation."""
    head = F.substring(text, 1, HEAD)

    def found(pattern: str, family: str, label: str) -> Column:
        at = F.regexp_instr(head, F.lit(_any_case(pattern)))
        own = (at > 0) & ~_cited(F.left(head, at - 1))
        return F.when(own, F.struct(F.lit(family).alias("family"), F.lit(label).alias("label")))

    return F.coalesce(*(found(*form) for form in FORMS))


def page_signals(pages: DataFrame, *keys: str) -> DataFrame:
    """keys, family, tax_year, starts, continuation_page, confidence_bps and matched of each page's text.

    A number or title in the head gives 9,000 points, 9,800 with a control number of its group; a control number of one
    form alone 9,500; a statement's title 7,500, on pages without any mark of a printed form only.
    """
    text = F.col("text")
    control = F.col("_control")
    seen = pages.select(*keys, "text", head_form(text).alias("_form"), _group(text, CONTROL).alias("_control"))
    form, alone = F.col("_form.family"), _mapped(control, ALONE)
    group = F.create_map(*(x for k, v in CONFIRMING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    confirmed = F.coalesce(F.array_contains(group[control], form), F.lit(False)) | F.coalesce(alone == form, F.lit(False))
    titles = [F.when(_has(text, p), F.struct(F.lit(f).alias("family"), F.lit(n).alias("label"))) for p, f, n in STATEMENTS]
    title = F.when(form.isNull() & alone.isNull() & ~_has(text, PRINTED), F.coalesce(*titles))
    known = seen.select(
        *keys,
        "_form",
        "_control",
        title.alias("_title"),
        alone.alias("_alone"),
        F.coalesce(confirmed, F.lit(False)).alias("_confirmed"),
        F.coalesce(*(_group(text, p) for p in YEARS)).cast("int").alias("tax_year"),
        _group(text, CONTINUED).cast("int").alias("continuation_page"),
    )
    family = F.coalesce(form, F.col("_alone"), F.col("_title.family"))
    points = F.when(form.isNotNull(), F.when(F.col("_confirmed"), 9_800).otherwise(9_000))
    points = points.when(F.col("_alone").isNotNull(), 9_500).when(F.col("_title").isNotNull(), 7_500).otherwise(0)
    shown = (
        F.concat(F.lit("form:"), F.col("_form.label")),
        F.concat(F.lit("omb:"), control),
        F.col("_title.label"),
        F.concat(F.lit("year:"), "tax_year"),
        F.concat(F.lit("page:"), "continuation_page"),
    )
    return known.select(
        *keys,
        family.alias("family"),
        "tax_year",
        (family.isNotNull() & control.isNotNull() & F.col("continuation_page").isNull()).alias("starts"),
        "continuation_page",
        points.alias("confidence_bps"),
        F.concat_ws(",", *shown).alias("matched"),
    )


def token_evidence(text: Column, family: Column) -> Column:
    """How a family's number stands on a page: anchored (in the head), unanchored, cited-only or absent.

    Matches are marked, and one fold over the pieces between marks carries the characters before each: linear in the text.
    """

    def evidence(pattern: str) -> Column:
        whole = F.translate(text, _MARK, "\x02")
        pieces = F.split(F.regexp_replace(whole, _any_case(f"({pattern})"), _MARK + "$1"), _MARK)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.lit(-1).alias("best"))

        def step(acc: Column, piece: Column) -> Column:
            # best: -1 before the first piece, which is no match; 0 none, 1 cited, 2 elsewhere, 3 in the head
            here = F.when(_cited(acc["before"]), 1).when(acc["at"] < HEAD, 3).otherwise(2)
            best = F.when(acc["best"] < 0, 0).otherwise(F.greatest(acc["best"], here))
            before = F.right(F.concat(acc["before"], piece), F.lit(BEFORE))
            return F.struct((acc["at"] + F.length(piece)).alias("at"), before.alias("before"), best.alias("best"))

        best = F.aggregate(pieces, start, step)["best"]
        return F.element_at(F.array(*map(F.lit, ("absent", "cited-only", "unanchored", "anchored"))), best + 1)

    chosen = reduce(lambda c, form: c.when(family == form[1], evidence(form[0])), FORMS[1:], F.when(family == FORMS[0][1], evidence(FORMS[0][0])))
    return F.when(text.isNull(), "absent").otherwise(F.coalesce(chosen, F.lit("absent")))


def printed_family(printed: Column) -> Column:
    """The family of a form's printed name; null for every name that is not exactly one of the known ones."""
    name = F.trim(F.regexp_replace(F.upper(printed), r"\s+", " "))
    partner = F.regexp_extract(name, r"^SCHEDULE K-?1 \(FORM (1120-?S|1065)\)$", 1)
    schedule = F.regexp_extract(name, r"^SCHEDULE ([1CEF]) \(FORM 1040(?: OR 1040-?SR)?\)$", 1)
    bare = F.regexp_replace(name, "^FORM ", "")
    own = F.when(partner == "1065", "K1_1065").when(partner != "", "K1_1120S").when(schedule != "", F.concat(F.lit("1040_SCH_"), schedule))
    return F.coalesce(own, _mapped(bare, NAMES))


def valid_claim(text: Column, family: Column, printed: Column) -> Column:
    """The family that a reader's claim on a page supports, or null.

    The printed name must be that of the family, and the page must not merely cite it; statements need neither.
    """
    backed = (printed_family(printed) == family) & (token_evidence(text, family) != "cited-only")
    return F.when(family.isin(*TITLED) | F.coalesce(backed, F.lit(False)), family)


def classified(pages: DataFrame, *keys: str) -> DataFrame:
    """keys, family and decided_by of each page: its own signals first, then a valid claim (claim_family, claim_printed), else unresolved."""
    signals = page_signals(pages, *keys, "text", "claim_family", "claim_printed")
    claim = F.when(F.col("family").isNull(), valid_claim(F.col("text"), F.col("claim_family"), F.col("claim_printed")))
    decided = F.when(F.col("family").isNotNull(), "signals").when(claim.isNotNull(), "claim").otherwise("unresolved")
    return signals.select(*keys, F.coalesce("family", claim).alias("family"), decided.alias("decided_by"))
