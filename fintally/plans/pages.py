"""Queries of page signals and bundle classes over pages that orders stand for, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.operators import page_signals
from fintally.plans.portfolio import K, case, case_sql, orders

# Parts of a page, dealt by divisors of the key; a page is their concatenation with blanks.
LEADS = ("", "Department of the Treasury", "attach", "(see", "Enter the amount from", "lines " * 80, "Prefer")
TOKENS = (
    "Schedule K-1 (Form 1120-S)", "Schedule K-1 (Form 1065), box 4", "SCHEDULE K1 (FORM 1065)", "Schedule C (Form 1040 or 1040-SR)",
    "Supplemental Income and Loss", "Schedule F (Form 1040)", "Schedule 1 (Form 1040)", "Form 1125-E", "Form 8825", "Form 4562",
    "Form 4562-FY", "Form 4626", "Form 1120-S", "Form 1120S", "Form 1120-F", "Form 1120", "Form 1120Department", "Form 1065",
    "Wage and Tax Statement", "Form 1040-SR", "Form 1040", "Form 1040-NR", "Form 1040EZ", "Form 5472", "nothing", "Balance Sheet",
    "Profit & Loss", "debt schedule", "Statement of revenues and expenses",
)
TAILS = ("", "OMB No. 1545-0123", "OMB No 1545-0074", "OMB No. 1545-0008", "OMB No. 1545-9999", "balance sheet", "see Form 1065", "Form 4562")
YEARS = ("", "for calendar year 2021", "Tax year: 2019 or", "2020 ending", "in 2021", "for the year 1999", "year beginning July 1, 2018")
ENDS = ("", "Page 3", "page 2 of 4", "Page 1", "page 27", "page 22x")
CLAIMS = ("1120S", "1065", "4562", "PNL", "1040", "other", None, "K1_1065", "1040_SCH_C")
PRINTS = ("Form 1120-S", "form  1065", "4562", None, "Form 1040-SR", "5472", "Schedule K-1 (Form 1065)", "Schedule C")
PARTS = ((LEADS, 1), (TOKENS, 3), (TAILS, 11), (YEARS, 89), (ENDS, 5))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    part = lambda values, by: case(F.floor(k / by), values)
    text = F.when(k % 97 != 0, F.concat_ws(" ", *(part(*p) for p in PARTS)))
    return orders(spark, sf_dir).select(k.alias("page_id"), text.alias("text"), part(CLAIMS, 2).alias("claim_family"), part(PRINTS, 7).alias("claim_printed"))


def _pages_sql() -> str:
    part = lambda values, by: case_sql(f"(o_orderkey // {by})", values)
    text = f"CASE WHEN o_orderkey % 97 <> 0 THEN concat_ws(' ', {', '.join(part(*p) for p in PARTS)}) END"
    return f"pages AS (SELECT o_orderkey AS page_id, {text} AS text, {part(CLAIMS, 2)} AS claim_family, {part(PRINTS, 7)} AS claim_printed FROM orders)"


# The patterns without look-ahead, for SQL: what must not follow is said by what may.
_SQL_FORMS = {
    "k1-1120s": r"schedule\s+k-?1\s*\(form\s+1120-?s\),?\s*(?:$|[^b,\s]|b(?:$|[^o])|bo(?:$|[^x]))",
    "k1-1065": r"schedule\s+k-?1\s*\(form\s+1065\),?\s*(?:$|[^b,\s]|b(?:$|[^o])|bo(?:$|[^x]))",
    "4562": r"form\s+4562(?:$|[^\d-])",
    "4626": r"form\s+4626(?:$|[^\d-])",
    "1120s": r"form\s+1120-?s(?:$|[^f\d-])",
    "1120": r"form\s+1120(?:$|[^s\d-]|s\w)",
    "1065": r"form\s+1065(?:$|[^\d-])",
    "1040": r"form\s+1040(?:-?sr)?(?:$|[^\dae-]|a\w|e(?:$|[^z])|ez\w)",
}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _signals_sql() -> str:
    pattern = lambda p, n: _quoted(_SQL_FORMS.get(n, p))
    cited = _quoted(page_signals.CITATION)
    before = lambda p: f"right(regexp_extract(head, '(?is)^(.*?)(?:{p})', 1), 24)"
    forms = " ".join(f"WHEN regexp_matches(head, '(?i){pattern(p, n)}') AND NOT regexp_matches({before(pattern(p, n))}, '(?i){cited}') THEN '{f}|{n}'" for p, f, n in page_signals.FORMS)
    titles = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{f}|{n}'" for p, f, n in page_signals.STATEMENTS)
    years = ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in page_signals.YEARS)
    groups = " OR ".join(f"(control = '{k}' AND form IN ({', '.join(repr(x) for x in v)}))" for k, v in page_signals.CONFIRMING.items())
    return f"""{_pages_sql()},
h AS (SELECT *, substr(text, 1, 400) AS head FROM pages),
f AS (SELECT *, CASE {forms} END AS hit, nullif(regexp_extract(text, '(?i){page_signals.CONTROL}', 1), '') AS control,
  CAST(coalesce({years}) AS INTEGER) AS tax_year, CAST(nullif(regexp_extract(text, '(?i){page_signals.CONTINUED}', 1), '') AS INTEGER) AS continuation_page FROM h),
g AS (SELECT *, split_part(hit, '|', 1) AS form, CASE WHEN control IN ('1545-0008', '1545-0029') THEN 'W2' END AS alone FROM f),
t AS (SELECT *, CASE WHEN form IS NULL AND alone IS NULL AND NOT regexp_matches(text, '(?i){page_signals.PRINTED}') THEN CASE {titles} END END AS title,
  coalesce({groups} OR alone = form, false) AS confirmed FROM g),
signals AS (SELECT *, coalesce(form, alone, split_part(title, '|', 1)) AS family,
  CASE WHEN form IS NOT NULL AND confirmed THEN 9800 WHEN form IS NOT NULL THEN 9000 WHEN alone IS NOT NULL THEN 9500 WHEN title IS NOT NULL THEN 7500 ELSE 0 END AS confidence_bps,
  concat_ws(',', 'form:' || split_part(hit, '|', 2), 'omb:' || control, split_part(title, '|', 2), 'year:' || tax_year, 'page:' || continuation_page) AS matched FROM t)"""


def _evidence_sql() -> str:
    """Evidence of the claimed family; the matches of one family's pattern and the text before each."""
    names = " ".join(f"WHEN '{f}' THEN '(?i)({_quoted(_SQL_FORMS.get(n, p))})'" for p, f, n in page_signals.FORMS)
    return f"""p AS (SELECT *, CASE claim_family {names} END AS pattern FROM signals),
m AS (SELECT *, string_split(regexp_replace(text, pattern, chr(1) || '\\1', 'g'), chr(1)) AS parts FROM p),
b AS (SELECT *, [array_to_string(parts[1:i], '') FOR i IN range(1, len(parts))] AS befores FROM m),
e AS (SELECT *, [CASE WHEN regexp_matches(right(x, 24), '(?i){_quoted(page_signals.CITATION)}') THEN 1 WHEN length(x) < 400 THEN 3 ELSE 2 END FOR x IN befores] AS marks FROM b),
evidence AS (SELECT *, ['absent', 'cited-only', 'unanchored', 'anchored'][coalesce(list_max(marks), 0) + 1] AS evidence,
  trim(regexp_replace(upper(claim_printed), '\\s+', ' ', 'g')) AS print FROM e)"""


_NAMES_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**page_signals.NAMES, "SCHEDULE K-1 (FORM 1065)": "K1_1065"}.items())
_CLAIM_SQL = f"""claims AS (SELECT *, CASE WHEN claim_family IN ('PNL', 'BALANCE_SHEET', 'DEBT_SCHEDULE', 'NON_FORM') THEN claim_family
  WHEN CASE regexp_replace(print, '^FORM ', '') {_NAMES_SQL} END = claim_family AND evidence <> 'cited-only' THEN claim_family END AS claim FROM evidence)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", page_signals.token_evidence(F.col("text"), F.col("claim_family")).alias("evidence"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", page_signals.valid_claim(F.col("text"), F.col("claim_family"), F.col("claim_printed")).alias("family"))


QUERIES = {
    "t05_page_signals": lambda s, d: page_signals.page_signals(pages(s, d), "page_id"),
    "t06_token_evidence": evidence,
    "t09_bundle_classes": lambda s, d: page_signals.classified(pages(s, d), "page_id"),
    "t10_valid_claims": claims,
}
ORACLES = {
    "t05_page_signals": f"WITH {_signals_sql()} SELECT page_id, family, tax_year, family IS NOT NULL AND control IS NOT NULL AND continuation_page IS NULL AS starts, continuation_page, confidence_bps, matched FROM signals",
    "t06_token_evidence": f"WITH {_signals_sql()}, {_evidence_sql()} SELECT page_id, evidence FROM evidence",
    "t09_bundle_classes": f"WITH {_signals_sql()}, {_evidence_sql()}, {_CLAIM_SQL} SELECT page_id, coalesce(family, claim) AS family, CASE WHEN family IS NOT NULL THEN 'signals' WHEN claim IS NOT NULL THEN 'claim' ELSE 'unresolved' END AS decided_by FROM claims",
    "t10_valid_claims": f"WITH {_signals_sql()}, {_evidence_sql()}, {_CLAIM_SQL} SELECT page_id, claim AS family FROM claims",
}
