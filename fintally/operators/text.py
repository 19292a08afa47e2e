"""Text operators as column expressions: amounts, labels, periods, personal data, page text quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, minus and currency signs of printed amounts; what stands for an absent one.
SPACE = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u205f]"
MINUS = "[-\\u2013\\u2014\\u2212]"
CURRENCY = "[$\u20ac\u00a3]"
ABSENT = r"(?i)^(n/?a|none|nil)$"
#: Thousands in groups of three, by one kind of mark.
GROUPED = r"^\d{1,3}(?:(?:\.\d{3})+|(?:,\d{3})+|(?:'\d{3})+)$"
#: Amounts of the common form, which are read without looking for others: dollars with or without commas, up to two decimals.
_DOLLARS = r"\$?(?:\d{1,12}|\d{1,3}(?:,\d{3}){1,3})(?:\.\d{1,2})?"
PLAIN = rf"^(?:-?{_DOLLARS}|\({_DOLLARS}\))\z"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _without_sign(state: Column) -> Column:
    """The outermost sign mark of state.text taken off and counted: parentheses, else a leading, else a trailing minus."""
    t, dashes = state["text"], state["text"].rlike(f"^{MINUS}+$")
    paren, lead, trail = t.rlike(r"^\(.*\)$"), t.rlike(f"^{MINUS}") & ~dashes, t.rlike(f"{MINUS}$") & ~dashes
    inner = F.when(paren, _stripped(F.regexp_replace(t, r"^\(|\)$", ""))).when(lead, F.regexp_replace(t, f"^{MINUS}{SPACE}*", "")).when(trail, F.regexp_replace(t, f"{SPACE}*{MINUS}$", ""))
    return F.struct(F.coalesce(inner, t).alias("text"), (state["signs"] + (paren | lead | trail).cast("int")).alias("signs"))


def _parts(b: Column) -> Column:
    """struct<whole, part, fault> of digits with marks: what precedes and follows the decimal mark, or why there is none."""
    marks = lambda m: F.length(b) - F.length(F.replace(b, F.lit(m), F.lit("")))
    dots, commas = marks("."), marks(",")
    head, tail = F.regexp_extract(b, r"^(.*)[.,]([^.,]*)$", 1), F.regexp_extract(b, r"^(.*)[.,]([^.,]*)$", 2)
    mark = F.substring(b, F.length(head) + 1, F.lit(1))
    whole_only = lambda x: F.struct(x.alias("whole"), F.lit("").alias("part"), F.lit(None).cast("string").alias("fault"))
    both_parts = lambda x, y: F.struct(x.alias("whole"), y.alias("part"), F.lit(None).cast("string").alias("fault"))
    fault = lambda why: F.struct(F.lit("").alias("whole"), F.lit("").alias("part"), F.lit(why).alias("fault"))
    ungrouped = F.regexp_replace(b, "[.,]", "")
    mixed = F.replace(head, F.when(mark == ".", ",").otherwise("."), F.lit(""))
    short, grouped = tail.rlike(r"^\d{1,2}$"), b.rlike(GROUPED)
    return (
        F.when((dots > 0) & (commas > 0), F.when(mixed.rlike("[.,]"), fault("malformed_grouping")).otherwise(both_parts(mixed, tail)))
        .when(dots + commas == 0, whole_only(b))
        .when(grouped & ((commas > 0) | (dots > 1)), whole_only(ungrouped))
        .when(dots + commas > 1, fault("malformed_grouping"))
        .when(short, both_parts(head, tail))
        .when(tail == "", whole_only(head))
        .when(commas > 0, fault("malformed_grouping"))
        .when(b.rlike(r"^\d{1,3}\.\d{3}$"), fault("ambiguous_separator"))
        .otherwise(fault("too_many_decimals"))
    )


def normalize_amount(text: Column, scale: Column | int = 1, cents_box: Column | None = None) -> Column:
    """struct<cents, null_reason, rejection> of a printed amount, times scale.

    An absent mark is null with a reason, never zero. More than one sign mark is a conflict. With a point and a comma the
    last one is the decimal mark; groups have three digits; one point before three digits is ambiguous. The digits of a
    cents box stand for the decimals, which must then be absent. A null text reads as an empty one.
    """
    if cents_box is None and isinstance(scale, int) and 0 < scale <= 1000:
        return let(F.coalesce(text, F.lit("")), lambda x: _plain_or_any(x, scale))
    return _any_amount(text, scale, cents_box)


def _plain_or_any(text: Column, scale: int) -> Column:
    """An amount of the common form by its digits alone, any other one, or an absent one, by its marks."""
    digits = F.translate(text, "$,()-", "").try_cast("decimal(14,2)")
    cents = (digits * F.when(text.rlike("^[(-]"), -100 * scale).otherwise(100 * scale)).cast("long")
    none = F.lit(None).cast("string")
    plain = F.struct(cents.alias("cents"), none.alias("null_reason"), none.alias("rejection"))
    dash = F.struct(F.lit(None).cast("long").alias("cents"), F.lit("dash").alias("null_reason"), none.alias("rejection"))
    return F.when(text.rlike(PLAIN), plain).when(text.isin(*"-\u2013\u2014\u2212"), dash).otherwise(_any_amount(text, scale, None))


def _any_amount(text: Column, scale: Column | int, cents_box: Column | None) -> Column:
    t = _stripped(F.coalesce(text, F.lit("")))
    scale = F.lit(scale) if isinstance(scale, int) else scale
    box = F.lit(None).cast("string") if cents_box is None else _stripped(cents_box)
    box_digits = F.when((box == "") | box.rlike(f"^{MINUS}+$"), "00").when(box.rlike(r"^\d{1,2}$"), F.lpad(box, 2, "0"))
    none = F.lit(None)
    result = lambda cents=none, reason=none, rejection=none: F.struct(cents.cast("long").alias("cents"), reason.cast("string").alias("null_reason"), rejection.cast("string").alias("rejection"))
    reject = lambda why: result(rejection=F.lit(why) if isinstance(why, str) else why)

    def amount(signs: Column, p: Column) -> Column:
        whole, part = F.replace(p["whole"], F.lit("'"), F.lit("")), p["part"]
        digits = F.concat(F.lit("0"), whole, F.rpad(F.coalesce(box_digits, part), 2, "0"))
        cents = digits.try_cast("decimal(38,0)") * scale.cast("decimal(10,0)") * F.when(signs == 1, -1).otherwise(1)
        number = whole.rlike(r"^\d*$") & part.rlike(r"^\d*$") & (F.concat(whole, part) != "")
        return (
            F.when(p["fault"].isNotNull(), reject(p["fault"]))
            .when(~number, reject("not_a_number"))
            .when(F.length(part) > 2, reject("too_many_decimals"))
            .when(box_digits.isNotNull() & (part != ""), reject("invalid_cents_box"))
            .when(cents.isNull() | (F.abs(cents) > F.lit((1 << 63) - 1).cast("decimal(38,0)")), reject("out_of_range"))
            .otherwise(result(cents.try_cast("long")))
        )

    def unsigned(state: Column) -> Column:
        spaced = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(state["text"], CURRENCY, ""), f"{SPACE}+", " ")), "^ | $", "")
        body = F.regexp_replace(spaced, " ", "")  # thousands by spaces, and stray spaces
        return (
            F.when(state["signs"] > 1, reject("conflicting_signs"))
            .when(~body.rlike(r"^[\d.,']+$"), reject("not_a_number"))
            .when(box.isNotNull() & box_digits.isNull(), reject("invalid_cents_box"))
            .otherwise(let(body, lambda b: let(_parts(b), lambda p: amount(state["signs"], p))))
        )

    first = let(F.struct(t.alias("text"), F.lit(0).alias("signs")), _without_sign)
    return (
        F.when(t == "", result(reason=F.lit("empty")))
        .when(t.rlike(f"^{MINUS}+$"), result(reason=F.lit("dash")))
        .when(t.rlike(ABSENT), result(reason=F.lit("na")))
        .otherwise(let(let(first, _without_sign), unsigned))
    )


def normalize_label(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces, no leading account number, `total for` as `total`."""
    t = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(t, r"^\d+ +", ""), r"\btotal for\b", "total")


def similarity_points(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length, in ten-thousandths rounded down."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 10_000).otherwise(F.floor((longer - F.levenshtein(a, b)) * 10_000 / longer)).cast("int")


def canonical_period(text: Column) -> Column:
    """A period label without a trailing parenthesis; `As of Y-M-D` as Y-M; one space in `TTM ...`."""
    t = F.trim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", ""))
    t = F.regexp_replace(t, r"(?i)^as of (\d{4}-\d{2})-\d{2}$", "$1")
    return F.regexp_replace(t, r"(?i)^ttm\s+", "TTM ")


SSN, EIN, NINE = r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{2}-\d{7}\b", r"\b\d{9}\b"


def scan_pii(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, severity, masked) of personal numbers; the mask keeps the last four digits.

    The patterns cannot overlap: each asks for a word boundary at both ends and another shape of the same characters.
    """
    found = lambda kind, severity, p: F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), m.alias("m")))
    hits = F.concat(found("ssn", "definite", SSN), found("ein", "definite", EIN), found("nine_digits", "possible", NINE))
    out = df.select(id_col, F.inline(hits))
    masked = F.concat(F.regexp_replace(F.expr("substring(m, 1, length(m) - 4)"), r"\d", "*"), F.expr("right(m, 4)"))
    return out.select(id_col, "kind", "severity", masked.alias("masked"))


def garbled(text: Column, least_chars: int = 40) -> Column:
    """`short`, `garbled` (over 5% control, private-use or replacement characters) or `ok`."""
    odd = F.length(F.regexp_replace(text, "[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ue000-\\uf8ff\\ufffd]", ""))
    size = F.length(F.trim(text))
    return F.when(text.isNull() | (size < least_chars), "short").when(odd * 20 > F.length(text), "garbled").otherwise("ok")
