"""Small scalars as column expressions: settings, hashes, keys, rates, prices, scales of statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fintally.functions.money import BIG

# Default limits of a deal and days of the reminder cadence, with their greatest values.
DEAL_LIMITS = {"maxDocsPerDeal": 60, "maxBytesPerDeal": 1_073_741_824, "maxCostMicroUsdPerDeal": 10_000_000}
CADENCE = {"reminderAfterDays": (7, 60), "expireGraceDays": (14, 90)}
#: The greatest integer that a JSON number holds exactly.
SAFE = (1 << 53) - 1
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193


def setting(settings: Column, path: str, default: int, most: int = SAFE) -> Column:
    """A positive whole JSON number at path, up to most; else the default. A text that looks like a number doesn't count."""
    raw = F.get_json_object(settings, path)
    parent, _, name = path.rpartition(".")
    quoted = F.get_json_object(settings, parent).rlike(f'"{name}"\\s*:\\s*"')
    value = F.when(raw.rlike(r"^\d{1,16}(\.0+)?$") & ~F.coalesce(quoted, F.lit(False)), F.regexp_replace(raw, r"\.0+$", "")).try_cast("long")
    return F.when(value.between(1, most), value).otherwise(F.lit(default).cast("long"))


def unit_scale(text: Column) -> Column:
    """1,000,000 or 1,000 where a text says that its amounts are in millions or thousands, else 1; millions first."""
    said = {"millions": r"(?i)in millions|\(\$?000,000s?\)", "thousands": r"(?i)in thousands|\(\$?000'?s?\)"}
    return F.when(text.rlike(said["millions"]), 1_000_000).when(text.rlike(said["thousands"]), 1_000).otherwise(1)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the text's UTF-8 bytes, as LONG."""
    digits = F.hex(F.encode(text, "UTF-8"))
    bytes_of = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.coalesce(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"), F.lit(0)))
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(FNV_PRIME), F.lit(1 << 32))  # noqa: E731  below 2^57
    return F.when(text == "", F.lit(FNV_START).cast("long")).otherwise(F.aggregate(bytes_of, F.lit(FNV_START).cast("long"), step))


def rate_bps(kind: Column, bps: Column, spread_bps: Column, prime_bps: Column, cap_bps: Column) -> Column:
    """A fixed rate, or prime and spread, up to a cap if there is one. Null where the rate is missing or negative."""
    rate = F.when(kind == "fixed", bps).otherwise(prime_bps + F.coalesce(spread_bps, F.lit(0)))
    return F.when(rate >= 0, F.when(cap_bps.isNull(), rate).otherwise(F.least(rate, cap_bps)))


def token_cost_micro(rate_in: Column, rate_out: Column, fresh: Column, out: Column, written: Column, read: Column) -> Column:
    """Micro-USD of tokens at dollars per million: cache writes at 25/20 and reads at 2/20 of the input rate; rounded down once."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(BIG)
    twentieths = (zero(fresh) * zero(rate_in) + zero(out) * zero(rate_out)) * 20 + zero(written) * zero(rate_in) * 25 + zero(read) * zero(rate_in) * 2
    return ((twentieths - twentieths % 20) / 20).cast("long")


def compare_decimal(mantissa_a: Column, scale_a: Column, mantissa_b: Column, scale_b: Column) -> Column:
    """-1, 0 or 1 of two fixed-point numbers, at their common scale (scales up to 9)."""
    at = lambda m, s: m.cast(BIG) * F.element_at(F.array(*(F.lit(10**k).cast(BIG) for k in range(10))), F.greatest(scale_a, scale_b) - s + 1)
    a, b = at(mantissa_a, scale_a), at(mantissa_b, scale_b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def make_decimal(mantissa: Column, scale: Column) -> Column:
    """struct<mantissa, scale>; null where the scale is negative."""
    return F.when(scale >= 0, F.struct(mantissa.cast("long").alias("mantissa"), scale.cast("int").alias("scale")))


def sheet_number(cents: Column) -> Column:
    """Cents as a number with two decimals."""
    return (cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def file_label(name: Column, most: int = 120) -> Column:
    """A file name with anything but letters, digits, point, underscore, blank and hyphen replaced, of bounded length."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._ -]+", "_"), 1, most)


def storage_key(tenant: Column, deal: Column, digest: Column, extension: Column) -> Column:
    """tenant/deal/digest.extension of allowed parts, else null."""
    good = tenant.rlike("^[A-Za-z0-9-]+$") & deal.rlike("^[A-Za-z0-9-]+$") & is_sha256(digest) & F.lower(extension).isin("pdf", "png", "jpg", "jpeg", "csv", "xlsx")
    return F.when(good, F.concat(tenant, F.lit("/"), deal, F.lit("/"), digest, F.lit("."), F.lower(extension)))


def valid_key(key: Column) -> Column:
    parts = F.split(key, "/")
    return F.coalesce((F.size(parts) == 3) & key.rlike(r"^[A-Za-z0-9-]+/[A-Za-z0-9-]+/[0-9a-f]{64}\.(pdf|png|jpg|jpeg|csv|xlsx)$"), F.lit(False))


def treatment(node: Column) -> Column:
    """How a pro-forma line moves: what the bridge adds back is excluded, all else follows revenue."""
    return F.when(node.rlike(r"(^|\.)(depreciation|amortization|interest_expense|interest)$"), "excluded").otherwise("ratio")


def role_tier(role: Column) -> Column:
    return F.when(role == "owner", 4).when(role == "admin", 3).when(role == "underwriter", 2).when(role == "viewer", 1).otherwise(0)


def html_cells(html: Column) -> Column:
    """array<array<string>>: rows and cells of the tables of a page, tags taken out, white space single."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    decoded = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda c: F.trim(decoded(cell(c)))))
