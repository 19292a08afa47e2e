"""URL filters with Spark SQL functions only.

Rules and listed entries are canonical URLs without a scheme: host, then a path that ends in a slash. Each URL has as
keys its host and every parent domain, with every prefix of its path that ends in a slash, as far as the longest listed
domain and path go: a longer key can't be listed. A split-block Bloom filter
of the listed keys (eight words of 32 bits to a block, one bit set in each) lets possible hits pass; they meet the
list in an exact hash join, which removes the false positives. The longest rule decides. Without a rule the verdict is
block if an entry of the block list fits, else allow.

Scale: keys are made and filtered row by row; only possible hits are shuffled, once for each distinct host and path.
The filter has FILTER_BLOCKS blocks at most (32 bytes each), which bounds what the plan carries: a longer list only
passes more false positives on to the join. Verdicts join back on host and path, where AQE splits hot hosts.

Cases: a null url, or one without ://, has an empty host and path, no rule and the verdict allow; repeated rows give
repeated results; equal lengths go to the first rule in text order; extra columns are kept, and columns named as the
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import table

# The rules (verdict, canonical URL) and the block list of spam hosts.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BLOCK_LIST = ("casino-win.example.org/", "cheap-pills.example.com/", "free-prizes.example.net/")

#: Blocks of the filter at most (a power of two), and bits of it for each listed key until then.
FILTER_BLOCKS, BITS_PER_KEY = 1 << 14, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, most_labels: int, most_steps: int) -> Column:
    """Every parent domain of a host with every prefix of the path that ends in a slash, none longer than any listed key."""
    # what lies before the longest listed domain is cut off, and a path behind the longest listed one
    last = F.when(F.size(F.split(host, r"\.", -1)) > most_labels, F.substring_index(host, ".", -most_labels)).otherwise(host)
    labels = F.split(last, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/", most_steps + 1)
    prefixes = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 40) % blocks


def _bit(h: Column, k: int) -> Column:
    """The bit of word k: five bits of the hash for each of the eight words."""
    return F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int")


def bloom_words(listed: DataFrame) -> tuple[Column, int]:
    """The words of the filter of the column key, block after block, and the number of blocks."""
    count = max(1, listed.count())
    blocks = 1
    while blocks < FILTER_BLOCKS and blocks * 256 < count * BITS_PER_KEY:
        blocks *= 2
    h = F.xxhash64("key")
    bits = listed.select(_block(h, blocks).alias("block"), h.alias("h"))
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"), k))).alias(f"w{k}") for k in range(8)]
    rows = {r[0]: r[1:] for r in bits.groupBy("block").agg(*words).collect()}  # at most FILTER_BLOCKS rows
    flat = ",".join(str(w) for b in range(blocks) for w in rows.get(b, (0,) * 8))
    return F.split(F.lit(flat), ",").cast("array<bigint>"), blocks


def may_hold(words: Column, blocks: int, key: Column) -> Column:
    h = F.xxhash64(key)
    tests = [F.call_function("shiftright", F.element_at(words, (_block(h, blocks) * 8 + k + 1).cast("int")), _bit(h, k)).bitwiseAND(F.lit(1)) == 1 for k in range(8)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def judged(df: DataFrame, listed: DataFrame, *, url_col: str = "url") -> DataFrame:
    """df with host, path, rule and verdict; listed: key, kind (rule or entry), verdict, each key and kind once."""
    results = {"host", "path", "rule", "verdict"}
    kept = [c for c in df.columns if c not in results]
    host, path = host_and_path(F.col("_url"))
    rows = df.select(*kept, F.col(url_col).alias("_url")).withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}).drop("_url")
    words, blocks = bloom_words(listed)
    most_labels, most_steps = listed.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))), F.max(F.size(F.split("key", "/", -1)) - 1)).first()
    hits = rows.select("host", "path", F.filter(keys(F.col("host"), F.col("path"), most_labels or 1, most_steps or 1), lambda k: may_hold(words, blocks, k)).alias("keys"))
    hits = hits.where(F.size("keys") > 0).distinct().select("host", "path", F.explode("keys").alias("key"))
    rule = F.col("kind") == "rule"
    found = hits.join(listed, "key").groupBy("host", "path").agg(
        F.min(F.when(rule, F.struct(-F.length("key"), F.col("key").alias("key"), "verdict"))).alias("best"),
        F.max(F.when(~rule, F.col("verdict"))).alias("entry"),
    )
    found = found.select("host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", "entry").alias("verdict"))
    return rows.join(found, ["host", "path"], "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def listed_keys(spark: SparkSession) -> DataFrame:
    rows = [(url, "rule", verdict) for verdict, url in RULES] + [(url, "entry", "block") for url in BLOCK_LIST]
    return spark.createDataFrame(rows, "key string, kind string, verdict string")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), listed_keys(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH listed(key, kind, verdict) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM h),
m AS (SELECT d.host, d.path, l.* FROM d JOIN listed l ON starts_with(d.path, substr(l.key, instr(l.key, '/')))
      AND (d.host = split_part(l.key, '/', 1) OR ends_with(d.host, '.' || split_part(l.key, '/', 1)))),
r AS (SELECT host, path, arg_max(key, length(key)) FILTER (WHERE kind = 'rule') AS rule,
             arg_max(verdict, length(key)) FILTER (WHERE kind = 'rule') AS decided, max(verdict) FILTER (WHERE kind = 'entry') AS entry FROM m GROUP BY host, path)
SELECT h.page_id, h.host, h.path, r.rule, coalesce(r.decided, r.entry, 'allow') AS verdict
FROM h LEFT JOIN r ON h.host = r.host AND h.path = r.path
""".format(
    values=", ".join([f"('{u}', 'rule', '{v}')" for v, u in RULES] + [f"('{u}', 'entry', 'block')" for u in BLOCK_LIST]), upper=UPPER, lower=LOWER
)
