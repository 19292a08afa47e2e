"""Mixing sources to target weights by Sainte-Laguë apportionment, with Spark SQL functions only.

Targets: a source's share goes by weight, stops at MOST times its size, and what is above goes to the others. Words are
apportioned in blocks of BLOCK: the blocks of the mix go to the sources, a source's to its groups of shards, a group's
to its shards, each time to the highest quotient weight / (2 k + 1), k blocks given so far, while the taker has blocks
left (each block can be used MOST times). In a shard documents stand in seeded order, their words are cut into equal
blocks, and a seeded order of the blocks says which ones are used once more than the others.

Apportionment needs no loop over quotients: a water level of the shares bounds the seats of each taker from below and
from above, the two bounds are n apart in sum or little more, and only the seats between them are ranked. Rows of one
window are those of a shard (about SHARD words), the shards of a group (GROUP), the groups of a source, or the sources.

Cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, the last one; a null doc_id is
an id like another; repeated rows (same id, source and size) are one unit that is split into parts of COPIES, and what a
part takes is dealt evenly to its rows; a text of any length may span blocks; an empty table gives no rows; a table
without a word takes nothing; columns named as the results are replaced, others are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fintally.llm.common import table, written

#: Words of a block, and of a shard.
BLOCK, SHARD = 32, 1 << 20
#: Shards whose quotas are found together.
GROUP = 1024
#: Repeated rows that are dealt together.
COPIES = 1000
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all, and uses of a block at most.
SHARE, MOST = 1.5, 2
SEED = 13


def size_of(text: Column) -> Column:
    """Number of words: runs of anything but the space and the characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _order(*parts: Column) -> Column:
    """A seeded place for a key, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def water_level(volume: Column, weight: Column, cap: Column, by: list[str]) -> Column:
    """The greatest of this column in a group of by is the level x at which the sum of least(cap, weight * x) is the volume.

    It is above all ratios where the caps are below the volume. That sum is the least of the lines caps-so-far + other-weights * x in order of cap / weight, so x is the greatest
    of their solutions.
    """
    order = Window.partitionBy(*by).orderBy(cap / weight, weight, cap)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (volume.cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0)).cast("double")) / F.sum(weight).over(after).cast("double")


def apportioned(takers: DataFrame, by: list[str], key: str, volume: str, weight: str, cap: str) -> DataFrame:
    """takers with column quota: the seats that each one gets by the highest quotients weight / (2 k + 1), at most cap.

    Columns are named: by and volume are those of a group, key orders takers of equal quotients and is unique in a
    group, weight and cap are those of a taker (weight above 0). Seats beyond all caps stay empty.
    """
    group = Window.partitionBy(*by)
    w, c = F.col(weight), F.col(cap)
    seats = F.least(F.col(volume), F.sum(c).over(group))
    # rounding moves a group's sum by n / 2 at most
    base = takers.withColumn("_seats", seats).withColumn("_n", F.count(F.lit(1)).over(group) / 2 + 1)
    base = base.withColumn("_from", water_level(F.col("_seats") - F.col("_n"), w, c, by)).withColumn("_to", water_level(F.col("_seats") + F.col("_n"), w, c, by))
    base = base.withColumn("_from", F.greatest(F.max("_from").over(group), F.lit(0.0))).withColumn("_to", F.max("_to").over(group))
    low = F.greatest(F.lit(0), F.least(c, F.floor(w * F.col("_from") + 0.5) - 1))
    high = F.least(c, F.floor(w * F.col("_to") + 0.5) + 1)
    base = base.withColumn("_low", low.cast("long")).withColumn("_open", F.col("_seats") - F.sum(low.cast("long")).over(group))
    options = F.when(high > F.col("_low"), F.sequence(F.col("_low"), high.cast("long") - 1)).otherwise(F.array(F.lit(-1).cast("long")))
    ranked = base.withColumn("_k", F.explode(options)).withColumn("_quotient", F.when(F.col("_k") >= 0, w / (2 * F.col("_k") + 1)))
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("_quotient"), key, "_k"))
    given = ranked.withColumn("_given", (F.col("_k") >= 0) & (rank <= F.col("_open")))
    names = [*takers.columns, "_low"]
    out = given.groupBy(*names).agg(F.count_if("_given").alias("_more"))
    return out.select(*takers.columns, (F.col("_low") + F.col("_more")).alias("quota"))


def with_targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (size, weight) with target: words by weight, at most most times the size."""
    everything = Window.partitionBy()
    volume, cap = F.sum("size").over(everything).cast("double") * share, F.col("size") * most
    level = sources.withColumn("_level", water_level(volume, F.col("weight"), cap, []))
    return level.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.max("_level").over(everything))).drop("_level")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, source, text); sources by code point weigh weights, repeating.

    share <= most. A source, a group and a shard are each known by their numbers from here on.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = written(rows)
    words = F.col("size") * F.col("rows")
    sources = units.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum(F.when(F.col("size") > 0, words + block)).alias("_load"))
    number = F.row_number().over(Window.partitionBy().orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    sources = sources.withColumn("source_no", number).withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    sources = with_targets(sources.withColumnRenamed("source_size", "size"), share, most).withColumnRenamed("size", "source_size")
    shards_of = F.greatest(F.lit(1), F.ceil(F.coalesce("_load", F.lit(0)) / shard)).cast("long")
    sources = written(sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "weight", shards_of.alias("_shards")))

    parts = units.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    # parts of repeated rows are units of their own
    copy = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / COPIES)))
    parts = parts.withColumn("part", copy).withColumn("rows", F.least(F.lit(COPIES), F.col("rows") - F.col("part") * COPIES))
    place = _order(F.col("doc_id"), F.col("size"), F.col("part"))
    parts = parts.withColumn("place", place).withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % F.col("_shards")).withColumn("words", words)
    parts = written(parts.select("doc_id", "size", "rows", "part", "source_no", "source_size", "target", "shard", "place", "words"))

    held = parts.where("words > 0").groupBy("source_no", "shard").agg(F.sum("words").alias("shard_words"))
    held = held.withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("shard_words") / block + 0.5)).cast("long")).withColumn("group", F.floor(F.col("shard") / GROUP))
    quotas = written(_quotas(held, sources.select("source_no", "weight", "target"), most))

    taken = _taken(parts.where("words > 0").join(quotas, ["source_no", "shard"]))
    none = parts.where("words = 0").withColumn("taken", F.lit(0).cast("long")).select(taken.columns)
    each = taken.unionByName(none).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    dealt = F.expr("taken div rows + if(copy <= taken % rows, 1, 0)")
    return each.select("doc_id", "size", "source_size", "target", dealt.alias("taken"))


def _quotas(held: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """source_no, shard, shard_words, blocks, quota: block uses of each shard.

    A source's blocks are equal, but may be longer or shorter than another's if it has few: weights and targets are
    those of its own blocks. The sum of targets is taken in millionths, so that it doesn't depend on its order.
    """
    groups = held.groupBy("source_no", "group").agg(F.sum("blocks").alias("group_blocks"), F.sum("shard_words").alias("group_words"))
    top = groups.groupBy("source_no").agg(F.sum("group_blocks").alias("source_blocks"), F.sum("group_words").alias("words")).join(sources, "source_no")
    per_word = F.col("source_blocks") / F.col("words")
    top = top.withColumn("weight", F.col("weight") * per_word).withColumn("wanted", F.round(F.col("target") * per_word * 1000000).cast("long"))
    volume = F.round(F.sum("wanted").over(Window.partitionBy()) / 1000000).cast("long")
    top = top.withColumn("volume", volume).withColumn("cap", F.col("source_blocks") * most)
    top = apportioned(top, [], "source_no", "volume", "weight", "cap").select("source_no", F.col("quota").alias("volume"))
    middle = groups.join(top, "source_no").withColumn("cap", F.col("group_blocks") * most)
    middle = apportioned(middle, ["source_no"], "group", "volume", "group_blocks", "cap").select("source_no", "group", F.col("quota").alias("volume"))
    low = held.join(middle, ["source_no", "group"]).withColumn("cap", F.col("blocks") * most)
    return apportioned(low, ["source_no", "group"], "shard", "volume", "blocks", "cap").select("source_no", "shard", "shard_words", "blocks", "quota")


def _taken(parts: DataFrame) -> DataFrame:
    """parts with taken: the words of the blocks that are used, each as often as it is used."""
    shard = Window.partitionBy("source_no", "shard")
    so_far = F.sum("words").over(shard.orderBy("place", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("words"))
    pieces = placed.withColumn("block", F.explode(F.expr("sequence(start * blocks div shard_words, (end - 1) * blocks div shard_words)")))
    # block b has the words from ceil(b * shard_words / blocks) on
    first, last = (f"(({b}) * shard_words + blocks - 1) div blocks" for b in ("block", "block + 1"))
    pieces = pieces.withColumn("overlap", F.expr(f"least(end, {last}) - greatest(start, {first})"))
    lot = _order(F.col("source_no"), F.col("shard"), F.col("block"))
    rank = F.dense_rank().over(shard.orderBy("lot", "block"))
    uses = F.expr("quota div blocks + if(rank <= quota % blocks, 1, 0)")
    pieces = pieces.withColumn("lot", lot).withColumn("rank", rank).withColumn("uses", uses)
    keys = ["source_no", "shard", "place", "doc_id", "size", "part", "rows", "source_size", "target"]
    return pieces.groupBy(*keys).agg(F.sum(F.col("overlap") * F.col("uses")).alias("taken"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 1.5 times all words takes of each document."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: Each quotient as a row of its own; holds below GROUP shards a source, and for ids that are given once.
ORACLE_SQL = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
totals as (
  select source, sum(size)::bigint as source_size, coalesce(sum(size + 32) filter (where size > 0), 0) as load, row_number() over (order by source nulls last) - 1 as no
  from docs group by source),
sources as (
  select *, [5, 2, 1][(no % 3 + 1)::int]::bigint as weight, greatest(1, ceil(load / 1048576.0))::bigint as shards from totals),
levels as (
  select 2.0 * source_size / weight as ratio,
         (1.5 * sum(source_size) over ()::double - coalesce(sum(2 * source_size) over before, 0)::double) / sum(weight) over after::double as x
  from sources
  window before as (order by 2.0 * source_size / weight, weight rows between unbounded preceding and 1 preceding),
         after as (order by 2.0 * source_size / weight, weight rows between current row and unbounded following)),
targets as (
  select *, least(2.0::double * source_size, weight * (select arg_min(x, ratio) from levels where x <= ratio)) as target from sources),
placed as (
  select d.*, t.no, t.source_size, t.target, md5('13:' || coalesce(d.doc_id::varchar, 'null') || ':' || d.size || ':0') as place,
         ('0x' || substr(md5('13:' || coalesce(d.doc_id::varchar, 'null') || ':' || d.size || ':0'), 1, 8))::ubigint::bigint % t.shards as shard
  from docs d join targets t on d.source is not distinct from t.source),
shards as (
  select no, shard, sum(size)::bigint as words, greatest(1, floor(sum(size) / 32.0 + 0.5))::bigint as blocks from placed where size > 0 group by no, shard),
blocks as (
  select s.no, any_value(t.weight) * (sum(s.blocks)::double / sum(words)::double) as weight, sum(s.blocks)::bigint as blocks,
         round(any_value(t.target) * (sum(s.blocks)::double / sum(words)::double) * 1000000)::bigint as wanted
  from shards s join targets t on t.no = s.no group by s.no),
source_quota as (
  select no, count(*) as quota from (
    select no, weight / (2 * k + 1) as q, k from (select no, weight, unnest(range(2 * blocks)) as k from blocks)
    qualify row_number() over (order by q desc, no, k) <= (select round(sum(wanted) / 1000000) from blocks)) group by no),
shard_quota as (
  select no, shard, count(*) as quota from (
    select s.no, s.shard, s.q, s.k, z.quota as most from (
      select no, shard, blocks / (2 * k + 1) as q, k from (select *, unnest(range(2 * blocks)) as k from shards)) s join source_quota z on z.no = s.no
    qualify row_number() over (partition by s.no order by s.q desc, s.shard, s.k) <= z.quota) group by no, shard),
lots as (
  select no, shard, k as block, words, blocks, coalesce(quota, 0) // blocks + (row_number() over (
           partition by no, shard order by md5('13:' || no || ':' || shard || ':' || k)) <= coalesce(quota, 0) % blocks)::bigint as uses
  from (select *, unnest(range(blocks)) as k from shards) left join shard_quota using (no, shard)),
spans as (
  select *, sum(size) over (partition by no, shard order by place, doc_id) - size as start_at, sum(size) over (partition by no, shard order by place, doc_id) as end_at
  from placed where size > 0),
pieces as (
  select s.doc_id, l.uses * (least(end_at, ((l.block + 1) * words + blocks - 1) // blocks) - greatest(start_at, (l.block * words + blocks - 1) // blocks)) as took
  from spans s join lots l on l.no = s.no and l.shard = s.shard and l.block between start_at * blocks // words and (end_at - 1) * blocks // words)
select p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::bigint as taken
from placed p left join (select doc_id, sum(took) as taken from pieces group by doc_id) t on t.doc_id = p.doc_id
"""
