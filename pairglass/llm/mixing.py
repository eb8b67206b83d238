"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the exponential key ``-ln(u) / w``: u from a hash of its id and the seed, w its quality weight.
A source takes complete epochs first; what is left of its target is filled with the documents of the smallest keys,
up to the prefix of word counts that comes nearest to it.

The prefix sums don't sort a source in one task. Keys fall into ``BUCKETS`` ranges, words are summed by source and
range, and only the one range of a source in which its target ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for a mean of six characters a word, less the further from it."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(F.length(text).cast("double") / F.greatest(size, F.lit(1)).cast("double") - 6.0) / 6.0)


def uniform(id_: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, ratios=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size, target): ``share`` of all words by weight, at most ``most`` times a source's words each.

    Water-filling in closed form. With sources in order of ``most * words / weight``, the first k are full for the
    least k at which the level of the others, what is left over their weights, doesn't reach the next one's ratio.
    One row for each source; the windows over that table hold no documents.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(ratios)))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in ratios]), (at + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("ratio", F.col("source_size").cast("double") * most / F.col("weight"))
    every = Window.partitionBy(F.lit(1))
    upto = Window.orderBy("ratio", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = (
        by.withColumn("total", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("full", F.coalesce(F.sum("source_size").over(upto), F.lit(0)).cast("double") * most)
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    )
    level = (F.col("total") - F.col("full")) / F.col("open")
    by = by.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", F.col("src").isNull(), "src", level.alias("v")))).over(every)["v"])
    target = F.least(F.col("source_size").cast("double") * most, F.col("level") * F.col("weight"))
    return by.select("src", "source_size", F.coalesce(target, F.col("source_size").cast("double") * most).alias("target"))


def _keyed(docs: DataFrame, seed: str, weight: Column | None) -> DataFrame:
    """``docs`` with __src, __size, __key, __bucket and __hash."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({"__src": F.col("source"), "__size": size, "__hash": F.coalesce(F.xxhash64("text"), F.lit(0))})
    w = F.coalesce(quality_weight(F.col("text"), F.col("__size")) if weight is None else weight, F.lit(1.0)).cast("double")
    rows = rows.withColumn("__key", -F.log(uniform(F.col("doc_id"), seed)) / w)
    return rows.withColumn("__bucket", F.floor(F.col("__key") / (1.0 + F.col("__key")) * BUCKETS).cast("int"))


def _bounds(rows: DataFrame, ratios, share: float, most: float) -> DataFrame:
    """One row for each source: its target, whole epochs, and the key range in which the rest of its target ends."""
    rows = rows.select(F.col("__src").alias("src"), F.col("__size").alias("size"), F.col("__bucket").alias("bucket"))
    targets = source_targets(rows, ratios, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = settle(targets.withColumnRenamed("src", "tsrc"), "mix-targets")
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).join(targets.select("tsrc", "rest"), F.col("src").eqNullSafe(F.col("tsrc")))
    over = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    at = sums.groupBy("tsrc").agg(
        F.min(F.when(over, F.col("bucket"))).alias("edge"), F.min(F.when(over, F.col("before"))).alias("edge_before"),
        F.min(F.when(F.col("before") >= F.col("rest"), F.col("bucket"))).alias("out"),
    )
    at = at.withColumnRenamed("tsrc", "asrc")
    return settle(targets.join(at, F.col("tsrc").eqNullSafe(F.col("asrc")), "left").drop("asrc"), "mix-bounds")


def _taken(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` of ``_keyed`` with their source's bounds and __taken."""
    joined = rows.join(bounds.select(*(F.col(c).alias(f"__{c}") for c in bounds.columns)), F.col("__src").eqNullSafe(F.col("__tsrc")))
    on_edge = F.col("__edge").isNotNull() & (F.col("__bucket") == F.col("__edge"))
    base = F.col("__epochs") * F.col("__size")
    inside = F.when(F.coalesce(F.col("__bucket") < F.col("__out"), F.lit(True)), F.col("__size")).otherwise(F.lit(0))
    plain = joined.where(~on_edge).withColumn("__taken", base + inside)
    run = Window.partitionBy("__src").orderBy("__key", "doc_id", "__size", "__hash").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__edge_before") + F.coalesce(F.sum("__size").over(run), F.lit(0))
    fits = 2 * ahead + F.col("__size") <= 2 * F.col("__rest")
    edged = joined.where(on_edge).withColumn("__taken", base + F.when(fits, F.col("__size")).otherwise(F.lit(0)))
    return plain.unionByName(edged)


def mix(docs: DataFrame, *, ratios=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source).

    A null text has size 0 and is taken 0 times; null sources are one source, the last. Repeated rows are each taken
    for themselves. Ties of keys go by id, size and a hash of the text. An empty table gives no rows. Other columns
    are ignored. ``weight`` is a positive column of quality weights of ``docs``, by default ``quality_weight``.
    """
    rows = _keyed(docs, seed, weight).select("doc_id", "__src", "__size", "__key", "__bucket", "__hash")
    rows = settle(rows, "mix-sizes")
    got = _taken(rows, _bounds(rows, ratios, share, most))
    return got.select("doc_id", F.col("__src").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, *, ratios=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken, all columns as they are, whatever their names.

    Rows without words (null texts too) are not taken; repeated rows are each taken for themselves; an empty table
    gives no rows.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = _keyed(docs.select("doc_id", "text", "source", whole.alias("__row")), seed, None)
    bounds = _bounds(settle(rows.select("__src", "__size", "__bucket"), "mix-sizes"), ratios, share, most)
    got = _taken(rows, bounds).where("__taken > 0")
    copies = F.sequence(F.lit(1), (F.col("__taken") / F.col("__size")).cast("int"))
    return got.withColumn("__copy", F.explode(copies)).select("__row.*")


ORACLE = f"""
with d as (select doc_id, source, text, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size from documents),
k as (select doc_id, source, size, -ln((cast(('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double)
   / coalesce(1.0::double / (1.0::double + abs(cast(length(text) as double) / cast(greatest(size, 1) as double) - 6.0::double) / 6.0::double), 1.0::double) as key from d),
s as (select source, cast(sum(size) as bigint) ss from d group by source),
w as (select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double wt from s),
r as (select *, cast(ss as double) * 2.0::double / wt ratio, cast(sum(ss) over () as double) * 1.5::double total from w),
f as (select *, cast(coalesce(sum(ss) over p, 0) as double) * 2.0::double as filled, sum(wt) over () - coalesce(sum(wt) over p, 0) as openw from r
      window p as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (total - filled) / openw lv from f),
v as (select lv from l where lv <= ratio order by ratio, source nulls last limit 1),
t as (select source, ss, least(cast(ss as double) * 2.0::double, coalesce((select lv from v) * wt, cast(ss as double) * 2.0::double)) target from r),
e as (select *, case when ss > 0 then cast(floor(target / ss) as bigint) else 0 end ep from t),
j as (select k.doc_id, k.size, e.ss, e.target, e.ep, e.target - e.ep * e.ss rest,
      coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) ahead
      from k join e on k.source is not distinct from e.source)
select doc_id, size, ss as source_size, target, cast(ep * size + case when 2 * ahead + size <= 2 * rest then size else 0 end as bigint) taken from j
"""
