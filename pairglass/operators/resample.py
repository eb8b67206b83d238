"""Resampling of alignments: (split, subset, seq_id, seq), all splits in one table. Draws come from an md5, not a generator."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "resample"


def draw(*parts: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def whole(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(1).alias("split"), F.lit("full").alias("subset"), "seq_id", "seq")


def _splits(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n))))


def split_half(rows: DataFrame, splits: int, canonical: str | None = None, seed: str = SEED) -> DataFrame:
    """Half of the sequences, rounded down, in 'a', the others in 'b'; the canonical one in both.

    Sequences are dealt in the order of a draw. Those of a split are counted by the first three digits of it; only of
    the one part in which the half ends are the rows put in order.
    """
    dealt = _splits(rows, splits).withColumn("__draw", draw(F.col("split"), F.col("seq_id"), seed=seed)).withColumn("__part", F.substring("__draw", 1, 3))
    sizes = dealt.groupBy("split", "__part").agg(F.count("*").alias("__n"))
    by = Window.partitionBy("split")  # 4,096 rows a split at most
    before = F.coalesce(F.sum("__n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("split", "__part", "__n", before.alias("__before"), F.floor(F.sum("__n").over(by) / 2).alias("__half"))
    dealt = dealt.join(F.broadcast(sizes), ["split", "__part"])
    edge = (F.col("__before") < F.col("__half")) & (F.col("__before") + F.col("__n") > F.col("__half"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("split", "__part").orderBy("__draw", "seq_id"))
    kept = ("split", "seq_id", "seq")
    whole = dealt.where(~edge).select(*kept, (F.col("__before") < F.col("__half")).alias("__first"))
    parted = dealt.where(edge).withColumn("__first", place <= F.col("__half")).select(*kept, "__first")
    subset = F.array(F.when(F.col("__first"), "a").otherwise("b"))
    if canonical is not None:
        subset = F.when(F.col("seq_id") == canonical, F.array(F.lit("a"), F.lit("b"))).otherwise(subset)
    return whole.union(parted).select("split", F.explode(subset).alias("subset"), "seq_id", "seq")


def number(rows: DataFrame) -> DataFrame:
    """``rows`` with ord, from 1 without gaps, in the order of the first three digits of an md5 and then of seq_id.

    Only the counts of the 4,096 parts are ordered in one task.
    """
    rows = rows.withColumn("__part", F.substring(F.md5("seq_id"), 1, 3))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("seq_id"))
    return rows.join(F.broadcast(sizes), "__part").withColumn("ord", F.col("__before") + place).drop("__part", "__before")


def bootstrap(rows: DataFrame, splits: int, canonical: str | None = None, seed: str = SEED) -> DataFrame:
    """As many draws with replacement as there are sequences, named with their number, and the canonical one as it is."""
    numbered = number(rows).select("ord", F.col("seq_id").alias("name"), "seq")
    n = rows.count()
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "k").withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    at = F.conv(F.substring(draw(F.col("split"), F.col("k"), seed=seed), 1, 8), 16, 10).cast("long") % n + 1
    got = draws.withColumn("ord", at).join(numbered, "ord")
    got = got.select("split", F.lit("boot").alias("subset"), F.concat_ws("_", "name", "k").alias("seq_id"), "seq")
    if canonical is not None:
        own = _splits(rows.where(F.col("seq_id") == canonical), splits)
        got = got.unionByName(own.select("split", F.lit("boot").alias("subset"), "seq_id", "seq"))
    return got


def resample(rows: DataFrame, method: str, splits: int, canonical: str | None = None, seed: str = SEED) -> DataFrame:
    from .alignment import NoCanonical

    if canonical is not None and rows.where(F.col("seq_id") == canonical).isEmpty():
        raise NoCanonical(canonical)
    if method == "null":
        return whole(rows)
    if method == "splithalf":
        return split_half(rows, splits, canonical, seed)
    if method == "bootstrap":
        return bootstrap(rows, splits, canonical, seed)
    raise ValueError(f"no such resampling: {method}")


@dataclass(frozen=True)
class Tables:
    """Resampled alignments as how often each row is in each of them: rows (seq_id, seq, times) aren't copied.

    ``times``: an unsigned little-endian 16-bit number for each of ``names``, (split, subset).
    """

    rows: DataFrame
    names: tuple[tuple[int, str], ...]
    halves: bool = False


def half_bounds(rows: DataFrame, splits: int, seed: str = SEED) -> list[tuple[str, str]]:
    """The last (draw, seq_id) of each split's first half; ('', '') where the half is empty.

    Tasks count the draws' first three digits (4,096 numbers a split); only the rows of the part in which a half ends
    are put in order.
    """
    dealt = _splits(rows.select("seq_id"), splits).withColumn("draw", draw(F.col("split"), F.col("seq_id"), seed=seed))
    part = F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")
    counted = dealt.groupBy("split", part.alias("part")).agg(F.count("*").alias("n")).toArrow()
    n = np.zeros((splits, 4096), np.int64)
    n[counted.column("split").to_numpy() - 1, counted.column("part").to_numpy()] = counted.column("n").to_numpy()
    upto, half = n.cumsum(1), n.sum(1) // 2
    edge = (upto < half[:, None]).sum(1)
    place = half - np.take_along_axis(upto - n, edge[:, None], 1)[:, 0]
    bounds = [("", "")] * splits
    if half.max(initial=0) == 0:
        return bounds
    edges = rows.sparkSession.createDataFrame([(k + 1, int(edge[k]), int(p)) for k, p in enumerate(place) if half[k]], "split int, edge int, wanted int")
    found = dealt.join(F.broadcast(edges), "split").where(part == F.col("edge"))  # one row a split
    order = F.row_number().over(Window.partitionBy("split").orderBy("draw", "seq_id"))
    for r in found.withColumn("place", order).where("place = wanted").collect():
        bounds[r["split"] - 1] = (r["draw"], r["seq_id"] or "")
    return bounds


def _halves(bounds, canonical: str | None, seed: str) -> Column:
    """The multiplicities of a row in both halves of each split, one after the other."""
    name = F.coalesce("seq_id", F.lit(""))
    first, second, both = b"\x01\x00\x00\x00", b"\x00\x00\x01\x00", b"\x01\x00\x01\x00"

    def of(k: int, last: str, last_name: str) -> Column:
        own = draw(F.lit(k), F.col("seq_id"), seed=seed)
        return F.when((own < last) | ((own == last) & (name <= last_name)), F.lit(first)).otherwise(F.lit(second))

    times = F.concat(*(of(k, *b) for k, b in enumerate(bounds, 1)))
    return times if canonical is None else F.when(F.col("seq_id") == canonical, F.lit(both * len(bounds))).otherwise(times)


#: Rows whose draws are put together at once.
DRAWN = 1 << 14


def _draw_vectors(splits):
    def run(key, table):
        at = table["ord"].to_numpy()
        ords, row = np.unique(at, return_inverse=True)
        n = np.bincount(row * splits + table["split"].to_numpy() - 1, minlength=len(ords) * splits).reshape(len(ords), splits)
        if n.max(initial=0) > 65535:
            raise OverflowError("a row drawn over 65,535 times")
        return pa.table({"ord": pa.array(ords), "drawn": pa.array([r.tobytes() for r in n.astype("<u2")], pa.binary())})

    return run


def tables(rows: DataFrame, method: str, splits: int, canonical: str | None = None, seed: str = SEED) -> Tables:
    """The same draws as ``resample``, for counting in one pass. ``rows`` (seq_id, seq) is read a few times: settle it.

    Halves need no shuffle of rows. For bootstrap the draws are shuffled (a few bytes each), never sequences with them;
    each sequence is shuffled once. Rows of one seq_id go to the same half.
    """
    from .alignment import NoCanonical

    if canonical is not None and rows.where(F.col("seq_id") == canonical).isEmpty():
        raise NoCanonical(canonical)
    rows, spark = rows.select("seq_id", "seq"), rows.sparkSession
    if method == "null":
        return Tables(rows.withColumn("times", F.lit(b"\x01\x00")), ((1, "full"),))
    if method == "splithalf":
        bounds = half_bounds(rows, splits, seed)
        return Tables(rows.withColumn("times", _halves(bounds, canonical, seed)), tuple((k, s) for k in range(1, splits + 1) for s in ("a", "b")), True)
    if method == "bootstrap":
        n = rows.count()
        draws = spark.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("split"))
        at = F.conv(F.substring(draw(F.col("split"), F.col("k"), seed=seed), 1, 8), 16, 10).cast("long") % n + 1
        drawn = draws.select("split", at.alias("ord"))  # shuffled once, counted where they meet
        packed = drawn.groupBy(F.floor(F.col("ord") / DRAWN).alias("block")).applyInArrow(_draw_vectors(splits), "ord long, drawn binary")
        got = number(rows).join(packed, "ord", "left").withColumn("drawn", F.coalesce("drawn", F.lit(bytes(2 * splits))))
        if canonical is not None:  # once more as it is
            once = F.udf(lambda t: (np.frombuffer(t, "<u2") + np.uint16(1)).tobytes(), "binary")
            own = got.where(F.col("seq_id") == canonical).withColumn("drawn", once("drawn"))
            got = got.where(~F.coalesce(F.col("seq_id") == canonical, F.lit(False))).union(own)
        return Tables(got.select("seq_id", "seq", F.col("drawn").alias("times")), tuple((k, "boot") for k in range(1, splits + 1)))
    raise ValueError(f"no such resampling: {method}")
