"""Pair counts of a stream of sequences: counts are sums, so a complete-mode aggregate keeps them up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import cells


def streaming_singles(rows: DataFrame) -> DataFrame:
    return cells(rows).groupBy("pos", "sym").agg(F.count("*").alias("n"))


def streaming_pairs(rows: DataFrame, length: int) -> DataFrame:
    """Pairs are made from each row by itself: a stream can't join itself without state."""
    i = F.sequence(F.lit(0), F.lit(length - 2))
    at = lambda k: F.substring(F.col("seq"), k + 1, F.lit(1))
    pairs = F.flatten(F.transform(i, lambda a: F.transform(F.sequence(a + 1, F.lit(length - 1)), lambda b: F.struct(a.alias("p1"), b.alias("p2"), at(a).alias("s1"), at(b).alias("s2")))))
    return rows.select(F.inline(pairs)).groupBy("p1", "p2", "s1", "s2").agg(F.count("*").alias("n"))
