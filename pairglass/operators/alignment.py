"""Alignments as tables: rows (seq_id, seq) of equal-length strings, cells (seq_id, pos, sym), per-column statistics.

Every function takes ``keys``, further columns (such as split and subset) that part one table into many alignments, so
that all of them are computed in one job. Positions count from 0, residues from 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The symbols in their order, the gap last.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY-"
GAP = "-"


class UnequalLengths(ValueError):
    """The rows of an alignment differ in length."""


class NoCanonical(ValueError):
    """The canonical sequence is not in the alignment."""


def sequence(text: Column, length: int = 24) -> Column:
    """Any text as a sequence: its letters in capitals, cut or padded with gaps, letters outside the alphabet as gaps."""
    letters = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.translate(F.rpad(F.substring(letters, 1, length), length, GAP), "BJOUXZ", "------")


def from_texts(df: DataFrame, id_: str, text: str, length: int = 24) -> DataFrame:
    return df.select(F.col(id_).cast("string").alias("seq_id"), sequence(F.col(text), length).alias("seq"))


def from_whole_texts(df: DataFrame, id_: str, text: str, length: int = 24) -> DataFrame:
    """Rows of ``length`` symbols from every letter of the texts: the first one of a text is named by its id, the others
    by the id, a point and their number, the last one is padded; a text without letters is one row of gaps."""
    letters = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", "")
    parts = df.select(F.col(id_).cast("string").alias("__id"), F.posexplode_outer(F.regexp_extract_all(letters, F.lit(f".{{1,{length}}}"), F.lit(0))).alias("__k", "__part"))
    name = F.when(F.col("__k") > 0, F.concat_ws(".", "__id", "__k")).otherwise(F.col("__id"))
    return parts.select(F.when(F.col("__id").isNotNull(), name).alias("seq_id"), sequence(F.col("__part"), length).alias("seq"))


def load(rows: DataFrame) -> DataFrame:
    """Capitals, and one length for all; raises ``UnequalLengths``."""
    rows = rows.withColumn("seq", F.upper("seq"))
    ends = rows.agg(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b")).first()
    if ends["a"] != ends["b"]:
        raise UnequalLengths(f"lengths from {ends['a']} to {ends['b']}")
    return rows


def cells(rows: DataFrame, keys=()) -> DataFrame:
    """(*keys, seq_id, pos, sym)."""
    return rows.select(*keys, "seq_id", F.posexplode(F.split("seq", "")).alias("pos", "sym"))


def dimensions(rows: DataFrame, keys=()) -> DataFrame:
    """(*keys, n, length)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("length"))


def gap_frequency(cells_: DataFrame, keys=()) -> DataFrame:
    """(*keys, pos, gap)."""
    return cells_.groupBy(*keys, "pos").agg(F.avg((F.col("sym") == GAP).cast("double")).alias("gap"))


def min_entropy(change: float = 0.05) -> float:
    return -change * math.log(change) - (1 - change) * math.log(1 - change)


def column_stats(cells_: DataFrame, keys=()) -> DataFrame:
    """(*keys, pos, gap, entropy): entropy in nats over the symbols other than gaps, unweighted; null for all gaps."""
    return stats_of_counts(cells_.groupBy(*keys, "pos", "sym").agg(F.count("*").cast("double").alias("n")), keys)


def stats_of_counts(single: DataFrame, keys=()) -> DataFrame:
    """The same from unweighted counts of one column (*keys, pos, sym, n)."""
    some = F.col("sym") != GAP
    held = F.sum(F.when(some, F.col("n")).otherwise(0.0))
    logs = F.sum(F.when(some, F.col("n") * F.log("n")).otherwise(0.0))
    gap = F.sum(F.when(~some, F.col("n")).otherwise(0.0)) / F.sum("n")
    return single.groupBy(*keys, "pos").agg(gap.alias("gap"), F.when(held > 0, F.log(held) - logs / held).alias("entropy"))


def reduced_columns(stats: DataFrame, gap: float = 0.1, change: float = 0.05) -> DataFrame:
    """Columns with fewer gaps than ``gap`` and more entropy than a column of which ``change`` differs."""
    return stats.where((F.col("gap") < gap) & (F.col("entropy") > min_entropy(change)))


def reference_mask(columns: DataFrame, rf: str) -> DataFrame:
    """Columns at which the reference line ``rf`` has no gap."""
    return columns.where(F.substring(F.lit(rf), F.col("pos") + 1, 1) != GAP) if isinstance(rf, Column) else columns.where(
        F.element_at(F.split(F.lit(rf), ""), F.col("pos") + 1) != GAP
    )


def positions(cells_: DataFrame, keys=()) -> DataFrame:
    """(*keys, seq_id, pos, residue): the place among the symbols of its sequence that are no gaps; null at gaps."""
    run = Window.partitionBy(*keys, "seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.sum((F.col("sym") != GAP).cast("int")).over(run)
    return cells_.select(*keys, "seq_id", "pos", F.when(F.col("sym") != GAP, count).alias("residue"))


def residues_of_rows(rows: DataFrame) -> DataFrame:
    """(seq_id, residues): the same of each row (seq_id, seq) as an array by position, null at gaps; no row is shuffled."""

    def run(batches):
        for b in batches:
            x = b.column("seq")
            at = np.concatenate([[0], np.cumsum(pc.utf8_length(x).to_numpy(zero_copy_only=False))]).astype(np.int32)
            text = "".join(x.to_pylist())
            held = np.frombuffer(text.encode("utf-32-le"), "<u4") != ord(GAP)
            run_ = np.cumsum(held)
            before = np.concatenate([[0], run_])[at[:-1]]
            number = pa.array((run_ - np.repeat(before, np.diff(at))).astype(np.int32), mask=~held)
            yield pa.RecordBatch.from_arrays([b.column("seq_id"), pa.ListArray.from_arrays(pa.array(at), number)], names=["seq_id", "residues"])

    return rows.select("seq_id", "seq").mapInArrow(run, "seq_id string, residues array<int>")


def map_to_canonical(scores: DataFrame, cells_: DataFrame, canonical: str, by=("p1", "p2"), keys=(), check: bool = True) -> DataFrame:
    """``scores`` with positions as residues of the canonical sequence; rows at its gaps go. Raises ``NoCanonical``."""
    own = cells_.where(F.col("seq_id") == canonical)
    if check and own.isEmpty():
        raise NoCanonical(canonical)
    at = positions(own, keys).where(F.col("residue").isNotNull()).select(*keys, "pos", "residue")
    for name in by:
        # One row for each position of one sequence: small however many sequences there are.
        one = F.broadcast(at.withColumnsRenamed({"pos": name, "residue": f"__{name}"}))
        scores = scores.join(one, [*keys, name]).drop(name).withColumnRenamed(f"__{name}", name)
    return scores


def similarity(x: Column, y: Column) -> Column:
    """The share of equal positions of two strings of one length; two gaps are equal."""
    same = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    return same.cast("double") / F.length(x)


def drop_zeros(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value) > 0)
