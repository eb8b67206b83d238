"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..sources.store import discard, fresh, settle, shared_root

__all__ = ["discard", "fresh", "release", "settle", "shared_root", "ship", "sieve", "sifted", "tidied", "unused"]

#: Rows of an Arrow batch where the session leaves Spark's default: texts are long.
BATCH_ROWS = 1000
#: Bits of a sieve: a bound on what is broadcast. More keys only let more of the others pass.
SIEVE_BITS = 1 << 24


def ship(spark: SparkSession) -> None:
    """Give the executors this package; smaller Arrow batches, unless the session sets its own size."""
    shipping.ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def tidied(run):
    """``run`` over batches or groups, giving freed memory back to the system at its end: Python workers live on."""

    @functools.wraps(run)
    def batches_(batches):
        yield from run(batches)
        release()

    return batches_


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _place(key: str | Column) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(SIEVE_BITS).cast("long"))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A filter of ``SIEVE_BITS`` bits for a column of hashes, 64 to a row: 2 ** 18 rows at most, however many keys."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(key).bitwiseAND(63).cast("int"))
    return keys.groupBy(F.shiftright(_place(key), 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def sifted(rows: DataFrame, key: str, held: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false where ``key`` is certainly not in the sieve. Nothing is shuffled."""
    got = rows.join(F.broadcast(held), F.shiftright(_place(key), 6) == F.col("__word"), "left")
    bit = F.call_function("shiftright", F.col("__bits"), _place(key).bitwiseAND(63).cast("int")).bitwiseAND(1)
    return got.withColumn(name, F.coalesce(bit, F.lit(0)) == 1).drop("__word", "__bits")


def unused(columns, *names: str) -> list[str]:
    """``names`` with as many underscores before them as no column of ``columns`` has."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return [mark + n for n in names]
