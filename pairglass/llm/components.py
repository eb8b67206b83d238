"""Connected components of links, without bringing them to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle


class Union:
    """Disjoint sets of 0 to n - 1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def _forest(batches):
    """Of a task's links those that span its components; each task holds one table file's links."""
    place: dict[int, int] = {}
    names: list[int] = []
    up: list[int] = []
    sets = Union(0)
    sets.up = up
    for b in batches:
        keep = []
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for z in (x, y):
                if z not in place:
                    place[z] = len(names)
                    names.append(z)
                    up.append(len(up))
            keep.append(sets.join(place[x], place[y]))
        yield b.filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), long: component is the smallest node that is reachable.

    Alternating stars: every node hands its larger neighbours to its smallest one, then its smaller neighbours to the
    smallest of them, until nothing changes; a logarithmic number of rounds. Each round is a written table. The rows
    of a node with many neighbours meet only in sums by key and in joins that Spark can split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    every = settle(e, "links")
    e = settle(every.mapInArrow(_forest, "u long, v long"), "links")
    discard(every)
    nodes = settle(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "link-nodes")
    mark = lambda t: tuple(t.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 31)), F.lit(0))).first())
    before = mark(e)
    for _ in range(most):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        last, e = e, settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("k", "m")).distinct(), "links")
        discard(last)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
