"""Networks as edge tables (*keys, p1, p2, weight[, pvalue]) with p1 < p2: pruning, spanning trees, consensus, votes,
and similarity of two networks. Every function takes ``keys`` that part a table into many networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, settle


class NoWeights(ValueError):
    """A network without a weight column."""


def network(df: DataFrame, weight: str = "score") -> DataFrame:
    """Edges from scores: weights rounded to eight decimals, as networks are kept."""
    if weight not in df.columns:
        raise NoWeights(weight)
    return df.withColumn("weight", F.round(weight, 8)).drop(*([weight] if weight != "weight" else []))


def node_degrees(edges: DataFrame, keys=()) -> DataFrame:
    """(*keys, node, degree): sums of weights."""
    one = edges.select(*keys, F.col("p1").alias("node"), "weight")
    return one.union(edges.select(*keys, "p2", "weight")).groupBy(*keys, "node").agg(F.sum("weight").alias("degree"))


def total_weight(edges: DataFrame, keys=()) -> DataFrame:
    return node_degrees(edges, keys).groupBy(*keys).agg((F.lit(0.5) * F.sum("degree")).alias("total"))


def at_least(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("weight") >= threshold)


def significant(edges: DataFrame, level: float = 0.05) -> DataFrame:
    return edges.where(F.col("pvalue") <= level)


def _ranked(edges: DataFrame, n: int, keys, order) -> DataFrame:
    if not keys:
        return edges.orderBy(*order).limit(n)
    by = Window.partitionBy(*keys).orderBy(*order)
    return edges.withColumn("__place", F.row_number().over(by)).where(F.col("__place") <= n).drop("__place")


def top_n(edges: DataFrame, n: int = 100, keys=()) -> DataFrame:
    return _ranked(edges, n, keys, (F.desc("weight"), F.desc("p1"), F.desc("p2")))


def bottom_n(edges: DataFrame, n: int = 100, keys=()) -> DataFrame:
    return _ranked(edges, n, keys, (F.asc("weight"), F.asc("p1"), F.asc("p2")))


#: Edges of a network that one task may take at the end; of more, forests are grown by rounds of DataFrame operations.
FEW_EDGES = 1 << 18


def _find(up: dict, x):
    while up.setdefault(x, x) != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _forest(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["weight", "p1", "p2"], ascending=[False, True, True])
    up: dict[int, int] = {}
    keep = []
    for a, b in zip(frame["p1"], frame["p2"]):
        a, b = _find(up, a), _find(up, b)
        keep.append(a != b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return frame[np.array(keep, bool)]


def _roots(parent: DataFrame, keys) -> DataFrame:
    """(*keys, node, root) from (*keys, node, parent), where roots are their own parents: by jumps of doubled length."""
    got = settle(parent.select(*keys, "node", F.col("parent").alias("root")), "roots")
    while True:
        up = got.select(*keys, F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = settle(got.join(up, [*keys, "root"]).select(*keys, "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "roots")
        discard(got)
        got = jumped.select(*keys, "node", "root")
        got.settled_path = jumped.settled_path
        if jumped.where("moved").isEmpty():
            return got


def forest_by_rounds(edges: DataFrame, keys=()) -> DataFrame:
    """The forest by Boruvka's rounds: every component takes its heaviest edge out (of equal ones the least pair), and
    what edges join becomes one component. A round at least halves the components that have edges."""
    keys, names = list(keys), edges.columns
    live = settle(edges.withColumns({"c1": F.col("p1").cast("long"), "c2": F.col("p2").cast("long")}), "live")
    out = None
    while not live.isEmpty():
        order = F.struct((-F.col("weight")).alias("w"), F.col("p1").alias("p1"), F.col("p2").alias("p2"))
        ends = live.select("*", F.explode(F.array(F.struct(F.col("c1").alias("node"), F.col("c2").alias("to")), F.struct(F.col("c2").alias("node"), F.col("c1").alias("to")))).alias("e"))
        best = ends.groupBy(*keys, "e.node").agg(F.min_by(F.struct("e.to", *names), order).alias("b"))
        best = settle(best.select(*keys, "node", "b.to", *(F.col(f"b.{c}").alias(c) for c in names if c not in keys)), "best")
        taken = best.select(*names).dropDuplicates([*keys, "p1", "p2"])  # two components may take the same edge
        out = taken if out is None else out.union(taken)
        # Of two that take each other the lesser is the root.
        back = best.select(*keys, F.col("node").alias("to"), F.col("to").alias("again"))
        mutual = (F.col("again") == F.col("node")) & (F.col("node") < F.col("to"))
        parent = best.join(back, [*keys, "to"]).select(*keys, "node", F.when(mutual, F.col("node")).otherwise(F.col("to")).alias("parent"))
        roots = _roots(parent, keys)
        for c in ("c1", "c2"):
            live = live.join(roots.select(*keys, F.col("node").alias(c), F.col("root").alias("__r")), [*keys, c]).drop(c).withColumnRenamed("__r", c)
        live = settle(live.where("c1 <> c2"), "live")
    return edges.limit(0) if out is None else out.select(*names)


def _most_edges(edges: DataFrame, keys) -> int:
    n = edges.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return n or 0


def spanning_forest(edges: DataFrame, keys=()) -> DataFrame:
    """The maximum spanning forest of each network; of equal weights the least pair first.

    First in parts: an edge that isn't in the forest of a part of the edges isn't in the whole one's. What is left, at
    most sixteen forests, is finished in one task a network where all are of ``FEW_EDGES`` at most, else by rounds in
    which no task holds more than a partition of edges. Each pair has one edge.
    """
    keys = list(keys)
    part = F.pmod(F.xxhash64("p1", "p2"), F.lit(16)).cast("int")
    if _most_edges(edges, keys) > 16 * FEW_EDGES:
        return forest_by_rounds(edges, keys)
    some = edges.withColumn("__part", part).groupBy(*keys, "__part").applyInPandas(lambda f: _forest(f).drop(columns="__part"), edges.schema)
    some = settle(some, "forests")
    if _most_edges(some, keys) > FEW_EDGES:
        return forest_by_rounds(some, keys)
    if keys:
        return some.groupBy(*keys).applyInPandas(_forest, edges.schema)
    return some.withColumn("__part", F.lit(0)).groupBy("__part").applyInPandas(lambda f: _forest(f).drop(columns="__part"), edges.schema)


def _spanning_links(keys):
    """A forest of the links that a task sees, of each network."""

    def run(batches):
        up: dict[tuple, dict] = {}
        for b in batches:
            kept = []
            for k, (u, v, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("u", "v", *keys)))):
                own = up.setdefault(tuple(key), {})
                x, y = _find(own, u), _find(own, v)
                if x != y:
                    own[max(x, y)] = min(x, y)
                    kept.append(k)
            yield b.take(pa.array(kept, pa.int64()))

    return run


def components(links: DataFrame, keys=()) -> DataFrame:
    """(*keys, node, component) of the nodes of ``links`` (*keys, u, v): the least node that they reach."""
    keys = list(keys)
    some = links.select(*keys, F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    some = some.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    some = some.mapInArrow(_spanning_links(keys), some.schema).dropDuplicates([*keys, "u", "v"])
    live = settle(some.select("*", F.col("u").alias("c1"), F.col("v").alias("c2")), "live")
    label = settle(live.select(*keys, F.col("u").alias("node")).union(live.select(*keys, "v")).distinct().withColumn("component", F.col("node")), "labels")
    while not live.isEmpty():
        ends = live.select(*keys, F.col("c1").alias("node"), F.col("c2").alias("to")).union(live.select(*keys, "c2", "c1"))
        # To the least neighbour if that is less than itself: no circles, and the least node of a component stays.
        parent = ends.groupBy(*keys, "node").agg(F.least(F.min("to"), F.first("node")).alias("parent"))
        roots = _roots(parent, keys)
        moved = roots.withColumnRenamed("node", "component")
        label = settle(label.join(moved, [*keys, "component"], "left").select(*keys, "node", F.coalesce("root", "component").alias("component")), "labels")
        for c in ("c1", "c2"):
            live = live.join(roots.select(*keys, F.col("node").alias(c), F.col("root").alias("__r")), [*keys, c]).drop(c).withColumnRenamed("__r", c)
        live = settle(live.where("c1 <> c2"), "live")
    return label


def prune(edges: DataFrame, method: str, n: int = 100, keys=()) -> DataFrame:
    if method == "mst":
        return spanning_forest(edges, keys)
    if method == "topn":
        return top_n(edges, n, keys)
    if method == "bottomn":
        return bottom_n(edges, n, keys)
    if method == "pvalue":
        return significant(edges)
    raise ValueError(f"no such pruning: {method}")


def consensus(edges: DataFrame, of: DataFrame | None = None, keys=("split", "subset"), by=()) -> DataFrame:
    """(*by, p1, p2, weight): the share of the pruned networks ``edges`` that have an edge.

    ``of``: the networks before they were pruned; those that pruning empties count too.
    """
    graphs = (edges if of is None else of).select(*by, *keys).distinct().groupBy(*by).agg(F.count("*").alias("graphs"))
    n = edges.groupBy(*by, "p1", "p2").agg(F.count("*").alias("n"))
    n = n.join(graphs, list(by)) if by else n.crossJoin(F.broadcast(graphs))  # one row
    return n.select(*by, "p1", "p2", (F.col("n") / F.col("graphs")).alias("weight"))


def borda(scores: DataFrame, voters=("method", "subset"), split: str = "split") -> DataFrame:
    """(split, p1, p2, rank, weight): edges by the sum of their ranks over all voters; equal sums share the lower rank."""
    own = Window.partitionBy(split, *voters).orderBy(F.desc("score"))
    summed = scores.withColumn("__rank", F.rank().over(own)).groupBy(split, "p1", "p2").agg(F.sum("__rank").alias("__sum"))
    place = F.rank().over(Window.partitionBy(split).orderBy("__sum"))
    return summed.withColumn("rank", place).select(split, "p1", "p2", "rank", (1.0 / F.col("rank")).alias("weight"))


def _union(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """Edges of either network with both weights, null where it hasn't the edge."""
    x = a.select(*keys, "p1", "p2", F.col("weight").alias("wa"))
    y = b.select(*keys, "p1", "p2", F.col("weight").alias("wb"))
    return x.join(y, [*keys, "p1", "p2"], "full_outer")


def jaccard(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    both = F.sum((F.col("wa").isNotNull() & F.col("wb").isNotNull()).cast("int"))
    return _union(a, b, keys).groupBy(*keys).agg(F.coalesce(both / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("similarity"))


def _filled(a, b, keys):
    return _union(a, b, keys).na.fill(0.0, ["wa", "wb"])


def pearson(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    return _filled(a, b, keys).groupBy(*keys).agg(F.corr("wa", "wb").alias("similarity"))


def _mean_rank(value: str, keys):
    parts = [*keys] or [F.lit(1)]
    order = F.rank().over(Window.partitionBy(*parts).orderBy(value))
    return order + (F.count("*").over(Window.partitionBy(*parts, value)) - 1) / 2


def spearman(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """Correlation of mean ranks over all edges of either network. A network has at most L (L - 1) / 2 edges."""
    both = _filled(a, b, keys).withColumn("ra", _mean_rank("wa", keys)).withColumn("rb", _mean_rank("wb", keys))
    return both.groupBy(*keys).agg(F.corr("ra", "rb").alias("similarity"))


def adjacency_difference(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """(*keys, p1, p2, diff) of the adjacency matrices, each column scaled to sum 1."""
    both = _filled(a, b, keys)
    by = Window.partitionBy(*keys, "p2")
    part = lambda w: F.col(w) / F.greatest(F.sum(w).over(by), F.lit(1e-8))
    return both.select(*keys, "p1", "p2", (part("wa") - part("wb")).alias("diff"))


def frobenius(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    d = adjacency_difference(a, b, keys)
    return d.groupBy(*keys).agg((1 / (1 + F.sqrt(F.sum(F.col("diff") * F.col("diff"))))).alias("similarity"))


def _singular(a, b, keys, take):
    d = adjacency_difference(a, b, keys)
    keys = list(keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(frame[["p1", "p2"]])
        m = np.zeros((len(nodes), len(nodes)))
        m[np.searchsorted(nodes, frame["p1"]), np.searchsorted(nodes, frame["p2"])] = frame["diff"]
        out = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame(out | {"similarity": [1 / (1 + take(np.linalg.svd(m, compute_uv=False)))]})

    types = dict(d.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in keys) + "similarity double"
    if keys:
        return d.groupBy(*keys).applyInPandas(run, schema)
    return d.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(lambda f: run(f), schema)


def spectral(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    return _singular(a, b, keys, lambda s: float(s.max(initial=0.0)))


def nuclear(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    return _singular(a, b, keys, lambda s: float(s.sum()))


SIMILARITIES = {"jaccard": jaccard, "pearson": pearson, "spearman": spearman, "frobenius": frobenius, "spectral": spectral, "nuclear": nuclear}


def similarity(a: DataFrame, b: DataFrame, method: str = "spearman", keys=()) -> DataFrame:
    if method not in SIMILARITIES:
        raise ValueError(f"no such similarity: {method}")
    return SIMILARITIES[method](a, b, keys)


def reproducibility_halves(edges: DataFrame, method: str = "spearman", keys=("split",), of: DataFrame | None = None) -> DataFrame:
    """(*keys, similarity) of the networks of each split's two halves, 'a' and 'b'.

    ``of``: the networks before they were pruned; a split whose halves pruning empties has similarity 0.
    """
    half = lambda s: edges.where(F.col("subset") == s).select(*keys, "p1", "p2", "weight")
    got = similarity(half("a"), half("b"), method, keys)
    if of is None:
        return got
    known = got.withColumn("__known", F.lit(True))
    every = of.select(*keys).distinct().join(known, list(keys), "left")
    return every.select(*keys, F.when(F.col("__known"), F.col("similarity")).otherwise(0.0).alias("similarity"))


def reproducibility_bootstrap(edges: DataFrame, method: str = "spearman", split: str = "split") -> DataFrame:
    """One row: the mean similarity over all pairs of bootstrap networks (a fixed number of splits, not of rows)."""
    splits = edges.select(split).distinct()
    pairs = splits.select(F.col(split).alias("x")).crossJoin(splits.select(F.col(split).alias("y"))).where("x < y")
    take = lambda s: edges.join(pairs, F.col(split) == F.col(s)).select("x", "y", "p1", "p2", "weight")
    return similarity(take("x"), take("y"), method, ("x", "y")).agg(F.avg("similarity").alias("similarity"))
