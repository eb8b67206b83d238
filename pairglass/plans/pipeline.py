"""Resample an alignment, score all pairs of columns of every part in one job, and measure accuracy and reproducibility."""

from __future__ import annotations

import functools
import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy as acc
from ..operators import graphs
from ..operators.alignment import cells, column_stats, load, map_to_canonical, reduced_columns, stats_of_counts
from ..operators.counts import henikoff_share, of_tables, pairs, single_counts, singles
from ..operators.resample import resample, tables
from ..operators.scorers import SCORERS, Counts, score
from ..operators.weights import sequence_weights, weights_of_tables
from ..sources.store import settle

KEYS = ("split", "subset")
log = logging.getLogger("pairglass")


def logged(event: str):
    """Log calls of a function; a second one of the same event in a row isn't logged again."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            if getattr(log, "last", None) != event:
                log.info("%s %s", event, " ".join(f"{k}={v}" for k, v in kwargs.items()))
                log.last = event
            return f(*args, **kwargs)

        return run

    return wrap


@dataclass(frozen=True)
class Parameters:
    resampling_method: str = "splithalf"
    num_partitions: int = 100
    pc_type: str = "inc"
    pc_lambda: float = 1.0
    pc_mix: float = 0.1
    gap: float = 1.0
    swt_method: str = "henikoff"
    cutoff: float = 0.68
    pruning: str = "mst"
    number: int = 100
    acc_method: str = "avgdist"
    sim_method: str = "spearman"
    file_indicator: str = "run"

    def set(self, **changes) -> Parameters:
        return replace(self, **changes)


class Pipeline:
    def __init__(self, rows: DataFrame, canonical: str, options: Parameters = Parameters()):
        self.rows, self.canonical, self.options = load(rows.select("seq_id", "seq")), canonical, options
        self.length = len(self.rows.first()["seq"])

    @logged("resample")
    def resample(self) -> DataFrame:
        o = self.options
        return resample(self.rows, o.resampling_method, o.num_partitions, self.canonical)

    @logged("count")
    def counts(self, parts: DataFrame | None = None) -> Counts:
        """Counts of all resampled alignments, in one pass over the rows; or of ``parts``, rows with the keys."""
        o = self.options
        if parts is None:
            return self._counts_of_tables()
        parts = settle(parts, "parts")
        c = cells(parts, KEYS)
        kept = reduced_columns(column_stats(c, KEYS), o.gap).select(*KEYS, "pos")
        w = None if o.swt_method == "unweighted" else sequence_weights(parts, c, o.swt_method, o.cutoff, KEYS)
        return self._reduced(singles(c, w, KEYS), pairs(parts, self.length, w, KEYS), kept).settled()

    def _reduced(self, one: DataFrame, two: DataFrame, kept: DataFrame) -> Counts:
        o = self.options
        one = one.join(kept, [*KEYS, "pos"], "left_semi")
        for p in ("p1", "p2"):
            two = two.join(kept.withColumnRenamed("pos", p), [*KEYS, p], "left_semi")
        return Counts(one, two, o.pc_type, o.pc_mix, o.pc_lambda, KEYS)

    def _counts_of_tables(self) -> Counts:
        o = self.options
        t = tables(settle(self.rows, "rows"), o.resampling_method, o.num_partitions, self.canonical)
        plain = settle(single_counts(t.rows, t.names, self.length), "singles")  # what columns are kept, and Henikoff's weights, come from it
        kept = settle(reduced_columns(stats_of_counts(plain, KEYS), o.gap).select(*KEYS, "pos"), "kept")
        if o.swt_method == "unweighted":
            one, two = of_tables(t.rows, t.names, self.length, t.halves)
        elif o.swt_method == "henikoff":
            one, two = of_tables(t.rows, t.names, self.length, t.halves, henikoff_share(plain, t.names, self.length))
        elif o.swt_method in ("similarity", "symmpurge"):
            one, two = of_tables(weights_of_tables(t.rows, len(t.names), o.swt_method, o.cutoff), t.names, self.length, t.halves)
        else:
            raise ValueError(f"no such weights: {o.swt_method}")
        return self._reduced(one, two, kept).settled()

    @logged("score")
    def networks(self, methods, counts: Counts | None = None) -> DataFrame:
        """(method, split, subset, p1, p2, score, pvalue) by residues of the canonical sequence."""
        counts = self.counts() if counts is None else counts
        own = cells(self.rows.where(F.col("seq_id") == self.canonical))
        out = None
        for m in methods:
            if m not in SCORERS:
                raise ValueError(f"no such score: {m}")
            got = map_to_canonical(score(counts, m), own, self.canonical, check=False)
            got = got.select(F.lit(m).alias("method"), *KEYS, "p1", "p2", F.round("score", 8).alias("score"), "pvalue")
            got = settle(got, f"scores-{m}")
            out = got if out is None else out.unionByName(got)
        return out

    def pruned(self, networks: DataFrame) -> DataFrame:
        edges = networks.withColumnRenamed("score", "weight")
        return settle(graphs.prune(edges, self.options.pruning, self.options.number, ("method", *KEYS)), "pruned")

    @logged("accuracy")
    def accuracy(self, networks: DataFrame, contact: DataFrame, dist: DataFrame, compat: bool = False, within=()) -> DataFrame:
        """(method, split, accuracy): the mean over subsets; ``compat``: half of the last subset's, as first written.

        ``within``: keys of ``dist`` that part it into structures; a subset's accuracy is then the mean over them.
        """
        m, keys = self.options.acc_method, ("method", *KEYS)
        if m in ("contact", "avgdist"):
            networks = self.pruned(networks).withColumnRenamed("weight", "score")
        by = acc.accuracy(networks, m, contact, dist, keys, within)
        if within:
            by = by.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))
        value = F.max_by("accuracy", "subset") / F.count("*") if compat else F.avg("accuracy")
        return by.groupBy("method", "split").agg(value.alias("accuracy"))

    @logged("reproducibility")
    def reproducibility(self, networks: DataFrame) -> DataFrame:
        """(method, split, reproducibility); for bootstrap one row of split 0 for each method."""
        o, edges = self.options, self.pruned(networks)
        if o.resampling_method == "splithalf":
            got = graphs.reproducibility_halves(edges, o.sim_method, ("method", "split"), networks)
            return got.withColumnRenamed("similarity", "reproducibility")
        if o.resampling_method == "bootstrap":
            out = None
            for (m,) in edges.select("method").distinct().collect():
                one = graphs.reproducibility_bootstrap(edges.where(F.col("method") == m), o.sim_method)
                one = one.select(F.lit(m).alias("method"), F.lit(0).alias("split"), F.col("similarity").alias("reproducibility"))
                out = one if out is None else out.union(one)
            return out
        raise ValueError("reproducibility needs splithalf or bootstrap")

    def consensus(self, networks: DataFrame) -> DataFrame:
        return graphs.consensus(self.pruned(networks), networks, KEYS, ("method",))

    def voted(self, networks: DataFrame) -> DataFrame:
        return graphs.borda(networks)


def vote_accuracy(scores: DataFrame, contact: DataFrame | None, dist: DataFrame, method: str = "avgdist", within=()) -> DataFrame:
    """(method, split, accuracy) of each method's scores, means over subsets, and of the ``voted`` network of each split."""
    voted = graphs.borda(scores).select(F.lit("voted").alias("method"), "split", F.lit("").alias("subset"), "p1", "p2", F.col("weight").alias("score"))
    every = scores.select("method", *KEYS, "p1", "p2", "score").unionByName(voted)
    got = acc.accuracy(every, method, contact, dist, ("method", *KEYS), within)
    return got.groupBy("method", "split").agg(F.avg("accuracy").alias("accuracy"))


def plot_data(accuracy: DataFrame, reproducibility: DataFrame) -> DataFrame:
    return accuracy.join(reproducibility, ["method", "split"]).select("method", "split", "accuracy", "reproducibility")


def axis_limits(df: DataFrame, value: str, share: float = 0.2) -> DataFrame:
    """(low, high): the range, widened by ``share`` of it."""
    r = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    wide = share * (F.col("b") - F.col("a"))
    return r.select((F.col("a") - wide).alias("low"), (F.col("b") + wide).alias("high"))


def density(df: DataFrame, value: str, low: float, high: float, points: int = 256) -> DataFrame:
    """(x, density): Gaussian kernels of Scott's bandwidth at ``points`` places. The grid, of fixed size, is what is broadcast."""
    n = df.where(F.col(value).isNotNull()).agg((F.pow(F.count(value), F.lit(-0.2)) * F.stddev_samp(value)).alias("h"))
    grid = df.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col(value)) / F.col("h")
    rows = df.where(F.col(value).isNotNull()).select(value).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(grid))
    return rows.groupBy("x").agg((F.avg(F.exp(-z * z / 2)) / (F.first("h") * F.sqrt(2 * F.pi()))).alias("density"))


def network_plot(edges: DataFrame, least: float) -> DataFrame:
    """Consensus edges of ``least`` or more with the opacity to draw them in."""
    kept = edges.where(F.col("weight") >= least)
    r = kept.agg(F.min("weight").alias("a"), F.max("weight").alias("b"))
    alpha = F.when(F.col("b") > F.col("a"), 0.2 + 0.8 * (F.col("weight") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(1.0)
    return kept.crossJoin(F.broadcast(r)).select("p1", "p2", "weight", alpha.alias("alpha"))
