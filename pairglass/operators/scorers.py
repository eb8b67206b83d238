"""Scores of pairs of columns from counts: the mutual-information family, chi-squared and statistical coupling.

``single`` (*keys, pos, sym, n) and ``pair`` (*keys, p1, p2, s1, s2, n) are sparse. An estimate mixes a share rho of
the prior q into the frequencies: P_i(a) = (1 - rho) f_i(a) + rho q(a), P_ij(a, b) = (1 - rho) f_ij(a, b) + rho q(a) q(b).
Symbols that don't occur are accounted for in closed form, so tables are never filled to 441 cells for entropies.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.store import settle
from .alignment import ALPHABET, GAP
from .counts import mixing_share, prior, symbol_table, xlogx


@dataclass(frozen=True)
class Counts:
    """Counts of the columns to be scored, and how priors are mixed in."""

    single: DataFrame
    pair: DataFrame
    kind: str = "none"
    mix: float = 0.5
    lam: float = 1.0
    keys: tuple[str, ...] = ()

    def share(self, total: Column) -> Column:
        return mixing_share(self.kind, total, self.mix, self.lam)

    def settled(self) -> Counts:
        """Both tables written once: they are small, and every score reads them several times."""
        return replace(self, single=settle(self.single, "singles"), pair=settle(self.pair, "pairs"))

    def prior(self) -> dict[str, float]:
        return prior(self.kind, self.single)


def _totals(c: Counts) -> DataFrame:
    """(*keys, total): the sum of weights, the same in every column."""
    return c.single.groupBy(*c.keys, "pos").agg(F.sum("n").alias("t")).groupBy(*c.keys).agg(F.max("t").alias("total"))


def _with(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Join one row for each of ``keys``; without keys, the one row."""
    return df.join(F.broadcast(other), list(keys)) if keys else df.crossJoin(F.broadcast(other))


def column_entropies(c: Counts) -> DataFrame:
    """(*keys, pos, h, total)."""
    q = c.prior()
    t = _with(c.single, _totals(c), c.keys).withColumn("rho", c.share(F.col("total")))
    u = F.col("rho") * symbol_table(q)[F.col("sym")]
    p = (1 - F.col("rho")) * F.col("n") / F.col("total") + u
    logs = sum(v * math.log(v) for v in q.values() if v > 0)
    every = F.when(F.first("rho") > 0, F.first("rho") * F.log(F.first("rho")) + F.first("rho") * logs).otherwise(0.0)
    return t.groupBy(*c.keys, "pos").agg((-(every + F.sum(xlogx(p) - xlogx(u)))).alias("h"), F.first("total").alias("total"))


def joint_entropies(c: Counts) -> DataFrame:
    """(*keys, p1, p2, hij)."""
    q = c.prior()
    table = symbol_table(q)
    t = _with(c.pair, _totals(c), c.keys).withColumn("rho", c.share(F.col("total")))
    u = F.col("rho") * table[F.col("s1")] * table[F.col("s2")]
    p = (1 - F.col("rho")) * F.col("n") / F.col("total") + u
    logs = 2 * sum(v * math.log(v) for v in q.values() if v > 0)
    every = F.when(F.first("rho") > 0, F.first("rho") * F.log(F.first("rho")) + F.first("rho") * logs).otherwise(0.0)
    return t.groupBy(*c.keys, "p1", "p2").agg((-(every + F.sum(xlogx(p) - xlogx(u)))).alias("hij"))


def _sides(df: DataFrame, columns: DataFrame, keys, names: dict[str, str]) -> DataFrame:
    """Join ``columns`` (*keys, pos, ...) to p1 and p2; names: column to its stem, which gets 1 or 2 appended."""
    for side in ("1", "2"):
        own = columns.select(*keys, F.col("pos").alias(f"p{side}"), *(F.col(k).alias(f"{v}{side}") for k, v in names.items()))
        df = df.join(own, [*keys, f"p{side}"])
    return df


def mi(c: Counts) -> DataFrame:
    """(*keys, p1, p2, score, hij): mutual information in nats over 21 symbols."""
    both = _sides(joint_entropies(c), column_entropies(c), c.keys, {"h": "h"})
    return both.select(*c.keys, "p1", "p2", (F.col("h1") + F.col("h2") - F.col("hij")).alias("score"), "hij")


def _score(df: DataFrame, keys, value: Column) -> DataFrame:
    return df.select(*keys, "p1", "p2", value.alias("score"))


def nmi(c: Counts, of: DataFrame | None = None) -> DataFrame:
    m = mi(c) if of is None else of
    return _score(m, c.keys, F.when(F.abs("hij") > 1e-12, F.col("score") / F.col("hij")).otherwise(0.0))


def symmetric(df: DataFrame, keys=(), value: str = "score") -> DataFrame:
    """(*keys, pos, other, value) with each pair from both sides."""
    one = df.select(*keys, F.col("p1").alias("pos"), F.col("p2").alias("other"), value)
    return one.union(df.select(*keys, "p2", "p1", value))


def column_stats(df: DataFrame, keys=(), value: str = "score") -> DataFrame:
    """(*keys, pos, m, v): mean and population variance of the scores that touch a column."""
    return symmetric(df, keys, value).groupBy(*keys, "pos").agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))


def product_z(df: DataFrame, keys=(), value: str = "score") -> DataFrame:
    """``df`` with z: the score against the product of the two columns' normal distributions; 0 without variance."""
    both = _sides(df, column_stats(df, keys, value), keys, {"m": "m", "v": "v"})
    total = F.col("v1") + F.col("v2")
    mean = (F.col("m1") * F.col("v2") + F.col("m2") * F.col("v1")) / total
    return both.withColumn("z", F.when((F.col("v1") > 0) & (F.col("v2") > 0), (F.col(value) - mean) / F.sqrt(F.col("v1") * F.col("v2") / total)).otherwise(0.0))


def znmi(c: Counts, of: DataFrame | None = None) -> DataFrame:
    return _score(product_z(nmi(c, of), c.keys), c.keys, F.col("z"))


def apc(df: DataFrame, keys=(), value: str = "score") -> DataFrame:
    """Average product correction: the score less the product of its columns' means over the mean of all."""
    both = _sides(df, column_stats(df, keys, value), keys, {"m": "m"})
    both = _with(both, df.groupBy(*keys).agg(F.avg(value).alias("mean")), keys)
    return _score(both, keys, F.when(F.col("mean") != 0, F.col(value) - F.col("m1") * F.col("m2") / F.col("mean")).otherwise(F.col(value)))


def mip(c: Counts, of: DataFrame | None = None) -> DataFrame:
    return apc(mi(c) if of is None else of, c.keys)


def mic(c: Counts, of: DataFrame | None = None) -> DataFrame:
    """Mutual information less the pairs' coupling through all other columns, over the root of its mean."""
    m = mi(c) if of is None else of
    s = symmetric(m, c.keys)
    a = s.select(*c.keys, F.col("other").alias("k"), F.col("pos").alias("p1"), F.col("score").alias("x"))
    b = s.select(*c.keys, F.col("other").alias("k"), F.col("pos").alias("p2"), F.col("score").alias("y"))
    through = a.join(b, [*c.keys, "k"]).where("p1 < p2").groupBy(*c.keys, "p1", "p2").agg(F.sum(F.col("x") * F.col("y")).alias("cps"))
    n = m.groupBy(*c.keys).agg(((1 + F.sqrt(1 + 8 * F.count("*"))) / 2 - 2).alias("others"))
    both = m.join(through, [*c.keys, "p1", "p2"], "left").withColumn("cps", F.coalesce("cps", F.lit(0.0)))
    both = _with(both, n, c.keys).withColumn("cps", F.when(F.col("others") > 0, F.col("cps") / F.col("others")).otherwise(0.0))
    both = _with(both, both.groupBy(*c.keys).agg(F.avg("cps").alias("mean")), c.keys)
    return _score(both, c.keys, F.when(F.col("mean") > 0, F.col("score") - F.col("cps") / F.sqrt("mean")).otherwise(F.col("score")))


def residuals(m: DataFrame, keys=(), sample: int | None = None) -> DataFrame:
    """(*keys, p1, p2, r): of the regression of scores on the products of their columns' means.

    ``sample``: fit on so many pairs, in the order of an md5, at most.
    """
    both = _sides(m, column_stats(m, keys), keys, {"m": "m"}).withColumn("x", F.col("m1") * F.col("m2"))
    fitted = both
    if sample is not None:
        from pyspark.sql import Window

        order = F.md5(F.concat_ws("|", F.lit("rpmi"), F.col("p1"), F.col("p2")))
        if keys:  # tasks keep as many rows a key before they are shuffled
            by = Window.partitionBy(*keys).orderBy(order, "p1", "p2")
            fitted = both.withColumn("__place", F.row_number().over(by)).where(F.col("__place") <= sample)
        else:
            fitted = both.orderBy(order, "p1", "p2").limit(sample)
    line = fitted.groupBy(*keys).agg(F.regr_slope("score", "x").alias("slope"), F.regr_intercept("score", "x").alias("intercept"))
    both = _with(both, line, keys)
    return both.select(*keys, "p1", "p2", (F.col("score") - F.col("slope") * F.col("x") - F.col("intercept")).alias("r"))


def zres(c: Counts, of: DataFrame | None = None) -> DataFrame:
    m = settle(mi(c), "mi") if of is None else of
    r = settle(residuals(m, c.keys), "residuals")
    both = _sides(r, column_stats(r, c.keys, "r"), c.keys, {"m": "m", "v": "v"})
    z1, z2 = (F.col("r") - F.col("m1")) / F.sqrt("v1"), (F.col("r") - F.col("m2")) / F.sqrt("v2")
    value = F.when((z1 > 0) & (z2 > 0), z1 * z2).otherwise(-F.abs(z1 * z2))
    return _score(both, c.keys, F.when((F.col("v1") > 0) & (F.col("v2") > 0), value).otherwise(0.0))


@F.pandas_udf(DoubleType())
def right_tail(z: pd.Series) -> pd.Series:
    """Of the standard normal distribution."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore")


def rpmi(c: Counts, of: DataFrame | None = None, sample: int = 5000, pvalues: bool = True) -> DataFrame:
    """Residuals above both columns' means as z of the product distribution, others 0; p-values by Bonferroni, 1 for 0."""
    r = settle(residuals(mi(c) if of is None else of, c.keys, sample), "residuals")
    r = product_z(r, c.keys, "r")
    score = F.when((F.col("r") > F.col("m1")) & (F.col("r") > F.col("m2")), F.col("z")).otherwise(0.0)
    r = _score(r, c.keys, score)
    if not pvalues:
        return r
    r = settle(r, "rpmi")
    n = r.groupBy(*c.keys).agg(F.sum((F.col("score") != 0).cast("int")).alias("tests"))
    p = F.when(F.col("score") != 0, F.least(F.lit(1.0), F.col("tests") * right_tail(F.col("score")))).otherwise(1.0)
    return _with(r, n, c.keys).select(*c.keys, "p1", "p2", "score", p.alias("pvalue"))


def fchisq(c: Counts) -> DataFrame:
    """Sum over occurring cells of (P_ij - P_i P_j)^2 / (P_i P_j).

    With a prior every cell of symbols with q > 0 occurs; their part of the sum over cells that weren't counted is
    taken in closed form from the columns' marginals.
    """
    q = c.prior()
    table = symbol_table(q)
    rho = c.share(F.col("total"))
    t = _with(c.single, _totals(c), c.keys).withColumn("rho", rho)
    p = t.withColumn("u", F.col("rho") * table[F.col("sym")]).withColumn("p", (1 - F.col("rho")) * F.col("n") / F.col("total") + F.col("u"))
    p = p.withColumn("q", table[F.col("sym")])
    # Sums of q^2 / P and P over symbols with q > 0: of symbols that don't occur P is rho q.
    open_ = F.lit(sum(v for v in q.values())) - F.sum(F.when(F.col("q") > 0, F.col("q")).otherwise(0.0))
    col = p.groupBy(*c.keys, "pos").agg(
        (F.sum(F.when(F.col("q") > 0, F.col("q") ** 2 / F.col("p")).otherwise(0.0)) + F.when(F.first("rho") > 0, open_ / F.first("rho")).otherwise(0.0)).alias("a"),
        (F.sum(F.when(F.col("q") > 0, F.col("p")).otherwise(0.0)) + F.first("rho") * open_).alias("b"),
    )
    pair = _with(c.pair, _totals(c), c.keys).withColumn("rho", rho)
    pair = pair.withColumn("q1", table[F.col("s1")]).withColumn("q2", table[F.col("s2")]).withColumn("u", F.col("rho") * F.col("q1") * F.col("q2"))
    pair = pair.withColumn("o", (1 - F.col("rho")) * F.col("n") / F.col("total") + F.col("u"))
    for side in ("1", "2"):
        own = p.select(*c.keys, F.col("pos").alias(f"p{side}"), F.col("sym").alias(f"s{side}"), F.col("p").alias(f"e{side}"))
        pair = pair.join(own, [*c.keys, f"p{side}", f"s{side}"])
    e = F.col("e1") * F.col("e2")
    held = F.col("u") > 0
    seen = pair.groupBy(*c.keys, "p1", "p2").agg(
        F.sum((F.col("o") - e) ** 2 / e).alias("seen"), F.sum(F.when(held, F.col("u") ** 2 / e).otherwise(0.0)).alias("x"),
        F.sum(F.when(held, F.col("u")).otherwise(0.0)).alias("y"), F.sum(F.when(held, e).otherwise(0.0)).alias("z"), F.first("rho").alias("rho"),
    )
    both = _sides(seen, col, c.keys, {"a": "a", "b": "b"})
    rest = F.col("rho") ** 2 * F.col("a1") * F.col("a2") - F.col("x") - 2 * (F.col("rho") - F.col("y")) + F.col("b1") * F.col("b2") - F.col("z")
    return _score(both, c.keys, F.col("seen") + F.when(F.col("rho") > 0, rest).otherwise(0.0))


def sca(c: Counts) -> DataFrame:
    """Statistical coupling of each column's most frequent residue, weighted against its background frequency."""
    from pyspark.sql import Window

    from .counts import BACKGROUND

    best = Window.partitionBy(*c.keys, "pos").orderBy(F.desc("n"), F.instr(F.lit(ALPHABET), F.col("sym")))
    top = c.single.where(F.col("sym") != GAP).withColumn("place", F.row_number().over(best)).where("place = 1")
    top = _with(top, _totals(c), c.keys).withColumn("f", F.col("n") / F.col("total"))
    total = sum(BACKGROUND.values())
    q = symbol_table({s: v / total for s, v in BACKGROUND.items()})[F.col("sym")]
    w = F.log(F.col("f") * (1 - q) / (q * (1 - F.col("f"))))
    top = top.withColumn("w", F.when(F.col("f") < 1, w).otherwise(0.0)).select(*c.keys, "pos", "sym", "f", "w", "total")
    pair = c.pair
    both = pair.select(*c.keys, "p1", "p2").distinct()
    for side in ("1", "2"):
        own = top.select(*c.keys, F.col("pos").alias(f"p{side}"), F.col("sym").alias(f"s{side}"), F.col("f").alias(f"f{side}"), F.col("w").alias(f"w{side}"), F.col("total").alias(f"t{side}"))
        both = both.join(own, [*c.keys, f"p{side}"])
    both = both.join(pair, [*c.keys, "p1", "p2", "s1", "s2"], "left")
    f = F.coalesce("n", F.lit(0.0)) / F.col("t1")
    return _score(both, c.keys, F.col("w1") * F.col("w2") * F.abs(f - F.col("f1") * F.col("f2")))


def covariance(c: Counts) -> DataFrame:
    """(*keys, p1, p2, s1, s2, cov) for the cells that occur: P_ij - P_i P_j."""
    table = symbol_table(c.prior())
    rho = c.share(F.col("total"))
    p = _with(c.single, _totals(c), c.keys).withColumn("rho", rho)
    p = p.withColumn("p", (1 - F.col("rho")) * F.col("n") / F.col("total") + F.col("rho") * table[F.col("sym")])
    pair = _with(c.pair, _totals(c), c.keys).withColumn("rho", rho)
    pair = pair.withColumn("o", (1 - F.col("rho")) * F.col("n") / F.col("total") + F.col("rho") * table[F.col("s1")] * table[F.col("s2")])
    for side in ("1", "2"):
        own = p.select(*c.keys, F.col("pos").alias(f"p{side}"), F.col("sym").alias(f"s{side}"), F.col("p").alias(f"e{side}"))
        pair = pair.join(own, [*c.keys, f"p{side}", f"s{side}"])
    return pair.select(*c.keys, "p1", "p2", "s1", "s2", (F.col("o") - F.col("e1") * F.col("e2")).alias("cov"))


SCORERS: dict[str, Callable[[Counts], DataFrame]] = {"mi": lambda c: mi(c).drop("hij"), "nmi": nmi, "znmi": znmi, "mic": mic, "mip": mip, "zres": zres, "rpmi": rpmi, "fchisq": fchisq, "sca": sca}


def register_scorer(name: str, scorer: Callable[[Counts], DataFrame]) -> None:
    SCORERS[name] = scorer


def score(c: Counts, method: str) -> DataFrame:
    """(*keys, p1, p2, score, pvalue); p-values are 1 where a method has none."""
    if method not in SCORERS:
        raise ValueError(f"no such score: {method}")
    got = SCORERS[method](c)
    return got if "pvalue" in got.columns else got.withColumn("pvalue", F.lit(1.0))
