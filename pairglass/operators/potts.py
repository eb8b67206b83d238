"""Scores of inverse Potts models, ridge and sparse precision.

Pairs of columns are rows: their estimated tables of 441 cells are built from the counts in batches of pairs, and what
needs no more than a pair's own table (``ipdi``, direct information) is taken there. ``psicov`` parts its problem first:
states that no covariance above the penalty connects are independent, exactly, and each connected component is a task of
its own. The others invert the covariance of a whole alignment, in one task for each of ``keys``: its size is that of the
columns, however many sequences there were.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import settle
from .alignment import ALPHABET
from .graphs import components
from .scorers import SCORERS, Counts, apc

Q = len(ALPHABET)
RIDGE_RHO = 0.005
LASSO_ALPHA = 0.1


def estimates(single: pd.DataFrame, pair: pd.DataFrame, share, q: np.ndarray):
    """(columns, P_i, P_ij) with the diagonal blocks; share: of the prior, from the sum of weights."""
    code = {s: k for k, s in enumerate(ALPHABET)}
    cols = np.sort(single["pos"].unique())
    at = {p: k for k, p in enumerate(cols)}
    m = len(cols)
    pi, pij = np.zeros((m, Q)), np.zeros((m, m, Q, Q))
    pi[single["pos"].map(at), single["sym"].map(code)] = single["n"]
    pair = pair[pair["p1"].isin(at) & pair["p2"].isin(at)]
    i, j, a, b = pair["p1"].map(at), pair["p2"].map(at), pair["s1"].map(code), pair["s2"].map(code)
    pij[i, j, a, b] = pair["n"]
    pij[j, i, b, a] = pair["n"]
    k = np.arange(m)
    pij[k, k] = pi[:, :, None] * np.eye(Q)
    total = pi[0].sum() if m else 1.0
    rho = share(total)
    pi = (1 - rho) * pi / total + rho * q
    pij = (1 - rho) * pij / total + rho * q[:, None] * q
    pij[k, k] = pi[:, :, None] * np.eye(Q)
    return cols, pi, pij


def blocks_to_matrix(x: np.ndarray) -> np.ndarray:
    m, _, a, b = x.shape
    return x.transpose(0, 2, 1, 3).reshape(m * a, m * b)


def matrix_to_blocks(x: np.ndarray, q: int) -> np.ndarray:
    m = len(x) // q
    return x.reshape(m, q, m, q).transpose(0, 2, 1, 3)


def covariance_blocks(pi: np.ndarray, pij: np.ndarray) -> np.ndarray:
    return pij - pi[:, None, :, None] * pi[None, :, None, :]


class NotSettled(ArithmeticError):
    """An iteration didn't reach its tolerance."""


def direct_information(e: np.ndarray, p: np.ndarray, r: np.ndarray, tolerance: float = 1e-4, most: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(information, settled) of two-site models with couplings e (B, 20, 20) and marginals p, r (B, 21).

    Marginals are fitted by turns until no step moves one by more than ``tolerance``; pairs that haven't settled after
    ``most`` steps are marked, and their value means nothing. Couplings that aren't finite give not-a-number.
    """
    w = np.ones((len(e), Q, Q))
    with np.errstate(over="ignore", invalid="ignore"):
        w[:, : Q - 1, : Q - 1] = np.exp(-e)
        x, y = np.full((len(e), Q), 1 / Q), np.full((len(e), Q), 1 / Q)
        live = np.isfinite(w).all((1, 2))
        for _ in range(most):
            k = np.flatnonzero(live)
            if not len(k):
                break
            nx = p[k] / np.einsum("bij,bj->bi", w[k], y[k])
            nx /= nx.sum(1, keepdims=True)
            ny = r[k] / np.einsum("bij,bi->bj", w[k], x[k])  # both from the step before
            ny /= ny.sum(1, keepdims=True)
            moved = np.maximum(np.abs(nx - x[k]).max(1), np.abs(ny - y[k]).max(1))
            x[k], y[k] = nx, ny
            live[k[~(moved > tolerance)]] = False
        joint = w * x[:, :, None] * y[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        xlx = lambda t: np.where(t > 0, t * np.log(np.where(t > 0, t, 1)), 0)
        outer = p[:, :, None] * r[:, None, :]
        cross = np.where(joint > 0, joint * np.log(np.where(outer > 0, outer, 1)), 0)
        out = (xlx(joint) - cross).sum((1, 2))
    return np.where(np.isfinite(w).all((1, 2)), out, np.nan), ~live


def settled_information(e: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ma.MaskedArray:
    """Direct information with the pairs that haven't settled masked."""
    value, settled = direct_information(e, p, r)
    return np.ma.array(value, mask=~settled)


def _pairs(m: int):
    return np.triu_indices(m, 1)


def _inverse(cov: np.ndarray) -> np.ndarray:
    """The inverse of the covariance without the gap's state, as blocks."""
    c = blocks_to_matrix(cov[:, :, : Q - 1, : Q - 1])
    return matrix_to_blocks(np.linalg.inv(c), Q - 1)


def nmf(pi, pij):
    w = -_inverse(covariance_blocks(pi, pij))
    i, j = _pairs(len(pi))
    w = w[i, j]
    s, t = w.sum(1, keepdims=True), w.sum(2, keepdims=True)
    g = w - s.transpose(0, 2, 1) @ s - t @ t.transpose(0, 2, 1) + w.sum((1, 2), keepdims=True)
    return np.sqrt((g * g).sum((1, 2)))


def nmfdi(pi, pij):
    i, j = _pairs(len(pi))
    return settled_information(_inverse(covariance_blocks(pi, pij))[i, j], pi[i], pi[j])


def _margins(pi):
    i, j = _pairs(len(pi))
    return i, j, pi[i][:, : Q - 1, None], pi[j][:, None, : Q - 1]


def pair_coupling(c, p, r):
    """The coupling of two two-state sites from their covariance."""
    return np.log((1 + c / (p * r)) * (1 + c / ((1 - p) * (1 - r))) / ((1 - c / ((1 - p) * r)) * (1 - c / (p * (1 - r)))))


def ipdi(p: np.ndarray, r: np.ndarray, joint: np.ndarray) -> np.ma.MaskedArray:
    """From marginals p, r (B, 21) and tables ``joint`` (B, 21, 21) of pairs, each by itself."""
    c = (joint - p[:, :, None] * r[:, None, :])[:, : Q - 1, : Q - 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        e = pair_coupling(c, p[:, : Q - 1, None], r[:, None, : Q - 1])
    return settled_information(e, p, r)


def smdi(pi, pij):
    i, j, p, r = _margins(pi)
    cov = covariance_blocks(pi, pij)
    c = cov[i, j][:, : Q - 1, : Q - 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        e = -_inverse(cov)[i, j] + pair_coupling(c, p, r) - c / (p * (1 - p) * r * (1 - r) - c * c)
    return settled_information(e, pi[i], pi[j])


def tapdi(pi, pij):
    """Not a number where the square root has no real value."""
    i, j, p, r = _margins(pi)
    x, y = 1 - 2 * p, 1 - 2 * r
    with np.errstate(invalid="ignore", divide="ignore"):
        e = (np.sqrt(1 - 2 * x * y * _inverse(covariance_blocks(pi, pij))[i, j]) - 1) / (x * y)
    return settled_information(e, pi[i], pi[j])


def prior_covariance(s: np.ndarray, kind: str = "dense") -> np.ndarray:
    """The mean variance on the diagonal; for 'dense' also the mean of the upper triangle, diagonal included, off it."""
    n = len(s)
    out = np.eye(n) * np.diag(s).mean()
    if kind == "dense" and n > 1:
        out += (1 - np.eye(n)) * 2 * np.triu(s).sum() / (n * (n - 1))
    elif kind not in ("dense", "diagonal"):
        raise ValueError(f"no such prior: {kind}")
    return out


def shrink(prior: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, float]:
    """``s`` with the least share 0.01 * 1.1^k of the prior for which it is positive definite."""
    rho = 0.01
    while rho < 1:
        mixed = rho * prior + (1 - rho) * s
        try:
            np.linalg.cholesky(mixed)
            return mixed, rho
        except np.linalg.LinAlgError:
            rho *= 1.1
    return prior, 1.0


def ridge(pi, pij, compat: bool = False):
    """Precision with an L2 penalty; ``compat``: the transposed product and a matrix square, as they were first written."""
    s = blocks_to_matrix(covariance_blocks(pi, pij))
    s, _ = shrink(prior_covariance(s), s)
    values, v = np.linalg.eigh(s)
    theta = (np.sqrt(values**2 + 8 * RIDGE_RHO) - values) / (4 * RIDGE_RHO)
    precision = (v.T * theta) @ v if compat else (v * theta) @ v.T
    i, j = _pairs(len(pi))
    w = matrix_to_blocks(precision, Q)[i, j][:, : Q - 1, : Q - 1]
    return (w @ w if compat else w * w).sum((1, 2))


def graphical_lasso(s: np.ndarray, alpha: float, rounds: int = 20_000, tolerance: float = 1e-8, start: np.ndarray | None = None) -> np.ndarray:
    """The sparse precision of ``s`` under an L1 penalty off the diagonal, by alternating directions; or ``NotSettled``.

    The penalty is let down to ``alpha`` in a few steps, each begun at the solution before it, and the weight of the
    constraint follows the residuals.
    """
    n = len(s)
    z, u, step = (np.diag(1 / np.diag(s)) if start is None else start), np.zeros((n, n)), 1.0
    top = max(np.abs(s - np.diag(np.diag(s))).max(initial=0.0), alpha)
    path = [a for a in top * 0.5 ** np.arange(1, 5) if a > alpha] + [alpha]
    off = 1 - np.eye(n)
    done = False
    for a in path:
        last = a == alpha
        for k in range(rounds):
            values, v = np.linalg.eigh(step * (z - u) - s)
            theta = (v * ((values + np.sqrt(values**2 + 4 * step)) / (2 * step))) @ v.T
            old, x = z, theta + u
            z = np.sign(x) * np.maximum(np.abs(x) - a / step * off, 0)
            u = u + theta - z
            primal, dual = np.abs(theta - z).max(), step * np.abs(z - old).max()
            if done := max(primal, dual) < (tolerance if last else 1e-3):
                break
            if k % 10 == 9 and k < 500 and not 0.1 < primal / max(dual, 1e-300) < 10:
                scale = 2.0 if primal > dual else 0.5
                step, u = step * scale, u / scale
    if not done:
        raise NotSettled(f"precision after {rounds} rounds")
    return z


#: Per-pair kernels of (marginals, marginals, tables), and those that need all of an alignment's columns together.
PAIRWISE = {"ipdi": ipdi}
KERNELS = {"nmf": nmf, "nmfdi": nmfdi, "smdi": smdi, "tapdi": tapdi, "ridge": ridge}
METHODS = ("nmf", "nmfdi", "ipdi", "smdi", "tapdi", "ridge", "psicov")


def _share(c: Counts):
    kind, mix, lam = c.kind, c.mix, c.lam
    return lambda total: {"none": 0.0, "fix": 21 * lam / (21 * lam + total)}.get(kind, mix)


def _types(c: Counts) -> str:
    types = dict(c.pair.dtypes)
    return "".join(f"{k} {types[k]}, " for k in c.keys)


def _columns(c: Counts) -> DataFrame:
    """(*keys, pos, p): the estimated distribution of each column as 21 little-endian doubles."""
    q, share = np.array([c.prior()[s] for s in ALPHABET]), _share(c)

    def run(batches):
        for b in batches:
            out = []
            for cells in b.column("cells").to_pylist():
                n = np.zeros(Q)
                for x in cells:
                    n[ALPHABET.index(x["sym"])] = x["n"]
                rho = share(n.sum())
                out.append(((1 - rho) * n / n.sum() + rho * q).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in c_keys), b.column("pos"), pa.array(out, pa.binary())], names=[*c_keys, "pos", "p"])

    c_keys = list(c.keys)
    held = c.single.groupBy(*c_keys, "pos").agg(F.collect_list(F.struct("sym", "n")).alias("cells"))  # 21 at most
    return held.mapInArrow(run, f"{_types(c)}pos int, p binary")


def pair_tables(c: Counts, *more) -> DataFrame:
    """(*keys, p1, p2, cells, a, b): each pair's counts (at most 441) and its columns' distributions, as one row.

    ``more``: further columns of ``_columns`` that both sides get, with 1 or 2 behind their names.
    """
    cells = c.pair.groupBy(*c.keys, "p1", "p2").agg(F.collect_list(F.struct("s1", "s2", "n")).alias("cells"))
    columns = settle(_columns(c), "columns")
    for side, name in (("1", "a"), ("2", "b")):
        own = columns.select(*c.keys, F.col("pos").alias(f"p{side}"), F.col("p").alias(name))
        cells = cells.join(own, [*c.keys, f"p{side}"])
    return cells


#: Pairs whose tables a task holds at once.
BATCH = 512


def _tables(batch, share, q):
    """(p, r, joint) of a batch of ``pair_tables`` rows."""
    read = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), "<f8").reshape(-1, Q)
    code = np.zeros(128, np.int64)
    code[[ord(s) for s in ALPHABET]] = np.arange(Q)
    lists = batch.column("cells")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    at = lambda name: code[np.frombuffer("".join(flat.field(name).to_pylist()).encode(), np.uint8)]
    joint = np.zeros((batch.num_rows, Q, Q))
    joint[row, at("s1"), at("s2")] = flat.field("n").to_numpy()
    total = joint.sum((1, 2))
    rho = np.array([share(t) for t in total])[:, None, None]
    return read("a"), read("b"), (1 - rho) * joint / total[:, None, None] + rho * q[:, None] * q


def pairwise_score(c: Counts, method: str) -> DataFrame:
    """(*keys, p1, p2, score) of one of ``PAIRWISE``: batches of pairs, however many columns and keys.

    A score without a real value is not a number; one that hasn't settled is null (see ``unsettled``).
    """
    kernel, share, keys = PAIRWISE[method], _share(c), list(c.keys)
    q = np.array([c.prior()[s] for s in ALPHABET])

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                got = kernel(*_tables(part, share, q))
                score = pa.array(got.data, mask=np.ma.getmaskarray(got))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (*keys, "p1", "p2")), score], names=[*keys, "p1", "p2", "score"])

    return pair_tables(c).mapInArrow(run, f"{_types(c)}p1 int, p2 int, score double")


def pair_couplings(c: Counts) -> DataFrame:
    """(*keys, p1, p2, s1, s2, coupling): the two-state couplings of ``ipdi`` for every pair of symbols other than gaps."""
    share, keys = _share(c), list(c.keys)
    q = np.array([c.prior()[s] for s in ALPHABET])
    symbols = pa.array(list(ALPHABET[: Q - 1]))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                p, r, joint = _tables(part, share, q)
                cov = (joint - p[:, :, None] * r[:, None, :])[:, : Q - 1, : Q - 1]
                with np.errstate(invalid="ignore", divide="ignore"):
                    e = pair_coupling(cov, p[:, : Q - 1, None], r[:, None, : Q - 1])
                k, x, y = (v.ravel() for v in np.indices(e.shape))
                cols = [part.column(n).take(pa.array(k)) for n in (*keys, "p1", "p2")]
                yield pa.RecordBatch.from_arrays([*cols, symbols.take(pa.array(x)), symbols.take(pa.array(y)), pa.array(e.ravel())], names=[*keys, "p1", "p2", "s1", "s2", "coupling"])

    return pair_tables(c).mapInArrow(run, f"{_types(c)}p1 int, p2 int, s1 string, s2 string, coupling double")


def unsettled(scores: DataFrame, keys=()) -> DataFrame:
    """(*keys, pairs, unsettled): how many scores are null because their iteration didn't reach its tolerance."""
    return scores.groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum(F.col("score").isNull().cast("long")).alias("unsettled"))


def _state(p, s):
    return p.astype(np.int64) * Q + s


def sparse_precision(c: Counts, alpha: float = LASSO_ALPHA) -> DataFrame:
    """(*keys, u, v, precision) for u < v, the entries off the diagonal that aren't 0; a state is pos * 21 + symbol.

    The estimate is of half the covariance and half its prior. Entries of at most ``alpha`` don't connect states, and
    the solution is 0 between states that no path of larger entries connects (exactly; no approximation), so each
    component is solved by itself in a task that holds no more than its own matrix. The prior needs only the variances:
    a pair's covariances sum to 0, so the whole triangle's sum is half the trace.
    """
    keys, types = list(c.keys), _types(c)
    share, q = _share(c), np.array([c.prior()[s] for s in ALPHABET])

    def entries(p, r, joint, off):
        return 0.5 * (joint - p[:, :, None] * r[:, None, :]) + 0.5 * off[:, None, None]

    def own_entries(p, mean, off):
        s = 0.5 * (np.eye(Q) * p[:, :, None] - p[:, :, None] * p[:, None, :]) + 0.5 * off[:, None, None] * (1 - np.eye(Q))
        return s + 0.5 * mean[:, None, None] * np.eye(Q)

    def traces(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column("p").to_pylist()), "<f8").reshape(-1, Q)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array((p * (1 - p)).sum(1))], names=[*keys, "t"])

    columns = settle(_columns(c), "columns")
    n = F.count("*") * Q
    mean = columns.mapInArrow(traces, f"{types}t double").groupBy(*keys).agg((F.sum("t") / n).alias("mean"), (F.sum("t") / (n * (n - 1))).alias("off"))
    mean = settle(mean, "priors")  # one row for each alignment
    with_mean = lambda df: df.join(F.broadcast(mean), keys) if keys else df.crossJoin(F.broadcast(mean))
    pairs, alone = with_mean(pair_tables(c)), with_mean(columns)

    def rows_of(batch, w, keep, extra=()):
        k, a, b = np.nonzero(keep)
        return k, a, b, w[k, a, b]

    def emit(b, k, u, v, w, names=("u", "v", "s"), more=()):
        cols = [b.column(x).take(pa.array(k)) for x in keys]
        return pa.RecordBatch.from_arrays([*cols, *more, pa.array(u), pa.array(v), pa.array(w)], names=[*keys, *[m for m in ("component",) if more], *names])

    def parts(batches):
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                yield b.slice(a, BATCH)

    def links(batches):
        for b in parts(batches):
            w = entries(*_tables(b, share, q), b.column("off").to_numpy())
            k, x, y, w = rows_of(b, w, np.abs(w) > alpha)
            yield emit(b, k, _state(b.column("p1").to_numpy()[k], x), _state(b.column("p2").to_numpy()[k], y), w)

    def own_links(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column("p").to_pylist()), "<f8").reshape(-1, Q)
            w = own_entries(p, b.column("mean").to_numpy(), b.column("off").to_numpy())
            k, x, y, w = rows_of(b, w, (np.abs(w) > alpha) & (np.arange(Q)[:, None] < np.arange(Q)))
            at = b.column("pos").to_numpy()[k]
            yield emit(b, k, _state(at, x), _state(at, y), w)

    schema = f"{types}u long, v long, s double"
    linked = settle(pairs.mapInArrow(links, schema).union(alone.mapInArrow(own_links, schema)), "links")
    nodes = settle(components(linked.select(*keys, "u", "v"), keys), "components")

    # The entries inside components: each column's states with their components, joined to both sides of a pair.
    held = nodes.groupBy(*keys, F.floor(F.col("node") / Q).cast("int").alias("pos")).agg(F.collect_list(F.struct((F.col("node") % Q).cast("int").alias("s"), "component")).alias("states"))
    side = lambda k: held.select(*keys, F.col("pos").alias(f"p{k}"), F.col("states").alias(f"states{k}"))

    def labels(column):
        out = np.full((len(column), Q), -1, np.int64)
        for k, states in enumerate(column.to_pylist()):
            for x in states:
                out[k, x["s"]] = x["component"]
        return out

    def inside(batches):
        for b in parts(batches):
            w = entries(*_tables(b, share, q), b.column("off").to_numpy())
            one, two = labels(b.column("states1")), labels(b.column("states2"))
            k, x, y, w = rows_of(b, w, (one[:, :, None] == two[:, None, :]) & (one[:, :, None] >= 0))
            yield emit(b, k, _state(b.column("p1").to_numpy()[k], x), _state(b.column("p2").to_numpy()[k], y), w, more=[pa.array(one[k, x])])

    def own_inside(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column("p").to_pylist()), "<f8").reshape(-1, Q)
            w = own_entries(p, b.column("mean").to_numpy(), b.column("off").to_numpy())
            one = labels(b.column("states"))
            k, x, y, w = rows_of(b, w, (one[:, :, None] == one[:, None, :]) & (one[:, :, None] >= 0) & (np.arange(Q)[:, None] <= np.arange(Q)))
            at = b.column("pos").to_numpy()[k]
            yield emit(b, k, _state(at, x), _state(at, y), w, more=[pa.array(one[k, x])])

    def solve(key, table):
        u, v = table["u"].to_numpy(), table["v"].to_numpy()
        states, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = at[: len(u)], at[len(u) :]
        s = np.zeros((len(states), len(states)))
        s[i, j] = s[j, i] = table["s"].to_numpy()
        z = graphical_lasso(s, alpha)
        a, b = np.nonzero(np.triu(z, 1))
        cols = {k: pa.repeat(x, len(a)) for k, x in zip(keys, key)}
        return pa.table(cols | {"u": pa.array(states[a]), "v": pa.array(states[b]), "precision": pa.array(z[a, b])})

    schema = f"{types}component long, u long, v long, s double"
    both = pairs.join(side(1), [*keys, "p1"]).join(side(2), [*keys, "p2"]).mapInArrow(inside, schema)
    both = both.union(alone.join(held, [*keys, "pos"]).mapInArrow(own_inside, schema))
    return both.groupBy(*keys, "component").applyInArrow(solve, f"{types}u long, v long, precision double")


def psicov(c: Counts, alpha: float = LASSO_ALPHA) -> DataFrame:
    """(*keys, p1, p2, score): sums of absolute precisions of two columns' states, gaps left out, for every pair."""
    got = sparse_precision(c, alpha)
    at = lambda x: F.floor(F.col(x) / Q).cast("int")
    got = got.where(f"u % {Q} < {Q - 1} and v % {Q} < {Q - 1}").select(*c.keys, at("u").alias("p1"), at("v").alias("p2"), F.abs("precision").alias("x"))
    got = got.where("p1 < p2").groupBy(*c.keys, "p1", "p2").agg(F.sum("x").alias("score"))
    every = c.pair.select(*c.keys, "p1", "p2").distinct()
    return every.join(got, [*c.keys, "p1", "p2"], "left").na.fill(0.0, ["score"])


def dense_score(c: Counts, method: str) -> DataFrame:
    """(*keys, p1, p2, score) of one of ``KERNELS``, an alignment in one task.

    A score without a real value (tapdi's square root) is not a number; one that hasn't settled is null.
    """
    kernel, share = KERNELS[method], _share(c)
    q = np.array([c.prior()[s] for s in ALPHABET])
    keys = list(c.keys)

    def run(key, table):
        frame = table.to_pandas()
        one = frame[frame["p2"].isna()].rename(columns={"p1": "pos", "s1": "sym"})
        two = frame[frame["p2"].notna()].astype({"p2": int})
        cols, pi, pij = estimates(one, two, share, q)
        i, j = _pairs(len(cols))
        got = np.ma.array(kernel(pi, pij)) if len(i) else np.ma.array([])
        own = {k: pa.repeat(v, len(i)) for k, v in zip(keys, key)}
        return pa.table(own | {"p1": pa.array(cols[i], pa.int32()), "p2": pa.array(cols[j], pa.int32()), "score": pa.array(got.data, pa.float64(), mask=np.ma.getmaskarray(got))})

    both = c.single.select(*keys, F.col("pos").alias("p1"), F.lit(None).cast("int").alias("p2"), F.col("sym").alias("s1"), F.lit(None).cast("string").alias("s2"), "n")
    both = both.unionByName(c.pair.select(*keys, "p1", "p2", "s1", "s2", "n"))
    by = keys or ["__all"]
    both = both if keys else both.withColumn("__all", F.lit(1))
    return both.groupBy(*by).applyInArrow(run, f"{_types(c)}p1 int, p2 int, score double")


def model_score(c: Counts, method: str) -> DataFrame:
    """(*keys, p1, p2, score) of one of ``METHODS``; ridge and psicov with the average product correction."""
    if method in PAIRWISE:
        return pairwise_score(c, method)
    got = psicov(c) if method == "psicov" else dense_score(c, method)
    return apc(got, c.keys) if method in ("ridge", "psicov") else got


for _name in METHODS:
    SCORERS[_name] = lambda c, m=_name: model_score(c, m)
