"""Approximate nearest neighbours by randomly rotated one-bit codes.

The index: each vector, less the centre of its cell, is rotated by a fixed random orthogonal matrix and kept as one
sign bit a dimension, with its length and the inner product of the rotated unit vector and its code. From these the
inner product with a query is estimated without bias, with an error bound; the vectors whose upper bound reaches the
k-th lower bound are ranked anew by their exact inner products.

Cells come from a bounded sample, every row is indexed. A query's k-th best inner product within the sample is a lower
bound of its final one, so cells that can't reach it (centre and covering radius) are passed over without loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, ship

SAMPLE = 4096
MOST_CELLS = 1024
BLOCK = 16_384
QUERIES = 2048
#: Code length, and the bound in standard deviations of the estimate.
BITS = 256
EPSILON = 3.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """``dim`` rows of a random orthogonal matrix: vectors, padded by zeros to ``BITS`` at least, are rotated by it."""
    wide = max(BITS, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def inner(x: np.ndarray, m: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns ``m`` of ``x`` and ``j`` of ``y`` in double precision, summed from the first row to the last."""
    out = np.zeros(len(m))
    for a, b in zip(x, y):
        out += a[m] * b[j]
    return out


def cells(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds over the sample."""
    k = min(k, len(sample))
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds if k > 1 else 0):
        at = nearest(sample, c)
        for j in range(k):
            if (own := at == j).any():
                c[j] = sample[own].mean(0)
    return c if k > 1 else sample.mean(0, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * x @ c.T - (c * c).sum(1)).argmax(1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length of each residual, inner product of its rotated unit vector and its code)."""
    r = (x - centre) @ turn
    length = np.sqrt((r * r).sum(1))
    unit = r / np.where(length > 0, length, 1)[:, None]
    return np.packbits(r > 0, axis=1), length, np.maximum(np.abs(unit).sum(1) / np.sqrt(turn.shape[1]), 1e-6)


def estimate(bits, length, fit, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float):
    """(queries by vectors) estimated inner products, and the error bounds for a query of length 1."""
    dim = turn.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    signs *= (length / fit / np.sqrt(dim)).astype(np.float32)[:, None]
    est = (q @ turn).astype(np.float32) @ signs.T
    est += (q @ centre)[:, None].astype(np.float32)
    bound = epsilon * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(1, dim - 1)) * length
    return est, (bound + 1e-5 * (length + np.sqrt((centre * centre).sum()) + 1)).astype(np.float32)


def search(block: dict, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, turn: np.ndarray, epsilon: float):
    """(query, vec_id, score): the k best of the block for each query, the rest left out only below the bounds."""
    out = []
    n = len(block["ids"])
    for a in range(0, len(ids), 256):
        s = slice(a, a + 256)
        est, bound = estimate(block["bits"], block["length"], block["fit"], q[s], block["centre"], turn, epsilon)
        size = np.sqrt((q[s] * q[s]).sum(1)).astype(np.float32)
        bar, turned = floor[s].astype(np.float32), np.ascontiguousarray(q[s].T)
        if n > k:  # the k best by estimate are ranked first, without the query's own rows; the bar stays if there are fewer
            est[block["ids"][None] == ids[s][:, None]] = -np.inf
            top = np.argpartition(est, n - k, axis=1)[:, n - k :]
            true = inner(turned, np.repeat(np.arange(len(top)), k), block["columns"], top.ravel()).reshape(top.shape)
            true[block["ids"][top] == ids[s][:, None]] = -np.inf
            bar = np.maximum(bar, true.min(1).astype(np.float32))
        est += size[:, None] * bound[None]
        m, j = np.nonzero(est >= bar[:, None] - 1e-6)
        other = ids[s][m] != block["ids"][j]
        m, j = m[other], j[other]
        exact = inner(turned, m, block["columns"], j)
        o = np.lexsort((block["ids"][j], -exact, m))
        m, j, exact = m[o], j[o], exact[o]
        first = np.searchsorted(m, np.arange(len(est)))
        keep = np.arange(len(m)) - first[m] < k
        out.append((ids[s][m[keep]], block["ids"][j[keep]], exact[keep]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _array(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    return np.asarray(c.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _assign(centres: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _array(b.column(1))
                at = nearest(x, centres)
                away = np.sqrt(((x - centres[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    return run


def _route(centres, radius, sample_ids, sample, k):
    """Each query to the cells whose upper bound reaches its k-th best within the sample."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, q = b.column(0).to_numpy(), _array(b.column(1))
            s = q @ sample.T
            s[ids[:, None] == sample_ids[None]] = -np.inf
            floor = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k] if len(sample) > k else np.full(len(q), -np.inf)
            size = np.sqrt((q * q).sum(1))
            floor = floor - 1e-9 * (np.abs(np.where(np.isfinite(floor), floor, 0)) + 1)
            m, c = np.nonzero(q @ centres.T + size[:, None] * radius[None] * (1 + 1e-9) + 1e-9 >= floor[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(ids[m], pa.int64()), b.column(1).take(pa.array(m)), pa.array(floor[m])], names=["cell", "query_id", "q", "floor"])

    return run


def _search(centres, k, epsilon):
    def run(key, left, right):
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            x = _array(left["v"])
            turn, centre = rotation(x.shape[1]), centres[key[0].as_py()]
            bits, length, fit = encode(x, centre, turn)
            block = {"ids": left["vec_id"].to_numpy(), "columns": np.ascontiguousarray(x.T), "bits": bits, "length": length, "fit": fit, "centre": centre}
            out = search(block, right["query_id"].to_numpy(), _array(right["q"]), right["floor"].to_numpy(), k, turn, epsilon)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, with finite components of which one at least isn't zero."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}


def neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 20, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` for each row of ``queries``.

    Both have (vec_id, embedding). A row isn't its own neighbour (equal vec_id). Ties go to the smaller vec_id. Vectors
    that are null, zero or hold null or non-finite components take no part. Vectors are compared with those of their own
    dimension, each dimension in a search of its own. Repeated rows are rows of their own. Without candidates or queries
    there are no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    good, asked = usable(vectors), usable(queries)
    sizes, n_asked = _sizes(good), _sizes(asked)
    found = None
    for dim in sorted(sizes.keys() & n_asked.keys()):
        one = _found(good.where(F.size("v") == dim), asked.where(F.size("v") == dim), sizes[dim], n_asked[dim], k, epsilon, block)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(good: DataFrame, asked: DataFrame, n: int, n_asked: int, k: int, epsilon: float, block: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block, for vectors of one dimension."""
    spark = good.sparkSession
    got = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample, sample_ids = np.array([r["v"] for r in got], np.float64), np.array([r["vec_id"] for r in got])
    centres = cells(sample, max(1, min(MOST_CELLS, -(-n // block))))
    indexed = settle(good.mapInArrow(_assign(centres), "vec_id long, v array<float>, cell int, away double"), "ann-index")
    stats = {r["cell"]: r for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    radius = np.array([stats[c]["r"] if c in stats else -1e300 for c in range(len(centres))])
    parts = spark.createDataFrame([(c, -(-s["n"] // block)) for c, s in stats.items()], "pc int, parts int")
    asked = asked.mapInArrow(_route(centres, radius, sample_ids, sample, k), "cell int, query_id long, q array<float>, floor double")
    groups = max(1, -(-n_asked // QUERIES))
    left = indexed.join(F.broadcast(parts), F.col("cell") == F.col("pc")).select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.join(F.broadcast(parts), F.col("cell") == F.col("pc")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select("cell", "part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"), "query_id", "q", "floor")
    keys = ("cell", "part", "g")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(centres, k, epsilon), "query_id long, vec_id long, score double")


ORACLE = """
with v as (select vec_id, [x::double for x in embedding] e from embeddings
  where embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])),
s as (select q.vec_id query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
