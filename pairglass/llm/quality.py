"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has bins and a lookup table, learned by boosting shallow trees on one feature after the other in cycles;
the pairs of features that explain most of what is left get two-way tables in the same way. A score is the sum of the
entries, through the logistic function. The model is fitted on at most ``FIT_ROWS`` labelled documents (a bounded
sample by hash; all of them if there are fewer); every document is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle, ship, tidied

FIT_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "digits", "marks", "upper", "wide", "lines", "pipes",
    "distinct", "top_word", "odd_ends", "odd_words", "short_words", "long_words", "line_copies", "stops", "entropy", "packed",
)
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 mark, 5 space, 6 bytes of other letters
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[_a:_b] = 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 5
_CLASS[128:] = 6


def features(text: str | None) -> list[float]:
    """Of the whole text; null counts as empty."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=by, minlength=7)
    words = t.split()
    count = Counter(words)
    m = max(1, len(words))
    p = by[by > 0] / n
    odd_end = odd = short = long = 0
    for w, c in count.items():
        k = len(w)
        if k <= 3:
            short += c
        elif k > 14:
            long += c
        if not w.isalpha():
            if not (w[-1].isalnum() or w[-1] in ".,;:!?"):
                odd_end += c
            if not w[:-1].isalpha() and k > 1:
                odd += c
    lines = t.split("\n")
    return [
        np.log1p(len(t)), np.log1p(len(words)), sum(len(w) * c for w, c in count.items()) / m, (kind[1] + kind[2] + kind[6]) / n, kind[3] / n, kind[4] / n,
        kind[2] / n, kind[6] / n, len(lines) / m, by[124] / m, len(count) / m, max(count.values(), default=0) / m,
        odd_end / m, odd / m, short / m, long / m, 1 - len(set(lines)) / len(lines), (by[46] + by[33] + by[63]) / m,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, len(zlib.compress(raw, 1)) / n,
    ]


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int = 4, least: float = 8.0) -> np.ndarray:
    """The step of a shallow tree on one binned feature: best-first cuts of the bins; g, h: sums by bin."""
    parts, out = [(0, len(g))], np.zeros(len(g))

    def best(a, b):
        if b - a < 2:
            return 0.0, a
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1), 0.0)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    cuts = [best(0, len(g))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: cuts[i][0])
        if cuts[k][0] <= 1e-9:
            break
        (a, b), (_, c) = parts[k], cuts[k]
        parts[k : k + 1], cuts[k : k + 1] = [(a, c), (c, b)], [best(a, c), best(c, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray, least: float = 8.0) -> np.ndarray:
    """The step of a depth-two tree on two binned features: one cut of the first, on each side one of the second."""
    best = None
    for c in range(1, len(g)):
        sides = [tree_1d(g[s].sum(0), h[s].sum(0), 2, least) for s in (slice(0, c), slice(c, None))]
        gain = sum(float((x * g[s].sum(0)).sum()) for x, s in zip(sides, (slice(0, c), slice(c, None))))
        if best is None or gain > best[0]:
            best = gain, c, sides
    out = np.zeros_like(g)
    if best:
        out[: best[1]], out[best[1] :] = best[2]
    return out


@dataclass
class Additive:
    """Edges and tables by feature, tables by pair of features on coarser edges."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.grids):
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.08) -> Additive:
    """With one class only, or no rows, the score is the share of label 1 (0.5 without rows)."""
    m = Additive()
    if len(y):
        p = (y.sum() + 0.5) / (len(y) + 1)
        m.start = float(np.log(p / (1 - p)))
    if len(y) < 2 or y.min() == y.max():
        return m
    least = min(8.0, max(0.5, 0.02 * len(y) * p * (1 - p)))  # of information in a leaf: 8, less for few rows
    d = x.shape[1]
    cuts = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
    m.edges, m.coarse = [cuts(x[:, j], 48) for j in range(d)], [cuts(x[:, j], 8) for j in range(d)]
    bins = [np.searchsorted(m.edges[j], x[:, j], side="right") for j in range(d)]
    rough = [np.searchsorted(m.coarse[j], x[:, j], side="right") for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.start)
    for _ in range(rounds):
        for j in range(d):
            q = 1 / (1 + np.exp(-z))
            n = len(m.tables[j])
            step = rate * tree_1d(np.bincount(bins[j], y - q, n), np.bincount(bins[j], q * (1 - q), n), 4, least)
            m.tables[j] += step
            z += step[bins[j]]
    q = 1 / (1 + np.exp(-z))

    def grid(v, a, b):
        na, nb = len(m.coarse[a]) + 1, len(m.coarse[b]) + 1
        return np.bincount(rough[a] * nb + rough[b], v, na * nb).reshape(na, nb)

    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            g, h = grid(y - q, a, b), grid(q * (1 - q), a, b)
            gains.append((float((g**2 / (h + 8)).sum()), a, b))
    m.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    m.grids = [np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)) for a, b in m.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(m.pairs):
            q = 1 / (1 + np.exp(-z))
            step = rate * tree_2d(grid(y - q, a, b), grid(q * (1 - q), a, b), least)
            m.grids[k] += step
            z += step[rough[a], rough[b]]
    return m


def remainder(id_: Column, k: int) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % k, F.lit(-1))


TABLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.BinaryType())])


def _feature_batches(batches):
    for b in batches:
        rows = [np.asarray(features(t), "<f4").tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(FEATURES)).astype(np.float64)


def _score_batches(model: Additive):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return run


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``docs``, in the shared folder: the only pass over the texts."""
    ship(docs.sparkSession)
    return settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_feature_batches), TABLE), "quality-features")


def fit_on(table: DataFrame, labels: DataFrame, *, fold: int = 4, out: int = 2, rows: int = FIT_ROWS) -> Additive:
    """Only labels of documents whose crc32 isn't held out; ``rows`` of them by hash at most. Null labels don't count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold) != out))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    got = table.join(F.broadcast(known), "doc_id").select("x", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "x", "y").limit(rows).toPandas()
    x = np.frombuffer(b"".join(map(bytes, got["x"])), "<f4").reshape(-1, len(FEATURES)).astype(np.float64)
    return fit(x, got["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fold: int = 4, out: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts are scored as empty ones; a null doc_id is never held out; repeated rows each get their row;
    without usable labels every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    table = feature_table(docs)
    model = fit_on(table, labels, fold=fold, out=out, rows=rows)
    scored = table.mapInArrow(_score_batches(model), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold) == out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep_batches(model: Additive, at: int, least: float):
    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            if texts:
                x = np.asarray([features(t) for t in texts], "<f4").astype(np.float64)
                yield b.filter(pa.array(model.score(x) >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score under ``least``; all columns as they are."""
    ship(docs.sparkSession)
    y = labels.select(F.col("doc_id").alias("__label_id"), "quality")
    usable = F.col("quality").isin(0, 1) & F.col("__label_id").isNotNull() & (remainder(F.col("__label_id"), 4) != 2)
    some = y.where(usable).orderBy(F.xxhash64("__label_id"), "__label_id").limit(FIT_ROWS)
    fitted = docs.select(F.col("doc_id"), "text").join(F.broadcast(some.select(F.col("__label_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    model = fit_on(feature_table(fitted), labels)
    return docs.mapInArrow(tidied(_keep_batches(model, docs.columns.index("text"), least)), docs.schema)
