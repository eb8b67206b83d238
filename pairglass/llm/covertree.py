"""Embedding near-dedup: exact cosine pairs over a threshold by dual traversal of cover trees.

Vectors of one label are dealt into blocks; each block gets a cover tree over its unit vectors, with nested levels of
halving radii. Pairs of blocks are traversed together: a pair of nodes is dropped if their centres are further apart
than the threshold's distance and both covering radii, and taken whole if all their points must be near. Equal
vectors are one point with a count.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Union, components
from .shared import settle, ship

THRESHOLD = 0.98
BLOCK = 2048
LEAF = 24


class CoverTree:
    """Nodes in preorder over points in tree order. Node k covers points first[k] to last[k], all within radius[k] of
    point centre[k]; its children are kids[from[k]:from[k + 1]]; a leaf has none and is compared point by point."""

    def __init__(self, unit: np.ndarray):
        self.order: list[np.ndarray] = []
        self.rows: list[tuple[int, int, int, float]] = []
        self.kids: list[list[int]] = []
        self.size = 0
        if len(unit):
            self._grow(unit, np.arange(len(unit)), 0, 2.0, np.sqrt(np.maximum(0, ((unit - unit[0]) ** 2).sum(1))))
        self.order = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)

    def _grow(self, unit: np.ndarray, members: np.ndarray, centre: int, radius: float, away: np.ndarray) -> int:
        """members: places of points, the centre's first; away: their distances to it, within ``radius``."""
        k, first = len(self.rows), self.size
        self.rows.append((centre, first, first, float(away.max(initial=0.0))))
        self.kids.append([])
        reach = float(away.max(initial=0.0))
        if len(members) <= LEAF or reach <= 1e-12:
            self.order.append(members)
            self.size += len(members)
        else:
            half = radius / 2
            while half >= reach:
                half /= 2
            left, gaps, c = members, away, centre
            while len(left):
                near = gaps <= half
                near[left == c] = True
                self.kids[k].append(self._grow(unit, left[near], c, half, gaps[near]))
                left = left[~near]
                if len(left):
                    c = int(left[0])
                    gaps = np.sqrt(np.maximum(0, ((unit[left] - unit[c]) ** 2).sum(1)))
        centre_, first_, _, reach_ = self.rows[k]
        self.rows[k] = (centre_, first_, self.size, reach_)
        return k

    def arrays(self) -> dict[str, np.ndarray]:
        c, a, b, r = (np.array(x) for x in zip(*self.rows))
        return {"order": self.order, "centre": c, "first": a, "last": b, "radius": r, "from": np.cumsum([0, *map(len, self.kids)]), "kids": np.array([x for k in self.kids for x in k], np.int64)}


def pack(ids: np.ndarray, counts: np.ndarray, x: np.ndarray) -> bytes:
    """A block: points with their original vectors and the tree over them."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    t = CoverTree(unit).arrays()
    o = t.pop("order")
    t["centre"] = np.argsort(o)[t["centre"]]
    out = io.BytesIO()
    np.savez(out, ids=ids[o], counts=counts[o], x=x[o].astype(np.float32), **t)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    t = dict(np.load(io.BytesIO(raw)))
    x = t["x"].astype(np.float64)
    t["x"], t["norm"] = x, np.sqrt((x * x).sum(1))
    t["unit"] = x / t["norm"][:, None]
    return t


def cosines(a: dict, i: slice, b: dict, j: slice) -> np.ndarray:
    return (a["x"][i] @ b["x"][j].T) / (a["norm"][i][:, None] * b["norm"][j][None])


def dual(a: dict, b: dict, threshold: float, found) -> None:
    """Calls found(i, j) with index arrays or slices of linked pairs of points of ``a`` and ``b``, each pair once.

    ``a is b``: only pairs of different points, each in both orders.
    """
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kids = lambda t, k: t["kids"][t["from"][k] : t["from"][k + 1]]
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        u, v = kids(a, p), kids(b, q)
        if not len(u) and not len(v):
            i, j = slice(a["first"][p], a["last"][p]), slice(b["first"][q], b["last"][q])
            m, n = np.nonzero(cosines(a, i, b, j) >= threshold)
            m, n = m + i.start, n + j.start
            if a is b:
                m, n = m[m != n], n[m != n]
            if len(m):
                found(m, n)
            continue
        u, v = (u if len(u) else np.array([p])), (v if len(v) else np.array([q]))
        dot = a["unit"][a["centre"][u]] @ b["unit"][b["centre"][v]].T
        gap = np.sqrt(np.maximum(0, 2 - 2 * dot))
        reach = a["radius"][u][:, None] + b["radius"][v][None]
        for m, n in np.argwhere(gap <= far + reach + 1e-6):
            s, t = int(u[m]), int(v[n])
            if a is not b and gap[m, n] + reach[m, n] < far - 1e-6 or a is b and s != t and gap[m, n] + reach[m, n] < far - 1e-6:
                found(slice(a["first"][s], a["last"][s]), slice(b["first"][t], b["last"][t]))
            else:
                stack.append((s, t))


def links(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Linked points' counts for each point of ``a`` and of ``b``, and a forest of links (ids) that spans them."""
    na, nb, same = np.zeros(len(a["ids"]), np.int64), np.zeros(len(b["ids"]), np.int64), a is b
    sets, forest = Union(len(na) + (0 if same else len(nb))), []
    shift = 0 if same else len(na)

    def tie(i: int, j: int) -> None:
        if sets.join(i, j + shift):
            forest.append((int(a["ids"][i]), int(b["ids"][j])))

    def found(i, j):
        if isinstance(i, slice):
            na[i] += b["counts"][j].sum()
            if not same:
                nb[j] += a["counts"][i].sum()
            for k in range(i.start, i.stop):
                tie(k, j.start)
            for k in range(j.start + 1, j.stop):
                tie(i.start, k)
            return
        np.add.at(na, i, b["counts"][j])
        if not same:
            np.add.at(nb, j, a["counts"][i])
        for x, y in zip(i.tolist(), j.tolist()):
            tie(x, y)

    dual(a, b, threshold, found)
    return na, nb, forest


def _block(key, table):
    ids, counts = table["cid"].to_numpy(), table["n"].to_numpy()
    o = np.argsort(ids)
    x = np.array(table["v"].to_pylist(), np.float64)
    return pa.table({"label": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "blocks": pa.array([table["blocks"][0].as_py()], pa.int32()), "raw": pa.array([pack(ids[o], counts[o], x[o])], pa.binary())})


def _pair(threshold: float):
    def run(key, table):
        blocks = dict(zip(table["block"].to_pylist(), table["raw"].to_pylist()))
        i, j = key[1].as_py(), key[2].as_py()
        a = unpack(blocks[i])
        b = a if i == j else unpack(blocks[j])
        na, nb, forest = links(a, b, threshold)
        out = [(int(x), int(n), None) for t, c in ((a, na), (b, nb)) for x, n in zip(t["ids"][c > 0], c[c > 0])]
        out += [(x, 0, y) for x, y in forest]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "n", "b"), cols)})

    return run


def near(vectors: DataFrame, *, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Rows are compared if their labels are equal and not null. Null, empty or zero vectors, such with null or
    non-finite components, and rows without vec_id link with nothing, nor do vectors of different lengths with each
    other. Repeated rows count as vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v"), "label")
    rows = rows.withColumn("dim", F.size("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    good = rows.where(usable)
    classes = good.groupBy("label", "dim", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), "blocks")
    dealt = classes.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    group = F.concat_ws("|", F.col("label").cast("string"), F.col("dim").cast("string"))
    dealt = dealt.select(group.alias("label"), F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), "blocks", "cid", "n", "v")
    blocks = dealt.groupBy("label", "block").applyInArrow(_block, "label string, block int, blocks int, raw binary")
    blocks = settle(blocks, "vector-blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = blocks.withColumn("other", other).select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "raw")
    found = settle(pairs.groupBy("label", "i", "j").applyInArrow(_pair(threshold), "a long, n long, b long"), "vector-links")
    comp = components(found.where("b is not null").select("a", "b"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    done = classes.join(counts, F.col("cid") == F.col("a"), "left").drop("a")
    done = done.join(comp, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid")).drop("component", "node")
    named = done.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "c")
    done = done.join(named, F.col("comp") == F.col("c"))
    done = done.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = settle(done, "vector-classes-done")
    linked = good.join(done, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
with recursive v as (select vec_id, label, [x::double for x in embedding] e from embeddings
  where label is not null and embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) component_id from r group by a),
n as (select a, count(*) n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on e.vec_id = c.a left join n on e.vec_id = n.a
"""
