"""Audit of how filters interact: what each removes in every order of application.

A document is a mask, one bit for each filter that it fails; the corpus is counted down to mask cells, at most 32 a part
for five filters. All orders of a part are then visited by adjacent transpositions (each order differs from the one
before in one swap of neighbours), so of an order's steps only the two swapped ones are taken anew from the cells, and
Shapley sums accumulate along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, tidied

FILTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Bytes of UTF-8 that don't begin a code point.
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def transpositions(n: int) -> Iterator[int]:
    """The places k at which k and k + 1 are swapped to visit all n! orders, from the ascending one."""
    value, at, step = list(range(n)), list(range(n)), [-1] * n
    while True:
        for v in range(n - 1, -1, -1):
            k = at[v]
            j = k + step[v]
            if 0 <= j < n and value[j] < v:
                break
        else:
            return
        other = value[j]
        value[k], value[j], at[v], at[other] = other, v, j, k
        for w in range(v + 1, n):
            step[w] = -step[w]
        yield min(k, j)


def walk(cells: np.ndarray, names: Sequence[str] = FILTERS) -> dict[str, list]:
    """All orders' steps from ``cells`` (3, 2 ** n): documents, good ones, toxic ones by mask (bit k: fails filter k).

    Columns filter_order, step and ``COUNTS``.
    """
    n = len(names)
    masks = np.arange(1 << n)

    def step(before: int, f: int) -> tuple[int, int, int, int, int]:
        """kept, removed, good_lost, toxic_lost, redundant of filter f after those in ``before``."""
        fails, gone = (masks >> f & 1) == 1, (masks & before) != 0
        here = cells[:, fails & ~gone].sum(1)
        return (int(cells[0, ~fails & ~gone].sum()), int(here[0]), int(here[1]), int(here[2]), int(cells[0, fails & gone].sum()))

    order = list(range(n))
    prefix = [(1 << k) - 1 for k in range(n)]
    steps = [step(prefix[k], k) for k in range(n)]
    visited, totals = [], [0] * n

    def visit() -> None:
        visited.append((tuple(order), tuple(steps)))
        for f, s in zip(order, steps):
            totals[f] += s[1]

    visit()
    for k in transpositions(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        prefix[k + 1] = prefix[k] | 1 << order[k]
        steps[k], steps[k + 1] = step(prefix[k], order[k]), step(prefix[k + 1], order[k + 1])
        visit()
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", *COUNTS)}
    for o, ss in visited:
        name = "".join(names[f] for f in o)
        for k, (f, (kept, removed, good, toxic, redundant)) in enumerate(zip(o, ss)):
            row = (name, k + 1, kept, removed, redundant, int(cells[0, 1 << f]), good, toxic, totals[f])
            for c, v in zip(out, row):
                out[c].append(v)
    return out


def _text_masks(batches):
    """(doc_id, part, digest, mask) by what the text alone decides: filters A to D."""
    import hashlib

    for b in batches:
        masks, digests = [], []
        for v in b.column(2):
            raw = v.as_py() or b""
            words = raw.split()  # at the six ASCII blanks
            points = len(raw.translate(None, CONTINUED))
            mask = (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            mask |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * points) << 2
            mask |= (len(raw) != len(raw.translate(None, MARKS))) << 3
            masks.append(mask)
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, with those labelled good and toxic.

    Texts are digested once; copies are told by (sha-256, doc_id) pairs of some sixty bytes, never by moving texts. The
    rows of one text are first counted by (part, labels) with their least doc_id, so a text that a third of all rows
    share is a few rows when its own are brought together.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary"))
    rows = rows.mapInArrow(tidied(_text_masks), "doc_id long, part string, digest binary, mask int")
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("c"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("at"))
    marked = marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without doc_id have no label; they are dealt by their texts, so they don't meet in one task of the join.
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.xxhash64("digest")), "named": F.col("doc_id").isNotNull()})
    both = rows.join(marked.withColumn("named", F.lit(True)), ["at", "named"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    own = both.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), first.alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # four rows a part at most
    own = own.withColumn("least", least).withColumn("single", F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0) + F.col("nameless"))
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("single").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("single")).alias("n"))))
    cells = own.select("part", "good", "toxic", split.alias("cell")).where("cell.n > 0").select("part", "good", "toxic", "cell.mask", "cell.n")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cells.groupBy("part", "mask").agg(only("good"), only("toxic"), F.sum("n").alias("n"))


def _walk_batches(batches):
    types = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            table = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in cells:
                table[:, c["mask"]] = c["n"], c["good"], c["toxic"]
            got = walk(table)
            n = len(got["step"])
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), *(pa.array(v, t) for v, t in zip(got.values(), types))], names=["part", *got])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, ``COUNTS``): 600 rows for each value of lang, a null one counted as ''.

    A: under 200 words. B: fewer than half of the words distinct. C: more than 3 % capitals A-Z. D: a mark of
    ``#$%&*|``. E: the same text as a row of a smaller doc_id anywhere. A null text is an empty one and fails A alone,
    and E if there are others. Rows without doc_id are no copies and have no labels, but nothing is a copy of them;
    rows of one doc_id aren't each other's copies; of several labels of a doc_id any that says so counts. Empty tables
    of documents give no rows, empty labels zeros; other columns are ignored.
    """
    cells = masks(docs, labels)
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return held.mapInArrow(_walk_batches, schema)


ORACLE = r"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) good, max((coalesce(toxic, 0) = 1)::int) toxic from labels where doc_id is not null group by doc_id),
f as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, (len(ws) < 200)::int a, (100 * len(list_distinct(ws)) < 50 * len(ws))::int b,
  (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int c, regexp_matches(t, '[#$%&*|]')::int d, coalesce((doc_id > min(doc_id) over (partition by t))::int, 0) e from w left join l using (doc_id)),
m as (select part, a, b, c, d, e, count(*) n, sum(good) good, sum(toxic) toxic from f group by all),
k as (select unnest(['A', 'B', 'C', 'D', 'E']) k),
o as (select v.k || w.k || x.k || y.k || z.k o from k v, k w, k x, k y, k z where len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
s as (select o, s, substr(o, s, 1) f, substr(o, 1, s - 1) before from o, (select unnest(range(1, 6))::int s)),
ms as (select m.*, concat(case when a = 1 then 'A' end, case when b = 1 then 'B' end, case when c = 1 then 'C' end, case when d = 1 then 'D' end, case when e = 1 then 'E' end) fails from m),
r as (select part, o, s, f, sum(case when g = '' and not own then n else 0 end) kept, sum(case when g = '' and own then n else 0 end) removed, sum(case when g <> '' and own then n else 0 end) redundant,
  sum(case when fails = f then n else 0 end) unique_fails, sum(case when g = '' and own then good else 0 end) good_lost, sum(case when g = '' and own then toxic else 0 end) toxic_lost
  from (select ms.*, s.*, contains(fails, f) own, case when before = '' then '' else regexp_replace(fails, '[^' || before || ']', '', 'g') end g from ms, s) group by all)
select part, o filter_order, s step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, f))::bigint shapley from r"""
