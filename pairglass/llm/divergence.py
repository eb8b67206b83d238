"""Divergence of sources within each language: differences of smoothed term frequencies, by source pair and by term.

Terms in too few documents don't count, and most terms of a large corpus are such. A count-min sketch of document
frequencies, merged over all tasks, never underestimates, so a (lang, term) whose least cell is below the bar is
impossible and is never shuffled. The others are counted exactly, by (lang, source, term) and first within each task.
Sources are compared by a join of the counts that both have; terms that only one or none of them has are taken from the
counts' histograms in closed form, so nothing is filled up to all terms of a language.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, settle, ship, tidied

#: Bytes of terms: letters A-Z, a-z and every character beyond ASCII; of them A-Z are lowered.
TERM = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
LEAST = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP = 50
#: Rows of the sketch and cells of a row. A bit for each cell is what tasks are sent: 1 MB, however large the corpus.
#: Where more than ``WIDTH`` terms a row are frequent, more of the others pass; counts stay exact.
DEPTH, WIDTH = 2, 1 << 22
#: Bytes of text whose terms a task counts at once.
HELD = 16 << 20


def _cells(langs: np.ndarray, terms: np.ndarray, width: int) -> np.ndarray:
    """(DEPTH, n): the cells of keys with these 64-bit hashes, numbered over all rows of the sketch."""
    h = (terms ^ langs * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) % np.uint64(width) + np.uint64(k * width)).astype(np.int64) for k in range(DEPTH)])


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(values.to_pylist(), object), categorize=False).astype(np.uint64)


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row of each term, terms) of an array of strings, in order: cut and lowered as bytes, all at once."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), pa.array([], pa.string()).dictionary_encode()
    raw = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    bounds = offsets[1:-1] - offsets[0]
    bounds = bounds[(bounds > 0) & (bounds < len(raw))]
    inside = TERM[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[bounds] = inside[bounds]  # terms don't cross texts
    ends[bounds - 1] = inside[bounds - 1]
    first = np.flatnonzero(begins)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - first)]).astype(np.int32)
    cut = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    per_row = np.diff(np.searchsorted(first, offsets - offsets[0]))
    return np.repeat(np.arange(len(texts)), per_row), cut.dictionary_encode()


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _counted(group: np.ndarray, texts: pa.Array):
    """(group, code, occurrences, rows, dictionary): each term of each group of rows."""
    row, terms = _terms(texts)
    kinds = max(1, len(terms.dictionary))
    key = row * kinds + terms.indices.to_numpy()
    key.sort()
    at = _runs(key)
    n, key = np.diff(np.append(at, len(key))), key[at]  # each term of each row
    key = group[key // kinds] * kinds + key % kinds
    order = np.argsort(key, kind="stable")
    at = _runs(key[order])
    total = np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    key = key[order][at]
    return key // kinds, key % kinds, total, np.diff(np.append(at, len(order))), terms.dictionary


def _chunks(batches, held):
    """(lang, source, text) columns of about ``held`` bytes of text."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += b.column(2).nbytes
        if size >= held:
            yield pa.Table.from_batches(some).combine_chunks()
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def _column(table, name) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.string())


def _sketch_batches(least, width, held):
    def run(batches):
        sketch = np.zeros(DEPTH * width, np.int32)
        for t in _chunks(batches, held):
            langs = _column(t, "lang").dictionary_encode()
            group, code, _, df, terms = _counted(langs.indices.to_numpy().astype(np.int64), _column(t, "text"))
            for row in _cells(_hashes(langs.dictionary)[group], _hashes(terms)[code], width):
                np.add.at(sketch, row, np.minimum(df, least).astype(np.int32))
            np.minimum(sketch, least, out=sketch)  # at the bar more doesn't matter, and sums can't overflow
        live = np.flatnonzero(sketch)
        for a in range(0, len(live), 1 << 16):
            some = live[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sketch[some])], names=["cell", "n"])

    return run


def possible(rows: DataFrame, least: int, width: int = WIDTH, held: int = HELD) -> bytes:
    """A bit for each cell of the merged sketch: set if keys that fall there may be in ``least`` documents.

    ``DEPTH * width / 8`` bytes (``width``: a multiple of 64) come to the driver, whatever the number of rows.
    """
    cells = rows.mapInArrow(tidied(_sketch_batches(least, width, held)), "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(63))
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(DEPTH * width // 64, np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return bits.tobytes()


def _count_batches(sent, width, held):
    def run(batches):
        bits = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for t in _chunks(batches, held):
            langs, sources = _column(t, "lang").dictionary_encode(), _column(t, "source").dictionary_encode()
            many = len(sources.dictionary)
            group, code, n, df, terms = _counted(langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy(), _column(t, "text"))
            at = _cells(_hashes(langs.dictionary)[group // many], _hashes(terms)[code], width)
            may = np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0))
            for a in range(0, len(may), 1 << 16):
                k = may[a : a + (1 << 16)]
                columns = [langs.dictionary.take(pa.array(group[k] // many)), sources.dictionary.take(pa.array(group[k] % many)), terms.take(pa.array(code[k])), pa.array(n[k]), pa.array(df[k])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

    return run


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kinds)), exact in decimals of 38 digits; 0 without kinds."""
    wide = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTH * kinds))
    return F.when(kinds > 0, 1 + whole).otherwise(F.lit(0)).cast("long")


def _ranked(found: DataFrame, part: str, most: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    got = found.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return got if most is None else got.where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part 'pair': every other source of the language, the sum over the language's kept terms (those in ``least`` of its
    documents) of the absolute difference of both sources' shares. Part 'term': the ``top`` kept terms that occur in the
    source and have a larger share there than in the language, by the difference. Ties go by item in code-point order.
    Null text, lang and source are read as ''; rows are counted as often as they occur, whatever their doc_id; a text
    without terms still makes its group occur. A language without kept terms has pairs of value 0. An empty table gives
    no rows; other columns are ignored. ``width`` and ``held`` bound memory and what is sent; results don't depend on them.
    """
    spark = docs.sparkSession
    ship(spark)
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").alias("text"))
    groups = settle(rows.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups").select("lang", "source")
    bits = spark.sparkContext.broadcast(zlib.compress(possible(rows, least, width, held), 1))
    got = rows.mapInArrow(tidied(_count_batches(bits, width, held)), "lang string, source string, term string, n long, df long")
    got = got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    # Sources meet by (lang, term): as many rows as the language has sources. A null df in no source can't be.
    every = Window.partitionBy("lang", "term")
    got = got.withColumns({"in": F.sum("df").over(every), "all": F.sum("n").over(every)}).where(F.col("in") >= least)
    kept = settle(got.select("lang", "source", "term", "n", "all"), "terms")

    terms = kept.groupBy("lang", "term").agg(F.first("all").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("nl"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("ng"))
    zero = F.lit(0).cast("long")
    # One row for each group: their sizes, and the share of a term that doesn't occur in it.
    sizes = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "nl", "ng"])
    sizes = settle(sizes.withColumn("p0", share(zero, F.col("ng"), F.col("v"))), "sizes")
    p = settle(kept.join(sizes, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("ng"), F.col("v"))), "shares")

    up = p.withColumn("value", F.col("p") - share(F.col("all"), F.col("nl"), F.col("v"))).where("value > 0").withColumnRenamed("term", "item")
    by_term = _ranked(up, "term", top)

    # Of pairs a < b: terms that both have, then those that only one has (all of it less the shared ones), then the rest.
    side = lambda df, s, *names: df.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in names))
    a, b = side(sizes, "a", "source", "p0", "v"), side(sizes, "b", "source", "p0")
    pairs = a.join(b, "lang").where("source_a < source_b")
    far = F.abs
    left = p.select("lang", "term", F.col("source").alias("source_a"), F.col("p").alias("pa"), F.col("p0").alias("p0_a"))
    right = p.select("lang", "term", F.col("source").alias("source_b"), F.col("p").alias("pb"), F.col("p0").alias("p0_b"))
    both = left.join(right, ["lang", "term"]).where("source_a < source_b")
    shared = far(F.col("pa") - F.col("pb")) - far(F.col("pa") - F.col("p0_b")) - far(F.col("pb") - F.col("p0_a")) + far(F.col("p0_a") - F.col("p0_b"))
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(shared).alias("both"))
    # Shares of a source depend on counts alone: far fewer values than terms.
    levels = p.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    own = levels.join(sizes.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0")), "lang").where("source <> other")
    own = own.groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * far(F.col("p") - F.col("q0"))).alias("own"), F.sum("terms").alias("terms"))
    one = own.select("lang", F.col("source").alias("source_a"), F.col("other").alias("source_b"), F.col("own").alias("own_a"), F.col("terms").alias("terms_a"))
    two = own.select("lang", F.col("other").alias("source_a"), F.col("source").alias("source_b"), F.col("own").alias("own_b"), F.col("terms").alias("terms_b"))
    on = ["lang", "source_a", "source_b"]
    whole = pairs.join(both, on, "left").join(one, on, "left").join(two, on, "left").na.fill(0, ["both", "own_a", "own_b", "terms_a", "terms_b"])
    rest = (F.col("v_a") - F.col("terms_a") - F.col("terms_b")) * far(F.col("p0_a") - F.col("p0_b"))
    whole = whole.withColumn("value", F.col("both") + F.col("own_a") + F.col("own_b") + rest)
    ends = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    by_pair = _ranked(whole.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value"), "pair")
    return settle(by_pair.unionByName(by_term), "divergence")


ORACLE = rf"""with d as (select coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts from documents),
g as (select distinct lang, source from d),
k as (select lang, term from (select lang, unnest(list_distinct(ts)) term from d) group by all having count(*) >= {LEAST}),
c as (select lang, source, term, n from (select lang, source, term, count(*) n from (select lang, source, unnest(ts) term from d) group by all) join k using (lang, term)),
v as (select lang, count(*) v from k group by lang),
x as (select g.lang, g.source, k.term, coalesce(n, 0)::hugeint n from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
t as (select lang, source, sum(n) n from x group by all),
p as (select x.lang, x.source, x.term, x.n, 1 + {SCALE} * (x.n + {SMOOTH}) // (t.n + {SMOOTH} * v.v) p from x join t on t.lang = x.lang and t.source = x.source join v on v.lang = x.lang),
pl as (select lang, term, 1 + {SCALE} * (sum(n) + {SMOOTH}) // (sum(sum(n)) over (partition by lang) + {SMOOTH} * v) q from x join v using (lang) group by lang, term, v),
pr as (select a.lang, a.source, 'pair' part, b.source item, sum(abs(a.p - b.p))::bigint value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pz as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source),
tm as (select lang, source, 'term' part, term item, (p - q)::bigint value from p join pl using (lang, term) where n > 0 and p > q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pz union all select * from tm))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= {TOP}"""
