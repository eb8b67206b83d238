"""Contingency counts of one and two columns, pseudocounts and the consensus sequence."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.store import settle
from .alignment import ALPHABET, GAP, UnequalLengths

K = len(ALPHABET)

#: Background frequencies of the 20 residues in the order of the alphabet; the gap has none.
BACKGROUND = {
    "A": 0.073, "C": 0.025, "D": 0.050, "E": 0.061, "F": 0.042, "G": 0.072, "H": 0.023, "I": 0.053, "K": 0.064, "L": 0.089,
    "M": 0.023, "N": 0.043, "P": 0.052, "Q": 0.040, "R": 0.052, "S": 0.073, "T": 0.056, "V": 0.063, "W": 0.013, "Y": 0.033,
}
#: Cells of 8 bytes that are counted at once: pairs of columns are taken in runs of as many as fit.
TILE_CELLS = 1 << 22
#: Bytes of sequences that a task holds before they are counted.
HELD_BYTES = 4 << 20
#: The same where a batch's sums go out by themselves: of wide rows and of rows with keys.
WIDE_BYTES = 16 << 20
#: Places of cells (8 bytes each) that are made at once.
AT_ONCE = 1 << 19
#: Tables that one job counts; more are counted by further ones.
MOST_TABLES = 512


def singles(cells: DataFrame, weights: DataFrame | None = None, keys=()) -> DataFrame:
    """(*keys, pos, sym, n)."""
    if weights is None:
        return cells.groupBy(*keys, "pos", "sym").agg(F.count("*").cast("double").alias("n"))
    return cells.join(weights, [*keys, "seq_id"]).groupBy(*keys, "pos", "sym").agg(F.sum("w").alias("n"))


def pairs_by_join(cells: DataFrame, weights: DataFrame | None = None, keys=()) -> DataFrame:
    """(*keys, p1, p2, s1, s2, n) for p1 < p2, by a join of the cells of each sequence.

    For cells that come as such: it shuffles every cell and makes every pair of them a row. Cells of rows are joined by
    ``pairs`` where they lie.
    """
    if weights is not None:
        cells = cells.join(weights, [*keys, "seq_id"])
    w = F.sum("w") if weights is not None else F.count("*").cast("double")
    a = cells.withColumnsRenamed({"pos": "p1", "sym": "s1"})
    b = cells.select(*keys, "seq_id", F.col("pos").alias("p2"), F.col("sym").alias("s2"))
    both = a.join(b, [*keys, "seq_id"]).where("p1 < p2")
    return both.groupBy(*keys, "p1", "p2", "s1", "s2").agg(w.alias("n"))


def _raw(column, length: int) -> np.ndarray:
    """(rows, length): a column of strings as bytes, without a Python object for each."""
    column = pa.array(column.to_pylist(), pa.string()) if not isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    if column.null_count or (np.diff(at) != length).any():
        if column.null_count or pc.any(pc.not_equal(pc.utf8_length(column), length)).as_py():
            raise UnequalLengths(f"a row that isn't {length} symbols long")
        raise ValueError("a symbol outside the alphabet")
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if length and len(column) else np.zeros(0, np.uint8)
    return whole.reshape(len(column), length)


def _codes(column, length: int) -> np.ndarray:
    """(rows, length): the symbols of a column of strings as numbers."""
    code = np.full(256, 255, np.uint8)
    code[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(K)
    x = code[_raw(column, length)]
    if (x == 255).any():
        raise ValueError("a symbol outside the alphabet")
    return x


def _fixed(column, kind: str, tables: int) -> np.ndarray:
    """(rows, tables): a binary column of ``tables`` numbers a row, read where it lies."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, wide = len(column), np.dtype(kind).itemsize * tables
    if n == 0:
        return np.zeros((0, tables), kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    if column.null_count or (np.diff(at) != wide).any():
        raise ValueError(f"a row that isn't of {tables} tables")
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(n, tables)


def _runs(length: int, tables: int):
    """Pairs of columns (i, j), i < j, in runs whose cells of all tables are ``TILE_CELLS`` at most."""
    i, j = np.triu_indices(length, 1)
    step = max(1, TILE_CELLS // (K * K * tables))
    for a in range(0, len(i), step):
        yield i[a : a + step], j[a : a + step]


def _pair_sums(x: np.ndarray, add, tables: int, held: dict | None = None):
    """(i, j, sums (tables, pairs, 441)) for runs of pairs of columns. ``add(sums, flat, rows)`` counts places ``flat``
    (pairs, rows) of cells into the tables; ``held`` keeps the sums of one call for the next."""
    columns = np.ascontiguousarray(x.T)
    for i, j in _runs(x.shape[1], tables):
        if held is None:
            sums = np.zeros((tables, len(i) * K * K))
        elif (sums := held.get(int(i[0]) * x.shape[1] + int(j[0]))) is None:
            sums = held[int(i[0]) * x.shape[1] + int(j[0])] = np.zeros((tables, len(i) * K * K))
        first, step = (np.arange(len(i)) * K * K)[:, None], max(64, max(AT_ONCE, len(i) * K * K // 2) // len(i))
        for a in range(0, len(x), step):
            flat = columns[i, a : a + step].astype(np.intp)
            flat *= K
            flat += columns[j, a : a + step]
            flat += first
            add(sums, flat, slice(a, a + step))
        yield i, j, sums.reshape(tables, len(i), K * K)


def _one_run(length: int, tables: int) -> bool:
    """Whether the cells of all pairs of columns are few enough to be kept until a task's end."""
    return length * (length - 1) // 2 * K * K * tables <= TILE_CELLS


def _cells(i, j, sums: np.ndarray):
    """(table, p1, p2, s1, s2, n) of the cells that aren't 0, as arrays."""
    t, p, c = np.nonzero(sums)
    return t, i[p].astype(np.int32), j[p].astype(np.int32), c // K, c % K, sums[t, p, c]


def _by_key(keys, length):
    symbols = pa.array(list(ALPHABET))

    def run(batches):
        held, size, kept, last = [], 0, {}, {}
        keep = not keys and _one_run(length, 1)  # counted on from batch to batch, sent once

        def batch(key, i, j, sums):
            _, p1, p2, s1, s2, n = _cells(i, j, sums)
            cols = [pa.repeat(v, len(n)) for v in key]
            return pa.RecordBatch.from_arrays([*cols, pa.array(p1), pa.array(p2), symbols.take(pa.array(s1)), symbols.take(pa.array(s2)), pa.array(n)], names=[*keys, "p1", "p2", "s1", "s2", "n"])

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x, w = _codes(rows.column("seq"), length), rows.column("w").to_numpy() if "w" in rows.column_names else None
            group, firsts = np.zeros(len(x), np.int64), [0]
            if keys:  # numbers for the combinations of key values
                for k in keys:
                    own = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                    group = group * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
                    group = np.unique(group, return_inverse=True)[1]
                firsts = np.unique(group, return_index=True)[1]
            order = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[order], np.arange(len(firsts) + 1))
            for g, f in enumerate(firsts):
                own = order[ends[g] : ends[g + 1]] if keys else slice(None)
                mine = None if w is None else w[own]

                def add(sums, flat, part, mine=mine):
                    if mine is None:
                        sums[0] += np.bincount(flat.ravel(), minlength=sums.shape[1])
                    else:
                        sums[0] += np.bincount(flat.ravel(), np.tile(mine[part], len(flat)), sums.shape[1])

                for i, j, sums in _pair_sums(x[own], add, 1, kept if keep else None):
                    if keep:
                        last[0] = (i, j, sums)
                    else:
                        yield batch([rows.column(k)[int(f)] for k in keys], i, j, sums)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows * length
            if size >= (HELD_BYTES if keep else WIDE_BYTES):
                yield from flush()
                size = 0
        if held:
            yield from flush()
        for i, j, sums in last.values():
            yield batch([], i, j, sums)

    return run


def pairs(rows: DataFrame, length: int, weights: DataFrame | None = None, keys=()) -> DataFrame:
    """The same from rows (*keys, seq_id, seq) of ``length`` symbols, however many: each task counts its rows' pairs of
    columns in runs, so what it holds doesn't grow with the square of the columns, and only counts are shuffled.
    Weights: a table of them (*keys, seq_id, w), or a column w of the rows.

    Raises ``UnequalLengths`` for a row of another length (or none) and ``ValueError`` for a symbol outside the alphabet.
    """
    ship(rows.sparkSession)
    if weights is not None:
        rows = rows.join(weights, [*keys, "seq_id"])
    weighed = "w" in rows.columns
    types = dict(rows.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in keys) + "p1 int, p2 int, s1 string, s2 string, n double"
    w = [F.col("w").cast("double")] if weighed else []
    got = rows.select(*keys, "seq", *w).mapInArrow(_by_key(list(keys), length), schema)
    return got.groupBy(*keys, "p1", "p2", "s1", "s2").agg(F.sum("n").alias("n"))


def _by_table(names, length, share, halves):
    """Counts of one and of two columns of every table at once; ``share`` (tables, length, 21): by what a symbol of a
    column adds to a sequence's weight, or None for weights of 1 (or those in column w)."""
    symbols, tables = pa.array(list(ALPHABET)), len(names)
    split, subset = pa.array([s for s, _ in names], pa.int32()), pa.array([s for _, s in names])

    def batch(t, p1, p2, s1, s2, n):
        two = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.string())] if p2 is None else [pa.array(p2), symbols.take(pa.array(s2))]
        t = pa.array(t)
        return pa.RecordBatch.from_arrays([split.take(t), subset.take(t), pa.array(p1, pa.int32()), two[0], symbols.take(pa.array(s1)), two[1], pa.array(n)], names=["split", "subset", "p1", "p2", "s1", "s2", "n"])

    def run(batches):
        held, size, kept, last = [], 0, {}, {}
        keep, one = _one_run(length, tables), np.zeros((tables, length, K))
        parts = share.value if share is not None else None

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = _codes(rows.column("seq"), length)
            times = _fixed(rows.column("times"), "<u2", tables)
            weight = None
            if parts is not None:
                weight = sum(parts[:, c, :].T[x[:, c]] for c in range(length)) * times
            elif "w" in rows.column_names:
                weight = _fixed(rows.column("w"), "<f8", tables) * times
            if weight is not None:
                use = [(t, np.flatnonzero(times[:, t]), np.ascontiguousarray(weight[:, t])) for t in range(tables)]
            else:
                use = [(t, np.repeat(np.arange(len(x)), times[:, t]), None) for t in range(tables)]
            both = np.flatnonzero((times[:, 0] > 0) & (times[:, 1] > 0)) if halves else None

            def add(sums, flat, part):
                a, b = part.start, min(part.stop, len(x))
                every = lambda where: np.bincount(flat[:, where - a].ravel(), minlength=sums.shape[1])
                own = lambda r: r[np.searchsorted(r, a) : np.searchsorted(r, b)]
                if halves and weight is None:  # the second half is all but the first, and what is in both
                    whole = np.bincount(flat.ravel(), minlength=sums.shape[1]) + every(own(both))
                for t, rows_, w in use:
                    mine = own(rows_)
                    if w is not None:
                        sums[t] += np.bincount(flat[:, mine - a].ravel(), np.tile(w[mine], len(flat)), sums.shape[1])
                    elif halves and t % 2:
                        sums[t] += whole - first
                    else:
                        first = every(mine)
                        sums[t] += first

            for c in range(length):
                for t, rows_, w in use:
                    one[t, c] += np.bincount(x[rows_, c], None if w is None else w[rows_], K)
            for i, j, sums in _pair_sums(x, add, tables, kept if keep else None):
                if keep:
                    last[0] = (i, j, sums)
                else:
                    yield batch(*_cells(i, j, sums))

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows * (length + 2 * tables * (5 if parts is not None or "w" in b.schema.names else 1))
            if size >= (HELD_BYTES if keep else WIDE_BYTES):
                yield from flush()
                size = 0
        if held:
            yield from flush()
        for i, j, sums in last.values():
            yield batch(*_cells(i, j, sums))
        t, p, k = np.nonzero(one)
        yield batch(t, p.astype(np.int32), None, k, None, one[t, p, k])

    return run


def of_tables(rows: DataFrame, names, length: int, halves: bool = False, share: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """(single, pair), with keys split and subset, of all resampled tables in one pass over rows (seq_id, seq, times).

    ``times``: for each of ``names`` (split, subset) an unsigned little-endian 16-bit number, how often the row is in
    that table. No row is copied: a task adds its rows to every table, and only counts are shuffled. ``halves``: the
    tables are halves by turns, each row in one of two or in both. Weights: ``share`` or a column ``w`` of as many
    doubles. Both results are settled.
    """
    ship(rows.sparkSession)
    tables = len(names)
    sent = rows.sparkSession.sparkContext.broadcast(share) if share is not None else None
    rows = rows.select("seq", "times", *(c for c in ("w",) if c in rows.columns and share is None))
    step = max(2, MOST_TABLES)
    out = None
    for a in range(0, tables, step):
        some = list(names[a : a + step])
        cut = lambda c, wide: F.substring(c, a * wide + 1, len(some) * wide)  # noqa: E731, B023
        mine = rows if tables <= step else rows.withColumns({c: cut(c, n) for c, n in (("times", 2), ("w", 8)) if c in rows.columns})
        part = rows.sparkSession.sparkContext.broadcast(share[a : a + step]) if share is not None and tables > step else sent
        got = mine.mapInArrow(_by_table(some, length, part, halves), "split int, subset string, p1 int, p2 int, s1 string, s2 string, n double")
        out = got if out is None else out.union(got)
    got = settle(out.groupBy("split", "subset", "p1", "p2", "s1", "s2").agg(F.sum("n").alias("n")), "counts")
    one = got.where("p2 is null").select("split", "subset", F.col("p1").alias("pos"), F.col("s1").alias("sym"), "n")
    return one, got.where("p2 is not null")


def _singles_by_table(names, length):
    def run(batches):
        split, subset = pa.array([s for s, _ in names], pa.int32()), pa.array([s for _, s in names])
        total = np.zeros((len(names), length, K))
        for b in batches:
            x = _codes(b.column("seq"), length)
            times = _fixed(b.column("times"), "<u2", len(names))
            for t in range(len(names)):
                own = x[np.repeat(np.arange(len(x)), times[:, t])]
                total[t] += np.bincount((own + K * np.arange(length)).ravel(), minlength=K * length).reshape(length, K)
        t, p, k = np.nonzero(total)
        of = pa.array(t)
        yield pa.RecordBatch.from_arrays([split.take(of), subset.take(of), pa.array(p, pa.int32()), pa.array(list(ALPHABET)).take(pa.array(k)), pa.array(total[t, p, k])], names=["split", "subset", "pos", "sym", "n"])

    return run


def single_counts(rows: DataFrame, names, length: int) -> DataFrame:
    """(split, subset, pos, sym, n): unweighted counts of one column in all tables, as in ``of_tables``."""
    ship(rows.sparkSession)
    got = rows.select("seq", "times").mapInArrow(_singles_by_table(list(names), length), "split int, subset string, pos int, sym string, n double")
    return got.groupBy("split", "subset", "pos", "sym").agg(F.sum("n").alias("n"))


def henikoff_share(single: DataFrame, names, length: int) -> np.ndarray:
    """(tables, length, 21): what a symbol adds to its sequence's weight, from unweighted counts of one column.

    A column adds up to one over all sequences, so the sum of weights is the length and the scale to the number of
    sequences needs no pass over them. Tables times columns times 21 numbers come to the driver.
    """
    at = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(names), length, K))
    for r in single.toLocalIterator():
        out[at[r["split"], r["subset"]], r["pos"], ALPHABET.index(r["sym"])] = r["n"]
    n = out.sum(2, keepdims=True)
    kinds = (out > 0).sum(2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(out > 0, n / (length * kinds * out), 0.0)


def _weighted_singles(length):
    def run(batches):
        total = np.zeros(length * K)
        for b in batches:
            x = _codes(b.column("seq"), length).astype(np.intp) + K * np.arange(length)
            w = b.column("w").to_numpy() if "w" in b.schema.names else None
            total += np.bincount(x.ravel(), None if w is None else np.repeat(w, length), length * K)
        at = np.flatnonzero(total)
        symbols = pa.array(list(ALPHABET)).take(pa.array(at % K))
        yield pa.RecordBatch.from_arrays([pa.array((at // K).astype(np.int32)), symbols, pa.array(total[at])], names=["pos", "sym", "n"])

    return run


def singles_of_rows(rows: DataFrame, length: int) -> DataFrame:
    """(pos, sym, n) from rows (seq) of ``length`` symbols, by a column w if they have one: cells are never made."""
    ship(rows.sparkSession)
    w = [F.col("w").cast("double")] if "w" in rows.columns else []
    got = rows.select("seq", *w).mapInArrow(_weighted_singles(length), "pos int, sym string, n double")
    return got.groupBy("pos", "sym").agg(F.sum("n").alias("n"))


def symbol_table(q: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(s), F.lit(float(v))) for s, v in q.items()))


def prior(kind: str, single: DataFrame | None = None) -> dict[str, float]:
    """The distribution that is mixed in: uniform, of residues in general, or pooled over all columns (21 sums)."""
    if kind == "bg":
        total = sum(BACKGROUND.values())
        return {s: BACKGROUND.get(s, 0.0) / total for s in ALPHABET}
    if kind == "emp":
        n = {r["sym"]: r["n"] for r in single.groupBy("sym").agg(F.sum("n").alias("n")).collect()}
        total = sum(n.values())
        return {s: n.get(s, 0.0) / total for s in ALPHABET}
    if kind in ("none", "fix", "inc"):
        return dict.fromkeys(ALPHABET, 1 / len(ALPHABET))
    raise ValueError(f"no such pseudocounts: {kind}")


def mixing_share(kind: str, total: Column, mix: float = 0.5, lam: float = 1.0) -> Column:
    """How much of the prior goes into the estimate; ``total``: the sum of weights."""
    if kind == "none":
        return F.lit(0.0)
    if kind == "fix":
        return F.lit(21.0 * lam) / (F.lit(21.0 * lam) + total)
    if kind in ("inc", "bg", "emp"):
        return F.lit(float(mix))
    raise ValueError(f"no such pseudocounts: {kind}")


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def consensus(single: DataFrame, n: int = 1, keys=(), gaps: DataFrame | None = None) -> DataFrame:
    """(*keys, pos, sym, score, place): the ``n`` best symbols of each column by frequency times information.

    Frequencies are over symbols other than gaps; a column's information is weighted by its share of them: that of
    ``gaps`` (*keys, pos, gap), such as the unweighted ``gap_frequency`` beside weighted counts, or else of ``single``.
    Ties go by the order of the alphabet.
    """
    by = Window.partitionBy(*keys, "pos")
    total, none = F.sum("n").over(by), F.sum(F.when(F.col("sym") == GAP, F.col("n")).otherwise(0.0)).over(by)
    rows = single.withColumn("held", total - none).withColumn("filled", (total - none) / total).where(F.col("sym") != GAP)
    if gaps is not None:
        rows = rows.join(gaps, [*keys, "pos"]).withColumn("filled", 1 - F.col("gap"))
    rows = rows.withColumn("p", F.col("n") / F.col("held"))
    info = F.sum(F.col("p") * F.log2(F.col("p") + 1e-12)).over(by)  # symbols that don't occur add nothing
    rows = rows.withColumn("score", F.col("p") * F.col("filled") * (F.lit(float(np.log2(20))) + info))
    place = F.row_number().over(by.orderBy(F.desc(F.round("score", 8)), F.instr(F.lit(ALPHABET), F.col("sym"))))
    return rows.withColumn("place", place).where(F.col("place") <= n).select(*keys, "pos", "sym", "score", "place")
