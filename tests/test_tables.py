"""Counting all resampled tables in one pass, wide alignments, and weights over whole alignments."""

import itertools
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairglass.operators import alignment as al
from pairglass.operators import counts as ct
from pairglass.operators import resample as rs
from pairglass.operators import weights as wt
from pairglass.plans import pipeline as pl

KEYS = ("split", "subset")


def made(spark, n, length, symbols="ACDE-", seed=1, copies=0):
    rng = np.random.default_rng(seed)
    seqs = ["".join(rng.choice(list(symbols), length)) for _ in range(n)]
    seqs += [seqs[int(k)] for k in rng.integers(0, n, copies)]
    return spark.createDataFrame([(f"s{i:04d}", t) for i, t in enumerate(seqs)], "seq_id string, seq string").repartition(3), seqs


def as_dict(df, *keys, value="n"):
    got = df.collect()
    out = {tuple(r[k] for k in keys): r[value] for r in got}
    assert len(out) == len(got)
    return out


def brute_pairs(seqs):
    return Counter((i, j, t[i], t[j]) for t in seqs for i, j in itertools.combinations(range(len(t)), 2))


@pytest.mark.parametrize("cells", [1 << 22, 441 * 7])
def test_wide_alignment(spark, cells):
    """More columns than a matrix product over all symbols could hold, and runs of a few pairs."""
    rows, seqs = made(spark, 40, 150)
    assert as_dict(ct.pairs(rows, 150), "p1", "p2", "s1", "s2") == brute_pairs(seqs)
    x = np.array([[al.ALPHABET.index(c) for c in t[:20]] for t in seqs], np.uint8)
    old, ct.TILE_CELLS = ct.TILE_CELLS, cells
    try:
        got = Counter()

        def add(sums, flat, part):
            sums[0] += np.bincount(flat.ravel(), minlength=sums.shape[1])

        for i, j, sums in ct._pair_sums(x, add, 1):
            _, p1, p2, a, b, n = ct._cells(i, j, sums)
            got.update({(int(p), int(q), al.ALPHABET[s], al.ALPHABET[t]): int(v) for p, q, s, t, v in zip(p1, p2, a, b, n)})
    finally:
        ct.TILE_CELLS = old
    assert got == brute_pairs([t[:20] for t in seqs])


def test_pairs_by_keys_with_nulls(spark):
    rows, _ = made(spark, 60, 6, copies=9)
    rows = rows.withColumns({"k": F.when(F.col("seq_id") < "s0020", "a").when(F.col("seq_id") < "s0040", "b"), "l": F.lit(3)})
    got = as_dict(ct.pairs(rows, 6, None, ("k", "l")), "k", "l", "p1", "p2", "s1", "s2")
    want = Counter()
    for r in rows.collect():
        want.update({(r["k"], 3, *c): n for c, n in brute_pairs([r["seq"]]).items()})
    assert got == want


def test_pairs_refuse_other_rows(spark):
    for rows, error in (([("a", "AC"), ("b", "ACD")], "UnequalLengths"), ([("a", "A?")], "outside the alphabet"), ([("a", None)], "UnequalLengths")):
        with pytest.raises(Exception, match=error):
            ct.pairs(spark.createDataFrame(rows, "seq_id string, seq string"), 2).collect()
    assert ct.pairs(spark.createDataFrame([], "seq_id string, seq string"), 5).count() == 0


@pytest.mark.parametrize("method", ["null", "splithalf", "bootstrap"])
@pytest.mark.parametrize("weights", ["unweighted", "henikoff", "similarity", "symmpurge"])
def test_tables_equal_copied_rows(spark, method, weights):
    """One pass over the rows gives what counting every resampled row gives."""
    rows, _ = made(spark, 33, 7, copies=8)
    n, canonical = 3, "s0004"
    parts = rs.resample(rows, method, n, canonical)
    w = None if weights == "unweighted" else wt.sequence_weights(parts, al.cells(parts, KEYS), weights, 0.4, KEYS)
    t = rs.tables(rows, method, n, canonical)
    if weights == "henikoff":
        one, two = ct.of_tables(t.rows, t.names, 7, t.halves, ct.henikoff_share(ct.single_counts(t.rows, t.names, 7), t.names, 7))
    elif w is not None:
        one, two = ct.of_tables(wt.weights_of_tables(t.rows, len(t.names), weights, 0.4), t.names, 7, t.halves)
    else:
        one, two = ct.of_tables(t.rows, t.names, 7, t.halves)
        assert as_dict(one, *KEYS, "pos", "sym") == as_dict(ct.single_counts(t.rows, t.names, 7), *KEYS, "pos", "sym")
    plain = lambda d: {k: v for k, v in d.items() if abs(v) > 1e-12}
    assert plain(as_dict(one, *KEYS, "pos", "sym")) == pytest.approx(plain(as_dict(ct.singles(al.cells(parts, KEYS), w, KEYS), *KEYS, "pos", "sym")))
    assert plain(as_dict(two, *KEYS, "p1", "p2", "s1", "s2")) == pytest.approx(plain(as_dict(ct.pairs(parts, 7, w, KEYS), *KEYS, "p1", "p2", "s1", "s2")))


def test_tables_beyond_one_job(spark, monkeypatch):
    rows, _ = made(spark, 20, 4)
    t = rs.tables(rows, "splithalf", 5, "s0000")
    want = as_dict(ct.of_tables(t.rows, t.names, 4, True)[1], *KEYS, "p1", "p2", "s1", "s2")
    share = ct.henikoff_share(ct.single_counts(t.rows, t.names, 4), t.names, 4)
    heavy = as_dict(ct.of_tables(t.rows, t.names, 4, True, share)[1], *KEYS, "p1", "p2", "s1", "s2")
    monkeypatch.setattr(ct, "MOST_TABLES", 4)
    assert as_dict(ct.of_tables(t.rows, t.names, 4, True)[1], *KEYS, "p1", "p2", "s1", "s2") == want
    assert as_dict(ct.of_tables(t.rows, t.names, 4, True, share)[1], *KEYS, "p1", "p2", "s1", "s2") == pytest.approx(heavy)


def test_tables_of_few_rows(spark):
    from pairglass.operators.alignment import NoCanonical

    one = spark.createDataFrame([("a", "AC")], "seq_id string, seq string")
    t = rs.tables(one, "splithalf", 2)
    assert as_dict(ct.of_tables(t.rows, t.names, 2, t.halves)[1], *KEYS, "s1", "s2") == {(1, "b", "A", "C"): 1, (2, "b", "A", "C"): 1}
    none = one.where("false")
    t = rs.tables(none, "splithalf", 2)
    assert ct.of_tables(t.rows, t.names, 2, t.halves)[0].count() == 0
    with pytest.raises(NoCanonical):
        rs.tables(none, "bootstrap", 2, "a")


def test_pipeline_counts_the_same_either_way(spark):
    rows, _ = made(spark, 30, 6)
    p = pl.Pipeline(rows, "s0003", pl.Parameters(num_partitions=2, gap=0.5))
    a, b = p.counts(), p.counts(p.resample())
    assert as_dict(a.pair, *KEYS, "p1", "p2", "s1", "s2") == pytest.approx(as_dict(b.pair, *KEYS, "p1", "p2", "s1", "s2"))
    assert as_dict(a.single, *KEYS, "pos", "sym") == pytest.approx(as_dict(b.single, *KEYS, "pos", "sym"))


def brute_degrees(seqs, cutoff):
    x = np.array([list(t) for t in seqs])
    return [int(((x == x[k]).mean(1) > cutoff).sum()) - (1 > cutoff) for k in range(len(x))]


def brute_pruned(seqs, threshold):
    x, out = np.array([list(t) for t in seqs]), []
    for k in range(len(x)):
        both = (x == "-") & (x[k] == "-")
        if not (((x == x[k]) & ~both).sum(1) > threshold * (~both).sum(1))[k + 1 :].any():
            out.append(f"s{k:04d}")
    return out


@pytest.mark.parametrize("length", [5, 33, 70, 130])
def test_whole_alignment_against_brute_force(spark, length):
    """Several tiles, copies in many of them, words of 32 and 64 columns and more than one of them."""
    rows, seqs = made(spark, 700, length, "AC-" if length < 10 else "ACDEFGHIKLMNPQRSTVWY-", copies=300)
    for cutoff in (0.0, 0.12, 0.6, 0.999, 1.0):
        got = as_dict(wt.degrees(rows, cutoff), "seq_id", value="degree")
        assert [got[f"s{k:04d}",] for k in range(len(seqs))] == brute_degrees(seqs, cutoff)
    for threshold in (0.1, 0.5, 0.95):
        assert sorted(r["seq_id"] for r in wt.prune_by_similarity(rows, threshold).collect()) == brute_pruned(seqs, threshold)


@pytest.mark.parametrize(("length", "symbols", "tile"), [(24, "ACDE-", 1 << 17), (24, "ACDEFGHIKLMNPQRSTVWY-", 1 << 17), (22, "AC-", 60)])
def test_many_rows_meet_by_shared_columns(spark, monkeypatch, length, symbols, tile):
    """Only pairs with shared columns are compared, and none that is alike is missed or counted twice."""
    calls = []
    monkeypatch.setattr(wt, "MANY", 1)
    monkeypatch.setattr(wt.alike, "TILE", tile)
    monkeypatch.setattr(wt.alike, "sums", lambda *a, inner=wt.alike.sums: calls.append(a[2]) or inner(*a))
    rows, seqs = made(spark, 500, length, symbols, copies=200)
    for cutoff in (0.42, 0.7, 0.96):
        got = as_dict(wt.degrees(rows, cutoff), "seq_id", value="degree")
        assert [got[f"s{k:04d}",] for k in range(len(seqs))] == brute_degrees(seqs, cutoff)
    for threshold in (0.5, 0.8):
        assert sorted(r["seq_id"] for r in wt.prune_by_similarity(rows, threshold).collect()) == brute_pruned(seqs, threshold)
    assert len(calls) == 5
    one_name = spark.createDataFrame([("a", "A" * 24), ("a", "C" + "A" * 23), (None, "D" + "A" * 23), ("b", "-" * 24), ("c", "-" * 24)], "seq_id string, seq string")
    assert sorted((r["seq_id"] or "", r["seq"][0]) for r in wt.prune_by_similarity(one_name, 0.5).collect()) == [("", "D"), ("a", "A"), ("a", "C"), ("b", "-"), ("c", "-")]


def test_pairs_that_share_too_little_are_compared_by_tiles():
    assert wt.alike.meeting(24, 9) is None and wt.alike.meeting(33, 33) is None
    assert sum(len(x) for x in wt.alike.meeting(24, 10).values()) == 8 + 9 * 28
    for least in range(10, 25):  # each set of so many columns holds some of these
        rng = np.random.default_rng(least)
        for _ in range(300):
            held = set(rng.choice(24, least, replace=False).tolist())
            assert any({*first, *more} <= held for first, some in wt.alike.meeting(24, least).items() for more, *_ in some)


def test_whole_alignment_of_odd_rows(spark):
    df = lambda *r: spark.createDataFrame(list(r), "seq_id string, seq string")
    assert wt.degrees(df(), 0.5).count() == 0 and wt.prune_by_similarity(df()).count() == 0
    assert {r["seq_id"] for r in wt.prune_by_similarity(df(("a", "--"), ("b", "--"))).collect()} == {"a", "b"}  # nothing held
    assert [r["degree"] for r in wt.degrees(df(("a", "AX"), ("b", "AX"), ("b", "AX")), 0.5).collect()] == [2, 2, 2]
    assert {r["seq_id"] for r in wt.prune_by_similarity(df(("a", "ACD"), ("b", "ACE")), 0.9, rf="xx.").collect()} == {"b"}


def test_one_group_isnt_one_task(spark):
    rows, _ = made(spark, 900, 12)
    grid = wt._grid(rows.groupBy("seq").agg(F.count("*").alias("n")), [], ["n"], 12)
    tasks = grid.groupBy("i", "j").count().collect()
    assert len(tasks) == 10 and max(r["count"] for r in tasks) < 700


def test_pair_counts_hold_little():
    """What a task holds doesn't grow with its rows, and its sums go out once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    seqs = ["".join(r) for r in rng.choice(list(al.ALPHABET), (2000, 24))]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs * 100)], names=["seq"])
    tracemalloc.start()
    out = list(ct._by_key([], 24)(iter([batch] * 8)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1 and sum(out[0].column("n").to_pylist()) == 8 * len(batch) * 276
    assert peak < 120e6


def test_table_counts_hold_little():
    """The same of the counts of all halves: four times the rows take no more memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    names = [(k, s) for k in (1, 2, 3) for s in "ab"]
    first = rng.integers(0, 2, (20_000, 3))
    times = np.stack([first, 1 - first], 2).reshape(20_000, 6).astype("<u2")
    seqs = ["".join(r) for r in rng.choice(list(al.ALPHABET), (20_000, 24))]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs), pa.array([t.tobytes() for t in times], pa.binary())], names=["seq", "times"])
    peaks = []
    for many in (10, 40):
        tracemalloc.start()
        out = list(ct._by_table(names, 24, None, True)(iter([batch] * many)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        n = sum(sum(b.column("n").to_pylist()) for b in out if b.column("p2").null_count == 0)
        assert len(out) == 2 and n == many * 3 * len(batch) * 276
    assert peaks[1] < 1.1 * peaks[0] < 120e6


def test_weights_of_rows(spark):
    """Weights by rows are those by cells, repeated and null names included; of unique names no row is shuffled."""
    data = [("a", "ACD-E"), ("b", "ACDFE"), ("b", "GCDFE"), (None, "ACWFE"), (None, "-CWFE"), ("c", "ACDFE")]
    rows = spark.createDataFrame(data, "seq_id string, seq string")
    want = {r["seq_id"]: r["w"] for r in wt.henikoff(al.cells(rows)).collect()}
    assert {r["seq_id"]: r["w"] for r in wt.henikoff_by_name(rows, 5).collect()} == pytest.approx(want)
    got = wt.henikoff_of_rows(rows, 5)
    assert sorted((r["seq_id"], round(r["w"], 9)) for r in got.collect()) == sorted((k, round(want[k], 9)) for k, _ in data if k)
    n = {(r["pos"], r["sym"]): r["n"] for r in ct.singles(al.cells(rows), wt.henikoff(al.cells(rows))).collect()}
    assert {(r["pos"], r["sym"]): r["n"] for r in ct.singles_of_rows(got, 5).collect()} == pytest.approx(n)
    once = spark.createDataFrame([d for d in data if d[0] in ("a", "c")], "seq_id string, seq string")
    plan = wt.henikoff_of_rows(once, 5, unique=True)
    assert "Exchange" not in plan._jdf.queryExecution().toString()
    assert {r["seq_id"]: r["w"] for r in plan.collect()} == pytest.approx({r["seq_id"]: r["w"] for r in wt.henikoff(al.cells(once)).collect()})


def test_symbol_counts_by_join_shuffle_no_cells(spark, tmp_path):
    from pairglass.plans import queries as q

    texts = ["Acde fghik lmnpq rstvw yacde fgh", "acdd", None, "Wvtsr qpnml kihgf edcay wvtsr qpn"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    as_list = lambda df: sorted((r["p1"], r["p2"], r["s1"], r["s2"], r["n"]) for r in df.collect())
    got = q.QUERIES["symbol_counts_by_join"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().toString()
    assert as_list(got) == as_list(ct.pairs_by_join(q.cells(spark, str(tmp_path))))


def test_residues_of_rows(spark):
    rows, _ = made(spark, 30, 7)
    want = {}
    for r in al.positions(al.cells(rows)).collect():
        want.setdefault(r["seq_id"], {})[r["pos"]] = r["residue"]
    got = al.residues_of_rows(rows)
    assert {r["seq_id"]: dict(enumerate(r["residues"])) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_small_alignments_share_a_task(spark, monkeypatch):
    """Alignments packed together are as each by itself, with repeated and null names and null keys; a row is shuffled once."""
    rng = np.random.default_rng(5)
    data = [(f"d{i % 9}" if i % 13 else None, f"s{i % 50:02d}" if i % 11 else None, "".join(rng.choice(list("AC-"), 6))) for i in range(120)]
    rows = spark.createDataFrame(data, "doc string, seq_id string, seq string")

    def taken(df):
        return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())

    def every():
        return [wt.by_similarity(rows, 0.5, ("doc",)), wt.symmetric_purge(rows, 0.5, ("doc",)), wt.prune_by_similarity(rows, 0.6, keys=("doc",)), wt.prune_by_similarity(rows, 0.6, "xx-xx-", ("doc",))]

    got = every()
    assert all(f._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 2 for f in got)  # the plan is printed before and after
    got = [taken(f) for f in got]
    monkeypatch.setattr(wt, "_packed", lambda *_: None)
    for mine, want in zip(got, map(taken, every())):
        assert mine == want


def test_draws_are_shuffled_once(spark):
    rows, seqs = made(spark, 50, 5)
    t = rs.tables(rows, "bootstrap", 3)
    times = np.array([np.frombuffer(r["times"], "<u2") for r in t.rows.collect()])
    assert times.shape == (50, 3) and (times.sum(0) == 50).all()
    plan = t.rows._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(ord#" in line and "split#" in line for line in plan.splitlines())


@pytest.mark.parametrize(("symbols", "wide"), [("AC-", 256), ("ACD-", 8), ("ACDEFGHIKLMNPQRSTVWY-", 256)])
def test_many_rows_are_compared_in_rounds(spark, monkeypatch, symbols, wide):
    """One key a round, over several tiles; groups of all kinds, and rows that earlier rounds have settled."""
    monkeypatch.setattr(wt, "MANY", 1)
    for name, value in (("TILE", 150), ("ROUND_BYTES", 1), ("WIDE", wide), ("HITS", 500)):
        monkeypatch.setattr(wt.alike, name, value)
    rounds = []
    monkeypatch.setattr(wt.alike, "settle", lambda df, name, inner=wt.alike.settle, **k: rounds.append(name) or inner(df, name, **k))
    rows, seqs = made(spark, 400, 24, symbols, seed=3, copies=100)
    got = as_dict(wt.degrees(rows, 0.6), "seq_id", value="degree")
    assert [got[f"s{k:04d}",] for k in range(len(seqs))] == brute_degrees(seqs, 0.6)
    assert sorted(r["seq_id"] for r in wt.prune_by_similarity(rows, 0.6).collect()) == brute_pruned(seqs, 0.6)
    assert rounds.count("alike") > 4


@pytest.mark.parametrize(("run", "most"), [(lambda rows: wt.prune_by_similarity(rows, 0.5), 12), (lambda rows: wt.symmetric_purge(rows, 0.42), 24)])
def test_round_leaves_no_shuffle_files(spark, monkeypatch, run, most):
    """Not more than one round's shuffle is on disk at once, however many keys there are."""
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    monkeypatch.setattr(wt, "MANY", 1)
    rows, _ = made(spark, 300, 24, "ACDE-")
    monkeypatch.setattr(wt.alike, "ROUND_BYTES", 1, raising=False)
    before = files()
    run(rows)
    for _ in range(50):
        if (left := files() - before) <= most:  # of counts and of the weights themselves
            break
        time.sleep(0.1)
    assert left <= most, left


def test_signatures_cover_pairs_once():
    """Each set of so many columns holds a signature, and each signature is at one key."""
    rng = np.random.default_rng(5)
    for length, least, rows in [(24, 10, 10**6), (24, 10, 10**9), (24, 13, 10**7), (24, 13, 10**9), (19, 16, 10**7), (24, 24, 10**6), (3, 3, 10)]:
        groups = wt.alike.grouped(length, least, rows, 0.09)
        assert sorted(c for columns, _ in groups for c in columns) == list(range(length)) and sum(t - 1 for _, t in groups) < least
        held = [(frozenset({*two, *more}), g) for two, some in wt.alike.signatures(groups).items() for more, g in some]
        assert len(set(held)) == len(held) and all(len(h) == groups[g][1] for h, g in held)
        for _ in range(20):
            some = set(rng.choice(length, least, replace=False).tolist())
            assert any(h <= some for h, _ in held)


def test_rows_of_one_name_dont_go_by_each_other():
    names = ["", "a", "a", "b", "c", "c", "c", "c", "d"]
    cut = lambda *at: [pa.RecordBatch.from_pydict({"last": names[a:b]}) for a, b in zip((0, *at), (*at, len(names)))]
    for at in ((), (2,), (5, 6), (0, 4, 8)):
        assert [n for b in wt._tied(cut(*at)) for n in b.column("n").to_pylist()] == [0, 0, 1, 0, 0, 1, 2, 3, 0]


def test_nearly_equal_rows_meet_at_few_keys():
    """16 of the 19 columns of the reference line (prune_similarity_reference): a row is shuffled four times at most."""
    for rows in (10**6, 10**7, 10**8):
        plan = wt.alike.signatures(wt.alike.grouped(19, 16, rows, 0.09))
        assert len(plan) <= 4 and sum(len(x) for x in plan.values()) <= 20
        assert rows < 10**7 or min(len(more) for some in plan.values() for more, _ in some) >= 4  # six columns are shared, and not three
