import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairglass.functions.text import record_fields
from pairglass.operators import accuracy as acc
from pairglass.operators import alignment as al
from pairglass.operators import counts as ct
from pairglass.operators import graphs as gr
from pairglass.operators import potts
from pairglass.operators import resample as rs
from pairglass.operators import scorers as sc
from pairglass.operators import weights as wt
from pairglass.plans import pipeline as pl
from pairglass.sources import formats as fm
from pairglass.streaming.counts import streaming_pairs

SEQS = ["ACDE-", "ACDEF", "ACKEF", "GCKE-", "GLKDF", "GLKDW"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(SEQS)], "seq_id string, seq string")


def as_dict(df, *keys, value="score"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def brute_mi(seqs):
    n, out = len(seqs), {}
    h = lambda xs: -sum(c / n * math.log(c / n) for c in (xs.count(v) for v in set(xs)))
    for i, j in itertools.combinations(range(len(seqs[0])), 2):
        a, b = [s[i] for s in seqs], [s[j] for s in seqs]
        out[i, j] = h(a) + h(b) - h(list(zip(a, b)))
    return out


def test_mutual_information(spark, rows):
    c = sc.Counts(ct.singles(al.cells(rows)), ct.pairs(rows, 5))
    got = as_dict(sc.mi(c), "p1", "p2")
    assert got == pytest.approx(brute_mi(SEQS))


def test_pairs_both_ways(spark, rows):
    a = as_dict(ct.pairs(rows, 5), "p1", "p2", "s1", "s2", value="n")
    assert a == as_dict(ct.pairs_by_join(al.cells(rows)), "p1", "p2", "s1", "s2", value="n")
    w = wt.henikoff(al.cells(rows))
    a = as_dict(ct.pairs(rows, 5, w), "p1", "p2", "s1", "s2", value="n")
    assert a == pytest.approx(as_dict(ct.pairs_by_join(al.cells(rows), w), "p1", "p2", "s1", "s2", value="n"))
    b = as_dict(rows.select("seq").transform(lambda d: streaming_pairs(d, 5)), "p1", "p2", "s1", "s2", value="n")
    assert b == as_dict(ct.pairs(rows, 5), "p1", "p2", "s1", "s2", value="n")


def test_weights_sum_to_n(spark, rows):
    for w in (wt.henikoff(al.cells(rows)), wt.symmetric_purge(rows, 0.5)):
        assert sum(r["w"] for r in w.collect()) == pytest.approx(len(SEQS))
    near = lambda i, j: sum(a == b for a, b in zip(SEQS[i], SEQS[j])) / 5
    want = {(f"s{i}",): 1 / (1 + sum(near(i, j) > 0.5 for j in range(6) if j != i)) for i in range(6)}
    assert as_dict(wt.by_similarity(rows, 0.5), "seq_id", value="w") == pytest.approx(want)


@pytest.mark.parametrize("kind", ["none", "fix", "inc", "bg", "emp"])
def test_priors(spark, rows, kind):
    """Chi-squared and entropies by full tables."""
    c = sc.Counts(ct.singles(al.cells(rows)), ct.pairs(rows, 5), kind, 0.1)
    q = np.array([c.prior()[s] for s in al.ALPHABET])
    rho = {"none": 0.0, "fix": 21 / (21 + 6)}.get(kind, 0.1)
    cols, pi, pij = potts.estimates(c.single.toPandas(), c.pair.toPandas(), lambda t: rho, q)
    assert pi.sum(1) == pytest.approx(np.ones(5)) and pij.sum((2, 3)) == pytest.approx(np.ones((5, 5)))
    chi = as_dict(sc.fchisq(c), "p1", "p2")
    mi = as_dict(sc.mi(c), "p1", "p2")
    x = lambda p: float((p[p > 0] * np.log(p[p > 0])).sum())
    for i, j in itertools.combinations(range(5), 2):
        e, o = np.outer(pi[i], pi[j]), pij[i, j]
        assert chi[i, j] == pytest.approx(((o - e)[o > 0] ** 2 / e[o > 0]).sum())
        assert mi[i, j] == pytest.approx(x(o) - x(pi[i]) - x(pi[j]), abs=1e-9)


def test_dense_scores(spark, rows):
    c = sc.Counts(ct.singles(al.cells(rows)), ct.pairs(rows, 5), "inc", 0.5)
    for m in ("nmf", "nmfdi", "ipdi", "smdi", "ridge"):
        got = sc.score(c, m).collect()
        assert len(got) == 10 and all(math.isfinite(r["score"]) for r in got)
    s = np.array([[2.0, 0.6, 0.0], [0.6, 1.0, 0.0], [0.0, 0.0, 1.5]])
    assert potts.graphical_lasso(s, 0.0, 20_000, 1e-9) == pytest.approx(np.linalg.inv(s), abs=1e-4)
    assert potts.shrink(np.eye(2), np.array([[1.0, 2.0], [2.0, 1.0]]))[1] < 1


def brute_potts(seqs, name, mix=0.5):
    """The scores from their formulas, one pair of columns at a time, in plain numpy."""
    sym, q = al.ALPHABET, 21
    n, m = len(seqs), len(seqs[0])
    p1, p2 = np.zeros((m, q)), np.zeros((m, m, q, q))
    for t in seqs:
        for i in range(m):
            p1[i, sym.index(t[i])] += 1 / n
            for j in range(m):
                p2[i, j, sym.index(t[i]), sym.index(t[j])] += 1 / n
    p1 = (1 - mix) * p1 + mix / q
    p2 = (1 - mix) * p2 + mix / q**2
    for i in range(m):
        p2[i, i] = np.diag(p1[i])
    cov = np.zeros((m * q, m * q))
    for i in range(m):
        for j in range(m):
            cov[i * q : (i + 1) * q, j * q : (j + 1) * q] = p2[i, j] - np.outer(p1[i], p1[j])
    keep = [k for k in range(m * q) if k % q != q - 1]
    inverse = np.linalg.inv(cov[np.ix_(keep, keep)])
    block = lambda x, i, j, w: x[i * w : (i + 1) * w, j * w : (j + 1) * w]

    def information(e, i, j):
        w = np.ones((q, q))
        w[:20, :20] = np.exp(-e)
        x = y = np.full(q, 1 / q)
        for _ in range(10_000):
            u, v = p1[i] / (w @ y), p1[j] / (w.T @ x)
            u, v = u / u.sum(), v / v.sum()
            moved = max(abs(u - x).max(), abs(v - y).max())
            x, y = u, v
            if moved <= 1e-4:
                break
        joint = w * np.outer(x, y)
        joint /= joint.sum()
        return (joint * np.log(joint / np.outer(p1[i], p1[j]))).sum()

    out = {}
    prior = np.full(cov.shape, 2 * np.triu(cov).sum() / (len(cov) * (len(cov) - 1)))
    np.fill_diagonal(prior, np.diag(cov).mean())
    if name == "ridge":
        rho = 0.01
        while rho < 1 and np.linalg.eigvalsh(rho * prior + (1 - rho) * cov).min() <= 0:
            rho *= 1.1
        values, vectors = np.linalg.eigh(rho * prior + (1 - rho) * cov if rho < 1 else prior)
        theta = sum((math.sqrt(v * v + 0.04) - v) / 0.02 * np.outer(x, x) for v, x in zip(values, vectors.T))
    for i, j in itertools.combinations(range(m), 2):
        a, b = p1[i][:20, None], p1[j][None, :20]
        c, e = block(cov, i, j, q)[:20, :20], block(inverse, i, j, 20)
        two = np.log((1 + c / (a * b)) * (1 + c / ((1 - a) * (1 - b))) / ((1 - c / ((1 - a) * b)) * (1 - c / (a * (1 - b)))))
        if name == "nmf":
            w = -e
            s, t = w.sum(0)[None], w.sum(1)[:, None]
            out[i, j] = np.linalg.norm(w - s.T @ s - t @ t.T + w.sum())
        elif name == "ridge":
            out[i, j] = (block(theta, i, j, q)[:20, :20] ** 2).sum()
        else:
            x, y = 1 - 2 * a, 1 - 2 * b
            with np.errstate(invalid="ignore"):
                coupling = {"nmfdi": e, "ipdi": two, "smdi": -e + two - c / (a * (1 - a) * b * (1 - b) - c * c), "tapdi": (np.sqrt(1 - 2 * x * y * e) - 1) / (x * y)}[name]
            out[i, j] = information(coupling, i, j) if np.isfinite(coupling).all() else math.nan
    if name == "ridge":  # less the product of both columns' means over the mean
        mean = lambda k: np.mean([v for p, v in out.items() if k in p])
        every = np.mean(list(out.values()))
        out = {(i, j): v - mean(i) * mean(j) / every for (i, j), v in out.items()}
    return out


@pytest.mark.parametrize("name", ["nmf", "nmfdi", "ipdi", "smdi", "tapdi", "ridge"])
def test_potts_scores_by_formula(spark, name):
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACDEFG-"), 4)) for _ in range(30)]
    seqs = [t + t[0] for t in seqs]
    rows = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(seqs)], "seq_id string, seq string")
    c = sc.Counts(ct.singles(al.cells(rows)), ct.pairs(rows, 5), "inc", 0.5)
    got, want = as_dict(sc.score(c, name), "p1", "p2"), brute_potts(seqs, name)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9, nan_ok=True)


def test_unsettled_values_are_errors():
    with pytest.raises(potts.NotSettled):
        potts.graphical_lasso(np.array([[2.0, 0.6], [0.6, 1.0]]), 0.1, rounds=1)
    p = np.random.default_rng(1).dirichlet(np.ones(21), 2)
    assert not potts.direct_information(np.random.default_rng(2).normal(size=(1, 20, 20)), p[:1], p[1:], tolerance=0.0, most=2)[1].any()


def test_sparse_precision_is_stationary():
    """The lasso's optimality: the gradient is within the penalty, and on it wherever the precision isn't zero."""
    rng = np.random.default_rng(7)
    s = np.cov(rng.normal(size=(40, 6)).T) + 0.1 * np.eye(6)
    z = potts.graphical_lasso(s, 0.1, tolerance=1e-9)
    gradient = s - np.linalg.inv(z)
    off = ~np.eye(6, dtype=bool)
    assert np.abs(np.diag(gradient)).max() < 1e-6 and np.abs(gradient[off]).max() < 0.1 + 1e-6
    live = off & (np.abs(z) > 1e-7)
    assert gradient[live] == pytest.approx(-0.1 * np.sign(z[live]), abs=1e-6)


def whole_covariance(seqs, mix=0.5):
    """Half the covariance of all states and half its dense prior, from full tables."""
    sym, q = al.ALPHABET, 21
    n, m = len(seqs), len(seqs[0])
    one = np.zeros((n, m * q))
    for k, t in enumerate(seqs):
        one[k, [i * q + sym.index(c) for i, c in enumerate(t)]] = 1
    p = (1 - mix) * one.mean(0) + mix / q
    s = (1 - mix) * one.T @ one / n + mix / q**2
    for i in range(m):
        s[i * q : (i + 1) * q, i * q : (i + 1) * q] = np.diag(p[i * q : (i + 1) * q])
    s -= np.outer(p, p)
    return 0.5 * s + 0.5 * potts.prior_covariance(s)


@pytest.mark.parametrize("mix, alpha", [(0.5, 0.1), (0.1, 0.1), (0.1, 0.02), (0.02, 0.04)])
def test_screened_precision_equals_the_whole_one(spark, mix, alpha):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("ACD-"), 2)) for _ in range(60)]
    seqs = [t + ("A" if t[0] == "A" else rng.choice(list("CD"))) + t[1] for t in base]
    rows = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(seqs)], "seq_id string, seq string")
    c = sc.Counts(ct.singles(al.cells(rows)), ct.pairs(rows, 4), "inc", mix)
    s = whole_covariance(seqs, mix)
    want = potts.graphical_lasso(s, alpha)
    got = np.zeros(want.shape)
    for r in potts.sparse_precision(c, alpha).collect():
        got[r["u"], r["v"]] = got[r["v"], r["u"]] = r["precision"]
    off = ~np.eye(len(s), dtype=bool)
    assert got[off] == pytest.approx(want[off], abs=1e-6)
    gradient = s - np.linalg.inv(want)  # the optimality of the solution itself
    assert np.abs(gradient[off]).max() < alpha + 1e-5
    live = off & (np.abs(want) > 1e-6)
    assert gradient[live] == pytest.approx(-alpha * np.sign(want[live]), abs=1e-5)
    score = as_dict(potts.psicov(c, alpha), "p1", "p2")
    assert len(score) == 6
    for (i, j), v in score.items():
        assert v == pytest.approx(np.abs(want[i * 21 : i * 21 + 20, j * 21 : j * 21 + 20]).sum(), abs=1e-5)


def test_precision_by_keys(spark):
    """Two alignments at once give what each gives; the screen parts at least one of them."""
    rng = np.random.default_rng(9)
    rows = [(k, f"s{i}", (a := rng.choice(list("AC"))) + a + rng.choice(list("ACD"))) for k in (1, 2) for i in range(30)]
    both = spark.createDataFrame(rows, "split int, seq_id string, seq string")
    c = sc.Counts(ct.singles(al.cells(both, ("split",)), None, ("split",)), ct.pairs(both, 3, None, ("split",)), "inc", 0.1, keys=("split",))
    got = as_dict(sc.score(c, "psicov"), "split", "p1", "p2")
    for k in (1, 2):
        own = both.where(F.col("split") == k).drop("split")
        one = as_dict(sc.score(sc.Counts(ct.singles(al.cells(own)), ct.pairs(own, 3), "inc", 0.1), "psicov"), "p1", "p2")
        assert {p: v for (s, *p), v in ((x, v) for x, v in got.items()) for p in [tuple(p)] if s == k} == pytest.approx(one)
    assert any(v != 0 for v in got.values())


def brute_components(links):
    up = {x: x for e in links for x in e}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_forests_by_rounds(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(k, k + 1) for k in range(100, 140)]
    both = [(k, a, b) for k in (1, 2) for a, b in (links if k == 1 else links[: len(links) // 2])]
    got = as_dict(gr.components(spark.createDataFrame(both, "k int, u long, v long"), ("k",)), "k", "node", value="component")
    assert got == {(k, x): c for k, own in ((1, links), (2, links[: len(links) // 2])) for x, c in brute_components(own).items()}
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 25, (150, 2)) if a != b})
    edges = spark.createDataFrame([(k, a, b, float((a * 7 + b * 3 + k) % 5)) for k in (1, 2) for a, b in pairs], "k int, p1 int, p2 int, weight double")
    one_task = as_dict(gr.spanning_forest(edges, ("k",)), "k", "p1", "p2", value="weight")
    monkeypatch.setattr(gr, "FEW_EDGES", 0)
    assert as_dict(gr.spanning_forest(edges, ("k",)), "k", "p1", "p2", value="weight") == one_task
    assert gr.spanning_forest(edges.where("false"), ("k",)).count() == 0
    assert gr.components(spark.createDataFrame([], "u long, v long")).count() == 0


def atom(serial, residue, x, chain="A"):
    return f"ATOM  {serial:5d}  CB  ALA {chain}{residue:4d}    {x:8.3f}{0.0:8.3f}{0.0:8.3f}  1.00"


@pytest.mark.parametrize("block", ["128m", "200"])
def test_models_of_many_files(spark, tmp_path, block):
    """Models are counted within each file, also where a file is read in many blocks."""
    want = {}
    for f, models in (("a", 2), ("b", 3), ("c", 1), ("d", 0)):
        lines = ["HEADER    X"]
        for m in range(max(models, 1)):
            lines += [f"MODEL     {m + 1:4d}"] if models else []
            lines += [atom(k + 1, k + 1, 10 * m + k + ord(f)) for k in range(30)]
            lines += ["ENDMDL"] if models else []
        (tmp_path / f"{f}.pdb").write_text("\n".join([*lines, "END", ""]))
        for model in (0, 1, 2):
            m = model if model < models else 0
            want |= {(model, f, k + 1): 10.0 * m + k + ord(f) for k in range(30)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {}
        for model in (0, 1, 2):
            for r in fm.read_pdb(spark, str(tmp_path), model).collect():
                assert (key := (model, r["file"].rsplit("/", 1)[1][0], r["resseq"])) not in got
                got[key] = r["x"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert got == want


def test_spectral_and_nuclear_values(spark):
    a = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, 0.25), (1, 1, 2, 1.0), (2, 3, 7, 1.0)], "split int, p1 int, p2 int, weight double")
    b = spark.createDataFrame([(1, 0, 1, 0.1), (1, 1, 3, 2.0), (2, 3, 7, 4.0)], "split int, p1 int, p2 int, weight double")

    def matrix(rows):
        m = np.zeros((8, 8))
        for i, j, w in rows:
            m[i, j] = w
        return m / np.maximum(m.sum(0), 1e-8)

    d = {1: matrix([(0, 1, 0.5), (0, 2, 0.25), (1, 2, 1.0)]) - matrix([(0, 1, 0.1), (1, 3, 2.0)]), 2: np.zeros((8, 8))}
    for name, take in (("spectral", max), ("nuclear", sum)):
        want = {(k,): 1 / (1 + take(np.linalg.svd(m)[1])) for k, m in d.items()}
        assert as_dict(gr.similarity(a, b, name, ("split",)), "split", value="similarity") == pytest.approx(want)


def test_records_over_lines(spark):
    record = (
        "LOCUS       AB123  77 aa  linear\nDEFINITION  A long\n            name of it.\nACCESSION   AB123\nVERSION     AB123.1  GI:42\nDBLINK      GI:9\nSOURCE      x\n"
        "  ORGANISM  Escherichia coli K-12 substr. X\n            Bacteria.\nREFERENCE   1\n  TITLE     First half\n            second half\n  JOURNAL   J.\n  TITLE     Other\n"
        '     /strain="K"12"\nORIGIN\n        1 acd efg\n       61 hik\n//\n'
    )
    got = spark.createDataFrame([(record,)], "t string").select(*(c.alias(k) for k, c in record_fields(F.col("t")).items())).first()
    assert (got["locus"], got["length"], got["definition"], got["gi"], got["organism"]) == ("AB123", 77, "A long name of it.", "42", "Escherichia coli")
    assert got["title"].split() == ["First", "half", "second", "half"] and "\n" not in got["title"]
    assert (got["strain"], got["sequence"]) == ('K"12', "ACDEFGHIK")


def test_networks_that_pruning_empties_count(spark):
    whole = spark.createDataFrame([(1, "a", 0, 1, 2.0), (1, "b", 0, 1, 0.1), (2, "a", 0, 1, 0.1), (2, "b", 0, 1, 0.1)], "split int, subset string, p1 int, p2 int, weight double")
    pruned = gr.at_least(whole, 1.0)
    assert gr.consensus(pruned, of=whole).first()["weight"] == 0.25
    got = {r["split"]: r["similarity"] for r in gr.reproducibility_halves(pruned, "jaccard", of=whole).collect()}
    assert got == {1: 0.0, 2: 0.0}


def test_edge_without_distance(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "p1 int, p2 int, weight double")
    dist = spark.createDataFrame([(1, 2, 3.0), (2, 3, 5.0)], "i int, j int, d double")
    with pytest.raises(Exception, match="no distance of 1 and 3"):
        acc.mean_distance(edges, dist).collect()


def test_halves_by_order(spark):
    rows = spark.createDataFrame([(f"n{i}", "AC") for i in range(301)], "seq_id string, seq string")
    import hashlib

    got = {(r["split"], r["seq_id"]): r["subset"] for r in rs.split_half(rows, 2).collect()}
    for k in (1, 2):
        order = sorted(range(301), key=lambda i: (hashlib.md5(f"resample|{k}|n{i}".encode()).hexdigest(), f"n{i}"))
        assert {got[k, f"n{i}"] for i in order[:150]} == {"a"} and {got[k, f"n{i}"] for i in order[150:]} == {"b"}


def test_weights_and_pruning_by_key(spark):
    rows = spark.createDataFrame([("x", "a", "ACDE"), ("x", "b", "ACDF"), ("y", "c", "ACDE"), ("y", "d", "WWWW")], "doc string, seq_id string, seq string")
    assert as_dict(wt.by_similarity(rows, 0.5, ("doc",)), "seq_id", value="w") == {("a",): 0.5, ("b",): 0.5, ("c",): 1.0, ("d",): 1.0}
    assert {r["seq_id"] for r in wt.prune_by_similarity(rows, 0.5, keys=("doc",)).collect()} == {"b", "c", "d"}


def test_clean_project_and_records(spark, tmp_path):
    for part in ("alignments", "other"):
        (tmp_path / part).mkdir()
    assert fm.clean_project(spark, str(tmp_path)) == ["alignments"] and (tmp_path / "other").is_dir()
    d = spark.createDataFrame([("7", "ACD")], "gi string, sequence string")
    fm.write_records(d, str(tmp_path / "r"))
    assert fm.load_records(spark, str(tmp_path / "r")).collect() == d.collect()
    (tmp_path / "bad.nwk").write_text("1\t2\t0.5\tx\n")
    with pytest.raises(Exception):
        fm.read_network_text(spark, str(tmp_path / "bad.nwk")).collect()


def test_forest_and_similarity(spark):
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0), (4, 5, 1.0)], "p1 int, p2 int, weight double")
    assert {(r["p1"], r["p2"]) for r in gr.spanning_forest(edges).collect()} == {(0, 1), (1, 2), (4, 5)}
    for m in ("jaccard", "pearson", "spearman", "frobenius", "spectral", "nuclear"):
        assert gr.similarity(edges, edges, m).first()["similarity"] == pytest.approx(1.0)
    assert [(r["p1"], r["p2"]) for r in gr.top_n(edges, 2).collect()] == [(0, 1), (1, 2)]
    assert [(r["p1"], r["p2"]) for r in gr.bottom_n(edges, 1).collect()] == [(0, 2)]
    with pytest.raises(ValueError):
        gr.prune(edges, "nothing")


def test_resampling(spark, rows):
    h = rs.resample(rows, "splithalf", 3, "s0").groupBy("split", "subset").agg(F.collect_set("seq_id").alias("s")).collect()
    for k in (1, 2, 3):
        a, b = ({x for r in h if r["split"] == k and r["subset"] == s for x in r["s"]} for s in "ab")
        assert a | b == {f"s{i}" for i in range(6)} and a & b == {"s0"}
    assert rs.resample(rows, "bootstrap", 2, "s0").groupBy("split").count().collect()[0]["count"] == 7
    with pytest.raises(al.NoCanonical):
        rs.resample(rows, "null", 1, "nobody")


def test_unequal_lengths(spark):
    with pytest.raises(al.UnequalLengths):
        al.load(spark.createDataFrame([("a", "AC"), ("b", "A")], "seq_id string, seq string"))


def test_prune_by_similarity(spark):
    rows = spark.createDataFrame([("a", "ACDE-"), ("b", "ACDE-"), ("c", "GLKDF")], "seq_id string, seq string")
    assert {r["seq_id"] for r in wt.prune_by_similarity(rows).collect()} == {"b", "c"}


def test_accuracy(spark):
    scores = spark.createDataFrame([(1, 2, 3.0), (1, 3, 2.0), (2, 3, 1.0)], "p1 int, p2 int, score double")
    contact = spark.createDataFrame([(1, 2)], "i int, j int")
    assert acc.accuracy(scores, "hamming", contact).first()["accuracy"] == 1.0
    assert acc.accuracy(scores, "bacc", contact).first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        acc.accuracy(scores, "nothing", contact)


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nAC\nDE\n>y\nGG\n>x one\nKK\n")
    got = {r["seq_id"]: r["seq"] for r in fm.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"x one": "KK", "y": "GG"}
    fm.write_fasta(spark.createDataFrame(list(got.items()), "seq_id string, seq string").coalesce(1), str(tmp_path / "b"))
    assert {r["seq_id"]: r["seq"] for r in fm.read_fasta(spark, str(tmp_path / "b")).collect()} == got
    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\n#=GF ID x\n\nx  AC.\ny  GG-\n#=GC RF xx.\n\nx  D\ny  E\n#=GC RF x\n//\n")
    got = {r["seq_id"]: r["seq"] for r in fm.read_stockholm(spark, str(tmp_path / "a.sto")).collect()}
    assert got == {"x": "AC-D", "y": "GG-E", "#=GC RF": "xx-x"}
    fm.write_stockholm(spark.createDataFrame([("x", "A-")], "seq_id string, seq string"), str(tmp_path / "c"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["# STOCKHOLM 1.0", "x\tA.", "//"]
    (tmp_path / "r.gb").write_text('LOCUS       AB1  5 aa\nDEFINITION  thing\nVERSION  AB1 GI:77\n  ORGANISM  E. coli\n   /strain="K"\nORIGIN\n  1 acd ef\n//\nLOCUS  B  1 aa\nVERSION GI:78\n//\n')
    got = {r["gi"]: r for r in fm.read_records(spark, str(tmp_path / "r.gb")).collect()}
    assert got["77"]["sequence"] == "ACDEF" and got["77"]["strain"] == "K" and got["78"]["strain"] is None
    (tmp_path / "s.pdb").write_text("ATOM      1  CA  GLY A   1       0.000   0.000   0.000  1.00\nATOM      2  CB  ALA A   2       3.000   4.000   0.000  1.00\n")
    from pairglass.operators.structure import distances, representatives

    assert distances(representatives(fm.read_pdb(spark, str(tmp_path / "s.pdb")))).first()["d"] == 5.0
    net = spark.createDataFrame([(1, 2, 0.5, 1.0)], "p1 int, p2 int, score double, pvalue double")
    fm.write_network_text(net, str(tmp_path / "n"))
    assert fm.read_network_text(spark, str(tmp_path / "n")).collect() == net.collect()
    fm.write_database({"net": net}, {"a": 1}, str(tmp_path / "d"))
    tables, options = fm.read_database(spark, str(tmp_path / "d"), ["net"])
    assert tables["net"].count() == 1 and options == {"a": 1}


def test_record_fields_missing(spark):
    r = spark.createDataFrame([("nothing here",)], "t string")
    assert all(v is None for v in r.select(*(c.alias(k) for k, c in record_fields(F.col("t")).items())).first())


def test_pipeline_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"s{i:02}", "".join(rng.choice(list("ACDE"), 6))) for i in range(24)], "seq_id string, seq string")
    p = pl.Pipeline(rows, "s00", pl.Parameters(resampling_method="bootstrap", num_partitions=2, pruning="topn", number=5, swt_method="unweighted"))
    nets = p.networks(["mi", "mip"])
    assert nets.count() == 2 * 2 * 15
    assert {r["method"] for r in p.reproducibility(nets).collect()} == {"mi", "mip"}
    assert p.consensus(nets).agg(F.max("weight")).first()[0] <= 1.0
    assert p.voted(nets).count() == 30


def test_whole_texts_as_rows(spark):
    texts = [(1, "ab cd-" * 7), (2, "A" * 24 + "c"), (3, "A" * 24 + "d"), (4, "12 \n"), (5, None), (6, "acde" * 5000)]
    got = as_dict(al.from_whole_texts(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text"), "seq_id", value="seq")
    want = {}
    for i, t in texts:
        s = "".join(c for c in (t or "").upper() if "A" <= c <= "Z").translate(str.maketrans("BJOUXZ", "------"))
        for k in range(0, max(1, len(s)), 24):
            want[(f"{i}.{k // 24}" if k else str(i),)] = s[k : k + 24].ljust(24, "-")
    assert got == want and got["2.1",] != got["3.1",]


def test_queries_read_whole_texts(spark, tmp_path):
    from pairglass.plans import queries as q

    texts = [(i, "ACDE" * 6 + ("ACDEFGHIKLMN" if i % 2 else "NMLKIHGFEDCA") * 2) for i in range(1, 9)]
    spark.createDataFrame(texts, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q.rows(spark, str(tmp_path)).count() == 16
    for name in ("mst", "sim_nuclear", "rpmi_pvalues", "nmf", "mi", "wts_similarity"):
        assert q.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert q.QUERIES["mst"](spark, str(tmp_path)).agg(F.max("weight")).first()[0] > 0  # the first 24 letters are all the same


def test_structures_cover_every_vector(spark, tmp_path):
    from pairglass.plans import queries as q

    rng = np.random.default_rng(4)
    vecs = {i: rng.standard_normal(4).astype(np.float32).astype(float).tolist() for i in range(60)}
    rows = [*vecs.items(), (60, None), (61, [1.0]), (62, [float("nan")] * 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = q.structures(spark, str(tmp_path))
    want = {(i // 24, i % 24 + 1, j % 24 + 1): math.dist(vecs[i][:3], vecs[j][:3]) for i, j in itertools.combinations(vecs, 2) if i // 24 == j // 24}
    got = as_dict(d, "structure", "i", "j", value="d")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    edges = spark.createDataFrame([("m", 1, 2, 0.5), ("m", 3, 9, 2.0)], "method string, p1 int, p2 int, weight double")
    mine = as_dict(acc.mean_distance(edges, d, ("method",), within=("structure",)), "structure", value="accuracy")
    for s in range(3):
        own = {k[1:]: v for k, v in want.items() if k[0] == s}
        low, mean = min(own.values()), sum(own.values()) / len(own)
        assert mine[(s,)] == pytest.approx(1 - sum(w * (own[p] - low) / (mean - low) for p, w in (((1, 2), 0.5), ((3, 9), 2.0))) / 2.5)


@pytest.mark.parametrize("name", ["sim_spectral", "sim_nuclear"])
def test_similarity_without_sql_reads_all_edges(spark, monkeypatch, name):
    from pairglass.plans import queries as q

    edges = [(1, h, i, j, float(i + j if h == "a" or j < 13 else 1)) for h in "ab" for i, j in itertools.combinations(range(14), 2)]
    nets = spark.createDataFrame(edges, "split int, subset string, p1 int, p2 int, weight double")
    monkeypatch.setattr(q, "networks", lambda *_: nets)
    want = gr.similarity(q.sub(nets, "a"), q.sub(nets, "b"), name[4:], ("split",)).first()["similarity"]
    cut = gr.top_n(nets, 40, q.KEYS)
    assert gr.similarity(q.sub(cut, "a"), q.sub(cut, "b"), name[4:], ("split",)).first()["similarity"] != pytest.approx(want, abs=1e-4)
    assert q.QUERIES[name](spark, "").first()["similarity"] == pytest.approx(want, abs=1e-6)


def test_accuracy_of_equal_distances(spark):
    """A structure of one distance has an accuracy that isn't a number, as in SQL, and no error; nor have means with it one."""
    edges = spark.createDataFrame([("m", 1, "a", 0, 1, 0.5), ("m", 1, "a", 0, 2, 0.25)], "method string, split int, subset string, p1 int, p2 int, score double")
    d = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, 4.0), (0, 1, 2, 6.0), (1, 0, 1, 3.0)], "structure long, i int, j int, d double")
    got = as_dict(acc.accuracy(edges, "avgdist", d, d, within=("structure",)), "structure", value="accuracy")
    assert got[0,] == pytest.approx(1 - (0.25 * 1.0) / 0.75) and np.isnan(got[1,])
    voted = as_dict(pl.vote_accuracy(edges, None, d, "avgdist", ("structure",)), "method", value="accuracy")
    assert all(np.isnan(v) for v in voted.values())
