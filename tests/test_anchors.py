"""Known values on a protein-family alignment and its structure, where the files are given:

    PAIRGLASS_ALIGNMENT=<FASTA file> PAIRGLASS_STRUCTURE=<PDB file> python -m pytest tests/test_anchors.py
"""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairglass.operators import accuracy as acc
from pairglass.operators import alignment as al
from pairglass.operators import counts as ct
from pairglass.operators import graphs as gr
from pairglass.operators import potts  # noqa: F401
from pairglass.operators import scorers as sc
from pairglass.operators import structure as st
from pairglass.operators import weights as wt
from pairglass.plans import pipeline as pl
from pairglass.sources import formats as fm
from pairglass.sources.store import settle

FASTA, PDB = os.environ.get("PAIRGLASS_ALIGNMENT"), os.environ.get("PAIRGLASS_STRUCTURE")
pytestmark = pytest.mark.skipif(not FASTA, reason="no alignment given")
LENGTH, CANONICAL = 272, "1IU0"

#: Mean, population deviation, greatest value, the two best pairs.
SCORES = {
    "mi": (0.24386834, 0.10004940, 0.76798960, {(29, 31), (28, 29)}),
    "nmi": (0.05831270, 0.01808414, 0.16623072, {(29, 31), (28, 29)}),
    "znmi": (0.11002703, 1.24139563, 5.14493069, {(47, 141), (44, 48)}),
    "mip": (0.00023633, 0.03680717, 0.25987948, {(29, 31), (28, 30)}),
    "mic": (-0.00772633, 0.03656609, 0.23141508, {(29, 31), (28, 30)}),
    "zres": (0.23775101, 2.06886599, 25.94009663, {(93, 94), (119, 120)}),
    "fchisq": (0.75131565, 0.26545760, 2.33786347, {(29, 31), (96, 97)}),
    "sca": (0.04774475, 0.06095855, 0.47078781, {(115, 133), (47, 141)}),
    "nmf": (9011.80321698, 53618.05753951, 1018703.29131654, {(119, 120), (93, 94)}),
    "nmfdi": (0.04769633, 0.02434057, 0.25735727, {(29, 31), (27, 28)}),
    "ipdi": (0.17525025, 0.07516870, 0.59080288, {(47, 141), (99, 141)}),
    "smdi": (0.05537710, 0.01824441, 0.21592578, {(47, 99), (47, 113)}),
}
CONSENSUS = {
    "unweighted": ("EKGEGGLGFSIQDDGIFVSSVLPGGPAAKAGLKPGDVILEINGKSVEGLTHLEAVKLLRGSTTVTLTVL", 45.125522),
    "henikoff": ("EKGSGGLGISIQDDGIYVSSVVPGGPAEKAGLRPGDVILSVNGEDVTGLSHLEAVILIRGSSTVTLTVQ", 38.504219),
}


@pytest.fixture(scope="module")
def rows(spark):
    return settle(al.load(fm.read_fasta(spark, FASTA).select("seq_id", "seq")), "fixture")


@pytest.fixture(scope="module")
def counts(rows):
    """Of the 69 columns with few gaps."""
    kept = settle(al.reduced_columns(al.column_stats(al.cells(rows))).select("pos"), "kept")
    one = ct.singles(al.cells(rows)).join(kept, "pos", "left_semi")
    two = ct.pairs(rows, LENGTH)
    for p in ("p1", "p2"):
        two = two.join(kept.withColumnRenamed("pos", p), p, "left_semi")
    one, two = settle(one, "one"), settle(two, "two")
    return lambda kind, mix=0.5: sc.Counts(one, two, kind, mix)


def test_columns(rows):
    stats = al.column_stats(al.cells(rows)).toPandas()
    kept = lambda gap: int(((stats["gap"] < gap) & (stats["entropy"] > al.min_entropy())).sum())
    assert [kept(g) for g in (0.1, 0.15, 1.0)] == [69, 73, 247]
    assert al.min_entropy() == pytest.approx(0.1985152433)


def test_pairs_of_all_columns_in_one_pass(rows):
    got = ct.pairs(rows, LENGTH).groupBy("p1", "p2").agg(F.sum("n").alias("n")).agg(F.count("*").alias("pairs"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert tuple(got) == (LENGTH * (LENGTH - 1) // 2, 800, 800)


@pytest.mark.parametrize("name", SCORES)
def test_scores(counts, name):
    c = counts("inc") if name in ("nmf", "nmfdi", "ipdi", "smdi") else counts("fix")
    got = sc.score(c, name).toPandas().sort_values("score", ascending=False)
    mean, deviation, most, best = SCORES[name]
    v = got["score"].to_numpy()
    assert len(v) == 2346
    assert (v.mean(), v.std(), v.max()) == pytest.approx((mean, deviation, most), rel=1e-5, abs=1e-7)
    assert {(r.p1, r.p2) for r in got.head(2).itertuples()} == best


def test_scores_without_real_values(counts):
    got = sc.score(counts("inc"), "tapdi")
    assert got.where("isnan(score)").count() == 1707
    assert potts.unsettled(got).first()["unsettled"] == 0


def test_sparse_precision_of_the_alignment(counts):
    got = sc.score(counts("inc"), "psicov")
    assert got.count() == 2346 and got.where("score is null or isnan(score)").count() == 0


def test_weights(rows):
    w = {k: wt.by_similarity(rows, k).agg(F.sum("w")).first()[0] for k in (0.68, 0.38)}
    assert w == pytest.approx({0.68: 6.789167, 0.38: 1.0}, rel=1e-6)
    assert wt.degrees(rows, 0.68).agg(F.sum("degree")).first()[0] == 2 * 297_714
    h = wt.henikoff(al.cells(rows)).toPandas().set_index("seq_id")["w"]
    assert (h[CANONICAL], h.min(), h.max(), h.sum()) == pytest.approx((2.0892931, 0.3116664, 42.8909541, 800))
    assert wt.prune_by_similarity(rows).count() == 785


@pytest.mark.parametrize("weights", CONSENSUS)
def test_consensus(rows, weights):
    cells = al.cells(rows)
    single = settle(ct.singles(cells, wt.henikoff(cells) if weights == "henikoff" else None), "single")
    top = ct.consensus(single, gaps=al.gap_frequency(cells)).toPandas().sort_values("pos")
    kept = al.column_stats(cells).where("gap < 0.1").select("pos").toPandas()["pos"]
    text, total = CONSENSUS[weights]
    assert top["score"].sum() == pytest.approx(total, rel=1e-6)
    assert "".join(top[top["pos"].isin(kept)]["sym"]) == text


def test_default_pipeline(rows):
    p = pl.Pipeline(rows, CANONICAL, pl.Parameters(resampling_method="null"))
    c = p.counts()
    m = sc.mi(c).toPandas().sort_values("score", ascending=False)
    v = m["score"].to_numpy()
    assert (len(v), v.mean(), v.std(), v.max()) == pytest.approx((30_381, 0.23061843, 0.11751673, 0.89829308), rel=1e-6)
    assert {(r.p1, r.p2) for r in m.head(2).itertuples()} == {(28, 29), (29, 31)}
    nets = p.networks(["mi"], c).toPandas()
    top = nets.sort_values("score", ascending=False).iloc[0]
    assert (len(nets), nets["score"].mean(), (top["p1"], top["p2"])) == (4095, pytest.approx(0.35221572, rel=1e-6), (10, 11))


def test_splits_in_one_pass(rows):
    """Wide alignment, weights, both halves of each split (with PAIRGLASS_SPLITS=100, the default number, about ten minutes)."""
    n = int(os.environ.get("PAIRGLASS_SPLITS", "3"))
    c = pl.Pipeline(rows, CANONICAL, pl.Parameters(num_partitions=n)).counts()
    assert c.single.select("split", "subset").distinct().count() == 2 * n
    halves = c.single.where(f"split = {n} and pos = 29").groupBy("subset").agg(F.sum("n").alias("n")).toPandas().set_index("subset")["n"]
    assert (halves["a"], halves["b"]) in ((pytest.approx(400), pytest.approx(401)), (pytest.approx(401), pytest.approx(400)))


@pytest.mark.skipif(not PDB, reason="no structure given")
def test_structure_and_accuracy(spark, rows, counts):
    d = settle(st.distances(st.representatives(fm.read_pdb(spark, PDB))), "distances")
    v = d.toPandas()["d"].to_numpy()
    assert (len(v), v.min(), v.mean()) == (4095, pytest.approx(3.020318, abs=1e-5), pytest.approx(15.562199, abs=1e-5))
    assert st.contacts(d, 8.0, 0).count() == 474 and st.contacts(d, 8.0, 5).count() == 243
    m = al.map_to_canonical(sc.mi(counts("fix")).drop("hij"), al.cells(rows), CANONICAL)
    m = settle(m.withColumn("score", F.round("score", 8)), "mapped")
    contact = d.where("d < 8")
    s = acc.performance(m, contact).toPandas()
    assert (len(s), s["hit"].sum()) == (2346, 310)
    assert (int((s["hit"] & s["ideal"]).sum()), int(((1 - s["hit"]) & (1 - s["ideal"])).sum())) == (100, 1662)
    for name, want in {"bacc": 0.56944356, "mcc": 0.11713580, "hamming": 0.38396625, "whamming": 0.42505274}.items():
        assert acc.accuracy(m, name, contact, d).first()["accuracy"] == pytest.approx(want, abs=1e-6)
    hits = acc.performance(m, contact)  # hits as predictions of the first places
    assert acc.measured(acc.confusion(hits, "hit", "ideal")).first()["bacc"] == pytest.approx(0.54939549, abs=1e-6)
    top = settle(gr.top_n(gr.network(m), 100).withColumnRenamed("weight", "score"), "top")
    for name, want in {"contact": 0.37, "avgdist": 0.32764113}.items():
        assert acc.accuracy(top, name, contact, d).first()["accuracy"] == pytest.approx(want, abs=1e-6)
    tree = gr.spanning_forest(gr.network(sc.mi(counts("fix")).drop("hij"))).toPandas()
    assert (len(tree), tree["weight"].sum()) == (68, pytest.approx(27.38585589, abs=1e-6))
    assert len(np.unique(tree[["p1", "p2"]])) == 69
