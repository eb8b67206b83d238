"""Filter audit, byte-level BPE and source divergence against brute force and the library, on every odd case."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pairglass.llm import bpe, divergence, filteraudit

SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, term string, mask int, part string, digest string, good int, toxic int, cells int, rank int, value long, docs long"
CLASH = (1, 2, "x", 3, "y", "z", 4, 5, 6, 7, 8, 9)


def made(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdEFü日#") for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(80)]
    texts += [texts[0]] * 7 + [None, None, "", "", " \t", "a " * 300, "word " * 20_000, "X" * 50_000]
    langs, sources = ["en", "en", "de", None, ""], ["a", "a", "b", "c", None, ""]
    rows = [(k, t, rng.choice(langs), rng.choice(sources)) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], "en", "a"), (None, texts[0], "en", "a"), (None, None, None, None), (3, texts[0], "de", "b"), (-5, texts[1], "en", "a")]
    return rows


LABELS = [(k, k % 3 % 2, k % 2) for k in range(0, 60)] + [(1, 1, 0), (2, None, 1), (None, 1, 1), (0, 1, None)]


def labels(spark, rows=LABELS):
    return spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, quality int, toxic int, lang string, c long")


# --- filter audit


def brute_audit(rows, marks):
    good, toxic = {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, t in marks if t == 1 and d is not None}
    fails = defaultdict(list)
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, lang, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {f for f, x in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)))) if x}
        fails[lang or ""].append((own | ({"E"} if d is not None and d > least[t] else set()), d in good, d in toxic))
    out = {}
    for part, docs in fails.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                hit, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                every = sum(f in x[0] for x in docs)
                out[part, "".join(order), step] = [len(left), len(hit), every - len(hit), sum(x[0] == {f} for x in docs), sum(x[1] for x in hit), sum(x[2] for x in hit)]
                shapley[f] += len(hit)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rows = corpus()
    got = filteraudit.audit(made(spark, rows).repartition(5), labels(spark)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filteraudit.COUNTS) for r in got}
    assert len(found) == len(got) == 600 * len({x[2] or "" for x in rows})
    assert found == brute_audit(rows, LABELS)


def test_filter_audit_empty(spark):
    assert filteraudit.audit(made(spark, []), labels(spark)).count() == 0
    got = filteraudit.audit(made(spark, [(1, None, None, None)]), labels(spark, [])).collect()
    assert {(r["part"], r["good_lost"], r["toxic_lost"]) for r in got} == {("", 0, 0)}
    assert all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_orders_differ_by_one_swap(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in filteraudit.transpositions(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_removals_add_up():
    """Shapley sums of a part add up to what all filters together remove, in every order."""
    cells = np.random.default_rng(3).integers(0, 50, (3, 32))
    got = filteraudit.walk(cells)
    gone = int(cells[0, 1:].sum())
    by_order = Counter()
    for o, r in zip(got["filter_order"], got["removed"]):
        by_order[o] += r
    assert set(by_order.values()) == {gone} and len(by_order) == 120
    assert sum({o[s - 1]: v for o, s, v in zip(got["filter_order"], got["step"], got["shapley"])}.values()) == 120 * gone


# --- byte-level BPE

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\0", "a<|endoftext|>  <|endoftext|><|endoftext|> b", "<|endoftext|>", "<|endoftext|", "  <|endoftext|>  ", "x" * 30_000, "ab" * 20_000, " " * 5000, "\n" * 300 + "a", "'s't'll've're'S", "ꟑ𐶀͸ ̈ 😀", "\u0085 \x1c a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_byte_pairs(spark, library):
    rows = corpus() + [(1000 + k, t, "en", "a") for k, t in enumerate(ODD)]
    docs = made(spark, rows).repartition(4)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(docs, PATH).collect())
    want = Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((d, t or "") for d, t, *_ in rows)
    assert bpe.digest_documents(made(spark, []), PATH).count() == 0


def test_byte_pairs_random_strings(library):
    rng, model = random.Random(2), bpe.BytePairs(PATH)
    letters = "abcdefgh ''sdtmlvre  \n\t\x1c\x85 éüßñ0123٣中文字ꟑ𐶀͸̈!?.,;#|<>endoftext😀​﻿"
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(model.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert model.decode(np.array([171, 50256, 64], "<u4").tobytes()) == library.decode([171, 50256, 64], skip_special_tokens=False)


def test_merges_against_the_rule():
    """The queue gives what rescanning for the least rank after each merge gives."""
    rng, model = random.Random(4), bpe.BytePairs(PATH)

    def rescan(part):
        ids = [model.base[b] for b in part]
        while True:
            ranks = [(model.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in model.merges]
            if not ranks:
                return ids
            k = min(ranks)[1]
            ids[k : k + 2] = [model.merges[ids[k], ids[k + 1]][1]]

    for _ in range(500):
        part = "".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 60))).encode()
        assert model.merged(part) == rescan(part)


def test_byte_pairs_keeps_no_long_parts():
    model = bpe.BytePairs(PATH)
    model.encode("a" * 100_000 + " " + "b" * 65 + " short")
    assert max(map(len, model.known)) <= bpe.LONGEST


# --- source divergence


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = sorted({d[1] for d in own})
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in sources}
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in sources}, share(every)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize("least, top, width, held", [(30, 50, 1 << 22, 1 << 24), (5, 7, 1 << 22, 40), (3, 50, 64, 1 << 24), (1, 3, 1 << 10, 1)])
def test_source_divergence(spark, least, top, width, held):
    rows = corpus()
    got = [tuple(r) for r in divergence.audit(made(spark, rows).repartition(5), least, top, width, held).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least, top)


def test_source_divergence_without_terms(spark):
    assert divergence.audit(made(spark, [])).count() == 0
    rows = [(1, None, None, None), (1, "12 34", None, "b"), (2, "one", "en", "a")]
    got = {tuple(r) for r in divergence.audit(made(spark, rows)).collect()}
    assert got == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kinds = 9_000_000_000_123_456, 10_000_000_000_000_000, 77_777
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kinds)).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * kinds)


def test_sketch_never_underestimates(spark):
    rows = corpus()
    bits = np.frombuffer(divergence.possible(made(spark, rows).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text"), 20, 256, 50), np.uint8)
    rows_, terms = divergence._terms(pa.array([t or "" for _, t, *_ in rows]))
    df = Counter((rows[r][2] or "", t) for r, t in set(zip(rows_.tolist(), terms.to_pylist())))
    often = [k for k, n in df.items() if n >= 20]
    at = divergence._cells(divergence._hashes(pa.array([k for k, _ in often])), divergence._hashes(pa.array([t for _, t in often])), 256)
    assert ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all()


def test_terms_of_bytes():
    texts = ["", "Ab", "cD", " x1y\0ÄÖ-ß ", "日本 a", "", "Z"]
    rows, terms = divergence._terms(pa.array(["skipped", *texts])[1:])
    want = [(k, t) for k, text in enumerate(texts) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    assert list(zip(rows.tolist(), terms.to_pylist())) == want
    assert len(divergence._terms(pa.array([], pa.string()))[0]) == len(divergence._terms(pa.array(["", "1"]))[0]) == 0
