"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lowers case, drops accents and zero-width marks, maps look-alike letters of other scripts and digit
substitutions inside words to Latin letters, and turns all else into spaces. The lexicon holds whole words and word
beginnings with their weights, learned from labels as log odds; matches inside an exception phrase don't count. The
sum of the weights, normalised by length, gives the score through a fitted logistic function.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import remainder
from .shared import settle, ship, tidied

#: Labelled documents that the lexicon is learned from, at most so many of each label, by hash.
FIT_TOXIC, FIT_CLEAN = 4_000, 12_000
LEAST_COUNT, LEAST_ODDS = 4, 2.0
BEGINNINGS = (4, 5, 6, 7)
#: Harmless phrases around words that a lexicon may hold.
EXCEPTIONS = ("pond scum", "clown fish", "clownfish", "trash can", "trash bin", "trash bag", "moron mountain", "idiot proof", "sore loser rule", "dummy variable", "killer whale", "killer app", "master kill switch")
#: Letters of other scripts, and Latin ones without a decomposition, by the Latin letters that they look like.
LOOKALIKES = {c: latin for latin, letters in {
    "a": "аαɑᴀⲁ", "b": "вβьƅʙ", "c": "сϲᴄⲥ", "d": "ԁɗđɖᴅ", "e": "еεҽєэɛəᴇ", "f": "ƒꬵғ", "g": "ɡցɢԍ", "h": "нһհʜɦ", "i": "іιıɩɪⲓɨ", "j": "јϳյʝ", "k": "кκҡқᴋⲕ",
    "l": "ⅼłӏʟɭǀ", "m": "ммᴍⲙ", "n": "ηոпɴɳŋ", "o": "оοօσøᴏⲟө", "p": "рρᴘⲣҏ", "q": "ԛզɋ", "r": "гᴦʀɾⲅ", "s": "ѕꜱʂƨ", "t": "тτᴛⲧŧ", "u": "υμսᴜʋ", "v": "νѵᴠⱱ", "w": "ԝѡωաᴡɯ", "x": "хχⲭҳ", "y": "уүγʏყⲩұ", "z": "ᴢʐƶȥ",
    "ss": "ß", "ae": "æ", "oe": "œ",
}.items() for c in letters}
DIGITS = str.maketrans("01345789", "oieastbg")
SIGNS = str.maketrans("@$!|", "asil")
_DIGIT_WORD = re.compile(r"[a-z0-9]*(?:[a-z][0-9]|[0-9][a-z])[a-z0-9]*")
_SIGN = re.compile(r"(?<=[a-z])[@$!|]+(?=[a-z])|\b[@$](?=[a-z])|(?<![^\s])[@$](?=[a-z]{3})")


class _Table(dict):
    """What a code point folds to, worked out when it is first met: None drops it."""

    def __missing__(self, c: int) -> int | str | None:
        self[c] = out = _folded(c)
        return out


def _folded(c: int) -> int | str | None:
    ch = chr(c)
    if c < 0x80:
        return c if ch.isalnum() else " "
    if unicodedata.category(ch) in ("Cf", "Mn"):
        return None
    base = unicodedata.normalize("NFKD", ch.lower()).lower()
    base = "".join(LOOKALIKES.get(x, x) for x in base if not unicodedata.combining(x))
    if not any(x.isalnum() for x in base):
        return " "
    return base if base.isascii() or c < 0x3000 else c


_TABLE = _Table()


def fold(text: str | None) -> str:
    """Folded words between single or more spaces, with a space at each end."""
    t = (text or "").lower()
    if any(c in t for c in "@$!|"):
        t = _SIGN.sub(lambda m: m[0].translate(SIGNS), t)
    t = t.translate(_TABLE)
    if not t.isascii() or any(c in t for c in "01345789"):
        t = _DIGIT_WORD.sub(lambda m: m[0].translate(DIGITS), t)
    return f" {t} "


def terms(folded: str) -> set[str]:
    """Whole words as " word ", beginnings as " wor"."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in BEGINNINGS:
            if len(w) > k:
                out.add(f" {w[:k]}")
    return out


def learn(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """Weights of terms by log odds. A longer term stays beside a beginning of it only if it weighs clearly more."""
    found = {}
    for w, (c0, c1) in counts.items():
        odds = math.log((c1 + 0.5) / (n_toxic + 1)) - math.log((c0 + 0.5) / (n_clean + 1))
        if c1 >= LEAST_COUNT and odds >= LEAST_ODDS and c1 >= 2 * c0:
            found[w] = round(odds, 4)
    kept: dict[str, float] = {}
    for w in sorted(found, key=lambda w: (len(w.strip()), w)):
        above = [kept[w[:k]] for k in range(5, len(w)) if w[:k] in kept]
        if not above or found[w] > max(above) + 0.7:
            kept[w] = found[w]
    return kept


@lru_cache(4)
def automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...] = EXCEPTIONS):
    a = ahocorasick.Automaton()
    for w, x in lexicon:
        a.add_word(w, (len(w), x))
    for p in exceptions:
        p = fold(p)
        a.add_word(p, (len(p), None))
    if len(a):
        a.make_automaton()
    return a


def measure(folded: str, a) -> tuple[float, float, float, float]:
    """(sum of weights, the largest, distinct terms, words): the heaviest term of each start, none inside an exception."""
    hits: dict[int, tuple[float, int]] = {}
    free: list[tuple[int, int]] = []
    if len(a):
        for end, (k, x) in a.iter(folded):
            s = end - k + 1
            if x is None:
                free.append((s, end))
            elif x > hits.get(s, (0, 0))[0]:
                hits[s] = x, end
    if free and hits:
        hits = {s: h for s, h in hits.items() if not any(p <= s < e for p, e in free)}
    weights = [x for x, _ in hits.values()]
    return sum(weights), max(weights, default=0.0), float(len({folded[s : e + 1] for s, (_, e) in hits.items()})), float(len(folded.split()))


def inputs(m: np.ndarray) -> np.ndarray:
    total, most, kinds, n = m.T
    return np.stack([np.log1p(total), most / 5, np.log1p(100 * total / (n + 20)), np.log1p(kinds), total / np.sqrt(n + 5)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised weights by Newton's method; the last is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-3
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty, x.T @ (y - q) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.c_[inputs(m), np.ones(len(m))] @ w
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fold_batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fold(t) for t in b.column(2).to_pylist()], pa.string())], names=["h", "y", "folded"])


def _count_batches(batches):
    """Counts of (term, half of the sample, label), summed over the task's documents."""
    n: Counter = Counter()
    for b in batches:
        for h, y, t in zip(*(c.to_pylist() for c in b.columns)):
            n.update((w, h, y) for w in terms(t))
    items = list(n.items())
    for i in range(0, len(items), 50_000):
        part = items[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part], pa.int32()), pa.array([c for _, c in part], pa.int64())],
            names=["term", "h", "y", "n"],
        )


def _measure_batches(lexicon):
    def run(batches):
        a = automaton(lexicon)
        for b in batches:
            m = np.array([measure(t, a) for t in b.column(2).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(m), pa.list_(pa.float64()))], names=["y", "m"])

    return run


def _score_batches(lexicon, w):
    def run(batches):
        a = automaton(lexicon)
        for b in batches:
            m = np.array([measure(fold(t), a) for t in b.column(1).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(m, w) if len(m) else np.zeros(0))], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, fold_by: int = 3, out: int = 1):
    """(lexicon, logistic weights), from a bounded sample of labelled documents whose crc32 isn't held out.

    One half of the sample gives a lexicon by which the other half is measured for the logistic function; the lexicon
    that is returned comes from both halves. Without both labels the lexicon is empty and every score 0.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold_by) != out))
    order = (F.xxhash64("doc_id"), "doc_id")
    known = known.where("y = 1").orderBy(*order).limit(FIT_TOXIC).union(known.where("y = 0").orderBy(*order).limit(FIT_CLEAN))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("h"), "y", "text")
    rows = settle(rows.mapInArrow(_fold_batches, "h int, y int, folded string"), "toxicity-sample")
    size = {(r["h"], r["y"]): r["n"] for r in rows.groupBy("h", "y").agg(F.count("*").alias("n")).collect()}
    of = lambda y, *hs: sum(size.get((h, y), 0) for h in hs)
    if not of(0, 0, 1) or not of(1, 0, 1):
        return (), np.array([0.0] * 5 + [-30.0])
    case = lambda h, y: F.sum(F.when((F.col("h") == h) & (F.col("y") == y), F.col("n")).otherwise(0))
    counts = rows.mapInArrow(tidied(_count_batches), "term string, h int, y int, n long").groupBy("term")
    counts = counts.agg(*(case(h, y).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1))).where(F.col("n01") + F.col("n11") >= LEAST_COUNT)
    counts = counts.where((F.col("n01") + F.col("n11") >= F.col("n00") + F.col("n10")) | (F.col("n01") >= 2 * F.col("n00"))).collect()
    half = learn({r["term"]: (r["n00"], r["n01"]) for r in counts}, of(0, 0), of(1, 0))
    full = learn({r["term"]: (r["n00"] + r["n10"], r["n01"] + r["n11"]) for r in counts}, of(0, 0, 1), of(1, 0, 1))
    key = tuple(sorted(half.items()))
    got = rows.where("h = 1").mapInArrow(_measure_batches(key), T.StructType([T.StructField("y", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))])).orderBy("y", "m").toPandas()
    m = np.array(list(got["m"]), float).reshape(-1, 4)
    if not len(m) or got["y"].nunique() < 2:
        return (), np.array([0.0] * 5 + [-30.0])
    return tuple(sorted(full.items())), logistic(inputs(m), got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fold_by: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts are scored as empty ones; a null doc_id is never held out; repeated rows each get their row;
    an empty table gives no rows; other columns are ignored.
    """
    lexicon, w = fit(docs, labels, fold_by=fold_by, out=out)
    got = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_score_batches(lexicon, w)), "doc_id long, score double")
    return got.select("doc_id", (remainder(F.col("doc_id"), fold_by) == out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
