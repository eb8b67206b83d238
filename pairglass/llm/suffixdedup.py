"""Exact removal of repeated 400-byte strings, by suffix arrays over the places where repeats can be.

1. Every window of ``LENGTH`` bytes has an anchor: the least hash of its ``GRAM``-byte strings. Windows in a row with
   one anchor are a run. Equal windows have equal anchors, so a run whose anchor is found once in all documents
   holds no repeat. Runs are named by text, place, anchor and a 64-bit digest of their bytes; no bytes are moved.
2. A run whose bytes are found twice is repeated as a whole. Of the runs with a shared anchor, and of those that hold
   theirs twice, one of each kind of bytes goes to a shard by its anchor.
3. Each shard builds a suffix array by Larsson-Sadakane refinement, the common prefixes of neighbours by Kasai's rule,
   and marks windows with a neighbour that shares ``LENGTH`` bytes, a few anchors at a time. Anchors with more bytes than
   a shard takes are dealt over several; their windows' fingerprints are merged by binary search in sorted ranges of
   fingerprints.
4. Texts are cut where windows were marked.

Passages of over 50 words can be shorter than ``LENGTH`` bytes. They are only reported: windows of ``WORDS`` words get
anchors and runs in the same way, and windows of shared anchors are held against each other by their hashes. Anchors are
dealt into buckets, those of very many windows into several, so a text is counted in as many as it has runs.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, release, settle, ship, sieve, sifted, tidied

LENGTH = 400
GRAM = 128
WORDS = 51
WORD_GRAM = 9
#: Windows of words that a task holds against each other at once, and that a group gets.
FLUSH = 400_000
PIECE = 1 << 20
SHARD_BYTES = 2 << 20
#: Bytes of a shard that a task sorts at once, where one anchor hasn't more: each takes about 60 bytes of memory.
SORTED_BYTES = 1 << 19
#: Bytes of runs of split anchors for each range of fingerprints: some 200,000 windows.
RANGE_BYTES = 1 << 19
#: Symbols of nine bits in one number.
PACK = 7
#: A run's place is kept as the first window, a bit for an anchor that is in it twice, and the number of windows.
LEN_BITS = 21
AT_BITS = LEN_BITS + 1
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, PIECE + LENGTH)
        _powers["up"] = np.cumprod(np.full(m, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` numbers in a row."""
    m = len(h)
    blocks = np.concatenate([h, np.full(-m % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - w + 1], ahead[w - 1 : m])


def _rolled(a: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` numbers in a row."""
    up, down = _power(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * up, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: len(a) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


#: Two numbers for each byte, drawn once: sums over a window with them tell windows apart.
_TABLES = np.random.default_rng(400).integers(0, 1 << 64, (2, 256), np.uint64)


def fingerprints(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of ``length`` bytes, in two numbers."""
    return _rolled(_TABLES[0][raw], length), _rolled(_TABLES[1][raw], length)


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the least hash of its ``gram``-byte strings; and all these hashes."""
    h = _rolled(raw.astype(np.uint64) + np.uint64(1), gram)
    return _least(h, length - gram + 1), h


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word; words end at white space and where a document ends."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    first, last = ~space, ~space
    begins = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(raw), bool)
    edge[begins[begins < len(raw)]] = True
    first[1:] &= space[:-1] | edge[1:]
    last[:-1] &= space[1:] | edge[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29)), np.searchsorted(ends, first, side="right")


def long_word_hashes(raw: np.ndarray) -> np.ndarray:
    """Of one text, in pieces that end at white space."""
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(raw):
        b = min(len(raw), a + PIECE)
        while b < len(raw) and not _SPACE[raw[b]]:
            b += 1
        out.append(word_hashes(raw[a:b], np.array([b - a]))[0])
        a = b
    return np.concatenate(out)


def word_runs(words: np.ndarray, doc: np.ndarray, many: int, gram: int):
    """(document, first window of those given, windows, anchor) of each run."""
    if len(words) < many:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    least = _least(_rolled(words, gram), many - gram + 1)
    n = len(least)
    valid = doc[:n] == doc[many - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    ok = valid[first]
    return doc[first[ok]], first[ok], size[ok], least[first[ok]]


def runs(raw: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(document, first window, windows, anchor, whether that is in it twice) of each run; ``ends``: of the documents in ``raw``."""
    if len(raw) < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, bool)]
    least, h = anchors(raw, length, gram)
    n = len(least)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    valid = np.arange(n) + length <= ends[doc]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    ok = valid[first]
    first, size = first[ok], size[ok]
    w = length - gram
    twice = [b > w + 1 or np.count_nonzero(h[a : a + b + w] == v) > 1 for a, b, v in zip(first.tolist(), size.tolist(), least[first])]
    return doc[first], first, size, least[first], np.array(twice, bool)


RUNS = "k long, nb long, at long, v long, d long, kind int"
#: Kinds of rows: runs of bytes, runs of words, and one row a text with its number of windows of words.
BYTE_RUN, WORD_RUN, TEXT = 0, 1, 2


def _run_batches(length: int, gram: int, many: int, word_gram: int):
    def batch(k, nb, at, v, d, kind):
        none = pa.nulls(len(k), pa.int64())
        v, d = (none if x is None else pa.array(x.view(np.int64)) for x in (v, d))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(nb), pa.array(at), v, d, pa.array(np.full(len(k), kind, np.int32))], names=["k", "nb", "at", "v", "d", "kind"])

    def emit(raw, ks, nbs, starts, ends):
        """starts: offsets of the pieces within their texts."""
        doc, first, size, anchor, twice = runs(raw, ends, length, gram)
        view = memoryview(raw)
        digest = [xxhash.xxh3_64_intdigest(view[a : a + b + length - 1]) for a, b in zip(first.tolist(), size.tolist())]
        begin = np.concatenate([[0], ends[:-1]])
        at = ((first - begin[doc] + starts[doc]) << AT_BITS) | (twice.astype(np.int64) << LEN_BITS) | size
        return batch(ks[doc], nbs[doc], at, anchor, np.array(digest, np.uint64), BYTE_RUN)

    def emit_words(words, doc, ks, nbs):
        """Runs named by their first word and windows; ``doc`` rises."""
        begin = np.searchsorted(doc, np.arange(len(ks) + 1))
        for a in range(0, max(1, len(words)), PIECE):  # windows from a on, each with all its words
            d, first, size, anchor = word_runs(words[a : a + PIECE + many - 1], doc[a : a + PIECE + many - 1], many, word_gram)
            yield batch(ks[d], nbs[d], ((a + first - begin[d]) << LEN_BITS) | size, anchor, None, WORD_RUN)
        yield batch(ks, nbs, np.maximum(0, np.diff(begin) - many + 1), None, None, TEXT)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(1).cast(pa.binary())
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            ks, nbs = b.column(0).to_numpy(), np.diff(offsets)
            i = 0
            while i < len(ks):
                if nbs[i] > PIECE:  # a long text in pieces, each with all of its windows
                    for a in range(0, int(nbs[i]) - length + 1, PIECE):
                        raw = data[offsets[i] + a : min(offsets[i + 1], offsets[i] + a + PIECE + length - 1)]
                        yield emit(raw, ks[i : i + 1], nbs[i : i + 1], np.array([a]), np.array([len(raw)]))
                    words = long_word_hashes(data[offsets[i] : offsets[i + 1]])
                    yield from emit_words(words, np.zeros(len(words), np.int64), ks[i : i + 1], nbs[i : i + 1])
                    i += 1
                    continue
                j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
                j = max(i + 1, min(j, len(ks)))
                raw, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                yield emit(raw, ks[i:j], nbs[i:j], np.zeros(j - i, np.int64), ends)
                yield from emit_words(*word_hashes(raw, ends), ks[i:j], nbs[i:j])
                i = j

    return run


def packed(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's ``PACK`` symbols in one number, all ends (256 and more) as one symbol; and the number of the next
    end, counted from 1, where it is among them, else 0."""
    n, end = len(text), text >= 256
    sym = np.zeros(n + PACK - 1, np.int16)
    sym[:n] = np.where(end, 256, text) + 1
    out, near = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(PACK):
        out <<= 9
        out |= sym[i : i + n]
        near[: max(0, n - i)] |= end[i:]
    after = np.cumsum(end, dtype=_places(n)) + ~end
    return out, np.where(near, after, 0).astype(after.dtype)


def _places(n: int):
    """The lesser type that numbers ``n`` places."""
    return np.int32 if n < (1 << 31) - 2 else np.int64


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of ``text``, of bytes and ends of 256 and more, sorted by at least ``depth`` symbols.

    Larsson and Sadakane's refinement: suffixes sorted by h symbols are sorted by 2h through the rank of the suffix h
    further on; only groups that are not yet single are sorted again. It begins with ``PACK`` symbols in one number;
    suffixes with an end among these are parted by that end.
    """
    n = len(text)
    place = _places(n)
    first, tie = packed(text)
    order = np.argsort(first, kind="stable").astype(place)
    # Equal numbers with an end in them are in the order of their ends already, as ends rise with the place.
    rank = np.empty(n, place)
    new = np.ones(n, bool)
    first, tie = first[order], tie[order]
    new[1:] = (first[1:] != first[:-1]) | (tie[1:] != tie[:-1])
    del first, tie
    group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=place), place(0)))
    rank[order] = group
    h = PACK
    while h < depth:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single).astype(place)
        if not len(open_):
            break
        at = order[open_]
        ahead = np.where(at < n - h, rank[np.minimum(at, n - 1 - h) + h] + 1, 0) if h < n else np.zeros(len(at), place)
        g = group[open_]
        o = np.lexsort((ahead, g)) if n >= 1 << 31 else np.argsort(g.astype(np.int64) * (n + 1) + ahead, kind="stable")
        at, ahead, g = at[o], ahead[o], g[o]
        del o
        order[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (ahead[1:] != ahead[:-1]) | (g[1:] != g[:-1])
        new[open_] = fresh
        group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=place), place(0)))
        rank[order] = group
        h *= 2
    rank[order] = np.arange(n, dtype=place)
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix in order the symbols that it shares with the one before it.

    Kasai's rule: read by place in the text, the value falls by one at most. It is one less exactly where the symbols
    before the two suffixes are equal, so only the other places are compared, ``PACK`` symbols at a time and then one.
    """
    n = len(text)
    place = _places(n)
    before = np.full(n, -1, place)
    before[order[1:]] = order[:-1]
    i = np.arange(n, dtype=place)
    reducible = np.zeros(n, bool)
    p = before[1:]
    reducible[1:] = (p > 0) & (text[:-1] == text[np.maximum(p - 1, 0)]) & (before[:-1] == p - 1)
    open_ = np.flatnonzero(~reducible & (before >= 0)).astype(place)
    value = np.zeros(n, place)
    many, tie = packed(text)
    a, b, k, rest = open_, before[open_], 0, []
    del before, p, open_
    while len(a):
        inside = (a < n - k) & (b < n - k)
        same = inside.copy()
        x, y = a[inside] + place(k), b[inside] + place(k)
        same[inside] = (many[x] == many[y]) & (tie[x] == 0) & (tie[y] == 0)
        rest.append((a[~same], b[~same], k))
        a, b, k = a[same], b[same], k + PACK
    del many, tie
    a, b = (np.concatenate([r[c] for r in rest] or [np.zeros(0, place)]) for c in (0, 1))
    k = np.concatenate([np.full(len(r[0]), r[2], place) for r in rest] or [np.zeros(0, place)])
    del rest
    for _ in range(PACK):
        inside = (a < n - k) & (b < n - k)
        same = inside.copy()
        same[inside] = text[a[inside] + k[inside]] == text[b[inside] + k[inside]]
        value[a[~same]] = k[~same]
        a, b, k = a[same], b[same], k[same] + place(1)
    last = np.maximum.accumulate(np.where(reducible, place(0), i))
    i -= last
    value = value[last]
    value -= i
    return value[order]


def marked(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows are found in another place of the pieces."""
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(pieces), _places(int(sizes.sum()) + 2 * len(pieces) + 256))
    for i, (a, p) in enumerate(zip(begin.tolist(), pieces)):
        text[a : a + len(p)] = np.frombuffer(p, np.uint8)
        text[a + len(p)] = 256 + i  # ends differ, so no common prefix goes over one
    order, rank = suffix_array(text, length)
    shared = common_prefixes(text, order, rank)
    hit = np.zeros(len(text), bool)
    hit[order] = (shared >= length) | (np.append(shared[1:], 0) >= length)
    return [hit[a : a + max(0, s - length + 1)] for a, s in zip(begin.tolist(), sizes.tolist())]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Windows:
    """Windows of words of many texts: counts those that another of these texts has too, and hands on the rest."""

    def __init__(self, buckets: int):
        self.buckets, self.n, self.hash, self.k, self.nb, self.at = buckets, 0, [], [], [], []

    def add(self, hashes: np.ndarray, k: int, nb: int, bucket: int, parts: int) -> None:
        """Windows of one anchor, which has ``parts`` buckets from ``bucket`` on."""
        at = bucket + ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        self.at.append(at % self.buckets)
        self.hash.append(hashes)
        self.k.append(np.full(len(hashes), k, np.int64))
        self.nb.append(np.full(len(hashes), nb, np.int64))
        self.n += len(hashes)

    def rows(self):
        if not self.n:
            return
        h, k, nb, bucket = (np.concatenate(x) for x in (self.hash, self.k, self.nb, self.at))
        self.__init__(self.buckets)
        o = np.argsort(bucket, kind="stable")
        h, k, nb, bucket = h[o], k[o], nb[o], bucket[o]
        cuts, found = np.flatnonzero(np.diff(bucket, prepend=-1)), []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):  # equal windows have one anchor, so one bucket
            (hh, kk, nn, many), more = told(h[a:b], k[a:b], nb[a:b], np.ones(b - a, np.int64), np.zeros(b - a, bool))
            found += more
            # Of windows counted already one posting is enough: others will find it.
            yield None, None, len(hh), -1 - int(bucket[a]), None, None, None, hh.tobytes() + kk.tobytes() + nn.tobytes() + many.tobytes()
        for kk, nn, c in summed(found):
            yield kk, nn, c, -1 - (kk % self.buckets), None, None, None, None


def summed(found):
    """(k, nb, number) once a text."""
    total: dict = {}
    for k, nb, c in found:
        total[k, nb] = total.get((k, nb), 0) + c
    return [(k, nb, c) for (k, nb), c in total.items()]


def told(h, k, nb, many, known):
    """Postings of windows: one (h, k, nb, many) for each hash and text, or one for each hash that two texts have, with
    many as 0; and the windows counted, (k, nb, number), of postings not yet ``known``."""
    o = np.lexsort((nb, k, h))
    h, k, nb, many, known = h[o], k[o], nb[o], many[o], known[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (nb[1:] != nb[:-1])
    at = np.flatnonzero(new)
    many = np.add.reduceat(np.where(known, 0, many), at) if len(at) else many
    h, k, nb = h[at], k[at], nb[at]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    group = np.cumsum(first) - 1
    two = np.bincount(group, minlength=1)[group] > 1 if len(h) else np.zeros(0, bool)
    counted = two & (many > 0)
    names, own = np.unique(np.stack([k[counted], nb[counted]], 1), axis=0, return_inverse=True)
    sums = np.bincount(own.ravel(), many[counted], len(names)).astype(np.int64)
    keep = ~two | first
    return (h[keep], k[keep], nb[keep], np.where(two, 0, many)[keep]), [(int(x), int(y), int(c)) for (x, y), c in zip(names, sums)]


def _slice_batches(length: int, many: int, buckets: int):
    """(k, nb, text, runs) to one row of bytes for each run of bytes, and windows of words by bucket, as shards below 0."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())

    def batch(rows):
        cols = list(zip(*rows)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k", "nb", "at", "shard", "unit", "lone", "split", "raw"])

    def run(batches):
        windows = Windows(buckets)
        for b in batches:
            for k, nb, text, held in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                out, words = [], None
                for r in held:
                    if r["parts"] is not None:
                        if words is None:
                            words = long_word_hashes(np.frombuffer(raw, np.uint8))
                        first, size = r["at"] >> LEN_BITS, r["at"] & ((1 << LEN_BITS) - 1)
                        windows.add(_rolled(words[first : first + size + many - 1], many), k, nb, r["shard"], r["parts"])
                        continue
                    first, size = r["at"] >> AT_BITS, r["at"] & ((1 << LEN_BITS) - 1)
                    out.append((k, nb, r["at"], r["shard"], r["unit"], r["lone"], r["split"], raw[first : first + size + length - 1]))
                if out:
                    yield batch(out)
                if windows.n >= FLUSH:
                    yield batch(windows.rows())
        yield batch(windows.rows())

    return run


def _held(table):
    """(k, nb, number, and nulls) of windows of words that two texts have, from one bucket."""
    parts = [[], [], [], []]
    out = []
    for k, nb, m, raw in zip(*(table[c].to_pylist() for c in ("k", "nb", "at", "raw"))):
        if raw is None:
            out.append((k, nb, m))
            continue
        for c, t in enumerate((np.uint64, np.int64, np.int64, np.int64)):
            parts[c].append(np.frombuffer(raw, t, m, 8 * m * c))
    if parts[0]:
        h, k, nb, many = (np.concatenate(x) for x in parts)
        out += told(h, k, nb, many, many == 0)[1]
    out = summed(out)
    release()
    cols = list(zip(*out)) or [[]] * 3
    none = pa.nulls(len(out), pa.int64())
    return pa.table(dict(zip(("k", "nb", "a", "b", "r", "packed"), [*(pa.array(c, pa.int64()) for c in cols), none, none, pa.nulls(len(out), pa.binary())])))


def _packed_windows(parts, ranges: int):
    """(range, bytes) of windows (k, nb, place, evidence only, fingerprint): of windows that are evidence only, one of
    each fingerprint."""
    k, nb, at, known, f1, f2 = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((known, f2, f1))
    k, nb, at, known, f1, f2 = (x[order] for x in (k, nb, at, known, f1, f2))
    again = np.zeros(len(k), bool)
    again[1:] = known[1:] & (f1[1:] == f1[:-1]) & (f2[1:] == f2[:-1])
    k, nb, at, known, f1, f2 = (x[~again] for x in (k, nb, at, known, f1, f2))
    range_ = (f1 % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(range_, kind="stable")
    cuts = np.flatnonzero(np.diff(range_[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        own = order[a:b]
        yield int(range_[own[0]]), b"".join(x[own].astype(t).tobytes() for x, t in ((k, "<i8"), (nb, "<i8"), (at, "<i8"), (known, "<i8"), (f1, "<u8"), (f2, "<u8")))


def _units(rows):
    """Rows (unit, ..., raw), sorted, in lists of whole units, each of ``SORTED_BYTES`` bytes at most or of one unit."""
    held, size = [], 0
    for _, unit in groupby(rows, key=lambda r: r[0]):
        unit = list(unit)
        more = sum(len(r[-1]) for r in unit)
        if held and size + more > SORTED_BYTES:
            yield held
            held, size = [], 0
        held += unit
        size += more
    if held:
        yield held


def _shard(length: int, ranges: int):
    def run(key, table):
        """Marked windows as (k, nb, a, b); of split anchors also the windows that other units may hold, packed by range."""
        if key[0].as_py() < 0:
            return _held(table)
        out = []
        for rows in _units(sorted(zip(*(table[c].to_pylist() for c in ("unit", "k", "nb", "at", "lone", "split", "raw"))))):
            parts = []
            for (_, k, nb, at, lone, split, raw), f in zip(rows, marked([r[-1] for r in rows], length)):
                first = at >> AT_BITS
                if lone:
                    out += [(k, nb, first + a, first + b, None, None) for a, b in zip(*(x.tolist() for x in _spans(f)))]
                if split and len(f):
                    same = lambda v, n=len(f): np.full(n, v, np.int64)
                    known = f if lone else np.ones(len(f), bool)
                    parts.append((same(k), same(nb), first + np.arange(len(f)), known, *fingerprints(np.frombuffer(raw, np.uint8), length)))
            if parts:  # of each list by itself: evidence only makes way for windows that it was held against
                out += [(None, None, None, None, r, x) for r, x in _packed_windows(parts, ranges)]
        cols = list(zip(*out)) or [[]] * 6
        release()
        types = [pa.int64()] * 5 + [pa.binary()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("k", "nb", "a", "b", "r", "packed"), cols, types)})

    return run


def _merge(key, table):
    """Windows whose fingerprint another shard has too, by binary search in the sorted fingerprints of one range."""
    parts = [np.frombuffer(x, np.uint64).reshape(6, -1) for x in table["packed"].to_pylist()]
    k, nb, at, known, f1, f2 = np.concatenate(parts, 1)
    whole = np.sort(f1)
    many = np.searchsorted(whole, f1, side="right") - np.searchsorted(whole, f1, side="left")
    some = np.flatnonzero(many > 1)  # only of these the second half matters
    order = some[np.lexsort((f2[some], f1[some]))]
    x, y = f1[order], f2[order]
    near = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    hit = np.zeros(len(k), bool)
    hit[order[1:][near]] = hit[order[:-1][near]] = True
    hit &= known == 0
    cut = lambda v: pa.array(v[hit].view(np.int64))
    return pa.table({"k": cut(k), "nb": cut(nb), "a": cut(at), "b": pa.array(at[hit].view(np.int64) + 1)})


def _cut_batches(length: int):
    def run(batches):
        for b in batches:
            rows = []
            for i, text, many, shared in zip(*(c.to_pylist() for c in b.columns)):
                raw = (text or "").encode()
                kept, at, gone, spans, end = [], 0, 0, 0, -1
                for s in sorted((x["a"], x["b"] + length - 1) for x in many or ()):
                    if s[0] > end:
                        spans += 1
                    if s[0] > at:
                        kept.append(raw[at : s[0]])
                    gone += max(0, s[1] - max(at, s[0]))
                    at, end = max(at, s[1]), max(end, s[1])
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((i, len(raw), gone, spans, hashlib.sha256(left).hexdigest(), shared, left))
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, kept) for each row of ``docs`` (doc_id, text).

    ``kept`` is what is left of the text's UTF-8 bytes once every byte covered by a string of ``length`` bytes that
    starts anywhere else too is removed. ``n_shared`` only reports: how many windows of ``words`` words (parted by
    ASCII white space, compared as they are written) another row holds too. A null text is empty; texts under
    ``length`` bytes lose nothing; repeated rows of a long text each lose all; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("nb"))
    long_ = texts.where(F.col("nb") >= min(length, 2 * words - 1))
    found = settle(long_.select("k", "text").mapInArrow(tidied(_run_batches(length, gram, words, word_gram)), RUNS), "repeat-runs")
    of_bytes = found.where(F.col("kind") == BYTE_RUN).drop("kind")
    twice = of_bytes.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select(F.col("v").alias("w"))
    own = F.col("at").bitwiseAND(1 << LEN_BITS) != 0
    shared = of_bytes.where(~own).join(twice, F.col("v") == F.col("w"), "left_semi").union(of_bytes.where(own))
    shared = settle(shared, "repeat-shared")

    kinds = settle(shared.groupBy("v", "d").agg(F.count("*").alias("n"), F.min(F.struct("k", "nb", "at")).alias("one")), "repeat-kinds")
    same = kinds.where("n > 1").select(F.col("v").alias("w"), F.col("d").alias("e"))
    whole = shared.join(same, (F.col("v") == F.col("w")) & (F.col("d") == F.col("e")), "left_semi")
    first, size = F.shiftright("at", AT_BITS), F.col("at").bitwiseAND((1 << LEN_BITS) - 1)
    whole = whole.select("k", "nb", first.alias("a"), (first + size).alias("b"))

    held = F.col("one.at").bitwiseAND((1 << LEN_BITS) - 1) + length
    by = kinds.groupBy("v").agg(F.count("*").alias("kinds"), F.sum(held).alias("bytes"), F.max(F.col("one.at").bitwiseAND(1 << LEN_BITS)).alias("own")).where("kinds > 1 or own > 0")
    by = settle(by.select(F.col("v").alias("w"), "bytes"), "repeat-anchors")
    total, over_full = by.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bytes") > shard_bytes, F.col("bytes"))), F.lit(0))).first()
    ranges = max(1, -(-over_full // RANGE_BYTES))
    shards = max(1, -(-total // shard_bytes))
    some = kinds.join(by, F.col("v") == F.col("w"))
    parts = F.ceil(F.col("bytes") / shard_bytes)
    unit = F.xxhash64("v", F.when(parts > 1, F.pmod(F.xxhash64("d"), parts)).otherwise(F.lit(0)))
    shard = F.pmod(unit, F.lit(shards))
    none = F.lit(None)
    run = lambda at, shard, unit, lone, split, parts: F.struct(at.alias("at"), shard.cast("long").alias("shard"), unit.cast("long").alias("unit"), lone.alias("lone"), split.alias("split"), parts.cast("long").alias("parts")).alias("run")
    some = some.select("one.k", "one.nb", run(F.col("one.at"), shard, unit, F.col("n") == 1, parts > 1, none))

    of_words = found.where(F.col("kind") == WORD_RUN)
    own = F.col("at").bitwiseAND((1 << LEN_BITS) - 1)
    over = of_words.groupBy("v").agg(F.min("k").alias("x"), F.max("k").alias("y"), F.ceil(F.sum(own) / FLUSH).alias("parts")).where("x <> y").select(F.col("v").alias("w"), "parts")
    of_words = settle(of_words.join(over, F.col("v") == F.col("w")).select("k", "nb", "at", "v", "parts").distinct(), "repeat-word-runs")
    windows = of_words.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0]
    buckets = max(1, -(-windows // FLUSH))
    bucket = F.pmod(F.xxhash64("v"), F.lit(buckets))
    some = some.union(of_words.select("k", "nb", run(F.col("at"), bucket, none, none.cast("boolean"), none.cast("boolean"), F.least("parts", F.lit(buckets)))))
    wanted = settle(some.groupBy("k", "nb").agg(F.collect_list("run").alias("runs")), "repeat-wanted")
    # Of equal texts one row is enough; texts that nothing is wanted of aren't moved.
    one = sifted(long_.select("k", "nb", "text"), "k", sieve(wanted, "k"), "likely").where("likely").drop("likely").dropDuplicates(["k", "nb"])
    one = one.join(wanted.select(F.col("k").alias("wk"), F.col("nb").alias("wnb"), "runs"), (F.col("k") == F.col("wk")) & (F.col("nb") == F.col("wnb")))
    bytes_ = one.select("k", "nb", "text", "runs").mapInArrow(tidied(_slice_batches(length, words, buckets)), "k long, nb long, at long, shard long, unit long, lone boolean, split boolean, raw binary")
    done = settle(bytes_.groupBy("shard").applyInArrow(_shard(length, ranges), "k long, nb long, a long, b long, r long, packed binary"), "repeat-marks")
    discard(by, of_words, wanted)
    spans = whole.union(done.where("r is null and b is not null").select("k", "nb", "a", "b"))
    if over_full:
        spans = spans.union(done.where("r is not null").select("r", "packed").groupBy("r").applyInArrow(_merge, "k long, nb long, a long, b long"))
    # Of a text that two rows hold all windows are shared.
    copies = found.where(F.col("kind") == TEXT).groupBy("k", "nb").agg(F.count("*").alias("rows"), F.first("at").alias("n")).where("rows > 1 and n > 0")
    shared_words = done.where("b is null and r is null").groupBy("k", "nb").agg(F.sum("a").alias("n")).union(copies.select("k", "nb", "n"))
    span = F.struct("a", "b")
    marks = spans.select("k", "nb", span.alias("span"), F.lit(None).cast("long").alias("n")).union(shared_words.select("k", "nb", F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType).alias("span"), "n"))
    marks = settle(marks.groupBy("k", "nb").agg(F.collect_set("span").alias("spans"), F.coalesce(F.max("n"), F.lit(0)).alias("shared")), "repeat-spans")
    discard(found, shared, kinds, done)
    likely = sifted(texts, "k", sieve(marks, "k"), "likely")
    marks = marks.select(F.col("k").alias("wk"), F.col("nb").alias("wnb"), "spans", "shared")
    cut = likely.where("likely").join(marks, (F.col("k") == F.col("wk")) & (F.col("nb") == F.col("wnb")), "left").select("doc_id", "text", "spans", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))
    rest = likely.where("not likely").select("doc_id", "text", F.lit(None).cast(marks.schema["spans"].dataType).alias("spans"), F.lit(0).cast("long").alias("shared"))
    return cut.union(rest).mapInArrow(tidied(_cut_batches(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary")
