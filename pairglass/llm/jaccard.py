"""N-gram Jaccard join in metric space: groups of documents within a Jaccard distance, exactly.

Nearly all pairs of documents are at distance 1, so documents as pivots can't part a corpus: every window of the
triangle inequality would hold everything. The join goes down in three steps instead, each exact:

1. Shingles found several times (shared passages, large groups of copies) are counted over all documents. Pivots are
   single shingles in a fixed order: that of their hashes, but the most crowded ones, found more than ``CROWD`` times,
   come last. The order decides how much is compared, never what is found.
2. A document is in the region of each pivot within its window, the first ``n - ceil(t n) + 1`` of its shingles: two
   sets within the threshold share a pivot in both windows. Within a region only pairs pass whose sizes, and whose
   shingles from there on, can reach the threshold.
3. Regions of crowded pivots get a document as pivot. All their members' distances to it are measured; members within
   the threshold are one component. By the triangle inequality two others can link only if their distances to the
   pivot differ by no more than the threshold's, so members are dealt into rings of that width, and a ring is joined
   with itself and the next one, in blocks, wherever it holds more than one component.

Equal sets are one class throughout. Pairs are first held against sketches (counts of shingles by hash, whose
difference in L1 is no larger than the sets' symmetric difference), then sets are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, release, settle, ship, sieve, sifted, tidied, unused

WORDS = 5
PERCENT = 75
CROWD = 64
#: At most so many pivots change places in the order (the most crowded ones); a bound on what is broadcast, not on results.
MOVED = 200_000
PIECE = 1 << 19
FLUSH = 300_000
COUNT_FLUSH = 2_000_000
BLOCK = 2048
#: Regions of up to so many members are sifted by sketches before sets are read; larger ones are measured as they are.
SIFTED = 4096
#: Pairs of one set that are compared in one group.
HAND = 512
#: A place or a size in a post that doesn't fit; it passes every bound.
UNKNOWN = 65535
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, 2 * PIECE)
        _powers["up"] = np.cumprod(np.full(m, _BASE, _U))
        _powers["down"] = np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), _U))
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of UTF-8 bytes, A-Z as a-z."""
    a = _LOW[raw]
    space = _SPACE[a]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    up, down = _power(len(a))
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * up, out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U)), first


def _long_hashes(raw: np.ndarray) -> np.ndarray:
    """Of a long text, in pieces that end at white space."""
    out, a = [], 0
    while a < len(raw):
        b = min(len(raw), a + PIECE)
        while b < len(raw) and not _SPACE[raw[b]]:
            b += 1
        out.append(word_hashes(raw[a:b])[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; a shorter text is one shingle; without words none."""
    out: list[np.ndarray] = [np.zeros(0, _U)] * len(texts)
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= PIECE):
            n += len(texts[j])
            j += 1
        some = texts[i:j]
        if n > 2 * PIECE:
            w = _long_hashes(np.frombuffer(some[0], np.uint8))
            doc = np.zeros(len(w), np.int64)
        else:
            w, first = word_hashes(np.frombuffer(b"\n".join(some) + b"\n", np.uint8))
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in some]), first, side="right")
        k = _U(0x9FB21C651E98DF25)
        count = np.bincount(doc, minlength=len(some))
        d, h = np.zeros(0, np.int64), np.zeros(0, _U)
        if len(w) >= words:
            m = len(w) - words + 1
            h = w[:m]
            for s in range(1, words):
                h = h * k + w[s : m + s]
            inside = doc[:m] == doc[words - 1 :]
            h, d = mix(h)[inside], doc[:m][inside]
        begin = np.cumsum(count) - count
        for x in np.flatnonzero((count > 0) & (count < words)).tolist():
            v = w[begin[x] : begin[x] + 1]
            for s in range(1, count[x]):
                v = v * k + w[begin[x] + s]
            d, h = np.append(d, x), np.append(h, mix(v + _U(count[x])))
        o = np.lexsort((h, d))
        d, h = d[o], h[o]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        d, h = d[new], h[new]
        at = np.searchsorted(d, np.arange(len(some) + 1))
        for x in range(len(some)):
            out[i + x] = h[at[x] : at[x + 1]]
        i = j
    return out


def class_of(s: np.ndarray) -> int:
    """The name of a set; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """Counts of shingles by the low bits of their hashes, about one count for eight shingles; counts end at 255."""
    m = 1 << min(14, max(5, (len(s) // 8).bit_length()))
    return np.minimum(np.bincount((s & _U(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """No more than the symmetric difference of the two sets."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        if a.max() == 255:
            return 0
        a = a.reshape(-1, len(b)).sum(0)
        if b.max() == 255:
            return 0
    return int(np.abs(a - b).sum())


def window(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Posts:
    """Collects (pivot, place, set) by bucket, and gives them out as packed rows; members of crowded regions as rows."""

    def __init__(self, buckets: int):
        self.buckets, self.seen, self.n = buckets, set(), 0
        self.pivot, self.key, self.place, self.size, self.members = [], [], [], [], []

    def add(self, key: int, n: int, pivots: np.ndarray, heads: np.ndarray) -> None:
        """``pivots`` of the window in order, then the pivots by document of the crowded ones among them."""
        if key not in self.seen:
            self.seen.add(key)
            m = len(pivots)
            self.pivot.append(pivots)
            self.key.append(np.full(m, key, np.int64))
            self.place.append(np.minimum(np.arange(m), UNKNOWN).astype(np.uint16))
            self.size.append(np.full(m, min(n, UNKNOWN), np.uint16))
            self.members += [(int(h), key) for h in np.unique(heads).tolist() if h != key]
            self.n += m + len(heads)

    def rows(self):
        """(bucket, posts, how many, head, member)."""
        if self.pivot:
            p, k, q, n = (np.concatenate(x) for x in (self.pivot, self.key, self.place, self.size))
            bucket = ((p >> _U(32)) % _U(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            p, k, q, n, bucket = p[order].astype(np.uint32), k[order], q[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                yield int(bucket[a]), k[a:b].tobytes() + p[a:b].tobytes() + q[a:b].tobytes() + n[a:b].tobytes(), b - a, None, None
        for head, member in self.members:
            yield member % self.buckets, None, 0, head, member
        self.__init__(self.buckets)


ROWS = "crowd boolean, doc_id long, tk long, key long, n long, sketch binary"
_ROWS = tuple(zip(("crowd", "doc_id", "tk", "key", "n", "sketch"), (pa.bool_(), *[pa.int64()] * 4, pa.binary())))
POSTS = "bucket int, posts binary, n_posts long, head long, member long"
_POSTS = tuple(zip(("bucket", "posts", "n_posts", "head", "member"), (pa.int32(), pa.binary(), *[pa.int64()] * 3)))


def _batch(rows, fields):
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])


def _raw_texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sliced(batches, text: int, most: int = 4 << 20):
    """Batches of about ``most`` bytes of text or one row."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
            yield b.slice(a, z - a)
            a = z


class Counts:
    """Counts shingles of different sets; gives out those found more than once, with the least set that has them."""

    def __init__(self):
        self.sets, self.n = {}, 0

    def add(self, key: int, s: np.ndarray) -> None:
        if key not in self.sets:
            self.sets[key] = s
            self.n += len(s)

    def rows(self):
        keys = sorted(self.sets)
        s = np.concatenate([self.sets[k] for k in keys]) if keys else np.zeros(0, _U)
        owner = np.repeat(np.array(keys, np.int64), [len(self.sets[k]) for k in keys])
        order = np.argsort(s, kind="stable")
        s = s[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]]))
        n = np.diff(first, append=len(s))
        many = n > 1
        self.__init__()
        shingle, least, n = s[first[many]].view(np.int64), owner[order[first[many]]], n[many]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(n), bool)), pa.nulls(len(n), pa.int64()), pa.array(least), pa.array(shingle), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.binary())],
            names=[f for f, _ in _ROWS],
        )


def _first(words: int):
    """One row for each document; and (true, null, least set, shingle, count) of shingles found more than once.

    A count is a lower bound: a task counts by parts of its documents, and a shingle found once in a part isn't given.
    """

    def run(batches):
        counts = Counts()
        for b in _sliced(batches, 2):
            rows = []
            for i, tk, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(_raw_texts(b.column(2)), words)):
                key = class_of(s)
                rows.append((False, i, tk, key, len(s), sketch(s) if len(s) else None))
                if len(s):
                    counts.add(key, s)
            yield _batch(rows, _ROWS)
            if counts.n >= COUNT_FLUSH:
                yield counts.rows()
        yield counts.rows()

    return run


def _post(words: int, percent: int, buckets: int, moved: np.ndarray, rank: np.ndarray, heads: np.ndarray):
    """The posts of all documents.

    moved: the sorted shingles that come last in the order; rank: their places there; heads: the sets that are pivots
    of their regions.
    """

    def run(batches):
        posts = Posts(buckets)
        for b in _sliced(batches, 0):
            for s in shingle_sets(_raw_texts(b.column(0)), words):
                if not len(s):
                    continue
                k = window(len(s), percent)
                mine = np.zeros(0, np.int64)
                if len(moved):
                    at = np.searchsorted(moved, s)
                    at[at == len(moved)] = 0
                    last = moved[at] == s
                    if last[:k].any():
                        tail = at[last]
                        front = s[~last][:k]
                        mine = heads[tail[np.argsort(rank[tail])][: k - len(front)]]
                        posts.add(class_of(s), len(s), front, mine)
                        continue
                posts.add(class_of(s), len(s), s[:k], mine)
            if posts.n >= FLUSH:
                yield _batch(posts.rows(), _POSTS)
        yield _batch(posts.rows(), _POSTS)

    return run


def _regions(percent: int, crowd: int):
    """Pairs within regions of a bucket (false, u, v); of crowded ones the members (true, pivot, v)."""

    def run(key, table):
        p, q, k, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for posts, m in zip(table["posts"].to_pylist(), table["n_posts"].to_pylist()):
            if m:
                k.append(np.frombuffer(posts, np.int64, m))
                p.append(np.frombuffer(posts, np.uint32, m, 8 * m))
                q.append(np.frombuffer(posts, np.uint16, m, 12 * m))
                n.append(np.frombuffer(posts, np.uint16, m, 14 * m))
        p, q, k, n = np.concatenate(p), np.concatenate(q).astype(np.int64), np.concatenate(k), np.concatenate(n).astype(np.int64)
        o = np.lexsort((q, k, p))
        p, q, k, n = p[o], q[o], k[o], n[o]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        p, q, k, n = p[new], q[new], k[new], n[new]
        begin = np.flatnonzero(np.concatenate([np.ones(min(len(p), 1), bool), p[1:] != p[:-1]]))
        size = np.diff(begin, append=len(p))
        out_u, out_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = begin[(size > 1) & (size <= crowd)], size[(size > 1) & (size <= crowd)]
        for step in range(1, int(small[1].max(initial=1))):  # neighbours ``step`` apart, of all regions at once
            b, s = small[0][small[1] > step], small[1][small[1] > step] - step
            i = np.repeat(b - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
            j = i + step
            reach = np.minimum(n[i] - q[i], n[j] - q[j])
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * reach >= percent * (n[i] + n[j]))
            ok |= (n[i] == UNKNOWN) | (n[j] == UNKNOWN)
            out_u.append(k[i[ok]])
            out_v.append(k[j[ok]])
        crowded = np.flatnonzero(size > crowd)  # the least key of each is its pivot
        heads = [np.full(size[x] - 1, k[begin[x]]) for x in crowded]
        heads.append(table["head"].drop_null().to_numpy())
        members = [k[begin[x] + 1 : begin[x] + size[x]] for x in crowded]
        members.append(table["member"].drop_null().to_numpy())
        out = []
        for crowd_, u, v in ((False, out_u, out_v), (True, heads, members)):
            both = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1).astype(np.int64), axis=0)
            out.append(pa.table({"crowd": pa.array(np.full(len(both), crowd_)), "u": pa.array(both[:, 0]), "v": pa.array(both[:, 1])}))
        release()
        return pa.concat_tables(out)

    return run


def _sketched(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for m, n, x, y in zip(*(b.column(c).to_pylist() for c in ("nu", "nv", "su", "sv"))):
                keep.append((100 + percent) * apart(x, y) <= (100 - percent) * (m + n))
            yield b.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return run


def with_partners(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which sets have another one that size and sketch don't keep apart."""
    long_ = np.array([len(x) for x in sketches])
    hit = np.zeros(len(sizes), bool)
    for m in np.unique(long_).tolist():  # sets within the threshold have sketches of one length, or of twice that
        at = np.flatnonzero((long_ == m) | (long_ == 2 * m))
        rows = [np.frombuffer(sketches[i], np.uint8) for i in at]
        full = np.array([r.max() == 255 for r in rows])  # counts that ended say nothing
        table = np.stack([(r if len(r) == m else r.reshape(2, m).sum(0, dtype=np.int32)).astype(np.int32) for r in rows])
        n = sizes[at]
        for x in range(len(at)):
            ok = 100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])
            ok[x] = False
            ys = np.flatnonzero(ok & ~(hit[at] & hit[at[x]]))
            if len(ys):
                away = np.abs(table[ys] - table[x]).sum(1)
                away[full[ys] | full[x]] = 0
                near = ys[(100 + percent) * away <= (100 - percent) * (n[ys] + n[x])]
                hit[at[near]] = True
                hit[at[x]] |= len(near) > 0
    return hit


def _partnered(percent: int):
    def run(key, table):
        hit = with_partners(table["n"].to_numpy(), table["sketch"].to_pylist(), percent)
        return table.filter(pa.array(hit)).select(["u", "v"])

    return run


def _set_batches(words: int):
    def run(batches):
        for b in _sliced(batches, 0):
            rows = [(class_of(s), s.tobytes()) for s in shingle_sets(_raw_texts(b.column(0)), words)]
            yield _batch(rows, (("key", pa.int64()), ("shingles", pa.binary())))

    return run


def shared_counts(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted ``x`` each of the sorted ``ys`` holds."""
    if not ys:
        return np.zeros(0, np.int64)
    y = np.concatenate(ys)
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    hit = np.concatenate([[0], np.cumsum(x[at] == y)])
    ends = np.cumsum([len(z) for z in ys])
    return hit[ends] - hit[np.concatenate([[0], ends[:-1]])]


def _verify(percent: int, keep_all: bool):
    """Pairs of one u with their sets: (u, v, whether linked, the distance); all pairs, or the linked ones."""

    def run(key, left, right):
        u = key[0].as_py()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            x = np.frombuffer(right["shingles"][0].as_py(), _U)
            v = left["v"].to_numpy()
            for a in range(0, len(v), 512):
                ys = [np.frombuffer(y, _U) for y in left["other"][a : a + 512].to_pylist()]
                both = shared_counts(x, ys)
                every = len(x) + np.array([len(y) for y in ys]) - both
                ok = np.ones(len(ys), bool) if keep_all else 100 * both >= percent * every
                for c, part in enumerate((v[a : a + 512][ok], (100 * both >= percent * every)[ok], (1 - both / every)[ok])):
                    out[c] = np.concatenate([out[c], part])
        return pa.table({"u": pa.array(np.full(len(out[0]), u), pa.int64()), "v": pa.array(out[0], pa.int64()), "linked": pa.array(out[1].astype(bool)), "away": pa.array(out[2].astype(np.float64))})

    return run


def _ring(percent: int):
    """Links between members of different components, of two blocks of rings around one pivot."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        side, member, comp = table["side"].to_numpy(), table["member"].to_numpy(), table["comp"].to_numpy()
        sets = [np.frombuffer(s, _U) for s in table["shingles"].to_pylist()]
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if len(set(comp[a])) > len(set(comp[b])):
            a, b = b, a
        out = []
        sizes = np.array([len(s) for s in sets])
        comp = np.unique(comp, return_inverse=True)[1]
        for x in b.tolist():  # the side with more components
            ys = a[(comp[a] != comp[x]) & (100 * np.minimum(sizes[a], sizes[x]) >= percent * np.maximum(sizes[a], sizes[x]))]
            if i == j:
                ys = ys[ys > x]
            if len(ys):
                both = shared_counts(sets[x], [sets[y] for y in ys])
                ys = ys[100 * both >= percent * (sizes[x] + sizes[ys] - both)]
                # One link to each component is enough, and then they are one.
                joined, one = np.unique(comp[ys], return_index=True)
                out += [(int(member[x]), int(member[y])) for y in ys[one]]
                comp[np.isin(comp, joined)] = comp[x]
        cols = list(zip(*out)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int, keep_all: bool) -> DataFrame:
    """``pairs`` (u, v) held against their sets; those of one u in groups of about ``HAND``."""
    hands = pairs.groupBy(F.col("u").alias("hu")).agg(F.ceil(F.count("*") / HAND).alias("hands"))
    # Settled, so that its size is known to the planner.
    dealt = settle(pairs.join(hands, F.col("u") == F.col("hu")).select("u", "v", F.pmod(F.xxhash64("v"), "hands").cast("int").alias("hand")), "jaccard-dealt")
    wanted = dealt.select(F.col("u").alias("w"), "hand").distinct()
    of = lambda side: sifted(sets, "key", sieve(dealt, side), "likely").where("likely")
    left = dealt.join(of("v").select(F.col("key").alias("k"), F.col("shingles").alias("other")), F.col("v") == F.col("k")).select(F.col("u").alias("pu"), F.col("hand").alias("ph"), "v", "other")
    right = wanted.join(of("u").select("key", "shingles"), F.col("key") == F.col("w")).select(F.col("key").alias("u"), "hand", "shingles")
    got = left.groupBy("pu", "ph").cogroup(right.groupBy("u", "hand")).applyInArrow(_verify(percent, keep_all), "u long, v long, linked boolean, away double")
    got = settle(got, "jaccard-measured" if keep_all else "jaccard-linked")
    discard(dealt)
    return got


def _sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """The sets of classes, from one text of each: only texts that pass a sieve are read into sets."""
    some = classes.join(keys, "key", "left_semi").groupBy("key").agg(F.min("tk").alias("wanted"))
    some = settle(some.select("key", "wanted"), "jaccard-wanted")
    texts = docs.select(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"), "text")
    texts = sifted(texts, "tk", sieve(some, "wanted"), "likely").where("likely").select("text")
    sets = texts.mapInArrow(tidied(_set_batches(words)), "key long, shingles binary").dropDuplicates(["key"])
    sets = settle(sets.join(some.select("key"), "key", "left_semi"), "jaccard-sets")
    discard(some)
    return sets


def link_classes(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, tk, key, n) name the class of each document's set, links (a, b) tie classes.

    tk is a hash of the text.

    The links span exactly the components of all pairs of classes within the threshold.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"), "text")
    first = settle(texts.mapInArrow(tidied(_first(words)), ROWS), "jaccard-first")
    rows = first.where("not crowd").select("doc_id", "tk", "key", "n", "sketch")
    counts = first.where("crowd").groupBy("key").agg(F.sum("n").alias("n"), F.min("tk").alias("head")).where(F.col("n") > crowd)
    crowded = counts.orderBy(F.desc("n"), "key").limit(MOVED).collect()
    moved, n, head = (np.array([r[c] for r in crowded], np.int64) for c in ("key", "n", "head"))
    o = np.argsort(moved.view(_U))
    moved, n, head = moved[o].view(_U), n[o], head[o]
    # The least crowded first, by powers of two; those with one pivot side by side, so that a window has few.
    rank = np.empty(len(moved), np.int64)
    rank[np.lexsort((moved, head, np.log2(np.maximum(n, 1)).astype(np.int64)))] = np.arange(len(moved))
    posts = docs.select("text").mapInArrow(tidied(_post(words, percent, buckets, moved, rank, head)), POSTS)
    found = settle(posts.groupBy("bucket").applyInArrow(_regions(percent, crowd), "crowd boolean, u long, v long"), "jaccard-regions")
    known = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    of = lambda x: known.select(F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = found.where("not crowd").select("u", "v").distinct()
    pairs = pairs.join(of("u"), F.col("u") == F.col("ku")).join(of("v"), F.col("v") == F.col("kv"))
    pairs = settle(pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(tidied(_sketched(percent)), "u long, v long"), "jaccard-pairs")
    members = settle(_members(found.where("crowd").select("u", "v").distinct(), known, percent), "jaccard-members")
    discard(found)
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).union(members.select("u")).union(members.select("v"))
    sets = _sets(docs, rows.select("key", "tk"), keys.distinct(), words)
    links = _links(pairs, sets, percent, False).select(F.col("u").alias("a"), F.col("v").alias("b"))
    discard(pairs)
    if not members.isEmpty():
        links = links.union(_crowded(members, sets, links, percent))
    discard(members, sets)
    return rows.select("doc_id", "tk", "key", "n"), links


def _members(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of the members of crowded regions (u, v) those that may link with another one there; all, of very large regions."""
    regions = members.groupBy(F.col("u").alias("ru")).agg((F.count("*") <= SIFTED).alias("small"))
    members = settle(members.join(regions, F.col("u") == F.col("ru")).select("u", "v", "small"), "jaccard-region-members")
    small = members.where("small").select("u", "v")
    small = small.union(small.select("u", F.col("u").alias("v")).distinct())
    small = small.join(known, F.col("v") == F.col("key")).select("u", "v", "n", "sketch")
    kept = small.groupBy("u").applyInArrow(_partnered(percent), "u long, v long").where("u <> v")
    return kept.union(members.where("not small").select("u", "v"))


def _crowded(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The links of crowded regions: ``members`` (u: the pivot, v), none of them larger than what is shipped in blocks."""
    width = 1 - percent / 100
    measured = _links(members, sets, percent, True)
    star = measured.where("linked").select(F.col("u").alias("a"), F.col("v").alias("b"))
    comps = components(links.union(star)).select(F.col("node").alias("m"), F.col("component").alias("c"))
    comps = settle(comps, "jaccard-crowd-components")
    own = measured.select("u", F.col("u").alias("member"), F.lit(0.0).alias("away")).distinct()
    every = measured.select("u", F.col("v").alias("member"), "away").union(own)
    every = every.join(comps, F.col("member") == F.col("m"), "left").select("u", "member", "away", F.coalesce("c", "member").alias("comp"))
    # A margin in the last place keeps members at a ring's edge in reach of both.
    ring = F.least(F.floor((F.col("away") + 1e-12) / width), F.lit(int(np.ceil(1 / width)) - 1)).cast("int")
    whole = every = settle(every.withColumn("ring", ring), "jaccard-rings")
    discard(comps)
    mixed = every.groupBy("u").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("u")
    every = every.join(mixed, "u", "left_semi")
    by = every.groupBy("u", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    by = by.select(F.col("u").alias("bu"), F.col("ring").alias("br"), "blocks", "lo", "hi")
    dealt = every.join(by, (F.col("u") == F.col("bu")) & (F.col("ring") == F.col("br")))
    dealt = dealt.select("u", "member", "comp", "ring", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"))
    # Sides are ring and block in one number; a pair of sides is made once, if its rings are one or neighbours.
    side = lambda r, b: r.cast("long") * (1 << 40) + b
    other = by.select(F.col("bu").alias("u"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("br").alias("ring"), b.alias("block")))).alias("o"))
    dealt_sides = settle(other.join(by.select(F.col("bu").alias("u"), F.col("br"), "blocks").groupBy("u").agg(F.collect_list(F.struct("br", "blocks")).alias("rings")), "u"), "jaccard-sides")
    near = F.filter("rings", lambda r: F.abs(r["br"] - F.col("o.ring")) <= 1)
    partners = F.flatten(F.transform(near, lambda r: F.transform(F.sequence(F.lit(0), r["blocks"] - 1), lambda b: side(r["br"], b))))
    sides = dealt_sides.select("u", F.col("o.ring").alias("ring"), F.col("o.block").alias("block"), F.explode(partners).alias("partner"))
    sides = sides.withColumn("side", side(F.col("ring"), F.col("block"))).withColumnRenamed("u", "su").withColumnRenamed("ring", "sr").withColumnRenamed("block", "sb")
    rows = dealt.join(sides, (F.col("u") == F.col("su")) & (F.col("ring") == F.col("sr")) & (F.col("block") == F.col("sb")))
    rows = rows.select("u", F.least("side", "partner").alias("i"), F.greatest("side", "partner").alias("j"), "side", "member", "comp")
    # Only pairs of blocks that hold more than one component are compared.
    held = rows.groupBy("u", "i", "j").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("u", "i", "j")
    dealt_rows = settle(rows.join(held, ["u", "i", "j"], "left_semi"), "jaccard-ring-rows")
    some = sifted(sets, "key", sieve(dealt_rows, "member"), "likely").where("likely")
    rows = dealt_rows.join(some.select(F.col("key").alias("k"), "shingles"), F.col("member") == F.col("k")).drop("k")
    rings = rows.select("u", "i", "j", "side", "member", "comp", "shingles").groupBy("u", "i", "j").applyInArrow(_ring(percent), "a long, b long")
    rings = settle(rings, "jaccard-ring-links")
    discard(whole, dealt_sides, dealt_rows)
    return star.union(rings)


def join(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct shingles. A text of
    fewer words is one shingle; null texts and texts without words have none and link with nothing. A null doc_id
    links like any other; its component is the least doc_id there is, null if there is none. Repeated rows are all
    returned, in one component unless they are empty. An empty table gives no rows; other columns are ignored.
    """
    rows, links = link_classes(docs, words=words, percent=percent, crowd=crowd)
    comps = settle(components(links), "jaccard-components")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comps, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("component", "key").alias("comp"))
    classes = settle(classes, "jaccard-classes")
    discard(comps)
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "c")
    named = settle(classes.join(least, F.col("comp") == F.col("c")).select(F.col("key").alias("k"), "component_id"), "jaccard-named")
    discard(classes)
    out = rows.join(named, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id, null after all others, then the least hash of a text.

    Rows are told apart by doc_id and text; of equal ones one is kept. Rows without words link with nothing and stay.
    """
    rows, links = link_classes(docs, words=words, percent=percent)
    own = tuple(unused(docs.columns, "none", "id", "tk"))
    named = lambda id_, tk: (id_.isNull().alias(own[0]), F.coalesce(id_, F.lit(0)).alias(own[1]), tk.alias(own[2]))
    rows = rows.where("n > 0").select("key", *named(F.col("doc_id"), F.col("tk")))
    comps = settle(components(links), "jaccard-components")
    classes = rows.groupBy("key").agg(F.min(F.struct(*own)).alias("least")).join(comps, F.col("key") == F.col("node"), "left")
    classes = settle(classes.select("key", "least", F.coalesce("component", "key").alias("comp")), "jaccard-classes")
    discard(comps)
    least = classes.groupBy("comp").agg(F.min("least").alias("best")).withColumnRenamed("comp", "c")
    best = settle(classes.join(least, F.col("comp") == F.col("c")).select(F.col("key").alias("k"), "best"), "jaccard-named")
    gone = rows.join(best, F.col("key") == F.col("k")).where(F.struct(*own) != F.col("best"))
    gone = settle(gone.select(*own).distinct(), "jaccard-gone")
    discard(classes, best)
    left = docs.select("*", *named(F.col("doc_id").cast("long"), F.coalesce(F.xxhash64("text"), F.lit(0))))
    # By the keys of the join, so that rows needn't be dealt again.
    return left.join(gone, list(own), "left_anti").dropDuplicates(list(own)).drop(*own)


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, hash(array_to_string(ws[i:i+4], ' ')) h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, case when len(ws) > 0 then 1 else 0 end) + 1)) i from w)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, (select min(b) from r where r.a = d.doc_id) component_id
from documents d left join n using (doc_id)
"""
