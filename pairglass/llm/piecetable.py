"""SentencePiece BPE encoding by a prefix table, and decoding.

Every prefix of a text has one encoding, so its last token is unique. The table holds that token for each prefix: of
the tokens that end there (all found at once by an automaton, longest first) it is the one that is compatible with the
last token of the prefix before it. The ids of the whole are then read backwards from the last prefix.

Two tokens are compatible if encoding their joint text gives just the two. That is decided from their merge trees: the
pieces along the right edge of the left token and the left edge of the right one exist for known spans of the merge
order, and a merge over the border would have come before both of its parts were merged away.

No piece of the vocabulary has a space mark after another character (runs of the mark apart), or a line break, so
texts are cut there and the parts' ids are kept by part.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, tidied

SPACE = "▁"
CACHE = 400_000
#: Parts of more characters are encoded anew each time, so that texts without spaces don't fill the cache.
LONGEST = 64
PAIRS = 400_000
BATCH_CHARS = 1 << 20


class PrefixTable:
    """For a SentencePiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bos, self.eos, self.unknown = m.bos_id(), m.eos_id(), m.unk_id()
        self.pieces = {m.id_to_piece(i): i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))}
        self.rank = {i: -m.get_score(i) for i in self.pieces.values()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(m.is_byte(i) for i in self.bytes)
        self.text = {i: p for p, i in self.pieces.items()}
        if m.normalize("a  b Ａ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}Ａ":
            raise ValueError("the model normalises texts")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("pieces cross words or lines")
        # The single characters, then all pieces in merge order, so that a piece's two parts come before it.
        self.left: dict[int, tuple[int, ...]] = {}
        self.right: dict[int, tuple[int, ...]] = {}
        self.reached: set[int] = set()
        for p, i in sorted(self.pieces.items(), key=lambda x: (len(x[0]) > 1, self.rank[x[1]], len(x[0]))):
            if len(p) == 1:
                self.left[i] = self.right[i] = (i,)
            elif (parts := self._parts(p, i)) is not None:
                a, b = parts
                self.left[i] = (*self.left[a], i)
                self.right[i] = (*self.right[b], i)
            else:
                continue
            self.reached.add(i)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if i in self.reached:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.width = n
        self.known: dict[str, bytes] = {}

    def _parts(self, p: str, i: int) -> tuple[int, int] | None:
        """The last merge that makes piece ``i``: the two tokens of its text's encoding if ``i`` itself were not there."""
        last: list[int | None] = [None] * (len(p) + 1)
        start = [0] * (len(p) + 1)
        for end in range(1, len(p) + 1):
            for a in range(0 if end < len(p) else 1, end):
                t = self.pieces.get(p[a:end])
                if t is None or t not in self.reached:
                    continue
                if a == 0 or (last[a] is not None and self._compatible(last[a], t, self.rank[i], len(p))):
                    last[end], start[end] = t, a
                    break
            if last[end] is None:
                return None
        b, at = last[len(p)], start[len(p)]
        a = last[at] if at else None
        return (a, b) if at and start[at] == 0 and a is not None else None

    def _compatible(self, x: int, y: int, below: float = float("inf"), longest: int = 1 << 30) -> bool:
        """``below``: only merges of a lesser rank happen, and none of ``longest`` characters (the piece in question)."""
        xs, ys = self.right[x], self.left[y]
        i = j = 0
        while True:
            # xs[i] and ys[j] touch; a merge over the border competes with the next merge on either side.
            t = self.pieces.get(self.text[xs[i]] + self.text[ys[j]])
            rx = self.rank[xs[i + 1]] if i + 1 < len(xs) else float("inf")
            ry = self.rank[ys[j + 1]] if j + 1 < len(ys) else float("inf")
            if t is not None and len(self.text[t]) < longest:
                r = self.rank[t]
                # Of equal ranks the leftmost merge comes first: the left token's own before the border's, that before the right token's.
                if r <= below and r < rx and r <= ry:
                    return False
            if rx == ry == float("inf"):
                return True
            if rx <= ry:
                i += 1
            else:
                j += 1

    def compatible(self, x: int, y: int) -> bool:
        key = x * self.width + y
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            got = self.fits[key] = self._compatible(x, y)
        return got

    def part(self, p: str) -> list[int]:
        """The ids of a part of a normalised text."""
        n = len(p)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        fits, width = self.fits, self.width
        reach = 0
        for end, (k, t) in self.automaton.iter(p):
            end += 1
            for gap in range(reach + 1, end):  # characters that no token ends at stand alone
                if last[gap] < 0:
                    last[gap], start[gap] = -2, gap - 1
            reach = end
            if last[end] >= 0:
                continue
            a = end - k
            before = last[a]
            if a == 0 or before == -2:
                last[end], start[end] = t, a
            elif before >= 0:
                ok = fits.get(before * width + t)
                if ok or ok is None and self.compatible(before, t):
                    last[end], start[end] = t, a
        for gap in range(reach + 1, n + 1):
            last[gap], start[gap] = -2, gap - 1
        out, at = [], n
        while at:
            t = last[at]
            if t >= 0:
                out.append(t)
            elif self.fallback:
                out += [self.bytes[b] for b in reversed(p[start[at] : at].encode("utf-8"))]
            else:
                out.append(self.unknown)
            at = start[at]
        return out[::-1]

    def _cut(self, text: str) -> list[str]:
        """Parts of a text; a space mark stands before a part unless it begins with a line break."""
        return text.replace("\n", " \n").split(" ")

    def body(self, text: str) -> bytes:
        """The ids of a text without begin and end, as little-endian 32-bit numbers."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or text[0] == "\n" or "\0" in text or SPACE in text:
            return self.slow(text)
        parts, known = self._cut(text), self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            out = []
            for p in parts:
                if (ids := known.get(p)) is None:
                    ids = np.array(self.part(p if p[:1] == "\n" else SPACE + p), "<u4").tobytes()
                    if len(p) <= LONGEST:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)

    def slow(self, text: str) -> bytes:
        """Texts with runs of spaces or marks of their own: cut before a run of marks."""
        t = SPACE + text.replace(" ", SPACE)
        out, known = [], self.known
        for p in re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+", t):
            key = "\x00" + p
            if (ids := known.get(key)) is None:
                ids = np.array(self.part(p), "<u4").tobytes()
                if len(p) <= LONGEST:
                    known[key] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """With begin and end ids, exactly as the sentencepiece library encodes without sampling."""
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join((np.array([self.bos], "<u4").tobytes(), self.body(text), np.array([self.eos], "<u4").tobytes()))

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(1)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def _digest_batches(path):
    def run(batches):
        table = prefix_table(path)
        for b in batches:
            n, x, y = [], [], []
            for t in b.column(1).to_pylist():
                ids = table.encode(t or "")
                n.append(len(ids) // 4)
                x.append(hashlib.sha256(ids).hexdigest())
                y.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _id_batches(path):
    def run(batches):
        table = prefix_table(path)
        for b in batches:
            ids = [np.frombuffer(table.encode(t or ""), "<i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text): with begin and end ids.

    A null or empty text has these two only; repeated rows each get their row; an empty table gives none; other
    columns are ignored. ``model`` is a path that executors can read.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_id_batches(model)), "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text that they decode to."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_digest_batches(model)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
