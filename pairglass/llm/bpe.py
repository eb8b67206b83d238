"""Byte-level BPE encoding by a priority queue of merges over a linked list of symbols, and decoding.

A part of a text (a word with the blank before it, a run of digits, of marks or of white space) starts as one symbol a
byte. The symbols are a doubly linked list in two arrays; the queue holds (rank, place) of every pair that can merge.
The lowest rank, and of equal ones the leftmost place, merges first; an entry whose left symbol is gone or whose pair
has changed since it was pushed is stale and skipped. A merge pushes the two pairs it makes, so a part of n bytes costs
O(n log n). Decoding concatenates the vocabulary's byte strings.

The marks of the vocabulary's special tokens are cut out of a text first and stand for themselves, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, tidied

CACHE = 400_000
#: Parts of more characters are encoded anew each time, so that texts without spaces don't fill the cache.
LONGEST = 64
#: White space and the parts of a text as byte-level vocabularies of this kind cut it (fixed values).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes are the same in the regex module and the library, whatever their Unicode versions; texts
#: with others are cut by the library's own splitter. ``_agree`` checks it.
KNOWN = "\u0000-՗‐-⁞€"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """For a byte-level BPE file of the tokenizers library without normaliser, dropout or prefix space."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("not a plain BPE model")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a byte-level model without normaliser and prefix space")
        letters = byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        if any(bytes([b]) not in vocab for b in range(256)):
            raise ValueError("a byte without a token")
        self.base = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.text = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", ())):
            raise ValueError("special tokens that take in what is beside them")
        self.text |= {i: t.encode("utf-8") for t, i in self.special.items()}
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.parts = regex.compile(PATTERN).findall
        self.usual = regex.compile(f"[{KNOWN}]*").fullmatch
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.known: dict[str, bytes] = {}
        self._agree()

    def _agree(self) -> None:
        """Raises ``ValueError`` if the library cuts at other places around any code point of ``KNOWN``."""
        points = [c for a, b in ((0, 0x557), (0x2010, 0x205E), (0x20AC, 0x20AC)) for c in map(chr, range(a, b + 1))]
        probe = "".join(f"!a{c}1{c}!{c}{c}|" for c in points)
        if self.parts(probe) != self._library(probe):
            raise ValueError("the library's classes of characters are other ones")

    def _library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def merged(self, part: bytes) -> list[int]:
        """The ids of one part."""
        sym = [self.base[b] for b in part]
        n, merges = len(sym), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], k) for k in range(n - 1) if (m := merges.get((sym[k], sym[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            j = after[k]
            if sym[k] < 0 or j >= n:
                continue
            m = merges.get((sym[k], sym[j]))
            if m is None or m[0] != rank:  # a neighbour has merged since
                continue
            sym[k], sym[j] = m[1], -1
            after[k] = right = after[j]
            if right < n:
                before[right] = k
                if (m := merges.get((sym[k], sym[right]))) is not None:
                    heapq.heappush(queue, (m[0], k))
            left = before[k]
            if left >= 0 and (m := merges.get((sym[left], sym[k]))) is not None:
                heapq.heappush(queue, (m[0], left))
        return [s for s in sym if s >= 0]

    def _plain(self, text: str) -> bytes:
        parts, known = self.parts(text) if self.usual(text) else self._library(text), self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            out = []
            for p in parts:
                if (ids := known.get(p)) is None:
                    ids = np.array(self.merged(p.encode("utf-8")), "<u4").tobytes()
                    if len(p) <= LONGEST:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, as the library's without further special tokens."""
        if len(self.known) > CACHE:
            self.known.clear()
        if self.cut is None or not any(m in text for m in self.special):
            return self._plain(text)
        pieces = self.cut.split(text)  # texts and marks by turns
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(pieces))

    def decode(self, ids: bytes) -> str:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(1)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _digest_batches(path):
    def run(batches):
        model = byte_pairs(path)
        for b in batches:
            n, x, y = [], [], []
            for t in b.column(1):
                ids = model.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                x.append(hashlib.sha256(ids).hexdigest())
                y.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _id_batches(path):
    def run(batches):
        model = byte_pairs(path)
        for b in batches:
            ids = [np.frombuffer(model.encode(t.as_py() or ""), "<i4") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _text_batches(path):
    def run(batches):
        model = byte_pairs(path)
        for b in batches:
            ids = b.column(1)
            texts = [None if not v.is_valid else model.decode(v.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for v in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text).

    A null or empty text has no ids (an empty array); a null doc_id stays null; repeated rows each get their row; an
    empty table gives none; other columns are ignored. ``model`` is a path that executors can read.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_id_batches(model)), "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): bytes that are no UTF-8 become U+FFFD; null ids give null; ids outside the
    vocabulary raise ``KeyError``."""
    ship(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidied(_text_batches(model)), "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text that they decode to; rows as
    in ``encode_documents``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_digest_batches(model)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
