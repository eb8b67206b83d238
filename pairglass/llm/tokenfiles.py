"""Token-ID output: files of one concatenated id array with Elias-Fano encoded document boundaries.

A file (little-endian) holds

    8 bytes   magic
    ids       unsigned 16-bit, or 32-bit for a larger vocabulary, all documents one after the other
    bounds    an Elias-Fano sequence: the id offset at which each document ends
    names     an Elias-Fano sequence: the doc_ids, less the first one, in ascending order
    footer    lengths, the first doc_id, the width of an id; a fixed number of bytes

An Elias-Fano sequence of n values up to u keeps the low ``log2(u / n)`` bits of each packed, and the high bits as a
bit vector with one bit for each value, with the place of every 512th one for select: about ``2 + log2(u / n)`` bits a
value, and offsets of single documents without a table of 64-bit numbers.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, ship

MAGIC = b"PGTOK\x00\x00\x01"
FOOTER = struct.Struct("<QQqQQB7x8s")
STEP = 512
#: Parts that are kept, and characters of the longest of them: so texts without spaces don't fill the cache.
CACHE, LONGEST = 500_000, 64
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
PROBE = ("a", "word", "straße", "naïve", "être", "niñoÿ", "internationalisation")


class EliasFano:
    """A non-decreasing sequence of numbers from 0; ``select(i)`` gives the i-th."""

    HEAD = struct.Struct("<QQBQQ")

    def __init__(self, n: int, top: int, low: int, lows: np.ndarray, highs: np.ndarray, marks: np.ndarray):
        self.n, self.top, self.low, self.lows, self.highs, self.marks = n, top, low, lows, highs, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        if low:
            bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            lows = np.zeros(0, np.uint8)
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        mask = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        mask[at] = 1
        return cls(n, top, low, lows, np.packbits(mask, bitorder="little"), at[::STEP].astype(np.uint32) if not n or at[-1] < 2**32 else at[::STEP].astype(np.uint64))

    def to_bytes(self) -> bytes:
        wide = self.marks.dtype == np.uint64
        return self.HEAD.pack(self.n, self.top, self.low | (128 if wide else 0), len(self.lows), len(self.highs)) + self.lows.tobytes() + self.highs.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, top, low, a, b = cls.HEAD.unpack_from(raw)
        o = cls.HEAD.size
        kind = np.uint64 if low & 128 else np.uint32
        return cls(n, top, low & 127, np.frombuffer(raw, np.uint8, a, o), np.frombuffer(raw, np.uint8, b, o + a), np.frombuffer(raw, kind, offset=o + a + b))

    def select(self, i: int) -> int:
        """The i-th value: from the mark before it, over at most the bits of ``STEP`` values."""
        at = int(self.marks[i // STEP])
        left = i % STEP
        byte = at >> 3
        word = int(self.highs[byte]) >> (at & 7) << (at & 7)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        high = (byte << 3) + (word & -word).bit_length() - 1 - i
        if not self.low:
            return high
        first = i * self.low
        piece = int.from_bytes(self.lows[first >> 3 : ((first + self.low - 1) >> 3) + 1].tobytes(), "little")
        return high << self.low | piece >> (first & 7) & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low:
            return high.astype(np.int64)
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.int64)
        return (high << self.low) | (bits << np.arange(self.low)).sum(1)


class TokenFile:
    """Random access to one file: documents by place or by doc_id, ids as numpy arrays."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        bounds, names, self.first, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        tail = size - FOOTER.size
        self.names = EliasFano.from_bytes(self.file.read_at(names, tail - names))
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, tail - names - bounds))

    def span(self, k: int) -> tuple[int, int]:
        return (self.bounds.select(k - 1) if k else 0), self.bounds.select(k)

    def read(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), f"<u{self.width}")

    def document(self, k: int) -> tuple[int, np.ndarray]:
        """(doc_id, ids with the end id) of the k-th document of the file."""
        return self._name(self.names.select(k)), self.read(*self.span(k))

    def _name(self, above: int) -> int:
        """A doc_id from its distance to the first one, which may take 64 bits without a sign."""
        return (self.first + above + 2**63) % 2**64 - 2**63

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        ends, names = self.bounds.all(), self.names.all()
        at, k = 0, 0
        while k < self.n_docs:
            upto = max(k + 1, int(np.searchsorted(ends, at + (1 << 22), side="right")))
            block = self.read(at, int(ends[upto - 1]))
            for i in range(k, upto):
                a = int(ends[i - 1]) if i else 0
                yield self._name(int(names[i])), block[a - at : int(ends[i]) - at]
            k, at = upto, int(ends[upto - 1])


def write_file(uri: str, documents: Iterator[tuple[int, bytes]], width: int) -> tuple[int, int, int, int]:
    """(documents, ids, first doc_id, last doc_id). ``documents`` ascend by doc_id. The file appears whole, by a rename."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{np.random.default_rng().integers(1 << 62):x}.part"
    ends, names, total = [], [], 0
    with fs.open_output_stream(own) as out:
        out.write(MAGIC)
        for name, ids in documents:
            out.write(ids)
            total += len(ids) // width
            ends.append(total)
            names.append(name)
        first = names[0] if names else 0
        bounds = EliasFano.of(np.array(ends, np.uint64)).to_bytes()
        names_ = EliasFano.of(np.array(names, np.int64).astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)).to_bytes()
        out.write(bounds + names_ + FOOTER.pack(len(bounds), len(names_), first, len(ends), total, width, MAGIC))
    fs.move(own, path)
    return len(ends), total, first, names[-1] if names else 0


class Parts(dict):
    """The ids of parts of texts, as bytes; a new part is encoded when it is asked for.

    The tokenizer lowers case, and cuts between a letter and a mark; so a part of Latin letters with at most one mark
    at its end has the ids of its lower-case letters, which go straight to the library's BPE model, and those of the
    mark. All other parts go through the whole tokenizer; those over ``LONGEST`` characters aren't kept.
    """

    def __init__(self, tokenizer, kind: str):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.kind, self.model = tokenizer, kind, tokenizer.model.tokenize
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: bytes_.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        probe = [*PROBE, *(x.upper() for x in PROBE), *(x + m for x in PROBE for m in ".,;:!?")]
        self.simple = True  # if both ways agree
        self.simple = all(self[w] == self.whole(w) for w in probe)
        self.clear()

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, w: str) -> bytes:
        if len(w) > LONGEST:
            return self.whole(w)
        m = WORD.fullmatch(w) if self.simple else None
        if m is None:
            got = self[w] = self.whole(w)
            return got
        body, mark = m.groups()
        low = body.lower()
        got = self.get(low)
        if got is None:
            got = self[low] = array(self.kind, [t.id for t in self.model(low if low.isascii() else low.translate(self.table))]).tobytes()
        if mark:
            got = self[w] = got + (self.get(mark) or self.setdefault(mark, self.whole(mark)))
        elif w != low:
            self[w] = got
        return got


class Encoder:
    """The ids of a text as bytes, from the tokenizers library.

    The tokenizer drops white space and never joins over it, so the ids of a text are those of its parts between
    spaces; parts are encoded once and kept. Texts that may hold the strings of special tokens go through whole.
    """

    def __init__(self, path: str, end: int, width: int):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("needs a little-endian machine")
        self.tokenizer, self.kind = Tokenizer.from_file(path), "H" if width == 2 else "I"
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = array(self.kind, [end]).tobytes()
        self.known = Parts(self.tokenizer, self.kind)
        self.whole = self.known.whole

    def encode(self, text: str) -> bytes:
        """The ids and the end id."""
        if any(m in text for m in self.marks):
            return self.whole(text) + self.end
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))) + self.end


@lru_cache(1)
def encoder(path: str, end: int, width: int) -> Encoder:
    return Encoder(path, end, width)


def _documents(batches, path, end, width):
    encode = encoder(path, end, width).encode
    for b in batches:
        for name, text in zip(b.column(0).to_pylist(), b.column(1)):
            yield name, encode(text.as_py() or "")


def _write(folder: str, path: str, end: int, width: int):
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        uri = f"{folder}/{shard:06d}.tok"
        docs, ids, first, last = write_file(uri, _documents(batches, path, end, width), width)
        if docs:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "docs": [docs], "ids": [ids], "first": [first], "last": [last], "shard": [shard]})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, *, folder: str | None = None, width: int = 2) -> list[dict]:
    """Write the ids of ``docs`` (doc_id, text) to files in ``folder``, in ascending doc_id over all files.

    Returns one entry for each file: uri, docs, ids, first and last doc_id, and start, the ids of all files before it.
    Files follow ranges of doc_id; texts are dealt out before they are encoded, so each is encoded once. A null text is
    empty and has the end id only; rows without doc_id come first, as the lowest long; repeated rows are all written,
    those of one doc_id in the order of a hash of the text; an empty table gives no files. A retried task writes its
    file again under the same name. Other columns are ignored. ``tokenizer`` is a path that executors can read.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh(spark, "tokens")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = "uri string, docs long, ids long, first long, last long, shard long"
    files = sorted((r.asDict() for r in dealt.mapInArrow(_write(folder, tokenizer, end, width), schema).collect()), key=lambda r: r["shard"])
    at = 0
    for f in files:
        f["start"], at = at, at + f["ids"]
    return files


def _read(batches):
    for b in batches:
        for uri, at in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
            out = []

            def batch(out):
                cols = list(zip(*out))
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

            for name, ids in TokenFile(uri):
                out.append((None if name == -(2**63) else name, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(out) == 10_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)


def read_tokens(spark: SparkSession, files: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in ``files``, read from the files."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(f["uri"], f["start"]) for f in files], "uri string, start long")
    return rows.repartition(len(files), "uri").mapInArrow(_read, schema)
