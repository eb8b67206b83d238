"""Secret scans: three base patterns, and an assignment-aware lexer that adds spans.

The lexer reads source and configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``<name>x</name>``) into
name-literal pairs, follows names that stand for literals and sums of strings, and scores each literal by how
sensitive its target's name is and how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship, tidied

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are maximal, so asking for the least length at once finds what filtering afterwards would.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

SIGN = re.compile(r"[=:]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
BLANKS = re.compile(r"[ \t]*+")
QUOTED = {
    '"': re.compile(r'"((?:[^"\\\n]++|\\.)*+)"'), "'": re.compile(r"'((?:[^'\\\n]++|\\.)*+)'"), "`": re.compile(r"`([^`\n]*+)`"),
}
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
TAG = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\s]{8,}+)</\1>")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENT = re.compile(r"[A-Za-z_$][A-Za-z_.$]*+")

#: How much a part of a target's name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "private": 0.6, "signing": 0.5, "encryption": 0.5,
    "key": 0.5, "api": 0.4, "access": 0.3, "client": 0.2, "session": 0.3, "cookie": 0.4, "dsn": 0.5, "salt": 0.5,
}
#: Name parts that say the value is not itself secret.
HARMLESS = {"id", "name", "path", "file", "url", "type", "length", "size", "count", "public", "hint", "field", "label", "header", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)(?:change_?me|example|placeholder|your[_-]|dummy|sample|redacted|todo|none|null|true|false|undefined|\*{3,}|x{4,}|\.{3,})")
#: Opening and closing marks of templates: a placeholder is anything with one of each, in this order.
TEMPLATES = (("<", ">"), ("${", "}"), ("{{", "}}"), ("%(", ")"))
LEAST = 1.5


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name.rpartition(".")[2] or name)]
    if not parts or any(p in HARMLESS for p in parts[-1:]):
        return 0.0
    return min(1.5, sum(SENSITIVE.get(p, 0.0) for p in set(parts)))


def templated(value: str) -> bool:
    return any((i := value.find(a)) >= 0 and value.find(b, i + len(a)) >= 0 for a, b in TEMPLATES)


class Value:
    """What a name stands for: its own literals and the values it refers to, and sums over all of them.

    Values are linked, not copied, so ``x = x + "..."`` on every line costs each line its own literals only. Characters
    beyond Latin-1 are counted in 256 classes, which bounds what a value keeps. Bare literals that end at one place
    (``a=b=c=...``) share what is counted of the longest, the first of them; ``ends`` keeps it by the place.
    """

    __slots__ = ("spans", "refs", "size", "counts", "spoilt", "found")
    MOST = 1 << 40

    def __init__(self, text: str, spans: list[tuple[int, int]], refs: list[Value], ends: dict[int, tuple[Counter, int, bool]]):
        self.spans, self.refs, self.found = spans, refs, False
        self.counts, self.size, self.spoilt = Counter(), 0, False
        for a, b in spans:
            if b not in ends:
                own = text[a:b]
                counts = Counter(own) if own.isascii() else Counter(c if c < "\u0100" else chr(256 + (ord(c) & 255)) for c in own)
                ends[b] = counts, b - a, " " in own or bool(PLACEHOLDER.search(own)) or templated(own)
            self.add(*ends[b])
        for r in refs:
            self.add(r.counts, r.size, r.spoilt)

    def add(self, counts: Counter, size: int, spoilt: bool) -> None:
        for c, n in counts.items():
            self.counts[c] = min(self.MOST, self.counts[c] + n)
        self.size, self.spoilt = min(self.MOST, self.size + size), self.spoilt or spoilt

    def score(self) -> float:
        """0 to 1 by Shannon entropy and classes of characters; 0 for short ones, placeholders and plain words."""
        if self.size < 8 or self.spoilt:
            return 0.0
        n = sum(self.counts.values())
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        kinds = {0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in self.counts}
        if len(kinds) == 1 and kinds != {2}:
            return 0.0
        return min(1.0, 0.25 * bits) * (0.5 + 0.2 * min(len(kinds), 3) - 0.1)

    def mark(self, into: set[tuple[int, int]]) -> None:
        """Put all spans into ``into``; each value once, whoever refers to it."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.found:
                v.found = True
                into.update(s for s in v.spans if s[1] > s[0])
                todo += v.refs


def name_before(text: str, j: int) -> str:
    """The name that ends before ``j``, but for closing quotes and brackets and blanks; empty where there is none."""
    while j > 0 and text[j - 1] in " \t":
        j -= 1
    while j > 0 and text[j - 1] in "\"'])":
        j -= 1
    i = j
    while i > 0 and text[i - 1] in NAME_CHARS:
        i -= 1
    return text[i:j].lstrip("0123456789.-")


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(target, spans of its literals, names referred to) for each assignment, in order.

    Names, blanks and literals are as long as they are. Runs of signs, names before them and bare literals are read
    once, however many signs share them.
    """
    start = upto = 0
    named, name = -1, ""
    run = (0, 0)
    for m in SIGN.finditer(text):
        i = j = m.start()
        if text[i + 1 : i + 2] == "=":
            continue
        if text[i - 1 : i] in (":", "="):
            while j > upto and text[j - 1] in ":=> ":
                j -= 1
            start = j = start if j == upto else j
            upto = i
        if j != named:
            named, name = j, name_before(text, j)
        if not name:
            continue
        at, literals, refs = i + 1, [], []
        if text[at : at + 1] == ">":
            at += 1
        while True:
            at = BLANKS.match(text, at).end()
            if q := QUOTED.get(text[at : at + 1]):
                if not (t := q.match(text, at)):
                    break
                literals.append(t.span(1))
                at = t.end()
            else:
                if not run[0] <= at < run[1]:
                    if not (t := BARE.match(text, at)):
                        break
                    run = t.span()
                if IDENT.fullmatch(text, at, run[1]):
                    refs.append(text[at : run[1]])
                else:
                    literals.append((at, run[1]))
                at = run[1]
            p = PLUS.match(text, at)
            if not p:
                break
            at = p.end()
        if literals or refs:
            yield name, literals, refs
    if "</" in text:
        for m in TAG.finditer(text):
            yield m[1], [m.span(2)], []


def lexed(text: str) -> set[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name."""
    found: set[tuple[int, int]] = set()
    known: dict[str, Value] = {}
    ends: dict[int, tuple[Counter, int, bool]] = {}
    last, score, longest = "", 0.0, 0
    for name, literals, refs in pairs(text):
        # A bare word with digits may be a literal or a name: it is a name if it stands for something.
        named = {text[a:b]: (a, b) for a, b in literals if b - a <= longest and text[a - 1 : a] not in QUOTED and text[a:b] in known}
        literals = [x for x in literals if x not in named.values()] if named else literals
        refs = [known[r] for r in dict.fromkeys([*refs, *named]) if r in known]
        if not literals and not refs:
            continue
        value = refs[0] if len(refs) == 1 and not literals else Value(text, literals, refs, ends)
        known[name], longest = value, max(longest, len(name))
        if name is not last:
            last, score = name, name_score(name)
        if score + 1 >= LEAST and score + value.score() >= LEAST:
            value.mark(found)
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, all): (start, end, kind) by start, then kind as listed in ``KINDS``, then end; null is empty."""
    t = text or ""
    base = []
    if "=" in t or ":" in t:
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    if "AKIA" in t:
        base += [(*m.span(), "access") for m in ACCESS.finditer(t)]
    base += [(*m.span(), "hex") for m in HEX.finditer(t)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    more = []
    if "=" in t or ":" in t or "</" in t:
        more = [(a, b, "lexed") for a, b in lexed(t) if not any(x <= a and b <= y for x, y, _ in base)]
    return base, sorted([*base, *more], key=order) if more else base


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """``text`` with each maximal run of ``spans`` replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("n_lexed", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def _scan_batches(batches):
    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            base, every = scan(t)
            n = Counter(k for _, _, k in every)
            rows.append((i, n["assign"], n["access"], n["hex"], n["lexed"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.string()] * 2)], names=SCHEMA.names
        )


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts by kind, a digest of the base spans, and all spans.

    Spans are code points of the text. A null or empty text has none; repeated rows give repeated rows; an empty
    table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidied(_scan_batches), SCHEMA)


def _redact_batches(at: int):
    def run(batches):
        for b in batches:
            texts = [t if t is None else redact(t, scan(t)[1]) for t in b.column(at).to_pylist()]
            cols = [*b.columns]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return run


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; null texts stay null, other columns as they are."""
    ship(docs.sparkSession)
    return docs.mapInArrow(tidied(_redact_batches(docs.columns.index("text"))), docs.schema)
