"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only at the hits, checksums decide."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from swaymeter.llm.common import in_arrow, pick

BASE_KINDS = ("assign", "access", "hex")
#: Kinds in the order in which spans of one start are listed: the base kinds, then those with an embedded checksum.
KINDS = (*BASE_KINDS, "github", "npm")
# fixed values: keywords of assignments, prefixes of keys, and least lengths of the variable parts
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXES = {"akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ANCHORED = {"access": re.compile("AKIA[A-Z0-9]+"), "github": re.compile("gh[pousr]_[A-Za-z0-9]{36}"), "npm": re.compile("npm_[A-Za-z0-9]{36}")}
HEX = re.compile("[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
#: A run of HEX_MIN hex digits covers at least PROBES neighbouring multiples of STRIDE.
STRIDE, PROBES = 8, 3
PROBE = re.compile("[0-9a-f]{%d,}" % PROBES)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RANDOM_CHARS = 30


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, (len(word), "assign"))
    for prefix, kind in PREFIXES.items():
        found.add_word(prefix, (len(prefix), kind))
    found.make_automaton()
    return found


def checksum_holds(token: str) -> bool:
    """Whether the last 6 base-62 digits of a prefixed token are the CRC-32 of the 30 characters before them."""
    body, value = token[token.index("_") + 1 :], 0
    for ch in body[RANDOM_CHARS:]:
        value = value * 62 + BASE62.index(ch)
    return value == zlib.crc32(body[:RANDOM_CHARS].encode())


def _hex_spans(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for probe in PROBE.finditer(text[::STRIDE]):
        at = probe.start() * STRIDE
        while True:
            if at >= end:
                start = at
                while start > end and HEX.match(text[start - 1]):
                    start -= 1
                end = HEX.match(text, at).end()
                if end - start >= HEX_MIN:
                    yield start, end
            at = (end + STRIDE - 1) // STRIDE * STRIDE  # the same row of probes may cross into another run
            if at >= probe.end() * STRIDE:
                break


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, in code points, ordered by start and then by kind as in KINDS.

    Spans of one kind are the leftmost non-overlapping matches of its pattern over the whole text; spans of different
    kinds may overlap. Assignments, access keys and hex strings are judged by length, the other kinds by the checksum
    within the token. Null and empty texts have none.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered; ASCII letters are all that matters here
        low = "".join(c.lower() if c.isascii() else c for c in text)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in _automaton().iter(low))
    found, done = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < done[kind]:
            continue
        match = (ASSIGN if kind == "assign" else ANCHORED[kind]).match(text, at)
        if match is None:
            continue
        done[kind] = match.end()
        if kind == "assign":
            good = match.end() - match.start(2) >= ASSIGN_MIN
        elif kind == "access":
            good = match.end() - at >= ACCESS_MIN
        else:
            good = checksum_holds(match.group())
        if good:
            found.append((kind, at, match.end()))
    found += (("hex", *span) for span in _hex_spans(text))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every secret replaced by its kind in brackets; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


DIGEST = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, spans = {k: [] for k in BASE_KINDS}, [], []
        for text in batch.column(1):
            found = find_secrets(text.as_py())
            base = [s for s in found if s[0] in BASE_KINDS]
            for k in BASE_KINDS:
                counts[k].append(sum(s[0] == k for s in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(found))
        arrays = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, counts of the base kinds, digest of the base spans, all spans.

    Nothing is shuffled; a repeated row gives its result again, an empty table an empty result.
    """
    slim = pick(docs, doc_id=id_col, text=text_col)
    rest = T.StructType.fromDDL(DIGEST)
    return slim.mapInArrow(_digest, T.StructType([slim.schema["doc_id"], *rest.fields]))


class _Redact:
    def __init__(self, text_at: int, length_at: int | None):
        self.text_at, self.length_at = text_at, length_at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, find_secrets(t)) for t in (x.as_py() for x in batch.column(self.text_at))]
            columns = list(batch.columns)
            columns[self.text_at] = pa.array(texts, pa.string())
            if self.length_at is not None:
                old = columns[self.length_at]
                sizes = [old[i].as_py() if t is None else len(t) for i, t in enumerate(texts)]
                columns[self.length_at] = pa.array(sizes, old.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`docs` with secrets in the text replaced by their kind; `length_col`, if named, is counted anew.

    Null texts stay null and keep their length; other columns pass through.
    """
    names = docs.columns
    return in_arrow(docs, _Redact(names.index(text_col), names.index(length_col) if length_col else None))


def op2_secret_scans(docs: DataFrame) -> DataFrame:
    return scan(docs)
