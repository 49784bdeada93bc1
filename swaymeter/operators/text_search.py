"""Free-text search over stored fragment signatures.

A signature is a set of bits, one for each hash of three letters or digits in a row of the folded text. A text that holds the
query has all bits of the query's fragments, so only texts with these are read and compared. Signatures are a small table of
their own (see `signatures`), made once per article, in one pass of Arrow tasks over the folded text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaymeter.functions.base import all_of, icontains
from swaymeter.operators.filters import search
from swaymeter.operators.term_search import FRAGMENT

BITS = 4096
#: Characters and texts that are taken apart at once.
CHARS, TEXTS = 1 << 21, 1 << 10
#: Letters and digits whose fragments have a place in a table; others are hashed as they come.
LETTERS = 160
UNKNOWN = -2


class _Places:
    """The places of fragments in the signature: of the first LETTERS letters and digits that are met from a table that fills
    as they come, so that nearly every fragment costs a look into the table and no hash."""

    def __init__(self):
        self.letters: list[str] = [""]
        self.number = np.full(0x110000, -1, np.int16)  # -1: not met; 0: neither letter nor digit; LETTERS + 1: not in the table
        self.table = np.full((LETTERS + 1) ** FRAGMENT, UNKNOWN, np.int16)  # -1: no fragment
        at = self.table.reshape((LETTERS + 1,) * FRAGMENT)
        at[0], at[:, 0], at[:, :, 0] = -1, -1, -1

    @staticmethod
    def place(fragment: str) -> int:
        """The one of `pmod(xxhash64(fragment), BITS)`."""
        return xxhash.xxh64_intdigest(fragment.encode(), 42) % BITS

    def _numbered(self, points: np.ndarray) -> np.ndarray:
        numbers = self.number[points]
        for p in np.unique(points[numbers < 0]).tolist():
            if unicodedata.category(chr(p))[0] not in "LN":
                self.number[p] = 0
            elif len(self.letters) <= LETTERS:
                self.number[p] = len(self.letters)
                self.letters.append(chr(p))
            else:
                self.number[p] = LETTERS + 1
        return self.number[points] if (numbers < 0).any() else numbers

    def of(self, text: str) -> np.ndarray:
        """The place of the fragment at each character of a text, -1 where there is none; the last two have none."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = self._numbered(points).astype(np.int32)
        others = n > LETTERS
        if others.any():
            n[others] = 0
        key = (n[:-2] * (LETTERS + 1) + n[1:-1]) * (LETTERS + 1) + n[2:]
        out = self.table[key]
        new = np.unique(key[out == UNKNOWN])
        if len(new):
            spelled = ("".join(self.letters[k // (LETTERS + 1) ** i % (LETTERS + 1)] for i in (2, 1, 0)) for k in new.tolist())
            self.table[new] = [self.place(f) for f in spelled]
            out = self.table[key]
        if others.any():
            letter = others | (n > 0)
            rare = np.flatnonzero((others[:-2] | others[1:-1] | others[2:]) & letter[:-2] & letter[1:-1] & letter[2:])
            known: dict[str, int] = {}
            for i in rare.tolist():
                f = text[i : i + FRAGMENT]
                if f not in known:
                    known[f] = self.place(f)
                out[i] = known[f]
        return out


def _chunks(texts: pa.Array):
    """The texts in runs of a bounded number of texts and characters (one text at least)."""
    run, size = [], 0
    for text in texts:
        run.append(text.as_py() or "")
        size += len(run[-1])
        if len(run) == TEXTS or size > CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _signed(texts: pa.Array, places: _Places) -> pa.Array:
    bits, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for run in _chunks(texts):
        place = places.of("\n".join(run) + "\n\n\n")  # no fragment reaches over a line end
        row = np.repeat(np.arange(len(run)), [len(t) + 1 for t in run])
        real = place >= 0
        marks = np.zeros(len(run) * BITS, bool)
        marks[row[real] * BITS + place[real]] = True
        found = np.flatnonzero(marks)
        bits.append((found % BITS).astype(np.int32))
        counts.append(np.bincount(found // BITS, minlength=len(run)))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bits)), mask=texts.is_null() if texts.null_count else None)


def _bits(text: Column) -> Column:
    """The distinct places of the fragments of a text in the signature, ascending; NULL for no text."""
    made: list[_Places] = []

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(_Places())
        return _signed(texts, made[0])

    return places(F.upper(text))


def signatures(df: DataFrame, text: str = "article_text", key: str = "id") -> DataFrame:
    """(key, bits): the set bits of each text, ascending; NULL for no text. Rows stay where they are."""
    return df.select(key, _bits(F.col(text)).alias("bits"))


def candidates(signed: DataFrame, query: str, key: str = "id") -> DataFrame:
    """The keys whose text can hold the query; all of them where the query has no fragment."""
    # the bits of the query, from the expression that made the signatures
    needed = signed.sparkSession.range(1).select(_bits(F.lit(query)).alias("p")).first()["p"]
    return signed.where(all_of(F.array_contains("bits", p) for p in sorted(needed))).select(key)


def search_texts(articles: DataFrame, signed: DataFrame, query: str, text: str = "article_text", author: str | None = "author",
                 key: str = "id") -> DataFrame:
    """Rows of `articles` whose text (or author, if named) holds the query, ignoring case: those of `filters.search`.

    Texts are read for the candidates only. An empty query finds every row.
    """
    if not query:
        return articles
    found = articles.join(candidates(signed, query, key), key, "left_semi").where(icontains(text, query))
    hits = found.select(key)
    if author:
        hits = hits.unionByName(articles.where(search(query, author)).select(key)).distinct()
        return articles.join(hits, key, "left_semi")
    return found
