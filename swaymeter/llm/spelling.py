"""Spelling variants: k-d trees over letter counts find words one edit apart, the more frequent one becomes the form.

One inserted letter changes one count by one, one replaced letter takes one from a count and adds one to another, so words
one edit apart are at an L1 distance of at most two. Words are searched per pair of lengths: equal, one longer, one shorter.
The space of letter counts is cut into cells by an outer k-d tree, so that a length with very many words is shared out; a
word lies in one cell and asks every cell that it can reach. Inside a cell a k-d tree with tight boxes finds the leaves, and
only words of these leaves are compared letter by letter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaymeter.llm.common import cut, quoted, stored

LENGTH, LEAST, FACTOR, MODULUS = 6, 5, 5, 199
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words that one cell should hold, and words per leaf of its tree.
CELL, LEAF = 8_192, 48
#: Words whose letter counts place the cuts between cells; where these lie changes the work of a task, never the result.
SAMPLE = 200_000
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
LETTERS = 26 + 64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text) to (word, n), added up within the task as far as HELD words go."""
    held: Counter = Counter()
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            start = zlib.crc32((doc.as_py() + ":").encode())
            for run, n in Counter(RUN.findall((text.as_py() or "").encode().lower().decode())).items():
                if len(run) >= LENGTH:
                    h = zlib.crc32(run.encode(), start)
                    if h % MODULUS == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= LENGTH:
                        held[run] += n
            if len(held) > HELD:
                yield _words(held)
                held.clear()
    if held:
        yield _words(held)


def _words(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lower-cased, of at least LENGTH code points, found LEAST times.

    Of a run whose crc32 of `<doc_id>:<run>` is divisible by MODULUS one letter is deleted first. Null texts have no words, a
    null id counts as the text `null`, repeated rows count again. Texts are counted where they lie; only words are shuffled.
    """
    slim = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("null")).alias("id"), quoted(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of codes; every letter has a code below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row of `codes`, in the least type that holds their differences."""
    rows, length = codes.shape
    place = np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - 192 + 26) + LETTERS * np.arange(rows)[:, None]
    kind = np.int8 if length < 127 else np.int16 if length < 32_767 else np.int32
    return np.bincount(place.ravel(), minlength=rows * LETTERS).reshape(rows, LETTERS).astype(kind)


class Tree:
    """A k-d tree over the rows of `vectors`. `tight` boxes hug the rows; the others divide the whole space."""

    def __init__(self, vectors: np.ndarray, leaf: float, tight: bool):
        top = np.iinfo(vectors.dtype).max
        self.low, self.high, self.children, self.rows = [], [], [], []
        width = vectors.shape[1]
        todo = [(np.arange(len(vectors)), np.zeros(width, vectors.dtype), np.full(width, top, vectors.dtype), None)]
        while todo:
            rows, low, high, parent = todo.pop()
            here = vectors[rows]
            if tight and len(rows):
                low, high = here.min(axis=0), here.max(axis=0)
            node = len(self.low)
            if parent is not None:
                self.children[parent].append(node)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            spread = here.var(axis=0, dtype=np.float32) if len(rows) > leaf else np.zeros(1)
            at = int(spread.argmax())
            if spread[at] == 0:
                self.rows.append(rows)
                continue
            self.rows.append(None)
            column = here[:, at]
            most = min(int(np.median(column)), int(column.max()) - 1)
            for side, lower in ((column <= most, True), (column > most, False)):
                lo, hi = low.copy(), high.copy()
                if lower:
                    hi[at] = most
                else:
                    lo[at] = most + 1
                todo.append((rows[side], lo, hi, node))

    def search(self, asked: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of `asked`) wherever a row can lie in the leaf's box after adding `more` and taking `less` letters."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, rows = todo.pop()
            here = asked[rows]
            missing = np.maximum(self.low[node] - here, 0).sum(axis=1, dtype=np.int32)
            excess = np.maximum(here - self.high[node], 0).sum(axis=1, dtype=np.int32)
            rows = rows[(missing <= more) & (excess <= less)]
            if not len(rows):
                continue
            if self.rows[node] is not None:
                yield node, rows
            else:
                todo += [(child, rows) for child in self.children[node]]


#: By how many letters the word found is longer: letters to add, letters to take.
EDITS = {0: (1, 1), 1: (1, 0), -1: (0, 1)}


def one_edit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) whose letters differ by one edit; rows of `b` are as long as those of `a`, or one letter longer or
    shorter."""
    longer = b.shape[1] - a.shape[1]
    if longer < 0:
        j, i = one_edit(b, a)
        return i, j
    length = a.shape[1]
    if not longer:
        return np.nonzero((a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int32) == length - 1)
    head, tail = a[:, None, :] == b[None, :, :-1], a[:, None, :] == b[None, :, 1:]
    i, j = np.nonzero(head.sum(axis=2, dtype=np.int32) + tail.sum(axis=2, dtype=np.int32) >= length)
    same = np.logical_and.accumulate(head[i, j], axis=1).sum(axis=1) + np.logical_and.accumulate(tail[i, j, ::-1], axis=1).sum(axis=1)
    return i[same >= length], j[same >= length]


#: Letters compared at once.
BLOCK = 1 << 22


def near(asked: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of `asked` and `there`, one edit apart: tree over `there`, pruned by boxes, verified in the leaves."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a, b = counts(asked), counts(there)
    kind = np.promote_types(a.dtype, b.dtype)
    used = np.flatnonzero((a.max(axis=0) > 0) | (b.max(axis=0) > 0))
    a, b = a[:, used].astype(kind), b[:, used].astype(kind)
    tree = Tree(b, LEAF, tight=True)
    for leaf, rows in tree.search(a, *EDITS[there.shape[1] - asked.shape[1]]):
        inside = tree.rows[leaf]
        wide = max(1, math.isqrt(BLOCK // there.shape[1]))
        for k in range(0, len(inside), wide):
            part = inside[k : k + wide]
            step = max(1, BLOCK // (len(part) * there.shape[1]))
            for s in range(0, len(rows), step):
                x, y = one_edit(asked[rows[s : s + step]], there[part])
                i.append(rows[s : s + step][x])
                j.append(part[y])
    return np.concatenate(i), np.concatenate(j)


class _Cells:
    """Deals words to the cells of their own length and of the lengths beside it. `trees` holds the divided lengths."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees = trees

    def _reached(self, vectors: np.ndarray, length: int, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        tree = self.trees.get(length)
        if tree is None:
            yield 0, np.arange(len(vectors))
        else:
            yield from tree.search(vectors.astype(tree.low[0].dtype), more, less)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), object)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            by_length: dict[int, list[int]] = {}
            for at, word in enumerate(words):
                by_length.setdefault(len(word), []).append(at)
            for length, where in by_length.items():
                at = np.array(where)
                vectors = counts(letters(words[at].tolist()))
                for home, rows in self._reached(vectors, length, 0, 0):
                    yield self._rows(length, home, True, words[at[rows]], n[at[rows]])
                for longer, (more, less) in EDITS.items():
                    for cell, rows in self._reached(vectors, length + longer, more, less):
                        yield self._rows(length + longer, cell, False, words[at[rows]], n[at[rows]])

    @staticmethod
    def _rows(length: int, cell: int, home: bool, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(words)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, length, np.int32)), pa.array(np.full(k, cell, np.int32)), pa.array(np.full(k, home)), pa.array(words, pa.string()), pa.array(n)],
            ["length", "cell", "home", "word", "n"])


def _cell(group: pa.Table) -> pa.Table:
    """One cell: its words (`home`) and those that ask it, to the number and the best of the near words of each."""
    home = np.array(group.column("home").to_pylist(), bool)
    words = np.array(group.column("word").to_pylist(), object)
    n = group.column("n").to_numpy()
    order = np.flatnonzero(home)[np.argsort(words[home])]
    there, there_n = words[order], n[order]
    asked = np.flatnonzero(~home)
    out: list[tuple] = [(w, k, 0, None, None) for w, k in zip(there, there_n.tolist(), strict=True)]
    length = group.column("length")[0].as_py()
    for other in (length - 1, length, length + 1) if len(order) else ():
        rows = asked[[len(words[a]) == other for a in asked]]
        if not len(rows):
            continue
        i, j = near(letters(words[rows].tolist()), letters(there.tolist()))
        found = np.bincount(i, minlength=len(rows))
        first = np.lexsort((j, -there_n[j], i))
        i, j = i[first], j[first]
        lead = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(i[lead], j[lead], strict=True):
            out.append((words[rows[a]], int(n[rows[a]]), int(found[a]), int(there_n[b]), there[b]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table({name: pa.array(col, kind) for name, col, kind in zip(["word", "n", "n_near", "best_n", "best"], columns, kinds, strict=True)})


def _divided(words: DataFrame) -> dict[int, Tree]:
    """An outer tree for each length with more than CELL words, from at most about SAMPLE words chosen by their hash."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).collect()}
    if not sizes:
        return {}
    share = min(1.0, SAMPLE / sum(sizes.values()))
    drawn = words.where(F.length("word").isin(list(sizes))).where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    by_length: dict[int, list[str]] = {}
    for r in drawn.select("word").collect():
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    return {length: Tree(counts(letters(sample)), CELL * share, tight=False) for length, sample in by_length.items()}


def nearest(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) for distinct `words` (word, n): how many of them are one edit away, and the most
    frequent of these, ties by code points. Words that none is near have 0 and nulls; an empty table gives an empty result.

    A word asks each reachable cell once and gets back one row, so no pair of words is ever written.
    """
    dealt = words.select("word", "n").mapInArrow(_Cells(_divided(words)), "length int, cell int, home boolean, word string, n long")
    found = dealt.groupBy("length", "cell").applyInArrow(_cell, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    by_word = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return by_word.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct `words` (word, n).

    The form is the best near word if it is at least `factor` times as frequent, else null; the root is the end of the chain
    of forms. A chain multiplies the frequency at each step, so its length, and with it the number of joins, is bounded by
    the logarithm of the largest frequency.
    """
    found = stored(nearest(stored(words.select("word", "n"), "words")), "near-words")
    is_form = F.col("best_n") >= factor * F.col("n")
    formed = found.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    least, most = found.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(most / least, factor)) + 1 if most else 0
    up = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        hop = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs))
