"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over with training tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter.llm.common import in_arrow, pick

WINDOW = 13
#: A document is contaminated when at least one in so many of its words lies in a benchmark passage.
COVERAGE = 20
#: Benchmark words held by one automaton (about 200 bytes a word). A larger benchmark is dealt over several automata,
#: each streamed over all documents, so memory does not grow with it.
SHARD_WORDS = 250_000
# after lower-casing A-Z: anything but ASCII that is neither digit nor letter
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall(text.encode().lower()) if text else []


class Automaton:
    """Suffix automaton of all items: every path from state 0 is a run of consecutive words of some item.

    `find` follows the words of a text and knows at every word the longest run that ends there and stands in some
    item. A run of WINDOW words, or the whole of a shorter item, is an occurrence; `owners` tells whose.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in found]) for item, found in items if found]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self._own(coded)

    def _extend(self, last: int, code: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if code in nxt[last]:
            old = nxt[last][code]
            return old if length[old] == length[last] + 1 else self._split(last, code, old)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and code not in nxt[state]:
            nxt[state][code] = new
            state = link[state]
        if state >= 0:
            old = nxt[state][code]
            link[new] = old if length[old] == length[state] + 1 else self._split(state, code, old)
        return new

    def _split(self, state: int, code: int, old: int) -> int:
        """Gives the runs through `state` a state of their own; longer runs keep the old one."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[old]))
        length.append(length[state] + 1)
        link.append(link[old])
        link[old] = copy
        while state >= 0 and nxt[state].get(code) == old:
            nxt[state][code] = copy
            state = link[state]
        return copy

    def _own(self, coded: list[tuple[object, list[int]]]) -> None:
        """For each state: the state of its last WINDOW words, whose items those are, and the short items ending there."""
        window, link, length = self.window, self.link, self.length
        n = len(link)
        self.window_state, self.short = [0] * n, [()] * n
        owners: list[set] = [set() for _ in range(n)]
        short: list[list[tuple[int, object]]] = [[] for _ in range(n)]
        for state in sorted(range(1, n), key=length.__getitem__):
            if length[state] >= window:
                self.window_state[state] = state if length[link[state]] < window else self.window_state[link[state]]
        for item, codes in coded:
            state = 0
            for at, code in enumerate(codes):
                state = self.next[state][code]
                if at + 1 >= window:
                    owners[self.window_state[state]].add(item)
            if len(codes) < window:
                short[state].append((len(codes), item))
        for state in sorted(range(1, n), key=length.__getitem__):
            self.short[state] = (*short[state], *self.short[link[state]])
        self.owners = [tuple(o) for o in owners]

    def find(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Marks in `hit` the words within occurrences and adds their items to `items`."""
        nxt, link, length, window, tails, short = self.next, self.link, self.length, self.window, self.window_state, self.short
        state = run = marked = 0
        for at, code in enumerate(map(self.ids.get, words)):
            if code is None:
                state = run = 0
                continue
            while code not in nxt[state]:
                if state == 0:
                    run = -1
                    break
                state = link[state]
                run = length[state]
            if run < 0:
                run = 0
                continue
            state = nxt[state][code]
            run += 1
            if run >= window:
                tail = tails[state]
                start = max(marked, at - window + 1)
                hit[start : at + 1] = b"\x01" * (at + 1 - start)
                marked = at + 1
                items.update(self.owners[tail])
            if short[state]:
                for size, item in short[state]:
                    if size <= run:
                        hit[at - size + 1 : at + 1] = b"\x01" * size
                        items.add(item)


def _shards(items: list[tuple[object, list[bytes]]], most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in groups of at most `most` words; an item longer than that is a group of its own."""
    group, size = [], 0
    for item, found in items:
        if group and size + len(found) > most:
            yield group
            group, size = [], 0
        group.append((item, found))
        size += len(found)
    if group:
        yield group


class _Stream:
    """Runs over batches of documents; `make` turns (batch, per row: words, hit marks, items) into an output batch."""

    def __init__(self, items: list[tuple[object, str | None]], text_at: int, make, window: int, shard_words: int):
        self.items, self.text_at, self.make, self.window, self.shard_words = items, text_at, make, window, shard_words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = list(_shards([(item, tokens(text)) for item, text in self.items], self.shard_words)) or [[]]
        kept = Automaton(groups[0], self.window) if len(groups) == 1 else None
        for batch in batches:
            texts = [t.as_py() for t in batch.column(self.text_at)]
            marks: list = [None] * len(texts)
            for group in groups:
                automaton = kept or Automaton(group, self.window)
                for i, text in enumerate(texts):
                    found = tokens(text)
                    marks[i] = marks[i] or (bytearray(len(found)), set())
                    automaton.find(found, *marks[i])
            yield self.make(batch, texts, marks)


#: The benchmark is sent to every task as a whole: test sets are small by their nature. Beyond this size it is an error,
#: to be met by calling once per part of the benchmark.
MAX_BENCHMARK_BYTES = 256 << 20


def benchmark_items(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[tuple[object, str | None]]:
    """The test items on the driver, their total size proven below MAX_BENCHMARK_BYTES first."""
    slim = pick(bench, item=item_col, text=text_col)
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {total} bytes; the bound is {MAX_BENCHMARK_BYTES}")
    return [(r["item"], r["text"]) for r in slim.collect()]


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and COVERAGE * n_hit >= n_words


def _digest(batch: pa.RecordBatch, texts, marks) -> pa.RecordBatch:
    rows = []
    for hit, items in marks:
        n, n_hit = len(hit), sum(hit)
        names = sorted(str(i) for i in items)
        rows.append((n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), contaminated(n, n_hit)))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
    arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of `docs`: words, words within benchmark passages, the items these belong to, the verdict.

    Null and empty texts have no words and are clean; null or empty items have no passages; items with equal texts all
    count; an item id of null is named `None`. No shuffle: documents are streamed in place.
    """
    slim = pick(docs, doc_id=id_col, text=text_col)
    rest = T.StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    run = _Stream(benchmark_items(bench), 1, _digest, window, shard_words)
    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], *rest.fields]))


def cut_out(text: str, hit: bytearray) -> str:
    """The text without the words marked, and without the separators between two of them."""
    raw, parts, at, before = text.encode(), [], 0, False
    for word, marked in zip(TOKEN.finditer(raw.lower()), hit, strict=True):
        if marked:
            if not before:
                parts.append(raw[at : word.start()])
            at = word.end()
        before = bool(marked)
        if not marked:
            parts.append(raw[at : word.end()])
            at = word.end()
    return b"".join([*parts, raw[at:]]).decode()


def long_runs(hit: bytearray, least: int) -> bytearray:
    """The marks of runs of at least `least` marked words; shorter runs are left out."""
    out = bytearray(len(hit))
    for run in re.finditer(rb"\x01{%d,}" % least, hit):
        out[run.start() : run.end()] = run[0]
    return out


class _Clean:
    def __init__(self, text_at: int, length_at: int | None, least: int):
        self.text_at, self.length_at, self.least = text_at, length_at, least

    def __call__(self, batch: pa.RecordBatch, texts, marks) -> pa.RecordBatch:
        keep = [not contaminated(len(hit), sum(hit)) for hit, _ in marks]
        passages = [long_runs(hit, self.least) if k else hit for k, (hit, _) in zip(keep, marks, strict=True)]
        clean = [cut_out(t, hit) if k and any(hit) else t for t, k, hit in zip(texts, keep, passages, strict=True)]
        columns = list(batch.columns)
        columns[self.text_at] = pa.array(clean, pa.string())
        if self.length_at is not None:
            old = columns[self.length_at]
            sizes = [old[i].as_py() if new is texts[i] else len(new) for i, new in enumerate(clean)]
            columns[self.length_at] = pa.array(sizes, old.type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))


def decontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", length_col: str | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` without contaminated documents (coverage limit), and without the passages of `window` or more benchmark
    words in the others (length limit). Shorter items count for the coverage alone: where one stands by itself in a clean
    document, its words stay. `length_col`, if named, is counted anew where a text changed.

    Null and empty texts have no words, are not contaminated and stay; null and empty items match nothing; repeated rows are
    rows of their own; other columns, whatever their names, pass unchanged; an empty table (of either kind) takes nothing out."""
    names = docs.columns
    make = _Clean(names.index(text_col), names.index(length_col) if length_col else None, window)
    return in_arrow(docs, _Stream(benchmark_items(bench), names.index(text_col), make, window, shard_words))


def op5_decontamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return overlaps(docs, bench)
