"""Conversation repair: the cheapest edits that make the roles of a damaged conversation `(s?(ua)+)?`.

The edits of one conversation are paths through a lattice: node (i, state) means that i rows are dealt with and the
roles kept so far end in `state`. Bidirectional Dijkstra searches it: a forward and a reverse heap meet, all crossings
of equal cost are finished, and the one with the least concatenated audit is taken. Between two nodes no audit of the
cheapest paths begins with another (what is left over would be insertions that lead back to the same node, at no cost), so
least audits of parts make the least audit of the whole. That lets long conversations be cut: each piece of SEGMENT rows is
solved from every state to every state, and the pieces are folded.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from swaymeter.llm.common import pick, stored

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after a system row, after a user row, after an assistant row. Conversations end in the first or last.
STATES, ENDS = range(4), (0, 3)
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: What an inserted or reroled row becomes, by state.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
SEGMENT = 256
#: Conversations of more rows or characters than this are searched in pieces by many tasks.
LONG_ROWS, LONG_CHARS = 4_096, 1 << 23
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3

Row = tuple[str, int]
"""Role initial and fault of a row."""


def _forward(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial of the edit, i, state) of the edits that lead on from a node."""
    yield INSERT, "I", i, NEXT[state]
    if i < len(rows):
        initial, fault = rows[i]
        yield DELETE, "D", i + 1, state
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            yield REROLE + more, "R", i + 1, NEXT[state]
            if (initial, state) in KEEPS:
                yield more, "K", i + 1, KEEPS[initial, state]


def _reverse(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """The edits that lead to a node, with the nodes that they come from."""
    for before in (s for s in STATES if NEXT[s] == state):
        yield INSERT, "I", i, before
    if i:
        initial, fault = rows[i - 1]
        yield DELETE, "D", i - 1, state
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            for before in (s for s in STATES if NEXT[s] == state):
                yield REROLE + more, "R", i - 1, before
            for before in (s for s in STATES if KEEPS.get((initial, s)) == state):
                yield more, "K", i - 1, before


def cheapest(rows: list[Row], start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state `start` before all rows to one of `ends` after them, ties by the
    ASCII-least audit; None where no edits lead there.

    Heaps are ordered by cost, then by rows dealt with: every edit raises one of them, so the audit of a node is final
    when it is taken from its heap. The search ends when the two least costs together exceed the best crossing.
    """
    n = len(rows)
    ahead, back = [(0, 0, "", start)], [(0, 0, "", s) for s in sorted(ends)]
    done_ahead: dict[tuple[int, int], tuple[int, str]] = {}
    done_back: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None

    def cross(first: tuple[int, str], cost: int, edit: str, last: tuple[int, str]) -> None:
        nonlocal best
        found = (first[0] + cost + last[0], first[1] + edit + last[1])
        best = found if best is None else min(best, found)

    while ahead and back and (best is None or ahead[0][0] + back[0][0] <= best[0]):
        if ahead[0][0] <= back[0][0]:
            cost, i, audit, state = heapq.heappop(ahead)
            if (i, state) in done_ahead:
                continue
            here = done_ahead[i, state] = (cost, audit)
            if (i, state) in done_back:
                cross(here, 0, "", done_back[i, state])
            for more, edit, j, to in _forward(rows, i, state):
                if (j, to) in done_back:
                    cross(here, more, edit, done_back[j, to])
                if (j, to) not in done_ahead:
                    heapq.heappush(ahead, (cost + more, j, audit + edit, to))
        else:
            cost, left, audit, state = heapq.heappop(back)
            i = n - left
            if (i, state) in done_back:
                continue
            here = done_back[i, state] = (cost, audit)
            if (i, state) in done_ahead:
                cross(done_ahead[i, state], 0, "", here)
            for more, edit, j, to in _reverse(rows, i, state):
                if (j, to) in done_ahead:
                    cross(done_ahead[j, to], more, edit, here)
                if (j, to) not in done_back:
                    heapq.heappush(back, (cost + more, n - j, edit + audit, to))
    if not ahead:  # all that can be reached is known
        for s in ends:
            if (n, s) in done_ahead:
                cross(done_ahead[n, s], 0, "", (0, ""))
    if not back and (0, start) in done_back:
        cross((0, ""), 0, "", done_back[0, start])
    return best


def onward(reached: dict[int, tuple[int, tuple[str, ...]]], ways: dict[tuple[int, int], tuple[int, str]]) -> dict[int, tuple[int, tuple[str, ...]]]:
    """The best way to each state after one more piece: `reached` has cost and the audits of the pieces before, by state."""
    out: dict[int, tuple[int, tuple[str, ...]]] = {}
    for (start, end), (cost, audit) in ways.items():
        if start in reached:
            found = (reached[start][0] + cost, (*reached[start][1], audit))
            # pieces up to here are the same, so audits compare as their concatenation does
            if end not in out or (found[0], "".join(found[1])) < (out[end][0], "".join(out[end][1])):
                out[end] = found
    return out


def ways(rows: list[Row]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) from each state before `rows` to each state after them, solved in pieces of SEGMENT rows."""
    out = {}
    pieces = [{(a, b): found for a in STATES for b in STATES if (found := cheapest(part, a, (b,)))} for part in _pieces(rows)]
    for start in STATES:
        reached = {start: (0, ("",))}
        for piece in pieces:
            reached = {s: (cost, ("".join(audits),)) for s, (cost, audits) in onward(reached, piece).items()}
        out |= {(start, end): (cost, audits[0]) for end, (cost, audits) in reached.items()}
    return out


def _pieces(rows: list[Row]) -> list[list[Row]]:
    return [rows[k : k + SEGMENT] for k in range(0, len(rows), SEGMENT)] or [[]]


def plan(rows: list[Row]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(rows) <= SEGMENT:
        return cheapest(rows)
    found = ways(rows)
    return min(found[0, end] for end in ENDS if (0, end) in found)


class Writer:
    """Applies an audit row by row and hashes the repaired `role:text` lines as they come."""

    def __init__(self):
        self.hash, self.state, self.empty = hashlib.sha256(), 0, True

    def line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False

    def made(self, text: str) -> None:
        self.state = NEXT[self.state]
        self.line(ROLE[self.state], text)

    def apply(self, audit: str, rows: Iterator[tuple[str, str]]) -> None:
        for edit in audit:
            if edit == "I":
                self.made("")
                continue
            role, text = next(rows)
            if edit == "R":
                self.made(text)
            elif edit == "K":
                self.state = KEEPS[role[:1], self.state]
                self.line(role, text)


# ------------------------------------------------------------------------------------------------ damage and faults


def damaged(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage, null roles and texts as one space; dropped rows stay as
    `gone`, so that a conversation that loses all its rows is still known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    rows = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select("*", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).select(
        "conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def _faults(text: Column) -> Column:
    """BLANK, CUT_OFF or 0 of a text by itself."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(0).cast("int")


ILLEGAL_NOT = ("su", "ua", "au")
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Rows of one turn come in this order; equal rows are interchangeable.
ORDER = ["conv_id", "turn", "role", "text_hash"]


def _summary(rows: list[tuple[int | None, str, str, int]]) -> tuple:
    """The results of one conversation from its rows (turn, role, text, own fault) in order."""
    seen, coded = set(), []
    for _, role, text, fault in rows:
        coded.append((role[:1], fault if fault == BLANK else DUPLICATE if (role, text) in seen else fault))
        seen.add((role, text))
    turns = {r[0] for r in rows} - {None}
    cost, audit = plan(coded)
    writer = Writer()
    writer.apply(audit, ((role, text) for _, role, text, _ in rows))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == kind for _, f in coded) for kind in (BLANK, DUPLICATE, CUT_OFF)),
        sum(a[0] + b[0] not in ILLEGAL_NOT for a, b in zip(coded, coded[1:], strict=False)), cost, audit, writer.hash.hexdigest())


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, one after the other, from rows sorted by ORDER."""

    names = ["conv_id", *(part.split()[0] for part in SUMMARY.split(", "))]
    numbers = [pa.int64()] * 6
    out: list[tuple] = []
    for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
        out.append((conv_id, *_summary([r[1:5] for r in group if not r[5]])))
        if len(out) == 4_096:
            yield _batch(out, names, [*numbers, pa.string(), pa.string()])
            out = []
    if out:
        yield _batch(out, names, [*numbers, pa.string(), pa.string()])


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch; the first column is an id, a number or a text, and numbers where all ids are null."""
    ids = pa.array([r[0] for r in rows])
    rest = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:], types, strict=True)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()) if pa.types.is_null(ids.type) else ids, *rest], names)


# ------------------------------------------------------------------------------------------------ long conversations


def _part_summary(conv_id, part: int, rows: list[tuple]) -> tuple:
    """One task's share of a long conversation, rows (turn, role initial, fault): all ways through it, and its counts."""
    coded = [(initial, fault) for _, initial, fault in rows]
    found = ways(coded)
    turns = [r[0] for r in rows if r[0] is not None]
    return (
        conv_id, part, len(rows), [list(k) for k in found], [c for c, _ in found.values()], [a for _, a in found.values()],
        *(sum(f == kind for _, f in coded) for kind in (BLANK, DUPLICATE, CUT_OFF)),
        sum(a[0] + b[0] not in ILLEGAL_NOT for a, b in zip(coded, coded[1:], strict=False)), coded[0][0], coded[-1][0],
        turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))


PARTS = (
    "part long, rows long, ends array<array<int>>, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, low long, high long, turns long")


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """The parts of one long conversation, in order, to its results and to the audit of each part."""
    parts = sorted(frame.itertuples(index=False), key=lambda r: r.part)
    reached: dict[int, tuple[int, tuple[str, ...]]] = {0: (0, ())}
    for p in parts:
        reached = onward(reached, {tuple(k): (c, a) for k, c, a in zip(p.ends, p.costs, p.audits, strict=True)})
    cost, audits = min((reached[s] for s in ENDS if s in reached), key=lambda r: (r[0], "".join(r[1])))
    with_turns = [p for p in parts if p.turns]
    gaps = 0
    if with_turns:
        shared = sum(int(a.high) == int(b.low) for a, b in zip(with_turns, with_turns[1:], strict=False))
        gaps = int(with_turns[-1].high) - int(with_turns[0].low) + 1 - (sum(int(p.turns) for p in with_turns) - shared)
    illegal = sum(p.illegal for p in parts) + sum(a.last + b.first not in ILLEGAL_NOT for a, b in zip(parts, parts[1:], strict=False))
    total = [sum(getattr(p, name) for p in parts) for name in ("blank", "duplicate", "truncated")]
    return pd.DataFrame({"conv_id": frame["conv_id"].iloc[:1], "gaps": gaps, "blank": total[0], "duplicate": total[1], "truncated": total[2],
                         "illegal": illegal, "cost": cost, "parts": [[p.part for p in parts]], "audits": [list(audits)]})


class _Hash:
    """The hash of each long conversation, from its parts' audits (each before its part's rows) and rows, as a stream."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
            writer = Writer()
            for _, part in groupby(group, key=lambda r: r[1]):
                audit = next(part)[2]
                writer.apply(audit, ((role, text) for _, _, _, role, text in part))
            yield _batch([(conv_id, writer.hash.hexdigest())], ["conv_id", "repaired_sha256"], [pa.string()])


def _long(rows: DataFrame) -> DataFrame:
    """The results of long conversations from `rows` (as `damaged`, with text_hash and fault).

    Rows are sorted over all tasks by conversation, turn, role and text; each task solves its share from every state to
    every state, the shares of a conversation (one a task) are folded, and the repaired lines are hashed as a stream. Only
    that hash, which has to see its lines one after the other, visits a conversation in one task, line by line.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    numbered = stored(rows.where("not gone").withColumn("k", F.monotonically_increasing_id()), "long-rows")
    place = F.struct(F.col("turn").isNotNull().alias("t"), "turn", "k")
    first = numbered.groupBy("conv_id", "role", "text_hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("conv_id", F.col("role").alias("r"), F.col("text_hash").alias("h"), "first")
    seen = numbered.alias("a").join(first.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("role") == F.col("r")) & (F.col("text_hash") == F.col("h")), "left")
    again = F.col("first").isNotNull() & (place != F.col("first"))
    marked = seen.select("a.conv_id", "turn", "role", "text", "text_hash", "k", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    keys = [*ORDER, "k"]
    ranged = stored(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id().cast("long")), "long-sorted")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id, part), group in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
            found = _part_summary(conv_id, part, [r[2:] for r in group])
            yield pa.RecordBatch.from_pylist([dict(zip(["conv_id", *(p.split()[0] for p in PARTS.split(", "))], found, strict=True))], schema=schema)

    out_type = T.StructType([rows.schema["conv_id"], *_fields(PARTS)])
    schema = to_arrow_schema(out_type)
    slim = ranged.select("conv_id", "part", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "role", "text_hash", "k")
    slim = slim.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text_hash", "k").select("conv_id", "part", "turn", "initial", "fault")
    parts = stored(slim.mapInArrow(share, out_type), "long-parts")
    folded = stored(parts.groupBy("conv_id").applyInPandas(_fold, f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, parts array<long>, audits array<string>"), "long-audits")
    heads = folded.select("conv_id", F.explode(F.arrays_zip("parts", "audits")).alias("p")).select(
        "conv_id", F.col("p.parts").alias("part"), F.col("p.audits").alias("audit"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("text_hash"), F.lit(None).cast("long").alias("k"))
    lines = ranged.select("conv_id", "part", F.lit(None).cast("string").alias("audit"), "role", "text", "turn", "text_hash", "k").unionByName(heads)
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("audit").isNull(), "turn", "role", "text_hash", "k")
    hashes = lines.select("conv_id", "part", "audit", "role", "text").mapInArrow(_Hash(), f"conv_id {id_type}, repaired_sha256 string")
    audits = folded.withColumn("audit", F.array_join("audits", ""))
    return audits.alias("a").join(hashes.alias("h"), F.col("a.conv_id").eqNullSafe(F.col("h.conv_id"))).select(
        "a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# ------------------------------------------------------------------------------------------------ the operator


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    `rows` has conv_id, turn, role, text and gone (rows that are no longer there). Rows are taken by turn, nulls first, rows
    of one turn by role and SHA-256 of the text. Null ids are one conversation; null roles and texts are one space;
    repeated rows are rows, all but the first being duplicates; a role's initial is its first code point (an empty role
    has none, so it is reroled or deleted); a conversation without rows has zeros, an empty audit and the hash of nothing;
    an empty table gives an empty result. A conversation of more than LONG_ROWS rows or LONG_CHARS characters is searched
    in pieces by many tasks, with the same result.
    """
    ready = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    ready = ready.select("*", F.sha2("text", 256).alias("text_hash"), _faults(F.col("text")).alias("fault"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long = stored(sizes.where((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).select(F.col("conv_id").alias("long_id")), "long-ids")
    out_type = T.StructType([rows.schema["conv_id"], *_fields(SUMMARY)])
    apart = not long.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    usual = ready.join(long, same, "left_anti") if apart else ready
    usual = usual.repartition("conv_id").sortWithinPartitions(*ORDER).select("conv_id", "turn", "role", "text", "fault", "gone")
    found = usual.mapInArrow(_by_conversation, out_type)
    if not apart:
        return found
    from_long = stored(_long(ready.join(long, same, "left_semi")), "long-results")
    # long conversations of which nothing is left
    none = long.join(from_long, F.col("long_id").eqNullSafe(F.col("conv_id")), "left_anti").select(
        F.col("long_id").alias("conv_id"), *(F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return found.unionByName(from_long).unionByName(none)


def op11_conversation_repair(chats: DataFrame) -> DataFrame:
    return repaired(damaged(pick(chats, conv_id="conv_id", turn="turn", role="role", text="text")))
