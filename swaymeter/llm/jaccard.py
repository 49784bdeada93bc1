"""Jaccard join of shingle sets by a token-group matrix, for the components of all links.

1. Every text becomes the set of its distinct 5-word shingles, as 64-bit hashes; equal sets are one set from here on.
2. Similar sets are partitioned into groups. Sets that share one of a few least hashes are a bucket. They are compared with
   the most typical set of their bucket, the one whose buckets hold the most sets, and form a family with the most typical one
   that they are linked with. Families whose first sets have the same fullest bucket are a group.
3. The token-group matrix stores the union of each group's tokens. Two linked sets share a token among the rarest of either
   (for the shorter the first n - ceil(8n/9) + 1, for the longer the first n - ceil(4n/5) + 1 in one order of all tokens), so
   only these are stored and asked. A set whose tokens meet another group in the matrix, at a length that can link, is a
   candidate for it.
4. Signatures of a bit a token bound the overlap of candidates and members before any tokens are fetched: only sets and members
   that can be linked go on. Of these, a candidate's overlap with the group's whole union bounds its overlap with each member;
   only where it reaches 4/5 of the set is the group opened and the members compared.
5. Links between groups join them to components.

A link inside a family changes no component, so none has to be written, and sets meet groups, not each other: many similar
sets cost a row of the matrix per token and group, and a row per set and group, instead of a square of pairs. Copies around one
text are one group, most of them in the family of the set nearest to it, so that their tokens meet few groups at any number of
copies. A group may be of any size; where it is opened, its members and those that ask it are shared out over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from swaymeter.llm.common import cut, dropped, quoted, shuffles_freed, stored
from swaymeter.llm.components import components

SHINGLE = 5
#: Buckets of tokens that are counted to order tokens from rare to frequent: half a megabyte for each task at any size of the
#: corpus, and a megabyte of counts from each.
WIDTH = 1 << 18
BLOCK = 1 << 12
#: Rows that a task hands on at once.
ROWS = 1 << 19
#: Least hashes by which sets meet for the groups.
KEYS = 4
ODD = (np.random.default_rng(13).integers(1, 1 << 63, KEYS, np.uint64) << np.uint64(1)) | np.uint64(1)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Steps by which sets move on to the family of their family's first set.
HOPS = 3
#: Members of a group and their tokens that one task holds, and sets that are asked against them there.
MEMBERS = 1_024
HELD_TOKENS, HELD_ASKED = 1 << 20, 1_024
#: Times as many where a group is opened by signatures only, which have a bit for a token.
SIGNED = 8
#: Ids that travel with every task to pick texts; beyond, texts and ids meet in an ordinary join.
MAX_IDS = 1_000_000
#: Bits of the longest signature of a set.
MOST_BITS = 1 << 15
#: Sets that a task remembers so as to hand on equal ones once; it changes the work, never the result.
SEEN = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit, in place."""
    for odd in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(33)
        h *= odd
    h ^= h >> np.uint64(33)
    return h


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as ascending 64-bit hashes; A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`. Fewer
    words than SHINGLE are one shingle, none (or null) give the empty set."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(found))
    words = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64)
    out = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        out *= MULTIPLY
        out += words[k : k + len(out)]
    out = _mixed(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set: among n different sets two share it with a chance of n * n / 2**65."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), 13) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int | None]]]:
    for batch in batches:
        tokens = [shingles(t.as_py()) for t in batch.column(1)]
        yield batch, tokens, [set_id(t) if len(t) else None for t in tokens]


def signature(tokens: np.ndarray) -> bytes:
    """For each of a power of two of buckets, whether an odd number of tokens falls in it: about a bit for each token.

    Where the signatures of two sets differ in d bits, the sets differ in at least d tokens.
    """
    width = min(MOST_BITS, max(64, 1 << (len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 == 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two signatures differ, the longer one folded to the length of the other."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    if len(x) < len(y):
        x, y = y, x
    return int((np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, sid, n and signature of both sets) of pairs that can be linked: linked sets differ in at most a ninth of their
    tokens."""
    for batch in batches:
        n, other_n, bits, other_bits = (batch.column(k).to_pylist() for k in range(2, 6))
        keep = [9 * differing(p, q) <= a + b for a, b, p, q in zip(n, other_n, bits, other_bits, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["g", "sid"]).filter(pa.array(keep, pa.bool_()))


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, salt, asked, sid, family, n, bits), sorted, a group's members first: to rows (g, asked, sid) of sets that ask and
    members of other families that can be linked by their signatures; a task writes no more rows than it reads."""
    at, group = None, None
    for batch in batches:
        g, salt, asked, sid, family, n = (batch.column(k).to_pylist() for k in range(6))
        out: list[tuple] = []
        for i in range(batch.num_rows):
            if (g[i], salt[i]) != at:
                out += group.met() if group else []
                at, group = (g[i], salt[i]), _Signed(g[i])
            bits = batch.column(6)[i].as_py()
            if not asked[i]:
                group.add(sid[i], family[i], n[i], bits)
            elif group.asks(family[i], n[i], bits):
                out.append((g[i], True, sid[i]))
        yield _kept(out)
    yield _kept(group.met() if group else [])


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    g, asked, sid = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(asked, pa.bool_()), pa.array(sid, pa.int64())], ["g", "asked", "sid"])


class _Signed:
    """A group's members by the width of their signatures, and which of them a set that asks can be linked with."""

    def __init__(self, g: int):
        self.g = g
        self.waiting: dict[int, list[tuple]] = {}
        self.members: dict[int, tuple[np.ndarray, ...]] = {}
        self.hit: dict[int, np.ndarray] = {}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def add(self, name: int, family: int, n: int, bits: bytes) -> None:
        self.waiting.setdefault(len(bits), []).append((name, family, n, bits))

    def _close(self) -> None:
        for width, rows in self.waiting.items():
            self.members[width] = tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))
            self.hit[width] = np.zeros(len(rows), bool)
            self.folded[width, width] = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
        self.waiting.clear()

    def asks(self, family: int, n: int, bits: bytes) -> bool:
        """Whether a member of another family can be linked with the set: linked sets differ in at most a ninth of their tokens, and
        so in the width of their signatures by a factor of 2 at most."""
        if self.waiting:
            self._close()
        found, own = False, np.frombuffer(bits, np.uint64)
        for width in (len(bits) // 2, len(bits), len(bits) * 2):
            if width not in self.members:
                continue
            least = min(width, len(bits))
            if (width, least) not in self.folded:
                whole = self.folded[width, width]
                self.folded[width, least] = np.bitwise_xor.reduce(whole.reshape(len(whole), -1, least // 8), axis=1)
            _, families, sizes = self.members[width]
            near = np.flatnonzero((families != family) & (5 * np.minimum(sizes, n) >= 4 * np.maximum(sizes, n)))
            mine = np.bitwise_xor.reduce(own.reshape(-1, least // 8), axis=0)
            differ = np.bitwise_count(self.folded[width, least][near] ^ mine).sum(axis=1, dtype=np.int64)
            near = near[9 * differ <= sizes[near] + n]
            self.hit[width][near] = True
            found |= len(near) > 0
        return found

    def met(self) -> list[tuple]:
        """The members that a set asked for."""
        return [(self.g, False, name) for width, (names, _, _) in self.members.items() for name in names[self.hit[width]].tolist()]


class _New:
    """Tells which sets a task has not met yet, as far as it remembers."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, name: int | None) -> bool:
        if name is None or name in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(name)
        return True


class _Profile:
    """(doc_id, text) to one row per document (doc_id, n, sid, keys, bits) and, at the end of a task, its counts of token
    buckets. Keys are the least hashes of a set, bits its signature."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def _batch(self, rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * rows), f.type) for f in self.schema],
            schema=self.schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n_waiting, new = np.zeros(WIDTH, np.int64), [], 0, _New()
        for batch, tokens, names in _sets(batches):
            keys = [np.array([(t * odd).min() for odd in ODD]).view(np.int64).tolist() if len(t) else None for t in tokens]
            bits = [signature(t) if len(t) else None for t in tokens]
            yield self._batch(len(tokens), doc_id=batch.column(0), n=[len(t) for t in tokens], sid=names, keys=keys, bits=bits)
            for t, name in zip(tokens, names, strict=True):
                if new(name):
                    waiting.append((t & np.uint64(WIDTH - 1)).astype(np.int64))
                    n_waiting += len(t)
                    if n_waiting > WIDTH:
                        total += np.bincount(np.concatenate(waiting), minlength=WIDTH)
                        waiting, n_waiting = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=WIDTH)
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield self._batch(len(used), block=used.tolist(), counts=[blocks[b].astype(np.uint32).tobytes() for b in used])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each block added up, as a stream."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["block", "counts"])


def _order(profile: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket its frequency in 64ths of the mean, and from which value on a bucket is hot."""
    slim = profile.where("block is not null").select("block", "counts")
    total = np.zeros((WIDTH // BLOCK, BLOCK), np.int64)
    for r in slim.repartition("block").mapInArrow(_added, "block int, counts binary").collect():
        total[r["block"]] = np.frombuffer(r["counts"], np.int64)
    mean = max(1.0, total.mean())
    return np.minimum(total.ravel() * 64 / mean, 65_535).astype(np.uint16), int(min(65_535, 256 + 64 * 64 / mean))


class _Rarest:
    """(doc_id, text) to the rarest tokens of each set: (token, salt, hot, sid, n, stored), `stored` for those that the
    matrix keeps. Tokens of hot buckets are salted by their set."""

    def __init__(self, order, hot: int):
        self.order, self.hot = order, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, new = self.order.value, _New()
        for _, tokens, names in _sets(batches):
            fresh = [(t, name) for t, name in zip(tokens, names, strict=True) if new(name)]
            some: list[tuple] = []
            size = 0
            for t, name in fresh:
                level = order[(t & np.uint64(WIDTH - 1)).astype(np.int64)]
                n = len(t)
                first = np.argsort(level, kind="stable")[: n - (4 * n + 4) // 5 + 1]
                some.append((t[first], level[first] >= self.hot, name, n, n - (8 * n + 8) // 9 + 1))
                size += len(first)
                if size > ROWS:
                    yield self._rows(some)
                    some, size = [], 0
            if some:
                yield self._rows(some)

    @staticmethod
    def _rows(some: list[tuple]) -> pa.RecordBatch:
        lengths = [len(s[0]) for s in some]
        names = np.repeat(np.array([s[2] for s in some], np.int64), lengths)
        hot = np.concatenate([s[1] for s in some])
        keep = np.concatenate([np.arange(k) < s[4] for k, s in zip(lengths, some, strict=True)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([s[0] for s in some]).view(np.int64)), pa.array(np.where(hot, names % 64, 0).astype(np.int32)), pa.array(hot),
             pa.array(names), pa.array(np.repeat(np.array([s[3] for s in some], np.int32), lengths)), pa.array(keep)],
            ["token", "salt", "hot", "sid", "n", "stored"])


class _Tokens:
    """(doc_id, text) to (doc_id, sid, tokens), each set once as far as a task remembers."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for batch, tokens, names in _sets(batches):
            at = [i for i, name in enumerate(names) if new(name)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.int64()), pa.array([tokens[i].tobytes() for i in at], pa.binary())], ["sid", "tokens"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, salt, asked, sid, family, tokens), sorted, a group's members first: to links (a, b) of a set that asks and a
    member that join families; a task writes fewer links than it reads rows."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            g, salt, asked, sid, family = (batch.column(k).to_pylist() for k in range(5))
            for i in range(batch.num_rows):
                yield (g[i], salt[i]), asked[i], sid[i], family[i], np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)

    a: list[int] = []
    b: list[int] = []
    at, group = None, None
    for key, asked, sid, family, tokens in rows():
        if key != at:
            at, group = key, _Group()
        if asked:
            others = group.linked(family, tokens)
            a += [sid] * len(others)
            b += others
        else:
            group.add(sid, family, tokens)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Group:
    """A group's members, their token union, and for each token of it the members that have it."""

    def __init__(self):
        self.names: list[int] = []
        self.families: list[int] = []
        self.sets: list[np.ndarray] = []
        self.union: np.ndarray | None = None
        self.first: dict[int, int] = {}

    def add(self, name: int, family: int, tokens: np.ndarray) -> None:
        self.names.append(name)
        self.families.append(family)
        self.sets.append(tokens.copy())

    def _close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.union, self.start = np.unique(tokens[order], return_index=True)
        self.stop = np.append(self.start[1:], len(tokens))

    def linked(self, own: int, tokens: np.ndarray) -> list[int]:
        """Members that are linked with the set, as far as they join families that were not joined here before: the union
        bounds the overlap, then members are counted."""
        if self.union is None:
            self._close()
        if not len(self.union):
            return []
        at = np.searchsorted(self.union, tokens)
        at = at[at < len(self.union)] if len(at) and at[-1] == len(self.union) else at
        at = at[self.union[at] == tokens[: len(at)]]
        if 5 * len(at) < 4 * len(tokens):
            return []
        width = self.stop[at] - self.start[at]
        place = np.repeat(self.start[at] - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
        both = np.bincount(self.owner[place], minlength=len(self.names))
        good = np.flatnonzero(5 * both >= 4 * (self.sizes + len(tokens) - both))
        out = []
        for k in good.tolist():
            a, b = self._first(own), self._first(self.families[k])
            if a != b:
                self.first[b] = a
                out.append(self.names[k])
        return out

    def _first(self, family: int) -> int:
        """What stands for all families that are known here to be linked with this one."""
        while (above := self.first.get(family, family)) != family:
            self.first[family] = family = self.first.get(above, above)
        return family


def _shared_out(members: DataFrame, asked: DataFrame, times: int) -> DataFrame:
    """(g, salt, asked, sid, family): the members of each group and the sets that ask it, dealt over as many salts as hold them."""
    shares = members.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / (times * HELD_TOKENS)), F.ceil(F.count(F.lit(1)) / (times * MEMBERS))).cast("long").alias("parts"))
    load = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (times * HELD_ASKED)).cast("long").alias("turns"))
    plan = cut(shares.join(load, "g"))
    salt = lambda part, turn: (part * F.col("turns") + turn).alias("salt")
    spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inside = members.join(plan, "g").select("g", "sid", "family", "turns", spread(F.col("sid"), F.col("parts")).alias("part"), every("turns").alias("turn"))
    inside = inside.select("g", salt(F.col("part"), F.col("turn")), F.lit(False).alias("asked"), "sid", "family")
    outside = asked.join(plan, "g").select("g", "sid", "family", "turns", spread(F.col("sid"), F.col("turns")).alias("turn"), every("parts").alias("part"))
    outside = outside.select("g", salt(F.col("part"), F.col("turn")), F.lit(True).alias("asked"), "sid", "family")
    return inside.unionByName(outside)


class _Sets:
    """The texts and the sets made of them: distinct sets as (sid, n, first_id, key0, key1 ...), their tokens on demand."""

    def __init__(self, docs: DataFrame, profile: DataFrame):
        self.docs = docs
        self.by_doc = profile.where("block is null").select("doc_id", "n", "sid", "keys", "bits")
        self.distinct = stored(self.by_doc.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), *(F.first(F.col("keys")[k]).alias(f"key{k}") for k in range(KEYS))), "jaccard-sets")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """(g, sid) of the pairs (g, only, sid) whose sets `only` and `sid` can be linked by their signatures."""
        wanted = pairs.select(F.explode(F.array("only", "sid")).alias("sid")).distinct()
        bits = cut(self.by_doc.select("sid", "n", "bits").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))
        first = bits.select(F.col("sid").alias("only"), F.col("n").alias("g_n"), F.col("bits").alias("g_bits"))
        return pairs.join(bits, "sid").join(first, "only").select("g", "sid", "n", "g_n", "bits", "g_bits").mapInArrow(_possible, "g long, sid long")

    def sifted(self, members: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of `members` and `asked`, as `links` takes them, those that can be linked by their signatures."""
        rows = cut(_shared_out(members, asked, SIGNED))
        wanted = rows.select("sid").distinct()
        bits = self.by_doc.select("sid", "n", "bits").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
        full = rows.join(cut(bits), "sid").select("g", "salt", "asked", "sid", "family", "n", "bits")
        kept = full.repartition("g", "salt").sortWithinPartitions("g", "salt", "asked").mapInArrow(_sifted, "g long, asked boolean, sid long")
        kept = cut(kept.distinct())
        return tuple(cut(df.join(kept.where(side).select("g", "sid"), ["g", "sid"], "left_semi")) for df, side in ((members, "not asked"), (asked, "asked")))

    def tokens(self, wanted: DataFrame) -> DataFrame:
        """(sid, tokens) of the sets `wanted` (sid), made again from the text of the first document of each."""
        ids = stored(self.distinct.join(wanted, "sid").select("sid", F.col("first_id").alias("id")), "jaccard-wanted")
        few = ids.count() <= MAX_IDS
        pick = ids.select("id").distinct()
        texts = self.docs.join(F.broadcast(pick) if few else pick, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        made = texts.mapInArrow(_Tokens(), "sid long, tokens binary")
        mine = ids.select("sid")
        return stored(made.join(F.broadcast(mine) if few else mine, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens")), "jaccard-tokens")

    def links(self, members: DataFrame, asked: DataFrame) -> DataFrame:
        """Links (a, b) of sets `asked` (g, sid, family) with `members` (g, sid, family, n) of a group, as many as it takes to
        join their families as all links do. Very many members or tokens are shared out, and so are the sets that ask a group."""
        rows = cut(_shared_out(members, asked, 1))
        tokens = self.tokens(rows.select("sid").distinct())
        full = rows.join(tokens, "sid").select("g", "salt", "asked", "sid", "family", "tokens")
        links = cut(full.repartition("g", "salt").sortWithinPartitions("g", "salt", "asked").mapInArrow(_opened, "a long, b long"))
        dropped(tokens)
        return links


def _similar(least: Column, most: Column) -> Column:
    """Sizes that allow a link."""
    return 5 * least >= 4 * most


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`.

    Null and empty texts have the empty set and are linked with nothing, so their component is their own id; repeated
    rows have equal sets; null ids count as larger than any, so a component of null ids alone has none; an empty table
    gives an empty result. Every link with 100 * intersection >= 80 * union counts, through however many others.
    """
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    out = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("n int, sid long, keys array<long>, bits binary, block int, counts binary").fields])
    with shuffles_freed(docs.sparkSession):
        profile = stored(slim.mapInArrow(_Profile(to_arrow_schema(out)), out), "jaccard-profile")
        sets = _Sets(slim, profile)
        ids = _components(slim, profile, sets)
    plain = sets.by_doc.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sid")
    linked = plain.where("sid is not null").join(ids, "sid").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return linked.unionByName(plain.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _components(slim: DataFrame, profile: DataFrame, sets: _Sets) -> DataFrame:
    """(sid, component) of every set: the least id of a document in its component."""
    # families
    rows = sets.distinct.select("sid", "n", F.posexplode(F.array(*(f"key{k}" for k in range(KEYS)))).alias("k", "key"))
    buckets = rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = stored(rows.join(buckets, ["k", "key"]), "jaccard-buckets")
    typical = cut(crowded.groupBy("sid").agg(F.sum("size").alias("score"), F.max(F.struct("size", "k", "key")).alias("fullest")))
    ranked = crowded.join(typical.select("sid", "score"), "sid").select("k", "key", "sid", "n", "score")
    centres = ranked.groupBy("k", "key").agg(F.max(F.struct("score", "sid", "n")).alias("centre"))
    near = ranked.join(centres, ["k", "key"]).where((F.col("sid") != F.col("centre.sid")) & _similar(F.least("n", "centre.n"), F.greatest("n", "centre.n")))
    near = sets.possible(near.select(F.col("centre.sid").alias("g"), F.col("centre.sid").alias("only"), "sid").distinct())
    near = cut(near.select("g", "sid", F.col("sid").alias("family")))
    first_sets = sets.distinct.select(F.col("sid").alias("g"), "sid", F.col("sid").alias("family"), "n")
    stars = sets.links(first_sets.join(near.select("g").distinct(), "g", "left_semi"), near)
    # a link leads from a set to a more typical one, so that no steps go in circles
    above = stars.join(typical.select(F.col("sid").alias("b"), "score"), "b").groupBy(F.col("a").alias("sid")).agg(F.max(F.struct("score", "b")).alias("most"))
    families = cut(above.select("sid", F.col("most.b").alias("family")))
    for _ in range(HOPS):
        hop = families.select(F.col("sid").alias("family"), F.col("family").alias("next"))
        families = cut(families.join(hop, "family", "left").select("sid", F.coalesce("next", "family").alias("family")))

    # groups of families
    placed = sets.distinct.join(families, "sid", "left").select("sid", "first_id", "n", F.coalesce("family", "sid").alias("family"))
    crowds = typical.select(F.col("sid").alias("family"), F.xxhash64("fullest.k", "fullest.key").alias("crowd"))
    placed = stored(placed.join(crowds, "family", "left").select("sid", "first_id", "n", "family", F.coalesce("crowd", "family").alias("g")), "jaccard-groups")

    # matrix
    order, hot = _order(profile)
    sent = slim.sparkSession.sparkContext.broadcast(order)
    rarest = slim.mapInArrow(_Rarest(sent, hot), "token long, salt int, hot boolean, sid long, n int, stored boolean")
    of_token = Window.partitionBy("token", "salt").orderBy("sid")
    other = (F.lag("sid").over(of_token) != F.col("sid")) | (F.lead("sid").over(of_token) != F.col("sid"))
    shared = rarest.withColumn("shared", F.coalesce(other, F.lit(False))).where("hot or shared").select("token", "sid", "n", "stored")
    shared = stored(shared.join(placed.select("sid", "family", "g"), "sid"), "jaccard-shared")
    matrix = shared.where("stored").groupBy("token", "g").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("family").alias("one"), F.max("family").alias("last"))
    asks = shared.select("token", "sid", "n", "family").distinct()
    fits = ((F.col("one") != F.col("family")) | (F.col("last") != F.col("family"))) & (F.col("low") <= F.col("n")) & _similar(F.col("high"), F.col("n"))
    asked = asks.join(matrix, "token").where(fits).select("g", "sid", "family").distinct()
    alone = placed.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("only")).where("size = 1").select("g", "only")
    asked = cut(asked.join(alone, "g", "left"))
    single = sets.possible(asked.where("only is not null").select("g", "only", "sid")).join(placed.select("sid", "family"), "sid").select("g", "sid", "family")
    candidates = cut(single.unionByName(asked.where("only is null").select("g", "sid", "family")))

    # members of the groups asked, and links between families
    members = cut(placed.join(candidates.select("g").distinct(), "g", "left_semi").select("g", "sid", "family", "n"))
    found = sets.links(*sets.sifted(members, candidates)).unionByName(stars)
    by = lambda c: placed.select(F.col("sid").alias(c), F.col("family").alias(f"f_{c}"))
    joined = components(found.join(by("a"), "a").join(by("b"), "b").select(F.col("f_a").alias("a"), F.col("f_b").alias("b")).where("a != b").distinct())

    # components
    rooted = cut(placed.join(joined.withColumnRenamed("node", "family"), "family", "left").select("sid", "first_id", F.coalesce("root", "family").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return cut(rooted.join(firsts, "root").select("sid", "component"))


def op13_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
