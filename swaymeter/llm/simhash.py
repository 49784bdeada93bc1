"""SimHash near-duplicates: deletion-variant signatures, equality joins, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter.llm.common import cut, free_names, in_arrow, pick, quoted, stored
from swaymeter.llm.components import components

SHINGLE = 3
SEED = 42
#: Buckets of more fingerprints than this are cut again by a finer signature instead of being compared pair by pair.
FULL_BUCKET = 64
CHUNK = 1 << 15


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64-bit fingerprint (signed) of a whole text. A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles with
    repeats; fewer words than a shingle form one; none (or null) gives 0."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    size = min(size, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, CHUNK):
        pieces = map(joined.__getitem__, map(slice, starts[k : k + CHUNK], stops[k : k + CHUNK]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), ">u8", min(CHUNK, n - k))
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array((simhash(t.as_py()) for t in batch.column(batch.num_columns - 1)), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of `docs`, whatever its id; fp is the signed form of the 64-bit fingerprint."""
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, T.StructType([slim.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _wildcards(value: Column, bits: range, tag: int) -> Column:
    """One (where, masked) signature per bit of `bits`: the value with that bit deleted, and what was deleted where."""
    return F.array(*(F.struct(F.lit(tag + b).alias("where"), value.bitwiseAND(F.lit(_signed(~(1 << b)))).alias("masked")) for b in bits))


def _signed(mask: int) -> int:
    return (mask + (1 << 63)) % (1 << 64) - (1 << 63)


def _half(value: Column, low: int, n: int) -> Column:
    return value.bitwiseAND(F.lit(_signed(((1 << n) - 1) << low)))


def _within(members: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) inside buckets of `members` that hold few fingerprints, and the members of full buckets.

    Counting a bucket is a combinable aggregate; only buckets of two or more are joined back, and only those of at most
    FULL_BUCKET are compared, so no row meets more than FULL_BUCKET others.
    """
    counts = cut(members.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few, full = counts.where(F.col("n") <= FULL_BUCKET), counts.where(F.col("n") > FULL_BUCKET)
    kept = cut(members.join(few.select(*key), key))
    left, right = kept.withColumnRenamed("fp", "a"), kept.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    on = [left[k] == right[k] for k in key]
    links = left.join(right, [*on, F.col("a") < F.col("b"), near]).select("a", "b")
    return links, members.join(full.select(*key), key)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose components equal those of "at most 2 of 64 bits differ", for distinct fingerprints `fp`.

    1. Two halves of 32 bits: one of them differs by at most one bit, so two fingerprints in reach share one of the 64
       signatures "half with one bit deleted". Buckets of few are compared in full.
    2. A full bucket is cut again by its other half: two quarters of 16 bits, one bit deleted: 32 signatures within
       the bucket.
    3. What is full even then is linked exactly without pairs: signatures of the whole value with two bits deleted put
       together only fingerprints in reach, so linking each to the least of its bucket loses nothing.
    """
    halves = F.concat(*(_wildcards(_half(F.col("fp"), low, 32), range(low, low + 32), 0) for low in (0, 32)))
    first = prints.select("fp", F.explode(halves).alias("s")).select("fp", F.col("s.where").alias("w1"), F.col("s.masked").alias("m1"))
    near, full = _within(first, ["w1", "m1"])
    full = cut(full)
    other = lambda low: F.concat(*(_wildcards(_half(F.col("fp"), q, 16), range(q, q + 16), 0) for q in (low, low + 16)))
    quarters = F.when(F.col("w1") < 32, other(32)).otherwise(other(0))
    second = full.select("fp", "w1", "m1", F.explode(quarters).alias("s")).select("fp", "w1", "m1", F.col("s.where").alias("w2"), F.col("s.masked").alias("m2"))
    nearer, crowded = _within(second, ["w1", "m1", "w2", "m2"])
    crowd = cut(crowded.select("fp").distinct())
    one = crowd.select("fp", F.explode(_wildcards(F.col("fp"), range(64), 0)).alias("s"))
    two = one.select("fp", F.col("s.where").alias("w1"), F.explode(F.filter(_wildcards(F.col("s.masked"), range(64), 0), lambda x: x["where"] > F.col("s.where"))).alias("z"))
    star = two.select("fp", F.struct("w1", "z.where", "z.masked").alias("k"))
    least = cut(star.groupBy("k").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "a"))
    stars = star.join(least, "k").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return near.unionByName(nearer).unionByName(stars).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root, first_id) for the distinct fingerprints of (doc_id, fp): the group and its smallest doc_id.

    Null ids count as larger than any; a group of null ids alone has none. Copies meet in their fingerprint, by a
    combinable minimum, before anything is compared.
    """
    by_print = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(by_print.select("fp"))).withColumnRenamed("node", "fp")
    rooted = cut(by_print.join(found, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("group_id")))
    return cut(rooted.join(least, "root").select("fp", "root", F.col("group_id").alias("first_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id), one row per row of `docs`.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows fall in one group; an empty
    table gives an empty result. Only ids and fingerprints are shuffled, never texts.
    """
    return _grouped(cut(fingerprints(docs, id_col, text_col)))


def _grouped(prints: DataFrame) -> DataFrame:
    return prints.join(groups(prints), "fp").select("doc_id", "fp", "root", F.col("first_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id, columns unchanged.

    Rows that share this id and fingerprint count as repeated rows, of which one stays. Each text is fingerprinted once
    and stored with its fingerprint; the rows that stay are fetched from there, keyed by id and fingerprint, so that a large
    group of copies is spread over all tasks.
    """
    fp, key = free_names(docs, "fp", "id_key")
    at = docs.columns.index(id_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    marked = stored(in_arrow(plain, _Append(docs.columns.index(text_col)), fp=T.LongType()), "simhash-rows")
    found = _grouped(cut(marked.select(F.col(f"c{at}").alias("doc_id"), "fp")))
    as_key = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n"))
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("fp"), F.min("component_id").alias("id"))
    best = cut(best.select(F.col("fp").alias(fp), as_key(F.col("id")).alias(key)))
    kept = marked.toDF(*docs.columns, fp).withColumn(key, as_key(quoted(id_col))).join(best, [fp, key], "left_semi").dropDuplicates([fp, key])
    return kept.select(*(quoted(c) for c in docs.columns))


class _Append:
    """Adds the fingerprint of column number `at` to each batch."""

    def __init__(self, at: int):
        self.at = at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array((simhash(t.as_py()) for t in batch.column(self.at)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, f"c{batch.num_columns}"])


def op4_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(pick(docs, doc_id="doc_id", text="text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
