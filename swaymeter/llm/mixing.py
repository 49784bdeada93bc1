"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swaymeter.llm.common import cut, free_names, pick, quoted, words
from swaymeter.operators.joins import small

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = 11
BITS = 52


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    return F.size(words(quoted(text_col))).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Rows of `sources` with their rank by code point, null last: a range sort and one offset per partition, so that
    no task holds all sources."""
    keyed = sources.select("*", F.col("source").isNull().cast("int").alias("last"))
    parts = cut(keyed.repartitionByRange(F.col("last"), F.col("source")).sortWithinPartitions("last", "source"))
    parts = parts.select("*", F.spark_partition_id().alias("part"))
    within = parts.select("*", F.row_number().over(Window.partitionBy("part").orderBy("last", "source")).alias("at"))
    ends = within.groupBy("part").agg(F.max("at").alias("n"))  # one row per partition
    before = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return within.join(before, "part").select("source", "source_size", (F.col("at") + F.col("before") - 1).alias("rank"))


def rates(sources: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share the total by weight; a target above `max_rate` times its source's size stops there and the excess is
    shared anew among the rest, until none is above. Each round is one aggregate of one row; the set of full sources
    only grows, and all numbers are whole until the last division. No size at all gives targets of 0.
    """
    turn = F.col("rank") % len(weights)
    weight = F.lit(int(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(int(w))).otherwise(weight)
    ranked = cut(_ranked(sources).select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_rate).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, share = total, ranked.agg(F.sum("weight")).first()[0] or 1
    while True:
        full = F.col("most") * share < F.col("weight") * left
        row = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0)).alias("taken"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        now_left, now_share = total - (row["taken"] or 0), row["open"] or 0
        if (now_left, now_share) == (left, share) or not now_share:
            break
        left, share = now_left, now_share
    target = F.when(full, F.col("most").cast("double")).otherwise((F.col("weight") * left).cast("double") / F.lit(float(share)))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A uniform whole number below 2**52 from the id and the seed; null ids draw as the text `null`."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often each document is emitted.

    A document comes floor(rate) times, and once more with probability rate - floor(rate), drawn from a hash of its id
    and the seed, so reruns agree and repeated rows get equal copies. Null texts have size 0; null sources form one
    source, last in order; an empty table gives an empty plan; sources of size 0 have rate 0. The sum per source is
    combined before the shuffle, and the rates are stored before the join, so a source with any share of the rows is
    split by the adaptive join.
    """
    sized = cut(docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), sizes(docs, text_col).alias("size")))
    by_source = cut(rates(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    right = by_source.select(key.alias("key"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    joined = sized.select("doc_id", "source", "size", key.alias("key")).join(small(right), "key")
    whole = F.floor(rate)
    more = (draw(F.col("doc_id"), seed).cast("double") < (rate - whole) * float(2**BITS)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", (whole + more).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row of `docs` as many times as planned, plus the last column `copy` (from 1).

    The rates of the sources join the rows themselves: broadcast where the sources have been counted and are few, so that
    no text moves; a larger table of sources is joined by a shuffle that splits hot sources.

    A null source is a source of its own, the last one; a null text has size 0; null ids share one draw (as the text `null`);
    repeated rows of an id have its draw; a column `copy` of `docs` stays beside the new one, which takes a free name; an
    empty table gives an empty one.
    """
    slim = cut(docs.select(quoted(source_col).alias("source"), sizes(docs, text_col).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    by_source = cut(rates(slim, weights, max_rate))
    key_name, size_name, target_name, copy_name = free_names(docs, "mix_key", "mix_size", "mix_target", "copy")
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    right = by_source.select(key(F.col("source")).alias(key_name), F.col("source_size").alias(size_name), F.col("target").alias(target_name))
    cols = [quoted(c) for c in docs.columns]
    rate = F.when(F.col(size_name) > 0, F.col(target_name) / F.col(size_name).cast("double")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(quoted(id_col), seed).cast("double") < (rate - F.floor(rate)) * float(2**BITS)).cast("long")).cast("int")
    joined = docs.select(*cols, key(quoted(source_col)).alias(key_name)).join(small(right), key_name)
    each = joined.select(*cols, F.when(copies > 0, F.sequence(F.lit(1), copies)).alias(copy_name))
    return each.select(*cols, F.explode(copy_name).alias(copy_name))


def op10_mixing(docs: DataFrame) -> DataFrame:
    planned = plan_mix(pick(docs, doc_id="doc_id", source="source", text="text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
