"""Updates of the narratives table and its dimensions, as DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import any_of, bind, missing, shortest_terms
from swaymeter.functions.labels import canonical_intent, contextual_intent
from swaymeter.functions.text import date_in_text
from swaymeter.operators.filters import has_label, lacks_author, needs_intent
from swaymeter.operators.joins import spread_key, surrogate_id


def upsert(dimension: DataFrame, updates: DataFrame, fields: Sequence[str], order: str, key: str = "name") -> DataFrame:
    """Insert or replace by key; of several updates with one key the last in `order` wins."""
    last = (updates.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max_by(F.struct(*fields), order).alias("_u")))
    joined = dimension.withColumn("_old", F.lit(True)).join(last, key, "full_outer")
    values = {f: F.when(F.col("_u").isNotNull(), F.col(f"_u.{f}")).otherwise(F.col(f)) for f in fields}
    return (joined.withColumns(values).withColumn("id", F.coalesce("id", surrogate_id(F.upper(key))))
            .select(*dimension.columns))


def keyed_update(df: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = "id",
                 order: str | None = None) -> DataFrame:
    """Overwrite columns of the rows whose key has an update; NULL updates count.

    Of several updates with one key the last in `order` wins, without an order the largest by value; ties in the
    order go by value, too. So every row of `df` comes out once.
    """
    rank = F.struct(*([order] if order else []), F.struct(*columns).alias("_u"))
    u = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank)["_u"].alias("_u"))
    new = {c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in columns}
    return df.join(u, key, "left").withColumns(new).select(*df.columns)


def reset_label(df: DataFrame, label: str = "Other", column: str = "strategic_intent") -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(label)))


def repaired_intent(intent: str = "strategic_intent", text: str = "article_text") -> Column:
    """Off-topic texts become general news, then the repair rules run in order.

    The rules are folded over as data, so a later rule sees what an earlier one made.
    """
    def repaired(t: Column) -> Column:
        def holds(words) -> Column:
            return F.coalesce(any_of(F.contains(t, F.lit(w)) for w in shortest_terms(words)), F.lit(False))

        start = F.when(holds(V.OFF_TOPIC_WORDS), F.lit(V.OFF_TOPIC_LABEL)).otherwise(F.col(intent))
        rules = F.array(*[
            F.struct(F.lit(wrong.upper()).alias("wrong"), F.lit(right).alias("right"),
                     (holds([wrong]) if wrong in V.LABEL_REPAIRS_IN_TEXT else F.lit(False)).alias("in_text"))
            for wrong, right in V.LABEL_REPAIRS])
        return F.aggregate(rules, start, lambda label, r: F.when(
            F.coalesce(F.upper(label) == r["wrong"], F.lit(False)) | r["in_text"], r["right"]).otherwise(label))

    return bind(F.upper(F.col(text)), repaired)


def repair_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("strategic_intent", repaired_intent())


def mark_anchors(df: DataFrame, cutoff: int) -> DataFrame:
    return df.withColumn("is_anchor", F.col("id") <= cutoff)


def stamp(df: DataFrame, as_of: str, condition: Column | None = None) -> DataFrame:
    """Set the processing time, on all rows or where the condition holds."""
    now = F.to_timestamp(F.lit(as_of))
    value = now if condition is None else F.when(condition, now).otherwise(F.col("ml_processed_at"))
    return df.withColumn("ml_processed_at", value)


def change_set(before: DataFrame, after: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """What a run would change: (key, column, old, new), nothing written."""
    b = before.select(key, *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    a = after.select(key, *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("old"), F.col(f"_a_{c}").alias("new"))
                      for c in columns])
    changed = F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return b.join(a, key).select(key, F.explode(changed).alias("_x")).select(key, "_x.*")


def fill_missing_intents(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Label articles without an intent from predictions (id, intent, conf, tone)."""
    wanted = df.filter(needs_intent()).select("id")
    updates = predictions.join(wanted, "id", "left_semi").select(
        "id", canonical_intent("intent").alias("strategic_intent"),
        F.coalesce("conf", F.lit(0.0)).alias("confidence"), F.coalesce("tone", F.lit("Factual")).alias("tone"))
    return keyed_update(df, updates, ["strategic_intent", "confidence", "tone"])


def relabel_for_index(df: DataFrame, predictions: DataFrame, cutoff: int) -> DataFrame:
    """Label unlabelled articles of known actor and country with index intents and set anchors."""
    wanted = df.filter(F.col("strategic_intent").isNull() & ~missing("article_text")
                       & has_label("inferred_actor") & has_label("target_country")).select("id")
    updates = predictions.join(wanted, "id", "left_semi").select(
        "id", F.coalesce(contextual_intent("intent"), F.lit("Other")).alias("strategic_intent"),
        F.coalesce("conf", F.lit(0.5)).alias("confidence"), F.coalesce("tone", F.lit("Factual")).alias("tone"),
        (F.col("id") <= cutoff).alias("is_anchor"))
    return keyed_update(df, updates, ["strategic_intent", "confidence", "tone", "is_anchor"])


def backfill_authors(df: DataFrame, authors: DataFrame, include_null: bool = False) -> DataFrame:
    """Author by url for articles that lack one (authors: url, author)."""
    lacking = lacks_author(include_null=include_null)
    found = authors.filter(~missing("author")).groupBy("url").agg(F.min("author").alias("_found"))
    keyed = df.withColumn("_key", spread_key(F.col("url"), lacking))
    joined = keyed.join(found.withColumnRenamed("url", "_key"), "_key", "left")
    return joined.withColumn("author", F.coalesce("_found", "author")).select(*df.columns)


def backfill_times(df: DataFrame) -> DataFrame:
    """Posting time from a date in the text, where missing."""
    return df.withColumn("posting_time", F.coalesce("posting_time", date_in_text("article_text").cast("timestamp")))
