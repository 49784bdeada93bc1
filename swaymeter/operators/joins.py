"""Lookups and links, as set joins.

No join carries a broadcast hint on a caller's table: Spark broadcasts a side when its
measured size allows and otherwise splits hot keys itself. Rows that cannot match get
a key of their own, so that they do not pile up in the partition of NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter import fixed_values as V
from swaymeter.functions.base import iexact, look_up, present, strip
from swaymeter.functions.labels import alias, score_intent
from swaymeter.operators.aggregates import best_risk, pick_best
from swaymeter.operators.lookup import MAX_LOOKUP, small  # noqa: F401
from swaymeter.operators.term_search import term_mentions, word_mentions  # noqa: F401


def spread_key(key: Column, usable: Column, row_id: str = "id") -> Column:
    """The key where usable; elsewhere a unique value no real key can equal."""
    own = F.concat(F.lit("\u0001"), F.col(row_id).cast("string"))
    return F.when(F.coalesce(usable, F.lit(False)), key).otherwise(own)


def surrogate_id(c: Column) -> Column:
    """Stable 60-bit id of a name: the same on every run, without a counter."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


# ---- profiles ------------------------------------------------------------
def link_journalists(df: DataFrame, journalists: DataFrame) -> DataFrame:
    """Fill `journalist_fk` by author name, ignoring case and outer blanks.

    Linked rows keep their link; of several profiles with one name the first by name counts.
    """
    profile = pick_best(journalists.withColumn("_key", F.upper("name")), ["_key"],
                        [F.col("name"), F.col("id")], ["id"]).withColumnRenamed("id", "_fk")
    author = strip("author")
    usable = F.col("journalist_fk").isNull() & ~F.col("author").isin(V.PLACEHOLDERS)
    keyed = df.withColumn("_key", spread_key(F.upper(author), usable))
    joined = keyed.join(profile, "_key", "left")
    return joined.withColumn("journalist_fk", F.coalesce("journalist_fk", "_fk")).drop("_key", "_fk")


def with_missing_profiles(profiles: DataFrame, names: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Profiles plus one new (id, name) row for each name that has none."""
    fold = F.upper if ignore_case else (lambda c: c)
    wanted = names.select(F.col("name")).filter(present("name"))
    if ignore_case:
        wanted = wanted.select(strip("name").alias("name")).filter(present("name"))
    wanted = wanted.withColumn("_key", fold(F.col("name"))).groupBy("_key").agg(F.min("name").alias("name"))
    new = (wanted.join(profiles.select(fold(F.col("name")).alias("_key")).distinct(), "_key", "left_anti")
           .select(surrogate_id(F.col("_key")).alias("id"), "name"))
    return profiles.unionByName(new, allowMissingColumns=True)


def link_outlets(df: DataFrame, outlets: DataFrame, ignore_case: bool = True) -> tuple[DataFrame, DataFrame]:
    """Create missing outlets, then fill `media_outlet_fk`; returns (articles, outlets)."""
    return _link(df, outlets, "media_outlet", "media_outlet_fk", ignore_case)


def link_authors_exact(df: DataFrame, journalists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Create missing journalists by exact name, then fill `journalist_fk`."""
    return _link(df, journalists, "author", "journalist_fk", False)


def _link(df, profiles, column, fk, ignore_case):
    all_profiles = with_missing_profiles(profiles, df.select(F.col(column).alias("name")).distinct(), ignore_case)
    fold = F.upper if ignore_case else (lambda c: c)
    key = fold(strip(column)) if ignore_case else F.col(column)
    lookup = (all_profiles.select(fold(F.col("name")).alias("_key"), F.col("id").alias("_fk"))
              .groupBy("_key").agg(F.min("_fk").alias("_fk")))
    keyed = df.withColumn("_key", spread_key(key, present(column) & F.col(fk).isNull()))
    linked = keyed.join(lookup, "_key", "left").withColumn(fk, F.coalesce(fk, "_fk")).drop("_key", "_fk")
    return linked, all_profiles


def of_outlet(df: DataFrame, outlets: DataFrame, outlet: str) -> DataFrame:
    """Articles of an outlet, by their linked profile or by the name in the text column."""
    ids = outlets.filter(iexact("name", outlet)).select(F.col("id").alias("media_outlet_fk"), F.lit(True).alias("_hit"))
    keyed = df.withColumn("_key", spread_key(F.col("media_outlet_fk").cast("string"), F.col("media_outlet_fk").isNotNull()))
    linked = ids.select(F.col("media_outlet_fk").cast("string").alias("_key"), "_hit").distinct()
    joined = keyed.join(linked, "_key", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) | F.coalesce(iexact("media_outlet", outlet), F.lit(False))
    return joined.filter(hit).drop("_hit").select(*df.columns)


# ---- score lookups -------------------------------------------------------
def _key(c: Column) -> Column:
    return F.lower(strip(c))


def _exact(df: DataFrame, index: DataFrame, country: Column, actor: Column, intent: Column, name: str) -> DataFrame:
    # (country, actor, intent) is unique; max() only guards against spellings that fold together
    best = index.groupBy(_key(F.col("country")).alias("_c"), _key(F.col("actor")).alias("_a"),
                         _key(F.col("intent")).alias("_i")).agg(F.max("final_risk").alias(name))
    keyed = df.withColumns({"_c": _key(country), "_a": _key(actor), "_i": _key(intent)})
    return keyed.join(small(best), ["_c", "_a", "_i"], "left")


def score_exact(df: DataFrame, index: DataFrame, country: Column, actor: Column, intent: Column,
                name: str = "score") -> DataFrame:
    """Score of exactly this (country, actor, intent), ignoring case and outer blanks."""
    return _exact(df, index, country, actor, intent, name).drop("_c", "_a", "_i")


def score_cascade(df: DataFrame, index: DataFrame) -> DataFrame:
    """Exact score, else the pair's highest, else a constant of the stored intent.

    Adds `score` and `match_level` (exact / pair / constant).
    """
    fill = {c: F.coalesce(F.col(c), F.lit("")) for c in ("target_country", "inferred_actor", "strategic_intent")}
    country = alias("country", "score", fill["target_country"])
    actor = alias("actor", "score", fill["inferred_actor"])
    folded = index.withColumns({"_c": _key(F.col("country")), "_a": _key(F.col("actor")), "_i": _key(F.col("intent"))})
    best = folded.filter(F.col("_c").isNotNull() & F.col("_a").isNotNull()).groupBy("_c", "_a", "_i").agg(F.max("final_risk").alias("risk"))
    # one row per pair: its scores by intent and its highest score
    pairs = best.groupBy("_c", "_a").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "risk")))).alias("_by_intent"),
        F.max("risk").alias("_pair"))
    keyed = df.withColumns({"_c": _key(country), "_a": _key(actor), "_i": _key(score_intent(fill["strategic_intent"]))})
    joined = keyed.join(small(pairs), ["_c", "_a"], "left").withColumn("_exact", F.try_element_at("_by_intent", F.coalesce("_i", F.lit(""))))
    constant = F.coalesce(look_up(F.col("strategic_intent"), V.INTENT_CONSTANTS), F.lit(V.INTENT_CONSTANT_DEFAULT))
    return (joined.withColumn("score", F.coalesce("_exact", "_pair", constant))
            .withColumn("match_level", F.when(F.col("_exact").isNotNull(), F.lit("exact"))
                        .when(F.col("_pair").isNotNull(), F.lit("pair")).otherwise(F.lit("constant")))
            .drop("_c", "_a", "_i", "_by_intent", "_exact", "_pair"))


def score_without_actor(df: DataFrame, index: DataFrame, country: Column, intent: Column, actor: Column) -> DataFrame:
    """Exact score, else that of the first actor indexed for (country, intent), else 0."""
    exact = _exact(df, index, country, actor, intent, "_exact")
    first = (index.groupBy(F.trim("country").alias("_fc"), F.trim("intent").alias("_fi"))
             .agg(F.min_by("final_risk", "actor").alias("_any")))
    joined = exact.withColumns({"_fc": country, "_fi": intent}).join(small(first), ["_fc", "_fi"], "left")
    return (joined.withColumn("score", F.coalesce("_exact", "_any", F.lit(0.0)))
            .drop("_c", "_a", "_i", "_fc", "_fi", "_exact", "_any"))


def request_scores(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Best score for requests of (country, actor, intent); intent empty or `All` means any.

    Adds `score` (4 decimals) and `score_intent`.
    """
    def fold(c: Column) -> Column:
        return F.upper(c)

    by_pair = best_risk(index.select(fold(F.col("country")).alias("_c"), fold(F.col("actor")).alias("_a"),
                                     "intent", "final_risk"), "_c", "_a")
    by_pair = by_pair.select("_c", "_a", F.lit("").alias("_i"), "final_risk", F.col("intent").alias("_intent"))
    by_intent = (index.groupBy(fold(F.col("country")).alias("_c"), fold(F.col("actor")).alias("_a"),
                               fold(F.col("intent")).alias("_i"))
                 .agg(F.max_by(F.struct("final_risk", "intent"), "final_risk").alias("_b"))
                 .select("_c", "_a", "_i", F.col("_b.final_risk"), F.col("_b.intent").alias("_intent")))
    any_intent = ~present("intent") | (F.col("intent") == "All")
    keyed = requests.withColumns({
        "_c": fold(alias("country", "request", "country")), "_a": fold(alias("actor", "request", "actor")),
        "_i": F.when(any_intent, F.lit("")).otherwise(fold(F.col("intent")))})
    joined = keyed.join(by_pair.unionByName(by_intent), ["_c", "_a", "_i"], "left")
    return (joined.withColumn("score", F.coalesce(F.round("final_risk", 4), F.lit(0.0)))
            .withColumn("score_intent", F.coalesce("_intent", F.lit("No Risk Data Found")))
            .drop("_c", "_a", "_i", "final_risk", "_intent"))


# ---- semi, anti, grid ----------------------------------------------------
def mark_listed(df: DataFrame, ids: DataFrame, key: str = "id", name: str = "is_anchor") -> DataFrame:
    """Flag rows whose id is on a list."""
    listed = ids.select(key).distinct().withColumn(name, F.lit(True))
    return df.drop(name).join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def not_stored(df: DataFrame, store: DataFrame, key: str = "url", row_id: str = "id") -> DataFrame:
    """Rows whose key the store does not have yet; a missing key is skipped, too."""
    return df.filter(present(key)).join(store.select(key).filter(present(key)).distinct(), key, "left_anti")


def labelled_anchors(df: DataFrame) -> DataFrame:
    """Anchors with a human label, next to what was predicted for them."""
    agree = F.col("true_label") == F.col("strategic_intent")
    return (df.filter(F.col("is_anchor") & present("true_label"))
            .withColumn("agrees", F.when(F.coalesce(agree, F.lit(False)), 1).otherwise(0)))


def labelled_by(df: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Human labels from a separate table."""
    return df.drop("true_label").join(labels.select(key, "true_label"), key, "left")


def resolve_with(df: DataFrame, column: str, aliases: DataFrame, name: str) -> DataFrame:
    """Canonical spelling from an alias table (`key`, `value`), unknown names unchanged.

    A NULL name meets nothing and gets a key from the other columns, so that rows without a name are dealt out evenly.
    """
    own = F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]).cast("string")
    table = aliases.groupBy(F.lower("key").alias("_key")).agg(F.min("value").alias("_value"))
    usable = F.col(column).isNotNull()
    keyed = df.withColumn("_key", F.when(usable, F.lower(strip(column))).otherwise(F.concat(F.lit("\u0001"), own)))
    return (keyed.join(table, "_key", "left").withColumn(name, F.coalesce("_value", column))
            .drop("_key", "_value"))


def query_grid(stories: DataFrame, queries: Mapping[str, Column], actors: Sequence[str], actor: str) -> DataFrame:
    """Stories of each actor's collection that answer each target's query: adds `target`.

    A story can answer several targets and then gives several rows.
    """
    targets = F.filter(F.array(*[F.when(F.coalesce(q, F.lit(False)), F.lit(t)) for t, q in queries.items()]),
                       lambda t: t.isNotNull())
    return (stories.filter(F.col(actor).isin(list(actors))).withColumn("target", F.explode(targets)))
