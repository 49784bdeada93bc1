"""Which panel answers a question, and about whom."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import look_up, lower_contains_any, strip, title_case
from swaymeter.functions.labels import has_words
from swaymeter.operators.filters import no_placeholder
from swaymeter.operators.lookup import small


def _first_key(q: Column, values: dict[str, str]) -> Column:
    """Value of the first key inside the question."""
    out = F.when(F.lit(False), F.lit(""))
    for key, value in values.items():
        out = out.when(F.contains(q, F.lit(key)), F.lit(value))
    return out


def _listed(q: Column, names: list[str]) -> Column:
    """All names inside the question, in list order, title-cased."""
    hits = F.array(*[F.when(F.contains(q, F.lit(n)), F.lit(n)) for n in names])
    return F.transform(F.filter(hits, lambda x: x.isNotNull()), title_case)


def _about_country(q: Column) -> Column:
    name = F.regexp_extract(q, V.QUESTION_ABOUT_COUNTRY_PATTERN, 1)
    return (F.when(name == "", F.lit(None).cast("string"))
            .when(F.contains(name, F.lit("south")) & F.contains(name, F.lit("africa")), F.lit("South Africa"))
            .when(name == "senegal", F.lit("Senegal")).when(name == "drc", F.lit("DRC"))
            .when(lower_contains_any(name, ["cote", "ivoire", "ivory"]), F.lit("Côte d'Ivoire"))
            .when(name == "ethiopia", F.lit("Ethiopia")))


def route_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Adds route, country, actor, other_actor and intent; the first fitting rule decides."""
    q = F.col("_q")
    named_country = F.regexp_extract(q, f"({V.QUESTION_COUNTRY_PATTERN})", 1)
    named_actor = F.regexp_extract(q, f"({V.QUESTION_ACTOR_PATTERN})", 1)
    about = _about_country(q)
    actors, countries = _listed(q, V.QUESTION_ACTORS), _listed(q, V.QUESTION_COUNTRIES)
    route = (F.when((named_country != "") & has_words(q, "narratives"), F.lit("narratives"))
             .when(has_words(q, "overview"), F.lit("overview"))
             .when(about.isNotNull() & has_words(q, "country_counts"), F.lit("country_counts"))
             .when(has_words(q, "actor_stats"), F.lit("actor_stats"))
             .when(has_words(q, "compare") & (F.size(actors) >= 2), F.lit("compare"))
             .when(has_words(q, "tone") & (F.size(actors) >= 1), F.lit("tone"))
             .when(has_words(q, "off_topic") & ~has_words(q, "off_topic_actors"), F.lit("off_topic"))
             .when(has_words(q, "help"), F.lit("help"))
             .when(has_words(q, "total"), F.lit("total"))
             .when(has_words(q, "avg_index"), F.lit("avg_index"))
             .otherwise(F.lit("context")))
    routed = questions.withColumn("_q", F.lower(strip(text))).withColumn("route", route)
    r = F.col("route")
    listed = r.isin("actor_stats", "compare", "tone")
    country = (F.when(r == "narratives", look_up(named_country, V.COUNTRY_ALIASES["question"]))
               .when(r == "country_counts", about)
               .when(listed, F.try_element_at(countries, F.lit(1)))
               .when(r == "context", _first_key(q, V.COUNTRY_ALIASES["question"])))
    actor = (F.when(r == "narratives", look_up(named_actor, V.ACTOR_ALIASES["question"]))
             .when(r.isin("compare", "tone"), F.try_element_at(actors, F.lit(1)))
             .when(r == "context", _first_key(q, V.ACTOR_ALIASES["question"])))
    return routed.withColumns({
        "country": country, "actor": actor,
        "other_actor": F.when(r == "compare", F.try_element_at(actors, F.lit(2))),
        "intent": F.when(r == "context", _first_key(q, V.intent_aliases("display")))}).drop("_q")


def answer_questions(routed: DataFrame, articles: DataFrame, index: DataFrame, keys: Sequence[str] = ("question_id",), n: int = 5) -> DataFrame:
    """(keys, measure, label, value) for a table of routed questions, all at once.

    `total` and `avg_index` get one figure, `country_counts` the articles about the country, `compare` the articles of
    either actor (in the country, if one is named), `tone` the tones of the actor's articles, `actor_stats` the `n` most
    active actors (in the country). Articles are counted once by country, actor and tone; every question asks for one
    or two keys, and one join with the table of counts answers them all.
    """
    counts = articles.groupBy(F.lower("target_country").alias("_c"), "inferred_actor", "tone").agg(F.count("*").alias("n"))
    named = counts.filter(F.col("inferred_actor").isNotNull() & no_placeholder("inferred_actor")).withColumn("_a", F.lower("inferred_actor"))
    anywhere = F.array(F.lit(""), "_c")  # each count holds for its country and for no country asked
    actors = (named.withColumn("_c", F.explode(F.array_compact(anywhere))).groupBy("_c", "_a").agg(F.sum("n").alias("value")))
    rank = F.row_number().over(Window.partitionBy("_c").orderBy(F.desc("value"), "_a"))  # one row per actor
    nothing = F.lit(None).cast("string")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))
    mean = index.agg(F.round(F.avg("final_risk"), 6).alias("value"))
    tones = named.filter(F.col("tone").isNotNull() & no_placeholder("tone")).groupBy("_a", "tone").agg(F.sum("n").alias("value"))
    known = [
        total.select(F.lit("total").alias("route"), F.lit("").alias("_c"), F.lit("").alias("_a"), nothing.alias("found"), "value"),
        mean.select(F.lit("avg_index"), F.lit(""), F.lit(""), nothing, "value"),
        counts.filter("_c IS NOT NULL").groupBy("_c").agg(F.sum("n").alias("value")).select(F.lit("country_counts"), "_c", F.lit(""), nothing, "value"),
        actors.select(F.lit("compare"), "_c", "_a", nothing, "value"),
        tones.select(F.lit("tone"), F.lit(""), "_a", "tone", "value"),
        actors.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(F.lit("actor_stats"), "_c", F.lit(""), "_a", "value"),
    ]
    answers = reduce(DataFrame.union, [k.withColumn("value", F.col("value").cast("double")) for k in known])
    route, place = F.col("route"), F.coalesce(F.lower("country"), F.lit(""))
    who = F.when(route == "compare", F.array("actor", "other_actor")).when(route == "tone", F.array("actor")).otherwise(F.array(F.lit("")))
    asked = routed.filter(route.isin("total", "avg_index", "country_counts", "compare", "tone", "actor_stats")).select(
        *keys, "route", F.when(route.isin("country_counts", "compare", "actor_stats"), place).otherwise(F.lit("")).alias("_c"),
        F.when(route == "country_counts", F.col("country")).alias("_country"), F.explode(who).alias("_who"))
    joined = asked.withColumn("_a", F.lower("_who")).join(small(answers), ["route", "_c", "_a"], "left")
    label = F.coalesce("found", F.when(route == "compare", F.col("_who")), "_country")
    value = F.coalesce("value", F.when(route.isin("country_counts", "compare"), F.lit(0.0)))
    measure = F.when(route == "tone", F.lit("tone")).when(route == "avg_index", F.lit("mean index")).otherwise(F.lit("articles"))
    # a tone or a list that nothing answers has no rows; the mean of no index is one row without a value
    return joined.filter(F.col("value").isNotNull() | ~route.isin("tone", "actor_stats")).select(
        *keys, measure.alias("measure"), label.alias("label"), value.alias("value"))
