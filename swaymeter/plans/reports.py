"""Dashboard pages and reports, as named panels (one DataFrame each).

All counting panels of a page come from one text-free projection of the filtered
articles; a page of articles fetches its texts last, for the chosen ids only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions import text as X
from swaymeter.functions.base import iexact, look_up, present, strip, to_day
from swaymeter.functions.labels import alias, canonical_intent, country_name
from swaymeter.functions.scores import risk_band
from swaymeter.operators import aggregates as A
from swaymeter.operators import filters as P
from swaymeter.operators.joins import of_outlet, request_scores
from swaymeter.operators.paging import Page, latest, newest_order, paginate

SLIM = ["id", "posting_time", "media_outlet", "inferred_actor", "strategic_intent", "tone", "target_country",
        "confidence", "author", "url"]


def slim(df: DataFrame) -> DataFrame:
    """The article table without its texts."""
    return df.select(*[c for c in SLIM if c in df.columns])


def display_rows(rows: DataFrame, title=X.display_title) -> DataFrame:
    """Title, summary and display intent for the articles of one page."""
    return rows.withColumns({"display_title": title("article_text"),
                             "display_summary": X.display_summary("article_text"),
                             "canonical_intent": canonical_intent("strategic_intent")})


def page_with_text(articles: DataFrame, chosen: DataFrame, page: object, size: int, title=X.display_title) -> Page:
    """A page chosen among text-free rows, with the texts of just these rows."""
    found = paginate(chosen, page, size)
    rows = display_rows(articles.join(F.broadcast(found.keys), "id"), title).orderBy("position")
    return Page(rows, found.keys, found.number, found.num_pages, found.total)


def request(spark, country: str | None, actor: str | None, intent: str | None) -> DataFrame:
    return spark.createDataFrame([(country, actor, intent)], "country string, actor string, intent string")


def contextual_score(index: DataFrame, country: str, actor: str, intent: str | None = None) -> DataFrame:
    """Best indexed score for one request: (country, actor, intent, score, score_intent)."""
    return request_scores(request(index.sparkSession, country, actor, intent), index)


class Panels(Mapping):
    """Named panels, each built when it is asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = makers

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# ---- overview ------------------------------------------------------------
def overview_cards(base: DataFrame, index: DataFrame) -> DataFrame:
    """Totals, distinct outlets, intents and actors, mean confidence and mean risk, in one row.

    Distinct values are counted on the table of combinations, not on the articles.
    """
    combos = base.groupBy("media_outlet", "strategic_intent", "inferred_actor").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.count("confidence").alias("n_conf"))
    return cards_of(combos, index)


def cards_of(combos: DataFrame, index: DataFrame) -> DataFrame:
    """The cards from counts (n, conf, n_conf) per outlet, intent and actor, in any number of rows."""
    def kinds(c: str):
        # a placeholder is no kind of its own, NULL is one
        return A.distinct_values(c) - F.count_distinct(F.when(F.col(c).isin(V.PLACEHOLDERS), F.col(c)))

    mean = F.try_divide(F.sum("conf"), F.sum("n_conf"))
    cards = combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(A.distinct_values("media_outlet"), F.lit(0)).alias("outlets"),
        F.coalesce(kinds("strategic_intent"), F.lit(0)).alias("intents"),
        F.coalesce(kinds("inferred_actor"), F.lit(0)).alias("actors"),
        F.bround(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_confidence"))
    risk = index.agg(F.bround(F.coalesce(F.avg("final_risk"), F.lit(0.0)), 3)).scalar()
    return cards.withColumn("avg_risk", risk)


def overview_base(articles: DataFrame, country: str | None = None, actor: str | None = None,
                  intent: str | None = None) -> DataFrame:
    """Articles about monitored countries that are not about sports, text-free."""
    chosen = P.matching(articles.filter(P.monitored()), country, actor, intent)  # cheap conditions first
    return slim(P.without_words(chosen, V.SPORTS_WORDS))


def top_subjects(base: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent (intent, actor, country); names are mapped after the cut, so groups stay apart."""
    top = A.top_counts(base.filter(P.no_placeholder("strategic_intent", [""])), "strategic_intent", "inferred_actor",
                       "target_country", n=n, name="total")
    return top.withColumn("canonical_intent", canonical_intent("strategic_intent"))


def overview(articles: DataFrame, index: DataFrame, country: str | None = None, actor: str | None = None,
             intent: str | None = None, page: object = 1, keep: bool = False) -> Panels:
    """Panels of the overview page. With `keep`, the filtered base is stored once for all panels."""
    base = overview_base(articles, country, actor, intent)
    base = base.persist() if keep else base
    risk = index
    risk = risk.filter(iexact("country", country)) if country else risk
    risk = risk.filter(iexact("actor", actor)) if actor else risk
    panels = {
        "cards": lambda: overview_cards(base, risk),
        "volume": lambda: A.latest_volume(base, 500),
        "countries": lambda: A.top_counts(base.filter(P.no_placeholder("target_country")), "target_country", n=10,
                                          name="total"),
        "subjects": lambda: top_subjects(base),
        "articles": lambda: page_with_text(articles, base, page, 10).rows,
    }
    if country and actor:
        panels["score"] = lambda: contextual_score(index, country, actor, intent)
    return Panels(**panels)


# ---- outlets -------------------------------------------------------------
def top_outlets(articles: DataFrame, n: int = 10) -> DataFrame:
    return A.top_counts(articles.filter(present("media_outlet")), "media_outlet", n=n, name="article_count")


def outlet_profile(articles: DataFrame, outlets: DataFrame, outlet: str | None = None,
                   page: object = 1) -> Panels:
    base = slim_with(articles, "media_outlet_fk")
    one = bool(outlet) and outlet != "All Outlets"
    chosen = of_outlet(base, outlets, outlet) if one else base

    def top(c: str, n: int | None = 10) -> Callable[[], DataFrame]:
        return lambda: A.top_counts(chosen.filter(P.no_placeholder(c)), c, n=n)

    panels = {"top_outlets": lambda: top_outlets(base),
              "articles": lambda: page_with_text(articles, chosen, page, 10).rows}
    if one:
        panels |= {"stats": lambda: totals(chosen), "intents": top("strategic_intent"), "actors": top("inferred_actor"),
                   "tones": top("tone", None), "countries": top("target_country")}
    return Panels(**panels)


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_articles"), F.avg("confidence").alias("avg_confidence"))


def slim_with(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*[c for c in [*SLIM, *extra] if c in df.columns])


# ---- countries -----------------------------------------------------------
def intent_distribution(articles: DataFrame) -> DataFrame:
    """Counts per display intent; raw labels that map to none are left out."""
    raw = A.count_by(articles.filter(~P.null_like("strategic_intent")), "strategic_intent")
    mapped = raw.withColumn("intent", canonical_intent("strategic_intent")).filter(F.col("intent").isNotNull())
    return mapped.groupBy("intent").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "intent")


def country_profile_report(articles: DataFrame, index: DataFrame, country: str | None = None) -> dict[str, DataFrame]:
    base = slim(articles)
    pairs = base.filter(P.no_placeholder("target_country") & P.no_placeholder("inferred_actor"))
    top_pairs = A.top_counts(pairs, "target_country", "inferred_actor", n=10)
    panels = {
        "countries": A.top_counts(base.filter(P.no_placeholder("target_country")), "target_country", n=10),
        "actors": A.top_counts(base.filter(P.no_placeholder("inferred_actor")), "inferred_actor", n=10),
        "pairs": top_pairs.withColumn("label", F.concat("target_country", F.lit(" - "), "inferred_actor")),
    }
    if country:
        here = base.filter(iexact("target_country", country))
        indexed = F.lit(V.COUNTRY_ALIASES["profile"].get(country.lower(), country.lower()))
        panels["actor_risk"] = A.mean_risk(index.filter(iexact("country", indexed)), "actor").orderBy(
            F.desc("avg_risk"), "actor")
        panels["intents"] = intent_distribution(here)
        panels["volume"] = A.daily_volume(here)
        panels["confidence"] = here.agg(F.count("*").alias("articles"), F.avg("confidence").alias("avg_confidence"))
        panels["latest"] = latest(here, 10)
    else:
        panels["country_risk"] = A.mean_risk(index, "country").orderBy(F.desc("avg_risk"), "country")
    return panels


# ---- authors -------------------------------------------------------------
AUTHOR_ORDER = [("author", True, False)]


def author_directory(articles: DataFrame, search: str | None = None, page: object = 1, size: int = 30) -> Page:
    """Alphabetical page of valid authors with article count and mean confidence."""
    stats = A.author_stats(articles.filter(P.valid_author()).filter(P.search(search or "", "author")))
    found = paginate(stats, page, size, AUTHOR_ORDER, key="author")
    shown = found.rows.filter(F.length(strip("author")) > 2).select(
        strip("author").alias("author"), "articles", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))
    return Page(shown, found.keys, found.number, found.num_pages, found.total)


def author_profile(articles: DataFrame, name: str, page: object = 1) -> Panels:
    own = slim(articles).filter(iexact("author", name))

    def top(c: str) -> Callable[[], DataFrame]:
        return lambda: A.top_counts(own.filter(P.no_placeholder(c)), c, n=5)

    return Panels(stats=lambda: totals(own), intents=top("strategic_intent"), countries=top("target_country"),
                  actors=top("inferred_actor"), articles=lambda: page_with_text(articles, own, page, 10).rows)


# ---- country report ------------------------------------------------------
def known_country(articles: DataFrame, selected: str) -> DataFrame:
    """One row with the spelling of a selected country as the articles use it."""
    used = articles.filter(F.lower("target_country") == selected.lower()).agg(F.min("target_country").alias("known"))
    return used.select(country_name(F.lit(selected), "known").alias("country"))


def report_scores(index: DataFrame, country: str, actors: Sequence[str]) -> DataFrame:
    """Requested actors ranked by their best score; equal scores stay in the order asked for."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(i, a) for i, a in enumerate(actors)], "position int, actor string")
    indexed_country = F.coalesce(look_up(F.lower(F.lit(country)), V.COUNTRY_ALIASES["report_index"]), F.lit(country))
    best = A.best_risk(index.filter(iexact("country", indexed_country)).withColumn("_a", F.upper("actor")), "_a")
    in_articles = alias("actor", "report_articles", "actor")
    keyed = asked.withColumn("_a", F.upper(alias("actor", "report_index", in_articles)))
    joined = keyed.join(best, "_a", "left")
    return (joined.select(
        "position", "actor", F.bround(F.coalesce("final_risk", F.lit(0.0)), 3).alias("score"),
        risk_band("final_risk").alias("band"), F.coalesce("intent", F.lit("No Data Found")).alias("primary_threat"))
        .orderBy(F.desc("score"), "position"))


def volume_by_actor(articles: DataFrame, country: str, actors: Sequence[str]) -> DataFrame:
    """(actor, day, count): articles a day about the country for each asked actor, in one grouped scan.

    An actor that is asked under two names has a series under each.
    """
    asked: dict[str, list[str]] = {}
    for actor in actors:
        asked.setdefault(V.ACTOR_ALIASES["report_articles"].get(actor.lower(), actor).upper(), []).append(actor)
    about = articles.filter((F.upper("target_country") == F.upper(F.lit(country))) & F.upper("inferred_actor").isin(list(asked))
                            & F.col("posting_time").isNotNull())
    base = P.without_words(about, V.SPORTS_WORDS_REPORT)
    days = base.groupBy(F.upper("inferred_actor").alias("_a"), to_day("posting_time").alias("day")).agg(F.count("*").alias("count"))
    names = F.create_map(*[x for a, shown in asked.items() for x in (F.lit(a), F.array(*map(F.lit, shown)))])
    return days.select(F.explode(names[F.col("_a")]).alias("actor"), "day", "count")


def country_report(articles: DataFrame, index: DataFrame, country: str, actors: Sequence[str]) -> dict[str, DataFrame]:
    """Scores of the actors and their volumes; narratives, volume and intents of the top one."""
    spelled = known_country(articles, country).first()["country"]
    name = F.lit(spelled)
    scores = report_scores(index, spelled, actors)
    top = scores.first()["actor"]
    top_name = V.ACTOR_ALIASES["report_articles"].get(top.lower(), top)
    about = articles.filter((F.upper("target_country") == F.upper(name)) & iexact("inferred_actor", top_name))
    base = P.without_words(about, V.SPORTS_WORDS_REPORT)
    labelled = base.filter(P.no_placeholder("strategic_intent", ["", "Unknown", "unknown"]))
    counted = slim(base).filter(P.no_placeholder("strategic_intent"))
    intents = A.top_counts(counted, "strategic_intent", n=5)
    primary = A.top_counts(counted, "strategic_intent", n=1).agg(
        F.coalesce(F.max("strategic_intent"), F.lit("General Influence")).alias("primary_intent"))
    return {
        "scores": scores,
        "summary": base.agg(F.count("*").alias("articles")).withColumn("primary_intent", primary.scalar()),
        "narratives": latest(labelled, 4).select(
            "id", "strategic_intent", "tone", "url", "media_outlet",
            X.format_day("posting_time").alias("day"), X.snippet("article_text", 500).alias("excerpt")),
        "evidence": latest(base.filter(F.col("article_text").isNotNull()), 15).select(
            "id", "media_outlet", "strategic_intent", X.snippet("article_text", 500).alias("excerpt")),
        "volume": A.daily_volume(slim(base)),
        "volume_by_actor": volume_by_actor(articles, spelled, actors),
        "intents": A.shown_ascending(intents, "count", "strategic_intent"),
    }


# ---- listing, home, question context ---------------------------------------
def article_listing(articles: DataFrame, country: str | None = None, actor: str | None = None,
                    intent: str | None = None, start: str | None = None, end: str | None = None,
                    page: object = 1, size: int = 20) -> Page:
    chosen = P.matching(slim(articles), country, actor, intent).filter(P.between_days("posting_time", start, end))
    return page_with_text(articles, chosen, page, size, X.simple_title)


def article_search(articles: DataFrame, query: str, page: object = 1, size: int = 10) -> Page:
    chosen = slim(articles.filter(P.search(query, "article_text")))
    return page_with_text(articles, chosen, page, size)


def home(articles: DataFrame) -> dict[str, DataFrame]:
    base = slim(articles)

    def filled(c: str) -> DataFrame:
        return base.filter(P.no_placeholder(c))

    return {
        "totals": base.agg(F.count("*").alias("articles")).withColumns({
            "countries": filled("target_country").select("target_country").distinct().agg(F.count("*")).scalar(),
            "actors": filled("inferred_actor").select("inferred_actor").distinct().agg(F.count("*")).scalar()}),
        "latest": latest(base, 10),
        "countries": A.top_counts(filled("target_country"), "target_country", n=5),
        "actors": A.top_counts(filled("inferred_actor"), "inferred_actor", n=5),
    }


def question_context(articles: DataFrame, country: str | None = None, actor: str | None = None,
                     intent: str | None = None) -> dict[str, DataFrame]:
    """Counts, top lists and samples that answer one question."""
    base = P.matching(articles.filter(P.monitored()), country, actor, intent)
    counting = slim(base)
    panels = {"count": counting.agg(F.count("*").alias("articles"))}
    if not (country or actor or intent):
        panels["total"] = slim(articles).agg(F.count("*").alias("articles"))
    if country and not intent:
        panels["intents"] = A.top_counts(counting.filter(P.no_placeholder("strategic_intent", [""])),
                                         "strategic_intent", n=3)
    if country and not actor:
        panels["actors"] = A.top_counts(counting.filter(P.no_placeholder("inferred_actor", [""])), "inferred_actor", n=3)
    if actor and not country:
        panels["countries"] = A.top_counts(counting.filter(P.no_placeholder("target_country", [""])),
                                           "target_country", n=3)
    if country and actor:
        panels["narratives"] = A.top_counts(counting.filter(P.no_placeholder("strategic_intent", [""])),
                                            "strategic_intent", n=5)
    newest = latest(counting, 3).select("id")
    panels["samples"] = (articles.join(F.broadcast(newest), "id", "left_semi")  # three ids
                         .select("id", "posting_time", X.snippet("article_text", 100).alias("excerpt"),
                                 "strategic_intent", "inferred_actor")
                         .orderBy(*newest_order()))
    return panels


def actor_statistics(articles: DataFrame, index: DataFrame, country: str | None = None) -> DataFrame:
    """Articles, mean confidence and mean index per actor (index by the actor's index name)."""
    base = P.matching(articles.filter(P.no_placeholder("inferred_actor")), country)
    stats = A.mean_confidence(base, "inferred_actor")
    risk = index.filter(iexact("country", alias("country", "request", F.lit(country)))) if country else index
    mean = A.mean_risk(risk.withColumn("_a", F.upper("actor")), "_a")
    keyed = stats.withColumn("_a", F.upper(F.coalesce(alias("actor", "request", "inferred_actor"), F.lit("\u0001"))))
    return keyed.join(mean, "_a", "left").drop("_a").orderBy(F.desc("articles"), "inferred_actor")


def compare_actors(articles: DataFrame, actors: Sequence[str], country: str | None = None) -> DataFrame:
    """(actor, articles, top_intent) of the given actors; `N/A` without any intent."""
    named = articles.sparkSession.createDataFrame([(a, a.upper()) for a in actors], "actor string, _a string")
    base = P.matching(articles, country).select(F.upper("inferred_actor").alias("_a"), "strategic_intent")
    mine = base.filter(F.col("_a").isin([a.upper() for a in actors]))
    counts = A.count_by(mine, "_a", name="articles")
    top = A.most_frequent(mine.filter(P.no_placeholder("strategic_intent", [""])), ["_a"], "strategic_intent")
    return (named.join(counts, "_a", "left").join(top.drop("count"), "_a", "left")
            .select("actor", F.coalesce("articles", F.lit(0)).alias("articles"),
                    F.coalesce("strategic_intent", F.lit("N/A")).alias("top_intent")))


def tone_breakdown(articles: DataFrame, actor: str, country: str | None = None) -> DataFrame:
    return A.top_counts(P.matching(articles, country, actor).filter(P.no_placeholder("tone", [""])), "tone")


def foreign_total(articles: DataFrame) -> DataFrame:
    """Articles with a foreign actor that are not about football."""
    return P.without_words(articles.filter(P.foreign()), ["football"]).agg(F.count("*").alias("total"))


def country_counts(articles: DataFrame, country: str) -> dict[str, DataFrame]:
    """Foreign articles about a country, and their most frequent (intent, actor)."""
    base = slim(articles).filter(iexact("target_country", country) & P.foreign())
    labelled = base.filter(P.no_placeholder("strategic_intent", ["", "unknown", "Unknown"]))
    return {"total": base.agg(F.count("*").alias("articles")),
            "top": A.top_counts(labelled, "strategic_intent", "inferred_actor", n=5)}


def country_narratives(articles: DataFrame, country: str, actor: str | None = None, n: int = 12) -> DataFrame:
    """Latest articles about a country (and actor) as lines of evidence."""
    base = articles.filter(iexact("target_country", country) & (F.col("article_text") != ""))
    base = (base.filter(iexact("inferred_actor", actor)) if actor
            else base.filter(P.no_placeholder("inferred_actor", ["Local", "Domestic", ""])))
    return latest(base, n).select("id", X.source_line("media_outlet", "inferred_actor", "strategic_intent",
                                                      "article_text").alias("line"))
