"""Labels: intents, actors, countries, tones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import (ColumnOrName, any_of, bind, blank_to_null, col, first_match, look_up,
                                      lower_contains_any, missing, strip, title_case)


def canonical_intent(raw: ColumnOrName, title: ColumnOrName | None = None) -> Column:
    """Display name of a raw intent, else the intent the title words point at, else NULL."""
    mapped = look_up(F.lower(strip(raw)), V.intent_aliases("display"))
    if title is not None:
        recovered = bind(F.lower(col(title)), lambda t: first_match(t, V.TITLE_FUNNELS, F.lit(None).cast("string")))
        mapped = F.coalesce(mapped, F.when(~missing(title), recovered))
    return F.when(~missing(raw), mapped)


def contextual_intent(raw: ColumnOrName) -> Column:
    """One of the eight index intents or `Other`; NULL for a missing raw intent.

    Aliases first, then the eight names in order matched as substrings either way
    round, then the word funnels. A blank-only label is inside every name and so
    becomes the first one.
    """
    def from_words(key: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name in V.INTENTS:
            low = F.lit(name.lower())
            out = out.when(F.contains(key, low) | F.contains(low, key), F.lit(name))
        return out.otherwise(first_match(key, V.CONTEXT_FUNNELS, F.lit("Other")))

    key = F.lower(strip(raw))
    return F.when(~missing(raw), F.coalesce(look_up(key, V.intent_aliases("context")), bind(key, from_words)))


def score_intent(raw: ColumnOrName) -> Column:
    """Intent used to look a score up; anything unknown counts as Sovereignty."""
    return F.coalesce(look_up(F.lower(strip(raw)), V.intent_aliases("score")), F.lit("Sovereignty"))


def lookup_intent(raw: ColumnOrName) -> Column:
    """Intent used by the plain risk lookup; unknown ones pass through."""
    return F.coalesce(look_up(F.lower(strip(raw)), V.intent_aliases("lookup")), col(raw))


def is_strategic(raw: ColumnOrName) -> Column:
    """False for intents that always score 0."""
    return ~missing(raw) & ~F.lower(col(raw)).isin("neutral", "unknown", "none")


def clean_intent(raw: ColumnOrName) -> Column:
    """Lower case, single blanks, one trailing generic word removed."""
    one_blank = F.regexp_replace(F.lower(strip(raw)), r"[\s\p{Z}]+", " ")
    return strip(F.regexp_replace(one_blank, "(" + "|".join(V.INTENT_SUFFIXES) + ")$", ""))


def actor_from_outlet(outlet: ColumnOrName) -> Column:
    found = bind(F.lower(col(outlet)), lambda t: first_match(t, V.OUTLET_ACTOR_RULES, F.lit("Unknown")))
    return F.when(missing(outlet), F.lit("Unknown")).otherwise(found)


def _first_entity_actor(entities: Column, rules) -> Column:
    """Actor of the first list element that matches any rule."""
    low = F.transform(entities, F.lower)
    per_item = F.transform(low, lambda e: first_match(e, rules, F.lit(None).cast("string")))
    return F.try_element_at(F.filter(per_item, lambda a: a.isNotNull()), F.lit(1))


def actor_from_content(text: ColumnOrName, organisations: ColumnOrName | None = None,
                       persons: ColumnOrName | None = None) -> Column:
    """Organisations decide before persons, persons before words of the text."""
    options = []
    if organisations is not None:
        options.append(_first_entity_actor(col(organisations), V.ORGANISATION_ACTOR_RULES))
    if persons is not None:
        options.append(_first_entity_actor(col(persons), V.PERSON_ACTOR_RULES))
    options.append(bind(F.lower(col(text)), lambda t: first_match(t, V.TEXT_ACTOR_RULES, F.lit("Unknown"))))
    return F.coalesce(*options, F.lit("Unknown"))


def resolve_actor(stored: ColumnOrName, outlet: ColumnOrName, text: ColumnOrName,
                  organisations: ColumnOrName | None = None) -> Column:
    """Stored actor, else from the outlet name, else from the content, else `Unknown`."""
    def known(c: Column) -> Column:
        return F.when(~missing(c) & (c != "Unknown"), c)

    return F.coalesce(known(col(stored)), known(actor_from_outlet(outlet)),
                      known(actor_from_content(text, organisations)),
                      blank_to_null(stored), F.lit("Unknown"))


def override_actor(actor: ColumnOrName, url: ColumnOrName, outlet: ColumnOrName) -> Column:
    """One outlet always counts as USA."""
    hit = F.contains(col(url), F.lit("nytimes.com")) | (col(outlet) == "The New York Times")
    return F.when(F.coalesce(hit, F.lit(False)), F.lit("USA")).otherwise(col(actor))


def alias(kind: str, ruleset: str, c: ColumnOrName) -> Column:
    """Canonical name of an actor or country; unknown names pass through unchanged."""
    table = {"actor": V.ACTOR_ALIASES, "country": V.COUNTRY_ALIASES}[kind][ruleset]
    return F.coalesce(look_up(F.lower(strip(c)), table), col(c))


def is_low_resource(lang: ColumnOrName) -> Column:
    return F.coalesce(col(lang).isin(V.LOW_RESOURCE_LANGS), F.lit(False))


def clean_tone(tone: ColumnOrName) -> Column:
    """Remove digits and dots; nothing left means `Unknown`."""
    left = strip(F.regexp_replace(col(tone), "[0-9.]+", ""))
    return F.when(missing(tone) | (left == ""), F.lit("Unknown")).otherwise(left)


TUPLE_TONE = r"""^\(\s*(?:'([^'\\]*)'|"([^"\\]*)")\s*(?:,\s*[-+]?[0-9.eE+-]+\s*)?,?\s*\)$"""


def untuple_tone(tone: ColumnOrName) -> Column:
    """`('Label', 0.9)` becomes `Label`; anything that is no such tuple stays."""
    c = col(tone)
    label = F.concat(F.regexp_extract(c, TUPLE_TONE, 1), F.regexp_extract(c, TUPLE_TONE, 2))
    return F.when(F.startswith(c, F.lit("(")) & c.rlike(TUPLE_TONE) & c.contains(","), label).otherwise(c)


def country_name(selected: ColumnOrName, known: ColumnOrName) -> Column:
    """Country name for a typed-in selection: fixed alias, else the spelling in use, else title case."""
    low = F.lower(col(selected))
    return F.coalesce(look_up(low, V.COUNTRY_ALIASES["report_articles"]), col(known), title_case(selected))


def is_valid_pair(country: ColumnOrName, actor: ColumnOrName) -> Column:
    """Country and actor both monitored, ignoring case and blanks."""
    def squeeze(c: ColumnOrName) -> Column:
        return F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))

    countries = [c.replace(" ", "") for c in V.PIPELINE_COUNTRIES]
    actors = [a.replace(" ", "") for a in V.PIPELINE_ACTORS]
    return F.coalesce(squeeze(country).isin(countries) & squeeze(actor).isin(actors), F.lit(False))


def is_valid_country(country: ColumnOrName) -> Column:
    """Country monitored, the accented spelling included."""
    plain = F.replace(F.lower(col(country)), F.lit("côte d'ivoire"), F.lit("cote d'ivoire"))
    return F.coalesce(plain.isin(V.PIPELINE_COUNTRIES), F.lit(False))


def has_words(c: Column, name: str) -> Column:
    """Question words of one topic inside an already lower-cased question."""
    return any_of([lower_contains_any(c, V.QUESTION_WORDS[name])])
