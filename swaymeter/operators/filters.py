"""Row predicates over the narratives table. Each returns a boolean column for `filter`."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import (ColumnOrName, all_of, any_of, bind, col, contains_any, icontains, iexact,
                                      lower_contains_any, missing, not_in, present, strip)
from swaymeter.functions.text import is_corrupt


def matching(df: DataFrame, country: str | None = None, actor: str | None = None,
             intent: str | None = None) -> DataFrame:
    """Rows of one country, actor and intent; an empty argument means no restriction."""
    for name, value in (("target_country", country), ("inferred_actor", actor), ("strategic_intent", intent)):
        if value:
            df = df.filter(iexact(name, value))
    return df


def without_words(df: DataFrame, words: Iterable[str], text: ColumnOrName = "article_text") -> DataFrame:
    """Drop rows whose text holds one of the words; rows without a text stay."""
    return df.filter(~F.coalesce(contains_any(text, words, in_engine=True), F.lit(False)))


def monitored(country: ColumnOrName = "target_country") -> Column:
    return col(country).isin(V.MONITORED_COUNTRIES)


def no_placeholder(c: ColumnOrName, values: Iterable[str] = V.PLACEHOLDERS, drop_null: bool = False) -> Column:
    return not_in(c, values, drop_null)


def foreign(actor: ColumnOrName = "inferred_actor") -> Column:
    return not_in(actor, V.LOCAL_ACTORS)


def needs_intent(intent: ColumnOrName = "strategic_intent", text: ColumnOrName = "article_text") -> Column:
    """Intent missing while there is a real text to label."""
    return missing(intent) & present(text) & ~iexact(text, V.NO_CONTENT)


def needs_processing() -> Column:
    """Text, country and actor are there, the country is monitored, and a label is missing."""
    return (present("article_text") & present("target_country") & present("inferred_actor") & monitored()
            & (missing("strategic_intent") | missing("tone")))


LABEL_COLUMNS = ["strategic_intent", "tone", "target_country", "inferred_actor"]


def unlabelled() -> Column:
    return any_of(F.col(c).isNull() for c in LABEL_COLUMNS)


def labelled() -> Column:
    return all_of(F.col(c).isNotNull() for c in LABEL_COLUMNS)


def null_or_iexact(c: ColumnOrName, values: Iterable[str]) -> Column:
    return col(c).isNull() | F.upper(col(c)).isin([v.upper() for v in values])


def between_days(c: ColumnOrName, start: str | None, end: str | None) -> Column:
    """Inclusive range of UTC days; a bound that is no ISO date is ignored.

    Written as a timestamp range, so that it reaches the parquet scan.
    """
    bounds = []
    if first := real_day(start):
        bounds.append(col(c) >= F.to_timestamp(F.lit(first)))
    if last := real_day(end):
        bounds.append(col(c) < F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 1)))
    return all_of(bounds)


def real_day(value: str | None) -> str | None:
    """The day as `yyyy-MM-dd`, None for what is no day."""
    found = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", value or "")
    try:
        return datetime.date(*map(int, found.groups())).isoformat() if found else None
    except ValueError:
        return None


def since(c: ColumnOrName, as_of: str | Column, days: int) -> Column:
    """Not older than `days` days before `as_of`."""
    now = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return col(c) >= now - F.make_interval(days=F.lit(days))


def valid_author(author: ColumnOrName = "author") -> Column:
    a = col(author)
    return (a.isNotNull() & ~a.isin(V.PLACEHOLDER_AUTHORS) & ~a.rlike("^https?://")
            & a.rlike(r"^[A-Za-z\s.'-]+$"))


def listed_author(author: ColumnOrName = "author") -> Column:
    """Valid and longer than two characters."""
    return valid_author(author) & (F.length(strip(author)) > 2)


def null_like(c: ColumnOrName) -> Column:
    """NULL, blank or one of the spellings of "nothing"."""
    text = F.lower(strip(c))
    return F.coalesce(text, F.lit("")).isin(["", *V.NULL_LIKE_INTENTS])


def longer_than(c: ColumnOrName, n: int) -> Column:
    return F.length(col(c)) > n


def scrape_ok(text: ColumnOrName, strict: bool = False) -> Column:
    """No stored error message: by prefix, or (strict) anywhere in the text."""
    t = col(text)
    if strict:
        return ~F.contains(t, F.lit("Failed")) & ~F.contains(t, F.lit("Error"))
    return ~any_of(F.startswith(t, F.lit(p)) for p in V.CORRUPT_PREFIXES)


def relevant(text: ColumnOrName, target: ColumnOrName) -> Column:
    """The target's name occurs in the text; an empty side means no."""
    hit = F.contains(F.lower(col(text)), F.lower(col(target)))
    return F.coalesce(present(text) & present(target) & hit, F.lit(False))


def mentions_no_target(text: ColumnOrName = "article_text",
                       terms: Mapping[str, Iterable[str]] = V.TARGET_TERMS) -> Column:
    """The text names no target country: for each country, none of its terms."""
    every_term = [t for group in terms.values() for t in group]
    return ~contains_any(text, every_term)


def old_without_target(cutoff: str, time: ColumnOrName = "posting_time", text: ColumnOrName = "article_text",
                       terms: Mapping[str, Iterable[str]] = V.TARGET_TERMS) -> Column:
    return (col(time) < F.to_timestamp(F.lit(cutoff))) & mentions_no_target(text, terms)


def term_outside_country(term: str, countries: Iterable[str], text: ColumnOrName = "article_text",
                         country: ColumnOrName = "target_country") -> Column:
    """Text holds the term and the country is known and not one of these."""
    return icontains(text, term) & ~col(country).isin(list(countries))


def search(query: str, *columns: ColumnOrName) -> Column:
    return any_of(F.coalesce(icontains(c, query), F.lit(False)) for c in columns) if query else F.lit(True)


def _stem(term: str) -> str:
    return term.rstrip("*").strip().lower()


def _term_regex(terms: Iterable[str]) -> str:
    """One word-bounded alternation; a trailing `*` leaves the word open to the right."""
    parts = [re.escape(_stem(t)) + ("" if t.endswith("*") else r"(?![\p{L}\p{N}_])") for t in terms]
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(parts) + ")"


def keyword_query(text: ColumnOrName, all_groups: Iterable[Iterable[str]],
                  none_of: Iterable[str] = ()) -> Column:
    """A word of every group occurs in the text, and none of the forbidden ones.

    A plain search for the words comes before the regular expression that checks the word
    bounds, so texts without any of the words never reach it.
    """
    none_of = list(none_of)

    def has(t: Column, terms: Iterable[str]) -> Column:
        terms = list(terms)
        return lower_contains_any(t, [_stem(w) for w in terms]) & t.rlike(_term_regex(terms))

    def check(t: Column) -> Column:
        hit = all_of(has(t, g) for g in all_groups)
        return hit & ~has(t, none_of) if none_of else hit

    return F.coalesce(bind(F.lower(col(text)), check), F.lit(False))


def tuple_tone(c: ColumnOrName = "tone") -> Column:
    return F.startswith(col(c), F.lit("("))


def has_label(c: ColumnOrName) -> Column:
    """Neither missing nor one of unknown / none / null."""
    return ~F.lower(F.coalesce(col(c), F.lit(""))).isin(V.SKIP_LABELS)


def lacks_author(author: ColumnOrName = "author", url: ColumnOrName = "url", include_null: bool = False) -> Column:
    empty = F.coalesce(col(author).isin(V.PLACEHOLDERS), F.lit(include_null))
    return empty & present(url)


def corrupt(text: ColumnOrName = "article_text") -> Column:
    return is_corrupt(text)
