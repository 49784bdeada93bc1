"""The rules for missing values, case and order that every operator shares."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# The characters that count as whitespace
WHITESPACE = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: ColumnOrName) -> Column:
    """Trim every kind of Unicode whitespace at both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` mentions it.

    Worth it where the value is costly (case folding of a whole text, parsing) or where
    repeating it would blow up the generated code.
    """
    return F.transform(F.array(value), use)[0]


def missing(c: ColumnOrName) -> Column:
    """NULL or empty string."""
    return F.coalesce(col(c), F.lit("")) == ""


def present(c: ColumnOrName) -> Column:
    return ~missing(c)


def blank_to_null(c: ColumnOrName) -> Column:
    return F.when(present(c), col(c))


def iexact(c: ColumnOrName, value: str | Column) -> Column:
    """Case-insensitive equality: no trimming, no accent folding."""
    return F.upper(col(c)) == F.upper(value if isinstance(value, Column) else F.lit(value))


def icontains(c: ColumnOrName, value: str | Column) -> Column:
    """Case-insensitive substring; `%`, `_` and `\\` have no special meaning."""
    return F.contains(F.upper(col(c)), F.upper(value if isinstance(value, Column) else F.lit(value)))


def shortest_terms(terms: Iterable[str]) -> list[str]:
    """Drop terms containing another term: they cannot change an any-of-these answer."""
    unique = list(dict.fromkeys(t.upper() for t in terms))
    return [t for t in unique if not any(o != t and o in t for o in unique)]


#: Terms beyond which a text is searched in Python, whose search for one term passes over a text several times as fast.
FEW_TERMS = 8


def holds_any(text: Column, terms: Iterable[str]) -> Column:
    """True if the text holds one of the terms as it is spelled; NULL text gives NULL."""
    words = list(terms)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        spelled = (t.as_py() for t in texts)
        return pa.array([None if t is None else any(w in t for w in words) for t in spelled], pa.bool_())

    return found(text)


def contains_any(c: ColumnOrName, terms: Iterable[str], in_engine: bool = False) -> Column:
    """True if the text holds one of the terms, ignoring case. NULL text gives NULL.

    The text is folded once; plain searches for the terms end at the first hit. `in_engine` keeps long lists out of Python too.
    """
    words = shortest_terms(terms)
    if not words:
        return F.lit(False)
    if len(words) > FEW_TERMS and not in_engine:
        return holds_any(F.upper(col(c)), words)
    return bind(F.upper(col(c)), lambda t: any_of(F.contains(t, F.lit(w)) for w in words))


def lower_contains_any(c: ColumnOrName, terms: Iterable[str]) -> Column:
    """Like `contains_any` on an already lower-cased column."""
    return any_of(F.contains(col(c), F.lit(t)) for t in terms)


def not_in(c: ColumnOrName, values: Iterable[str], drop_null: bool = False) -> Column:
    """Exclusion that keeps NULL rows unless `drop_null`."""
    c = col(c)
    outside = ~c.isin(list(values))
    return outside if drop_null else (c.isNull() | outside)


def newest_first(c: ColumnOrName) -> Column:
    """Descending with NULL first."""
    return col(c).desc_nulls_first()


def first_match(subject: Column, rules: Iterable[tuple[str, Iterable[str]]], default: Column) -> Column:
    """Value of the first rule with a word inside `subject`."""
    out = None
    for value, words in rules:
        hit = lower_contains_any(subject, words)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return default if out is None else out.otherwise(default)


def map_of(values: Mapping[str, object]) -> Column:
    """A literal map of a Python mapping (for small fixed tables)."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def look_up(key: Column, values: Mapping[str, object]) -> Column:
    """Value for `key`, NULL when absent or when the key is NULL."""
    return F.when(key.isNotNull(), F.try_element_at(map_of(values), F.coalesce(key, F.lit(""))))


def clip01(x: ColumnOrName) -> Column:
    """Limit to 0..1; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def title_case(c: ColumnOrName) -> Column:
    return F.initcap(F.lower(col(c)))


def to_day(c: ColumnOrName) -> Column:
    """UTC date of a timestamp (the session time zone must be UTC)."""
    return F.to_date(col(c))
