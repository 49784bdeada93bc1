"""Text, date, url and reply functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import WHITESPACE, ColumnOrName, any_of, bind, blank_to_null, col, missing, strip

ELLIPSIS = "…"


# ---- cutting -------------------------------------------------------------
def model_input(text: ColumnOrName, size: int = 4000) -> Column:
    """Stripped text of at most `size` characters; missing text is empty."""
    return F.substring(strip(F.coalesce(col(text), F.lit(""))), 1, size)


LINE_BREAK = r"[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029][\s\p{Z}\u001C-\u001F\u0085]*"
BLANKS = r"[\s\p{Z}\u001C-\u001F\u0085]+"
#: Characters of a text in which its first parts are looked for before the whole text is.
OPENING = 1024


def _first_parts(text: Column, pattern: str, n: int) -> Column:
    """First n parts between separators, and what follows them (at least its start) as part n + 1, if any.

    Parts may end in whitespace. A separator takes in all whitespace behind it, so the opening of a text that shows something
    behind n separators has the same first n parts as the whole text, which is split only if it is longer and does not.
    """
    def parts(t: Column) -> Column:
        return F.filter(F.split(F.ltrim(t, F.lit(WHITESPACE)), pattern, n + 1), lambda x: x != "")

    opening = bind(parts(F.substring(text, 1, OPENING)),
                   lambda found: F.when((F.size(found) > n) | (F.length(text) <= OPENING), found))
    return F.coalesce(opening, parts(text))


def first_lines(text: ColumnOrName, n: int) -> Column:
    """The first n lines that are not blank, without outer whitespace."""
    return bind(col(text), lambda t: F.transform(F.slice(_first_parts(t, LINE_BREAK, n), 1, n), strip))


def truncate_words(text: ColumnOrName, n: int, mark: str = " " + ELLIPSIS) -> Column:
    """First `n` words, with an ellipsis if there were more."""
    def shorten(w: Column) -> Column:
        return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(mark))).otherwise(F.array_join(w, " "))

    return bind(col(text), lambda t: bind(_first_parts(t, BLANKS, n), shorten))


def display_title(text: ColumnOrName) -> Column:
    """First of three lines that reads like a title, else the first 20 words."""
    def title(lines: Column) -> Column:
        candidates = F.filter(lines, lambda x: F.length(x).between(5, 250) & ~x.rlike(V.METADATA_LINE))
        return F.when(F.size(lines) == 0, F.lit("Empty Article")).otherwise(F.try_element_at(candidates, F.lit(1)))

    return bind(col(text), lambda t: F.when(missing(t), F.lit("No Content Available")).otherwise(
        F.coalesce(bind(first_lines(t, 3), title), truncate_words(t, 20, "..."))))


def simple_title(text: ColumnOrName, size: int = 100) -> Column:
    line = F.try_element_at(first_lines(text, 1), F.lit(1))
    return F.coalesce(F.substring(line, 1, size), F.lit("No Title Available"))


def display_summary(text: ColumnOrName, size: int = 500) -> Column:
    """Whole text when short, else cut at the last blank before `size`."""
    def shorten(flat: Column) -> Column:
        head = F.substring(flat, 1, size)
        to_blank = F.regexp_extract(head, r"(?s)^(.*) ", 1)
        cut = F.when(F.length(to_blank) > 0, to_blank).otherwise(head)
        return F.when(F.length(flat) > size, F.concat(cut, F.lit(ELLIPSIS))).otherwise(flat)

    return bind(strip(F.replace(col(text), F.lit("\n"), F.lit(" "))), shorten)


def narrative_summary(notes: ColumnOrName, strategy: ColumnOrName, intent: ColumnOrName,
                      text: ColumnOrName) -> Column:
    head = F.concat(F.substring(col(text), 1, 100), F.lit("..."))
    return F.coalesce(blank_to_null(notes), blank_to_null(strategy), blank_to_null(intent),
                      F.when(~missing(text), head), F.lit("No summary available"))


def snippet(text: ColumnOrName, size: int) -> Column:
    return F.translate(F.substring(col(text), 1, size), "\n", " ")


def source_line(outlet: ColumnOrName, actor: ColumnOrName, intent: ColumnOrName, text: ColumnOrName,
                size: int = 450) -> Column:
    """One line of evidence: source, actor, intent and the start of the text."""
    def shown(c: ColumnOrName) -> Column:
        return F.coalesce(col(c), F.lit("None"))

    return F.concat(F.lit("SOURCE: "), shown(outlet), F.lit(" | ACTOR: "), shown(actor),
                    F.lit(" | INTENT: "), shown(intent), F.lit(" | TEXT: "),
                    F.coalesce(snippet(text, size), F.lit("")))


def summary_guard(text: ColumnOrName, size: int = 200) -> Column:
    """A message instead of a summary for texts that are too short, else NULL."""
    short = missing(text) | (F.length(strip(text)) < size)
    return F.when(short, F.lit(V.TOO_SHORT_SUMMARY))


def detect_french(text: ColumnOrName, size: int | None = 512) -> Column:
    """`fr` if more than 3 of the French words stand alone in the opening of `size` characters, else `en`.

    The rule to be matched reads 512 characters; None reads the whole text.
    """
    whole = F.coalesce(col(text), F.lit(""))
    if size is None:
        hits = count_alone(whole, V.FRENCH_WORDS)
    else:
        head = F.substring(F.lower(F.substring(whole, 1, size)), 1, size)
        hits = bind(F.concat(F.lit(" "), head, F.lit(" ")), lambda t: sum(
            (F.contains(t, F.lit(f" {w} ")).cast("int") for w in V.FRENCH_WORDS), F.lit(0)))
    return F.when(hits > 3, F.lit("fr")).otherwise(F.lit("en"))


def count_alone(text: Column, words: Iterable[str]) -> Column:
    """How many of the (lower-case) words stand between spaces or ends of a text, ignoring case; NULL holds none.

    The words of a whole text are compared as numbers of 8 bytes, so the number of words sought does not matter.
    """
    sought = sorted(set(words))
    if any(not w or " " in w or len(w.encode()) > 8 for w in sought):
        raise ValueError("words of 1 to 8 bytes without a space")
    # only ASCII letters fold to ASCII letters, but for the Kelvin sign
    bytewise = all(w.isascii() and "k" not in w for w in sought)
    pairs = sorted((int.from_bytes(w.encode(), "little"), len(w.encode())) for w in sought)
    keys, sizes = np.array([k for k, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // WORD_BYTES)) + 1).tolist(), len(texts)]  # a bounded number of bytes at once
        found = [_alone(texts[i:j], keys, sizes, bytewise) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array(np.concatenate(found).astype(np.int32))

    return count(F.concat(F.lit(" "), F.coalesce(text if bytewise else F.lower(text), F.lit("")), F.lit(" ")))


#: Bytes of text whose words are compared at once.
WORD_BYTES = 1 << 22


def _alone(texts: pa.Array, keys: np.ndarray, sizes: np.ndarray, fold: bool) -> np.ndarray:
    """For each text (with a space at either end) the number of different words (keys of so many bytes) that it has."""
    seen = np.zeros((len(texts), len(keys)), bool)
    if not len(texts) or not len(keys):
        return seen.sum(axis=1)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if fold:
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    spaces = np.flatnonzero(data == 32)
    size = np.diff(spaces) - 1
    short = np.flatnonzero((size > 0) & (size <= sizes.max()))
    first, size = spaces[short] + 1, size[short]
    word = np.zeros(len(first), np.uint64)
    for i in range(int(sizes.max())):  # a word ends before the last byte, which is a space
        word |= np.where(i < size, data[np.minimum(first + i, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * i)
    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
    hit = (keys[at] == word) & (sizes[at] == size)
    seen[np.searchsorted(offsets - offsets[0], first[hit], side="right") - 1, at[hit]] = True
    return seen.sum(axis=1)


def is_corrupt(text: ColumnOrName) -> Column:
    """Missing, blank or a stored error message instead of an article."""
    t = col(text)
    return (t.isNull() | (F.trim(t) == "") | any_of(F.startswith(t, F.lit(p)) for p in V.CORRUPT_PREFIXES)
            | t.isin(V.CORRUPT_TEXTS))


# ---- casts and dates -----------------------------------------------------
def safe_double(c: ColumnOrName, default: float | None = None) -> Column:
    value = strip(c).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def safe_int(c: ColumnOrName, default: int | None = None) -> Column:
    text = strip(c)
    value = F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def safe_bool(c: ColumnOrName, true_values: Sequence[str] = ("true",)) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(list(true_values)), F.lit(False))


def parse_timestamp(c: ColumnOrName, formats: Sequence[str] = V.STORY_FORMATS) -> Column:
    """First format that fits."""
    text = strip(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def date_in_text(text: ColumnOrName, size: int | None = 300) -> Column:
    """Date written near the start of a text (the rule to be matched reads 300 characters; None: anywhere).

    The first of three patterns that occurs decides. Numeric dates are read day first,
    with day and month swapped where that is the only valid reading.
    """
    head = col(text) if size is None else F.substring(col(text), 1, size)
    numeric = F.regexp_extract(head, V.NUMERIC_DATE, 1)
    month_first = F.regexp_extract(head, V.MONTH_FIRST_DATE, 1)
    day_first = F.regexp_extract(head, V.DAY_FIRST_DATE, 1)

    def read(c: Column, *formats: str) -> Column:
        return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])

    def month_name(c: Column) -> Column:
        return F.regexp_replace(F.initcap(F.lower(c)), r"\bSept\b", "Sep")

    slashed = F.replace(numeric, F.lit("-"), F.lit("/"))
    return (F.when(numeric != "", read(slashed, "d/M/yyyy", "M/d/yyyy"))
            .when(month_first != "", read(month_name(month_first), "MMMM d, yyyy", "MMM d, yyyy"))
            .when(day_first != "", read(month_name(day_first), "d MMMM yyyy", "d MMM yyyy")))


def format_day(c: ColumnOrName, pattern: str = "yyyy-MM-dd", default: str = "Unknown") -> Column:
    return F.coalesce(F.date_format(col(c), pattern), F.lit(default))


def format_decimal(c: ColumnOrName, places: int) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(col(c), places)


def get_or_zero(m: ColumnOrName, key: ColumnOrName) -> Column:
    return F.coalesce(F.try_element_at(col(m), col(key)), F.lit(0))


def label_or(c: ColumnOrName, default: str) -> Column:
    return F.initcap(F.coalesce(blank_to_null(c), F.lit(default)))


# ---- urls ----------------------------------------------------------------
def absolute_url(url: ColumnOrName, base: ColumnOrName) -> Column:
    """Full url of a link found on the page `base`."""
    u, b = col(url), col(base)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.when(page.rlike(r"://[^/]*/"), F.regexp_replace(page, r"[^/]*$", "")).otherwise(F.concat(page, F.lit("/")))

    def without_dots(address: Column) -> Column:
        """`.` and `..` segments of the path resolved; query and fragment stay."""
        return bind(address, resolved)

    def resolved(full: Column) -> Column:
        start = F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        path = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        rest = F.regexp_extract(full, r"([?#].*)$", 1)
        parts = F.filter(F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/"), lambda x: x != ".")
        done = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(
            x == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)).otherwise(F.array_append(out, x)))
        return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(start, F.array_join(done, "/"), rest)).otherwise(full)

    return (F.when(missing(u), F.lit(None).cast("string"))
            .when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u))
            .when(u.rlike("^https?://"), u)
            .when(F.startswith(u, F.lit("?")), F.concat(page, u))
            .when(F.startswith(u, F.lit("#")), F.concat(F.regexp_replace(b, r"#.*$", ""), u))
            .otherwise(without_dots(F.concat(F.when(F.startswith(u, F.lit("/")), root).otherwise(folder), u))))


def url_path(url: ColumnOrName) -> Column:
    """Lower-cased path of a url, without query and fragment."""
    bare = F.regexp_replace(F.lower(col(url)), r"[?#].*$", "")
    return F.regexp_replace(bare, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/]*", "")


def is_image_url(url: ColumnOrName) -> Column:
    def holds(path: Column) -> Column:
        ends = path.rlike(r"\.(?:" + "|".join(V.IMAGE_EXTENSIONS) + ")$")
        return ends | any_of(F.contains(path, F.lit(m)) for m in V.IMAGE_PATH_MARKERS)

    return bind(col(url), lambda u: F.coalesce(~missing(u) & bind(url_path(u), holds), F.lit(False)))


def is_meaningful_image(url: ColumnOrName) -> Column:
    low = F.lower(col(url))
    return F.coalesce(~missing(url) & ~any_of(F.contains(low, F.lit(w)) for w in V.IMAGE_STOP_WORDS), F.lit(False))


# ---- model replies -------------------------------------------------------
REPLY_SCHEMA = "strategic_intent string, strategic_intent_conf string, notes string"


def parse_reply(reply: ColumnOrName) -> Column:
    """(intent, conf, notes) of a model reply.

    The last brace block counts. A block (or, without any block, the reply) that is no
    valid JSON is searched for the three fields one by one.
    """
    raw = strip(reply)
    blocks = F.regexp_extract_all(raw, F.lit(r"(?s)(\{.*?\})"), F.lit(1))
    last = F.try_element_at(blocks, F.lit(-1))
    return bind(F.struct(F.coalesce(last, raw).alias("text"), last.isNotNull().alias("is_block")), _read_reply)


def _read_reply(found: Column) -> Column:
    source = found["text"]

    def field(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), F.lit(1))

    def answer(intent: Column, conf: Column, notes: Column) -> Column:
        return F.struct(F.coalesce(intent, F.lit("Neutral")).alias("intent"),
                        F.coalesce(conf.try_cast("double"), F.lit(0.0)).alias("conf"), notes.alias("notes"))

    no_notes = F.when(found["is_block"], F.lit("Extracted via Regex from block")).otherwise(F.lit("Extracted via Regex"))
    loose = answer(field(V.INTENT_FIELD), field(V.CONF_FIELD), F.coalesce(field(V.NOTES_FIELD), no_notes))
    strict = bind(F.from_json(source, REPLY_SCHEMA), lambda p: answer(
        p["strategic_intent"], p["strategic_intent_conf"], F.coalesce(p["notes"], F.lit(""))))
    # json_object_keys is NULL unless the text is one valid JSON object
    return F.when(F.json_object_keys(source).isNotNull(), strict).otherwise(loose)
