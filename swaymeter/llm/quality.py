"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaymeter.llm.common import SPACE, free_names, pick, quoted, words


class Rule(NamedTuple):
    """A document fails the rule when `metric` lies outside [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: Published limits for web text (word length, symbols per word, stop words, line shapes), eased where short or
#: compound-rich languages need it.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_ratio", 0.01, None),
    Rule("bullets", "bullet_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_ratio", None, 0.3),
    Rule("same_lines", "dup_line_ratio", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•", "‣", "●")
ELLIPSES = ("...", "…")
# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "on", "are", "with", "as", "be", "at", "this", "from", "by", "or", "an", "a", "it",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "est", "dans", "pour", "par", "sur", "pas", "au",
    "der", "die", "das", "und", "von", "zu", "den", "mit", "im", "ist", "des", "dem", "nicht", "ein", "eine", "als", "auf", "sich", "auch", "es",
    "el", "los", "las", "y", "del", "se", "con", "no", "su", "para", "al", "lo", "como",
)


def _marked(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` plus one struct column `quality` with the counts the rules read.

    words are `[^\\x20\\x09-\\x0D]+`. n_repeat_words counts the words that lie in some 3-word window found at least
    twice in the text, exactly: window hashes only tell whether a text can have such windows at all. A null text has
    no words; an empty table gives an empty table; a repeated row gets the same counts again.
    """
    t, w, h, s, p, ln, m = free_names(docs, "qt", "qw", "qh", "qs", "qp", "qlines", "quality")
    cols = [quoted(c) for c in docs.columns]
    c = quoted
    blank = " " + SPACE[1:]
    step = docs.select(*cols, F.coalesce(c(text_col), F.lit("")).alias(t))
    step = step.select(*cols, c(t), words(c(t)).alias(w), F.filter(F.split(c(t), "\n"), lambda x: F.btrim(x, F.lit(blank)) != "").alias(ln))
    starts = F.when(F.size(c(w)) >= 3, F.sequence(F.lit(0), F.size(c(w)) - 3)).otherwise(F.array().cast("array<int>"))
    step = step.select("*", F.transform(starts, lambda i: F.xxhash64(F.get(c(w), i), F.get(c(w), i + 1), F.get(c(w), i + 2))).alias(h))
    window = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(c(w), i), F.get(c(w), i + 1), F.get(c(w), i + 2)).alias("g"), i.alias("i")))
    none = F.array().cast("array<struct<g:string,i:int>>")
    step = step.select(*cols, c(t), c(w), c(ln), F.when(F.size(F.array_distinct(c(h))) < F.size(c(h)), F.sort_array(window)).otherwise(none).alias(s))
    again = F.filter(c(s), lambda x, k: (x["g"] == F.get(c(s), k - 1)["g"]) | (x["g"] == F.get(c(s), k + 1)["g"]))
    step = step.select(*cols, c(t), c(w), c(ln), F.array_sort(F.transform(again, lambda x: x["i"])).alias(p))
    covered = F.aggregate(F.transform(c(p), lambda x, k: F.least(F.lit(3), F.get(c(p), k + 1) - x)), F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        F.size(c(w)).cast("long").alias("n_words"),
        F.length(F.translate(c(t), SPACE, "")).cast("long").alias("word_chars"),
        (F.length(c(t)) - F.length(F.translate(c(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(c(ln)) - F.size(F.array_distinct(c(ln)))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter(c(w), lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(c(ln)).cast("long").alias("n_lines"),
        _marked(c(ln), lambda x: F.substring(F.btrim(x, F.lit(blank)), 1, 1).isin(*BULLETS)).cast("long").alias("n_bullet_lines"),
        _marked(c(ln), lambda x: _ends(F.btrim(x, F.lit(blank)))).cast("long").alias("n_ellipsis_lines"),
    )
    return step.select(*cols, counts.alias(m))


def _ends(line: Column) -> Column:
    return line.endswith(ELLIPSES[0]) | line.endswith(ELLIPSES[1])


def ratios(q: Column) -> dict[str, Column]:
    """The ratios a rule may name, from the counts; a text without words (or lines) has ratio 0 throughout."""
    per = lambda part, whole: F.when(q[whole] > 0, q[part] / q[whole]).otherwise(F.lit(0.0))
    return {
        "n_words": q["n_words"].cast("double"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "bullet_ratio": per("n_bullet_lines", "n_lines"),
        "ellipsis_ratio": per("n_ellipsis_lines", "n_lines"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }


def failures(q: Column, rules=RULES) -> Column:
    """The names of the failed rules, as an array: the threshold table as one expression."""
    have, checks = ratios(q), []
    for rule in rules:
        value, bad = have[rule.metric], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*checks))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def judge(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """All columns of `docs` plus the struct `verdict`: counts, base_failed, failed_rules, kept.

    The name gets leading underscores where `docs` already has such a column; it is always the last one.
    """
    measured = measures(docs, text_col)
    name, row = free_names(measured, "verdict", "row")
    # the optimiser does not move a filter below a row number, so that the counts are never written out inside a filter
    numbered = measured.select("*", F.monotonically_increasing_id().alias(row))
    q = quoted(measured.columns[-1])
    failed = failures(q, rules)
    fields = [q[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    kept = ~base_failed(q) & (F.size(failed) == 0) & (quoted(row) >= 0)
    verdict = F.struct(*fields, base_failed(q).alias("base_failed"), failed.alias("failed_rules"), kept.alias("kept"))
    return numbered.select(*(quoted(c) for c in docs.columns), verdict.alias(name))


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass the rules, columns unchanged."""
    judged = judge(docs, rules, text_col)
    return judged.where(quoted(judged.columns[-1])["kept"]).select(*(quoted(c) for c in docs.columns))


def op3_quality_rules(docs: DataFrame) -> DataFrame:
    judged = judge(pick(docs, doc_id="doc_id", text="text"))
    v = F.col("verdict")
    return judged.select("doc_id", *(v[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
