"""Search for any number of terms in whole texts, through an index of the terms.

A text is folded and split into words once. Its distinct words are looked up in the index; only what the index points at
is compared with the text itself. So the work per text depends on its words, not on the number of terms.

An index that travels (`few`) is a dictionary in Arrow tasks: words are looked up once per batch and remembered, and a text is
compared with its candidates in the row that has it. A larger one is joined with a row per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swaymeter.operators.lookup import MAX_LOOKUP

#: Characters of a term's longest word by which it is found inside words.
FRAGMENT = 3
NO_WORD = r"[^\p{L}\p{N}]+"
#: As NO_WORD, the underscore being part of words.
NO_BOUND = r"[^\p{L}\p{N}_]+"
#: Words that a task remembers with what the index has for them, and their longest; it changes the work, never the result.
SEEN, LONGEST = 200_000, 64


def _words(df: DataFrame, text: Column, split_at: str) -> DataFrame:
    """One row (id, _word) per distinct word of a text.

    The generator is an outer one because the optimiser would otherwise repeat the whole split in a filter before it. The
    text stays behind: a row per word must not carry it.
    """
    each = df.select("id", F.explode_outer(F.array_distinct(F.split(text, split_at))).alias("_word"))
    return each.where(F.col("_word") != "")


def _travels(index: DataFrame, few: bool | None) -> bool:
    return index.limit(MAX_LOOKUP + 1).count() <= MAX_LOOKUP if few is None else few


def _looked_up(probes: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return probes.distinct().join(index, key)


def _verified(found: DataFrame, df: DataFrame, text: Column, holds: Column, values: list[str]) -> DataFrame:
    """Candidates (id, _sure, values) whose text holds the term: candidates of an id come together, so that each text is
    fetched and folded once. The candidates, without texts, are kept for their two uses."""
    found = found.distinct().persist()
    unsure = found.where("not _sure").groupBy("id").agg(F.collect_set(F.struct(*values)).alias("_c"))
    read = df.join(unsure, "id").select("id", text.alias("_text"), "_c").select("id", "_text", F.explode_outer("_c").alias("_c"))
    return found.where("_sure").select("id", *values).unionByName(read.select("id", "_text", "_c.*").where(holds).select("id", *values)).distinct()


def _numbers(words: pa.Array, of: Callable[[str], tuple[int, ...]], seen: dict[str, tuple[int, ...]]) -> pa.Array:
    """For each list of words the distinct numbers that `of` gives for them, ascending; none for no list."""
    filled = words.fill_null([]) if words.null_count else words
    coded = pc.dictionary_encode(filled.flatten())
    numbers = []
    for word in coded.dictionary.to_pylist():
        found = seen.get(word)
        if found is None:
            found = of(word)
            if len(word) <= LONGEST:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[word] = found
        numbers.append(found)
    sizes = np.array([len(n) for n in numbers] or [0], np.int64)
    flat = np.array([k for n in numbers for k in n] or [0], np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes[code]) if len(code) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(words)), pc.list_value_length(filled).to_numpy(zero_copy_only=False))[at]
    hit = code[at]
    many, first = sizes[hit], (np.cumsum(sizes) - sizes)[hit]
    place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pairs = np.unique(np.stack([np.repeat(row, many), flat[place]]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(pairs[0], minlength=len(words)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pairs[1].astype(np.int32)))


def _numbered(spark: SparkSession, rows: list, index: DataFrame, columns: list[str]) -> DataFrame:
    """The collected rows of an index as a table that travels, with their numbers."""
    fields = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in columns)
    return F.broadcast(spark.createDataFrame([(k, *[r[c] for c in columns]) for k, r in enumerate(rows)], f"_k int, {fields}"))


def _held(candidates: pa.Array, texts: pa.Array, sure: np.ndarray, holds: Callable[[str, int], bool]) -> pa.Array:
    """The candidates (numbers for each text) that are sure or that the folded text holds."""
    numbers = candidates.flatten().to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(candidates.offsets.to_numpy()))
    keep = sure[numbers]
    at, folded = -1, ""
    for i in np.flatnonzero(~keep).tolist():
        if row[i] != at:
            at, folded = row[i], texts[int(row[i])].as_py().lower()
        keep[i] = holds(folded, int(numbers[i]))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(row[keep], minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers[keep]))


def _found(df: DataFrame, text: str, index: DataFrame, key: str, word: str, holds: Callable[[list], Callable[[str, int], bool]], values: list[str]) -> DataFrame:
    """(id, values) of the `index` rows (values, key, _sure) that a text holds, from one pass over the texts.

    A text is split at blanks; the words (`word`, a pattern) of its distinct parts are looked up, each part once as far as a
    task remembers. What is not `_sure` is held against the lower-cased text by `holds(rows)`.
    """
    rows = index.collect()
    in_words, test = _by_word(rows, key, word), holds(rows)
    sure = np.array([r["_sure"] for r in rows], bool)
    seen: dict[str, tuple[int, ...]] = {}

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        return _held(_numbers(pc.utf8_split_whitespace(texts), in_words, seen), texts, sure, test)

    # an outer generator, so that no filter repeats the search before it
    each = df.select("id", numbers(F.col(text)).alias("_n")).select("id", F.explode_outer("_n").alias("_k"))
    return each.join(_numbered(df.sparkSession, rows, index, values), "_k").select("id", *values)


def _by_word(rows: list, key: str, word: str) -> Callable[[str], tuple[int, ...]]:
    """The numbers of the rows whose key is a word (a match of `word`) of a part of a text, or, behind `^`, begins one."""
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        index.setdefault(r[key], []).append(k)
    starts = sorted({len(w) - 1 for w in index if w.startswith("^")})
    words = re.compile(word)

    def of(part: str) -> tuple[int, ...]:
        found = set()
        for w in words.findall(part.lower()):
            found.update(index.get("=" + w, ()), *[index.get("^" + w[:n], ()) for n in starts if len(w) >= n])
        return tuple(found)

    return of


def _stands(text: str, stem: str, prefix: bool) -> bool:
    """Whether a stem occurs as a whole word or phrase, open to the right for a prefix: what `_bounded` matches."""
    inside = lambda c: c == "_" or unicodedata.category(c)[0] in "LN"
    at = text.find(stem)
    while at >= 0:
        end = at + len(stem)
        if not (at and inside(text[at - 1])) and (prefix or end == len(text) or not inside(text[end])):
            return True
        at = text.find(stem, at + 1)
    return False


# ---- terms anywhere in a text --------------------------------------------
def substring_index(terms: DataFrame) -> DataFrame:
    """(group, term, spelled, piece, fragment) of terms (group, term).

    `piece` is the term's longest word: where the term occurs, one word of the text holds it, and so one of the fragments
    of that word is `fragment`, the first characters of the piece.
    """
    spelled = terms.select("group", "term", F.upper("term").alias("spelled")).where("spelled <> ''").distinct()
    by_length = F.transform(F.split("spelled", NO_WORD), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    longest = spelled.withColumn("piece", F.array_max(by_length)["w"])
    return longest.withColumn("fragment", F.substring("piece", 1, FRAGMENT))


def term_table(spark: SparkSession, terms: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(terms), "group string, term string")


def mentions(df: DataFrame, terms: DataFrame, text: str = "article_text", few: bool | None = None) -> DataFrame:
    """(id, group, term) for each of the `terms` (group, term) that occurs anywhere in the text, inside words as well,
    ignoring case. Rows with one id count as one; a NULL text or term holds nothing, an empty term is none.

    `few` says whether the index travels to the texts (by default where it has at most MAX_LOOKUP rows); if not, ids and
    words are shuffled. Terms that are no single word are then held against the texts of their candidates.
    """
    index = substring_index(terms).withColumn("_sure", F.col("piece") == F.col("spelled"))
    lengths = sorted(r["n"] for r in index.select(F.length("fragment").alias("n")).distinct().collect())  # 0 to FRAGMENT
    folded = F.upper(F.col(text))
    values = ["group", "term", "spelled"]
    holds = F.contains("_text", "spelled")
    keyed = index.where("fragment <> ''")
    if _travels(keyed, few):
        found = _pieces_found(df, folded, keyed, holds, values).persist()  # kept for both kinds of hits
        out = found.where("_sure").select("id", "group", "term").unionByName(found.where("not _sure").select("id", "group", "term")).distinct()
    else:
        out = _joined_mentions(df, folded, keyed, lengths, holds, values)
    if 0 in lengths:  # terms without a letter or digit: nothing to look up
        bare = index.where("fragment = ''").select("group", "term", "spelled")
        held = df.select("id", folded.alias("_text")).join(bare, F.contains("_text", "spelled")).select("id", "group", "term").distinct()
        out = out.unionByName(held)
    return out


def _by_fragment(rows: list) -> Callable[[str], tuple[int, ...]]:
    """The numbers of the rows whose piece a word holds, by the fragments of the word."""
    index: dict[str, list[tuple[str, int]]] = {}
    for k, r in enumerate(rows):
        index.setdefault(r["fragment"], []).append((r["piece"], k))
    lengths = sorted({len(f) for f in index})

    def of(word: str) -> tuple[int, ...]:
        parts = {word[i : i + n] for n in lengths for i in range(len(word) - n + 1)}
        return tuple(k for part in parts if part in index for piece, k in index[part] if piece in word)

    return of


def _pieces_found(df: DataFrame, folded: Column, index: DataFrame, holds: Column, values: list[str]) -> DataFrame:
    """Rows (id, _sure, values) of the `index` rows that a text holds, from one pass over the texts."""
    rows = index.collect()
    in_word = _by_fragment(rows)
    seen: dict[str, tuple[int, ...]] = {}

    @F.arrow_udf("array<int>")
    def numbers(words: pa.Array) -> pa.Array:
        return _numbers(words, in_word, seen)

    split = df.select("id", folded.alias("_text"), F.split(folded, NO_WORD).alias("_words"))
    each = split.select("id", "_text", numbers("_words").alias("_n")).select("id", "_text", F.explode_outer("_n").alias("_k"))
    return each.join(_numbered(df.sparkSession, rows, index, ["_sure", *values]), "_k").where(F.col("_sure") | holds).select("id", "_sure", *values)


def _joined_mentions(df: DataFrame, folded: Column, index: DataFrame, lengths: list[int], holds: Column, values: list[str]) -> DataFrame:
    """`mentions` of an index that does not travel."""
    words = _words(df, folded, NO_WORD)
    if lengths == [FRAGMENT]:
        words = words.where(F.length("_word") >= FRAGMENT)
        at = words.select("*", F.explode_outer(F.sequence(F.lit(1), F.length("_word") - (FRAGMENT - 1))).alias("_at"))
        probes = at.select("id", "_word", F.substring("_word", F.col("_at"), F.lit(FRAGMENT)).alias("fragment"))
    else:
        at = words.select("*", F.explode_outer(F.sequence(F.lit(1), F.length("_word"))).alias("_at"))
        at = at.select("*", F.explode_outer(F.array(*[F.lit(n) for n in lengths if n] or [F.lit(1)])).alias("_n"))
        probes = at.where(F.col("_at") + F.col("_n") <= F.length("_word") + 1).select("id", "_word", F.substring("_word", F.col("_at"), F.col("_n")).alias("fragment"))
    found = _looked_up(probes, index, "fragment").where(F.contains("_word", "piece")).select("id", "_sure", *values)
    return _verified(found, df, folded, holds, values).select("id", "group", "term")


def term_mentions(df: DataFrame, terms: Iterable[tuple[str, str]], text: str = "article_text") -> DataFrame:
    """`mentions` of terms given as (group, term) pairs."""
    return mentions(df, term_table(df.sparkSession, terms), text, few=True)


def word_mentions(df: DataFrame, terms: DataFrame, text: str = "article_text", few: bool | None = None) -> DataFrame:
    """(id, group, term) for the `terms` (group, term) whose first word is a word of the text and that occur in it, ignoring
    case. Rows with one id count as one. `few` as in `mentions`."""
    first = F.regexp_extract("spelled", r"([\p{L}\p{N}]+)", 1)
    index = terms.select("group", "term", F.lower("term").alias("spelled")).select("*", first.alias("_word")).where("_word <> ''").distinct()
    folded = F.lower(F.col(text))
    index = index.withColumn("_sure", F.col("_word") == F.col("spelled"))
    if _travels(index, few):
        keyed = index.withColumn("_probe", F.concat(F.lit("="), F.col("_word")))
        holds_term = lambda rows: lambda folded, k: rows[k]["spelled"] in folded
        return _found(df, text, keyed, "_probe", r"[^\W_]+", holds_term, ["group", "term"]).distinct()
    values = ["group", "term", "spelled"]
    found = _looked_up(_words(df, folded, NO_WORD), index, "_word").select("id", "_sure", *values)
    return _verified(found, df, folded, F.contains("_text", "spelled"), values).select("id", "group", "term")


# ---- boolean queries -----------------------------------------------------
def query_table(spark: SparkSession, queries: Mapping[str, tuple[Iterable[Iterable[str]], Iterable[str]]]) -> DataFrame:
    """(query, group, negated, term) of queries given as groups of words, of which one each has to occur, and words that
    must not occur."""
    rows = [(q, g, False, t) for q, (groups, _) in queries.items() for g, terms in enumerate(groups) for t in terms]
    rows += [(q, -1, True, t) for q, (_, none_of) in queries.items() for t in none_of]
    return spark.createDataFrame(rows, "query string, group int, negated boolean, term string")


def _bounded(stem: Column, prefix: Column) -> Column:
    """The pattern of a stem as a whole word (or phrase), open to the right for a prefix."""
    quoted = F.regexp_replace(stem, r"([^\p{L}\p{N}\s])", r"\\$1")
    right = F.when(prefix, F.lit("")).otherwise(F.lit(r"(?![\p{L}\p{N}_])"))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, right)


def query_index(queries: DataFrame) -> DataFrame:
    """The terms of `queries` (query, group, negated, term) with the word by which each is looked up.

    `probe` is the term's first word behind `=`, or behind `^` where the word may go on; `sure` terms need no more than
    that; the others are held against the text by `pattern`. Terms without a letter or digit match nothing.
    """
    stem = F.lower(F.btrim(F.regexp_replace("term", r"\*+$", "")))
    terms = queries.select("query", "group", "negated", stem.alias("stem"), F.col("term").endswith("*").alias("prefix"))
    first = F.regexp_extract("stem", r"[\p{L}\p{N}_]+", 0)
    open_end = F.col("prefix") & F.endswith("stem", "first") & (F.col("rest") == "")
    terms = terms.withColumn("first", first).withColumn("rest", F.regexp_extract("stem", r"[\p{L}\p{N}_]+(.*)$", 1))
    probe = F.concat(F.when(open_end, "^").otherwise("="), F.col("first"))
    keyed = terms.where("first <> ''").select("query", "group", "negated", probe.alias("probe"), (F.col("first") == F.col("stem")).alias("sure"),
                                               _bounded(F.col("stem"), F.col("prefix")).alias("pattern"), "stem", "prefix")
    return keyed.distinct()


def _joined_hits(df: DataFrame, folded: Column, index: DataFrame, holds: Column, values: list[str]) -> DataFrame:
    """The terms that texts hold, of an index that does not travel."""
    open_lengths = index.where(F.col("probe").startswith("^")).select((F.length("probe") - 1).alias("n")).distinct()
    lengths = sorted(r["n"] for r in open_lengths.collect())  # of words
    words = _words(df, folded, NO_BOUND)
    exact = F.concat(F.lit("="), F.col("_word"))
    starts = [F.when(F.length("_word") >= n, F.concat(F.lit("^"), F.substring("_word", 1, n))) for n in lengths]
    if lengths:
        probes = words.select("id", F.explode_outer(F.array(exact, *starts)).alias("probe")).where("probe is not null")
    else:
        probes = words.select("id", exact.alias("probe"))
    found = _looked_up(probes, index, "probe").select("id", "_sure", *values, "pattern")
    return _verified(found, df, folded, holds, [*values, "pattern"]).select("id", *values)


def percolate(df: DataFrame, queries: DataFrame, text: str = "article_text", few: bool | None = None) -> DataFrame:
    """(id, query) for every query that a text answers: a term of each of its groups occurs as a word or phrase, and none
    of its negated terms, ignoring case; a trailing `*` leaves the last word open.

    All queries are answered in one pass: the distinct words of a text (and their beginnings, in the lengths that open
    terms have) are looked up in the index of terms, and per text and query the satisfied groups are counted. A query
    without a group that has to occur is answered by no text, and neither is any by a NULL text. Rows with one id count as
    one. `few` as in `mentions`.
    """
    index = query_index(queries).withColumnRenamed("sure", "_sure")
    values = ["query", "group", "negated"]
    if _travels(index, few):
        stands = lambda rows: lambda folded, k: _stands(folded, rows[k]["stem"], rows[k]["prefix"])
        hits = _found(df, text, index, "probe", r"\w+", stands, values)
    else:
        hits = _joined_hits(df, F.lower(F.col(text)), index, F.rlike("_text", "pattern"), values)
    groups = hits.distinct().groupBy("id", "query").agg(F.count_if(~F.col("negated")).alias("_have"), F.max("negated").alias("_barred"))
    needed = queries.where("not negated").groupBy("query").agg(F.count_distinct("group").alias("_needed"))
    answered = groups.where("not _barred").join(needed, "query").where(F.col("_have") == F.col("_needed"))
    return answered.select("id", "query")


def percolate_grid(stories: DataFrame, queries: DataFrame, actors: Iterable[str], actor: str, text: str = "article_text") -> DataFrame:
    """(id, actor column, target): stories of each actor's collection that answer each target's query."""
    own = stories.where(F.col(actor).isin(list(actors)))
    found = percolate(own, queries, text).withColumnRenamed("query", "target")
    return own.select("id", actor).distinct().join(found, "id").select("id", actor, "target")
