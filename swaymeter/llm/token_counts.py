"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies; ids are never made."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swaymeter.llm.common import new_folder, quoted

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose piece counts travel with every task: the most widespread ones, at most HEAD of at most HEAD_BYTES
#: each (so 262,144 * 32 bytes at the very most). All others are joined.
HEAD, HEAD_BYTES = 262_144, 32
#: Distinct entries a task holds before it hands them on.
FLUSH = 200_000
# fixed values: the contractions that the vocabulary's splitter knows
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters for which normalising is lower-casing and nothing else, so that splitting needs no library call.
NOT_PLAIN = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa1-\\u0233]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x370) if unicodedata.category(chr(c))[0] == kind)


@cache
def _plain_pattern() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile("|".join([*CONTRACTIONS, f"[{letters}]+", f"[{numbers}]", f"[^\\s{letters}{numbers}]+"]))


@cache
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def _specials(path: str) -> re.Pattern | None:
    with open(path, encoding="utf-8") as f:
        words = [t["content"] for t in json.load(f)["added_tokens"]]
    return re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))) if words else None


@cache
def _splits(path: str) -> dict[str, tuple[str, ...]]:
    """Pre-tokens of blank-free pieces of text seen so far in this process; emptied when large."""
    return {}


def pre_tokens(text: str | None, path: str) -> tuple[Counter, int]:
    """Frequencies of the pre-tokens of a whole text, and how many special strings it holds.

    Special strings are found first, in the text as it is. The rest is split by the library, or, where every character
    is one that the normaliser can only lower-case, at blanks and by the same pattern, which gives the same pieces.
    """
    found: Counter = Counter()
    if not text:
        return found, 0
    pattern, n_special = _specials(path), 0
    parts = [text]
    if pattern and "<|" in text:
        parts = pattern.split(text)
        n_special = len(parts) - 1
    split, plain, known = tokenizer(path), _plain_pattern(), _splits(path)
    for part in parts:
        if NOT_PLAIN.search(part):
            normal = split.normalizer.normalize_str(part)
            found.update(normal[a:b] for _, (a, b) in split.pre_tokenizer.pre_tokenize_str(normal))
            continue
        for word, n in Counter(part.lower().split()).items():
            pieces = known.get(word)
            if pieces is None:
                if len(known) >= FLUSH:
                    known.clear()
                pieces = tuple(plain.findall(word))
                if len(word) <= HEAD_BYTES:
                    known[word] = pieces
            for piece in pieces:
                found[piece] += n
    return found, n_special


def count_pieces(pre_token: str, path: str) -> int:
    """Into how many vocabulary entries the merges turn one pre-token."""
    split = tokenizer(path)
    return sum(len(split.model.tokenize(mapped)) for mapped, _ in split.pre_tokenizer.pre_tokenize_str(pre_token))


def whole_count(text: str | None, path: str) -> int:
    """The count the library itself gives; only tests use it."""
    return len(tokenizer(path).encode(text or "", add_special_tokens=False).ids)


class _Spread:
    """Pre-tokens of the rows of a task with the number of documents they occur in."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py(), self.path)[0].keys())
                if len(seen) >= FLUSH:
                    yield self.batch(seen)
                    seen = Counter()
        yield self.batch(seen)

    def batch(self, seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre_token", "n_docs"])


class _Pieces:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_pieces(t.as_py(), self.path) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], [*batch.schema.names, "pieces"])


class _Frequencies:
    """Per document one row with what the head decides, and one row per remaining pre-token with its frequency."""

    def __init__(self, path: str, head):
        self.path, self.head = path, head

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = self.head.value
        for batch in batches:
            at, pre, n, known = [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found, total = pre_tokens(text.as_py(), self.path)
                for token, k in found.items():
                    pieces = head.get(token)
                    if pieces is None:
                        at.append(i), pre.append(token), n.append(k), known.append(0)
                    else:
                        total += k * pieces
                at.append(i), pre.append(None), n.append(1), known.append(total)
                if len(at) >= FLUSH:
                    yield self.batch(batch, at, pre, n, known)
                    at, pre, n, known = [], [], [], []
            yield self.batch(batch, at, pre, n, known)

    def batch(self, source: pa.RecordBatch, at, pre, n, known) -> pa.RecordBatch:
        keys = source.select(list(range(source.num_columns - 1))).take(pa.array(at, pa.int64()))
        arrays = [*keys.columns, pa.array(pre, pa.string()), pa.array(n, pa.int64()), pa.array(known, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, [*keys.schema.names, "pre_token", "n", "known"])


def piece_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pre_token, n_docs, pieces), each distinct pre-token of the corpus once, stored in the shared folder."""
    spark = docs.sparkSession
    spread = docs.select(quoted(text_col).alias("text")).mapInArrow(_Spread(path), "pre_token string, n_docs long")
    distinct = spread.groupBy("pre_token").agg(F.sum("n_docs").alias("n_docs"))
    folder = new_folder(spark, "pieces")
    distinct.mapInArrow(_Pieces(path), "pre_token string, n_docs long, pieces int").write.parquet(folder)
    return spark.read.parquet(folder)


def widespread(pieces: DataFrame) -> dict[str, int]:
    """Piece counts of the most widespread short pre-tokens: all above a level of n_docs at which there are at most HEAD.

    The level comes from a histogram over sixteenths of powers of two, so nothing is sorted or met in one task.
    """
    level = F.floor(16 * F.log2(F.col("n_docs")))
    short = pieces.where(F.octet_length("pre_token") <= HEAD_BYTES).select("pre_token", "pieces", level.alias("level"))
    least, total = None, 0
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > HEAD:
            break
        least = r["level"]
    return {} if least is None else {r["pre_token"]: r["pieces"] for r in short.where(F.col("level") >= least).collect()}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of `docs`; null texts count as empty, other columns are not read, an
    empty table gives an empty result.

    Rows are told apart by id, length and a hash of the text; rows equal in all of these are repeated rows, counted
    together and given back one by one. Rows whose pre-tokens are all in the head carry their count alone; the rest
    meets the piece table in one join on rare pre-tokens, none of which can be hot, since the hot ones are the head.
    """
    spark = docs.sparkSession
    pieces = piece_table(docs, path, text_col)
    head = spark.sparkContext.broadcast(widespread(pieces))
    text = F.coalesce(quoted(text_col), F.lit(""))
    keyed = docs.select(quoted(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    keys = keyed.drop("text")
    schema = keys.schema.add("pre_token", "string").add("n", "long").add("known", "long")
    rows = keyed.mapInArrow(_Frequencies(path, head), schema)
    # a row without a pre-token matches nothing, under a key of its own, so these rows do not pile up
    own = F.coalesce(F.col("pre_token"), F.concat(F.lit(" "), F.col("text_hash").cast("string")))
    joined = rows.withColumn("pre_token", own).join(pieces.select("pre_token", "pieces"), "pre_token", "left")
    amount = F.when(F.col("pieces").isNotNull(), F.col("n") * F.col("pieces")).otherwise(F.col("known"))
    copies = F.when(F.col("pre_token").startswith(" "), F.col("n")).otherwise(0)
    summed = joined.groupBy("doc_id", "n_bytes", "text_hash").agg(F.sum(amount).alias("tokens"), F.sum(copies).alias("copies"))
    each = summed.select("doc_id", "n_bytes", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), F.col("copies").cast("int").alias("copies"))
    return each.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """`path` is the place of the vocabulary file on every machine."""
    counted = token_counts(docs, path)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
