"""Language identification: TF-IDF character n-grams against several centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter.llm.common import crc32_text, cut, pick

#: n-grams of 1, 2 and 3 letters are hashed into so many features.
FEATURES = 1 << 12
ORDERS = (1, 2, 3)
#: Centroids are fitted on at most so many distinct training texts of a language, those with the smallest hashes. Document
#: frequencies are counted over all training rows.
PER_LANGUAGE = 1000
#: Texts are drawn by a threshold on their hash for so many times the number wanted, since the number of distinct texts
#: it comes from is known to within COUNT_ERROR only.
MARGIN, COUNT_ERROR = 1.2, 0.02
CLUSTERS, ROUNDS = 3, 8
#: A text further from every centroid than this share of what training rows have (their 1 % quantile) is rejected.
REJECT_SHARE = 0.5
MAX_CENTROID_BYTES = 64 << 20
#: Languages a table of labels may have; their sampling shares travel with every task.
MAX_LANGUAGES = 10_000
FOLDS, HELD_OUT = 5, 0
CHUNK = 1 << 20
BLOCK = 512
UNKNOWN = "und"
# fixed values: odd multipliers of the rolling n-gram hash
STEP, MIX = 0x9E3779B1, 0x85EBCA6B


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text: letters lower-cased, everything else a blank. Zero without letters."""
    total = np.zeros(FEATURES, np.int64)
    if not text:
        return total
    letters, low = _letters(), text.lower()
    for at in range(0, len(low), CHUNK):
        codes = np.frombuffer(low[max(0, at - 2) : at + CHUNK].encode("utf-32-le"), "<u4").copy()
        is_letter = letters[codes]
        codes[~is_letter] = 32
        last = at + CHUNK >= len(low)  # a blank before the text and after it, but not between chunks
        codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)] * last)).astype(np.uint32)
        is_letter = np.concatenate(([False], is_letter, [False] * last)).astype(bool)
        rolled = np.zeros(len(codes), np.uint32)
        for n in ORDERS:
            size = len(codes) - n + 1
            if size <= 0:
                break
            rolled = rolled[:size] * np.uint32(STEP) + codes[n - 1 :]
            some = is_letter[:size].copy()
            for k in range(1, n):
                some |= is_letter[k : k + size]
            # n-grams of the overlap with the chunk before are already counted
            if at:
                some[: 3 - n + 1] = False
            hashed = (rolled[some] * np.uint32(MIX)) >> np.uint32(32 - FEATURES.bit_length() + 1)
            total += np.bincount(hashed, minlength=FEATURES)
    return total


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """One row per text: log(1 + count) * idf, scaled to length 1 (or zero)."""
    rows = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        rows[i] = np.log1p(gram_counts(text)) * idf
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _doc_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total += gram_counts(text.as_py()) > 0
            rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["feature", "n"])


def cluster(rows: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart starting rows; at most `k` centroids of length 1."""
    rows = rows[np.linalg.norm(rows, axis=1) > 0]
    if not len(rows):
        return rows
    chosen = [rows.mean(axis=0)]
    for _ in range(1, min(k, len(rows))):
        near = np.max(rows @ np.stack(chosen).T, axis=1)
        chosen.append(rows[int(np.argmin(near))])
    centres = np.stack(chosen)
    for _ in range(rounds):
        owner = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([rows[owner == j].mean(axis=0) if (owner == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


class _Fit:
    def __init__(self, idf: np.ndarray, most: int):
        self.idf, self.most = idf, most

    def __call__(self, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h").head(self.most)
        rows = vectors(list(group["text"]), self.idf)
        centres = cluster(rows)
        if not len(centres):
            return pd.DataFrame({"lang": [], "centre": [], "usual": []})
        usual = float(np.quantile(np.max(rows @ centres.T, axis=1), 0.01))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(centres), "centre": list(centres), "usual": usual})


class Model:
    """Inverse document frequencies, and the centroids with the language of each."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, usual: np.ndarray):
        self.idf, self.langs, self.centres, self.usual = idf, langs, centres, usual

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Nearest language, its cosine (0 to 1), and whether the distance says that it is none of the learned ones."""
        rows = vectors(texts, self.idf)
        empty = ~rows.any(axis=1)
        if not len(self.centres):
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        near = rows @ self.centres.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1)
        lang = [UNKNOWN if e else self.langs[j] for e, j in zip(empty, best, strict=True)]
        return lang, [float(s) for s in score], [bool(r) for r in (empty | (score < REJECT_SHARE * self.usual[best]))]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from (doc_id, text, lang); rows without a language are left out.

    The number of distinct texts per language is counted first, so that the sample is drawn in place by a threshold on
    the text's hash and only sampled texts move. Equal texts of a language are drawn once, by a combinable aggregate, so
    that neither ids (null and repeated ones among them) nor copies bring more than `per_language` texts and the margin,
    cut after sorting, together for a language.
    """
    rows = labelled.where(F.col("lang").isNotNull())
    spread = rows.select("text").mapInArrow(_doc_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts = {r["feature"]: r["n"] for r in spread}
    n_rows = counts.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + n_rows) / (1 + df)) + 1.0
    texts = rows.select("lang", F.coalesce("text", F.lit("")).alias("text"))
    share = cut(texts.groupBy("lang").agg((F.lit(MARGIN * per_language) / F.approx_count_distinct("text", COUNT_ERROR)).alias("share")))
    if share.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    drawn = texts.select("lang", "text", h.alias("h")).join(F.broadcast(share), "lang").where(F.col("h") < F.col("share") * float(1 << 63))
    sample = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    schema = "lang string, centre array<float>, usual double"
    fitted = _Fit(idf, per_language)
    found = sample.groupBy("lang").applyInPandas(lambda group: fitted(group), schema).orderBy("lang").limit(1 + MAX_CENTROID_BYTES // (4 * FEATURES)).collect()
    if len(found) * 4 * FEATURES > MAX_CENTROID_BYTES:
        raise ValueError(f"more centroids than fit {MAX_CENTROID_BYTES} bytes")
    centres = np.array([r["centre"] for r in found], np.float32).reshape(len(found), FEATURES)
    return Model(idf, [r["lang"] for r in found], centres, np.array([r["usual"] for r in found]))


class _Predict:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lang, score, rejected = model.predict([t.as_py() for t in part.column(part.num_columns - 1)])
                arrays = [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of `docs`.

    Learns from rows with a language outside the held-out fold (crc32 of the id). Texts without letters, null and empty
    ones among them, are `und` with score 0 and rejected, as is everything where nothing could be learned. Repeated rows are
    rows of their own; equal texts of a language are learned from once.
    """
    fold = crc32_text(F.col("doc_id")) % folds == held_out
    slim = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(slim.where(~fold)))
    asked = slim.select("doc_id", fold.alias("held_out"), "text")
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, lang_pred string, score double, rejected boolean").fields])
    return asked.mapInArrow(_Predict(model), schema)


def op7_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs)
