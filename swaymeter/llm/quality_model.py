"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter.llm.common import crc32_text, pick, quoted, stored
from swaymeter.llm.quality import STOP_WORDS

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
#: Shares of the pooled covariance and of its diagonal mixed into each class covariance, and the least variance.
POOLED, DIAGONAL, FLOOR = 0.2, 0.1, 1e-3
#: Log-density differences are divided by this before the logistic: statistics of one text are not independent.
TEMPERATURE = 4.0
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "symbol_share", "digit_share", "upper_share", "punctuation_share", "repeat_share",
    "dup_line_share", "distinct_share", "stop_share", "line_words", "top_word_share",
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS, _DIGITS, _UPPER, _MARKS = b"#*$%&|<>=+~^\\/{}[]_@", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?'\"()-"


def _logit(part: float, whole: float) -> float:
    """A share as log-odds, with one unseen case on either side."""
    return math.log((part + 1.0) / (max(0.0, whole - part) + 1.0))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS. An empty or null text counts as one of
    no words; every value is finite."""
    raw = (text or "").encode()
    found = raw.split()
    n = len(found)
    low = [w.lower() for w in found]
    sizes = np.fromiter(map(len, found), np.float64, n) if n else np.zeros(1)
    count = Counter(low)
    letters = len(raw)
    share = lambda chars: _logit(letters - len(raw.translate(None, chars)), letters)
    repeated = 0
    if n >= 3:
        windows = list(zip(found, found[1:], found[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(n),
        math.log1p(float(sizes.mean())),
        math.log1p(float(sizes.std())),
        share(_SYMBOLS),
        share(_DIGITS),
        share(_UPPER),
        share(_MARKS),
        _logit(repeated, n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(len(count), n),
        _logit(sum(count[w] for w in _STOP if w in count), n),
        math.log1p(n / max(1, len(lines))),
        _logit(max(count.values(), default=0), n),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one row of statistics per row of `docs`."""
    slim = pick(docs, doc_id=id_col, text=text_col)
    return slim.mapInArrow(_statistics, T.StructType([slim.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' per class over the rows of a task: (label, at, value)."""
    size = len(STATISTICS)
    sums = {0: np.zeros(1 + size + size * size), 1: np.zeros(1 + size + size * size)}
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, size)
        y = np.array(batch.column(0).to_pylist())
        for label, total in sums.items():
            own = x[y == label] if len(y) else x
            total += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    labels = np.repeat([0, 1], 1 + size + size * size)
    at = np.tile(np.arange(1 + size + size * size), 2)
    arrays = [pa.array(labels, pa.int32()), pa.array(at, pa.int32()), pa.array(np.concatenate([sums[0], sums[1]]), pa.float64())]
    yield pa.RecordBatch.from_arrays(arrays, ["label", "at", "value"])


class Model:
    """Class means, and the inverses of the Cholesky factors of the shrunken class covariances, computed once."""

    def __init__(self, moments: dict[int, np.ndarray]):
        size = len(STATISTICS)
        counts = {c: m[0] for c, m in moments.items()}
        total = sum(counts.values())
        self.known = all(n > 0 for n in counts.values())
        if not self.known:
            self.share = counts.get(1, 0.0) / total if total else 0.5
            return
        mean = {c: m[1 : 1 + size] / m[0] for c, m in moments.items()}
        scatter = {c: m[1 + size :].reshape(size, size) - m[0] * np.outer(mean[c], mean[c]) for c, m in moments.items()}
        pooled = sum(scatter.values()) / total
        self.mean, self.inverse, self.offset = mean, {}, {}
        for c in moments:
            own = (1 - POOLED) * scatter[c] / counts[c] + POOLED * pooled
            own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(size)
            factor = np.linalg.cholesky(own)
            self.inverse[c] = np.linalg.inv(factor)
            self.offset[c] = math.log(counts[c] / total) - np.log(np.diag(factor)).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row, from the difference of the Mahalanobis log-densities."""
        if not self.known:
            return np.full(len(x), self.share)
        density = {c: self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) for c in (0, 1)}
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -60, 60)))


def fit(rows: DataFrame) -> Model:
    """Learns from (label, x). Each task sends one fixed set of sums, combined before they reach the driver."""
    sums = rows.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(_moments, "label int, at int, value double")
    size = 1 + len(STATISTICS) + len(STATISTICS) ** 2
    moments = {0: np.zeros(size), 1: np.zeros(size)}
    for r in sums.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        moments[r["label"]][r["at"]] = r["value"]
    return Model(moments)


class _Score:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            score = self.model.scores(x)
            arrays = [*batch.columns[:2], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    Learns from all labelled rows outside the held-out fold (crc32 of the id); null labels and labels other than 0 and
    1 are left out; a doc_id labelled twice counts twice. Without both classes every score is the share of class 1
    (0.5 without labels). Texts are read once; only ids and statistics meet the labels.
    """
    rows = stored(measured(docs, id_col, text_col), "statistics")
    fold = crc32_text(F.col("doc_id")) % folds == held_out
    known = pick(labels, doc_id="doc_id", label=label_col).where(F.col("label").isin(0, 1))
    model = fit(rows.where(~fold).join(known, "doc_id").select("label", "x"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])
    return rows.select("doc_id", fold.alias("held_out"), "x").mapInArrow(_Score(model), schema)


def op8_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
