"""Toxicity: a weighted finite-state grammar of insult, threat, target, negation and reported speech over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter.llm.common import crc32_text, cut, pick

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: The grammar's insult lexicon and the weights of its scores are learned from at most so many labelled rows a class.
PER_CLASS = 10_000
#: Lexicon units are whole words and word beginnings of so many letters; the lexicon keeps at most MAX_UNITS of them.
SHORTEST, LONGEST, MAX_UNITS = 3, 10, 50_000
LEAST_COUNT, LEAST_SHARE, LEAST_WEIGHT, LEAST_Z = 5, 0.005, 2.0, 3.5
#: Repetitions of a unit within one text that count as evidence.
PER_TEXT = 8
FLUSH = 200_000
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(WORD.pattern + r"|[\"“”«»]")
#: Clauses end here; commas, colons, brackets and quotes are inside a clause.
END = re.compile(r"[.!?;]+")
QUOTES = {'"': "quote", "“": "open", "«": "open", "”": "close", "»": "close"}
# fixed values: closed word classes of the grammar in English, French, German and Spanish
TARGETS = frozenset("you your yours he she they him her them his their tu toi vous votre ton ta il elle ils du dich dir ihr euch sie er usted tú él ella ellos".split())
NEGATIONS = frozenset("not no never none don't isn't aren't wasn't pas jamais aucun nicht nie kein keine nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls told tells wrote dit disait appelle sagt sagte nannte schrieb dijo dice llamó escribió".split())
FUTURES = frozenset("will shall gonna going must should va vais werde werden wird voy vamos debe".split())
THREATS = frozenset("kill hurt destroy beat burn shoot hang stab tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split())
# the arcs' weights
NEGATED, REPORTED, TARGETED, THREAT, HEAPED = 0.3, 0.5, 1.5, 4.0, 1.25
NEGATION_SCOPE = 3

#: A transducer: state -> class -> (next state, factor on what the token emits). A class without an arc loops with
#: the factor of the state's own entry "".
Transducer = dict[int, dict[str, tuple[int, float]]]
NEGATION: Transducer = {
    0: {"negation": (1, 1.0), "": (0, 1.0)},
    **{k: {"negation": (1, 1.0), "": (k + 1 if k < NEGATION_SCOPE else 0, NEGATED)} for k in range(1, NEGATION_SCOPE + 1)},
}
#: After a verb of speech, what follows is reported: to the end of the clause, or of the quotation that begins there.
SPEECH: Transducer = {
    0: {"report": (1, 1.0), "": (0, 1.0)},
    1: {"quote": (2, 1.0), "open": (2, 1.0), "": (1, REPORTED)},
    2: {"quote": (0, 1.0), "close": (0, 1.0), "": (2, REPORTED)},
}
#: An insult right after another one weighs more.
INSULT: Transducer = {0: {"insult": (1, 1.0), "": (0, 1.0)}, 1: {"insult": (1, HEAPED), "": (0, 1.0)}}
TARGET: Transducer = {0: {"target": (1, 1.0), "": (0, 1.0)}, 1: {"": (1, TARGETED)}}
#: Without a future word and a target before it, a verb of violence is a report of deeds, not a threat.
MENACE: Transducer = {
    0: {"future": (1, 1.0), "target": (1, 1.0), "threat": (0, 0.0), "": (0, 1.0)},
    1: {"threat": (1, 1.0), "": (1, 1.0)},
}


def compose(*parts: Transducer) -> tuple[dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float]], tuple[int, ...]]:
    """The product of transducers that read the same tokens: all move at once and their factors multiply."""
    classes = {c for part in parts for arcs in part.values() for c in arcs}
    start = (0,) * len(parts)
    arcs: dict = {}
    todo = [start]
    while todo:
        state = todo.pop()
        for kind in classes:
            steps = [part[s].get(kind, part[s][""]) for part, s in zip(parts, state, strict=True)]
            to = tuple(s for s, _ in steps)
            if (state, kind) not in arcs:
                arcs[state, kind] = (to, math.prod(f for _, f in steps))
                todo.append(to)
    return arcs, start


GRAMMAR, START = compose(NEGATION, SPEECH, TARGET, MENACE, INSULT)
#: The start of a clause inside a quotation of reported speech that an earlier clause of the line has opened.
QUOTED = (0, 2, 0, 0, 0)
CLOSED = {w: kind for kind, some in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("future", FUTURES), ("threat", THREATS)) for w in some}


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: the whole word, marked as such, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class Lexicon:
    """Insult weights of words: the largest of their units' weights."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.seen = weights, {}

    def weight(self, word: str) -> float:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= FLUSH:
                self.seen.clear()
            found = self.seen[word] = max((self.weights.get(u, 0.0) for u in units(word)), default=0.0)
        return found


FEATURES = ("clause_best", "clause_sum", "clauses", "density", "rate", "word_best", "word_kinds", "threats", "length")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Scores of the clauses that the grammar matches in a whole text; all zero when there are none.

    Words count everywhere with the grammar's factor at their place: `word_best` and `word_kinds` take a word where it
    weighs most, `density` adds the factors.
    """
    low = (text or "").lower()
    n_words = low.count(" ") + 1
    kinds = {}
    for word in set(WORD.findall(low)):
        w = lexicon.weight(word)
        if w > 0:
            kinds[word] = w
    if not kinds and not any(t in low for t in THREATS):
        return [0.0] * (len(FEATURES) - 1) + [math.log1p(n_words)]
    scores, hits, threats, heard = [], 0.0, 0.0, dict.fromkeys(kinds, 0.0)
    for line in low.split("\n"):
        if not any(w in kinds or w in THREATS for w in WORD.findall(line)):
            continue
        state = START
        for clause in END.split(line):
            state, total = QUOTED if state[1] == 2 else START, 0.0
            for word in TOKEN.findall(clause):
                weight = kinds.get(word, 0.0)
                kind = "insult" if weight else QUOTES.get(word) or CLOSED.get(word, "")
                state, factor = GRAMMAR.get((state, kind)) or GRAMMAR[state, ""]
                if kind == "insult":
                    total += weight * factor
                    hits += factor
                    heard[word] = max(heard[word], weight * factor)
                elif kind == "threat":
                    total += THREAT * factor
                    threats += factor
            if total > 0:
                scores.append(total)
    best = max(scores, default=0.0)
    strong = sorted(heard.values(), reverse=True)
    return [
        best, math.log1p(sum(scores)), math.log1p(len(scores)), math.log1p(1000 * hits / n_words), math.log1p(1000 * sum(scores) / n_words), strong[0] if strong else 0.0,
        math.log1p(sum(strong)), math.log1p(threats), math.log1p(n_words),
    ]


def unit_counts(text: str | None) -> tuple[Counter, int]:
    """How often the units occur in a text, up to PER_TEXT each, and its number of words."""
    found: Counter = Counter()
    words = Counter(WORD.findall((text or "").lower()))
    for word, n in words.items():
        for unit in units(word):
            found[unit] += n
    return Counter({u: min(n, PER_TEXT) for u, n in found.items()}), words.total()


class _Units:
    """(unit, toxic, clean): how often the units occur in sampled texts of either class; the empty unit counts words."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                counts, n_words = unit_counts(text.as_py())
                seen[label.as_py()].update(counts)
                seen[label.as_py()][""] += n_words
                if len(seen[0]) + len(seen[1]) >= FLUSH:
                    yield self.batch(*seen)
                    seen = (Counter(), Counter())
        yield self.batch(*seen)

    def batch(self, clean: Counter, toxic: Counter) -> pa.RecordBatch:
        names = list({**clean, **toxic})
        arrays = [pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([clean[u] for u in names], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["unit", "toxic", "clean"])


def _sketch(text: str | None) -> int:
    """The least hash of the three-word runs of a text: near copies nearly always share it."""
    found = WORD.findall((text or "").lower())
    runs = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    return min(xxhash.xxh64_intdigest(r) for r in runs) - (1 << 63)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_sketch(t.as_py()) for t in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["label", "text", "sketch"])


class _Features:
    def __init__(self, weights):
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(self.weights.value)
        for batch in batches:
            rows = pa.array([features(t.as_py(), lexicon) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["label", "x"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one constant) of a ridge logistic regression with balanced classes, by Newton steps."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(rows.shape[1])
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (balance * (p - y)) + keep * w
        curve = (rows * (balance * p * (1 - p))[:, None]).T @ rows + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """The lexicon's weights, and the logistic weights of the clause scores (scaled by `size`)."""

    def __init__(self, lexicon: dict[str, float], size: np.ndarray, weights: np.ndarray):
        self.lexicon, self.size, self.weights = lexicon, size, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x / self.size) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(label, text) of at most `per_class` texts a class: rows of the labelled ids with the smallest hashes, near copies
    once, and of these the ones with the smallest hashes of their sketch, however many rows share an id.

    Ids and sketches that are chosen are bounded by the parameter, so they are sent to the tasks and texts are filtered in
    place; only texts with a chosen sketch are shuffled, and equal sketches meet in a combinable minimum.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [labels.where(F.col("label") == c).dropDuplicates(["doc_id"]).orderBy(*order).limit(per_class) for c in (0, 1)]
    ids = cut(chosen[0].unionByName(chosen[1]))
    sampled = docs.join(F.broadcast(ids), "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    marked = sampled.mapInArrow(_sketches, "label int, text string, sketch long")
    found = cut(marked.select("label", "sketch").distinct())
    least = [found.where(F.col("label") == c).orderBy(F.xxhash64("sketch"), "sketch").limit(per_class) for c in (0, 1)]
    kept = marked.join(F.broadcast(cut(least[0].unionByName(least[1]))), ["label", "sketch"], "left_semi")
    return cut(kept.groupBy("label", "sketch").agg(F.min("text").alias("text")).select("label", "text"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from (doc_id, text) and (doc_id, label)."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, per_class)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    none = Model({}, np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1))
    if not toxic or not clean:
        none.weights[-1] = 30.0 if toxic else -30.0
        return none
    seen = sample.mapInArrow(_Units(), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    seen = cut(seen)
    words = seen.where("unit = ''").first()
    weight = F.log((F.col("t") + 0.5) / (words["t"] + 1.0)) - F.log((F.col("c") + 0.5) / (words["c"] + 1.0))
    z = weight / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    kept = seen.select("unit", "t", weight.alias("w"), z.alias("z")).where(
        (F.col("unit") != "") & (F.col("t") >= max(LEAST_COUNT, math.ceil(LEAST_SHARE * toxic))) & (F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
    lexicon = {r["unit"]: r["w"] for r in kept.orderBy(F.desc("z"), "unit").limit(MAX_UNITS).collect()}
    rows = sample.mapInArrow(_Features(spark.sparkContext.broadcast(lexicon)), "label int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    size = np.maximum(x.std(axis=0), 1e-6)
    return Model(lexicon, size, logistic(x / size, y))


class _Score:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        lexicon = Lexicon(model.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py(), lexicon) for t in batch.column(2)], np.float64).reshape(-1, len(FEATURES))
            score = model.score(x)
            arrays = [*batch.columns[:2], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    Learns from labelled rows outside the held-out fold (crc32 of the id), bounded by `per_class`; labels other than 0
    and 1 are left out, of several labels of an id one counts, and repeated rows of an id are rows of their own. Null and empty texts match nothing and get the score of no match. Without both classes the
    score is 0 (or 1, where only toxic rows are known).
    """
    fold = crc32_text(F.col("doc_id")) % folds == held_out
    slim = pick(docs, doc_id=id_col, text=text_col)
    known = pick(labels, doc_id="doc_id", label=label_col).where(F.col("label").isin(0, 1) & ~fold)
    model = docs.sparkSession.sparkContext.broadcast(fit(slim, known, per_class))
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])
    return slim.select("doc_id", fold.alias("held_out"), "text").mapInArrow(_Score(model), schema)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
