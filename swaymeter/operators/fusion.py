"""Model scores: votes, stacking, calibration, and merging two sources of labels.

Scores come as a long table (article_id, model, class, prob or logit).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swaymeter.functions.base import ColumnOrName, bind, col, missing
from swaymeter.operators.aggregates import most_frequent, pick_best
from swaymeter.operators.lookup import small

MATCH_THRESHOLD = 0.6
#: Classes whose calibration cells travel with every task (models tell apart tens of them); beyond, they are joined.
MAX_BROADCAST_CLASSES = 1_000


# ---- probabilities and votes ---------------------------------------------
def softmax_array(logits: ColumnOrName) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    def shifted(x: Column) -> Column:
        return bind(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
        return bind(total, lambda t: F.transform(powers, lambda p: p / t))

    return bind(bind(col(logits), shifted), shares)


def softmax_long(scores: DataFrame, keys: Sequence[str] = ("article_id", "model")) -> DataFrame:
    """Adds `prob` to a long table of logits."""
    group = Window.partitionBy(*keys)  # one row per class
    powers = scores.withColumn("_pow", F.exp(F.col("logit") - F.max("logit").over(group)))
    return powers.withColumn("prob", F.col("_pow") / F.sum("_pow").over(group)).drop("_pow")


def mean_scores(scores: DataFrame, value: str = "prob") -> DataFrame:
    return scores.groupBy("article_id", "class").agg(F.avg(value).alias(value))


def best_class(probs: DataFrame, *keys: str) -> DataFrame:
    """Class of the highest probability; ties go to the smaller class."""
    keys = keys or ("article_id",)
    return pick_best(probs, list(keys), [-F.col("prob"), F.col("class")], ["class", "prob"])


def soft_vote(scores: DataFrame) -> DataFrame:
    return best_class(mean_scores(scores))


def hard_vote(scores: DataFrame) -> DataFrame:
    """Class most models choose, with the mean probability of that class."""
    winner = most_frequent(best_class(scores, "article_id", "model"), ["article_id"], "class")
    return winner.select("article_id", "class").join(mean_scores(scores), ["article_id", "class"])


# ---- stacking ------------------------------------------------------------
def stacking_features(scores: DataFrame, models: Sequence[int], classes: Sequence[int]) -> DataFrame:
    """One row per article with the probabilities of all models side by side."""
    from pyspark.ml.functions import array_to_vector

    cells = [F.coalesce(F.sum(F.when((F.col("model") == m) & (F.col("class") == c), F.col("prob"))), F.lit(0.0))
             for m in models for c in classes]
    wide = scores.groupBy("article_id").agg(F.array(*cells).alias("_features"))
    return wide.select("article_id", array_to_vector("_features").alias("features"))


def fit_stacking(features: DataFrame, labels: DataFrame, max_iter: int = 50, reg: float = 0.01):
    """Logistic regression over the stacked probabilities (labels: article_id, label)."""
    from pyspark.ml.classification import LogisticRegression

    train = features.join(labels.select("article_id", F.col("label").cast("double").alias("label")), "article_id")
    return LogisticRegression(maxIter=max_iter, regParam=reg, probabilityCol="probability").fit(train)


def apply_stacking(model, features: DataFrame) -> DataFrame:
    """Long class probabilities of the stacked model."""
    from pyspark.ml.functions import vector_to_array

    probs = model.transform(features).select("article_id", vector_to_array("probability").alias("_p"))
    return probs.select("article_id", F.posexplode("_p").alias("class", "prob"))


def apply_coefficients(scores: DataFrame, weights: DataFrame, biases: DataFrame) -> DataFrame:
    """Long class probabilities of a stacked model given as tables: weights (model, class, out, weight), biases (out, bias).

    A missing score counts as 0. The tables are as large as models times classes squared, so they are broadcast.
    """
    parts = scores.join(small(weights), ["model", "class"]).groupBy("article_id", "out").agg(F.sum(F.col("prob") * F.col("weight")).alias("_z"))
    logits = parts.join(small(biases), "out").select("article_id", F.col("out").alias("class"), (F.col("_z") + F.col("bias")).alias("logit"))
    return softmax_long(logits, ("article_id",)).select("article_id", "class", "prob")


# ---- calibration ---------------------------------------------------------
#: Distinct scores of a class that one task pools.
PIECE = 10_000
#: Scores of a calibrator that are kept together and searched one by one.
CELL = 64


def _placed(df: DataFrame, order: str) -> DataFrame:
    """Adds `place`, the number from 0 of a row among those of its class, without bringing a class together: rows are dealt
    out by ranges and numbered there, behind the rows of the ranges before (one number per task and class)."""
    ranged = df.repartitionByRange("class", order).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("class", "_part").orderBy(order)) - 1
    kept = ranged.withColumn("_inside", inside).persist()
    sizes = kept.groupBy("class", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("class", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = kept.join(F.broadcast(before), ["class", "_part"])
    return numbered.withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def _stacks(points, start, falls) -> list:
    """The stack of pooled blocks after each prefix of `points` (positives, size), behind the stack `start`; a stack is
    (positives, size, rest) or None, so that stacks share their tails."""
    out = [start]
    for y, n in points:
        rest = out[-1]
        while rest is not None and falls(rest[0] * n, y * rest[1]):
            y, n, rest = y + rest[0], n + rest[1], rest[2]
        out.append((y, n, rest))
    return out


def _blocks(points, start=None):
    """`points` pooled behind the stack `start`; blocks of equal means are one."""
    return _stacks(points, start, lambda mean, own: mean >= own)[-1]


def _listed(stack) -> list[list[float]]:
    """The blocks of a stack from its bottom."""
    out = []
    while stack is not None:
        out.append([stack[0], stack[1]])
        stack = stack[2]
    return out[::-1]


def _pooled_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pooled blocks of one piece of a class, one row."""
    pdf = pdf.sort_values("prob")
    blocks = _listed(_blocks(zip(pdf["positives"].astype(float), pdf["n"].astype(float), strict=True)))
    return pd.DataFrame({"class": pdf["class"].iloc[:1], "piece": pdf["piece"].iloc[:1], "blocks": [blocks]})


def _around_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each piece of a class, the pooled blocks of all scores before and of all scores after it."""
    pdf = pdf.sort_values("piece")
    pieces = [[(float(y), float(n)) for y, n in blocks] for blocks in pdf["blocks"]]
    left, stack = [], None
    for blocks in pieces:
        left.append(_listed(stack))
        stack = _blocks(blocks, stack)
    right, stack = [], None
    for blocks in pieces[::-1]:
        right.append(_listed(stack))
        stack = _stacks(blocks[::-1], stack, lambda mean, own: mean <= own)[-1]
    return pd.DataFrame({"class": pdf["class"], "piece": pdf["piece"], "left": left, "right": right[::-1]})


def _venn_abers_piece(pdf: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    """p0 and p1 at every score of one piece of a class and in the gap behind each (and before the first of the class).

    p0 and p1 at s are the isotonic fit at s with one extra point there, labelled 0 or 1. The fits of the scores before
    and after s are kept as stacks of pooled blocks that share their tails, and the extra point pools what it must. The
    scores of the other pieces of the class take part as pooled blocks.
    """
    pdf = pdf.sort_values("prob")
    points = list(zip(pdf["positives"].astype(float), pdf["n"].astype(float), strict=True))
    left, right = ([(float(y), float(n)) for y, n in around[side].iloc[0]] for side in ("left", "right"))
    rising, falling = (lambda mean, own: mean > own), (lambda mean, own: mean < own)
    before = _stacks(points, _stacks(left, None, rising)[-1], rising)
    after = _stacks(points[::-1], _stacks(right, None, falling)[-1], falling)[::-1]

    def fit(left, right, y, n):
        while True:
            if left is not None and left[0] * n > y * left[1]:
                y, n, left = y + left[0], n + left[1], left[2]
            elif right is not None and right[0] * n < y * right[1]:
                y, n, right = y + right[0], n + right[1], right[2]
            else:
                return y / n

    first = pdf["piece"].iloc[0] == 0
    rows = [(-math.inf, False, *(fit(None, after[0], float(e), 1.0) for e in (0, 1)))] if first else []
    for j, (score, (y, n)) in enumerate(zip(pdf["prob"], points, strict=True)):
        rows.append((score, True, *(fit(before[j], after[j + 1], y + e, n + 1) for e in (0, 1))))
        rows.append((score, False, *(fit(before[j + 1], after[j + 1], float(e), 1.0) for e in (0, 1))))
    return pd.DataFrame([(pdf["class"].iloc[0], *r) for r in rows], columns=["class", "score", "exact", "p0", "p1"])


def fit_calibrator(probs: DataFrame, labels: DataFrame) -> DataFrame:
    """One-against-rest Venn-Abers table (class, score, exact, p0, p1), fitted on all labelled articles.

    `exact` rows hold at the score, the others between it and the next one. Equal scores are counted first. A class is cut
    into pieces of PIECE scores; of each, only the pooled blocks go to the other pieces. Blocks are points of a convex line of
    whole numbers, so n articles have at most about n^(2/3) of them. A split of the labelled articles that the models
    were not trained on is the caller's to choose.
    """
    known = labels.select("article_id", "label")
    hit = (F.col("class") == F.col("label")).cast("long")
    counts = (probs.filter(F.col("class").isNotNull() & F.col("prob").isNotNull()).join(known, "article_id")
              .groupBy(F.col("class").cast("int").alias("class"), F.col("prob").cast("double").alias("prob"))
              .agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("positives")))
    pieces = _placed(counts, "prob").withColumn("piece", F.floor(F.col("place") / PIECE).cast("long")).drop("place")
    keys = ["class", "piece"]
    pooled = pieces.groupBy(*keys).applyInPandas(_pooled_piece, "class int, piece long, blocks array<array<double>>")
    around = pooled.groupBy("class").applyInPandas(
        _around_pieces, "class int, piece long, left array<array<double>>, right array<array<double>>")
    return pieces.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInPandas(
        _venn_abers_piece, "class int, score double, exact boolean, p0 double, p1 double")


def _cells(rows: DataFrame, item: Column) -> DataFrame:
    """(class, start, items): the rows of each class in order of their `start`, CELL of them a cell."""
    cell = F.floor(F.col("place") / CELL).alias("_cell")
    cells = _placed(rows, "start").groupBy("class", cell).agg(F.min("start").alias("start"), F.sort_array(F.collect_list(item)).alias("items"))
    return cells.drop("_cell").persist()


def _calibration_cells(calibrator: DataFrame) -> list[DataFrame]:
    """The calibrator as cells of CELL scores, above them cells of the first scores of these and so on, until a class has
    few enough for one cell; the top comes first."""
    value = F.col("p1") / (F.col("p0") + F.col("p1") + 1e-15)
    steps = calibrator.groupBy("class", F.col("score").alias("start")).agg(
        F.max(F.when(F.col("exact"), value)).alias("at"), F.max(F.when(~F.col("exact"), value)).alias("after"))
    levels = [_cells(steps, F.struct(F.col("start").alias("score"), "at", "after"))]
    while (levels[0].groupBy("class").count().agg(F.max("count")).first()[0] or 0) > 1:
        levels.insert(0, _cells(levels[0].select("class", "start"), F.struct(F.col("start").alias("score"))))
    return levels


def calibrate(probs: DataFrame, calibrator: DataFrame | None) -> DataFrame:
    """Calibrated probabilities that sum to 1 per article; without a calibrator, as they are.

    A score is looked up from cell to cell of its class, each time by an ordinary join; the last score of a cell that is not
    above it leads on, and in the last cell, holds. Scores of classes that the calibrator does not know stay as they are, a
    missing score counts 0.
    """
    if calibrator is None:
        return probs
    levels = _calibration_cells(calibrator)
    found = probs.select("article_id", F.col("class").cast("int").alias("class"), F.col("prob").cast("double").alias("prob"))
    last = F.try_element_at(F.filter("items", lambda s: s["score"] <= F.col("prob")), F.lit(-1))
    for n, level in enumerate(levels):
        level = small(level.drop("start") if n == 0 else level, MAX_BROADCAST_CLASSES * 16)
        found = found.join(level, ["class", "start"][:n + 1], "left").withColumn("_last", last)
        found = found.select("article_id", "class", "prob", F.col("_last.score").alias("start"), "_last")
    looked_up = F.when(F.col("start") == F.col("prob"), F.col("_last.at")).otherwise(F.col("_last.after"))
    raw = found.select("article_id", "class", F.when(F.col("prob").isNotNull(), F.coalesce(looked_up, "prob")).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy("article_id"))  # one row per class
    return raw.select("article_id", "class", F.coalesce(F.try_divide(F.col("_p"), total), F.lit(0.0)).alias("prob"))


# ---- scoring texts -------------------------------------------------------
Scorer = Callable[[list[str]], Sequence[tuple[str, float]]]


def score_texts(df: DataFrame, make_scorer: Callable[[], Scorer], text: str = "article_text", key: str = "id",
                batch: int = 20) -> DataFrame:
    """(key, label, conf) from an outside model, called on batches of texts.

    The model is made once per task. A batch that fails is asked again text by text, and only a text that fails alone
    gives ('unknown', 0.0), so the result does not depend on how rows fall into batches; a task whose model cannot be
    made gives that for all its rows.
    """
    def ask(scorer: Scorer | None, texts: list[str]) -> list[tuple[str, float]]:
        try:
            scored = [(str(a), float(b)) for a, b in scorer(texts)]
            if len(scored) != len(texts):
                raise ValueError("one result per text expected")
            return scored
        except Exception:
            if len(texts) == 1 or scorer is None:
                return [("unknown", 0.0)] * len(texts)
            return [one for t in texts for one in ask(scorer, [t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            scorer = make_scorer()
        except Exception:
            scorer = None
        for frame in frames:
            out: list[tuple[str, float]] = []
            texts = frame[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                out += ask(scorer, texts[i:i + batch])
            yield pd.DataFrame({key: frame[key], "label": [a for a, _ in out], "conf": [b for _, b in out]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, label string, conf double")


def decode_labels(df: DataFrame, classes: DataFrame, column: str = "class", name: str = "label",
                  default: str = "Factual") -> DataFrame:
    """Class index to name through a class table (`class`, `label`) of any size; a small one travels to the rows."""
    known = classes.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("label").alias("_label"))
    known = known.withColumnRenamed("class", "_class")
    joined = df.join(small(known), F.col(column) == F.col("_class"), "left").drop("_class")
    return joined.withColumn(name, F.coalesce("_label", F.lit(default))).drop("_label")


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Class table (class, label): distinct labels in sorted order, counted from 0; NULL is no label.

    The distinct labels are dealt out by ranges and sorted there; a label's class is its place in its range behind all
    labels of the ranges before, whose sizes (one number per task) the driver adds up.
    """
    distinct = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    ranged = distinct.repartitionByRange("label").withColumn("part", F.spark_partition_id())
    ranged = ranged.persist()  # a label stays in its part
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(before)]
        before += sizes[part]
    place = F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1
    offset = F.try_element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)
    return ranged.select((place + offset).cast("int").alias("class"), "label")


# ---- merging two sources -------------------------------------------------
def merge_confirmed(model: ColumnOrName, model_conf: ColumnOrName, other: ColumnOrName, other_conf: ColumnOrName,
                    threshold: float = MATCH_THRESHOLD) -> Column:
    """(intent, conf, source): agreement above the threshold counts as confirmed; else the surer side."""
    m, mc, o, oc = map(col, (model, model_conf, other, other_conf))
    best = F.greatest(mc, oc)
    same = F.lower(m) == F.lower(o)
    model_wins = mc >= oc

    def result(intent, conf, source) -> Column:
        return F.struct(intent.alias("intent"), conf.cast("double").alias("conf"), F.lit(source).alias("source"))

    return (F.when(missing(m) | missing(o), result(F.lit("unknown"), F.lit(0.0), "unknown"))
            .when(same & (best >= threshold), result(m, best, "ensemble_matched_confirmed"))
            .when(same & model_wins, result(m, mc, "model_selected_after_low_match"))
            .when(same, result(o, oc, "llm_selected_after_low_match"))
            .when(model_wins, result(m, mc, "model"))
            .otherwise(result(o, oc, "llm")))


def merge_either(model: ColumnOrName, model_conf: ColumnOrName, other: ColumnOrName,
                 other_conf: ColumnOrName) -> Column:
    """(intent, conf, source) of what is there; NULL when neither side has a label."""
    m, o = col(model), col(other)
    mc, oc = F.coalesce(col(model_conf), F.lit(0.0)), F.coalesce(col(other_conf), F.lit(0.0))

    def result(intent, conf, source) -> Column:
        return F.struct(intent.alias("intent"), conf.cast("double").alias("conf"), F.lit(source).alias("source"))

    both = m.isNotNull() & o.isNotNull()
    return (F.when(both & (m == o), result(m, F.greatest(mc, oc), "both"))
            .when(both & (mc >= oc), result(m, mc, "model"))
            .when(both, result(o, oc, "llm"))
            .when(m.isNotNull(), result(m, mc, "model"))
            .when(o.isNotNull(), result(o, oc, "llm")))


def gate(model: ColumnOrName, model_conf: ColumnOrName, other: ColumnOrName, other_conf: ColumnOrName,
         threshold: float = MATCH_THRESHOLD) -> Column:
    """(intent, conf, source): the second source wherever the model is not sure enough."""
    unsure = col(model_conf) < threshold
    return F.struct(F.when(unsure, col(other)).otherwise(col(model)).alias("intent"),
                    F.when(unsure, col(other_conf)).otherwise(col(model_conf)).cast("double").alias("conf"),
                    F.when(unsure, F.lit("llm")).otherwise(F.lit("model")).alias("source"))


def final_confidence(intent_conf: ColumnOrName, tone_conf: ColumnOrName) -> Column:
    return F.greatest(col(intent_conf), col(tone_conf))


def empty_text_result(text: ColumnOrName) -> Column:
    """The safe result for articles without a text, NULL for all others."""
    safe = F.struct(F.lit("unknown").alias("intent"), F.lit("neutral").alias("tone"), F.lit(0.0).alias("conf"),
                    F.lit(0.0).alias("score"), F.lit("Unknown").alias("actor"), F.lit("Unknown").alias("country"))
    return F.when(missing(F.trim(col(text))), safe)


def keep_pseudo_labels(df: DataFrame, min_chars: int = 100) -> DataFrame:
    """Accept undecided pseudo labels of texts that are long enough."""
    accept = F.col("pseudo_kept").isNull() & F.coalesce(F.length("article_text") > min_chars, F.lit(False))
    return df.withColumns({"pseudo_kept": F.when(accept, F.lit(True)).otherwise(F.col("pseudo_kept")),
                           "pseudo_weight": F.when(accept, F.lit(1.0)).otherwise(F.col("pseudo_weight"))})
