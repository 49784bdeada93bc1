"""Votes, stacking, calibration and fusion over scores derived from the vectors."""

from pyspark.sql import functions as F

from catalog import check
from catalog.views import oracle, table, view
from swaymeter import fixed_values as V
from swaymeter.operators import fusion as E

PROBS = """
, probs AS (SELECT article_id, model, class, logit, label, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS prob
  FROM (SELECT *, max(logit) OVER (PARTITION BY article_id, model) AS m FROM logits) WINDOW w AS (PARTITION BY article_id, model)),
means AS (SELECT article_id, class, avg(prob) AS prob FROM probs GROUP BY ALL)"""


def probs(spark, d):
    """Softmax of the logits of each model, computed in place on the arrays."""
    arrays = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("article_id"), "label",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda m: E.softmax_array(
            F.transform(F.slice("embedding", m * 8 + 1, 8), lambda x: x.cast("double") * 4)))).alias("model", "_p"))
    return arrays.select("article_id", "label", "model", F.posexplode("_p").alias("class", "prob"))


@check("softmax_of_arrays", oracle(PROBS + """
SELECT article_id, model, class, round(prob, 6) AS prob FROM probs""", "logits"))
def _(spark, d):
    return probs(spark, d).select("article_id", "model", "class", F.round("prob", 6).alias("prob"))


@check("softmax_of_rows", oracle(PROBS + """
SELECT article_id, model, class, round(prob, 6) AS prob FROM probs""", "logits"))
def _(spark, d):
    return E.softmax_long(view(spark, d, "logits")).select("article_id", "model", "class", F.round("prob", 6).alias("prob"))


@check("argmax_per_model", oracle(PROBS + """
SELECT article_id, model, class, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY article_id, model
  ORDER BY prob DESC, class) AS rn FROM probs) WHERE rn = 1""", "logits"))
def _(spark, d):
    return E.best_class(probs(spark, d), "article_id", "model").withColumn("prob", F.round("prob", 6))


@check("soft_vote", oracle(PROBS + """
SELECT article_id, class, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY article_id
  ORDER BY prob DESC, class) AS rn FROM means) WHERE rn = 1""", "logits"))
def _(spark, d):
    return E.soft_vote(probs(spark, d)).withColumn("prob", F.round("prob", 6))


@check("hard_vote", oracle(PROBS + """
, votes AS (SELECT article_id, class, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY article_id, model
    ORDER BY prob DESC, class) AS rn FROM probs) WHERE rn = 1 GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, class) AS rn FROM votes)
SELECT w.article_id, w.class, round(prob, 6) AS prob FROM won w JOIN means m ON m.article_id = w.article_id AND m.class = w.class
WHERE rn = 1""", "logits"))
def _(spark, d):
    return E.hard_vote(probs(spark, d)).withColumn("prob", F.round("prob", 6))


@check("mean_logits", oracle("""
SELECT article_id, class, round(avg(logit), 6) AS logit FROM logits GROUP BY ALL""", "logits"))
def _(spark, d):
    return E.mean_scores(view(spark, d, "logits"), "logit").withColumn("logit", F.round("logit", 6))


@check("stacked_classifier")
def _(spark, d):
    scores = probs(spark, d)
    features = E.stacking_features(scores, range(8), range(8))
    labels = scores.select("article_id", "label").distinct()
    return E.best_class(E.apply_stacking(E.fit_stacking(features, labels, max_iter=10), features))


@check("stacking_features", oracle(PROBS + """
, every AS (SELECT article_id, m.i AS model, c.i AS class FROM (SELECT DISTINCT article_id FROM logits), range(8) m(i), range(8) c(i))
SELECT article_id, model, class, round(sum(COALESCE(prob, 0)), 6) AS prob FROM every LEFT JOIN probs USING (article_id, model, class) GROUP BY ALL""", "logits"))
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    wide = E.stacking_features(probs(spark, d), range(8), range(8)).select("article_id", F.posexplode(vector_to_array("features")).alias("at", "prob"))
    return wide.select("article_id", F.floor(F.col("at") / 8).cast("int").alias("model"), (F.col("at") % 8).alias("class"), F.round("prob", 6).alias("prob"))


@check("apply_coefficients", oracle(PROBS + """
, z AS (SELECT article_id, o.i AS class, sum(prob * ((model * 7 + class * 3 + o.i * 5) % 11 - 5) / 10.0E0) + o.i / 10.0E0 AS z
  FROM probs, range(4) o(i) GROUP BY article_id, o.i)
SELECT article_id, class, round(exp(z) / sum(exp(z)) OVER (PARTITION BY article_id), 6) AS prob FROM z""", "logits"))
def _(spark, d):
    ids = spark.range(8)
    every = ids.select(F.col("id").alias("model"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("class"))
    weights = every.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "weight", (F.expr("(model * 7 + class * 3 + out * 5) % 11") - 5) / 10.0)
    biases = spark.range(4).select(F.col("id").alias("out"), (F.col("id") / 10.0).alias("bias"))
    return E.apply_coefficients(probs(spark, d), weights, biases).withColumn("prob", F.round("prob", 6))


#: The scores of calibration_table are rounded to hundredths beforehand, so that SQL can list them.
GRID = 100
CALIBRATOR = PROBS + f"""
, bins AS (SELECT class, CAST(round(prob * {GRID}) AS INT) AS bin, count(*) AS n, sum(CASE WHEN class = label THEN 1 ELSE 0 END) AS y
  FROM (SELECT m.article_id, m.class, m.prob, l.label FROM means m JOIN (SELECT DISTINCT article_id, label FROM logits) l USING (article_id))
  GROUP BY ALL),
grid AS (SELECT class, g.bin, COALESCE(n, 0) AS n, COALESCE(y, 0) AS y
  FROM (SELECT DISTINCT class FROM bins) CROSS JOIN (SELECT unnest(range({GRID} + 1)) AS bin) g LEFT JOIN bins USING (class, bin)),
cum AS (SELECT class, bin, sum(n) OVER w AS n, sum(y) OVER w AS y FROM grid WINDOW w AS (PARTITION BY class ORDER BY bin)),
starts AS (SELECT class, bin AS a, COALESCE(lag(n) OVER w, 0) AS n, COALESCE(lag(y) OVER w, 0) AS y FROM cum
  WINDOW w AS (PARTITION BY class ORDER BY bin)),
fits AS (SELECT s.class, g.bin AS bin, s.a, min((e.y - s.y) / (e.n - s.n + 1.0E0)) AS low, min((e.y - s.y + 1) / (e.n - s.n + 1.0E0)) AS high
  FROM grid g JOIN starts s ON s.class = g.class AND s.a <= g.bin JOIN cum e ON e.class = g.class AND e.bin >= g.bin GROUP BY ALL),
cal AS (SELECT class, bin, max(low) AS p0, max(high) AS p1 FROM fits GROUP BY ALL)"""


def means_and_labels(spark, d):
    scores = probs(spark, d)
    return E.mean_scores(scores), scores.select("article_id", "label").distinct()


#: p0 and p1 at every score of a class, unrounded: the highest over the starts before it of the lowest mean over the ends behind
#: it, of all points between start and end and one extra point labelled 0 or 1.
CALIBRATOR_OF_ALL = PROBS + """
, scores AS MATERIALIZED (SELECT article_id, class, prob FROM means),
points AS (SELECT class, prob, count(*) AS n, sum(CASE WHEN class = label THEN 1 ELSE 0 END) AS y
  FROM scores JOIN (SELECT DISTINCT article_id, label FROM logits) l USING (article_id) GROUP BY ALL),
cum AS (SELECT class, prob, n AS own_n, y AS own_y, sum(n) OVER w AS n, sum(y) OVER w AS y, row_number() OVER w AS place FROM points
  WINDOW w AS (PARTITION BY class ORDER BY prob)),
spans AS (SELECT s.class, s.place AS a, e.place, e.prob, e.n - s.n + s.own_n + 1.0E0 AS n, e.y - s.y + s.own_y AS y
  FROM cum s JOIN cum e ON e.class = s.class AND e.place >= s.place),
fits AS (SELECT class, prob, min(y / n) OVER w AS low, min((y + 1) / n) OVER w AS high FROM spans
  WINDOW w AS (PARTITION BY class, a ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cal AS (SELECT class, prob, max(low) AS p0, max(high) AS p1 FROM fits GROUP BY ALL)"""


@check("calibration_table", oracle(CALIBRATOR + """
SELECT class, bin, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM cal JOIN bins USING (class, bin)""", "logits"))
def _(spark, d):
    means, labels = means_and_labels(spark, d)
    means = means.withColumn("prob", F.round(F.col("prob") * GRID) / GRID)
    table_ = E.fit_calibrator(means, labels).filter("exact")
    return table_.select("class", F.round(F.col("score") * GRID).cast("int").alias("bin"), F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@check("calibrated_probabilities", oracle(CALIBRATOR_OF_ALL + """
, raw AS (SELECT article_id, class, p1 / (p0 + p1 + 1e-15) AS p FROM scores JOIN cal USING (class, prob))
SELECT article_id, class, round(p / sum(p) OVER (PARTITION BY article_id), 6) AS prob FROM raw""", "logits"))
def _(spark, d):
    means, labels = means_and_labels(spark, d)
    means = means.persist()  # summed once, so that the scores looked up are those fitted to the last bit
    return E.calibrate(means, E.fit_calibrator(means, labels)).withColumn("prob", F.round("prob", 6))


def length_scorer():
    """Stands in for an outside model: labels by text length, fails on batches with an error text."""
    def score(texts):
        if any(t.startswith("Failed:") for t in texts):
            raise RuntimeError("model failure")
        return [("long" if len(t) > 1000 else "short", min(1.0, len(t) / 5000)) for t in texts]

    return score


@check("score_texts_in_batches", oracle("""
SELECT id, CASE WHEN starts_with(article_text, 'Failed:') THEN 'unknown' WHEN length(COALESCE(article_text, '')) > 1000 THEN 'long'
    ELSE 'short' END AS label,
  CASE WHEN starts_with(article_text, 'Failed:') THEN 0 ELSE round(least(1, length(COALESCE(article_text, '')) / 5000.0E0), 6) END AS conf
FROM articles""", "articles"))
def _(spark, d):
    return E.score_texts(view(spark, d, "articles"), length_scorer, batch=20).withColumn("conf", F.round("conf", 6))


@check("decode_labels", oracle(PROBS + """
, best AS (SELECT article_id, class FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY prob DESC, class) AS rn FROM means)
  WHERE rn = 1)
SELECT article_id, class, CASE class WHEN 0 THEN 'Alarmist' WHEN 1 THEN 'Cynical' WHEN 2 THEN 'Factual' WHEN 3 THEN 'Sensationalist'
  ELSE 'Factual' END AS label FROM best""", "logits"))
def _(spark, d):
    classes = spark.createDataFrame(list(enumerate(V.TONES)), "class int, label string")
    return E.decode_labels(E.soft_vote(probs(spark, d)), classes).select("article_id", "class", "label")


@check("encode_labels", """
SELECT CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS class, source AS label FROM (SELECT DISTINCT source FROM documents)""")
def _(spark, d):
    return E.encode_labels(table(spark, d, "documents"), "source")


# two sources of labels per event
PAIRS = """
SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS m,
  CAST(event_id * 13 % 101 AS DOUBLE) / 100 AS mc,
  CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN upper(event_type) WHEN 2 THEN 'view' ELSE event_type END AS o,
  CAST(user_id * 29 % 101 AS DOUBLE) / 100 AS oc FROM events"""


def pairs(spark, d):
    return spark.sql(PAIRS.replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))


@check("merge_confirmed", f"""
WITH p AS ({PAIRS})
SELECT id, CASE WHEN COALESCE(m, '') = '' OR COALESCE(o, '') = '' THEN 'unknown' WHEN lower(m) = lower(o) AND greatest(mc, oc) >= 0.6 THEN m
    WHEN mc >= oc THEN m ELSE o END AS intent,
  CASE WHEN COALESCE(m, '') = '' OR COALESCE(o, '') = '' THEN 0 ELSE greatest(mc, oc) END AS conf,
  CASE WHEN COALESCE(m, '') = '' OR COALESCE(o, '') = '' THEN 'unknown' WHEN lower(m) = lower(o) THEN
    CASE WHEN greatest(mc, oc) >= 0.6 THEN 'ensemble_matched_confirmed' WHEN mc >= oc THEN 'model_selected_after_low_match'
      ELSE 'llm_selected_after_low_match' END WHEN mc >= oc THEN 'model' ELSE 'llm' END AS source FROM p""")
def _(spark, d):
    return pairs(spark, d).withColumn("r", E.merge_confirmed("m", "mc", "o", "oc")).select("id", "r.*")


@check("merge_either", f"""
WITH p AS ({PAIRS})
SELECT id, CASE WHEN m IS NULL THEN o WHEN o IS NULL OR mc >= oc THEN m ELSE o END AS intent,
  CASE WHEN m IS NULL THEN oc WHEN o IS NULL THEN mc ELSE greatest(mc, oc) END AS conf,
  CASE WHEN m = o THEN 'both' WHEN m IS NULL THEN 'llm' WHEN o IS NULL OR mc >= oc THEN 'model' ELSE 'llm' END AS source
FROM p WHERE m IS NOT NULL OR o IS NOT NULL""")
def _(spark, d):
    merged = pairs(spark, d).withColumn("r", E.merge_either("m", "mc", "o", "oc"))
    return merged.filter(F.col("r").isNotNull()).select("id", "r.*")


@check("confidence_gate", f"""
WITH p AS ({PAIRS})
SELECT id, CASE WHEN mc < 0.6 THEN o ELSE m END AS intent, CASE WHEN mc < 0.6 THEN oc ELSE mc END AS conf,
  CASE WHEN mc < 0.6 THEN 'llm' ELSE 'model' END AS source FROM p""")
def _(spark, d):
    return pairs(spark, d).withColumn("r", E.gate("m", "mc", "o", "oc")).select("id", "r.*")


@check("final_confidence", f"WITH p AS ({PAIRS}) SELECT id, greatest(mc, oc) AS conf FROM p")
def _(spark, d):
    return pairs(spark, d).select("id", E.final_confidence("mc", "oc").alias("conf"))


@check("keep_pseudo_labels", oracle("""
SELECT id, CASE WHEN pseudo_kept IS NULL AND length(article_text) > 100 THEN TRUE ELSE pseudo_kept END AS pseudo_kept,
  CASE WHEN pseudo_kept IS NULL AND length(article_text) > 100 THEN 1.0 ELSE pseudo_weight END AS pseudo_weight FROM articles""", "articles"))
def _(spark, d):
    return E.keep_pseudo_labels(view(spark, d, "articles")).select("id", "pseudo_kept", "pseudo_weight")


@check("safe_result_for_empty_text", oracle("""
SELECT id, 'unknown' AS intent, 'neutral' AS tone, 0.0E0 AS conf FROM articles WHERE COALESCE(trim(article_text), '') = ''""", "articles"))
def _(spark, d):
    safe = view(spark, d, "articles").withColumn("s", E.empty_text_result("article_text")).filter(F.col("s").isNotNull())
    return safe.select("id", "s.intent", "s.tone", "s.conf")
