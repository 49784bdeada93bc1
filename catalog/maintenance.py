"""Table maintenance."""

from pyspark.sql import functions as F

from catalog import check
from catalog.views import has_any, mapped, oracle, quoted, rules, table, view
from swaymeter import fixed_values as V
from swaymeter.operators import html
from swaymeter.operators import maintain as M
from swaymeter.plans.jobs import repaired

HASH_ID = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@check("upsert_dimension", f"""
WITH dim AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS STRING) AS country FROM supplier),
up AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'Supplier#' || lpad(CAST(o_custkey AS STRING), 9, '0') ELSE 'New ' || CAST(o_custkey AS STRING) END AS name,
    o_orderstatus AS country, o_orderkey AS line FROM orders),
last AS (SELECT name, max_by(country, line) AS country FROM up GROUP BY name)
SELECT COALESCE(d.id, {HASH_ID.format("upper(l.name)")}) AS id, COALESCE(d.name, l.name) AS name,
  CASE WHEN l.name IS NOT NULL THEN l.country ELSE d.country END AS country
FROM dim d FULL JOIN last l ON l.name = d.name""")
def _(spark, d):
    dim = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                             F.col("s_nationkey").cast("string").alias("country"))
    cust = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(cust, 9, "0"))).otherwise(F.concat(F.lit("New "), cust))
    updates = table(spark, d, "orders").select(name.alias("name"), F.col("o_orderstatus").alias("country"), F.col("o_orderkey").alias("line"))
    return M.upsert(dim, updates, ["country"], "line")


@check("keyed_update", oracle("""
SELECT f.id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS STRING) ELSE f.tone END AS tone,
  CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN 1.0 END ELSE f.confidence END AS confidence
FROM facts f LEFT JOIN labels l ON l.doc_id = f.id""", "facts"))
def _(spark, d):
    updates = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("tone"),
                                               F.when(F.col("toxic") == 1, 1.0).alias("confidence"))
    return M.keyed_update(view(spark, d, "facts"), updates, ["tone", "confidence"]).select("id", "tone", "confidence")


@check("reset_label", oracle("SELECT id, nullif(strategic_intent, 'Other') AS strategic_intent FROM facts", "facts"))
def _(spark, d):
    return M.reset_label(view(spark, d, "facts")).select("id", "strategic_intent")


def repair_ctes():
    steps = [f"s0 AS (SELECT id, article_text, CASE WHEN {has_any('article_text', V.OFF_TOPIC_WORDS)} THEN 'General News' ELSE strategic_intent END AS i FROM articles)"]
    for n, (wrong, right) in enumerate(V.LABEL_REPAIRS, 1):
        hit = f"upper(i) = {quoted(wrong.upper())}"
        if wrong in V.LABEL_REPAIRS_IN_TEXT:
            hit += f" OR contains(upper(article_text), {quoted(wrong.upper())})"
        steps.append(f"s{n} AS (SELECT id, article_text, CASE WHEN ({hit}) AND (i IS NULL OR i <> {quoted(right)}) THEN {quoted(right)} ELSE i END AS i FROM s{n - 1})")
    return ", " + ", ".join(steps)


@check("repair_labels", oracle(repair_ctes() + f" SELECT id, i AS strategic_intent FROM s{len(V.LABEL_REPAIRS)}", "articles"))
def _(spark, d):
    return M.repair_labels(view(spark, d, "articles")).select("id", "strategic_intent")


@check("mark_anchors_by_cutoff", "SELECT event_id AS id, event_id <= 451 AS is_anchor FROM events")
def _(spark, d):
    return M.mark_anchors(table(spark, d, "events").select(F.col("event_id").alias("id")), 451)


@check("stamp_processing_time", oracle("""
SELECT CAST(CASE WHEN strategic_intent IS NOT NULL THEN TIMESTAMP '2025-01-02 03:04:05' END AS DATE) AS day, count(*) AS n FROM facts GROUP BY 1""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").withColumn("ml_processed_at", F.lit(None).cast("timestamp"))
    stamped = M.stamp(df, "2025-01-02 03:04:05", F.col("strategic_intent").isNotNull())
    return stamped.groupBy(F.to_date("ml_processed_at").alias("day")).agg(F.count("*").alias("n"))


@check("dry_run_changes", oracle("""
SELECT id, 'strategic_intent' AS "column", strategic_intent AS old, CAST(NULL AS STRING) AS new FROM facts WHERE strategic_intent = 'Other'
UNION ALL SELECT id, 'is_anchor', CASE WHEN is_anchor THEN 'true' ELSE 'false' END, CASE WHEN id <= 451 THEN 'true' ELSE 'false' END FROM facts
WHERE is_anchor <> (id <= 451)""", "facts"))
def _(spark, d):
    before = view(spark, d, "facts")
    return M.change_set(before, M.mark_anchors(M.reset_label(before), 451), ["strategic_intent", "is_anchor"])


PREDICTED = """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'Trade dominance' WHEN 1 THEN 'religious influence' WHEN 2 THEN 'military' ELSE 'odd' END AS intent,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS conf,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Cynical' END AS tone FROM events WHERE event_type <> 'error'"""


def predicted(spark, d):
    return spark.sql(PREDICTED.replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))


@check("fill_missing_intents", oracle(f"""
, p AS ({PREDICTED})
SELECT a.id, CASE WHEN p.id IS NOT NULL THEN {mapped("lower(p.intent)", V.intent_aliases("display"))} ELSE a.strategic_intent END AS strategic_intent,
  CASE WHEN p.id IS NOT NULL THEN COALESCE(p.conf, 0) ELSE a.confidence END AS confidence,
  CASE WHEN p.id IS NOT NULL THEN COALESCE(p.tone, 'Factual') ELSE a.tone END AS tone
FROM articles a LEFT JOIN p ON p.id = a.id AND COALESCE(a.strategic_intent, '') = '' AND a.article_text <> ''
  AND upper(a.article_text) <> 'NO CONTENT AVAILABLE'""", "articles"))
def _(spark, d):
    return M.fill_missing_intents(view(spark, d, "articles"), predicted(spark, d)).select("id", "strategic_intent", "confidence", "tone")


@check("relabel_for_index", oracle(f"""
, p AS ({PREDICTED})
SELECT a.id, CASE WHEN p.id IS NOT NULL THEN CASE p.intent WHEN 'Trade dominance' THEN 'Economic' WHEN 'religious influence' THEN 'Religious'
    WHEN 'military' THEN 'MilitaryPresence' ELSE {rules("'odd'", V.CONTEXT_FUNNELS, "'Other'")} END ELSE a.strategic_intent END AS strategic_intent,
  CASE WHEN p.id IS NOT NULL THEN a.id <= 5000 ELSE a.is_anchor END AS is_anchor
FROM articles a LEFT JOIN p ON p.id = a.id AND a.strategic_intent IS NULL AND a.article_text <> ''
  AND lower(COALESCE(a.inferred_actor, '')) NOT IN ('unknown', 'none', 'null', '')
  AND lower(COALESCE(a.target_country, '')) NOT IN ('unknown', 'none', 'null', '')""", "articles"))
def _(spark, d):
    return M.relabel_for_index(view(spark, d, "articles"), predicted(spark, d), 5000).select("id", "strategic_intent", "is_anchor")


@check("backfill_authors", oracle("""
, found AS (SELECT 'https://news.example.com/' || CAST(page_id AS STRING) AS url, CASE page_id % 6 WHEN 0 THEN 'Mary Major'
    WHEN 1 THEN 'Li Wei' WHEN 2 THEN 'Awa Diop' WHEN 3 THEN 'Jane Q. Doe' END AS author FROM pages)
SELECT f.id, COALESCE(n.author, f.author) AS author FROM facts f
LEFT JOIN found n ON n.url = f.url AND (f.author IS NULL OR f.author IN ('', 'Unknown')) AND n.author IS NOT NULL""", "facts"))
def _(spark, d):
    from catalog.texts import marked_pages

    found = html.page_authors(marked_pages(spark, d)).select(
        F.concat(F.lit("https://news.example.com/"), F.col("page_id").cast("string")).alias("url"), "author")
    return M.backfill_authors(view(spark, d, "facts"), found, include_null=True).select("id", "author")


@check("backfill_times", oracle("""
SELECT id, COALESCE(CAST(posting_time AS DATE), CASE id % 12 WHEN 1 THEN DATE '2025-04-15' WHEN 4 THEN DATE '2025-04-15'
  WHEN 9 THEN DATE '2025-04-15' END) AS day FROM facts""", "facts"))
def _(spark, d):
    return M.backfill_times(view(spark, d, "articles")).select("id", F.to_date("posting_time").alias("day"))


@check("repair_all", oracle(repair_ctes().replace("ELSE strategic_intent END", "ELSE nullif(strategic_intent, 'Other') END") + f"""
SELECT s.id, s.i AS strategic_intent, CASE WHEN f.tone LIKE '(%' THEN 'Cynical' ELSE f.tone END AS tone
FROM s{len(V.LABEL_REPAIRS)} s JOIN facts f ON f.id = s.id""", "articles"))
def _(spark, d):
    return repaired(view(spark, d, "articles")).select("id", "strategic_intent", "tone")
