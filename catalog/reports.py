"""Pages and reports, panel by panel."""

import uuid

from pyspark.sql import functions as F

from catalog import CHECKS, check, work_folder
from catalog.texts import LINES
from catalog.views import has_any, listed, mapped, oracle, quoted, table, view
from swaymeter import fixed_values as V
from swaymeter.operators import paging, text_search
from swaymeter.plans import audit, reports, rollup

CLEAN = f"""
, clean AS (SELECT * FROM articles WHERE target_country IN {listed(V.MONITORED_COUNTRIES)}
  AND NOT COALESCE({has_any('article_text', V.SPORTS_WORDS)}, FALSE))"""


def overview_panel(name, country=None, actor=None, intent=None, page=1):
    def run(spark, d):
        return reports.overview(view(spark, d, "articles"), view(spark, d, "idx"), country, actor, intent, page)[name]

    return run


def no_placeholder(c):
    return f"({c} IS NULL OR {c} NOT IN ('', 'Unknown'))"


@check("overview_cards", oracle(CLEAN + f"""
SELECT count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT media_outlet FROM clean)) AS outlets,
  (SELECT count(*) FROM (SELECT DISTINCT strategic_intent FROM clean WHERE {no_placeholder("strategic_intent")})) AS intents,
  (SELECT count(*) FROM (SELECT DISTINCT inferred_actor FROM clean WHERE {no_placeholder("inferred_actor")})) AS actors,
  round(COALESCE(avg(confidence), 0), 3) AS avg_confidence, (SELECT round(COALESCE(avg(final_risk), 0), 3) FROM idx) AS avg_risk
FROM clean""", "articles", "idx"))
def _(spark, d):
    return overview_panel("cards")(spark, d)


@check("overview_cards_filtered", oracle(CLEAN + f"""
, c2 AS (SELECT * FROM clean WHERE upper(target_country) = 'SENEGAL' AND upper(inferred_actor) = 'RUSSIA')
SELECT count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT media_outlet FROM c2)) AS outlets,
  (SELECT count(*) FROM (SELECT DISTINCT strategic_intent FROM c2 WHERE {no_placeholder("strategic_intent")})) AS intents,
  (SELECT count(*) FROM (SELECT DISTINCT inferred_actor FROM c2 WHERE {no_placeholder("inferred_actor")})) AS actors,
  round(COALESCE(avg(confidence), 0), 3) AS avg_confidence,
  (SELECT round(COALESCE(avg(final_risk), 0), 3) FROM idx WHERE country = 'Senegal' AND actor = 'Russia') AS avg_risk FROM c2""", "articles", "idx"))
def _(spark, d):
    return overview_panel("cards", "senegal", "russia")(spark, d)


@check("overview_volume", oracle(CLEAN + """
SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM (SELECT posting_time FROM clean WHERE posting_time IS NOT NULL
  ORDER BY posting_time DESC, id LIMIT 500) GROUP BY 1""", "articles"))
def _(spark, d):
    return overview_panel("volume")(spark, d)


@check("overview_page", oracle(CLEAN + f"""
, p AS (SELECT * FROM clean ORDER BY posting_time DESC NULLS FIRST, id LIMIT 10 OFFSET 10)
SELECT id, 10 + row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS position,
  {mapped("lower(trim(strategic_intent))", V.intent_aliases("display"))} AS canonical_intent,
  length(regexp_replace(replace(article_text, chr(10), ' '), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) > 500 AS cut FROM p""", "articles"))
def _(spark, d):
    rows = overview_panel("articles", page=2)(spark, d)
    return rows.select("id", "position", "canonical_intent", F.endswith("display_summary", F.lit("…")).alias("cut"))


@check("overview_score", oracle("""
SELECT 'ivory coast' AS country, 'USA' AS actor, round(max(final_risk), 4) AS score, arg_max(intent, final_risk) AS score_intent
FROM idx WHERE country = 'CoteIvoire' AND actor = 'UnitedStates'""", "idx"))
def _(spark, d):
    return reports.contextual_score(view(spark, d, "idx"), "ivory coast", "USA").select("country", "actor", "score", "score_intent")


def outlet_panel(name):
    def run(spark, d):
        return reports.outlet_profile(view(spark, d, "articles"), view(spark, d, "outlets"), "rfi")[name]

    return run


RFI = """
, rfi AS (SELECT f.* FROM facts f LEFT JOIN outlets o ON o.id = f.media_outlet_fk WHERE upper(o.name) = 'RFI' OR upper(f.media_outlet) = 'RFI')"""


@check("outlet_stats", oracle(RFI + " SELECT count(*) AS total_articles, round(avg(confidence), 6) AS avg_confidence FROM rfi", "facts", "outlets"))
def _(spark, d):
    return outlet_panel("stats")(spark, d).withColumn("avg_confidence", F.round("avg_confidence", 6))


@check("outlet_intents", oracle(RFI + f"""
SELECT strategic_intent, count(*) AS count FROM rfi WHERE {no_placeholder("strategic_intent")} GROUP BY 1
ORDER BY count DESC, strategic_intent NULLS LAST LIMIT 10""", "facts", "outlets"))
def _(spark, d):
    return outlet_panel("intents")(spark, d)


@check("outlet_tones", oracle(RFI + f" SELECT tone, count(*) AS count FROM rfi WHERE {no_placeholder('tone')} GROUP BY 1", "facts", "outlets"))
def _(spark, d):
    return outlet_panel("tones")(spark, d)


@check("outlet_page", oracle(RFI + """
SELECT id, row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS position FROM rfi ORDER BY position LIMIT 10""", "facts", "outlets"))
def _(spark, d):
    return outlet_panel("articles")(spark, d).select("id", "position")


def country_panel(name, country=None):
    def run(spark, d):
        return reports.country_profile_report(view(spark, d, "facts"), view(spark, d, "idx"), country)[name]

    return run


@check("country_pairs", oracle(f"""
SELECT target_country, inferred_actor, count(*) AS count, target_country || ' - ' || inferred_actor AS label FROM facts
WHERE {no_placeholder("target_country")} AND {no_placeholder("inferred_actor")} GROUP BY 1, 2
ORDER BY count DESC, target_country NULLS LAST, inferred_actor NULLS LAST LIMIT 10""", "facts"))
def _(spark, d):
    return country_panel("pairs")(spark, d)


@check("country_risk", oracle("SELECT country, round(avg(final_risk), 6) AS avg_risk FROM idx GROUP BY country", "idx"))
def _(spark, d):
    return country_panel("country_risk")(spark, d).withColumn("avg_risk", F.round("avg_risk", 6))


@check("country_actor_risk", oracle("""
SELECT actor, round(avg(final_risk), 6) AS avg_risk FROM idx WHERE country = 'CoteIvoire' GROUP BY actor""", "idx"))
def _(spark, d):
    return country_panel("actor_risk", "Côte d'Ivoire")(spark, d).withColumn("avg_risk", F.round("avg_risk", 6))


@check("country_intents", oracle(f"""
SELECT intent, count(*) AS count FROM (SELECT {mapped("lower(trim(strategic_intent))", V.intent_aliases("display"))} AS intent FROM facts
  WHERE upper(target_country) = 'DRC') WHERE intent IS NOT NULL GROUP BY 1""", "facts"))
def _(spark, d):
    return country_panel("intents", "drc")(spark, d)


@check("country_volume", oracle("""
SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM facts WHERE upper(target_country) = 'DRC' AND posting_time IS NOT NULL
GROUP BY 1""", "facts"))
def _(spark, d):
    return country_panel("volume", "DRC")(spark, d)


def author_panel(name):
    def run(spark, d):
        return reports.author_profile(view(spark, d, "articles"), "jean-luc b.")[name]

    return run


@check("author_profile_stats", oracle("""
SELECT count(*) AS total_articles, round(avg(confidence), 6) AS avg_confidence FROM facts WHERE upper(author) = 'JEAN-LUC B.'""", "facts"))
def _(spark, d):
    return author_panel("stats")(spark, d).withColumn("avg_confidence", F.round("avg_confidence", 6))


@check("author_profile_countries", oracle(f"""
SELECT target_country, count(*) AS count FROM facts WHERE upper(author) = 'JEAN-LUC B.' AND {no_placeholder("target_country")} GROUP BY 1
ORDER BY count DESC, target_country NULLS LAST LIMIT 5""", "facts"))
def _(spark, d):
    return author_panel("countries")(spark, d)


@check("author_page", oracle("""
SELECT id, row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS position FROM facts WHERE upper(author) = 'JEAN-LUC B.'
ORDER BY position LIMIT 10""", "facts"))
def _(spark, d):
    return author_panel("articles")(spark, d).select("id", "position")


ASKED = ["USA", "China", "Saudi Arabia", "Turkey"]
BEST = """
, asked(position, actor, article_name, name) AS (VALUES (0, 'USA', 'US', 'UnitedStates'), (1, 'China', 'China', 'China'),
  (2, 'Saudi Arabia', 'Saudi Arabia', 'Saudi'), (3, 'Turkey', 'Turkey', 'Turkey')),
best AS (SELECT actor, final_risk, intent, row_number() OVER (PARTITION BY actor ORDER BY final_risk DESC, intent) AS rn FROM idx
  WHERE country = 'Senegal'),
scores AS (SELECT position, a.actor, article_name, round(COALESCE(final_risk, 0), 3) AS score,
    CASE WHEN final_risk IS NULL THEN 'N/A' WHEN final_risk > 0.7 THEN 'High' WHEN final_risk > 0.4 THEN 'Medium' ELSE 'Low' END AS band,
    COALESCE(intent, 'No Data Found') AS primary_threat
  FROM asked a LEFT JOIN best b ON b.actor = a.name AND rn = 1),
""" + f"""top AS (SELECT * FROM scores ORDER BY score DESC, position LIMIT 1),
about AS (SELECT articles.* FROM articles, top WHERE upper(target_country) = 'SENEGAL' AND upper(inferred_actor) = upper(article_name)
  AND NOT COALESCE({has_any('article_text', V.SPORTS_WORDS_REPORT)}, FALSE))"""


def report_panel(name):
    def run(spark, d):
        return reports.country_report(view(spark, d, "articles"), view(spark, d, "idx"), "senegal", ASKED)[name]

    return run


@check("report_scores", oracle(BEST + " SELECT position, actor, score, band, primary_threat FROM scores", "articles", "idx"))
def _(spark, d):
    return report_panel("scores")(spark, d)


@check("report_summary", oracle(BEST + f"""
SELECT count(*) AS articles, COALESCE((SELECT strategic_intent FROM about WHERE {no_placeholder("strategic_intent")} GROUP BY 1
  ORDER BY count(*) DESC, strategic_intent NULLS LAST LIMIT 1), 'General Influence') AS primary_intent FROM about""", "articles", "idx"))
def _(spark, d):
    return report_panel("summary")(spark, d)


@check("report_narratives", oracle(BEST + """
SELECT id, strategic_intent, tone, COALESCE(strftime(posting_time, '%Y-%m-%d'), 'Unknown') AS day FROM about
WHERE strategic_intent IS NULL OR strategic_intent NOT IN ('', 'Unknown', 'unknown')
ORDER BY posting_time DESC NULLS FIRST, id LIMIT 4""", "articles", "idx"))
def _(spark, d):
    return report_panel("narratives")(spark, d).select("id", "strategic_intent", "tone", "day")


@check("report_volume", oracle(BEST + """
SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM about WHERE posting_time IS NOT NULL GROUP BY 1""", "articles", "idx"))
def _(spark, d):
    return report_panel("volume")(spark, d)


@check("report_volume_by_actor", oracle(BEST + f"""
SELECT a.actor, CAST(posting_time AS DATE) AS day, count(*) AS count FROM asked a JOIN articles
  ON upper(target_country) = 'SENEGAL' AND upper(inferred_actor) = upper(a.article_name)
WHERE posting_time IS NOT NULL AND NOT COALESCE({has_any('article_text', V.SPORTS_WORDS_REPORT)}, FALSE) GROUP BY 1, 2""", "articles", "idx"))
def _(spark, d):
    return report_panel("volume_by_actor")(spark, d)


@check("report_intents", oracle(BEST + f"""
SELECT strategic_intent, count(*) AS count FROM about WHERE {no_placeholder("strategic_intent")} GROUP BY 1
ORDER BY count DESC, strategic_intent NULLS LAST LIMIT 5""", "articles", "idx"))
def _(spark, d):
    return report_panel("intents")(spark, d)


@check("article_listing", oracle(f"""
SELECT id, row_number() OVER (ORDER BY posting_time DESC, id) AS position, COALESCE({LINES}[1][1:100], 'No Title Available') AS display_title FROM articles
WHERE upper(inferred_actor) = 'CHINA' AND CAST(posting_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'
ORDER BY posting_time DESC, id LIMIT 20""", "articles"))
def _(spark, d):
    found = reports.article_listing(view(spark, d, "articles"), actor="China", start="2024-01-03", end="2024-01-25")
    return found.rows.select("id", "position", "display_title")


@check("article_search", oracle("""
SELECT id, row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS position FROM articles WHERE contains(upper(article_text), 'KREMLIN')
ORDER BY position LIMIT 10 OFFSET 10""", "articles"))
def _(spark, d):
    return reports.article_search(view(spark, d, "articles"), "kremlin", 2).rows.select("id", "position")


@check("article_search_by_signature", oracle("""
SELECT id FROM articles WHERE contains(upper(article_text), 'TRADE DEAL') OR contains(upper(author), 'TRADE DEAL')""", "articles"))
def _(spark, d):
    articles = view(spark, d, "articles")
    path = f"{work_folder(spark)}/signatures-{uuid.uuid4().hex}"
    text_search.signatures(articles).write.parquet(path)
    return text_search.search_texts(articles, spark.read.parquet(path), "Trade deal").select("id")


@check("article_search_by_short_query", oracle("""
SELECT id FROM articles WHERE contains(upper(article_text), 'Q2') OR contains(upper(author), 'Q2')""", "articles"))
def _(spark, d):
    articles = view(spark, d, "articles")
    return text_search.search_texts(articles, text_search.signatures(articles), "q2").select("id")


@check("article_page_by_day", oracle("""
SELECT id, posting_time, row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS position FROM facts
ORDER BY position LIMIT 25 OFFSET 500""", "facts"))
def _(spark, d):
    facts = view(spark, d, "facts")
    return paging.paginate_by_part(facts, 21, 25, F.to_date("posting_time")).rows.select("id", "posting_time", "position")


@check("author_page_by_letter", oracle("""
, a AS (SELECT DISTINCT c_name AS author FROM customer)
SELECT author, row_number() OVER (ORDER BY author) AS position FROM a ORDER BY position LIMIT 30 OFFSET 60""", "facts"))
def _(spark, d):
    authors = table(spark, d, "customer").select(F.col("c_name").alias("author")).distinct()
    found = paging.paginate_by_part(authors, 3, 30, F.substring("author", 1, 12), [("author", True, False)], "author")
    return found.rows.select("author", "position")


def kept_rollup(spark, d):
    """The roll-up as a stream of batches leaves it: newest articles first, then late ones, then undated ones, the second
    batch written twice, and all but the last batch merged."""
    articles = view(spark, d, "articles")
    path = f"{work_folder(spark)}/rollup-{uuid.uuid4().hex}"
    middle = F.to_timestamp(F.lit("2024-01-02"))
    batches = [articles.filter(F.col("posting_time") >= middle), articles.filter(F.col("posting_time") < middle),
               articles.filter(F.col("posting_time").isNull())]
    for number in (0, 1, 1):
        rollup.write_counts(batches[number], f"{path}/counts/run=a/batch={number}")
    rollup.merge(spark, f"{path}/counts", f"{path}/merged")
    rollup.write_counts(batches[2], f"{path}/counts/run=b/batch=0")
    return rollup.read(spark, f"{path}/counts", f"{path}/merged")


def rollup_panel(name, **who):
    def run(spark, d):
        return rollup.overview(kept_rollup(spark, d), view(spark, d, "idx"), **who)[name]

    return run


check("rollup_cards", CHECKS["overview_cards"][1])(rollup_panel("cards"))
check("rollup_cards_filtered", CHECKS["overview_cards_filtered"][1])(rollup_panel("cards", country="senegal", actor="russia"))
check("rollup_volume", CHECKS["overview_volume"][1])(rollup_panel("volume"))
check("rollup_countries", oracle(CLEAN + f"""
SELECT target_country, count(*) AS total FROM clean WHERE {no_placeholder("target_country")} GROUP BY 1
ORDER BY total DESC, target_country LIMIT 10""", "articles"))(rollup_panel("countries"))


@check("rollup_daily_volume", oracle("""
SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM facts WHERE posting_time IS NOT NULL GROUP BY 1""", "facts"))
def _(spark, d):
    return rollup.daily_volume(kept_rollup(spark, d))


def context_panel(name, **who):
    def run(spark, d):
        return reports.question_context(view(spark, d, "articles"), **who)[name]

    return run


IN_SCOPE = f"target_country IN {listed(V.MONITORED_COUNTRIES)}"


@check("context_count", oracle(f"""
SELECT count(*) AS articles FROM facts WHERE {IN_SCOPE} AND target_country = 'Senegal' AND inferred_actor = 'China'""", "facts"))
def _(spark, d):
    return context_panel("count", country="senegal", actor="china")(spark, d)


@check("context_intents", oracle("""
SELECT strategic_intent, count(*) AS count FROM facts WHERE target_country = 'Ethiopia' AND (strategic_intent IS NULL OR strategic_intent <> '')
GROUP BY 1 ORDER BY count DESC, strategic_intent NULLS LAST LIMIT 3""", "facts"))
def _(spark, d):
    return context_panel("intents", country="Ethiopia")(spark, d)


@check("context_samples", oracle(f"""
SELECT id, replace(article_text[1:100], chr(10), ' ') AS excerpt, strategic_intent, inferred_actor FROM articles WHERE {IN_SCOPE}
ORDER BY posting_time DESC NULLS FIRST, id LIMIT 3""", "articles"))
def _(spark, d):
    return context_panel("samples")(spark, d).drop("posting_time")


@check("tone_breakdown", oracle("""
SELECT tone, count(*) AS count FROM facts WHERE inferred_actor = 'Turkey' AND (tone IS NULL OR tone <> '') GROUP BY tone""", "facts"))
def _(spark, d):
    return reports.tone_breakdown(view(spark, d, "facts"), "turkey")


@check("foreign_total", oracle(f"""
SELECT count(*) AS total FROM articles WHERE (inferred_actor IS NULL OR inferred_actor NOT IN {listed(V.LOCAL_ACTORS)})
  AND NOT COALESCE(contains(upper(article_text), 'FOOTBALL'), FALSE)""", "articles"))
def _(spark, d):
    return reports.foreign_total(view(spark, d, "articles"))


@check("country_counts_top", oracle(f"""
SELECT strategic_intent, inferred_actor, count(*) AS count FROM facts WHERE upper(target_country) = 'DRC'
  AND (inferred_actor IS NULL OR inferred_actor NOT IN {listed(V.LOCAL_ACTORS)})
  AND (strategic_intent IS NULL OR strategic_intent NOT IN ('', 'unknown', 'Unknown')) GROUP BY 1, 2
ORDER BY count DESC, strategic_intent NULLS LAST, inferred_actor NULLS LAST LIMIT 5""", "facts"))
def _(spark, d):
    return reports.country_counts(view(spark, d, "facts"), "DRC")["top"]


@check("country_narratives", oracle("""
SELECT id, 'SOURCE: ' || COALESCE(media_outlet, 'None') || ' | ACTOR: ' || COALESCE(inferred_actor, 'None') || ' | INTENT: '
  || COALESCE(strategic_intent, 'None') || ' | TEXT: ' || replace(article_text[1:450], chr(10), ' ') AS line FROM articles
WHERE target_country = 'Senegal' AND article_text <> '' AND (inferred_actor IS NULL OR inferred_actor NOT IN ('Local', 'Domestic', ''))
ORDER BY posting_time DESC NULLS FIRST, id LIMIT 12""", "articles"))
def _(spark, d):
    return reports.country_narratives(view(spark, d, "articles"), "senegal")


def audit_panel(name):
    def run(spark, d):
        return audit.audit(view(spark, d, "articles"), "2024-01-25", "chinese", ("DRC",), "2024-01-20")[name]

    return run


@check("audit_recent_pairs", oracle("""
SELECT target_country, inferred_actor, count(*) AS count FROM facts WHERE posting_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2""", "facts"))
def _(spark, d):
    return audit_panel("recent_pairs")(spark, d)


@check("audit_off_target", oracle("""
SELECT id, target_country FROM articles WHERE posting_time >= TIMESTAMP '2024-01-24 00:00:00' AND contains(upper(article_text), 'CHINESE')
  AND target_country <> 'DRC'""", "articles"))
def _(spark, d):
    return audit_panel("off_target")(spark, d).select("id", "target_country")


@check("audit_old_without_target", oracle("""
SELECT count(*) AS count FROM articles WHERE posting_time < TIMESTAMP '2024-01-20 00:00:00' AND NOT (""" + " OR ".join(
    f"contains(upper(article_text), upper({quoted(t)}))" for ts in V.TARGET_TERMS.values() for t in ts) + ")", "articles"))
def _(spark, d):
    return audit_panel("old_without_target")(spark, d)


@check("audit_latest", oracle("""
SELECT id, CAST(length(article_text) AS BIGINT) AS chars FROM articles ORDER BY posting_time DESC NULLS FIRST, id LIMIT 5""", "articles"))
def _(spark, d):
    return audit_panel("latest")(spark, d).select("id", F.col("chars").cast("bigint").alias("chars"))


@check("audit_corrupt_examples", oracle("""
SELECT id, article_text FROM articles WHERE article_text IS NULL OR trim(article_text) = '' OR article_text LIKE 'Failed:%'
  OR article_text LIKE 'Error:%' ORDER BY id LIMIT 3""", "articles"))
def _(spark, d):
    return audit_panel("corrupt")(spark, d).select("id", "article_text")
