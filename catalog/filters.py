"""Predicates (whole tables, whole texts)."""

from pyspark.sql import functions as F

from catalog import check
from catalog.views import has_any, listed, oracle, table, view
from swaymeter import fixed_values as V
from swaymeter.functions import text as X
from swaymeter.functions.base import newest_first, present
from swaymeter.operators import aggregates as A
from swaymeter.operators import filters as P


def counted(df, name="n"):
    return df.agg(F.count("*").alias(name))


@check("filter_case_insensitive", oracle("""
SELECT id, target_country FROM facts WHERE upper(target_country) = 'DRC' AND upper(inferred_actor) = 'CHINA'
  AND upper(strategic_intent) = 'ECONOMIC'""", "facts"))
def _(spark, d):
    return P.matching(view(spark, d, "facts"), "DRC", "china", "ECONOMIC").select("id", "target_country")


@check("exclude_sports_texts", oracle(f"""
SELECT id FROM articles WHERE NOT COALESCE({has_any('article_text', V.SPORTS_WORDS)}, FALSE)""", "articles"))
def _(spark, d):
    return P.without_words(view(spark, d, "articles"), V.SPORTS_WORDS).select("id")


@check("exclude_sports_texts_report", oracle(f"""
SELECT id FROM articles WHERE NOT COALESCE({has_any('article_text', V.SPORTS_WORDS_REPORT)}, FALSE)""", "articles"))
def _(spark, d):
    return P.without_words(view(spark, d, "articles"), V.SPORTS_WORDS_REPORT).select("id")


@check("filter_monitored_countries", oracle(f"""
SELECT target_country, count(*) AS n FROM facts WHERE target_country IN {listed(V.MONITORED_COUNTRIES)}
GROUP BY target_country""", "facts"))
def _(spark, d):
    return A.count_by(view(spark, d, "facts").filter(P.monitored()), "target_country", name="n")


@check("exclude_placeholders_keep_null", oracle("""
SELECT strategic_intent, count(*) AS n FROM facts
WHERE NOT (strategic_intent IN ('', 'Unknown') AND strategic_intent IS NOT NULL) GROUP BY strategic_intent""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").filter(P.no_placeholder("strategic_intent"))
    return A.count_by(df, "strategic_intent", name="n")


@check("exclude_local_actors", oracle(f"""
SELECT inferred_actor, count(*) AS n FROM facts
WHERE inferred_actor IS NULL OR inferred_actor NOT IN {listed(V.LOCAL_ACTORS)} GROUP BY inferred_actor""", "facts"))
def _(spark, d):
    return A.count_by(view(spark, d, "facts").filter(P.foreign()), "inferred_actor", name="n")


@check("filter_missing_intent", oracle("""
SELECT id FROM articles WHERE (strategic_intent IS NULL OR strategic_intent = '') AND article_text IS NOT NULL
  AND article_text <> '' AND upper(article_text) <> 'NO CONTENT AVAILABLE'""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(P.needs_intent()).select("id")


@check("filter_needs_processing", oracle(f"""
SELECT id FROM articles WHERE article_text <> '' AND target_country <> '' AND inferred_actor <> ''
  AND target_country IN {listed(V.MONITORED_COUNTRIES)}
  AND (strategic_intent IS NULL OR strategic_intent = '' OR tone IS NULL OR tone = '')""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(P.needs_processing()).select("id")


@check("split_labelled_unlabelled", oracle("""
SELECT CASE WHEN strategic_intent IS NULL OR tone IS NULL OR target_country IS NULL OR inferred_actor IS NULL
  THEN 'unlabelled' ELSE 'labelled' END AS state, count(*) AS n FROM facts GROUP BY 1""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts")
    state = F.when(P.labelled(), F.lit("labelled")).when(P.unlabelled(), F.lit("unlabelled"))
    return A.count_by(df.withColumn("state", state), "state", name="n")


@check("filter_null_or_listed", oracle(f"""
SELECT target_country, inferred_actor, count(*) AS n FROM facts
WHERE (target_country IS NULL OR upper(target_country) IN {listed(c.upper() for c in V.PIPELINE_COUNTRIES)})
  AND (inferred_actor IS NULL OR upper(inferred_actor) IN {listed(c.upper() for c in V.PIPELINE_ACTORS)})
GROUP BY target_country, inferred_actor""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").filter(P.null_or_iexact("target_country", V.PIPELINE_COUNTRIES)
                                        & P.null_or_iexact("inferred_actor", V.PIPELINE_ACTORS))
    return A.count_by(df, "target_country", "inferred_actor", name="n")


@check("filter_day_range", oracle("""
SELECT id FROM facts WHERE CAST(posting_time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.between_days("posting_time", "2024-01-10", "2024-01-20")).select("id")


@check("filter_day_range_bad_bound", oracle("""
SELECT id FROM facts WHERE CAST(posting_time AS DATE) <= DATE '2024-01-05'""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.between_days("posting_time", "soon", "2024-01-05")).select("id")


@check("filter_recent", oracle("""
SELECT id FROM facts WHERE posting_time >= TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 2 DAY""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.since("posting_time", "2024-01-28 12:00:00", 2)).select("id")


@check("filter_valid_author", oracle(f"""
SELECT author, count(*) AS n FROM facts WHERE author NOT IN {listed(V.PLACEHOLDER_AUTHORS)}
  AND NOT regexp_matches(author, '^https?://') AND regexp_matches(author, '^[A-Za-z\\s.''-]+$')
  AND length(trim(author)) > 2 GROUP BY author""", "facts"))
def _(spark, d):
    return A.count_by(view(spark, d, "facts").filter(P.listed_author()), "author", name="n")


@check("filter_null_like", oracle("""
SELECT id FROM facts WHERE strategic_intent IS NULL OR lower(trim(strategic_intent)) IN
  ('', 'null', 'none', 'n/a', 'unknown', 'tbd', 'nan', 'na')""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.null_like("strategic_intent")).select("id")


@check("filter_text_length", oracle("""
SELECT CAST(count(CASE WHEN length(article_text) > 100 THEN 1 END) AS BIGINT) AS over_100,
  CAST(count(CASE WHEN length(article_text) > 500 THEN 1 END) AS BIGINT) AS over_500,
  CAST(count(CASE WHEN length(article_text) > 1000 THEN 1 END) AS BIGINT) AS over_1000 FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").agg(*[F.count_if(P.longer_than("article_text", n)).alias(f"over_{n}")
                                            for n in (100, 500, 1000)])


@check("filter_corrupt_text", oracle("""
SELECT id FROM articles WHERE article_text IS NULL OR trim(article_text) = '' OR article_text LIKE 'Failed:%'
  OR article_text LIKE 'Error:%' OR article_text IN
  ('Failed to extract content (page might be dynamic or empty)', 'Failed: Empty Content')""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(X.is_corrupt("article_text")).select("id")


@check("filter_scrape_ok", oracle("""
SELECT id, NOT contains(article_text, 'Failed') AND NOT contains(article_text, 'Error') AS strict FROM articles
WHERE NOT starts_with(article_text, 'Failed:') AND NOT starts_with(article_text, 'Error:')""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(P.scrape_ok("article_text")).select(
        "id", P.scrape_ok("article_text", strict=True).alias("strict"))


@check("filter_relevant", oracle("""
SELECT id FROM articles WHERE article_text <> '' AND target_country <> ''
  AND contains(lower(article_text), lower(target_country))""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(P.relevant("article_text", "target_country")).select("id")


@check("filter_old_without_target", oracle("""
SELECT id FROM articles WHERE posting_time < TIMESTAMP '2024-01-20 00:00:00' AND """
    + " AND ".join(f"NOT {has_any('article_text', t)}" for t in V.TARGET_TERMS.values()), "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(P.old_without_target("2024-01-20")).select("id")


@check("filter_term_outside_country", oracle("""
SELECT id FROM articles WHERE posting_time >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 1 DAY
  AND article_text ILIKE '%CHINESE%'
  AND target_country NOT IN ('South Africa', 'DRC')""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").filter(
        P.since("posting_time", "2024-01-25", 1)
        & P.term_outside_country("chinese", ["South Africa", "DRC"])).select("id")


@check("search_text_or_author", oracle("""
SELECT id FROM articles WHERE contains(upper(article_text), 'KREMLIN') OR contains(upper(author), 'KREMLIN')
UNION ALL SELECT id FROM articles WHERE contains(upper(author), 'O''NEIL')""", "articles"))
def _(spark, d):
    df = view(spark, d, "articles")
    both = df.filter(P.search("kremlin", "article_text", "author")).select("id")
    return both.unionByName(df.filter(P.search("o'neil", "author")).select("id"))


@check("keyword_query", oracle(r"""
SELECT id FROM articles WHERE regexp_matches(lower(article_text), '(^|[^\p{L}\p{N}_])(senegal|dakar|abidjan)($|[^\p{L}\p{N}_])')
  AND regexp_matches(lower(article_text), '(^|[^\p{L}\p{N}_])(invest|trade($|[^\p{L}\p{N}_])|cocoa($|[^\p{L}\p{N}_])|health($|[^\p{L}\p{N}_]))')
  AND NOT regexp_matches(lower(article_text), '(^|[^\p{L}\p{N}_])football($|[^\p{L}\p{N}_])')""", "articles"))
def _(spark, d):
    wanted = P.keyword_query("article_text", [["Senegal", "Dakar", "Abidjan"], ["invest*", "trade", "cocoa", "health"]],
                             ["football"])
    return view(spark, d, "articles").filter(wanted).select("id")


@check("filter_tuple_tone", oracle("SELECT id, tone FROM facts WHERE tone LIKE '(%'", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.tuple_tone()).select("id", "tone")


@check("filter_valid_pair", oracle("""
SELECT id FROM facts
WHERE replace(lower(target_country), ' ', '') IN ('senegal', 'drc', 'ethiopia', 'coted''ivoire', 'ivorycoast', 'southafrica')
  AND replace(lower(inferred_actor), ' ', '') IN ('china', 'france', 'russia', 'usa', 'saudi', 'turkey', 'uae', 'israel',
  'iran', 'rwanda')""", "facts"))
def _(spark, d):
    from swaymeter.functions.labels import is_valid_pair

    return view(spark, d, "facts").filter(is_valid_pair("target_country", "inferred_actor")).select("id")


@check("filter_has_label", oracle("""
SELECT id FROM facts WHERE lower(COALESCE(inferred_actor, '')) NOT IN ('unknown', 'none', 'null', '')
  AND lower(COALESCE(target_country, '')) NOT IN ('unknown', 'none', 'null', '')""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.has_label("inferred_actor") & P.has_label("target_country")).select("id")


@check("filter_lacks_author", oracle("""
SELECT id, author IS NULL AS is_null FROM facts
WHERE (author IS NULL OR author IN ('Unknown', '')) AND url <> ''""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").filter(P.lacks_author(include_null=True)).select(
        "id", F.col("author").isNull().alias("is_null"))


@check("project_display_row", oracle("""
SELECT f.id, COALESCE(o.name, CASE WHEN media_outlet <> '' THEN media_outlet END, 'Unknown') || ' - '
  || COALESCE(strftime(posting_time, '%Y-%m-%d'), 'No date') AS shown
FROM facts f LEFT JOIN outlets o ON o.id = f.media_outlet_fk""", "facts", "outlets"))
def _(spark, d):
    outlets = view(spark, d, "outlets").select(F.col("id").alias("media_outlet_fk"), "name")
    df = view(spark, d, "facts").join(outlets, "media_outlet_fk", "left")
    name = F.coalesce("name", F.when(present("media_outlet"), F.col("media_outlet")), F.lit("Unknown"))
    return df.select("id", F.concat(name, F.lit(" - "), X.format_day("posting_time", default="No date")).alias("shown"))


@check("project_pair_label", oracle("""
SELECT target_country || ' - ' || inferred_actor AS label, count(*) AS n FROM facts GROUP BY 1""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").withColumn("label", F.concat("target_country", F.lit(" - "), "inferred_actor"))
    return A.count_by(df, "label", name="n")


@check("drop_undated", oracle("SELECT count(*) AS n FROM facts WHERE posting_time IS NOT NULL", "facts"))
def _(spark, d):
    return counted(view(spark, d, "facts").filter(F.col("posting_time").isNotNull()))


@check("scan_projected_columns", "SELECT event_id, user_id, value FROM events WHERE value > 100")
def _(spark, d):
    from swaymeter.sources.readers import read_table

    return read_table(spark, f"{d}/events.parquet", "event_id", "user_id", "value").filter(F.col("value") > 100)


@check("scan_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS chars FROM pages")
def _(spark, d):
    from swaymeter.sources.readers import read_pages

    return read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@check("null_order_of_latest", oracle("""
SELECT id FROM facts ORDER BY posting_time DESC NULLS FIRST, id LIMIT 400""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").orderBy(newest_first("posting_time"), "id").limit(400).select("id")


@check("search_documents", "SELECT count(*) AS n FROM documents WHERE contains(upper(text), 'GAME')")
def _(spark, d):
    return counted(table(spark, d, "documents").filter(P.search("game", "text")))
