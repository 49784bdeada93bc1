"""Text, date, url, reply and HTML functions over whole texts."""

from pyspark.sql import functions as F

from catalog import check
from catalog.views import low_any, oracle, table, view
from swaymeter import fixed_values as V
from swaymeter.functions import text as X
from swaymeter.operators import html

SP = r"[\s\p{Z}]"
TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def trim(x):
    return TRIM.format(x)


LINES = ("list_filter(list_transform(string_split_regex(article_text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), "
         "lambda x: " + trim("x") + "), lambda x: x <> '')")
WORDS = "list_filter(string_split_regex(article_text, '[\\s\\p{Z}]+'), lambda x: x <> '')"


@check("model_input", oracle(f"""
SELECT id, md5({trim("COALESCE(article_text, '')")}[1:4000]) AS cut FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", F.md5(X.model_input("article_text")).alias("cut"))


@check("detect_french", oracle("""
, t AS (SELECT id, ' ' || substr(lower(COALESCE(article_text, '')), 1, 512) || ' ' AS s FROM articles)
SELECT id, CASE WHEN """ + " + ".join(f"CAST(contains(s, ' {w} ') AS INT)" for w in V.FRENCH_WORDS) + """ > 3
  THEN 'fr' ELSE 'en' END AS lang FROM t""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.detect_french("article_text").alias("lang"))


@check("detect_french_whole_text", oracle("""
, t AS (SELECT id, ' ' || lower(COALESCE(article_text, '')) || ' ' AS s FROM articles)
SELECT id, CASE WHEN """ + " + ".join(f"CAST(contains(s, ' {w} ') AS INT)" for w in V.FRENCH_WORDS) + """ > 3
  THEN 'fr' ELSE 'en' END AS lang FROM t""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.detect_french("article_text", None).alias("lang"))


@check("display_title", oracle(f"""
, t AS (SELECT id, article_text, {LINES} AS lines, {WORDS} AS words FROM articles),
c AS (SELECT *, list_filter(lines[1:3], lambda x: NOT regexp_matches(x, '(?i)^(By|On|Updated|Source:|Published|https?://|.*\\d{{4}})')
    AND length(x) BETWEEN 5 AND 250)[1] AS candidate FROM t)
SELECT id, CASE WHEN COALESCE(article_text, '') = '' THEN 'No Content Available' WHEN len(lines) = 0 THEN 'Empty Article'
  ELSE COALESCE(candidate, array_to_string(words[1:20], ' ') || CASE WHEN len(words) > 20 THEN '...' ELSE '' END) END AS title
FROM c""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.display_title("article_text").alias("title"))


@check("simple_title", oracle(f"""
SELECT id, COALESCE({LINES}[1][1:100], 'No Title Available') AS title FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.simple_title("article_text").alias("title"))


@check("display_summary", oracle(f"""
, t AS (SELECT id, {trim("replace(article_text, chr(10), ' ')")} AS flat FROM articles),
h AS (SELECT id, flat, flat[1:500] AS head, strpos(reverse(flat[1:500]), ' ') AS back FROM t)
SELECT id, CASE WHEN length(flat) > 500 THEN CASE WHEN back > 0 AND back < 500 THEN head[1:500 - back] ELSE head END || '…'
  ELSE flat END AS summary FROM h""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.display_summary("article_text").alias("summary"))


@check("narrative_summary", oracle("""
SELECT id, CASE WHEN lang_detect <> '' THEN lang_detect WHEN tone <> '' THEN tone WHEN strategic_intent <> '' THEN strategic_intent
  WHEN article_text <> '' THEN article_text[1:100] || '...' ELSE 'No summary available' END AS summary FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select(
        "id", X.narrative_summary("lang_detect", "tone", "strategic_intent", "article_text").alias("summary"))


@check("source_line", oracle("""
SELECT id, 'SOURCE: ' || COALESCE(media_outlet, 'None') || ' | ACTOR: ' || COALESCE(inferred_actor, 'None') || ' | INTENT: '
  || COALESCE(strategic_intent, 'None') || ' | TEXT: ' || replace(COALESCE(article_text[1:450], ''), chr(10), ' ') AS line
FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select(
        "id", X.source_line("media_outlet", "inferred_actor", "strategic_intent", "article_text").alias("line"))


@check("truncate_words", oracle(f"""
, t AS (SELECT id, {WORDS} AS w FROM articles)
SELECT id, array_to_string(w[1:12], ' ') || CASE WHEN len(w) > 12 THEN ' …' ELSE '' END AS w12,
  array_to_string(w[1:45], ' ') || CASE WHEN len(w) > 45 THEN ' …' ELSE '' END AS w45 FROM t""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.truncate_words("article_text", 12).alias("w12"),
                                             X.truncate_words("article_text", 45).alias("w45"))


@check("summary_guard", oracle(f"""
SELECT id, CASE WHEN length({trim("COALESCE(article_text, '')")}) < 200
  THEN 'Summary not available (article too short).' END AS message FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.summary_guard("article_text").alias("message"))


@check("parse_timestamps", """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
    ELSE 'around noon' END AS written FROM orders)
SELECT o_orderkey, CAST(COALESCE(try_strptime(written, '%m/%d/%Y %H:%M'), try_strptime(written, '%Y-%m-%d %H:%M:%S'),
  try_strptime(written, '%d/%m/%Y %H:%M')) AS DATE) AS day FROM s""")
def _(spark, d):
    key, date = F.col("o_orderkey") % 4, F.col("o_orderdate")
    written = (F.when(key == 0, F.date_format(date, "MM/dd/yyyy HH:mm")).when(key == 1, F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
               .when(key == 2, F.date_format(date, "dd/MM/yyyy HH:mm")).otherwise("around noon"))
    return table(spark, d, "orders").select("o_orderkey", F.to_date(X.parse_timestamp(written)).alias("day"))


@check("date_in_text", oracle(r"""
, t AS (SELECT id, article_text[1:300] AS head FROM articles),
m AS (SELECT id, regexp_extract(head, '\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b', 1) AS a,
    regexp_extract(head, '\b([0-9A-Za-z_]+ \d{1,2}, \d{4})\b', 1) AS b, regexp_extract(head, '\b(\d{1,2} [0-9A-Za-z_]+ \d{4})\b', 1) AS c FROM t)
SELECT id, CAST(CASE WHEN a <> '' THEN COALESCE(try_strptime(replace(a, '-', '/'), '%d/%m/%Y'), try_strptime(replace(a, '-', '/'), '%m/%d/%Y'))
  WHEN b <> '' THEN try_strptime(b, '%B %d, %Y') WHEN c <> '' THEN try_strptime(c, '%d %B %Y') END AS DATE) AS day FROM m""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", X.date_in_text("article_text").alias("day"))


@check("format_days", oracle("""
SELECT id, COALESCE(strftime(posting_time, '%Y-%m-%d'), 'Unknown') AS iso, COALESCE(strftime(posting_time, '%B %d, %Y'), 'Unknown') AS long
FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", X.format_day("posting_time").alias("iso"),
                                          X.format_day("posting_time", "MMMM dd, yyyy").alias("long"))


@check("format_numbers", """
SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_decimal("o_totalprice", 2).alias("price"))


@check("safe_casts", """
SELECT event_id, TRY_CAST(regexp_extract(props, ': (.*)}', 1) AS INT) AS k,
  COALESCE(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN ' ' || CAST(value AS STRING) || ' ' ELSE event_type END AS DOUBLE), 4.0) AS conf,
  event_type = 'view' AS flag FROM events""")
def _(spark, d):
    number = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).otherwise(F.col("event_type"))
    flag = F.when(F.col("event_type") == "view", " TRUE ").otherwise("no")
    return table(spark, d, "events").select(
        "event_id", X.safe_int(F.regexp_extract("props", ": (.*)}", 1)).alias("k"), X.safe_double(number, 4.0).alias("conf"),
        X.safe_bool(flag).alias("flag"))


@check("map_get_or_zero", """
SELECT event_id, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 5 ELSE 0 END AS weight FROM events""")
def _(spark, d):
    weights = F.create_map(F.lit("view"), F.lit(3), F.lit("click"), F.lit(5))
    return table(spark, d, "events").select("event_id", X.get_or_zero(weights, "event_type").alias("weight"))


@check("display_labels", oracle("""
SELECT id, CASE WHEN COALESCE(strategic_intent, '') = '' THEN 'General' ELSE array_to_string(list_transform(
  string_split(lower(strategic_intent), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS label FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", X.label_or("strategic_intent", "General").alias("label"))


LINKS = """
SELECT page_id, url AS base, CASE page_id % 8 WHEN 0 THEN '//cdn.example.com/Images/a.bin' WHEN 1 THEN '/photos/b' WHEN 2 THEN 'c.PNG?x=1'
  WHEN 3 THEN 'http://other.example/d.jpeg' WHEN 4 THEN '' WHEN 5 THEN 'upload/e.svg#top' WHEN 6 THEN '/static/logo.png'
  ELSE url END AS link FROM pages"""


@check("absolute_urls", f"""
WITH l AS ({LINKS}), p AS (SELECT *, regexp_extract(base, '^[a-z]+://[^/?#]*') AS root, regexp_replace(base, '[?#].*$', '') AS page FROM l)
SELECT page_id, CASE WHEN link = '' THEN NULL WHEN link LIKE '//%' THEN 'https:' || link WHEN link LIKE '/%' THEN root || link
  WHEN link LIKE 'http%' THEN link WHEN regexp_matches(page, '://[^/]*/') THEN regexp_replace(page, '[^/]*$', '') || link
  ELSE page || '/' || link END AS full_url FROM p""")
def _(spark, d):
    links = spark.sql(LINKS.replace("FROM pages", "FROM {p}"), p=table(spark, d, "pages"))
    return links.select("page_id", X.absolute_url("link", "base").alias("full_url"))


@check("image_urls", f"""
WITH l AS ({LINKS}), p AS (SELECT *, regexp_replace(regexp_replace(lower(link), '[?#].*$', ''), '^([a-z]+:)?//[^/]*', '') AS path FROM l)
SELECT page_id, link <> '' AND (regexp_matches(path, '\\.(jpg|jpeg|png|gif|webp|bmp|svg|ico)$') OR contains(path, '/image')
    OR contains(path, '/img') OR contains(path, '/photo') OR contains(path, '/pic')) AS image,
  link <> '' AND NOT {low_any("lower(link)", V.IMAGE_STOP_WORDS)} AS meaningful FROM p""")
def _(spark, d):
    links = spark.sql(LINKS.replace("FROM pages", "FROM {p}"), p=table(spark, d, "pages"))
    return links.select("page_id", X.is_image_url("link").alias("image"), X.is_meaningful_image("link").alias("meaningful"))


# replies around every event: plain, fenced, two blocks, broken, none
REPLIES = """
SELECT event_id, CASE event_id % 6
  WHEN 0 THEN '{"strategic_intent": "' || event_type || '", "strategic_intent_conf": ' || CAST(CAST(event_id % 100 AS DOUBLE) / 100 AS STRING) || ', "notes": "ok"}'
  WHEN 1 THEN 'Sure: {"a": 1} then {"strategic_intent": "' || event_type || '", "strategic_intent_conf": "0.5"}'
  WHEN 2 THEN '{"strategic_intent": "' || event_type || '" "strategic_intent_conf": 0.25}'
  WHEN 3 THEN 'no idea about ' || event_type
  WHEN 4 THEN '"strategic_intent": "' || event_type || '", "strategic_intent_conf": 0.75, "notes": "loose"'
  ELSE props END AS reply FROM events"""


@check("parse_replies", f"""
WITH r AS ({REPLIES})
SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'Neutral' WHEN 5 THEN 'Neutral' ELSE regexp_extract(reply, '"strategic_intent": "([^"]+)"', 1) END AS intent,
  CASE event_id % 6 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 4 THEN 0.75 ELSE 0.0 END AS conf,
  CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN '' WHEN 2 THEN 'Extracted via Regex from block' WHEN 3 THEN 'Extracted via Regex'
    WHEN 4 THEN 'loose' ELSE '' END AS notes FROM r""")
def _(spark, d):
    replies = spark.sql(REPLIES.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))
    return replies.withColumn("p", X.parse_reply("reply")).select("event_id", "p.intent", "p.conf", "p.notes")


# every page with authors and images of several forms put in front of its own markup
def marked_pages(spark, d):
    return spark.sql(MARKED.replace("FROM pages", "FROM {p}"), p=table(spark, d, "pages"))


MARKED = """
SELECT page_id, 'https://site.example/a/b' AS url, CASE page_id % 6
  WHEN 0 THEN '<meta name="author" content=" Mary Major "><meta property="og:image" content="/img/lead.jpg">'
  WHEN 1 THEN '<meta name="author" content="Staff"><script type="application/ld+json">[{{"author": {{"name": "Li Wei"}}, "image": {{"url": "//cdn.example/x.png"}}}}]</script>'
  WHEN 2 THEN '<p class="lead byline">By <b>Awa Diop</b></p><img src="/static/logo.png"><article><img src="pics/one.gif"></article>'
  WHEN 3 THEN '<p>By Jane Q. Doe, reporter</p><img src="/banner.jpg"><img src="two.webp">'
  ELSE '' END || html AS html FROM pages"""


@check("page_authors", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Mary Major' WHEN 1 THEN 'Li Wei' WHEN 2 THEN 'Awa Diop' WHEN 3 THEN 'Jane Q. Doe' END AS author
FROM pages""")
def _(spark, d):
    return html.page_authors(marked_pages(spark, d)).select("page_id", "author")


@check("page_logos", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://site.example/static/logo.png' WHEN 1 THEN 'https://site.example/icon.png' END AS logo FROM pages""")
def _(spark, d):
    head = (F.when(F.col("page_id") % 3 == 0, F.lit('<header><img src="/static/logo.png" alt="Logo"></header>'))
            .when(F.col("page_id") % 3 == 1, F.lit('<link rel="apple-touch-icon" href="/icon.png">')).otherwise(F.lit("")))
    home = table(spark, d, "pages").select("page_id", F.lit("https://site.example/").alias("url"), F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))
    return html.page_logos(home).select("page_id", "logo")


@check("page_scan_errors", """
SELECT page_id, page_id % 5 = 0 AS broken, page_id % 5 > 0 OR page_id % 2 = 0 AS has_author FROM pages""")
def _(spark, d):
    before = F.when(F.col("page_id") % 2 == 0, F.lit('<meta name="author" content="Ana Lo">')).otherwise(F.lit(""))
    odd = F.when(F.col("page_id") % 5 == 0, F.lit("<![foo[bar]]>")).otherwise(F.lit('<meta name="author" content="Bo Li">'))
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(before, odd, F.coalesce("html", F.lit(""))).alias("html"))
    scanned = html.scan_pages(pages)
    return scanned.select("page_id", F.col("error").isNotNull().alias("broken"), F.exists("metas", lambda m: m["name"] == "author").alias("has_author"))


@check("page_images", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://site.example/img/lead.jpg' WHEN 1 THEN 'https://cdn.example/x.png'
  WHEN 2 THEN 'https://site.example/a/pics/one.gif' WHEN 3 THEN 'https://site.example/a/two.webp' END AS image FROM pages""")
def _(spark, d):
    return html.page_images(marked_pages(spark, d)).select("page_id", "image")
