"""Counts, means, picks, windows, pages and set operations."""

from pyspark.sql import functions as F

from catalog import check
from catalog.views import mapped, oracle, table, view
from swaymeter import fixed_values as V
from swaymeter.operators import aggregates as A
from swaymeter.operators import filters as P
from swaymeter.operators import paging, sets
from swaymeter.plans import audit, reports


@check("count_all_and_filtered", oracle("""
SELECT count(*) AS total, count(CASE WHEN strategic_intent IS NULL THEN 1 END) AS no_intent,
  max(CASE WHEN inferred_actor = 'China' THEN 1 ELSE 0 END) = 1 AS any_china FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").agg(
        F.count("*").alias("total"), F.count_if(F.col("strategic_intent").isNull()).alias("no_intent"),
        F.coalesce(F.bool_or(F.col("inferred_actor") == "China"), F.lit(False)).alias("any_china"))


@check("top_outlets", oracle("""
SELECT media_outlet, count(*) AS article_count FROM facts WHERE media_outlet <> '' GROUP BY media_outlet
ORDER BY article_count DESC, media_outlet LIMIT 10""", "facts"))
def _(spark, d):
    return reports.top_outlets(view(spark, d, "facts"))


@check("top_actors", oracle("""
SELECT inferred_actor, count(*) AS n FROM facts WHERE inferred_actor IS NULL OR inferred_actor NOT IN ('', 'Unknown')
GROUP BY inferred_actor ORDER BY n DESC, inferred_actor NULLS LAST LIMIT 5""", "facts"))
def _(spark, d):
    return A.top_counts(view(spark, d, "facts").filter(P.no_placeholder("inferred_actor")), "inferred_actor", n=5, name="n")


@check("top_actor_country_pairs", oracle("""
SELECT target_country, inferred_actor, count(*) AS n FROM facts
WHERE (target_country IS NULL OR target_country NOT IN ('', 'Unknown'))
  AND (inferred_actor IS NULL OR inferred_actor NOT IN ('', 'Unknown'))
GROUP BY target_country, inferred_actor
ORDER BY n DESC, target_country NULLS LAST, inferred_actor NULLS LAST LIMIT 10""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").filter(P.no_placeholder("target_country") & P.no_placeholder("inferred_actor"))
    return A.top_counts(df, "target_country", "inferred_actor", n=10, name="n")


@check("top_subjects_mapped_after_limit", oracle(f"""
SELECT strategic_intent, inferred_actor, target_country, total,
  {mapped("lower(strategic_intent)", V.intent_aliases("display"))} AS canonical_intent
FROM (SELECT strategic_intent, inferred_actor, target_country, count(*) AS total FROM facts
  WHERE strategic_intent IS NULL OR strategic_intent <> '' GROUP BY ALL
  ORDER BY total DESC, strategic_intent NULLS LAST, inferred_actor NULLS LAST, target_country NULLS LAST LIMIT 5)""",
    "facts"))
def _(spark, d):
    return reports.top_subjects(view(spark, d, "facts"))


@check("intent_breadth", oracle("""
SELECT strategic_intent, count(*) AS count, count(DISTINCT target_country) AS countries,
  count(DISTINCT inferred_actor) AS actors, CAST(sum(count(*)) OVER () AS BIGINT) AS total
FROM facts WHERE strategic_intent NOT IN ('', 'Unknown') GROUP BY strategic_intent""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").filter(P.no_placeholder("strategic_intent", drop_null=True))
    return A.breadth(df, "strategic_intent")


@check("distinct_cardinality_null_counted", oracle("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT media_outlet FROM facts)) AS with_null,
  (SELECT count(DISTINCT media_outlet) FROM facts) AS without_null""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").agg(A.distinct_values("media_outlet").alias("with_null"),
                                       F.count_distinct("media_outlet").alias("without_null"))


@check("mean_confidence_by_outlet", oracle("""
SELECT media_outlet, count(*) AS articles, round(avg(confidence), 6) AS avg_confidence FROM facts
GROUP BY media_outlet""", "facts"))
def _(spark, d):
    return A.mean_confidence(view(spark, d, "facts"), "media_outlet").withColumn(
        "avg_confidence", F.round("avg_confidence", 6))


@check("mean_risk_by_country", oracle("""
SELECT country, round(avg(final_risk), 6) AS avg_risk FROM idx GROUP BY country""", "idx"))
def _(spark, d):
    return A.mean_risk(view(spark, d, "idx"), "country").withColumn("avg_risk", F.round("avg_risk", 6))


@check("max_risk_by_pair", oracle("""
SELECT country, actor, max(final_risk) AS max_risk FROM idx GROUP BY country, actor""", "idx"))
def _(spark, d):
    return A.max_risk(view(spark, d, "idx"), "country", "actor")


@check("daily_volume", oracle("""
SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM facts WHERE posting_time IS NOT NULL GROUP BY 1""",
    "facts"))
def _(spark, d):
    return A.daily_volume(view(spark, d, "facts"))


@check("latest_500_volume", oracle("""
SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM (SELECT posting_time FROM facts
  WHERE posting_time IS NOT NULL ORDER BY posting_time DESC, id LIMIT 500) GROUP BY 1""", "facts"))
def _(spark, d):
    return A.latest_volume(view(spark, d, "facts"))


@check("recount_after_mapping", oracle(f"""
SELECT intent, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT {mapped("lower(strategic_intent)", V.intent_aliases("display"))} AS intent, count(*) AS n FROM facts
  WHERE strategic_intent IS NOT NULL AND lower(trim(strategic_intent)) NOT IN ('', 'unknown') GROUP BY 1)
WHERE intent IS NOT NULL GROUP BY intent""", "facts"))
def _(spark, d):
    return reports.intent_distribution(view(spark, d, "facts"))


@check("author_statistics", oracle("""
SELECT author, count(*) AS articles, round(avg(confidence), 6) AS avg_confidence FROM facts
WHERE author NOT IN ('', 'Unknown') AND regexp_matches(author, '^[A-Za-z\\s.''-]+$') GROUP BY author
HAVING count(*) >= 1""", "facts"))
def _(spark, d):
    return A.author_stats(view(spark, d, "facts").filter(P.valid_author())).withColumn(
        "avg_confidence", F.round("avg_confidence", 6))


@check("compare_actors", oracle("""
, mine AS (SELECT * FROM facts WHERE upper(target_country) = 'SENEGAL'),
named AS (SELECT 'China' AS actor UNION ALL SELECT 'Russia' UNION ALL SELECT 'Nobody')
SELECT actor, (SELECT count(*) FROM mine WHERE upper(inferred_actor) = upper(actor)) AS articles,
  COALESCE((SELECT COALESCE(strategic_intent, 'N/A') FROM mine WHERE upper(inferred_actor) = upper(actor)
    AND (strategic_intent IS NULL OR strategic_intent <> '') GROUP BY strategic_intent
    ORDER BY count(*) DESC, strategic_intent NULLS FIRST LIMIT 1), 'N/A') AS top_intent
FROM named""", "facts"))
def _(spark, d):
    return reports.compare_actors(view(spark, d, "facts"), ["China", "Russia", "Nobody"], "Senegal")


@check("actor_statistics_with_risk", oracle("""
, stats AS (SELECT inferred_actor, count(*) AS articles, round(avg(confidence), 6) AS avg_confidence,
    CASE lower(inferred_actor) WHEN 'us' THEN 'UnitedStates' WHEN 'united states' THEN 'UnitedStates'
      WHEN 'saudi arabia' THEN 'Saudi' ELSE inferred_actor END AS name
  FROM facts WHERE inferred_actor IS NULL OR inferred_actor NOT IN ('', 'Unknown') GROUP BY inferred_actor)
SELECT inferred_actor, articles, avg_confidence, avg_risk FROM stats
LEFT JOIN (SELECT actor, round(avg(final_risk), 6) AS avg_risk FROM idx GROUP BY actor) r ON r.actor = name""",
    "facts", "idx"))
def _(spark, d):
    out = reports.actor_statistics(view(spark, d, "facts"), view(spark, d, "idx"))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "avg_risk")})


@check("quality_profile", oracle("""
SELECT count(*) AS total, count(CASE WHEN article_text IS NULL OR trim(article_text) = '' OR article_text LIKE 'Failed:%'
    OR article_text LIKE 'Error:%' THEN 1 END) AS corrupt,
  count(CASE WHEN strategic_intent IS NOT NULL AND tone IS NOT NULL AND target_country IS NOT NULL
    AND inferred_actor IS NOT NULL THEN 1 END) AS labelled,
  count(CASE WHEN strategic_intent IS NULL OR tone IS NULL OR target_country IS NULL OR inferred_actor IS NULL
    THEN 1 END) AS unlabelled,
  round(avg(length(article_text)), 6) AS mean_chars FROM articles""", "articles"))
def _(spark, d):
    return audit.quality_profile(view(spark, d, "articles")).withColumn("mean_chars", F.round("mean_chars", 6))


@check("collection_health", """
WITH c AS (SELECT n_name AS actor FROM nation UNION ALL SELECT 'ATLANTIS'),
  s AS (SELECT n_name AS actor, count(*) AS stories FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name)
SELECT c.actor, COALESCE(stories, 0) AS stories FROM c LEFT JOIN s ON s.actor = c.actor""")
def _(spark, d):
    nation, customer, orders = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    names = nation.select(F.col("n_name").alias("actor"))
    all_names = names.unionByName(spark.createDataFrame([("ATLANTIS",)], "actor string"))
    stories = (orders.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
               .join(customer, F.col("o_custkey") == F.col("c_custkey"))
               .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
               .select(F.col("n_name").alias("actor")))
    return A.collection_health(stories, all_names, "actor")


@check("outcome_summary", """
SELECT event_type, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 1) AS percent
FROM events GROUP BY event_type""")
def _(spark, d):
    return A.outcome_summary(table(spark, d, "events"), "event_type")


@check("home_totals", oracle("""
SELECT count(*) AS articles,
  (SELECT count(*) FROM (SELECT DISTINCT target_country FROM facts
    WHERE target_country IS NULL OR target_country NOT IN ('', 'Unknown'))) AS countries,
  (SELECT count(*) FROM (SELECT DISTINCT inferred_actor FROM facts
    WHERE inferred_actor IS NULL OR inferred_actor NOT IN ('', 'Unknown'))) AS actors FROM facts""", "facts"))
def _(spark, d):
    return reports.home(view(spark, d, "facts"))["totals"]


# ---- picks and weights -----------------------------------------------------
@check("price_relative_to_supplier_max", """
SELECT o_orderkey, o_custkey, round(CASE WHEN m > 0 THEN o_totalprice / m ELSE 0 END, 6) AS relative
FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders)""")
def _(spark, d):
    out = A.relative_to_max(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "relative")
    return out.select("o_orderkey", "o_custkey", F.round("relative", 6).alias("relative"))


@check("weight_within_customer", """
SELECT o_orderkey, round(CASE WHEN s = 0 THEN 1.0E0 / n ELSE o_totalprice / s END, 6) AS weight
FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders)""")
def _(spark, d):
    out = A.weight_in_group(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "weight")
    return out.select("o_orderkey", F.round("weight", 6).alias("weight"))


@check("best_risk_per_pair", oracle("""
SELECT country, actor, final_risk, intent FROM (SELECT *, row_number() OVER (PARTITION BY country, actor
  ORDER BY final_risk DESC, intent) AS rn FROM idx) WHERE rn = 1""", "idx"))
def _(spark, d):
    return A.best_risk(view(spark, d, "idx"), "country", "actor")


@check("modal_intent_per_actor", oracle("""
SELECT inferred_actor, strategic_intent, n AS count FROM (
  SELECT inferred_actor, strategic_intent, count(*) AS n, row_number() OVER (PARTITION BY inferred_actor
    ORDER BY count(*) DESC, strategic_intent NULLS FIRST) AS rn
  FROM facts GROUP BY inferred_actor, strategic_intent) WHERE rn = 1""", "facts"))
def _(spark, d):
    return A.most_frequent(view(spark, d, "facts"), ["inferred_actor"], "strategic_intent")


@check("first_rows_are_anchors", """
SELECT event_id AS id, event_id IN (SELECT event_id FROM events ORDER BY event_id LIMIT 150) AS is_anchor FROM events""")
def _(spark, d):
    return paging.mark_first(table(spark, d, "events").select(F.col("event_id").alias("id")), 150)


# ---- order, pages, caps ----------------------------------------------------
@check("latest_articles", oracle("""
SELECT id, media_outlet FROM facts ORDER BY posting_time DESC NULLS FIRST, id LIMIT 15""", "facts"))
def _(spark, d):
    return paging.latest(view(spark, d, "facts"), 15).select("id", "media_outlet")


def page_sql(page, size):
    return oracle(f"""
, total AS (SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / {size}.0) AS BIGINT)) AS pages FROM facts),
p AS (SELECT CASE WHEN {page} BETWEEN 1 AND pages THEN {page} ELSE pages END AS number, pages, n FROM total)
SELECT id, rn AS position, CAST(number AS BIGINT) AS page, CAST(pages AS BIGINT) AS pages, n AS total
FROM (SELECT id, row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS rn FROM facts), p
WHERE rn > (number - 1) * {size} AND rn <= number * {size}""", "facts")


def page_rows(spark, d, page, size):
    found = paging.paginate(view(spark, d, "facts"), page, size)
    return found.rows.select("id", "position", F.lit(found.number).cast("bigint").alias("page"),
                             F.lit(found.num_pages).cast("bigint").alias("pages"),
                             F.lit(found.total).cast("bigint").alias("total"))


@check("page_three", page_sql(3, 10))
def _(spark, d):
    return page_rows(spark, d, "3", 10)


@check("page_beyond_end", page_sql(10**9, 30))
def _(spark, d):
    return page_rows(spark, d, 10**9, 30)


@check("page_not_a_number", page_sql(1, 20))
def _(spark, d):
    return page_rows(spark, d, "two", 20)


@check("page_far_from_both_ends", page_sql(24, 20))
def _(spark, d):
    return page_rows(spark, d, 24, 20)


@check("page_after_a_row", oracle("""
, o AS (SELECT id, row_number() OVER (ORDER BY posting_time DESC NULLS FIRST, id) AS rn FROM facts)
SELECT id, rn - 40 AS position FROM o WHERE rn > 40 AND rn <= 60""", "facts"))
def _(spark, d):
    facts = view(spark, d, "facts")
    last = paging.page_after(facts, 40).filter("position = 40").first()
    return paging.page_after(facts, 20, {"posting_time": last["posting_time"], "id": last["id"]}).select("id", "position")


@check("author_directory_page", oracle("""
SELECT trim(author) AS author, count(*) AS articles, round(COALESCE(avg(confidence), 0), 6) AS avg_confidence FROM facts
WHERE author NOT IN ('', 'Unknown') AND regexp_matches(author, '^[A-Za-z\\s.''-]+$') GROUP BY author
ORDER BY author LIMIT 30""", "facts"))
def _(spark, d):
    return reports.author_directory(view(spark, d, "facts")).rows.withColumn("avg_confidence", F.round("avg_confidence", 6))


@check("capped_run", oracle("""
SELECT id FROM facts WHERE strategic_intent IS NULL OR strategic_intent IN ('', 'Unknown') ORDER BY id LIMIT 500""",
    "facts"))
def _(spark, d):
    todo = view(spark, d, "facts").filter(F.coalesce("strategic_intent", F.lit("")).isin("", "Unknown"))
    return paging.capped(todo, 500).select("id")


@check("top_countries_ascending", oracle("""
SELECT target_country, count(*) AS n FROM facts WHERE target_country IS NOT NULL GROUP BY target_country
ORDER BY n DESC, target_country LIMIT 10""", "facts"))
def _(spark, d):
    top = A.top_counts(view(spark, d, "facts").filter(F.col("target_country").isNotNull()), "target_country", n=10, name="n")
    return A.shown_ascending(top, "n", "target_country")


# ---- sets ------------------------------------------------------------------
@check("distinct_outlets", oracle("SELECT DISTINCT media_outlet FROM facts", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("media_outlet").distinct()


@check("outlets_without_profile", oracle("""
SELECT DISTINCT media_outlet AS name FROM facts WHERE media_outlet <> '' AND media_outlet NOT IN (SELECT name FROM outlets)""",
    "facts", "outlets"))
def _(spark, d):
    return sets.names_without_profile(view(spark, d, "facts"), "media_outlet", view(spark, d, "outlets"))


@check("union_of_story_lists", """
SELECT target, actor, count(*) AS n FROM (
  SELECT 'Senegal' AS target, 'China' AS actor FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'DRC', 'China' FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'DRC', 'Russia' FROM events WHERE event_type <> 'view') GROUP BY target, actor""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    parts = [("Senegal", "China", e.filter("event_type = 'view'")), ("DRC", "China", e.filter("event_type = 'click'")),
             ("DRC", "Russia", e.filter("event_type <> 'view'").drop("event_type"))]
    return A.count_by(sets.union_tagged(parts), "target", "actor", name="n")


@check("first_story_per_url", oracle("""
SELECT id, url FROM (SELECT id, url, row_number() OVER (PARTITION BY url ORDER BY inferred_actor NULLS FIRST, id) AS rn
  FROM facts WHERE url IS NOT NULL) WHERE rn = 1""", "facts"))
def _(spark, d):
    return sets.first_per_key(view(spark, d, "facts"), "url", ["inferred_actor", "id"]).select("id", "url")


@check("split_anchors", oracle("SELECT is_anchor, count(*) AS n FROM facts GROUP BY is_anchor", "facts"))
def _(spark, d):
    anchors, others = sets.split_by(view(spark, d, "facts"), F.col("is_anchor"))
    both = anchors.select(F.lit(True).alias("is_anchor")).unionByName(others.select(F.lit(False).alias("is_anchor")))
    return A.count_by(both, "is_anchor", name="n")
