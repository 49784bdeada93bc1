"""Readers and writers: derived tables go out as files and come back through the library."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import check, work_folder
from catalog.views import oracle, table, view
from swaymeter.operators.aggregates import count_by
from swaymeter.plans import reports
from swaymeter.plans.ingest import story_outcomes
from swaymeter.sources import readers, sinks


def new_path(spark, name):
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a CSV file: one with quoted line breaks is read by one task.
ROWS_PER_FILE = 20_000


def csv_of(df, name, **options):
    path = new_path(df.sparkSession, name)
    writer = df.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "gzip").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.csv(path)
    return path


def article_csv(spark, d):
    time, i = F.col("posting_time"), F.col("id") % 3
    written = (F.when(i == 0, F.date_format(time, "MM/dd/yyyy HH:mm")).when(i == 1, F.date_format(time, "yyyy-MM-dd HH:mm:ss"))
               .otherwise(F.date_format(time, "dd/MM/yyyy HH:mm")))
    df = view(spark, d, "articles").select(
        F.coalesce("article_text", F.lit("")).alias("article_text"), written.alias("posting_time"), "media_outlet",
        "inferred_actor", "strategic_intent", F.lit("").alias("sector"), "tone", "target_country", F.col("id").cast("string").alias("URL"),
        F.when(F.col("id") % 13 == 0, "high").otherwise(F.col("confidence").cast("string")).alias("confidence"), "lang_detect",
        F.when(F.col("is_anchor"), "TRUE").otherwise("no").alias("use_afrolm"))
    return csv_of(df, "articles")


DAY = """CASE id % 3 WHEN 0 THEN CAST(posting_time AS DATE) WHEN 1 THEN CAST(posting_time AS DATE)
  ELSE COALESCE(TRY_CAST(strftime(posting_time, '%Y-%d-%m') AS DATE), CAST(posting_time AS DATE)) END"""


@check("read_articles_csv", oracle(f"""
SELECT CAST(id AS STRING) AS url, {DAY} AS day, COALESCE(nullif(trim(media_outlet), ''), 'Unknown') AS media_outlet,
  COALESCE(nullif(trim(strategic_intent), ''), 'Unknown') AS strategic_intent, 'Unknown' AS sector,
  CASE WHEN id % 13 = 0 THEN 4.0 ELSE COALESCE(confidence, 4.0) END AS confidence,
  COALESCE(nullif(lang_detect, ''), 'en') AS lang_detect, is_anchor AS use_afrolm, -1 AS llm_strat_id,
  CAST(length(COALESCE(article_text, '')) AS BIGINT) AS chars
FROM articles WHERE posting_time IS NOT NULL""", "articles"))
def _(spark, d):
    good, _bad = readers.read_articles_csv(spark, article_csv(spark, d))
    return good.select("url", F.to_date("posting_time").alias("day"), "media_outlet", "strategic_intent", "sector", "confidence",
                       "lang_detect", "use_afrolm", "llm_strat_id",
                       F.coalesce(F.length("article_text"), F.lit(0)).cast("bigint").alias("chars"))


@check("reject_articles_csv", oracle("""
SELECT CAST(id AS STRING) AS url, 'posting_time is empty' AS reason FROM facts WHERE posting_time IS NULL""", "facts"))
def _(spark, d):
    return readers.read_articles_csv(spark, article_csv(spark, d))[1].select(F.col("URL").alias("url"), "reason")


@check("read_initial_csv", oracle("""
SELECT CAST(id AS STRING) AS url, COALESCE(inferred_actor, '') AS inferred_actor, nullif(strategic_intent, '') AS strategic_intent,
  COALESCE(confidence, 0) AS confidence, is_anchor AS use_afrolm, md5(article_text) AS text FROM articles WHERE article_text IS NOT NULL""", "articles"))
def _(spark, d):
    df = view(spark, d, "articles").filter(F.col("article_text").isNotNull()).select(
        "article_text", "posting_time", "media_outlet", "inferred_actor", "strategic_intent",
        "target_country", F.col("id").cast("string").alias("URL"), "confidence",
        F.when(F.col("is_anchor"), "Yes").otherwise("0").alias("use_afrolm"))
    return readers.read_initial_csv(spark, csv_of(df, "initial")).select(
        "url", "inferred_actor", "strategic_intent", "confidence", "use_afrolm", F.md5("article_text").alias("text"))


def damaged_csv(spark, d):
    """Articles in three files: whole records, records that lack their last cells, records with a cell too many."""
    path = new_path(spark, "damaged")
    facts = view(spark, d, "facts").select(
        F.lit("t").alias("article_text"), F.date_format("posting_time", "yyyy-MM-dd HH:mm:ss").alias("posting_time"),
        F.when(F.col("id") % 11 == 0, "n/a").otherwise(F.col("confidence").cast("string")).alias("confidence"),
        F.col("id").cast("string").alias("URL"), F.lit("x").alias("sector"), "lang_detect")
    kind = F.col("lang_detect")
    csv = lambda df, name: df.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    csv(facts.filter(kind.isin("en", "fr") | kind.isNull()), "whole")
    csv(facts.filter(kind == "sw").drop("lang_detect", "sector"), "short")
    csv(facts.filter(~kind.isin("en", "fr", "sw")).withColumn("more", F.lit("y")), "long")
    return f"{path}/*", ["article_text", "posting_time", "confidence", "URL", "sector", "lang_detect"]


@check("damaged_csv_records", oracle("""
SELECT CASE WHEN lang_detect IS NULL OR lang_detect IN ('en', 'fr') THEN 'whole' ELSE 'damaged' END AS kind, count(*) AS n FROM facts GROUP BY 1""", "facts"))
def _(spark, d):
    path, names = damaged_csv(spark, d)
    rows = readers.read_checked_csv(spark, path, names=names)
    return rows.groupBy(F.when(F.col(readers.DAMAGED).isNull(), "whole").otherwise("damaged").alias("kind")).agg(F.count("*").alias("n"))


@check("reject_initial_csv", oracle("""
SELECT CAST(id AS STRING) AS url, 'unreadable confidence' AS reason, 'n/a' AS value FROM facts WHERE id % 13 = 0""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts").select(
        F.lit("t").alias("article_text"), "posting_time", F.col("id").cast("string").alias("URL"),
        F.when(F.col("id") % 13 == 0, "n/a").otherwise(F.col("confidence").cast("string")).alias("confidence"))
    return readers.reject_initial_csv(spark, csv_of(df, "lenient"))


@check("read_risk_csv", oracle("SELECT actor, country, intent, final_risk FROM idx", "idx"))
def _(spark, d):
    df = view(spark, d, "idx").withColumnRenamed("final_risk", "FinalRisk")
    return readers.read_risk_csv(spark, csv_of(df, "risk"))


@check("read_outlets_csv", """
SELECT s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'Group ' || CAST(s_nationkey AS STRING) END AS parent_organisation,
  CAST(NULL AS STRING) AS website FROM supplier""")
def _(spark, d):
    df = table(spark, d, "supplier").select(
        F.concat(F.lit(" "), "s_name").alias("name"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Group "), F.col("s_nationkey").cast("string"))).alias("parent_organisation"),
        F.lit("x").alias("_c2"), F.lit("  ").alias("website"))
    return readers.read_outlets_csv(spark, csv_of(df, "outlets")).select("name", "parent_organisation", "website")


@check("read_journalists_csv", """
SELECT 'Éric ' || c_name AS name, nullif(c_mktsegment, 'BUILDING') AS city FROM customer WHERE c_custkey % 7 > 0""")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("Éric "), "c_name"))
    df = table(spark, d, "customer").select(name.alias("name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("city"))
    return readers.read_journalists_csv(spark, csv_of(df, "journalists", encoding="iso-8859-1")).select("name", "city")


@check("read_ids", "SELECT doc_id AS id FROM labels WHERE toxic = 0")
def _(spark, d):
    path = new_path(spark, "ids")
    line = F.when(F.col("toxic") == 0, F.col("doc_id").cast("string")).otherwise("not an id")
    table(spark, d, "labels").select(line.alias("value")).write.text(path)
    return readers.read_ids(spark, path)


def stories(spark, d):
    """Stories as JSON files below (target, actor) folders would hold them."""
    path = new_path(spark, "stories")
    view(spark, d, "facts").select(
        "url", F.col("posting_time").cast("string").alias("publish_date"), F.col("media_outlet").alias("media_name"),
        F.col("lang_detect").alias("language"), F.when(F.col("is_anchor"), F.col("confidence")).alias("score"),
        F.col("inferred_actor").alias("actor"), F.col("target_country").alias("target")).write.json(path)
    return readers.read_stories(spark, path)


@check("read_stories", oracle("""
SELECT target_country, inferred_actor, count(*) AS n, count(url) AS urls, round(sum(CASE WHEN is_anchor AND confidence IS NOT NULL
  THEN confidence ELSE 1.0 END), 5) AS confidence, min(CAST(posting_time AS DATE)) AS first_day, TRUE AS pseudo_kept
FROM facts GROUP BY target_country, inferred_actor""", "facts"))
def _(spark, d):
    rows = readers.story_rows(stories(spark, d))
    return rows.groupBy("target_country", "inferred_actor").agg(
        F.count("*").alias("n"), F.count("url").alias("urls"), F.round(F.sum("confidence"), 5).alias("confidence"),
        F.min(F.to_date("posting_time")).alias("first_day"), F.bool_and("pseudo_kept").alias("pseudo_kept"))


@check("append_articles", oracle("""
SELECT COALESCE(strftime(posting_time, '%Y-%m'), 'undated') AS month, 2 * count(*) AS n FROM facts GROUP BY 1""", "facts"))
def _(spark, d):
    path = new_path(spark, "store")
    for _round in range(2):
        sinks.append_articles(view(spark, d, "facts"), path)
    return count_by(spark.read.parquet(path).withColumn("month", F.col("month").cast("string")), "month", name="n")


@check("read_articles_of_days", oracle("""
SELECT id, url FROM facts WHERE CAST(posting_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", "facts"))
def _(spark, d):
    path = new_path(spark, "store")
    sinks.append_articles(view(spark, d, "facts"), path)
    return readers.read_articles(spark, path, "2024-1-5", "2024-01-20").select("id", "url")


@check("import_twice", oracle("""
SELECT 'first' AS file, url, 0 + row_number() OVER (ORDER BY id) - 1 AS line FROM facts UNION ALL
SELECT 'second', url, row_number() OVER (ORDER BY id) - 1 FROM facts""", "facts"))
def _(spark, d):
    """Ids by place: the two imports, each of several files in order, share none, and neither has one twice."""
    parts = []
    for name in ("first", "second"):
        df = view(spark, d, "facts").select(F.lit("t").alias("article_text"), F.lit("2025-01-01 00:00:00").alias("posting_time"), F.col("url").alias("URL"), "id")
        path = csv_of(df.orderBy("id").drop("id"), name)
        rows = readers.read_articles_csv(spark, path, place=True)[0]
        sizes = rows.groupBy("_file").agg(F.count("*").alias("n"))
        earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
        before = sizes.select("_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        rows = rows.join(before, "_file")
        parts.append(rows.select(F.lit(name).alias("file"), F.nullif("url", F.lit("")).alias("url"), (F.col("before") + F.col("_line")).alias("line"), readers.place_id().alias("id")))
    both = parts[0].unionByName(parts[1])
    return both.join(both.groupBy("id").count().filter("count = 1"), "id", "left_semi").drop("id")


@check("update_months", oracle("""
SELECT f.id, CASE WHEN l.doc_id IS NOT NULL THEN 'Economic' ELSE strategic_intent END AS strategic_intent,
  CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2031-05-06 07:08:09' ELSE posting_time END AS posting_time
FROM facts f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = f.id""", "facts"))
def _(spark, d):
    path = new_path(spark, "months")
    sinks.append_articles(view(spark, d, "facts").select("id", "strategic_intent", "posting_time"), path)
    updates = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("Economic").alias("strategic_intent"),
                                               F.to_timestamp(F.lit("2031-05-06 07:08:09")).alias("posting_time"))
    sinks.update_months(spark, path, updates, ["strategic_intent", "posting_time"])
    return spark.read.parquet(path).drop("month")


@check("replace_table", oracle("SELECT actor, country, intent, final_risk FROM idx", "idx"))
def _(spark, d):
    path = new_path(spark, "index")
    index = view(spark, d, "idx")
    sinks.replace_table(index.limit(0), path)
    sinks.replace_table(index, path)
    return sinks.read_current(spark, path)


@check("write_backup", """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events""")
def _(spark, d):
    path = new_path(spark, "backup")
    error = F.when(F.col("event_type") == "error", "timeout")
    sinks.write_backup(table(spark, d, "events").select(F.col("event_id").alias("id"), "value", error.alias("error")), path)
    return readers.read_text_csv(spark, path).select(F.col("id").cast("bigint").alias("id"), "status")


@check("write_panels", oracle("""
SELECT target_country, count(*) AS count FROM facts WHERE target_country IS NULL OR target_country NOT IN ('', 'Unknown') GROUP BY 1
ORDER BY count DESC, target_country NULLS LAST LIMIT 5""", "facts"))
def _(spark, d):
    folder = new_path(spark, "panels")
    sinks.write_panels(reports.home(view(spark, d, "facts").withColumn("article_text", F.lit(""))), folder, "parquet")
    return spark.read.parquet(f"{folder}/countries")


# ---- ingest ------------------------------------------------------------------
@check("ingest_outcomes", oracle("""
, store AS (SELECT DISTINCT url FROM facts WHERE id % 10 = 1 AND url <> ''),
texts AS (SELECT url, min_by(article_text, id) AS article_text FROM articles WHERE article_text IS NOT NULL AND url <> '' GROUP BY url),
j AS (SELECT f.id, f.url, CASE WHEN COALESCE(f.url, '') = '' THEN 'no url' WHEN s.url IS NOT NULL THEN 'already stored'
    WHEN t.article_text IS NULL THEN 'no page'
    WHEN NOT COALESCE(f.target_country <> '' AND contains(lower(t.article_text), lower(f.target_country)), FALSE) THEN 'irrelevant'
    WHEN t.article_text LIKE 'Failed:%' OR t.article_text LIKE 'Error:%' THEN 'scrape error'
    WHEN length(t.article_text) <= 1000 THEN 'too short' END AS reason
  FROM facts f LEFT JOIN store s ON s.url = f.url LEFT JOIN texts t ON t.url = f.url),
w AS (SELECT url, min(id) AS id FROM j WHERE reason IS NULL GROUP BY url)
SELECT j.id, COALESCE(reason, CASE WHEN w.id IS NULL THEN 'duplicate in run' END, 'saved') AS outcome
FROM j LEFT JOIN w ON w.id = j.id""", "articles"))
def _(spark, d):
    facts = view(spark, d, "facts")
    texts = (view(spark, d, "articles").filter(F.col("article_text").isNotNull() & (F.col("url") != ""))
             .groupBy("url").agg(F.min_by("article_text", "id").alias("article_text")))
    store = facts.filter("id % 10 = 1")
    return story_outcomes(facts, texts, store, ["id"], row_id="id").select("id", "outcome")
