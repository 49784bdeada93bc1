"""Links, lookups, semi and anti joins, mentions."""

from pyspark.sql import functions as F

from catalog import check
from catalog.views import low_any, mapped, oracle, quoted, table, view
from swaymeter import fixed_values as V
from swaymeter.functions.base import contains_any
from swaymeter.operators import aggregates as A
from swaymeter.operators import filters as P
from swaymeter.operators import joins as J
from swaymeter.operators import term_search as S

HASH_ID = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@check("link_journalists", oracle("""
, p AS (SELECT upper(name) AS k, min_by(id, struct_pack(name, id)) AS pid FROM journalists GROUP BY 1)
SELECT f.id, COALESCE(f.journalist_fk, pid) AS journalist_fk FROM facts f
LEFT JOIN p ON f.author NOT IN ('', 'Unknown') AND k = upper(trim(f.author))""", "facts", "journalists"))
def _(spark, d):
    return J.link_journalists(view(spark, d, "facts"), view(spark, d, "journalists")).select("id", "journalist_fk")


@check("link_outlets_create_missing", oracle(f"""
, names AS (SELECT upper(trim(media_outlet)) AS k FROM facts WHERE trim(media_outlet) <> '' GROUP BY 1),
p AS (SELECT upper(name) AS k, min(id) AS pid FROM outlets GROUP BY 1)
SELECT f.id, COALESCE(f.media_outlet_fk, pid, CASE WHEN trim(media_outlet) <> '' THEN
  {HASH_ID.format("upper(trim(media_outlet))")} END) AS media_outlet_fk
FROM facts f LEFT JOIN p ON k = upper(trim(media_outlet)) AND media_outlet <> ''""", "facts", "outlets"))
def _(spark, d):
    linked, _all = J.link_outlets(view(spark, d, "facts"), view(spark, d, "outlets"))
    return linked.select("id", "media_outlet_fk")


@check("profiles_after_link", oracle(f"""
SELECT id, name FROM outlets UNION ALL
SELECT {HASH_ID.format("upper(name)")} AS id, name FROM (
  SELECT min(trim(media_outlet)) AS name FROM facts WHERE trim(media_outlet) <> ''
    AND upper(trim(media_outlet)) NOT IN (SELECT upper(name) FROM outlets) GROUP BY upper(trim(media_outlet)))""",
    "facts", "outlets"))
def _(spark, d):
    return J.link_outlets(view(spark, d, "facts"), view(spark, d, "outlets"))[1].select("id", "name")


@check("link_authors_exact", oracle(f"""
, p AS (SELECT name, min(id) AS pid FROM journalists GROUP BY name)
SELECT f.id, COALESCE(f.journalist_fk, pid, CASE WHEN author <> '' THEN {HASH_ID.format("author")} END) AS journalist_fk
FROM facts f LEFT JOIN p ON p.name = f.author AND author <> ''""", "facts", "journalists"))
def _(spark, d):
    return J.link_authors_exact(view(spark, d, "facts"), view(spark, d, "journalists"))[0].select("id", "journalist_fk")


@check("articles_of_outlet", oracle("""
SELECT f.id FROM facts f LEFT JOIN outlets o ON o.id = f.media_outlet_fk
WHERE upper(o.name) = 'RFI' OR upper(f.media_outlet) = 'RFI'""", "facts", "outlets"))
def _(spark, d):
    return J.of_outlet(view(spark, d, "facts"), view(spark, d, "outlets"), "rfi").select("id")


SCORE_CTES = f"""
, keyed AS (SELECT id, strategic_intent,
  COALESCE({mapped("lower(trim(target_country))", V.COUNTRY_ALIASES["score"])}, target_country, '') AS c,
  COALESCE({mapped("lower(trim(inferred_actor))", V.ACTOR_ALIASES["score"])}, inferred_actor, '') AS a,
  COALESCE({mapped("lower(trim(strategic_intent))", V.intent_aliases("score"))}, 'Sovereignty') AS i FROM facts)"""


CONSTANT = ("CASE k.strategic_intent " + " ".join(f"WHEN {quoted(n)} THEN {v}E0" for n, v in V.INTENT_CONSTANTS.items())
            + " ELSE 0.5E0 END")


@check("score_exact", oracle(SCORE_CTES + """
SELECT k.id, x.final_risk AS score FROM keyed k LEFT JOIN idx x ON lower(x.country) = lower(k.c)
  AND lower(x.actor) = lower(k.a) AND lower(x.intent) = lower(k.i)""", "facts", "idx"))
def _(spark, d):
    from swaymeter.functions.labels import alias, score_intent

    df = view(spark, d, "facts")
    return J.score_exact(df, view(spark, d, "idx"), alias("country", "score", "target_country"),
                         alias("actor", "score", "inferred_actor"),
                         score_intent("strategic_intent")).select("id", "score")


@check("score_cascade", oracle(SCORE_CTES + f"""
SELECT k.id, COALESCE(x.final_risk, p.m, {CONSTANT}) AS score,
  CASE WHEN x.final_risk IS NOT NULL THEN 'exact' WHEN p.m IS NOT NULL THEN 'pair' ELSE 'constant' END AS match_level
FROM keyed k LEFT JOIN idx x ON lower(x.country) = lower(k.c) AND lower(x.actor) = lower(k.a)
  AND lower(x.intent) = lower(k.i)
LEFT JOIN (SELECT lower(country) AS c, lower(actor) AS a, max(final_risk) AS m FROM idx GROUP BY 1, 2) p
  ON p.c = lower(k.c) AND p.a = lower(k.a)""", "facts", "idx"))
def _(spark, d):
    return J.score_cascade(view(spark, d, "facts"), view(spark, d, "idx")).select("id", "score", "match_level")


@check("score_without_actor", oracle(f"""
, keyed AS (SELECT id, target_country AS c, inferred_actor AS a,
  COALESCE({mapped("lower(trim(strategic_intent))", V.intent_aliases("lookup"))}, strategic_intent) AS i FROM facts)
SELECT k.id, COALESCE(x.final_risk, y.any_risk, 0) AS score FROM keyed k
LEFT JOIN idx x ON lower(x.country) = lower(trim(k.c)) AND lower(x.actor) = lower(trim(k.a)) AND lower(x.intent) = lower(trim(k.i))
LEFT JOIN (SELECT country, intent, min_by(final_risk, actor) AS any_risk FROM idx GROUP BY 1, 2) y
  ON y.country = k.c AND y.intent = k.i""", "facts", "idx"))
def _(spark, d):
    from swaymeter.functions.labels import lookup_intent

    return J.score_without_actor(view(spark, d, "facts"), view(spark, d, "idx"), F.col("target_country"),
                                 lookup_intent("strategic_intent"), F.col("inferred_actor")).select("id", "score")


@check("request_scores", oracle(f"""
, req AS (SELECT DISTINCT target_country AS country, inferred_actor AS actor,
    CASE WHEN strategic_intent = 'Religious' THEN 'Religious' WHEN strategic_intent IN ('Economic') THEN 'All' ELSE '' END
    AS intent FROM facts),
keyed AS (SELECT *, upper(COALESCE({mapped("lower(trim(country))", V.COUNTRY_ALIASES["request"])}, country)) AS c,
  upper(COALESCE({mapped("lower(trim(actor))", V.ACTOR_ALIASES["request"])}, actor)) AS a FROM req),
hits AS (SELECT k.country, k.actor, k.intent, x.final_risk, x.intent AS xi, row_number() OVER (
    PARTITION BY k.country, k.actor, k.intent ORDER BY final_risk DESC NULLS LAST, x.intent) AS rn
  FROM keyed k LEFT JOIN idx x ON upper(x.country) = k.c AND upper(x.actor) = k.a
    AND (k.intent IN ('', 'All') OR upper(x.intent) = upper(k.intent)))
SELECT country, actor, intent, round(COALESCE(final_risk, 0), 4) AS score, COALESCE(xi, 'No Risk Data Found') AS score_intent
FROM hits WHERE rn = 1""", "facts", "idx"))
def _(spark, d):
    wanted = (F.when(F.col("strategic_intent") == "Religious", F.lit("Religious"))
              .when(F.col("strategic_intent") == "Economic", F.lit("All")).otherwise(F.lit("")))
    requests = view(spark, d, "facts").select(F.col("target_country").alias("country"),
                                              F.col("inferred_actor").alias("actor"), wanted.alias("intent")).distinct()
    return J.request_scores(requests, view(spark, d, "idx"))


@check("mark_anchor_ids", """
SELECT event_id AS id, event_id IN (SELECT doc_id FROM labels) AS is_anchor FROM events""")
def _(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return J.mark_listed(table(spark, d, "events").select(F.col("event_id").alias("id")), ids)


@check("stories_not_stored", oracle("""
SELECT id FROM facts WHERE NOT is_anchor AND url <> '' AND url NOT IN
  (SELECT url FROM facts WHERE is_anchor AND url IS NOT NULL)""", "facts"))
def _(spark, d):
    df = view(spark, d, "facts")
    return J.not_stored(df.filter(~F.col("is_anchor")), df.filter("is_anchor")).select("id")


@check("labelled_anchors", oracle("""
SELECT id, CASE WHEN true_label = strategic_intent THEN 1 ELSE 0 END AS agrees FROM facts
WHERE is_anchor AND true_label <> ''""", "facts"))
def _(spark, d):
    return J.labelled_anchors(view(spark, d, "facts")).select("id", "agrees")


@check("labels_from_table", """
SELECT event_id AS id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS true_label
FROM events LEFT JOIN labels ON doc_id = event_id""")
def _(spark, d):
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), kind.alias("true_label"))
    df = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("true_label"))
    return J.labelled_by(df, labels)


@check("resolve_names_with_table", """
SELECT c_custkey, COALESCE(v, c_mktsegment) AS segment FROM customer
LEFT JOIN (SELECT lower(c_mktsegment) AS k, min(upper(c_mktsegment)) AS v FROM customer
  WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) ON k = lower(trim(c_mktsegment))""")
def _(spark, d):
    customer = table(spark, d, "customer")
    aliases = customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_mktsegment").alias("key"), F.upper("c_mktsegment").alias("value")).distinct()
    return J.resolve_with(customer, "c_mktsegment", aliases, "segment").select("c_custkey", "segment")


TERMS = [(c, t) for c, terms in V.TARGET_TERMS.items() for t in terms]


@check("term_mentions", oracle("""
, terms(country, term) AS (VALUES """ + ", ".join(f"({quoted(c)}, {quoted(t)})" for c, t in TERMS) + """)
SELECT a.id, t.country AS "group", t.term FROM articles a JOIN terms t ON contains(upper(a.article_text), upper(t.term))""",
    "articles"))
def _(spark, d):
    return J.term_mentions(view(spark, d, "articles"), TERMS)


@check("word_mentions_by_equi_join", r"""
WITH terms AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS "group", p_name AS term FROM part
  UNION SELECT 'word', text FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS text FROM benchmark)),
words AS (SELECT doc_id AS id, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)
SELECT id, "group", count(*) AS n FROM (
  SELECT id, "group", term FROM (SELECT id, unnest(w) AS word FROM words) x JOIN terms ON lower(term) = word
  UNION ALL
  SELECT id, "group", term FROM words JOIN (SELECT * FROM terms
    WHERE lower(term) <> regexp_extract(lower(term), '[\p{L}\p{N}]+')) t
    ON list_contains(w, regexp_extract(lower(term), '[\p{L}\p{N}]+')) AND contains(lower(text), lower(term)))
GROUP BY id, "group" """)
def _(spark, d):
    part = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("group"), F.col("p_name").alias("term"))
    words = table(spark, d, "benchmark").select(F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("term"))
    terms = part.unionByName(words.select(F.lit("word").alias("group"), "term")).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("article_text"))
    return A.count_by(J.word_mentions(docs, terms), "id", "group", name="n")


GRID = {"Senegal": ["Senegal", "Dakar"], "DRC": ["Kinshasa", "Goma"], "Ethiopia": ["Ethiopia", "military"]}


@check("query_grid", oracle("""
SELECT id, inferred_actor, target FROM articles JOIN (""" + " UNION ALL ".join(f"SELECT {quoted(t)} AS target" for t in GRID) + """) g
ON """ + " OR ".join(f"(target = {quoted(t)} AND {low_any('lower(article_text)', [w.lower() for w in ws])})" for t, ws in GRID.items()) + """
WHERE inferred_actor IN ('China', 'France', 'Russia')""", "articles"))
def _(spark, d):
    queries = {t: contains_any("article_text", ws) for t, ws in GRID.items()}
    return J.query_grid(view(spark, d, "articles"), queries, ["China", "France", "Russia"], "inferred_actor").select(
        "id", "inferred_actor", "target")


@check("query_grid_counts", oracle("""
SELECT inferred_actor, target, count(*) AS n FROM (
  SELECT inferred_actor, 'Senegal' AS target FROM articles WHERE contains(lower(article_text), 'senegal')
    AND contains(lower(article_text), 'trade')
  UNION ALL SELECT inferred_actor, 'Ethiopia' FROM articles WHERE contains(lower(article_text), 'ethiopia')
    AND contains(lower(article_text), 'military'))
WHERE inferred_actor IN ('China', 'US') GROUP BY ALL""", "articles"))
def _(spark, d):
    queries = {"Senegal": P.keyword_query("article_text", [["senegal*"], ["trade*"]]),
               "Ethiopia": P.keyword_query("article_text", [["ethiopia*"], ["military*"]])}
    grid = J.query_grid(view(spark, d, "articles"), queries, ["China", "US"], "inferred_actor")
    return A.count_by(grid, "inferred_actor", "target", name="n")



def bounded(column: str, terms) -> str:
    """Any of the terms as a word or phrase of a folded column, `*` leaving it open to the right."""
    import re

    edge = r"[^\p{L}\p{N}_]"
    parts = [re.sub(r"([^\w\s])", r"\\\1", t.rstrip("*").lower()) + ("" if t.endswith("*") else f"($|{edge})") for t in terms]
    return f"regexp_matches({column}, " + quoted(f"(^|{edge})({'|'.join(parts)})") + ")"


def answers(column: str, query) -> str:
    groups, none_of = query
    return " AND ".join([bounded(column, g) for g in groups] + ([f"NOT {bounded(column, none_of)}"] if none_of else []))


SEARCHES = V.topic_searches()

LOW = ", low AS (SELECT id, inferred_actor, lower(article_text) AS t FROM articles)"


@check("country_queries", oracle(LOW + " " + " UNION ALL ".join(
    f"SELECT id, {quoted(c)} AS query FROM low WHERE {answers('t', q)}" for c, q in SEARCHES.items()), "articles"))
def _(spark, d):
    return S.percolate(view(spark, d, "articles"), S.query_table(spark, SEARCHES))


@check("country_queries_by_actor", oracle(LOW + " SELECT inferred_actor, query AS target, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT inferred_actor, {quoted(c)} AS query FROM low WHERE {answers('t', q)}" for c, q in SEARCHES.items())
    + ") WHERE inferred_actor IN ('China', 'Turkey', 'Rwanda') GROUP BY ALL", "articles"))
def _(spark, d):
    found = S.percolate_grid(view(spark, d, "articles"), S.query_table(spark, SEARCHES), ["China", "Turkey", "Rwanda"], "inferred_actor")
    return A.count_by(found, "inferred_actor", "target", name="n")


# a query per benchmark item: its third and fourth words, not its fifth
@check("item_queries", r"""
WITH q AS (SELECT item_id, w[3] AS a, w[4] AS b, w[5] AS c FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)
SELECT x.doc_id AS id, CAST(item_id AS VARCHAR) AS query FROM q JOIN w x ON x.w = a JOIN w y ON y.w = b AND y.doc_id = x.doc_id
WHERE NOT EXISTS (SELECT 1 FROM w z WHERE z.w = c AND z.doc_id = x.doc_id)""")
def _(spark, d):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    words = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.slice(found, 3, 3).alias("w"))
    queries = words.select("query", F.posexplode("w").alias("group", "term")).withColumn("negated", F.col("group") == 2)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("article_text"))
    return S.percolate(docs, queries.select("query", "group", "negated", "term"))
