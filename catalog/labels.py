"""Label functions."""

from pyspark.sql import functions as F

from catalog import CHECKS, check
from catalog.views import low_any, mapped, oracle, quoted, rules, table, view
from swaymeter import fixed_values as V
from swaymeter.functions import labels as L
from swaymeter.functions import scores as S
from swaymeter.functions.base import clip01
from swaymeter.operators import aggregates as A
from swaymeter.plans.questions import answer_questions, route_questions


@check("clip_to_unit", """
SELECT event_id, CASE WHEN value / 100 - 0.2 < 0 THEN 0 WHEN value / 100 - 0.2 > 1 THEN 1
  ELSE round(value / 100 - 0.2, 6) END AS clipped FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(clip01(F.col("value") / 100 - 0.2), 6).alias("clipped"))


@check("canonical_intent", oracle(f"""
SELECT id, CASE WHEN strategic_intent <> '' THEN COALESCE(
  {mapped("lower(trim(strategic_intent))", V.intent_aliases("display"))},
  CASE WHEN article_text <> '' THEN {rules("lower(article_text)", V.TITLE_FUNNELS)} END) END AS intent
FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", L.canonical_intent("strategic_intent", "article_text").alias("intent"))


# labels of many forms: the stored ones, and names of parts mixed with words of the rules
RAW = """
SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Debt Trap Diplomacy' WHEN 1 THEN p_name || ' trade war'
  WHEN 2 THEN ' ' WHEN 3 THEN 'eco' WHEN 4 THEN 'space race' WHEN 5 THEN 'vote power' WHEN 6 THEN NULL WHEN 7 THEN ''
  WHEN 8 THEN p_type || ' Military expansion' WHEN 9 THEN 'Human Rights Advocacy' WHEN 10 THEN 'Reputation  Damage War'
  ELSE p_name END AS raw FROM part"""


def raw_labels(spark, d):
    return spark.sql(RAW.replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))


TWO_WAY = "CASE " + " ".join(
    f"WHEN contains(r, {quoted(n.lower())}) OR contains({quoted(n.lower())}, r) THEN {quoted(n)}" for n in V.INTENTS)


@check("contextual_intent", f"""
WITH raw AS ({RAW}), low AS (SELECT id, raw, lower(trim(raw)) AS r FROM raw)
SELECT id, CASE WHEN raw <> '' THEN COALESCE({mapped("r", V.intent_aliases("context"))},
  {TWO_WAY} ELSE {rules("r", V.CONTEXT_FUNNELS, "'Other'")} END) END AS intent FROM low""")
def _(spark, d):
    return raw_labels(spark, d).select("id", L.contextual_intent("raw").alias("intent"))


@check("score_and_lookup_intent", f"""
WITH raw AS ({RAW})
SELECT id, COALESCE({mapped("lower(trim(raw))", V.intent_aliases("score"))}, 'Sovereignty') AS for_score,
  COALESCE({mapped("lower(trim(raw))", V.intent_aliases("lookup"))}, raw) AS for_lookup,
  COALESCE(raw, '') <> '' AND lower(COALESCE(raw, '')) NOT IN ('neutral', 'unknown', 'none') AS strategic FROM raw""")
def _(spark, d):
    return raw_labels(spark, d).select("id", L.score_intent("raw").alias("for_score"), L.lookup_intent("raw").alias("for_lookup"),
                                       L.is_strategic("raw").alias("strategic"))


@check("clean_intent", f"""
WITH raw AS ({RAW})
SELECT id, trim(regexp_replace(regexp_replace(trim(lower(raw)), '\\s+', ' ', 'g'),
  '(narrative|strategy|influence|erosion|interference|war)$', '')) AS cleaned FROM raw""")
def _(spark, d):
    return raw_labels(spark, d).select("id", L.clean_intent("raw").alias("cleaned"))


@check("actor_from_outlet", oracle(f"""
SELECT id, CASE WHEN COALESCE(media_outlet, '') = '' THEN 'Unknown'
  ELSE {rules("lower(media_outlet)", V.OUTLET_ACTOR_RULES, "'Unknown'")} END AS actor FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", L.actor_from_outlet("media_outlet").alias("actor"))


def entity_sql(rule_set):
    return ("list_filter([" + rules("lower(a)", rule_set) + ", " + rules("lower(b)", rule_set)
            + "], lambda x: x IS NOT NULL)[1]")


@check("actor_from_content", oracle(f"""
, e AS (SELECT *, CASE id % 9 WHEN 0 THEN 'Bank of Turkey' WHEN 1 THEN 'Gulf Emirates Fund' ELSE 'Acme' END AS a,
    CASE id % 4 WHEN 0 THEN 'Chinese Rail' ELSE 'UN' END AS b,
    CASE id % 10 WHEN 0 THEN 'Kagame' ELSE 'Anna' END AS pa, CASE id % 6 WHEN 0 THEN 'Joe Biden' ELSE 'Bob' END AS pb
  FROM articles)
SELECT id, COALESCE({entity_sql(V.ORGANISATION_ACTOR_RULES)},
  {entity_sql(V.PERSON_ACTOR_RULES).replace("(a)", "(pa)").replace("(b)", "(pb)")},
  {rules("lower(article_text)", V.TEXT_ACTOR_RULES)}, 'Unknown') AS actor FROM e""", "articles"))
def _(spark, d):
    i = F.col("id")
    orgs = F.array(F.when(i % 9 == 0, "Bank of Turkey").when(i % 9 == 1, "Gulf Emirates Fund").otherwise("Acme"),
                   F.when(i % 4 == 0, "Chinese Rail").otherwise("UN"))
    persons = F.array(F.when(i % 10 == 0, "Kagame").otherwise("Anna"), F.when(i % 6 == 0, "Joe Biden").otherwise("Bob"))
    return view(spark, d, "articles").select("id", L.actor_from_content("article_text", orgs, persons).alias("actor"))


@check("resolve_actor", oracle(f"""
SELECT id, COALESCE(CASE WHEN inferred_actor NOT IN ('', 'Unknown') THEN inferred_actor END,
  CASE WHEN media_outlet <> '' THEN {rules("lower(media_outlet)", V.OUTLET_ACTOR_RULES)} END,
  {rules("lower(article_text)", V.TEXT_ACTOR_RULES)}, 'Unknown') AS actor FROM articles""", "articles"))
def _(spark, d):
    return view(spark, d, "articles").select("id", L.resolve_actor("inferred_actor", "media_outlet", "article_text").alias("actor"))


@check("override_actor", oracle("""
SELECT id, CASE WHEN url LIKE '%nytimes.com%' OR media_outlet = 'The New York Times' THEN 'USA' ELSE inferred_actor END AS actor
FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", L.override_actor("inferred_actor", "url", "media_outlet").alias("actor"))


@check("resolve_aliases", oracle(f"""
SELECT id, COALESCE({mapped("lower(trim(inferred_actor))", V.ACTOR_ALIASES["request"])}, inferred_actor) AS actor,
  COALESCE({mapped("lower(trim(target_country))", V.COUNTRY_ALIASES["request"])}, target_country) AS country,
  COALESCE({mapped("lower(trim(inferred_actor))", V.ACTOR_ALIASES["report_articles"])}, inferred_actor) AS article_actor
FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select(
        "id", L.alias("actor", "request", "inferred_actor").alias("actor"),
        L.alias("country", "request", "target_country").alias("country"),
        L.alias("actor", "report_articles", "inferred_actor").alias("article_actor"))


@check("low_resource_language", oracle("""
SELECT id, COALESCE(lang_detect IN ('ha','yo','am','sw','wo','ig','ff','pt','bm','mg','zu'), FALSE) AS low FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", L.is_low_resource("lang_detect").alias("low"))


@check("clean_tone", oracle("""
SELECT id, CASE WHEN COALESCE(trim(regexp_replace(tone, '[0-9.]+', '', 'g')), '') = '' THEN 'Unknown'
  ELSE trim(regexp_replace(tone, '[0-9.]+', '', 'g')) END AS tone FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", L.clean_tone("tone").alias("tone"))


@check("untuple_tone", oracle(r"""
SELECT id, CASE WHEN tone LIKE '(%' AND regexp_matches(tone, '^\(''([^'']*)'', [0-9.]+\)$')
  THEN regexp_extract(tone, '^\(''([^'']*)''', 1) ELSE tone END AS tone FROM facts""", "facts"))
def _(spark, d):
    return view(spark, d, "facts").select("id", L.untuple_tone("tone").alias("tone"))


@check("country_name", oracle(f"""
, known AS (SELECT lower(target_country) AS k, min(target_country) AS name FROM facts WHERE target_country <> '' GROUP BY 1),
asked AS (SELECT n_name AS selected FROM nation UNION ALL SELECT DISTINCT target_country FROM facts WHERE target_country IS NOT NULL
  UNION ALL SELECT 'IVORY COAST')
SELECT selected, COALESCE({mapped("lower(selected)", V.COUNTRY_ALIASES["report_articles"])}, name,
  list_aggregate(list_transform(string_split(lower(selected), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')) AS country
FROM asked LEFT JOIN known ON k = lower(selected)""", "facts"))
def _(spark, d):
    facts = view(spark, d, "facts").filter(F.col("target_country").isNotNull())
    known = facts.groupBy(F.lower("target_country").alias("k")).agg(F.min("target_country").alias("known"))
    asked = (table(spark, d, "nation").select(F.col("n_name").alias("selected"))
             .unionByName(facts.select(F.col("target_country").alias("selected")).distinct())
             .unionByName(spark.createDataFrame([("IVORY COAST",)], "selected string")))
    joined = asked.join(known, F.lower("selected") == F.col("k"), "left")
    return joined.select("selected", L.country_name("selected", "known").alias("country"))


@check("risk_bands", oracle("""
SELECT i.actor, i.country, i.intent, CASE WHEN r > 0.7 THEN 'High' WHEN r > 0.4 THEN 'Medium' ELSE 'Low' END AS band,
  CASE WHEN round(r, 2) <= 0.30 THEN 'Low' WHEN round(r, 2) <= 0.60 THEN 'Moderate' ELSE 'High' END AS guide
FROM (SELECT *, final_risk * 1.4E0 AS r FROM idx) i""", "idx"))
def _(spark, d):
    r = F.col("final_risk") * 1.4
    return view(spark, d, "idx").select("actor", "country", "intent", S.risk_band(r).alias("band"), S.guide_band(r).alias("guide"))


@check("months_to_event", """
SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 999 WHEN CAST(o_orderdate AS DATE) <= DATE '1996-06-15' THEN 0
  ELSE greatest(0, (year(o_orderdate) - 1996) * 12 + month(o_orderdate) - 6 - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END)
  END AS months FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.months_to_election("o_orderdate", F.lit("1996-06-15")).alias("months"))


@check("event_proximity", """
SELECT o_orderkey, round(1 - least(m, 24) / 24.0E0, 6) AS proximity FROM (SELECT o_orderkey, CASE
  WHEN CAST(o_orderdate AS DATE) <= DATE '1996-06-15' THEN 0
  ELSE (year(o_orderdate) - 1996) * 12 + month(o_orderdate) - 6 - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END END AS m
  FROM orders)""")
def _(spark, d):
    months = S.months_to_election("o_orderdate", F.lit("1996-06-15"))
    return table(spark, d, "orders").select("o_orderkey", F.round(S.election_proximity(months), 6).alias("proximity"))


@check("fsi_norm", """
SELECT p_partkey, round(greatest(0, least(1, (p_size * 3 - 22) / 98.0E0)), 6) AS norm FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.fsi_norm(F.col("p_size") * 3), 6).alias("norm"))


@check("debt_ratio_and_presence", """
SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN least(1, greatest(0, 1000 / c_acctbal)) ELSE 0 END, 6) AS ratio,
  CASE WHEN c_acctbal < -500 THEN 1.0 WHEN c_nationkey > 20 THEN 1.0 WHEN c_custkey % 10 = 1 THEN 1.0
    WHEN c_nationkey > 12 THEN 0.5 WHEN c_custkey % 10 > 0 AND c_custkey % 10 < 1 THEN 0.5
    WHEN c_custkey % 4 = 3 THEN 0.5E0 ELSE 0.2E0 END AS presence FROM customer""")
def _(spark, d):
    mil = F.when(F.col("c_nationkey") > 20, 0.33).when(F.col("c_nationkey") > 12, 0.1).otherwise(0.0)
    res = F.when(F.col("c_custkey") % 10 == 1, 0.10).otherwise(0.0)
    disinfo = F.when(F.col("c_custkey") % 4 == 3, 0.16).otherwise(0.15)
    debt = F.when(F.col("c_acctbal") < -500, 1.0).otherwise(0.0)
    return table(spark, d, "customer").select(
        "c_custkey", F.round(S.debt_ratio(F.lit(1000.0), "c_acctbal"), 6).alias("ratio"),
        S.presence(debt, mil, res, disinfo).alias("presence"))


# ---- question routing --------------------------------------------------------
def q_any(name):
    return low_any("q", V.QUESTION_WORDS[name])


def first_key(values):
    return "CASE " + " ".join(f"WHEN contains(q, {quoted(k)}) THEN {quoted(v)}" for k, v in values.items()) + " ELSE NULL END"


def listed_names(names):
    def title(n):
        return " ".join(w.capitalize() for w in n.split())

    return "list_filter([" + ", ".join(f"CASE WHEN contains(q, {quoted(n)}) THEN {quoted(title(n))} END" for n in names) + "], lambda x: x IS NOT NULL)"


@check("route_questions", oracle(f"""
, a AS (SELECT *, lower(trim(text)) AS q FROM questions),
b AS (SELECT *, regexp_extract(q, {quoted("(" + V.QUESTION_COUNTRY_PATTERN + ")")}, 1) AS nc,
    regexp_extract(q, {quoted("(" + V.QUESTION_ACTOR_PATTERN + ")")}, 1) AS na,
    regexp_extract(q, {quoted(V.QUESTION_ABOUT_COUNTRY_PATTERN)}, 1) AS ac,
    {listed_names(V.QUESTION_ACTORS)} AS actors, {listed_names(V.QUESTION_COUNTRIES)} AS countries FROM a),
c AS (SELECT *, CASE WHEN contains(ac, 'south') THEN 'South Africa' WHEN ac = 'senegal' THEN 'Senegal' WHEN ac = 'drc' THEN 'DRC'
    WHEN contains(ac, 'cote') OR contains(ac, 'ivor') THEN 'Côte d''Ivoire' WHEN ac = 'ethiopia' THEN 'Ethiopia' END AS about FROM b),
r AS (SELECT *, CASE WHEN nc <> '' AND {q_any("narratives")} THEN 'narratives' WHEN {q_any("overview")} THEN 'overview'
    WHEN about IS NOT NULL AND {q_any("country_counts")} THEN 'country_counts' WHEN {q_any("actor_stats")} THEN 'actor_stats'
    WHEN contains(q, 'compare') AND len(actors) >= 2 THEN 'compare' WHEN {q_any("tone")} AND len(actors) >= 1 THEN 'tone'
    WHEN {q_any("off_topic")} AND NOT {q_any("off_topic_actors")} THEN 'off_topic' WHEN {q_any("help")} THEN 'help'
    WHEN {q_any("total")} THEN 'total' WHEN {q_any("avg_index")} THEN 'avg_index' ELSE 'context' END AS route FROM c)
SELECT conv_id, turn, route,
  CASE route WHEN 'narratives' THEN {mapped("nc", V.COUNTRY_ALIASES["question"])} WHEN 'country_counts' THEN about
    WHEN 'actor_stats' THEN countries[1] WHEN 'compare' THEN countries[1] WHEN 'tone' THEN countries[1]
    WHEN 'context' THEN {first_key(V.COUNTRY_ALIASES["question"])} END AS country,
  CASE route WHEN 'narratives' THEN {mapped("na", V.ACTOR_ALIASES["question"])} WHEN 'compare' THEN actors[1]
    WHEN 'tone' THEN actors[1] WHEN 'context' THEN {first_key(V.ACTOR_ALIASES["question"])} END AS actor,
  CASE WHEN route = 'compare' THEN actors[2] END AS other_actor,
  CASE WHEN route = 'context' THEN {first_key(V.intent_aliases("display"))} END AS intent FROM r""", "questions"))
def _(spark, d):
    return route_questions(view(spark, d, "questions")).drop("text")


@check("answer_questions", oracle(f"""
, routed AS ({CHECKS["route_questions"][1]}),
named AS (SELECT lower(target_country) AS c, lower(inferred_actor) AS a, tone FROM facts WHERE inferred_actor NOT IN ('', 'Unknown')),
per AS (SELECT c, a, count(*) AS n FROM named WHERE c IS NOT NULL GROUP BY ALL UNION ALL SELECT '', a, count(*) FROM named GROUP BY a),
top AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, a) <= 5),
two AS (SELECT conv_id, turn, COALESCE(lower(country), '') AS c, unnest([actor, other_actor]) AS label FROM routed WHERE route = 'compare')
SELECT conv_id, turn, 'articles' AS measure, NULL AS label, CAST((SELECT count(*) FROM facts) AS DOUBLE) AS value FROM routed WHERE route = 'total'
UNION ALL SELECT conv_id, turn, 'mean index', NULL, (SELECT round(avg(final_risk), 6) FROM idx) FROM routed WHERE route = 'avg_index'
UNION ALL SELECT conv_id, turn, 'articles', country, COALESCE(n, 0) FROM routed LEFT JOIN (SELECT lower(target_country) AS c, count(*) AS n FROM facts GROUP BY 1)
  ON c = lower(country) WHERE route = 'country_counts'
UNION ALL SELECT conv_id, turn, 'articles', label, COALESCE(n, 0) FROM two LEFT JOIN per ON per.c = two.c AND per.a = lower(label)
UNION ALL SELECT conv_id, turn, 'tone', t.tone, t.n FROM routed JOIN (SELECT a, tone, count(*) AS n FROM named WHERE tone NOT IN ('', 'Unknown') GROUP BY ALL) t
  ON t.a = lower(actor) WHERE route = 'tone'
UNION ALL SELECT conv_id, turn, 'articles', a, n FROM routed JOIN top ON top.c = COALESCE(lower(country), '') WHERE route = 'actor_stats'""",
    "questions", "facts", "idx"))
def _(spark, d):
    routed = route_questions(view(spark, d, "questions")).drop("text")
    return answer_questions(routed, view(spark, d, "facts"), view(spark, d, "idx"), ["conv_id", "turn"])


@check("questions_per_route", oracle(f"""
SELECT CASE WHEN {q_any("overview").replace("(q,", "(lower(text),")} THEN 'overview' ELSE 'other' END AS kind, count(*) AS n
FROM questions WHERE NOT regexp_matches(lower(text), {quoted("(" + V.QUESTION_COUNTRY_PATTERN + ")")}) GROUP BY 1""", "questions"))
def _(spark, d):
    routed = route_questions(view(spark, d, "questions"))
    no_country = routed.filter(~F.lower("text").rlike("(" + V.QUESTION_COUNTRY_PATTERN + ")"))
    kind = F.when(F.col("route") == "overview", "overview").otherwise("other")
    return A.count_by(no_country.withColumn("kind", kind), "kind", name="n")
