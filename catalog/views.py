"""Narratives, stories, index, scores and questions derived from the given tables.

Each view is one SELECT that Spark and DuckDB both run, over whole tables: every event is
an article fact and takes the text of its document (ten events per document), behind a
lead line that gives the word and date rules something to find.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


FACTS = """
SELECT event_id AS id,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS posting_time,
  CASE user_id % 12 WHEN 0 THEN 'France24' WHEN 1 THEN 'BBC Africa' WHEN 2 THEN 'Xinhua' WHEN 3 THEN 'Rfi'
    WHEN 4 THEN ' rfi ' WHEN 5 THEN 'The New York Times' WHEN 6 THEN 'Sport 24' WHEN 7 THEN 'Anadolu Agency'
    WHEN 8 THEN '' WHEN 9 THEN 'Gulf News' WHEN 10 THEN 'Le Soleil' ELSE NULL END AS media_outlet,
  CASE user_id % 13 WHEN 0 THEN 'China' WHEN 1 THEN 'France' WHEN 2 THEN 'US' WHEN 3 THEN 'United States'
    WHEN 4 THEN 'Russia' WHEN 5 THEN 'Saudi Arabia' WHEN 6 THEN 'UAE' WHEN 7 THEN 'Turkey' WHEN 8 THEN 'Rwanda'
    WHEN 9 THEN 'Local' WHEN 10 THEN '' WHEN 11 THEN 'Unknown' ELSE NULL END AS inferred_actor,
  CASE event_id % 8 WHEN 0 THEN 'Senegal' WHEN 1 THEN 'Ethiopia' WHEN 2 THEN 'Côte d''Ivoire' WHEN 3 THEN 'DRC'
    WHEN 4 THEN 'South Africa' WHEN 5 THEN 'drc' WHEN 6 THEN 'Cote d''Ivoire' ELSE NULL END AS target_country,
  CASE event_id % 11 WHEN 0 THEN 'Economic' WHEN 1 THEN 'economic dependency' WHEN 2 THEN 'Sovereignty Erosion'
    WHEN 3 THEN 'Religious' WHEN 4 THEN 'Military Base' WHEN 5 THEN 'resource control'
    WHEN 6 THEN 'Human Rights Advocacy' WHEN 7 THEN 'Other' WHEN 8 THEN '' WHEN 9 THEN 'Unknown'
    ELSE NULL END AS strategic_intent,
  CASE event_id % 5 WHEN 0 THEN 'Factual' WHEN 1 THEN 'Alarmist 3.45' WHEN 2 THEN '(''Cynical'', 0.9)'
    WHEN 3 THEN '' ELSE NULL END AS tone,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id * 37 % 101 AS DOUBLE) / 100 END AS confidence,
  (event_id % 10 = 0) AS is_anchor,
  CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'Sovereignty Erosion' ELSE 'Economic' END END
    AS true_label,
  CASE user_id % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'https://x.example/a'
    WHEN 4 THEN 'Ana O''Neil' WHEN 5 THEN 'jean-luc b.' ELSE 'Jean-Luc B.' END AS author,
  CASE WHEN event_id % 41 = 0 THEN NULL
    WHEN event_id % 3 = 0 THEN 'https://news.example.com/hot'
    ELSE 'https://news.example.com/' || CAST(event_id % 4000 AS STRING) END AS url,
  CASE user_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'sw' WHEN 3 THEN 'am' WHEN 4 THEN '' END
    AS lang_detect,
  CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE END AS pseudo_kept,
  CASE event_type WHEN 'view' THEN 1.0E0 ELSE 0.0E0 END AS pseudo_weight,
  CASE WHEN event_id % 17 = 0 THEN event_id END AS media_outlet_fk,
  CASE WHEN event_id % 19 = 0 THEN event_id END AS journalist_fk
FROM events"""

LEAD = """CASE f.id % 12
    WHEN 0 THEN 'Football match report' || chr(10)
    WHEN 1 THEN 'By Ana Oneil' || chr(10) || 'Published 15/04/2025' || chr(10)
      || 'Senegal port trade deal signed with Chinese investors' || chr(10)
    WHEN 2 THEN 'Talks in ' || COALESCE(f.target_country, 'Africa') || ' go on' || chr(10)
    WHEN 3 THEN 'Chinese military base in Ethiopia draws protest' || chr(10)
    WHEN 4 THEN 'April 15, 2025 - Kremlin envoy visits Kinshasa' || chr(10)
    WHEN 5 THEN 'Medical health project opens in Dakar' || chr(10)
    WHEN 6 THEN 'La campagne : le parti et la ville pour la France' || chr(10)
    WHEN 9 THEN '15 April 2025 Abidjan cocoa and mineral exports' || chr(10)
    WHEN 11 THEN 'Error: timeout' || chr(10)
    ELSE '' END"""

ARTICLES = f"""
SELECT f.*, CASE f.id % 12 WHEN 7 THEN NULL WHEN 8 THEN 'Failed: HTTP 500' WHEN 10 THEN '   '
    ELSE {LEAD} || COALESCE(d.text, '') END AS article_text
FROM facts f LEFT JOIN documents d ON d.doc_id = CAST((f.id - f.id % 10) / 10 AS BIGINT)"""

# mean confidence (summed in whole hundredths, so that both engines agree to the last bit) per index-style (actor, country, intent); some cells are missing on purpose
INDEX = """
SELECT actor, country, intent, CAST(SUM(CAST(ROUND(COALESCE(confidence, 0.0E0) * 100) AS BIGINT)) AS DOUBLE) / COUNT(*)
  * 0.00987654321E0 AS final_risk FROM (
  SELECT CASE inferred_actor WHEN 'US' THEN 'UnitedStates' WHEN 'Saudi Arabia' THEN 'Saudi' ELSE inferred_actor END
      AS actor,
    CASE target_country WHEN 'Côte d''Ivoire' THEN 'CoteIvoire' ELSE target_country END AS country,
    CASE id % 7 WHEN 0 THEN 'Economic' WHEN 1 THEN 'Sovereignty' WHEN 2 THEN 'Religious'
      WHEN 3 THEN 'MilitaryPresence' WHEN 4 THEN 'SocialFragility' WHEN 5 THEN 'LGBTQ' ELSE 'ElectionInfluence' END
      AS intent,
    confidence
  FROM facts
  WHERE inferred_actor IN ('China', 'France', 'US', 'Russia', 'Saudi Arabia', 'UAE')
    AND target_country IN ('Senegal', 'Ethiopia', 'DRC', 'Côte d''Ivoire')) c
WHERE NOT (actor = 'China' AND intent IN ('Economic', 'LGBTQ'))
GROUP BY actor, country, intent"""

OUTLETS = """
SELECT s_suppkey AS id, CASE s_suppkey WHEN 1 THEN 'Rfi' WHEN 2 THEN 'FRANCE24' WHEN 3 THEN 'xinhua'
    ELSE s_name END AS name
FROM supplier"""

JOURNALISTS = """
SELECT c_custkey AS id, CASE c_custkey WHEN 1 THEN 'ANA O''NEIL' WHEN 2 THEN 'Jean-Luc B.' WHEN 3 THEN 'JEAN-LUC B.'
    ELSE c_name END AS name
FROM customer"""

# every turn of every conversation, behind a question about one of the topics
QUESTIONS = """
SELECT conv_id, turn, CASE (conv_id * 5 + turn) % 15
    WHEN 0 THEN 'What narratives about Senegal and China? '
    WHEN 1 THEN 'List narratives. ' WHEN 2 THEN 'How many articles on ivory coast? '
    WHEN 3 THEN 'Most active actors in DRC ' WHEN 4 THEN 'Compare Russia and France in Ethiopia '
    WHEN 5 THEN 'Tone of Turkey coverage ' WHEN 6 THEN 'celebrity music ' WHEN 7 THEN 'how to filter '
    WHEN 8 THEN 'total number ' WHEN 9 THEN 'vulnerability score ' WHEN 10 THEN 'compare China '
    WHEN 11 THEN 'Ivory Coast and UAE religious influence ' WHEN 12 THEN 'claims in cote ivoire by turkey '
    WHEN 13 THEN 'stats for south africa ' ELSE '' END || text AS text
FROM conversations"""

# each vector as 8 models x 8 classes of logits
LOGITS_SPARK = """
SELECT vec_id AS article_id, CAST(pos DIV 8 AS INT) AS model, CAST(pos % 8 AS INT) AS class,
  CAST(x AS DOUBLE) * 4 AS logit, label
FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, x) FROM embeddings)"""
LOGITS_DUCK = """
SELECT vec_id AS article_id, CAST(pos // 8 AS INT) AS model, CAST(pos % 8 AS INT) AS class,
  CAST(x AS DOUBLE) * 4 AS logit, label
FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""

# exposure of customer countries to supplier nations, from the order lines
EXPOSURE = """
SELECT actor, country, metric, CASE metric WHEN 'debt' THEN amount WHEN 'res' THEN qty / 1000000
    WHEN 'mil' THEN returned / lines WHEN 'disinfo' THEN late / lines WHEN 'elec' THEN disc / lines * 10
    ELSE tax / lines * 10 END AS value
FROM (SELECT sn.n_name AS actor, cn.n_name AS country, ROUND(SUM(l_extendedprice), 2) AS amount,
    SUM(l_quantity) AS qty, CAST(COUNT(*) AS DOUBLE) AS lines,
    CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS returned,
    CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS late,
    ROUND(SUM(l_discount), 4) AS disc, ROUND(SUM(l_tax), 4) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey
  GROUP BY sn.n_name, cn.n_name) pairs
JOIN (SELECT 'debt' AS metric UNION ALL SELECT 'res' UNION ALL SELECT 'mil' UNION ALL SELECT 'disinfo'
  UNION ALL SELECT 'elec' UNION ALL SELECT 'lgbtq') metrics ON TRUE
WHERE NOT (metric = 'debt' AND amount < 10000)"""

# the same pairs with each order's country found first, so that Spark moves the order lines once instead of once per join
LINES_OF = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
assert LINES_OF in EXPOSURE
EXPOSURE_SPARK = EXPOSURE.replace(LINES_OF, """lineitem JOIN
    (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey""")

PROFILE = """
SELECT n_name AS country, gdp, fsi_raw, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE enforcement END
    AS lgbt_enforcement,
  CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE CAST(last_order AS DATE) END AS election_date
FROM (SELECT c_nationkey, ROUND(SUM(c_acctbal) * 1000, 2) AS gdp, 22 + ROUND(AVG(c_acctbal), 4) / 80 AS fsi_raw,
    COUNT(DISTINCT c_mktsegment) / 7.0E0 AS enforcement
  FROM customer GROUP BY c_nationkey) c
JOIN (SELECT c_nationkey AS k, MAX(o_orderdate) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_nationkey) o ON o.k = c.c_nationkey
JOIN nation ON n_nationkey = c.c_nationkey"""

SPARK_VIEWS = {"facts": FACTS, "articles": ARTICLES, "idx": INDEX, "outlets": OUTLETS, "journalists": JOURNALISTS,
               "questions": QUESTIONS, "logits": LOGITS_SPARK, "exposure": EXPOSURE_SPARK, "profile": PROFILE}
DUCK_VIEWS = {**SPARK_VIEWS, "logits": LOGITS_DUCK, "exposure": EXPOSURE}
NEEDS = {"articles": ["facts"], "idx": ["facts"]}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = SPARK_VIEWS[name]
    names = [n for n in NEEDS.get(name, [])]
    ctes = ", ".join(f"{n} AS ({SPARK_VIEWS[n]})" for n in names)
    whole = f"WITH {ctes} {text}" if ctes else text
    frames = {}
    for base in BASE:
        pattern = rf"\b(FROM|JOIN) {base}\b"
        if re.search(pattern, whole):
            whole = re.sub(pattern, rf"\1 {{t_{base}}}", whole)
            frame = table(spark, sf_dir, base)
            frames[f"t_{base}"] = frame
    return spark.sql(whole, **frames)


def oracle(sql: str, *names: str) -> str:
    """DuckDB text with the derived views in front; `sql` may begin with `, more AS (...)`."""
    wanted: list[str] = []
    for n in names:
        wanted += [m for m in [*NEEDS.get(n, []), n] if m not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in wanted) + " " + sql


# ---- SQL fragments ---------------------------------------------------------
def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def has_any(column: str, words) -> str:
    """Case-insensitive any-of, spelled out."""
    return "(" + " OR ".join(f"contains(upper({column}), upper({quoted(w)}))" for w in words) + ")"


def low_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


def mapped(expr: str, values, default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {default} END"


def rules(expr: str, pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {low_any(expr, w)} THEN {quoted(v)}" for v, w in pairs) + f" ELSE {default} END"


STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def stripped(expr: str) -> str:
    return STRIP.format(expr)
