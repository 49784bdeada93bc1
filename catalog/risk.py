"""Content signal, contextual signal, index and article scores."""

from pyspark.sql import functions as F

from catalog import check
from catalog.labels import TWO_WAY
from catalog.views import mapped, oracle, quoted, rules, view
from swaymeter import fixed_values as V
from swaymeter.plans import risk_index as R
from swaymeter.sources import readers

PPI = """
, share AS (SELECT CASE WHEN count(*) > 0 AND count(CASE WHEN is_anchor THEN 1 END) > 0
    THEN CAST(count(CASE WHEN is_anchor THEN 1 END) AS DOUBLE) / count(*) END AS pi FROM facts),
g AS (SELECT inferred_actor, target_country, strategic_intent, count(*) AS n, sum(COALESCE(confidence, 0)) AS s,
    COALESCE(sum(CASE WHEN is_anchor AND true_label <> '' THEN CASE WHEN true_label = strategic_intent THEN 1 ELSE 0 END
      - COALESCE(confidence, 0) END), 0) AS corr,
    count(CASE WHEN is_anchor AND true_label <> '' THEN 1 END) AS n_labelled
  FROM facts WHERE inferred_actor <> '' AND target_country <> '' AND strategic_intent <> '' GROUP BY ALL),
theta AS (SELECT g.*, greatest(0, least(1, s / n + corr / (n * pi))) AS theta FROM g, share WHERE pi IS NOT NULL),
base AS (SELECT inferred_actor AS actor, target_country AS country, intent, avg(theta) AS base, count(*) AS raw_intents
  FROM (SELECT *, COALESCE(""" + mapped("r", V.intent_aliases("context")) + ", " + TWO_WAY + " ELSE " + rules(
    "r", V.CONTEXT_FUNNELS, "'Other'") + """ END) AS intent FROM (SELECT *, lower(trim(strategic_intent)) AS r FROM theta)) GROUP BY ALL)"""


@check("anchor_share", oracle("""
SELECT count(*) AS total, count(CASE WHEN is_anchor THEN 1 END) AS anchors,
  round(count(CASE WHEN is_anchor THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS share FROM facts""", "facts"))
def _(spark, d):
    return R.anchor_share(view(spark, d, "facts")).withColumn("share", F.round("share", 6))


@check("ppi_sums", oracle(PPI + """
SELECT inferred_actor, target_country, strategic_intent, n, round(s, 6) AS sum_conf, round(corr, 6) AS correction, n_labelled FROM g""", "facts"))
def _(spark, d):
    sums = R.ppi_sums(view(spark, d, "facts"))
    return sums.withColumns({c: F.round(c, 6) for c in ("sum_conf", "correction")})


@check("ppi_theta", oracle(PPI + """
SELECT inferred_actor, target_country, strategic_intent, n, n_labelled, round(theta, 6) AS theta FROM theta""", "facts"))
def _(spark, d):
    return R.ppi(view(spark, d, "facts")).select("inferred_actor", "target_country", "strategic_intent", "n", "n_labelled",
                                                 F.round("theta", 6).alias("theta"))


@check("ppi_theta_uncorrected", oracle(PPI + """
SELECT inferred_actor, target_country, strategic_intent, round(greatest(0, least(1, s / n)), 6) AS theta FROM g""", "facts"))
def _(spark, d):
    return R.ppi(view(spark, d, "facts"), apply_correction=False).select(
        "inferred_actor", "target_country", "strategic_intent", F.round("theta", 6).alias("theta"))


@check("content_signal", oracle(PPI + """
SELECT actor, country, intent, round(base, 6) AS base, raw_intents FROM base""", "facts"))
def _(spark, d):
    return R.content_signal(R.ppi(view(spark, d, "facts"))).withColumn("base", F.round("base", 6))


FACTORS = """
, wide AS (SELECT a.actor, c.country, """ + ", ".join(
    f"COALESCE(sum(CASE WHEN metric = '{m}' THEN value END), 0) AS {m}" for m in ("debt", "res", "mil", "disinfo", "elec", "lgbtq")) + """
  FROM (SELECT DISTINCT actor FROM exposure) a CROSS JOIN (SELECT DISTINCT country FROM profile) c
  LEFT JOIN exposure e ON e.actor = a.actor AND e.country = c.country GROUP BY a.actor, c.country),
k AS (SELECT w.*, gdp, fsi_raw, lgbt_enforcement, CASE WHEN debt > 0 OR mil >= 0.33 OR res >= 0.10 THEN 1.0
    WHEN mil > 0 OR res > 0 OR disinfo > 0.15 THEN 0.5 ELSE 0.2 END AS presence,
    CASE WHEN election_date IS NULL THEN 999 WHEN election_date <= DATE '1996-06-15' THEN 0
      ELSE greatest(0, (year(election_date) - 1996) * 12 + month(election_date) - 6
        - CASE WHEN day(election_date) < 15 THEN 1 ELSE 0 END) END AS months
  FROM wide w JOIN profile p ON p.country = w.country),
f AS (SELECT actor, country, debt AS debt_value, CASE WHEN gdp > 0 THEN greatest(0, least(1, debt / gdp)) ELSE 0 END AS g_debt,
    res AS g_res, mil AS g_mil,
    elec * greatest(CASE WHEN months < 999 THEN 1 - least(months, 24) / 24.0E0 ELSE 0 END, 0.25 * presence) AS g_elec,
    (1 - COALESCE(lgbt_enforcement, 0.5)) * lgbtq AS g_lgbt,
    greatest(0, least(1, (fsi_raw - 22) / 98.0E0)) * disinfo AS g_frag FROM k)"""
LONG = """
, long AS (SELECT actor, country, 'debt' AS factor, g_debt AS g, {debt} AS m FROM f""" + "".join(
    f" UNION ALL SELECT actor, country, '{x}', g_{x}, g_{x} FROM f" for x in ("mil", "res", "elec", "lgbt", "frag")) + """),
rel AS (SELECT actor, country, factor, g, CASE WHEN max(m) OVER w > 0 THEN m / max(m) OVER w ELSE 0 END AS r FROM long
  WINDOW w AS (PARTITION BY actor, factor)),
links(intent, factor) AS (VALUES """ + ", ".join(f"({quoted(i)}, {quoted(x)})" for i, fs in V.INTENT_FACTORS.items() for x in fs) + """),
weighted AS (SELECT intent, actor, country, g, CASE WHEN sum(r) OVER w = 0 THEN 1.0E0 / count(*) OVER w ELSE r / sum(r) OVER w END AS wt
  FROM rel JOIN links USING (factor) WINDOW w AS (PARTITION BY intent, actor, country)),
ca AS (SELECT intent, actor, country, greatest(0, least(1, sum(wt * g))) AS ca FROM weighted GROUP BY ALL)"""
AS_OF = "1996-06-15"


def derived_factors(spark, d):
    return R.factors(view(spark, d, "exposure"), view(spark, d, "profile"), as_of=AS_OF)


@check("exposure_grid", oracle(FACTORS + """
SELECT actor, country, round(debt, 4) AS debt, round(res, 6) AS res, round(mil, 6) AS mil, round(disinfo, 6) AS disinfo,
  round(elec, 6) AS elec, round(lgbtq, 6) AS lgbtq FROM wide""", "exposure", "profile"))
def _(spark, d):
    grid = R.exposure_grid(view(spark, d, "exposure"), view(spark, d, "profile"))
    return grid.select("actor", "country", F.round("debt", 4).alias("debt"),
                       *[F.round(c, 6).alias(c) for c in ("res", "mil", "disinfo", "elec", "lgbtq")])


@check("factors", oracle(FACTORS + """
SELECT actor, country, """ + ", ".join(f"round(g_{x}, 6) AS g_{x}" for x in V.FACTORS) + " FROM f", "exposure", "profile"))
def _(spark, d):
    return derived_factors(spark, d).select("actor", "country", *[F.round(f"g_{x}", 6).alias(f"g_{x}") for x in V.FACTORS])


def register_relative(metric, column):
    @check(f"relative_factors_{metric}", oracle(FACTORS + LONG.replace("{debt}", column) + """
SELECT actor, country, factor, round(g, 6) AS g, round(r, 6) AS r FROM rel""", "exposure", "profile"))
    def _(spark, d):
        out = R.relative_factors(derived_factors(spark, d), metric)
        return out.select("actor", "country", "factor", F.round("g", 6).alias("g"), F.round("r", 6).alias("r"))


register_relative("raw_debt", "debt_value")
register_relative("g_debt", "g_debt")


@check("contextual_signal", oracle(FACTORS + LONG.replace("{debt}", "g_debt") + """
SELECT intent, actor, country, round(ca, 6) AS ca FROM ca""", "exposure", "profile"))
def _(spark, d):
    out = R.contextual_signal(R.relative_factors(derived_factors(spark, d), "g_debt"))
    return out.withColumn("ca", F.round("ca", 6))


def packaged(name, rows):
    return f"{name} AS (VALUES " + ", ".join("(" + ", ".join(
        "NULL" if x is None else repr(x) + "E0" if isinstance(x, float) and "e" not in repr(x) else repr(x) if isinstance(x, float)
        else quoted(x) for x in r) + ")" for r in rows) + ")"


PACKAGED = (", " + packaged("exposure(actor, country, metric, value)", V.exposure_rows()) + ", "
            + packaged("profile0(country, gdp, fsi_raw, lgbt_enforcement, election_date)", V.COUNTRY_PROFILE)
            + ", profile AS (SELECT country, gdp, fsi_raw, lgbt_enforcement, CAST(election_date AS DATE) AS election_date FROM profile0)")
CUBE = PPI + PACKAGED + FACTORS.replace("1996-06-15", "2026-01-15").replace("- 1996", "- 2026").replace("- 6\n", "- 1\n") + LONG


@check("final_risk_cube", oracle(CUBE.replace("{debt}", "g_debt") + """
SELECT ca.intent, ca.actor, ca.country, round(COALESCE(base, 0), 6) AS base, round(ca, 6) AS ca,
  round(greatest(0, least(1, COALESCE(base, 0) + (1 - COALESCE(base, 0)) * ca)), 6) AS final_risk
FROM ca LEFT JOIN base b ON b.intent = ca.intent AND b.actor = ca.actor AND b.country = ca.country""", "facts"))
def _(spark, d):
    base = R.content_signal(R.ppi(view(spark, d, "facts")))
    context = R.index_context(readers.exposure(spark), readers.country_profile(spark), "g_debt", as_of="2026-01-15")
    cube = R.risk_cube(base, context)
    return cube.withColumns({c: F.round(c, 6) for c in ("base", "ca", "final_risk")})


@check("build_index", oracle(CUBE.replace("{debt}", "debt_value") + """
SELECT ca.intent, ca.actor, ca.country, round(greatest(0, least(1, COALESCE(base, 0) + (1 - COALESCE(base, 0)) * ca)), 6) AS final_risk
FROM ca LEFT JOIN base b ON b.intent = ca.intent AND b.actor = ca.actor AND b.country = ca.country""", "facts"))
def _(spark, d):
    index = R.build_index(view(spark, d, "facts"), readers.exposure(spark), readers.country_profile(spark), "raw_debt",
                          as_of="2026-01-15")
    return index.withColumn("final_risk", F.round("final_risk", 6))


@check("score_articles", oracle(CUBE.replace("{debt}", "g_debt") + f"""
, x AS (SELECT ca.intent, ca.actor, ca.country, greatest(0, least(1, COALESCE(base, 0) + (1 - COALESCE(base, 0)) * ca)) AS final_risk
  FROM ca LEFT JOIN base b ON b.intent = ca.intent AND b.actor = ca.actor AND b.country = ca.country),
s AS (SELECT id, COALESCE({mapped("lower(trim(target_country))", V.COUNTRY_ALIASES["score"])}, target_country, '') AS c,
  COALESCE({mapped("lower(trim(inferred_actor))", V.ACTOR_ALIASES["score"])}, inferred_actor, '') AS a,
  COALESCE({mapped("lower(trim(strategic_intent))", V.intent_aliases("score"))}, 'Sovereignty') AS i FROM facts)
SELECT id, CASE WHEN x.final_risk IS NOT NULL THEN 'exact' WHEN p.risk IS NOT NULL THEN 'pair' ELSE 'constant' END AS match_level,
  round(COALESCE(x.final_risk, p.risk), 5) AS score
FROM s LEFT JOIN x ON lower(x.country) = lower(c) AND lower(x.actor) = lower(a) AND lower(x.intent) = lower(i)
LEFT JOIN (SELECT lower(country) AS pc, lower(actor) AS pa, max(final_risk) AS risk FROM x GROUP BY 1, 2) p ON pc = lower(c) AND pa = lower(a)""", "facts"))
def _(spark, d):
    facts = view(spark, d, "facts")
    index = R.build_index(facts, readers.exposure(spark), readers.country_profile(spark), "g_debt", as_of="2026-01-15")
    scored = R.score_articles(facts, index)
    known = F.when(F.col("match_level") != "constant", F.round("score", 5))
    return scored.select("id", "match_level", known.alias("score"))
