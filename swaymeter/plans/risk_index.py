"""The risk index: content signal, contextual signal and their combination.

The article table is read once, for the group sums; the anchor share is one number made from
these. Everything after the group sums works on a cube whose size does not depend on the
number of articles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import clip01, present
from swaymeter.functions.labels import contextual_intent
from swaymeter.functions.scores import (combine_risk, debt_ratio, election_proximity, fsi_norm, months_to_election,
                                        ppi_estimate, presence)
from swaymeter.operators.joins import score_cascade

GROUP = ["inferred_actor", "target_country", "strategic_intent"]
PAIR = ["actor", "country"]
#: Pairs of actors and countries an index may have.
MAX_CELLS = 1_000_000


# ---- content signal ------------------------------------------------------
def anchor_share(articles: DataFrame) -> DataFrame:
    """One row: all articles, anchors and their share (NULL when either is 0)."""
    counts = articles.agg(F.count("*").alias("total"), F.count_if("is_anchor").alias("anchors"))
    return counts.withColumn("share", F.when((F.col("total") > 0) & (F.col("anchors") > 0),
                                             F.col("anchors").cast("double") / F.col("total")))


def _group_sums(articles: DataFrame) -> DataFrame:
    """Per (actor, country, raw intent), whether known or not: articles, confidence, correction, anchors."""
    conf = F.coalesce("confidence", F.lit(0.0))
    labelled = F.coalesce(F.col("is_anchor"), F.lit(False)) & present("true_label")
    error = (F.col("true_label") == F.col("strategic_intent")).cast("double") - conf
    return articles.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.sum(conf).alias("sum_conf"),
        F.coalesce(F.sum(F.when(labelled, error)), F.lit(0.0)).alias("correction"),
        F.count_if(labelled).alias("n_labelled"), F.count_if("is_anchor").alias("_anchors"))


def known_group() -> Column:
    return present(GROUP[0]) & present(GROUP[1]) & present(GROUP[2])


def ppi_sums(articles: DataFrame) -> DataFrame:
    """Per (actor, country, raw intent): articles, confidence, correction and labelled anchors."""
    return _group_sums(articles.filter(known_group())).drop("_anchors")


def ppi(articles: DataFrame, apply_correction: bool = True) -> DataFrame:
    """Estimate `theta` per (actor, country, raw intent); empty when there are no anchors.

    All groups are summed, those without a name too, and the share of anchors is one number made from the sums.
    """
    every = _group_sums(articles)
    total, anchors = F.sum("n"), F.sum("_anchors")
    share = every.agg(F.when(anchors > 0, anchors.cast("double") / total)).scalar()
    shared = every.withColumn("share", share).drop("_anchors")
    sums = shared.filter(known_group() & F.col("share").isNotNull())
    correction = F.col("correction") if apply_correction else F.lit(0.0)
    return sums.withColumn("theta", ppi_estimate("n", "sum_conf", correction, "share"))


def content_signal(theta: DataFrame) -> DataFrame:
    """Unweighted mean of the estimates per (actor, country, index intent)."""
    return (theta.withColumn("intent", contextual_intent("strategic_intent")).filter(F.col("intent").isNotNull())
            .groupBy(F.col("inferred_actor").alias("actor"), F.col("target_country").alias("country"), "intent")
            .agg(F.avg("theta").alias("base"), F.count("*").alias("raw_intents")))


# ---- contextual signal ---------------------------------------------------
def exposure_grid(exposure: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per (actor, country) with every metric, 0.0 where there is no figure.

    Every actor of the figures is paired with every country of the profile, which is the index's own size and is held
    against MAX_CELLS. Figures without an actor or a country belong to no pair.
    """
    metrics = ["debt", "res", "mil", "disinfo", "elec", "lgbtq"]
    known = exposure.filter(F.col("actor").isNotNull() & F.col("country").isNotNull())
    wide = known.groupBy(*PAIR).agg(*[
        F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]).persist()  # the figures are read once
    names = countries.filter(F.col("country").isNotNull()).select("country").distinct().persist()
    actors = wide.select("actor").distinct()
    n_actors, n_names = actors.count(), names.count()
    if n_actors * n_names > MAX_CELLS:
        raise ValueError(f"{n_actors} actors and {n_names} countries; the bound is {MAX_CELLS} pairs")
    every = names.agg(F.collect_list("country")).scalar()  # at most MAX_CELLS names, as just counted
    grid = actors.withColumn("country", F.explode(every)).join(wide, PAIR, "left")
    return grid.select(*PAIR, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in metrics])


def factors(exposure: DataFrame, profile: DataFrame, as_of: str | Column | None = None,
            months: Mapping[str, int] | None = None) -> DataFrame:
    """The six factors per (actor, country).

    The election clock is either `as_of` against the profile's election dates or fixed
    `months` per country (absent: no election known).
    """
    if (as_of is None) == (months is None):
        raise ValueError("give either as_of or months")
    if months is not None:
        clock = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in months.items() for x in kv]),
                                            F.col("country")), F.lit(999)) if months else F.lit(999)
    else:
        clock = months_to_election("election_date", F.lit(as_of) if isinstance(as_of, str) else as_of)
    profile = profile.persist()  # a row per country, for the grid and the figures
    grid = exposure_grid(exposure, profile).join(profile, "country")
    foothold = presence("debt", "mil", "res", "disinfo")
    return grid.select(
        *PAIR, F.col("debt").alias("debt_value"),
        debt_ratio("debt", "gdp").alias("g_debt"), F.col("res").alias("g_res"), F.col("mil").alias("g_mil"),
        (F.col("elec") * F.greatest(election_proximity(clock), 0.25 * foothold)).alias("g_elec"),
        ((1.0 - F.coalesce("lgbt_enforcement", F.lit(0.5))) * F.col("lgbtq")).alias("g_lgbt"),
        (fsi_norm("fsi_raw") * F.col("disinfo")).alias("g_frag"))


def relative_factors(g: DataFrame, r_metric: str = "raw_debt") -> DataFrame:
    """Long table (actor, country, factor, g, r): r is g over the actor's largest.

    `raw_debt` compares debt in money, `g_debt` as a share of GDP.
    """
    debt = {"raw_debt": "debt_value", "g_debt": "g_debt"}[r_metric]
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"g_{f}").alias("g"),
                               F.col(debt if f == "debt" else f"g_{f}").alias("m")) for f in V.FACTORS])
    long = g.select(*PAIR, F.explode(cells).alias("_c")).select(*PAIR, "_c.*")
    top = F.max("m").over(Window.partitionBy("actor", "factor"))  # one row per country
    return long.withColumn("r", F.when(top > 0, F.col("m") / top).otherwise(F.lit(0.0))).drop("m")


def contextual_signal(relative: DataFrame, intent_factors: Mapping[str, Sequence[str]] = V.INTENT_FACTORS) -> DataFrame:
    """(intent, actor, country, ca): weighted mean of each intent's factors, weights from r."""
    links: dict[str, list[str]] = {}
    for intent, names in intent_factors.items():
        for f in names:
            links.setdefault(f, []).append(intent)
    intents = F.create_map(*[x for f, i in links.items() for x in (F.lit(f), F.array(*map(F.lit, i)))])
    used = relative.withColumn("intent", F.explode(F.try_element_at(intents, F.col("factor"))))
    # sum(w * g) with w = r / sum(r), or 1 / k where all r are 0
    total, k = F.sum("r"), F.count("*")
    mean = F.when(total == 0, F.sum("g") / k).otherwise(F.sum(F.col("r") * F.col("g")) / total)
    return used.groupBy("intent", *PAIR).agg(clip01(mean).alias("ca"))


def risk_cube(base: DataFrame, context: DataFrame) -> DataFrame:
    """(intent, actor, country, base, ca, final_risk) for every cell of the context."""
    joined = context.join(base.select("intent", *PAIR, "base"), ["intent", *PAIR], "left")
    filled = joined.fillna(0.0, ["base", "ca"])
    return filled.withColumn("final_risk", combine_risk("base", "ca"))


def index_context(exposure: DataFrame, profile: DataFrame, r_metric: str = "g_debt", as_of: str | None = None,
                  months: Mapping[str, int] | None = None) -> DataFrame:
    return contextual_signal(relative_factors(factors(exposure, profile, as_of, months), r_metric))


def build_index(articles: DataFrame, exposure: DataFrame, profile: DataFrame, r_metric: str = "g_debt",
                as_of: str | None = None, months: Mapping[str, int] | None = None,
                apply_correction: bool = True) -> DataFrame:
    """The whole index (actor, country, intent, final_risk) from articles and exposure."""
    base = content_signal(ppi(articles, apply_correction))
    cube = risk_cube(base, index_context(exposure, profile, r_metric, as_of, months))
    return cube.select("actor", "country", "intent", "final_risk")


def score_articles(articles: DataFrame, index: DataFrame) -> DataFrame:
    """One score and match level per article."""
    return score_cascade(articles, index)
