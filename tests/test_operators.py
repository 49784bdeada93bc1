"""Literal rows and properties for operators and plans."""

import datetime
import json
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.labels import clean_tone, untuple_tone
from swaymeter.operators import aggregates as A
from swaymeter.operators import filters as P
from swaymeter.operators import fusion as E
from swaymeter.operators import html
from swaymeter.operators import joins as J
from swaymeter.operators import maintain as M
from swaymeter.operators import paging, sets
from swaymeter.plans import jobs, reports
from swaymeter.plans import risk_index as R
from swaymeter.plans.ingest import ingest_stories
from swaymeter.sources import readers, sinks
from swaymeter.streaming import streams as S


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- risk index --------------------------------------------------------------
# Published final risk for a content signal of 0, debt compared in money, an election in
# three months in Cote d'Ivoire and none elsewhere: sums over all actors and countries, and single cells
PUBLISHED_SUMS = {"ElectionInfluence": 7.49302934, "MilitaryPresence": 8.627549918, "ResourceDependency": 4.348611982,
                  "SocialFragility": 11.609543521}
PUBLISHED_CELLS = {
    ("ElectionInfluence", "China", "DRC"): 0.2218826269815859,
    ("MilitaryPresence", "UnitedStates", "CoteIvoire"): 0.66,
    ("ResourceDependency", "China", "Ethiopia"): 0.5943873517786561,
    ("SocialFragility", "Russia", "South Africa"): 0.34009651981727135,
    ("SocialFragility", "NonState", "DRC"): 0.7765714285714286,
    ("ElectionInfluence", "France", "CoteIvoire"): 0.3963749549266066,
    ("ResourceDependency", "UAE", "Senegal"): 0.0019523809523809524,
    ("MilitaryPresence", "Rwanda", "DRC"): 0.33,
}
# Sums of the other four intents, which had a content signal and so lie above the context alone
PUBLISHED_UPPER_SUMS = {"Economic": 5.678068043, "Sovereignty": 8.22835122, "LGBTQ": 8.945819141, "Religious": 9.782094615}


@pytest.fixture(scope="module")
def context(spark):
    months = {"CoteIvoire": 3}
    return R.index_context(readers.exposure(spark), readers.country_profile(spark), "raw_debt", months=months).persist()


def test_published_index(spark, context):
    cells = {(r.intent, r.actor, r.country): r.ca for r in context.collect()}
    assert len(cells) == 440
    for cell, value in PUBLISHED_CELLS.items():
        assert cells[cell] == pytest.approx(value, abs=1e-9)
    for intent, total in PUBLISHED_SUMS.items():
        assert sum(v for k, v in cells.items() if k[0] == intent) == pytest.approx(total, abs=1e-8)
    for intent, total in PUBLISHED_UPPER_SUMS.items():
        assert sum(v for k, v in cells.items() if k[0] == intent) < total


def test_debt_variants_differ(spark, context):
    other = R.index_context(readers.exposure(spark), readers.country_profile(spark), "g_debt", months={"CoteIvoire": 3})
    joined = context.join(other.withColumnRenamed("ca", "cb"), ["intent", "actor", "country"])
    assert 0 < joined.filter(F.abs(F.col("ca") - F.col("cb")) > 1e-9).count() < 440


def article(**kw):
    base = {"id": 0, "inferred_actor": "China", "target_country": "Senegal", "strategic_intent": "Economic", "confidence": 0.5,
            "is_anchor": False, "true_label": None}
    return {**base, **kw}


ART = ("id long, inferred_actor string, target_country string, strategic_intent string, confidence double, is_anchor boolean, "
       "true_label string")


def articles(spark, items):
    return spark.createDataFrame([article(id=i, **kw) for i, kw in enumerate(items)], ART)


def test_ppi_by_hand(spark):
    df = articles(spark, [{"confidence": 0.6}, {"confidence": 0.8, "is_anchor": True, "true_label": "Economic"},
                          {"confidence": None, "is_anchor": True, "true_label": "Religious"},
                          {"inferred_actor": "", "is_anchor": True}, {"strategic_intent": "Religious", "confidence": 0.4}])
    theta = {r.strategic_intent: r.theta for r in R.ppi(df).collect()}
    # share 3/5; corrections (1 - .8) + (0 - 0)
    assert theta["Economic"] == pytest.approx((0.6 + 0.8 + 0) / 3 + 0.2 / (3 * 0.6))
    assert theta["Religious"] == pytest.approx(0.4)


def test_ppi_is_limited_and_guarded(spark):
    right = articles(spark, [{"is_anchor": True, "true_label": "Economic", "confidence": 0.1}] + [{"strategic_intent": "x"}] * 9)
    wrong = articles(spark, [{"is_anchor": True, "true_label": "z", "confidence": 0.9}] + [{"strategic_intent": "x"}] * 9)
    assert R.ppi(right).filter("strategic_intent = 'Economic'").first().theta == 1.0
    assert R.ppi(wrong).filter("strategic_intent = 'Economic'").first().theta == 0.0
    assert R.ppi(articles(spark, [{}, {}])).count() == 0
    assert R.ppi(articles(spark, [{}]).limit(0)).count() == 0


def test_index_properties(spark, context):
    rng = random.Random(7)
    items = [{"inferred_actor": rng.choice(["China", "France", "Iran", ""]), "target_country": rng.choice(["Senegal", "DRC"]),
              "strategic_intent": rng.choice(["Economic", "military base", "odd", None]), "confidence": rng.random(),
              "is_anchor": rng.random() < 0.3, "true_label": rng.choice(["Economic", None])} for _ in range(400)]
    base = R.content_signal(R.ppi(articles(spark, items)))
    cube = R.risk_cube(base, context)
    got = rows(cube.withColumns({c: F.round(c, 9) for c in ("base", "ca", "final_risk")}))
    assert len(got) == 440
    assert all(0 <= r["final_risk"] <= 1 and r["final_risk"] >= max(r["base"], r["ca"]) - 1e-12 for r in cube.collect())
    shuffled = articles(spark, items).orderBy(F.rand(3)).repartition(5)
    again = R.risk_cube(R.content_signal(R.ppi(shuffled)), context)
    assert rows(again.withColumns({c: F.round(c, 9) for c in ("base", "ca", "final_risk")})) == got


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 0.0), ("c", 2.0)], "k string, v double")
    out = A.weight_in_group(df, ["k"], "v", "w")
    assert rows(out.groupBy("k").agg(F.sum("w").alias("s")), "k", "s") == [("a", 1.0), ("b", 1.0), ("c", 1.0)]
    zero = A.relative_to_max(df, ["k"], "v", "r").filter("k = 'b'")
    assert {r.r for r in zero.collect()} == {0.0}


# ---- lookups -----------------------------------------------------------------
INDEX = [("China", "Senegal", "Economic", 0.3), ("China", "Senegal", "Sovereignty", 0.7), ("UnitedStates", "CoteIvoire", "Religious", 0.2)]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(INDEX, "actor string, country string, intent string, final_risk double")


def test_score_cascade_levels(spark, index):
    df = spark.createDataFrame([
        (1, " senegal ", "CHINA", "economic dependency"), (2, "Senegal", "China", "LGBTQ"), (3, "Mali", "China", "SocialFragility"),
        (4, "Mali", "x", "other"), (5, "Ivory Coast", "us", "religious"), (6, None, None, None)],
        "id int, target_country string, inferred_actor string, strategic_intent string")
    got = {r.id: (r.score, r.match_level) for r in J.score_cascade(df, index).collect()}
    assert got == {1: (0.3, "exact"), 2: (0.7, "pair"), 3: (0.9, "constant"), 4: (0.5, "constant"), 5: (0.2, "exact"), 6: (0.5, "constant")}
    empty = {r.id: r.match_level for r in J.score_cascade(df, index.limit(0)).collect()}
    assert set(empty.values()) == {"constant"}


def test_contextual_score(index):
    assert rows(reports.contextual_score(index, "Senegal", "china"), "score", "score_intent") == [(0.7, "Sovereignty")]
    assert rows(reports.contextual_score(index, "Senegal", "china", "economic"), "score", "score_intent") == [(0.3, "Economic")]
    assert rows(reports.contextual_score(index, "Mars", "china", "All"), "score", "score_intent") == [(0.0, "No Risk Data Found")]


def test_report_keeps_input_order_on_ties(index):
    got = reports.report_scores(index, "Senegal", ["Iran", "China", "Turkey"]).collect()
    assert [(r.actor, r.score, r.band, r.primary_threat) for r in got] == [
        ("China", 0.7, "Medium", "Sovereignty"), ("Iran", 0.0, "N/A", "No Data Found"), ("Turkey", 0.0, "N/A", "No Data Found")]


# ---- order and pages -----------------------------------------------------------
def test_null_times_come_first(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01'), (2, NULL), (3, timestamp'2024-02-01'), (4, NULL), "
                   "(5, timestamp'2024-02-01') AS t(id, posting_time)")
    assert [r.id for r in paging.latest(df, 4).collect()] == [2, 4, 3, 5]


@pytest.mark.parametrize("page,number", [("x", 1), (0, 4), (-1, 4), (99, 4), (2, 2), (None, 1), (4, 4), ("3", 3)])
def test_page_clamp(page, number):
    assert paging.clamp_page(page, 4) == number


def test_pages_cover_the_table_once(spark):
    df = spark.range(95).select("id", F.when(F.col("id") % 4 > 0, F.timestamp_seconds(F.col("id") % 7)).alias("posting_time"))
    expected = [r.id for r in df.orderBy(*paging.newest_order()).collect()]
    seen = []
    for n in range(1, 6):
        found = paging.paginate(df, n, 20)
        assert (found.number, found.num_pages, found.total) == (n, 5, 95)
        page = found.rows.collect()
        assert [r.position for r in page] == list(range(20 * n - 19, min(95, 20 * n) + 1))
        seen += [r.id for r in page]
    assert seen == expected
    walked, last = [], None
    while batch := paging.page_after(df, 20, last).collect():
        walked += [r.id for r in batch]
        last = {"posting_time": batch[-1].posting_time, "id": batch[-1].id}
    assert walked == expected


def test_empty_table_has_one_page(spark):
    found = paging.paginate(spark.sql("SELECT 1L AS id, timestamp'2024-01-01' AS posting_time").limit(0), 7, 10)
    assert (found.number, found.num_pages, found.total, found.rows.count()) == (1, 1, 0, 0)


def test_hot_url_keeps_one_row(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("url"))
    got = sets.first_per_key(df, "url", ["id"])
    assert got.count() == 1001 and got.filter("url = 'hot'").first().id == 0
    assert "Window" not in plan_of(got)


# ---- links -----------------------------------------------------------------------
def test_link_journalists(spark):
    df = spark.createDataFrame([(1, " ana ", None), (2, "Unknown", None), (3, None, None), (4, "ANA", 9), (5, "Bo", None)],
                               "id int, author string, journalist_fk long")
    people = spark.createDataFrame([(11, "Ana"), (10, "ANA"), (12, "Cy")], "id long, name string")
    assert rows(J.link_journalists(df, people), "id", "journalist_fk") == [(1, 10), (2, None), (3, None), (4, 9), (5, None)]


def test_link_outlets_creates_once(spark):
    df = spark.createDataFrame([(1, "Rfi", None), (2, " rfi ", None), (3, "New", None), (4, "NEW ", None), (5, "", None), (6, None, None)],
                               "id int, media_outlet string, media_outlet_fk long")
    outlets = spark.createDataFrame([(1, "RFI")], "id long, name string")
    linked, profiles = J.link_outlets(df, outlets)
    got = dict(rows(linked, "id", "media_outlet_fk"))
    assert got[1] == got[2] == 1 and got[3] == got[4] > 1 and got[5] is None and got[6] is None
    assert profiles.count() == 2
    again, same = J.link_outlets(df, profiles)
    assert rows(same) == rows(profiles) and rows(again, "id", "media_outlet_fk") == rows(linked, "id", "media_outlet_fk")


def test_not_stored(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "id int, url string")
    assert rows(J.not_stored(new, new.filter("url = 'a'"))) == [("b", 2)]


def test_word_mentions(spark):
    df = spark.createDataFrame([(1, "The port of Dakar, Senegal"), (2, "dakar-based; South Africa"), (3, "south of africa"), (4, None)],
                               "id int, article_text string")
    terms = spark.createDataFrame([("S", "Dakar"), ("A", "South Africa")], "group string, term string")
    assert rows(J.word_mentions(df, terms)) == [(1, "S", "Dakar"), (2, "A", "South Africa"), (2, "S", "Dakar")]


# ---- fusion ------------------------------------------------------------------------
def test_merge_confirmed(spark):
    data = [("A", .7, "a", .2), ("A", .5, "a", .4), ("A", .3, "a", .4), ("A", .4, "a", .4), ("A", .9, "B", .3), ("A", .3, "B", .3),
            ("A", .2, "B", .3), (None, .9, "B", .3), ("A", .9, "", .3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, m string, mc double, o string, oc double")
    got = [tuple(r.v) for r in df.select(E.merge_confirmed("m", "mc", "o", "oc").alias("v"), "i").orderBy("i").collect()]
    assert got == [("A", .7, "ensemble_matched_confirmed"), ("A", .5, "model_selected_after_low_match"),
                   ("a", .4, "llm_selected_after_low_match"), ("A", .4, "model_selected_after_low_match"), ("A", .9, "model"),
                   ("A", .3, "model"), ("B", .3, "llm"), ("unknown", 0.0, "unknown"), ("unknown", 0.0, "unknown")]


def test_merge_either(spark):
    data = [("A", .5, "A", .9), ("A", .5, "a", .9), ("A", .5, None, None), (None, None, "B", .2), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, m string, mc double, o string, oc double")
    got = [tuple(r.v) if r.v else None for r in df.select(E.merge_either("m", "mc", "o", "oc").alias("v"), "i").orderBy("i").collect()]
    assert got == [("A", .9, "both"), ("a", .9, "llm"), ("A", .5, "model"), ("B", .2, "llm"), None]


def test_hard_vote_tie_goes_to_smaller_class(spark):
    scores = spark.createDataFrame([(1, 0, 0, .4), (1, 0, 1, .6), (1, 1, 0, .9), (1, 1, 1, .1)],
                                   "article_id long, model int, class int, prob double")
    assert rows(E.hard_vote(scores), "article_id", "class") == [(1, 0)]
    assert rows(E.soft_vote(scores), "article_id", "class") == [(1, 0)]


def test_failing_batches_give_unknown(spark):
    def make():
        def score(texts):
            if "boom" in texts:
                raise RuntimeError("boom")
            return [("ok", 0.9)] * len(texts)
        return score

    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "id long, article_text string").coalesce(1)
    assert rows(E.score_texts(df, make, batch=1)) == [(1, "ok", 0.9), (2, "unknown", 0.0), (3, "ok", 0.9)]
    assert rows(E.score_texts(df, make, batch=20)) == rows(E.score_texts(df, make, batch=1))
    assert {r.label for r in E.score_texts(df, lambda: 1 / 0).collect()} == {"unknown"}


def test_calibrator_against_pooling(spark):
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 21, 200) / 20
    hits = (rng.random(200) < scores).astype(int)
    probs = spark.createDataFrame([(i, 0, float(s)) for i, s in enumerate(scores)], "article_id long, class int, prob double")
    labels = spark.createDataFrame([(i, 0 if h else 1) for i, h in enumerate(hits)], "article_id long, label int")
    table = E.fit_calibrator(probs, labels).collect()
    assert len(table) == 2 * len(set(scores)) + 1
    for row in table:
        s = row.score if row.exact else row.score + 0.01 if row.score >= 0 else -1.0
        for extra, got in ((0, row.p0), (1, row.p1)):
            pairs = sorted([(float(b), int(h)) for b, h in zip(scores, hits)] + [(s, extra)])
            places = sorted({b for b, _ in pairs})
            # equal scores form one point: average them first, weighted
            ys = [[h for x, h in pairs if x == b] for b in places]
            fit = weighted_pava([sum(y) / len(y) for y in ys], [len(y) for y in ys])[places.index(s)]
            assert got == pytest.approx(fit)
    assert all(r.p0 <= r.p1 for r in table)


def test_calibrated_probabilities_of_unrounded_scores(spark, tmp_path):
    """Scores of one class within a hundredth of each other keep their own places in the fit."""
    from catalog import load

    rng = np.random.default_rng(9)
    vectors = (rng.normal(size=(40, 64)) / 100).astype(np.float32)
    vectors[1], labels = vectors[0], [int(x) for x in rng.integers(0, 8, 40)]
    spark.createDataFrame([(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(vectors, labels))],
                          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    powers = np.exp(vectors.astype(float).reshape(40, 8, 8) * 4)
    scores = (powers / powers.sum(axis=2, keepdims=True)).mean(axis=1).round(12)
    assert all(len(set(scores[:, c])) == 39 and len(set(scores[:, c].round(2))) < 6 for c in range(8))
    raw = np.zeros((40, 8))
    for c in range(8):
        for i, s in enumerate(scores[:, c]):
            p0, p1 = (fit_with_extra(scores[:, c], [k == c for k in labels], s, extra) for extra in (0, 1))
            raw[i, c] = p1 / (p0 + p1 + 1e-15)
    want = raw / raw.sum(axis=1, keepdims=True)
    got = load()["calibrated_probabilities"][0](spark, str(tmp_path)).collect()
    assert len(got) == 320
    for row in got:
        assert row.prob == pytest.approx(want[row.article_id, row["class"]], abs=1e-6)


def fit_with_extra(scores, hits, at, extra):
    """The isotonic fit at the score `at` with one extra point there; equal scores form one point."""
    pairs = sorted([(float(b), int(h)) for b, h in zip(scores, hits)] + [(float(at), extra)])
    places = sorted({b for b, _ in pairs})
    ys = [[h for x, h in pairs if x == b] for b in places]
    return weighted_pava([sum(y) / len(y) for y in ys], [len(y) for y in ys])[places.index(at)]


def weighted_pava(y, w):
    blocks = []
    for v, n in zip(y, w):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    return [v for v, _, k in blocks for _ in range(k)]


def test_calibrated_rows_sum_to_one(spark):
    probs = spark.createDataFrame([(a, c, p) for a in range(30) for c, p in enumerate((a / 60, 1 - a / 60))],
                                  "article_id long, class int, prob double")
    labels = spark.createDataFrame([(a, int(a < 20)) for a in range(30)], "article_id long, label int")
    out = E.calibrate(probs, E.fit_calibrator(probs, labels))
    assert {round(r.s, 9) for r in out.groupBy("article_id").agg(F.sum("prob").alias("s")).collect()} == {1.0}
    assert rows(E.calibrate(probs, None)) == rows(probs)


# ---- maintenance -----------------------------------------------------------------
def test_repairs_run_in_order(spark):
    df = spark.createDataFrame([(1, "A football club opens a Medical centre", "Sovereignty"), (2, "ancient museum", None), (3, "x", "ECONOMIC"),
                                (4, None, "destabilization"), (5, "medical aid", None), (6, "x", "Other")],
                               "id int, article_text string, strategic_intent string")
    once = M.repair_labels(df)
    assert rows(once, "id", "strategic_intent") == [(1, "Economic"), (2, "General News"), (3, "Economic"), (4, "SocialFragility"),
                                                    (5, "Economic"), (6, "Other")]
    assert rows(M.repair_labels(once)) == rows(once)


def test_repairs_are_idempotent(spark):
    df = spark.createDataFrame([("('A', 0.5)",), ("B 3.4",), (None,), ("Other",)], "tone string")
    for fn in (untuple_tone, clean_tone):
        once = df.select(fn("tone").alias("tone"))
        assert rows(once.select(fn("tone"))) == rows(once)


def test_dry_run_equals_the_change(spark):
    before = spark.createDataFrame([(1, "Other", 0.1), (2, None, 0.2), (3, "x", None)], "id int, strategic_intent string, confidence double")
    after = M.reset_label(before)
    assert rows(M.change_set(before, after, ["strategic_intent", "confidence"])) == [(1, "strategic_intent", "Other", None)]
    assert M.change_set(before, before, ["strategic_intent"]).count() == 0


def test_upsert_last_wins(spark):
    dim = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "id long, name string, city string")
    up = spark.createDataFrame([("B", "q", 1), ("B", None, 2), ("C", "z", 3)], "name string, city string, line int")
    got = {r.name: (r.id, r.city) for r in M.upsert(dim, up, ["city"], "line").collect()}
    assert got["A"] == (1, "x") and got["B"] == (2, None) and got["C"][1] == "z" and got["C"][0] > 2


# ---- pages --------------------------------------------------------------------------
PAGES = [
    ('<meta name="author" content="Ana Diaz">', "Ana Diaz"),
    ('<meta property="article:author" content="Bo Lee">', "Bo Lee"),
    ('<meta name="author" content="Staff"><script type="application/ld+json">{"author": {"name": "Cy Roe"}}</script>', "Cy Roe"),
    ('<script type="application/ld+json">[{"author": [{"name": "Di Fox"}]}]</script>', "Di Fox"),
    ('<script type="application/ld+json">{broken</script><div class="meta byline">By <i>Ed Hill</i></div>', "Ed Hill"),
    ('<a rel="author">By Fay Low</a>', "Fay Low"),
    ("<style>By Not Me</style><p>By Jane Doe</p>", "Jane Doe"),
    ('<p class="byline">editor</p><p>nothing</p>', None),
    ('<address itemscope><span itemprop="name">Gus Orr</span></address>', "Gus Orr"),
    (None, None),
]


def test_authors(spark):
    df = spark.createDataFrame([(i, "http://a.b/c", h) for i, (h, _) in enumerate(PAGES)], "page_id int, url string, html string")
    assert [r.author for r in html.page_authors(df).orderBy("page_id").collect()] == [a for _, a in PAGES]


def test_pages_are_scanned_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(html, "PAGES_AT_ONCE", 3)
    df = spark.range(20).selectExpr("id AS page_id", "'u' AS url", "concat('<meta name=author content=A', id, '>') AS html").coalesce(1)
    got = html.scan_pages(df)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.metas[0].content for r in got.orderBy("page_id").collect()] == [f"A{i}" for i in range(20)]


def test_a_repeated_by_is_no_author(spark):
    texts = ["By By By By by", "lines By By Jane Doe, reporter", "By Jane Roe By Night", "By Byron Lee"]
    df = spark.createDataFrame([(i, "http://a.b/c", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id int, url string, html string")
    assert [r.author for r in html.page_authors(df).orderBy("page_id").collect()] == [None, "Jane Doe", "Jane Roe", "Byron Lee"]


IMAGES = [
    ('<meta property="og:image" content="/i/a.jpg">', "http://a.b/i/a.jpg"),
    ('<meta name="twitter:image" content="//c.d/b.png">', "https://c.d/b.png"),
    ('<img src="/top.png"><article><img src="/logo.png"><img src="one.gif"></article>', "http://a.b/x/one.gif"),
    ('<div class="post-content"></div><img src="/late.webp">', "http://a.b/late.webp"),
    ('<script type="application/ld+json">{"image": {"url": "/img/z"}}</script>', "http://a.b/img/z"),
    ('<img src="/page">', None),
]


def test_images_and_logos(spark):
    df = spark.createDataFrame([(i, "http://a.b/x/y", h) for i, (h, _) in enumerate(IMAGES)], "page_id int, url string, html string")
    assert [r.image for r in html.page_images(df).orderBy("page_id").collect()] == [u for _, u in IMAGES]
    home = spark.createDataFrame([(5, "http://o.p/", '<link rel="icon" href="/fav"><header><img src="/img/mark"></header>')],
                                 "page_id int, url string, html string")
    logos = html.page_logos(home)
    assert rows(logos, "page_id", "logo") == [(5, "http://o.p/img/mark")]
    assert [r.image for r in html.page_images(df, logos).orderBy("page_id").collect()][5] == "http://o.p/img/mark"


# ---- files -----------------------------------------------------------------------------
def test_articles_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('article_text,posting_time,media_outlet,URL,confidence,use_afrolm,llm_strat_id\n'
                 '"He said ""hi"",\nthen left",04/15/2025 10:00, Rfi ,http://u,x,TRUE,7\nb,someday,,,,,\nc,,,,,,\nd,31/12/2024 09:05,,,,,\n')
    good, bad = readers.read_articles_csv(spark, str(f))
    assert rows(good, "article_text", "media_outlet", "confidence", "use_afrolm", "llm_strat_id", "sector", "lang_detect") == [
        ('He said "hi",\nthen left', "Rfi", 4.0, True, 7, "Unknown", "en"), ("d", "Unknown", 4.0, False, -1, "Unknown", "en")]
    assert rows(bad, "reason") == [("Could not parse date: someday",), ("posting_time is empty",)]


def test_outlet_and_journalist_csv(spark, tmp_path):
    f = tmp_path / "o.csv"
    f.write_text("name,parent_organisation,,website\nLact,,, http://l \n")
    assert rows(readers.read_outlets_csv(spark, str(f)), "name", "parent_organisation", "website") == [("Lact", None, "http://l")]
    g = tmp_path / "j.csv"
    g.write_bytes("name,city\nÉmile,Fès\n,x\n".encode("latin-1"))
    assert rows(readers.read_journalists_csv(spark, str(g)), "name", "city") == [("Émile", "Fès")]
    u = tmp_path / "u.csv"
    u.write_bytes("﻿name,city\nÉmile,Fès\n".encode())
    assert readers.pick_encoding(spark, str(u)) == "utf-8"
    assert rows(readers.read_journalists_csv(spark, str(u)), "name", "city") == [("Émile", "Fès")]


def test_jobs_from_csv_to_scores(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("article_text,posting_time,inferred_actor,target_country,strategic_intent,URL,confidence\n"
                 + "".join(f"text {i},2025-01-0{i + 1} 00:00:00,China,Senegal,Economic,http://u/{i},0.5\n" for i in range(5)))
    p = {n: str(tmp_path / n) for n in ("art", "rej", "index", "scored", "fixed")}
    jobs.import_articles(spark, str(f), p["art"], p["rej"], anchor_size=2)
    stored = spark.read.parquet(p["art"])
    assert stored.filter("is_anchor").count() == 2 and stored.select("id").distinct().count() == 5
    jobs.repair(spark, p["art"], p["fixed"], dry_run="yes")
    assert spark.read.parquet(p["fixed"]).count() == 0
    with_labels = stored.withColumn("true_label", F.lit(None).cast("string"))
    with_labels.write.parquet(str(tmp_path / "art2"))
    jobs.index(spark, str(tmp_path / "art2"), p["index"], "2026-01-15")
    jobs.score(spark, str(tmp_path / "art2"), p["index"], p["scored"])
    assert {r.match_level for r in spark.read.parquet(p["scored"]).collect()} == {"exact"}
    assert sinks.read_current(spark, p["index"]).count() == 440


def test_ingest_saves_first_copy_that_passes(spark):
    long = "Senegal " + "x" * 1000
    stories = spark.createDataFrame([(1, "u1", "Mali", "A"), (2, "u1", "Senegal", "B"), (3, "u1", "Senegal", "C"), (4, "u2", "Senegal", "A"),
                                     (5, None, "Senegal", "A"), (6, "u3", "Senegal", "A"), (7, "u4", "Senegal", "A"), (8, "nytimes.com/x", "Senegal", "A")],
                                    "story_id int, url string, target_country string, inferred_actor string").withColumn("media_outlet", F.lit("m"))
    texts = spark.createDataFrame([("u1", long), ("u2", long), ("u3", "Senegal"), ("nytimes.com/x", long)], "url string, article_text string")
    store = spark.createDataFrame([("u2",)], "url string")
    done = ingest_stories(stories, texts, store, ["story_id"])
    assert rows(done.articles, "story_id", "inferred_actor") == [(2, "B"), (8, "USA")]
    assert rows(done.rejects, "story_id", "outcome") == [(1, "irrelevant"), (3, "duplicate in run"), (4, "already stored"), (5, "no url"),
                                                         (6, "too short"), (7, "no page")]


# ---- streams ------------------------------------------------------------------------------
def write_day(folder, name, items):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(i) for i in items))


def test_streams_equal_batch_and_restart(spark, tmp_path):
    schema = "id long, url string, posting_time timestamp"
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    day = datetime.datetime(2024, 1, 1)

    def item(i, url, hours):
        return {"id": i, "url": url, "posting_time": (day + datetime.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S")}

    store = S.store_writer(out, ["id"])
    write_day(source, "d1", [item(1, "a", 0), item(2, "a", 1), item(3, "b", 2)])
    S.run_batches(S.story_stream(spark, str(source), schema), store, ck)
    assert rows(S.read_store(spark, out), "id") == [(1,), (3,)]
    write_day(source, "d2", [item(4, "b", 30), item(5, "c", 31), item(6, None, 31)])
    for _ in range(2):  # the second run finds nothing new
        S.run_batches(S.story_stream(spark, str(source), schema), store, ck)
    assert rows(S.read_store(spark, out), "id", "url") == [(1, "a"), (3, "b"), (5, "c")]
    batch = sets.first_per_key(spark.read.schema(schema).json(str(source)), "url", ["id"])
    assert rows(batch, "id") == rows(S.read_store(spark, out), "id")


def test_repeated_batch_is_stored_once(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, url string")
    handle = S.store_writer(out, ["id"])
    handle(batch, 0)
    handle(batch, 1)
    handle(batch, 0)
    assert rows(S.read_store(spark, out), "id") == [(1,), (2,)]


def test_new_checkpoint_adds_to_the_store(spark, tmp_path):
    schema = "id long, url string, posting_time timestamp"
    source, out = tmp_path / "in", str(tmp_path / "out")
    store = S.store_writer(out, ["id"])
    write_day(source, "d1", [{"id": 1, "url": "a"}, {"id": 2, "url": "b"}])
    S.run_batches(S.story_stream(spark, str(source), schema), store, str(tmp_path / "ck1"))
    write_day(source, "d2", [{"id": 3, "url": "a"}, {"id": 4, "url": "c"}])
    S.run_batches(S.story_stream(spark, str(source), schema), store, str(tmp_path / "ck2"))
    assert rows(S.read_store(spark, out), "id", "url") == [(1, "a"), (2, "b"), (4, "c")]


def test_undated_stories_pass_the_window(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_day(source, "d1", [{"url": "a"}, {"url": "a"}, {"url": "b", "posting_time": "2024-01-01T00:00:00"}, {"url": "b", "posting_time": "2024-01-01T00:00:00"}])
    S.run_once(S.dedup_stream(S.story_stream(spark, str(source), "url string, posting_time timestamp")), out, str(tmp_path / "ck"))
    assert rows(spark.read.parquet(out), "url") == [("a",), ("a",), ("b",)]


def test_repeated_updates_keep_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, tone string")
    updates = spark.createDataFrame([(1, "x", 1), (1, "w", 2), (3, "z", 1)], "id long, tone string, at int")
    assert rows(M.keyed_update(df, updates, ["tone"])) == [(1, "x"), (2, "b")]
    assert rows(M.keyed_update(df, updates, ["tone"], order="at")) == [(1, "w"), (2, "b")]


def test_impossible_days_bound_nothing(spark):
    df = spark.sql("SELECT timestamp'2024-03-01' AS t")
    assert df.filter(P.between_days("t", "2024-13-45", "2023-02-30")).count() == 1
    assert df.filter(P.between_days("t", "2024-3-1", "2024-3-1")).count() == 1


def test_dot_segments(spark):
    from swaymeter.functions.text import absolute_url
    links = ["../x", "./x", "?q=1", "x/../y", "/a/../b?c=../d", "../../../z", "#f", "..", "p.html"]
    df = spark.createDataFrame([(u, "https://h.example/a/b/c?d=1") for u in links], "u string, b string")
    assert [r[0] for r in df.select(absolute_url("u", "b")).collect()] == [
        urllib.parse.urljoin("https://h.example/a/b/c?d=1", u) for u in links]


def test_missing_keys_are_spread(spark):
    """A third of the rows without a key: no shuffle partition gets more than twice its share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), "id")).alias("name"), F.lit("x").alias("media_outlet"),
                                      F.when(F.col("id") % 3 > 0, F.col("id")).alias("media_outlet_fk"))
        aliases = spark.range(500).select(F.concat(F.lit("n"), "id").alias("key"), F.lit("v").alias("value"))
        for joined in (J.resolve_with(df, "name", aliases.hint("merge"), "full"),):
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 2 * 3000 / len(sizes) and sum(sizes) == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_daily_volume_stream_drops_late_rows(spark, tmp_path):
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "posting_time timestamp"
    stamps = lambda *d: [{"posting_time": f"2024-01-{x:02d}T12:00:00"} for x in d]
    write_day(source, "f1", stamps(1, 1, 2, 8))
    S.run_once(S.daily_volume_stream(S.story_stream(spark, str(source), schema)), out, ck)
    write_day(source, "f2", stamps(1, 7, 20))  # day 1 is long closed
    S.run_once(S.daily_volume_stream(S.story_stream(spark, str(source), schema)), out, ck)
    got = {r.day.day: r["count"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 2, 2: 1, 7: 1, 8: 1}


# ---- plans ---------------------------------------------------------------------------------
def test_plans_stay_in_the_engine(spark):
    from catalog.views import view

    d = "/root/testdata/sf0.001"
    facts, arts = view(spark, d, "facts"), view(spark, d, "articles")
    index = view(spark, d, "idx")
    for df in (R.ppi(facts), J.score_cascade(facts, index), M.repair_labels(arts), reports.overview_base(arts), A.breadth(facts, "strategic_intent")):
        plan = plan_of(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
    ranged = facts.filter(F.col("id") > 5).select("id")
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,5)]" in plan_of(ranged)
    assert "ReadSchema: struct<event_id:bigint>" in plan_of(ranged)


def test_days_prune_months(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(90).select("id", F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).cast("timestamp").alias("posting_time"))
    sinks.append_articles(df.unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS timestamp) AS posting_time")), path)
    found = readers.read_articles(spark, path, "2024-02-10", "2024-02-20")
    assert sorted(r.id for r in found.select("id").collect()) == list(range(40, 51))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert readers.read_articles(spark, path).count() == 91


def test_fixed_tables():
    assert len(V.exposure_rows()) == 6 * 11 * 5
    assert V.intent_aliases("display")["human rights advocacy"] == "LGBTQ"
    assert V.intent_aliases("score")["human rights advocacy"] == "SocialFragility"
    assert "economic" not in V.intent_aliases("context")


def test_factors_read_the_profile_once(spark):
    spark.catalog.clearCache()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    profile = readers.country_profile(spark)
    counted = profile.mapInPandas(count, profile.schema)
    found = R.factors(readers.exposure(spark), counted, months={})
    assert found.count() == R.factors(readers.exposure(spark), profile, months={}).count() > 0
    assert seen.value == profile.count()
    spark.catalog.clearCache()


def test_order_lines_meet_orders_that_know_their_country(spark):
    from catalog.views import view

    lines = view(spark, "/root/testdata/sf0.001", "exposure")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {key: next(line.index("Join") for line in lines if "Join Inner" in line and key in line) for key in ("o_custkey", "l_orderkey")}
    assert at["o_custkey"] > at["l_orderkey"]
