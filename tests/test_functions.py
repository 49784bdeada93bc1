"""Literal rows for the column functions."""

import datetime

import random

import pytest
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions import base as B
from swaymeter.functions import labels as L
from swaymeter.functions import scores as S
from swaymeter.functions import text as X
from swaymeter.operators import filters as P


def values(spark, rows, fn, schema="x string"):
    """fn over single-column rows, in order."""
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, " + schema)
    return [r[0] for r in df.select(fn().alias("v"), "i").orderBy("i").select("v").collect()]


def test_missing_and_placeholders(spark):
    rows = [None, "", " ", "Unknown", "unknown", "N/A", "TBD", "null", "nan", "Economic"]
    assert values(spark, rows, lambda: B.missing("x")) == [True, True] + [False] * 8
    assert values(spark, rows, lambda: P.no_placeholder("x")) == [True, False, True, False, True, True, True, True, True, True]
    assert values(spark, rows, lambda: P.null_like("x")) == [True] * 9 + [False]
    assert values(spark, rows, lambda: P.has_label("x"))[:5] == [False, False, True, False, False]


def test_case_and_accents(spark):
    rows = ["Côte d'Ivoire", "CÔTE D'IVOIRE", "Cote d'Ivoire", " drc ", None]
    assert values(spark, rows, lambda: B.iexact("x", "côte d'ivoire")) == [True, True, False, False, None]
    assert values(spark, rows, lambda: L.alias("country", "request", "x")) == [
        "CoteIvoire", "CoteIvoire", "CoteIvoire", "DRC", None]


def test_wildcards_are_plain_characters(spark):
    rows = ["100% sure", "100 sure", "a_b", "aXb", "back\\slash", "it's"]
    assert values(spark, rows, lambda: B.icontains("x", "0% S")) == [True] + [False] * 5
    assert values(spark, rows, lambda: B.icontains("x", "A_B")) == [False, False, True, False, False, False]
    assert values(spark, rows, lambda: B.icontains("x", "\\")) == [False] * 4 + [True, False]
    assert values(spark, rows, lambda: B.contains_any("x", ["IT'S", "_"])) == [False, False, True, False, False, True]


def test_strip_and_clip(spark):
    rows = ["  a \t", " b\n", "", None]
    assert values(spark, rows, lambda: B.strip("x")) == ["a", "b", "", None]
    assert values(spark, [-0.1, 0.0, 1.0, 1.2, None], lambda: B.clip01("x"), "x double") == [0.0, 0.0, 1.0, 1.0, None]


def test_long_word_lists(spark):
    terms = [f"term{i}" for i in range(50)] + ["été", "a.b", "(x)|y", "term"]
    rows = ["about TERM49", "nothing", None, "un ÉTÉ", "axb", "A.B", "(X)|Y", "(X)", "TER"]
    assert values(spark, rows, lambda: B.contains_any("x", terms)) == [True, False, None, True, False, True, True, False, False]
    short = ["alpha", "alpine", "beta"]
    assert values(spark, ["ALPINE", "alp", "xbetax"], lambda: B.contains_any("x", short)) == [True, False, True]


def test_null_text_is_not_a_mention(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, article_text string")
    terms = {"A": [f"w{i}" for i in range(60)]}
    kept = df.filter(P.mentions_no_target(terms=terms)).collect()
    assert [r.id for r in kept] == [2]


def test_shortest_terms():
    assert B.shortest_terms(["sport", "Sports", "match", "sport"]) == ["SPORT", "MATCH"]


def test_contextual_intent(spark):
    rows = ["Debt Trap Diplomacy", "economic", "eco", " ", "space race", "trade war", "vote power", "", None,
            "human rights advocacy", "free dependency", "odd"]
    assert values(spark, rows, lambda: L.contextual_intent("x")) == [
        "Economic", "Economic", "Economic", "Economic", "Other", "ResourceDependency", "ElectionInfluence", None, None,
        "SocialFragility", "MilitaryPresence", "Other"]


def test_canonical_intent_recovers_from_title(spark):
    rows = [("Other", "She said so"), ("Human Rights Advocacy", "trade"), ("Other", "Troops move"), ("Other", ""), ("", "trade"), ("x", None)]
    got = values(spark, rows, lambda: L.canonical_intent("x", "t"), "x string, t string")
    assert got == ["Economic", "LGBTQ", "MilitaryPresence", None, None, None]


def test_clean_intent_and_strategic(spark):
    rows = ["Sovereignty  Erosion", "Information war", "influence", None]
    assert values(spark, rows, lambda: L.clean_intent("x")) == ["sovereignty", "information", "", None]
    assert values(spark, ["Neutral", "none", "", None, "Economic"], lambda: L.is_strategic("x")) == [False, False, False, False, True]


def test_actor_rules(spark):
    assert values(spark, ["RT", "Support News", "France 24", "China Daily", "Gulf News", "", None, "Le Soleil"],
                  lambda: L.actor_from_outlet("x")) == ["Russia", "Russia", "France", "China", "UAE", "Unknown", "Unknown", "Unknown"]
    df = spark.createDataFrame([(["UN", "Turkish Airlines", "China Rail"], ["Macron"], "x"), ([], ["Joe Biden"], "x"),
                                ([], [], "In Dubai and Washington"), ([], [], "quiet")],
                               "o array<string>, p array<string>, t string")
    assert [r[0] for r in df.select(L.actor_from_content("t", "o", "p")).collect()] == ["Turkey", "USA", "Usa", "Unknown"]
    rows = [("China", "RT", "x"), ("Unknown", "Xinhua", "x"), ("", "Le Soleil", "in moscow"), (None, None, "x")]
    assert values(spark, rows, lambda: L.resolve_actor("x", "o", "t"), "x string, o string, t string") == [
        "China", "China", "Russia", "Unknown"]


def test_tones(spark):
    rows = ["('Factual', 0.91)", '("A", 1)', "(broken", "Factual", None, "('A')"]
    assert values(spark, rows, lambda: L.untuple_tone("x")) == ["Factual", "A", "(broken", "Factual", None, "('A')"]
    assert values(spark, ["Factual 3.45", "0.9", "", None, "Alarmist"], lambda: L.clean_tone("x")) == [
        "Factual", "Unknown", "Unknown", "Unknown", "Alarmist"]


def test_display_title(spark):
    long = "w " * 200
    rows = ["By Ann\nhttps://x.y\nA real title\nmore", "12 May 2024: dated\nshort\nFine line", "abc\n" + long, "\n \n", "", None,
            "Only the first\nBuying time", " ".join(f"w{i}" for i in range(25))]
    got = values(spark, rows, lambda: X.display_title("x"))
    assert got[0] == "A real title" and got[1] == "short" and got[2].endswith("...") and got[2].startswith("abc w w")
    assert got[3:6] == ["Empty Article", "No Content Available", "No Content Available"]
    assert got[6] == "Buying time"  # "Only" starts with "On"
    assert got[7] == " ".join(f"w{i}" for i in range(25))


def test_title_of_by_and_on_lines(spark):
    assert values(spark, ["Buying time\nx"], lambda: X.display_title("x")) == ["Buying time"]
    assert values(spark, ["Bypass closed\nnext line"], lambda: X.display_title("x")) == ["next line"]


def test_summaries(spark):
    rows = ["short\ntext ", "a" * 600, "word " * 150, None]
    got = values(spark, rows, lambda: X.display_summary("x"))
    assert got[0] == "short text" and got[1] == "a" * 500 + "…" and got[3] is None
    assert got[2] == ("word " * 100)[:-1] + "…"
    assert values(spark, ["a b c", "a  b", ""], lambda: X.truncate_words("x", 2)) == ["a b …", "a b", ""]
    assert values(spark, ["x" * 199, "x" * 200, None], lambda: X.summary_guard("x").isNotNull()) == [True, False, True]


def test_french(spark):
    rows = ["Le chat est dans la maison avec les autres", "the cat is in the house", None]
    assert values(spark, rows, lambda: X.detect_french("x")) == ["fr", "en", "en"]


def test_dates(spark):
    rows = ["on 15/04/2025 it", "4/15/2025", "April 15, 2025", "15 April 2025", "32/13/2025 and April 15, 2025", "none", "15-4-2025", None]
    day = datetime.date(2025, 4, 15)
    assert values(spark, rows, lambda: X.date_in_text("x")) == [day, day, day, day, None, None, day, None]
    stamps = values(spark, ["04/15/2025 10:30", "2025-04-15 10:30:00", "15/04/2025 10:30", "x", ""], lambda: X.parse_timestamp("x"))
    assert stamps == [datetime.datetime(2025, 4, 15, 10, 30)] * 3 + [None, None]


def test_casts(spark):
    assert values(spark, [" 1.5 ", "x", "", None], lambda: X.safe_double("x", 4.0)) == [1.5, 4.0, 4.0, 4.0]
    assert values(spark, ["7", "7.5", "x"], lambda: X.safe_int("x", -1)) == [7, -1, -1]
    assert values(spark, ["TRUE", " true", "1", None], lambda: X.safe_bool("x")) == [True, True, False, False]


def test_replies(spark):
    good = '{"strategic_intent": "Economic", "strategic_intent_conf": 0.8, "notes": "n"}'
    rows = [good, f"```json\n{good}\n```", '{"a": 1} ' + good, '{"strategic_intent": "Religious", "notes": "has {brace} in"}',
            '{"strategic_intent": "LGBTQ" "strategic_intent_conf": 0.4}', "no braces", '"strategic_intent": "Economic", "strategic_intent_conf": 0.3',
            '{"strategic_intent_conf": "high"}']
    got = values(spark, rows, lambda: X.parse_reply("x"))
    assert [(r.intent, r.conf, r.notes) for r in got] == [
        ("Economic", 0.8, "n")] * 3 + [
        ("Religious", 0.0, "Extracted via Regex from block"), ("LGBTQ", 0.4, "Extracted via Regex from block"),
        ("Neutral", 0.0, "Extracted via Regex"), ("Economic", 0.3, "Extracted via Regex"), ("Neutral", 0.0, "")]


def test_urls(spark):
    rows = [("//c.d/x.png", "http://a.b/p/q"), ("/x.png", "http://a.b/p/q"), ("x.png", "http://a.b/p/q?z"), ("x", "http://a.b"),
            ("http://e/f", "http://a.b"), ("", "http://a.b"), (None, "http://a.b")]
    assert values(spark, rows, lambda: X.absolute_url("x", "b"), "x string, b string") == [
        "https://c.d/x.png", "http://a.b/x.png", "http://a.b/p/x.png", "http://a.b/x", "http://e/f", None, None]
    urls = ["http://a/b.JPG?x=1", "http://a/photos/1", "http://a/page", "", None, "http://img.example/x"]
    assert values(spark, urls, lambda: X.is_image_url("x")) == [True, True, False, False, False, False]
    assert values(spark, ["/upload/a.png", "/cover.png", None], lambda: X.is_meaningful_image("x")) == [False, True, False]


def test_scores(spark):
    assert values(spark, [0.71, 0.7, 0.41, 0.4, None], lambda: S.risk_band("x"), "x double") == ["High", "Medium", "Medium", "Low", "N/A"]
    assert values(spark, [0.30, 0.304, 0.31, 0.6, 0.61], lambda: S.guide_band("x"), "x double") == ["Low", "Low", "Moderate", "Moderate", "High"]
    dates = [datetime.date(2026, 6, 30), datetime.date(2025, 10, 31), None, datetime.date(2026, 2, 10)]
    assert values(spark, dates, lambda: S.months_to_election("x", F.lit("2026-01-15")), "x date") == [5, 0, 999, 0]
    assert values(spark, [0, 12, 24, 48, 999], lambda: S.election_proximity("x"), "x int") == [1.0, 0.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("debt,mil,res,disinfo,want", [(1, 0, 0, 0, 1.0), (0, 0.33, 0, 0, 1.0), (0, 0, 0.1, 0, 1.0), (0, 0.1, 0, 0, 0.5),
                                                       (0, 0, 0.05, 0, 0.5), (0, 0, 0, 0.16, 0.5), (0, 0, 0, 0.15, 0.2)])
def test_presence(spark, debt, mil, res, disinfo, want):
    row = spark.range(1).select(S.presence(*[F.lit(float(v)) for v in (debt, mil, res, disinfo)])).first()
    assert row[0] == want


def test_keyword_query(spark):
    rows = ["Dakar invests in trade", "Dakar investment", "Dakarois investment", "Dakar investment and football", None]
    wanted = [["Dakar", "Senegal"], ["invest*"]]
    assert values(spark, rows, lambda: P.keyword_query("x", wanted, ["football"])) == [True, True, False, False, False]


def test_bad_day_bounds_are_ignored(spark):
    df = spark.sql("SELECT timestamp'2024-01-05 23:59:59' AS t UNION ALL SELECT timestamp'2024-01-06 00:00:00'")
    assert df.filter(P.between_days("t", "x", "2024-01-05")).count() == 1
    assert df.filter(P.between_days("t", "2024-01-06", None)).count() == 1
    assert df.filter(P.between_days("t", None, "")).count() == 2


def test_openings_give_what_whole_texts_give(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "By", "word", "x y", " ", "  ", "\n", "\r\n", " \n ", "\u2028", "\u00a0", "\u001f"]) for _ in range(rng.randint(0, 30)))
             for _ in range(400)] + [None, "", "one line without a break " * 3]
    titles = (lambda: X.display_title("x"), lambda: X.simple_title("x"), lambda: X.truncate_words("x", 3), lambda: X.first_lines("x", 2))
    monkeypatch.setattr(X, "OPENING", 10_000)
    whole = [values(spark, texts, c) for c in titles]
    for size in (1, 7, 20):
        monkeypatch.setattr(X, "OPENING", size)
        assert [values(spark, texts, c) for c in titles] == whole
    assert whole[2][-1] == "one line without …"


def test_long_word_lists_are_searched_like_short_ones(spark):
    """Beyond FEW_TERMS terms a text is not scanned by one search in the plan per term."""
    terms = [f"term{i}x" for i in range(30)] + ["É.t_", "it's", "%"]
    rows = [None, "", "a TERM29X b", "term29", "xé.T_y", "IT'S", "100%", "straße"]
    assert values(spark, rows, lambda: B.contains_any("x", terms)) == [None, False, True, False, True, True, True, False]
    df = spark.createDataFrame([(r,) for r in rows], "x string").where(B.contains_any("x", terms))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 0


def test_french_words_of_a_whole_text(spark):
    """The whole text takes one pass however many words are sought; odd letters, ends and repeats count as in plain searches."""
    rng = random.Random(4)
    parts = ["le", "LA", "Les", "que", "dans", "qu\u0130", "le\0", "l\u212ae", "dans,", "d\u00e9s", "", "et\n", "et", "avecs", "xavec", "avec", "\U0001f600", "PAR"]
    made = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    made += [(900, None), (901, ""), (902, "le"), (903, "le la les des"), (904, "x " * 3_000_000 + "le la les des"), (905, " le  la les")]
    df = spark.createDataFrame(made, "id long, t string").repartition(3)
    found = df.select("id", X.detect_french("t", None).alias("lang"), X.count_alone(F.col("t"), ["le", "ok", "dans"]).alias("n"))
    plain = {i: f" {(t or '').lower()} " for i, t in made}
    want = {i: ("fr" if sum(f" {w} " in t for w in V.FRENCH_WORDS) > 3 else "en", sum(f" {w} " in t for w in ("le", "ok", "dans"))) for i, t in plain.items()}
    assert {r["id"]: (r["lang"], r["n"]) for r in found.collect()} == want
    shown = df.select(X.detect_french("t", None))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in shown and "contains(" not in shown.lower()
