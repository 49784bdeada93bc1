"""Term search, percolation, stores by parts, roll-ups, updates by month, page directories, calibration, damaged records."""

import glob
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from swaymeter.operators import filters, fusion, lookup, maintain, paging, term_search, text_search
from swaymeter.plans import reports, rollup
from swaymeter.sources import readers, sinks
from swaymeter.streaming import streams

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


WORDS = ["Dakar", "dakarois", "DRC", "xdrcx", "Congo", "la", "La Paz", "addis", "Ababa", "c.f.a", "ivory", "coast", "été", "ኢትዮጵያ", "trade_war", "…", "a"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    made = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "-"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    made += [(900, None), (901, ""), (902, "DAKAR " * 30_000 + "Addis Ababa")]
    return spark.createDataFrame(made, "id long, article_text string"), made


@pytest.mark.parametrize("few", [True, False])
def test_mentions(spark, texts, few):
    df, made = texts
    terms = [("S", "Dakar"), ("C", "drc"), ("C", "DRC"), ("X", "la paz"), ("X", "La"), ("E", "Addis Ababa"), ("E", "ኢትዮጵያ"), ("F", "c.f.a"), ("P", "…"),
             ("I", "ivory coast"), ("A", "A"), ("Z", "zzz"), ("N", None), ("N", "")]
    want = sorted({(i, g, t) for i, text in made for g, t in terms if t and text and t.upper() in text.upper()}, key=repr)
    table = spark.createDataFrame(terms, "group string, term string")
    assert rows(term_search.mentions(df, table, few=few)) == want
    long_terms = [t for t in terms if t[1] and len(t[1]) > 2 and t[1] != "…"]
    assert rows(term_search.term_mentions(df, long_terms)) == [w for w in want if (w[1], w[2]) in long_terms]
    assert rows(term_search.mentions(df.limit(0), table, few=few)) == []


def test_a_text_is_split_once(spark, texts):
    """The candidates come from one scan with one split, kept for both of their uses."""
    spark.catalog.clearCache()
    found = term_search.term_mentions(texts[0], [("S", "Dakar"), ("E", "Addis Ababa")])
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("split(upper(article_text" in line for line in lines) == 2 == sum("InMemoryRelation" in line for line in lines)
    one = term_search._words(texts[0], F.upper("article_text"), term_search.NO_WORD)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    spark.catalog.clearCache()


@pytest.mark.parametrize("few", [True, False])
def test_percolate(spark, texts, few):
    """Every query answers as `keyword_query` does."""
    df, made = texts
    queries = {
        "phrase": ([["addis ababa", "la paz"], ["dakar*"]], []), "barred": ([["Congo"]], ["DRC", "trade*"]), "open": ([["dak*", "iv*"]], []),
        "dots": ([["c.f.a"]], []), "score": ([["trade_war"]], []), "none": ([["nowhere"]], []), "only barred": ([], ["DRC"]), "accent": ([["ÉTÉ"], ["a"]], ["…"])}
    want = set()
    for name, (groups, none_of) in queries.items():
        if groups:
            hit = filters.keyword_query("article_text", groups, [t for t in none_of if re.search(r"\w", t)])
            want |= {(r["id"], name) for r in df.where(hit).collect()}
    table = term_search.query_table(spark, queries)
    assert rows(term_search.percolate(df, table, few=few)) == sorted(want, key=repr)
    assert rows(term_search.percolate(df.limit(0), table, few=few)) == []


@pytest.mark.parametrize("search", ["mentions", "word_mentions", "percolate"])
def test_texts_are_read_once(spark, search):
    """Phrases are held against a text in the row that has it: texts are neither read again nor joined."""
    spark.catalog.clearCache()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    made = [(i, "Talks in Addis Ababa, Straße \u0130stanbul" if i % 2 else "addis\u00a0ababa: ADDIS-Ababa" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(made, "id long, article_text string").mapInPandas(count, "id long, article_text string")
    terms = spark.createDataFrame([("E", "Addis Ababa"), ("E", "addis"), ("S", "stra\u00dfe"), ("T", "i\u0307stan"), ("T", "i\u0307stanbul")], "group string, term string")
    if search == "percolate":
        found = term_search.percolate(df, term_search.query_table(spark, {"a": ([["addis ababa"]], ["stra\u00dfen"]), "b": ([["addis"], ["ababa"]], ["talk*"])}))
        want = sorted([(i, "a") for i, t in made if t and "Talks" in t] + [(i, "b") for i, t in made if t and "Talks" not in t], key=repr)
        assert rows(found) == want
    else:
        found = rows(getattr(term_search, search)(df, terms))
        assert [f for f in found if f[2] == "Addis Ababa"] == [(i, "E", "Addis Ababa") for i, t in sorted(made, key=lambda m: repr(m)) if t and "Talks" in t]
        assert {f[0] for f in found if f[2] == "addis"} == {i for i, t in made if t}
        assert {f[0] for f in found if f[2] == "stra\u00dfe"} == {i for i, t in made if t and "Talks" in t}
    assert seen.value == 60
    spark.catalog.clearCache()


def test_lookups_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    table = spark.range(50).mapInPandas(count, "id long")
    spark.range(50).join(lookup.small(table), "id").count()
    assert seen.value == 50
    assert "Broadcast" not in plan(spark.range(9).join(lookup.small(spark.range(9), 5).hint("merge"), "id"))
    spark.catalog.clearCache()


STORY = "id long, url string, n int"


def test_batches_read_only_their_parts(spark, tmp_path):
    path = str(tmp_path / "store")
    handle = streams.store_writer(path, ["id"])
    handle(spark.createDataFrame([(i, f"u{i}", i) for i in range(200)], STORY), 0)
    earlier = streams.stored_before(spark, path, "direct", 1, [3, 5])
    assert re.search(r"PartitionFilters: \[[^]]*url_part[^]]* IN \(3,5\)", plan(earlier)) and "url_part" not in earlier.columns
    assert 0 < earlier.count() < 50
    handle(spark.createDataFrame([(300, "u7", 1), (301, "new", 1), (302, "new", 1), (303, None, 1), (304, "", 1)], STORY), 1)
    handle(spark.createDataFrame([(300, "u7", 1), (301, "new", 1), (302, "new", 1), (303, None, 1), (304, "", 1)], STORY), 1)
    assert rows(streams.read_store(spark, path), "id") == sorted([(i,) for i in range(200)] + [(301,)], key=repr)


def articles(spark):
    rng = random.Random(9)
    day = lambda: rng.choice([None, "2025-03-01 10:00:00", "2025-03-02 00:00:00", "2025-03-02 23:00:00", "2024-12-31 12:00:00"])
    made = [(i, f"http://n/{i}", rng.choice(["A", "B", "", "Unknown", None]), rng.choice(["Economic", "Religious", "", None]), day(),
             rng.choice(["Football cup", "Trade deal", None]), rng.choice(["Senegal", "DRC", "France", None]), rng.choice([0.5, 0.125, None]),
             rng.choice(["Rfi", "BBC", None])) for i in range(400)]
    return spark.createDataFrame(made, "id long, url string, inferred_actor string, strategic_intent string, t string, article_text string, "
                                 "target_country string, confidence double, media_outlet string").withColumn("posting_time", F.to_timestamp("t")).drop("t")


def test_rollup_equals_the_direct_count(spark, tmp_path):
    """Kept by the store writer over late and repeated batches, merged in between."""
    df = articles(spark)
    index = spark.createDataFrame([("A", "Senegal", "Economic", 0.25)], "actor string, country string, intent string, final_risk double")
    store, kept, merged = (str(tmp_path / name) for name in ("store", "kept", "merged"))
    handle = streams.store_writer(store, ["id"], rollup_path=kept)
    for batch, rest in ((0, 0), (1, 1), (1, 1)):
        handle(df.where(F.col("id") % 3 == rest), batch)
    assert rollup.read(spark, kept).agg(F.sum("n")).first()[0] == df.where("id % 3 < 2").count()
    rollup.merge(spark, kept, merged)
    handle(df.where("id % 3 > 0"), 2)  # a third of them late, a third known already
    table = rollup.read(spark, kept, merged)
    for who in ({}, {"country": "senegal"}, {"country": "DRC", "actor": "a"}):
        direct, counted = reports.overview(df, index, **who), rollup.overview(table, index, **who)
        for panel in ("cards", "volume", "countries"):
            assert [tuple(r) for r in counted[panel].collect()] == [tuple(r) for r in direct[panel].collect()], (panel, who)
        assert rows(counted["subjects"]) == rows(direct["subjects"])
    assert [r["count"] for r in rollup.latest_volume(table, 30).collect()] == [30]
    files = table.inputFiles()
    assert files and not any(f.startswith("file:" + store) for f in files)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/month=*/*.parquet")}


def test_only_months_with_changes_are_written(spark, tmp_path):
    path = str(tmp_path / "articles")
    df = articles(spark).drop("t")
    sinks.append_articles(df, path)
    before = files(path)
    updates = spark.createDataFrame([(r["id"], "New", 0.75) for r in df.where("month(posting_time) = 12 and id % 2 = 0").collect()] + [(9999, "x", 0.1), (None, "y", 0.2)],
                                    "id long, strategic_intent string, confidence double")
    assert sinks.update_months(spark, path, updates, ["strategic_intent", "confidence"]) == ["2024-12"]
    now = files(path)
    assert all(now[f] == at for f, at in before.items() if "2024-12" not in f)
    want = maintain.keyed_update(df, updates, ["strategic_intent", "confidence"])
    assert rows(spark.read.parquet(path), *df.columns) == rows(want, *df.columns)
    # all undated rows move to a month that has rows already
    dated = F.coalesce("posting_time", F.to_timestamp(F.lit("2025-03-05 00:00:00")))
    done = sinks.change_months(spark, path, F.col("posting_time").isNull(), lambda x: x.withColumn("posting_time", dated))
    assert done == ["2025-03", "undated"]
    assert rows(spark.read.parquet(path), *df.columns) == rows(want.withColumn("posting_time", dated), *df.columns)
    assert sinks.update_months(spark, path, updates.limit(0), ["confidence"]) == []


def test_pages_by_part(spark, tmp_path):
    path = str(tmp_path / "articles")
    df = articles(spark)
    sinks.append_articles(df, path)
    stored = spark.read.parquet(path)
    months = lambda days: F.col("month").isin([d.strftime("%Y-%m") if d else "undated" for d in days])
    for page in (1, 2, 5, 9, 14, "x", 99):
        direct = paging.paginate(df, page, 30)
        by_part = paging.paginate_by_part(stored, page, 30, F.to_date("posting_time"), within=months)
        assert [(r["id"], r["position"]) for r in by_part.rows.collect()] == [(r["id"], r["position"]) for r in direct.rows.collect()]
        assert (by_part.number, by_part.num_pages, by_part.total) == (direct.number, direct.num_pages, direct.total)
    page = paging.paginate_by_part(stored, 5, 30, F.to_date("posting_time"), within=months)
    assert re.search(r"PartitionFilters: \[[^]]*month", plan(page.keys))
    assert paging.paginate_by_part(df.limit(0), 3, 30, F.to_date("posting_time")).rows.count() == 0
    names = spark.createDataFrame([(f"{c}{i}",) for c in "BAéz" for i in range(7)] + [(None,)], "author string")
    for page in (1, 2, 3, 4):
        direct, by_letter = (f.rows.select("author", "position").collect() for f in (
            paging.paginate(names.where("author is not null"), page, 9, [("author", True, False)], "author"),
            paging.paginate_by_part(names.where("author is not null"), page, 9, F.substring("author", 1, 1), [("author", True, False)], "author")))
        assert direct == by_letter


@pytest.mark.parametrize("query", ["dakar", "DAKAR, la", "la", "a", "…", "addis ababa", "ኢትዮ", "rc", "zz top", "", "c.f.a"])
def test_signature_search(spark, texts, query):
    df = texts[0].withColumn("author", F.when(F.col("id") % 5 == 0, "Aïda Dakar"))
    signed = text_search.signatures(df)
    want = rows(df.where(filters.search(query, "article_text", "author")), "id")
    assert rows(text_search.search_texts(df, signed, query), "id") == want
    assert rows(text_search.search_texts(df, signed, query, author=None), "id") == rows(df.where(filters.search(query, "article_text")), "id")


def test_signatures_take_one_pass_over_a_text(spark, texts):
    """The bits are those of the hashed fragments; no row per word or fragment is made and no lambda is interpreted for them."""
    odd = [(i, c) for i, c in enumerate(["Straße ÉTÉ x2y", "a_b cde\nfgh", "abc", "ab", "中文字 😀😀😀 𝒜𝒜𝒜", "".join(map(chr, range(0x1200, 0x1340))), "ﬃ ŉab"], 5_000)]
    df = texts[0].unionByName(spark.createDataFrame(odd, "id long, article_text string"))
    words = F.filter(F.split(F.upper("article_text"), term_search.NO_WORD), lambda w: F.length(w) >= 3)
    place = lambda w, i: F.pmod(F.xxhash64(F.substring(w, i, 3)), F.lit(text_search.BITS)).cast("int")
    plain = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: place(w, i)))
    signed = text_search.signatures(df)
    assert rows(signed) == rows(df.select("id", F.array_sort(F.array_distinct(F.flatten(plain)))))
    made = plan(text_search.signatures(texts[0]))
    assert "lambda" not in made and made.count("ArrowEvalPython") == 1


def plain_venn_abers(points, s):
    """p0 and p1 at s: the isotonic fit of all points and one more at s, labelled 0 or 1 (min-max formula)."""
    out = []
    for extra in (0, 1):
        some = sorted([*points, (s, extra)])
        xs = sorted({x for x, _ in some})
        mean = lambda a, b: sum(y for x, y in some if a <= x <= b) / sum(a <= x <= b for x, _ in some)
        out.append(max(min(mean(a, b) for b in xs if b >= s) for a in xs if a <= s))
    return out


def test_calibration_against_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CELL", 3)
    rng = random.Random(12)
    labelled = [(i, rng.random(), rng.randint(0, 1)) for i in range(25)] + [(30, 0.5, 1), (31, 0.5, 0), (32, 0.5, 1)]
    probs = [(i, 0, p) for i, p, _ in labelled] + [(i, 1, 1 - p) for i, p, _ in labelled]
    new = [(100 + i, c, p) for i in range(20) for c, p in ((0, rng.random()), (1, rng.random()))] + [(200, 0, 0.5), (200, 1, 0.0), (201, 0, 1.0), (201, 1, None), (202, 7, 0.4)]
    frame = lambda r: spark.createDataFrame(r, "article_id long, class int, prob double")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "article_id long, label int")
    calibrator = fusion.fit_calibrator(frame(probs), labels)
    points = {0: [(p, int(y == 0)) for _, p, y in labelled], 1: [(1 - p, int(y == 1)) for _, p, y in labelled]}
    raw = {}
    for i, c, p in new + probs:
        p0, p1 = plain_venn_abers(points[c], p) if c in points and p is not None else (0, 0)
        raw[i, c] = 0.0 if p is None else p1 / (p0 + p1 + 1e-15) if c in points else p
    got = {(r["article_id"], r["class"]): r["prob"] for r in fusion.calibrate(frame(new + probs), calibrator).collect()}
    assert got.keys() == raw.keys()
    for (i, c), value in got.items():
        total = sum(v for (j, _), v in raw.items() if j == i)
        assert value == pytest.approx(raw[i, c] / total if total else 0.0, abs=1e-9)


def test_calibrator_counts_every_labelled_article(spark):
    """All 20,500 articles take part, and scores of one class that lie in several pieces."""
    labels = spark.range(20500).select(F.col("id").alias("article_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    probs = labels.select("article_id", F.lit(1).alias("class"), F.lit(0.5).alias("prob"))
    got = fusion.fit_calibrator(probs, labels).where("exact").collect()
    assert [(r["p0"], r["p1"]) for r in got] == [(4100 / 20501, 4101 / 20501)]


def test_calibrator_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(fusion, "PIECE", 4)
    points = [(i, rng.random(), rng.randint(0, 1)) for i in range(40)]
    probs = spark.createDataFrame([(i, c, p if c else 1 - p) for i, p, _ in points for c in (0, 1)], "article_id long, class int, prob double")
    labels = spark.createDataFrame([(i, y) for i, _, y in points], "article_id long, label int")
    table = fusion.fit_calibrator(probs, labels).collect()
    assert len(table) == 2 * (2 * 40 + 1)
    for r in table:
        of_class = [(p if r["class"] else 1 - p, int(y == r["class"])) for _, p, y in points]
        s = r["score"] if r["exact"] else -1.0 if r["score"] < 0 else r["score"] + 1e-9
        assert (r["p0"], r["p1"]) == pytest.approx(plain_venn_abers(of_class, s))


def test_label_ranks_without_one_task(spark):
    df = spark.createDataFrame([(w,) for w in ["b", "a", None, "é", "Z", "b", "", *(f"x{i}" for i in range(500))]], "label string")
    got = fusion.encode_labels(df, "label")
    want = sorted({w for (w,) in df.where("label is not null").collect()}, key=lambda w: w.encode())
    assert [(r["class"], r["label"]) for r in got.orderBy("class").collect()] == list(enumerate(want))
    assert "SinglePartition" not in plan(got)
    assert fusion.encode_labels(df.limit(0), "label").count() == 0
    spark.catalog.clearCache()


def test_import_of_many_files(spark, monkeypatch):
    """A file with quoted line breaks is read by one task, so an import comes in files of a bounded number of rows."""
    from catalog import load, sources

    monkeypatch.setattr(sources, "ROWS_PER_FILE", 150)
    path = sources.csv_of(spark.range(1000).selectExpr("id", "'a\nb' AS text").coalesce(1), "many")
    assert len(glob.glob(path.removeprefix("file:") + "/*.csv.gz")) == 7
    assert readers.read_checked_csv(spark, path).where("_damaged is null and text = 'a\nb'").count() == 1000
    placed = load()["import_twice"][0](spark, "/root/testdata/sf0.001").where("file = 'first'")
    assert [r["line"] for r in placed.orderBy("line").collect()] == list(range(placed.count()))


def test_damaged_records_are_kept(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('article_text,posting_time,URL,confidence\n"one, two",2025-01-02 03:04:05,u1,0.5\nshort,2025-01-02 03:04:05\n'
                 'long,2025-01-02 03:04:05,u3,0.5,extra\nok,2025-01-02 03:04:05,u4,n/a\nnone,soon,u5,0.1\nopen,"2025-01-02,u6,0.5\nlast,x,y,z\n')
    good, bad = readers.read_articles_csv(spark, str(f))
    assert rows(good, "url") == [("u1",), ("u4",)]
    found = rows(bad, "URL", "reason")
    assert ("u5", "Could not parse date: soon") in found and found.count((None, "damaged record")) == 3
    kept = " ".join(r["record"] for r in bad.where("record is not null").collect())
    assert all(part in kept for part in ("short", "extra", "u6", "last,x,y,z"))
    assert rows(readers.read_initial_csv(spark, str(f)), "url") == [("u1",), ("u4",), ("u5",)]
    lost = rows(readers.reject_initial_csv(spark, str(f)), "url", "reason")
    assert ("u4", "unreadable confidence") in lost and ("u5", "unreadable posting_time") in lost and len(lost) == 5


@pytest.mark.parametrize("broken", ["swaymeter.llm", "ahocorasick", "corpus_pipeline"])
def test_entry_without_training_text(broken):
    """A module that cannot be imported takes only its own queries with it."""
    code = f"import sys; sys.modules[{broken!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 240 and out[2] == "False"
