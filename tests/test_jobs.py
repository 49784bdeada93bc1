"""The jobs, on a few literal rows."""

import json

from pyspark.sql import functions as F

from swaymeter import schemas
from swaymeter.plans import jobs
from swaymeter.sources import sinks


def narratives(spark, items):
    """Article rows with the given values, everything else NULL."""
    names = sorted({k for i in items for k in i})
    kinds = {f.name: f.dataType for f in schemas.NARRATIVES}
    df = spark.createDataFrame([tuple(i.get(n) for n in names) for i in items],
                               ", ".join(f"{n} {kinds[n].simpleString()}" for n in names))
    return df.select(*[(F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schemas.NARRATIVES])


def stored(spark, tmp_path, name, df):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return path


def test_label(spark, tmp_path):
    base = {"article_text": "t" * 60, "target_country": "Senegal", "inferred_actor": "China"}
    art = stored(spark, tmp_path, "art", narratives(spark, [
        {"id": 1, **base}, {"id": 2, **base, "strategic_intent": "x", "tone": "y"}, {"id": 3, **base, "target_country": "Mali"}]))
    pred = stored(spark, tmp_path, "pred", spark.createDataFrame(
        [(1, "Economic", 0.4, "Religious", 0.9, "Cynical"), (2, "a", 0.9, None, None, "b"), (3, "a", 0.9, None, None, "b")],
        "id long, model string, model_conf double, llm string, llm_conf double, tone string"))
    out = str(tmp_path / "out")
    jobs.label(spark, art, pred, out)
    got = {r.id: (r.strategic_intent, r.confidence, r.prediction_source, r.tone) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("Religious", 0.9, "llm", "Cynical"), 2: ("x", None, None, "y"), 3: (None, None, None, None)}
    short = stored(spark, tmp_path, "short", narratives(spark, [{"id": 1, **base, "article_text": "t" * 49}]))
    jobs.label(spark, short, pred, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).first().strategic_intent is None
    jobs.label(spark, art, pred, str(tmp_path / "dry"), dry_run="yes")
    assert {(r.id, r.column) for r in spark.read.parquet(str(tmp_path / "dry")).collect()} == {
        (1, c) for c in ("strategic_intent", "confidence", "prediction_source", "tone")}


def test_imports_keep_ids_apart_and_anchors_in_file_order(spark, tmp_path):
    """The longer file sorts last by name and first by size."""
    head = "article_text,posting_time,inferred_actor,target_country,strategic_intent,URL,confidence\n"
    one, two = tmp_path / "one", tmp_path / "two"
    for folder in (one, two):
        folder.mkdir()
        (folder / "a.csv").write_text(head + "".join(f"{folder.name} a{i},2025-01-01 00:00:00,China,Senegal,Economic,u,0.5\n" for i in range(3)))
        (folder / "b.csv").write_text(head + "".join(f'"{folder.name} b{i}\n{"x" * 500}",2025-01-01 00:00:00,China,Senegal,Economic,u,abc\n' for i in range(5)))
    out = str(tmp_path / "out")
    for folder in (one, two, one):
        jobs.import_articles(spark, str(folder), out, str(tmp_path / "rej"), anchor_size=4)
    found = spark.read.parquet(out).collect()
    assert len(found) == 24 and len({r.id for r in found}) == 16
    anchors = {r.article_text.split("\n")[0] for r in found if r.is_anchor}
    assert anchors == {f"{f} {n}" for f in ("one", "two") for n in ("a0", "a1", "a2", "b0")}


def test_fill_and_relabel(spark, tmp_path):
    art = stored(spark, tmp_path, "art", narratives(spark, [{"id": i, "article_text": "t", "inferred_actor": "China", "target_country": "Senegal"} for i in (1, 2)]))
    pred = stored(spark, tmp_path, "pred", spark.createDataFrame([(1, "economic dependency", 0.5, "Cynical"), (1, "economic dependency", 0.4, "Cynical")],
                                                                  "id long, intent string, conf double, tone string"))
    jobs.fill_intents(spark, art, pred, str(tmp_path / "filled"))
    assert sorted((r.id, r.confidence) for r in spark.read.parquet(str(tmp_path / "filled")).collect() if r.confidence) == [(1, 0.5)]
    jobs.relabel(spark, art, pred, str(tmp_path / "relabelled"), cutoff=1)
    assert sorted((r.id, r.is_anchor) for r in spark.read.parquet(str(tmp_path / "relabelled")).collect()) == [(1, True), (2, None)]


def test_link_and_backfill(spark, tmp_path):
    art = stored(spark, tmp_path, "art", narratives(spark, [
        {"id": 1, "media_outlet": "rfi", "author": "ana", "url": "http://u/1"}, {"id": 2, "media_outlet": "New", "author": "", "url": "http://u/2"}]))
    outlets = stored(spark, tmp_path, "outlets", spark.createDataFrame([(7, "RFI")], "id long, name string"))
    people = stored(spark, tmp_path, "people", spark.createDataFrame([(9, "Ana")], "id long, name string"))
    linked, profiles = str(tmp_path / "linked"), str(tmp_path / "profiles")
    jobs.link(spark, art, outlets, people, linked, profiles)
    got = {r.id: (r.media_outlet_fk, r.journalist_fk) for r in spark.read.parquet(linked).collect()}
    assert got[1] == (7, 9) and got[2][0] > 7 and got[2][1] is None
    assert {r.name for r in spark.read.parquet(profiles).collect()} == {"RFI", "New"}
    pages = stored(spark, tmp_path, "pages", spark.createDataFrame(
        [(1, "http://u/1", '<meta name="author" content="X Y">'), (2, "http://u/2", '<meta name="author" content="Bo Lee">')],
        "page_id long, url string, html string"))
    jobs.backfill_authors(spark, art, pages, str(tmp_path / "authors"))
    assert {r.id: r.author for r in spark.read.parquet(str(tmp_path / "authors")).collect()} == {1: "ana", 2: "Bo Lee"}


def test_ingest(spark, tmp_path):
    (tmp_path / "stories").mkdir()
    story = {"publish_date": "2025-01-02", "media_name": "m", "language": "en", "actor": "China", "target": "Senegal"}
    (tmp_path / "stories" / "a.json").write_text("\n".join(json.dumps({**story, "url": u}) for u in ("u1", "u1", "u2", "u3")))
    texts = stored(spark, tmp_path, "texts", spark.createDataFrame(
        [("u1", "Senegal " * 200), ("u2", "Senegal " * 200), ("u3", "short")], "url string, article_text string"))
    store = stored(spark, tmp_path, "store", narratives(spark, [{"id": 1, "url": "u2"}]))
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    jobs.ingest(spark, str(tmp_path / "stories"), texts, store, out, rejects)
    saved = spark.read.parquet(out).collect()
    assert [(r.url, str(r.month), r.pseudo_kept, r.confidence) for r in saved] == [("u1", "2025-01", True, 1.0)]
    assert {(r.url, r.outcome) for r in spark.read.parquet(rejects).collect()} == {("u2", "already stored"), ("u3", "irrelevant")}


def test_dimensions_index_and_all(spark, tmp_path):
    csv = tmp_path / "o.csv"
    csv.write_text("name,country\nRfi,France\nRfi,Mali\n")
    old = stored(spark, tmp_path, "old", spark.createDataFrame([(5, "Rfi")], "id long, name string").select(
        "id", "name", *[F.lit(None).cast("string").alias(f) for f in schemas.OUTLET_FIELDS[1:]]))
    jobs.import_dimensions(spark, str(csv), old, str(tmp_path / "dim"))
    assert [(r.id, r.country) for r in spark.read.parquet(str(tmp_path / "dim")).collect()] == [(5, "Mali")]
    risk = tmp_path / "r.csv"
    risk.write_text("intent,actor,country,FinalRisk\nEconomic,China,Senegal,0.25\n")
    jobs.import_index(spark, str(risk), str(tmp_path / "idx"))
    assert sinks.read_current(spark, str(tmp_path / "idx")).first().final_risk == 0.25
    art = stored(spark, tmp_path, "art", narratives(spark, [
        {"id": i, "article_text": "x" * 200, "inferred_actor": "China", "target_country": "Senegal", "strategic_intent": "economic dependency",
         "confidence": 0.5, "is_anchor": i == 0, "true_label": "Economic" if i == 0 else None} for i in range(4)]))
    jobs.main(["all", "--articles", art, "--work", str(tmp_path / "w"), "--index_path", str(tmp_path / "idx2"), "--as_of", "2026-01-15"])
    scored = spark.read.parquet(str(tmp_path / "w" / "scored")).collect()
    assert {(r.strategic_intent, r.match_level, r.pseudo_weight) for r in scored} == {("Economic", "exact", 1.0)}
