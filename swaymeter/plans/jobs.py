"""Jobs: one function per maintenance task, reading and writing tables by path.

`python -m swaymeter.plans.jobs <job> --option value ...` runs one of them.
"""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter import schemas
from swaymeter.functions.base import present
from swaymeter.functions.labels import is_valid_country, is_valid_pair, resolve_actor, untuple_tone
from swaymeter.operators import filters as P
from swaymeter.operators import fusion, html, joins, maintain
from swaymeter.operators.paging import capped
from swaymeter.plans.ingest import ingest_stories
from swaymeter.plans.risk_index import build_index, score_articles
from swaymeter.sources import readers, sinks


def import_articles(spark: SparkSession, csv: str, out: str, rejects: str, anchor_size: int = 0,
                    anchor_ids: str = "") -> None:
    """Articles from CSV; anchors are the first rows (by file name, then by line) or the ids on a list.

    The id is a hash of the file's path and the line's place, so a repeated import gives the same ids and an import of
    other files other ones.
    """
    rows, bad = readers.read_articles_csv(spark, csv, place=True)
    rows = rows.withColumn("id", readers.place_id("_file", "_line"))
    if anchor_ids:
        rows = joins.mark_listed(rows, readers.read_ids(spark, anchor_ids))
    elif anchor_size:
        first = rows.select("id", "_file", "_line").orderBy("_file", "_line").limit(anchor_size).select("id")
        rows = joins.mark_listed(rows, first)
    sinks.append_articles(rows.drop("_file", "_line"), out)
    bad.write.mode("overwrite").json(rejects)


def import_index(spark: SparkSession, csv: str, out: str) -> str:
    return sinks.replace_table(readers.read_risk_csv(spark, csv), out)


def import_dimensions(spark: SparkSession, csv: str, table: str, out: str, kind: str = "outlets") -> None:
    """Insert or update outlets or journalists from CSV; later lines (of later file names) win."""
    fields = schemas.OUTLET_FIELDS if kind == "outlets" else schemas.JOURNALIST_FIELDS
    read = readers.read_outlets_csv if kind == "outlets" else readers.read_journalists_csv
    updates = read(spark, csv, place=True).withColumn("_line", F.struct("_file", "_line"))
    old = spark.read.parquet(table) if table else spark.createDataFrame(
        [], "id bigint, " + ", ".join(f"{f} string" for f in fields))
    maintain.upsert(old, updates, fields[1:], "_line").write.mode("overwrite").parquet(out)


def ingest(spark: SparkSession, stories: str, page_texts: str, store: str, out: str, rejects: str) -> None:
    """New stories whose page text passes the gate."""
    rows = readers.story_rows(readers.read_stories(spark, stories)).withColumn(
        "story_id", joins.surrogate_id(F.concat_ws("\u0001", "url", "inferred_actor", "target_country")))
    rows = rows.dropDuplicates(["story_id"])  # equal in url, actor and target
    done = ingest_stories(rows.drop("article_text"), spark.read.parquet(page_texts), spark.read.parquet(store),
                          ["target_country", "inferred_actor", "story_id"])
    sinks.append_articles(done.articles.drop("story_id"), out)
    done.rejects.write.mode("overwrite").parquet(rejects)


def link(spark: SparkSession, articles: str, outlets: str, journalists: str, out: str, outlets_out: str) -> None:
    """Link articles with outlet and journalist profiles."""
    linked, profiles = joins.link_outlets(spark.read.parquet(articles), spark.read.parquet(outlets))
    joins.link_journalists(linked, spark.read.parquet(journalists)).write.mode("overwrite").parquet(out)
    profiles.write.mode("overwrite").parquet(outlets_out)


def backfill_authors(spark: SparkSession, articles: str, pages: str, out: str) -> None:
    found = html.page_authors(readers.read_pages(spark, pages), [*V.AUTHOR_STOP_WORDS, "agency", "reuters", "afp"])
    maintain.backfill_authors(spark.read.parquet(articles), found).write.mode("overwrite").parquet(out)


def repaired(articles: DataFrame) -> DataFrame:
    done = maintain.repair_labels(maintain.reset_label(articles))
    return maintain.backfill_times(done.withColumn("tone", untuple_tone("tone")))


def repair(spark: SparkSession, articles: str, out: str, dry_run: str = "") -> None:
    """Label, tone and time repairs; with `dry_run` only the changes are written."""
    before = spark.read.parquet(articles)
    after = repaired(before)
    if dry_run:
        after = maintain.change_set(before, after, ["strategic_intent", "tone", "posting_time"])
    after.write.mode("overwrite").parquet(out)


def label(spark: SparkSession, articles: str, predictions: str, out: str, limit: int = 0, min_chars: int = 50,
          dry_run: str = "") -> None:
    """Fill missing labels from predictions (id, model, model_conf, llm, llm_conf, tone, and optionally tone_conf).

    Takes articles of a monitored country with at least `min_chars` characters, resolves their actor from outlet and
    text, keeps pairs that may influence each other, and stores the surer of intent and tone as confidence.
    """
    before = spark.read.parquet(articles)
    todo = before.filter(P.needs_processing() & is_valid_country("target_country") & (F.length("article_text") >= min_chars))
    todo = todo.select("id", "target_country", resolve_actor("inferred_actor", "media_outlet", "article_text").alias("inferred_actor"))
    todo = capped(todo.filter(is_valid_pair("target_country", "inferred_actor")), limit or None, "id")
    found = spark.read.parquet(predictions)
    if "tone_conf" not in found.columns:
        found = found.withColumn("tone_conf", F.lit(0.0))
    merged = found.withColumn("_m", fusion.merge_either("model", "model_conf", "llm", "llm_conf")).filter(F.col("_m").isNotNull())
    updates = merged.join(todo.select("id", "inferred_actor"), "id").select(
        "id", F.col("_m.intent").alias("strategic_intent"),
        fusion.final_confidence(F.col("_m.conf"), F.coalesce("tone_conf", F.lit(0.0))).alias("confidence"),
        F.col("_m.source").alias("prediction_source"), "tone", "inferred_actor")
    columns = ["strategic_intent", "confidence", "prediction_source", "tone", "inferred_actor"]
    after = maintain.keyed_update(before, updates, columns)
    if dry_run:
        after = maintain.change_set(before, after, columns)
    after.write.mode("overwrite").parquet(out)


def score(spark: SparkSession, articles: str, index: str, out: str) -> None:
    score_articles(spark.read.parquet(articles), sinks.read_current(spark, index)).write.mode("overwrite").parquet(out)


def index(spark: SparkSession, articles: str, out: str, as_of: str, r_metric: str = "g_debt") -> str:
    """Recompute the index and replace the stored one."""
    cube = build_index(spark.read.parquet(articles), readers.exposure(spark), readers.country_profile(spark),
                       r_metric, as_of=as_of)
    return sinks.replace_table(cube, out)


def fill_intents(spark: SparkSession, articles: str, predictions: str, out: str) -> None:
    """Intents for articles without one, from predictions (id, intent, conf, tone)."""
    maintain.fill_missing_intents(spark.read.parquet(articles), spark.read.parquet(predictions)).write.mode("overwrite").parquet(out)


def relabel(spark: SparkSession, articles: str, predictions: str, out: str, cutoff: int = 0) -> None:
    """Index intents for unlabelled articles, and anchors up to the id `cutoff`."""
    done = maintain.relabel_for_index(spark.read.parquet(articles), spark.read.parquet(predictions), cutoff)
    done.write.mode("overwrite").parquet(out)


def all(spark: SparkSession, articles: str, work: str, index_path: str, as_of: str, csv: str = "",  # noqa: A001
        predictions: str = "", anchor_size: int = 0) -> None:
    """Import (with `csv`), label (with `predictions`), repair, keep pseudo labels, recompute the index, score."""
    if csv:
        import_articles(spark, csv, articles, f"{work}/rejected", anchor_size)
    if predictions:
        label(spark, articles, predictions, f"{work}/labelled")
        articles = f"{work}/labelled"
    repair(spark, articles, f"{work}/repaired")
    kept = fusion.keep_pseudo_labels(spark.read.parquet(f"{work}/repaired").filter(present("article_text")))
    kept.write.mode("overwrite").parquet(f"{work}/kept")
    index(spark, f"{work}/kept", index_path, as_of)
    score(spark, f"{work}/kept", index_path, f"{work}/scored")


JOBS: dict[str, Callable] = {f.__name__: f for f in (
    import_articles, import_index, import_dimensions, ingest, link, backfill_authors, repair, label, fill_intents, relabel, score, index, all)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        sub = commands.add_parser(name, help=job.__doc__)
        for p in list(inspect.signature(job).parameters.values())[1:]:
            required = p.default is inspect.Parameter.empty
            sub.add_argument(f"--{p.name}", required=required, default=None if required else p.default,
                             type=int if isinstance(p.default, int) else str)
    options = vars(parser.parse_args(argv))
    job = JOBS[options.pop("job")]
    spark = SparkSession.builder.appName(job.__name__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    job(spark, **options)


if __name__ == "__main__":
    main()
