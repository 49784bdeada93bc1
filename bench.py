"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and
the cores. The given tables have one row group each, which Spark reads in one task; so they are written once, before
any timing, as tables of several files, as they would be on a cluster. Each query runs three times, over its whole input,
with every result column computed; its time is the median.
"""

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from catalog import load

HEADLINE = [
    "ppi_theta", "content_signal", "final_risk_cube", "build_index", "score_articles", "score_cascade", "request_scores",
    "factors", "contextual_signal", "intent_breadth", "top_actor_country_pairs", "daily_volume", "latest_500_volume",
    "author_statistics", "compare_actors", "page_three", "page_beyond_end", "first_story_per_url", "stories_not_stored",
    "link_journalists", "link_outlets_create_missing", "exclude_sports_texts", "filter_old_without_target", "term_mentions",
    "word_mentions_by_equi_join", "keyword_query", "query_grid", "canonical_intent", "contextual_intent", "actor_from_content",
    "resolve_actor", "display_title", "display_summary", "detect_french", "date_in_text", "parse_replies", "route_questions",
    "page_authors", "page_images", "soft_vote", "hard_vote", "calibrated_probabilities", "merge_confirmed", "repair_labels",
    "keyed_update", "upsert_dimension", "ingest_outcomes", "overview_cards", "report_scores", "quality_profile",
    "stream_daily_volume", "stream_store_and_score",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def in_several_files(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The same tables, each in `files` files; `events`, which the streams find by its file name, stays one file."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in sorted(os.listdir(sf_dir)):
        if table == "events.parquet":
            shutil.copyfile(f"{sf_dir}/{table}", f"{folder}/{table}")
        else:
            spark.read.parquet(f"{sf_dir}/{table}").repartition(files).write.parquet(f"{folder}/{table}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark, checks, times = session(), load(), {}
    given, sf_dir = sf_dir, in_several_files(spark, sf_dir, int(os.environ.get("BENCH_CPUS", "8")))
    checks["count_all_and_filtered"][0](spark, sf_dir).collect()  # start-up is not part of any query
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            checks[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(median(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(given.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
