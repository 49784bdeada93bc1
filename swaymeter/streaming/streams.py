"""The daily ingest as an incremental stream.

Every stream runs with `availableNow`: it takes what is new, then stops, as a daily job
does. Progress and state live in the caller's checkpoint folder, so a stream that is
started again (also after losing executors) goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from swaymeter import schemas
from swaymeter.operators.joins import not_stored
from swaymeter.operators.sets import first_per_key
from swaymeter.plans.rollup import write_counts

LATE = "2 days"


def story_stream(spark: SparkSession, path: str, schema: T.StructType = schemas.STORY, kind: str = "json",
                 glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """New files below a folder."""
    reader = spark.readStream.schema(schema).format(kind)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append everything new to a parquet table and stop."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def dedup_stream(stream: DataFrame, time: str = "posting_time", key: str = "url", late: str = LATE) -> DataFrame:
    """One row per url within the late window; state older than that is dropped.

    An undated row has no place in the window and goes on without
    state, to be held against the store by `store_writer` like every other row.
    """
    keyed = stream.filter(F.col(key).isNotNull())
    dated = keyed.filter(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return dated.unionByName(keyed.filter(F.col(time).isNull()))


def daily_volume_stream(stream: DataFrame, time: str = "posting_time", late: str = LATE) -> DataFrame:
    """Finished days with their number of articles; rows later than `late` are not counted."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("count"))
    return windows.select(F.to_date("window.start").alias("day"), "count")


#: Parts of a store by the hash of the url. Fixed: a url has to fall in the same part in every run.
STORE_PARTS = 64


def url_part(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(STORE_PARTS)).cast("int")


def store_writer(store_path: str, order: list[str], row_id: str = "id",
                 transform: Callable[[DataFrame], DataFrame] | None = None,
                 rollup_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler: first copy of each url the store does not have, labelled, then stored.

    A batch writes a folder of its own, named after the streaming query (whose id lives in the checkpoint) and the
    batch, and replaces it if the batch is repeated: a batch that ran twice is stored once, and a query with a new
    checkpoint adds to what earlier ones stored. Inside, rows lie in parts by the hash of their url; a batch is held
    against the urls of its own parts only, in all folders but its own. With `rollup_path` the counts of the stored rows
    (see `plans.rollup`) are kept next to them, batch by batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        own = f"run={run}/batch={batch_id}"
        batch = batch.filter(F.col("url") != "").persist()  # it is read to find its parts, to choose rows and to fetch them
        try:
            parts = [r["p"] for r in batch.select(url_part(F.col("url")).alias("p")).distinct().collect()]  # at most STORE_PARTS
            earlier = stored_before(spark, store_path, run, batch_id, parts)
            fresh = first_per_key(batch, "url", order, row_id)
            fresh = not_stored(fresh, earlier, "url") if earlier is not None else fresh
            done = (transform(fresh) if transform else fresh).withColumn("url_part", url_part(F.col("url")))
            done.hint("rebalance", "url_part").write.mode("overwrite").partitionBy("url_part").parquet(f"{store_path}/{own}")
            if rollup_path:
                written = spark.read.schema(done.schema).parquet(f"{store_path}/{own}")
                write_counts(written, f"{rollup_path}/{own}")
        finally:
            batch.unpersist()

    return handle


def stored_before(spark: SparkSession, store_path: str, run: str, batch_id: int, parts: list[int] | None = None) -> DataFrame | None:
    """The store without the folder of this very batch, and only the given parts of it; None while there is no store."""
    try:
        store = spark.read.parquet(store_path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    own = (F.col("run").cast("string") == run) & (F.col("batch") == batch_id)
    chosen = store.filter(~own)
    return (chosen if parts is None else chosen.filter(F.col("url_part").isin(parts))).drop(*FOLDERS)


#: Columns that are folders of a store.
FOLDERS = ["run", "batch", "url_part"]


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    return spark.read.parquet(store_path).drop(*FOLDERS)
