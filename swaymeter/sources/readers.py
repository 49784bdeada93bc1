"""Readers. Every path may be local, `s3a://`, `hdfs://`, ...: Spark resolves it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter import schemas
from swaymeter.functions.base import blank_to_null, col, present, strip
from swaymeter.functions.text import parse_timestamp, safe_bool, safe_double, safe_int
from swaymeter.operators.filters import between_days, real_day
from swaymeter.operators.joins import small, surrogate_id

ARTICLE_FIELDS = ["article_text", "posting_time", "media_outlet", "inferred_actor", "strategic_intent", "sector",
                  "tone", "target_country", "URL", "confidence", "lang_detect", "use_afrolm", "llm_strat",
                  "llm_strat_conf", "llm_strat_notes", "pseudo_kept", "pseudo_weight", "llm_strat_id",
                  "strategic_intent_id"]
# every byte is valid in iso-8859-1, so nothing after it could ever be chosen
ENCODINGS = ("utf-8", "iso-8859-1")


def read_text_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A CSV file with header, quoted line breaks and all columns as strings."""
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("encoding", encoding).option("nullValue", "\u0001").option("emptyValue", "").csv(path))


DAMAGED = "_damaged"


def read_checked_csv(spark: SparkSession, path: str, encoding: str = "utf-8", names: Sequence[str] | None = None) -> DataFrame:
    """As `read_text_csv`, with the whole record in `_damaged` where it has too few or too many cells or an open quote
    (which takes in what follows it), else NULL there. `names` are the columns, by default those of the header.
    """
    names = list(names or read_text_csv(spark, path, encoding).columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, DAMAGED]])
    read = (spark.read.schema(schema).option("columnNameOfCorruptRecord", DAMAGED).option("mode", "PERMISSIVE").option("header", True)
            .option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
            .option("nullValue", "\u0001").option("emptyValue", "").csv(path))
    # Spark does not read that column alone, so it is tied to another one
    return read.withColumn(DAMAGED, F.when(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) >= "", F.col(DAMAGED)))


def _with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, NULL where the file lacks one."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[n.lower()]}`") if n.lower() in have else F.lit(None).cast("string")).alias(n)
                       for n in names])


PLACE = ["_file", "_line"]


def with_place(raw: DataFrame) -> DataFrame:
    """Adds the path of the file a row comes from and its place in the file, from 0.

    A file with quoted line breaks is read in one piece, so row numbers within it follow each other; the first number
    of each file (one row a file) makes them independent of how files are dealt to tasks.
    """
    numbered = raw.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_line", F.monotonically_increasing_id())
    starts = numbered.groupBy("_file").agg(F.min("_line").alias("_start"))
    return numbered.join(small(starts), "_file").withColumn("_line", F.col("_line") - F.col("_start")).drop("_start")


def place_id(file: str = "_file", line: str = "_line") -> Column:
    """Id of a row by its place: the same in every run."""
    return surrogate_id(F.concat_ws("\u0001", F.col(file), F.col(line).cast("string")))


def article_rows(raw: DataFrame) -> DataFrame:
    """Typed article rows with defaults; `posting_time` is NULL where no format fits."""
    def text(c: str, default: str | None = None) -> Column:
        value = blank_to_null(strip(c))
        return value if default is None else F.coalesce(value, F.lit(default))

    unknown = ["media_outlet", "inferred_actor", "strategic_intent", "sector", "tone", "target_country"]
    return raw.select(
        "article_text", parse_timestamp("posting_time").alias("posting_time"),
        *[text(c, "Unknown").alias(c) for c in unknown],
        text("URL", "").alias("url"), safe_double("confidence", 4.0).alias("confidence"),
        text("lang_detect", "en").alias("lang_detect"), safe_bool("use_afrolm").alias("use_afrolm"),
        text("llm_strat").alias("llm_strat"), safe_double("llm_strat_conf").alias("llm_strat_conf"),
        text("llm_strat_notes").alias("llm_strat_notes"), safe_bool("pseudo_kept").alias("pseudo_kept"),
        safe_double("pseudo_weight", 0.0).alias("pseudo_weight"), safe_int("llm_strat_id", -1).alias("llm_strat_id"),
        safe_int("strategic_intent_id", 0).alias("strategic_intent_id"), *[c for c in PLACE if c in raw.columns])


def read_articles_csv(spark: SparkSession, path: str, place: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles, rejects): damaged records and rows without a usable time are rejected with a reason.

    A damaged record is kept whole in `record`; its cells are not trusted. With `place`, see `with_place`.
    """
    read = read_checked_csv(spark, path)
    read = with_place(read) if place else read
    raw = _with_columns(read, [*ARTICLE_FIELDS, DAMAGED, *(PLACE if place else [])])
    whole, damaged = raw.filter(F.col(DAMAGED).isNull()).drop(DAMAGED), raw.filter(F.col(DAMAGED).isNotNull())
    time = parse_timestamp("posting_time")
    reason = F.when(~present(strip("posting_time")), F.lit("posting_time is empty")).otherwise(
        F.concat(F.lit("Could not parse date: "), F.col("posting_time")))
    rejects = whole.filter(time.isNull()).withColumns({"reason": reason, "record": F.lit(None).cast("string")})
    nothing = {c: F.lit(None).cast("string") for c in ARTICLE_FIELDS}
    broken = damaged.withColumns({**nothing, "reason": F.lit("damaged record"), "record": F.col(DAMAGED)}).drop(DAMAGED)
    return article_rows(whole.filter(time.isNotNull())), rejects.unionByName(broken)


def initial_rows(raw: DataFrame) -> DataFrame:
    """Lenient form: texts as they are, missing ones empty, 0.0 as default confidence."""
    plain = ["media_outlet", "inferred_actor", "sector", "tone", "target_country", "lang_detect"]
    return raw.select(
        "article_text", blank_to_null("posting_time").try_cast("timestamp").alias("posting_time"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in plain],
        blank_to_null("strategic_intent").alias("strategic_intent"), F.coalesce("URL", F.lit("")).alias("url"),
        F.coalesce(blank_to_null("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        safe_bool("use_afrolm", ("true", "1", "yes")).alias("use_afrolm"))


def read_initial_csv(spark: SparkSession, path: str) -> DataFrame:
    """The lenient import: every whole record gives a row; see `reject_initial_csv` for what was lost or replaced."""
    read = read_checked_csv(spark, path)
    return initial_rows(_with_columns(read.filter(F.col(DAMAGED).isNull()), ARTICLE_FIELDS))


def reject_initial_csv(spark: SparkSession, path: str) -> DataFrame:
    """(url, reason, value) for every cell that the lenient import could not read and replaced by its default, and every
    damaged record, which gives no row; `value` is the cell or the record."""
    read = read_checked_csv(spark, path)
    rows = _with_columns(read, [*ARTICLE_FIELDS, DAMAGED])
    cells = {"confidence": ("confidence", "double"), "posting_time": ("posting_time", "timestamp")}
    whole = F.col(DAMAGED).isNull()
    bad = [F.when(whole & blank_to_null(strip(c)).isNotNull() & blank_to_null(c).try_cast(kind).isNull(),
                  F.struct(F.lit(f"unreadable {name}").alias("reason"), F.col(c).alias("value"))) for name, (c, kind) in cells.items()]
    broken = F.when(~whole, F.struct(F.lit("damaged record").alias("reason"), F.col(DAMAGED).alias("value")))
    found = rows.select(F.when(whole, F.col("URL")).alias("url"), F.explode_outer(F.array_compact(F.array(*bad, broken))).alias("x"))
    return found.filter("x is not null").select("url", "x.reason", "x.value")


def read_risk_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_csv(spark, path)
    return raw.select("actor", "country", "intent", F.col("FinalRisk").try_cast("double").alias("final_risk"))


def read_outlets_csv(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Outlet profiles; blank cells are NULL, unnamed columns are ignored."""
    read = read_text_csv(spark, path)
    return _profiles(with_place(read) if place else read, schemas.OUTLET_FIELDS, place)


def _profiles(raw: DataFrame, fields: Sequence[str], place: bool) -> DataFrame:
    more = PLACE if place else []
    return _with_columns(raw, [*fields, *more]).select(*[blank_to_null(strip(n)).alias(n) for n in fields], *more)


def pick_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """First encoding that decodes the file without a replacement character."""
    for encoding in encodings:
        lines = spark.read.option("encoding", encoding).option("header", False).csv(path)
        bad = [F.contains(F.col(c), F.lit("\ufffd")) for c in lines.columns]
        broken = F.greatest(*[F.coalesce(b.cast("int"), F.lit(0)) for b in bad], F.lit(0)) == 1
        if lines.filter(broken).isEmpty():
            return encoding
    return encodings[-1]


def read_journalists_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, place: bool = False) -> DataFrame:
    read = read_text_csv(spark, path, pick_encoding(spark, path, encodings))
    raw = with_place(read) if place else read
    bom_free = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    cleaned = _profiles(bom_free, schemas.JOURNALIST_FIELDS, place)
    return cleaned.filter(F.col("name").isNotNull())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; anything else is skipped."""
    return (spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id"))
            .filter(F.col("id").isNotNull()))


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_articles(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The stored article table, or its articles of the UTC days `start` to `end` (ISO dates; None: open).

    Only the months that can hold such days are read. A bound that is no day is ignored; undated articles come only
    without bounds.
    """
    df = spark.read.schema(T.StructType([*schemas.NARRATIVES.fields, T.StructField("month", T.StringType())])).parquet(path)
    first, last = (real_day(d) for d in (start, end))
    if first:
        df = df.filter((F.col("month") >= first[:7]) & (F.col("month") != "undated"))
    if last:
        df = df.filter(F.col("month") <= last[:7])
    return df.filter(between_days("posting_time", start, end)).drop("month")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
              *columns: str, **options: str) -> DataFrame:
    """A database table read in parallel ranges of `key`; filters and columns are pushed down."""
    df = (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
                                            upperBound=str(upper), numPartitions=str(partitions), **options).load())
    return df.select(*columns) if columns else df


def story_rows(stories: DataFrame, generous: bool = True) -> DataFrame:
    """Stories as article rows with every column and its default.

    `generous` presets the confidence with the story's score or 1.0.
    """
    confidence = F.coalesce(col("score"), F.lit(1.0)) if generous else F.lit(None).cast("double")
    known = {"url": F.col("url"), "posting_time": F.coalesce(F.try_to_timestamp("publish_date"),
                                                            parse_timestamp("publish_date")),
             "media_outlet": F.col("media_name"), "inferred_actor": F.col("actor"),
             "target_country": F.col("target"), "lang_detect": F.col("language"),
             "confidence": confidence, "pseudo_kept": F.lit(True), "pseudo_weight": F.lit(1.0),
             "use_afrolm": F.lit(False)}
    return stories.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in schemas.NARRATIVES if f.name != "id"])


def read_stories(spark: SparkSession, path: str, schema: T.StructType = schemas.STORY) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def exposure(spark: SparkSession) -> DataFrame:
    """The packaged exposure figures: (actor, country, metric, value)."""
    from swaymeter.fixed_values import exposure_rows

    return spark.createDataFrame(exposure_rows(), schemas.EXPOSURE)


def country_profile(spark: SparkSession) -> DataFrame:
    from swaymeter.fixed_values import COUNTRY_PROFILE

    return spark.createDataFrame(COUNTRY_PROFILE, schemas.COUNTRY_PROFILE).withColumn(
        "election_date", F.to_date("election_date"))
