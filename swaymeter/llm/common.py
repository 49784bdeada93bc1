"""What the operators of this package share: tables, words, shared folders, safe column names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\x0c\r"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir` of the session.

    Where it is unset, a local session (one machine) gets a folder of its own; a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="swaymeter-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a full URI of the file system that Spark means by it, for writers outside the JVM."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a slim table: lineage ends in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """As `cut`, but as compressed Parquet that later reads can prune."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver's JVM next collects its garbage, so that a chain of
    stored tables takes the disk of one step and not of all. What is made inside is to be run once; results are made outside."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from `stored` that is not read any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * (len(SPACE) - 1))
    return F.array_remove(F.split(flat, " "), "")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of `df` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given: clashes with other columns cannot happen."""
    return df.select(*(quoted(name).alias(alias) for alias, name in columns.items()))


def in_arrow(df: DataFrame, run, **more: T.DataType) -> DataFrame:
    """`df` with all its columns through `run`, batch by batch; `more` are columns that `run` adds at the end.

    Inside, columns have plain names by position, so that any name may occur outside, dots and repeats included.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    added = [T.StructField(f"c{len(df.columns) + i}", kind) for i, kind in enumerate(more.values())]
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added])).toDF(*df.columns, *more)


def crc32_text(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as the text `null`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def sql_list(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
