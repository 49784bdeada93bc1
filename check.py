"""Compare registered queries with their SQL: `python check.py [sf_dir] [name ...]`."""

import sys
import time
import traceback

from pyspark.sql import SparkSession

from catalog import load
from tests.oracle import compare, duck


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, (query, sql) in load().items():
        if args and name not in args:
            continue
        start, seen = time.time(), []
        try:
            diff = compare(spark, con, sf_dir, query, sql, seen) if sql else f"rows only: {query(spark, sf_dir).count()}"
        except Exception as e:
            diff = "".join(traceback.format_exception_only(e))[:1500]
        ok = diff is None or diff.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s rows={seen} {diff or ''}", flush=True)
        spark.catalog.clearCache()
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
