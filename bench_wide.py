"""The eight benchmark shapes over a table of parts, 25 million rows of 13 columns in 5 parts, in strict mode.

python bench_wide.py [--rows N] [--threads T] [--folder F]: one JSON line with the median seconds of each query, from
the statement's text to an Arrow table on the driver, after two warm-up runs. The table is made, with random values of
the benchmark's distributions, in a new folder, which is deleted afterwards.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from lamina import Engine, TableSchema  # noqa: E402

PARTS, SEED, RUNS = 5, 42, 7
SCHEMA = TableSchema.of(
    "events",
    {"ts": "I64", "user_id": "I64", "country_id": "I16", "city_id": "I32", "device": "I8", "event_type": "Str", "price": "F64", "quantity": "I32",
     "duration_ms": "I32", "flag_a": "Bool", "flag_b": "Bool", "session_id": "I64", "event_code": "I16"},
    (0,),
)
QUERIES = {
    "q1": "SELECT SUM(price) FROM events",
    "q2": "SELECT SUM(price), AVG(price), MIN(price), MAX(price), COUNT(price) FROM events",
    "q3": "SELECT SUM(price) FROM events WHERE ts < 250000",
    "q4": "SELECT SUM(price) FROM events WHERE country_id < 100",
    "q5": "SELECT country_id, SUM(price) FROM events GROUP BY country_id",
    "q6": "SELECT user_id, SUM(price) FROM events GROUP BY user_id",
    "q7": "SELECT country_id, city_id, AVG(price) FROM events WHERE ts > 5000000 GROUP BY country_id, city_id",
    "q8": "SELECT event_type, SUM(price) FROM events GROUP BY event_type",
}


def rows(spark: SparkSession, low: int, high: int, files: int) -> DataFrame:
    """Rows low to high; ts rises by 1 to 3 a row, 2 in the mean."""
    u = lambda k, n: F.floor(F.rand(SEED + 100 * k + low) * n)
    return spark.range(low, high, 1, files).select(
        F.col("id") * 2 + u(0, 2), u(1, 1_000_000), u(2, 200), u(3, 10_000), u(4, 5), F.concat(F.lit("event_kind_"), u(5, 20).cast("string")), F.rand(SEED + low) * 1000,
        u(6, 49) + 1, u(7, 600_000), F.rand(SEED + low + 1) < 0.5, F.rand(SEED + low + 2) < 0.5, F.abs(F.xxhash64("id", F.lit(low))).bitwiseAND(F.lit((1 << 63) - 1)), u(8, 32_767),
    )


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--rows", type=int, default=25_000_000)
    parser.add_argument("--threads", type=int, default=4)
    parser.add_argument("--folder", default=tempfile.gettempdir())
    o = parser.parse_args()
    spark = (
        SparkSession.builder.master(f"local[{o.threads}]")
        .config("spark.sql.shuffle.partitions", o.threads)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A split is measured with all its columns, of which the queries read two or three.
        .config("spark.sql.files.maxPartitionBytes", "512m")
        # A million groups fit the first-level map of a partial aggregation.
        .config("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "20")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-", dir=o.folder)
    try:
        engine = Engine(spark, folder, strict=True)
        engine.create_table(SCHEMA)
        began = time.perf_counter()
        for k in range(PARTS):
            engine.insert("events", rows(spark, k * o.rows // PARTS, (k + 1) * o.rows // PARTS, o.threads), options={"compression": "lz4_raw"})
        loaded = time.perf_counter() - began
        size = sum(p.bytes for p in engine.table("events").parts())
        times = {}
        for name, sql in QUERIES.items():
            runs = []
            for _ in range(2 + RUNS):
                began = time.perf_counter()
                engine.collect(sql)
                runs.append(time.perf_counter() - began)
            times[name] = round(statistics.median(runs[2:]), 4)
        out = {"metric": "sum of the eight benchmark queries", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "rows": o.rows, "threads": o.threads, "bytes": size, "insert_sec": round(loaded, 1)}
        print(json.dumps(out))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    main()
