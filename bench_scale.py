"""Times operators on larger tables than the given ones, and prints one JSON line.

BENCH_CPUS      local cores (default 8)
BENCH_CANDLES   candles of four pairs (default 1,000,000)
BENCH_RELEASES  releases, on a tenth as many instants (default 20,000)
BENCH_VECTORS   vectors for the neighbour search (default 50,000)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from aftershock.operators import trees  # noqa: E402
from aftershock.operators.market import PRICES, market_after, market_at, market_features  # noqa: E402
from aftershock.operators.neighbours import nearest  # noqa: E402
from aftershock.operators.stats import describe_stats  # noqa: E402
from aftershock.session import local_session, stored  # noqa: E402


def candles(spark: SparkSession, n: int) -> DataFrame:
    """Random walks of four pairs, five minutes apart."""
    no, pair = F.expr("id div 4"), F.col("id") % 4
    noise = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)) for i in range(4)]
    base = 10_000 + F.round(300 * F.sin(no / 500.0)).cast("long")
    rows = spark.range(n).select(
        F.concat(F.lit("P"), pair.cast("string")).alias("pair"),
        F.timestamp_seconds(no * 300).alias("ts"),
        (base + noise[0]).alias("open"), (base + 40 + noise[1]).alias("high"),
        (base - noise[2]).alias("low"), (base + noise[3]).alias("close"),
    )
    return stored(rows, "candles")


def vectors(spark: SparkSession, n: int) -> DataFrame:
    """Points in 16 dimensions around two hundred centres."""
    def part(i: int):
        centre = F.pmod(F.xxhash64(F.pmod(F.xxhash64("id"), F.lit(200)), F.lit(i)), F.lit(1000)) / 50.0
        return centre + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0

    rows = spark.range(n).select(
        "id", F.array(*[part(i) for i in range(16)]).alias("vector"), (F.col("id") % 2).cast("int").alias("label")
    )
    return stored(rows, "vectors")


def main() -> None:
    size = {k: int(os.environ.get(f"BENCH_{k}", v)) for k, v in (("CANDLES", 1_000_000), ("RELEASES", 20_000), ("VECTORS", 50_000))}
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    market = candles(spark, size["CANDLES"])
    step = max(1, 10 * size["CANDLES"] // (4 * size["RELEASES"]))
    wanted = F.pmod(F.xxhash64("ts", F.lit("instants")), F.lit(step)) == 0
    instants = stored(market.filter((F.col("pair") == "P0") & wanted).select("pair", "ts"), "instants")
    points = vectors(spark, size["VECTORS"])
    told = points.select("label", (F.col("id") % 5).cast("int").alias("fold"), *[F.get("vector", F.lit(i)).alias(f"x{i}") for i in range(16)])
    told = stored(told.withColumn("label", (F.col("x0") + F.col("x1") > 20).cast("int")), "rows")
    grid = trees.grid_points(maxDepth=(2, 4, 6), minInstancesPerNode=(10, 100))
    jobs = {
        "market_after": lambda: market_after(market),
        "market_features": lambda: market_features(market),
        "market_at": lambda: market_at(instants, market),
        "nearest": lambda: nearest(points.filter("id % 5 = 0"), points.filter("id % 5 <> 0"), 11, ["label"]),
        "tree_grid": lambda: trees.grid_table(
            spark, trees.fit_grid(told, [f"x{i}" for i in range(16)], "label", "dtree", "clf", grid)
        ),
        "describe_stats": lambda: describe_stats(market, PRICES),
    }
    times = {}
    for name, job in jobs.items():
        began = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "larger tables, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, **size}))
    spark.stop()


if __name__ == "__main__":
    main()
