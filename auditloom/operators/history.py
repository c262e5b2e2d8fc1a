"""History of benchmark runs: one JSON line a run, and the best of each target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "target string, concurrency int, started_at string, seconds double, pages long, elements long, peak_mb double"


def collect(spark: SparkSession, target: str, concurrency: int, started_at: str, seconds: float, pages: DataFrame, links: DataFrame, images: DataFrame, peak_mb: float) -> DataFrame:
    """A run's row; elements are pages, links and images together."""
    n = [x.count() for x in (pages, links, images)]
    return spark.createDataFrame([(target, concurrency, started_at, seconds, n[0], sum(n), peak_mb)], SCHEMA)


def append(run: DataFrame, folder: str) -> None:
    run.coalesce(1).write.mode("append").json(folder)


def best(spark: SparkSession, folder: str) -> DataFrame:
    """Per target and concurrency the most elements a second, when that was, and how many runs there were."""
    runs = spark.read.schema(SCHEMA).json(folder).withColumn("rate", F.col("elements") / F.greatest("seconds", F.lit(0.001)))
    top = F.max(F.struct("rate", "started_at"))
    return runs.groupBy("target", "concurrency").agg(top["rate"].alias("rate"), top["started_at"].alias("started_at"), F.count("*").alias("runs"))


def passes(run: DataFrame, elements_a_second: float = 40_000, pages_a_second: float = 300, peak_mb: float = 200) -> DataFrame:
    """``run`` with what it misses of the gate."""
    miss = F.array(
        F.when(F.col("elements") < elements_a_second * F.col("seconds"), "elements"),
        F.when(F.col("pages") < pages_a_second * F.col("seconds"), "pages"),
        F.when(F.col("peak_mb") > peak_mb, "memory"),
    )
    return run.withColumn("missed", F.array_compact(miss))
