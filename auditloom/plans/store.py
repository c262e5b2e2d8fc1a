"""Crawls and comparisons as folders of Parquet tables, opened for reading only."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.plans.model import Crawl

SCHEMA_VERSION = 1
TABLES = ("urls", "pages", "links", "images", "robots", "sitemaps", "issues")
META = "schema_version int, base_url string, mode string, started_at string, status string, truncated boolean, discover_sitemaps boolean, rules_version string, config_json string"


def save(crawl: Crawl, folder: str, started_at: str = "", status: str = "done", rules_version: str = "1") -> str:
    """Every table that the crawl has, and last of all its description, so that a folder without one is no crawl."""
    for name in TABLES:
        df = getattr(crawl, name)
        if df is not None:
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    row = (SCHEMA_VERSION, crawl.base_url, crawl.mode, started_at, status, crawl.truncated, crawl.discover_sitemaps, rules_version, json.dumps(crawl.config, sort_keys=True))
    crawl.spark.createDataFrame([row], META).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/crawl_meta")
    return folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException:
        return None


def identify(spark: SparkSession, folder: str) -> str:
    """``crawl``, ``diff`` or ``other``."""
    if _table(spark, folder, "crawl_meta") is not None and _table(spark, folder, "urls") is not None:
        return "crawl"
    return "diff" if _table(spark, folder, "diff_meta") is not None else "other"


def meta(spark: SparkSession, folder: str) -> dict:
    found = _table(spark, folder, "crawl_meta")
    if found is None:
        raise ValueError(f"{folder} holds no crawl, it is: {identify(spark, folder)}")
    row = found.first().asDict()
    if row["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"{folder} has the schema {row['schema_version']}, newer than {SCHEMA_VERSION}")
    return row


def load(spark: SparkSession, folder: str) -> Crawl:
    m = meta(spark, folder)
    t = {name: _table(spark, folder, name) for name in TABLES}
    more = {k: m[k] for k in ("started_at", "status", "rules_version")}
    crawl = Crawl(t["urls"], t["pages"], t["links"], t["images"], t["robots"], t["sitemaps"], m["base_url"], m["mode"], m["truncated"], m["discover_sitemaps"], json.loads(m["config_json"]), t["issues"])
    return replace(crawl, run=more)


def latest_two(spark: SparkSession, root: str) -> DataFrame:
    """(site, crawl, before) of the crawls under ``root/site=…/crawl=…``: of each site the newest and the one before it.  Only
    the descriptions are read."""
    m = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(META).parquet(f"{root}/*/*/crawl_meta")
    part = lambda k: F.regexp_extract(F.input_file_name(), rf"/{k}=([^/]+)/", 1).alias(k)
    found = m.select(part("site"), part("crawl"), "started_at", "status")
    w = Window.partitionBy("site").orderBy(F.desc("started_at"), F.desc("crawl"))
    return found.withColumn("before", F.lead("crawl").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("site", "crawl", "before")


def write_by_project(df: DataFrame, folder: str, project: str, date: str) -> None:
    """Into ``folder/project=…/date=…``; only that partition is replaced."""
    out = df.withColumns({"project": F.lit(project), "date": F.lit(date)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "date").parquet(folder)
