"""Walks along redirects, a hop a round, in which only the walks that go on take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.functions import constants as K
from auditloom.plans.staging import stage


def chains(urls: DataFrame, hops: int = K.MAX_REDIRECT_HOPS, heads_only: bool = True) -> DataFrame:
    """(url, final_url, hops, path, loop) from each URL that redirects and, if ``heads_only``, that none redirects to.
    A walk ends at a URL without successor, at one seen before (a loop) or after ``hops``.  Only redirecting URLs take part, and
    after the first hop only walks that go on.  A URL in several rows goes several ways, and each of them is a walk."""
    step = stage(urls.where(F.col("redirect_to").isNotNull()).select(F.col("url").alias("f"), F.col("redirect_to").alias("t")), "step")
    ways = step.select(F.col("f").alias("url"), F.array("f", "t").alias("path"), (F.col("f") == F.col("t")).alias("loop"))
    on, out = step.select(F.col("f").alias("at"), F.col("t").alias("more")), None
    for n in range(1, hops + 1):
        rows = Observation()
        last = F.col("loop") | F.lit(n == hops)
        each = ways.withColumn("at", F.when(~last, F.element_at("path", -1))).join(on, "at", "left").drop("at")
        each = stage(each.observe(rows, F.count("more").alias("n")), "ways")
        done = each.where("more IS NULL").drop("more")
        out = done if out is None else out.unionByName(done)
        if not rows.get["n"]:
            break
        ways = each.where("more IS NOT NULL").select("url", F.concat("path", F.array("more")).alias("path"), F.array_contains("path", F.col("more")).alias("loop"))
    if heads_only:
        out = out.join(step.select(F.col("t").alias("url")).distinct(), "url", "left_anti")
    return out.select("url", F.element_at("path", -1).alias("final_url"), (F.size("path") - 1).alias("hops"), "path", "loop")


def cycles(urls: DataFrame, hops: int = K.MAX_REDIRECT_HOPS) -> DataFrame:
    """(url, cycle): each loop once, by its smallest URL (and its length, where a URL goes several ways)."""
    walks = chains(urls, hops, heads_only=False).where("loop")
    turn = F.array_position("path", F.col("final_url")).cast("int")
    cut = walks.select(F.slice("path", turn, F.size("path") - turn).alias("cycle"))
    at = F.array_position("cycle", F.array_min("cycle")).cast("int")
    turned = F.concat(F.slice("cycle", at, F.size("cycle")), F.slice("cycle", F.lit(1), at - 1))
    return cut.select(F.array_min("cycle").alias("url"), turned.alias("cycle")).groupBy("url", F.size("cycle")).agg(F.min("cycle").alias("cycle")).select("url", "cycle")


def final_status(urls: DataFrame, hops: int = K.FINAL_HOPS) -> DataFrame:
    """(url, final_url, hops, status_code, is_internal, error_kind) of every URL after at most ``hops`` redirects of status 3xx.
    Of the ways of a URL that is in several rows the longest counts, of equal ones that to the smallest URL; the end has a row
    for each row of its own."""
    moving = urls.where(F.col("status_code").between(300, 399)).select("url", "redirect_to").distinct()
    far = F.struct(-F.col("hops"), F.col("final_url"))
    ends = chains(moving, hops, heads_only=False).groupBy("url").agg(F.min_by("final_url", far).alias("final_url"), F.max("hops").alias("hops"))
    j = urls.select("url").distinct().join(ends, "url", "left").select("url", F.coalesce("final_url", "url").alias("final_url"), F.coalesce("hops", F.lit(0)).alias("hops"))
    known = urls.select(F.col("url").alias("final_url"), "status_code", "is_internal", "error_kind")
    return j.join(known, "final_url", "left").select("url", "final_url", "hops", "status_code", "is_internal", "error_kind")
