"""Checking the state of foreign URLs politely: how many of a host are asked, and when asking stops."""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import urls as U

PER_HOST, TOTAL, FAILURES = 200, 10_000, 3
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def to_probe(found: DataFrame, per_host: int = PER_HOST, total: int = TOTAL) -> DataFrame:
    """(url, host, seq, reason) of foreign URLs (url, seq) in the order they were found, each once: reason is null for those
    that are asked, ``host_budget`` or ``total_budget`` for the others.

    The total is counted over hosts' first ``per_host`` only, by a threshold on the order, so no task sees all URLs."""
    one = found.groupBy("url").agg(F.min("seq").alias("seq")).withColumn("host", U.host(F.col("url")))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("seq", "url"))
    one = one.withColumn("_r", rank)
    # at most ``total`` rows are sorted by the driver's top-k; the last of them is where asking stops
    last = one.where(F.col("_r") <= per_host).orderBy("seq", "url").limit(total).agg(F.max(F.struct("seq", "url")).alias("m"), F.count("*").alias("n")).first()
    at = last["m"]
    over = (F.col("seq") > at["seq"]) | ((F.col("seq") == at["seq"]) & (F.col("url") > at["url"])) if last["n"] == total else F.lit(False)
    return one.select("url", "host", "seq", F.when(F.col("_r") > per_host, "host_budget").when(over, "total_budget").alias("reason"))


def breaker(results: DataFrame, failures: int = FAILURES) -> DataFrame:
    """Of answers (host, seq, status_code, error_kind) in order: ``skipped`` tells why an answer would not have been asked for,
    null if it was.  A host closes with ``failures`` network errors in a row, any answer starting the count anew, or at once
    with 429 or 503."""
    w = Window.partitionBy("host").orderBy("seq")
    failed = F.col("error_kind").isNotNull()
    r = results.withColumn("_run", F.sum((~failed).cast("int")).over(w))
    streak = F.sum(failed.cast("int")).over(Window.partitionBy("host", "_run").orderBy("seq"))
    why = F.when(F.coalesce(F.col("status_code").isin(429, 503), F.lit(False)), "rate_limited").when(failed & (streak >= failures), "host_unreachable")
    r = r.withColumn("_why", why)
    before = F.first("_why", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("skipped", before).drop("_run", "_why")


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds to wait, from a number or one of the three forms of an HTTP date; one that is past is 0; None if unreadable."""
    text = (value or "").strip()
    if text.isascii() and text.isdigit():
        return float(text)
    words = [w for w in text.replace(",", " ").replace("-", " ").split() if w]
    clock = next((w for w in words if ":" in w), None)
    month = next((_MONTHS.index(w.lower()) + 1 for w in words if w.lower() in _MONTHS), None)
    numbers = [w for w in words if w.isascii() and w.isdigit()]
    if clock is None or month is None or len(numbers) != 2 or len(numbers[1]) not in (2, 4):
        return None
    year = int(numbers[1])
    if len(numbers[1]) == 2:
        year += 1900 if year >= 70 else 2000
    try:
        h, m, s = (int(x) for x in clock.split(":"))
        at = datetime(year, month, int(numbers[0]), h, m, min(s, 59), tzinfo=timezone.utc)
    except ValueError:
        return None
    return max(0.0, (at - now).total_seconds())


def retry_after_udf(now: datetime):
    @F.pandas_udf(T.DoubleType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: retry_after(v, now)).astype("float64")

    return run
