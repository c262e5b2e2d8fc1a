"""Pages as a stream: parsed and judged as they arrive, late information merged, hosts throttled by replay."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from auditloom.operators import page_rules
from auditloom.operators.merge import newest_urls
from auditloom.plans.model import indexability
from auditloom.functions import text as X
from auditloom.sources import html


def findings(fetches: DataFrame) -> DataFrame:
    """Page-rule findings of a batch or a stream of fetches; stateless, so a stream needs no watermark."""
    p = html.parse(fetches.where("body IS NOT NULL").select("url", "status_code", "x_robots_tag", "ttfb_ms", "body"), html="body").withColumn("is_html", F.lit(True))
    directives = X.noindex(F.col("meta_robots")) | X.noindex(F.col("x_robots_tag"))
    reason = indexability(F.lit(False), F.col("status_code"), F.col("is_html"), directives, F.col("canonical"), F.col("url"))
    return page_rules.evaluate(p.withColumn("indexability_reason", reason).withColumn("is_indexable", F.col("indexability_reason").isNull()))


def write_findings(fetches: DataFrame, out: str, checkpoint: str, seconds: int = 2, available_now: bool = False) -> StreamingQuery:
    """Append findings as Parquet; a restart goes on from the checkpoint."""
    w = findings(fetches).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")).start()


def discovered(fetches: DataFrame) -> DataFrame:
    """URLs that pages lead to, each once (the state holds what was seen)."""
    p = html.parse(fetches.where("body IS NOT NULL").select("url", "body"), html="body")
    return p.select(F.explode("links.url").alias("url")).where("url IS NOT NULL").dropDuplicates(["url"])


def upsert(fetches: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Late information of a stream of URL states (with ``seq``) merged into a table, micro-batch by micro-batch: every batch
    writes a new version beside the old one, and the number of the last whole version is its folder's name."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, folder)
        both = newest_urls(batch if old is None else old.unionByName(batch))
        both.write.mode("overwrite").parquet(f"{folder}/v={n}")

    w = fetches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")).start()


def latest(spark, folder: str) -> DataFrame | None:
    """The newest whole version that ``upsert`` has written."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    whole = [int(x[2:]) for x in names if x.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/_SUCCESS"))]
    return spark.read.parquet(f"{folder}/v={max(whole)}") if whole else None


class Progress(StreamingQueryListener):
    """Samples of a running query: (batch, rows, rows a second), the last ``keep`` of them."""

    def __init__(self, keep: int = 100):
        self.samples: deque[tuple[int, int, float]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.samples.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryTerminated(self, event) -> None:
        pass


def stop_reason(urls: int, seconds: float, depth: int, max_urls: int | None = None, max_seconds: float | None = None, max_depth: int | None = None, pending_429: bool = False) -> str | None:
    """Why a crawl that has come so far is cut off, or None."""
    if max_urls is not None and urls >= max_urls:
        return "max_urls"
    if max_seconds is not None and seconds >= max_seconds:
        return "max_duration"
    if max_depth is not None and depth > max_depth:
        return "max_depth"
    return "rate_limited" if pending_429 else None


def next_to_fetch(frontier: DataFrame, capacity: DataFrame) -> DataFrame:
    """Of the waiting URLs (url, host, depth, seq), of each host as many as it may take now (host, slots), shallowest and
    oldest first."""
    w = Window.partitionBy("host").orderBy("depth", "seq", "url")
    return frontier.join(capacity, "host").withColumn("_r", F.row_number().over(w)).where("_r <= slots").drop("_r", "slots")


def throttle(results: DataFrame, ceiling: int = 8, delays: dict[str, float] | None = None) -> DataFrame:
    """Replay of each host's answers (host, seq, status_code, error_kind, retry_after) in order: three overloads halve the
    slots, twenty good answers in a row add one, a Retry-After pauses.  Adds slots and pause_s after each answer.  Hosts with
    a crawl delay (``delays``, in seconds) are asked one at a time, with that pause at least.

    The machine's state is three numbers, so a host's answers pass in batches and are never held together."""
    start = ceiling
    cols = results.select("host", "seq", "status_code", "error_kind", "retry_after")
    schema = "host string, seq long, status_code int, error_kind string, retry_after double, slots int, pause_s double"
    ordered = cols.repartition("host").sortWithinPartitions("host", "seq")

    def by_host(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, tuple[int, int, int]] = {}
        for b in batches:
            parts = []
            for host, df in b.groupby("host", sort=False):
                delay = (delays or {}).get(host, 0.0)
                slots, bad, good = state.get(host, (1 if delay else start, 0, 0))
                rows = []
                for r in df.itertuples(index=False):
                    code = None if pd.isna(r.status_code) else int(r.status_code)
                    overload = code in (429, 503) or r.error_kind in ("timeout", "connection")
                    bad, good = (bad + 1, 0) if overload else (0, good + 1)
                    if bad == 3:
                        slots, bad = max(1, slots // 2), 0
                    if good == 20:
                        slots, good = min(1 if delay else ceiling, slots + 1), 0
                    rows.append((slots, max(delay, float(r.retry_after) if overload and not pd.isna(r.retry_after) else 0.0)))
                state = {host: (slots, bad, good)}  # hosts come one after the other
                parts.append(df.assign(slots=[a for a, _ in rows], pause_s=[p for _, p in rows]))
            if parts:
                yield pd.concat(parts)

    return ordered.mapInPandas(by_host, schema)
