"""Other sources: built sites on disk, URL lists, robots files and sitemaps."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from io import BytesIO
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.functions.html_text import plain_location
from auditloom.functions.urls import normalize
from auditloom.plans.staging import stage

SITEMAP_BYTES = 64 << 20
CRAWL_DELAY_MAX = 30.0


def read_site(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """A built site as fetches: every file below ``folder`` with the URL that it answers to (an index file to its folder's)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.escape(folder.rstrip("/").removeprefix("file://"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), rf"^.*?{root}/", "")
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(rel, r"(^|/)index\.html$", "$1"))
    kind = U.content_type(rel)
    body = F.when(kind == "text/html", F.decode("content", "UTF-8"))
    return files.select(
        url.alias("url"), F.lit(200).alias("status_code"), kind.alias("content_type"), F.lit(None).cast("string").alias("x_robots_tag"), F.lit(None).cast("string").alias("location"),
        body.alias("body"), F.lit(None).cast("int").alias("ttfb_ms"), F.lit(True).alias("is_internal"), F.lit(False).alias("in_sitemap"), F.lit(False).alias("blocked_by_robots"), F.lit(None).cast("string").alias("error_kind"),
    )


def resolve_files(urls: DataFrame, files: DataFrame) -> DataFrame:
    """(url, file): for each URL path the exact file, else its index, else with ``.html``; one join over all candidates."""
    p = F.regexp_replace(U.path(F.col("url")), "^/", "")
    trimmed = F.rtrim(p, F.lit("/"))
    cands = F.array(F.struct(F.lit(0).alias("r"), p.alias("f")), F.struct(F.lit(1).alias("r"), F.concat(trimmed, F.when(trimmed == "", "").otherwise("/"), F.lit("index.html")).alias("f")), F.struct(F.lit(2).alias("r"), F.concat(trimmed, F.lit(".html")).alias("f")))
    each = urls.select("url", F.explode(cands).alias("c")).where(~F.col("c.f").contains(".."))
    hit = each.join(files.select(F.col("file").alias("f")), F.col("c.f") == F.col("f"))
    return hit.groupBy("url").agg(F.min("c").alias("c")).select("url", F.col("c.f").alias("file"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and comments apart, normalized, each once.  A crawl of a list follows no links: build it
    with ``mode="list"`` and ``truncated=True``, for its link graph is never whole."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url != '' AND NOT startswith(url, '#')")
    return lines.select(U.normalize_udf("url").alias("url")).where("url IS NOT NULL").distinct()


class Robots:
    """A robots file for one agent: the most specific group, the longest matching rule, allowing rules before equal others."""

    def __init__(self, text: str, agent: str = "*"):
        groups: dict[str, list[tuple[bool, str]]] = {}
        delays: dict[str, float] = {}
        self.sitemaps: list[str] = []
        names: list[str] = []
        fresh = True
        for line in text.splitlines():
            key, _, value = line.partition("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "sitemap" and value:
                self.sitemaps.append(value)
            elif key == "user-agent":
                names = [value.lower()] if not fresh or not names else [*names, value.lower()]
                fresh = True
                groups.setdefault(value.lower(), [])
            elif key in ("allow", "disallow") and names:
                fresh = False
                for n in names:
                    if value:
                        groups[n].append((key == "allow", value))
            elif key == "crawl-delay" and names:
                fresh = False
                try:
                    delays |= {n: min(float(value), CRAWL_DELAY_MAX) for n in names}
                except ValueError:
                    pass
        own = max((n for n in groups if n != "*" and n in agent.lower()), key=len, default="*")
        self.rules, self.delay = groups.get(own, []), delays.get(own)

    def allows(self, path: str) -> bool:
        best = (0, True)
        for allow, pattern in self.rules:
            rx = "".join(".*" if ch == "*" else re.escape(ch) for ch in pattern.rstrip("$")) + ("$" if pattern.endswith("$") else "")
            if re.match(rx, path or "/"):
                best = max(best, (len(pattern), allow))
        return best[1]

    @property
    def blocks_all(self) -> bool:
        return not self.allows("/") and not any(a for a, _ in self.rules)


def parse_robots(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, status_code, content) rows with blocks_all, crawl_delay, sitemaps and sitemap_count added."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rs = [Robots(t or "", agent) for t in b["content"]]
            yield b.assign(blocks_all=[r.blocks_all for r in rs], crawl_delay=[r.delay for r in rs], sitemaps=[r.sitemaps for r in rs], sitemap_count=[len(r.sitemaps) for r in rs])

    return robots.select("host", "status_code", "content").mapInPandas(run, "host string, status_code int, content string, blocks_all boolean, crawl_delay double, sitemaps array<string>, sitemap_count int")


def sitemap(data: bytes | None) -> tuple[bool, list[str], str | None]:
    """(is an index, locations, error): plain or gzip; locations of images, videos and news are none; what was read before an
    error counts."""
    raw = data or b""
    try:
        if raw[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=BytesIO(raw)) as f:
                raw = f.read(SITEMAP_BYTES + 1)
            if len(raw) > SITEMAP_BYTES:
                return False, [], "too_large"
    except OSError:
        return False, [], "gzip"
    found, is_index, stack, error = [], False, [], None
    parser = ET.XMLPullParser(["start", "end"])
    try:
        parser.feed(raw)
        parser.close()
    except ET.ParseError:
        error = "xml"
    try:
        for event, e in parser.read_events():
            name = plain_location(e.tag)
            if event == "start":
                stack.append(name)
                is_index = is_index or name == "sitemapindex"
            else:
                stack.pop()
                if name == "loc" and stack[-1:] in (["url"], ["sitemap"]) and (e.text or "").strip():
                    found.append(e.text.strip())
                e.clear()
    except ET.ParseError:
        error = "xml"
    if not error and not found and not raw.strip():
        error = "empty"
    return is_index, found, error


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """(url, status_code, content, well_known, discovered_from) rows to sitemap rows with their locations."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sitemap(x) for x in b["content"]]
            locs = [[n for u in found if (n := normalize(u))] for _, found, _ in got]
            yield pd.DataFrame({"url": b["url"], "status_code": b["status_code"], "is_index": [i for i, _, _ in got], "is_valid": [e is None for *_, e in got], "well_known": b["well_known"], "parse_error": [e for *_, e in got], "url_count": [len(x) for x in locs], "bytes": [len(x or b"") for x in b["content"]], "discovered_from": b["discovered_from"], "locations": locs})

    return files.mapInPandas(run, "url string, status_code int, is_index boolean, is_valid boolean, well_known boolean, parse_error string, url_count long, bytes long, discovered_from string, locations array<string>")


WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml")
MOST_SITEMAPS = 5000


def discover_sitemaps(spark: SparkSession, base_url: str, announced: list[str], answers: DataFrame, most: int = MOST_SITEMAPS) -> DataFrame:
    """Sitemap rows, from those that robots.txt announces and the well-known places through all indexes, each once, of the
    site's own only, ``most`` documents at most.  ``answers`` (url, status_code, content) is what fetching would bring.

    A level of indexes is one join and one parse; the list of names, bounded by ``most``, is the driver's."""
    site = urlsplit(base_url).netloc.lower()
    own = lambda u: urlsplit(u).netloc.lower() == site
    known = [normalize(p, base_url) for p in WELL_KNOWN]
    todo = list(dict.fromkeys(u for u in [*(normalize(a, base_url) for a in announced), *known] if u and own(u)))
    seen, origin, out = set(), {u: ("well_known" if u in known and u not in announced else "robots") for u in todo}, None
    while todo and len(seen) < most:
        todo = todo[: most - len(seen)]
        seen |= set(todo)
        asked = spark.createDataFrame([(u, u in known and origin[u] == "well_known", origin[u]) for u in todo], "url string, well_known boolean, discovered_from string")
        rows = stage(parse_sitemaps(asked.join(answers, "url", "left").select("url", "status_code", "content", "well_known", "discovered_from")), "sitemaps")
        out = rows if out is None else out.unionByName(rows)
        found = rows.where("is_index").select("url", F.explode("locations").alias("child")).groupBy("child").agg(F.min("url").alias("parent")).orderBy("child").limit(most).collect()
        todo = [r["child"] for r in found if own(r["child"]) and r["child"] not in seen]
        origin |= {r["child"]: r["parent"] for r in found}
    return out if out is not None else parse_sitemaps(answers.limit(0).selectExpr("url", "status_code", "content", "false AS well_known", "'' AS discovered_from"))


def in_sitemaps(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.where("NOT is_index").select(F.explode("locations").alias("url")).distinct()
