"""A crawl as named DataFrames, built from fetched documents by declarative steps."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.functions import urls as U
from auditloom.plans.staging import stage
from auditloom.sources import html

#: Columns of a finding.
ISSUE = "rule_id string, severity string, category string, url string, group_key string, detail_json string"
FETCH = "url string, status_code int, content_type string, x_robots_tag string, location string, body string, ttfb_ms int, is_internal boolean, in_sitemap boolean, blocked_by_robots boolean, error_kind string"
ROBOTS = "host string, status_code int, content string, blocks_all boolean, sitemap_count int"
SITEMAPS = "url string, status_code int, is_index boolean, is_valid boolean, well_known boolean, parse_error string, url_count long, bytes long, discovered_from string"


@dataclass(frozen=True)
class Crawl:
    """urls: url, status_code, redirect_to, is_internal, in_sitemap, crawl_state, exclusion_reason, error_kind, content_type,
    content_length, ttfb_ms, x_robots_tag, depth.  pages: url with what parsing found, is_indexable and the reason if not.
    links: from_url, to_url, element, nofollow, region, position, text, fragment.  Keys are URLs; there are no ids."""

    urls: DataFrame
    pages: DataFrame
    links: DataFrame | None
    images: DataFrame | None = None
    robots: DataFrame | None = None
    sitemaps: DataFrame | None = None
    base_url: str = ""
    mode: str = "http"
    truncated: bool = False
    discover_sitemaps: bool = True
    config: dict = field(default_factory=dict)
    issues: DataFrame | None = None
    #: started_at, status and rules_version of the run, where they are known.
    run: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.urls.sparkSession

    def with_issues(self, issues: DataFrame) -> Crawl:
        return replace(self, issues=issues)

    @property
    def home(self) -> Column:
        """Whether ``url`` is the home page, with or without its last slash."""
        return F.rtrim(F.col("url"), F.lit("/")) == self.base_url.rstrip("/")

    def inlinks(self) -> DataFrame:
        """(url, internal_links_in): distinct sources over all elements."""
        return self.links.groupBy(F.col("to_url").alias("url")).agg(F.countDistinct("from_url").alias("internal_links_in"))

    def edges(self, *elements: str) -> DataFrame:
        """Links with what is known of their targets; the join that many rules share."""
        t = self.urls.select(F.col("url").alias("to_url"), "status_code", "is_internal", "error_kind", "redirect_to", "content_length")
        links = self.links.where(F.col("element").isin(*elements)) if elements else self.links
        return links.join(t, "to_url")


def indexability(robots: Column, status: Column, is_html: Column, directives: Column, canonical: Column, url: Column) -> Column:
    """The first reason why a page cannot be indexed; null if it can."""
    return (
        F.when(robots, "robots").when(status >= 500, "5xx").when(status >= 400, "4xx").when(status.between(300, 399), "redirect").when(status.isNull() | (status != 200), "4xx")
        .when(~is_html, "not_html").when(directives, "noindex").when(canonical.isNotNull() & (canonical != url), "canonicalised")
    )


def build(fetches: DataFrame, base_url: str, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, fields: set[str] | None = None, **meta) -> Crawl:
    """A crawl from (url, status_code, content_type, x_robots_tag, location, body, ttfb_ms, is_internal, in_sitemap,
    blocked_by_robots, error_kind) rows.  Every page is parsed once: the parsed pages are staged, and all else is read from there.  ``fields`` of the parser leave out others, and links or images with them."""
    f = fetches.withColumns({"redirect_to": U.resolve_udf("url", "location"), "content_length": F.octet_length("body").cast("long")})
    ok_html = F.coalesce(F.lower("content_type").contains("html"), F.lit(False))
    known = f.select(
        "url", "status_code", "redirect_to", "is_internal", "in_sitemap", F.when(F.col("blocked_by_robots"), "excluded").when(F.col("error_kind").isNotNull(), "error").otherwise("done").alias("crawl_state"),
        F.when(F.col("blocked_by_robots"), "robots").alias("exclusion_reason"), "error_kind", "content_type", "content_length", "ttfb_ms", "x_robots_tag",
    )
    parsed = html.parse(f.where(F.col("body").isNotNull() & ok_html).select("url", "status_code", "x_robots_tag", "ttfb_ms", "blocked_by_robots", "body"), html="body", fields=None if fields is None else fields | {"canonical", "meta_robots"}).withColumn("is_html", F.lit(True))
    directives = X.noindex(F.col("meta_robots")) | X.noindex(F.col("x_robots_tag"))
    reason = indexability(F.coalesce("blocked_by_robots", F.lit(False)), F.col("status_code"), F.col("is_html"), directives, F.col("canonical"), F.col("url"))
    pages = stage(parsed.withColumn("indexability_reason", reason).withColumn("is_indexable", F.col("indexability_reason").isNull()), "pages")
    links = images = None
    if "links" in pages.columns:
        each = pages.select(F.col("url").alias("from_url"), F.explode("links").alias("l")).where("l.url IS NOT NULL")
        links = each.select("from_url", F.regexp_replace("l.url", r"#(?!!).*$", "").alias("to_url"), "l.element", F.col("l.nofollow").alias("nofollow"), "l.region", "l.position", "l.text", "l.fragment")
    if "images" in pages.columns:
        images = pages.select(F.col("url").alias("from_url"), F.explode("images").alias("i")).select("from_url", "i.*").withColumn("format", U.image_format(F.col("url")))
    return Crawl(known, pages, links, images, robots, sitemaps, base_url, **meta)


def json_of(**detail: Column) -> Column:
    """Details as text; nulls are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in detail.items()])) if detail else F.lit("{}")


def config_differences(a: dict, b: dict, prefix: str = "") -> list[str]:
    """Dotted paths at which two configurations differ; the rules block is not compared."""
    out = []
    for k in sorted(set(a) | set(b)):
        if not prefix and k == "rules":
            continue
        x, y = a.get(k), b.get(k)
        if isinstance(x, dict) and isinstance(y, dict):
            out += config_differences(x, y, f"{prefix}{k}.")
        elif json.dumps(x, sort_keys=True) != json.dumps(y, sort_keys=True):
            out.append(prefix + k)
    return out
