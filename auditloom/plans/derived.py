"""Crawl relations derived from the driver's ``pages`` by arithmetic, in SQL that Spark and other engines read alike.

The corpus has no statuses, redirects or links between its pages; these do, so that site rules have something to find
and an oracle to be held against.  ``fx_*`` have numbers as keys; ``cu``, ``cl`` and ``cp`` (urls, links, pages) have URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.plans.model import Crawl

FX = """
fx_urls AS (
SELECT CAST(page_id AS BIGINT) AS id, regexp_replace(url, '#.*$', '') AS url,
  CASE WHEN page_id % 10 = 9 THEN 0 ELSE 1 END AS is_internal,
  CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS in_sitemap,
  CASE WHEN page_id % 41 = 13 THEN 'excluded' ELSE 'done' END AS crawl_state,
  CASE WHEN page_id % 41 = 13 THEN 'robots' END AS exclusion_reason,
  CASE WHEN page_id % 41 = 13 THEN NULL WHEN page_id % 29 = 7 THEN 301 WHEN page_id % 37 = 11 THEN 302
       WHEN page_id % 23 = 5 THEN 404 WHEN page_id % 31 = 3 THEN 500 WHEN page_id % 43 = 9 THEN 403 ELSE 200 END AS status_code,
  CASE WHEN page_id % 41 = 13 THEN NULL WHEN page_id % 58 = 7 THEN (page_id + 29) % (SELECT count(*) FROM pages)
       WHEN page_id % 29 = 7 THEN page_id - page_id % 23 + 5
       WHEN page_id % 37 = 11 THEN CASE WHEN page_id % 74 = 11 THEN page_id + 37 ELSE page_id - 37 END END AS redirect_to,
  CAST(100 + (page_id * 7919) % 400000 AS BIGINT) AS content_length, CAST((page_id * 37) % 1500 AS INT) AS ttfb_ms
FROM pages),
fx_links AS (
SELECT p.page_id AS from_id,
  CASE WHEN t.k = 0 AND p.page_id % 20 <> 19 THEN p.page_id + 1 ELSE (p.page_id * 3 + t.k * t.k * 17) % (SELECT count(*) FROM pages) END AS to_id,
  CASE WHEN t.k < 2 THEN 'a' WHEN t.k = 2 THEN 'img' WHEN t.k = 3 THEN 'script' ELSE 'link' END AS element,
  CASE WHEN t.k = 1 AND p.page_id % 9 = 0 THEN 1 ELSE 0 END AS is_nofollow, t.k AS position
FROM pages p CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS t(k)
WHERE p.page_id + 1 < (SELECT count(*) FROM pages) AND NOT (t.k >= 2 AND p.page_id % 5 <> 0)
  AND NOT (t.k = 1 AND (p.page_id % 2 = 1 OR (p.page_id * 3 + 17) % (SELECT count(*) FROM pages) % 20 = 0))),
cu AS (
SELECT u.url, u.is_internal = 1 AS is_internal, u.in_sitemap = 1 AS in_sitemap, u.crawl_state, u.exclusion_reason, CAST(u.status_code AS INT) AS status_code,
  CASE WHEN u.redirect_to IS NOT NULL THEN coalesce(t.url, concat('https://missing.invalid/', CAST(u.redirect_to AS VARCHAR(20)))) END AS redirect_to,
  u.content_length, u.ttfb_ms, CAST(NULL AS VARCHAR(20)) AS error_kind
FROM fx_urls u LEFT JOIN fx_urls t ON t.id = u.redirect_to),
cl AS (
SELECT f.url AS from_url, t.url AS to_url, l.element, l.is_nofollow = 1 AS nofollow, l.position
FROM fx_links l JOIN fx_urls f ON f.id = l.from_id JOIN fx_urls t ON t.id = l.to_id),
cp AS (
SELECT u.url, regexp_extract(p.html, '<title>(.*?)</title>', 1) AS title, CASE WHEN p.page_id % 7 = 2 THEN c.url ELSE u.url END AS canonical,
  CASE WHEN p.page_id % 11 = 4 THEN 'noindex, follow' END AS meta_robots, md5(substr(p.html, 200, 40)) AS html_hash,
  (u.status_code = 200 AND NOT (p.page_id % 11 = 4) AND NOT (p.page_id % 7 = 2)) AS is_indexable,
  CASE WHEN u.status_code >= 500 THEN '5xx' WHEN u.status_code >= 400 THEN '4xx' WHEN u.status_code >= 300 THEN 'redirect'
       WHEN p.page_id % 11 = 4 THEN 'noindex' WHEN p.page_id % 7 = 2 THEN 'canonicalised' END AS indexability_reason, CAST(u.status_code AS INT) AS status_code
FROM pages p JOIN fx_urls u ON u.id = p.page_id LEFT JOIN fx_urls c ON c.id = (p.page_id * 3 + 1) % (SELECT count(*) FROM pages)
WHERE u.status_code IS NOT NULL AND p.page_id % 13 <> 12)"""

#: The later crawl, from the earlier one by other residues of the URL's length.
AFTER = """
cu2 AS (SELECT url, is_internal, in_sitemap, crawl_state, exclusion_reason, CAST(CASE WHEN length(url) % 19 = 4 THEN 404 ELSE status_code END AS INT) AS status_code, redirect_to, content_length, ttfb_ms, error_kind FROM cu WHERE length(url) % 17 <> 3),
cp2 AS (SELECT url, CASE WHEN length(url) % 5 = 1 THEN concat(title, '!') ELSE title END AS title, canonical, meta_robots, html_hash,
  CASE WHEN length(url) % 7 = 3 THEN FALSE ELSE is_indexable END AS is_indexable, CASE WHEN length(url) % 7 = 3 THEN 'noindex' ELSE indexability_reason END AS indexability_reason, status_code FROM cp WHERE length(url) % 17 <> 3)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return spark.sql(f"WITH pages AS (SELECT * FROM {{raw}}), {FX}, {AFTER} SELECT * FROM {name}", raw=pages)


def home(spark: SparkSession, sf_dir: str) -> str:
    """The URL of page 0."""
    got = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id = 0").select(F.regexp_replace("url", "#.*$", "")).first()
    return got[0] if got else ""


def crawl(spark: SparkSession, sf_dir: str, after: bool = False) -> Crawl:
    t = lambda n: table(spark, sf_dir, n)
    return Crawl(t("cu2" if after else "cu"), t("cp2" if after else "cp"), t("cl"), base_url=home(spark, sf_dir))
