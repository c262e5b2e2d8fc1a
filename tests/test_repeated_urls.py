"""Tables in which URLs come more than once: every query gives the rows of its SQL there too."""

import duckdb
import pytest

from auditloom import catalog_queries
from auditloom.operators import site_rules
from auditloom.plans import derived
from tests.oracle import same


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """900 pages of sf0.1, two in three under the URL of an earlier one, with entities in titles and titles in common."""
    out = tmp_path_factory.mktemp("repeated")
    title = "CASE WHEN a.page_id % 5 = 2 THEN '<title>&amp;&amp; ' WHEN a.page_id % 5 = 3 THEN '<title>Common ' || b.page_id % 9 || '</title><title>' ELSE '<title>' END"
    q = f"""SELECT a.page_id, b.url, replace(a.html, '<title>', {title}) AS html
    FROM '/root/testdata/sf0.1/pages.parquet' a JOIN '/root/testdata/sf0.1/pages.parquet' b ON b.page_id = CASE WHEN a.page_id % 3 > 0 THEN (a.page_id * 11) % 140 ELSE a.page_id END WHERE a.page_id < 900"""
    duckdb.sql(f"COPY ({q}) TO '{out}/pages.parquet' (FORMAT parquet)")
    return str(out)


def agrees(spark, name, folder):
    same(catalog_queries.QUERIES[name](spark, folder), catalog_queries.ORACLE_SQL[name], folder)


@pytest.mark.parametrize("name", ["index_robots_blocked", "index_blocked_in_sitemap"])
def test_blocked(spark, folder, name):
    agrees(spark, name, folder)


def test_merge(spark, folder):
    agrees(spark, "merge_urls", folder)


def test_written_titles(spark, folder):
    agrees(spark, "page_meta_title_too_short", folder)


@pytest.mark.parametrize("name", ["diff_issues", "diff_gate", "portfolio_changes", "issue_summary_view", "portfolio_severity", "persisted_pairs"])
def test_findings(spark, folder, name):
    agrees(spark, name, folder)


def test_one_finding_a_target(spark, folder):
    """A URL with two answers of the 4xx class is two rows of the query and one finding."""
    c = derived.crawl(spark, folder)
    two = c.urls.where("is_internal").limit(1).select("url").first()["url"]
    from dataclasses import replace

    urls = spark.createDataFrame([(two, s, True, None, None, None) for s in (404, 410)], "url string, status_code int, is_internal boolean, error_kind string, redirect_to string, content_length long")
    links = spark.createDataFrame([("p", two, "a")], "from_url string, to_url string, element string")
    r, c = site_rules.by_id("HTTP-404-INTERNAL"), replace(c, urls=urls, links=links)
    assert r.query(c).count() == 2 and [x["url"] for x in r.evaluate(c).collect()] == [two]


@pytest.mark.parametrize("name", ["broken_links_view", "http_redirect_chain", "http_redirect_to_404", "http_redirect_loop"])
def test_redirects(spark, folder, name):
    agrees(spark, name, folder)


def test_changed_pages(spark, folder):
    agrees(spark, "diff_pages", folder)


def test_a_changed_canonical_is_found(spark):
    from auditloom.operators import diff
    from auditloom.plans.model import Crawl

    cols = "url string, canonical string, title string, indexability_reason string"
    a = spark.createDataFrame([("u", "x", "t", None), ("v", "v", "t", None), ("v", "w", "t", None), ("n", None, "t", None)], cols)
    b = spark.createDataFrame([("u", "y", "t", None), ("v", "w", "t", None), ("v", "v", "t", None), ("n", "n", "t", None)], cols)
    got = sorted(tuple(r)[:4] for r in diff.page_changes(Crawl(a, a, None), Crawl(b, b, None)).collect())
    assert got == [("canonical_changed", "n", None, "n"), ("canonical_changed", "u", "x", "y")]
