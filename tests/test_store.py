"""Stores, configuration, late information, sitemap discovery, workbooks, history and streams."""

import json
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.functions.text import status_rank
from auditloom.operators import catalog, diff, history, merge, page_rules, probes, reports, workbook
from auditloom.plans import config, fixtures, store
from auditloom.plans.model import FETCH
from auditloom.sources import files
from auditloom.sources.html import parse_page
from auditloom.streaming import pages as stream


@pytest.fixture(scope="module")
def site(spark, data):
    c = fixtures.crawl(spark, data)
    return c.with_issues(page_rules.evaluate(c.pages))


def test_store_round_trip(spark, site, tmp_path):
    for site_name, name, began in (("a", "c1", "2026-01-01"), ("a", "c2", "2026-01-02"), ("b", "c1", "2026-01-01")):
        store.save(site, f"{tmp_path}/site={site_name}/crawl={name}", began)
    folder = f"{tmp_path}/site=a/crawl=c1"
    again = store.load(spark, folder)
    assert again.base_url == site.base_url and again.run["started_at"] == "2026-01-01"
    assert again.pages.count() == site.pages.count() and again.issues.count() == site.issues.count()
    assert store.identify(spark, folder) == "crawl" and store.identify(spark, str(tmp_path)) == "other"
    got = {tuple(r) for r in store.latest_two(spark, str(tmp_path)).collect()}
    assert got == {("a", "c2", "c1"), ("b", "c1", None)}
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path))
    d = diff.compare(again, store.load(spark, f"{tmp_path}/site=a/crawl=c2"))
    d.write(f"{tmp_path}/diff")
    assert store.identify(spark, f"{tmp_path}/diff") == "diff"
    changes, warnings = diff.read(spark, f"{tmp_path}/diff", ["title_changed"])
    assert changes.count() == 0 and warnings == d.warnings == ()
    store.write_by_project(changes, f"{tmp_path}/hive", "p", "2026-01-01")


def test_warnings(site):
    from dataclasses import replace

    a = replace(site, truncated=True, run={"started_at": "2026-02-01", "rules_version": "1"}, config={"max_urls": 5, "rules": {}})
    b = replace(site, mode="list", base_url="https://fx.example/sub/", robots=None, run={"started_at": "2026-01-01", "rules_version": "2", "status": "failed"}, config={"max_urls": 6, "rules": {"disable": ["HTTP-5XX"]}})
    kinds = [w.split(":")[0] for w in diff.warnings_of(a, b)]
    assert kinds == ["truncated", "unfinished", "order_inverted", "rules_version_changed", "mode_changed", "scope_changed", "config_changed", "missing_table", "rules_config"]


def test_config():
    c = config.parse("max_urls: 10\ninclude_patterns: ['^/a']\nrules:\n  disable: [content-thin]\n")
    assert c.max_urls == 10 and c.as_dict()["include_patterns"] == ["^/a"] and config.parse("").concurrency == 8
    for bad in ("max_url: 1", "max_urls: x", "concurrency: 99", "rules: {disable: [NO-SUCH]}", "- a", "include_patterns: [1]", "max_urls: true"):
        with pytest.raises(ValueError):
            config.parse(bad)
    assert json.dumps(config.schema()) and config.schema()["properties"]["max_urls"] == {"type": "integer"}


def test_merges(spark):
    cols = "url string, seq int, crawl_state string, status_code int, in_sitemap boolean"
    old = spark.createDataFrame([("a", 1, "pending", None, True), ("b", 1, "done", 200, False)], cols)
    new = spark.createDataFrame([("a", 2, "done", 200, False), ("b", 2, None, None, False), ("c", 2, "pending", None, None)], cols)
    got = {r["url"]: tuple(r)[2:] for r in merge.merge_urls(old, new).collect()}
    assert got == {"a": ("done", 200, True), "b": (None, 200, False), "c": ("pending", None, None)}
    p = spark.createDataFrame([("a", 1, "old", "h"), ("a", 2, None, "i")], "url string, seq int, title string, html_hash string")
    assert [tuple(r) for r in merge.replace_pages(p.where("seq = 1"), p.where("seq = 2")).collect()] == [("a", 2, None, "i")]
    r = spark.createDataFrame([("a", "img", None, 1), ("a", None, 5, 2)], "url string, kind string, bytes long, seq int")
    assert [tuple(x) for x in merge.merge_resources(r.where("seq = 1"), r.where("seq = 2")).collect()] == [("a", "img", 5, 2)]


def test_retry_after(spark):
    now = datetime(1994, 11, 6, 8, 49, 0, tzinfo=timezone.utc)
    for text in ("Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "37"):
        assert probes.retry_after(text, now) == 37
    assert probes.retry_after("Sun, 06 Nov 1993 08:49:37 GMT", now) == 0
    assert [probes.retry_after(x, now) for x in (None, "", "soon", "-1", "Sun, 06 Nov 1994")] == [None] * 5
    assert spark.createDataFrame([("5",), (None,)], "v string").select(probes.retry_after_udf(now)("v")).collect()[0][0] == 5


def test_sitemap_discovery(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *u: f"<sitemapindex {ns}>{''.join(f'<sitemap><loc>{x}</loc></sitemap>' for x in u)}</sitemapindex>".encode()
    urls = lambda *u: f"<urlset {ns}>{''.join(f'<url><loc>{x}</loc></url>' for x in u)}</urlset>".encode()
    e = "https://e.com"
    rows = [(f"{e}/i.xml", 200, index(f"{e}/j.xml", f"{e}/a.xml", "https://other.com/x.xml")), (f"{e}/j.xml", 200, index(f"{e}/i.xml", f"{e}/b.xml")), (f"{e}/a.xml", 200, urls(f"{e}/1")), (f"{e}/b.xml", 200, urls(f"{e}/2", f"{e}/1")), (f"{e}/sitemap.xml", 404, b"")]
    answers = spark.createDataFrame(rows, "url string, status_code int, content binary")
    found = files.discover_sitemaps(spark, e + "/", [f"{e}/i.xml"], answers)
    got = {r["url"].removeprefix(e): (r["discovered_from"].removeprefix(e), r["is_valid"]) for r in found.collect()}
    assert got == {"/i.xml": ("robots", True), "/j.xml": ("/i.xml", True), "/a.xml": ("/i.xml", True), "/b.xml": ("/j.xml", True), "/sitemap.xml": ("well_known", False), "/sitemap_index.xml": ("well_known", False)}
    assert {r["url"] for r in files.in_sitemaps(found).collect()} == {f"{e}/1", f"{e}/2"}
    assert files.discover_sitemaps(spark, e + "/", [f"{e}/i.xml"], answers, most=3).count() == 3


def test_exports(spark, site, tmp_path):
    counts = workbook.write(workbook.sheets_of(site), f"{tmp_path}/audit.xlsx")
    assert list(counts)[0] == "summary" and counts["urls"] == site.urls.count()
    with zipfile.ZipFile(f"{tmp_path}/audit.xlsx") as z:
        import xml.etree.ElementTree as ET

        assert len(ET.fromstring(z.read("xl/workbook.xml"))[0]) == len(counts) == 14
        assert len(ET.fromstring(z.read("xl/worksheets/sheet2.xml"))[0]) == counts["urls"] + 1
    reports.export_csv(site, f"{tmp_path}/csv", ["urls", "issues"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/urls").count() == site.urls.count()
    assert "HTTP-5XX" in reports.audit_report(site, site.issues) and "<table>" in reports.html_report(site, site.issues)
    assert reports.number(1234567.5, ".", ",") == "1.234.567,5" and reports.plural(1, "page") == "1 page" and reports.plural(1000, "page") == "1,000 pages"
    assert reports.clipped("a\x1b[31mb​" + "c" * 300) == "a[31mb" + "c" * 248 + "…"


def test_history(spark, site, tmp_path):
    for seconds in (2.0, 1.0):
        history.append(history.collect(spark, "t", 8, f"at {seconds}", seconds, site.pages, site.links, site.images, 100.0), f"{tmp_path}/h")
    r = history.best(spark, f"{tmp_path}/h").first()
    assert (r["target"], r["runs"], r["started_at"]) == ("t", 2, "at 1.0")
    assert history.passes(spark.read.schema(history.SCHEMA).json(f"{tmp_path}/h")).first()["missed"] == ["elements", "pages"]


def test_findings_over_the_site(spark, site):
    f = {r["rule_id"]: r for r in reports.findings_summary(site.issues, site.pages.count()).collect()}
    assert f["CONTENT-THIN"]["findings"] == f["CONTENT-THIN"]["pages"] >= 1
    assert reports.urls_of_rule(site.issues, "CONTENT-THIN").count() == f["CONTENT-THIN"]["findings"]
    assert reports.base_mismatch(site).count() == 0 and reports.first_error(site).first()["status_code"] >= 400
    card = reports.inspect(site, "/p1")
    assert card["url"].first()["url"] == "https://fx.example/p1" and card["page"].count() == 1 and card["inlinks"].count() >= 1
    assert reports.suggestions(site, "https://fx.example/p4x").first() is not None
    assert catalog.audit(site, {"HTTP-5XX"}).count() >= 1


def test_streams(spark, data, tmp_path):
    fixtures.table(spark, data, "fxf", FETCH).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    watch = stream.Progress()
    spark.streams.addListener(watch)
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream.write_findings(source, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    spark.streams.removeListener(watch)
    want = fixtures.crawl(spark, data).pages
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.groupBy("rule_id").count().orderBy("rule_id").collect() == page_rules.evaluate(want).groupBy("rule_id").count().orderBy("rule_id").collect()
    assert sum(n for _, n, _ in watch.samples) == spark.read.parquet(f"{tmp_path}/in").where("body IS NOT NULL").count()
    urls = stream.discovered(spark.read.parquet(f"{tmp_path}/in")).count()
    assert urls > 0
    spark.createDataFrame([("a", 1, 200), ("a", 2, None), ("b", 1, 404)], "url string, seq int, status_code int").write.parquet(f"{tmp_path}/states")
    states = spark.readStream.schema("url string, seq int, status_code int").parquet(f"{tmp_path}/states")
    stream.upsert(states, f"{tmp_path}/urls", f"{tmp_path}/cp2", available_now=True).awaitTermination()
    assert {tuple(r) for r in stream.latest(spark, f"{tmp_path}/urls").collect()} == {("a", 2, 200), ("b", 1, 404)}


def test_frontier_and_throttle(spark):
    f = spark.createDataFrame([(f"u{i}", "h" if i < 5 else "k", i % 2, i) for i in range(8)], "url string, host string, depth int, seq int")
    slots = spark.createDataFrame([("h", 2), ("k", 1)], "host string, slots int")
    assert sorted(r["url"] for r in stream.next_to_fetch(f, slots).collect()) == ["u0", "u2", "u6"]
    rows = [("h", i, 503 if i < 3 else 200, None, 7.0 if i == 0 else None) for i in range(23)] + [("slow", 0, 200, None, None)]
    got = {(r["host"], r["seq"]): (r["slots"], r["pause_s"]) for r in stream.throttle(spark.createDataFrame(rows, "host string, seq long, status_code int, error_kind string, retry_after double"), delays={"slow": 2.0}).collect()}
    assert got["h", 0] == (8, 7.0) and got["h", 2][0] == 4 and got["h", 22][0] == 5 and got["slow", 0] == (1, 2.0)
    assert [stream.stop_reason(5, 1, 1, max_urls=5), stream.stop_reason(1, 9, 1, max_seconds=9), stream.stop_reason(1, 1, 3, max_depth=2), stream.stop_reason(1, 1, 1, pending_429=True), stream.stop_reason(1, 1, 1)] == ["max_urls", "max_duration", "max_depth", "rate_limited", None]


def test_sources(spark, tmp_path):
    (tmp_path / "dist" / "sub").mkdir(parents=True)
    (tmp_path / "dist" / "index.html").write_text("<title>t</title>")
    (tmp_path / "dist" / "sub" / "a.html").write_text("<p>x</p>")
    got = {r["url"]: r["content_type"] for r in files.read_site(spark, f"{tmp_path}/dist", "https://e.com").collect()}
    assert got == {"https://e.com/": "text/html", "https://e.com/sub/a.html": "text/html"}
    names = spark.createDataFrame([("index.html",), ("sub/a.html",)], "file string")
    asked = spark.createDataFrame([("https://e.com/",), ("https://e.com/sub/a",), ("https://e.com/no",)], "url string")
    assert {r["url"]: r["file"] for r in files.resolve_files(asked, names).collect()} == {"https://e.com/": "index.html", "https://e.com/sub/a": "sub/a.html"}
    (tmp_path / "list.txt").write_text("# list\nhttps://e.com\n\nhttps://e.com/\nnot a url\n")
    assert [r["url"] for r in files.read_url_list(spark, f"{tmp_path}/list.txt").collect()] == ["https://e.com/"]


def test_url_functions(spark):
    df = spark.createDataFrame([("https://e.com/a%20b", 200), ("mailto:x@e.com", None), ("http://127.0.0.1/", 503)], "u string, s int")
    got = df.select(U.is_crawlable(F.col("u")).alias("c"), status_rank(F.col("s")).alias("r"), U.allowed(F.col("u"), ["e\\.com"], ["^mailto"]).alias("a"), U.url_hash_udf("u").alias("h"), U.public_udf(U.host(F.col("u"))).alias("p")).collect()
    assert [(x["c"], x["r"], x["a"], x["p"]) for x in got] == [(True, 1, True, True), (False, 5, False, False), (True, 4, False, False)]
    assert got[0]["h"] == U.url_hash("https://e.com/a%20b")
    assert U.percent_decode("a%20b%zz%C3%A1") == "a b%zzá"
    page = "https://e.com/a/b?q#f"
    assert [U.resolve_light(h, page) for h in ("x", "../x", "/y?z", "//o.com/p", "?k", "#t", "http://n/")] == ["https://e.com/a/x", "https://e.com/x", "https://e.com/y?z", "https://o.com/p", "https://e.com/a/b?k", "https://e.com/a/b?q", "http://n/"]


@pytest.mark.parametrize(
    "html, words, closed, outside",
    [
        ("bare text", 2, '#text "bare text"', []),
        ("<html><head><title>x</title><body><p>one two three", 3, "<body>", []),
        ("<html><head><title>x</title></head>stray<body>one</body></html>", 2, "<body>", []),
        ("<html><head><img src='/p.png'><meta name=description content=d></head><body>one</body>", 1, '<img src="/p.png">', ["meta description"]),
        ("<head><noscript><p>x</p></noscript><link rel=canonical href=/></head><body>a<nav>b</nav><script>c</script><aside>d</aside></body>", 2, "<body>", []),
        ("<!-- c --><?xml?><!doctype html><html><head></head><body><title>t</title></body></html>", 1, "<body>", ["title"]),
    ],
)
def test_head_and_body(html, words, closed, outside):
    got = parse_page(html, "https://e.com/")
    assert (got["word_count"], got["closed_by"], got["outside_head"]) == (words, closed, outside)


def test_entities():
    from auditloom.functions.constants import NAMED_ENTITIES
    from auditloom.sources.html import decode_entities

    import html as std

    for name in NAMED_ENTITIES:
        assert decode_entities(f"x&{name};y") == f"x{std.unescape(f'&{name};')}y"
    for kept in ("&ccedil;", "&pound;", "&amp", "&copy=1", "&;", "&#;", "&unknown;"):
        assert decode_entities(kept) == kept
    assert decode_entities("&#65;&#x42;") == "AB"
    assert parse_page('<a href="/?a=1&copy=2">x</a>', "https://e.com/")["links"][0]["url"] == "https://e.com/?a=1&copy=2"
    assert parse_page("<a href='/x#café &quot;b'>x</a>", "https://e.com/")["links"][0]["fragment"] == "caf%C3%A9%20%22b"


def test_fields_that_are_not_asked_for():
    page = "<html><head><title>t</title></head><body><a href='/x'>l</a><img src='/i'>words here</body></html>"
    full, few = parse_page(page, "https://e.com/"), parse_page(page, "https://e.com/", frozenset({"title", "word_count"}))
    assert few["title"] == full["title"] and few["word_count"] == full["word_count"] == 3 and "text_minhash" not in few and full["content_ratio"] > 0


def test_the_widths_of_a_title(spark):
    from auditloom.functions.text import pixel_width

    # by hand: W 944, i 222, blank 278, a 556, at 20 pixels an em
    df = spark.createDataFrame([("WW",), ("iii i",), (" a ",)], "t string")
    assert [round(r[0], 3) for r in df.select(pixel_width(F.col("t"), 20.0)).collect()] == [37.76, 23.32, 11.12]


def test_every_rule_fires_on_the_site(spark, data, site):
    from auditloom import catalog_queries

    fired = {r["rule_id"] for r in catalog_queries.QUERIES["audit_site"](spark, "/root/testdata/sf0.01").select("rule_id").collect()}
    assert fired == set(fixtures.PAGE_RULES) | set(fixtures.SITE_RULES)
    assert {r.id for r in page_rules.RULES} == set(fixtures.PAGE_RULES)
