"""Site rules ask the parser for what they read alone, comments cost next to nothing, and an index is one pass."""

from html.parser import HTMLParser

from auditloom.operators import catalog, page_rules, reports, site_rules
from auditloom.plans import fixtures
from auditloom.sources.html import parse_page


def test_plain_comments_are_one_step(monkeypatch):
    calls, parse = [], HTMLParser.parse_comment
    monkeypatch.setattr(HTMLParser, "parse_comment", lambda self, i, report=1: calls.append(i) or parse(self, i, report))
    got = parse_page("<p>a" + "<!-- padding -->" * 1000 + "b c<!-- a - b --><!-->d</p>", None)
    assert len(calls) < 10 and got["word_count"] == 2  # a comment parts no words


def test_site_rules_need_only_their_fields(spark, data):
    full = fixtures.crawl(spark, data)
    for id in ("HREFLANG-TO-4XX", "ASSET-IFRAME-BROKEN", "META-DESC-DUPLICATE", "HREFLANG-NOT-RECIPROCAL", "LINK-FRAGMENT-BROKEN", "SOCIAL-OG-IMAGE-BROKEN"):
        c = fixtures.crawl(spark, data, site_rules.fields({id}))
        assert not {"text_minhash", "body_text", "images"} & set(c.pages.columns)
        r = site_rules.by_id(id)
        assert sorted(map(tuple, r.evaluate(c).collect())) == sorted(map(tuple, r.evaluate(full).collect()))
    assert catalog.fields({"HTTP-5XX", "HREFLANG-TO-4XX"}) == page_rules.fields({"HTTP-5XX"}) | {"hreflang"}


def test_an_index_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([("u", "One one", "two"), ("v", None, "ÚNO two")], "url string, title string, body string").write.parquet(f"{tmp_path}/p")
    idx = reports.index(spark.read.parquet(f"{tmp_path}/p"), "url", "title", "body")
    assert idx._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(map(tuple, idx.collect())) == [("one", "title", "u"), ("two", "body", "u"), ("two", "body", "v"), ("uno", "body", "v")]
