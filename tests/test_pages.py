"""Rules over hand-written pages: what must fire fires, a sound page stays silent."""

import pytest

from auditloom.functions.urls import is_public_address, normalize
from auditloom.operators import page_rules, site_rules
from auditloom.plans.model import FETCH, build
from auditloom.sources.files import Robots, sitemap
from auditloom.sources.html import minhash, parse_page

TEXT = "Plain words that fill the page so that it is not thin. " * 40
SOUND = f"""<html lang="en"><head><title>A sound title of the proper length here</title><meta name="description" content="A description that is long enough to be shown in full below a result, with words.">
<meta name="viewport" content="width=device-width"><link rel="canonical" href="https://ex.com/"><link rel="alternate" hreflang="en" href="https://ex.com/"><link rel="alternate" hreflang="es" href="https://ex.com/es/">
<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="https://ex.com/o.png"></head>
<body><main><h1>Head</h1><h2>Next</h2><p>{TEXT}</p><a href="/about">About us</a><img src="/i.png" alt="An image"></main></body></html>"""


def crawl(spark, **pages):
    rows = [(u if u.startswith("http") else f"https://ex.com{u}", 200, "text/html", None, None, h, 100, True, True, False, None) for u, h in pages.items()]
    return build(spark.createDataFrame(rows, FETCH), "https://ex.com/")


def fired(spark, html, url="/"):
    return {r["rule_id"] for r in page_rules.evaluate(crawl(spark, **{url: html}).pages).select("rule_id").collect()}


def test_a_sound_page_is_silent(spark):
    assert fired(spark, SOUND) == set()


@pytest.mark.parametrize(
    "rule, change",
    [
        ("META-TITLE-MISSING", ("A sound title of the proper length here", "")),
        ("META-TITLE-TOO-SHORT", ("A sound title of the proper length here", "Short")),
        ("META-TITLE-TOO-LONG", ("A sound title of the proper length here", "W" * 40)),
        ("META-TITLE-MULTIPLE", ("</title>", "</title><title>Another</title>")),
        ("META-DESC-TOO-SHORT", ("A description that is long enough to be shown in full below a result, with words.", "Short")),
        ("META-DESC-TOO-LONG", ("A description", "W" * 100)),
        ("META-VIEWPORT-MISSING", ('name="viewport"', 'name="x"')),
        ("META-REFRESH", ("</head>", '<meta http-equiv="refresh" content="0;url=/x"></head>')),
        ("META-OUTSIDE-HEAD", ("<title>", "<p>x</p><title>")),
        ("INDEX-NOINDEX", ("</head>", '<meta name="robots" content="googlebot: noindex"></head>')),
        ("INDEX-NOFOLLOW-INTERNAL", ('<a href="/about">', '<a rel="nofollow" href="/about">')),
        ("HTTP-MIXED-CONTENT", ('src="/i.png"', 'src="http://ex.com/i.png"')),
        ("CANON-MISSING", ('rel="canonical"', 'rel="x"')),
        ("CANON-MULTIPLE", ("</head>", '<link rel="canonical" href="https://ex.com/"></head>')),
        ("CANON-RELATIVE", ('rel="canonical" href="https://ex.com/"', 'rel="canonical" href="/"')),
        ("CANON-CROSS-DOMAIN", ('rel="canonical" href="https://ex.com/"', 'rel="canonical" href="https://other.com/"')),
        ("CONTENT-H1-MISSING", ("<h1>Head</h1>", "")),
        ("CONTENT-H1-MULTIPLE", ("<h1>Head</h1>", "<h1>Head</h1><h1>Two</h1>")),
        ("CONTENT-H1-EMPTY", ("<h1>Head</h1>", "<h1> </h1>")),
        ("CONTENT-HEADING-SKIP", ("<h2>Next</h2>", "<h4>Next</h4>")),
        ("CONTENT-THIN", (TEXT, "few words")),
        ("CONTENT-LANG-MISSING", ('lang="en"', "")),
        ("ASSET-IMG-NO-ALT", (' alt="An image"', "")),
        ("ASSET-IMG-EMPTY-ALT-LINK", ("</main>", '<a href="/x"><img src="/y.png" alt=""></a></main>')),
        ("HREFLANG-NO-SELF", ('hreflang="en" href="https://ex.com/"', 'hreflang="en" href="https://ex.com/en/"')),
        ("HREFLANG-INVALID-CODE", ('hreflang="es"', 'hreflang="es-UK"')),
        ("HREFLANG-LANG-MISMATCH", ('lang="en"', 'lang="de"')),
        ("HREFLANG-SELF-ONLY", ('<link rel="alternate" hreflang="es" href="https://ex.com/es/">', "")),
        ("SOCIAL-OG-MISSING", ("og:title", "og:x")),
        ("LINK-ANCHOR-EMPTY", (">About us<", "> <")),
        ("LINK-ANCHOR-GENERIC", (">About us<", ">Click here!<")),
    ],
)
def test_rule_fires(spark, rule, change):
    assert change[0] in SOUND
    assert rule in fired(spark, SOUND.replace(*change, 1))


def test_site_rules_over_pages(spark):
    a = SOUND.replace("https://ex.com/es/", "https://ex.com/b").replace('href="/about"', 'href="/b#none"')
    b = SOUND.replace('rel="canonical" href="https://ex.com/"', 'rel="canonical" href="https://ex.com/b"').replace("<main>", '<main id="there">')
    c = crawl(spark, **{"/": a, "/b": b})
    ids = {r["rule_id"] for r in site_rules.evaluate(c, {"META-TITLE-DUPLICATE", "LINK-FRAGMENT-BROKEN", "META-DESC-DUPLICATE", "HREFLANG-NOT-RECIPROCAL"}).collect()}
    assert {"META-TITLE-DUPLICATE", "META-DESC-DUPLICATE", "LINK-FRAGMENT-BROKEN"} <= ids


def test_parse_edges():
    assert parse_page(None, None)["word_count"] == 0
    assert parse_page("<a href='x'>unclosed <b>bold", "https://e.com/")["links"][0]["text"] == "unclosed bold"
    assert parse_page("a<b>b</b>c", None)["word_count"] == 3
    assert parse_page("<title>a &amp; &unknown; b</title>", None)["title"] == "a & &unknown; b"
    assert minhash("too short") is None
    same, other = minhash(TEXT + " tail"), minhash(TEXT)
    assert len(same) == 128 and sum(x == y for x, y in zip(same, other)) > 100


@pytest.mark.parametrize("url, want", [("HTTPS://User@Ex.com:443/a/../b?utm_x=1&b=2&a=1#f", "https://ex.com/b?a=1&b=2"), ("http://ex.com", "http://ex.com/"), ("http://ex.com/#!x", "http://ex.com/#!x"), ("/rel", None), ("http://[bad", None), (None, None)])
def test_normalize(url, want):
    assert normalize(url) == want
    if want:
        assert normalize(want) == want


def test_robots_sitemap_addresses():
    r = Robots("User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 99\nSitemap: https://e.com/s.xml")
    assert r.allows("/") and not r.allows("/private/x") and r.allows("/private/open") and r.delay == 30 and r.sitemaps == ["https://e.com/s.xml"]
    assert Robots("User-agent: *\nDisallow: /").blocks_all
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"><url><loc>https://e.com/a</loc><image:image><image:loc>https://e.com/i.png</image:loc></image:image></url>'
    assert sitemap(xml) == (False, ["https://e.com/a"], "xml")
    assert not is_public_address("127.0.0.1") and not is_public_address("169.254.169.254") and is_public_address("8.8.8.8")
