"""A made-up site in SQL that Spark and other engines read alike: for every rule some pages that break it, and many that do not.

Page ``n`` of the site stands for page ``n`` of the driver's table.  All are one sound page, changed in one place by
``n mod MODULUS``; every page with the remainder 0 links to those up to the next such page, and to that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.plans.model import FETCH, ROBOTS, SITEMAPS, Crawl, build

MODULUS = 48
ORIGIN = "https://fx.example"
TEXT = "Plain words{N} that fill{N} the page{N} so that{N} it is{N} not thin{N}. "
DESCRIPTION = "A description of page {N} that is long enough to be shown in full below a result, with words."
TITLE = "A sound title of proper length for page {N}"
HEAD = f"""<title>{TITLE}</title><meta name="description" content="{DESCRIPTION}"><meta name="viewport" content="width=device-width"><link rel="canonical" href="{{URL}}">\
<link rel="alternate" hreflang="en" href="{{URL}}"><link rel="alternate" hreflang="es" href="{ORIGIN}/es/{{N}}">\
<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="{ORIGIN}/og.png">"""
PAGE = f"""<!doctype html><html lang="en"><head>{HEAD}</head><body><main id="start"><h1>Head {{N}}</h1><h2>Next</h2><p>{TEXT * 40}</p><a href="/about">About us</a><img src="/i.png" alt="An image">{{LINKS}}</main></body></html>"""
#: Text with enough different shingles for a signature.
VARIED = " ".join(f"varied{i}" for i in range(400))

_END = "</head>"
#: remainder -> (what is replaced, by what); some remainders change other columns, below.
CHANGES: dict[int, tuple[str, str]] = {
    1: (_END, '<meta name="robots" content="googlebot: noindex"></head>'),
    2: ('<a href="/about">', '<a rel="nofollow" href="/about">'),
    4: ('src="/i.png"', 'src="http://fx.example/i.png"'),
    6: ("</main>", "</main>{PADDING}"),
    7: (TITLE, ""),
    8: (TITLE, "W" * 40 + " {N}"),
    9: (TITLE, "Short {N}"),
    10: ("</title>", "</title><title>Another</title>"),
    11: (f'content="{DESCRIPTION}"', 'content=""'),
    12: ("A description", "W" * 100),
    13: (DESCRIPTION, "Short {N}"),
    14: ('name="viewport"', 'name="x"'),
    15: (_END, '<meta http-equiv="refresh" content="0;url=/x"></head>'),
    16: ("<title>", "<p>x</p><title>"),
    17: ('rel="canonical"', 'rel="x"'),
    18: (_END, '<link rel="canonical" href="{URL}"></head>'),
    19: ('rel="canonical" href="{URL}"', 'rel="canonical" href="/p{N}"'),
    20: ('rel="canonical" href="{URL}"', 'rel="canonical" href="https://other.example/"'),
    21: ("<h1>Head {N}</h1>", ""),
    22: ("<h1>Head {N}</h1>", "<h1>Head {N}</h1><h1>Two</h1>"),
    23: ("<h1>Head {N}</h1>", "<h1> </h1>"),
    24: ("<h2>Next</h2>", "<h4>Next</h4>"),
    25: (TEXT * 40, "few words"),
    26: (' lang="en"', ""),
    27: (' alt="An image"', ""),
    28: ("</main>", '<a href="/x"><img src="/y.png" alt=""></a></main>'),
    29: ('hreflang="en" href="{URL}"', f'hreflang="en" href="{ORIGIN}/en/{{N}}"'),
    30: ('hreflang="es"', 'hreflang="es-UK"'),
    31: ('lang="en"><head', 'lang="de"><head'),
    32: (f'<link rel="alternate" hreflang="es" href="{ORIGIN}/es/{{N}}">', ""),
    33: ("og:title", "og:x"),
    34: (">About us<", "> <"),
    35: (">About us<", ">Click here!<"),
    36: ('href="/about"', f'href="/p{MODULUS}#nowhere"'),
    37: (f'{ORIGIN}/es/{{N}}', f"{ORIGIN}/p{MODULUS}"),
    38: (f'{ORIGIN}/es/{{N}}', f"{ORIGIN}/gone"),
    39: (f"{ORIGIN}/og.png", f"{ORIGIN}/og-gone.png"),
    40: ("</main>", '<iframe src="/gone"></iframe></main>'),
    41: ("</main>", '<form action="/gone" method="get"></form></main>'),
    42: (DESCRIPTION, "A description that two pages or more have in common, though it should be of one of them only."),
    43: (TEXT * 40, VARIED + " here{N} " + TEXT * 40),
    44: ("</head><body>", "<body>"),  # legal: a head need not be closed
    45: ("Plain words", "Pl&aacute;in &unknown; words"),
}
UNAVAILABLE, SLOW, HEADER, ISLAND = 3, 5, 46, 47


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fetches() -> str:
    change = " ".join(f"WHEN {k} THEN replace(h, {_q(a)}, {_q(b)})" for k, (a, b) in CHANGES.items())
    n = "CAST(page_id AS VARCHAR(20))"
    hub = " || ".join(f"'<a href=\"/p' || CAST(page_id + {k} AS VARCHAR(20)) || '\">Page {k}</a>'" for k in (*range(1, ISLAND), MODULUS))
    return f"""
fxt AS (SELECT page_id, CASE WHEN page_id = 0 THEN '{ORIGIN}/' ELSE '{ORIGIN}/p' || {n} END AS url, page_id % {MODULUS} AS k, {_q(PAGE)} AS h FROM pages),
fxb AS (SELECT page_id, url, k, replace(replace(replace(replace(CASE k {change} ELSE h END, '{{LINKS}}', CASE k WHEN 0 THEN {hub} WHEN {ISLAND} THEN '<a href="/p' || CAST(page_id + {MODULUS} AS VARCHAR(20)) || '">Next island</a>' ELSE '' END),
  '{{PADDING}}', CASE k WHEN 6 THEN repeat('<!-- padding -->', 33000) ELSE '' END), '{{URL}}', url), '{{N}}', {n}) AS body FROM fxt),
fxf AS (SELECT url, CAST(CASE k WHEN {UNAVAILABLE} THEN 503 ELSE 200 END AS INT) AS status_code, 'text/html' AS content_type, CASE k WHEN {HEADER} THEN 'noindex' END AS x_robots_tag, CAST(NULL AS VARCHAR(20)) AS location, body,
  CAST(CASE k WHEN {SLOW} THEN 1001 ELSE 1000 END AS INT) AS ttfb_ms, TRUE AS is_internal, k <> {ISLAND} AS in_sitemap, FALSE AS blocked_by_robots, CAST(NULL AS VARCHAR(20)) AS error_kind FROM fxb
UNION ALL SELECT '{ORIGIN}' || path, status, kind, NULL, NULL, NULL, 100, TRUE, FALSE, FALSE, NULL
FROM (VALUES ('/about', 200, 'text/plain'), ('/gone', 404, 'text/html'), ('/og.png', 200, 'image/png'), ('/og-gone.png', 404, 'image/png'), ('/i.png', 200, 'image/png')) AS v(path, status, kind)),
fxr AS (SELECT host, CAST(status AS INT) AS status_code, content, blocks AS blocks_all, CAST(0 AS INT) AS sitemap_count FROM (VALUES ('fx.example', 404, '', FALSE), ('other.example', 200, 'User-agent: *' || chr(10) || 'Disallow: /', TRUE)) AS v(host, status, content, blocks)),
fxm AS (SELECT '{ORIGIN}' || path AS url, CAST(status AS INT) AS status_code, FALSE AS is_index, valid AS is_valid, known AS well_known, error AS parse_error, CAST(n AS BIGINT) AS url_count, CAST(size AS BIGINT) AS bytes, CAST(NULL AS VARCHAR(20)) AS discovered_from
FROM (VALUES ('/good.xml', 200, TRUE, FALSE, NULL, 10, 1000), ('/bad.xml', 200, FALSE, FALSE, 'xml', 0, 10), ('/sitemap.xml', 404, FALSE, TRUE, 'empty', 0, 0), ('/sitemap_index.xml', 200, FALSE, TRUE, 'xml', 0, 10),
  ('/many.xml', 200, TRUE, FALSE, NULL, 50001, 1000), ('/full.xml', 200, TRUE, FALSE, NULL, 50000, 52428800), ('/large.xml', 200, TRUE, FALSE, NULL, 10, 52428801)) AS v(path, status, valid, known, error, n, size))"""


SITE = _fetches()


def table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    cols = [c.split()[0] for c in schema.split(", ")]
    site = SITE.replace("{", "{{").replace("}", "}}")  # braces of the texts are not those of the query's parameters
    return spark.sql(f"WITH pages AS (SELECT * FROM {{raw}}), {site} SELECT {', '.join(cols)} FROM {name}", raw=pages)


def crawl(spark: SparkSession, sf_dir: str, fields: set[str] | None = None) -> Crawl:
    """The site, crawled: parsed (for these fields), judged and with its robots and sitemap files."""
    return build(table(spark, sf_dir, "fxf", FETCH), ORIGIN + "/", table(spark, sf_dir, "fxr", ROBOTS), table(spark, sf_dir, "fxm", SITEMAPS), fields=fields)


# -- what the rules must find, in SQL over the same site -------------------------------------------------------------
#: Pages as regular expressions see them; ``idx`` and ``ok`` are the conditions that most rules have.
SEEN = r"""
fxs AS (SELECT *, regexp_extract(body, '<title>([^<]*)</title>', 1) AS title, regexp_extract(body, '<meta name="description" content="([^"]*)"', 1) AS description,
  regexp_extract(body, '<link rel="canonical" href="([^"]*)"', 1) AS canonical, regexp_matches(body, '<meta name="robots" content="[^"]*noindex') AS says, status_code BETWEEN 200 AND 299 AS ok,
  len(regexp_extract_all(regexp_replace(regexp_extract(body, '(?s)<body>(.*)</body>', 1), '<[^>]*>', ' ', 'g'), '\S+')) AS words,
  regexp_extract_all(body, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract_all(body, 'hreflang="[^"]*" href="([^"]*)"', 1) AS alternates,
  regexp_extract(body, '<html lang="([^"]*)"', 1) AS lang FROM fxf WHERE body IS NOT NULL),
fxi AS (SELECT *, status_code = 200 AND NOT says AND x_robots_tag IS NULL AND (canonical IN ('', url) OR 'https://fx.example' || canonical = url) AS idx FROM fxs)"""

PAGE_RULES = {
    "INDEX-NOINDEX": "status_code = 200 AND (says OR x_robots_tag = 'noindex')",
    "INDEX-NOFOLLOW-INTERNAL": "ok AND contains(body, 'rel=\"nofollow\" href=\"/')",
    "HTTP-5XX": "status_code BETWEEN 500 AND 599",
    "HTTP-MIXED-CONTENT": "ok AND starts_with(url, 'https:') AND contains(body, 'src=\"http://')",
    "HTTP-SLOW-RESPONSE": "ttfb_ms > 1000",
    "HTTP-LARGE-PAGE": "ok AND strlen(body) > 512000",
    "META-TITLE-MISSING": "idx AND trim(title) = ''",
    "META-TITLE-TOO-LONG": "idx AND contains(title, repeat('W', 31))",  # 31 * 0.944 * 20 > 580
    "META-TITLE-TOO-SHORT": "idx AND length(title) BETWEEN 1 AND 29",
    "META-TITLE-MULTIPLE": "idx AND len(regexp_extract_all(body, '<title>')) > 1",
    "META-DESC-MISSING": "idx AND trim(description) = ''",
    "META-DESC-TOO-LONG": "idx AND contains(description, repeat('W', 75))",  # 75 * 0.944 * 14 > 990
    "META-DESC-TOO-SHORT": "idx AND length(description) BETWEEN 1 AND 69",
    "META-VIEWPORT-MISSING": "idx AND NOT contains(body, 'name=\"viewport\"')",
    "META-REFRESH": "idx AND contains(body, 'http-equiv=\"refresh\"')",
    "META-OUTSIDE-HEAD": "ok AND regexp_matches(body, '<head><p>.*<(title|meta|link)')",
    "CANON-MISSING": "idx AND canonical = ''",
    "CANON-MULTIPLE": "ok AND len(regexp_extract_all(body, 'rel=\"canonical\"')) > 1",
    "CANON-RELATIVE": "ok AND canonical <> '' AND NOT regexp_matches(canonical, '^[a-z]+:')",
    "CANON-CROSS-DOMAIN": "ok AND starts_with(canonical, 'http') AND NOT starts_with(canonical, 'https://fx.example/')",
    "CONTENT-H1-MISSING": "idx AND (len(h1) = 0 OR trim(h1[1]) = '')",
    "CONTENT-H1-MULTIPLE": "idx AND len(h1) > 1",
    "CONTENT-H1-EMPTY": "idx AND len(h1) > 0 AND trim(h1[1]) = ''",
    "CONTENT-HEADING-SKIP": "idx AND regexp_matches(body, '</h1><h[3-6]>')",
    "CONTENT-THIN": "idx AND words < 300",
    "CONTENT-LANG-MISSING": "idx AND lang = ''",
    "ASSET-IMG-NO-ALT": "ok AND regexp_matches(body, '<img src=\"[^\"]*\">')",
    "ASSET-IMG-EMPTY-ALT-LINK": "ok AND regexp_matches(body, '<a [^>]*><img [^>]*alt=\"\"></a>')",
    "HREFLANG-NO-SELF": "idx AND NOT list_contains(alternates, url)",
    "HREFLANG-INVALID-CODE": "ok AND contains(body, 'hreflang=\"es-UK\"')",
    "HREFLANG-LANG-MISMATCH": "idx AND lang = 'de' AND list_contains(alternates, url)",
    "HREFLANG-SELF-ONLY": "idx AND len(alternates) = 1",
    "SOCIAL-OG-MISSING": "idx AND NOT (contains(body, 'og:title') AND contains(body, 'og:description') AND contains(body, 'og:image'))",
    "LINK-ANCHOR-EMPTY": "ok AND regexp_matches(body, '<a href=\"/[^\"]*\">\\s*</a>')",
    "LINK-ANCHOR-GENERIC": "ok AND regexp_matches(body, '<a [^>]*>Click here!</a>')",
}

_TO = "(SELECT url FROM fxf WHERE status_code = 404)"
#: rule -> (columns, query).
SITE_RULES = {
    "INDEX-SECTION-DISCONNECTED": ("pages", f"SELECT count(*) AS pages FROM fxb JOIN fxi ON fxi.url = fxb.url WHERE idx AND k = {ISLAND} AND page_id > {MODULUS} HAVING count(*) > 0"),
    "INDEX-ROBOTS-TXT-MISSING": ("host status_code", "SELECT host, status_code FROM fxr WHERE host = 'fx.example' AND status_code BETWEEN 400 AND 499"),
    "INDEX-ROBOTS-TXT-BLOCKS-ALL": ("host robots_txt", "SELECT host, content AS robots_txt FROM fxr WHERE regexp_matches(content, 'Disallow: /$')"),
    "INDEX-SITEMAP-ERROR": ("sitemap reason", "SELECT url AS sitemap, CASE WHEN NOT is_valid THEN parse_error WHEN url_count > 50000 THEN 'too_many_urls' ELSE 'too_large' END AS reason FROM fxm WHERE (NOT is_valid AND (NOT well_known OR status_code = 200)) OR url_count > 50000 OR bytes > 50 * 1024 * 1024"),
    "META-DESC-DUPLICATE": ("url pages", "SELECT url, pages FROM (SELECT url, count(*) OVER (PARTITION BY description) AS pages FROM fxi WHERE idx AND trim(description) <> '') WHERE pages > 1"),
    "DUP-CONTENT-NEAR": ("url pages", "SELECT url, pages FROM (SELECT url, count(*) OVER () AS pages FROM fxi WHERE idx AND contains(body, 'varied0 varied1 ')) WHERE pages > 1"),
    "ASSET-IFRAME-BROKEN": ("url status used_by_pages", f"SELECT 'https://fx.example' || src AS url, 404 AS status, count(*) AS used_by_pages FROM (SELECT regexp_extract(body, '<iframe src=\"([^\"]*)\"', 1) AS src FROM fxi) WHERE 'https://fx.example' || src IN {_TO} GROUP BY src"),
    "ASSET-FORM-BROKEN": ("url status used_by_pages", f"SELECT 'https://fx.example' || src AS url, 404 AS status, count(*) AS used_by_pages FROM (SELECT regexp_extract(body, '<form action=\"([^\"]*)\"', 1) AS src FROM fxi) WHERE 'https://fx.example' || src IN {_TO} GROUP BY src"),
    "HREFLANG-NOT-RECIPROCAL": ("url target reason", "SELECT a.url, a.target, 'missing_return' AS reason FROM (SELECT url, unnest(alternates) AS target FROM fxi WHERE idx) a JOIN fxi b ON b.url = a.target WHERE a.target <> a.url AND NOT list_contains(b.alternates, a.url)"),
    "HREFLANG-TO-4XX": ("url target status_code", f"SELECT url, target, 404 AS status_code FROM (SELECT url, unnest(alternates) AS target FROM fxi) WHERE target IN {_TO}"),
    "SOCIAL-OG-IMAGE-BROKEN": ("url used_by_pages status_code", f"SELECT src AS url, count(*) AS used_by_pages, 404 AS status_code FROM (SELECT regexp_extract(body, 'og:image\" content=\"([^\"]*)\"', 1) AS src FROM fxi) WHERE src IN {_TO} GROUP BY src"),
    "LINK-FRAGMENT-BROKEN": ("url fragment links linked_from", f"SELECT '{ORIGIN}/p{MODULUS}' AS url, 'nowhere' AS fragment, count(*) AS links, count(*) AS linked_from FROM fxi WHERE ok AND contains(body, '#nowhere') HAVING count(*) > 0 AND (SELECT count(*) FROM fxi WHERE url = '{ORIGIN}/p{MODULUS}') > 0"),
}


def page_sql(rule: str, severity: str) -> str:
    return f"SELECT url, '{rule}' AS rule_id, '{severity}' AS severity FROM fxi WHERE {PAGE_RULES[rule]}"


def with_site(sql: str) -> str:
    return f"WITH {SITE}, {SEEN} {sql}"
