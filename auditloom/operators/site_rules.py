"""Rules that look at a whole site: DataFrame queries over the crawl's relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import constants as K
from auditloom.functions import text as X
from auditloom.functions import urls as U
from auditloom.operators.depth import click_depth
from auditloom.operators.near import near_duplicates
from auditloom.operators.redirects import chains, cycles, final_status
from auditloom.plans.model import Crawl, json_of
from auditloom.plans.staging import stage

c = F.col


@dataclass(frozen=True)
class SiteRule:
    id: str
    severity: str
    query: Callable[[Crawl], DataFrame]
    whole: bool = False  # makes no sense over a truncated crawl
    reads: frozenset[str] = frozenset()  # of what the parser can find
    by_target: bool = False  # its rows are by URL and status, its findings by URL

    @property
    def category(self) -> str:
        return self.id.split("-")[0].lower()

    def evaluate(self, crawl: Crawl) -> DataFrame:
        """Findings of this rule: url (null for the site), severity, group_key and details from the query's columns."""
        df = self.query(crawl)
        extra = [x for x in df.columns if x not in ("url", "severity", "group_key")]
        out = df.select(
            F.lit(self.id).alias("rule_id"),
            (c("severity") if "severity" in df.columns else F.lit(self.severity)).alias("severity"),
            F.lit(self.category).alias("category"),
            (c("url") if "url" in df.columns else F.lit(None)).cast("string").alias("url"),
            (c("group_key") if "group_key" in df.columns else F.lit("")).alias("group_key"),
            json_of(**{x: c(x) for x in extra}).alias("detail_json"),
        )
        if self.by_target:  # a URL with several answers is one finding, of the first
            keys = [x for x in out.columns if x != "detail_json"]
            out = out.groupBy(*keys).agg(F.min("detail_json").alias("detail_json"))
        return out


RULES: list[SiteRule] = []


def rule(id: str, severity: str, whole: bool = False, reads: str = "", by_target: bool = False):
    def add(f: Callable[[Crawl], DataFrame]):
        RULES.append(SiteRule(id, severity, f, whole, frozenset(reads.split()), by_target))
        return f

    return add


def fields(only: set[str] | None = None) -> frozenset[str]:
    """The fields that the parser must find for these rules, or for all."""
    return frozenset().union(*[r.reads for r in RULES if only is None or r.id in only])


def by_id(id: str) -> SiteRule:
    return next(r for r in RULES if r.id == id)


def gone(status: Column = None, internal: Column = None) -> Column:
    """What counts as broken: any error of an own URL, of others only 404 and 410."""
    s, i = c("status_code") if status is None else status, c("is_internal") if internal is None else internal
    return (i & (s >= 400)) | (~i & s.isin(404, 410))


def _marked(crawl: Crawl) -> DataFrame:
    """URLs with what their pages say."""
    p = crawl.pages.select("url", "is_indexable", "indexability_reason")
    return crawl.urls.join(p, "url", "left")


def _blocked(crawl: Crawl) -> DataFrame:
    """Rows of ``urls`` that robots files keep out, each once however many pages the crawl has of its URL."""
    p = crawl.pages.where("indexability_reason = 'robots'").select("url", F.lit(True).alias("_page")).distinct()
    return crawl.urls.join(p, "url", "left").where((c("exclusion_reason") == "robots") | c("_page"))


# -- indexability ---------------------------------------------------------------------------------------------------
@rule("INDEX-ROBOTS-BLOCKED", "critical", reads="links")
def robots_blocked(crawl: Crawl) -> DataFrame:
    blocked = _blocked(crawl).where(c("is_internal") & ~U.is_infrastructure(c("url")))
    return crawl.inlinks().join(blocked.select("url"), "url", "left_semi").select("url", c("internal_links_in").alias("linked_from"))


@rule("INDEX-BLOCKED-IN-SITEMAP", "critical")
def blocked_in_sitemap(crawl: Crawl) -> DataFrame:
    return _blocked(crawl).where("in_sitemap").select("url")


@rule("INDEX-NOINDEX-IN-SITEMAP", "critical")
def noindex_in_sitemap(crawl: Crawl) -> DataFrame:
    return _marked(crawl).where(c("in_sitemap") & ~c("is_indexable") & (c("indexability_reason") == "noindex")).select("url")


@rule("INDEX-SITEMAP-MISSING", "high")
def sitemap_missing(crawl: Crawl) -> DataFrame:
    n = crawl.urls.agg(F.count_if("in_sitemap").alias("n"))
    return n.where((c("n") == 0) & F.lit(crawl.mode == "http" and crawl.discover_sitemaps)).select(F.lit(None).cast("string").alias("url"))


def orphans(crawl: Crawl) -> DataFrame:
    """Pages of the sitemap that no link leads to, the home page apart."""
    p = crawl.urls.where(c("is_internal") & c("in_sitemap") & ~crawl.home).join(crawl.pages.select("url"), "url", "left_semi")
    return p.join(crawl.links.select(c("to_url").alias("url")), "url", "left_anti").select("url")


rule("INDEX-ORPHAN-PAGE", "high", whole=True, reads="links")(orphans)


def _seeds(crawl: Crawl) -> DataFrame:
    """The home page and its alternates."""
    home = crawl.urls.where(crawl.home).select("url")
    if "hreflang" not in crawl.pages.columns:
        return home
    alt = crawl.pages.join(home, "url", "left_semi").select(F.explode("hreflang").alias("h")).select(c("h.url").alias("url"))
    return home.unionByName(alt.where("url IS NOT NULL")).distinct()


def _indexable_linked(crawl: Crawl) -> DataFrame:
    n = crawl.inlinks()
    p = crawl.pages.where("is_indexable").select("url").join(crawl.urls.where("is_internal").select("url"), "url", "left_semi")
    return p.join(n, "url")


@rule("INDEX-DEEP-PAGE", "medium", whole=True, reads="links hreflang")
def deep_page(crawl: Crawl) -> DataFrame:
    deep = click_depth(crawl.links, _seeds(crawl)).where(c("depth") > K.DEEP_CLICKS)
    return _indexable_linked(crawl).join(deep, "url").where(F.lit(crawl.mode != "list")).select("url", c("depth").alias("click_depth"), F.lit(K.DEEP_CLICKS).alias("max_click_depth"))


def unreached(crawl: Crawl) -> DataFrame:
    return _indexable_linked(crawl).join(click_depth(crawl.links, _seeds(crawl)), "url", "left_anti").select("url")


@rule("INDEX-SECTION-DISCONNECTED", "high", whole=True, reads="links hreflang")
def section_disconnected(crawl: Crawl) -> DataFrame:
    home = crawl.urls.where(crawl.home).select(F.lit(1).alias("_k")).limit(1)  # one row, or none
    u = stage(unreached(crawl).withColumn("section", F.concat(F.lit("/"), F.regexp_extract(U.path(c("url")), "^/([^/]*)", 1))), "unreached")
    per = u.groupBy("section").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "section").limit(3).agg(F.collect_list(F.struct("n", "section")).alias("_s"))
    first = u.orderBy("url").limit(K.SAMPLE).agg(F.array_sort(F.collect_list("url")).alias("examples"))
    total = u.agg(F.count("*").alias("pages"))
    one = F.lit(1).alias("_k")
    j = total.select("pages", one).join(top.select("_s", one), "_k").join(first.select("examples", one), "_k").join(home, "_k", "left_semi")
    return j.where((c("pages") > 0) & F.lit(crawl.mode != "list")).select(F.lit(None).cast("string").alias("url"), "pages", F.transform("_s", lambda s: s["section"]).alias("sections"), "examples", F.lit("section-disconnected").alias("group_key"))


@rule("INDEX-NO-INTERNAL-LINKS-IN", "high", whole=True, reads="links")
def no_internal_links_in(crawl: Crawl) -> DataFrame:
    p = crawl.pages.where("is_indexable").select("url").join(crawl.urls.where(c("is_internal") & ~crawl.home).select("url"), "url", "left_semi")
    return p.join(crawl.links.select(c("to_url").alias("url")), "url", "left_anti").select("url")


@rule("INDEX-ROBOTS-TXT-MISSING", "medium")
def robots_txt_missing(crawl: Crawl) -> DataFrame:
    first = crawl.urls.where("is_internal").agg(F.min("url").alias("_u")).select(U.authority(c("_u")).alias("host"))
    return crawl.robots.join(first, "host").where(c("status_code").between(400, 499) & F.lit(crawl.mode == "http")).select("host", "status_code")


@rule("INDEX-ROBOTS-TXT-BLOCKS-ALL", "critical")
def robots_txt_blocks_all(crawl: Crawl) -> DataFrame:
    return crawl.robots.where("blocks_all").select("host", F.array_join(F.slice(F.split("content", "\n"), 1, 20), "\n").alias("robots_txt"))


@rule("INDEX-SITEMAP-ERROR", "high")
def sitemap_error(crawl: Crawl) -> DataFrame:
    bad = ~c("is_valid") & (~c("well_known") | (c("status_code") == 200))
    reason = F.when(bad, F.coalesce("parse_error", F.lit("invalid"))).when(c("url_count") > K.SITEMAP_MAX_URLS, "too_many_urls").when(c("bytes") > K.SITEMAP_MAX_BYTES, "too_large")
    return crawl.sitemaps.withColumn("reason", reason).where("reason IS NOT NULL").select(c("url").alias("sitemap"), "reason", "status_code", "url_count", "bytes", F.concat(F.lit("sitemap-error:"), "reason").alias("group_key"))


# -- HTTP -----------------------------------------------------------------------------------------------------------
def _targets(crawl: Crawl, when: Column, *elements: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Targets of links that fulfil a condition, with the number of linking pages."""
    e = crawl.edges(*elements).where(when)
    return e.groupBy(c("to_url").alias("url"), "status_code", "error_kind", *by).agg(F.countDistinct("from_url").alias("linked_from"), F.min("from_url").alias("example_page"))


@rule("HTTP-404-INTERNAL", "critical", reads="links", by_target=True)
def http_404_internal(crawl: Crawl) -> DataFrame:
    return _targets(crawl, c("is_internal") & c("status_code").between(400, 499), "a").select("url", "status_code", "linked_from")


@rule("HTTP-404-EXTERNAL", "medium", reads="links", by_target=True)
def http_404_external(crawl: Crawl) -> DataFrame:
    dns = c("status_code").isNull() & (c("error_kind") == "dns")
    t = _targets(crawl, ~c("is_internal") & (c("status_code").isin(404, 410) | F.coalesce(dns, F.lit(False))), "a")
    return t.select("url", "status_code", F.when(c("status_code").isNull(), c("error_kind")).alias("reason"), "linked_from")


@rule("HTTP-EXTERNAL-UNVERIFIABLE", "low", reads="links", by_target=True)
def http_external_unverifiable(crawl: Crawl) -> DataFrame:
    return _targets(crawl, ~c("is_internal") & c("status_code").isin(401, 403, 429), "a").select("url", "status_code", "linked_from")


@rule("HTTP-REDIRECT-CHAIN", "high")
def http_redirect_chain(crawl: Crawl) -> DataFrame:
    return chains(crawl.urls).where("NOT loop AND hops >= 2").select("url", "hops", "final_url", c("path").alias("chain"))


@rule("HTTP-REDIRECT-LOOP", "critical")
def http_redirect_loop(crawl: Crawl) -> DataFrame:
    return cycles(crawl.urls).select("url", F.size("cycle").alias("length"), "cycle", F.concat(F.lit("redirect-loop:"), F.md5("url")).alias("group_key"))


@rule("HTTP-REDIRECT-TO-404", "critical")
def http_redirect_to_404(crawl: Crawl) -> DataFrame:
    end = crawl.urls.select(c("url").alias("final_url"), c("status_code").alias("final_status_code"))
    return chains(crawl.urls).where("NOT loop").join(end, "final_url").where(c("final_status_code").between(400, 499)).select("url", "final_url", "final_status_code", "hops")


@rule("HTTP-NO-HTTPS", "critical")
def http_no_https(crawl: Crawl) -> DataFrame:
    # the redirect's target need not be a URL that was fetched; its text tells the scheme
    stays = c("status_code").between(200, 299) | (c("status_code").between(300, 399) & (U.scheme(c("redirect_to")) == "http"))
    u = crawl.urls.where(c("is_internal") & (U.scheme(c("url")) == "http") & (c("crawl_state") == "done") & stays)
    one = F.lit(1).alias("_k")
    first = u.orderBy("url").limit(K.SAMPLE).agg(F.array_sort(F.collect_list("url")).alias("sample")).select("sample", one)
    return u.agg(F.count("*").alias("http_urls")).select("http_urls", one).join(first, "_k").where("http_urls > 0").select(F.lit(None).cast("string").alias("url"), "http_urls", "sample")


# -- meta and duplicates --------------------------------------------------------------------------------------------
@rule("META-TITLE-DUPLICATE", "high", reads="title")
def meta_title_duplicate(crawl: Crawl) -> DataFrame:
    own = lambda: F.coalesce(F.nullif(U.pagination_base(U.path(c("url"))), F.lit("")), F.regexp_replace(U.path(c("url")), "/$", ""))
    p = crawl.pages.where(c("is_indexable") & (F.trim("title") != ""))
    base = own()
    n = p.groupBy(c("title").alias("_x")).agg(F.count("*").alias("pages"), F.countDistinct(base).alias("_b"), F.max((U.pagination_base(U.path(c("url"))) != "").cast("int")).alias("_p")).where("pages > 1")
    series = (c("_b") == 1) & (c("_p") == 1)
    return p.select("url", "title").join(n, c("title") == c("_x")).select("url", "title", "pages", series.alias("pagination_series"), F.when(series, "low").otherwise("high").alias("severity"), F.concat(F.lit("title:"), F.md5("title")).alias("group_key"))


@rule("META-DESC-DUPLICATE", "medium", reads="meta_description")
def meta_desc_duplicate(crawl: Crawl) -> DataFrame:
    p = crawl.pages.where(c("is_indexable") & (F.trim("meta_description") != ""))
    n = p.groupBy(c("meta_description").alias("_x")).agg(F.count("*").alias("pages")).where("pages > 1")
    return p.select("url", "meta_description").join(n, c("meta_description") == c("_x")).select("url", c("meta_description").alias("description"), "pages", F.concat(F.lit("desc:"), F.md5("meta_description")).alias("group_key"))


def _canonical(crawl: Crawl) -> DataFrame:
    """Pages joined with the URL they call canonical, where that is another one."""
    t = crawl.urls.select(c("url").alias("canonical"), c("status_code").alias("status"), c("is_internal").alias("target_internal"), c("redirect_to").alias("redirects_to"))
    return crawl.pages.select("url", "canonical").where("canonical != url").join(t, "canonical")


@rule("CANON-TO-4XX", "critical", reads="canonical")
def canon_to_4xx(crawl: Crawl) -> DataFrame:
    return _canonical(crawl).where(gone(c("status"), c("target_internal"))).select("url", "canonical", "status")


@rule("CANON-TO-REDIRECT", "high", reads="canonical")
def canon_to_redirect(crawl: Crawl) -> DataFrame:
    return _canonical(crawl).where(c("status").between(300, 399) | c("redirects_to").isNotNull()).select("url", "canonical", "status", "redirects_to")


@rule("CANON-TO-NOINDEX", "critical", reads="canonical meta_robots")
def canon_to_noindex(crawl: Crawl) -> DataFrame:
    says = lambda x: F.coalesce(F.lower(x).contains("noindex"), F.lit(False))
    header = c("x_robots_tag") if "x_robots_tag" in crawl.pages.columns else F.lit(None).cast("string")
    t = crawl.pages.select(c("url").alias("canonical"), c("meta_robots").alias("m"), header.alias("x")).where(says(c("m")) | says(c("x")))
    return crawl.pages.select("url", "canonical").where("canonical != url").join(t, "canonical").select("url", "canonical", F.when(says(c("m")), c("m")).otherwise(c("x")).alias("directive"))


@rule("CANON-CHAIN", "high", reads="canonical")
def canon_chain(crawl: Crawl) -> DataFrame:
    own = crawl.pages.select("url", "canonical").where("canonical != url")
    nxt = own.select(c("url").alias("canonical"), c("canonical").alias("then"))
    return own.join(nxt, "canonical").join(crawl.urls.select(c("url").alias("then")), "then", "left_semi").select("url", "canonical", "then")


@rule("DUP-CONTENT-EXACT", "high", reads="html_hash")
def dup_content_exact(crawl: Crawl) -> DataFrame:
    p = crawl.pages.where("is_indexable").select("url", "html_hash")
    n = p.groupBy("html_hash").agg(F.count("*").alias("pages")).where("pages > 1")
    return p.join(n, "html_hash").select("url", "pages", F.concat(F.lit("html:"), "html_hash").alias("group_key"))


@rule("DUP-CONTENT-NEAR", "medium", reads="text_minhash shingles html_hash hreflang")
def dup_content_near(crawl: Crawl) -> DataFrame:
    p = crawl.pages.where("is_indexable")
    alt = p.select(c("url").alias("a"), F.explode("hreflang").alias("h")).select("a", c("h.url").alias("b"))
    of = near_duplicates(p.select("url", "text_minhash", "html_hash", *[x for x in ("shingles",) if x in p.columns]), alt)
    n = of.groupBy("component").agg(F.count("*").alias("pages"))
    return of.join(n, "component").select("url", "pages", F.concat(F.lit("near:"), F.md5("component")).alias("group_key"))


# -- assets ---------------------------------------------------------------------------------------------------------
@rule("ASSET-IMG-BROKEN", "high", reads="links", by_target=True)
def asset_img_broken(crawl: Crawl) -> DataFrame:
    return _targets(crawl, gone(), "img").select("url", "status_code", c("linked_from").alias("used_by_pages"))


def _heavy(crawl: Crawl, element: str, limit: int, own: bool) -> DataFrame:
    when = (c("status_code") == 200) & (c("content_length") > limit) & (c("is_internal") if own else F.lit(True))
    return _targets(crawl, when, element, by=("content_length",)).select("url", c("content_length").alias("bytes"), F.lit(limit).alias("limit_bytes"), c("linked_from").alias("used_by_pages"))


@rule("ASSET-IMG-HEAVY", "medium", reads="links")
def asset_img_heavy(crawl: Crawl) -> DataFrame:
    return _heavy(crawl, "img", K.HEAVY_IMAGE, own=False)


@rule("ASSET-JS-HEAVY", "medium", reads="links")
def asset_js_heavy(crawl: Crawl) -> DataFrame:
    return _heavy(crawl, "script", K.HEAVY_JS, own=True).drop("used_by_pages")


@rule("ASSET-CSS-HEAVY", "medium", reads="links")
def asset_css_heavy(crawl: Crawl) -> DataFrame:
    return _heavy(crawl, "link", K.HEAVY_CSS, own=True).drop("used_by_pages")


@rule("ASSET-BROKEN", "high", reads="links")
def asset_broken(crawl: Crawl) -> DataFrame:
    return _targets(crawl, gone(), "link", "script", by=("element",)).select("url", "status_code", c("element").alias("kind"), c("linked_from").alias("used_by_pages"))


def _embed(crawl: Crawl, element: str) -> DataFrame:
    return _targets(crawl, c("is_internal") & (c("status_code") >= 400), element).select("url", c("status_code").alias("status"), c("linked_from").alias("used_by_pages"), "example_page")


@rule("ASSET-IFRAME-BROKEN", "high", reads="links", by_target=True)
def asset_iframe_broken(crawl: Crawl) -> DataFrame:
    return _embed(crawl, "iframe")


@rule("ASSET-FORM-BROKEN", "critical", reads="links", by_target=True)
def asset_form_broken(crawl: Crawl) -> DataFrame:
    return _embed(crawl, "form")


# -- alternates -----------------------------------------------------------------------------------------------------
def _alternates(crawl: Crawl) -> DataFrame:
    """(url, code, target, key, own): one row for each alternate of a page; key and own are comparable forms."""
    each = crawl.pages.select("url", "is_indexable", F.explode("hreflang").alias("h"))
    t = F.coalesce("h.url", "h.href")
    return each.select("url", "is_indexable", "h.code", t.alias("target"), U.url_key(t).alias("key"), U.url_key(c("url")).alias("own"))


@rule("HREFLANG-NOT-RECIPROCAL", "high", reads="hreflang")
def hreflang_not_reciprocal(crawl: Crawl) -> DataFrame:
    a = _alternates(crawl)
    asked = a.where("is_indexable AND key != own").select("url", "own", "code", "target", "key").dropDuplicates(["url", "key"])
    # of pages with one key the first set counts
    first = Window.partitionBy("key").orderBy("url")
    pages = crawl.pages.select(U.url_key(c("url")).alias("key"), "url", F.size("hreflang").alias("n")).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("key", c("url").alias("_t"), "n")
    back = a.select(c("url").alias("_t"), c("key").alias("own")).distinct()
    j = asked.join(pages, "key").join(back.withColumn("_back", F.lit(True)), ["_t", "own"], "left").where("_back IS NULL")
    pair = F.concat(F.lit("hreflang-pair:"), F.md5(F.concat_ws("\n", F.least("own", "key"), F.greatest("own", "key"))))
    return j.select("url", "code", "target", F.when(c("n") > 0, "missing_return").otherwise("no_alternates").alias("reason"), pair.alias("group_key"))


@rule("HREFLANG-TO-4XX", "critical", reads="hreflang")
def hreflang_to_4xx(crawl: Crawl) -> DataFrame:
    t = crawl.urls.select(c("url").alias("target"), "status_code", "is_internal")
    bad = (c("is_internal") & c("status_code").between(400, 499)) | (~c("is_internal") & c("status_code").isin(404, 410))
    return _alternates(crawl).dropDuplicates(["url", "key"]).join(t, "target").where(bad).select("url", "code", "target", "status_code")


# -- social and links -----------------------------------------------------------------------------------------------
@rule("SOCIAL-OG-IMAGE-BROKEN", "medium", reads="links")
def social_og_image_broken(crawl: Crawl) -> DataFrame:
    used = crawl.links.where("element = 'meta'").groupBy(c("to_url").alias("url")).agg(F.countDistinct("from_url").alias("used_by_pages"), F.min("from_url").alias("example_page"))
    dns = F.coalesce(~c("is_internal") & c("status_code").isNull() & (c("error_kind") == "dns"), F.lit(False))
    return used.join(final_status(crawl.urls), "url").where(gone() | dns).select("url", "used_by_pages", "example_page", "status_code", F.when(c("status_code").isNull(), c("error_kind")).alias("reason"), F.when(c("hops") > 0, c("final_url")).alias("final_url"), F.nullif("hops", F.lit(0)).alias("hops"))


@rule("LINK-FRAGMENT-BROKEN", "low", reads="links ids")
def link_fragment_broken(crawl: Crawl) -> DataFrame:
    ids = crawl.pages.where((c("status_code") == 200) & (F.size("ids") > 0)).join(crawl.urls.where("is_internal").select("url"), "url", "left_semi").select(c("url").alias("to_url"), "ids")
    good = crawl.pages.where(c("status_code").between(200, 299) & ~U.is_infrastructure(c("url"))).select(c("url").alias("from_url"))
    l = crawl.links.where((c("element") == "a") & c("fragment").isNotNull()).join(good, "from_url", "left_semi").join(ids, "to_url").where(~U.lands(c("fragment"), c("ids")))
    g = l.groupBy("to_url", "fragment").agg(F.count("*").alias("links"), F.countDistinct("from_url").alias("linked_from"))
    # ten examples for each target, found without gathering all sources
    w = Window.partitionBy("to_url", "fragment").orderBy("from_url")
    ex = l.select("to_url", "fragment", "from_url").distinct().withColumn("_r", F.row_number().over(w)).where(c("_r") <= K.SAMPLE).groupBy("to_url", "fragment").agg(F.array_sort(F.collect_list("from_url")).alias("sample"))
    return g.join(ex, ["to_url", "fragment"]).select(c("to_url").alias("url"), "fragment", "links", "linked_from", "sample", F.concat(F.lit("fragment:"), F.md5(F.concat_ws("#", "to_url", "fragment"))).alias("group_key"))


def evaluate(crawl: Crawl, only: set[str] | None = None) -> DataFrame | None:
    """Findings of all site rules that the crawl allows."""
    out = None
    for r in RULES:
        if (only is not None and r.id not in only) or (r.whole and crawl.truncated):
            continue
        if (r.id.startswith("INDEX-ROBOTS-TXT") and crawl.robots is None) or (r.id == "INDEX-SITEMAP-ERROR" and crawl.sitemaps is None):
            continue
        df = r.evaluate(crawl)
        out = df if out is None else out.unionByName(df)
    return out
