"""Rules that look at one page: all of them are column expressions over the page's row, evaluated in one narrow pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import constants as K
from auditloom.functions import text as X
from auditloom.functions import urls as U
from auditloom.plans.model import ISSUE, json_of
from auditloom.sources import html

c = F.col
_FINDING = "array<struct<severity:string,group_key:string,detail_json:string>>"


@dataclass(frozen=True)
class PageRule:
    id: str
    severity: str
    evaluate: Callable[[], Column]

    @property
    def category(self) -> str:
        return self.id.split("-")[0].lower()


RULES: list[PageRule] = []


def rule(id: str, severity: str):
    def add(f: Callable[[], Column]):
        RULES.append(PageRule(id, severity, f))
        return f

    return add


def found(when: Column, severity: str | Column, group: Column | None = None, **detail: Column) -> Column:
    one = F.struct((severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (F.lit("") if group is None else group).alias("group_key"), json_of(**detail).alias("detail_json"))
    return F.when(when, F.array(one))


def simple(id: str, severity: str, when: Callable[[], Column], group: Callable[[], Column] | None = None, **detail: Callable[[], Column]) -> None:
    RULES.append(PageRule(id, severity, lambda: found(when(), severity, group() if group else None, **{k: v() for k, v in detail.items()})))


def ok() -> Column:
    return c("is_html") & c("status_code").between(200, 299)


def idx() -> Column:
    return c("is_html") & c("is_indexable")



def some(arr: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(arr, f)


def sample(arr: Column) -> Column:
    return F.slice(F.array_distinct(arr), 1, K.SAMPLE)


def shown(src: Column) -> Column:
    """A source as it is reported: inlined data is cut."""
    return F.when(src.startswith("data:"), F.concat(F.substring_index(src, ",", 1), F.lit(",…"))).otherwise(src)


def group_of(prefix: str, arr: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.array_join(F.array_sort(F.array_distinct(arr)), "\n")))


def internal(l: Column) -> Column:
    return F.coalesce(U.authority(l["url"]) == U.authority(c("url")), F.lit(False))


# indexability
@rule("INDEX-NOINDEX", "medium")
def _():
    meta, header = X.noindex(c("meta_robots")), X.noindex(c("x_robots_tag"))
    root = U.path(c("url")).isin("", "/")
    return found((c("status_code") == 200) & (meta | header), F.when(root, "critical").otherwise("medium"), source=F.when(meta, "meta").otherwise("header"), value=F.when(meta, c("meta_robots")).otherwise(c("x_robots_tag")), home_page=root)


@rule("INDEX-NOFOLLOW-INTERNAL", "medium")
def _():
    bad = some(c("links"), lambda l: (l["element"] == "a") & l["nofollow"] & internal(l) & ~U.is_infrastructure(l["url"]))
    hrefs = F.transform(bad, lambda l: l["href"])
    marks = F.transform(bad, lambda l: F.concat(l["href"], F.lit("\t"), F.coalesce(l["text"], F.lit(""))))
    return found(ok() & (F.size(bad) > 0), "medium", group_of("nofollow:", marks), links=F.size(F.array_distinct(hrefs)), examples=sample(hrefs))


# HTTP
simple("HTTP-5XX", "critical", lambda: c("status_code").between(500, 599), status_code=lambda: c("status_code"))


@rule("HTTP-MIXED-CONTENT", "high")
def _():
    bad = F.transform(some(c("links"), lambda l: ~l["element"].isin("a", "form") & F.lower(F.ltrim(l["href"])).startswith("http://")), lambda l: l["href"])
    return found(ok() & (U.scheme(c("url")) == "https") & (F.size(bad) > 0), "high", resources=F.size(F.array_distinct(bad)), sample=sample(bad))


simple("HTTP-SLOW-RESPONSE", "medium", lambda: c("ttfb_ms") > K.SLOW_MS, ttfb_ms=lambda: c("ttfb_ms"), threshold_ms=lambda: F.lit(K.SLOW_MS))
simple("HTTP-LARGE-PAGE", "medium", lambda: ok() & (c("html_bytes") > K.LARGE_PAGE_BYTES), html_bytes=lambda: c("html_bytes"), threshold_bytes=lambda: F.lit(K.LARGE_PAGE_BYTES))

# meta
_t = lambda: F.regexp_replace(c("title"), r"^\s+|\s+$", "")
_d = lambda: F.regexp_replace(c("meta_description"), r"^\s+|\s+$", "")
_tpx = lambda: X.pixel_width(c("title"), K.TITLE_FONT_PX)
_dpx = lambda: X.pixel_width(c("meta_description"), K.DESC_FONT_PX)
simple("META-TITLE-MISSING", "critical", lambda: idx() & X.blank(c("title")))
simple("META-TITLE-TOO-LONG", "medium", lambda: idx() & ~X.blank(c("title")) & (_tpx() > K.TITLE_MAX_PX), width_px=_tpx, limit_px=lambda: F.lit(K.TITLE_MAX_PX), chars=lambda: F.char_length(_t()))
simple("META-TITLE-TOO-SHORT", "low", lambda: idx() & ~X.blank(c("title")) & (F.char_length(_t()) < K.TITLE_MIN_CHARS), chars=lambda: F.char_length(_t()), min_chars=lambda: F.lit(K.TITLE_MIN_CHARS), width_px=_tpx)
simple("META-TITLE-MULTIPLE", "medium", lambda: idx() & (c("title_count") > 1), titles=lambda: c("title_count"))
simple("META-DESC-MISSING", "high", lambda: idx() & X.blank(c("meta_description")))
simple("META-DESC-TOO-LONG", "low", lambda: idx() & ~X.blank(c("meta_description")) & (_dpx() > K.DESC_MAX_PX), width_px=_dpx, limit_px=lambda: F.lit(K.DESC_MAX_PX), chars=lambda: F.char_length(_d()))
simple("META-DESC-TOO-SHORT", "low", lambda: idx() & ~X.blank(c("meta_description")) & (F.char_length(_d()) < K.DESC_MIN_CHARS), chars=lambda: F.char_length(_d()), min_chars=lambda: F.lit(K.DESC_MIN_CHARS))
simple("META-VIEWPORT-MISSING", "high", lambda: idx() & X.blank(c("viewport")))
simple("META-REFRESH", "high", lambda: idx() & ~X.blank(c("refresh")), content=lambda: c("refresh"))
simple("META-OUTSIDE-HEAD", "high", lambda: ok() & (F.size("outside_head") > 0), lambda: F.concat(F.lit("outside-head:"), F.regexp_extract("closed_by", "^<*([^ >]*)", 1), F.lit(":"), F.array_join("outside_head", ",")), closed_by=lambda: c("closed_by"), tags=lambda: c("outside_head"))

# canonical
simple("CANON-MISSING", "medium", lambda: idx() & X.blank(c("canonical_raw")))
simple("CANON-MULTIPLE", "high", lambda: ok() & (c("canonical_count") > 1), count=lambda: c("canonical_count"))
simple("CANON-RELATIVE", "medium", lambda: ok() & ~X.blank(c("canonical_raw")) & ~U.has_scheme(c("canonical_raw")), canonical_raw=lambda: c("canonical_raw"), resolved=lambda: c("canonical"))


@rule("CANON-CROSS-DOMAIN", "medium")
def _():
    a, b = U.without_www(U.host(c("url"))), U.without_www(U.host(c("canonical")))
    return found(ok() & c("canonical").isNotNull() & (a != "") & (b != "") & (a != b), "medium", canonical=c("canonical"), page_host=a, canonical_host=b)


# content
_h1 = lambda: F.filter("headings", lambda h: h["level"] == 1)
_first_blank = lambda: X.blank(F.get(_h1(), F.lit(0))["text"])
simple("CONTENT-H1-MISSING", "high", lambda: idx() & ((F.size(_h1()) == 0) | _first_blank()), h1_count=lambda: F.size(_h1()))
simple("CONTENT-H1-MULTIPLE", "low", lambda: idx() & (F.size(_h1()) > 1), h1_count=lambda: F.size(_h1()))
simple("CONTENT-H1-EMPTY", "medium", lambda: idx() & (F.size(_h1()) > 0) & _first_blank(), h1_count=lambda: F.size(_h1()))


@rule("CONTENT-HEADING-SKIP", "low")
def _():
    hs = c("headings")
    steps = F.transform(hs, lambda h, i: F.struct(F.get(hs, i - 1)["level"].alias("from"), h["level"].alias("to"), i.alias("index"), F.left(h["text"], F.lit(120)).alias("text")))
    skips = F.filter(steps, lambda s: (s["index"] > 0) & (s["to"] > s["from"] + 1))
    one = F.get(skips, F.lit(0))
    return found(idx() & (F.size(skips) > 0), "low", F.concat_ws(":", F.lit("skip"), one["from"], one["to"], one["text"]), **{"from": one["from"], "to": one["to"], "index": one["index"], "skips": F.size(skips), "text": one["text"]})


simple("CONTENT-THIN", "high", lambda: idx() & (c("word_count") < K.THIN_WORDS), word_count=lambda: c("word_count"), threshold=lambda: F.lit(K.THIN_WORDS))
simple("CONTENT-LANG-MISSING", "medium", lambda: idx() & X.blank(c("lang")))


# assets
@rule("ASSET-IMG-NO-ALT", "high")
def _():
    bad = F.transform(F.filter("images", lambda i: i["alt"].isNull()), lambda i: shown(i["src"]))
    return found(ok() & (F.size(bad) > 0), "high", images=F.size(bad), sample=sample(bad))


@rule("ASSET-IMG-EMPTY-ALT-LINK", "high")
def _():
    silent = F.transform(F.filter("links", lambda l: (l["element"] == "a") & X.blank(l["text"])), lambda l: l["position"])
    bad = F.transform(F.filter("images", lambda i: i["alt"].isNotNull() & X.blank(i["alt"]) & F.coalesce(F.array_contains(silent, i["anchor"]), F.lit(False))), lambda i: i["src"])
    one = lambda s: F.struct(
        F.lit("high").alias("severity"),
        F.concat(F.lit("img:"), F.md5(s)).alias("group_key"),
        F.to_json(F.struct(shown(s).alias("src"), F.nullif(F.size(F.filter(bad, lambda x: x == s)), F.lit(1)).alias("occurrences"))).alias("detail_json"),
    )
    return F.when(ok(), F.transform(F.array_distinct(bad), one))


# hreflang
_keys = lambda: F.transform("hreflang", lambda h: U.url_key(F.coalesce(h["url"], h["href"])))


def _own(k: Column) -> Column:
    return (k == U.url_key(c("url"))) | F.coalesce(k == U.url_key(c("canonical")), F.lit(False))


simple("HREFLANG-NO-SELF", "high", lambda: idx() & (F.size("hreflang") > 0) & ~F.exists(_keys(), _own), alternates=lambda: F.size("hreflang"), codes=lambda: F.transform("hreflang", lambda h: h["code"]))


@rule("HREFLANG-INVALID-CODE", "high")
def _():
    def one(code: Column) -> Column:
        reason = X.check_code(code)
        href = F.get(F.filter("hreflang", lambda h: h["code"] == code), F.lit(0))["href"]
        return F.struct(F.lit("high").alias("severity"), F.concat(F.lit("hreflang-code:"), code).alias("group_key"), F.to_json(F.struct(code.alias("code"), reason.alias("reason"), X.suggest_code(code, reason).alias("suggestion"), href.alias("href"))).alias("detail_json"))

    return F.when(ok(), F.transform(F.filter(F.array_distinct(F.transform("hreflang", lambda h: h["code"])), lambda x: X.check_code(x).isNotNull()), one))


@rule("HREFLANG-LANG-MISMATCH", "medium")
def _():
    own = F.filter("hreflang", lambda h: _own(U.url_key(F.coalesce(h["url"], h["href"]))) & X.primary_language(h["code"]).isNotNull() & (F.lower(h["code"]) != "x-default"))
    page = X.primary_language(c("lang"))
    one = F.get(own, F.lit(0))
    none = ~F.exists(own, lambda h: X.same_language(X.primary_language(h["code"]), page))
    return found(ok() & idx() & (F.size(own) > 0) & page.isNotNull() & none, "medium", F.concat_ws(":", F.lit("hreflang-lang"), page, one["code"]), html_lang=c("lang"), hreflang=one["code"], href=one["href"])


simple("HREFLANG-SELF-ONLY", "low", lambda: ok() & idx() & (F.size("hreflang") > 0) & F.forall(_keys(), _own), lambda: group_of("hreflang-self:", F.transform("hreflang", lambda h: h["code"])), codes=lambda: F.transform("hreflang", lambda h: h["code"]))


# social and links
@rule("SOCIAL-OG-MISSING", "low")
def _():
    wanted = F.lit(["og:title", "og:description", "og:image"])
    there = F.transform("og", lambda o: o["key"])
    missing = F.array_except(wanted, there)
    return found(idx() & (F.size(missing) > 0), "low", F.concat(F.lit("og:"), F.array_join(missing, ",")), missing=missing, present=F.array_intersect(wanted, there))


@rule("LINK-ANCHOR-EMPTY", "medium")
def _():
    bad = F.transform(some(c("links"), lambda l: (l["element"] == "a") & internal(l) & ~l["href"].startswith("#") & X.blank(l["text"]) & ~l["has_image"] & ~l["labelled"]), lambda l: l["href"])
    return found(ok() & (F.size(bad) > 0), "medium", group_of("anchor-empty:", bad), links=F.size(bad), sample=sample(bad))


@rule("LINK-ANCHOR-GENERIC", "low")
def _():
    slug = lambda l: X.fold_anchor(F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_extract(U.path(l["url"]), r"([^/]+)/?$", 1)), F.lit("")), "[-_]", " "))
    bad = some(c("links"), lambda l: (l["element"] == "a") & internal(l) & ~X.blank(l["text"]) & X.is_generic_anchor(X.fold_anchor(l["text"]), c("lang")) & ~F.coalesce(slug(l) == X.fold_anchor(l["text"]), F.lit(False)))
    texts = F.transform(bad, lambda l: X.fold_anchor(l["text"]))
    return found(ok() & (F.size(bad) > 0), "low", group_of("anchor-generic:", texts), links=F.size(bad), texts=sample(texts), sample=sample(F.transform(bad, lambda l: l["href"])))


def _named(r: PageRule) -> Column:
    """A rule's findings with its id and category."""
    of = lambda x: F.struct(F.lit(r.id).alias("rule_id"), x["severity"].alias("severity"), F.lit(r.category).alias("category"), x["group_key"].alias("group_key"), x["detail_json"].alias("detail_json"))
    return F.transform(F.coalesce(r.evaluate().cast(_FINDING), F.array().cast(_FINDING)), of)


def _todo(only: set[str] | None) -> list[PageRule]:
    return [r for r in RULES if only is None or r.id in only]


#: What rules read of a page besides what the parser finds.
_FETCHED = "url string, status_code int, x_robots_tag string, ttfb_ms int, is_html boolean, is_indexable boolean"


def fields(only: set[str] | None = None) -> frozenset[str]:
    """The fields that the parser must find for these rules, or for all."""
    return _fields(frozenset(r.id for r in _todo(only)))


@lru_cache(maxsize=None)
def _fields(ids: frozenset[str]) -> frozenset[str]:
    """Kept, since they hang on the rules alone, and analysis is not free."""
    return frozenset(html.fields_of([_named(r) for r in _todo(set(ids))], _FETCHED))


def evaluate(pages: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Findings of all page rules, or of some: one projection and one explode, without a shuffle."""
    each = [_named(r) for r in _todo(only)]
    if not each:
        return pages.sparkSession.createDataFrame([], ISSUE)
    return pages.select("url", F.explode(F.concat(*each)).alias("f")).select("f.rule_id", "f.severity", "f.category", "url", "f.group_key", "f.detail_json")
