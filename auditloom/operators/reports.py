"""Reports over a crawl: summaries, datasets, views, one URL's card, suggestions and search."""

from __future__ import annotations

import unicodedata
from html import escape
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import constants as K
from auditloom.functions import text as X
from auditloom.functions import urls as U
from auditloom.operators.redirects import chains, final_status
from auditloom.operators.site_rules import gone, orphans
from auditloom.plans.model import Crawl

c = F.col


# -- views ----------------------------------------------------------------------------------------------------------
def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule_id", "severity", "category").agg(F.count("*").alias("n"))


def indexable_pages(crawl: Crawl) -> DataFrame:
    return crawl.pages.where("is_indexable")


def broken_links(crawl: Crawl) -> DataFrame:
    """Links whose target is broken at the end of its redirects."""
    end = final_status(crawl.urls).where(gone()).select(c("url").alias("to_url"), "final_url", "hops", "status_code")
    return crawl.links.where("element = 'a'").join(end, "to_url").select("from_url", "to_url", "final_url", "hops", "status_code")


# -- summaries ------------------------------------------------------------------------------------------------------
def status_breakdown(crawl: Crawl) -> DataFrame:
    """Responses by class, own and foreign; URLs without a response by why."""
    kind = F.coalesce(X.status_class(c("status_code")), F.when(c("crawl_state") == "excluded", "out_of_scope").when(c("error_kind").isNotNull(), "no_response").otherwise("never_requested"))
    return crawl.urls.groupBy(kind.alias("class")).agg(F.count_if("is_internal").alias("internal"), F.count_if(~c("is_internal")).alias("external"))


def indexability_reasons(crawl: Crawl) -> DataFrame:
    return crawl.pages.groupBy(F.coalesce("indexability_reason", F.lit("indexable")).alias("reason")).agg(F.count("*").alias("pages"))


def exclusions(crawl: Crawl) -> DataFrame:
    return crawl.urls.where("exclusion_reason IS NOT NULL").groupBy("exclusion_reason").agg(F.count("*").alias("urls"))


def findings_summary(issues: DataFrame, total_pages: int) -> DataFrame:
    """Per rule and severity: findings, pages, template groups (a group so large that it must be a template), and whether the
    rule is pervasive."""
    site = F.count_if(c("url").isNull())
    per = issues.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), (F.countDistinct("url") + site).alias("pages"))
    g = issues.where("group_key != ''").groupBy("rule_id", "severity", "group_key").agg(F.countDistinct("url").alias("n"))
    template = (c("n") >= K.TEMPLATE_MIN) | ((c("n") >= K.TEMPLATE_FLOOR) & (c("n") * 100 >= total_pages * K.TEMPLATE_SHARE))
    t = g.where(template).groupBy("rule_id", "severity").agg(F.count("*").alias("template_groups"))
    pervasive = (c("pages") >= K.PERVASIVE_MIN) & (c("pages") * 100 >= total_pages * K.PERVASIVE_SHARE)
    return per.join(t, ["rule_id", "severity"], "left").select("rule_id", "severity", "findings", "pages", F.coalesce("template_groups", F.lit(0)).alias("template_groups"), pervasive.alias("pervasive"))


def urls_of_rule(issues: DataFrame, rule_id: str) -> DataFrame:
    out = issues.where(c("rule_id") == rule_id)
    depth = F.get_json_object("detail_json", "$.click_depth").cast("int")
    return out.orderBy(depth.desc_nulls_last(), "group_key", "url")


def base_mismatch(crawl: Crawl) -> DataFrame:
    """Origins that four fifths of all canonicals or more name though the crawl has another: a wrong base URL."""
    origin = F.concat(U.scheme(c("canonical")), F.lit("://"), U.authority(c("canonical")))
    p = crawl.pages.where("canonical IS NOT NULL").select(origin.alias("origin"))
    n = p.groupBy("origin").agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row an origin
    base = "{0.scheme}://{0.netloc}".format(urlsplit(crawl.base_url))
    return n.where((c("origin") != base) & (c("n") * 100 >= c("total") * 80))


def first_error(crawl: Crawl) -> DataFrame:
    """Why a crawl found nothing: its shallowest failure."""
    return crawl.urls.where("error_kind IS NOT NULL OR status_code >= 400").orderBy(F.col("depth").asc_nulls_last() if "depth" in crawl.urls.columns else c("url"), "url").limit(1)


def rule_groups(issues: DataFrame, examples: int = 3) -> DataFrame:
    """Rules by impact with a few examples each, the examples found without gathering a rule's URLs."""
    n = issues.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))
    w = Window.partitionBy("rule_id", "severity").orderBy("url")
    ex = issues.where("url IS NOT NULL").select("rule_id", "severity", "url").distinct().withColumn("_r", F.row_number().over(w)).where(c("_r") <= examples)
    ex = ex.groupBy("rule_id", "severity").agg(F.array_sort(F.collect_list("url")).alias("examples"))
    return n.join(ex, ["rule_id", "severity"], "left").orderBy(X.severity_rank(c("severity")), F.desc("findings"), "rule_id")


def audit_report(crawl: Crawl, issues: DataFrame, title: str = "Site audit") -> str:
    """A Markdown report from small aggregates: a row for each rule at most reaches the driver."""
    total = crawl.pages.count()
    lines = [f"# {title}", "", f"{crawl.base_url}: {total} pages" + (", truncated" if crawl.truncated else ""), "", "| class | internal | external |", "|-|-|-|"]
    lines += [f"| {r['class']} | {r['internal']} | {r['external']} |" for r in status_breakdown(crawl).orderBy("class").collect()]
    lines += ["", "| rule | severity | findings | examples |", "|-|-|-|-|"]
    lines += [f"| {r['rule_id']} | {r['severity']} | {r['findings']} | {', '.join(r['examples'] or [])} |" for r in rule_groups(issues).collect()]
    return "\n".join(lines) + "\n"


def number(n: int | float, thousands: str = ",", point: str = ".") -> str:
    """A number as people read it."""
    whole, _, rest = f"{n:,}".partition(".")
    return whole.replace(",", thousands) + (point + rest if rest else "")


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{number(n)} {one if n == 1 else many or one + 's'}"


def clipped(text: str | None, most: int = 255) -> str:
    """Foreign text made safe for a terminal or a report: no control characters, not longer than ``most``."""
    plain = "".join(ch for ch in text or "" if unicodedata.category(ch) not in ("Cc", "Cf"))
    return plain if len(plain) <= most else plain[: most - 1] + "…"


def html_report(crawl: Crawl, issues: DataFrame, title: str = "Site audit") -> str:
    """The same report as a page of its own; a row for each rule at most reaches the driver."""
    e = lambda x: escape(clipped(str(x)))
    total = crawl.pages.count()
    classes = "".join(f"<tr><td>{e(r['class'])}</td><td>{number(r['internal'])}</td><td>{number(r['external'])}</td></tr>" for r in status_breakdown(crawl).orderBy("class").collect())
    rules = "".join(f"<tr><td>{e(r['rule_id'])}</td><td>{e(r['severity'])}</td><td>{number(r['findings'])}</td><td>{'<br>'.join(e(u) for u in r['examples'] or [])}</td></tr>" for r in rule_groups(issues).collect())
    note = " <em>truncated</em>" if crawl.truncated else ""
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><p>{e(crawl.base_url)}: {plural(total, "page")}{note}</p>'
        f"<table><tr><th>class</th><th>internal</th><th>external</th></tr>{classes}</table><table><tr><th>rule</th><th>severity</th><th>findings</th><th>examples</th></tr>{rules}</table></body></html>\n"
    )


# -- datasets and sinks ---------------------------------------------------------------------------------------------
def datasets(crawl: Crawl) -> dict[str, DataFrame]:
    """The tabular datasets by name."""
    pages = crawl.pages
    plain = [f.name for f in pages.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint", "boolean", "double")]
    out = {
        "urls": crawl.urls,
        "pages": pages.select(*[x for x in plain if x != "body_text"]),
        "links": crawl.links,
        "broken_links": broken_links(crawl),
        "resources": crawl.links.where(c("element").isin("img", "script", "link")).select(c("to_url").alias("url")).distinct().join(crawl.urls, "url").withColumn("kind", U.resource_kind(c("url"), c("content_type")) if "content_type" in crawl.urls.columns else F.lit(None).cast("string")),
        "redirects": chains(crawl.urls, heads_only=False).join(crawl.links.groupBy(c("to_url").alias("url")).agg(F.count("*").alias("inbound_links")), "url", "left").select("url", "final_url", "hops", F.coalesce("inbound_links", F.lit(0)).alias("inbound_links")),
        "non_indexable": pages.where("NOT is_indexable").select("url", "indexability_reason"),
        "orphans": orphans(crawl),
        "summary": status_breakdown(crawl),
    }
    more = {"images": crawl.images, "robots": crawl.robots, "sitemaps": crawl.sitemaps, "issues": crawl.issues}
    out |= {k: v for k, v in more.items() if v is not None}
    if crawl.issues is not None:
        out["issues_by_rule"] = issue_summary(crawl.issues)
    return out


def cells(df: DataFrame, most: int = 32_767) -> DataFrame:
    """Every column as text that a spreadsheet can take: nulls empty, binaries named, no formulas, cells of bounded length."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        v = F.lit("<blob>") if kind == "binary" else F.to_json(c(f.name)) if kind.startswith(("array", "struct", "map")) else c(f.name).cast("string")
        out.append(F.left(X.neutral(F.coalesce(v, F.lit(""))), F.lit(most)).alias(f.name))
    return df.select(*out)


def export_csv(crawl: Crawl, folder: str, names: list[str] | None = None) -> list[str]:
    """One distributed CSV dataset a name."""
    todo = datasets(crawl)
    for name in names or sorted(todo):
        cells(todo[name]).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return names or sorted(todo)


# -- one URL --------------------------------------------------------------------------------------------------------
def candidate_urls(text: str, base_url: str) -> list[str]:
    """What a user may have meant, best first."""
    out = [text]
    if text.startswith("/") or "://" not in text:
        out.append(urljoin(base_url if base_url.endswith("/") else base_url + "/", text))
    if "://" not in text:
        out += [f"https://{text}", f"http://{text}", f"https://{text}/", f"http://{text}/"]
    for u in list(out):
        out.append(u.rstrip("/") if u.endswith("/") else u + "/")
        if u.startswith("http://"):
            out.append("https://" + u[7:])
        elif u.startswith("https://"):
            out.append("http://" + u[8:])
    return list(dict.fromkeys(out))


def inspect(crawl: Crawl, text: str, samples: int = 10) -> dict[str, DataFrame]:
    """A URL's card: itself, its page, redirects, findings, links in by region, a sample of them, links out and images."""
    cands = candidate_urls(text, crawl.base_url)
    rank = F.array_position(F.lit(cands), c("url"))
    hit = crawl.urls.where(c("url").isin(cands)).orderBy(rank).limit(1)
    own = lambda df, key: df.join(F.broadcast(hit.select(c("url").alias(key))), key, "left_semi")  # noqa: E731  one row
    into = own(crawl.links, "to_url")
    t = crawl.urls.select(c("url").alias("to_url"), "status_code", "is_internal")
    out = {
        "url": hit,
        "page": own(crawl.pages, "url"),
        "redirects": own(chains(crawl.urls, 12, heads_only=False), "url"),
        "inlinks_by_region": into.groupBy("region").agg(F.count("*").alias("links"), F.countDistinct("from_url").alias("pages")) if "region" in crawl.links.columns else into.agg(F.count("*").alias("links")),
        "inlinks": into.orderBy("from_url").limit(samples),
        "outlinks": own(crawl.links, "from_url").join(t, "to_url", "left").orderBy(F.coalesce(gone(), F.lit(False)).desc(), "to_url").limit(samples),
    }
    if crawl.issues is not None:
        out["issues"] = own(crawl.issues, "url").orderBy(X.severity_rank(c("severity")), "rule_id")
    if crawl.images is not None:
        out["images"] = own(crawl.images, "from_url")
    return out


def suggestions(crawl: Crawl, text: str, most: int = 6) -> DataFrame:
    """URLs that hold the text, shortest first, else those whose last path segment is near it."""
    last = text.rstrip("/").rpartition("/")[2].lower()
    seg = F.lower(F.regexp_extract(U.path(c("url")), r"([^/]+)/?$", 1))
    d = F.levenshtein(seg, F.lit(last), max(1, len(last) // 3))
    holds = F.instr(F.lower("url"), text.lower()) > 0
    out = crawl.urls.select("url", F.when(holds, 0).when(d >= 0, 1).alias("kind"), F.when(holds, F.length("url")).otherwise(d).alias("distance"))
    return out.where("kind IS NOT NULL").orderBy("kind", "distance", "url").limit(most)


# -- search ---------------------------------------------------------------------------------------------------------
_ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüçñ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucn"


def fold(col: Column) -> Column:
    return F.translate(F.lower(col), _ACCENTS, _PLAIN)


def index(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """An inverted index (term, field, key): folded terms of text columns, distinct; one pass for all columns."""
    terms = lambda x: F.array_distinct(F.split(fold(F.coalesce(F.col(x).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"))
    each = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(x).alias("field"), terms(x).alias("terms")) for x in columns])).alias("f"))
    return each.select(F.col(key), "f.field", F.explode("f.terms").alias("term")).where("term != ''").select("term", "field", key)


def search(idx: DataFrame, key: str, query: str) -> DataFrame:
    """Keys that have all terms; ``field:term`` asks for one field."""
    wanted = []
    for w in query.split():
        field_, _, term = w.rpartition(":")
        wanted.append((field_ or None, term.lower().translate(str.maketrans(_ACCENTS, _PLAIN))))
    if not wanted:
        return idx.select(key).limit(0)
    tags = F.array_compact(F.array(*[F.when((c("term") == t) & ((c("field") == f) if f else F.lit(True)), i) for i, (f, t) in enumerate(wanted)]))
    found = idx.where(c("term").isin([t for _, t in wanted])).select(key, F.explode(tags).alias("i"))
    return found.groupBy(key).agg(F.countDistinct("i").alias("n")).where(c("n") == len(wanted)).select(key)
