"""URL functions.  Scalar ones are plain Python for use inside vectorized UDFs; what regular expressions can say is a Column."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urljoin, urlsplit, urlunsplit

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.constants import TRACKING

_DEFAULT_PORT = {"http": 80, "https": 443}


def normalize(url: str | None, base: str | None = None, slash: str = "as_is") -> str | None:
    """The canonical text of a URL, resolved against ``base``: no user, no default port, no fragment but ``#!``, no tracking
    parameters, the others sorted; None if it cannot be read.  ``slash``: as_is, add or remove a path's last one."""
    if url is None:
        return None
    raw = re.sub(r"[\t\r\n]", "", url.strip())
    try:
        parts = urlsplit(urljoin(base, raw) if base else raw)
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if not scheme or (scheme in _DEFAULT_PORT and not parts.hostname):
        return None
    if scheme not in _DEFAULT_PORT:
        return urlunsplit(parts)
    try:
        host = parts.hostname.encode("idna").decode() if not parts.hostname.isascii() else parts.hostname
    except UnicodeError:
        return None
    netloc = f"[{host}]" if ":" in host else host
    if port and port != _DEFAULT_PORT[scheme]:
        netloc += f":{port}"
    path = _dots(quote(parts.path, safe="/%:@!$&'()*+,;=~-._")) or "/"
    if slash == "add" and not path.endswith("/") and "." not in path.rpartition("/")[2]:
        path += "/"
    if slash == "remove" and len(path) > 1:
        path = path.rstrip("/") or "/"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING and not k.lower().startswith("utm_"))
    query = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in pairs)
    return urlunsplit((scheme, netloc, path, query, parts.fragment if parts.fragment.startswith("!") else ""))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        if p.lower() in (".", "%2e"):
            out += [""] if i == len(parts) - 1 else []
        elif p.lower() in ("..", "%2e%2e", ".%2e", "%2e."):
            if len(out) > 1:
                out.pop()
            out += [""] if i == len(parts) - 1 else []
        else:
            out.append(p)
    return "/".join(out)


def url_hash(url: str) -> int:
    h = xxhash.xxh3_64_intdigest(url.encode())
    return h - (1 << 64) * (h >> 63)


def percent_decode(text: str) -> str:
    """Byte by byte; what is no %XX stays."""
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode("utf-8", "replace")


def is_public_address(host: str) -> bool:
    """Whether a crawler may visit the host: no private, reserved or metadata address and no name of a local network."""
    h = host.strip("[]").lower().rstrip(".")
    try:
        ip = ipaddress.ip_address(h)
    except ValueError:
        return bool(h) and "." in h and not h.endswith((".local", ".localhost", ".internal", ".lan", ".home", ".corp", ".intranet", ".test", ".invalid", ".example", ".onion", ".home.arpa"))
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast


def resolve_light(href: str, page: str) -> str:
    """An alternate's address against its page's, without any normalization: by scheme, ``//``, ``/``, ``?``, ``#`` or relative
    with its dot segments."""
    h = href.strip()
    scheme, _, rest = page.partition("://")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", h):
        return h
    if h.startswith("//"):
        return f"{scheme}:{h}"
    site, slash, path = rest.partition("/")
    path = (slash + path).partition("#")[0]
    if not h or h.startswith("#"):
        return f"{scheme}://{site}{path}"
    path = path.partition("?")[0]
    if h.startswith("?"):
        return f"{scheme}://{site}{path}{h}"
    at, mark, query = h.partition("?")
    if not h.startswith("/"):
        at = path.rpartition("/")[0] + "/" + at
    return f"{scheme}://{site}{_dots(at)}{mark}{query}"


@F.pandas_udf(T.StringType())
def normalize_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize)


@F.pandas_udf(T.StringType())
def resolve_udf(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([normalize(h, b) for b, h in zip(bases, hrefs)], dtype=object)


@F.pandas_udf(T.LongType())
def url_hash_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else url_hash(u)).astype("Int64")


@F.pandas_udf(T.BooleanType())
def public_udf(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda h: h is not None and is_public_address(h))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def has_scheme(url: Column) -> Column:
    return F.ltrim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def authority(url: Column) -> Column:
    """host[:port], lower-cased, without the user."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d+$", "")


def without_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_internal(url: Column, base: Column) -> Column:
    return authority(url) == authority(base)


def in_scope(urls: DataFrame, seeds: DataFrame, col: str = "url") -> DataFrame:
    """``urls`` with ``in_scope``: whether the authority is that of a seed (url).  Seeds of a list name as many sites as they
    like, so they are joined; a seed's site is there once."""
    sites = seeds.select(authority(F.col("url")).alias("_site")).where("_site != ''").distinct().withColumn("_in", F.lit(True))
    j = urls.join(sites, authority(F.col(col)) == F.col("_site"), "left")
    return j.select(*urls.columns, F.coalesce("_in", F.lit(False)).alias("in_scope"))


def internal_links(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``links`` (from_url, to_url) with ``internal``: with one site, whether the target is in it; with several, whether it is in
    the page's own and that is one of them."""
    one = seeds.select(authority(F.col("url")).alias("a")).distinct().limit(2).count() <= 1
    j = in_scope(links, seeds, "to_url")
    same = F.lit(True) if one else authority(F.col("from_url")) == authority(F.col("to_url"))
    return j.select(*links.columns, (F.col("in_scope") & same).alias("internal"))


def is_crawlable(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_infrastructure(url: Column) -> Column:
    return path(url).startswith("/cdn-cgi/")


def allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusions win; no inclusions allow everything; patterns may match anywhere."""
    out = F.lit(not include)
    for p in include:
        out = out | url.rlike(p)
    for p in exclude:
        out = out & ~url.rlike(p)
    return out


def url_key(url: Column) -> Column:
    """For comparing alternates: no fragment, scheme and authority lower-cased, no index file, no last slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    return F.concat(head, F.regexp_replace(F.regexp_replace(rest, r"/index\.html?$", "/"), r"/$", ""))


def pagination_base(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/(?:page|pagina)/\d+/?$", 1)


def content_type(p: Column) -> Column:
    """By the file's extension."""
    kinds = {
        "html?": "text/html", "css": "text/css", "m?js": "text/javascript", "json": "application/json", "xml": "application/xml", "txt": "text/plain", "svg": "image/svg+xml",
        "png": "image/png", "jpe?g": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "pdf": "application/pdf", "woff2?": "font/woff2",
    }
    out = F.lit("application/octet-stream")
    for ext, kind in reversed(kinds.items()):
        out = F.when(F.lower(p).rlike(rf"\.{ext}$"), kind).otherwise(out)
    return out


def image_format(url: Column) -> Column:
    ext = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext.isin("png", "webp", "avif", "svg", "gif"), ext)


def resource_kind(url: Column, mime: Column) -> Column:
    ext = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    by_ext = (
        F.when(ext.isin("jpg", "jpeg", "png", "webp", "avif", "svg", "gif", "ico"), "img").when(ext == "css", "css").when(ext.isin("js", "mjs"), "js")
        .when(ext.isin("woff", "woff2", "ttf", "otf", "eot"), "font").when(ext.isin("mp4", "webm", "ogv", "mov"), "video")
    )
    m = F.lower(mime)
    by_mime = F.when(m.startswith("image/"), "img").when(m.contains("css"), "css").when(m.contains("javascript") | m.contains("ecmascript"), "js").when(m.contains("font"), "font").when(m.startswith("video/"), "video")
    return F.coalesce(by_mime, by_ext)


def lands(fragment: Column, ids: Column) -> Column:
    """Whether a fragment names a place on a page with these ids."""
    f = F.regexp_replace(fragment, r":~:.*$", "")
    return (f == "") | f.startswith("/") | f.startswith("!") | F.array_contains(ids, f) | F.array_contains(ids, F.coalesce(F.try_url_decode(F.replace(f, F.lit("+"), F.lit("%2B"))), f)) | (F.lower(f) == "top")
