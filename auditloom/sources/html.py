"""Web pages to relations: one pass over each page with the standard library's tokenizer, in Arrow batches."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import constants as K
from auditloom.functions.urls import normalize

LINK = "struct<element:string,href:string,url:string,fragment:string,text:string,rel:string,nofollow:boolean,region:string,position:int,labelled:boolean,has_image:boolean>"
IMAGE = "struct<src:string,url:string,alt:string,width:bigint,height:bigint,lazy:boolean,anchor:int>"
SCHEMA = (
    "title string, title_count int, titles array<string>, meta_description string, meta_robots string, viewport string, refresh string, canonical_raw string, canonical string,"
    "canonical_count int, amphtml string, lang string, headings array<struct<level:int,text:string>>, hreflang array<struct<code:string,href:string,url:string>>,"
    "og array<struct<key:string,value:string>>, twitter array<struct<key:string,value:string>>, schema_types array<string>, word_count int, text_bytes bigint, html_bytes bigint, content_ratio double,"
    f"body_text string, outside_head array<string>, closed_by string, ids array<string>, links array<{LINK}>, images array<{IMAGE}>, text_minhash binary, shingles binary, html_hash string, text_hash string"
)
#: Found only where it is named: the title as the source spells it, without its outer blanks.
MORE = "title_raw string"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = set("base basefont bgsound head html link meta noscript script style template title noframes".split())
RAW_HEAD = set("title script style noscript template noframes".split())
#: The names in ``SCHEMA``: what stands after a comma that is not inside angle brackets.
FIELDS = tuple(x.split()[0] for x in re.split(r",\s*(?![^<]*>)", SCHEMA))
SILENT = set("script style nav footer noscript template".split())
REGIONS = set("nav main footer aside".split())
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]{1,8}|[A-Za-z]{2,31});")


def decode_entities(text: str) -> str:
    """The named entities of a short list and numeric ones; others, and those without ``;``, stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        return _html.unescape(m[0]) if name[0] == "#" or name in K.NAMED_ENTITIES else m[0]

    return _ENTITY.sub(one, text)


def collapse(text: str) -> str:
    return " ".join(decode_entities(text).split())


def _splitmix(x: int) -> int:
    m = (1 << 64) - 1
    z = (x + 0x9E3779B97F4A7C15) & m
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
    return z ^ z >> 31


_MUL = np.array([_splitmix(2 * i) & 0xFFFFFFFF | 1 for i in range(K.PERMUTATIONS)], dtype=np.uint32)
_ADD = np.array([_splitmix(2 * i + 1) & 0xFFFFFFFF for i in range(K.PERMUTATIONS)], dtype=np.uint32)


def shingles(text: str) -> np.ndarray | None:
    """The hashes of a text's three-word shingles, each once, ascending; None if they are too few to compare."""
    words = re.findall(r"[^\W_]+", text.lower())
    if len(words) - 2 < K.MIN_SHINGLES:
        return None
    h = [xxhash.xxh3_64_digest(w.encode())[::-1] for w in words]
    s = np.array([xxhash.xxh3_64_intdigest(b"".join(h[i : i + 3])) for i in range(len(h) - 2)], dtype=np.uint64)
    return np.unique((s ^ s >> np.uint64(32)).astype(np.uint32))


def minhash(text: str) -> bytes | None:
    """The signature of a text."""
    x = shingles(text)
    return None if x is None else signature(x)


def signature(x: np.ndarray) -> bytes:
    """Of every permutation of the shingles the least value's low byte."""
    mins = np.full(K.PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        mins = np.minimum(mins, (_MUL[:, None] * x[None, i : i + 4096] + _ADD[:, None]).min(axis=1))
    return mins.astype(np.uint8).tobytes()


def schema_types(blob: str) -> list[str]:
    try:
        todo = [json.loads(blob)]
    except ValueError:
        return []
    out: list[str] = []
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            t = x.get("@type")
            out += [v for v in (t if isinstance(t, list) else [t]) if isinstance(v, str)]
            todo += list(x.values())
        elif isinstance(x, list):
            todo += x
    return list(dict.fromkeys(out))[:64]


_BLANK = " \t\n\r\f\ufeff"
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_TAG = re.compile(r"<\s*[^\s/>]+")
#: Comments without a dash or a bracket inside, one behind the other.
_COMMENTS = re.compile(r"(?:<!--[^-<>]*-->)+")


def attributes(raw: str) -> list[tuple[str, str | None]]:
    """The attributes of a start tag's source, decoded like text is."""
    at = _TAG.match(raw)
    pairs = ((m[1].lower(), m[2]) for m in _ATTR.finditer(raw, at.end() if at else 0))
    return [(k, None if v is None else decode_entities(v[1:-1] if v[0] in "\"'" else v)) for k, v in pairs]


class Page(HTMLParser):
    """Keeps a stack of open elements; stray end tags are ignored and void elements never opened.

    The head ends where it does for a browser: with its end tag, or with the first element or text that cannot be in it, be it
    closed or not.  From then on, text is the page's."""

    def __init__(self, url: str | None, links: bool = True, images: bool = True, text: bool = True):
        super().__init__(convert_charrefs=False)
        self.url = url
        self.want_links, self.want_images, self.want_text = links, images, text
        self.stack: list[str] = []
        self.silent = 0  # open elements whose text is not content
        self.asides = 0
        self.svgs = 0
        self.row: dict = {"title": None, "title_count": 0, "titles": [], "canonical_count": 0, "headings": [], "hreflang": [], "og": [], "twitter": [], "schema_types": [], "outside_head": [], "ids": [], "links": [], "images": [], "word_count": 0, "text_bytes": 0}
        self.text: list[str] = []
        self.core: list[str] = []
        self.chunk: list[str] = []
        self.catch: list[tuple[str, list[str]]] = []  # open title, heading, anchor and JSON-LD texts
        self.anchor: dict | None = None
        self.started, self.closed_by, self.position = False, None, 0

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As the tokenizer does, but a row of plain comments, of which nothing is kept, in one step."""
        m = _COMMENTS.match(self.rawdata, i)
        return m.end() if m else super().parse_comment(i, report)

    # -- text ---------------------------------------------------------------------------------------------------
    def flush(self) -> None:
        raw, self.chunk = "".join(self.chunk), []
        if not raw:
            return
        for _, parts in self.catch:
            parts.append(raw + " ")
        if not self.started:
            if RAW_HEAD & set(self.stack) or not (seen := raw.strip(_BLANK)):
                return
            if "head" in self.stack or not self.stack:
                self.start_body(f'#text "{seen[:40].rstrip()}"')
        if self.silent:
            return
        words = raw.split()
        self.row["word_count"] += len(words)
        if not self.asides:
            self.core.append(raw)
        if words and self.want_text:
            self.text.append(raw.strip())
        if words:
            self.row["text_bytes"] += len(raw.strip().encode("utf-8", "surrogatepass"))

    def handle_data(self, data: str) -> None:
        self.chunk.append(data)

    def handle_entityref(self, name: str) -> None:
        # the tokenizer also reports names without their semicolon; what stood there tells
        end = ";" if self.source.startswith(f"&{name};", self._at()) else ""
        self.chunk.append(f"&{name}{end}")

    def handle_charref(self, name: str) -> None:
        end = ";" if self.source.startswith(f"&#{name};", self._at()) else ""
        self.chunk.append(f"&#{name}{end}")

    # -- head ---------------------------------------------------------------------------------------------------
    def start_body(self, by: str) -> None:
        if not self.started:
            self.started, self.closed_by = True, by

    def outside(self, what: str) -> None:
        if self.started and what not in self.row["outside_head"]:
            self.row["outside_head"].append(what)

    def closes_head(self, tag: str, a: dict[str, str]) -> None:
        """An element that cannot be in a head starts the body: one in the head, next to it, or before it."""
        if self.started or tag in HEAD_TAGS or (RAW_HEAD & set(self.stack)):
            return
        if "head" in self.stack or not self.stack or self.stack[-1] == "html":
            from_ = next((f' {k}="{a[k][:80]}"' for k in ("src", "href", "id", "class", "name") if k in a), "")
            self.start_body(f"<{tag}{from_}>")

    # -- tags ---------------------------------------------------------------------------------------------------
    def link(self, element: str, href: str | None, **more) -> dict | None:
        if href is None or not href.strip():
            return None
        href = href.strip()
        x = {"element": element, "href": href, "url": None, "fragment": None, "text": None, "rel": None, "nofollow": False, "region": "unknown", "position": self.position, "labelled": False, "has_image": False} | more
        if self.want_links:
            x["url"] = normalize(href, self.url)
            x["region"] = next((t for t in reversed(self.stack) if t in REGIONS), "unknown")
            x["fragment"] = link_fragment(href)
        self.position += 1
        self.row["links"].append(x)
        return x

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        source = self.get_starttag_text() or ""
        if "&" in source:  # the tokenizer decodes by another table
            attrs = attributes(source)
        a = {k: v or "" for k, v in reversed(attrs)}
        self.closes_head(tag, a)
        if a.get("id"):
            self.row["ids"].append(a["id"])
        if tag == "a" and a.get("name"):
            self.row["ids"].append(a["name"])
        r = self.row
        if tag == "html":
            r.setdefault("lang", a.get("lang"))
        elif tag == "title" and not self.svgs:
            r["title_count"] += 1
            self.outside("title")
            self.catch.append(("title", []))
        elif tag == "meta":
            self.meta(a)
        elif tag == "link":
            self.rel(a)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.catch.append((tag, []))
        elif tag == "a" and a.get("href", "").strip():
            rel = (a.get("rel") or "").lower()
            self.anchor = self.link("a", a["href"], rel=rel or None, nofollow="nofollow" in rel.split(), labelled=bool({"aria-label", "aria-labelledby", "title"} & set(a)))
            self.catch.append(("a", []))
        elif tag == "svg" and self.anchor and a.get("aria-label", "").strip():
            self.anchor["labelled"] = True
        elif tag == "img":
            self.image(a)
        elif tag in ("script", "iframe"):
            self.link(tag, a.get("src"))
            if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
                self.catch.append(("script", []))
        elif tag == "form" and a.get("method", "get").strip().lower() in ("", "get"):
            self.link("form", a.get("action"))
        if tag not in VOID:
            self.stack.append(tag)
            self.count(tag, 1)

    def count(self, tag: str, by: int) -> None:
        if tag in SILENT:
            self.silent += by
        elif tag == "aside":
            self.asides += by
        elif tag == "svg":
            self.svgs += by

    def meta(self, a: dict[str, str]) -> None:
        r, content = self.row, a.get("content")
        if a.get("http-equiv", "").strip().lower() == "refresh":
            r["refresh"] = content
            return
        name, prop = a.get("name", "").lower(), a.get("property", "").lower()
        if name in ("description", "robots", "googlebot"):
            self.outside("meta description" if name == "description" else "meta robots")
        if name == "description":
            r["meta_description"] = content
        elif name == "robots":
            r["meta_robots"] = content
        elif name == "viewport":
            r["viewport"] = content
        elif content is not None and name.startswith("twitter:"):
            r["twitter"].append({"key": name, "value": content})
        elif content is not None and prop.startswith("og:"):
            if prop == "og:image" and content.strip() and not any(x["key"] == "og:image" for x in r["og"]):
                self.link("meta", content, rel=prop)
            r["og"].append({"key": prop, "value": content})

    def rel(self, a: dict[str, str]) -> None:
        rel, href, r = a.get("rel", "").strip().lower(), a.get("href"), self.row
        if href is None:
            return
        if rel == "canonical":
            r["canonical_count"] += 1
            self.outside("canonical")
            if "canonical_raw" not in r:
                r["canonical_raw"], r["canonical"] = href.strip(), normalize(href, self.url) if href.strip() else None
        elif rel == "amphtml":
            r["amphtml"] = normalize(href, self.url)
        elif rel == "alternate" and "hreflang" in a:
            self.outside("hreflang")
            r["hreflang"].append({"code": a["hreflang"], "href": href.strip(), "url": normalize(href, self.url)})
        elif rel == "stylesheet":
            self.link("link", href)

    def image(self, a: dict[str, str]) -> None:
        src, lazy = a.get("src", "").strip(), False
        if not src or src.startswith("data:"):
            late = next((a[k].strip() for k in ("data-src", "data-lazy-src", "data-original", "data-lazy") if a.get(k, "").strip()), "")
            if not late and a.get("srcset", "").strip():
                late = (a["srcset"].split(",")[0].split() or [""])[0]
            src, lazy = late or src, bool(late)
        if self.anchor:
            self.anchor["has_image"] = True
        if self.want_images:
            number = lambda k: int(a[k]) if re.fullmatch(r"[+-]?\d{1,18}", a.get(k, "")) else None
            self.row["images"].append({"src": src, "url": normalize(src, self.url) if src else None, "alt": a.get("alt"), "width": number("width"), "height": number("height"), "lazy": lazy, "anchor": self.anchor["position"] if self.anchor else None})
        if src:
            self.link("img", src)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            self.count(top, -1)
            if top == tag:
                break
        for i in range(len(self.catch) - 1, -1, -1):
            kind, parts = self.catch[i]
            if kind == tag:
                del self.catch[i]
                self.caught(tag, "".join(parts))
                break

    def caught(self, tag: str, raw: str) -> None:
        r = self.row
        if tag == "title":
            r["titles"].append(collapse(raw))
            if r["title"] is None:
                r["title"], r["title_raw"] = collapse(raw), raw.strip()
        elif tag == "a" and self.anchor is not None:
            self.anchor["text"] = collapse(raw) or None
            self.anchor = None
        elif tag == "script":
            r["schema_types"] = list(dict.fromkeys(r["schema_types"] + schema_types(raw)))[:64]
        elif tag[0] == "h":
            r["headings"].append({"level": int(tag[1]), "text": collapse(raw)})

    def _at(self) -> int:
        """Where the tokenizer stands in what it was fed."""
        line, column = self.getpos()
        return self._starts[line - 1] + column

    def feed(self, data: str) -> None:
        self.source = data
        self._starts = [0, *(m.end() for m in re.finditer("\n", data))]
        super().feed(data)


def link_fragment(href: str) -> str | None:
    """What stands behind ``#``, as a URL spells it: blanks, quotes, angle brackets and whatever is not ASCII as %XX."""
    if "#" not in href:
        return None
    tail = re.sub(r"[\t\n\r]", "", decode_entities(href).partition("#")[2].rstrip("".join(map(chr, range(33)))))
    return "".join(chr(b) if 32 < b < 127 and chr(b) not in "\"<>`" else f"%{b:02X}" for b in tail.encode("utf-8", "surrogatepass")) or None


def parse_page(text: str | None, url: str | None, fields: frozenset[str] = frozenset(FIELDS)) -> dict:
    """One page as a row of ``SCHEMA``; null is an empty page.  What is not among the ``fields`` is not computed where it
    costs much, and must not be relied on."""
    p, raw = Page(url, "links" in fields, "images" in fields, bool(fields & {"body_text", "text_hash"})), text or ""
    p.feed(raw)
    p.close()
    p.flush()
    for kind, parts in reversed(p.catch):
        if kind in ("title", "a"):
            p.caught(kind, "".join(parts))
    row = p.row | {"closed_by": p.closed_by, "ids": sorted(set(p.row["ids"]))}
    if fields & {"html_bytes", "html_hash", "content_ratio"}:
        data = raw.encode("utf-8", "surrogatepass")
        row |= {"html_bytes": len(data), "html_hash": xxhash.xxh3_64_hexdigest(data), "content_ratio": row["text_bytes"] / len(data) if data else 0.0}
    if fields & {"body_text", "text_hash"}:
        body = " ".join(p.text)
        row |= {"body_text": body, "text_hash": xxhash.xxh3_64_hexdigest(body.encode("utf-8", "surrogatepass"))}
    if fields & {"text_minhash", "shingles"} and (x := shingles(decode_entities(" ".join(p.core)))) is not None:
        row |= {"shingles": x.astype("<u4").tobytes(), "text_minhash": signature(x) if "text_minhash" in fields else None}
    return row


def parse(pages: DataFrame, url: str = "url", html: str = "html", rows: int = 64, fields: Iterable[str] | None = None) -> DataFrame:
    """``pages`` without the html column and with the columns of ``SCHEMA``, or those named in ``fields`` (of ``MORE`` too): the
    others are neither shipped nor, where they cost much, computed."""
    keep = [c for c in pages.columns if c != html]
    wanted = [f for f in T._parse_datatype_string(SCHEMA if fields is None else f"{SCHEMA}, {MORE}").fields if fields is None or f.name in set(fields)]
    schema = T.StructType([*pages.select(*keep).schema.fields, *wanted])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, names = to_arrow_schema(T.StructType(wanted)), frozenset(f.name for f in wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                got = [parse_page(h, u, names) for h, u in zip(part.column(len(keep)).to_pylist(), part.column(keep.index(url)).to_pylist())]
                cols = [pa.array([g.get(f.name) for g in got], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *cols], schema.fieldNames())

    return pages.select(*keep, F.col(html).cast("string")).mapInArrow(run, schema)


def fields_of(columns: Iterable[Column], more: str) -> set[str]:
    """The fields of ``SCHEMA`` that expressions over parsed pages (with the columns ``more`` besides) refer to, as the analyzer
    tells."""
    spark = SparkSession.active()
    empty = spark.createDataFrame([], f"{SCHEMA}, {more}")
    used = empty.select(*columns)._jdf.queryExecution().analyzed().references().toList().mkString("\n")
    return {x.partition("#")[0] for x in used.split("\n")} & set(FIELDS)


class HtmlLinks:
    """``html_links(html, base)`` as a table function in SQL: a row for each link of a page."""

    def eval(self, text: str | None, base: str | None) -> Iterator[tuple]:
        for x in parse_page(text, base, frozenset({"links"}))["links"]:
            yield x["element"], x["href"], x["url"], x["text"], x["nofollow"], x["region"]


def register_html_links(spark: SparkSession) -> None:
    kind = "element string, href string, url string, text string, nofollow boolean, region string"
    spark.udtf.register("html_links", F.udtf(HtmlLinks, returnType=kind))
