"""Text functions of the rules, as Columns where the engine has the means."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import constants as K


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, where ``f`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$")


def pixel_width(text: Column, font_px: float) -> Column:
    """Width in Arial: each class of characters is mapped to one letter, and letters are counted."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    total = F.char_length(t) * K.DEFAULT_WIDTH
    for width, chars in K.WIDTHS.items():
        escaped = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in chars)
        total = total + F.regexp_count(t, F.lit(f"[{escaped}]")) * (width - K.DEFAULT_WIDTH)
    return total * F.lit(font_px) / 1000.0


def noindex(directives: Column) -> Column:
    """Whether a comma-separated list of robots directives, each perhaps after an agent's name, says noindex or none."""
    return F.coalesce(F.exists(F.split(F.lower(directives), ","), lambda x: F.trim(F.substring_index(x, ":", -1)).isin("noindex", "none")), F.lit(False))


_FOLD = {
    **dict.fromkeys("áàâäãåą", "a"), **dict.fromkeys("éèêëę", "e"), **dict.fromkeys("íìîïı", "i"), **dict.fromkeys("óòôöõ", "o"), **dict.fromkeys("úùûü", "u"),
    **dict.fromkeys("çć", "c"), **dict.fromkeys("şś", "s"), "ğ": "g", "ł": "l", "ń": "n", **dict.fromkeys("źż", "z"), **dict.fromkeys("’‘´`", "'"),
}
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def fold_anchor(text: Column) -> Column:
    """Lower case, without full-width forms, marks, doubled blanks and outer punctuation."""
    t = F.regexp_replace(F.lower(F.translate(text, _WIDE, _NARROW)), "̇", "")
    t = F.translate(t, "".join(_FOLD), "".join(_FOLD.values()))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return t


def fold_python(text: str) -> str:
    t = text.translate(str.maketrans(_WIDE, _NARROW)).lower().replace("̇", "").translate(str.maketrans(_FOLD))
    t = " ".join(t.split())
    strip = lambda c: not unicodedata.category(c)[0] in "LN"
    while t and strip(t[0]):
        t = t[1:]
    while t and strip(t[-1]):
        t = t[:-1]
    return t


def is_generic_anchor(folded: Column, lang: Column) -> Column:
    everywhere = sorted({fold_python(p) for phrases, _ in K.GENERIC_ANCHORS.values() for p in phrases})
    out = folded.isin(everywhere)
    for code, (_, declared) in K.GENERIC_ANCHORS.items():
        out = out | ((primary_language(lang) == code) & folded.isin(sorted({fold_python(p) for p in declared})))
    return F.coalesce(out, F.lit(False))


def primary_language(code: Column) -> Column:
    first = F.lower(F.regexp_extract(F.trim(code), r"^([^-_]*)", 1))
    return F.when(first.rlike("^[a-z]{2,3}$"), first)


def same_language(a: Column, b: Column) -> Column:
    def key(c: Column) -> Column:
        out = c
        for old, new in K.SAME_LANGUAGE.items():
            out = F.when(c == old, new).otherwise(out)
        return out

    serbo = sorted(K.SERBO_CROATIAN)
    return (key(a) == key(b)) | ((a == "sh") & b.isin(serbo)) | ((b == "sh") & a.isin(serbo))


def check_code(code: Column) -> Column:
    """What is wrong with an hreflang code: empty, separator, private_use, structure, language or region; null if nothing."""
    c = F.trim(code)
    parts = F.split(c, "-")
    lang = F.lower(F.get(parts, F.lit(0)))
    known = sorted(K.LANGUAGES | K.LANGUAGES_WITHDRAWN | K.LANGUAGES_3)
    script = lambda p: F.lower(p).isin(sorted(K.SCRIPTS))
    second, third, n = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.size(parts)
    region = F.when((n == 2) & ~script(second), second).when(n == 3, third)
    good_region = F.upper(region).isin(sorted(K.regions())) | region.isin(sorted(K.M49))
    return (
        F.when(c == "", "empty").when(c.contains("_"), "separator").when(F.lower(c) == "x-default", F.lit(None)).when((F.lower(c) == "x") | F.lower(c).startswith("x-"), "private_use")
        .when(n > 3, "structure").when(~lang.isin(known), "language").when((n == 3) & ~script(second), "structure").when(region.isNotNull() & ~good_region, "region")
    )


def suggest_code(code: Column, reason: Column) -> Column:
    """A likely repair of a wrong code, or null."""
    c = F.trim(code)
    lang = F.lower(F.substring_index(c, "-", 1))
    fixed = F.regexp_replace(c, "_", "-")
    shaped = F.concat(F.lower(F.substring_index(fixed, "-", 1)), F.upper(F.regexp_extract(fixed, r"^[^-]*(.*)$", 1)))
    out = F.when((reason == "separator") & check_code(fixed).isNull(), shaped).when(reason == "private_use", "x-default")
    for bad, good in K.LANGUAGE_HINTS.items():
        out = out.when((reason == "language") & (lang == bad), F.concat(F.lit(good), F.upper(F.regexp_extract(c, r"^[^-]*(.*)$", 1))))
    region = F.upper(F.substring_index(c, "-", -1))
    for bad, good in K.REGION_HINTS.items():
        out = out.when((reason == "region") & (region == bad), F.lit(good) if good == "x-default" else F.concat(lang, F.lit(f"-{good}")))
    return out


def severity_rank(c: Column) -> Column:
    return F.array_position(F.lit(["critical", "high", "medium", "low", "info"]), c).cast("int")


def status_rank(c: Column) -> Column:
    return F.when(c.isNull(), 5).when(c < 300, 1).when(c < 400, 2).when(c < 500, 3).otherwise(4)


def status_class(c: Column) -> Column:
    return F.when(c < 300, "2xx").when(c < 400, "3xx").when(c < 500, "4xx").when(c.isNotNull(), "5xx")


def neutral(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote before it."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
