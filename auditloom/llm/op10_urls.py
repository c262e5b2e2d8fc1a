"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that each URL it fits must hold.  Over all URLs the frequency of those tokens is
counted, each rule is filed under its rarest, and a URL fetches by its own tokens the few rules whose regular
expressions then run.  Two kinds of rule share the index: host rules (a host with a path; they fit its subdomains,
the longest wins and decides) and patterns (for URLs that no host rule decides).

Up to ``IN_PLAN`` rules the index is a literal of the plan: everything is a column expression within one row, and only the
token counts are aggregated, for tokens that rules name.  A larger set becomes a table (token, rule): distinct URLs join it by
token, and what fits is aggregated a URL.  Both ways give the same rows, for any number of rules.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
repeated rows are judged alike; with no rules everything is allowed; an empty table gives an empty result; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import table

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return r"^[^/]*\." + re.escape(self.host) + re.escape(self.path)

    @property
    def tokens(self) -> list[str]:
        """Only those that end inside the rule: its last one may go on in the URL."""
        text = f".{self.host}{self.path}".lower()
        return [m[0] for m in _TOKEN.finditer(text) if m.end() < len(text)]


@dataclass(frozen=True)
class Pattern:
    """``*`` stands for anything, ``^`` for one separator or the end; ``||`` at the start for a host label's start."""

    action: str
    text: str

    @property
    def name(self) -> str:
        return self.text

    @property
    def regex(self) -> str:
        body, head = (self.text[2:], r"^[^/]*\.") if self.text.startswith("||") else (self.text, "")
        return head + "".join(".*" if c == "*" else r"(?:[^a-zA-Z0-9]|$)" if c == "^" else re.escape(c) for c in body)

    @property
    def tokens(self) -> list[str]:
        text = "." + self.text[2:].lower() if self.text.startswith("||") else "*" + self.text.lower()
        ends = text + "*"
        return [m[0] for m in _TOKEN.finditer(text) if text[m.start() - 1] != "*" and ends[m.end()] != "*"]


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

PATTERNS = (
    Pattern("block", "||spam-farm."),
    Pattern("block", "||ads."),
    Pattern("block", "||adserver."),
    Pattern("block", "||tracker."),
    Pattern("block", "||casino^"),
    Pattern("block", "/ads/"),
    Pattern("block", "/banner/*.gif^"),
    Pattern("block", "/wp-admin/"),
    Pattern("block", "/cgi-bin/"),
    Pattern("block", "/tag/*/feed^"),
    Pattern("allow", "/ads/txt^"),
)

#: Rules that the plan holds as literals; more are joined as a table.
IN_PLAN = 2000


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(F.lower(subject), "[^a-z0-9]+"))


def _rarest(subjects: DataFrame, rules: list[HostRule | Pattern]) -> list[str | None]:
    """Of each rule the token that fewest subjects hold; None for a rule without tokens.  What comes to the driver has a row
    for each token that rules name at most, and the rules came from there."""
    named = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if named:
        spark = subjects.sparkSession
        if len(named) <= IN_PLAN:
            seen = subjects.select(F.explode(F.array_intersect(_tokens(F.col("subject")), F.lit(named))).alias("t"))
        else:
            wanted = spark.createDataFrame([(t,) for t in named], "t string")
            seen = subjects.select(F.explode(_tokens(F.col("subject"))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).join(wanted, "t")
            return _least(rules, {r["t"]: r["n"] for r in seen.collect()})
        counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return _least(rules, counts)


def _least(rules: list[HostRule | Pattern], counts: dict[str, int]) -> list[str | None]:
    return [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None for r in rules]


def _fits_in_plan(df: DataFrame, rules: list[HostRule | Pattern], tokens: list[str | None]) -> DataFrame:
    """``df`` with ``fits``, (i, name, action) of the rules that fit, in order."""
    index: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        if t is not None:
            index.setdefault(t, []).append(i)
    always = [i for i, t in enumerate(tokens) if t is None]
    none = F.array().cast("array<int>")
    found = F.lit(always) if always else none
    if index:
        filed = F.create_map(*[x for k, v in sorted(index.items()) for x in (F.lit(k), F.lit(v))])
        keys = F.array_intersect(_tokens(F.col("subject")), F.lit(sorted(index)))
        found = F.concat(F.flatten(F.transform(keys, lambda t: F.coalesce(F.try_element_at(filed, t), none))), found)
    regexes = F.lit([r.regex for r in rules]) if rules else F.array().cast("array<string>")
    fits = F.array_sort(F.filter("found", lambda i: F.rlike(F.col("subject"), F.element_at(regexes, i + 1))))
    names, actions = F.lit([r.name for r in rules] or [""]), F.lit([r.action for r in rules] or [""])
    said = F.transform(F.when(F.size("found") > 0, fits).otherwise(none), lambda i: F.struct(i.alias("i"), F.element_at(names, i + 1).alias("name"), F.element_at(actions, i + 1).alias("action")))
    return df.withColumn("found", found).withColumn("fits", said).drop("found")


def _fits_joined(df: DataFrame, rules: list[HostRule | Pattern], tokens: list[str | None]) -> DataFrame:
    """The same by a join: distinct subjects by token with the table of rules.  A token that a great part of all URLs hold is a
    skewed side, which the engine splits; rules without a token meet every subject, in blocks of ``IN_PLAN``."""
    spark = df.sparkSession
    subjects = df.select("subject").distinct()
    kind = "array<struct<i:int,name:string,action:string>>"
    rows = [(t, i, r.name, r.action, r.regex) for i, (r, t) in enumerate(zip(rules, tokens))]
    filed = spark.createDataFrame([x for x in rows if x[0] is not None], "t string, i int, name string, action string, regex string")
    each = subjects.select("subject", F.explode(_tokens(F.col("subject"))).alias("t")).join(filed, "t")
    hits = each.where(F.rlike(F.col("subject"), F.col("regex"))).select("subject", F.struct("i", "name", "action").alias("f"))
    always = [x for x in rows if x[0] is None]
    for k in range(0, len(always), IN_PLAN):
        part = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(action).alias("action"), F.lit(rx).alias("regex")) for _, i, name, action, rx in always[k : k + IN_PLAN]])
        those = F.filter(part, lambda x: F.rlike(F.col("subject"), x["regex"]))
        hits = hits.unionByName(subjects.select("subject", F.explode(F.transform(those, lambda x: F.struct(x["i"], x["name"], x["action"]))).alias("f")))
    fits = hits.groupBy("subject").agg(F.array_sort(F.collect_set("f")).cast(kind).alias("fits"))  # as many as there are rules at most
    return df.join(fits, "subject", "left").withColumn("fits", F.coalesce("fits", F.array().cast(kind)))


def judge(urls: DataFrame, url_col: str = "url", host_rules: tuple = HOST_RULES, patterns: tuple = PATTERNS) -> DataFrame:
    """``urls`` with columns host, path, rule, matched (patterns that fit, in the rules' order) and verdict put after its
    own; columns of those names that it has already are replaced."""
    rules = [*host_rules, *patterns]
    host, path = host_path(F.col(url_col).cast("string"))
    # the input's columns travel in one, so that none of their names can clash with those used here
    df = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    df = df.withColumn("subject", F.concat(F.lit("."), F.col("host"), F.col("path")))
    df = (_fits_in_plan if len(rules) <= IN_PLAN else _fits_joined)(df, rules, _rarest(df, rules))
    n = len(host_rules)
    # host rules have the smaller numbers
    found = F.array_max(F.transform(F.filter("fits", lambda f: f["i"] < n), lambda f: F.struct(F.length(f["name"]).alias("n"), f["name"].alias("name"), f["action"].alias("action"))))
    df = df.withColumn("found", found).withColumn("pats", F.filter("fits", lambda f: f["i"] >= n))
    # an allowing pattern is an exception from the blocking ones
    said = F.transform("pats", lambda f: f["action"])
    of_pats = F.when(F.array_contains(said, "allow"), "allow").when(F.array_contains(said, "block"), "block").otherwise("allow")
    new = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.col("found.name"),
        "matched": F.transform("pats", lambda f: f["name"]),
        "verdict": F.when(F.col("found").isNotNull(), F.col("found.action")).otherwise(of_pats),
    }
    return df.select(*[F.col("row").getField(c).alias(c) for c in urls.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = lambda r: f"regexp_matches('.' || host || path, '{r.regex}')"
    by_length = sorted(HOST_RULES, key=lambda r: -len(r.name))
    allow = " OR ".join(fits(r) for r in PATTERNS if r.action == "allow")
    block = " OR ".join(fits(r) for r in PATTERNS if r.action == "block")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name}'" for r in by_length)} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r.name}' THEN '{r.action}'" for r in by_length)}
  WHEN {allow} THEN 'allow' WHEN {block} THEN 'block' ELSE 'allow' END AS verdict
FROM c"""


SQL = _sql()
