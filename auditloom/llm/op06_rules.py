"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and one bit for each rule that fails.
A policy is a version with a mask: applying one, comparing two, or asking what a rule alone rejects are bitwise
operations and aggregations over the ledger, never a second look at texts.

Defined results: a null text is an empty one; an empty or blank text has no words, measures 0 everywhere and fails
``few_words`` only; repeated rows are ledgered alike; columns of the input other than the id and the text are ignored.
Windows of five words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import WORD, table, words
from auditloom.plans.staging import stage

WINDOW = 5


def _per(name: str, least: str = "n_words") -> Column:
    return F.col(name) / F.greatest(F.col(least), F.lit(1))


#: Bit by bit, in this order for ever; a rule is retired by leaving its bit out of later policies.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "short_words", "long_words", "exclaims")
BIT = {name: 1 << i for i, name in enumerate(RULES)}


def _conditions() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": _per("n_symbols") > 0.1,
        "repeated_lines": (F.col("n_lines") >= 4) & (_per("n_dup_lines", "n_lines") > 0.3),
        "capitals": (F.col("n_words") >= 10) & (_per("n_capitals", "word_chars") > 0.5),
        "short_words": (F.col("n_words") >= 10) & (_per("word_chars") < 2),
        "long_words": (F.col("n_words") >= 10) & (_per("word_chars") > 20),
        "exclaims": (F.col("n_words") >= 10) & (_per("n_exclaims") > 0.3),
    }


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("1", (*BASE.rules, "symbols", "repeated_lines", "capitals", "exclaims")),
    Policy("2", (*BASE.rules, "symbols", "repeated_lines", "capitals", "exclaims", "short_words", "long_words")),
)


def _windows(w: Column, n: Column) -> Column:
    """A hash for each window of five words."""
    at = lambda i, k: F.get(w, i + k)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): one row for each of ``docs``, without any shuffle."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t"))
    df = df.withColumns({"_w": words(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))})
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "_h": _windows(F.col("_w"), F.size("_w"))})
    df = df.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        # most texts repeat nothing: only the others keep their windows for the search below
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"),
    )
    df = df.withColumn("_s", F.when(F.col("_h").isNotNull(), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # hashes sorted with their places: equal neighbours mark the windows that occur twice, and each marked window adds
    # the words up to the next marked one, five at most
    same = lambda s, i, k: F.get(F.col("_s"), i + k)["h"].eqNullSafe(s["h"])
    marked = F.filter(F.transform("_s", lambda s, i: F.when(same(s, i, -1) | same(s, i, 1), s["i"])), lambda x: x.isNotNull())
    df = df.withColumn("_m", F.when(F.col("_s").isNotNull(), F.sort_array(marked)))
    gaps = F.transform("_m", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_m"), i + 1) - x, F.lit(WINDOW))).cast("long"))
    df = df.withColumn("n_repeat_words", F.when(F.col("_m").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)))
    says = _conditions()
    bits = [F.when(says[name], F.lit(BIT[name])).otherwise(F.lit(0)) for name in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return df.drop("_h", "_s", "_m").withColumn("failed", failed.cast("long"))


def apply(led: DataFrame, policy: Policy) -> Column:
    """Whether a ledger row passes the policy."""
    return led["failed"].bitwiseAND(F.lit(policy.mask)) == 0


def ablations(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(version, rule, n_failed, n_only): of each policy and rule, the rows that fail the rule, and those that would pass
    the policy without it.  The rows are first counted by their bits, so that what follows is bounded by the number
    of different bitmasks."""
    by_bits = led.groupBy("failed").agg(F.count("*").alias("n"))
    spec = led.sparkSession.createDataFrame([(p.version, r, BIT[r], p.mask) for p in policies for r in p.rules], "version string, rule string, bit long, mask long")
    pairs = by_bits.withColumn("_p", F.explode(F.lit([i for i, _ in enumerate(policies)])))
    spec = spec.withColumn("_p", F.array_position(F.lit([p.version for p in policies]), F.col("version")).cast("int") - 1)
    j = pairs.join(F.broadcast(spec), "_p")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return j.groupBy("version", "rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once; policies and ablations read these few bytes a document and no text."""
    return stage(ledger(docs), "ledger")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = stored(table(spark, sf_dir, "documents", "doc_id", "text"))
    base, last = ~apply(led, BASE), apply(led, POLICIES[1])
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & last).alias("kept"), "failed")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(stored(table(spark, sf_dir, "documents", "doc_id", "text")))


SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
c AS (SELECT *, len(w) AS n_words, len(l) AS n_lines, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END AS g FROM b),
d AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM c),
e AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM d) WHERE n > 1),
f AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS r FROM e GROUP BY doc_id),
g AS (SELECT c.doc_id, n_words, n_lines, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  n_lines - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_exclaims
  FROM c LEFT JOIN f ON f.doc_id = c.doc_id),
h AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN n_symbols / greatest(n_words, 1) > 0.1 THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND n_dup_lines / n_lines > 0.3 THEN 8 ELSE 0 END)
  + (CASE WHEN n_words >= 10 AND n_capitals / word_chars > 0.5 THEN 16 ELSE 0 END) + (CASE WHEN n_words >= 10 AND word_chars / n_words < 2 THEN 32 ELSE 0 END)
  + (CASE WHEN n_words >= 10 AND word_chars / n_words > 20 THEN 64 ELSE 0 END) + (CASE WHEN n_words >= 10 AND n_exclaims / n_words > 0.3 THEN 128 ELSE 0 END) AS failed FROM g)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 159 = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM h"""


def _ablations_sql() -> str:
    spec = ", ".join(f"('{p.version}', '{r}', {BIT[r]}, {p.mask})" for p in POLICIES for r in p.rules)
    return f"""SELECT version, rule, CAST(sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN failed & mask = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only
FROM ({SQL}) CROSS JOIN (VALUES {spec}) AS p(version, rule, bit, mask) GROUP BY version, rule"""


ABLATIONS_SQL = _ablations_sql()
