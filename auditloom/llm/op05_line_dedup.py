"""Line dedup by pairwise alignment.

Lines that several documents hold are found by their hashes, with the number of their holders.  Every run of such lines,
consecutive and just long enough to have ``MIN_WORDS`` words, is filed under its rarest line's hash, with a hash of the run
beside it that tells other contexts of that line apart.  A run leads back to the earliest document that holds it, and a later
document is aligned with it.  The alignment is a patience diff: lines that occur once in either document anchor it, in
their longest common order, and it grows from the anchors to neighbouring equal lines.  Aligned blocks of at least
``MIN_WORDS`` words are deleted from the later document; single shared lines, and lines shared in another order, stay.

The result is that of aligning every document with every earlier one.  Each line of a block lies in a run of the block
that starts or ends at a line of it, so a document is paired through each of its runs; where the order of lines keeps
the alignment with the earliest holder from deleting a run, its other earlier holders are tried, the nearest first, until
one deletes it or none is left.  A common run thus leads to about as many pairs as it has holders, and to more only where
holders have their lines in different orders.

No line is too common: a line with more than a thousandth of all lines is one of a thousand at most, so these few are
known to every task, and their rows are dealt to several.

Defined results: lines are cut at ``\\n`` and compared without blanks at their ends; blank lines match nothing and stay; a
null text stays null; empty texts stay empty; "earlier" is by id, null ids last, then by a hash of the text; exactly
repeated rows of one id are one document and are treated alike; a document all of whose lines are deleted stays as an
empty text; other columns, whatever their names, pass through, n_chars is counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.common import GAP, WORD, by_batches, let, table
from auditloom.plans.staging import stage

MIN_WORDS = 20


def _unique(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    at: dict[int, int] = {}
    again = set()
    for i in range(lo, hi):
        if lines[i] in at:
            again.add(lines[i])
        at[lines[i]] = i
    return {k: v for k, v in at.items() if k not in again}


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by the first number, the longest run in which the second rises too (patience sorting)."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two lists of line hashes, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ua, ub = _unique(a, i, j), _unique(b, k, m)
        anchors = _longest_rising(sorted((x, ub[h]) for h, x in ua.items() if h in ub))
        if anchors:
            out += anchors
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)])]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], at_a: list[int], at_b: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) line numbers in b of the aligned runs, consecutive in both documents, with ``least`` words or more."""
    out, run = [], []
    for p in [*pairs, None]:
        if run and (p is None or at_a[p[0]] != at_a[run[-1][0]] + 1 or at_b[p[1]] != at_b[run[-1][1]] + 1):
            if sum(words[y] for _, y in run) >= least:
                out.append((at_b[run[0][1]], at_b[run[-1][1]]))
            run = []
        if p is not None:
            run.append(p)
    return out


_TRIM = rf"\A{GAP}|{GAP}\z"
#: Tasks that the rows of one very common line are dealt to.
SALTS = 64


def _lines(docs: DataFrame) -> DataFrame:
    """(o, i, t, at, h, w): of each document and line with words its number among those, its hash and its words.  o, i, t
    order documents."""
    split = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    d = docs.where("text IS NOT NULL").select(*_key(), split.alias("_l")).select("o", "i", "t", F.posexplode("_l").alias("at", "l"))
    return d.select("o", "i", "t", "at", F.xxhash64(F.regexp_replace("l", _TRIM, "")).alias("h"), F.regexp_count("l", F.lit(WORD)).alias("w"))


def _key() -> list[Column]:
    return [F.col("doc_id").isNull().cast("int").alias("o"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.xxhash64(F.col("text").cast("string")).alias("t")]


def deletions(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(o, i, t, gone): the numbers of the lines (among those with words) that later documents lose."""
    # one row for each document and line: a repeated row adds nothing
    lines = _lines(docs.select("doc_id", F.col("text").cast("string").alias("text"))).distinct()
    doc = F.struct("o", "i", "t")
    per = lines.groupBy("h").agg(F.min(doc).alias("first"), F.max(doc).alias("last"), F.count("*").alias("df")).where("first != last").select("h", "df")
    per = stage(per, "shared")
    total = per.agg(F.sum("df")).first()[0] or 0
    common = [r["h"] for r in per.where(F.col("df") * 1000 > total).where("df > 1000").select("h").collect()]  # a thousand at most
    is_common = F.col("h").isin(common) if common else F.lit(False)
    salt = F.when(is_common, F.pmod(F.xxhash64("i", "t"), F.lit(SALTS)).cast("int")).otherwise(0).alias("s")
    salts = F.when(is_common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = per.select("h", "df", F.explode(salts).alias("s"))
    # what a document shares, in order: as long as the document at most
    of = lines.select("*", salt).join(held, ["h", "s"]).groupBy(doc.alias("doc")).agg(F.sort_array(F.collect_list(F.struct("at", "h", "w", "df"))).alias("ls"))
    of = stage(of, "lines")
    found = of.mapInArrow(by_batches("op05", lambda batches: _runs_of(batches, least)), "doc struct<o: int, i: long, t: long>, lo int, hi int, rare long, g long")
    # a run's key: its rarest line and, beside it, the whole run
    key = ["rare", "g"]
    first = found.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last").select(*key, "first")
    runs = stage(found.join(first, key), "runs")
    later = runs.where("doc != first")
    gone = stage(_aligned(later.select(F.col("doc").alias("later"), "first").distinct(), of, least), "gone")

    def left(runs: DataFrame) -> DataFrame:
        j = runs.join(gone.select(F.col("doc").alias("_d"), "gone").hint("merge"), F.col("doc") == F.col("_d"), "left")
        rest = F.array_except(F.sequence("lo", "hi"), F.coalesce("gone", F.array().cast("array<int>")))
        return j.where(F.size(rest) > 0).select(*runs.columns)

    todo = stage(left(later).select("doc", "lo", "hi", *key), "left")
    if todo.isEmpty():
        return gone.select("doc.*", "gone")
    # the holders of what is left by their place among them; the first has been tried
    ranks = runs.join(todo.select(*key).distinct(), key, "left_semi").select(*key, "doc").distinct()
    ranks = stage(ranks.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("doc"))), "holders")
    todo = todo.join(ranks, [*key, "doc"]).where("n > 2")
    done, width = 1, 1
    while True:  # each round tries twice as many holders as the one before
        todo = stage(todo, "left")
        if todo.isEmpty():
            return gone.select("doc.*", "gone")
        tries = todo.select(*key, F.col("doc").alias("later"), F.explode(F.sequence(F.greatest(F.col("n") - done - width + 1, F.lit(2)), F.col("n") - done)).alias("n"))
        pairs = tries.join(ranks.select(*key, "n", F.col("doc").alias("first")), [*key, "n"]).select("later", "first").distinct()
        more = gone.unionByName(_aligned(pairs, of, least)).groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
        gone = stage(more, "gone")
        done, width = done + width, 2 * width
        todo = left(todo).where(F.col("n") - done > 1)


def runs_of(at: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) indices of the shortest runs of lines with consecutive numbers, ``least`` words or more, that start or
    that end at a line."""
    out = set()
    start = 0
    for stop in range(1, len(at) + 1):
        if stop < len(at) and at[stop] == at[stop - 1] + 1:
            continue
        # from lo to hi: the shortest that ends at hi; it starts later only if that still reaches
        lo, n = start, 0
        for hi in range(start, stop):
            n += words[hi]
            while n - words[lo] >= least:
                n, lo = n - words[lo], lo + 1
            if n >= least:
                out.add((lo, hi))
        hi, n = stop - 1, 0
        for lo in range(stop - 1, start - 1, -1):
            n += words[lo]
            while n - words[hi] >= least:
                n, hi = n - words[hi], hi - 1
            if n >= least:
                out.add((lo, hi))
        start = stop
    return sorted(out)


def _runs_of(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc, lo, hi, rare, g): of each document's runs the numbers of their first and last line, the hash of the rarest line in
    it (of equally rare ones the smallest) and a hash of all its lines."""
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            rows, lo, hi, rare, g = [], [], [], [], []
            for n, ls in enumerate(part.column("ls").to_pylist()):
                at = [e["at"] for e in ls]
                h = np.array([e["h"] for e in ls], dtype=np.int64)
                by_df = [(e["df"], e["h"]) for e in ls]
                for x, y in runs_of(at, [e["w"] for e in ls], least):
                    rows.append(n)
                    lo.append(at[x])
                    hi.append(at[y])
                    rare.append(min(by_df[x : y + 1])[1])
                    g.append(int.from_bytes(hashlib.blake2b(h[x : y + 1].tobytes(), digest_size=8).digest(), "little", signed=True))
            if rows:
                cols = [part.column("doc").take(pa.array(rows)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(rare, pa.int64()), pa.array(g, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "lo", "hi", "rare", "g"])


def _aligned(pairs: DataFrame, of: DataFrame, least: int) -> DataFrame:
    """(doc, gone): the numbers of the lines that the later document of each pair (later, first) loses."""
    # staged tables look small to the planner as files; these grow with the documents, and must be shuffled
    a, b = (of.select(F.col("doc").alias(x), F.transform("ls", lambda e: F.struct(e["at"], e["h"], e["w"])).alias(y)).hint("merge") for x, y in (("first", "a"), ("later", "b")))
    # the later document's own lines first: those of an early one that many begin from are then never shuffled once a pair
    sides = pairs.join(b, "later").join(a, "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = []
                for key, x, y in zip(*(part.column(c).to_pylist() for c in ("later", "a", "b"))):
                    met = patience([e["h"] for e in x], [e["h"] for e in y])
                    for lo, hi in blocks(met, [e["at"] for e in x], [e["at"] for e in y], [e["w"] for e in y], least):
                        rows.append((key["o"], key["i"], key["t"], list(range(lo, hi + 1))))
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], ["o", "i", "t", "gone"])

    found = sides.select("later", "a", "b").mapInArrow(by_batches("op05", run), "o int, i long, t long, gone array<int>")
    return found.groupBy(F.struct("o", "i", "t").alias("doc")).agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers, among those with words, are in ``gone``; every step is one pass over them."""

    def cut(split: Column) -> Column:
        wordy = F.array_compact(F.transform(split, lambda x, i: F.when(F.rlike(x, F.lit(WORD)), i)))
        lost = let(wordy, lambda at: F.transform(gone, lambda n: F.get(at, n)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), lost)
        return F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")

    return let(F.split(text, "\n"), cut)


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(row, text, gone): ``row`` is the input's row as a struct, ``text`` the new text, ``gone`` the numbers of its deleted lines
    among those with words (null: none)."""
    gone = deletions(docs, least).select(F.struct("o", "i", "t").alias("key"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.struct(*_key()).alias("key"), F.col("text").cast("string").alias("text"))
    j = rows.join(gone.hint("merge"), "key", "left")
    return j.select("row", F.when(F.col("gone").isNotNull(), _without(F.col("text"), F.col("gone"))).otherwise(F.col("text")).alias("text"), "gone")


def without_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deleted lines gone from ``text``; n_chars, if there, is counted anew where something is."""
    out = dedup(docs, least)
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed_lines"), F.sort_array("gone").alias("removed_lines"), "text")
