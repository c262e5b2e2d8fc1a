"""Mixing sources to target weights.

Words are packed, source by source in the order of ids, into blocks of fixed length.  Every output shard of the mix
draws how many blocks each source gives it: the whole part of the expected count, and a multinomial draw for the rest.  A
plain multinomial draw has the same expectation but spreads about it: a source that its target caps at ``most`` times its
size would lose every draw above the cap and never make up for it, and one of some twenty blocks would miss its target by a
fifth; so only the rest is drawn.  A source's drawn slots are numbered through all shards; slot ``s`` of a source with ``n``
blocks is block ``P(s mod n)`` of pass ``s div n``, P being a pseudorandom permutation of that source and pass, so that no
block is taken again before all were.  Slots join blocks by (source, block).

All of it is column expressions, aggregations and joins over sizes.  Running sums are made in two levels (blocks of ids, then
rows within one; thousands of shards, then shards within those), and the slots of one source are made by many tasks, each
of which has some shards, so that no source, however large, is summed or drawn in one task.

Defined results: a null text has the size 0; documents without words take part with 0; a null source is a source of
its own, the last; null ids come last; equal ids are ordered by size and then by a hash of the text; rows that are equal in
id, source and text are numbered in one task and mixed as rows of their own; an empty table, or one without words, gives
every row the target 0 and nothing taken.  Columns of the input may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.common import id_blocks, let, n_words, table, words
from auditloom.plans.staging import stage

BLOCK = 64
#: Blocks of an output shard, shards whose slots are numbered in one task, and slots that one task makes of them at least.
SHARD = 8192
CHUNK = 4096
SLOTS = 1 << 16
MOST = 3
WEIGHTS = (5, 2, 1)
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) from (skey, size) rows.

    Shares are weight by weight; a source stops at ``most`` times its size and the excess goes to the others by
    weight.  In closed form: with sources sorted by cap/weight, the first j are capped where the level the others
    would reach, (total - their caps) / (weight left), does not exceed the next cap/weight."""
    per = sizes.groupBy("skey").agg(F.sum("size").cast("long").alias("source_size"))
    rank = Window.orderBy(F.col("skey").isNull(), "skey")  # one row for each source
    w = F.element_at(F.lit(list(weights)), F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", w.cast("long")).withColumn("cap", most * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("skey").isNull(), "skey")
    upto, everything = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns(
        {
            "_caps": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "_ws": F.coalesce(F.sum("w").over(upto), F.lit(0)),
            "_total": F.sum("source_size").over(everything),
            "_w": F.sum("w").over(everything),
        }
    )
    # the level if all before this row are capped and this one is not
    at = (F.col("_total") - F.col("_caps")).cast("double") / (F.col("_w") - F.col("_ws")).cast("double")
    per = per.withColumn("_at", F.when(at * F.col("w") <= F.col("cap"), at))
    # of the rows for which that holds the first has the final level
    per = per.withColumn("_final", F.first("_at", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("_final") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def _unit(*cols: Column) -> Column:
    """Pseudorandom number in [0, 1) of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def permuted(slot: Column, n: Column, *salt: Column, rounds: int = 4, walks: int = 40) -> Column:
    """A permutation of 0..n-1: Feistel rounds on a grid of a x b >= n cells, walked on while outside of 0..n-1.  The
    grid has fewer than sqrt(n) + 1 cells too many, which a walk passes once each at most; for n over 1,500 to need more
    walks than given has a chance below 1e-60."""
    a = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        start = F.struct((x % a).alias("p"), F.floor(x / a).cast("long").alias("q"))

        def step(s: Column, r: Column) -> Column:
            m = F.when(r % 2 == 0, a).otherwise(b)
            return F.struct(s["q"].alias("p"), F.pmod(s["p"] + F.pmod(F.xxhash64(s["q"], r, *salt), m), m).alias("q"))

        return F.aggregate(F.lit(list(range(rounds))), start, step, lambda s: s["p"] + s["q"] * a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once(slot), lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def _offsets(docs: DataFrame) -> DataFrame:
    """Adds ``off``, the number of words of the same source before each row."""
    order, block = id_blocks(docs, "doc_id", "h")
    docs = docs.withColumns({"_k": order, "_b": block})
    parts = docs.groupBy("skey", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("skey").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("skey").alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("skey", "_b").orderBy("_k", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = docs.join(parts, F.col("skey").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("off", F.col("_before") + F.col("_in")).drop("_k", "_b", "_s", "_c", "_before", "_in")


def counts(goal: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, int]:
    """(skey, nb, m, c, count) and the number of slots: how many blocks source ``skey``, which has ``nb``, gives to shard
    ``m``, one of chunk ``c``.  ``goal`` has one row for each source."""
    src = goal.where("target > 0").withColumn("nb", F.ceil(F.col("source_size") / block).cast("long"))
    # a source's slots by its own mean length of a block, which is shorter where it has few words
    src = src.withColumn("slots", F.col("target") * F.col("nb") / F.col("source_size"))
    total = src.agg(F.sum("slots")).first()[0] or 0.0
    n = math.ceil(total)
    shards = max(1, -(-n // shard))
    per = src.select("skey", "nb", (F.col("slots") / F.lit(max(total, 1.0))).alias("share"), F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // CHUNK)).cast("array<bigint>")).alias("c"))
    # a row for each shard and source: a shard holds thousands of blocks, so these are far fewer than the blocks
    sm = goal.sparkSession.range(shards).select(F.col("id").alias("m"), F.call_function("div", F.col("id"), F.lit(CHUNK)).alias("c")).join(per, "c")
    sm = sm.withColumn("size", F.lit(n // shards).cast("long") + (F.col("m") < n % shards).cast("long"))
    sm = sm.withColumn("_e", F.col("size") * F.col("share")).withColumn("whole", F.floor("_e")).withColumn("_f", F.col("_e") - F.col("whole"))
    up = Window.partitionBy("m").orderBy(F.col("skey").isNull(), "skey")
    al = Window.partitionBy("m")
    sm = sm.withColumns({"_hi": F.sum("_f").over(up), "_all": F.sum("_f").over(al), "_left": F.col("size") - F.sum("whole").over(al)}).withColumn("_lo", F.col("_hi") - F.col("_f"))
    # a multinomial draw of the slots that are left, fewer than there are sources: each has a pseudorandom place on the line of
    # the sources' fractions
    drawn = F.transform(F.when(F.col("_left") > 0, F.sequence(F.lit(1).cast("long"), F.col("_left"))).otherwise(F.array().cast("array<bigint>")), lambda i: _unit(F.lit(seed), F.col("m"), i) * F.col("_all"))
    hits = F.size(F.filter(drawn, lambda x: (x >= F.col("_lo")) & (x < F.col("_hi"))))
    return sm.select("skey", "nb", "m", "c", (F.col("whole") + hits).alias("count")), n


def draws(goal: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(skey, idx, times): how often the mix takes each block it takes."""
    sm, n = counts(goal, block, shard, seed)
    sm = stage(sm, "draws")
    # slots are numbered through the shards; what would pass the most a block may be taken is given up
    chunk = sm.groupBy("skey", "c").agg(F.sum("count").alias("_n"))
    before = Window.partitionBy("skey").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.select(F.col("skey").alias("_s"), F.col("c").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("skey", "c").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    sm = sm.withColumn("_in", F.coalesce(F.sum("count").over(inner), F.lit(0)))
    sm = sm.join(chunk, F.col("skey").eqNullSafe(F.col("_s")) & (F.col("c") == F.col("_c"))).withColumn("first", F.col("_before") + F.col("_in"))
    sm = sm.withColumn("end", F.least(F.col("first") + F.col("count"), most * F.col("nb"))).where("end > first").select("skey", "nb", "m", "first", "end")
    # few rows that become many: dealt by shard, in a given number of tasks
    sm = sm.repartition(max(1, min(4096, -(-n // SLOTS))), "skey", "m")
    slots = sm.select("skey", "nb", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("slot"))
    idx = permuted(F.col("slot") % F.col("nb"), F.col("nb"), F.lit(seed), F.coalesce("skey", F.lit("")), F.floor(F.col("slot") / F.col("nb")))
    return slots.select("skey", idx.alias("idx")).groupBy("skey", "idx").agg(F.count("*").alias("times"))


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(id, doc_id, skey, size, h) of rows with doc_id, source and text, and ``more``: ``id``, a struct without nulls, is a
    row's own, the same on every run whatever the order of rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("skey"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), *more)
    own = [F.col("doc_id").isNull().alias("o"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("skey").isNull().alias("z"), F.coalesce("skey", F.lit("")).alias("s"), F.col("h")]
    copy = F.row_number().over(Window.partitionBy(*own).orderBy("size"))
    return rows.withColumn("id", F.struct(*own, copy.alias("n")))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` as ``keyed`` gives them.  Returned for each row: its columns, source_size, target, taken, and parts, the
    stretches that are taken as (start, end, times) in words of the row.  Texts are read once: their sizes are staged."""
    docs = stage(docs, "sizes")
    goal = targets(docs)
    drawn = draws(goal, block).select(F.col("skey").alias("_s"), "idx", "times")
    own = _offsets(docs.where("size > 0").select("id", "doc_id", "skey", "size", "h"))
    lo, hi = F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block)
    cut = own.withColumn("_i", F.explode(F.sequence(lo, hi)))
    # the drawn slots grow out of a handful of rows, so the planner takes them for small; they are not, and must be shuffled
    got = cut.join(drawn.hint("merge"), F.col("skey").eqNullSafe(F.col("_s")) & (F.col("_i") == F.col("idx")))
    start, end = F.greatest(F.col("_i") * block - F.col("off"), F.lit(0)), F.least((F.col("_i") + 1) * block - F.col("off"), F.col("size"))
    got = got.select("id", F.struct(start.alias("start"), end.alias("end"), "times").alias("_part"))
    # at most size / block + 2 stretches a row
    got = got.groupBy("id").agg(F.sort_array(F.collect_list("_part")).alias("parts"), F.sum((F.col("_part.end") - F.col("_part.start")) * F.col("_part.times")).alias("taken"))
    goal = goal.select(F.col("skey").alias("_s"), "source_size", "target")
    out = docs.join(got, "id", "left").join(goal, F.col("skey").eqNullSafe(F.col("_s")), "left")
    return out.select(*[docs[c] for c in docs.columns], "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "parts")


def mix_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row whose words are all taken r times is there r times, one that
    is taken in part is there with those words, in order and joined by spaces; n_chars, if there, is that of the new text."""
    plan = mix(keyed(docs), block).where("taken > 0").select("id", "size", "parts")
    # the input's columns travel in one, so that none of their names can clash with those used here
    full = keyed(docs.select("doc_id", "source", F.col("text").cast("string").alias("text"), F.struct("*").alias("row")), F.col("text"), F.col("row")).select("id", "text", "row")
    j = full.join(plan, "id")
    j = j.withColumn("_r", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda p: p["times"])).cast("int"))))
    j = j.withColumn("_p", F.filter("parts", lambda p: p["times"] >= F.col("_r")))
    n = F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"])
    cut = lambda w: F.flatten(F.transform("_p", lambda p: F.slice(w, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))))
    some = F.array_join(let(words(F.col("text")), cut), " ")
    j = j.withColumn("text", F.when(n == F.col("size"), F.col("text")).otherwise(some))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return j.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(keyed(docs)).select("doc_id", "size", "source_size", "target", "taken")
