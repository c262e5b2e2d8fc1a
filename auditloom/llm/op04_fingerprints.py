"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``k`` smallest distinct hashes of a text's five-word shingles.  Fingerprints of parts merge
into that of the whole, and from them follow estimates of resemblance, containment and the number of distinct
shingles; below ``k`` shingles all of these are exact.

Defined results: a null text is an empty one and has the empty fingerprint; two empty fingerprints have the likeness 1,
an empty and another one 0; a text of one to four words is one shingle; repeated rows are fingerprinted alike; the
order of documents is by id, null ids last and by a hash of their texts, equal ids by text; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.common import id_blocks, let, shingle_hashes, table, words

K = 128


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, k: int = K) -> Column:
    return bottom(shingle_hashes(words(text)), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Of the ``k`` smallest hashes of both together, the share that both hold."""
    shared = lambda both: F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.greatest(F.size(both), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(merge(a, b, k), shared))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below ``k``; else (k - 1) over the share of the hash space up to the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b holds: resemblance * |a or b| / |a|; an empty a is contained in all."""
    both = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * both / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each group.  Hashes are first made distinct and cut to the k smallest within salted parts of a
    group, so that the last step sees at most ``salts * k`` hashes of it, however many rows it has."""
    h = df.select(*keys, F.explode(sketch).alias("_h")).distinct().withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_h")
    h = h.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k)
    return h.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, fp and the following document's next_text and next_fp.

    Documents are dealt by blocks of ids; within a block the next row is a window's lead.  The last row of a block gets
    the first one of the next block, found by an aggregation to one row a block; only block numbers (one for some
    thousand documents) meet in one task."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order, block = id_blocks(docs, "doc_id", "text")
    docs = docs.withColumns({"_b": block, "_k": order})
    heads = docs.groupBy("_b").agg(F.min(F.struct(F.col("_k").alias("k"), F.col("text").alias("t"))).alias("_h")).select("_b", F.col("_h.t").alias("_t"))
    # the block before each head's own; before the first block comes the last one
    by_block = Window.orderBy("_b")
    before = docs.select("_b").distinct().withColumns({"_p": F.lag("_b").over(by_block), "_last": F.max("_b").over(Window.partitionBy())})
    heads = heads.join(before.select("_b", F.coalesce("_p", "_last").alias("_p")), "_b")
    heads = heads.select(F.col("_p").alias("_b"), F.col("_t").alias("_ht"), fingerprint(F.col("_t"), k).alias("_hf"))
    inner = Window.partitionBy("_b").orderBy("_k", "text")
    df = docs.repartition("_b").withColumn("fp", fingerprint(F.col("text"), k))
    df = df.withColumns({"next_text": F.lead("text").over(inner), "next_fp": F.lead("fp").over(inner)})
    last = F.col("next_text").isNull()  # texts are never null here, so only a block's last row has none
    df = df.join(heads, "_b", "left")
    return df.select("doc_id", "text", "fp", F.when(last, F.col("_ht")).otherwise(F.col("next_text")).alias("next_text"), F.when(last, F.col("_hf")).otherwise(F.col("next_fp")).alias("next_fp"))


def op4_fingerprints(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    df = with_next(table(spark, sf_dir, "documents", "doc_id", "text"), k)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    df = df.withColumn("edited", F.concat(head, F.substring(F.col("next_text"), F.lit(1), quarter)))
    df = df.withColumn("edited_fp", fingerprint(F.col("edited"), k))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
    )
