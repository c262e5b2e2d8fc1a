"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract here: runs of anything but space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: an expression used inside a lambda is otherwise computed anew for each
    element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none.  Only the end of the text is an end here (``$`` would
    also stand before a last U+0085, U+2028 or U+2029, which are letters of a word)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{GAP}|{GAP}\z", "")
    return F.array_remove(F.split(trimmed, GAP), "")


def n_words(text: Column) -> Column:
    """The number of words of a text, as a long."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


#: What operators keep in a Python worker from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in this Python worker from task to task.  Workers go from one stage to the next, so what other
    operators kept goes first: else it would add up to the memory of all of them."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def give_back() -> None:
    """Return what Arrow has freed to the system; its pool would hold on to it as long as the worker lives."""
    pa.default_memory_pool().release_unused()


def by_batches(owner: str, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``f`` for mapInArrow, with nothing of other operators or of past batches beside it in the worker's memory."""

    def run(batches):
        kept(owner)
        give_back()
        for out in f(batches):
            yield out
            del out
            give_back()
        give_back()

    return run


def by_groups(owner: str, f: Callable[[pa.Table], pa.Table]):
    """``f`` for applyInArrow, likewise."""

    def run(t):
        kept(owner)
        give_back()
        return f(t)

    return run


def in_blocks(batches: Iterable[pa.RecordBatch], column: str, chars: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``chars`` bytes of ``column`` each and ``rows`` rows at most, so that memory follows
    these bounds and the longest single text, not the sizes of batches."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = b.column(column).cast(pa.large_binary())
        start = size = 0
        for i, v in enumerate(pa.compute.binary_length(sizes).to_pylist()):
            if i > start and (size + (v or 0) > chars or i - start >= rows):
                yield b.slice(start, i - start)
                start, size = i, 0
            size += v or 0
        yield b.slice(start)


def id_blocks(df: DataFrame, key: str, tie: str, rows: int = 4096, most: int = 16) -> tuple[Column, Column]:
    """(order, block) of the rows in the order of ``key``, an integer, null keys last: ``order`` sorts like the key, nulls by
    the hash of ``tie``; ``block``, a struct, grows with it.

    Blocks are stretches of equal width of the key.  The width is taken from the rows' own spread and made smaller until no
    block has more than ``most * rows`` rows, so that a single outlying key does not gather the others in one block; what
    one key alone holds cannot be parted.  Only the key is read for this, and one row comes back."""
    none = F.col(key).isNull()
    at = F.when(none, F.xxhash64(tie)).otherwise(F.col(key).cast("long"))
    stats = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n"), F.count_if(none).alias("nulls")).first()
    n, nulls = stats["n"], stats["nulls"]
    largest = (1 << 63) - 1
    width = min(largest, max(1, (stats["hi"] - stats["lo"] + 1) * rows // n)) if n else 1
    while n > most * rows and width > 1:
        fullest = df.where(~none).groupBy(F.expr(f"CAST(`{key}` AS BIGINT) div {width}L")).count().agg(F.max("count")).first()[0]
        if fullest <= most * rows:
            break
        width = max(1, min(width // 2, width * rows // fullest))
    wide = min(largest, (1 << 64) // max(1, -(-nulls // rows)))
    block = F.struct(none.alias("o"), F.call_function("div", at, F.when(none, F.lit(wide)).otherwise(F.lit(width)).cast("long")).alias("b"))
    return F.struct(none.alias("o"), at.alias("k")), block


def shingle_hashes(w: Column, n: int = 5) -> Column:
    """64-bit hashes of the ``n``-word windows of an array of words, in order; fewer words make one shingle, none none."""

    def of(w: Column) -> Column:
        size = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(size >= n, hashes).when(size > 0, F.array(F.xxhash64(w, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))

    return let(w, of)
