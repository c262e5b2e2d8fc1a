"""Near-duplicate pages: buckets by rare shingles (or by bands of MinHash signatures, where shingles were not kept); one leader in
each bucket, components, then rising numbers of leaders among what is still apart."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import constants as K
from auditloom.functions.text import let
from auditloom.operators.graph import connected_components
from auditloom.plans.staging import stage

#: Shingles are ordered by how many pages have one of the same last bits; of those as many numbers reach the driver.
PLACES = 1 << 20
#: Leaders of a bucket in the first round after components are known.
FIRST = 8


def similarity(a: Column, b: Column) -> Column:
    """Share of equal bytes of two signatures, less what chance makes equal."""
    n = K.PERMUTATIONS
    byte = lambda x, i: F.substring(x, 2 * i + 1, F.lit(2))
    same = let(F.struct(F.hex(a).alias("a"), F.hex(b).alias("b")), lambda s: F.size(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: byte(s["a"], i) == byte(s["b"], i))))
    return (same / n - 1 / 256) / (1 - 1 / 256)


def rare_shingles(reps: DataFrame, least: float) -> DataFrame:
    """(u, k): of each page's shingles (u, s) so many of the rarest that two pages as like as ``least`` or more have one of them
    in common: whatever the order, the first shingle that both have is there.  That the rare come first makes buckets small."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, dtype=np.int64)
        for b in batches:
            for s in b.column(0):
                n += np.bincount(np.frombuffer(s.as_py(), dtype="<u4") % PLACES, minlength=PLACES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array(n[at])], ["at", "n"])

    found = reps.select("s").mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(PLACES, dtype=np.int64)
    often[found.column("at").to_numpy()] = found.column("n").to_numpy()

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, rows, keys = b.slice(i, 256), [], []
                for j, s in enumerate(part.column(1)):
                    x = np.frombuffer(s.as_py(), dtype="<u4")
                    few = np.lexsort((x, often[x % PLACES]))[: len(x) - math.ceil(least * len(x) - 1e-9) + 1]
                    rows.append(np.full(len(few), j))
                    keys.append(x[few].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys))], ["u", "k"])

    return reps.select("u", "s").mapInArrow(first, "u string, k long")


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """Those (a, b) of pairs with their shingles (sa, sb) that have ``least`` of all shingles of both in common, or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (s, t) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_py(), dtype="<u4") for v in (s, t))
                if min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9:
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = n >= least * (len(x) + len(y) - n) - 1e-9
            yield b.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a string, b string")


def near_duplicates(pages: DataFrame, alternates: DataFrame | None = None, least: float = K.NEAR_SIMILARITY) -> DataFrame:
    """(url, component) of pages (url, text_minhash, html_hash, and shingles where they were kept) that are near another.  Pages
    whose bytes are equal are one class, so a group of exact copies does not count by itself; pairs in ``alternates`` (a, b) are
    no link.  With shingles every pair that is near is found and none that is not; signatures alone estimate."""
    exact = "shingles" in pages.columns
    p = stage(pages.where(F.col("text_minhash").isNotNull()), "signatures")
    kept = F.min_by("shingles", "url") if exact else F.lit(None).cast("binary")
    reps = stage(p.groupBy("text_minhash").agg(F.min("url").alias("u"), kept.alias("s")), "classes")
    p = p.select("url", "text_minhash", "html_hash")
    band = let(F.hex("text_minhash"), lambda x: F.transform(F.sequence(F.lit(0), F.lit(K.BANDS - 1)), lambda i: F.substring(x, 2 * K.BAND_ROWS * i + 1, F.lit(2 * K.BAND_ROWS))))
    if exact:
        keys = stage(rare_shingles(reps, least).select("u", F.lit(0).alias("band"), "k"), "keys")
    else:
        keys = reps.select("u", F.posexplode(band).alias("band", "k"))
    # a bucket that one class alone is in links nothing
    shared = keys.groupBy("band", "k").agg(F.min("u").alias("l"), F.count("*").alias("m")).where("m > 1")
    keys = stage(keys.join(shared, ["band", "k"]), "bands")
    sig = reps.select(F.col("u").alias("_u"), F.col("s" if exact else "text_minhash").alias("_s"))
    both = None
    if alternates is not None:
        both = stage(alternates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "alternates")

    def verified(pairs: DataFrame) -> DataFrame:
        j = pairs.distinct().join(sig.withColumnRenamed("_u", "a").withColumnRenamed("_s", "sa"), "a").join(sig.withColumnRenamed("_u", "b").withColumnRenamed("_s", "sb"), "b")
        out = alike(j, least) if exact else j.where(similarity(F.col("sa"), F.col("sb")) >= least).select("a", "b")
        return stage(out if both is None else out.join(both, ["a", "b"], "left_anti"), "links")

    def components(links: DataFrame) -> DataFrame:
        return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("u"), "component")

    links = verified(keys.where("u != l").select(F.least("u", "l").alias("a"), F.greatest("u", "l").alias("b")))
    comp = components(links)
    # a pair meets when its member with the lower place leads, unless their components were joined before
    place = F.shiftrightunsigned(F.xxhash64("u", "band", "k"), 11).cast("double") / F.lit(float(1 << 53))
    apart = keys.select("band", "k", "u", place.alias("w"))
    lo, hi = 0, FIRST
    while True:
        q = apart.join(comp, "u", "left").select("band", "k", "u", "w", F.coalesce("component", "u").alias("q"))
        open_ = q.groupBy("band", "k").agg(F.min("q").alias("_0"), F.max("q").alias("_1"), F.count("*").alias("m")).where(f"_0 != _1 AND m > {lo}")
        q = stage(q.join(open_.select("band", "k", "m"), ["band", "k"]), "apart")
        largest = q.agg(F.max("m")).first()[0]
        if largest is None:
            break
        lead = q.where((F.col("w") * F.col("m") >= lo) & (F.col("w") * F.col("m") < hi)).select("band", "k", F.col("u").alias("l"), F.col("w").alias("wl"), F.col("q").alias("ql"))
        pairs = q.join(lead, ["band", "k"]).where((F.col("q") != F.col("ql")) & (F.struct("w", "u") > F.struct("wl", "l")))
        links = links.unionByName(verified(pairs.select(F.least("u", "l").alias("a"), F.greatest("u", "l").alias("b"))))
        comp = components(links)
        if largest <= hi:
            break
        apart, lo, hi = q.select("band", "k", "u", "w"), hi, hi * 4
    # equal signatures are one class, and so linked
    of = p.join(reps, "text_minhash").join(comp, "u", "left").select("url", "html_hash", F.coalesce("component", "u").alias("component"))
    groups = of.groupBy("component").agg(F.count("*").alias("_n"), F.countDistinct("html_hash").alias("_h")).where("_n > 1 AND _h > 1")
    return of.join(groups.select("component"), "component").select("url", "component")
