"""N-gram Jaccard join: a grouped prefix join over sets of five-word shingles.

Shingles are ordered by how many texts hold them, rarest first, so that two similar sets must share one of the first
few of each: the prefix filter.  Documents with equal sets are one class; classes with equal prefixes and size are one
group; groups that share a prefix shingle and whose sizes allow the similarity are candidates; candidates are expanded
to their members, which are verified exactly.

How it stays whole and bounded:

* Shingles that one text alone holds cannot link anything.  A first pass deals the shingle hashes of each batch of texts,
  packed, to the buckets of their hash ranges, where the number of their holders is counted; only shingles with two holders
  or more return to the batch they came from.  They suffice to verify, since an intersection has no others.  A batch sends
  a shingle once, with its number of holders in the batch, so a very common one is a row a batch in its bucket, not a
  row a text; which texts of the batch hold it does not pass through the bucket's count.
* Only components are wanted.  So a key's groups are first compared with one leader (a number of pairs in proportion to
  the keys), components are formed, and only keys with groups in different components stay.  After some such rounds,
  with leaders drawn anew, the classes of a key that still lie apart are compared by rising numbers of leaders, each
  class once with every leader before it, until no key is left that could tell anything: large groups of copies never
  become all their pairs, and no link that matters is lost.  Only texts that share a prefix shingle, fit in size and place
  and are not linked by anything else are compared pair by pair.

Shingles are compared by 64-bit hashes.

Defined results: words are those of the lower-cased (A-Z only) text; fewer than five words are one shingle; a null, empty or
blank text has the empty set, the size 0 and no link, so it is a component of its own; rows of equal ids are one document
whose sets link the id to whatever any of them is similar to, and each row is returned; null ids are returned with the
component null and link nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import by_batches, by_groups, in_blocks, table
from auditloom.operators.graph import connected_components
from auditloom.plans.staging import Stages, release, stage

N = 5
#: Similarity as a fraction of whole numbers: 100 * shared >= 80 * union.
PERCENT = 80
#: Rounds in which groups are compared with one leader only; in the first round after them a key has about so many leaders.
LEADERS = 3
FIRST, GROWTH = 64, 8
#: Characters of text to a bucket of hashes: a bucket holds about a sixth as many shingles, ten bytes each.
BUCKET_CHARS = 8 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hash of each word, filled on demand and emptied when it holds too many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str | None, hashes: dict[bytes, int], n: int = N) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    # bytes.lower() and bytes.split() know A-Z and the six ASCII blanks, and nothing else
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, dtype=np.uint64)
    a = np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))
    k = min(n, len(ws))
    h = np.full(len(ws) - k + 1, np.uint64(k))
    for j in range(k):
        h = (h ^ a[j : len(ws) - k + 1 + j]) * _K1
        h ^= h >> np.uint64(29)
    h *= _K2
    return np.unique(h ^ (h >> np.uint64(32)))


def _planes(h: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte by byte of their significance: the high bytes are zeros and compress away."""
    d = np.diff(h, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(d, dtype=np.uint64)


_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Stands for a place where several texts of a batch hold a shingle.
_SEVERAL = np.int32(-1)
_META = np.dtype([("id", "<i8"), ("n", "<i8"), ("f1", "<u8"), ("f2", "<u8"), ("own", "<i4")])


def _deal(buckets: int):
    """Batches of texts to (bucket, batch, hashes, places, meta) rows: places are rows within the batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, count = WordHashes(), TaskContext.get().partitionId(), 0
        for b in in_blocks(batches, "text", 6 << 20, rows=1 << 15):
            batch, count = part << 24 | count, count + 1
            meta = np.zeros(b.num_rows, dtype=_META)
            all_h, all_d, seen = [], [], {}
            for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"))):
                h = shingles(text.as_py(), hashes)
                f1, f2 = int(h.sum()), int(((h ^ (h >> np.uint64(31))) * _MIX).sum())
                key = (len(h), f1, f2)
                own = seen.setdefault(key, i)
                meta[i] = (doc_id, len(h), f1, f2, own)
                if own == i and len(h):
                    all_h.append(h)
                    all_d.append(np.full(len(h), i, dtype=np.uint16))
            rows: list[tuple] = []
            many = (b"", b"", b"")
            if all_h:
                h, d = np.concatenate(all_h), np.concatenate(all_d)
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                n = np.diff(np.append(first, len(h)))
                # what several texts of the batch hold: their places stay with the batch, the bucket gets one row
                several = n > 1
                many = (h[first[several]].tobytes(), d[np.repeat(several, n)].tobytes(), n[several].astype(np.uint16).tobytes())
                h, d, n = h[first], d[first], n.astype(np.uint16)
                of = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
                rows = [(k, batch, _planes(h[x:y]), d[x:y].tobytes(), n[x:y].tobytes(), None) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            rows.append((batch % buckets, batch, *many, meta.tobytes()))
            cols = list(zip(*rows))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], ["bucket", "batch", "h", "d", "n", "meta"])

    return run


def _count(t: pa.Table) -> pa.Table:
    """A bucket: the shingles that two texts or more hold go back to their batches, with that number.  Rows with ``meta`` only
    pass through."""
    hs, ds, ns, bs, back = [], [], [], [], []
    batches = t.column("batch").to_pylist()
    for i, (h, d, n, meta) in enumerate(zip(*(t.column(c) for c in ("h", "d", "n", "meta")))):
        if meta.is_valid:
            back.append((batches[i], h.as_py(), n.as_py(), d.as_py(), meta.as_py()))
            continue
        hs.append(_unplaned(h.as_py()))
        ds.append(np.frombuffer(d.as_py(), dtype=np.uint16))
        ns.append(np.frombuffer(n.as_py(), dtype=np.uint16))
        bs.append(np.full(len(ds[-1]), i, dtype=np.int32))
    if hs:
        h, d, n, b = np.concatenate(hs), np.concatenate(ds), np.concatenate(ns), np.concatenate(bs)
        del hs, ds, ns, bs
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        df = np.repeat(np.minimum(np.add.reduceat(n[order].astype(np.int64), first), np.iinfo(np.int32).max).astype(np.int32), np.diff(np.append(first, len(h))))
        keep = df > 1
        h, df, order = h[keep], df[keep], order[keep]
        d, b = np.where(n[order] > 1, _SEVERAL, d[order].astype(np.int32)), b[order]
        order = np.argsort(b, kind="stable")
        h, df, d, b = h[order], df[order], d[order], b[order]
        cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else []
        back += [(batches[b[x]], h[x:y].tobytes(), df[x:y].tobytes(), d[x:y].tobytes(), None) for x, y in zip(cuts, cuts[1:])]
    cols = list(zip(*back)) or [[]] * 5
    return pa.table([pa.array(c, type=k) for c, k in zip(cols, [pa.int64(), *[pa.binary()] * 4])], ["batch", "h", "df", "d", "meta"])


def _places(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(meta, h, df, d) of a batch: shared shingles, their numbers of holders, and the places of the texts that hold them."""
    metas, hs, dfs, ds, many = [], [], [], [], []
    for h, df, d, meta in zip(*(t.column(c).to_pylist() for c in ("h", "df", "d", "meta"))):
        if meta is not None:
            metas.append(np.frombuffer(meta, dtype=_META))
            many.append((np.frombuffer(h, dtype=np.uint64), np.frombuffer(df, dtype=np.uint16), np.frombuffer(d, dtype=np.uint16)))
        else:
            hs.append(np.frombuffer(h, dtype=np.uint64))
            dfs.append(np.frombuffer(df, dtype=np.int32))
            ds.append(np.frombuffer(d, dtype=np.int32))
    empty = [np.empty(0, dtype=x) for x in (np.uint64, np.int32, np.int32)]
    h, df, d = (np.concatenate([e, *x]) for e, x in zip(empty, (hs, dfs, ds)))
    own = d == _SEVERAL
    order = np.argsort(h[own], kind="stable")
    mh, mdf = h[own][order], df[own][order]
    parts = [(h[~own], df[~own], d[~own])]
    for x, n, places in many:
        # all of a batch's shingles with several holders come back
        parts.append((np.repeat(x, n), np.repeat(mdf[np.searchsorted(mh, x)], n), places.astype(np.int32)))
    return np.concatenate(metas), *(np.concatenate([p[i] for p in parts]) for i in range(3))


def _prefixes(percent: int):
    """A batch: per document its size, the two fingerprints of its set, and, if its prefix has shared shingles, the shared
    shingles in the global order and how many of them belong to the prefix."""

    def run(t: pa.Table) -> pa.Table:
        meta, h, df, d = _places(t)
        order = np.lexsort((h, df, d))
        h, d = h[order].view(np.int64), d[order]
        at = np.searchsorted(d, np.arange(len(meta) + 1))
        tokens, m, lone = [], [], []
        for i in range(len(meta)):
            n = int(meta["n"][i])
            shared = int(at[i + 1] - at[i])
            left = n - -(-percent * n // 100) + 1 - (n - shared)  # of the prefix, once the lone shingles are through
            has = meta["own"][i] == i and shared > 0 and left > 0
            tokens.append(h[at[i] : at[i + 1]] if has else None)
            m.append(left if has else 0)
            lone.append(n - shared)
        out = [pa.array(meta["id"]), pa.array(meta["n"]), pa.array(meta["f1"].view(np.int64)), pa.array(meta["f2"].view(np.int64)), pa.array(m, type=pa.int32()), pa.array(lone, type=pa.int64()), pa.array(tokens, type=pa.list_(pa.int64()))]
        return pa.table(out, ["doc_id", "n", "f1", "f2", "m", "lone", "tokens"])

    return run


def sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, f1, f2, m, lone, tokens) of every row of ``docs`` with an id, staged."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(24, -(-chars // BUCKET_CHARS))
    dealt = docs.mapInArrow(by_batches("op01", _deal(buckets)), "bucket int, batch long, h binary, d binary, n binary, meta binary")
    counted = dealt.groupBy("bucket").applyInArrow(by_groups("op01", _count), "batch long, h binary, df binary, d binary, meta binary")
    return stage(counted.groupBy("batch").applyInArrow(by_groups("op01", _prefixes(percent)), "doc_id long, n long, f1 long, f2 long, m int, lone long, tokens array<bigint>"), "sets")


def _linked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar; the hash sets of the two token lists are intersected row by row."""
    x = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    j = pairs.join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return j.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _reaches(n: str, p: str, m: str, r: str, percent: int) -> Column:
    """Whether sets of the sizes n and m whose first common shingle is at the places p and r can still be similar: what they
    share lies at those places or behind them."""
    most = F.least(F.col(n) - F.col(p), F.col(m) - F.col(r))
    return (100 + percent) * most >= percent * (F.col(n) + F.col(m))


def join(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links, placed): rows maps doc_id to its class (n, f1, f2), classes has these and c, the smallest id with
    that set; links holds similar pairs of classes, enough of them to connect every component; placed has the component q of
    every class c that can have a link."""
    rows = sets(docs, percent)
    full = rows.where("n > 0")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("c"), F.max("m").alias("m"), F.min("lone").alias("lone"), F.first("tokens", ignorenulls=True).alias("tokens"))
    classes = stage(classes, "classes")
    own = classes.where("m > 0").withColumn("prefix", F.slice("tokens", F.lit(1), F.col("m")))
    # groups: equal prefixes and sizes; with a lone shingle in the prefix a class is a group by itself
    key = F.when(F.col("lone") == 0, F.xxhash64("prefix")).otherwise(F.col("c"))
    own = own.select("c", "n", "lone", "prefix", key.alias("k"), (F.col("lone") == 0).alias("z"))
    groups = own.groupBy("n", "z", "k").agg(F.min("c").alias("g"), F.first("prefix").alias("prefix"), F.first("lone").alias("lone"))
    members = stage(own.join(groups.select("n", "z", "k", "g"), ["n", "z", "k"]).select("c", "g", "n"), "members")
    # a size band is narrow enough that its sizes fit each other; p is a shingle's place in the group's whole order
    band = F.floor(F.log(F.col("n")) / F.lit(-np.log(percent / 100)))
    keys = stage(groups.select("g", "n", "lone", band.alias("band"), F.posexplode("prefix").alias("p", "h")).withColumn("p", F.col("p") + F.col("lone")).drop("lone"), "keys")
    links: DataFrame | None = None
    open_keys = keys.withColumn("q", F.lit(None).cast("long"))
    st = Stages(docs.sparkSession)
    placed = st.put(members.withColumn("q", F.col("c")), "placed")
    for turn in range(LEADERS):
        # one leader for each key and band: the smallest id first, then one drawn anew for every key
        drawn = F.col("g") if turn == 0 else F.xxhash64("g", "h", F.lit(turn))
        lead = open_keys.groupBy("h", "band").agg(F.min(F.struct(drawn.alias("r"), "g", "n", "p", "q")).alias("_l"), F.count("*").alias("_n"))
        lead = lead.where("_n > 1").select("h", "band", F.col("_l.g").alias("l"), F.col("_l.n").alias("nl"), F.col("_l.p").alias("pl"), F.col("_l.q").alias("ql"))
        near = open_keys.join(lead, ["h", "band"]).where((F.col("g") != F.col("l")) & _reaches("n", "p", "nl", "pl", percent))
        near = near.where(~F.coalesce(F.col("q") == F.col("ql"), F.lit(False)))
        pairs = near.select(F.least("g", "l").alias("a"), F.greatest("g", "l").alias("b"))
        if turn == 0:
            pairs = pairs.unionByName(members.where("c != g").select(F.col("g").alias("a"), F.col("c").alias("b")))
        new = stage(_linked(pairs.distinct(), classes, percent), "links")
        links = new if links is None else links.unionByName(new)
        placed = _merged(placed, new, st)
        # a group's component, null if its members are in several
        of = placed.groupBy("g").agg(F.min("q").alias("_0"), F.max("q").alias("_1")).select("g", F.when(F.col("_0") == F.col("_1"), F.col("_0")).alias("q"))
        last, open_keys = open_keys, st.put(_open(keys.join(of, "g")), "open")
        st.drop(last)
    return rows, classes, *_by_rising_leaders(open_keys, placed, classes, links, st, percent)


def _merged(placed: DataFrame, new: DataFrame, st: Stages) -> DataFrame:
    """``placed`` after new links: only the links between components, as links of components, are followed."""
    at = lambda x: placed.select(F.col("c").alias(x), F.col("q").alias(f"q{x}"))
    e = new.join(at("a"), "a").join(at("b"), "b").where("qa != qb").select(F.col("qa").alias("src"), F.col("qb").alias("dst"))
    comp = connected_components(e).select(F.col("id").alias("q"), "component")
    out = st.put(placed.join(comp, "q", "left").select("c", "g", "n", F.coalesce("component", "q").alias("q")), "placed")
    st.drop(placed)
    release(placed.sparkSession)
    return out


def _open(keys: DataFrame) -> DataFrame:
    """The rows of those shingles that are held in more components than one; the others have nothing more to tell."""
    apart = keys.groupBy("h").agg(F.min("q").alias("_0"), F.max("q").alias("_1"), F.count_if(F.col("q").isNull()).alias("_n")).where("_0 != _1 OR _n > 0").select("h")
    return keys.join(apart, "h", "left_semi")


def _by_rising_leaders(open_keys: DataFrame, placed: DataFrame, classes: DataFrame, links: DataFrame, st: Stages, percent: int) -> tuple[DataFrame, DataFrame]:
    """``links`` and ``placed`` with whatever the open keys still hold.

    Every class has a pseudorandom place u in [0, 1) on each of its shingles.  A round's leaders on a shingle with M classes are those
    with a place from ``lo / M`` up to ``hi / M``; classes with higher places are compared with them, so a pair meets
    once, when its lower one leads, unless a link between the two components was found before.  A round multiplies the
    leaders, and the loop ends when every class of every open shingle has led."""
    one = open_keys.select("g", "band", "h", "p").join(placed.drop("n", "q"), "g").join(placed.select("c", "n"), "c").drop("g")
    one = one.withColumn("u", F.shiftrightunsigned(F.xxhash64("c", "h"), 11).cast("double") / F.lit(float(1 << 53)))
    m = one.groupBy("h").agg(F.count("*").alias("m"))  # as many as there are at first, in every round
    left = st.put(one.join(m, "h").withColumn("q", F.lit(None).cast("long")), "apart")
    lo, hi = 0, FIRST
    while True:
        last, left = left, st.put(_open(left.drop("q").where(F.col("m") > lo).join(placed.select("c", "q"), "c")), "apart")
        st.drop(last)
        largest = left.agg(F.max("m")).first()[0]
        if largest is None:
            return links, placed
        # sizes that fit each other are in one band or in neighbouring ones
        lead = left.where((F.col("u") * F.col("m") >= lo) & (F.col("u") * F.col("m") < hi))
        lead = lead.select("h", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("c").alias("l"), F.col("n").alias("nl"), F.col("p").alias("pl"), F.col("q").alias("ql"), F.col("u").alias("ul"))
        near = left.join(lead, ["h", "band"]).where((F.col("q") != F.col("ql")) & (F.struct("u", "c") > F.struct("ul", "l")))
        fits = (100 * F.least("n", "nl") >= percent * F.greatest("n", "nl")) & _reaches("n", "p", "nl", "pl", percent)
        pairs = near.where(fits).select(F.least("c", "l").alias("a"), F.greatest("c", "l").alias("b"))
        new = stage(_linked(pairs.distinct(), classes, percent), "links")
        links = links.unionByName(new)
        if not new.isEmpty():
            placed = _merged(placed, new, st)
        if largest <= hi:
            return links, placed
        lo, hi = hi, hi * GROWTH


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, classes, _, placed = join(docs, percent)
    of = classes.select("n", "f1", "f2", "c").join(placed.select("c", "q"), "c", "left").select("n", "f1", "f2", F.coalesce("q", "c").alias("q"))
    # rows of one id may hold different sets: these sets are one document
    same = rows.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    bound = rows.join(same, "doc_id").join(of, ["n", "f1", "f2"])
    several = bound.groupBy("doc_id").agg(F.min("q").alias("src"), F.max("q").alias("_1")).where("src != _1").drop("_1")
    edges = stage(bound.join(several, "doc_id").select("src", F.col("q").alias("dst")), "bound")
    if not edges.isEmpty():
        comp = connected_components(edges).select(F.col("id").alias("q"), "component")
        of = of.join(comp, "q", "left").select("n", "f1", "f2", F.coalesce("component", "q").alias("q"))
    classes = of.withColumnRenamed("q", "component")
    out = rows.where("n > 0").join(classes, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none).unionByName(_without_id(docs))


def _without_id(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the rows without an id: their sets are counted, and link nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in in_blocks(batches, "text", 6 << 20, rows=1 << 15):
            n = pa.array([len(shingles(t.as_py(), hashes)) for t in b.column("text")], type=pa.int64())
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, n, none], ["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id IS NULL").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose id is not its component's smallest.  Rows
    without an id or without words are kept."""
    gone = components(docs.where("doc_id IS NOT NULL"), percent).where("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct()
    # the input's columns travel in one, so that none of their names can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents", "doc_id", "text"))
