"""Click depth and reachability: chains of pages with one way in are jumped over, and a level loop whose rounds touch only the
edges of the new frontier does the rest."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.plans.staging import Stages

c = F.col


def click_depth(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, depth) of what ``a`` links reach from ``seeds`` (url), however deep.

    A page that one other page alone links to is a click deeper than that.  Such pages hang on the next page above that has more
    ways in, or is a seed; pointers to it double in length each round, so a chain of n pages takes log n rounds.  Between the
    other pages the links that are left weigh as many clicks as they jump over, and are followed a link a round, with one staged
    table each: lineage stays short, a lost executor repeats one round at most, and the loop ends with the first round that
    finds nothing nearer."""
    st = Stages(links.sparkSession)
    edges = st.put(links.where("element = 'a'").select("from_url", "to_url").where("from_url != to_url").distinct(), "edges")
    front = st.put(seeds.select("url").where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "level")
    single = edges.groupBy(c("to_url").alias("url")).agg(F.min("from_url").alias("up"), F.count("*").alias("n")).where("n = 1").select("url", "up")
    single = st.put(single.join(front, "url", "left_anti"), "single")
    over = st.put(_tops(st, single), "over")
    # links to pages with more ways in, from where their source hangs
    l = edges.join(single.select(c("url").alias("to_url")), "to_url", "left_anti")
    l = l.join(over.select(c("url").alias("from_url"), "top", "d"), "from_url", "left").where("d IS NULL OR top IS NOT NULL")
    l = l.select(F.coalesce("top", "from_url").alias("from_url"), "to_url", (F.coalesce("d", F.lit(0)) + 1).alias("w")).where("from_url != to_url")
    ways = st.put(l.groupBy("from_url", "to_url").agg(F.min("w").alias("w")), "ways")
    seen, parts = front, [front]
    for level in count(1):
        found = ways.join(front.select(c("url").alias("from_url"), "depth"), "from_url").groupBy(c("to_url").alias("url")).agg(F.min(c("depth") + c("w")).alias("depth"))
        # of what was seen only the found ones matter: where these are few, they go to it, and it is not shuffled
        known = seen.join(found.select("url"), "url", "left_semi").groupBy("url").agg(F.min("depth").alias("known"))
        rows = Observation()
        nxt = found.join(known, "url", "left").where("known IS NULL OR depth < known").select("url", "depth").observe(rows, F.count("*").alias("n"))
        nxt = st.put(nxt, "level")  # the same job counts the rows
        if not rows.get["n"]:
            break
        seen = seen.unionByName(nxt)
        parts.append(nxt)
        if level % 10 == 0:  # many small tables in one plan are slow to plan
            seen = st.put(_nearest(seen), "seen")
            for old in parts[:-1]:  # all but the frontier are in the new table alone
                st.drop(old)
            parts = [nxt, seen]
        front = nxt
    near = st.put(_nearest(seen), "seen")
    below = over.join(near.select(c("url").alias("top"), "depth"), "top").select("url", (c("depth") + c("d")).alias("depth"))
    return st.put(near.unionByName(below), "depth")


def _nearest(seen: DataFrame) -> DataFrame:
    return seen.groupBy("url").agg(F.min("depth").alias("depth"))


def _tops(st: Stages, single: DataFrame) -> DataFrame:
    """(url, top, d) of pages (url, up) that ``up`` alone links to: the first page above that is not such a page, d clicks
    away; null where there is none, since the pages above link in a circle.

    Pointers are doubled for pages that have such pages below them, which are few; the others take those of their page."""
    inner = single.join(single.select(c("up").alias("url")).distinct(), "url", "left_semi")
    more = inner.select(c("url").alias("up"), F.lit(True).alias("open"))
    tops = st.put(inner.join(more, "up", "left").select("url", c("up").alias("top"), F.lit(1).alias("d"), F.coalesce("open", F.lit(False)).alias("open")), "tops")
    before = None
    while True:
        n = tops.where("open").count()
        if n in (0, before):  # every round ends some pointers that ever end: of a page at each distance above an open one
            break
        before = n
        on = tops.select(c("url").alias("top"), c("top").alias("t"), c("d").alias("e"), c("open").alias("o"))
        jumped = tops.where("open").join(on, "top").select("url", c("t").alias("top"), (c("d") + c("e")).alias("d"), c("o").alias("open"))
        tops, old = st.put(tops.where("NOT open").unionByName(jumped), "tops"), tops
        st.drop(old)
    at = tops.select(c("url").alias("up"), F.when(~c("open"), c("top")).alias("top"), "d")
    return single.join(at, "up", "left").select("url", F.when(c("d").isNull(), c("up")).otherwise(c("top")).alias("top"), (F.coalesce("d", F.lit(0)) + 1).alias("d"))


def depth_shape(depths: DataFrame, threshold: int) -> DataFrame:
    """One row: how many pages are deeper than the threshold, their quartiles and the deepest."""
    deep = depths.where(F.col("depth") > threshold)
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY depth)")
    return deep.agg(F.count("*").alias("pages"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("depth").alias("deepest"))
