"""Graph loops over edge DataFrames; every round is a fixed number of shuffles, state stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.plans.staging import Stages

#: Edges to a task and file of a round's staged table.
EDGES = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph as (id, component), component being the smallest id reached.

    ``edges`` has columns ``src`` and ``dst`` of one orderable type; direction, repeats, self-links and
    rows with a null end are ignored.  Ids without a link are absent from the result.  Alternating
    large-star and small-star steps: O(log n) rounds in practice, each of which touches only edges, so a
    hub is handled by aggregation and joins and never gathered into one task.
    """
    spark = edges.sparkSession
    st = Stages(spark)
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    cur = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    # v is the larger end, u the smaller one
    cur = st.put(cur.select(b.alias("v"), a.alias("u")).distinct(), "cc")
    rows, seen = cur.count(), None
    for _ in range(max_rounds):
        # large star: neighbours above v hang onto v's smallest neighbour
        both = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: neighbours below v, and v, hang onto the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        j = large.join(low, "v")
        nxt = j.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(j.select("v", F.col("m").alias("u")))
        # a round has about as many edges as the one before: small tables are a few files, not one for each shuffle partition
        nxt = st.put(nxt.where("v != u").distinct().coalesce(1 + rows // EDGES), "cc")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.countDistinct("v")).first()
        st.drop(cur)
        cur, rows = nxt, state[0]
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)
