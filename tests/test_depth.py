"""Click depth has no greatest number of levels."""

import builtins

from auditloom.operators import depth

DEEP = 23  # past two rounds of gathering the levels into one table


def test_no_greatest_level(spark, monkeypatch):
    # a thousand levels take minutes; any fixed number of rounds is made a small one instead
    monkeypatch.setattr(depth, "range", lambda *a: builtins.range(*a)[:8], raising=False)
    rows = [("a", f"p{i}", f"p{i + 1}") for i in range(DEEP)] + [("a", f"p{DEEP}", "p0"), ("a", "p3", "p1"), ("img", "p0", f"p{DEEP}"), ("a", "other", "p5")]
    links = spark.createDataFrame(rows, "element string, from_url string, to_url string")
    got = {r["url"]: r["depth"] for r in depth.click_depth(links, spark.createDataFrame([("p0",)], "url string")).collect()}
    assert got == {f"p{i}": i for i in range(DEEP + 1)}


def _breadth_first(rows, seeds):
    out, level = dict.fromkeys(seeds, 0), set(seeds)
    while level:
        level = {t for e, f, t in rows if e == "a" and f in level} - set(out)
        out |= dict.fromkeys(level, max(out.values()) + 1)
    return out


def test_long_chains_take_few_jobs(spark):
    """A chain of 400 pages, each with leaves, circles and a side way in: jobs grow with its logarithm."""
    rows = [("a", f"h{i}", f"h{i + 1}") for i in range(400)] + [("a", f"h{i}", f"h{i}-{k}") for i in range(400) for k in range(2)]
    rows += [("a", "h9", "h0"), ("a", "h7-1", "h30"), ("a", "h350", "h30"), ("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "z", "v"), ("a", "v", "h5"), ("a", "v", "w"), ("img", "h0", "h400")]
    links = spark.createDataFrame(rows, "element string, from_url string, to_url string")
    seeds = spark.createDataFrame([("h0",), ("h200-1",)], "url string")
    spark.sparkContext.setJobGroup("long chains", "")
    got = {r["url"]: r["depth"] for r in depth.click_depth(links, seeds).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long chains"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == _breadth_first(rows, ["h0", "h200-1"])
    assert jobs < 150


def test_random_links(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        rows = [("a", f"p{r.randrange(60)}", f"p{r.randrange(60)}") for _ in range((50, 70, 90, 150)[seed])]
        links = spark.createDataFrame(rows, "element string, from_url string, to_url string")
        got = {x["url"]: x["depth"] for x in depth.click_depth(links, spark.createDataFrame([("p0",), ("p1",)], "url string")).collect()}
        assert got == _breadth_first(rows, ["p0", "p1"])
