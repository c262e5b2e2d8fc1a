"""Near-duplicate pages are those that are near by their shingles, whatever their signatures say."""

import random

from auditloom.operators import near
from auditloom.sources.html import shingles, signature


def _rows(texts):
    x = {u: shingles(t) for u, t in texts.items()}
    return [(u, bytearray(signature(v)), bytearray(v.astype("<u4").tobytes()), u) for u, v in x.items()], {u: set(v.tolist()) for u, v in x.items()}


def _groups(sets, least=0.8):
    of = {u: u for u in sets}
    for u in sets:
        for v in sets:
            if u < v and len(sets[u] & sets[v]) >= least * len(sets[u] | sets[v]) and of[u] != of[v]:
                old, new = max(of[u], of[v]), min(of[u], of[v])
                of = {k: new if c == old else c for k, c in of.items()}
    return {u: c for u, c in of.items() if sum(x == c for x in of.values()) > 1}


def test_against_all_pairs(spark):
    r, texts = random.Random(7), {}
    for g in range(12):  # groups of texts at about the limit, beside a stretch that all have
        words = [f"g{g}w{i}" for i in range(120)]
        for k in range(8):
            own = list(words)
            for _ in range(r.randrange(1, 10)):
                own[r.randrange(120)] = f"x{r.randrange(10**6)}"
            texts[f"u{g:02}{k}"] = " ".join(own + [f"all{i}" for i in range(60)])
    rows, sets = _rows(texts)
    df = spark.createDataFrame(rows, "url string, text_minhash binary, shingles binary, html_hash string")
    got = {x["url"]: x["component"] for x in near.near_duplicates(df).collect()}
    assert got == _groups(sets) and 20 < len(got) < 90


def test_like_signatures_alone_are_no_link(spark):
    """Two texts that are 0.77 alike and have signatures that say 0.8 or more, like some pages of links of the made-up site."""
    r, like = random.Random(1), 0.0
    while like < 0.81:
        common = " ".join(f"c{r.randrange(10**9)}" for _ in range(90))
        rows, sets = _rows({s: common + " " + " ".join(f"{s}{k}" for k in range(13)) for s in "xy"})
        like = sum(x == y for x, y in zip(rows[0][1], rows[1][1])) / 128
    assert len(sets["x"] & sets["y"]) < 0.8 * len(sets["x"] | sets["y"])
    df = spark.createDataFrame(rows, "url string, text_minhash binary, shingles binary, html_hash string")
    assert near.near_duplicates(df).count() == 0
    assert near.near_duplicates(df.drop("shingles")).count() == 2  # all that signatures can tell
