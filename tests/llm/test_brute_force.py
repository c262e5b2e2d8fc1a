"""Results that SQL cannot express, against plain Python over all rows."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import op01_ngram_join as join
from auditloom.llm import op02_mixing as mixing
from auditloom.llm import op03_toxicity as toxicity
from auditloom.llm import op04_fingerprints as prints
from auditloom.llm import op07_bpe as bpe
from auditloom.llm import op08_quality as quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- n-gram join -----------------------------------------------------------------------------------------------------
def shingles(text):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    at = {d: d for d in docs}

    def root(d):
        while at[d] != d:
            d = at[d]
        return d

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                at[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in docs}


def clusters(seed, n):
    """Texts in groups of near copies of every distance, chains of them, copies, and a passage that all of some kind hold."""
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(12)]
    out = {}
    while len(out) < n:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 6, 9, 30, 31, 100]))]
        if rng.random() < 0.5:
            base = common + base[: rng.randrange(1, 12)]
        for _ in range(rng.randrange(1, 7)):
            out[len(out)] = " ".join(base).upper() if rng.random() < 0.2 else " ".join(base)
            for _ in range(rng.randrange(0, 3)):  # drifts away from the first, a little each time
                k = rng.randrange(len(base))
                base = base[:k] + ([] if rng.random() < 0.3 and len(base) > 1 else [f"new{rng.randrange(10**6)}"]) + base[k + 1 :]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, monkeypatch, seed):
    monkeypatch.setattr(join, "FIRST", 2)  # several rounds of leaders even among few texts
    monkeypatch.setattr(join, "GROWTH", 2)
    docs = clusters(seed, 220)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.components(df).collect()} == components(docs)
    kept = {r["doc_id"] for r in join.keep_one(df).collect()}
    assert kept == {d for d, (_, c) in components(docs).items() if c == d}


def test_join_at_the_threshold(spark):
    base = [f"w{i}" for i in range(40)]  # 36 shingles
    docs = {0: " ".join(base), 1: " ".join(base[:36]), 2: " ".join(base[:33]), 3: " ".join(base[:32]), 4: " ".join(base[:31])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.components(df).collect()} == components(docs)
    two = {0: docs[0], 3: docs[3]}  # 28 of 36: below; 29 of 36: above
    for k, want in ((32, 3), (33, 0)):
        df = spark.createDataFrame([(0, docs[0]), (3, " ".join(base[:k]))], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in join.components(df).collect()} == {0: 0, 3: want}, two


# -- mixing ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shard, chunk", [(8192, 4096), (16, 2)])
def test_mix(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    monkeypatch.setattr(mixing, "SLOTS", 64)
    rng = random.Random(3)
    sources = ["big"] * 500 + ["mid"] * 60 + ["tiny"] * 3 + [None] * 8
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 40, 130]))), s) for i, s in enumerate(sources)]
    keyed = mixing.keyed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    goal = {r["skey"]: r for r in mixing.targets(keyed).collect()}
    drawn = mixing.draws(mixing.targets(keyed), block=8, shard=shard)
    nb = {k: -(-g["source_size"] // 8) for k, g in goal.items()}
    times = {}
    for r in drawn.collect():
        assert 0 <= r["idx"] < nb[r["skey"]] and (r["skey"], r["idx"]) not in times
        times[r["skey"], r["idx"]] = r["times"]
    for k, g in goal.items():
        per = [times.get((k, i), 0) for i in range(nb[k])]
        assert max(per) - min(per) <= 1  # no block again before all were
        assert abs(sum(per) - g["target"] / g["source_size"] * nb[k]) <= 1 + len(times) / shard
    # the blocks of a source are its words in the order of ids
    at, want = {}, {}
    for i, text, s in rows:
        n, off = len(text.split()), at.get(s, 0)
        want[i] = sum(times.get((s, w // 8), 0) for w in range(off, off + n))
        at[s] = off + n
    if shard == mixing.SHARD:
        assert {r["doc_id"]: r["taken"] for r in mixing.mix(keyed, block=8).collect()} == want


# -- fingerprints ----------------------------------------------------------------------------------------------------
def h64(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=h)
    return h - (1 << 64) * (h >> 63)


def sketch(text, k):
    w = WORD.findall(text)
    if 0 < len(w) < 5:
        return None  # the hash of an array; not rebuilt here
    return sorted({h64(w[i : i + 5]) for i in range(len(w) - 4)})[:k]


def alike(a, b, k):
    if not a and not b:
        return 1.0
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both)


def test_fingerprints(spark):
    folder, k = "/root/testdata/sf0.001", prints.K
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=lambda x: x)
    got = {r["doc_id"]: r for r in prints.op4_fingerprints(spark, folder).collect()}
    assert len(got) == len(docs)
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch(t, k), sketch(edited, k), sketch(nxt, k)
        if a is not None:
            assert r["fingerprint"] == "".join(f"{x & (1 << 64) - 1:016X}" for x in a)
            if b is not None:
                assert r["near_edited"] == pytest.approx(alike(a, b, k))
            if c is not None:
                assert r["near_next"] == pytest.approx(alike(a, c, k))


# -- BPE -------------------------------------------------------------------------------------------------------------
def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in bpe.op7_bpe(spark, folder).collect():
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


# -- classifiers, on rows that they did not learn from ---------------------------------------------------------------
def held_out(spark, query, label, folder="/root/testdata/sf0.1"):
    lab = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    got = query(spark, folder).where("held_out").join(lab, "doc_id").where("y IS NOT NULL").select("score", "predicted", "y").collect()
    hit = sum(r["predicted"] == 1 == r["y"] for r in got)
    return hit / max(1, sum(r["predicted"] for r in got)), hit / max(1, sum(r["y"] for r in got)), len(got)


def test_quality_held_out(spark):
    precision, recall, n = held_out(spark, quality.op8_quality_classifier, "quality")
    assert n > 400 and precision >= 0.9 and recall >= 0.95


def test_toxicity_held_out(spark):
    precision, recall, n = held_out(spark, toxicity.op3_toxicity, "toxic")
    assert n > 400 and precision >= 0.9 and recall >= 0.75


# -- the pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    s = quality.Scorer(quality.train(docs, labels))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, folder)
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in docs.collect() if s.score(r["text"]) >= 0.3)
    cut = stages["line_dedup"](spark, good, folder).cache()
    from tests.llm.test_line_dedup import brute

    whole = {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if WORD.search(x)] for r in good.collect()}
    gone = brute({d: [x.strip(" \t\n\v\f\r") for x in ls] for d, ls in whole.items()}, 20)
    for r in cut.collect():
        assert [x for x in (r["text"] or "").split("\n") if WORD.search(x)] == [x for k, x in enumerate(whole[r["doc_id"]]) if k not in set(gone[r["doc_id"]])]
        assert r["n_chars"] == len(r["text"]) or not gone[r["doc_id"]]
    one = stages["near_duplicates"](spark, cut, folder).cache()
    comp = components({r["doc_id"]: r["text"] for r in cut.collect()})
    assert {r["doc_id"] for r in one.collect()} == {d for d, (_, c) in comp.items() if c == d}
    mixed = stages["mixing"](spark, one, folder).cache()
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.keyed(one)).collect()}
    took = {}
    for r in mixed.collect():
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert took == {d: n for d, n in want.items() if n}
    e = bpe.encoder(bpe.vocabulary())
    texts = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    assert sorted((r["doc_id"], e.decode(r["ids"])) for r in stages["encoding"](spark, mixed, folder).collect()) == texts
