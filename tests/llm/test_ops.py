"""The ten operators on small tables with nulls, empty and repeated rows, ties and clashing columns, against brute force."""

import hashlib
import io

import numpy as np
import pytest

from auditloom.llm import op01_ngram_join as join
from auditloom.llm import op02_mixing as mixing
from auditloom.llm import op03_toxicity as toxicity
from auditloom.llm import op04_fingerprints as prints
from auditloom.llm import op05_line_dedup as lines
from auditloom.llm import op06_rules as rules
from auditloom.llm import op07_bpe as bpe
from auditloom.llm import op08_quality as quality
from auditloom.llm import op09_warc as warc
from auditloom.llm import op10_urls as urls
from tests.oracle import same

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60", "changed")
    rows = [(0, base), (1, base.upper()), (2, near), (3, "two words"), (4, "TWO words"), (5, ""), (6, None), (7, " \n\t "), (8, LONG), (8, LONG), (9, "a b c d e"), (None, base)]
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_join_components(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.components(docs).collect()}
    assert got[0] == (116, 0) and got[1] == (116, 0) and got[2] == (116, 0)
    assert got[3] == (1, 3) and got[4] == (1, 3)
    assert got[5] == (0, 5) and got[6] == (0, 6) and got[7] == (0, 7)
    assert got[9] == (1, 9) and got[8][1] == 8
    assert join.components(docs.where("false")).count() == 0


def test_join_planes():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (join._unplaned(join._planes(h)) == h).all()


def test_mixing(spark, docs):
    out = mixing.mix(mixing.keyed(docs), block=8).collect()
    assert len(out) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix(mixing.keyed(docs.where("false"))).count() == 0
    mixed = mixing.mix_documents(docs, block=8)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in out)


def test_targets(spark):
    rows = [("a", 10), ("b", 100), ("c", 1000), (None, 5)]
    got = {r["skey"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "skey string, size long")).collect()}
    size, weight = dict(rows), {"a": 5, "b": 2, "c": 1, None: 5}
    want, left, open_ = {}, 1115.0, dict(weight)
    while open_:  # reshare until none is above its cap
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in open_ if share[k] > 3 * size[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * size[k]
            left -= want[k]
            del open_[k]
    assert got == pytest.approx(want)


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 50, 1009):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7))).collect()]
        assert sorted(got) == list(range(n))


def test_toxicity_finds_the_sentence():
    rng = np.random.default_rng(1)
    words = [f"plain{i}" for i in range(40)]
    text = lambda: ". ".join(" ".join(rng.choice(words, 8)) for _ in range(6))
    rows = [(text() + (". you are a nasty person. " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    w = toxicity.Weights(toxicity.fit(rows))
    bad, spans = toxicity.judge("plain1 plain2. you are a nasty person. plain3", w)
    assert bad >= 0.7 > toxicity.judge("plain1 plain2. plain3", w)[0]
    assert len(spans) == 1 and "nasty" in "plain1 plain2. you are a nasty person. plain3"[spans[0][0] : spans[0][1]]
    assert toxicity.judge(None, w)[0] == toxicity.judge("", w)[0] == 0
    assert toxicity.fit([("x", 1)]).weights == {}


def test_fingerprints(spark, docs):
    from pyspark.sql import functions as F

    got = prints.with_next(docs).collect()
    assert len(got) == docs.count()
    order = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))  # one null id, so its text's hash orders nothing
    for a, b in zip(order, [*order[1:], order[0]]):
        assert a["next_text"] == b["text"] and a["next_fp"] == b["fp"]
    x = docs.where("doc_id = 0").select(prints.fingerprint(F.col("text")).alias("a"), prints.fingerprint(F.lit("w1 w2 w3 w4 w5 w6")).alias("b"))
    r = x.select(prints.resemblance(F.col("a"), F.col("b")), prints.containment(F.col("b"), F.col("a")), prints.distinct_shingles(F.col("a"))).first()
    assert tuple(r) == (2 / 116, 1.0, 116.0)


def test_line_dedup(spark):
    block = "\n".join(" ".join(f"b{k}{i}" for i in range(30)) for k in range(2))
    rows = [(2, f"own two\n{block}\nend"), (1, f"start\n\n{block}"), (3, "start\nown three"), (4, None), (5, "")]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"start\n\n{block}", 2: "own two\nend", 3: "start\nown three", 4: None, 5: ""}


def test_patience():
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert lines.patience([], [1]) == []
    assert lines.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]


def test_rules_oracle(spark):
    same(rules.op6_quality_rules(spark, SF), rules.SQL, SF)


def test_rules_edges(spark, docs):
    got = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    assert got[6]["n_words"] == 0 and got[6]["failed"] == rules.BIT["few_words"]
    r = rules.ledger(spark.createDataFrame([(1, "a b c d e f " * 2)], "doc_id long, text string")).first()
    assert r["n_repeat_words"] == 12
    a = rules.ablations(rules.ledger(docs), (rules.BASE,)).collect()
    assert {x["rule"]: x["n_failed"] for x in a}["few_words"] == 6


def test_bpe():
    from tokenizers import Tokenizer

    import public_tokenizers

    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.Encoder(bpe.vocabulary())
    texts = ["", "Hello world, don't!", "x<|endoftext|>y", "  \n\n tabs\t", "日本語 🎉", "a" * 3000, " " * 500, "1234567 8"]
    got = [np.frombuffer(x, dtype=np.int32).tolist() for x in e.encode_all(texts)]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [e.decode(x) for x in got] == texts


def test_quality():
    rng = np.random.default_rng(2)
    good = [(" ".join(rng.choice(["the", "house", "stood", "near", "river", "quietly"], 60)), 1) for _ in range(90)]
    bad = [(" ".join(rng.choice(["###", "$$$", "BUY", "NOW!!", "%%%"], 60)), 0) for _ in range(90)]
    s = quality.Scorer(quality.fit(good + bad))
    assert s.score(good[0][0]) > 0.7 > 0.3 > s.score(bad[0][0])
    assert 0 <= s.score("") <= 1 and s.score(None) == s.score("")
    assert quality.Scorer(quality.fit([])).score("x") == 0.5


def test_warc_ranges():
    data = [bytes([i]) * (1000 * i) for i in range(1, 6)]
    raw = b"".join(warc.record(i, "http://e.com/ x", p, hashlib.sha1(p).digest(), None, False) for i, p in enumerate(data))
    f = io.BytesIO(raw)
    for step in (1 << 20, 97, 5):
        got = [w for at in range(0, len(raw), step) for _, w in warc.members(f, at, at + step)]
        assert [warc.parse(w)[1].partition(b"\r\n\r\n")[2] for w in got] == data
    assert [warc.page_of(warc.record_id(i)) for i in (None, 0, -5, 1 << 62)] == [None, 0, -5, 1 << 62]


def test_warc_oracle(spark):
    same(warc.op9_warc(spark, SF), warc.SQL, SF)


def test_urls_oracle(spark):
    same(urls.op10_url_filters(spark, SF), urls.SQL, SF)


def test_urls_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?y"), (4, "http://example.com/en/"), (5, "http://notcom/en/"), (6, "http://a.net/es/z#q"), (7, "http://spam-farm.org/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("", "", None, "allow") == got[2]
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2:] == (None, "block")
