"""What stays behind in Python workers and in the shared folder when stage follows stage, as in the pipeline."""

import os
import weakref

import pyarrow as pa

from auditloom.llm import op05_line_dedup as dedup
from auditloom.llm import op07_bpe as bpe
from auditloom.llm import op08_quality as quality
from auditloom.operators.graph import connected_components
from auditloom.plans import staging


def test_the_encoder_goes_when_another_operator_runs_in_its_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i % 3} of a line\nand another one") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    ran = []
    frame = type(docs)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: ran.append(f) or plain(self, f, *a, **b))
    quality.keep_good(docs, labels)
    dedup.deletions(docs, 3)
    assert len(ran) >= 3
    source = bpe.vocabulary()
    for f in ran:  # as a worker would run them after the encoding stage
        held = weakref.ref(bpe.encoder(source))
        assert held() is bpe.encoder(source)
        assert list(f(iter([]))) == []
        assert held() is None


def test_arrow_memory_goes_back_after_a_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ran, back = [], []
    frame = type(docs)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: ran.append(f) or plain(self, f, *a, **b))
    quality.score(docs, quality.fit([]))
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: back.append(1)})())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None])], ["doc_id", "text"])
    assert sum(b.num_rows for b in ran[0](iter([batch, batch]))) == 4
    assert len(back) >= 2


def test_rounds_of_components_are_few_files(spark, monkeypatch):
    files = []
    put = staging.Stages.put

    def counted(self, df, label):
        out = put(self, df, label)
        files.append(sum(os.path.basename(f).startswith("part-") for f in out.inputFiles()))
        return out

    monkeypatch.setattr(staging.Stages, "put", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 50 != 49], "src long, dst long")
        got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 50 * 50 for i in range(400)}
    assert len(files) > 2 and set(files[1:]) == {1}
