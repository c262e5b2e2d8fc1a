"""Quality classifier: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with either dictionary, piece by piece.  The difference of the two sizes over the text's
own length says which corpus it resembles; a logistic calibration, fitted on labelled texts that went into
neither dictionary, turns this into the probability of label 1.

Defined results: a null text is an empty one; an empty text has the difference 0 and so the score the calibration
gives to "resembles neither"; repeated rows are scored alike, row by row; rows whose label is null are not
learned from; without labelled rows of either class every score is the rate of label 1 (0.5 if there are none).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import by_batches, crc_mod, in_blocks, table

#: Texts are compressed in pieces of so many bytes: with a short window the dictionary decides, not the text itself.
PIECE = 4096
LEVEL = 3
#: The least bytes that a text gives to a dictionary, and the least length of a piece, but for its separator.
SHARE = 256


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]  # of the difference, and the intercept
    rate: float


class Scorer:
    """Compressors of one Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.pair = []
        for raw in (model.good, model.bad) if model.good and model.bad else ():
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text; 0 for an empty text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw or not self.pair:
            return 0.0
        good, bad = self.pair
        g = b = 0
        for i in range(0, len(raw), PIECE):
            part = raw[i : i + PIECE]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / len(raw)

    def score(self, text: str | None) -> float:
        if not self.pair:
            return self.model.rate
        w, c = self.model.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w * self.difference(text) + c))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One weight and an intercept by Newton's method, lightly regularised."""
    scale = x.std() or 1.0
    X, beta = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        g = X.T @ (y - p) - 1e-3 * beta
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), g)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """At most ``size`` bytes of the texts: whole texts if they fit, else equal shares of all of them, short texts whole and
    of longer ones pieces spread from their beginning to their end."""
    least = sum(min(len(t), SHARE) + 1 for t in texts)
    if least > size:  # too many for a share each: texts spread over the list
        most = max(1, len(texts) * size // least)
        texts = [texts[i * len(texts) // most] for i in range(most)]
    share, left = max(map(len, texts), default=0), size
    for i, n in enumerate(sorted(map(len, texts))):
        if (n + 1) * (len(texts) - i) > left:
            share = left // (len(texts) - i) - 1
            break
        left -= n + 1
    out = []
    for i, t in enumerate(texts):
        if len(t) <= share:
            out.append(t)
            continue
        k = max(1, share // SHARE)
        n, step = share // k - 1, len(t) / k
        # the place of a piece in its part of the text differs from text to text, evenly over all places
        shift = i * 0.6180339887498949 % 1 * (step - n)
        out += [t[(at := int(p * step + shift)) : at + n] for p in range(k)]
    return b"\n".join(out)


def fit(rows: list[tuple[str, int]], dict_bytes: int = 1_000_000, base_rate: float | None = None) -> Model:
    """``rows`` are (text, label) in a fixed order; of each class every third text is kept for the calibration."""
    rate = sum(y for _, y in rows) / len(rows) if rows else 0.5
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    held: list[tuple[str, int]] = []
    at = {0: 0, 1: 0}
    for text, y in rows:
        at[y] += 1
        if at[y] % 3 == 0:
            held.append((text, y))
        else:
            parts[y].append((text or "").encode("utf-8", "surrogatepass"))
    dicts = {}
    for y, texts in parts.items():
        blob = _dictionary([t for t in texts if t], dict_bytes)
        dicts[y] = blob if len(blob) >= 8 else b""
    model = Model(dicts[1], dicts[0], (0.0, 0.0), rate)
    if not (model.good and model.bad) or len({y for _, y in held}) < 2:
        return Model(b"", b"", (0.0, 0.0), rate)
    s = Scorer(model)
    x = np.array([s.difference(t) for t, _ in held])
    w, c = _logistic(x, np.array([y for _, y in held], dtype=float))
    if base_rate is not None and 0 < base_rate < 1 and 0 < rate < 1:  # the sample takes the classes at other rates than they have
        c += math.log(base_rate / (1 - base_rate)) - math.log(rate / (1 - rate))
    return Model(model.good, model.bad, (w, c), rate if base_rate is None else base_rate)


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, residue: int = 0, per_class: int = 4000, max_chars: int = 20_000) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, none of them longer than ``max_chars``: the
    documented bound of what reaches the driver.  The rows are those with the smallest hash of the id, so they are
    spread over the corpus and the same on every run.  Rows of the held-out residue are never taken."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), held_out) != residue))
    base = lab.agg(F.avg("y")).first()[0]
    order = F.xxhash64(F.col("_id"), F.lit(8))
    ids = None
    for y in (0, 1):  # a top-k over ids alone; only chosen texts are joined
        one = lab.where(F.col("y") == y).groupBy("_id").agg(F.min("y").alias("y")).orderBy(order, "_id").limit(per_class)
        ids = one if ids is None else ids.unionByName(one)
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("t")).where(F.length("t").between(1, max_chars))
    # at most 2 * per_class ids: a broadcast of proven size
    got = text.join(F.broadcast(ids), "_id").select("_id", "t", "y").orderBy(F.xxhash64("_id", F.lit(8)), "_id", "t").limit(2 * per_class).collect()
    return fit([(r["t"], r["y"]) for r in got], base_rate=base)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; the two dictionaries (bounded) travel with the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in in_blocks(batches, "text", 8 << 20):
            v = np.array([s.score(t.as_py()) for t in b.column("text")], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(v), pa.array((v >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_batches("op08", run), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns kept; scoring and filtering are one narrow pass."""
    model = train(docs, labels)
    cols = docs.columns
    text_at = cols.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in in_blocks(batches, "text", 8 << 20):
            yield b.filter(pa.array([s.score(t.as_py()) >= threshold for t in b.column(text_at)]))

    return docs.mapInArrow(by_batches("op08", run), docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
