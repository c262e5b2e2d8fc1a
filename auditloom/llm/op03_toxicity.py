"""Toxicity by multiple-instance learning.

Only documents are labelled.  A sentence's probability is a logistic function of the words it holds; a document's
is the noisy-or of its sentences', 1 - prod(1 - p).  The weights are trained through the noisy-or from document
labels alone, and afterwards the sentence probabilities say where the offence is.  No weight is below 0: a word can
make a sentence offensive, and no number of harmless ones can take that back.  Both classes count alike in training,
so a score is against even odds, whatever the classes' shares.

Defined results: a null text is an empty one; an empty text, or one of blanks, has no sentence and the score
0; a sentence of more than ``STRETCH`` words is read as several, in stretches of that many, so that a text without marks is
not one sentence; words that fewer than four learned documents hold have no weight; repeated rows are scored
alike; rows with a null label are not learned from; without labelled rows of both classes all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import crc_mod, in_blocks, table

_SENTENCE = re.compile(r"[^.!?\n]+")
_RUN = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A sentence that never ends is read in stretches of so many words.
STRETCH = 64


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def features(word: str) -> tuple[str, ...]:
    """The word's runs of letters, and their beginnings of four and five: inflected forms share a stem.  Each feature once."""
    out: dict[str, None] = {}
    for run in _LETTERS.findall(word):
        n = len(run)
        out |= dict.fromkeys((run,) if n < 4 else (run, run[:4] + "*") if n < 5 else (run, run[:4] + "*", run[:5] + "*"))
    return tuple(out)


class Weights(dict):
    """word -> summed weight of its features, filled on demand and emptied when it holds too many words."""

    def __init__(self, model: Model, most: int = 1_000_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        get = self.model.weights.get
        x = self[word] = sum(get(f, 0.0) for f in features(word))
        return x


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has a word."""
    for m in _SENTENCE.finditer(text or ""):
        found = m[0].lower().split()
        if len(found) <= STRETCH:
            if found:
                yield m.start(), m.end(), set(found)
            continue
        at, spans = m.start(), [x.span() for x in _RUN.finditer(m[0])]
        for i in range(0, len(spans), STRETCH):
            part = spans[i : i + STRETCH]
            yield at + part[0][0], at + part[-1][1], {m[0][a:b].lower() for a, b in part}


def fit(rows: list[tuple[str, int]], rates: dict[int, float] | None = None, rounds: int = 250, min_docs: int = 4, l2: float = 0.02) -> Model:
    """Noisy-or likelihood, full-batch Adam, weights kept at 0 or above.  ``rates``: what each class counts for, the rows'
    own shares if not given."""
    n = Counter(y for _, y in rows)
    if len(n) < 2:
        return Model({}, -100.0)
    df: Counter[str] = Counter()
    docs = []
    for text, y in rows:
        sents = [{f for w in s for f in features(w)} for *_, s in sentences(text)]
        if sents:
            docs.append((sents, y))
            df.update(set().union(*sents))
    vocab = {w: i for i, w in enumerate(sorted(w for w, c in df.items() if c >= min_docs))}
    word, sent_of, doc_of, ys = [], [], [], []
    for d, (sents, y) in enumerate(docs):
        ys.append(y)
        for s in sents:
            ids = sorted(vocab[w] for w in s if w in vocab)
            word += ids
            sent_of += [len(doc_of)] * len(ids)
            doc_of.append(d)
    word, sent_of, doc_of, y = np.array(word, dtype=np.int64), np.array(sent_of, dtype=np.int64), np.array(doc_of, dtype=np.int64), np.array(ys)
    rates = rates or {k: v / len(rows) for k, v in n.items()}
    share = np.array([rates[k] * len(rows) / n[k] for k in (0, 1)])[y]
    w, b = np.zeros(len(vocab)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        s = np.bincount(sent_of, weights=w[word], minlength=len(doc_of)) + b
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        none = np.exp(np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
        some = np.maximum(1 - none, 1e-9)
        g = (np.where(y == 1, -none / some, 1.0) * share)[doc_of] * p
        gw = np.bincount(word, weights=g[sent_of], minlength=len(w)) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = np.maximum(w - 0.25 * fix * m / (np.sqrt(v) + 1e-6), 0.0)
        b -= 0.25 * fix * mb / (math.sqrt(vb) + 1e-6)
    return Model({k: float(w[i]) for k, i in vocab.items() if abs(w[i]) > 1e-3}, float(b))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 3, residue: int = 1, per_class: int = 1500, max_chars: int = 20_000) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, none longer than ``max_chars``: the documented bound
    of what reaches the driver.  The smallest hashes of the id are taken; the held-out residue never is."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), held_out) != residue))
    if lab.select("y").distinct().count() < 2:
        return Model({}, -100.0)
    ids = None
    for y in (0, 1):
        one = lab.where(F.col("y") == y).groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(per_class)
        ids = one if ids is None else ids.unionByName(one)
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("t")).where(F.length("t").between(1, max_chars))
    got = text.join(F.broadcast(ids), "_id").select("_id", "t", "y").orderBy(F.xxhash64("_id", F.lit(3)), "_id", "t").limit(2 * per_class).collect()
    return fit([(r["t"], r["y"]) for r in got], {0: 0.5, 1: 0.5})


def judge(text: str | None, weights: Weights, worst: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """(noisy-or score, offending sentences as (start, end, probability) in code points)."""
    none, found, b = 0.0, [], weights.model.bias
    for a, z, ws in sentences(text):
        s = b + sum(map(weights.__getitem__, ws))
        if s > -30:
            p = 1 / (1 + math.exp(-min(s, 30.0)))
            none += math.log1p(-min(p, 1 - 1e-12))
            if p >= worst:
                found.append((a, z, p))
    return 1 - math.exp(none), found


SCHEMA = "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, offending) of every row; the model, bounded by its sample, travels with the task."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for b in in_blocks(batches, "text", 8 << 20):
            got = [judge(t.as_py(), weights) for t in b.column("text")]
            v = np.array([x for x, _ in got], dtype=float)
            spans = pa.array([[{"start": a, "end": z, "p": p} for a, z, p in found] for _, found in got], type=span)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(v), pa.array((v >= threshold).astype(np.int32)), spans], ["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
