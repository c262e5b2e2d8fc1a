"""BPE encoding and decoding over a trie of distinct words.

The byte-pair encoding of a string is the only way to cut it into tokens so that every two neighbours are compatible,
that is, encode as themselves when put together.  So the encoding of any prefix ends in one definite token, its last-token
state, and what stands before that token is again a prefix, encoded already.  The distinct words of a batch go through
a trie in depth-first order: a word keeps the states of the prefix that it shares with the one before, and only the
rest is computed.  Sorted words with the length of the common prefix are that trie, in that order.

Defined results: a null text is an empty one; an empty text has no tokens and decodes to itself; repeated rows are encoded
alike; the special token's own string is one token; decoding gives the text back.  Other columns pass through
unchanged, except that ``ids`` and ``decoded`` of the input are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import by_batches, in_blocks, kept, table

#: How this family of vocabularies splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where that is visible Latin-1, else 256 and up."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One vocabulary with its caches, which are emptied at fixed sizes."""

    def __init__(self, source: str, most_words: int = 300_000, most_pairs: int = 1_000_000):
        spec = json.loads(source)
        letters = _letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.id_of))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = raw(a), raw(b)
            self.merge.setdefault((self.id_of[a], self.id_of[b]), (rank, self.id_of[a + b]))
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.most_words, self.most_pairs = most_words, most_pairs

    def merged(self, raw: bytes) -> list[int]:
        """The definition itself: the pair of lowest rank is merged, leftmost first, until none is left."""
        ids = [self.id_of[bytes([b])] for b in raw]
        while len(ids) > 1:
            best = min((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge) if any(p in self.merge for p in zip(ids, ids[1:])) else None
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words, in the trie's depth-first order."""
        id_of, longest, compatible, bytes_of = self.id_of, self.longest, self.compatible, self.bytes_of
        last: list[int] = [-1]  # last[i]: the last token of the first i bytes
        path = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, n = 0, min(len(raw), len(path))
            if raw[:n] == path[:n]:
                shared = n
            else:
                while raw[shared] == path[shared]:
                    shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(raw) + 1):
                for start in range(max(0, i - longest), i):
                    t = id_of.get(raw[start:i])
                    if t is not None and (start == 0 or compatible(last[start], t)):
                        last.append(t)
                        break
            path = raw
            ids, i = [], len(raw)
            while i:
                ids.append(last[i])
                i -= len(bytes_of[last[i]])
            self.words[word] = np.array(ids[::-1], dtype=np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        cut: list[list[str | int]] = []
        for text in texts:
            if self.at_special is None or not self.at_special.search(text):
                cut.append(self.split.findall(text))
                continue
            parts, at = [], 0
            for m in self.at_special.finditer(text):
                parts += self.split.findall(text[at : m.start()])
                parts.append(self.special[m[0]])
                at = m.end()
            cut.append(parts + self.split.findall(text[at:]))
        if len(self.words) >= self.most_words:
            self.words.clear()
        new = {w for ws in cut for w in ws if w not in self.words}
        self.learn(w for w in new if isinstance(w, str))
        self.words |= {i: np.array([i], dtype=np.int32).tobytes() for i in new if isinstance(i, int)}
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoder(source: str) -> Encoder:
    """One for the last vocabulary and each Python worker; its caches live on from task to task, until another operator runs
    in the worker."""
    mine = kept("op07")
    if source not in mine:
        mine.clear()
        mine[source] = Encoder(source)
    return mine[source]


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and with ``decoded``, the text that these ids decode to, where asked for.  The
    vocabulary (a file of fixed size) is broadcast; texts go through in small batches."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    cols = [c for c in docs.columns if c not in ("ids", "decoded")]
    at = cols.index(text_col)
    schema = docs.select(*cols).schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in in_blocks(batches, text_col, 2 << 20):
            ids = enc.encode_all([t.as_py() or "" for t in b.column(at)])
            flat = np.frombuffer(b"".join(ids), dtype=np.int32)
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            out = [*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                out.append(pa.array([enc.decode(np.frombuffer(x, dtype=np.int32).tolist()) for x in ids], type=pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema.fieldNames())

    return docs.select(*cols).mapInArrow(by_batches("op07", run), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pipeline's last stage: what is trained on."""
    out = encode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
