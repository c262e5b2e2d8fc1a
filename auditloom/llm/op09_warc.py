"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own.  A reading task gets a byte range of a file, looks for the gzip magic in it, and
takes a place for a record only if what it decompresses to begins with a WARC header that can be read.  A record
belongs to the range that it starts in, however far it reaches, so ranges can be cut anywhere.

Defined results: null html is an empty payload; a null url is written as an empty target; of records with equal payloads of
``least`` bytes or more those with the largest id are responses and the others revisit it, null ids counting as smallest;
repeated rows are written as often as they come; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import in_blocks, table
from auditloom.plans.staging import new_folder, stage

LEAST = 1000
SPLIT = 4 << 20
#: Reading tasks at most; beyond that a task has several ranges.
TASKS = 20_000
MAGIC = b"\x1f\x8b\x08"
_HIGH, _NULL = 0x6C6F6F6D_77617263, 0x6C6F6F6D_6E756C6C
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    """A URN that carries the id: its lower half is the page's."""
    high, low = (_NULL, 0) if page_id is None else (_HIGH, page_id & (1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(urn: str) -> int | None:
    x = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    low = x & (1 << 64) - 1
    return None if x >> 64 == _NULL else low - (1 << 64) * (low >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c if c > ' ' else f'%{ord(c):02X}' for c in url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _open(path: str):
    """The file system and the path in it.  Tasks open archives themselves, since no reader of Spark's gives byte ranges; what
    Hadoop calls s3a or s3n is s3 here.  A store that pyarrow cannot open raises its error; nothing falls back to local files."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, revisit).  Only payloads that occur again have a row on the right side of
    the join, one each, so a payload that a third of all pages share is a skewed join's left side, which is split."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    again = p.where(F.length("payload") >= least).groupBy(F.col("sha1").alias("_s")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
    again = again.where("_n > 1").drop("_n")
    j = p.join(again, (F.col("sha1") == F.col("_s")) & (F.length("payload") >= least), "left").drop("_s")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return j.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("refers_to")))


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = 128 << 20) -> DataFrame:
    """Write archives under ``folder``; returns (path, size) of each, staged.  A file gets a name that no other attempt
    uses and counts only once its row is committed, so a task that runs twice leaves no second copy."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size = None, "", 0
        done: list[tuple[str, int]] = []
        for b in in_blocks(batches, "payload", 4 << 20):
            for page_id, url, payload, sha1, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to", "revisit"))):
                if out is None:
                    path, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    where, inner = _open(path)
                    where.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(inner, compression=None)  # members are compressed already
                out.write(got := record(page_id, url, payload, bytes.fromhex(sha1), refers_to, revisit))
                size += len(got)
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, (path, size)], None
        if out is not None:
            out.close()
            done.append((path, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], type=pa.int64())], ["path", "size"])

    return stage(decided(pages, least).mapInArrow(run, "path string, size long"), "warc-list")


def members(f, start: int, end: int, chunk: int = 1 << 18, step: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each member that starts in [start, end) of the open file.  The file is read forwards once, by
    ``chunk``; of a place that turns out to be no member the bytes behind it are still there.  Members are decoded by ``step``, so
    that little is copied when one ends."""
    f.seek(start)
    buf, at, pos = b"", start, 0  # the buffer, its offset in the file, and the place in it
    while True:
        hit = buf.find(MAGIC, pos)
        if hit < 0:
            if at + len(buf) - len(MAGIC) + 1 >= end:
                return
            tail = buf[max(pos, len(buf) - len(MAGIC) + 1) :]
            more = f.read(chunk)
            if not more:
                return
            buf, at, pos = tail + more, at + len(buf) - len(tail), 0
            continue
        if at + hit >= end:
            return
        z, parts, size, good, i = zlib.decompressobj(31), [], 0, None, hit
        try:
            while not z.eof:
                piece = buf[i : i + step]
                if not piece:
                    piece = f.read(chunk)
                    if not piece:
                        break
                    buf, at, i, hit = buf[hit:] + piece, at + hit, i - hit, 0
                    piece = piece[:step]
                parts.append(z.decompress(piece))
                i += len(piece)
                size += len(parts[-1])
                if good is None and size >= 8:
                    good = b"".join(parts)[:7] == b"WARC/1."
                    if not good:
                        break
        except zlib.error:
            good = False
        if good and z.eof and b"\r\n\r\n" in (whole := b"".join(parts)):
            yield at + hit, whole
            pos = i - len(z.unused_data)
        else:
            pos = hit + 1


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-case name, and the block."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    headers = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return headers, rest[: int(headers.get("content-length", len(rest)))]


RECORD = "path string, offset long, record_type string, record_id string, refers_to_id string, url string, digest string, http string, payload binary"


def read(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives given as (path, size); files are cut into ranges of ``split`` bytes."""
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split)
    # a task for each range, up to a number that a driver can plan; a given number of partitions is not merged
    n = files.agg(F.sum(F.ceil(F.greatest("size", F.lit(1)) / split))).first()[0] or 1
    ranges = ranges.repartitionByRange(max(1, min(TASKS, int(n))), "path", "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                where, inner = _open(path)
                with where.open_input_file(inner) as f:
                    rows, size = [], 0
                    for offset, whole in members(f, start, end):
                        h, block = parse(whole)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        rows.append((path, offset, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), http.decode("utf-8", "replace"), payload))
                        size += len(payload)
                        if size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return ranges.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages", "page_id", "url", "html"), new_folder(spark, "warc"))
    own = read(files)

    def derive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [page_of(x) for x in b.column(0).to_pylist()]
            to = [page_of(x) if x else None for x in b.column(1).to_pylist()]
            hexes = [base64.b32decode(x.removeprefix("sha1:")).hex() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), b.column(3), pa.array(hexes), b.column(4), pa.array(to, type=pa.int64()), b.column(5)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_digest"])

    told = F.regexp_extract("http", r"(?i)content-length: *(\d+)", 1).cast("long")
    rows = own.select("record_id", "refers_to_id", "digest", told.alias("told"), "record_type", F.sha1("payload").alias("sha1"))
    out = rows.mapInArrow(derive, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_digest string")
    # a response's digest is that of the bytes read back; a revisit's is the one its header states
    digest = F.when(F.col("record_type") == "response", F.col("stored_digest")).otherwise(F.col("payload_digest"))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH a AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM a),
c AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM b)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM c"""
