"""Deterministic sharded WARC files, and reading them back.

Records are dealt out by page id in ranges, sorted, and written as one gzip member each; a file
is closed when it reaches its compressed size.  The files hold the same bytes on every run.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.registry import register
from signalbox.llm.storage import filesystem, id_bounds, id_bucket, partitions, shared_folder

DATE = "2020-01-01T00:00:00Z"
FILE_BYTES = 32 << 20
"""Compressed bytes at which a file is closed."""
SHARD_ROWS = 50_000
LEAST = 100
"""Payloads with fewer bytes are never revisits."""
LEVEL = 6
# The profile of revisits by equal payload, and the names of the fields
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "X-Page-Id"


def _sha(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def _id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member without time or name, so equal records are equal bytes."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    raw = f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = coder.compress(raw) + coder.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def page_record(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str = DATE) -> bytes:
    """A response with the payload, or a revisit with the HTTP header that the payload had."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    kind = "response" if refers is None else "revisit"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", _id(page, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url is not None else f"urn:page:{page}"),
        ("WARC-Payload-Digest", "sha256:" + digest), ("WARC-Block-Digest", _sha(block)), ("Content-Type", "application/http; msgtype=response"),
        (PAGE, "" if page is None else str(page)),
    ]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers, digest)), ("X-Refers-To-Page-Id", str(refers))]
    return _record(fields, block)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads that have a record with a smaller id.

    Only digests and ids move.  Digests with one id fall away in the aggregation; the join then
    has only those with copies, and Spark splits a hot one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("size"))
    keyed = keyed.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    return keyed.join(first.select("digest", "refers_to"), "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


MANIFEST = "shard int, part int, path string, n_records long, n_bytes long, sha256 string"
_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]
)


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_rows: int = SHARD_ROWS, least: int = LEAST) -> DataFrame:
    """Write all pages and return the stored manifest of the files that count.

    Null html is an empty payload; a null url is named by the page; null page ids come first and
    are responses; rows with equal ids are ordered by url and payload, and the first of equal
    payloads under one id stays a response with the others; an empty table writes no file.
    A task writes under temporary names and renames whole files; a repeated task puts equal
    bytes in place, and files beyond the manifest are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    count = rows.count()
    bounds = id_bounds(rows.select("page_id"), max(partitions(spark), -(-count // shard_rows)))
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = revisits(rows, least).select("page_id", nothing("string", "url"), nothing("string", "html"), "digest", "refers_to")
    both = rows.select("*", nothing("binary", "digest"), nothing("long", "refers_to")).unionByName(marks)
    both = both.withColumn("shard", id_bucket(F.col("page_id"), bounds))
    dealt = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        "page_id", F.col("refers_to").asc_nulls_last(), "url", "html"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        where.create_dir(path, recursive=True)
        out, made, part, marked, marks_of = None, [], 0, {}, None

        def finish() -> dict:
            out.close()
            name = f"{path}/shard-{shard:06d}-{part:05d}.warc.gz"
            where.move(temporary, name)
            return {"shard": shard, "part": part, "path": name, "n_records": n, "n_bytes": size, "sha256": sha.hexdigest()}

        for batch in batches:
            for page, url, html, digest, refers, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if refers is not None:
                    # a page's marks come before its records
                    marked = (marked if marks_of == page else {}) | {digest: refers}
                    marks_of = page
                    continue
                if out is None:
                    temporary, sha, n, size = f"{path}/{uuid.uuid4().hex}.tmp", hashlib.sha256(), 0, 0
                    out = where.open_output_stream(temporary, compression=None)
                payload = (html or "").encode()
                known = marked.get(hashlib.sha256(payload).digest()) if marked and page == marks_of else None
                data = page_record(page, url, payload, known)
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    made.append(finish())
                    out, part = None, part + 1
        if out is not None:
            made.append(finish())
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_MANIFEST)

    manifest = dealt.select("page_id", "url", "html", "digest", "refers_to", "shard").mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def members(file) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    waiting = b""
    while True:
        waiting = waiting or file.read(1 << 20)
        if not waiting:
            return
        coder, parts = zlib.decompressobj(31), []
        while not coder.eof:
            if not waiting:
                waiting = file.read(1 << 20)
                if not waiting:
                    raise ValueError("the archive ends within a record")
            parts.append(coder.decompress(waiting))
            waiting = coder.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError(f"no WARC record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


ROWS = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string"
_ROWS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string())]
)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the manifest's files; block and payload digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = filesystem(folder)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with where.open_input_stream(path, compression=None) as file:
                    for member in members(io.BufferedReader(file, 1 << 20)):
                        fields, block = parse(member)
                        if _sha(block) != fields["WARC-Block-Digest"]:
                            raise ValueError(f"a block of {path} differs from its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rpartition(b": ")[2])
                        kind = fields["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"a payload of {path} differs from its digest")
                        page, refers = fields[PAGE], fields.get("X-Refers-To-Page-Id")
                        url = fields["WARC-Target-URI"]
                        rows.append({
                            "page_id": int(page) if page else None, "url": None if url.startswith("urn:page:") else unquote(url),
                            "html": payload.decode() if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
                            "record_type": kind, "refers_to": int(refers) if refers else None, "path": path,
                        })
                        held += len(member)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    files = manifest.select("path", "shard", "part")
    return files.repartitionByRange(partitions(manifest.sparkSession), "shard", "part").mapInArrow(run, ROWS)


def round_trip(pages: DataFrame, file_bytes: int = FILE_BYTES, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, str]:
    folder = shared_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, file_bytes, shard_rows), folder), folder


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


@register("op8_warc_files", ORACLE)
def op8_warc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
