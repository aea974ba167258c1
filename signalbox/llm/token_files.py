"""Token ids in Huffman-coded files, written in id order and read back.

A file begins with ``TIDS`` and the compressed code lengths; blocks follow, each with its
documents (id, number of ids, first byte), its checkpoints and its payload.  A document begins
at a whole byte and has a checkpoint, a bit offset, every 256 ids; runs between checkpoints
are decoded independently.  Only the files that the manifest lists count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.llm import huffman
from signalbox.llm.registry import register
from signalbox.llm.storage import filesystem, id_bounds, id_bucket, partitions, shared_folder, stored
from signalbox.llm.tokens import END, VOCABULARY, token_ids

MAGIC = b"TIDS"
BLOCK = 1 << 20
"""Ids from which on a block is closed."""
FILE_IDS = 8_000_000
"""Ids a file should have about."""
SPACE = 1 << 16
_HEAD = "<qqqq"


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, n_tokens, ids) with the ids as 16-bit integers, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ids, bounds in token_ids(batch.column(1), vocabulary, end):
                raw = ids.astype("<u2").tobytes()
                own = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(bounds)), own], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit ids and bounds of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u2") if data.flags.aligned and offsets[0] % 2 == 0 else np.frombuffer(data.tobytes(), "<u2"), (offsets - offsets[0]) // 2


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: sums per task, added up by Spark; 65,536 rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SPACE, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_ids(batch.column(0))[0], minlength=SPACE)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(SPACE, dtype=np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row[0]] = row[1]
    return out


def encode(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, bits, marks) with each document's code and checkpoints."""
    packed = zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        code = huffman.codes(own)
        for batch in batches:
            ids, bounds = _ids(batch.column(2)) if len(batch) else (np.zeros(0, np.uint16), np.zeros(1, np.int64))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
                low, high = bounds[first], bounds[last]
                data, at, marks, mark_at = huffman.encode(ids[low:high], bounds[first : last + 1] - low, own, code)
                columns = [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)]
                for values, offsets in ((data, at), (marks, mark_at * 4)):
                    columns.append(pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "bits", "marks"])
                first = last

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, bits binary, marks binary")


def _block(rows: list[tuple]) -> bytes:
    """Documents with null ids carry a flag in the sign bit of their number of ids."""
    keys = np.array([0 if r[0] is None else r[0] for r in rows], dtype="<i8")
    counts = np.array([-r[1] if r[0] is None else r[1] for r in rows], dtype="<i8")
    sizes = np.array([len(r[2]) for r in rows], dtype=np.int64)
    starts = (np.cumsum(sizes) - sizes).astype("<i8")
    marks = b"".join(r[3] for r in rows)
    payload = b"".join(r[2] for r in rows)
    return struct.pack(_HEAD, len(rows), int(np.abs(counts).sum()), len(marks), len(payload)) + keys.tobytes() + counts.tobytes() + starts.tobytes() + marks + payload


MANIFEST = "bucket int, path string, n_docs long, n_tokens long, n_bytes long"
_MANIFEST = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def write(coded: DataFrame, lengths: np.ndarray, folder: str, buckets: list[int]) -> DataFrame:
    """Write one file per id range and return the stored manifest.

    A task writes under a temporary name and renames when the file is whole; a repeated task
    puts the same bytes in place.
    """
    head = zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        out, name, bucket, totals, rows, waiting = None, "", -1, [0, 0, 0], [], 0

        def put(data: bytes) -> None:
            out.write(data)
            totals[2] += len(data)

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    bucket, name = b, f"{path}/part-{b:06d}.tid"
                    where.create_dir(path, recursive=True)
                    temporary = f"{name}.{uuid.uuid4().hex}"
                    out = where.open_output_stream(temporary)
                    put(MAGIC + struct.pack("<q", len(head)) + head)
                rows.append(row)
                waiting += row[1]
                totals[0] += 1
                totals[1] += row[1]
                if waiting >= BLOCK:
                    put(_block(rows))
                    rows, waiting = [], 0
        if out is not None:
            if rows:
                put(_block(rows))
            out.close()
            where.move(temporary, name)
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "path": name, "n_docs": totals[0], "n_tokens": totals[1], "n_bytes": totals[2]}], schema=_MANIFEST)

    dealt = coded.select(id_bucket(F.col("doc_id"), buckets).alias("bucket"), "doc_id", "n_tokens", "bits", "marks")
    dealt = dealt.repartitionById(len(buckets) + 1, F.col("bucket")).sortWithinPartitions("doc_id", "n_tokens", "bits")
    manifest = dealt.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return coded.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files, the ids as 32-bit integers."""
    files = manifest.select("bucket", "path", F.coalesce(F.sum("n_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = filesystem(folder)
        for batch in batches:
            for _, path, start in zip(*(c.to_pylist() for c in batch.columns)):
                with where.open_input_stream(path) as file:
                    if file.read(4) != MAGIC:
                        raise ValueError(f"{path} is no file of token ids")
                    lengths = np.frombuffer(zlib.decompress(file.read(struct.unpack("<q", file.read(8))[0])), dtype=np.uint8)
                    decoder = huffman.table(lengths)
                    while head := file.read(struct.calcsize(_HEAD)):
                        n, total, mark_bytes, size = struct.unpack(_HEAD, head)
                        keys, counts, at = (np.frombuffer(file.read(8 * n), dtype="<i8") for _ in range(3))
                        missing, counts = counts < 0, np.abs(counts)
                        marks = np.frombuffer(file.read(mark_bytes), dtype="<u4").astype(np.int64)
                        data = np.frombuffer(file.read(size), dtype=np.uint8)
                        runs = (counts + huffman.STEP - 1) // huffman.STEP
                        last = np.cumsum(runs) - 1
                        lengths_of = np.full(len(marks), huffman.STEP)
                        lengths_of[last] = counts - (runs - 1) * huffman.STEP
                        ids = huffman.decode(data, marks + np.repeat(at * 8, runs), lengths_of, decoder).astype("<u4")
                        bounds = np.concatenate([[0], np.cumsum(counts)])
                        raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                        columns = [pa.array(keys, mask=missing), pa.array(start + bounds[:-1]), pa.array(counts), raw]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                        start += total

    return files.repartitionByRange(max(1, partitions(manifest.sparkSession)), "bucket").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Write the documents' token ids to files in the shared folder and read them back.

    Null texts are empty and have the end id alone; null doc_ids come first; equal ids stand
    beside each other in the order of their codes; an empty table gives an empty manifest.
    The ids of all texts are stored once, as counts must be known before anything is coded.
    """
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, vocabulary), "ids")
    counts = count_ids(tokens)
    lengths = huffman.code_lengths(counts)
    bounds = id_bounds(tokens.select("doc_id"), max(partitions(spark), -(-int(counts.sum()) // file_ids)))
    folder = shared_folder(spark, "token-files")
    return read(write(encode(tokens, lengths), lengths, folder, bounds), folder), folder


@register("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
