"""Vector bin packing of examples into sequences.

An example needs tokens, one segment and loss-bearing tokens (those after its prompt).  The
open sequence takes the waiting piece whose needs have the largest dot product with what is
left of the limits, each as a share of its limit.  When no piece fits whole, one is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.registry import register
from signalbox.llm.text import lean
from signalbox.llm.tokens import END, VOCABULARY, token_ids


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    waiting: int = 2048
    """Pieces among which the next one is chosen: the memory of a task, not a limit on the input."""


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    prompt: int
    whole: int

    def loss(self) -> int:
        return len(self.ids) - min(len(self.ids), self.prompt)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        rest = Piece(self.key, self.start + n, self.ids[n:], max(0, self.prompt - n), self.whole)
        return Piece(self.key, self.start, self.ids[:n], min(n, self.prompt), self.whole), rest


class Packer:
    """Packs a stream of examples; ``out`` holds (sequence, offset, piece) of closed sequences."""

    def __init__(self, limits: Limits):
        self.limits, self.out, self.sequence = limits, [], 0
        self.waiting: list[Piece] = []
        self.open: list[Piece] = []
        self.left = np.array([limits.tokens, limits.segments, limits.loss])

    def close(self) -> None:
        at = 0
        for piece in self.open:
            self.out.append((self.sequence, at, piece))
            at += len(piece.ids)
        self.sequence += bool(self.open)
        self.open = []
        self.left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])

    def add(self, piece: Piece) -> None:
        """Full sequences are cut from the front; the rest waits."""
        limits = self.limits
        while len(piece.ids) >= limits.tokens or piece.loss() >= limits.loss:
            head, piece = piece.cut(self.room(piece, limits.tokens, limits.loss))
            self.out.append((self.sequence, 0, head))
            self.sequence += 1
        if len(piece.ids):
            self.waiting.append(piece)
        if len(self.waiting) >= limits.waiting:
            self.pack(limits.waiting // 2)

    @staticmethod
    def room(piece: Piece, tokens: int, loss: int) -> int:
        """How many tokens of the piece fit."""
        return min(tokens, len(piece.ids), piece.prompt + loss)

    def pack(self, keep: int) -> None:
        """Place waiting pieces until ``keep`` are left."""
        limits = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.float64)
        needs = np.array([(len(p.ids), 1, p.loss()) for p in self.waiting], dtype=np.int64).reshape(-1, 3)
        shares = needs / limits**2
        free = np.ones(len(needs), dtype=bool)
        count = len(needs)
        while count > keep:
            if self.left.min() <= 0:
                self.close()
            score = np.where(free & (needs <= self.left).all(axis=1), shares @ self.left, -1.0)
            best = int(np.argmax(score))
            if score[best] < 0:
                # nothing fits whole: the largest piece fills the sequence
                best = int(np.argmax(np.where(free, needs[:, 0], -1)))
                n = self.room(self.waiting[best], int(self.left[0]), int(self.left[2]))
                head, self.waiting[best] = self.waiting[best].cut(n)
                self.open.append(head)
                self.close()
                rest = self.waiting[best]
                needs[best] = len(rest.ids), 1, rest.loss()
                shares[best] = needs[best] / limits**2
                continue
            self.open.append(self.waiting[best])
            self.left = self.left - needs[best]
            free[best] = False
            count -= 1
        self.waiting = [p for p, f in zip(self.waiting, free) if f]

    def finish(self) -> None:
        """Place all; the last sequence is split into lengths that are powers of two, so nothing is padded."""
        self.pack(0)
        tail, self.open = self.open, []
        total = sum(len(p.ids) for p in tail)
        while tail:
            wanted = 1 << (total.bit_length() - 1)
            total -= wanted
            while wanted:
                piece = tail.pop(0)
                if len(piece.ids) > wanted:
                    piece, rest = piece.cut(wanted)
                    tail.insert(0, rest)
                self.open.append(piece)
                wanted -= len(piece.ids)
            self.close()


OUT = "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens")] + [("ids", pa.binary())])


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = VOCABULARY, prompt: str | None = None) -> DataFrame:
    """One row per piece of the documents' token ids, the ids as little-endian 32-bit integers.

    ``prompt`` names a column with the number of leading tokens that bear no loss.  Each input
    partition is packed as a stream without a shuffle; memory is bounded by the waiting pieces.
    A null or empty text has the end id alone; equal rows are examples of their own; a null
    doc_id stays null; an empty table gives no rows.  Sequences are numbered within partitions,
    with the partition in the upper bits.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    columns.append((F.coalesce(F.col(prompt), F.lit(0)) if prompt else F.lit(0)).cast("long").alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits), TaskContext.get().partitionId() << 40

        def closed() -> pa.RecordBatch:
            rows = [(base + s, at, p.key, p.start, len(p.ids), p.whole, p.ids.astype("<u4").tobytes()) for s, at, p in packer.out]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            keys, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last, ids, bounds in token_ids(batch.column(1), vocabulary, END):
                for i in range(first, last):
                    # a copy: what waits does not hold on to all ids of its range
                    own = ids[bounds[i - first] : bounds[i - first + 1]].copy()
                    packer.add(Piece(keys[i], 0, own, prompts[i], len(own)))
                    if len(packer.out) >= 1000:
                        yield closed()
        packer.finish()
        if packer.out:
            yield closed()

    return docs.select(*columns).mapInArrow(lean(run), OUT)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op4_sequence_packing")
def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
