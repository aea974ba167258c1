"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade >= k) = sigmoid(w.x - t_k)`` with one weight vector for all thresholds
``t_1 < t_2 < ...``; the expected severity is the sum of these probabilities.  A text's features
are its distinct words and word beginnings.  Weights are not negative: harmless words do not
make up for harmful ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.llm.registry import register
from signalbox.llm.storage import stored
from signalbox.llm.text import words_of

SAMPLE = 20_000
"""Labelled documents that the model is fitted on, at most; taken by hash."""
FEATURES = 8192
PREFIXES = (4, 6)
MIN_DOCS = 3
MIN_LIFT = 25.0
MIN_Z = 4.5
PENALTY = 1e-5
STEPS = 800
_KINDS = np.ones(256, dtype=np.uint8)
_KINDS[[b for b in range(128) if not chr(b).isalnum()]] = 2
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) pairs, with repetitions, of a string column."""
    for first, _, words in words_of(column, prefixes=PREFIXES, kinds=_KINDS):
        row = first + np.repeat(np.arange(len(words.offsets) - 1), words.counts())
        for hashes in (words.hash, *words.prefix.values()):
            yield row, hashes


@dataclass
class OrdinalModel:
    """Sorted feature hashes with their weights, and the thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :]).sum(axis=1)

    def grade(self, scores: np.ndarray) -> np.ndarray:
        """The median grade: thresholds that are passed with probability one half or more."""
        return (scores[:, None] >= self.thresholds[None, :]).sum(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if not len(self.keys):
            return out
        likely = np.zeros(1 << 16, dtype=bool)
        likely[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        pairs = []
        for row, hashes in features(column):
            near = np.flatnonzero(likely[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[near]
            pairs.append(np.unique(row[near[hit]] * len(self.keys) + at[hit]))
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        return out + np.bincount(found // len(self.keys), weights=self.weights[found % len(self.keys)], minlength=len(out))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_ordinal(row: np.ndarray, column: np.ndarray, grades: np.ndarray, width: int, penalty: float = PENALTY, steps: int = STEPS):
    """Weights and thresholds of the penalised likelihood, for 0/1 features at (row, column).

    Gradient steps with adapted lengths over all rows; weights are kept at 0 or above, and the
    thresholds' distances above 0.
    """
    n, top = len(grades), int(grades.max(initial=0))
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    cuts = -np.log(share / (1 - np.minimum(share, 1 - 1e-9)) + 1e-12)
    # first threshold, then logarithms of the distances
    shape = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    x = np.concatenate([np.zeros(width), shape])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    thresholds = np.cumsum(np.concatenate([shape[:1], np.exp(shape[1:])]))
    for step in range(1, steps + 1):
        w, shape = x[:width], x[width:]
        thresholds = np.cumsum(np.concatenate([shape[:1], np.exp(shape[1:])]))
        s = np.bincount(row, weights=w[column], minlength=n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        low, high = _sigmoid(edges[grades] - s), _sigmoid(edges[grades + 1] - s)
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / p / n, high * (1 - high) / p / n
        d_score = d_high - d_low
        d_threshold = np.bincount(grades, weights=d_low, minlength=top + 1)[1:] - np.bincount(grades, weights=d_high, minlength=top + 1)[:-1]
        tail = np.cumsum(d_threshold[::-1])[::-1]
        d_shape = np.concatenate([tail[:1], tail[1:] * np.exp(shape[1:])])
        gradient = np.concatenate([np.bincount(column, weights=d_score[row], minlength=width) + penalty * w, d_shape])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x = x - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        x[:width] = np.maximum(x[:width], 0.0)
    return x[:width], thresholds


def fit(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, limit: int = FEATURES) -> OrdinalModel:
    """Fit on at most ``sample`` documents with a grade (doc_id, grade; 0, 1, 2, ...).

    Features are counted on the executors; those kept occur in more of the documents above
    grade 0 than chance allows and several times as often as in the others.  The sample's kept
    features, a few numbers a row, and the model reach the driver.  Repeated grades count as the
    largest; null ids and grades are left out; without two grades the model has no features.
    """
    spark = docs.sparkSession
    chosen = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "grade")
    rows = stored(rows.repartition(max(2, spark.sparkContext.defaultParallelism)), "graded")
    sizes = {r[0]: r[1] for r in rows.groupBy("grade").count().collect()}
    total, above = sum(sizes.values()), sum(v for k, v in sizes.items() if k > 0)
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf]))
    if not 0 < above < total:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high = np.array(batch.column(1).to_pylist()) > 0
            by_text: dict[int, list[np.ndarray]] = {}
            for row, hashes in features(batch.column(0)):
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                for r, own in zip(row[cut], np.split(hashes, cut[1:])):
                    by_text.setdefault(int(r), []).append(own)
            for flag in (False, True):
                sets = [np.unique(np.concatenate(v)) for r, v in by_text.items() if high[r] == flag]
                if sets:
                    key, n = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), flag)), pa.array(n)], ["key", "high", "n"])

    counted = rows.mapInArrow(count, "key long, high boolean, n long").groupBy("key").agg(
        F.sum(F.when(F.col("high"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("high"), 0).otherwise(F.col("n"))).alias("b")
    )
    pa_, pb = (F.col("a") + 0.5) / (above + 1.0), (F.col("b") + 0.5) / (total - above + 1.0)
    pooled = (F.col("a") + F.col("b")) / F.lit(float(total))
    z = (F.col("a") / float(above) - F.col("b") / float(total - above)) / F.sqrt(pooled * (1.0000001 - pooled) * (1.0 / above + 1.0 / (total - above)))
    kept = counted.where((F.col("a") + F.col("b") >= MIN_DOCS) & (pa_ >= MIN_LIFT * pb)).withColumn("z", z).where(F.col("z") >= MIN_Z)
    keys = np.sort(np.array([r[0] for r in kept.orderBy(F.desc("z"), "key").limit(limit).select("key").collect()], dtype=np.int64).view(np.uint64))
    if not len(keys):
        return none

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.zeros(0, dtype=np.int64)]
            for row, hashes in features(batch.column(0)):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                pairs.append(np.unique(row[hit] * len(keys) + at[hit]))
            found = np.unique(np.concatenate(pairs))
            own = np.split((found % len(keys)).astype(np.int32), np.searchsorted(found // len(keys), np.arange(1, len(batch))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["grade", "found"])

    got = rows.mapInArrow(sparse, "grade int, found array<int>").collect()
    grades = np.array([r[0] for r in got])
    column = np.array([c for r in got for c in r[1]], dtype=np.int64)
    row = np.repeat(np.arange(len(got)), [len(r[1]) for r in got])
    weights, thresholds = fit_ordinal(row, column, grades, len(keys))
    return OrdinalModel(keys, weights, thresholds)


def judged(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(row, severity, grade): each document as a struct of its own columns, and the model's result.

    Computed over whole texts; a null or empty text has no features.
    """
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.severity(scores)), pa.array(model.grade(scores).astype(np.int32))], ["row", "severity", "grade"])

    kinds = row.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kinds), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType())])
    return row.mapInArrow(run, schema)


def rejecting(docs: DataFrame, model: OrdinalModel, most: int = 0) -> DataFrame:
    """The documents with a grade of ``most`` or less, their columns unchanged."""
    return judged(docs, model).where(F.col("grade") <= most).select("row.*")


def toxic_grades(labels: DataFrame) -> DataFrame:
    """The table's two grades: 0 and 1."""
    return labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, toxic_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(docs, model).select("row.doc_id", "severity", "grade", (F.col("grade") > 0).alias("toxic"))
