"""TF-IDF over word and character n-grams.

Only the vocabulary is aggregated across documents.  Counting a document's terms against the
vocabulary is row-local, so (document, term) rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions.terms import terms, units
from signalbox.session import durable

SLICE = 500_000
"""Terms, words or characters of a batch that a task counts at once, but for those of a single longer text."""
TIES = 10_000
"""Terms of equal frequency and prefix that are ordered directly."""


@dataclass(frozen=True)
class TfidfSpec:
    """What counts as a term and which terms the vocabulary keeps."""

    analyzer: str = "word"
    low: int = 1
    high: int = 2
    max_features: int = 200_000
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = True
    strip_accents: bool = True


# Vectoriser settings of each consumer.
SPECS = {
    "knn_router": TfidfSpec("word", 1, 2, 200_000),
    "word12": TfidfSpec("word", 1, 2, 50_000, 1, 0.98),
    "charwb35": TfidfSpec("char_wb", 3, 5, 50_000, 1, 0.98),
    "char35": TfidfSpec("char", 3, 5, 50_000, 1, 0.98),
    "classifier": TfidfSpec("word", 1, 2, 40_000, 2, 1.0, sublinear=False, strip_accents=False),
    "retrieval": TfidfSpec("word", 1, 2, 40_000, 2, 1.0, sublinear=False),
    "pairwise": TfidfSpec("char_wb", 3, 5, 200_000, 1, 0.98),
    "embedder": TfidfSpec("char_wb", 3, 5, 50_000, 1, 0.98),
}


@dataclass(frozen=True)
class TfidfModel:
    """Vocabulary in term order with its idf; at most ``spec.max_features`` entries."""

    spec: TfidfSpec
    terms: list[str]
    idf: np.ndarray
    n_docs: int

    @property
    def size(self) -> int:
        return len(self.terms)


def with_terms(docs: DataFrame, spec: TfidfSpec, text: str = "query") -> DataFrame:
    column = terms(F.coalesce(F.col(text), F.lit("")), spec.analyzer, spec.low, spec.high, spec.strip_accents)
    return docs.withColumn("_terms", column)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch's rows with a bounded number of terms; a row lies in one of them."""
    yield from _stretches(batch, batch.column("_terms").value_lengths(), SLICE)


def _stretches(batch: pa.RecordBatch, lengths: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    ends = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _code_points(texts: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype="<u4")


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    flat = np.ascontiguousarray(points, dtype="<u4")
    sizes = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
    data = flat.tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(len(flat), pa.py_buffer(offsets), pa.py_buffer(data))


def _gram_counts(
    codes: np.ndarray, kinds: int, lengths: np.ndarray, low: int, high: int, cuts: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, places, tf, df) of the distinct n-grams of rows of ``lengths`` codes below ``kinds``.

    A place is where the n-gram begins for the first time.  ``cuts`` marks the codes that no n-gram holds together with the next one.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    passed = None if cuts is None else np.concatenate([[0], np.cumsum(cuts)])
    keys, space = codes, max(1, kinds)
    for n in range(1, high + 1):
        if n > 1:
            if space > 2**62 // max(1, kinds):
                found, keys = np.unique(keys, return_inverse=True)
                space = len(found)
            keys = keys[: len(codes) - n + 1] * kinds + codes[n - 1 :]
            space *= max(1, kinds)
        if n < low or not len(keys):
            continue
        at = np.arange(len(keys))
        inside = at + n <= end[: len(keys)]
        if passed is not None:
            inside &= passed[at + n - 1] == passed[at]
        at = at[inside]
        if not len(at):
            continue
        # places of equal n-grams stay in order, so their rows ascend
        at = at[np.argsort(keys[at], kind="stable")]
        own, rows = keys[at], row[at]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        first = np.flatnonzero(new)
        tf = np.diff(np.concatenate([first, [len(at)]]))
        df = np.add.reduceat((new | np.concatenate([[True], rows[1:] != rows[:-1]])).astype(np.int64), first)
        yield n, at[first], tf, df


def _partial_counts(batches: Iterator[pa.RecordBatch], spec: TfidfSpec = TfidfSpec("word", 1, 1)) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per distinct term of a stretch of rows; the one column has their words or characters."""

    def count_words(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        words = batch.column(0)
        coded = pc.dictionary_encode(words.flatten())
        names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = words.value_lengths().to_numpy(zero_copy_only=False)
        for n, at, tf, df in _gram_counts(codes, len(names), lengths, spec.low, spec.high):
            parts = [names.take(pa.array(codes[at + i])) for i in range(n)]
            yield pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0], tf, df

    def count_characters(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        texts = batch.column(0)
        points = _code_points(texts)
        present = np.zeros(0x110000, dtype=bool)
        present[points] = True
        kinds = int(present.sum())
        codes = (np.cumsum(present) - 1)[points]
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        cuts = None
        if spec.analyzer == "char_wb" and len(points):
            blank = points == 32
            cuts = blank & np.concatenate([blank[1:], [False]])
        for n, at, tf, df in _gram_counts(codes, kinds, lengths, spec.low, spec.high, cuts):
            yield _strings(points[at[:, None] + np.arange(n)]), tf, df

    for whole in batches:
        column = whole.column(0)
        by_words = spec.analyzer == "word"
        lengths = column.value_lengths() if by_words else pc.utf8_length(column)
        for batch in _stretches(whole, lengths, SLICE):
            for terms, tf, df in count_words(batch) if by_words else count_characters(batch):
                yield pa.RecordBatch.from_arrays([terms, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["term", "tf", "df"])


def term_statistics(docs: DataFrame, spec: TfidfSpec, text: str = "query") -> DataFrame:
    """``term, tf, df`` over all documents, in one shuffle of counts already summed per batch.

    Tasks get a text's words or characters and count its n-grams as numbers: only distinct ones become strings.
    A term every document holds arrives as one row per batch, so no term is a hot key.
    """
    parts = docs.select(units(F.coalesce(F.col(text), F.lit("")), spec.analyzer, spec.strip_accents).alias("_units"))
    counted = parts.mapInArrow(lambda batches: _partial_counts(batches, spec), "term string, tf long, df long")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, spec: TfidfSpec, text: str = "query", n_docs: int | None = None) -> DataFrame:
    """Terms within the document-frequency bounds; of those the ``max_features`` most frequent."""
    n = docs.count() if n_docs is None else n_docs
    stats = term_statistics(docs, spec, text)
    kept = stats.where((F.col("df") >= spec.min_df) & (F.col("df") <= F.lit(float(spec.max_df * n))))
    top = most_frequent(durable(kept), spec.max_features)
    idf = F.ln(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return top.withColumn("idf", idf)


def most_frequent(stats: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` terms of largest ``tf``, the smaller term first on ties, without one task that orders them.

    Counts by ``tf`` name the last frequency that is taken, and its last term is found by counts of
    prefixes; what is returned is one filter over ``stats``.
    """
    if stats.count() <= limit:
        return stats
    by_tf = stats.groupBy("tf").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("tf"))
    above, least = 0, None
    # equal frequencies are one row; their number is about the square root of the text's length
    for row in by_tf.toLocalIterator():
        if above + row["n"] >= limit:
            least = row["tf"]
            break
        above += row["n"]
    last = nth_term(stats.where(F.col("tf") == least).select("term"), limit - above)
    return stats.where((F.col("tf") > least) | ((F.col("tf") == least) & (F.col("term") <= last)))


def nth_term(terms: DataFrame, n: int) -> str:
    """The n-th smallest of distinct terms: a prefix grows by a character until few terms share it."""
    prefix = ""
    while True:
        own = terms.where(F.col("term").startswith(prefix)) if prefix else terms
        head = F.substring("term", 1, len(prefix) + 1)
        # a term that is its own prefix is one row
        for name, size, low in sorted(map(tuple, own.groupBy(head.alias("p")).agg(F.count(F.lit(1)), F.min("term")).collect())):
            if size == n == 1:
                return low
            if size >= n:
                break
            n -= size
        else:
            raise ValueError("fewer terms than that")
        prefix = name
        if size <= TIES:
            return own.where(head == name).orderBy("term").limit(n).agg(F.max("term")).first()[0]


def fit(docs: DataFrame, spec: TfidfSpec, text: str = "query", retry_min_df: bool = False) -> TfidfModel:
    """Collect the vocabulary; its size is bounded by ``spec.max_features``."""
    n = docs.count()
    table = vocabulary(docs, spec, text, n).select("term", "idf").toArrow()
    if table.num_rows == 0 and retry_min_df and spec.min_df > 1:
        return fit(docs, replace(spec, min_df=1), text)
    if table.num_rows == 0:
        raise ValueError("empty vocabulary")
    names = np.asarray(table.column("term").to_pylist(), dtype=object)
    order = np.argsort(names)
    return TfidfModel(spec, names[order].tolist(), table.column("idf").to_numpy()[order], n)


def _count_terms(terms: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, count) of every vocabulary term of a batch, by row and then index."""
    lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
    place = pc.index_in(terms.flatten(), value_set=vocabulary)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    index = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    row = np.repeat(np.arange(len(terms)), lengths)[known]
    keys, counts = np.unique(row * len(vocabulary) + index, return_counts=True)
    return keys // len(vocabulary), keys % len(vocabulary), counts


def transform(docs: DataFrame, model: TfidfModel, keep: Sequence[str] = ("id",), text: str = "query", as_vector: bool = False) -> DataFrame:
    """``keep`` columns plus ``idx, w`` arrays, or plus one ``features`` vector.

    Terms outside the vocabulary drop out; a text without known terms gets an empty vector.  The
    vocabulary, bounded by ``max_features``, is broadcast; a task counts and weighs a
    bounded stretch of rows at a time.
    """
    slim = with_terms(docs, model.spec, text).select(*keep, "_terms")
    fields = [f for f in slim.schema.fields if f.name != "_terms"]
    if as_vector:
        extra = [T.StructField("features", VectorUDT())]
    else:
        extra = [T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(fields + extra)
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(model.terms, pa.string()), model.idf))
    sublinear, size = model.spec.sublinear, model.size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = shared.value
        for batch in (part for whole in batches for part in _slices(whole)):
            n = batch.num_rows
            row, index, count = _count_terms(batch.column("_terms"), vocabulary)
            w = ((1.0 + np.log(count)) if sublinear else count.astype(np.float64)) * idf[index]
            w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=n))[row]
            ends = np.cumsum(np.bincount(row, minlength=n))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32()))
            ws = pa.ListArray.from_arrays(offsets, pa.array(w, pa.float64()))
            kept = [batch.column(f.name) for f in fields]
            if as_vector:
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), ids, ws],
                    ["type", "size", "indices", "values"],
                )
                columns = [*kept, vector]
            else:
                columns = [*kept, ids, ws]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return slim.mapInArrow(weigh, schema)


def as_vectors(weighted: DataFrame, size: int, keep: Sequence[str] = ("id",)) -> DataFrame:
    """``keep`` columns and the ``idx, w`` arrays as one ``features`` vector."""
    slim = weighted.select(*keep, "idx", "w")
    fields = [f for f in slim.schema.fields if f.name in keep]

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), batch.column("idx"), batch.column("w")],
                ["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], vector], [*[f.name for f in fields], "features"])

    return slim.mapInArrow(wrap, T.StructType([*fields, T.StructField("features", VectorUDT())]))


def weight_rows(weighted: DataFrame, model: TfidfModel, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Long ``id, term, w``: the term names looked up in the bounded vocabulary."""
    spark = weighted.sparkSession
    names = spark.createDataFrame(
        pa.table({"i": pa.array(np.arange(model.size), pa.int32()), "term": pa.array(model.terms)})
    )
    rows = weighted.select(*keep, F.explode(F.arrays_zip("idx", "w")).alias("e"))
    # The vocabulary never exceeds spec.max_features rows.
    joined = rows.join(F.broadcast(names), rows["e.idx"] == names["i"])
    return joined.select(*keep, "term", F.col("e.w").alias("w"))


def idf_value(n_docs: int, df: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1.0
