"""Log-bilinear language model, trained by noise-contrastive estimation, with normalised scores.

The last words' vectors, each weighted by its position, add up to a predicted vector; its product with
an outcome's vector and the outcome's bias are the outcome's score.  A word is predicted in two steps: first its class, then
the word within the class.  Words that come often have vectors of their own and form classes by
frequency; their number grows with the square root of the corpus, and classes have about the square root of
that many words, so a token costs the two roots.  All other words belong to classes by their last two bytes
and have their share of the class by their count.  The end of a text is a class of its own.

Training tells outcomes from noise drawn by their frequency, for classes and within each class, and never
sums over all outcomes; scoring does, in batched matrix products, so probabilities add up to one.

Tasks train on their own partitions and their models are averaged, each vector by how often a partition had it; so
the model depends on how the input is partitioned, and is the same for the same partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.registry import register
from signalbox.llm.storage import partitions, stored
from signalbox.llm.text import Words, lean, words_of

FOLDS, HELD_OUT = 7, 2
ROWS = 1024
"""Vectors that are sent together."""


@dataclass(frozen=True)
class Settings:
    growth: float = 1.0
    """Words with vectors: so many times the square root of the number of tokens, between ``least`` and ``most``."""
    least: int = 256
    most: int = 1 << 18
    """Bounds the model: 36 MB."""
    rare: int = 31
    dims: int = 16
    context: int = 3
    noise: int = 32
    noise_within: int = 16
    batch: int = 16384
    steps: int = 12
    """A range of texts of about a megabyte is learnt in so many minibatches or more, unless they fall below ``small`` tokens."""
    small: int = 1024
    rate: float = 0.12
    frequent: int = 65_536
    """Words, at least those with vectors, whose counts every task is sent; the counts of rarer ones are joined."""
    warm: int = 16
    """The first round of training takes one in so many texts, the second one all."""


@dataclass(frozen=True)
class Shape:
    """Items are words with vectors, then the rare classes, then the end (as context: the begin) of a text."""

    words: int
    rare: int
    dims: int
    context: int

    @property
    def width(self) -> int:
        """Words of a class."""
        return max(1, math.isqrt(self.words))

    @property
    def groups(self) -> int:
        return -(-self.words // self.width)

    @property
    def items(self) -> int:
        return self.words + self.rare + 1

    @property
    def classes(self) -> int:
        return self.groups + self.rare + 1

    def class_of(self, item: np.ndarray) -> np.ndarray:
        return np.where(item < self.words, item // self.width, self.groups + item - self.words)

    def members(self, group: int) -> slice:
        return slice(group * self.width, min(self.words, (group + 1) * self.width))


@dataclass
class Model:
    """One row per vector: items as predictors, classes, words in their classes, position weights; the last column has biases."""

    shape: Shape
    rows: np.ndarray

    @staticmethod
    def first(counts: np.ndarray, shape: Shape) -> Model:
        """``counts`` by item."""
        draw = np.random.Generator(np.random.PCG64(3))
        size = shape.items + shape.classes + shape.words + shape.context
        model = Model(shape, draw.normal(0, 0.3, (size, shape.dims + 1)).astype(np.float32))
        model.rows[:, -1] = 0.0
        model.weights[:, :-1] = 1 / shape.context
        for part, share in ((model.tops, _class_counts(counts, shape)), (model.words, counts[: shape.words])):
            part[:, -1] = np.log((share + 0.5) / (share + 0.5).sum()) if len(part) else 0.0
        return model

    @property
    def inputs(self) -> np.ndarray:
        return self.rows[: self.shape.items]

    @property
    def tops(self) -> np.ndarray:
        return self.rows[self.shape.items :][: self.shape.classes]

    @property
    def words(self) -> np.ndarray:
        return self.rows[self.shape.items + self.shape.classes :][: self.shape.words]

    @property
    def weights(self) -> np.ndarray:
        return self.rows[len(self.rows) - self.shape.context :]

    def predicted(self, context: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Predicted vectors, a one at their end to take in the biases, and the context's vectors by position."""
        parts = [np.take(self.inputs, context[:, i], axis=0) for i in range(context.shape[1])]
        out = parts[0] * self.weights[0]
        for part, weight in zip(parts[1:], self.weights[1:]):
            out += part * weight
        out[:, -1] = 1.0
        return out, parts

    def log10(self, context: np.ndarray, target: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Normalised log probabilities of the target items."""
        out, shape = np.zeros(len(target)), self.shape
        kind = shape.class_of(target)
        # tokens of one class beside each other
        order = np.argsort(kind, kind="stable")
        predicted, _ = self.predicted(context[order])
        kind, wanted = kind[order], target[order]
        for at in range(0, len(target), batch):
            own = slice(at, at + batch)
            out[order[own]] = _log_share(predicted[own] @ self.tops.T, kind[own])
        cuts = np.searchsorted(kind, np.arange(shape.groups + 1))
        for group in np.flatnonzero(cuts[1:] > cuts[:-1]):
            members = shape.members(group)
            for at in range(cuts[group], cuts[group + 1], batch):
                own = slice(at, min(at + batch, cuts[group + 1]))
                out[order[own]] += _log_share(predicted[own] @ self.words[members].T, wanted[own] - members.start)
        return out / np.log(10.0)


def _log_share(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logarithm of the share that each row's own outcome has of the exponentials."""
    value = scores[np.arange(len(own)), own]
    top = scores.max()
    if top - scores.min() > 80:
        top = scores.max(axis=1)
        scores -= top[:, None]
    else:
        # no row can overflow or vanish
        scores -= top
    np.exp(scores, out=scores)
    return value - top - np.log(scores.sum(axis=1))


def _class_counts(counts: np.ndarray, shape: Shape) -> np.ndarray:
    return np.bincount(shape.class_of(np.arange(shape.items)), counts, shape.classes)


class Trainer:
    """Noise-contrastive estimation with AdaGrad; a minibatch shares its noise, within a class too."""

    def __init__(self, model: Model, counts: np.ndarray, settings: Settings, seed: int):
        self.model, self.settings = model, settings
        self.draw = np.random.Generator(np.random.PCG64(seed))
        share = _class_counts(counts, model.shape) + 0.5
        share /= share.sum()
        self.cumulated = np.cumsum(share)
        self.log_noise = np.log(settings.noise * share).astype(np.float32)
        self.squares = np.full(model.rows.shape, 1e-4, dtype=np.float32)
        self.times = np.zeros(len(model.rows))
        """How often each vector was met."""
        self.within = []
        for group in range(model.shape.groups):
            share = counts[model.shape.members(group)] + 0.5
            share = share / share.sum()
            self.within.append((np.cumsum(share), np.log(settings.noise_within * share).astype(np.float32)))

    def contrast(self, q: np.ndarray, outcomes: np.ndarray, own: np.ndarray, cumulated: np.ndarray, log_noise: np.ndarray, noises: int, d_q: np.ndarray) -> np.ndarray:
        """Gradient of the outcomes' rows; that of the predicted vectors is added to ``d_q``."""
        noise = np.minimum(np.searchsorted(cumulated, self.draw.random(noises) * cumulated[-1]), len(cumulated) - 1)
        wanted, unwanted = outcomes[own], outcomes[noise]
        g_good = _sigmoid(np.einsum("ij,ij->i", q, wanted) - log_noise[own]) - np.float32(1)
        g_bad = _sigmoid(q @ unwanted.T - log_noise[noise])
        d_q += g_good[:, None] * wanted + g_bad @ unwanted
        out = _summed(own, g_good[:, None] * q, len(outcomes))
        d = out.shape[1]
        np.add.at(out.reshape(-1), (noise[:, None] * d + np.arange(d)).ravel(), (g_bad.T @ q).ravel().astype(np.float64))
        return out

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        model, shape, n = self.model, self.model.shape, len(target)
        kind = shape.class_of(target)
        # tokens of one class beside each other
        order = np.argsort(kind.astype(np.uint16), kind="stable") if shape.classes < 1 << 16 else np.argsort(kind, kind="stable")
        context, target, kind = context[order], target[order], kind[order]
        (q, parts), d_q = model.predicted(context), np.zeros((n, shape.dims + 1), dtype=np.float32)
        gradient = np.zeros_like(model.rows)
        grown = Model(shape, gradient)
        grown.tops[:] = self.contrast(q, model.tops, kind, self.cumulated, self.log_noise, self.settings.noise, d_q)
        cuts = np.searchsorted(kind, np.arange(shape.groups + 1))
        for group in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own, members = slice(cuts[group], cuts[group + 1]), shape.members(group)
            grown.words[members] = self.contrast(q[own], model.words[members], target[own] - members.start, *self.within[group], self.settings.noise_within, d_q[own])
        d_q[:, -1] = 0.0
        for i, part in enumerate(parts):
            grown.inputs[:] += _summed(context[:, i], d_q * model.weights[i], shape.items)
            grown.weights[i] = np.einsum("ij,ij->j", d_q, part)
        met = np.bincount(context.ravel(), minlength=shape.items)
        self.times[: shape.items] += met
        self.times[shape.items :][: shape.classes] += np.bincount(kind, minlength=shape.classes)
        self.times[shape.items + shape.classes :][: shape.words] += np.bincount(target[target < shape.words], minlength=shape.words)
        self.times[len(self.times) - shape.context :] += n
        gradient *= np.float32(1 / n)
        squared = gradient * gradient
        self.squares += squared
        np.sqrt(self.squares, out=squared)
        gradient *= np.float32(self.settings.rate)
        gradient /= squared
        model.rows -= gradient

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        size = max(1, min(self.settings.batch, max(self.settings.small, len(target) // self.settings.steps)))
        for at in range(0, len(target), size):
            own = slice(at, at + size)
            self.step(context[own], target[own])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    half = x.dtype.type(0.5)
    return half * (1 + np.tanh(half * x))


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    d = rows.shape[1]
    flat = (index[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, weights=rows.ravel(), minlength=n * d).reshape(n, d)


def word_class(words: Words, classes: int) -> np.ndarray:
    """Class of every word: its last two bytes, A-Z lower-cased, spread over the classes."""
    last = words.data[words.end - 1].astype(np.int64)
    prior = words.data[np.maximum(words.end - 2, words.start)].astype(np.int64)
    fold = lambda b: b + 32 * ((b >= 65) & (b <= 90))
    return (fold(prior) * 257 + fold(last)) * 40503 % 65521 % classes


@dataclass
class Vocabulary:
    """Frequent words by sorted hash: counts, and items of those with vectors (-1: of a rare class)."""

    keys: np.ndarray
    counts: np.ndarray
    item: np.ndarray
    shape: Shape
    item_counts: np.ndarray
    class_mass: np.ndarray
    tokens: int
    distinct: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 for the others."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def sequences(words: Words, entry: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, contexts, bounds) of a range of texts; each text's last item is its end."""
    shape = vocabulary.shape
    item = word_class(words, shape.rare) + shape.words
    if len(vocabulary.keys):
        own = vocabulary.item[entry]
        item = np.where((entry >= 0) & (own >= 0), own, item)
    end = shape.items - 1
    target = np.insert(item, words.bound[1:], end)
    bounds = words.bound + np.arange(len(words.bound))
    position = np.arange(len(target)) - np.repeat(bounds[:-1], np.diff(bounds))
    context = np.empty((len(target), shape.context), dtype=np.int64)
    for i in range(shape.context):
        # before a text's first word there is the begin
        context[:, i] = np.where(position > i, np.roll(target, i + 1), end)
    return target, context, bounds


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder of the texts that are not learnt from; a null id is empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def count_words(texts: DataFrame, settings: Settings) -> DataFrame:
    """(hash, class, n) of every word of all texts, summed per task as far as memory goes, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, first, inverse = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([h[2] for h in held]), minlength=len(key)).astype(np.int64)
            return key, np.concatenate([h[1] for h in held])[first], n

        for batch in batches:
            for _, _, words in words_of(batch.column(0)):
                key, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((key, word_class(words, settings.rare)[first], n))
                if sum(len(h[0]) for h in held) > 1_500_000:
                    held[:] = [summed()]
                    if len(held[0][0]) > 750_000:
                        yield _counts(*held.pop())
        if held:
            yield _counts(*summed())

    counted = texts.select("text").mapInArrow(lean(run), "hash long, class int, n long")
    return stored(counted.groupBy("hash").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "counts")


def _counts(key: np.ndarray, kind: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], ["hash", "class", "n"])


def least_count(counts: DataFrame, limit: int) -> int:
    """The least n such that at most ``limit`` words have n or more: by the counts of powers of two, then within one."""
    level, above = F.floor(F.log2("n")).cast("int"), 0
    for power, words in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if above + words > limit:
            inside = counts.where(level == power).groupBy("n").count().collect()
            for n, more in sorted(inside, reverse=True):
                if above + more > limit:
                    return n + 1
                above += more
        above += words
    return 1


def vocabulary_of(counts: DataFrame, ends: int, settings: Settings) -> Vocabulary:
    """The frequent words, of bounded number, and the rare classes' sums."""
    classes = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    tokens = sum(r["n"] for r in classes) + ends
    distinct = sum(r["types"] for r in classes) + (ends > 0)
    wanted = min(settings.most, max(settings.least, math.ceil(settings.growth * math.sqrt(tokens))))
    top = counts.where(F.col("n") >= least_count(counts, max(wanted, settings.frequent))).collect()
    top.sort(key=lambda r: (-r["n"], r["hash"]))
    shape = Shape(min(wanted, len(top)), settings.rare, settings.dims, settings.context)
    mass, item_counts = np.ones(settings.rare), np.zeros(shape.items)
    for r in classes:
        mass[r["class"]] += r["n"] + r["types"]
        item_counts[shape.words + r["class"]] += r["n"]
    for i, r in enumerate(top[: shape.words]):
        item_counts[i] = r["n"]
        mass[r["class"]] -= r["n"] + 1
        item_counts[shape.words + r["class"]] -= r["n"]
    item_counts[-1] = ends
    keys = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    item = np.where(np.arange(len(top)) < shape.words, np.arange(len(top)), -1)
    n = np.array([r["n"] for r in top], dtype=np.int64)
    return Vocabulary(keys[order], n[order], item[order], shape, item_counts, mass, tokens, distinct)


def train(texts: DataFrame, vocabulary: Vocabulary, settings: Settings) -> Model:
    """Two rounds over the texts' partitions, a part of the texts and then all; each ends with the average of the
    partitions' vectors, weighted by how often each was met.  The bounded model alone reaches the driver."""
    context = texts.sparkSession.sparkContext
    shape = vocabulary.shape
    known = context.broadcast(vocabulary)
    schema = "block int, times array<float>, total array<float>"

    def round_(rows: DataFrame, start: Model, seed: int) -> Model:
        begun = context.broadcast(start.rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = known.value
            trainer = Trainer(Model(shape, begun.value.copy()), vocabulary.item_counts, settings, seed + TaskContext.get().partitionId())
            seen = False
            for batch in batches:
                for _, _, words in words_of(batch.column(0)):
                    target, context, _ = sequences(words, vocabulary.find(words.hash), vocabulary)
                    trainer.learn(context, target)
                    seen = True
            if seen:
                yield _blocks(np.arange(0, len(begun.value), ROWS), trainer.times, trainer.model.rows * trainer.times[:, None].astype(np.float32))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, times, total in zip(*(batch.column(i) for i in range(3))):
                    own = found.setdefault(block.as_py(), [0.0, 0.0])
                    own[0] = own[0] + times.values.to_numpy().astype(np.float64)
                    own[1] = own[1] + total.values.to_numpy().astype(np.float64)
            for block, (times, total) in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([times], pa.list_(pa.float32())), pa.array([total], pa.list_(pa.float32()))], ["block", "times", "total"]
                )

        sent = rows.select("text").mapInArrow(lean(run), schema).repartition(partitions(rows.sparkSession), "block")
        out = start.rows.copy()
        table = sent.mapInArrow(add, schema).toArrow()
        for block, times, total in zip(*(table.column(i) for i in range(3))):
            here = out[block.as_py() * ROWS :][:ROWS]
            times, total = times.values.to_numpy(), total.values.to_numpy().reshape(-1, out.shape[1])
            # a vector that no partition met stays
            met = times > 0
            here[met] = total[met] / times[met, None]
        return Model(shape, out)

    warm = round_(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(settings.warm)) == 0), Model.first(vocabulary.item_counts, shape), 1000)
    return round_(texts, warm, 2000)


def _blocks(starts: np.ndarray, times: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(starts // ROWS, pa.int32()), pa.array([times[a : a + ROWS].astype(np.float32) for a in starts], pa.list_(pa.float32())),
            pa.array([total[a : a + ROWS].ravel() for a in starts], pa.list_(pa.float32())),
        ],
        ["block", "times", "total"],
    )


@dataclass
class Learned:
    counts: DataFrame
    vocabulary: Vocabulary
    model: Model


def learn(texts: DataFrame, settings: Settings = Settings()) -> Learned:
    """Counts of all words, and a model, from (doc_id, text)."""
    counts = count_words(texts, settings)
    vocabulary = vocabulary_of(counts, texts.select("doc_id").count(), settings)
    return Learned(counts, vocabulary, train(texts, vocabulary, settings))


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, found double, score double, rare array<long>, times array<int>"


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the texts that are not held out, and score all.

    Per document: n_tokens (words and one end), n_known (tokens that the learning texts have),
    train_tokens, base_score (add-one counts) and score (the model), both sums of log10.
    Null and empty texts have the end alone; equal rows are scored and learnt from one by one;
    without learning texts every count is 0.  Rare words' counts are joined by hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return scored(docs, learn(docs.where("NOT held_out"), settings))


def scored(docs: DataFrame, learned: Learned) -> DataFrame:
    """Scores of (doc_id, text, held_out) by what was learned."""
    counts, tokens, distinct = learned.counts, learned.vocabulary.tokens, learned.vocabulary.distinct
    shared = docs.sparkSession.sparkContext.broadcast((learned.vocabulary, learned.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        vocabulary, model = shared.value
        end_count = int(vocabulary.item_counts[-1])
        log_mass, log_count = np.log10(vocabulary.class_mass), np.log10(vocabulary.counts + 1.0)
        for batch in batches:
            for first, last, words in words_of(batch.column(1)):
                entry = vocabulary.find(words.hash)
                target, context, bounds = sequences(words, entry, vocabulary)
                total = np.concatenate([[0.0], np.cumsum(model.log10(context, target))])
                value = total[bounds[1:]] - total[bounds[:-1]]
                frequent = entry >= 0
                in_class = target[np.arange(len(entry)) + np.repeat(np.arange(last - first), words.counts())] >= vocabulary.shape.words
                own = np.where(frequent, log_count[entry] if len(log_count) else 0.0, 0.0)
                share = np.where(in_class, own - log_mass[word_class(words, vocabulary.shape.rare)], 0.0)
                sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (own, share, frequent)]
                found, shares, known = (s[words.bound[1:]] - s[words.bound[:-1]] for s in sums)
                rare, times = [], []
                for i in range(last - first):
                    at = slice(words.bound[i], words.bound[i + 1])
                    key, n = np.unique(words.hash[at][~frequent[at]], return_counts=True)
                    rare.append(key.view(np.int64))
                    times.append(n.astype(np.int32))
                n = last - first
                columns = [
                    pa.array(row + np.arange(n)), batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(bounds)),
                    pa.array(known.astype(np.int64) + (end_count > 0)), pa.array(found + np.log10(end_count + 1.0)), pa.array(value + shares),
                    pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _SCORED.split(", ")])

    rows = stored(docs.select("doc_id", "text", "held_out").mapInArrow(lean(run), _SCORED), "scored")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    joined = pairs.join(counts.select("hash", "n"), "hash")
    more = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    out = rows.drop("rare", "times").join(more, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("found") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1.0)))).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )


@register("op9_neural_lm")
def op9_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
