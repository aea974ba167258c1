"""Learned scorers: classifiers, regressors, pairwise preferences and item response."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.operators import boosting, linear, tfidf
from signalbox.operators.audit import model_pairs
from signalbox.operators.labels import soft_oracle_labels
from signalbox.operators.neighbors import dense_rewards
from signalbox.session import durable

FOREST_ROWS = 10_000
"""Rows up to which MLlib's forests take thresholds from all of them, beyond that from a sample of them."""
FOREST_BINS = 32


def _cells(models: Sequence[str], value: Callable[[int], Column]) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("model"), value(i).alias("score")) for i, m in enumerate(models)])


def text_features(
    train: DataFrame, queries: DataFrame, spec: tfidf.TfidfSpec, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Stored training vectors with the ``keep`` columns, and query vectors."""
    model = tfidf.fit(train, spec)
    rows = durable(tfidf.transform(train, model, keep=("id", *keep), as_vector=True))
    return rows, tfidf.transform(queries, model, as_vector=True)


def linear_cells(queries: DataFrame, models: Sequence[str], weights: np.ndarray, bias: np.ndarray, link: str = "identity") -> DataFrame:
    """``id, cells``: one linear score per column of ``weights`` (features x outputs).

    The weights are as large as vocabulary bound times outputs and go out as one broadcast, so
    that all outputs are scored in one pass.
    """
    shared = queries.sparkSession.sparkContext.broadcast((np.asfortranarray(weights), bias))
    width = len(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for first, last, row, idx, values in linear.row_parts(batch):
                out = linear.scores(row, idx, values, last - first, w) + b
                if link == "logistic":
                    out = 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))
                elif link == "softmax":
                    out = np.exp(out - out.max(axis=1, keepdims=True))
                    out /= out.sum(axis=1, keepdims=True)
                ends = pa.array(np.arange(0, out.size + 1, w.shape[1]), pa.int32())
                scores = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), scores], ["id", "scores"])

    scored = linear.sparse_parts(queries, ("id",)).mapInArrow(score, "id long, scores array<double>")
    if width != weights.shape[1]:
        return scored
    return scored.select("id", _cells(models, lambda i: F.get(F.col("scores"), F.lit(i))).alias("cells"))


def _label_index(models: Sequence[str], label: Column) -> Column:
    return (F.array_position(F.lit(list(models)), label) - 1).cast("double")


# --- regressors ------------------------------------------------------------------

def _size(rows: DataFrame) -> int:
    return rows.select("features").first().features.size


def fit_ridge(rows: DataFrame, models: Sequence[str], alpha: float = 10.0, values: str = "rewards") -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one ridge regression per model on shared features, to convergence."""
    parts = linear.sparse_parts(rows, (values,))
    return linear.ridge(parts, values, _size(rows), len(models), alpha)


def ridge_scores(rows: DataFrame, queries: DataFrame, models: Sequence[str], alpha: float = 10.0) -> DataFrame:
    weights, bias = fit_ridge(rows, models, alpha)
    return linear_cells(queries, models, weights, bias)


def _dense(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select("id", vector_to_array("features").alias("vec"), *columns)


def boosted_regression_scores(
    rows: DataFrame, queries: DataFrame, models: Sequence[str], trees: int = 300, depth: int = 4,
    step: float = 0.05, seed: int = 42, values: str = "rewards", row_share: float = 0.9, column_share: float = 0.9,
) -> DataFrame:
    """One boosted reward regressor per model, fitted on all rows together."""
    spec = boosting.Boosting(trees, depth, step, row_share, column_share)
    forests = boosting.fit_together(_dense(rows, F.col(values).alias("targets")), len(models), spec, seed)
    scored = boosting.predicted(_dense(queries), forests)
    return scored.select("id", _cells(models, lambda i: F.get("scores", F.lit(i))).alias("cells"))


# --- classifiers -----------------------------------------------------------------

def _labelled(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    return rows.select("features", _label_index(models, F.col("label")).alias("label"))


def _probabilities(column: str, models: Sequence[str]) -> Column:
    """Class probabilities in model order; a class past the largest label seen has none."""
    array = vector_to_array(F.col(column))
    return _cells(models, lambda i: F.coalesce(F.get(array, F.lit(i)), F.lit(0.0)))


def fit_logistic(rows: DataFrame, models: Sequence[str], c: float = 1.0, max_iter: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a multinomial head on labels; ``c`` is the inverse of the penalty on the summed loss."""
    parts = linear.sparse_parts(rows.select("features", _label_index(models, F.col("label")).cast("int").alias("label")), ("label",))

    def examples(batch, first, last):
        label = batch.column("label").slice(first, last - first).to_numpy()
        return (label[:, None] == np.arange(len(models))).astype(np.float64), np.ones(len(label))

    return linear.softmax(parts, _size(rows), len(models), 1.0 / c, examples, max_iter=max_iter)


def logistic_scores(rows: DataFrame, queries: DataFrame, models: Sequence[str], c: float = 1.0, max_iter: int = 500) -> DataFrame:
    """Oracle-label classifier: ``rows`` has ``features, label``; a class without rows has no share."""
    return linear_cells(queries, models, *fit_logistic(rows, models, c, max_iter), "softmax")


def _boosted_probabilities(rows: DataFrame, queries: DataFrame, models: Sequence[str], spec: boosting.Boosting, seed: int, in_task: int) -> DataFrame:
    """One binary boosted classifier per class, probabilities re-normalised over the classes."""
    data = rows.select("id", "features", _label_index(models, F.col("label")).cast("int").alias("label"))
    present = sorted(r.label for r in data.select("label").distinct().collect())
    if len(present) == 1:
        only = present[0]
        return queries.select("id", _cells(models, lambda i: F.lit(1.0 if i == only else 0.0)).alias("cells"))
    targets = F.array(*[(F.col("label") == i).cast("double") for i in present]).alias("targets")
    scored = boosting.boosted_outputs(_dense(data, targets), _dense(queries), len(present), spec, seed, in_task)
    share = lambda i: 1.0 / (1.0 + F.exp(-F.get("scores", F.lit(present.index(i))))) if i in present else F.lit(0.0)
    scored = scored.select("id", _cells(models, share).alias("cells"))
    total = C.total(C.values(F.col("cells"), "score"))
    return C.add_field_with(scored, "score", {"total": total}, lambda c, s: c["score"] / s["total"])


def boosted_classifier_scores(
    rows: DataFrame, queries: DataFrame, models: Sequence[str], trees: int = 500, depth: int = 5, step: float = 0.05, seed: int = 42,
    row_share: float = 0.9, column_share: float = 0.9, in_task: int = boosting.IN_TASK,
) -> DataFrame:
    """Boosted classifiers on all rows, whose number decides between one task an output and scans (``boosting``)."""
    spec = boosting.Boosting(trees, depth, step, row_share, column_share, logistic=True)
    return _boosted_probabilities(rows, queries, models, spec, seed, in_task)


def _binned(rows: DataFrame, cuts: list[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the vectors with the number of its bin in place of every value."""
    slim = rows.select(*keep, vector_to_array("features").alias("vec"))
    names = slim.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = linear.matrix(batch.column("vec"), len(cuts))
                bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.float64)
                ends = pa.array(np.arange(0, bins.size + 1, len(cuts)), pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(bins.ravel()))], names)

    return slim.mapInArrow(place, slim.schema).select(*keep, array_to_vector("vec").alias("features"))


def classifier_ensemble_scores(
    rows: DataFrame, queries: DataFrame, models: Sequence[str], trees: int = 500, depth: int = 5, step: float = 0.05,
    forest: int = 500, forest_depth: int = 30, c: float = 1.0, max_iter: int = 1000, seed: int = 42,
) -> DataFrame:
    """Mean class probability of boosted trees, a random forest and logistic regression.

    Forest trees grow until leaves are pure, to MLlib's limit of 30 levels.  On more than ``FOREST_ROWS`` rows it gets
    numbers of bins between quantiles of all rows, so that all of them, not MLlib's sample, tell the thresholds.
    """
    data, asked = _labelled(rows, models), queries
    if data.count() > FOREST_ROWS:
        cuts = boosting.quantile_cuts(_dense(rows), _size(rows), FOREST_BINS)
        data, asked = _binned(data, cuts, ("label",)), _binned(queries, cuts, ("id",))
    boosted = boosted_classifier_scores(rows, queries, models, trees, depth, step, seed)
    forest_model = RandomForestClassifier(
        numTrees=forest, maxDepth=forest_depth, seed=seed, predictionCol="_fp", rawPredictionCol="_fr", probabilityCol="_f"
    ).fit(data)
    logistic = logistic_scores(rows, queries, models, c, max_iter).select("id", F.col("cells").alias("_logistic"))
    forest_part = forest_model.transform(asked).select("id", _probabilities("_f", models).alias("_forest"))
    both = forest_part.join(logistic, "id").join(boosted, "id")
    part = lambda c, name: C.value_of(F.col(name), c["model"], "score")
    mean = lambda c: (c["score"] + part(c, "_forest") + part(c, "_logistic")) / F.lit(3.0)
    return C.add_field(both, "score", mean).drop("_forest", "_logistic")


def soft_oracle_scores(
    rows: DataFrame, queries: DataFrame, panel: DataFrame, models: Sequence[str], temperature: float = 0.05, max_iter: int = 1000
) -> DataFrame:
    """Regret-weighted soft-label classifier: one multinomial head on the soft targets themselves.

    Row weights are taken relative to their mean, so the penalty keeps its proportion.
    """
    labels = soft_oracle_labels(panel, temperature).select("id", "cells", "row_weight")
    joined = rows.select("id", "features").join(labels, "id")
    targets = F.array(*[F.coalesce(C.value_of(F.col("cells"), F.lit(m), "target"), F.lit(0.0)) for m in models])
    parts = durable(linear.sparse_parts(joined.select("features", targets.alias("targets"), "row_weight"), ("targets", "row_weight")))
    mean = parts.agg(F.avg("row_weight")).first()[0] or 1.0

    def examples(batch, first, last):
        weight = batch.column("row_weight").slice(first, last - first).to_numpy() / mean
        return linear.matrix(batch.column("targets").slice(first, last - first), len(models)), weight

    weights, bias = linear.softmax(parts, _size(rows), len(models), 1.0, examples, max_iter=max_iter)
    return linear_cells(queries, models, weights, bias, "softmax")


# --- independent performance and cost heads ------------------------------------------

def head_cells(rows: DataFrame, queries: DataFrame, models: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """``id, cells<model, performance, z_cost>`` from one head of each kind per model, to convergence.

    ``rows`` has ``features, performances, z_costs`` arrays.  A performance may be any fraction;
    a model with performances of 0 or 1 alone has a constant head.
    """
    parts, size, m = linear.sparse_parts(rows, ("performances", "z_costs")), _size(rows), len(models)
    spans = rows.agg(*[f(F.get("performances", F.lit(i))) for i in range(m) for f in (F.min, F.max)]).first()
    constant = np.array([spans[2 * i] == spans[2 * i + 1] and spans[2 * i] in (0.0, 1.0) for i in range(m)])

    def examples(batch, first, last):
        y = linear.matrix(batch.column("performances").slice(first, last - first), m)
        return y, np.where(constant, 0.0, np.ones_like(y))

    with linear.blocks(parts) as stored:
        weights, bias = linear.logistic(stored, size, m, np.full(m, penalty), examples, scaled=True)
        cost_weights, cost_bias = linear.ridge(stored, "z_costs", size, m, penalty)
    bias = np.where(constant, [30.0 if spans[2 * i] == 1.0 else -30.0 for i in range(m)], bias)
    perf = linear_cells(queries, models, weights, bias, "logistic")
    cost = linear_cells(queries, models, cost_weights, cost_bias)
    joined = perf.join(cost.select("id", F.col("cells").alias("_c")), "id")
    cell = lambda c: F.struct(
        c["model"].alias("model"),
        c["score"].alias("performance"),
        C.value_of(F.col("_c"), c["model"], "score").alias("z_cost"),
    )
    return joined.select("id", F.transform("cells", cell).alias("cells"))


# --- pairwise preferences -----------------------------------------------------------

def pairwise_scores(
    train: DataFrame,
    queries: DataFrame,
    models: Sequence[str],
    spec: tfidf.TfidfSpec = tfidf.SPECS["pairwise"],
    min_margin: float = 0.0,
    margin_power: float = 0.5,
    penalty: float = 1e-5,
    balanced: bool = True,
    max_iter: int = 30,
) -> DataFrame:
    """Mean win probability of every model over its margin-weighted pairwise classifiers.

    A tie counts as a loss of the earlier model with the smallest weight.  A pair with one
    outcome is constant and a pair without usable rows is even.
    """
    carried = dense_rewards(train, models).select("id", "query", "cells", "rewards")
    rows, vectors = text_features(carried, queries, spec, keep=("rewards",))
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    diff = F.col("reward_i") - F.col("reward_j")
    weight = F.pow(F.greatest(F.abs(diff), F.lit(1e-6)), F.lit(float(margin_power)))
    stats = {
        (r.model_i, r.model_j): r
        for r in model_pairs(carried, "reward")
        .where(F.abs(diff) >= min_margin)
        .groupBy("model_i", "model_j")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(diff > 0).alias("wins"),
            F.sum(F.when(diff > 0, weight).otherwise(0.0)).alias("w_win"),
            F.sum(F.when(diff > 0, 0.0).otherwise(weight)).alias("w_loss"),
        )
        .collect()
    }
    parts, size = linear.sparse_parts(rows, ("rewards",)), _size(rows)
    found = [stats.get((models[i], models[j])) for i, j in pairs]
    mixed = np.array([s is not None and 0 < s.wins < s.n for s in found])
    share = lambda s, wins: s.n / (2 * wins) if balanced else 1.0
    c_win = np.array([share(s, s.wins) if ok else 0.0 for s, ok in zip(found, mixed)])
    c_loss = np.array([share(s, s.n - s.wins) if ok else 0.0 for s, ok in zip(found, mixed)])
    # the mean weighted loss and the penalty keep their proportion whatever the weights add up to
    total = np.array([s.w_win * w + s.w_loss * l if ok else 1.0 for s, w, l, ok in zip(found, c_win, c_loss, mixed)])
    size_of = np.array([s.n if ok else 1.0 for s, ok in zip(found, mixed)])
    left, right = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    width = len(models)

    def examples(batch, first, last):
        r = linear.matrix(batch.column("rewards").slice(first, last - first), width)
        gap = r[:, left] - r[:, right]
        won = gap > 0
        weight = np.maximum(np.abs(gap), 1e-6) ** margin_power * np.where(won, c_win, c_loss) / total
        return won.astype(np.float64), np.where(np.abs(gap) >= min_margin, weight, 0.0)

    weights, bias = linear.logistic(parts, size, len(pairs), penalty * size_of / total, examples, max_iter=max_iter)
    bias = np.where(mixed, bias, [0.0 if s is None else 30.0 if s.wins == s.n else -30.0 for s in found])
    names = [f"{i}:{j}" for i, j in pairs]
    wins = linear_cells(vectors, names, weights, bias, "logistic")

    def mean_win(m: int) -> Column:
        total = F.lit(0.0)
        for place, (i, j) in enumerate(pairs):
            p = F.get(F.col("cells"), F.lit(place))["score"]
            if m == i:
                total = total + p
            elif m == j:
                total = total + (F.lit(1.0) - p)
        return total / F.lit(float(max(1, len(models) - 1)))

    return wins.select("id", _cells(models, mean_win).alias("cells"))


# --- item response -------------------------------------------------------------------

@dataclass
class ItemResponse:
    """Discrimination (width x latent), difficulty (width) and abilities (models x latent)."""

    models: list[str]
    a: np.ndarray
    a0: np.ndarray
    d: np.ndarray
    d0: np.ndarray
    ability: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.a, self.a0, self.d, self.d0, self.ability)])

    def unflat(self, v: np.ndarray) -> "ItemResponse":
        parts, at = [], 0
        for x in (self.a, self.a0, self.d, self.d0, self.ability):
            parts.append(v[at : at + x.size].reshape(x.shape))
            at += x.size
        return ItemResponse(self.models, *parts)

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = x @ self.a + self.a0
        disc = np.logaddexp(0.0, raw) + 1e-4
        return raw, disc @ self.ability.T - (x @ self.d + self.d0)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_item_response(
    rows: DataFrame, models: Sequence[str], width: int, latent: int = 25, epochs: int = 80, lr: float = 0.05,
    weight_decay: float = 1e-4, max_norm: float = 1.0, seed: int = 42,
) -> ItemResponse:
    """Multidimensional item response model on ``vec, performances`` by full-batch gradients.

    An epoch is one job: every partition sums its gradient, the partial sums are added per
    parameter, and a few thousand numbers come back.
    """
    rng = np.random.default_rng(seed)
    bound = 1.0 / np.sqrt(width)
    state = ItemResponse(
        list(models),
        rng.uniform(-bound, bound, (width, latent)), rng.uniform(-bound, bound, latent),
        rng.uniform(-bound, bound, width), rng.uniform(-bound, bound, 1),
        rng.normal(0.0, 0.02, (len(models), latent)),
    )
    data = durable(rows.select("vec", "performances"))
    n = data.count()
    if n == 0:
        raise ValueError("item response needs at least one training query")
    sc = rows.sparkSession.sparkContext
    m, v = np.zeros_like(state.flat()), np.zeros_like(state.flat())
    for step in range(1, epochs + 1):
        shared = sc.broadcast(state)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = np.zeros_like(now.flat())
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x, y = _matrix(batch.column("vec")), np.clip(_matrix(batch.column("performances")), 0.0, 1.0)
                raw, z = now.logits(x)
                err = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
                disc = np.logaddexp(0.0, raw) + 1e-4
                g_raw = (err @ now.ability) / (1.0 + np.exp(-np.clip(raw, -30, 30)))
                g_d = -err.sum(axis=1)
                total += np.concatenate(
                    [(x.T @ g_raw).ravel(), g_raw.sum(axis=0), x.T @ g_d, [g_d.sum()], (err.T @ disc).ravel()]
                )
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total)], ["p", "g"])

        sums = data.mapInArrow(partial, "p int, g double").groupBy("p").agg(F.sum("g").alias("g")).toPandas()
        grad = np.zeros_like(m)
        grad[sums["p"].to_numpy()] = sums["g"].to_numpy()
        grad /= n * len(models)
        norm = np.linalg.norm(grad)
        if norm > max_norm:
            grad *= max_norm / norm
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        now = state.flat()
        state = state.unflat(now - lr * (move + weight_decay * now))
        shared.unpersist()
    return state


def item_response_cells(queries: DataFrame, fitted: ItemResponse) -> DataFrame:
    """``id, cells<model, performance>``."""
    shared = queries.sparkSession.sparkContext.broadcast(fitted)
    width = len(fitted.models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, z = shared.value.logits(_matrix(batch.column("vec")))
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            ends = pa.array(np.arange(0, p.size + 1, width), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["id", "p"])

    scored = queries.select("id", "vec").mapInArrow(score, "id long, p array<double>")
    cells = F.array(
        *[F.struct(F.lit(m).alias("model"), F.get(F.col("p"), F.lit(i)).alias("performance")) for i, m in enumerate(fitted.models)]
    )
    return scored.select("id", cells.alias("cells"))


def dense_features(rows: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """``vec`` arrays as MLlib vectors."""
    return rows.select(*keep, array_to_vector(F.col("vec").cast("array<double>")).alias("features"))


# --- hybrid ---------------------------------------------------------------------------

def hybrid_scores(queries: DataFrame, branches: dict[str, tuple[Column, DataFrame]], fallback: Column) -> DataFrame:
    """Score each part of the queries with its own scorer and record which one it was.

    ``branches`` maps a source name to (condition on the query, scored cells); a query that no
    branch scored gets the fallback cells.
    """
    out = queries
    chosen, source = None, None
    for name, (condition, scored) in branches.items():
        out = out.join(scored.select("id", F.col("cells").alias(f"_{name}")), "id", "left")
        hit = condition & F.col(f"_{name}").isNotNull()
        chosen = F.when(hit, F.col(f"_{name}")) if chosen is None else chosen.when(hit, F.col(f"_{name}"))
        source = F.when(hit, F.lit(name)) if source is None else source.when(hit, F.lit(name))
    return out.select(
        *queries.columns, source.otherwise("train_mean").alias("router_source"), chosen.otherwise(fallback).alias("cells")
    )
