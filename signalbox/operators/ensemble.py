"""Blending, voting and guarded overrides of score and decision tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.operators.decide import decide, versus_base
from signalbox.operators.normalize import model_minmax, row_minmax, row_softmax


def normalized_weights(n: int, weights: Sequence[float] = ()) -> list[float]:
    """Weights that sum to 1, equal ones by default; a sum of zero or less is an error."""
    given = list(weights) or [1.0] * n
    if len(given) != n:
        raise ValueError(f"{len(given)} weights for {n} sources")
    total = sum(given)
    if total <= 0:
        raise ValueError("weights must sum to a positive number")
    return [w / total for w in given]


def _sum_cells(long: DataFrame, value: str = "score") -> DataFrame:
    """Sum long ``id, model, score`` into cells.

    Rows are partitioned by id once; both aggregates then use that partitioning.
    """
    placed = long.repartition("id")
    sums = placed.groupBy("id", "model").agg(F.sum(value).alias("score"))
    return C.from_long(sums, "score")


def blend(sources: Sequence[DataFrame], weights: Sequence[float] = (), scale: str = "minmax") -> DataFrame:
    """Weighted sum of score panels, each scaled per model first."""
    if not sources:
        raise ValueError("no score sources")
    shares = normalized_weights(len(sources), weights)
    parts = []
    for share, source in zip(shares, sources):
        scaled = model_minmax(source.select("id", "cells"), method=scale)
        weighted = C.add_field(scaled, "score", lambda c, s=share: F.lit(s) * c["score"])
        parts.append(C.to_long(weighted, "score"))
    return _sum_cells(reduce(DataFrame.unionByName, parts))


def average_blocks(blocks: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Mean of row-normalised blocks ``method, id, cells``; only the named methods when given."""
    chosen = blocks if names is None else blocks.where(F.col("method").isin(list(names)))
    long = C.to_long(row_minmax(chosen.select("method", "id", "cells")), "score")
    means = long.repartition("id").groupBy("id", "model").agg(F.avg("score").alias("score"))
    return C.from_long(means, "score")


# --- votes of earlier submissions ---------------------------------------------

def usable_history(
    history: DataFrame, min_score: float = 0.44, duplicates: str = "exclude", top_n: int = 5
) -> DataFrame:
    """History rows that may vote: complete, scored, good enough, duplicates settled, best first."""
    rows = history.where(
        (F.col("status") == "Complete") & F.col("public_score").isNotNull() & (F.col("public_score") >= min_score)
    )
    if duplicates == "exclude":
        once = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("file_name")
        rows = rows.join(once, "file_name", "left_semi")
    elif duplicates == "max":
        rows = rows.groupBy("file_name").agg(F.max("public_score").alias("public_score"))
    elif duplicates != "all":
        raise ValueError(f"unknown duplicate policy: {duplicates}")
    rows = rows.select("file_name", "public_score").orderBy(F.desc("public_score"), F.asc("file_name"))
    return rows.limit(top_n) if top_n > 0 else rows


def vote_weights(history: DataFrame, temperature: float = 0.01) -> DataFrame:
    """Softmax of the public scores over the voting rows."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    top = history.agg(F.max("public_score")).scalar()
    raw = history.withColumn("_e", F.exp((F.col("public_score") - top) / F.lit(temperature)))
    return raw.withColumn("weight", F.col("_e") / raw.agg(F.sum("_e")).scalar()).drop("_e")


def vote_scores(submissions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted one-hot sum over ``file_name, id, pred_model``, as cells of the models voted for."""
    voted = submissions.join(weights.select("file_name", "weight"), "file_name")
    return _sum_cells(voted.select("id", F.col("pred_model").alias("model"), F.col("weight").alias("score")))


def add_base_vote(scores: DataFrame, base: DataFrame, weight: float) -> DataFrame:
    """(1 - w) * score + w * one-hot of the base decision, over the union of the labels."""
    if weight <= 0:
        return scores.select("id", "cells")
    scaled = C.to_long(C.add_field(scores, "score", lambda c: F.lit(1.0 - weight) * c["score"]), "score")
    one_hot = base.select("id", F.col("pred_model").alias("model"), F.lit(float(weight)).alias("score"))
    return _sum_cells(scaled.unionByName(one_hot))


# --- overrides -------------------------------------------------------------------

def guarded_overrides(
    panel: DataFrame,
    base: DataFrame,
    min_margin: float = 0.0,
    min_gap: float = 0.0,
    max_overrides: int = 0,
    field: str = "score",
) -> DataFrame:
    """Debug table of base, score and final decision; ``override`` marks the rows that change.

    Without a maximum the guard is row-local.  With one, the n strongest rows come from a top-n
    and the guard compares with the weakest of them.
    """
    rows = versus_base(panel, base, field)
    passes = (
        (F.col("base_pred") != F.col("score_pred"))
        & (F.col("margin_vs_base") >= min_margin)
        & (F.col("top_gap") >= min_gap)
    )
    if max_overrides > 0:
        strength = F.struct(F.col("margin_vs_base"), F.col("top_gap"), (-F.col("id")).alias("id"))
        strongest = rows.where(passes).select(strength.alias("k")).orderBy(F.desc("k")).limit(max_overrides)
        passes = passes & (strength >= strongest.agg(F.min("k")).scalar())
    marked = rows.withColumn("override", F.coalesce(passes, F.lit(False)))
    final = F.when(F.col("override"), F.col("score_pred")).otherwise(F.col("base_pred"))
    return marked.withColumn("final_pred", final)


def candidate_sets(sources: DataFrame, base: DataFrame, counts: Sequence[int]) -> DataFrame:
    """Override rows of every source for every count, from one ranking per source.

    ``sources`` is ``source, id, cells``.  Only ranks up to the largest count are kept, which Spark
    applies on the map side, so the single ranked stretch of a source stays that short.
    """
    parts = sources.select("source", "id", "cells").join(base.select("id", F.col("pred_model").alias("base_pred")), "id")
    best = C.best(F.col("cells"), "score")
    rows = parts.select(
        "source",
        "id",
        "base_pred",
        best["model"].alias("score_pred"),
        (best["value"] - C.value_of(F.col("cells"), F.col("base_pred"), "score")).alias("margin_vs_base"),
        C.top_gap(F.col("cells"), "score", "zero-second").alias("top_gap"),
    ).where(F.col("base_pred") != F.col("score_pred"))
    order = W.partitionBy("source").orderBy(F.desc("margin_vs_base"), F.desc("top_gap"), F.asc("id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(counts))
    sized = ranked.withColumn("requested", F.explode(F.lit(list(counts))))
    return sized.where(F.col("rank") <= F.col("requested"))


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Overrides made and their transitions per source and requested count."""
    moves = candidates.groupBy("source", "requested", "base_pred", "score_pred").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_sort(F.collect_list(F.struct("base_pred", "score_pred", "n")))
    line = F.transform(text, lambda t: F.format_string("%s->%s:%d", t["base_pred"], t["score_pred"], t["n"]))
    return moves.groupBy("source", "requested").agg(
        F.sum("n").alias("actual"), F.array_join(line, "; ").alias("transitions")
    )


def apply_candidates(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decision tables ``source, requested, id, pred_model`` with the overrides put in."""
    sets = candidates.select("source", "requested").distinct()
    changes = candidates.select("source", "requested", "id", F.col("score_pred").alias("_new"))
    tables = sets.agg(F.collect_set(F.struct("source", "requested")).alias("s"))
    full = base.select("id", "pred_model", F.explode(tables.scalar()).alias("e")).select("id", "pred_model", "e.*")
    joined = full.join(changes, ["source", "requested", "id"], "left")
    return joined.select("source", "requested", "id", F.coalesce("_new", "pred_model").alias("pred_model"))


# --- choice of methods and candidate grid -------------------------------------------

# Method name parts, in the order taken when there is no validation board.
PRIORITY = ("word12_knn", "charwb35_knn", "char35_knn", "ridge")


def final_methods(methods: Sequence[str], limit: int, board: DataFrame | None = None) -> list[str]:
    """Methods for the final blend: best on the board first, then filled up in given order."""
    methods = list(methods)
    if board is None:
        ordered = [m for part in PRIORITY for m in methods if part in m]
        return list(dict.fromkeys(ordered))[:limit]
    ranked = board.where(F.col("method").isin(methods)).orderBy(F.desc("mean"), F.asc("method")).limit(limit)
    names = [r.method for r in ranked.select("method").collect()]
    for method in methods:
        if len(names) >= min(limit, len(methods)):
            break
        if method not in names:
            names.append(method)
    return names


def candidate_sizes(n: int) -> list[int]:
    return list(dict.fromkeys(min(size, n) for size in (1, 3, 5, n) if min(size, n) > 0))


def candidate_grid(
    blocks: DataFrame,
    methods: Sequence[str],
    base: DataFrame,
    base_weights: Sequence[float] = (0.15, 0.25, 0.35, 0.45),
    temperature: float = 0.08,
) -> DataFrame:
    """Decisions for every (number of methods, base weight) pair: ``top_n, base_weight, id, pred_model``.

    Averages of the first n methods come from one pass: a block joins every size that includes it.
    """
    if any(not 0.0 <= w < 1.0 for w in base_weights):
        raise ValueError("base weights must lie in [0, 1)")
    sizes = candidate_sizes(len(methods))
    place = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(methods))):
        place = F.when(F.col("method") == m, F.lit(i)).otherwise(place)
    chosen = blocks.withColumn("_place", place).where(F.col("_place").isNotNull())
    scaled = row_minmax(chosen.select("_place", "method", "id", "cells"))
    sized = scaled.withColumn("top_n", F.explode(F.lit(sizes))).where(F.col("_place") < F.col("top_n"))
    long = C.to_long(sized, "score", keep=("top_n", "id")).repartition("id")
    means = long.groupBy("id", "top_n", "model").agg(F.avg("score").alias("score"))
    averaged = C.from_long(means, "score", keys=("id", "top_n"))
    soft = row_softmax(averaged, "score", temperature, floor=1e-6)
    joined = soft.join(base.select("id", F.col("pred_model").alias("_base")), "id")
    weighted = joined.withColumn("base_weight", F.explode(F.lit([0.0, *[float(w) for w in base_weights]])))
    one_hot = lambda c: F.when(c["model"] == F.col("_base"), F.col("base_weight")).otherwise(0.0)
    mixed = lambda c: F.when(F.col("base_weight") == 0, c["score"]).otherwise(
        (F.lit(1.0) - F.col("base_weight")) * c["probability"] + one_hot(c)
    )
    return decide(C.add_field(weighted, "score", mixed), "score", ("top_n", "base_weight", "id", "_base"))


def grid_summary(grid: DataFrame) -> DataFrame:
    return grid.groupBy("top_n", "base_weight").agg(
        F.count_if(F.col("pred_model") != F.col("_base")).alias("changed_vs_base"), F.count(F.lit(1)).alias("n")
    )
