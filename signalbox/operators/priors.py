"""Smoothed reward priors per task, hierarchical priors and family priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import clip, is_id_only
from signalbox.functions.tasks import TASK_NAMES

LEVELS = {"profile": "task_profile", "subtask": "task_subtask_key", "domain": "task_domain"}


def global_prior(panel: DataFrame, field: str = "reward") -> DataFrame:
    """``model, prior``: the mean over all queries."""
    return C.to_long(panel, field).groupBy("model").agg(F.avg(field).alias("prior"))


def task_priors(panel: DataFrame, smoothing: float = 20.0, field: str = "reward", tasks=TASK_NAMES) -> DataFrame:
    """``task, model, n, prior`` with ``(sum + s * global) / (n + s)``; an empty task gets the global mean.

    One scan: sums per (task, model) are small, and the global mean is derived from them.
    """
    sums = (
        C.to_long(panel, field, keep=("task",))
        .groupBy("task", "model")
        .agg(F.sum(field).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    overall = sums.groupBy("model").agg((F.sum("s") / F.sum("n")).alias("global_prior"))
    grid = overall.select("model", "global_prior", F.explode(F.lit(list(tasks))).alias("task"))
    joined = grid.join(sums, ["task", "model"], "left")
    n = F.coalesce("n", F.lit(0))
    smooth = (F.col("s") + F.lit(smoothing) * F.col("global_prior")) / (n + F.lit(smoothing))
    prior = F.when(n > 0, smooth).otherwise(F.col("global_prior"))
    return joined.select("task", "model", n.alias("n"), prior.alias("prior"), "global_prior")


def task_prior_cells(priors: DataFrame) -> DataFrame:
    """One row per task with ``prior_cells``; as many rows as there are task labels."""
    return priors.groupBy("task").agg(
        F.array_sort(F.collect_list(F.struct("model", F.col("prior").alias("score")))).alias("prior_cells")
    )


def global_cells(prior: DataFrame) -> Column:
    entry = F.struct("model", F.col("prior").alias("score"))
    return prior.agg(F.array_sort(F.collect_list(entry)).alias("c")).scalar()


def lookup_task_priors(queries: DataFrame, priors: DataFrame, fallback: DataFrame) -> DataFrame:
    """Attach ``cells<model, score>`` of a query's task, or of all tasks when unknown.

    The prior side has one row per task label of a fixed list, so it is broadcast.
    """
    joined = queries.join(F.broadcast(task_prior_cells(priors)), "task", "left")
    return joined.withColumn("cells", F.coalesce("prior_cells", global_cells(fallback))).drop("prior_cells")


# --- hierarchical priors ----------------------------------------------------

def hierarchical_priors(panel: DataFrame, smoothing: float = 50.0, field: str = "reward") -> DataFrame:
    """``level, key, model, n, prior`` for profile, subtask, domain and global.

    The data is aggregated once at the finest level; the coarser levels are grouping sets of
    that small result.
    """
    keys = list(LEVELS.values())
    finest = (
        C.to_long(panel, field, keep=keys)
        .groupBy(*keys, "model")
        .agg(F.sum(field).alias("s"), F.count(F.lit(1)).alias("c"))
    )
    sets = [[F.col(k), F.col("model")] for k in keys] + [[F.col("model")]]
    level = F.grouping_id(*[F.col(k) for k in keys], F.col("model"))
    rolled = finest.groupingSets(sets, *[F.col(k) for k in keys], F.col("model")).agg(
        F.sum("s").alias("s"), F.sum("c").alias("n"), level.alias("gid")
    )
    name = F.when(F.col("gid") == 14, "global")
    key = F.when(F.col("gid") == 14, "__global__")
    for bits, (lvl, column) in zip((6, 10, 12), LEVELS.items()):
        name = name.when(F.col("gid") == bits, lvl)
        key = key.when(F.col("gid") == bits, F.col(column))
    table = rolled.select(name.alias("level"), key.alias("key"), "model", "s", "n")
    overall = table.where("level = 'global'").select("model", (F.col("s") / F.col("n")).alias("g"))
    smooth = (F.col("s") + F.lit(smoothing) * F.col("g")) / (F.col("n") + F.lit(smoothing))
    prior = F.when(F.col("level") == "global", F.col("g")).otherwise(smooth)
    return table.join(F.broadcast(overall), "model").select("level", "key", "model", "n", prior.alias("prior"))


def backoff_priors(queries: DataFrame, priors: DataFrame, min_count: int = 20) -> DataFrame:
    """Attach the first level with enough rows: profile, subtask, domain, else global.

    The levels have at most 36, 12, 11 and 1 keys by construction of the profile.
    """
    cells = priors.groupBy("level", "key").agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("model", F.col("prior").alias("score")))).alias("p"),
    )
    out = queries
    for level, column in LEVELS.items():
        usable = cells.where((F.col("level") == level) & (F.col("n") >= min_count))
        side = usable.select(F.col("key").alias(column), F.col("p").alias(f"_{level}"))
        out = out.join(F.broadcast(side), column, "left")
    root = cells.where("level = 'global'").select("p").scalar()
    used = F.lit("global")
    for level in reversed(LEVELS):
        used = F.when(F.col(f"_{level}").isNotNull(), F.lit(level)).otherwise(used)
    chosen = F.coalesce(*[F.col(f"_{level}") for level in LEVELS], root)
    return out.withColumns({"prior_cells": chosen, "prior_level": used}).drop(*[f"_{level}" for level in LEVELS])


def blend_with_prior(
    panel: DataFrame, weight: float = 0.15, domain_weights: dict[str, float] | None = None, field: str = "score"
) -> DataFrame:
    """Blend ``cells.score`` with ``prior_cells.score``; some domains have a weight of their own."""
    w = F.lit(float(weight))
    for domain, value in (domain_weights or {}).items():
        w = F.when(F.col("task_domain") == domain, F.lit(float(value))).otherwise(w)
    out = panel.withColumn("_w", clip(w, 0.0, 1.0))
    prior = lambda c: C.value_of(F.col("prior_cells"), c["model"], "score")
    mixed = lambda c: (F.lit(1.0) - F.col("_w")) * c[field] + F.col("_w") * prior(c)
    return C.add_field(out, field, mixed).drop("_w")


# --- family prior and fixed cost --------------------------------------------

def family_counts(labelled: DataFrame, text: str = "query", pattern: str | None = None) -> DataFrame:
    """``label, n`` inside the family of id-only queries."""
    member = is_id_only(F.col(text)) if pattern is None else is_id_only(F.col(text), pattern)
    return labelled.where(member).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def family_prior(counts: DataFrame) -> DataFrame:
    """One row: family size and majority label; of equal counts the last label by name."""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("family_size"),
        F.max(F.struct("n", "label"))["label"].alias("majority_label"),
    )


def fixed_model_cost(panel: DataFrame, field: str = "norm_cost") -> DataFrame:
    return C.to_long(panel, field).groupBy("model").agg(F.avg(field).alias("fixed_cost"))


def fixed_cost_scores(
    panel: DataFrame, fixed: DataFrame, alpha: float = 0.85, clip_predictions: bool = True
) -> DataFrame:
    """Add ``score`` from predicted performance and a model's mean training cost."""
    out = panel.withColumn("_f", C.model_map(fixed, "fixed_cost"))

    def score(c: Column) -> Column:
        perf, cost = c["performance"], F.col("_f")[c["model"]]["fixed_cost"]
        if clip_predictions:
            perf, cost = clip(perf, 0.0, 1.0), clip(cost, 0.0, None)
        return F.lit(alpha) * perf - F.lit(1.0 - alpha) * cost

    return C.add_field(out, "score", score).drop("_f")


def fill_from_train_mean(queries: DataFrame, scored: DataFrame, mean: DataFrame) -> DataFrame:
    """Scored cells where there are any, the training mean for the other queries."""
    joined = queries.join(scored.select("id", "cells"), "id", "left")
    source = F.when(F.col("cells").isNotNull(), "scorer").otherwise("train_mean")
    return joined.withColumn("router_source", source).withColumn("cells", F.coalesce("cells", global_cells(mean)))
