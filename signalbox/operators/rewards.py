"""Reward of a (query, model) cell, and the cost normalisations behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import clip, implied_cost, positive_or_one

ALPHA = 0.85
GLOBAL_METHODS = ("global-max", "mean-row-max")
COST_NORMS = (
    "global-max", "mean-row-max", "row-max", "none", "minmax-global", "minmax-per-model", "zscore-global",
)


def guard_denominator(value: Column, guard: str) -> Column:
    """``one``: a denominator that is not positive counts as 1; ``eps``: it is at least 1e-12."""
    if guard == "one":
        return positive_or_one(value)
    if guard == "eps":
        return F.greatest(value, F.lit(1e-12))
    raise ValueError(f"unknown zero guard: {guard}")


def denominator_table(panel: DataFrame, method: str, guard: str = "one") -> DataFrame:
    """One row ``denominator``: the mean of the per-query maximum cost, or the largest cost.

    The per-query maximum is row-local, so one partial and one final average do it.
    """
    highest = F.array_max(C.values(F.col("cells"), "cost"))
    if method == "mean-row-max":
        value = F.avg(highest)
    elif method == "global-max":
        value = F.max(highest)
    else:
        raise ValueError(f"unknown cost denominator: {method}")
    return panel.agg(guard_denominator(value, guard).alias("denominator"))


def denominator(panel: DataFrame, method: str, guard: str = "one") -> Column:
    """The denominator as a scalar subquery, usable in any projection."""
    return denominator_table(panel, method, guard).scalar()


def normalize_cost(panel: DataFrame, method: str = "global-max", guard: str = "one", fit: DataFrame | None = None) -> DataFrame:
    """Add ``norm_cost`` to every cell.

    ``fit`` is the panel the constants come from; by default the panel itself.
    """
    fit = panel if fit is None else fit
    if method == "none":
        return C.add_field(panel, "norm_cost", lambda c: c["cost"])
    if method == "row-max":
        highest = F.array_max(C.values(F.col("cells"), "cost"))
        share = lambda c, s: c["cost"] / F.when(s["highest"] == 0, 1.0).otherwise(s["highest"])
        return C.add_field_with(panel, "norm_cost", {"highest": highest}, share)
    if method in GLOBAL_METHODS:
        out = panel.withColumn("_d", denominator(fit, method, guard))
        return C.add_field(out, "norm_cost", lambda c: c["cost"] / F.col("_d")).drop("_d")
    if method == "minmax-global":
        costs = C.values(F.col("cells"), "cost")
        low, high = F.min(F.array_min(costs)), F.max(F.array_max(costs))
        span = F.when(high == low, 1.0).otherwise(high - low)
        out = panel.withColumn("_s", fit.agg(F.struct(low.alias("low"), span.alias("span")).alias("s")).scalar())
        return C.add_field(out, "norm_cost", lambda c: (c["cost"] - F.col("_s.low")) / F.col("_s.span")).drop("_s")
    if method == "minmax-per-model":
        low, high = F.min("cost"), F.max("cost")
        span = F.when(high == low, 1.0).otherwise(high - low)
        stats = C.to_long(fit, "cost").groupBy("model").agg(low.alias("low"), span.alias("span"))
        out = panel.withColumn("_s", C.model_map(stats, "low", "span"))
        scaled = lambda c: (c["cost"] - F.col("_s")[c["model"]]["low"]) / F.col("_s")[c["model"]]["span"]
        return C.add_field(out, "norm_cost", scaled).drop("_s")
    if method == "zscore-global":
        spread = F.stddev_samp("cost")
        stats = C.to_long(fit, "cost").agg(
            F.struct(
                F.avg("cost").alias("mean"),
                F.when(F.coalesce(spread, F.lit(0.0)) == 0, 1.0).otherwise(spread).alias("std"),
            ).alias("s")
        )
        out = panel.withColumn("_s", stats.scalar())
        return C.add_field(out, "norm_cost", lambda c: (c["cost"] - F.col("_s.mean")) / F.col("_s.std")).drop("_s")
    raise ValueError(f"unknown cost_norm: {method}; one of {COST_NORMS}")


def add_reward(
    panel: DataFrame,
    cost_norm: str = "global-max",
    alpha: float = ALPHA,
    guard: str = "one",
    fit: DataFrame | None = None,
) -> DataFrame:
    """Add ``norm_cost`` and ``reward = alpha * performance - (1 - alpha) * norm_cost``."""
    out = normalize_cost(panel, cost_norm, guard, fit)
    reward = lambda c: F.lit(alpha) * c["performance"] - F.lit(1.0 - alpha) * c["norm_cost"]
    return C.add_field(out, "reward", reward)


def fit_cost_scaler(panel: DataFrame) -> DataFrame:
    """``model, cost_mean, cost_std`` with the population deviation; a flat model gets 1."""
    spread = F.stddev_pop("cost")
    return (
        C.to_long(panel, "cost")
        .groupBy("model")
        .agg(
            F.avg("cost").alias("cost_mean"),
            F.when(spread < 1e-8, 1.0).otherwise(spread).alias("cost_std"),
        )
    )


def standardize_cost(panel: DataFrame, scaler: DataFrame) -> DataFrame:
    """Add ``z_cost`` to every cell."""
    out = panel.withColumn("_s", C.model_map(scaler, "cost_mean", "cost_std"))
    z = lambda c: (c["cost"] - F.col("_s")[c["model"]]["cost_mean"]) / F.col("_s")[c["model"]]["cost_std"]
    return C.add_field(out, "z_cost", z).drop("_s")


def restore_cost(panel: DataFrame, scaler: DataFrame) -> DataFrame:
    """Add ``pred_cost``: the standardised cost undone, never below zero."""
    out = panel.withColumn("_s", C.model_map(scaler, "cost_mean", "cost_std"))
    params = lambda c: F.col("_s")[c["model"]]
    undone = lambda c: F.greatest(F.lit(0.0), params(c)["cost_mean"] + params(c)["cost_std"] * c["z_cost"])
    return C.add_field(out, "pred_cost", undone).drop("_s")


def plug_in_scores(
    panel: DataFrame, scaler: DataFrame, cost_denominator: Column, cost_weight: float = 1 - ALPHA
) -> DataFrame:
    """Add ``pred_cost`` and ``score`` from predicted performance and standardised cost."""
    if not 0.0 <= cost_weight <= 1.0:
        raise ValueError("cost_weight must lie in [0, 1]")
    out = restore_cost(panel, scaler).withColumn("_d", F.greatest(cost_denominator, F.lit(1e-12)))
    score = lambda c: F.lit(1.0 - cost_weight) * c["performance"] - F.lit(cost_weight) * (c["pred_cost"] / F.col("_d"))
    return C.add_field(out, "score", score).drop("_d")


def router_scores(
    panel: DataFrame,
    performance: str = "performance",
    cost: str = "norm_cost",
    alpha: float = ALPHA,
    clip_predictions: bool = True,
) -> DataFrame:
    """Add ``score`` from predicted performance and normalised cost, clipped on request."""
    def score(c: Column) -> Column:
        perf, price = c[performance], c[cost]
        if clip_predictions:
            perf, price = clip(perf, 0.0, 1.0), clip(price, 0.0, None)
        return F.lit(alpha) * perf - F.lit(1.0 - alpha) * price

    return C.add_field(panel, "score", score)


def equivalent_cost_weight(old: float | Column, new: float | Column, alpha: float = ALPHA):
    """Cost weight that re-scores under denominator ``old`` as if it had been ``new``."""
    ratio = (1.0 - alpha) / alpha * (old / new)
    return ratio / (1.0 + ratio)


def rescore(panel: DataFrame, cost: str, old: Column, new: Column, alpha: float = ALPHA) -> DataFrame:
    """Re-score stored predictions for another denominator, through the equivalent weight."""
    out = panel.withColumn("_w", equivalent_cost_weight(old, new, alpha)).withColumn("_d", old)
    score = lambda c: (F.lit(1.0) - F.col("_w")) * c["performance"] - F.col("_w") * (c[cost] / F.col("_d"))
    return C.add_field(out, "score", score).drop("_w", "_d")


def add_implied_cost(panel: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return C.add_field(panel, "implied_cost", lambda c: implied_cost(c["performance"], c["reward"], alpha))
