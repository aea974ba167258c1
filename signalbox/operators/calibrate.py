"""Additive per-model biases by coordinate search.

For one coordinate a query switches to the model as soon as its bias passes a threshold that
depends on the row alone.  So one scan that counts rewards by the first grid value past the
threshold gives the reward of every grid value at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.session import durable


@dataclass(frozen=True)
class BiasSearch:
    models: list[str]
    searched: list[float]
    shrunk: list[float]
    reward_initial: float
    reward_searched: float
    reward_shrunk: float

    def table(self, spark) -> DataFrame:
        rows = [(m, float(b), float(s)) for m, b, s in zip(self.models, self.shrunk, self.searched)]
        return spark.createDataFrame(rows, "model STRING, bias DOUBLE, searched_bias DOUBLE")


def _compact(panel: DataFrame, models: Sequence[str]) -> DataFrame:
    """Scores and rewards in model order; a missing cell never wins."""
    cells = F.col("cells")
    low = F.lit(float("-inf"))
    return panel.select(
        F.array(*[F.coalesce(v, low) for v in C.dense_values(cells, "score", models)]).alias("s"),
        F.array(*[F.coalesce(v, F.lit(0.0)) for v in C.dense_values(cells, "reward", models)]).alias("r"),
    )


def _biased(biases: Sequence[float]):
    return F.zip_with("s", F.lit([float(b) for b in biases]), lambda a, b: a + b)


def _reward(rows: DataFrame, biases: Sequence[float]) -> float:
    picked = rows.withColumn("_b", _biased(biases))
    place = F.array_position("_b", F.array_max("_b"))
    return picked.agg(F.avg(F.element_at("r", place.cast("int")))).first()[0]


def _grid_rewards(rows: DataFrame, biases: Sequence[float], j: int, grid: Sequence[float]) -> list[float]:
    """Mean reward for every grid value of model j's bias, from one scan.

    The rivals' best is the first of the largest, as the argmax takes it; model j also wins a tie
    against a later model.
    """
    others = [float(b) if i != j else float("-inf") for i, b in enumerate(biases)]
    df = rows.withColumn("_o", _biased(others))
    df = df.withColumn("_best", F.array_max("_o")).withColumn("_at", F.array_position("_o", F.col("_best")) - 1)
    mine = F.get(F.col("s"), F.lit(j))
    wins = lambda g: (mine + g > F.col("_best")) | ((mine + g == F.col("_best")) & (F.col("_at") > j))
    first = F.size(F.filter(F.lit([float(g) for g in grid]), lambda g: ~wins(g)))
    slots = (
        df.select(
            first.alias("first"),
            F.get(F.col("r"), F.lit(j)).alias("mine"),
            F.get(F.col("r"), F.col("_at").cast("int")).alias("other"),
        )
        .groupBy("first")
        .agg(F.sum("mine").alias("mine"), F.sum("other").alias("other"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    gained, kept = np.zeros(len(grid) + 1), np.zeros(len(grid) + 1)
    n = 0
    for row in slots:
        gained[row["first"]] += row["mine"]
        kept[row["first"]] += row["other"]
        n += row["n"]
    switched = np.cumsum(gained)[:-1]
    rest = kept.sum() - np.cumsum(kept)[:-1]
    return [float(v) for v in (switched + rest) / n]


@dataclass(frozen=True)
class Stage:
    """Candidate values of one bias: a grid of its own, or offsets around the present value."""

    grid: tuple[float, ...]
    passes: int
    around: bool

    def candidates(self, present: float) -> list[float]:
        return [present + g for g in self.grid] if self.around else list(self.grid)


def _grid(radius: float, count: int, step: float) -> tuple[float, ...]:
    return tuple(round(-radius + i * step, 12) for i in range(count))


def half_open_grid(radius: float, step: float) -> tuple[float, ...]:
    """-radius, -radius + step, ...; the last value is less than half a step beyond the radius."""
    return _grid(radius, int(round(2 * radius / step)) + 1, step)


def inner_grid(radius: float, step: float) -> tuple[float, ...]:
    """-radius, -radius + step, ... as far as the radius goes."""
    return _grid(radius, int(math.floor(2 * radius / step + 1e-9)) + 1, step)


def _preferred(rewards: Sequence[float], tolerance: float) -> int:
    """The first candidate whose reward is the largest, up to the tolerance."""
    top = max(rewards)
    return next(i for i, r in enumerate(rewards) if r >= top - tolerance)


def _search(panel: DataFrame, models: Sequence[str], stages: Sequence[Stage], shrink: float, least_gain: float) -> BiasSearch:
    """Go through the stages; a stage's passes visit every bias and end with a pass that moves none."""
    if not 0.0 <= shrink <= 1.0:
        raise ValueError("shrink must lie in [0, 1]")
    rows = durable(_compact(panel, models))
    biases = [0.0] * len(models)
    initial = reached = _reward(rows, biases)

    def moves(j: int, stage: Stage) -> bool:
        nonlocal reached
        values = stage.candidates(biases[j])
        rewards = _grid_rewards(rows, biases, j, values)
        best = _preferred(rewards, least_gain)
        if rewards[best] <= reached + least_gain or values[best] == biases[j]:
            return False
        biases[j], reached = values[best], rewards[best]
        return True

    for stage in stages:
        for _ in range(stage.passes):
            if not sum([moves(j, stage) for j in range(len(models))]):
                break
    shrunk = [b * shrink for b in biases]
    return BiasSearch(list(models), biases, shrunk, initial, reached, _reward(rows, shrunk))


def fit_biases(
    panel: DataFrame,
    models: Sequence[str],
    max_bias: float = 0.05,
    step: float = 0.002,
    passes: int = 3,
    shrink: float = 0.5,
) -> BiasSearch:
    """Search every bias on a fixed grid in turn; stop when a pass changes nothing; then shrink."""
    if max_bias < 0 or step <= 0 or passes <= 0:
        raise ValueError("needs max_bias >= 0, step > 0 and passes > 0")
    return _search(panel, models, [Stage(half_open_grid(max_bias, step), passes, False)], shrink, 1e-12)


# Fixed values: (step, radius, passes) of the coarse stages; the last stage has a step of its own.
COARSE_STAGES = ((0.10, 1.5, 3), (0.05, 0.5, 3))
FINE_RADIUS, FINE_PASSES = 0.2, 2


def fit_biases_coarse_to_fine(
    panel: DataFrame, models: Sequence[str], step: float = 0.02, shrink: float = 0.7, enable: bool = False
) -> BiasSearch | None:
    """Search offsets around the current bias, first widely and then finely; off unless enabled."""
    if not enable:
        return None
    widths = (*COARSE_STAGES, (step, FINE_RADIUS, FINE_PASSES))
    stages = [Stage(inner_grid(radius, width), passes, True) for width, radius, passes in widths]
    return _search(panel, models, stages, shrink, 0.0)


def apply_biases(panel: DataFrame, biases: DataFrame, strict: bool = True) -> DataFrame:
    """score + bias; a model without a bias is an error when ``strict``."""
    out = panel.withColumn("_b", C.model_map(biases, "bias"))

    def shifted(c):
        bias = F.col("_b")[c["model"]]["bias"]
        if strict:
            message = F.concat(F.lit("calibration is missing model "), c["model"])
            bias = F.when(bias.isNull(), F.raise_error(message).cast("double")).otherwise(bias)
        return c["score"] + F.coalesce(bias, F.lit(0.0))

    return C.add_field(out, "score", shifted).drop("_b")
