"""Training labels and row weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import clip
from signalbox.operators.normalize import row_softmax
from signalbox.operators.quantiles import exact_quantiles

# Quantile that scales the weights, and floor of the gap weight.
SCALE_QUANTILE = 0.9
GAP_FLOOR = 0.10
FLAT = 1e-12


def _scaled(panel: DataFrame, floor: float) -> DataFrame:
    scale = exact_quantiles(panel, ["_spread"], [SCALE_QUANTILE])["_spread"][0]
    if scale <= FLAT:
        return panel.withColumn("row_weight", F.lit(1.0)).drop("_spread")
    share = clip(F.col("_spread") / F.lit(scale), 0.0, 1.0)
    return panel.withColumn("row_weight", F.lit(floor) + F.lit(1.0 - floor) * share).drop("_spread")


def range_weights(panel: DataFrame, floor: float = 0.05) -> DataFrame:
    """Weight by the reward range of a query against its 0.9 quantile, with a floor."""
    if not 0.0 <= floor <= 1.0:
        raise ValueError("floor must lie in [0, 1]")
    rewards = C.values(F.col("cells"), "reward")
    return _scaled(panel.withColumn("_spread", F.array_max(rewards) - F.array_min(rewards)), floor)


def gap_weights(panel: DataFrame) -> DataFrame:
    """Weight by the clipped top-two gap against its 0.9 quantile: 0.10 + 0.90 * share."""
    gap = clip(C.top_gap(F.col("cells"), "reward"), 0.0, 1.0)
    return _scaled(panel.withColumn("_spread", gap), GAP_FLOOR)


def raw_gap_weights(panel: DataFrame) -> DataFrame:
    return panel.withColumn("row_weight", clip(C.top_gap(F.col("cells"), "reward"), 0.0, 1.0))


def soft_oracle_labels(panel: DataFrame, temperature: float = 0.05) -> DataFrame:
    """``id, cells<model, target, reward>, row_weight`` with softmax targets."""
    soft = row_softmax(gap_weights(panel), "reward", temperature, out="target")
    return C.keep_fields(soft, "target", "reward")


def performance_labels(panel: DataFrame, floor: float = 0.05) -> DataFrame:
    """``id, cells<model, target, reward>, row_weight`` with performances as targets."""
    labelled = C.add_field(range_weights(panel, floor), "target", lambda c: c["performance"])
    return C.keep_fields(labelled, "target", "reward")


def pack(labels: DataFrame) -> DataFrame:
    """One flat array per query: targets, then rewards, then the row weight."""
    packed = F.concat(
        C.values(F.col("cells"), "target"), C.values(F.col("cells"), "reward"), F.array("row_weight")
    )
    return labels.select("id", F.transform("cells", lambda c: c["model"]).alias("models"), packed.alias("packed"))


def unpack(packed: DataFrame) -> DataFrame:
    """The inverse of ``pack``."""
    n = F.size("models")
    cell = lambda m, i: F.struct(
        m.alias("model"),
        F.get(F.col("packed"), i).alias("target"),
        F.get(F.col("packed"), i + n).alias("reward"),
    )
    return packed.select(
        "id", F.transform("models", cell).alias("cells"), F.get(F.col("packed"), 2 * n).alias("row_weight")
    )
