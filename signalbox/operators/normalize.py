"""Softmax and min-max normalisations of score cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C


def row_softmax(panel: DataFrame, field: str, temperature: float, out: str = "probability", floor: float = 0.0) -> DataFrame:
    """Softmax over a query's cells.

    A temperature that is not positive is an error unless ``floor`` gives the smallest
    temperature to use in its place.
    """
    if floor > 0:
        temperature = max(temperature, floor)
    if temperature <= 0:
        raise ValueError("temperature must be greater than zero")
    top = F.array_max(C.values(F.col("cells"), field))
    scaled = lambda c, s: F.exp((c[field] - s["top"]) / F.lit(float(temperature)))
    df = C.add_field_with(panel, out, {"top": top}, scaled)
    total = C.total(C.values(F.col("cells"), out))
    return C.add_field_with(df, out, {"total": total}, lambda c, s: c[out] / s["total"])


def row_minmax(panel: DataFrame, field: str = "score", out: str = "score", tiny: float = 1e-8) -> DataFrame:
    """Min-max over a query's cells; a flat row keeps a denominator of 1."""
    values = C.values(F.col("cells"), field)
    low, high = F.array_min(values), F.array_max(values)
    span = lambda s: F.when(s["high"] - s["low"] > tiny, s["high"] - s["low"]).otherwise(1.0)
    return C.add_field_with(
        panel, out, {"low": low, "high": high}, lambda c, s: (c[field] - s["low"]) / span(s)
    )


def model_minmax(
    panel: DataFrame, field: str = "score", out: str = "score", method: str = "minmax", tiny: float = 1e-12
) -> DataFrame:
    """Min-max per model over all queries, or nothing for ``none``."""
    if method == "none":
        return C.add_field(panel, out, lambda c: c[field])
    if method != "minmax":
        raise ValueError(f"unknown scale method: {method}")
    low, span = F.min(field), F.max(field) - F.min(field)
    stats = (
        C.to_long(panel, field)
        .groupBy("model")
        .agg(low.alias("low"), F.when(span > tiny, span).otherwise(1.0).alias("span"))
    )
    df = panel.withColumn("_s", C.model_map(stats, "low", "span"))
    scaled = lambda c: (c[field] - F.col("_s")[c["model"]]["low"]) / F.col("_s")[c["model"]]["span"]
    return C.add_field(df, out, scaled).drop("_s")
