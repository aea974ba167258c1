"""Exact quantiles of large columns without sorting them in one place.

Each round counts the values of a few intervals in equal-width bins and keeps only the bins
that hold a wanted rank.  A round is one scan with map-side aggregation and returns at most
``bins`` rows per interval, however many rows there are and however often a value repeats.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.session import durable

BINS = 2048


def _bin(x: Column, low: float, high: float) -> Column:
    width = F.lit(BINS) * ((x - F.lit(low)) / F.lit(high - low))
    return F.least(F.floor(width).cast("int"), F.lit(BINS - 1))


def _histograms(values: DataFrame, todo: list[tuple]) -> dict[int, list]:
    """Per interval (metric, low, high): its bins in order with count, smallest and largest value."""
    which, slot = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (metric, low, high) in enumerate(todo):
        inside = (F.col("m") == metric) & F.col("x").between(low, high)
        which = F.when(inside, F.lit(i)).otherwise(which)
        slot = F.when(inside, _bin(F.col("x"), low, high)).otherwise(slot)
    rows = (
        values.select(which.alias("i"), slot.alias("s"), "x")
        .where(F.col("i").isNotNull())
        .groupBy("i", "s")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        .collect()
    )
    out: dict[int, list] = {i: [] for i in range(len(todo))}
    for row in sorted(rows, key=lambda r: (r.i, r.s)):
        out[row.i].append(row)
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles with linear interpolation between neighbouring order statistics, per column.

    The columns are written out once; the rounds for all of them share their scans.
    """
    entry = lambda i, c: F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("x"))
    long = df.select(F.explode_outer(F.array(*[entry(i, c) for i, c in enumerate(columns)])).alias("e")).select("e.*")
    values = durable(long.where(F.col("x").isNotNull()))
    stats = values.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
    sizes = {r.m: r.n for r in stats}
    missing = [c for i, c in enumerate(columns) if i not in sizes]
    if missing:
        raise ValueError(f"quantiles of empty columns: {missing}")
    places = {m: [p * (n - 1) for p in probabilities] for m, n in sizes.items()}
    found: dict[tuple[int, int], float] = {}
    pending = [
        (r.m, r.a, r.b, 0, sorted({f(h) for h in places[r.m] for f in (math.floor, math.ceil)})) for r in stats
    ]
    while pending:
        found.update({(m, rank): a for m, a, b, _, ranks in pending if a == b for rank in ranks})
        todo = [p for p in pending if p[1] != p[2]]
        if not todo:
            break
        bins = _histograms(values, [(m, a, b) for m, a, b, _, _ in todo])
        pending = []
        for i, (m, _, _, before, ranks) in enumerate(todo):
            for row in bins[i]:
                inside = [r for r in ranks if before <= r < before + row.n]
                if inside:
                    pending.append((m, row.a, row.b, before, inside))
                before += row.n
    out = {}
    for m, name in enumerate(columns):
        between = lambda h: (found[m, math.floor(h)], found[m, math.ceil(h)], h - math.floor(h))
        out[name] = [low + (high - low) * part for low, high, part in map(between, places[m])]
    return out
