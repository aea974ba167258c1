"""Column functions over ``cells``, the per-query array of per-model structs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def values(cells: Column, field: str) -> Column:
    return F.transform(cells, lambda c: c[field])


def best(cells: Column, field: str) -> Column:
    """``struct<value, order, model>`` of the largest value; the first model wins ties."""
    ranked = F.transform(
        cells,
        lambda c, i: F.struct(c[field].alias("value"), (-i).alias("order"), c["model"].alias("model")),
    )
    return F.array_max(ranked)


def value_of(cells: Column, model: Column, field: str) -> Column:
    """Value of one model's cell, null when the query has no such cell."""
    return F.get(F.filter(cells, lambda c: c["model"] == model), F.lit(0))[field]


def top_gap(cells: Column, field: str, on_single: str = "error") -> Column:
    """Best minus second best value of a query.

    ``on_single`` says what a query with one candidate gives: an error, or its
    best value minus zero.
    """
    ordered = F.sort_array(values(cells, field), asc=False)
    gap = F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))
    if on_single == "error":
        message = F.lit("top gap needs at least two candidate models")
        return F.when(F.size(cells) < 2, F.raise_error(message).cast("double")).otherwise(gap)
    if on_single == "zero-second":
        return F.when(F.size(cells) < 2, F.get(ordered, F.lit(0))).otherwise(gap)
    raise ValueError(f"unknown on_single: {on_single}")


def let(bindings: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate a struct of values once per row and hand it to ``fn``.

    A plain intermediate column used inside a lambda would be inlined there by the optimizer
    and evaluated again for every element.
    """
    return F.get(F.transform(F.array(bindings), fn), F.lit(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def add_field_with(
    df: DataFrame, name: str, bindings: dict[str, Column], fn: Callable[[Column, Column], Column]
) -> DataFrame:
    """Add a field that needs per-query values; ``fn`` gets the cell and the bound values."""
    bound = F.struct(F.col("cells").alias("cells"), *[v.alias(k) for k, v in bindings.items()])
    fill = lambda s: F.transform(s["cells"], lambda c: c.withField(name, fn(c, s)))
    return df.withColumn("cells", let(bound, fill))


def add_field(df: DataFrame, name: str, fn: Callable[[Column], Column], cells: str = "cells") -> DataFrame:
    """Add or replace one field of every cell."""
    return df.withColumn(cells, F.transform(cells, lambda c: c.withField(name, fn(c))))


def keep_fields(df: DataFrame, *fields: str, cells: str = "cells") -> DataFrame:
    return df.withColumn(
        cells, F.transform(cells, lambda c: F.struct(c["model"].alias("model"), *[c[f].alias(f) for f in fields]))
    )


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn(
        "cells", F.transform("cells", lambda c: c.withField(new, c[old]).dropFields(old))
    )


def to_long(df: DataFrame, *fields: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per cell: the key columns, ``model`` and the chosen fields.

    The outer explode keeps the optimizer from evaluating the cells a second time in a
    "not empty" filter; the null row of an empty array is dropped after it.
    """
    exploded = df.select(*keep, F.explode_outer("cells").alias("cell")).where(F.col("cell").isNotNull())
    return exploded.select(*keep, F.col("cell.model").alias("model"), *[F.col(f"cell.{f}").alias(f) for f in fields])


def from_long(df: DataFrame, *fields: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Gather long rows into cells; one shuffle on the keys, a group is one query's models."""
    cell = F.struct("model", *fields)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def model_map(table: DataFrame, *fields: str) -> Column:
    """Per-model parameters as one map, read through a scalar subquery.

    The table has one row per candidate model, so the map is as small as the list of
    candidates and every lookup stays inside the row, without a join.
    """
    entry = F.struct(F.col("model"), F.struct(*fields))
    return table.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def dense_values(cells: Column, field: str, models: Sequence[str]) -> list[Column]:
    """One column per model name; an absent cell is null."""
    return [value_of(cells, F.lit(m), field) for m in models]


def combine(cells_a: Column, cells_b: Column, fields_a: Sequence[str], fields_b: Sequence[str]) -> Column:
    """Join two cell arrays of the same query by model name, keeping the left models."""
    return F.transform(
        cells_a,
        lambda a: F.struct(
            a["model"].alias("model"),
            *[a[f].alias(f) for f in fields_a],
            *[value_of(cells_b, a["model"], f).alias(f) for f in fields_b],
        ),
    )
