"""Shared folders, stored tables and balanced id ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.session import collect_garbage, drop_folder, ensure_checkpoint_dir, filesystem, shared_folder

SAMPLE = 20_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage as a checkpoint does, but in compressed columns.  The files lie
    in one folder per application; ``release`` removes it.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    collect_garbage(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove everything that ``stored`` and the file writers left for this application."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    drop_folder(spark, f"{base}/{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(ids: DataFrame, buckets: int) -> list:
    """Starts of about ``buckets`` ranges of ids with about equally many rows.

    ``ids`` has one column of longs or strings.  The bounds are quantiles of ids taken by their
    hash, so they are existing ids and the same on every run.  About 20,000 ids come to the driver
    at any input size; the smallest id is no bound.
    """
    name = ids.columns[0]
    counted = ids.where(F.col(name).isNotNull())
    total = counted.agg(F.count(F.lit(1)), F.min(name)).first()
    if not total[0]:
        return []
    every = max(1, total[0] // SAMPLE)
    # groups of equal ids are one entry with a weight
    rows = counted.where(F.pmod(F.xxhash64(name), F.lit(every)) == 0).groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return []
    rows.sort()
    weights = np.cumsum([r[1] for r in rows])
    at = np.searchsorted(weights, np.arange(1, buckets) * weights[-1] / buckets)
    return [x for x in sorted({rows[i][0] for i in at}) if x > total[1]]


def literals(values: list) -> Column:
    """An array of longs or strings."""
    kind = "string" if values and isinstance(values[0], str) else "long"
    return F.array(*[F.lit(x).cast(kind) for x in values]).cast(f"array<{kind}>")


def id_bucket(value: Column, bounds: list) -> Column:
    """Number of bounds that are not above ``value``: the range it lies in; null ids lie in the first.

    Two steps of about the square root of the number of bounds each.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(literals([g[0] for g in groups]), lambda b: b <= value))
    group = F.get(F.array(*[literals(g) for g in groups]), coarse - 1)
    inside = F.size(F.filter(group, lambda b: b <= value))
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + inside).cast("int")


def with_next(rows: DataFrame, key: str, columns: list[str], wrap: bool, before: list[str] = (), keys: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Add ``next_<column>``: the values of the next row by ascending key; with ``wrap`` the first row's after the last.

    Rows are dealt by ranges of keys whose starts are existing keys; the rows at a start go to the
    range before it too, so every range sees its successor.  Equal keys are ordered by ``columns``.
    Rows without a key have no next row and get nulls; they are spread by hash.  ``before`` names
    columns of which ``last_<column>`` is added: those of the row before; the rows at a range's end
    go to the range after it for that.  ``keys`` has the same keys where they can be read at less cost.
    ``groups`` has a column of ``columns``, the least and greatest key of its value, and a value column:
    rows of the group get it; it is dealt to every range between the keys.
    """
    counted = rows.select(key) if keys is None else keys.select(key)
    count, least = counted.agg(F.count(key), F.min(key)).first()
    bounds = id_bounds(counted, max(min(8 * partitions(rows.sparkSession), count // 100), -(-count // 5_000)))
    value = F.col(key)
    bucket = id_bucket(value, bounds)
    stray = -1 - F.pmod(F.xxhash64(*columns), F.lit(256)).cast("int")
    place = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    places = F.when(value.isNull(), F.array(place(stray, 0)))
    if wrap:
        places = places.when(value == F.lit(least), F.array(place(F.lit(0), 0), place(F.lit(len(bounds)), 1)))
    at_start = F.get(literals(bounds), bucket - 1) == value if bounds else F.lit(False)
    at_end = F.lit(False)
    if before and bounds:
        # every range starts with an existing key, so each has an end
        ends = dict(counted.where(value.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.max(key)).collect())
        at_end = F.coalesce(F.get(literals([ends[i] for i in range(len(bounds))]), bucket) == value, F.lit(False))
    ghosts = [F.when(at_start, place(bucket - 1, 1)), F.when(at_end, place(bucket + 1, -1))]
    places = places.otherwise(F.array_compact(F.array(place(bucket, 0), *ghosts)))
    order = Window.partitionBy("bucket").orderBy("ghost", key, *columns)
    dealt = rows.select("*", F.explode(places).alias("place")).select(*rows.columns, "place.*")
    near = [F.lead(c).over(order).alias(f"next_{c}") for c in columns] + [F.lag(c).over(order).alias(f"last_{c}") for c in before]
    if groups is not None:
        group, low, high, given = groups.columns
        ranges = F.sequence(id_bucket(F.col(low), bounds), id_bucket(F.col(high), bounds))
        dealt = dealt.unionByName(groups.select(group, F.col(given).alias("given"), F.lit(-2).alias("ghost"), F.explode(ranges).alias("bucket")), allowMissingColumns=True)
        near.append(F.max("given").over(Window.partitionBy("bucket", group)).alias(given))
    out = dealt.select("*", *near).where("ghost = 0")
    keyed = [F.when(value.isNotNull(), F.col(c)).alias(c) for c in out.columns if c.startswith(("next_", "last_"))]
    return out.select(*rows.columns, *keyed, *([] if groups is None else [given]))
