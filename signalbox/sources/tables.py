"""Sources and sinks: labelled and unlabelled frames, score tables, decisions, parameters."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions import cells as C

PERFORMANCE = "_performance"
COST = "_cost"
# Text columns looked for, in order of preference.
TEXT_COLUMNS = ("query", "prompt", "Question", "question", "text")
SCORE_SUFFIXES = ("", "_reward", "_score")


# --- frames -----------------------------------------------------------------

def read_frame(
    spark: SparkSession, path: str, schema: str | None = None, limit: int = 0, id_column: str = "ID"
) -> DataFrame:
    """Read a CSV or parquet frame.

    ``limit`` keeps the rows with the smallest ids, which makes the head the same on every run.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.orderBy(id_column).limit(limit) if limit > 0 else df


def frame_schema(models: Sequence[str], text: str = "query") -> str:
    """Schema of the labelled frame, so that a CSV read needs no inference pass."""
    numeric = [f"{m}{PERFORMANCE} DOUBLE, {m}{COST} DOUBLE" for m in models]
    return ", ".join(["ID BIGINT", f"{text} STRING", *numeric])


def model_names(columns: Sequence[str]) -> list[str]:
    """Models that have both a performance and a cost column, sorted by name."""
    present = set(columns)
    found = [
        c.removesuffix(PERFORMANCE)
        for c in columns
        if c.startswith("Model_") and c.endswith(PERFORMANCE) and c.removesuffix(PERFORMANCE) + COST in present
    ]
    if not found:
        raise ValueError("no Model_*_performance column with a matching Model_*_cost column")
    return sorted(found)


def text_column(columns: Sequence[str], requested: str = "") -> str:
    if requested:
        if requested not in columns:
            raise ValueError(f"text column {requested!r} is absent")
        return requested
    for name in TEXT_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no text column; looked for {', '.join(TEXT_COLUMNS)}")


def wide_to_panel(df: DataFrame, text: str = "", id_column: str = "ID") -> DataFrame:
    """Wide labelled frame to a panel ``id, query, cells<model, performance, cost>``.

    A projection: no join and no shuffle.  Cells with a null performance or cost drop out.
    """
    names = model_names(df.columns)
    query = text_column(df.columns, text)
    cell = lambda m: F.struct(
        F.lit(m).alias("model"),
        F.col(m + PERFORMANCE).cast("double").alias("performance"),
        F.col(m + COST).cast("double").alias("cost"),
    )
    every = F.array(*[cell(m) for m in names])
    complete = F.filter(every, lambda c: c["performance"].isNotNull() & c["cost"].isNotNull())
    return df.select(
        F.col(id_column).cast("long").alias("id"), F.col(query).cast("string").alias("query"), complete.alias("cells")
    )


def dropped_cells(df: DataFrame) -> DataFrame:
    """How many (query, model) cells a frame lacks, per model."""
    names = model_names(df.columns)
    missing = [
        F.count_if(F.col(m + PERFORMANCE).isNull() | F.col(m + COST).isNull()).alias(m) for m in names
    ]
    counted = df.agg(*missing)
    return counted.unpivot([], names, "model", "dropped")


def queries_only(df: DataFrame, text: str = "", id_column: str = "ID") -> DataFrame:
    query = text_column(df.columns, text)
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(query).cast("string").alias("query"))


# --- decisions --------------------------------------------------------------

def decision_frame(decisions: DataFrame) -> DataFrame:
    """``ID, pred_model`` as the outside world expects it."""
    if "id" not in [c.lower() for c in decisions.columns]:
        raise ValueError("a decision table needs an id column")
    return decisions.select(F.col("id").cast("long").alias("ID"), F.col("pred_model"))


def write_decisions(decisions: DataFrame, path: str, single_file: bool = False) -> None:
    """Write decisions as CSV ordered by id: range-partitioned files unless one is asked for."""
    frame = decision_frame(decisions).orderBy("ID")
    if single_file:
        frame = frame.coalesce(1)
    frame.write.mode("overwrite").option("header", True).csv(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    if df.columns != ["ID", "pred_model"]:
        raise ValueError(f"decision columns must be exactly ID, pred_model; got {df.columns}")
    return df.select(F.col("ID").cast("long").alias("id"), "pred_model")


# --- scores -----------------------------------------------------------------

def write_scores(scores: DataFrame, path: str) -> None:
    """Score tables as parquet, one folder per method."""
    scores.write.mode("overwrite").partitionBy("method").parquet(path)


def read_scores(spark: SparkSession, path: str, models: Sequence[str], method: str | None = None) -> DataFrame:
    """Long score rows ``id, model, score`` from parquet, or from a wide CSV."""
    if os.fspath(path).endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        return C.to_long(wide_scores_to_cells(df, models), "score")
    df = spark.read.parquet(path)
    if method is not None:
        df = df.where(F.col("method") == method)
    if "score" not in df.columns and "reward" in df.columns:
        df = df.withColumnRenamed("reward", "score")
    if "score" not in df.columns:
        raise ValueError(f"{path} has neither a score nor a reward column")
    keys = [c for c in ("method", "id", "model") if c in df.columns]
    return df.select(*keys, F.col("score").cast("double").alias("score"))


def score_columns(columns: Sequence[str], models: Sequence[str]) -> list[str]:
    """Columns that hold the scores: plain names, then ``_reward``, then ``_score``."""
    for suffix in SCORE_SUFFIXES:
        names = [m + suffix for m in models]
        if all(n in columns for n in names):
            return names
    raise ValueError("no complete set of model score columns")


def wide_scores_to_cells(df: DataFrame, models: Sequence[str], id_column: str = "ID") -> DataFrame:
    ordered = sorted(models)
    names = score_columns(df.columns, ordered)
    cell = lambda m, n: F.struct(F.lit(m).alias("model"), F.col(n).cast("double").alias("score"))
    return df.select(
        F.col(id_column).cast("long").alias("id"),
        F.array(*[cell(m, n) for m, n in zip(ordered, names)]).alias("cells"),
    )


def wide_export(panel: DataFrame, models: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One column per model and field; ``fields`` maps a cell field to its column suffix.

    The model list is given, so this is a projection and not a pivot.
    """
    columns = [
        C.value_of(F.col("cells"), F.lit(m), field).alias(m + suffix)
        for m in models
        for field, suffix in fields.items()
    ]
    return panel.select("id", *columns)


# --- router parameters ------------------------------------------------------

# What a parameter record without the newer entries means.
PARAMETER_DEFAULTS = {
    "score_bias": 0.0,
    "cost_weight": 0.15,
    "row_weight_floor": 0.05,
    "ranking_loss_weight": 1.0,
    "ranking_temperature": 0.05,
    "ranking_min_gap": 1e-4,
}
PARAMETER_SCHEMA = "model STRING, cost_mean DOUBLE, cost_std DOUBLE, " + ", ".join(
    f"{name} DOUBLE" for name in PARAMETER_DEFAULTS
)


def save_parameters(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").json(path)


def fill_parameters(params: DataFrame) -> DataFrame:
    """Add and fill whatever entries a record does not have."""
    columns = [
        (F.coalesce(F.col(n).cast("double"), F.lit(d)) if n in params.columns else F.lit(d)).alias(n)
        for n, d in PARAMETER_DEFAULTS.items()
    ]
    kept = [c for c in params.columns if c not in PARAMETER_DEFAULTS]
    return params.select(*kept, *columns)


def load_parameters(spark: SparkSession, path: str, models: Sequence[str]) -> DataFrame:
    params = fill_parameters(spark.read.schema(PARAMETER_SCHEMA).json(path))
    require_models(params, models)
    return params


def missing_models(table: DataFrame, models: Sequence[str]) -> DataFrame:
    wanted = table.sparkSession.createDataFrame([(m,) for m in models], "model STRING")
    return wanted.join(table.select("model").distinct(), "model", "left_anti")


def require_models(table: DataFrame, models: Sequence[str]) -> None:
    missing = [r.model for r in missing_models(table, models).orderBy("model").collect()]
    if missing:
        raise ValueError(f"missing models: {missing}")


# --- earlier decisions ------------------------------------------------------

def valid_earlier(earlier: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return earlier.where(F.col("pred_model").isin(list(allowed)))


def still_open(queries: DataFrame, earlier: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Queries without a usable earlier decision."""
    return queries.join(valid_earlier(earlier, allowed).select("id"), "id", "left_anti")


def resume_decisions(
    queries: DataFrame, earlier: DataFrame, fresh: DataFrame, allowed: Sequence[str], source: Column | None = None
) -> DataFrame:
    """Earlier valid decisions as they are, fresh ones for the rest, each with its source."""
    reused = (
        valid_earlier(earlier, allowed)
        .join(queries.select("id"), "id", "left_semi")
        .select("id", "pred_model", F.lit("earlier").alias("decision_source"))
    )
    rest = fresh.join(still_open(queries, earlier, allowed).select("id"), "id", "left_semi").select(
        "id", "pred_model", (source if source is not None else F.lit("fresh")).alias("decision_source")
    )
    return reused.unionByName(rest)


def append_decision_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)
