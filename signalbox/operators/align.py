"""Alignment of score sources and decision tables, and the decision-table validator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_PATTERN = r"^Model_[A-K]$"


def align_scores(panel: DataFrame, models: Sequence[str], strict: bool = True) -> DataFrame:
    """Bring every query's cells to the reference models in reference order.

    A missing model is an error when ``strict``; models outside the reference drop out.
    """
    cells = F.col("cells")
    names = F.transform(cells, lambda c: c["model"])
    absent = F.array_except(F.lit(list(models)), names)
    out = panel
    if strict:
        message = F.concat(F.lit("missing models: "), F.array_join(absent, ","))
        checked = F.when(F.size(absent) > 0, F.raise_error(message)).otherwise(cells)
        out = out.withColumn("cells", checked)
    ordered = F.filter(
        F.transform(F.lit(list(models)), lambda m: F.get(F.filter(F.col("cells"), lambda c: c["model"] == m), F.lit(0))),
        lambda c: c.isNotNull(),
    )
    return out.withColumn("cells", ordered)


def named_by_order(panel: DataFrame, models: Sequence[str]) -> DataFrame:
    """Give nameless score rows ``id, scores array`` the model names in order; the width must fit."""
    width = F.size("scores")
    message = F.concat(F.lit("unexpected score width: "), width.cast("string"))
    checked = F.when(width != len(models), F.raise_error(message)).otherwise(F.col("scores"))
    cell = lambda m, s: F.struct(m.alias("model"), s.cast("double").alias("score"))
    return panel.select("id", F.zip_with(F.lit(list(models)), checked, cell).alias("cells"))


def id_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many ids are on one side only, and how often ids repeat.

    Each side is counted per id before the join, so a repeated id costs one row.
    """
    left = a.groupBy("id").agg(F.count(F.lit(1)).alias("na"))
    right = b.groupBy("id").agg(F.count(F.lit(1)).alias("nb"))
    joined = left.join(right, "id", "full_outer")
    return joined.agg(
        F.count_if(F.col("nb").isNull()).alias("only_left"),
        F.count_if(F.col("na").isNull()).alias("only_right"),
        F.count_if(F.col("na") > 1).alias("repeated_left"),
        F.count_if(F.col("nb") > 1).alias("repeated_right"),
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("shared"),
    )


def require_same_ids(a: DataFrame, b: DataFrame) -> None:
    row = id_mismatches(a, b).first()
    if row.only_left or row.only_right or row.repeated_left or row.repeated_right:
        raise ValueError(f"id sets differ: {row.asDict()}")


def restrict_to(decisions: DataFrame, queries: DataFrame) -> DataFrame:
    """Tolerant alignment: decisions for other ids drop out."""
    return decisions.join(queries.select("id"), "id", "left_semi")


def checksum(df: DataFrame, *columns: str) -> Column:
    """Order-insensitive checksum: the sum of row hashes as a decimal, which cannot wrap."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def validate_decisions(decisions: DataFrame, queries: DataFrame, label_pattern: str = LABEL_PATTERN) -> DataFrame:
    """One row of violation counts; every count is 0 for a valid table.

    Counting per id first keeps a repeated id from multiplying in the join.
    """
    if decisions.columns != ["id", "pred_model"]:
        raise ValueError(f"decision columns must be exactly id, pred_model; got {decisions.columns}")
    per_id = decisions.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pred_model").isNull()).alias("nulls"),
        F.count_if(~F.coalesce(F.col("pred_model").rlike(label_pattern), F.lit(True))).alias("bad"),
    )
    wanted = queries.select("id", F.lit(True).alias("_wanted")).distinct()
    joined = per_id.join(wanted, "id", "full_outer")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if("_wanted").alias("expected_rows"),
        F.count_if(F.col("n").isNull()).alias("missing_ids"),
        F.count_if(F.col("_wanted").isNull()).alias("extra_ids"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_labels"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_labels"),
    )


def decision_checksum(decisions: DataFrame) -> DataFrame:
    return decisions.agg(checksum(decisions, "id", "pred_model").cast("string").alias("checksum"))


def require_valid(decisions: DataFrame, queries: DataFrame, label_pattern: str = LABEL_PATTERN) -> None:
    row = validate_decisions(decisions, queries, label_pattern).first().asDict()
    broken = {k: v for k, v in row.items() if k not in ("rows", "expected_rows") and v}
    if broken or row["rows"] != row["expected_rows"]:
        raise ValueError(f"invalid decision table: {row}")
