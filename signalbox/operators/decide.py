"""Argmax, ranking and top-k over scored panels and decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import fixed, truncate_text


def decide(panel: DataFrame, field: str = "score", keep: Sequence[str] = ("id",), out: str = "pred_model") -> DataFrame:
    """The best model of every query; of equal scores the first model by name."""
    best = C.best(F.col("cells"), field)
    return panel.select(*keep, best["model"].alias(out), best["value"].alias("score"))


def oracle(panel: DataFrame, field: str = "reward", keep: Sequence[str] = ("id",)) -> DataFrame:
    return decide(panel, field, keep, "label").withColumnRenamed("score", "oracle_reward")


def gather(panel: DataFrame, decisions: DataFrame, field: str, out: str = "value") -> DataFrame:
    """Value of the chosen model's cell; one join on id, then a lookup inside the row.

    Every decision keeps its row; its value is null without a panel row or such a cell.
    """
    joined = decisions.select("id", "pred_model").join(panel.select("id", "cells"), "id", "left")
    return joined.select("id", "pred_model", C.value_of(F.col("cells"), F.col("pred_model"), field).alias(out))


def mean_by_model(panel: DataFrame, *fields: str) -> DataFrame:
    return (
        C.to_long(panel, *fields)
        .groupBy("model")
        .agg(*[F.avg(f).alias(f"mean_{f}") for f in fields], F.count(F.lit(1)).alias("n"))
    )


def constant_board(panel: DataFrame, field: str = "reward") -> DataFrame:
    """Mean reward of always choosing one model, best first."""
    return mean_by_model(panel, field).orderBy(F.desc(f"mean_{field}"), "model")


def global_best(panel: DataFrame, field: str = "reward") -> DataFrame:
    """One row: the best constant model."""
    return constant_board(panel, field).select("model", f"mean_{field}").limit(1)


def constant_policy(queries: DataFrame, model: str, models: Sequence[str]) -> DataFrame:
    if model not in models:
        raise ValueError(f"unknown model {model!r}; one of {list(models)}")
    return queries.select("id", F.lit(model).alias("pred_model"))


def global_best_policy(queries: DataFrame, panel: DataFrame, field: str = "reward") -> DataFrame:
    return queries.select("id", global_best(panel, field).select("model").scalar().alias("pred_model"))


def margins(panel: DataFrame, field: str = "reward", on_single: str = "error") -> DataFrame:
    """Best minus second best per query, raw and held inside [0, 1]."""
    gap = C.top_gap(F.col("cells"), field, on_single)
    return panel.select("id", gap.alias("margin")).withColumn(
        "clipped_margin", F.least(F.greatest(F.col("margin"), F.lit(0.0)), F.lit(1.0))
    )


def labelled_margins(panel: DataFrame, keep: Sequence[str] = ("id", "query")) -> DataFrame:
    """Oracle label and reward margin of every query, as one projection."""
    return panel.select(
        *keep,
        C.best(F.col("cells"), "reward")["model"].alias("label"),
        C.top_gap(F.col("cells"), "reward").alias("margin"),
    )


def top_per_label(examples: DataFrame, k: int, max_chars: int = 0) -> DataFrame:
    """The k rows of largest margin per label, smaller id first on ties.

    The rank filter lets Spark cut every map task's rows to k per label before the shuffle,
    so a label with a third of all rows costs k rows per task.
    """
    order = W.partitionBy("label").orderBy(F.desc("margin"), F.asc("id"))
    slim = examples.select("id", "label", "margin", "query")
    top = slim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("query", truncate_text(F.col("query"), max_chars))


def versus_base(panel: DataFrame, base: DataFrame, field: str = "score") -> DataFrame:
    """Best model against the base decision: margin over the base and gap to the runner-up."""
    joined = panel.select("id", "cells").join(base.select("id", F.col("pred_model").alias("base_pred")), "id", "left")
    best = C.best(F.col("cells"), field)
    base_score = C.value_of(F.col("cells"), F.col("base_pred"), field)
    named = F.coalesce("base_pred", F.concat(F.lit("none for query "), F.col("id").cast("string")))
    message = F.concat(F.lit("base decision names an unknown model: "), named)
    checked = F.when(base_score.isNull(), F.raise_error(message).cast("double")).otherwise(base_score)
    return joined.select(
        "id",
        "base_pred",
        best["model"].alias("score_pred"),
        (best["value"] - checked).alias("margin_vs_base"),
        C.top_gap(F.col("cells"), field, "zero-second").alias("top_gap"),
    )


def override_candidates(panel: DataFrame, base: DataFrame, n: int | None = None, field: str = "score") -> DataFrame:
    """Rows whose best model differs from the base; the n strongest when n is given."""
    rows = versus_base(panel, base, field).where(F.col("base_pred") != F.col("score_pred"))
    if n is None:
        return rows
    return rows.orderBy(F.desc("margin_vs_base"), F.desc("top_gap"), F.asc("id")).limit(n)


def leaderboard(scored: DataFrame, method: str = "method", value: str = "reward") -> DataFrame:
    """Methods ranked by mean reward; the rank runs over one row per method."""
    board = scored.groupBy(method).agg(F.avg(value).alias("mean_reward"), F.count(F.lit(1)).alias("n"))
    return board.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_reward"), F.asc(method))))


def frequencies(df: DataFrame, column: str, top_n: int = 0) -> DataFrame:
    """Counts and shares by value, most frequent first; shares are over the kept rows."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc("label"))
    kept = ordered.limit(top_n) if top_n > 0 else counts
    return kept.withColumn("share", F.col("n") / kept.agg(F.sum("n")).scalar())


def format_counts(counts: DataFrame) -> DataFrame:
    """One text row ``Model_A=3 (60.0%), ...`` from a label/count table of candidate size."""
    rows = counts.where("n > 0")
    return _format(rows.withColumn("share", F.col("n") / rows.agg(F.sum("n")).scalar()))


def _format(rows: DataFrame) -> DataFrame:
    entry = F.struct((-F.col("n")).alias("o"), F.col("label"), F.col("n"), F.col("share"))
    text = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda r: F.format_string("%s=%d (%s%%)", r["label"], r["n"], fixed(r["share"] * 100, 1)),
    )
    joined = F.array_join(text, ", ")
    return rows.agg(F.when(F.length(joined) > 0, joined).otherwise("none").alias("counts"))


def decision_diff(base: DataFrame, final: DataFrame) -> DataFrame:
    """Transitions ``base -> final`` among changed decisions, most frequent first."""
    joined = base.select("id", F.col("pred_model").alias("base_pred")).join(
        final.select("id", F.col("pred_model").alias("final_pred")), "id"
    )
    return (
        joined.where(F.col("base_pred") != F.col("final_pred"))
        .groupBy("base_pred", "final_pred")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "base_pred", "final_pred")
    )


def changed_count(base: DataFrame, final: DataFrame) -> DataFrame:
    joined = base.select("id", F.col("pred_model").alias("a")).join(
        final.select("id", F.col("pred_model").alias("b")), "id"
    )
    return joined.agg(F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count(F.lit(1)).alias("compared"))
