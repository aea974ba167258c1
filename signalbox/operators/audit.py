"""Policy evaluation, per-row audits, losses and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import bce_with_logits, implied_cost, sigmoid, softplus
from signalbox.operators.decide import gather, mean_by_model, oracle
from signalbox.operators.quantiles import exact_quantiles
from signalbox.operators.rewards import ALPHA, guard_denominator

# Quantiles an audit reports.
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


# --- policy reward ----------------------------------------------------------

def policy_reward(panel: DataFrame, decisions: DataFrame, field: str = "reward", strict: bool = True) -> DataFrame:
    """Mean reward of a decision table over the panel's queries.

    When ``strict``, an unknown label, a decision without a query and a query without a decision
    are errors; otherwise they leave the mean.
    """
    if strict:
        cells = panel.select("id", "cells").join(decisions.select("id", "pred_model"), "id", "full")
        value = C.value_of(F.col("cells"), F.col("pred_model"), field)
        label = F.coalesce("pred_model", F.lit("none"))
        message = F.concat(F.lit("unknown decision label: "), label, F.lit(" of query "), F.col("id").cast("string"))
        picked = cells.select(F.when(value.isNull(), F.raise_error(message).cast("double")).otherwise(value).alias("value"))
    else:
        picked = gather(panel, decisions, field).where("value IS NOT NULL")
    value = F.col("value")
    return picked.agg(F.avg(value).alias("policy_reward"), F.count(F.lit(1)).alias("n"))


def policy_reward_metric(
    panel: DataFrame, decisions: DataFrame, cost_norm: str = "mean-row-max", alpha: float = ALPHA
) -> DataFrame:
    """alpha * mean(performance) - (1 - alpha) * mean(cost) / denominator of the judged rows.

    One pass: the chosen cells and the denominator come out of the same aggregate.
    """
    joined = decisions.select("id", "pred_model").join(panel.select("id", "cells"), "id")
    cells, pick = F.col("cells"), F.col("pred_model")
    highest = F.array_max(C.values(cells, "cost"))
    rows = joined.select(
        C.value_of(cells, pick, "performance").alias("p"),
        C.value_of(cells, pick, "cost").alias("c"),
        highest.alias("m"),
    )
    if cost_norm == "row-max":
        cost_term = F.avg(F.col("c") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")))
    else:
        denominators = {"mean-row-max": F.avg("m"), "global-max": F.max("m"), "none": F.lit(1.0)}
        if cost_norm not in denominators:
            raise ValueError(f"unknown cost_norm: {cost_norm}")
        cost_term = F.avg("c") / guard_denominator(denominators[cost_norm], "one")
    return rows.agg(
        (F.lit(alpha) * F.avg("p") - F.lit(1 - alpha) * cost_term).alias("policy_reward"),
        F.count(F.lit(1)).alias("n"),
    )


# --- per-row audit ----------------------------------------------------------

def audit_rows(
    panel: DataFrame, score: str = "score", reward: str = "reward", keep: Sequence[str] = ("id",), fields: Sequence[str] = ()
) -> DataFrame:
    """Selected and oracle model, their rewards, regret, score margin and reward gap per query.

    ``keep`` carries row values such as the text and the row weight; each of the ``fields``
    (logits, probabilities, targets, predicted scores) becomes an array in model order.
    """
    cells = F.col("cells")
    picked, ideal = C.best(cells, score), C.best(cells, reward)
    base = panel.select(
        *keep,
        "cells",
        picked["model"].alias("selected"),
        ideal["model"].alias("oracle"),
        ideal["value"].alias("oracle_reward"),
        C.top_gap(cells, score).alias("margin"),
        F.least(F.greatest(C.top_gap(cells, reward), F.lit(0.0)), F.lit(1.0)).alias("reward_gap"),
        *[C.values(cells, name).alias(name) for name in fields],
    )
    out = base.withColumn("routing_reward", C.value_of(cells, F.col("selected"), reward))
    return out.withColumn("regret", F.col("oracle_reward") - F.col("routing_reward")).drop("cells")


def performance_audit(panel: DataFrame, keep: Sequence[str] = ("id",), alpha: float = ALPHA) -> DataFrame:
    """Audit of performance logits: score = alpha * sigmoid(logit) - (1 - alpha) * implied cost."""
    scored = C.add_field(
        panel,
        "score",
        lambda c: F.lit(alpha) * sigmoid(c["logit"])
        - F.lit(1.0 - alpha) * implied_cost(c["performance"], c["reward"], alpha),
    )
    return audit_rows(scored, "score", "reward", keep)


def routing_metrics(rows: DataFrame) -> DataFrame:
    """Routing reward, oracle reward, regret and top-1 accuracy of audit rows."""
    return rows.agg(
        F.avg("routing_reward").alias("routing_reward"),
        F.avg("oracle_reward").alias("oracle_reward"),
        (F.avg("oracle_reward") - F.avg("routing_reward")).alias("routing_regret"),
        F.avg((F.col("selected") == F.col("oracle")).cast("double")).alias("top1_accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


# --- audit summary ----------------------------------------------------------

def summary_by_model(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Selection count, oracle count and mean regret when selected, for every model.

    A model never selected has a null mean regret.
    """
    names = rows.sparkSession.createDataFrame([(m,) for m in models], "model STRING")
    parts = rows.select(
        F.explode_outer(
            F.array(
                F.struct(F.col("selected").alias("model"), F.lit(1).alias("s"), F.lit(0).alias("o"), F.col("regret")),
                F.struct(
                    F.col("oracle").alias("model"),
                    F.lit(0).alias("s"),
                    F.lit(1).alias("o"),
                    F.lit(None).cast("double").alias("regret"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    counts = parts.groupBy("model").agg(
        F.sum("s").alias("selection_count"), F.sum("o").alias("oracle_count"), F.avg("regret").alias("mean_regret")
    )
    return names.join(counts, "model", "left").select(
        "model",
        F.coalesce("selection_count", F.lit(0)).alias("selection_count"),
        F.coalesce("oracle_count", F.lit(0)).alias("oracle_count"),
        "mean_regret",
    )


def quantile_table(rows: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """Long table ``metric, q, value`` of exact interpolated quantiles."""
    found = exact_quantiles(rows, columns, probabilities)
    out = [(c, float(q), float(v)) for c in columns for q, v in zip(probabilities, found[c])]
    return rows.sparkSession.createDataFrame(out, "metric STRING, q DOUBLE, value DOUBLE")


def training_summary(panel: DataFrame) -> DataFrame:
    """Per model: how often it is the oracle, and mean reward, performance and cost."""
    means = mean_by_model(panel, "reward", "performance", "cost").drop("n")
    counts = oracle(panel).groupBy(F.col("label").alias("model")).agg(F.count(F.lit(1)).alias("label_count"))
    return means.join(F.broadcast(counts), "model", "left").withColumn(
        "label_count", F.coalesce("label_count", F.lit(0))
    )


def collapse_report(rows: DataFrame, near_zero: float = 0.01) -> DataFrame:
    """Largest selection share, share of near-zero margins, and the model behind the collapse."""
    counts = rows.groupBy("selected").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("margin") <= near_zero).alias("near")
    )
    return counts.agg(
        (F.max("n") / F.sum("n")).alias("max_selection_share"),
        F.max(F.struct(F.col("n"), F.col("selected")))["selected"].alias("most_selected"),
        (F.sum("near") / F.sum("n")).alias("near_zero_margin_share"),
        F.count(F.lit(1)).alias("models_selected"),
    )


def selection_ratio(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Selected over oracle count per model, null where the oracle never picks the model."""
    table = summary_by_model(rows, models)
    return table.select(
        "model",
        "selection_count",
        "oracle_count",
        F.try_divide(F.col("selection_count").cast("double"), F.col("oracle_count")).alias("ratio"),
    )


def selection_drift(train: DataFrame, test: DataFrame) -> DataFrame:
    """Selection shares in two decision tables and their difference, model by model."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col("pred_model").alias("model")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("model", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias(name))

    both = shares(train, "train_share").join(shares(test, "test_share"), "model", "full_outer")
    filled = both.select(
        "model", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("train_share", "test_share")]
    )
    return filled.withColumn("shift", F.col("test_share") - F.col("train_share"))


# --- losses -----------------------------------------------------------------

def _pairs(cells: Column, fields: Sequence[str]) -> Column:
    """Every pair of a query's models, the earlier name first, as ``struct<i, j>``."""
    return F.flatten(
        F.transform(
            cells,
            lambda a: F.transform(
                F.filter(cells, lambda b: a["model"] < b["model"]),
                lambda b: F.struct(
                    F.struct(a["model"].alias("model"), *[a[f].alias(f) for f in fields]).alias("i"),
                    F.struct(b["model"].alias("model"), *[b[f].alias(f) for f in fields]).alias("j"),
                ),
            ),
        )
    )


def model_pairs(panel: DataFrame, *fields: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per query and pair of its models, made inside the row without a self-join."""
    exploded = panel.select(*keep, F.explode_outer(_pairs(F.col("cells"), fields)).alias("p"))
    exploded = exploded.where(F.col("p").isNotNull())
    return exploded.select(
        *keep,
        F.col("p.i.model").alias("model_i"),
        F.col("p.j.model").alias("model_j"),
        *[F.col(f"p.{side}.{f}").alias(f"{f}_{side}") for f in fields for side in ("i", "j")],
    )


def routing_aware_loss(
    labels: DataFrame,
    weight: float = 1.0,
    temperature: float = 0.05,
    min_gap: float = 1e-4,
    alpha: float = ALPHA,
) -> DataFrame:
    """Row-weighted binary cross-entropy plus the gap-weighted pairwise ranking loss.

    ``labels`` has ``cells<model, logit, target, reward>`` and ``row_weight``.  All pair terms
    are summed inside the row; across rows there is one aggregate of four sums.
    """
    scored = C.add_field(
        labels,
        "score",
        lambda c: F.lit(alpha) * F.lit(1.0) / (F.lit(1.0) + F.exp(-c["logit"]))
        - F.lit(1.0 - alpha) * implied_cost(c["target"], c["reward"], alpha),
    )
    scored = C.add_field(scored, "bce", lambda c: bce_with_logits(c["logit"], c["target"]))
    gap = lambda p: p["i"]["reward"] - p["j"]["reward"]
    lead = lambda p: p["i"]["score"] - p["j"]["score"]
    loss = lambda p: softplus(-F.signum(gap(p)) * lead(p) / F.lit(temperature)) * F.abs(gap(p))
    rows = scored.withColumn("_pairs", F.filter(_pairs(F.col("cells"), ("reward", "score")), lambda p: F.abs(gap(p)) >= min_gap))
    rows = rows.select(
        "row_weight",
        (C.total(C.values(F.col("cells"), "bce")) / F.size("cells")).alias("bce"),
        C.total(F.transform("_pairs", loss)).alias("pair_loss"),
        C.total(F.transform("_pairs", lambda p: F.abs(gap(p)))).alias("pair_weight"),
    )
    w = F.col("row_weight")
    sums = rows.agg(
        F.sum(F.col("bce") * w).alias("b"),
        F.sum(w).alias("w"),
        F.sum(F.col("pair_loss") * w).alias("p"),
        F.sum(F.col("pair_weight") * w).alias("d"),
    )
    bce_loss = F.col("b") / F.greatest(F.col("w"), F.lit(1e-6))
    ranking = F.when(F.col("d") > 0, F.try_divide(F.col("p"), F.col("d"))).otherwise(0.0)
    return sums.select(
        (bce_loss + F.lit(weight) * ranking).alias("total_loss"),
        bce_loss.alias("bce_loss"),
        ranking.alias("ranking_loss"),
    )


def soft_oracle_loss(labels: DataFrame) -> DataFrame:
    """Row-weighted KL divergence from softmax(logit) to the soft targets.

    ``labels`` has ``cells<model, logit, target>`` and ``row_weight``; a target of zero adds nothing.
    """
    logits = C.values(F.col("cells"), "logit")
    shifted = lambda s: C.total(F.transform(s["x"], lambda x: F.exp(x - s["top"])))
    lse = C.let(F.struct(logits.alias("x"), F.array_max(logits).alias("top")), lambda s: s["top"] + F.ln(shifted(s)))
    term = lambda c, s: F.when(
        c["target"] > 0, c["target"] * (F.ln(c["target"]) - (c["logit"] - s["lse"]))
    ).otherwise(0.0)
    divergence = C.let(
        F.struct(F.col("cells").alias("cells"), lse.alias("lse")),
        lambda s: C.total(F.transform(s["cells"], lambda c: term(c, s))),
    )
    rows = labels.select("row_weight", divergence.alias("kl"))
    total = F.sum(F.col("kl") * F.col("row_weight"))
    return rows.agg((total / F.greatest(F.sum("row_weight"), F.lit(1e-6))).alias("kl_loss"))


# --- residuals, regression metrics, token log-probabilities ------------------

def residuals(panel: DataFrame, biases: DataFrame | None = None) -> DataFrame:
    """Add ``residual = reward - (score + bias)``; a model without a bias counts as 0."""
    if biases is None:
        return C.add_field(panel, "residual", lambda c: c["reward"] - c["score"])
    out = panel.withColumn("_b", C.model_map(biases, "bias"))
    bias = lambda c: F.coalesce(F.col("_b")[c["model"]]["bias"], F.lit(0.0))
    return C.add_field(out, "residual", lambda c: c["reward"] - (c["score"] + bias(c))).drop("_b")


def regression_metrics(df: DataFrame, prediction: str, label: str) -> DataFrame:
    error = F.col(prediction) - F.col(label)
    return df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.count(F.lit(1)).alias("n"))


def token_scores(tokens: DataFrame) -> DataFrame:
    """Mean token log-probability per (query, label) as scored cells."""
    means = tokens.groupBy("id", F.col("label").alias("model")).agg(F.avg("logprob").alias("score"))
    return C.from_long(means, "score")


def cv_summary(board: DataFrame, method: str = "method", value: str = "reward", ddof: int = 1) -> DataFrame:
    """Mean, deviation, extremes and count per method over seeds."""
    spread = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return board.groupBy(method).agg(
        F.avg(value).alias("mean"),
        spread.alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n"),
    )
