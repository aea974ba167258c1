"""Registered queries: learned scorers, score blocks and validation boards (no SQL twins)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.tasks import with_task_profile
from signalbox.operators import audit as A
from signalbox.operators import decide as D
from signalbox.operators import ensemble as E
from signalbox.operators import factor as K
from signalbox.operators import learners as G
from signalbox.operators import neighbors as NB
from signalbox.operators import priors as P
from signalbox.operators import rewards as R
from signalbox.operators import splits as J
from signalbox.operators import tfidf as TF
from signalbox.plans import fixtures as X
from signalbox.plans.evaluation import HIER, PROMPTED_REWARD, profiled_rewards
from signalbox.plans.fixtures import HELD, MODELS, SPLIT_SEED, sql
from signalbox.plans.registry import register
from signalbox.plans.scoring import _r
from signalbox.plans.text import KNN_SCORES, neighbors_sql, rewarded_texts, text_split, vector_split, weights_sql, word_terms_sql
from signalbox.session import durable


def long_scores(scored: DataFrame) -> DataFrame:
    return C.to_long(scored, "score")


# --- text classifiers and regressors -------------------------------------------------------

@register("g1_oracle_classifier")
def g1(spark, sf):
    train, held = text_split(spark, sf)
    labelled = train.withColumn("label", C.best(F.col("cells"), "reward")["model"])
    rows, queries = G.text_features(labelled, held, TF.SPECS["classifier"], keep=("label",))
    return long_scores(G.logistic_scores(rows, queries, MODELS))


@register("g2_ridge_regression")
def g2(spark, sf):
    train, held = text_split(spark, sf)
    rows, queries = G.text_features(NB.dense_rewards(train, MODELS), held, TF.SPECS["word12"], keep=("rewards",))
    return long_scores(G.ridge_scores(rows, queries, MODELS))


@register("g3_pairwise_preferences")
def g3(spark, sf):
    train, held = text_split(spark, sf)
    return long_scores(G.pairwise_scores(train, held, MODELS))


# --- classifiers and regressors on embeddings ------------------------------------------------

def _vector_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Training vectors with reward arrays and the label of the best, and query vectors."""
    train, held = vector_split(spark, sf)
    best = F.array_position("performances", F.array_max("performances"))
    label = F.element_at(F.lit(MODELS), best.cast("int"))
    rows = train.select("id", "vec", F.col("performances").alias("rewards"), label.alias("label"))
    rows = durable(G.dense_features(rows, ("id", "rewards", "label")))
    return rows, G.dense_features(held, ("id",))


@register("g4_classifier_ensemble")
def g4(spark, sf):
    rows, queries = _vector_rows(spark, sf)
    return long_scores(G.classifier_ensemble_scores(rows, queries, MODELS))


@register("g4_boosted_classifier")
def g4_boosted(spark, sf):
    rows, queries = _vector_rows(spark, sf)
    return long_scores(G.boosted_classifier_scores(rows, queries, MODELS))


@register("g5_boosted_regressors")
def g5(spark, sf):
    rows, queries = _vector_rows(spark, sf)
    return long_scores(G.boosted_regression_scores(rows, queries, MODELS))


@register("g6_soft_oracle_classifier")
def g6(spark, sf):
    train, held = text_split(spark, sf)
    rows, queries = G.text_features(train.select("id", "query"), held, TF.SPECS["word12"])
    return long_scores(G.soft_oracle_scores(rows, queries, train.select("id", "cells"), MODELS))


def _heads(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted performance and standardised cost of held-out texts, the scaler and the panel."""
    panel = X.text_panel(spark, sf)
    scaler = R.fit_cost_scaler(panel)
    train, held = J.train_and_held(R.standardize_cost(panel, scaler), HELD, SPLIT_SEED)
    carried = NB.dense_rewards(train, MODELS, "performance", "performances")
    carried = NB.dense_rewards(carried, MODELS, "z_cost", "z_costs").select("id", "query", "performances", "z_costs")
    rows, queries = G.text_features(carried, held, TF.SPECS["word12"], keep=("performances", "z_costs"))
    return G.head_cells(rows, queries, MODELS), scaler, panel


@register("g7_performance_cost_heads")
def g7(spark, sf):
    predicted, scaler, panel = _heads(spark, sf)
    scored = R.plug_in_scores(predicted, scaler, R.denominator(panel, "mean-row-max", "eps"))
    return C.to_long(scored, "performance", "pred_cost", "score")


@register("g8_item_response")
def g8(spark, sf):
    train, held = vector_split(spark, sf)
    fitted = G.fit_item_response(train, MODELS, 64)
    performance = G.item_response_cells(held, fitted)
    fixed = P.fixed_model_cost(R.normalize_cost(X.panel(spark, sf), "mean-row-max"))
    return C.to_long(P.fixed_cost_scores(performance, fixed), "performance", "score")


@register("g9_direct_reward")
def g9(spark, sf):
    """Multi-output reward regression and the policy reward of its decisions."""
    train, held = text_split(spark, sf)
    rows, queries = G.text_features(NB.dense_rewards(train, MODELS), held, TF.SPECS["word12"], keep=("rewards",))
    decisions = D.decide(G.ridge_scores(rows, queries, MODELS))
    oracle = held.select(C.best(F.col("cells"), "reward")["value"].alias("v")).agg(F.avg("v")).scalar()
    return A.policy_reward(held, decisions).withColumn("oracle_reward", oracle)


@register(
    "g10_hybrid_routing",
    sql(*PROMPTED_REWARD, HIER, body="""SELECT p.id, CASE WHEN domain='coding' THEN 'coding' WHEN domain='arc_agi' THEN 'train_mean' ELSE 'general' END AS router_source,
        gp.model, round(CASE WHEN domain='coding' THEN h1.prior WHEN domain='arc_agi' THEN gp.g ELSE h2.prior END,8) AS score
        FROM profiles p CROSS JOIN gp LEFT JOIN hier h1 ON h1.level='subtask' AND h1.key=p.k AND h1.model=gp.model
        LEFT JOIN hier h2 ON h2.level='domain' AND h2.key=p.domain AND h2.model=gp.model"""),
)
def g10(spark, sf):
    """Subtask priors score coding queries, domain priors the others, id-only tasks fall back."""
    panel = profiled_rewards(spark, sf)
    priors = P.hierarchical_priors(panel)
    def scorer(level: str, column: str, part: DataFrame) -> DataFrame:
        cells = C.from_long(
            priors.where(F.col("level") == level).select(F.col("key").alias(column), "model", F.col("prior").alias("score")),
            "score", keys=(column,),
        )
        # One row per key of the task profile.
        return part.select("id", column).join(F.broadcast(cells), column)

    queries = panel.select("id", "task_domain", "task_subtask_key")
    coding = F.col("task_domain") == "coding"
    general = ~F.col("task_domain").isin("coding", "arc_agi")
    branches = {
        "coding": (coding, scorer("subtask", "task_subtask_key", queries.where(coding))),
        "general": (general, scorer("domain", "task_domain", queries.where(general))),
    }
    out = G.hybrid_scores(queries, branches, P.global_cells(P.global_prior(panel)))
    return _r(C.to_long(out, "score", keep=("id", "router_source")), "score")


@register("g10_hybrid_learned")
def g10_learned(spark, sf):
    """Coding texts by their own heads, the rest by item response on text embeddings."""
    panel = with_task_profile(R.normalize_cost(X.prompted_panel(spark, sf), "mean-row-max"))
    scaler = R.fit_cost_scaler(panel)
    train, held = J.train_and_held(R.standardize_cost(panel, scaler), HELD, SPLIT_SEED)
    coding = F.col("task_domain") == "coding"
    general_train = NB.dense_rewards(train.where(~coding), MODELS, "performance", "performances")
    embedder = K.fit_embedder(general_train.select("id", "query"))
    vectors = K.embed(general_train.select("id", "query"), embedder).join(general_train.select("id", "performances"), "id")
    response = G.fit_item_response(vectors, MODELS, embedder.width)
    fixed = P.fixed_model_cost(train.where(~coding))
    general = P.fixed_cost_scores(
        G.item_response_cells(K.embed(held.where(~coding).select("id", "query"), embedder), response), fixed
    )
    carried = NB.dense_rewards(train.where(coding), MODELS, "performance", "performances")
    carried = NB.dense_rewards(carried, MODELS, "z_cost", "z_costs").select("id", "query", "performances", "z_costs")
    rows, queries = G.text_features(carried, held.where(coding), TF.SPECS["classifier"], keep=("performances", "z_costs"))
    heads = G.head_cells(rows, queries, MODELS)
    special = R.plug_in_scores(heads, scaler, R.denominator(panel, "mean-row-max", "eps"))
    train_mean = P.global_cells(P.global_prior(R.add_reward(train, "mean-row-max", fit=panel)))
    part = held.select("id", "task_domain")
    branches = {
        "coding_heads": (coding, C.keep_fields(special, "score")),
        "general_item_response": (~coding, C.keep_fields(general, "score")),
    }
    return C.to_long(G.hybrid_scores(part, branches, train_mean), "score", keep=("id", "router_source"))


# --- score blocks and boards -------------------------------------------------------------------

VIEWS = ("word12", "charwb35", "char35")
KNN_K = (5, 20, 50)


def score_blocks(
    train: DataFrame, queries: DataFrame, views: Sequence[str] = VIEWS, ks: Sequence[int] = KNN_K,
    ridge_alpha: float = 10.0, clusters: int = 64,
) -> DataFrame:
    """``method, id, cells<model, score>`` of every view and scorer.

    A view's texts are cut into terms once for the vocabulary and once for the vectors, which
    serve neighbours, ridge and clusters; neighbours are found once for the largest k and cut at
    each k.  Vectors and rewards are stored, texts are not.
    """
    parts = []
    carried = NB.dense_rewards(train, MODELS)
    fallback = P.global_cells(P.global_prior(carried))
    asked = queries.select("id", "query")
    for view in views:
        model = TF.fit(carried, TF.SPECS[view])
        left = durable(TF.transform(asked, model))
        right = durable(TF.transform(carried, model, keep=("id", "rewards")))
        means = durable(NB.weighted_mean(NB.nearest_by_bounds(left, right, max(ks), ("rewards",)), MODELS, "rewards", ks, 1e-8))
        joined = left.select("id").join(means, "id", "left")
        for k in ks:
            cells = F.coalesce(F.col(f"cells_{k}"), fallback)
            parts.append(joined.select(F.lit(f"{view}_knn{k}").alias("method"), "id", cells.alias("cells")))
        rows, vectors = TF.as_vectors(right, model.size, ("id", "rewards")), TF.as_vectors(left, model.size)
        ridge = G.ridge_scores(rows, vectors, MODELS, ridge_alpha)
        parts.append(ridge.select(F.lit(f"{view}_ridge").alias("method"), "id", "cells"))
        if clusters > 0:
            cluster = K.cluster_scores(right, left, MODELS, fallback, model.size, clusters)
            parts.append(cluster.select(F.lit(f"{view}_cluster{clusters}").alias("method"), "id", "cells"))
    return durable(reduce(DataFrame.unionByName, parts))


def block_rewards(blocks: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean reward of every block's decisions: ``method, reward``."""
    decisions = D.decide(blocks, "score", ("method", "id"))
    joined = decisions.join(panel.select("id", F.col("cells").alias("truth")), "id", "left")
    value = C.value_of(F.col("truth"), F.col("pred_model"), "reward")
    message = F.concat(F.lit("decision without a reward: "), F.col("id").cast("string"))
    value = F.when(value.isNull(), F.raise_error(message).cast("double")).otherwise(value)
    return joined.groupBy("method").agg(F.avg(value).alias("reward"))


def validation_board(panel: DataFrame, seeds: Sequence[int], views: Sequence[str], **options) -> DataFrame:
    """``seed, method, reward, n_blocks`` with the oracle, every block and the averages of the best."""
    parts = []
    for seed in seeds:
        train, held = J.train_and_held(panel, HELD, seed)
        held = durable(held)
        blocks = score_blocks(train, held, views, **options)
        rewards = block_rewards(blocks, held)
        # A board has one row per method, so its order comes to the driver.
        ranked = [r.method for r in rewards.orderBy(F.desc("reward"), "method").collect()]
        oracle = held.select(C.best(F.col("cells"), "reward")["value"].alias("v")).agg(F.avg("v").alias("reward"))
        parts.append(oracle.select(F.lit("oracle").alias("method"), "reward", F.lit(0).alias("n_blocks")).withColumn("seed", F.lit(seed)))
        parts.append(rewards.select("method", "reward", F.lit(1).alias("n_blocks")).withColumn("seed", F.lit(seed)))
        for n in dict.fromkeys(min(top, len(ranked)) for top in (3, 5, 8, 12)):
            mixed = E.average_blocks(blocks, ranked[:n]).withColumn("method", F.lit(f"cv_top{n}_avg"))
            parts.append(
                block_rewards(mixed, held).select("method", "reward", F.lit(n).alias("n_blocks")).withColumn("seed", F.lit(seed))
            )
    return reduce(DataFrame.unionByName, parts)


@register("f10_score_blocks")
def f10(spark, sf):
    train, held = text_split(spark, sf)
    return C.to_long(score_blocks(train, held), "score", keep=("method", "id"))


def _holdout_sql(seed: int) -> str:
    split = X.SQL["split"].replace(f"md5('{SPLIT_SEED}:'", f"md5('{seed}:'")
    ctes = ",\n".join([split, word_terms_sql("split"), weights_sql(200000), neighbors_sql(100), KNN_SCORES])
    return f"""SELECT * FROM (WITH {ctes},
        picks AS (SELECT r.reward, row_number() OVER (PARTITION BY k.id ORDER BY k.score DESC, k.model) AS rk FROM knn_all k JOIN rw r ON r.id=k.id AND r.model=k.model)
        SELECT avg(reward) AS policy_reward, count(*) AS n, {seed} AS seed FROM picks WHERE rk=1)"""


@register("j3_knn_repeated_holdout", sql("panel", "den", "rw", body=" UNION ALL ".join(_holdout_sql(seed) for seed in (42, 43))))
def j3_knn(spark, sf):
    """Repeated hold-out reward of the nearest-neighbour scorer, one row per seed."""
    panel = durable(rewarded_texts(spark, sf))
    parts = []
    for seed in J.cv_seeds("42,43"):
        train, held = J.train_and_held(panel, HELD, seed)
        scored = NB.knn_scores(train, held, MODELS)[100]
        parts.append(A.policy_reward(held, D.decide(scored)).withColumn("seed", F.lit(seed)))
    return reduce(DataFrame.unionByName, parts)


@register("j2_stratified_cv_reward")
def j2_cv(spark, sf):
    """Mean reward of the oracle-label classifier over stratified folds."""
    labelled = rewarded_texts(spark, sf).withColumn("label", C.best(F.col("cells"), "reward")["model"])
    folds = durable(J.stratified_folds(labelled, 5, 42))
    parts = []
    for fold in range(5):
        train, held = folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)
        rows, queries = G.text_features(train, held, TF.SPECS["classifier"], keep=("label",))
        decisions = D.decide(G.logistic_scores(rows, queries, MODELS))
        parts.append(A.policy_reward(held, decisions).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, parts)


@register("j4_validation_board")
def j4(spark, sf):
    """Mean, spread and range of every method's reward over the seeds, all views and scorers."""
    board = validation_board(rewarded_texts(spark, sf), J.cv_seeds("42,43"), VIEWS)
    grouped = board.groupBy("method").agg(
        F.avg("reward").alias("mean"), F.stddev_samp("reward").alias("std"), F.min("reward").alias("min"), F.max("reward").alias("max"),
        F.count(F.lit(1)).alias("n"), F.max("n_blocks").alias("n_blocks"),
    )
    return grouped
