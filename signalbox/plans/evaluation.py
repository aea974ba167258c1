"""Registered queries: policy reward, audits, weights, losses, priors, joins and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.tasks import TASK_NAMES, task_label, with_task_profile
from signalbox.operators import align as L
from signalbox.operators import audit as A
from signalbox.operators import decide as D
from signalbox.operators import labels as W
from signalbox.operators import normalize as N
from signalbox.operators import priors as P
from signalbox.operators import rewards as R
from signalbox.operators import splits as J
from signalbox.plans import fixtures as X
from signalbox.plans.fixtures import MODELS, sql
from signalbox.plans.registry import register
from signalbox.plans.scoring import LEVEL_SQL, PROFILE_SQL, TASK_SQL, _r
from signalbox.session import durable


def rewarded(spark, sf, source: str = "alpha") -> DataFrame:
    """Cells with performance, cost, score and mean-row-max reward."""
    return R.add_reward(X.scored_panel(spark, sf, source), "mean-row-max")


AW = "aw AS (SELECT r.id, r.model, performance, cost, norm_cost, reward, score, (score-CAST(0.5 AS DOUBLE))*8 AS logit FROM rw r JOIN alpha a ON r.id=a.id AND r.model=a.model)"
AUDIT = """audit AS (SELECT id, max(CASE WHEN srk=1 THEN model END) AS selected, max(CASE WHEN rrk=1 THEN model END) AS oracle,
    max(CASE WHEN rrk=1 THEN reward END) AS oracle_reward, max(CASE WHEN srk=1 THEN reward END) AS routing_reward,
    max(CASE WHEN srk=1 THEN score END)-max(CASE WHEN srk=2 THEN score END) AS margin,
    least(1,greatest(0,max(CASE WHEN rrk=1 THEN reward END)-max(CASE WHEN rrk=2 THEN reward END))) AS reward_gap,
    max(CASE WHEN rrk=1 THEN reward END)-max(CASE WHEN srk=1 THEN reward END) AS regret
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS srk,
          row_number() OVER (PARTITION BY id ORDER BY reward DESC, model) AS rrk FROM aw) GROUP BY id)"""
# the same audit over score = alpha * sigmoid(logit) - (1 - alpha) * implied cost
AP = """ap AS (SELECT id, model, reward, CAST(0.85 AS DOUBLE)*(1/(1+exp(-least(30,greatest(-30,logit)))))
    -(1-CAST(0.85 AS DOUBLE))*greatest(0,(CAST(0.85 AS DOUBLE)*performance-reward)/(1-CAST(0.85 AS DOUBLE))) AS score FROM aw)"""
AUDIT_P = AUDIT.replace("audit AS", "auditp AS").replace("FROM aw)", "FROM ap)")
REWARDS = ("panel", "den", "rw", "alpha", AW)


def logits(df: DataFrame) -> DataFrame:
    return C.add_field(df, "logit", lambda c: (c["score"] - F.lit(0.5)) * 8)


# --- policy reward and audits -------------------------------------------------------

@register(
    "d1_denominators",
    sql("panel", "den", body="""SELECT 'global-max' AS method, round(g,8) AS denominator FROM den UNION ALL SELECT 'mean-row-max', round(r,8) FROM den"""),
)
def d1(spark, sf):
    panel = X.panel(spark, sf)
    part = lambda m: R.denominator_table(panel, m).select(F.lit(m).alias("method"), "denominator")
    return _r(part("global-max").unionByName(part("mean-row-max")), "denominator")


@register(
    "d1_sparse_denominators",
    sql("sparse", body="""SELECT 'global-max' AS method, round(max(cost),4) AS denominator FROM sparse
        UNION ALL SELECT 'mean-row-max', round(avg(mx),4) FROM (SELECT max(cost) AS mx FROM sparse GROUP BY id)"""),
)
def d1_sparse(spark, sf):
    panel = X.sparse_panel(spark, sf)
    part = lambda m: R.denominator_table(panel, m).select(F.lit(m).alias("method"), "denominator")
    return _r(part("global-max").unionByName(part("mean-row-max")), "denominator", digits=4)


@register(
    "d2_policy_reward",
    sql("panel", "den", "rw", "base", body="SELECT round(avg(reward),8) AS policy_reward, count(*) AS n FROM rw r JOIN base b ON r.id=b.id AND r.model=b.pred_model"),
)
def d2(spark, sf):
    return _r(A.policy_reward(rewarded(spark, sf), X.base_decisions(spark, sf)), "policy_reward")


@register(
    "d2_policy_reward_row_max",
    sql("panel", "base", body="""SELECT round(CAST(0.85 AS DOUBLE)*avg(performance)-(1-CAST(0.85 AS DOUBLE))*avg(cost/mx),8) AS policy_reward, count(*) AS n
        FROM (SELECT *, max(cost) OVER (PARTITION BY id) AS mx FROM panel) p JOIN base b ON p.id=b.id AND p.model=b.pred_model"""),
)
def d2_row_max(spark, sf):
    return _r(A.policy_reward_metric(X.panel(spark, sf), X.base_decisions(spark, sf), "row-max"), "policy_reward")


_METRICS = """SELECT round(avg(routing_reward),8) AS routing_reward, round(avg(oracle_reward),8) AS oracle_reward,
    round(avg(oracle_reward)-avg(routing_reward),8) AS routing_regret,
    round(avg(CASE WHEN selected=oracle THEN 1.0::DOUBLE ELSE 0 END),8) AS top1_accuracy, count(*) AS n FROM """


@register("d3_routing_metrics", sql(*REWARDS, AUDIT, body=_METRICS + "audit"))
def d3(spark, sf):
    out = A.routing_metrics(A.audit_rows(rewarded(spark, sf)))
    return _r(out, "routing_reward", "oracle_reward", "routing_regret", "top1_accuracy")


@register("d3_performance_metrics", sql(*REWARDS, AP, AUDIT_P, body=_METRICS + "auditp"))
def d3_performance(spark, sf):
    out = A.routing_metrics(A.performance_audit(logits(rewarded(spark, sf))))
    return _r(out, "routing_reward", "oracle_reward", "routing_regret", "top1_accuracy")


_AUDIT_COLUMNS = ("oracle_reward", "routing_reward", "margin", "reward_gap", "regret")
_AUDIT_SELECT = "SELECT id, selected, oracle, " + ", ".join(f"round({c},8) AS {c}" for c in _AUDIT_COLUMNS) + " FROM "


@register("d4_audit_rows", sql(*REWARDS, AUDIT, body=_AUDIT_SELECT + "audit"))
def d4(spark, sf):
    return _r(A.audit_rows(rewarded(spark, sf)), *_AUDIT_COLUMNS)


@register("d4_performance_audit", sql(*REWARDS, AP, AUDIT_P, body=_AUDIT_SELECT + "auditp"))
def d4_performance(spark, sf):
    return _r(A.performance_audit(logits(rewarded(spark, sf))), *_AUDIT_COLUMNS)


@register(
    "d5_summary_by_model",
    sql(*REWARDS, AUDIT, body="""SELECT m.model, (SELECT count(*) FROM audit WHERE selected=m.model) AS selection_count,
        (SELECT count(*) FROM audit WHERE oracle=m.model) AS oracle_count, (SELECT round(avg(regret),8) FROM audit WHERE selected=m.model) AS mean_regret
        FROM (SELECT DISTINCT model FROM panel UNION ALL SELECT 'Model_Z') m"""),
)
def d5(spark, sf):
    return _r(A.summary_by_model(A.audit_rows(rewarded(spark, sf)), [*MODELS, "Model_Z"]), "mean_regret")


_Q = ", ".join(str(q) for q in A.QUANTILES)


@register(
    "d5_quantiles",
    sql(*REWARDS, AUDIT, body="SELECT metric, q, round(value,8) AS value FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, unnest([{_Q}])::DOUBLE AS q, unnest(quantile_cont({c}, [{_Q}])) AS value FROM audit" for c in ("margin", "reward_gap", "regret")) + ")"),
)
def d5_quantiles(spark, sf):
    return _r(A.quantile_table(A.audit_rows(rewarded(spark, sf)), ["margin", "reward_gap", "regret"]), "value")


@register(
    "d6_range_weights",
    sql("panel", "den", "rw", body="""SELECT id, round(CAST(0.05 AS DOUBLE)+(1-CAST(0.05 AS DOUBLE))*least(1,greatest(0,s/(SELECT quantile_cont(s,0.9) FROM
        (SELECT max(reward)-min(reward) AS s FROM rw GROUP BY id)))),8) AS row_weight FROM (SELECT id, max(reward)-min(reward) AS s FROM rw GROUP BY id)"""),
)
def d6_range(spark, sf):
    return _r(W.range_weights(rewarded(spark, sf)).select("id", "row_weight"), "row_weight")


GAPS = """gaps AS (SELECT id, least(1,greatest(0,max(CASE WHEN rk=1 THEN reward END)-max(CASE WHEN rk=2 THEN reward END))) AS g FROM ranked GROUP BY id),
    gw AS (SELECT id, g, CAST(0.1 AS DOUBLE)+(1-CAST(0.1 AS DOUBLE))*least(1,greatest(0,g/(SELECT quantile_cont(g,0.9) FROM gaps))) AS row_weight FROM gaps)"""


@register(
    "d4_audit_cells",
    sql(*REWARDS, "ranked", GAPS, body="""SELECT t.id, CAST(row_number() OVER (PARTITION BY t.id ORDER BY model)-1 AS INTEGER) AS pos,
        round(te/sum(te) OVER (PARTITION BY t.id),8) AS target, round(pe/sum(pe) OVER (PARTITION BY t.id),8) AS probability, round(row_weight,8) AS row_weight
        FROM (SELECT id, model, exp((reward-max(reward) OVER (PARTITION BY id))/CAST(0.05 AS DOUBLE)) AS te,
          exp((score-max(score) OVER (PARTITION BY id))/CAST(0.05 AS DOUBLE)) AS pe FROM aw) t JOIN gw ON gw.id=t.id"""),
)
def d4_cells(spark, sf):
    """What an audit keeps of every cell: targets, probabilities and the row's weight."""
    panel = N.row_softmax(W.gap_weights(rewarded(spark, sf)), "reward", 0.05, out="target")
    panel = N.row_softmax(panel, "score", 0.05, out="probability")
    rows = A.audit_rows(panel, keep=("id", "row_weight"), fields=("target", "probability"))
    zipped = F.posexplode(F.arrays_zip("target", "probability")).alias("pos", "e")
    out = rows.select("id", "row_weight", zipped).select("id", "pos", "e.target", "e.probability", "row_weight")
    return _r(out, "target", "probability", "row_weight")


@register(
    "d5_row_weight_quantiles",
    sql("panel", "den", "rw", "ranked", GAPS, body=f"""SELECT 'row_weight' AS metric, q, round(value,8) AS value FROM
        (SELECT unnest([{_Q}])::DOUBLE AS q, unnest(quantile_cont(row_weight, [{_Q}])) AS value FROM gw)"""),
)
def d5_row_weights(spark, sf):
    return _r(A.quantile_table(W.gap_weights(rewarded(spark, sf)), ["row_weight"]), "value")


@register(
    "d6_gap_weights",
    sql("panel", "den", "rw", "ranked", GAPS, body="SELECT id, round(row_weight,8) AS row_weight, round(g,8) AS raw_weight FROM gw"),
)
def d6_gap(spark, sf):
    scaled = W.gap_weights(rewarded(spark, sf))
    raw = W.raw_gap_weights(scaled.withColumnRenamed("row_weight", "scaled"))
    return _r(raw.select("id", F.col("scaled").alias("row_weight"), F.col("row_weight").alias("raw_weight")), "row_weight", "raw_weight")


@register(
    "d7_soft_oracle_labels",
    sql("panel", "den", "rw", "ranked", GAPS, body="""SELECT t.id, t.model, round(e/sum(e) OVER (PARTITION BY t.id),8) AS target, round(reward,8) AS reward, round(row_weight,8) AS row_weight
        FROM (SELECT id, model, reward, exp((reward-max(reward) OVER (PARTITION BY id))/CAST(0.05 AS DOUBLE)) AS e FROM rw) t JOIN gw ON gw.id=t.id"""),
)
def d7(spark, sf):
    out = W.unpack(W.pack(W.soft_oracle_labels(rewarded(spark, sf))))
    return _r(C.to_long(out, "target", "reward", keep=("id", "row_weight")), "target", "reward", "row_weight")


@register(
    "d7_performance_labels",
    sql("panel", "den", "rw", body="""SELECT r.id, model, performance AS target, round(reward,8) AS reward, round(CAST(0.05 AS DOUBLE)+(1-CAST(0.05 AS DOUBLE))*
        least(1,greatest(0,s/(SELECT quantile_cont(s,0.9) FROM (SELECT max(reward)-min(reward) AS s FROM rw GROUP BY id)))),8) AS row_weight
        FROM rw r JOIN (SELECT id, max(reward)-min(reward) AS s FROM rw GROUP BY id) g ON g.id=r.id"""),
)
def d7_performance(spark, sf):
    out = W.unpack(W.pack(W.performance_labels(rewarded(spark, sf))))
    return _r(C.to_long(out, "target", "reward", keep=("id", "row_weight")), "reward", "row_weight")


@register(
    "d8_routing_aware_loss",
    sql(*REWARDS, "ranked", GAPS, """sc AS (SELECT aw.id, model, reward, performance, logit, row_weight,
          CAST(0.85 AS DOUBLE)*(1/(1+exp(-logit)))-(1-CAST(0.85 AS DOUBLE))*greatest(0,(CAST(0.85 AS DOUBLE)*performance-reward)/(1-CAST(0.85 AS DOUBLE))) AS s
          FROM aw JOIN gw ON gw.id=aw.id)""",
        """bce AS (SELECT sum(b*row_weight)/greatest(sum(row_weight),1e-6) AS bce_loss FROM (SELECT id, max(row_weight) AS row_weight,
          avg(greatest(logit,0)+ln(1+exp(-abs(logit)))-logit*performance) AS b FROM sc GROUP BY id))""",
        """pr AS (SELECT a.row_weight AS w, abs(a.reward-b.reward) AS g, -sign(a.reward-b.reward)*(a.s-b.s)/CAST(0.05 AS DOUBLE) AS x
          FROM sc a JOIN sc b ON a.id=b.id AND a.model<b.model WHERE abs(a.reward-b.reward)>=1e-4)""",
        body="""SELECT round(bce_loss+r,8) AS total_loss, round(bce_loss,8) AS bce_loss, round(r,8) AS ranking_loss FROM bce,
          (SELECT sum((greatest(x,0)+ln(1+exp(-abs(x))))*g*w)/sum(g*w) AS r FROM pr)"""),
)
def d8(spark, sf):
    panel = W.gap_weights(logits(rewarded(spark, sf)))
    labels = C.add_field(panel, "target", lambda c: c["performance"])
    return _r(A.routing_aware_loss(labels), "total_loss", "bce_loss", "ranking_loss")


@register(
    "d9_soft_oracle_loss",
    sql(*REWARDS, "ranked", GAPS, """st AS (SELECT aw.id, row_weight, logit-max(logit) OVER (PARTITION BY aw.id) AS z,
          exp((reward-max(reward) OVER (PARTITION BY aw.id))/CAST(0.05 AS DOUBLE)) AS e FROM aw JOIN gw ON gw.id=aw.id)""",
        "st2 AS (SELECT id, row_weight, e/sum(e) OVER (PARTITION BY id) AS t, z-ln(sum(exp(z)) OVER (PARTITION BY id)) AS lp FROM st)",
        body="""SELECT round(sum(kl*w)/greatest(sum(w),1e-6),8) AS kl_loss FROM (SELECT max(row_weight) AS w,
          sum(CASE WHEN t>0 THEN t*(ln(t)-lp) ELSE 0 END) AS kl FROM st2 GROUP BY id)"""),
)
def d9(spark, sf):
    from signalbox.operators.normalize import row_softmax

    soft = row_softmax(logits(rewarded(spark, sf)), "reward", 0.05, out="target")
    return _r(A.soft_oracle_loss(W.gap_weights(soft)), "kl_loss")


# --- priors ------------------------------------------------------------------------------

PROMPTED_REWARD = (
    "panel", "den", "rw", "prompted",
    f"tasks AS (SELECT id, {TASK_SQL} AS task FROM prompted)",
    f"profiles AS (SELECT id, query, k, d, split_part(k,'/',1) AS domain FROM (SELECT id, query, {PROFILE_SQL} AS k, {LEVEL_SQL} AS d FROM prompted))",
)
PRIORS = """gp AS (SELECT model, avg(reward) AS g FROM rw GROUP BY model),
    tp AS (SELECT task, r.model, count(*) AS n, (sum(reward)+20*max(g))/(count(*)+20) AS prior
      FROM rw r JOIN tasks t ON t.id=r.id JOIN gp ON gp.model=r.model GROUP BY task, r.model)"""


def prompted_rewards(spark, sf) -> DataFrame:
    return R.add_reward(X.prompted_panel(spark, sf), "mean-row-max")


@register(
    "d10_task_priors",
    sql(*PROMPTED_REWARD, PRIORS, body=f"""SELECT names.task, gp.model, coalesce(n,0) AS n, round(coalesce(prior,g),8) AS prior, round(g,8) AS global_prior
        FROM (SELECT unnest({list(TASK_NAMES)}) AS task) names CROSS JOIN gp LEFT JOIN tp ON tp.task=names.task AND tp.model=gp.model"""),
)
def d10(spark, sf):
    tagged = prompted_rewards(spark, sf).withColumn("task", task_label(F.col("query"))).drop("query")
    return _r(P.task_priors(tagged), "prior", "global_prior")


HIER = """gp AS (SELECT model, avg(reward) AS g, count(*) AS n FROM rw GROUP BY model),
    keyed AS (SELECT r.id, r.model, reward, g, unnest(['profile','subtask','domain']) AS level, unnest([k||'/'||d, k, domain]) AS key
      FROM rw r JOIN profiles p ON p.id=r.id JOIN gp ON gp.model=r.model),
    hier AS (SELECT level, key, model, count(*) AS n, (sum(reward)+50*max(g))/(count(*)+50) AS prior FROM keyed GROUP BY level, key, model
      UNION ALL SELECT 'global', '__global__', model, n, g FROM gp)"""


@register("d11_hierarchical_priors", sql(*PROMPTED_REWARD, HIER, body="SELECT level, key, model, n, round(prior,8) AS prior FROM hier"))
def d11(spark, sf):
    return _r(P.hierarchical_priors(with_task_profile(prompted_rewards(spark, sf)).drop("query")), "prior")


BACKOFF = """backoff AS (SELECT p.id, p.domain, gp.model, CASE WHEN h1.prior IS NOT NULL THEN 'profile' WHEN h2.prior IS NOT NULL THEN 'subtask'
      WHEN h3.prior IS NOT NULL THEN 'domain' ELSE 'global' END AS prior_level, coalesce(h1.prior,h2.prior,h3.prior,gp.g) AS prior
    FROM profiles p CROSS JOIN gp
    LEFT JOIN hier h1 ON h1.level='profile' AND h1.key=p.k||'/'||p.d AND h1.model=gp.model AND h1.n>=20
    LEFT JOIN hier h2 ON h2.level='subtask' AND h2.key=p.k AND h2.model=gp.model AND h2.n>=20
    LEFT JOIN hier h3 ON h3.level='domain' AND h3.key=p.domain AND h3.model=gp.model AND h3.n>=20)"""


def profiled_rewards(spark, sf) -> DataFrame:
    """Rewards and task profile without the text, written once for the scans that follow."""
    return durable(with_task_profile(prompted_rewards(spark, sf)).drop("query"))


def tagged_rewards(spark, sf) -> DataFrame:
    """Rewards and task label without the text, written once for the scans that follow."""
    return durable(prompted_rewards(spark, sf).withColumn("task", task_label(F.col("query"))).drop("query"))


def _backed_off(spark, sf) -> DataFrame:
    panel = profiled_rewards(spark, sf)
    return P.backoff_priors(panel, P.hierarchical_priors(panel))


@register("d11_backoff_priors", sql(*PROMPTED_REWARD, HIER, BACKOFF, body="SELECT id, prior_level, model, round(prior,8) AS score FROM backoff"))
def d11_backoff(spark, sf):
    out = _backed_off(spark, sf).select("id", "prior_level", F.col("prior_cells").alias("cells"))
    return _r(C.to_long(out, "score", keep=("id", "prior_level")), "score")


@register(
    "d12_prior_blend",
    sql(*PROMPTED_REWARD, HIER, BACKOFF, body="""SELECT b.id, b.model, round((1-w)*reward+w*prior,8) AS score FROM
        (SELECT *, CASE WHEN domain='coding' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS w FROM backoff) b JOIN rw r ON r.id=b.id AND r.model=b.model"""),
)
def d12(spark, sf):
    scored = C.add_field(_backed_off(spark, sf), "score", lambda c: c["reward"])
    return _r(C.to_long(P.blend_with_prior(scored, 0.15, {"coding": 0.30}), "score"), "score")


SUMMARY = """summary AS (SELECT m.model, coalesce(label_count,0) AS label_count, mean_reward, mean_performance, mean_cost FROM
    (SELECT model, avg(reward) AS mean_reward, avg(performance) AS mean_performance, avg(cost) AS mean_cost FROM rw GROUP BY model) m
    LEFT JOIN (SELECT model, count(*) AS label_count FROM ranked WHERE rk=1 GROUP BY model) l ON l.model=m.model)"""


@register(
    "d13_training_summary",
    sql("panel", "den", "rw", "ranked", SUMMARY, body="""SELECT model, label_count, round(mean_reward,8) AS mean_reward,
        round(mean_performance,8) AS mean_performance, round(mean_cost,8) AS mean_cost FROM summary"""),
)
def d13(spark, sf):
    return _r(A.training_summary(rewarded(spark, sf)), "mean_reward", "mean_performance", "mean_cost")


FAMILY = r"""fam AS (SELECT r.model AS label, count(*) AS n FROM ranked r JOIN prompted p ON p.id=r.id AND r.rk=1
    AND regexp_full_match(trim(p.query, chr(32)||chr(10)), 'ARC-AGI Task [0-9a-fA-F]+') GROUP BY r.model)"""


def family(spark, sf) -> DataFrame:
    return P.family_counts(D.labelled_margins(prompted_rewards(spark, sf)))


@register(
    "d14_family_prior",
    sql("panel", "den", "rw", "ranked", "prompted", FAMILY, body="""SELECT CAST(sum(n) AS BIGINT) AS family_size,
        (SELECT label FROM fam ORDER BY n DESC, label DESC LIMIT 1) AS majority_label FROM fam"""),
)
def d14(spark, sf):
    return P.family_prior(family(spark, sf))


@register(
    "d15_fixed_cost_scores",
    sql(*REWARDS, body="""SELECT s.id, s.model, round(CAST(0.85 AS DOUBLE)*least(1,greatest(0,s.score))-(1-CAST(0.85 AS DOUBLE))*f.c,8) AS score
        FROM alpha s JOIN (SELECT model, avg(norm_cost) AS c FROM rw GROUP BY model) f ON f.model=s.model"""),
)
def d15(spark, sf):
    panel = C.add_field(rewarded(spark, sf), "performance", lambda c: c["score"])
    return _r(C.to_long(P.fixed_cost_scores(panel, P.fixed_model_cost(panel)), "score"), "score")


@register(
    "d15_train_mean_fallback",
    sql(*REWARDS, body="""SELECT a.id, a.model, CASE WHEN a.id%3=0 THEN 'scorer' ELSE 'train_mean' END AS router_source,
        round(CASE WHEN a.id%3=0 THEN a.score ELSE g.m END,8) AS score FROM aw a JOIN (SELECT model, avg(reward) AS m FROM rw GROUP BY model) g ON g.model=a.model"""),
)
def d15_fallback(spark, sf):
    panel = rewarded(spark, sf)
    scored = C.keep_fields(panel.where(F.col("id") % 3 == 0), "score").select("id", "cells")
    out = P.fill_from_train_mean(panel.select("id"), scored, P.global_prior(panel))
    return _r(C.to_long(out, "score", keep=("id", "router_source")), "score")


# --- boards and remaining metrics ------------------------------------------------------

SEEDS = (42, 43, 44)
SEEDED = """seeded AS (SELECT seed, doc_id AS id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed||':'||doc_id), doc_id)
      <= greatest(1, round_even(count(*) OVER (PARTITION BY seed)*CAST(0.2 AS DOUBLE), 0)) AS held
      FROM documents CROSS JOIN (SELECT unnest([42,43,44]) AS seed) s)"""
PRIOR_CV = """sgp AS (SELECT seed, model, avg(reward) AS g FROM rw r JOIN seeded s ON s.id=r.id AND NOT held GROUP BY seed, model),
    stp AS (SELECT s.seed, task, r.model, (sum(reward)+20*max(g))/(count(*)+20) AS prior FROM rw r JOIN seeded s ON s.id=r.id AND NOT held
      JOIN tasks t ON t.id=r.id JOIN sgp ON sgp.seed=s.seed AND sgp.model=r.model GROUP BY s.seed, task, r.model),
    held AS (SELECT s.seed, s.id, sgp.model, coalesce(prior,g) AS score FROM seeded s JOIN tasks t ON t.id=s.id JOIN sgp ON sgp.seed=s.seed
      LEFT JOIN stp ON stp.seed=s.seed AND stp.task=t.task AND stp.model=sgp.model WHERE s.held),
    picked AS (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY score DESC, model) AS rk FROM held),
    board AS (SELECT 'task_prior' AS method, seed, avg(reward) AS reward FROM picked p JOIN rw r ON r.id=p.id AND r.model=p.model AND rk=1 GROUP BY seed
      UNION ALL SELECT 'oracle', s.seed, avg(reward) FROM seeded s JOIN ranked r ON r.id=s.id AND r.rk=1 AND held GROUP BY s.seed)"""


def prior_cv_board(spark, sf) -> DataFrame:
    """Task-prior router and oracle on held-out rows of every seed, all seeds in one job.

    The seed is one more grouping key: priors per (seed, task), lookups by (seed, task).
    """
    tagged = tagged_rewards(spark, sf)
    seeded = J.seeded_holdouts(tagged, 0.2, SEEDS)
    keyed = seeded.withColumn("task", F.concat_ws("|", "seed", "task"))
    fit, held = keyed.where(~F.col("held_out")), keyed.where("held_out")
    sums = (
        C.to_long(fit, "reward", keep=("seed", "task"))
        .groupBy("seed", "task", "model")
        .agg(F.sum("reward").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    overall = sums.groupBy("seed", "model").agg((F.sum("s") / F.sum("n")).alias("g"))
    names = F.explode(F.lit(list(TASK_NAMES)))
    grid = overall.withColumn("t", names).withColumn("task", F.concat_ws("|", "seed", "t"))
    joined = grid.join(sums.drop("seed"), ["task", "model"], "left")
    n = F.coalesce("n", F.lit(0))
    prior = F.when(n > 0, (F.col("s") + 20.0 * F.col("g")) / (n + 20.0)).otherwise(F.col("g"))
    cells = C.from_long(joined.select("task", "model", prior.alias("score")), "score", keys=("task",))
    picks = D.decide(cells, "score", ("task",), "pick").select("task", "pick")
    # One row per seed and task label.
    looked_up = held.join(F.broadcast(picks), "task")
    best = C.best(F.col("cells"), "reward")["value"]
    rows = looked_up.select("seed", C.value_of(F.col("cells"), F.col("pick"), "reward").alias("routed"), best.alias("oracle"))
    means = rows.groupBy("seed").agg(F.avg("routed").alias("task_prior"), F.avg("oracle").alias("oracle"))
    return means.unpivot(["seed"], ["task_prior", "oracle"], "method", "reward")


@register(
    "d16_cv_summary",
    sql(*PROMPTED_REWARD, "ranked", SEEDED, PRIOR_CV, body="""SELECT method, round(avg(reward),8) AS mean, round(stddev_samp(reward),8) AS std,
        round(min(reward),8) AS min, round(max(reward),8) AS max, count(*) AS n FROM board GROUP BY method"""),
)
def d16(spark, sf):
    return _r(A.cv_summary(prior_cv_board(spark, sf)), "mean", "std", "min", "max")


@register(
    "d17_residuals",
    sql(*REWARDS, body="SELECT id, model, round(reward-(score+CASE WHEN model='Model_B' THEN CAST(0.02 AS DOUBLE) ELSE 0 END),8) AS residual FROM aw"),
)
def d17(spark, sf):
    biases = spark.createDataFrame([("Model_B", 0.02)], "model STRING, bias DOUBLE")
    return _r(C.to_long(A.residuals(rewarded(spark, sf), biases), "residual"), "residual")


@register(
    "d18_regression_metrics",
    sql(*REWARDS, body="SELECT round(avg((score-reward)*(score-reward)),8) AS mse, round(avg(abs(score-reward)),8) AS mae, count(*) AS n FROM aw"),
)
def d18(spark, sf):
    return _r(A.regression_metrics(C.to_long(rewarded(spark, sf), "score", "reward"), "score", "reward"), "mse", "mae")


@register(
    "d19_token_scores",
    """SELECT id, model AS pred_model, round(s,8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, model) AS rk FROM
       (SELECT l_orderkey AS id, 'Model_'||chr(CAST(65+l_linenumber%3 AS INTEGER)) AS model, avg(-l_quantity/64) AS s FROM lineitem GROUP BY ALL)) WHERE rk=1""",
)
def d19(spark, sf):
    # An order line stands for one token of a label's log-probability.
    tokens = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.lit("Model_"), F.char(65 + F.col("l_linenumber") % 3)).alias("label"),
        (-F.col("l_quantity") / 64).alias("logprob"),
    )
    return _r(D.decide(A.token_scores(tokens)), "score")


@register(
    "d20_collapse_report",
    sql(*REWARDS, AUDIT, body="""SELECT round(max(n)/sum(n),8) AS max_selection_share, (SELECT selected FROM audit GROUP BY selected ORDER BY count(*) DESC, selected DESC LIMIT 1) AS most_selected,
        round(sum(near)/sum(n),8) AS near_zero_margin_share, count(*) AS models_selected FROM
        (SELECT selected, count(*) AS n, count(*) FILTER (WHERE margin<=CAST(0.01 AS DOUBLE)) AS near FROM audit GROUP BY selected)"""),
)
def d20(spark, sf):
    return _r(A.collapse_report(A.audit_rows(rewarded(spark, sf))), "max_selection_share", "near_zero_margin_share")


@register(
    "d20_selection_drift",
    sql("alpha", "base", body="""SELECT coalesce(a.model,b.model) AS model, round(coalesce(a.s,0),8) AS train_share, round(coalesce(b.s,0),8) AS test_share,
        round(coalesce(b.s,0)-coalesce(a.s,0),8) AS shift FROM (SELECT pred_model AS model, count(*)/sum(count(*)) OVER () AS s FROM base GROUP BY 1) a
        FULL JOIN (SELECT model, count(*)/sum(count(*)) OVER () AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM alpha) WHERE rk=1 GROUP BY model) b
        ON a.model=b.model"""),
)
def d20_drift(spark, sf):
    out = A.selection_drift(X.base_decisions(spark, sf), D.decide(X.scores(spark, sf)))
    return _r(out, "train_share", "test_share", "shift")


@register(
    "d20_selection_ratio",
    sql(*REWARDS, AUDIT, body="""SELECT m.model, s AS selection_count, o AS oracle_count, round(s/nullif(o,0),8) AS ratio FROM (SELECT DISTINCT model FROM panel) m,
        LATERAL (SELECT count(*) FILTER (WHERE selected=m.model) AS s, count(*) FILTER (WHERE oracle=m.model) AS o FROM audit)"""),
)
def d20_ratio(spark, sf):
    return _r(A.selection_ratio(A.audit_rows(rewarded(spark, sf)), MODELS), "ratio")


# --- alignment -----------------------------------------------------------------------------

@register("e1_align_scores", sql("alpha", body="SELECT id, model, score, CAST(ascii(model[7])-65 AS INTEGER) AS place FROM alpha WHERE model<'Model_H'"))
def e1(spark, sf):
    backwards = X.scores(spark, sf).withColumn("cells", F.reverse("cells"))
    aligned = L.align_scores(backwards, MODELS[:7])
    rows = aligned.select("id", F.posexplode_outer("cells").alias("place", "c"))
    return rows.select("id", F.col("c.model").alias("model"), F.col("c.score").alias("score"), "place")


@register(
    "e2_id_alignment",
    """SELECT count(*) FILTER (WHERE b.id IS NULL) AS only_left, count(*) FILTER (WHERE a.id IS NULL) AS only_right, CAST(0 AS BIGINT) AS repeated_left,
       count(*) FILTER (WHERE nb>1) AS repeated_right, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS shared
       FROM (SELECT doc_id AS id FROM documents) a FULL JOIN (SELECT l_orderkey AS id, count(*) AS nb FROM lineitem GROUP BY 1) b ON a.id=b.id""",
)
def e2(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return L.id_mismatches(X.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), lines)


@register(
    "e3_gather_cells",
    sql("panel", "den", "rw", "base", body="SELECT b.id, b.pred_model, round(reward,8) AS value FROM base b JOIN rw r ON r.id=b.id AND r.model=b.pred_model"),
)
def e3(spark, sf):
    return _r(D.gather(rewarded(spark, sf), X.base_decisions(spark, sf), "reward"), "value")


@register(
    "e4_prior_lookup",
    sql(*PROMPTED_REWARD, PRIORS, body="""SELECT q.id, gp.model, round(coalesce(prior,g),8) AS score FROM
        (SELECT id, CASE WHEN id%5=0 THEN 'unheard' ELSE task END AS task FROM tasks) q CROSS JOIN gp LEFT JOIN tp ON tp.task=q.task AND tp.model=gp.model"""),
)
def e4(spark, sf):
    tagged = tagged_rewards(spark, sf)
    odd = F.when(F.col("id") % 5 == 0, "unheard").otherwise(F.col("task"))
    out = P.lookup_task_priors(tagged.select("id", odd.alias("task")), P.task_priors(tagged), P.global_prior(tagged))
    return _r(C.to_long(out, "score"), "score")


@register(
    "e5_model_pairs",
    sql("panel", "den", "rw", body="""SELECT a.id, a.model AS model_i, b.model AS model_j, round(a.reward,8) AS reward_i, round(b.reward,8) AS reward_j
        FROM rw a JOIN rw b ON a.id=b.id AND a.model<b.model"""),
)
def e5(spark, sf):
    return _r(A.model_pairs(rewarded(spark, sf), "reward"), "reward_i", "reward_j")


@register(
    "e6_decision_diff",
    sql("alpha", "base", body="""SELECT b.pred_model AS base_pred, s.model AS final_pred, count(*) AS n FROM base b JOIN
        (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM alpha) s ON s.id=b.id AND s.rk=1
        WHERE s.model<>b.pred_model GROUP BY ALL"""),
)
def e6(spark, sf):
    return D.decision_diff(X.base_decisions(spark, sf), D.decide(X.scores(spark, sf)))


# --- splits and validation ---------------------------------------------------------------

@register("j1_holdout", sql("split", body="SELECT id, held_out FROM split"))
def j1(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return J.holdout(docs, X.HELD, X.SPLIT_SEED)


@register(
    "j1_holdout_lines",
    """SELECT id, row_number() OVER (ORDER BY md5('7:'||id), id) <= greatest(1, floor(count(*) OVER ()*CAST(0.1 AS DOUBLE))) AS held_out
       FROM (SELECT CAST(l_orderkey*8+l_linenumber AS BIGINT) AS id FROM lineitem GROUP BY 1)""",
)
def j1_lines(spark, sf):
    lines = X.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).distinct()
    return J.holdout(lines, 0.1, 7, "floor")


@register(
    "j2_stratified_folds",
    sql("panel", "den", "rw", "ranked", body="""SELECT id, model AS label, CAST((row_number() OVER (PARTITION BY model ORDER BY md5('42:'||id), id)-1)%5 AS INTEGER) AS fold
        FROM ranked WHERE rk=1"""),
)
def j2(spark, sf):
    labelled = D.oracle(rewarded(spark, sf)).select("id", "label")
    return J.stratified_folds(labelled, 5, 42, digits=2)


@register(
    "j3_repeated_holdout",
    sql(*PROMPTED_REWARD, "ranked", SEEDED, PRIOR_CV, body="SELECT method, CAST(seed AS INTEGER) AS seed, round(reward,8) AS reward FROM board"),
)
def j3(spark, sf):
    return _r(prior_cv_board(spark, sf), "reward")


@register(
    "j5_validate_decisions",
    """WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id%17=0 THEN NULL WHEN doc_id%13=0 THEN 'Model_Q' ELSE 'Model_A' END AS pred_model FROM documents WHERE doc_id%19<>0
         UNION ALL SELECT doc_id, 'Model_B' FROM documents WHERE doc_id%29=0 UNION ALL SELECT doc_id+100000000, 'Model_C' FROM documents WHERE doc_id%31=0),
       per AS (SELECT id, count(*) AS n FROM d GROUP BY id)
       SELECT (SELECT count(*) FROM d) AS rows, (SELECT count(*) FROM documents) AS expected_rows,
         (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM d)) AS missing_ids, (SELECT count(*) FROM per WHERE id NOT IN (SELECT doc_id FROM documents)) AS extra_ids,
         (SELECT count(*) FROM per WHERE n>1) AS repeated_ids, (SELECT count(*) FROM d WHERE pred_model IS NULL) AS null_labels,
         (SELECT count(*) FROM d WHERE pred_model='Model_Q') AS bad_labels""",
)
def j5(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    label = F.when(F.col("id") % 17 == 0, None).when(F.col("id") % 13 == 0, "Model_Q").otherwise("Model_A")
    broken = (
        docs.where(F.col("id") % 19 != 0).select("id", label.alias("pred_model"))
        .unionByName(docs.where(F.col("id") % 29 == 0).select("id", F.lit("Model_B").alias("pred_model")))
        .unionByName(docs.where(F.col("id") % 31 == 0).select((F.col("id") + 100_000_000).alias("id"), F.lit("Model_C").alias("pred_model")))
    )
    return L.validate_decisions(broken, docs)
