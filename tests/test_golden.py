"""Literal cases: rewards, softmax, weights, losses, ties and guards."""

import math

import numpy as np
import pytest
from conftest import matrix
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.operators import audit as A
from signalbox.operators import decide as D
from signalbox.operators import labels as W
from signalbox.operators import normalize as N
from signalbox.operators import rewards as R

COST = [[1, 3, 2], [4, 2, 1]]
GAP_REWARD = [[0.9, 0.5, 0.1], [2.0, 0.2, -1.0], [0.4, 0.4, 0.0]]


def one(df):
    return df.first()[0]


def test_denominators(panel):
    p = panel(cost=COST)
    assert one(R.denominator_table(p, "mean-row-max")) == 3.5
    assert one(R.denominator_table(p, "global-max")) == 4.0
    with pytest.raises(ValueError):
        R.denominator_table(p, "median")


def test_zero_denominator_guards(panel):
    p = panel(cost=[[0, 0]])
    assert one(R.denominator_table(p, "global-max", "one")) == 1.0
    assert one(R.denominator_table(p, "global-max", "eps")) == 1e-12


@pytest.mark.parametrize("method", R.COST_NORMS)
def test_flat_costs_never_divide_by_zero(panel, method):
    values = matrix(R.normalize_cost(panel(cost=[[0, 0], [0, 0]]), method), "norm_cost")
    assert values == [[0.0, 0.0], [0.0, 0.0]]


def test_softmax_golden(panel):
    out = matrix(N.row_softmax(panel(reward=[[0.2, 0.4, 0.1], [0.8, -0.1, 0.3]]), "reward", 0.05), "probability")
    assert np.allclose(out[0], [0.0179425348, 0.979629207, 0.00242825803], rtol=1e-7)
    assert np.allclose(out[1], [0.999954587, 1.52292881e-08, 4.53978680e-05], rtol=1e-7)
    assert np.allclose(np.sum(out, axis=1), 1.0)


def test_softmax_temperature(panel):
    with pytest.raises(ValueError):
        N.row_softmax(panel(reward=[[1, 2]]), "reward", 0.0)
    floored = matrix(N.row_softmax(panel(reward=[[1, 2]]), "reward", 0.0, floor=1e-6), "probability")
    assert floored == [[0.0, 1.0]]


def test_clipped_gaps(panel):
    rows = D.margins(panel(reward=GAP_REWARD)).orderBy("id").collect()
    assert np.allclose([r.clipped_margin for r in rows], [0.4, 1.0, 0.0])


def test_gap_needs_two_models(panel):
    with pytest.raises(Exception, match="at least two"):
        D.margins(panel(reward=[[0.5]])).collect()


def test_row_weights(panel):
    p = panel(reward=GAP_REWARD)
    by_range = [r.row_weight for r in W.range_weights(p, 0.05).orderBy("id").collect()]
    by_gap = [r.row_weight for r in W.gap_weights(p).orderBy("id").collect()]
    assert np.allclose(by_range, [0.346875, 1.0, 0.1984375])
    assert np.allclose(by_gap, [0.5090909091, 1.0, 0.1])
    flat = W.range_weights(panel(reward=[[1, 1], [2, 2]]))
    assert [r.row_weight for r in flat.collect()] == [1.0, 1.0]


def test_pack_round_trip(spark):
    labels = spark.createDataFrame(
        [(0, [("Model_A", 0.7, 0.5), ("Model_B", 0.3, 0.2)], 0.3)],
        "id long, cells array<struct<model: string, target: double, reward: double>>, row_weight double",
    )
    packed = W.pack(labels)
    assert packed.first().packed == [0.7, 0.3, 0.5, 0.2, 0.3]
    back = W.unpack(packed).first()
    assert back.row_weight == 0.3 and [tuple(c) for c in back.cells] == [("Model_A", 0.7, 0.5), ("Model_B", 0.3, 0.2)]


def test_soft_oracle_loss(panel):
    target = [[0.8, 0.15, 0.05], [0.1, 0.2, 0.7]]
    log = [[math.log(x) for x in row] for row in target]
    loss = lambda logit, w: one(A.soft_oracle_loss(panel(logit=logit, target=target).withColumn("row_weight", F.lit(w))))
    assert abs(loss(log, 1.0)) < 1e-12
    assert loss([row[::-1] for row in log], 1.0) > 0.1
    assert loss(log, 0.0) == 0.0


def test_routing_loss_against_numpy(panel):
    rng = np.random.default_rng(3)
    logit, target, reward = rng.normal(size=(6, 4)), rng.uniform(size=(6, 4)), rng.uniform(size=(6, 4))
    weight = np.arange(1, 7) / 6.0
    p = panel(logit=logit, target=target, reward=reward).withColumn("row_weight", (F.col("id") + 1) / 6.0)
    got = A.routing_aware_loss(p).first()
    bce = (np.logaddexp(0, logit) - logit * target).mean(axis=1)
    bce_loss = (bce * weight).sum() / weight.sum()
    score = 0.85 / (1 + np.exp(-logit)) - 0.15 * np.maximum(0, (0.85 * target - reward) / 0.15)
    top, bottom = 0.0, 0.0
    for r in range(6):
        for i in range(4):
            for j in range(i + 1, 4):
                gap = reward[r, i] - reward[r, j]
                if abs(gap) >= 1e-4:
                    x = -np.sign(gap) * (score[r, i] - score[r, j]) / 0.05
                    top += np.logaddexp(0, x) * abs(gap) * weight[r]
                    bottom += abs(gap) * weight[r]
    assert np.allclose([got.bce_loss, got.ranking_loss], [bce_loss, top / bottom])
    flat = panel(logit=[[0, 0]], target=[[0.5, 0.5]], reward=[[1, 1]]).withColumn("row_weight", F.lit(1.0))
    assert A.routing_aware_loss(flat).first().ranking_loss == 0.0


def test_equivalent_weight():
    assert R.equivalent_cost_weight(1.3760199546813965, 0.077205403389806) == pytest.approx(0.758757581074221, abs=1e-12)


def test_first_model_wins_ties(panel):
    picks = D.decide(panel(score=[[1, 1, 0], [0, 2, 2]])).orderBy("id").collect()
    assert [p.pred_model for p in picks] == ["Model_A", "Model_B"]


def test_unknown_labels_are_errors(spark, panel):
    p = panel(reward=[[0.1, 0.9]])
    decisions = spark.createDataFrame([(0, "Model_Q")], "id long, pred_model string")
    with pytest.raises(Exception, match="unknown decision label"):
        A.policy_reward(p, decisions).collect()
    assert A.policy_reward(p, decisions, strict=False).first().policy_reward is None
    with pytest.raises(ValueError):
        D.constant_policy(p, "Model_Q", ["Model_A"])


def test_oracle_beats_every_policy(panel):
    rng = np.random.default_rng(0)
    p = panel(score=rng.normal(size=(50, 5)), reward=rng.normal(size=(50, 5)))
    rows = A.audit_rows(p)
    assert rows.where("regret < 0").count() == 0
    m = A.routing_metrics(rows).first()
    assert m.routing_regret == pytest.approx(m.oracle_reward - m.routing_reward)


def test_plug_in_weight_bounds(panel):
    p = C.add_field(panel(performance=[[1, 0]]), "z_cost", lambda c: F.lit(0.0))
    scaler = p.sparkSession.createDataFrame([("Model_A", 1.0, 1.0), ("Model_B", 2.0, 1.0)], "model string, cost_mean double, cost_std double")
    assert matrix(R.plug_in_scores(p, scaler, F.lit(2.0), 0.5), "score") == [[0.25, -0.5]]
    with pytest.raises(ValueError):
        R.plug_in_scores(p, scaler, F.lit(2.0), 1.5)
