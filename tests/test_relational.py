"""Quantiles, splits, calibration, ensembles, alignment and sources."""

import math

import numpy as np
import pytest
from conftest import matrix
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.operators import align as L
from signalbox.operators import audit as A
from signalbox.operators import calibrate as B
from signalbox.operators import decide as D
from signalbox.operators import ensemble as E
from signalbox.operators import priors as P
from signalbox.operators import splits as J
from signalbox.operators.quantiles import exact_quantiles
from signalbox.sources import tables as S

Q = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize(
    "values",
    [
        list(np.random.default_rng(0).normal(size=5000)),
        [1.0] * 2000 + list(np.linspace(0, 3, 1000)),
        [0.0, 1e-300, 1e300],
        [5.0],
        list(np.random.default_rng(1).exponential(size=3000) ** 9),
    ],
)
def test_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = exact_quantiles(df.withColumn("w", -F.col("v")), ["v", "w"], Q)
    assert np.allclose(got["v"], np.quantile(values, Q), rtol=1e-12)
    assert np.allclose(got["w"], np.quantile(-np.array(values), Q), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([], "v double"), ["v"], [0.5])


@pytest.mark.parametrize("n,fraction,rounding,want", [(10, 0.25, "round", 2), (10, 0.25, "floor", 2), (3, 0.01, "round", 1), (50, 0.5, "round", 25)])
def test_holdout_size(spark, n, fraction, rounding, want):
    flagged = J.holdout(spark.range(n), fraction, 1, rounding)
    assert flagged.where("held_out").count() == want and flagged.count() == n


def test_holdout_follows_the_hash(spark):
    import hashlib

    rows = J.holdout(spark.range(500), 0.2, 9).collect()
    order = sorted(range(500), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
    assert {r.id for r in rows if r.held_out} == set(order[:100])


def test_threshold_refines_prefixes(spark):
    keys = spark.range(3000).select(J.split_key(4).alias("key"), "id")
    want = keys.orderBy("key", "id").limit(777).agg(F.max(F.struct("key", "id")).alias("m")).first().m
    assert J._threshold(keys, 777, prefix=1, leaf=5) == (want.key, want.id)


def test_no_holdout_for_zero_fraction(spark):
    assert J.holdout(spark.range(5), 0.0, 1, "floor").where("held_out").count() == 0
    with pytest.raises(ValueError):
        J.holdout(spark.range(5), 0.0, 1)


def test_stratified_folds_are_balanced(spark):
    df = spark.range(300).withColumn("label", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 5)))
    counts = J.stratified_folds(df, 4, 7, digits=1).groupBy("label", "fold").count().collect()
    for label in {r.label for r in counts}:
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_seeds():
    assert J.cv_seeds("3, 5", 42, 9) == [3, 5]
    assert J.cv_seeds("", 42, 2) == [42, 43]


# --- calibration -------------------------------------------------------------------------

def direct(scores, reward, biases):
    pick = (scores + biases).argmax(axis=1)
    return reward[np.arange(len(pick)), pick].mean()


def test_bias_search_matches_direct_search(spark, panel):
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 10, size=(60, 4)) / 10.0  # many ties
    reward = rng.uniform(size=(60, 4))
    models = [f"Model_{c}" for c in "ABCD"]
    found = B.fit_biases(panel(score=scores, reward=reward), models, 0.2, 0.05, 2, 0.5)
    grid, biases, best = B.half_open_grid(0.2, 0.05), np.zeros(4), direct(scores, reward, np.zeros(4))
    assert found.reward_initial == pytest.approx(best)
    for _ in range(2):
        changed = False
        for j in range(4):
            local, value = best, biases[j]
            for g in grid:
                trial = biases.copy()
                trial[j] = g
                r = direct(scores, reward, trial)
                if r > local + 1e-12:
                    local, value = r, g
            if value != biases[j]:
                biases[j], best, changed = value, local, True
        if not changed:
            break
    assert found.searched == pytest.approx(list(biases))
    assert found.reward_searched == pytest.approx(best)
    assert found.reward_shrunk == pytest.approx(direct(scores, reward, biases * 0.5))
    assert found.reward_searched >= found.reward_initial


def test_grid_rewards_one_scan(spark, panel):
    rng = np.random.default_rng(8)
    scores, reward = rng.integers(0, 5, size=(40, 3)) / 5.0, rng.uniform(size=(40, 3))
    rows = B._compact(panel(score=scores, reward=reward), ["Model_A", "Model_B", "Model_C"])
    grid = [-0.4, -0.2, 0.0, 0.2, 0.4]
    for j in range(3):
        want = [direct(scores, reward, np.eye(3)[j] * g) for g in grid]
        assert B._grid_rewards(rows, [0.0, 0.0, 0.0], j, grid) == pytest.approx(want)


def test_coarse_to_fine_is_opt_in(panel):
    p = panel(score=[[0.6, 0.5], [0.1, 0.9]], reward=[[0, 1], [0, 1]])
    assert B.fit_biases_coarse_to_fine(p, ["Model_A", "Model_B"]) is None
    found = B.fit_biases_coarse_to_fine(p, ["Model_A", "Model_B"], enable=True)
    assert found.reward_searched == 1.0 and found.reward_initial == 0.5


def test_missing_calibration(spark, panel):
    biases = spark.createDataFrame([("Model_A", 0.1)], "model string, bias double")
    p = panel(score=[[1, 1]])
    with pytest.raises(Exception, match="missing model"):
        B.apply_biases(p, biases).collect()
    assert matrix(B.apply_biases(p, biases, strict=False), "score") == [[1.1, 1.0]]


# --- ensembles -----------------------------------------------------------------------------

def test_blend_weights(panel):
    assert E.normalized_weights(2) == [0.5, 0.5]
    for bad in ([1.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            E.normalized_weights(2, bad)
    a, b = panel(score=[[0, 1], [2, 1]]), panel(score=[[5, 5], [5, 9]])
    assert matrix(E.blend([a, b], [3, 1]), "score") == [[0.0, 0.0], [0.75, 0.25]]


def test_history_policies(spark):
    rows = [("a", "Complete", 0.5), ("a", "Complete", 0.6), ("b", "Complete", 0.55), ("c", "Error", 0.9), ("d", "Complete", None), ("e", "Complete", 0.1), ("f", "Complete", 0.55)]
    history = spark.createDataFrame(rows, "file_name string, status string, public_score double")
    names = lambda **k: [r.file_name for r in E.usable_history(history, **k).collect()]
    assert names() == ["b", "f"]
    assert names(duplicates="max") == ["a", "b", "f"]
    assert names(duplicates="all", top_n=0) == ["a", "b", "f", "a"]
    assert names(duplicates="max", top_n=1) == ["a"]
    weights = E.vote_weights(E.usable_history(history, duplicates="max")).collect()
    raw = [math.exp((s - 0.6) / 0.01) for s in (0.6, 0.55, 0.55)]
    assert [r.weight for r in weights] == pytest.approx([x / sum(raw) for x in raw])
    with pytest.raises(ValueError):
        E.vote_weights(history, 0.0)


def test_final_methods(spark):
    methods = ["word12_knn5", "word12_ridge", "char35_knn5", "charwb35_knn5", "other"]
    assert E.final_methods(methods, 3) == ["word12_knn5", "charwb35_knn5", "char35_knn5"]
    board = spark.createDataFrame([("other", 0.9), ("oracle", 1.0), ("word12_ridge", 0.5)], "method string, mean double")
    assert E.final_methods(methods, 4, board) == ["other", "word12_ridge", "word12_knn5", "char35_knn5"]
    assert E.candidate_sizes(4) == [1, 3, 4] and E.candidate_sizes(5) == [1, 3, 5]


def test_overrides_need_known_base(spark, panel):
    base = spark.createDataFrame([(0, "Model_Q")], "id long, pred_model string")
    with pytest.raises(Exception, match="unknown model"):
        D.versus_base(panel(score=[[1, 2]]), base).collect()


# --- alignment and validation -----------------------------------------------------------------

def test_alignment_errors(spark, panel):
    p = panel(score=[[1, 2]])
    with pytest.raises(Exception, match="missing models"):
        L.align_scores(p, ["Model_A", "Model_Q"]).collect()
    assert [c.model for c in L.align_scores(p, ["Model_B", "Model_A"]).first().cells] == ["Model_B", "Model_A"]
    bare = spark.createDataFrame([(0, [1.0, 2.0])], "id long, scores array<double>")
    assert matrix(L.named_by_order(bare, ["Model_A", "Model_B"]), "score") == [[1.0, 2.0]]
    with pytest.raises(Exception, match="unexpected score width"):
        L.named_by_order(bare, ["Model_A"]).collect()


def test_validator(spark):
    queries = spark.range(3)
    good = spark.createDataFrame([(0, "Model_A"), (1, "Model_K"), (2, "Model_C")], "id long, pred_model string")
    L.require_valid(good, queries)
    for bad in ([(0, "Model_A")], [(0, "Model_A"), (1, None), (2, "Model_C")], [(0, "Model_Z"), (1, "Model_A"), (2, "Model_A")]):
        with pytest.raises(ValueError):
            L.require_valid(spark.createDataFrame(bad, "id long, pred_model string"), queries)
    with pytest.raises(ValueError):
        L.require_same_ids(good, spark.range(4))
    a, b = good.repartition(3), good.orderBy(F.desc("id"))
    assert L.decision_checksum(a).first() == L.decision_checksum(b).first()


# --- priors ---------------------------------------------------------------------------------------

def test_task_prior_smoothing(spark):
    rows = [(0, "math", [("Model_A", 1.0)]), (1, "math", [("Model_A", 0.0)]), (2, "coding", [("Model_A", 0.8)])]
    p = spark.createDataFrame(rows, "id long, task string, cells array<struct<model: string, reward: double>>")
    got = {r.task: r.prior for r in P.task_priors(p, 20.0).collect()}
    g = 1.8 / 3
    assert got["math"] == pytest.approx((1.0 + 20 * g) / 22)
    assert got["coding"] == pytest.approx((0.8 + 20 * g) / 21)
    assert got["science"] == pytest.approx(g) and len(got) == 9


def test_family_majority_takes_the_last_label_on_ties(spark):
    rows = [("ARC-AGI Task 1", "Model_A"), ("ARC-AGI Task 2", "Model_C"), ("other", "Model_B")]
    counts = P.family_counts(spark.createDataFrame(rows, "query string, label string"))
    assert tuple(P.family_prior(counts).first()) == (2, "Model_C")


# --- sources ----------------------------------------------------------------------------------------

def test_discovery():
    assert S.model_names(["Model_B_performance", "Model_B_cost", "Model_A_cost", "Model_A_performance", "Model_C_performance"]) == ["Model_A", "Model_B"]
    with pytest.raises(ValueError):
        S.model_names(["Model_A_performance"])
    assert S.text_column(["ID", "text", "prompt"]) == "prompt"
    assert S.text_column(["ID", "text"], "ID") == "ID"
    for columns, wanted in ((["ID"], ""), (["ID"], "query")):
        with pytest.raises(ValueError):
            S.text_column(columns, wanted)


def test_null_cells_drop_out(spark):
    wide = spark.createDataFrame(
        [(1, "q", 0.5, 1.0, None, 2.0)],
        "ID long, query string, Model_A_performance double, Model_A_cost double, Model_B_performance double, Model_B_cost double",
    )
    assert [c.model for c in S.wide_to_panel(wide).first().cells] == ["Model_A"]
    assert {r.model: r.dropped for r in S.dropped_cells(wide).collect()} == {"Model_A": 0, "Model_B": 1}


def test_csv_round_trip_and_limit(spark, tmp_path):
    text = 'two\nlines, "quoted"'
    df = spark.createDataFrame([(2, text, 0.1, 0.2), (1, "b", 0.3, 0.4)], S.frame_schema(["Model_A"]))
    path = str(tmp_path / "frame")
    df.write.option("header", True).option("escape", '"').csv(path)
    back = S.read_frame(spark, path, S.frame_schema(["Model_A"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [r.ID for r in S.read_frame(spark, path, S.frame_schema(["Model_A"]), limit=1).collect()] == [1]


def test_score_column_precedence(spark):
    both = ["Model_A", "Model_A_reward", "Model_A_score"]
    assert S.score_columns(both, ["Model_A"]) == ["Model_A"]
    assert S.score_columns(both[1:], ["Model_A"]) == ["Model_A_reward"]
    assert S.score_columns(both[2:], ["Model_A"]) == ["Model_A_score"]
    with pytest.raises(ValueError):
        S.score_columns([], ["Model_A"])


def test_parameter_defaults(spark, tmp_path):
    path = str(tmp_path / "params")
    old = spark.createDataFrame([("Model_A", 1.0, 0.5)], "model string, cost_mean double, cost_std double")
    S.save_parameters(old, path)
    loaded = S.load_parameters(spark, path, ["Model_A"]).first()
    assert loaded.ranking_loss_weight == 1.0 and loaded.score_bias == 0.0 and loaded.cost_std == 0.5
    with pytest.raises(ValueError, match="Model_B"):
        S.load_parameters(spark, path, ["Model_A", "Model_B"])


def test_sparse_cells(spark):
    long = spark.createDataFrame([(1, "Model_B", 2.0), (1, "Model_A", 2.0), (2, "Model_C", 1.0)], "id long, model string, score double")
    cells = C.from_long(long, "score")
    assert {r.id: r.pred_model for r in D.decide(cells).collect()} == {1: "Model_A", 2: "Model_C"}


def test_stream_routes_each_query_once(spark, tmp_path):
    from signalbox.streaming.incremental import earlier_decisions, route_stream

    folder, log, ckpt = (str(tmp_path / n) for n in ("queries", "log", "ckpt"))
    router = lambda df: df.select("id", F.lit("Model_A").alias("pred_model"))
    run = lambda: route_stream(spark, folder, log, ckpt, router, ["Model_A", "Model_B"]).awaitTermination()
    frame = lambda ids: spark.createDataFrame([(i, f"q{i}") for i in ids], "id long, query string")
    frame([1, 2, 2]).write.json(folder)
    run()
    frame([2, 3]).write.mode("append").json(folder)
    run()
    assert sorted(r.id for r in earlier_decisions(spark, log).collect()) == [1, 2, 3]


def test_offsets_stay_inside_the_radius():
    assert B.inner_grid(0.2, 0.07)[-1] == pytest.approx(0.15) and B.inner_grid(0.2, 0.02)[-1] == pytest.approx(0.2)
    assert B.half_open_grid(0.05, 0.002)[-1] == pytest.approx(0.05)


def test_rows_without_a_partner_are_errors(spark, panel):
    p = panel(score=[[0.6, 0.5], [0.1, 0.9]], reward=[[0.0, 1.0], [0.0, 1.0]])
    one = spark.createDataFrame([(0, "Model_A")], "id long, pred_model string")
    extra = spark.createDataFrame([(0, "Model_A"), (1, "Model_B"), (7, "Model_A")], "id long, pred_model string")
    for decisions in (one, extra):
        with pytest.raises(Exception, match="unknown decision label"):
            A.policy_reward(p, decisions).collect()
    assert A.policy_reward(p, extra, strict=False).first().n == 2
    with pytest.raises(Exception, match="unknown model"):
        D.versus_base(p, one).collect()
