"""Learned scorers: closed forms, special cases, and a planted signal that beats the constant."""

import numpy as np
import pytest
from conftest import matrix
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.operators import audit as A
from signalbox.operators import boosting, clusters
from signalbox.operators import decide as D
from signalbox.operators import factor as K
from signalbox.operators import learners as G
from signalbox.operators import linear
from signalbox.operators import neighbors as NB
from signalbox.operators import priors as P
from signalbox.operators import tfidf as TF

MODELS = ["Model_A", "Model_B", "Model_C"]
SPEC = TF.TfidfSpec("word", 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    """One keyword per query says which model is best; the rest is noise."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        best = i % 3
        words = [f"key{best}"] + [f"noise{rng.integers(30)}" for _ in range(4)]
        cells = [(m, 0.9 if j == best else 0.2 + 0.1 * float(rng.uniform())) for j, m in enumerate(MODELS)]
        rows.append((i, " ".join(words), cells))
    panel = spark.createDataFrame(rows, "id long, query string, cells array<struct<model: string, reward: double>>")
    panel = panel.withColumn("label", C.best(F.col("cells"), "reward")["model"])
    return panel.where("id < 180").cache(), panel.where("id >= 180").cache()


def routed(scored, held):
    assert scored.count() == 60
    return A.policy_reward(held, D.decide(scored)).first().policy_reward


def test_constant_is_poor(planted):
    train, held = planted
    assert A.policy_reward(held, D.global_best_policy(held, train)).first().policy_reward < 0.6


def test_text_scorers_find_the_signal(planted):
    train, held = planted
    rows, queries = G.text_features(NB.dense_rewards(train, MODELS), held, SPEC, keep=("label", "rewards"))
    assert routed(G.logistic_scores(rows, queries, MODELS), held) == pytest.approx(0.9)
    assert routed(G.ridge_scores(rows, queries, MODELS, 1.0), held) == pytest.approx(0.9)
    assert routed(G.soft_oracle_scores(rows, queries, train.select("id", "cells"), MODELS), held) == pytest.approx(0.9)
    assert routed(NB.knn_scores(train, held, MODELS, SPEC, (10,))[10], held) > 0.65
    assert routed(G.pairwise_scores(train, held, MODELS, SPEC, balanced=True), held) == pytest.approx(0.9)
    fallback = P.global_cells(P.global_prior(train))
    # texts of six words for each label: clusters follow what texts are about
    plain = F.expr("concat_ws(' ', split(query, ' ')[0], concat(split(query, ' ')[0], 'b'), concat(split(query, ' ')[0], 'c'), concat(split(query, ' ')[0], 'd'), concat(split(query, ' ')[0], 'e'), concat(split(query, ' ')[0], 'f'))")
    model = TF.fit(train.withColumn("query", plain), SPEC)
    sparse = TF.transform(NB.dense_rewards(train.withColumn("query", plain), MODELS), model, keep=("id", "rewards"))
    asked = TF.transform(held.withColumn("query", plain), model)
    assert K.cluster_scores(sparse, asked, MODELS, fallback, model.size, 1).count() == 60
    assert routed(K.cluster_scores(sparse, asked, MODELS, fallback, model.size, 6), held) == pytest.approx(0.9)


def test_mini_batches_cluster_as_well_as_full_batches(spark):
    """Cost against Lloyd's steps from many starts, on sparse rows around eight centres and on rows without structure."""
    rng = np.random.default_rng(2)
    size, k = 40, 8
    around = np.maximum(rng.normal(0, 0.25, (600, size)) + rng.random((k, size))[rng.integers(0, k, 600)] * 2 - 0.9, 0)
    loose = np.where(rng.random((500, size)) < 0.2, rng.random((500, size)), 0.0)
    for x in (around, loose):
        best = np.inf
        for _ in range(10):
            c = x[rng.permutation(len(x))[:k]]
            for _ in range(60):
                far = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
                label = far.argmin(1)
                c = np.stack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            best = min(best, ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).min(1).sum())
        rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "id long, idx array<int>, w array<double>").repartition(3)
        centres, cost = clusters.fit_kmeans(df, size, k, batch=64)
        own = ((x**2).sum(1)[:, None] - 2 * x @ centres + (centres.astype(float) ** 2).sum(0)).min(1).sum()
        assert cost == pytest.approx(own, rel=1e-4) and cost <= 1.02 * best
        placed = {r.id: r.cluster for r in clusters.nearest_centre(df, centres, ("id",)).collect()}
        assert np.allclose([((x[i] - centres[:, j]) ** 2).sum() for i, j in placed.items()], [((x[i][:, None] - centres) ** 2).sum(0).min() for i in placed], atol=1e-4)


def test_clusters_of_rows_without_terms_and_of_equal_rows(spark):
    df = spark.createDataFrame([(0, [], []), (1, [2], [1.0]), (2, [2], [1.0]), (3, [], [])], "id long, idx array<int>, w array<double>")
    centres, cost = clusters.fit_kmeans(df, 4, 2)
    assert centres.shape == (4, 2) and cost == pytest.approx(0.0, abs=1e-6)


def test_trees_find_the_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        best = i % 3
        vec = rng.normal(0, 0.2, 3)
        vec[best] += 1.0
        rows.append((i, [float(x) for x in vec], MODELS[best], [0.9 if j == best else 0.1 for j in range(3)]))
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string, rewards array<double>")
    train = G.dense_features(df, ("id", "label", "rewards"))
    queries = G.dense_features(df, ("id",))
    right = lambda s: D.decide(s).join(df, "id").where("pred_model = label").count()
    assert right(G.classifier_ensemble_scores(train, queries, MODELS, trees=30, depth=2, forest=5, forest_depth=4)) >= 140
    assert right(G.boosted_regression_scores(train, queries, MODELS, trees=3, depth=2)) >= 140
    scored = G.boosted_classifier_scores(train, queries, MODELS, trees=3, depth=2)
    assert np.allclose(np.sum(matrix(scored, "score"), axis=1), 1.0)
    single = G.boosted_classifier_scores(train.where("label = 'Model_B'"), queries, MODELS, trees=2, depth=2)
    assert matrix(single, "score")[0] == [0.0, 1.0, 0.0]


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)), rng.normal(size=(80, 2))
    y[:, 1] = 0.25  # a constant target
    df = spark.createDataFrame(
        [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))],
        "id long, vec array<double>, rewards array<double>",
    )
    rows = G.dense_features(df, ("id", "rewards"))
    got = matrix(G.ridge_scores(rows, rows, ["Model_A", "Model_B"], 10.0), "score")
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(5), xc.T @ (y[:, 0] - y[:, 0].mean()))
    assert np.allclose([r[0] for r in got], xc @ w + y[:, 0].mean(), atol=1e-8)
    assert np.allclose([r[1] for r in got], 0.25, atol=1e-8)


def test_pairwise_special_cases(spark):
    rows = [(i, f"w{i % 4}", [("Model_A", 0.9), ("Model_B", 0.5), ("Model_C", 0.5)]) for i in range(8)]
    train = spark.createDataFrame(rows, "id long, query string, cells array<struct<model: string, reward: double>>")
    scores = matrix(G.pairwise_scores(train, train, MODELS, SPEC, min_margin=0.01, max_iter=200), "score")
    # A wins both of its pairs; B against C has no usable row and is even.
    assert np.allclose(scores, [[1.0, 0.25, 0.25]] * 8, atol=1e-9)


def test_heads_recover_fractional_labels(spark):
    rows = [(i, "same text", [0.3, 1.0], [0.5, -0.5]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, query string, performances array<double>, z_costs array<double>")
    rows, queries = G.text_features(df, df.select("id", "query"), SPEC, keep=("performances", "z_costs"))
    out = G.head_cells(rows, queries, ["Model_A", "Model_B"])
    assert np.allclose(matrix(out, "performance")[0], [0.3, 1.0], atol=1e-3)
    assert np.allclose(matrix(out, "z_cost")[0], [0.5, -0.5], atol=1e-6)


def test_item_response_learns(spark):
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(120, 6))
    perf = 1 / (1 + np.exp(-(vec @ rng.normal(size=(6, 3)))))
    df = spark.createDataFrame(
        [(i, [float(x) for x in v], [float(x) for x in p]) for i, (v, p) in enumerate(zip(vec, perf))],
        "id long, vec array<double>, performances array<double>",
    )
    error = lambda m: np.abs(np.array(matrix(G.item_response_cells(df, m), "performance")) - perf).mean()
    start = G.fit_item_response(df, MODELS, 6, latent=4, epochs=1)
    assert error(G.fit_item_response(df, MODELS, 6, latent=4, epochs=40)) < 0.8 * error(start)
    again = G.fit_item_response(df, MODELS, 6, latent=4, epochs=1)
    assert np.allclose(start.flat(), again.flat())
    with pytest.raises(ValueError):
        G.fit_item_response(df.limit(0), MODELS, 6)


def test_item_response_gradient(spark):
    """One step from the start moves along the numeric gradient."""
    rng = np.random.default_rng(7)
    vec, perf = rng.normal(size=(10, 3)), rng.uniform(size=(10, 2))
    state = G.ItemResponse(
        ["Model_A", "Model_B"], rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=3), rng.normal(size=1), rng.normal(size=(2, 2))
    )

    def loss(v):
        _, z = state.unflat(v).logits(vec)
        return (np.logaddexp(0, z) - z * perf).mean()

    raw, z = state.logits(vec)
    err = 1 / (1 + np.exp(-z)) - perf
    g_raw = (err @ state.ability) / (1 + np.exp(-raw))
    g_d = -err.sum(axis=1)
    disc = np.logaddexp(0, raw) + 1e-4
    grad = np.concatenate([(vec.T @ g_raw).ravel(), g_raw.sum(0), vec.T @ g_d, [g_d.sum()], (err.T @ disc).ravel()]) / 20
    flat = state.flat()
    numeric = np.array([(loss(flat + 1e-6 * e) - loss(flat - 1e-6 * e)) / 2e-6 for e in np.eye(len(flat))])
    assert np.allclose(grad, numeric, atol=1e-6)


def test_embedding_spans_the_leading_directions(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{rng.integers(12)}" for _ in range(8))) for i in range(40)]
    df = spark.createDataFrame(docs, "id long, query string")
    spec = TF.TfidfSpec("word", 1, 1)
    embedder = K.fit_embedder(df, 4, spec)
    dense = np.zeros((40, embedder.model.size))
    for r in TF.transform(df, embedder.model).collect():
        dense[r.id, r.idx] = r.w
    _, _, vt = np.linalg.svd(dense, full_matrices=False)
    proj = dense @ vt[:4].T
    proj /= np.linalg.norm(proj, axis=1, keepdims=True)
    got = np.array([r.vec for r in K.embed(df, embedder).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(proj), atol=1e-6)
    narrow = K.fit_embedder(df, 256, spec)
    assert narrow.components is None and narrow.width == narrow.model.size
    assert np.allclose(K.embed(df, narrow).orderBy("id").first().vec, dense[0])


@pytest.mark.parametrize("rank", [90, 12])
def test_blocks_of_vectors_give_the_singular_vectors(spark, rank):
    """Restarts and a rank below the number of vectors included; a scan serves a whole block."""
    rng = np.random.default_rng(11)
    # singular values fall slowly, so the small basis has to be restarted
    left, right = np.linalg.qr(rng.normal(size=(150, rank)))[0], np.linalg.qr(rng.normal(size=(120, rank)))[0]
    dense = (left * 0.96 ** np.arange(rank)) @ right.T
    rows = spark.createDataFrame([(list(range(120)), r.tolist()) for r in dense], "idx array<int>, w array<double>").repartition(3).localCheckpoint()
    scans, sums = [], K.linear._sums
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(K.linear, "_sums", lambda *a: scans.append(1) or sums(*a))
        got = K.leading_vectors(rows, 120, 20, block=8, basis=0)
    wanted = np.linalg.svd(dense)[2][: min(20, rank)]
    assert got.shape == (120, min(20, rank)) and np.allclose(np.abs((got.T * wanted).sum(axis=1)), 1.0, atol=1e-9)
    assert len(scans) <= 25


def test_embedder_takes_blocks_when_rows_are_many(spark, monkeypatch):
    """Beyond the bound the blocks give the vectors that MLlib gives below it."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.integers(40)}" for _ in range(9))) for i in range(70)], "id long, query string")
    spec = TF.TfidfSpec("word", 1, 1)
    below = K.fit_embedder(df, 6, spec).components
    monkeypatch.setattr(K, "FEW", 10)
    monkeypatch.setattr(K, "RowMatrix", None)
    assert np.allclose(K.fit_embedder(df, 6, spec).components, below, atol=1e-7)


def test_mixed_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(0, Vectors.sparse(3, [1], [2.0])), (1, Vectors.dense([1.0, 2.0, 3.0])), (2, Vectors.sparse(3, [], []))], ["id", "features"])
    out = G.linear_cells(df.coalesce(1), ["a"], np.array([[1.0], [10.0], [100.0]]), np.zeros(1))
    assert [r.cells[0].score for r in out.orderBy("id").collect()] == [20.0, 321.0, 0.0]


def test_logistic_heads_reach_the_optimum(spark):
    from signalbox.operators import linear

    rng = np.random.default_rng(9)
    x, y, weight = rng.normal(size=(60, 4)), rng.uniform(size=(60, 3)), rng.uniform(0.2, 2.0, size=(60, 3))
    rows = [(list(range(4)), [float(v) for v in a], [float(v) for v in b], [float(v) for v in c]) for a, b, c in zip(x, y, weight)]
    df = spark.createDataFrame(rows, "idx array<int>, w array<double>, y array<double>, weight array<double>").repartition(3)

    def examples(batch, first, last):
        return tuple(linear.matrix(batch.column(name).slice(first, last - first), 3) for name in ("y", "weight"))

    penalty = np.array([0.1, 1.0, 3.0])
    w, b = linear.logistic(df, 4, 3, penalty, examples)
    err = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.linalg.norm(np.concatenate([x.T @ err + penalty * w, [err.sum(axis=0)]])) / 60 < 1e-6


def test_boosted_trees_match_a_plain_search():
    """One tree of one level splits where the squared error falls most."""
    from signalbox.operators import boosting

    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (80, 3)).astype(float)
    y = 2.0 * (x[:, 1] > 6) + rng.normal(0, 0.3, 80)
    forest = boosting.fit_boosted(x, y, boosting.Boosting(1, 1, 1.0, 1.0, 1.0), 0)
    loss = lambda j, t: sum(((y[m] - y[m].mean()) ** 2).sum() for m in (x[:, j] <= t, x[:, j] > t) if m.any())
    best = min(loss(j, t) for j in range(3) for t in np.unique(x[:, j]))
    assert np.isclose(((forest.predict(x) - y) ** 2).sum(), best)
    many = boosting.fit_boosted(x, y, boosting.Boosting(200, 3, 0.1), 0)
    assert ((many.predict(x) - y) ** 2).mean() < 0.5 * best / 80 + 0.02
    labels = (y > 1).astype(float)
    odds = boosting.fit_boosted(x, labels, boosting.Boosting(60, 3, 0.1, logistic=True), 0).predict(x)
    assert ((odds > 0) == (labels > 0)).mean() > 0.95


def test_starved_centres_are_measured_once_an_epoch(spark, monkeypatch):
    """Many centres that no row chooses: distances to all centres are taken once a start and epoch, not once a centre."""
    rows = [([i % 4], [1.0 + 1e-3 * (i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "idx array<int>, w array<double>").repartition(2).localCheckpoint()
    calls, whole = [], clusters._distances
    monkeypatch.setattr(clusters, "_distances", lambda *a: calls.append(1) or whole(*a))
    epochs = []
    scan = clusters._epoch
    monkeypatch.setattr(clusters, "_epoch", lambda *a: epochs.append(1) or scan(*a))
    # rows of twelve kinds for forty centres
    centres, cost = clusters.fit_kmeans(df, 4, 40, starts=2, epochs=4)
    assert len(calls) <= 2 * len(epochs) and cost < 1e-6 and centres.shape == (4, 40)


def test_lazily_scaled_centres_are_the_running_means(spark):
    """Sums, counts and costs of an epoch equal those of centres that are moved in place, one of them without weight."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((500, 30)) < 0.3, rng.random((500, 30)), 0.0)
    df = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], "idx array<int>, w array<double>").coalesce(1)
    centres, weight = x[:6].T.astype(np.float32), np.array([0.0, 0.01, 1.0, 5.0, 0.5, 2.0])
    sums, counts, costs = clusters._epoch(df, centres, weight, 2, 3, 50)
    own, mass, cost, chosen, total = centres.astype(np.float64), weight.copy(), np.zeros(2), np.zeros(6), np.zeros((30, 6))
    for low in range(0, 500, 50):
        part = x[low : low + 50]
        far = ((part[:, :, None] - own) ** 2).sum(axis=1)
        for s in range(2):
            cost[s] += far[:, 3 * s : 3 * s + 3].min(axis=1).sum()
            label = 3 * s + far[:, 3 * s : 3 * s + 3].argmin(axis=1)
            for j in set(label):
                mine = part[label == j]
                mass[j] += len(mine)
                chosen[j] += len(mine)
                total[:, j] += mine.sum(axis=0)
                own[:, j] += (mine.sum(axis=0) - len(mine) * own[:, j]) / mass[j]
    assert np.array_equal(counts, chosen) and np.allclose(sums, total, atol=1e-4) and np.allclose(costs, cost, rtol=1e-5)


def test_boosted_outputs_are_fitted_one_a_task(spark):
    """More outputs than shuffle partitions: each has its own partition, with the sample and its own targets."""
    rows = spark.createDataFrame([(i, [float(i), 1.0], [float(10 * i + j) for j in range(11)]) for i in range(30)], "id long, vec array<float>, targets array<double>")
    dealt = boosting.dealt_sample(rows, 11, 20)
    parts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.collect_set("output").alias("outputs"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(p.outputs[0] for p in parts) == list(range(11)) and all(len(p.outputs) == 1 and p.n == 20 for p in parts)
    assert dealt.where(F.col("target") != 10 * F.col("vec")[0] + F.col("output")).count() == 0
    # grouping keeps these partitions
    kept = dealt.groupBy("output").applyInArrow(lambda t: t.slice(0, 1).select(["output"]), "output int")
    assert kept._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    assert "ENSURE_REQUIREMENTS" not in kept._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[1].split("REPARTITION_BY_NUM")[0]


def test_boosted_leaves_hold_the_rows_asked_for():
    """Histograms by column and the count of rows give the trees of a plain search over all cuts."""
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 9, (120, 4)).astype(float), rng.normal(size=120)
    for least in (1, 15):
        forest = boosting.fit_boosted(x, y, boosting.Boosting(1, 1, 1.0, 1.0, 1.0, min_rows=least), 0)
        loss = lambda j, t: sum(((y[m] - y[m].mean()) ** 2).sum() for m in (x[:, j] <= t, x[:, j] > t))
        cuts = [(j, t) for j in range(4) for t in np.unique(x[:, j]) if least <= (x[:, j] <= t).sum() <= 120 - least]
        assert np.isclose(((forest.predict(x) - y) ** 2).sum(), min(loss(j, t) for j, t in cuts))


def test_softmax_on_soft_targets_is_optimal(spark):
    """The gradient vanishes at the solution, a class without targets has no share, and hard labels are a special case."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random((80, 12)) < 0.4, rng.random((80, 12)), 0.0)
    y = rng.random((80, 4)) ** 3
    y[:, 2] = 0.0
    y /= y.sum(axis=1, keepdims=True)
    weight = rng.random(80) + 0.1
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist(), t.tolist(), float(v)) for r, t, v in zip(x, y, weight)]
    df = spark.createDataFrame(rows, "idx array<int>, w array<double>, targets array<double>, weight double").repartition(3)

    def examples(batch, first, last):
        return linear.matrix(batch.column("targets").slice(first, last - first), 4), batch.column("weight").slice(first, last - first).to_numpy()

    w, b = linear.softmax(df, 12, 4, 0.3, examples, tol=1e-9)
    z = x @ w + b
    share = np.exp(z - z.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    residual = weight[:, None] * (share - y)
    assert (share[:, 2] == 0).all() and b[2] == -np.inf
    assert np.abs(x.T @ residual + 0.3 * w).max() < 1e-6 and np.abs(residual.sum(axis=0)).max() < 1e-6


@pytest.mark.parametrize("parts", [1, 3])
def test_trees_grown_together_are_those_grown_alone(spark, parts, monkeypatch):
    """Every output's forest equals that of one table in memory, whether histograms are added on executors or not."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(220, 5)), 2)
    y = np.stack([np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.2 * x[:, 1], x[:, 2] * (x[:, 3] > 0), np.full(220, 0.5)], axis=1)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, vec array<double>, targets array<double>").repartition(parts)
    spec = boosting.Boosting(13, 3, 0.2, row_share=1.0, column_share=1.0)
    if parts > 1:
        monkeypatch.setattr(boosting, "DIRECT", 0)
    cuts = boosting.quantile_cuts(df, 5)
    for j, forest in enumerate(boosting.fit_together(df, 3, spec)):
        alone = boosting.fit_boosted(x, y[:, j], spec, 42 + j, cuts)
        assert np.allclose(forest.predict(x), alone.predict(x), atol=1e-9)
        assert (forest.features == alone.features).mean() > 0.95 and forest.start == pytest.approx(alone.start)
    # shares of rows and columns still find the signal, on all rows
    some = boosting.fit_together(df, 1, boosting.Boosting(40, 3, 0.2, row_share=0.7, column_share=0.6))[0]
    assert np.mean((some.predict(x) - y[:, 0]) ** 2) < 0.05 * y[:, 0].var()


@pytest.mark.parametrize("least", [1, 9])
def test_boosted_classifiers_beyond_one_task_use_all_rows(spark, least):
    """More rows than a task takes give the forests of one table that holds them all, not those of a part."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(260, 4)), 2)
    y = np.stack([x[:, 0] + 0.5 * rng.normal(size=260) > 0.2, x[:, 1] * x[:, 2] > 0], axis=1).astype(float)
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, targets array<double>").repartition(3)
    spec = boosting.Boosting(12, 3, 0.3, row_share=1.0, column_share=1.0, logistic=True, min_rows=least)
    cuts = boosting.quantile_cuts(df, 4)
    scored = {r.id: r.scores for r in boosting.boosted_outputs(df, df.select("id", "vec"), 2, spec, in_task=100).collect()}
    for j in range(2):
        alone = boosting.fit_boosted(x, y[:, j], spec, 42 + j, cuts)
        assert np.allclose([scored[i][j] for i in range(260)], alone.predict(x), atol=1e-8)


def test_forest_thresholds_come_from_all_rows(spark, monkeypatch):
    """Beyond the rows that MLlib looks at for thresholds, it gets no more kinds of values than bins of all rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 2))
    rows = [(i, ("Model_A", "Model_B")[int(v[0] > 0)], v.tolist()) for i, v in enumerate(x)]
    df = G.dense_features(spark.createDataFrame(rows, "id long, label string, vec array<double>").repartition(3), ("id", "label"))
    monkeypatch.setattr(G, "FOREST_ROWS", 50)
    seen, fit = [], G.RandomForestClassifier.fit
    monkeypatch.setattr(G.RandomForestClassifier, "fit", lambda self, data: seen.append(data.collect()) or fit(self, data))
    scored = G.classifier_ensemble_scores(df, df.select("id", "features"), ["Model_A", "Model_B"], trees=3, depth=2, forest=5, forest_depth=4)
    best = {r.id: max(r.cells, key=lambda c: c.score).model for r in scored.collect()}
    assert np.mean([best[i] == label for i, label, _ in rows]) > 0.95
    kinds = np.array([r.features.toArray() for r in seen[0]])
    assert len(kinds) == 120 and all(16 < len(np.unique(kinds[:, j])) <= G.FOREST_BINS for j in range(2))


def test_scans_read_stored_blocks(spark, monkeypatch):
    """The rows are taken once for all scans of a fit, whose sums are those of the whole matrix; no file is left."""
    import os

    rng = np.random.default_rng(9)
    x = np.where(rng.random((90, 12)) < 0.4, rng.random((90, 12)), 0.0)
    x[7] = 0.0
    taken = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist(), int(i % 3)) for i, r in enumerate(x)], "idx array<int>, w array<double>, y int")
    rows = rows.repartition(4).mapInArrow(counted, rows.schema)
    weights, bias, z = rng.normal(size=(12, 3)), rng.normal(size=3), None
    with linear.blocks(rows) as stored:
        kept = stored.folder.partition(":")[2] if ":" in stored.folder else stored.folder
        assert stored.rows == 90 and [len(t) for t in stored.tasks] == [1] * 4
        files = set(os.listdir(kept))
        for most in (0, linear.DIRECT):
            monkeypatch.setattr(linear, "DIRECT", most)
            top, bottom, loss = linear._sums(stored, weights, bias, lambda z, batch, first, last: (z, z * z))
            z = x @ weights + bias
            assert np.allclose(top, x.T @ z) and np.allclose(bottom, z.sum(axis=0)) and np.allclose(loss, (z * z).sum(axis=0))
        assert np.allclose(linear._squares(stored, 12), [*(x * x).sum(axis=0), 90])
        assert set(os.listdir(kept)) == files
    assert taken.value == 90 and not os.path.exists(kept)


def test_steps_scaled_by_curves_reach_the_same_heads(spark, monkeypatch):
    """On many rows scaled steps end at the optimum of plain ones, also with an output that no target names."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(80, 5)) * [1.0, 8.0, 0.1, 1.0, 3.0]
    df = spark.createDataFrame([(list(range(5)), r.tolist(), int(r[0] + r[2] > 0)) for r in x], "idx array<int>, w array<double>, y int").repartition(2)

    def examples(batch, first, last):
        y = batch.column("y").slice(first, last - first).to_numpy()
        return (y[:, None] == np.arange(3)).astype(float), np.ones(len(y))

    def both(batch, first, last):
        y, weight = examples(batch, first, last)
        return y, np.ones_like(y)

    found = []
    for few in (linear.FEW, 10):
        monkeypatch.setattr(linear, "FEW", few)
        found.append((*linear.softmax(df, 5, 3, 0.5, examples, tol=1e-9), *linear.logistic(df, 5, 2, np.ones(2), lambda *a: tuple(v[:, :2] for v in both(*a)), tol=1e-9, scaled=True)))
    for one, other in zip(*found):
        assert np.allclose(one, other, atol=1e-5)


def test_validation_board_ranks_blocks_below_the_oracle(spark):
    """Two seeds of a planted table: every block and average once a seed, none above the oracle, text above the constant."""
    from signalbox.plans import learned

    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        best = i % 3
        words = [f"key{best}x{j}" for j in range(4)] + [f"noise{rng.integers(30)}" for _ in range(3)]
        cells = [(m, 0.9 if j == best else 0.2 + 0.1 * float(rng.uniform())) for j, m in enumerate(learned.MODELS)]
        rows.append((i, " ".join(words), cells))
    panel = spark.createDataFrame(rows, "id long, query string, cells array<struct<model: string, reward: double>>")
    board = learned.validation_board(panel, (1, 2), ["word12"], ks=(5,), clusters=3).collect()
    by = {(r.seed, r.method): (r.reward, r.n_blocks) for r in board}
    methods = {"oracle", "word12_knn5", "word12_ridge", "word12_cluster3", "cv_top3_avg"}
    assert len(board) == len(by) == 10 and {m for _, m in by} == methods
    for seed in (1, 2):
        oracle = by[seed, "oracle"][0]
        assert oracle == pytest.approx(0.9) and all(by[seed, m][0] <= oracle + 1e-9 for m in methods)
        assert by[seed, "word12_ridge"][0] > 0.8 and by[seed, "cv_top3_avg"] == (pytest.approx(by[seed, "cv_top3_avg"][0]), 3)


def test_only_splits_of_boosted_trees_come_to_the_driver(spark, monkeypatch):
    """What a level sends does not hold the bins' sums, however few the rows are."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, targets array<double>").repartition(3)
    sent, collect = [], type(df).collect

    def counted(self):
        out = collect(self)
        sent.extend(len(v) for r in out for v in r if hasattr(v, "__len__"))
        return out

    monkeypatch.setattr(type(df), "collect", counted)
    boosting.fit_together(df, 2, boosting.Boosting(2, 3))
    # a row of bounds of bins is the longest
    assert sent and max(sent) < boosting.BINS


def test_outputs_fitted_in_groups_are_those_fitted_together(spark, monkeypatch):
    """The driver's matrices have as many columns as a group; weights stay the same."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4))
    y = (x @ rng.normal(size=(4, 5)) + rng.normal(size=(80, 5)) > 0).astype(float)
    df = spark.createDataFrame([([0, 1, 2, 3], a.tolist(), b.tolist()) for a, b in zip(x, y)], "idx array<int>, w array<double>, y array<double>")

    def examples(batch, first, last):
        got = linear.matrix(batch.column("y").slice(first, last - first), 5)
        return got, np.ones_like(got)

    whole = linear.logistic(df, 4, 5, np.ones(5), examples)
    widths, descend = [], linear.descend
    monkeypatch.setattr(linear, "TOGETHER", 0)
    monkeypatch.setattr(linear, "GROUP", 64)
    monkeypatch.setattr(linear, "descend", lambda rows, size, outputs, *rest: widths.append(outputs) or descend(rows, size, outputs, *rest))
    parts = linear.logistic(df, 4, 5, np.ones(5), examples)
    assert widths == [2, 2, 1]
    assert np.allclose(whole[0], parts[0], atol=1e-4) and np.allclose(whole[1], parts[1], atol=1e-4)
