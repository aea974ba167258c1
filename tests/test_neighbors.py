"""Blocked nearest neighbours against brute force, with many blocks, copies and ties."""

import numpy as np
import pytest
from conftest import matrix
from pyspark.sql import functions as F

from signalbox.operators import neighbors as NB
from signalbox.operators import tfidf as TF


def brute(sims, ids, k, positive):
    out = {}
    for q, row in enumerate(np.round(sims, 9)):
        order = sorted((i for i in range(len(ids)) if row[i] > 0 or not positive), key=lambda i: (-row[i], ids[i]))[:k]
        out[q] = [(int(ids[i]), float(row[i])) for i in order]
    return out


def collect(df, n):
    got = {q: [] for q in range(n)}
    for r in df.orderBy("id", "rank").collect():
        got[r.id].append((r.neighbor_id, r.similarity))
    return got


@pytest.mark.parametrize("rows", [(3, 7), (100, 100)])
def test_dense_neighbors(spark, rows):
    rng = np.random.default_rng(1)
    train, query = rng.normal(size=(60, 8)), rng.normal(size=(20, 8))
    train[20:45] = train[3]  # copies
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")
    got = collect(NB.nearest(frame(query), frame(train), 9, "dense", positive_only=False, query_rows=rows[0], train_rows=rows[1]), 20)
    want = brute(query @ train.T, np.arange(60), 9, False)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def _texts():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    p = 1.0 / np.arange(1, 61)
    docs = [" ".join(rng.choice(vocab, size=rng.integers(3, 30), p=p / p.sum())) for _ in range(90)]
    docs[30:60] = [docs[2]] * 30  # a third of all rows is one text
    return docs + ["zzz yyy", ""]


@pytest.mark.parametrize("rows", [(5, 11), (500, 500)])
def test_sparse_neighbors(spark, rows):
    docs = _texts()
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, query string")
    train, query = frame.where("id < 70"), frame.where("id >= 70").withColumn("id", F.col("id") - 70)
    model = TF.fit(train, TF.TfidfSpec("word", 1, 2))
    dense = np.zeros((len(docs), model.size))
    for r in TF.transform(frame, model).collect():
        dense[r.id, r.idx] = r.w
    got = collect(
        NB.nearest(TF.transform(query, model), TF.transform(train, model), 12, query_rows=rows[0], train_rows=rows[1]), 22
    )
    want = brute(dense[70:] @ dense[:70].T, np.arange(70), 12, True)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert got[20] == [] and got[21] == []


def test_query_without_shared_term_gets_the_mean(spark):
    cells = "cells array<struct<model: string, reward: double>>"
    train = spark.createDataFrame(
        [(0, "red blue", [("Model_A", 1.0), ("Model_B", 0.0)]), (1, "green sky", [("Model_A", 0.0), ("Model_B", 0.5)])],
        f"id long, query string, {cells}",
    )
    queries = spark.createDataFrame([(10, "red"), (11, "unknown words")], "id long, query string")
    scored = NB.knn_scores(train, queries, ["Model_A", "Model_B"], TF.TfidfSpec("word", 1, 1), (1,))[1]
    assert matrix(scored, "score") == [[1.0, 0.0], [0.5, 0.25]]


def test_partial_panels_are_refused(spark):
    train = spark.createDataFrame([(0, "red", [("Model_A", 1.0)])], "id long, query string, cells array<struct<model: string, reward: double>>")
    with pytest.raises(Exception, match="without all models"):
        NB.dense_rewards(train, ["Model_A", "Model_B"]).collect()


def test_residuals_and_warm_up(spark):
    rng = np.random.default_rng(2)
    train, query, res = rng.normal(size=(30, 4)), rng.normal(size=(5, 4)), rng.normal(size=(30, 2))
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(query)], "id long, vec array<double>")
    right = spark.createDataFrame(
        [(i, [float(x) for x in v], [float(x) for x in r]) for i, (v, r) in enumerate(zip(train, res))],
        "id long, vec array<double>, residuals array<double>",
    )
    got = matrix(NB.residual_scores(right, left, ["Model_A", "Model_B"], k=6), "score")
    sims = query @ train.T
    for q in range(5):
        top = np.argsort(-sims[q])[:6]
        w = np.maximum(sims[q][top], 0)
        assert np.allclose(got[q], (w[:, None] * res[top]).sum(0) / w.sum())
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    warmed = [r.vec for r in NB.warm_up(right, left, 4, k=3, share=0.2).orderBy("id").collect()]
    near = np.argsort(-(unit(query) @ unit(train).T), axis=1)[:, :3]
    want = unit(0.8 * query + 0.2 * train[near].mean(axis=1))
    assert np.allclose(warmed, want)
    assert NB.warm_up(right, left, 4, k=0).orderBy("id").first().vec == [float(x) for x in query[0]]


@pytest.mark.parametrize("block_rows,k,query_rows", [(4, 12, 5), (8, 1, 500), (1, 31, 500), (1000, 12, 7)])
def test_bounds_leave_neighbours_alone(spark, block_rows, k, query_rows):
    """The same rows as without bounds: a third of them copies, ties at the k-th place, queries without neighbours."""
    docs = _texts() + ["other words entirely"] * 3 + [f"w{i} w{i + 1}" for i in range(0, 50, 2)]
    frame = spark.createDataFrame([(i, d, f"p{i}") for i, d in enumerate(docs)], "id long, query string, tag string")
    train, query = frame.where("id % 4 < 3"), frame.where("id % 4 = 3 OR id >= 88").withColumn("id", F.col("id") + 1000)
    model = TF.fit(train, TF.TfidfSpec("word", 1, 2))
    left, right = TF.transform(query, model), TF.transform(train, model, keep=("id", "tag"))
    stats = {}
    columns = ["id", "rank", "neighbor_id", "similarity", "tag"]
    got = NB.nearest_by_bounds(left, right, k, ("tag",), block_rows, query_rows=query_rows, stats=stats).select(columns)
    want = NB.nearest(left, right, k, "sparse", ("tag",)).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert stats["compared"] <= stats["pairs"] and (block_rows > 8 or stats["compared"] < 0.8 * stats["pairs"])


def test_bounds_of_empty_and_unlike_tables(spark):
    df = spark.createDataFrame([(1, [0, 2], [0.6, 0.8]), (2, [], [])], "id long, idx array<int>, w array<double>")
    other = spark.createDataFrame([(7, [1], [1.0]), (8, [], [])], df.schema)
    assert NB.nearest_by_bounds(df, other, 3).count() == 0 == NB.nearest_by_bounds(df.where("false"), df, 3).count() == NB.nearest_by_bounds(df, df.where("false"), 3).count()
    assert [(r.id, r.neighbor_id, r.similarity) for r in NB.nearest_by_bounds(df, df, 3).collect()] == [(1, 1, 1.0)]


def test_training_rows_are_stored_once(spark, tmp_path, monkeypatch):
    """One copy of the training rows in files, however many groups the queries form, and none when the search is over."""
    df = spark.createDataFrame([(i, [i % 7, 7 + i % 3], [0.6, 0.8]) for i in range(200)], "id long, idx array<int>, w array<double>")
    blocks = NB._stored_blocks(df.withColumn("_t", F.expr("cast(id % 5 as int)")), str(tmp_path))
    assert sorted(i for name, _, _ in blocks for i in NB._read(str(tmp_path), name).column("id").to_pylist()) == list(range(200))
    monkeypatch.setattr(NB, "shared_folder", lambda spark, name: str(tmp_path / name))
    assert NB.nearest_by_bounds(df, df, 3, query_rows=1).count() == 600
    assert not (tmp_path / "blocks").exists()
