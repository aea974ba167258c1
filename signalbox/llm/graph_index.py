"""Largest inner products by beam search in robust-pruned directed graphs, one graph a shard.

Vectors are dealt to shards by hash.  In a shard, with one more coordinate that makes all norms
equal, the largest inner product is the smallest distance.  Greedy searches in the graph so far
propose a vector's neighbours; pruning keeps the nearest one and drops those that are nearer to
it, by a relaxed factor, than to the vector itself, so the kept edges lead in different
directions.  Queries search every shard's graph with a beam; what they find is ranked by the
inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.llm.registry import register

NEAREST = 20
EVERY = 20


@dataclass(frozen=True)
class Settings:
    shard: int = 4096
    """Vectors a shard has about: the memory and time of a task."""
    degree: int = 32
    build_beam: int = 64
    beam: int = 128
    relax: float = 1.2
    batch: int = 256
    expand: int = 4
    entries: int = 31


class Graph:
    """A directed graph over the rows of ``points``; vectors of equal norm."""

    def __init__(self, vectors: np.ndarray, settings: Settings):
        self.settings = settings
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        scale = np.sqrt(norms.max(initial=0.0)) or 1.0
        self.points = (np.concatenate([vectors, extra[:, None]], axis=1) / scale).astype(np.float32)
        n = len(vectors)
        self.edges = np.full((n, settings.degree), -1, dtype=np.int32)
        # searches enter at the middle and at the longest vectors, which large products favour
        middle = np.argsort(-(self.points @ self.points.mean(axis=0)), kind="stable")[:1]
        self.entries = np.unique(np.concatenate([middle, np.argsort(-norms, kind="stable")[: settings.entries]]))
        order = np.random.Generator(np.random.PCG64(1)).permutation(n)
        # two passes: the first without relaxation
        for relax in (1.0, settings.relax):
            for at in range(0, n, settings.batch):
                self.insert(order[at : at + settings.batch], relax)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's rows, best first, and their inner products; rows are -1 where fewer are reached.

        All queries advance together: each expands its best entries that are not expanded yet.
        """
        q, n, wide = len(queries), len(self.points), self.settings.expand
        rows = np.full((q, beam), -1, dtype=np.int32)
        scores = np.full((q, beam), -np.inf, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        first = len(self.entries)
        value = queries @ self.points[self.entries].T
        order = np.argsort(-value, axis=1, kind="stable")
        rows[:, :first], scores[:, :first], done[:, :first] = self.entries[order], np.take_along_axis(value, order, axis=1), False
        seen = np.zeros((q, n), dtype=bool)
        seen[:, self.entries] = True
        active = np.arange(q)
        while len(active):
            open_ = ~done[active]
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :wide]
            own = np.take_along_axis(open_, pick, axis=1)
            at = np.where(own, np.take_along_axis(rows[active], pick, axis=1), -1)
            done[active[:, None], pick] = True
            found = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(active), -1)
            # each row once for each query
            found = np.sort(found, axis=1)
            fresh = found >= 0
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            fresh &= ~seen[active[:, None], found]
            who, where = np.nonzero(fresh)
            seen[active[who], found[who, where]] = True
            value = np.full(found.shape, -np.inf, dtype=np.float32)
            value[who, where] = np.einsum("ij,ij->i", queries[active[who]], self.points[found[who, where]])
            all_rows = np.concatenate([rows[active], np.where(fresh, found, -1)], axis=1)
            all_scores = np.concatenate([scores[active], value], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            best = np.argsort(-all_scores, axis=1, kind="stable")[:, :beam]
            rows[active] = np.take_along_axis(all_rows, best, axis=1)
            scores[active] = np.take_along_axis(all_scores, best, axis=1)
            done[active] = np.take_along_axis(all_done, best, axis=1)
            active = active[(~done[active]).any(axis=1)]
        return rows, scores

    def insert(self, members: np.ndarray, relax: float) -> None:
        near, _ = self.search(self.points[members], self.settings.build_beam)
        proposals = np.concatenate([near, self.edges[members]], axis=1)
        # a batch's members are proposed to each other as well
        peers = np.argsort(-(self.points[members] @ self.points[members].T), axis=1)[:, 1 : 1 + self.settings.degree // 2]
        proposals = np.concatenate([proposals, members[peers].astype(np.int32)], axis=1)
        self.edges[members] = self.pruned(members, proposals, relax)
        # edges back: targets with room take them, full ones are pruned again
        source = np.repeat(members, self.settings.degree)
        target = self.edges[members].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        which, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        if not width:
            return
        back = np.full((len(which), width), -1, dtype=np.int32)
        back[np.repeat(np.arange(len(which)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for at in range(0, len(which), self.settings.batch):
            own = which[at : at + self.settings.batch]
            self.edges[own] = self.pruned(own, np.concatenate([self.edges[own], back[at : at + self.settings.batch]], axis=1), relax)

    def pruned(self, members: np.ndarray, proposals: np.ndarray, relax: float) -> np.ndarray:
        """Up to ``degree`` proposals for each member, nearest first, without those that a kept one covers."""
        degree = self.settings.degree
        proposals = np.sort(proposals, axis=1)
        valid = (proposals >= 0) & (proposals != members[:, None])
        valid[:, 1:] &= proposals[:, 1:] != proposals[:, :-1]
        points = self.points[proposals]
        distance = 2.0 - 2.0 * np.einsum("ik,ijk->ij", self.points[members], points)
        distance[~valid] = np.inf
        keep = min(proposals.shape[1], 3 * degree)
        order = np.argsort(distance, axis=1, kind="stable")[:, :keep]
        proposals, distance = np.take_along_axis(proposals, order, axis=1), np.take_along_axis(distance, order, axis=1)
        points = np.take_along_axis(points, order[:, :, None], axis=1)
        between = 2.0 - 2.0 * np.matmul(points, points.transpose(0, 2, 1))
        # distances are squared, so is the factor
        covers = relax * relax * between <= distance[:, None, :]
        alive = np.isfinite(distance)
        out = np.full((len(members), degree), -1, dtype=np.int32)
        lane = np.arange(len(members))
        for slot in range(degree):
            best = np.argmax(alive, axis=1)
            left = alive[lane, best]
            if not left.any():
                break
            out[left, slot] = proposals[left, best[left]]
            alive &= ~covers[lane, best]
            alive[lane, best] = False
        return out


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has a number in every component, and one that is not 0."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product found for each query row.

    Both tables have vec_id and embedding.  Of equal vectors, copies beyond the k + 1 smallest
    ids can be nobody's answer and are not indexed; a hot vector so stays small.  Vectors that
    are null, zero or hold nulls or non-finite numbers take no part, as do null ids; repeated
    rows count once; vectors of other lengths than the query's have no product with it and are
    not its answers.  Every shard's task reads its vectors, builds the graph and then streams the
    queries, so no group of queries is collected and a lost task is simply run again.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = usable(queries).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    dims = F.size("embedding")
    # the groups of a copy are ranked by hash and vector, so equal ids of unequal vectors stay apart
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "embedding")
    shards = max(1, -(-rows.count() // settings.shard))
    shard_of = F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")
    indexed = kept.select(shard_of.alias("shard"), dims.alias("dims"), F.lit(0).alias("role"), "vec_id", "embedding")
    visiting = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), dims.alias("dims"), F.lit(1).alias("role"), "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, graph = None, [], [], None
        for batch in batches:
            shard, dims_, role, vec = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(dims_) != 0) | (np.diff(role) != 0)])) if len(batch) else []
            for low, high in zip(cuts, [*cuts[1:], len(batch)]):
                width = int(dims_[low])
                own = batch.column(4).slice(low, high - low).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if (shard[low], width) != place:
                    place, ids, parts, graph = (shard[low], width), [], [], None
                if role[low] == 0:
                    ids.append(vec[low:high])
                    parts.append(own)
                    continue
                if not parts:
                    continue
                if graph is None:
                    graph = _Shard(np.concatenate(ids), np.concatenate(parts), settings)
                for at in range(0, len(own), settings.batch):
                    yield graph.answer(vec[low + at : min(high, low + at + settings.batch)], own[at : at + settings.batch], k)

    dealt = indexed.unionByName(visiting).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dims", "role", "vec_id")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Shard:
    """A graph over distinct vectors and the ids that have each of them, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, settings: Settings):
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        first = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]))
        self.ids, self.bounds, self.vectors = ids, np.concatenate([first, [len(ids)]]), vectors[first]
        self.settings, self.graph = settings, Graph(self.vectors, settings)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
        flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)
        rows, _ = self.graph.search(flat, max(self.settings.beam, 2 * k))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query, vector, found in zip(query_ids, queries, rows):
            found = found[found >= 0]
            score = np.array([np.dot(x, vector) for x in self.vectors[found]]) if len(found) < 2 else self.vectors[found] @ vector
            low, high = self.bounds[found], self.bounds[found + 1]
            owner = np.repeat(np.arange(len(found)), high - low)
            ids = self.ids[np.concatenate([np.arange(a, b) for a, b in zip(low, high)])] if len(found) else np.zeros(0, np.int64)
            score = score[owner]
            other = ids != query
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))[:k]
            out.append((np.full(len(best), query), ids[best], score[best]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])


@register("op10_graph_search")
def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
