"""Exact nearest neighbours by cosine similarity, sparse or dense, and what is built on them.

Both sides are cut into blocks of bounded size.  A task compares one block with one block using
NumPy and passes on only the k best per query, so similarities are never emitted pair by pair
and no task holds more than two blocks.

For sparse vectors without negative weights blocks are clusters of alike rows, and a query visits only those that can hold
one of its k nearest: the product of the query with the largest weight of every term of a block bounds all
similarities in it.  The blocks with the largest bounds are searched first; the k-th similarity found so far is
what the bounds of others have to reach.  These blocks are files that the queries' tasks read, so that the disk holds
one copy of them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import truncate_text
from signalbox.operators import tfidf
from signalbox.operators.priors import global_cells, global_prior, lookup_task_priors, task_priors
from signalbox.session import collect_garbage, drop_folder, durable, filesystem, shared_folder

# Bounds of one block: rows and stored numbers.  A dense stretch of similarities takes
# QUERY_ROWS * TRAIN_ROWS * 8 bytes at most.
QUERY_ROWS = 1024
TRAIN_ROWS = 4096
BLOCK_VALUES = 4_000_000
SMALL_BLOCK = 128
CLUSTER_ROWS = 64
"""Rows of a cluster, about, where few leaders are enough for that; smaller blocks have sharper bounds."""
LEADERS = 512
SEEDS = 2
SEARCH_ROWS = 2048
"""Queries, about, that a task takes through the stored blocks together."""
PROBE = 4096
"""Rows, taken by hash, that tell clusters and their sizes."""
SIMILARITY_DIGITS = 9
PRODUCTS = 2_000_000


# --- one block against one block ----------------------------------------------

def _offsets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    return array.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _sparse_similarities(queries: pa.Table, train: pa.Table) -> np.ndarray:
    """Dense block of dot products from sparse rows.

    Terms that many rows of the block hold go through one matrix product; the others add up
    along their posting lists.
    """
    q_idx, q_off = _offsets(queries.column("idx"))
    q_w, _ = _offsets(queries.column("w"))
    t_idx, t_off = _offsets(train.column("idx"))
    t_w, _ = _offsets(train.column("w"))
    nq, nt = queries.num_rows, train.num_rows
    out = np.zeros((nq, nt))
    if len(q_idx) == 0 or len(t_idx) == 0:
        return out
    t_row = np.repeat(np.arange(nt), np.diff(t_off))
    q_row = np.repeat(np.arange(nq), np.diff(q_off))
    known, q_term = np.unique(q_idx, return_inverse=True)
    place = np.searchsorted(known, t_idx)
    place = np.minimum(place, len(known) - 1)
    shared = known[place] == t_idx
    t_term, t_row, t_val = place[shared], t_row[shared], t_w[shared]
    df = np.bincount(t_term, minlength=len(known))
    hot = np.flatnonzero(df > max(8, nt // 32))
    hot = hot[np.argsort(-df[hot], kind="stable")][:2048]
    slot = np.full(len(known), -1)
    slot[hot] = np.arange(len(hot))
    if len(hot):
        left, right = np.zeros((nq, len(hot))), np.zeros((nt, len(hot)))
        mine = slot[q_term] >= 0
        left[q_row[mine], slot[q_term[mine]]] = q_w[mine]
        theirs = slot[t_term] >= 0
        right[t_row[theirs], slot[t_term[theirs]]] = t_val[theirs]
        out += left @ right.T
    rare = slot[t_term] < 0
    order = np.argsort(t_term[rare], kind="stable")
    post_row, post_val = t_row[rare][order], t_val[rare][order]
    start = np.concatenate([[0], np.cumsum(np.bincount(t_term[rare], minlength=len(known)))])
    # all query terms meet their posting lists, a bounded number of products at a time
    length = start[q_term + 1] - start[q_term]
    ends = np.concatenate([[0], np.cumsum(length)])
    first = 0
    while first < len(q_term):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PRODUCTS, side="right")) - 1)
        part = length[first:last]
        at = np.arange(ends[last] - ends[first]) + np.repeat(start[q_term[first:last]] - (ends[first:last] - ends[first]), part)
        low, high = q_row[first], q_row[last - 1] + 1
        cell = np.repeat((q_row[first:last] - low) * nt, part) + post_row[at]
        sums = np.bincount(cell, weights=post_val[at] * np.repeat(q_w[first:last], part), minlength=(high - low) * nt)
        out[low:high] += sums.reshape(high - low, nt)
        first = last
    return out


def _dense_similarities(queries: pa.Table, train: pa.Table) -> np.ndarray:
    def matrix(table: pa.Table) -> np.ndarray:
        flat, offsets = _offsets(table.column("vec"))
        width = int(offsets[1]) if table.num_rows else 0
        return flat.astype(np.float64).reshape(table.num_rows, width)

    return matrix(queries) @ matrix(train).T


def _top_k(similarities: np.ndarray, train_ids: np.ndarray, k: int, positive_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query row, train row) of the k largest rounded similarities, the smaller id first on ties."""
    k = min(k, similarities.shape[1])
    cut = np.partition(similarities, similarities.shape[1] - k, axis=1)[:, similarities.shape[1] - k, None]
    keep = similarities >= cut
    if positive_only:
        keep &= similarities > 0
    rows, picks = np.nonzero(keep)
    order = np.lexsort((train_ids[picks], -similarities[rows, picks], rows))
    rows, picks = rows[order], picks[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], picks[rank < k]


# --- the blocked join -----------------------------------------------------------

def _blocks(side: DataFrame, rows_per_block: int, size: Column) -> tuple[int, int]:
    """(number of blocks, number of rows) so that a block keeps both bounds."""
    count, stored = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(1, math.ceil(count / rows_per_block), math.ceil(stored / BLOCK_VALUES)), count


def _grid_shape(queries: tuple[int, int], train: tuple[int, int], cores: int) -> tuple[int, int]:
    """Blocks per side; small inputs are cut finer, so that every core gets a few pairs of blocks.

    Finer blocks mean more copies of the other side, so large inputs keep the largest blocks.
    """
    (n_q, rows_q), (n_t, rows_t) = queries, train
    while n_q * n_t < 3 * cores and max(rows_q / n_q, rows_t / n_t) > 2 * SMALL_BLOCK:
        if rows_t / n_t >= rows_q / n_q:
            n_t += 1
        else:
            n_q += 1
    return n_q, n_t


def _comparison(kind: str, k: int, positive_only: bool):
    """A function of two Arrow tables: the k best rows of the second one for each row of the first one."""
    similarities = _sparse_similarities if kind == "sparse" else _dense_similarities
    digits = SIMILARITY_DIGITS

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        empty = pa.table(
            {"id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}
        )
        if q.num_rows == 0 or t.num_rows == 0:
            return empty
        sims = np.round(similarities(q, t), digits)
        t_ids = t.column("id").to_numpy()
        rows, picks = _top_k(sims, t_ids, k, positive_only)
        out = {
            "id": q.column("id").take(pa.array(rows, pa.int64())),
            "neighbor_id": pa.array(t_ids[picks], pa.int64()),
            "similarity": pa.array(sims[rows, picks], pa.float64()),
        }
        return pa.table(out)

    return compare


_FOUND = "id long, neighbor_id long, similarity double"


def _ranked(local: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("id").orderBy(F.desc("similarity"), F.asc("neighbor_id"))
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _with_payload(ranked: DataFrame, train: DataFrame, payload: Sequence[str]) -> DataFrame:
    if not payload:
        return ranked
    return ranked.join(train.select(F.col("id").alias("_n"), *payload), F.col("neighbor_id") == F.col("_n")).drop("_n")


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    kind: str = "sparse",
    payload: Sequence[str] = (),
    positive_only: bool = True,
    query_rows: int = QUERY_ROWS,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``id, neighbor_id, similarity, rank`` and the neighbour's ``payload`` columns.

    Exact for the rounded similarity; neighbours of equal similarity rank by id.  Blocks carry
    ids and vectors alone; the payload meets the k neighbours of a query afterwards, in a join
    whose hot neighbours Spark splits.  Every query visits every block.
    """
    columns = ["idx", "w"] if kind == "sparse" else ["vec"]
    size = F.size(columns[0])
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_q, n_t = _grid_shape(_blocks(queries, query_rows, size), _blocks(train, train_rows, size), cores)
    block = lambda n, tag: F.pmod(F.xxhash64(F.lit(tag), "id"), F.lit(n)).cast("int")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", *columns, block(n_q, "q").alias("_q")).withColumn("_t", grid(n_t))
    right = train.select("id", *columns, block(n_t, "t").alias("_t")).withColumn("_q", grid(n_q))
    # Both sides are spread over the grid by block, n_q * n_t groups of bounded size.
    local = left.groupBy("_q", "_t").cogroup(right.groupBy("_q", "_t")).applyInArrow(_comparison(kind, k, positive_only), _FOUND)
    return _with_payload(_ranked(local, k), train, payload)


# --- blocks that a bound rules out --------------------------------------------------

def _clustered(train: DataFrame, probe: pa.Table, count: int, block_rows: int, leaders: int) -> DataFrame:
    """``id, idx, w, _t``: rows beside the leader they are most like.

    ``probe`` holds rows taken by hash.  The first of them are the leaders, of bounded number and size; where all
    of them lie tells into how many parts, by hash, a cluster beyond the bounds of a block is cut.
    """
    each = max(1.0, len(probe.column("idx").combine_chunks().flatten()) / max(1, probe.num_rows))
    wanted = int(min(max(1, count // block_rows), leaders, max(1, BLOCK_VALUES / (4 * each))))
    full = probe.filter(pa.array(np.diff(_offsets(probe.column("idx"))[1]) > 0, pa.bool_()))
    chosen = full.slice(0, wanted)
    shared = train.sparkSession.sparkContext.broadcast(chosen)

    def leader_of(part: pa.Table, chosen: pa.Table) -> np.ndarray:
        near = np.zeros(part.num_rows, dtype=np.int64)
        if chosen.num_rows:
            for low in range(0, part.num_rows, QUERY_ROWS):
                near[low : low + QUERY_ROWS] = _sparse_similarities(part.slice(low, QUERY_ROWS), chosen).argmax(axis=1)
        return near

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = leader_of(pa.Table.from_batches([batch]), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["id", "idx", "w", "_c"])

    placed = train.select("id", "idx", "w").mapInArrow(place, "id long, idx array<int>, w array<double>, _c int")
    held = np.bincount(leader_of(probe, chosen), minlength=max(1, chosen.num_rows)) * count / max(1, probe.num_rows)
    parts = np.maximum(1, np.ceil(held / min(TRAIN_ROWS, BLOCK_VALUES / each))).astype(int).tolist()
    starts = np.concatenate([[0], np.cumsum(parts)]).tolist()
    part = F.pmod(F.xxhash64(F.lit("t"), "id"), F.get(F.lit(parts), F.col("_c")))
    return placed.withColumn("_t", (F.get(F.lit(starts), F.col("_c")) + part).cast("int")).drop("_c")


def _largest_weights(idx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every term of a block and its largest weight."""
    order = np.lexsort((w, idx))
    last = np.flatnonzero(np.concatenate([idx[order][1:] != idx[order][:-1], np.ones(min(1, len(idx)), dtype=bool)]))
    return idx[order[last]], w[order[last]]


def _cut(table: pa.Table) -> Iterator[pa.Table]:
    """Stretches of rows that keep both bounds of a block."""
    ends = _offsets(table.column("idx"))[1]
    first = 0
    while first < table.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_VALUES, side="right")) - 1)
        last = min(last, first + TRAIN_ROWS)
        yield table.slice(first, last - first)
        first = last


def _write(folder: str, name: str, table: pa.Table) -> str:
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return name


def _read(folder: str, name: str) -> pa.Table:
    files, path = filesystem(folder)
    with files.open_input_file(f"{path}/{name}") as source:
        return pa.ipc.open_file(source).read_all()


def _stored_blocks(placed: DataFrame, folder: str) -> list:
    """Write every block and the largest weights of its terms into ``folder``; one row per block tells its names.

    An attempt has names of its own, so a task that runs again leaves the files of the first alone.
    """
    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = []
        for block in _cut(table.select(["id", "idx", "w"])):
            name = uuid.uuid4().hex
            idx, w = _largest_weights(_offsets(block.column("idx"))[0], _offsets(block.column("w"))[0])
            if len(idx):
                top = pa.table({"idx": pa.array([idx], pa.list_(pa.int32())), "w": pa.array([w], pa.list_(pa.float64()))})
                rows.append({"block": _write(folder, name, block), "bound": _write(folder, f"{name}-bound", top), "terms": len(idx)})
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.string()), ("bound", pa.string()), ("terms", pa.int64())]))

    rows = placed.groupBy("_t").applyInArrow(write, "block string, bound string, terms long")
    return sorted(map(tuple, rows.collect()))


class _Asked:
    """Query rows laid out by term, to meet many blocks: terms of many rows in a matrix, the others in posting lists."""

    def __init__(self, queries: pa.Table):
        idx, ends = _offsets(queries.column("idx"))
        w, _ = _offsets(queries.column("w"))
        self.n = queries.num_rows
        row = np.repeat(np.arange(self.n), np.diff(ends))
        df = np.bincount(idx, minlength=1)
        self.terms = len(df)
        hot = np.flatnonzero(df > max(8, self.n // 32))
        hot = hot[np.argsort(-df[hot], kind="stable")][:2048]
        self.slot = np.full(self.terms, -1)
        self.slot[hot] = np.arange(len(hot))
        self.left = np.zeros((self.n, len(hot)))
        place = self.slot[idx]
        mine = place >= 0
        self.left[row[mine], place[mine]] = w[mine]
        rare = idx[~mine]
        order = np.argsort(rare, kind="stable")
        self.row, self.w = row[~mine][order], w[~mine][order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(rare, minlength=self.terms))])

    def products(self, block: pa.Table, at: np.ndarray | None = None) -> np.ndarray:
        """Dot products of the rows ``at`` (all without it) and the rows of the block."""
        idx, ends = _offsets(block.column("idx"))
        w, _ = _offsets(block.column("w"))
        nt = block.num_rows
        row = np.repeat(np.arange(nt), np.diff(ends))
        known = idx < self.terms
        idx, w, row = idx[known], w[known], row[known]
        place = self.slot[idx]
        mine = place >= 0
        right = np.zeros((nt, self.left.shape[1]))
        right[row[mine], place[mine]] = w[mine]
        out = (self.left if at is None else self.left[at]) @ right.T
        # rare terms meet their posting lists, a bounded number of products at a time
        idx, w, row = idx[~mine], w[~mine], row[~mine]
        length = self.start[idx + 1] - self.start[idx]
        some = length > 0
        idx, w, row, length = idx[some], w[some], row[some], length[some]
        ends = np.concatenate([[0], np.cumsum(length)])
        first = 0
        while first < len(idx):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PRODUCTS, side="right")) - 1)
            part = length[first:last]
            post = np.arange(ends[last] - ends[first]) + np.repeat(self.start[idx[first:last]] - (ends[first:last] - ends[first]), part)
            cell = self.row[post] * nt + np.repeat(row[first:last], part)
            sums = np.bincount(cell, weights=self.w[post] * np.repeat(w[first:last], part), minlength=self.n * nt).reshape(self.n, nt)
            out += sums if at is None else sums[at]
            first = last
        return out


def _block_bounds(asked: _Asked, folder: str, blocks: list) -> np.ndarray:
    """Products of the queries with the largest weights of every block."""
    out = np.zeros((asked.n, len(blocks)))
    first = 0
    while first < len(blocks):
        last, terms = first, 0
        while last < len(blocks) and (last == first or terms + blocks[last][2] <= BLOCK_VALUES):
            terms += blocks[last][2]
            last += 1
        tops = pa.concat_tables([_read(folder, bound) for _, bound, _ in blocks[first:last]])
        out[:, first:last] = asked.products(tops)
        first = last
    return out


class _Best:
    """The k best rows found so far of every query; a place without one has the similarity 0."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.similarities, self.ids = np.zeros((n, k)), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, similarities: np.ndarray, ids: np.ndarray) -> None:
        reached = (similarities > 0) & (similarities >= self.similarities[at, -1:])
        some = reached.any(axis=1)
        at, similarities = at[some], np.where(reached[some], similarities[some], 0.0)
        if not len(at):
            return
        rows, picks = _top_k(similarities, ids, self.k, True)
        found, names = np.zeros((len(at), self.k)), np.full((len(at), self.k), np.iinfo(np.int64).max)
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        found[rows, place], names[rows, place] = similarities[rows, picks], ids[picks]
        found, names = np.hstack([self.similarities[at], found]), np.hstack([self.ids[at], names])
        order = np.lexsort((names, -found))[:, : self.k]
        self.similarities[at] = np.take_along_axis(found, order, axis=1)
        self.ids[at] = np.take_along_axis(names, order, axis=1)


def _searched(queries: pa.Table, folder: str, blocks: list, k: int, seeds: int) -> tuple[_Best, int]:
    """The k best rows of every query, and the number of pairs of a query and a block that were compared."""
    asked = _Asked(queries)
    bounds = _block_bounds(asked, folder, blocks)
    best, compared = _Best(queries.num_rows, k), 0
    unseen = bounds > 0
    # a sum in another order may lie a little lower
    slack = 2.0 * 10.0**-SIMILARITY_DIGITS

    def visit(t: int, near: np.ndarray) -> int:
        at = np.flatnonzero(near)
        if len(at):
            unseen[at, t] = False
            block = _read(folder, blocks[t][0])
            best.add(at, np.round(asked.products(block, at), SIMILARITY_DIGITS), block.column("id").to_numpy())
        return len(at)

    first = np.argsort(-bounds, axis=1, kind="stable")[:, :seeds]
    for t in np.unique(first):
        compared += visit(t, unseen[:, t] & (first == t).any(axis=1))
    # the k-th similarity grows with every block, so the likeliest blocks come first
    for t in np.argsort(-bounds.sum(axis=0), kind="stable"):
        compared += visit(t, unseen[:, t] & (bounds[:, t] + slack >= best.similarities[:, -1]))
    return best, compared


def nearest_by_bounds(
    queries: DataFrame, train: DataFrame, k: int, payload: Sequence[str] = (), block_rows: int = CLUSTER_ROWS, seeds: int = SEEDS,
    leaders: int = LEADERS, query_rows: int = SEARCH_ROWS, stats: dict | None = None, probe: DataFrame | None = None,
    counts: tuple[int, int] | None = None,
) -> DataFrame:
    """``nearest`` for sparse vectors without negative weights and positive similarities, without the blocks that cannot matter.

    Blocks of training rows are files in the shared folder, written once and read by the tasks that hold the queries, so
    nothing is copied for the pairs of blocks; the neighbours found are stored and the files removed.

    ``stats``, if given, gets the number of blocks of the training rows, of pairs of a query and a block, and of
    those that were compared.  ``probe`` (at most ``PROBE`` training rows, taken by hash) and ``counts`` of queries and
    training rows save scans where vectors are not stored.
    """
    spark, cores = queries.sparkSession, queries.sparkSession.sparkContext.defaultParallelism
    asked, total = counts or (queries.count(), train.count())
    probe = train.orderBy(F.xxhash64("id"), "id").limit(PROBE) if probe is None else probe
    few = probe.select("id", "idx", "w").toArrow()
    folder = shared_folder(spark, "blocks")
    blocks = _stored_blocks(_clustered(train, few, total, block_rows, leaders), folder)
    groups = max(math.ceil(asked / query_rows), min(3 * cores, math.ceil(asked / SMALL_BLOCK)), 1)
    shared = spark.sparkContext.broadcast(blocks)
    pairs = spark.sparkContext.accumulator(0)

    def search(table: pa.Table) -> pa.Table:
        ids, found, names, first = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        # a group of many values is searched in parts
        for part in _cut(table.select(["id", "idx", "w"])) if shared.value else ():
            best, compared = _searched(part, folder, shared.value, k, seeds)
            pairs.add(compared)
            row, place = np.nonzero(best.similarities > 0)
            ids.append(part.column("id").to_numpy()[row])
            names.append(best.ids[row, place])
            found.append(best.similarities[row, place])
            first.append(place == 0)
        return pa.table({"id": np.concatenate(ids), "neighbor_id": np.concatenate(names), "similarity": np.concatenate(found), "first": np.concatenate(first)})

    dealt = queries.where(F.col("id").isNotNull()).select("id", "idx", "w", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(groups)).alias("_q"))
    local = dealt.groupBy("_q").applyInArrow(search, _FOUND + ", first boolean")
    # rows of one id share their neighbours: all of them count for each
    own = W.partitionBy("id")
    local = local.withColumn("_m", F.count_if("first").over(own)).withColumn("_r", F.row_number().over(own.orderBy(F.desc("similarity"), F.asc("neighbor_id"))))
    ranks = F.sequence((F.col("_r") - 1) * F.col("_m") + 1, F.least(F.col("_r") * F.col("_m"), F.lit(k).cast("long")))
    local = local.where((F.col("_r") - 1) * F.col("_m") < k)
    ranked = durable(local.select("id", "neighbor_id", "similarity", F.explode(ranks.cast("array<int>")).alias("rank")))
    drop_folder(spark, folder)
    shared.unpersist()
    collect_garbage(spark)
    if stats is not None:
        stats |= {"blocks": len(blocks), "pairs": len(blocks) * asked, "compared": pairs.value}
    return _with_payload(ranked, train, payload)


def weighted_mean(
    neighbors: DataFrame,
    models: Sequence[str],
    field: str,
    ks: Sequence[int],
    tiny: float = 1e-12,
) -> DataFrame:
    """``id, cells_<k>`` for every k: similarity-weighted means of the carried ``field`` arrays.

    One aggregate serves all k; ``cells_<k>`` is null when the weights add up to nothing.
    """
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums.append(F.sum(F.when(inside, F.col("similarity")).otherwise(0.0)).alias(f"_w_{k}"))
        for i in range(len(models)):
            term = F.col("similarity") * F.get(F.col(field), F.lit(i))
            sums.append(F.sum(F.when(inside, term).otherwise(0.0)).alias(f"_s_{k}_{i}"))
    grouped = neighbors.groupBy("id").agg(*sums)
    out = []
    for k in ks:
        weight = F.col(f"_w_{k}")
        cells = F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.try_divide(F.col(f"_s_{k}_{i}"), weight).alias("score"))
                for i, m in enumerate(models)
            ]
        )
        out.append(F.when(weight > tiny, cells).alias(f"cells_{k}"))
    return grouped.select("id", *out)


def dense_rewards(panel: DataFrame, models: Sequence[str], field: str = "reward", out: str = "rewards") -> DataFrame:
    """Add an array of one field in model order; a missing cell is an error."""
    values = C.values(F.col("cells"), field)
    message = F.concat(F.lit("query without all models: "), F.col("id").cast("string"))
    checked = F.when(F.size(values) != len(models), F.raise_error(message).cast("array<double>")).otherwise(values)
    return panel.withColumn(out, checked)


# --- sparse kNN on text -----------------------------------------------------------

def text_neighbors(
    train: DataFrame, queries: DataFrame, spec: tfidf.TfidfSpec, k: int, payload: Sequence[str] = ()
) -> DataFrame:
    """Neighbours of query texts among training texts under a vocabulary fit on the training texts.

    Vectors are made once and written in blocks alone; the payload comes from the training texts.
    """
    model = tfidf.fit(train, spec)
    few = train.select("id", "query").orderBy(F.xxhash64("id"), "id").limit(PROBE)
    found = nearest_by_bounds(
        tfidf.transform(queries, model), tfidf.transform(train, model), k, probe=tfidf.transform(few, model), counts=(queries.count(), model.n_docs)
    )
    return _with_payload(found, train, payload)


def knn_scores(
    train: DataFrame,
    queries: DataFrame,
    models: Sequence[str],
    spec: tfidf.TfidfSpec = tfidf.SPECS["knn_router"],
    ks: Sequence[int] = (100,),
    tiny: float = 1e-12,
) -> dict[int, DataFrame]:
    """For every k, ``id, cells<model, score>`` of all queries.

    ``train`` is a panel with rewards.  A query that shares no term with any training text gets
    the mean training reward.
    """
    carried = dense_rewards(train, models).select("id", "query", "rewards")
    neighbors = text_neighbors(carried, queries, spec, max(ks), ("rewards",))
    means = weighted_mean(neighbors, models, "rewards", ks, tiny)
    scored = queries.select("id").join(means, "id", "left")
    fallback = global_cells(global_prior(train))
    return {k: scored.select("id", F.coalesce(F.col(f"cells_{k}"), fallback).alias("cells")) for k in ks}


def task_knn_scores(
    train: DataFrame,
    queries: DataFrame,
    models: Sequence[str],
    k: int = 100,
    knn_weight: float = 0.70,
    smoothing: float = 20.0,
    spec: tfidf.TfidfSpec = tfidf.SPECS["knn_router"],
) -> DataFrame:
    """Task-prior and kNN router: ``w * knn + (1 - w) * prior`` per cell; both sides carry ``task``."""
    knn = knn_scores(train, queries, models, spec, (k,))[k]
    priors = lookup_task_priors(queries.select("id", "task"), task_priors(train, smoothing), global_prior(train))
    joined = knn.join(priors.select("id", F.col("cells").alias("prior_cells")), "id")
    return C.add_field(
        joined,
        "score",
        lambda c: F.lit(knn_weight) * c["score"]
        + F.lit(1.0 - knn_weight) * C.value_of(F.col("prior_cells"), c["model"], "score"),
    ).drop("prior_cells")


def similar_examples(
    labelled: DataFrame, queries: DataFrame, k: int, max_chars: int = 600, spec: tfidf.TfidfSpec = tfidf.SPECS["retrieval"]
) -> DataFrame:
    """The k most similar labelled texts per query, with similarity, label and margin."""
    carried = labelled.select(
        "id", "query", "label", "margin", truncate_text(F.col("query"), max_chars).alias("example")
    )
    return text_neighbors(carried, queries, spec, k, ("label", "margin", "example"))


# --- dense kNN ---------------------------------------------------------------------

def unit(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    length = F.when(norm > 0, norm).otherwise(1.0)
    bound = F.struct(vector.alias("v"), length.alias("n"))
    return C.let(bound, lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def residual_scores(
    reference: DataFrame, queries: DataFrame, models: Sequence[str], k: int = 50, tiny: float = 1e-12
) -> DataFrame:
    """Similarity-weighted mean residual of the k nearest reference vectors, as cells.

    ``reference`` has ``id, vec, residuals``; similarities below zero weigh nothing, and a query
    without any positive one gets the mean residual.
    """
    neighbors = nearest(queries, reference, k, "dense", ("residuals",), positive_only=False)
    clipped = neighbors.withColumn("similarity", F.greatest("similarity", F.lit(0.0)))
    means = weighted_mean(clipped, models, "residuals", (k,), tiny)
    overall = reference.agg(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.avg(F.get(F.col("residuals"), F.lit(i))).alias("score"))
                for i, m in enumerate(models)
            ]
        ).alias("c")
    ).scalar()
    scored = queries.select("id").join(means, "id", "left")
    return scored.select("id", F.coalesce(F.col(f"cells_{k}"), overall).alias("cells"))


def apply_residuals(panel: DataFrame, residual_cells: DataFrame, weight: float) -> DataFrame:
    """score + weight * residual."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must lie in [0, 1]")
    joined = panel.join(residual_cells.select("id", F.col("cells").alias("_r")), "id", "left")

    def corrected(c: Column) -> Column:
        residual = C.value_of(F.col("_r"), c["model"], "score")
        message = F.concat(F.lit("no residual for model "), c["model"])
        return c["score"] + F.lit(weight) * F.when(residual.isNull(), F.raise_error(message).cast("double")).otherwise(residual)

    return C.add_field(joined, "score", corrected).drop("_r")


def warm_up(train: DataFrame, queries: DataFrame, width: int, k: int = 5, share: float = 0.2) -> DataFrame:
    """Mix every query vector with the mean of its k nearest training vectors and re-normalise.

    Neighbours are found on unit vectors; the mean is over the training vectors as given.
    Nothing happens for k <= 0 or share <= 0.
    """
    if k <= 0 or share <= 0:
        return queries.select("id", "vec")
    left = queries.select("id", unit(F.col("vec")).alias("vec"))
    right = train.select("id", unit(F.col("vec")).alias("vec"), F.col("vec").alias("raw"))
    neighbors = nearest(left, right, k, "dense", ("raw",), positive_only=False)
    means = neighbors.groupBy("id").agg(
        F.array(*[F.avg(F.get(F.col("raw"), F.lit(i))) for i in range(width)]).alias("near")
    )
    joined = queries.select("id", "vec").join(means, "id", "left")
    mixed = F.zip_with("vec", "near", lambda a, b: F.lit(1.0 - share) * a + F.lit(share) * b)
    mixed = joined.select("id", F.coalesce(mixed, F.col("vec").cast("array<double>")).alias("vec"))
    return mixed.select("id", unit(F.col("vec")).alias("vec"))
