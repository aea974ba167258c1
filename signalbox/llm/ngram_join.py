"""Jaccard self-join on word shingles by parity sketches.

A set's shingle hashes are dealt to pieces by their leading bits, and a piece is the exclusive
or of its hashes.  If two sets of sizes s and t reach the similarity p/100, they differ in at most
``D = (100 - p)(s + t) / (100 + p)`` hashes, so in at most D pieces.  In one order of all pieces,
each set shows its first D + 1 pieces that are not empty; by the pigeonhole principle two such
sets show a common one.  Pieces that a sample of the documents has often come last in the order,
which leaves results alone and keeps common passages from making candidates.

Sets that show a common piece are candidates.  Their parity sketches (bit i is the parity of the
hashes that fall on it) differ in no more bits than the sets differ in hashes, which rules most
pairs out; the rest is verified on the texts.  First all sets of a piece meet its first one.  Those
that are then outside its component meet the others in blocks by their sketches: first the
nearest one of each set and piece is verified, then, if any were left, all in other components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.components import components
from signalbox.llm.registry import register
from signalbox.llm.storage import partitions, stored
from signalbox.llm.text import lean, mix, words_of

PERCENT = 75
BASE = 3072
"""Sets smaller than this have 4,096 pieces; each larger band has sets and pieces four times as many."""
SAMPLE = 64
OFTEN = 4
HOT = 200_000
"""Pieces, at most, that are known to be frequent: a bound on what tasks are sent."""
BLOCK = 2048
PAIRS = 1 << 17
"""Pairs whose sketches are compared at a time."""
NEAREST = 1
"""Candidates in other components that a set is verified with in a block before it is with all."""
LABELS = 1_000_000
"""Nodes up to which the table of components is broadcast."""
BLOOM = 1 << 24


def bound(s: int, t: int, percent: int = PERCENT) -> int:
    """Most hashes in which two linked sets of these sizes differ."""
    return (100 - percent) * (s + t) // (100 + percent)


def node_hash(hashes: np.ndarray) -> int:
    """64 bits that name a set."""
    total = np.add.reduce(mix(hashes ^ np.uint64(0xA0761D6478BD642F)))
    return int(mix(np.array([total], dtype=np.uint64) + np.uint64(len(hashes))).view(np.int64)[0])


def sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch: 512 bits, or the power of two from 0.85 times the set's size on if that is more.

    Two unrelated sets of n hashes differ in about half of such bits, 0.4 n at least, and linked ones in 0.29 n at most.
    """
    bits = max(512, 1 << (17 * len(hashes) // 20).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as 64-bit words, folded to ``size`` bytes: a longer one holds the shorter one."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, dtype=np.uint64).reshape(-1, size // 8), axis=0) for s in sketches])


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the sketches of each pair differ, the longer one folded to the shorter."""
    sizes = np.array([min(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.bitwise_count(fold([a[i] for i in at], size) ^ fold([b[i] for i in at], size)).sum(axis=1, dtype=np.int64)
    return out


def pieces(hashes: np.ndarray, hot: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, prior): the keys that a set (sorted distinct hashes) shows, for each band in which it may find a partner.

    The order of pieces: those that are not in ``hot``, then the others by the count ``often``, then by key.  ``prior`` has
    for one of the others the one that the set shows before it, or 0.
    """
    n, out, prior = len(hashes), [], []
    band = 0
    while n >= BASE << (2 * band):
        band += 1
    bands = [(band, bound(n, 100 * n // percent, percent))]
    if band:
        top = (BASE << (2 * (band - 1))) - 1
        if top * 100 >= percent * n:
            # the larger partner of a set in the band below
            bands.append((band - 1, bound(n, top, percent)))
    for b, most in bands:
        if n == 1 or most == 0:
            # only an equal set reaches the similarity, and that is the same node
            continue
        place = hashes >> np.uint64(64 - 12 - 2 * b)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        keys = mix(np.bitwise_xor.reduceat(hashes, first) ^ mix(place[first] * np.uint64(64) + np.uint64(b)))
        if len(keys) <= most:
            raise ValueError("pieces of a set collide beyond all chance")
        if len(hot):
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            common = hot[at] == keys
            rare = keys[~common]
            if len(rare) > most:
                keys = rare
            else:
                order = np.lexsort((keys[common], often[at[common]]))
                shown = keys[common][order[: most + 1 - len(rare)]]
                out += [rare, shown]
                prior += [np.zeros(len(rare) + 1, dtype=np.uint64), shown[:-1]]
                continue
        out.append(np.partition(keys, most)[: most + 1])
        prior.append(np.zeros(most + 1, dtype=np.uint64))
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(out), np.concatenate(prior)


def sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of all texts."""
    for first, last, words in words_of(column):
        hashes, bounds = words.shingles()
        for i in range(last - first):
            yield first + i, np.unique(hashes[bounds[i] : bounds[i + 1]])


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, sketch): mark tells texts of one id apart; a text without words has no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, s in sets(batch.column(1)):
                rows.append((len(s), node_hash(s), sketch(s)) if len(s) else (0, None, None))
            n, node, bits = zip(*rows) if rows else ((), (), ())
            made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], ["doc_id", "mark", "n", "node", "sketch"])

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(lean(run), "doc_id long, mark long, n long, node long, sketch binary")


def frequent_pieces(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pieces that several documents of a sample by hash show or could show, sorted, and their counts.

    ``HOT`` keys at most: the least count is chosen from the counts of counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for _, s in sets(batch.column(1)):
                if len(s) and (node := node_hash(s)) not in seen:
                    seen.add(node)
                    place = s >> np.uint64(52)
                    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    found.append(mix(np.bitwise_xor.reduceat(s, first) ^ mix(place[first] * np.uint64(64))))
            key, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counted = stored(sample.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "frequent")
    # powers of two keep the counts of counts few
    level = F.floor(F.log2("n")).cast("int")
    total, least = 0, OFTEN
    for power, n in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > HOT:
            least = 2 << power
            break
    rows = sorted(counted.where(F.col("n") >= least).collect(), key=lambda r: r[0] % (1 << 64))
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=np.int64)


def stars(docs: DataFrame, hot: np.ndarray, often: np.ndarray, percent: int) -> DataFrame:
    """(key, hub, node, prior, several) for all pieces shown by two nodes or more: hub is the first of them, node
    another one with its prior piece, and ``several`` says whether there are three or more."""

    def shown(*columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "node", "prior"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, owners, priors, held = [], [], [], 0
            for _, s in sets(batch.column(1)):
                if not len(s):
                    continue
                node = node_hash(s)
                if node in seen:
                    continue
                if len(seen) >= 100_000:
                    # forgotten copies come again and are merged after the shuffle
                    seen.clear()
                seen.add(node)
                own, prior = pieces(s, hot, often, percent)
                keys.append(own.view(np.int64))
                priors.append(prior.view(np.int64))
                owners.append(np.full(len(own), node))
                held += len(own)
                if held > 300_000:
                    yield shown(keys, owners, priors)
                    keys, owners, priors, held = [], [], [], 0
            if held:
                yield shown(keys, owners, priors)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the last group: its key, hub, last node and size; its second node waits for a third
        last_key, hub, last_node, size, waiting = None, 0, None, 0, None

        def rows(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "hub", "node", "prior", "several"])

        for batch in batches:
            if not len(batch):
                continue
            key, node, prior = (c.to_numpy() for c in batch.columns)
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            fresh = new | np.concatenate([[node[0] != last_node], node[1:] != node[:-1]])
            key, node, prior, new = key[fresh], node[fresh], prior[fresh], new[fresh]
            if not len(key):
                continue
            if waiting is not None:
                yield rows(*([x] for x in waiting), [not new[0]])
                waiting = None
            goes_on = not new[0]
            start = np.flatnonzero(new)
            if goes_on:
                start = np.concatenate([[0], start])
            group = np.cumsum(new) - (not goes_on)
            lengths = np.diff(np.concatenate([start, [len(key)]]))
            hubs, rank, sizes = node[start], np.arange(len(key)) - start[group] + 1, lengths.copy()
            if goes_on:
                hubs[0] = hub
                rank[group == 0] += size
                sizes[0] += size
            last_key, hub, last_node, size = key[-1], hubs[-1], node[-1], int(sizes[-1])
            keep = rank > 1
            if size == 2 and keep[-1]:
                waiting = (key[-1], hub, node[-1], prior[-1])
                keep[-1] = False
            yield rows(key[keep], hubs[group][keep], node[keep], prior[keep], (sizes > 2)[group][keep])
        if waiting is not None:
            yield rows(*([x] for x in waiting), [False])

    sent = docs.mapInArrow(lean(show), "key long, node long, prior long")
    dealt = sent.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(lean(gather), "key long, hub long, node long, prior long, several boolean")


def bloomed(docs: DataFrame, ids: DataFrame, without: bool = False) -> DataFrame:
    """Documents whose id may be among ``ids``, or ``without``, those whose id is not.

    A bit table of fixed size is broadcast, at most 262,144 rows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOOM))
    words = ids.select(slot("doc_id").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")
    )
    probe = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.when(F.col("doc_id").isNotNull(), slot("doc_id")).alias("slot"))
    found = probe.join(F.broadcast(words), F.shiftright("slot", 6) == F.col("word"), "left")
    maybe = F.coalesce(F.expr("shiftrightunsigned(bits, cast(slot % 64 AS int)) & 1L = 1L"), F.lit(False))
    return found.where(~maybe if without else maybe).select("row.*")


def verified(pairs: DataFrame, sets_: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose similarity is reached, as stored (u, v).

    Sizes and sketches rule out first; what is left is decided on the texts of the nodes' first documents.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (batch.column(i).to_numpy() for i in (2, 3))
            keep = np.minimum(s, t) * 100 >= percent * np.maximum(s, t)
            most = (100 - percent) * (s + t) // (100 + percent)
            left = pa.array(np.flatnonzero(keep))
            far = distances(batch.column(4).take(left).to_pylist(), batch.column(5).take(left).to_pylist())
            keep[keep] = far <= most[keep]
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    left = sets_.select(F.col("node").alias("a"), F.col("n").alias("s"), F.col("sketch").alias("x"), F.col("first").alias("i"))
    right = sets_.select(F.col("node").alias("b"), F.col("n").alias("t"), F.col("sketch").alias("y"), F.col("first").alias("j"))
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "s", "t", "x", "y")
    open_ = stored(both.mapInArrow(lean(possible), "a long, b long"), "pairs")
    wanted = open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct()
    first = stored(sets_.join(wanted, "node").select("node", F.col("first").alias("doc_id"), "mark"), "wanted")
    found = bloomed(docs, first.select("doc_id")).withColumn("mark", F.xxhash64("text"))
    texts = found.join(first, ["doc_id", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for (i, x), (_, y) in zip(sets(batch.column(2)), sets(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    full = open_.join(texts.select(F.col("node").alias("a"), F.col("text").alias("p")), "a")
    full = full.join(texts.select(F.col("node").alias("b"), F.col("text").alias("q")), "b").select("a", "b", "p", "q")
    return stored(full.mapInArrow(lean(decide), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def leftovers(star: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, open, prior, members) for pieces whose nodes beside the hub lie in several components.

    ``open`` marks nodes outside the component of the piece's hub; the hub itself has been compared with all.  Two nodes with
    the same prior piece meet there, too, so a piece whose nodes all have the same one is left out.
    """
    known = labels.select(F.col("node").alias("k"), "label")
    if labels.count() <= LABELS:
        known = F.broadcast(known)
    rows = star.where("several").join(known, F.col("node") == F.col("k"), "left").select("key", "hub", "node", "prior", F.coalesce("label", "node").alias("label"))
    rows = rows.join(known.withColumnRenamed("label", "other"), F.col("hub") == F.col("k"), "left")
    rows = rows.select("key", "node", "label", "prior", (F.col("label") != F.coalesce("other", "hub")).alias("open"))
    mixed = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.col("open").cast("long")).alias("opened"), F.min("prior").alias("low"), F.max("prior").alias("high")
    )
    mixed = mixed.where("members > 1 AND opened > 0 AND (low <> high OR low = 0)").select("key", "members")
    return stored(rows.join(mixed, "key"), "leftovers")


class Block:
    """Nodes of a block with their sketches, for comparison with others."""

    def __init__(self, parts: list[tuple]):
        self.node, self.label, self.n, self.prior = (np.concatenate([p[i] for p in parts]) for i in range(4))
        self.sketches = [x for p in parts for x in p[4]]
        self.size = np.array([len(x) for x in self.sketches], dtype=np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that have sketches of ``size`` bytes or more, folded to it, and the row of each node (or -1)."""
        if size not in self.folded:
            at = np.flatnonzero(self.size >= size)
            rows = np.full(len(self.size), -1)
            rows[at] = np.arange(len(at))
            self.folded[size] = fold([self.sketches[i] for i in at], size) if len(at) else np.zeros((0, size // 8), np.uint64), rows
        return self.folded[size]

    def near(self, other: Block, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(own place, other's place, bits apart) of pairs in different components that may be linked, own places ascending.

        Pairs with the same prior piece are left to that one.
        """
        step = max(1, PAIRS // max(1, len(other.node)))
        for low in range(0, len(self.node), step):
            own = slice(low, low + step)
            n, m, prior = self.n[own, None], other.n, self.prior[own, None]
            apart = (self.label[own, None] != other.label) & ((prior != other.prior) | (prior == 0))
            i, j = np.nonzero(apart & (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)))
            i += low
            size = np.minimum(self.size[i], other.size[j])
            far = np.empty(len(i), dtype=np.int64)
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                (x, p), (y, q) = self.by(width), other.by(width)
                for first in range(0, len(at), 8 * PAIRS // width):
                    some = at[first : first + 8 * PAIRS // width]
                    far[some] = np.bitwise_count(x[p[i[some]]] ^ y[q[j[some]]]).sum(axis=1, dtype=np.int64)
            close = far <= (100 - percent) * (self.n[i] + other.n[j]) // (100 + percent)
            yield i[close], j[close], far[close]


def in_blocks(left: DataFrame, sets_: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """(a, b, more): pairs of an open node and another one of its piece, in different components, that sketches allow.

    A piece's nodes are dealt to blocks of about ``BLOCK``, and every open node visits all of them; a
    task holds one block and the visitors that a batch brings.  With ``nearest`` a node keeps that many candidates
    in a block, so that pairs are as many as visits, and ``more`` marks the pairs of nodes that had others.
    """
    known = sets_.select("node", "n", "sketch")
    rows = left.join(known, "node").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    own = rows.select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "node", "label", "n", "prior", "sketch")
    visit = rows.where("open").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "node", "label", "n", "prior", "sketch")

    def pairs(probes: Block, members: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, far in probes.near(members, percent):
            more = np.zeros(len(i), dtype=bool)
            if nearest is not None and len(i):
                order = np.lexsort((members.node[j], far, i))
                i, j = i[order], j[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                size = np.diff(np.concatenate([first, [len(i)]]))
                keep = np.arange(len(i)) - np.repeat(first, size) < nearest
                more = np.repeat(size > nearest, size)[keep]
                i, j = i[keep], j[keep]
            a, b = probes.node[i], members.node[j]
            yield np.minimum(a, b), np.maximum(a, b), more

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, members, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            key, number, role, node, label, n, prior = (batch.column(i).to_numpy() for i in range(7))
            bits = batch.column(7).to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])]))
            out = []
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
                if (key[low], number[low]) != place:
                    place, members, block = (key[low], number[low]), [], None
                part = (node[low:high], label[low:high], n[low:high], prior[low:high], bits[low:high])
                if role[low] == 0:
                    # the members of a block come before its visitors
                    members.append(part)
                elif members:
                    block = block or Block(members)
                    out += pairs(Block([part]), block)
            if out:
                yield _pairs(out)

    dealt = own.unionByName(visit).repartition(partitions(left.sparkSession), "key", "block").sortWithinPartitions("key", "block", "role")
    return dealt.mapInArrow(lean(compare), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def _pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, more = (np.concatenate(x) for x in zip(*parts))
    _, first = np.unique(np.stack([a, b, more.astype(np.int64)], axis=1), axis=0, return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(more[first])], ["a", "b", "more"])


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only old components and new nodes are gone through again."""
    known = labels.select(F.col("node").alias("k"), F.col("label"))
    edges = links.join(known.withColumnRenamed("label", "x"), F.col("u") == F.col("k"), "left").drop("k")
    edges = edges.join(known.withColumnRenamed("label", "y"), F.col("v") == F.col("k"), "left")
    edges = edges.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")).distinct()
    higher = components(edges).select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = labels.join(higher, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = higher.join(labels.select("node"), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return stored(moved.unionByName(fresh), "labels")


def join_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, class, n_shingles, component_id): the smallest id that each document reaches by links.

    ``mark`` is a hash of the text, which tells rows of one id apart, and ``class`` names the component (null
    without words): those of one id's texts may differ and yet have the same smallest id.

    Documents link when their sets of distinct five-word shingles have the similarity
    ``percent`` / 100; with fewer words the whole sequence is the one shingle.  Null and empty
    texts have size 0 and stay alone; equal rows link as equal texts do.  A row without an id is in
    the component of its equals that have one; a text that only such rows have links with nothing
    and has a null component.  Words are lower-cased from A to Z.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stored(nodes(docs), "nodes")
    sets_ = table.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("place"),
    ).select("node", "n", "sketch", F.col("place.doc_id").alias("first"), "place.mark")
    sets_ = stored(sets_, "sets")
    star = stored(stars(docs, *frequent_pieces(docs), percent), "stars")
    pairs = star.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = components(verified(pairs, sets_, docs, percent))
    tested = None
    for nearest in (NEAREST, None):
        found = in_blocks(leftovers(star, labels), sets_, percent, nearest)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = stored(found, "found")
        tested = found.select("a", "b")
        more = found.agg(F.max("more")).first()[0]
        if more is not None:
            labels = merged(labels, verified(found.select("a", "b"), sets_, docs, percent))
        if not more:
            break
    joined = sets_.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    members = joined.join(least, "label").select(F.col("node").alias("k"), F.col("label").alias("class"), "component_id")
    out = table.join(members, F.col("node") == F.col("k"), "left")
    return out.select("doc_id", "mark", "class", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_class(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that another one of their class, with the smallest id, stands for.

    Columns are unchanged, whatever their names.  Of the rows that have the smallest id of a class one stays, the one with
    the least hash of its text; rows of one id with texts of different classes are told apart.  Rows
    without an id stay, as nothing names them, and texts without words stay, one for each id and text.  An empty table stays empty.
    Only documents whose id may be among the removed or repeated ones are shuffled.
    """
    classes = stored(join_classes(docs, percent).where("doc_id IS NOT NULL"), "classes")
    heads = classes.where("doc_id = component_id AND class IS NOT NULL").select("class", "doc_id", "mark")
    # classes of which rows with different texts have the smallest id
    twice = heads.groupBy("class").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least <> most")
    removed = heads.join(twice, "class").where("mark <> least").select("doc_id", "mark")
    removed = removed.unionByName(classes.where("doc_id <> component_id").select("doc_id", "mark")).distinct()
    repeated = classes.groupBy("doc_id").count().where("count > 1").select("doc_id")
    removed = stored(removed, "removed")
    touched = stored(removed.select("doc_id").unionByName(repeated).distinct(), "touched")
    # one row of an id's equal ones: chosen by the columns that can be compared
    near = bloomed(docs, touched).select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    near = near.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("mark"))
    kept = near.join(removed, ["doc_id", "mark"], "left_anti").select("row.*").dropDuplicates(["doc_id", "text"])
    return bloomed(docs, touched, without=True).unionByName(kept)


@register("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark", "class")
