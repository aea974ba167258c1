"""Maximal periodic runs of words by maximal pairs.

The suffixes of a text are sorted by doubling, and neighbours' common prefixes come from the ranks
of all doublings.  The tree of common-prefix intervals is gone through bottom-up; an interval keeps
its positions in order, and again by the word to the left of them.  When two children meet, a pair
of positions with different left words is a maximal pair: it extends neither to the left nor, as
the children differ after the common prefix, to the right.  If the prefix is at least
``times - 1`` distances long, the stretch that it spans is a run, and every run is found so.

Only suffixes that share with another one of their text as many words as the shortest run needs
enter the tree.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.cells import let
from signalbox.llm.registry import register
from signalbox.llm.text import mix, words_of

LEAST = 24
TIMES = 3
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shortest_prefix(least: int, times: int) -> int:
    """Fewest words that the two positions of a run's pair have in common."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def recurring(words: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions whose next ``size`` words come again in their text (or seem to, by hash)."""
    gram, width = words, 1
    while width < size:
        step = min(width, size - width)
        if len(gram) <= step:
            return np.zeros(0, dtype=np.int64)
        gram = mix(gram[:-step] * _SPREAD + gram[step:] + np.uint64(step))
        width += step
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(gram)]
    valid = np.flatnonzero(np.arange(len(gram)) + size <= bounds[1:][owner])
    own = gram[valid] ^ mix(owner[valid].astype(np.uint64) + _SPREAD)
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return valid[twice[at] == own]


def ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Order of all positions by their next 1, 2, 4, ... words; ``ends`` are the ends of the positions' texts."""
    n = len(words)
    places = np.arange(n)
    longest = int((ends - places).max())
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1]
    width = 1
    while width < longest:
        last = levels[-1]
        ahead = np.zeros(n, dtype=np.int64)
        inside = places + width < ends
        ahead[inside] = last[places[inside] + width]
        made, rank = np.unique(last * (n + 1) + ahead, return_inverse=True)
        levels.append(rank + 1)
        width *= 2
        if len(made) == n:
            break
    return levels


def common_prefixes(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from the positions ``a`` and ``b`` of one text on."""
    total = np.zeros(len(a), dtype=np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + total, b + total
        fits = (x < ends[a]) & (y < ends[b])
        same = np.zeros(len(a), dtype=bool)
        same[fits] = levels[t][x[fits]] == levels[t][y[fits]]
        total += same.astype(np.int64) << t
    return total


class Positions:
    """The positions of an interval in ascending order, all of them and by their left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, position: int, left: int):
        self.all, self.by_left = [position], {left: [position]}

    def others(self, left: int, low: int, high: int) -> Iterator[int]:
        """Positions from ``low`` to ``high`` with another left word.

        Those with the same one are passed over by halving: up to the first other one, both lists agree.
        """
        every, own = self.all, self.by_left.get(left, [])
        a, b = bisect_left(every, low), bisect_right(every, high)
        x, y = bisect_left(own, low), bisect_right(own, high)
        while b - a > y - x:
            least, most = 0, y - x
            while least < most:
                middle = (least + most + 1) // 2
                if every[a + middle - 1] == own[x + middle - 1]:
                    least = middle
                else:
                    most = middle - 1
            a, x = a + least + 1, x + least
            yield every[a - 1]

    def take(self, other: Positions) -> None:
        if len(other.all) > 8:
            self.all = sorted(self.all + other.all)
        else:
            for p in other.all:
                insort(self.all, p)
        for left, more in other.by_left.items():
            own = self.by_left.get(left)
            if own is None:
                self.by_left[left] = more
            elif len(more) > 8:
                self.by_left[left] = sorted(own + more)
            else:
                for p in more:
                    insort(own, p)


def maximal_pairs(order: list[int], common: list[int], left: list[int], floor: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, distance) of the stretches that maximal pairs of one text span.

    ``order`` has the suffixes in ascending order, ``common[k]`` the common prefix of the k-th and the
    one before, ``left`` the word to the left of the k-th.
    """

    def met(a: Positions, b: Positions, prefix: int) -> tuple[Positions, list[tuple[int, int, int]]]:
        if len(a.all) < len(b.all):
            a, b = b, a
        found, far, near = [], prefix // (times - 1), max(1, least - prefix)
        for word, positions in b.by_left.items():
            for p in positions:
                for q in a.others(word, p - far, p + far):
                    if abs(p - q) >= near:
                        found.append((min(p, q), prefix + abs(p - q), abs(p - q)))
        a.take(b)
        return a, found

    nodes, prefixes = [], []
    for k in range(len(order) + 1):
        shared = common[k] if k < len(order) and k else 0
        while prefixes and prefixes[-1] > shared:
            b, a = nodes.pop(), nodes.pop()
            node, found = met(a, b, prefixes.pop())
            nodes.append(node)
            yield from found
        if k == len(order):
            return
        if shared < floor:
            nodes = [Positions(order[k], left[k])]
        else:
            prefixes.append(shared)
            nodes.append(Positions(order[k], left[k]))


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of the texts ``words[bounds[i]:bounds[i + 1]]``, sorted."""
    floor = shortest_prefix(least, times)
    places = recurring(words, bounds, floor)
    if not len(places):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    owners = np.searchsorted(bounds, places, side="right") - 1
    # the texts concerned, put together
    texts, owners = np.unique(owners, return_inverse=True)
    sizes = (bounds[1:] - bounds[:-1])[texts]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    places = places - bounds[texts][owners] + starts[owners]
    joined = words[np.repeat(bounds[texts] - starts[:-1], sizes) + np.arange(starts[-1])]
    ends = np.repeat(starts[1:], sizes)
    levels = ranks(joined, ends)
    order = np.lexsort((levels[-1][places], owners))
    places, owners = places[order], owners[order]
    common = np.zeros(len(places), dtype=np.int64)
    common[1:] = common_prefixes(levels, ends, places[:-1], places[1:])
    common[1:][owners[1:] != owners[:-1]] = 0
    left = np.where(places > starts[owners], levels[0][places - 1], -1)
    cuts = np.concatenate([[0], np.flatnonzero(owners[1:] != owners[:-1]) + 1, [len(owners)]])
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i = owners[a]
        local = (places[a:b] - starts[i]).tolist()
        for start, length, distance in maximal_pairs(local, common[a:b].tolist(), left[a:b].tolist(), floor, least, times):
            rows.append((texts[i], start, length, distance))
    if not rows:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    found = np.array(rows, dtype=np.int64)
    # multiples of a period span the same stretch; the smallest is the period
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])
    found = found[fresh]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return tuple(found.T)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, words, runs, collapsed) per row of ``docs``.

    ``words`` counts the words (runs of bytes that are not ASCII white space) of ``text``.  ``runs`` has
    every stretch of at least ``least`` words and ``times`` periods that no neighbouring word extends,
    as (start, length, period), by start, then period; ``period`` is the smallest one.  ``collapsed`` is
    the text without the words that come after the first period of a run, its words joined by one space.
    A null or empty text has no words, no runs and the empty text; repeated rows give equal rows, a null
    doc_id stays null, other columns are not read, an empty table gives no rows.  Texts are
    treated whole, row by row, without a shuffle; a task's memory follows its longest text.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            counts, out, sizes = [], [], np.zeros(len(batch), dtype=np.int64)
            kept = []
            for first, last, words in words_of(column, fold=False):
                counts.append(words.counts())
                text, start, length, period = find_runs(words.hash, words.bound, least, times)
                out.append((start, length, period))
                sizes[first:last] = np.bincount(text, minlength=last - first)
                cuts = np.searchsorted(text, np.arange(last - first + 1))
                for i in range(last - first):
                    own = column[first + i].as_py().encode().split()
                    if cuts[i] < cuts[i + 1]:
                        here = slice(cuts[i], cuts[i + 1])
                        change = np.zeros(len(own) + 1, dtype=np.int64)
                        np.add.at(change, start[here] + period[here], 1)
                        np.add.at(change, start[here] + length[here], -1)
                        own = [own[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    kept.append(b" ".join(own).decode())
            start, length, period = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
            fields = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            made = [pa.array(np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)), pa.ListArray.from_arrays(offsets, fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array(kept, pa.string())], ["doc_id", "words", "runs", "collapsed"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length by period, ties to the first; null if there is none."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by the crc32 of its id, has its words repeated periodically from one on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        turned = lambda at: F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < at["a"], i).otherwise(at["a"] + (i - at["a"]) % at["p"]).cast("int"))))
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), turned)).otherwise(F.lit(""))

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, tail)).otherwise(text).alias("text"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(with_periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", longest_run(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
