"""Repeated substrings by merging the Burrows-Wheeler transforms of shards.

Equal strings have to meet before they can be found equal.  The minimizer of a string of ``length``
bytes, the least hash of its ``KEY`` bytes long parts, depends on its bytes alone, so the strings that
begin at neighbouring bytes and share a minimizer form a context, and equal strings lie in contexts of
one key.  A context whose key comes nowhere else cannot repeat.  Of equal contexts the first stands for
all, and all strings of the others repeat.  The distinct contexts of a key are then compared by their
bytes: contexts are dealt by key to buckets; a bucket's contexts form shards, each with its
Burrows-Wheeler transform; the transforms are merged without sorting suffixes again.

The merge refines the interleave of the shards: if it is right by the first h bytes, going from every
suffix to the one that begins earlier, in order of the bytes that come before, makes it right by h and
those.  After each round a block has the suffixes whose common prefix reaches so many bytes; a block of one
suffix leaves, as no earlier suffix can share more.  The blocks that are left after ``length`` bytes are
the repeated intervals, and all their strings but the first repeat.

Keys that a sample shows with many contexts, as at the ends of a passage in a third of all
documents, have contexts of one string each, whose key is the string's own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.ngram_join import bloomed
from signalbox.llm.registry import register
from signalbox.llm.storage import partitions, stored
from signalbox.llm.text import CHUNK, lean, mix, spans, texts

LENGTH = 100
KEY = 24
SAMPLE = 64
OFTEN = 24
"""Distinct contexts of a key in the sample, at least, that make it a frequent one."""
HOT = 1 << 20
"""Frequent keys, at most: with more samples a key has to come more often, so that their number has this bound."""
BUCKET = 8192
"""Contexts of a bucket, about."""
SHARD = 1 << 18
"""Bytes of a shard."""
LONGEST = 128
"""A context has at most so many strings."""
END = 0xFF  # never part of UTF-8
LAST = (1 << 63) - 1
"""Stands for a null doc_id: such rows come after all others."""
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 1 << 20


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all parts of ``size`` bytes."""
    out, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < size and len(out):
        step = min(width, size - width)
        out = out[:-step] * (_SPREAD + np.uint64(2 * width)) + (out[step:] ^ (out[step:] >> np.uint64(29)))
        width += step
    return mix(out)


def best_of(values: np.ndarray, width: int, better: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or ``better``) one of every ``width`` values in a row."""
    out, have = values, 1
    while have < width and len(out):
        step = min(have, width - have)
        out = better(out[:-step], out[step:])
        have += step
    return out


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, at, strings, key, content, within) of all contexts of the texts ``data[offsets[i]:offsets[i + 1]]``.

    A context has the strings that begin at the bytes ``at`` to ``at + strings - 1``; its content is a hash
    of all their bytes.  If one of its strings begins twice in it, its key comes twice: ``within`` is 1.
    """
    size = min(KEY, max(1, length // 2))
    part = rolled(data, size)
    width = length - size + 1
    least = best_of(part, width)
    n = len(least)
    if not n:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][owner]
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(head)
    stop = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~head[1:], [False]])) + 1
    long = stop - at
    if len(long) and long.max() > LONGEST:
        times = -(-long // LONGEST)
        at = np.repeat(at, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * LONGEST
        stop = np.minimum(at + LONGEST, np.repeat(stop, times))
    key = least[at]
    # parts that are the least of a string; neighbours among them that are equal
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(part == best_of(np.concatenate([edge, least, edge]), width, np.maximum))
    pair = np.flatnonzero(part[chosen[1:]] == part[chosen[:-1]])
    place = np.searchsorted(chosen[pair], at)
    beyond = np.append(chosen[1:][pair], len(data))
    within = (beyond[place] < stop + width - 1).astype(np.int64)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        single = hot[place] == key
        if single.any():
            counts = np.where(single, stop - at, 1)
            base = np.repeat(at, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            stop = np.where(np.repeat(single, counts), base + 1, np.repeat(stop, counts))
            alone = np.repeat(single, counts)
            key, at, within = np.repeat(key, counts), base, np.where(alone, 0, np.repeat(within, counts))
        else:
            alone = None
    else:
        alone = None
    content = spanned(data, at, stop + length - 1)
    if alone is not None:
        # another function of the same bytes
        key = np.where(alone, mix(content ^ _SPREAD), key)
    return owner[at], at - offsets[owner[at]], stop - at, key, content, within


def spanned(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the bytes ``data[low[i]:high[i]]``, from running sums."""
    out = np.zeros(len(low), dtype=np.uint64)
    codes = mix((np.arange(256).astype(np.uint64) + np.uint64(1)) * _SPREAD)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    first = 0
    while first < len(low):
        # as many as lie in a stretch of bounded length
        last = max(first + 1, int(np.searchsorted(low, low[first] + CHUNK, side="right")))
        a, b = int(low[first]), int(high[first:last].max())
        powers = np.full(b - a + 1, base, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(b - a + 1, inverse, dtype=np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        running = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(codes[data[a:b]] * powers[:-1], out=running[1:])
        here = slice(first, last)
        out[here] = mix((running[high[here] - a] - running[low[here] - a]) * back[low[here] - a] + (high[here] - low[here]).astype(np.uint64))
        first = last
    return out


class Shard:
    """Order of the suffixes of some strings by their first ``length`` bytes, and the bytes before them.

    Strings are read as rings closed by ``END``; numbers of suffixes begin at ``base``.
    """

    def __init__(self, strings: list[bytes], length: int, base: int):
        self.data = np.frombuffer(b"".join(s + bytes([END]) for s in strings), dtype=np.uint8)
        sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        string = np.repeat(np.arange(len(strings)), sizes)
        own, ring = start[string], sizes[string]
        place = np.arange(len(self.data)) - own
        ahead = lambda x, h: x[own + (place + h) % ring]
        packed, width = self.data.astype(np.uint64), 1
        while width < 8:
            packed = (packed << np.uint64(8 * width)) | ahead(packed, width)
            width *= 2
        rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
        while width < length:
            step = min(width, length - width)
            rank = np.unique(rank * len(rank) + ahead(rank, step), return_inverse=True)[1].astype(np.int64)
            width += step
        order = np.argsort(rank, kind="stable")
        place_of = np.empty_like(order)
        place_of[order] = np.arange(len(order))
        before = own + (place - 1) % ring
        self.last = self.data[before[order]]
        """The transform: the byte before every suffix, in their order."""
        self.back = base + place_of[before[order]]
        """Number of the suffix that begins one byte earlier."""
        self.string, self.place = string[order], place[order]


def merged(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, block) of the merged shards: the suffixes that share ``length`` bytes with another one, in order.

    Suffixes share them if their blocks are equal.
    """
    last = np.concatenate([s.last for s in shards])
    back = np.concatenate([s.back for s in shards])
    # two bytes a round: the one before and the one before that
    pair = last.astype(np.uint16) + (last[back].astype(np.uint16) << np.uint16(8))
    twice = back[back]
    suffix, block = np.arange(len(last)), np.zeros(len(last), dtype=np.int64)
    done = 0
    while done < length and len(suffix):
        step = min(2, length - done)
        came = (pair if step == 2 else last)[suffix]
        order = np.argsort(came, kind="stable")
        suffix, block, came = (twice if step == 2 else back)[suffix[order]], block[order], came[order]
        fresh = np.concatenate([[True], (came[1:] != came[:-1]) | (block[1:] != block[:-1])])
        done += step
        several = ~(fresh & np.concatenate([fresh[1:], [True]]))
        suffix, block = suffix[several], np.cumsum(fresh)[several]
    return suffix, block


def repeated(strings: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(string, first, count): ranges of places at which a part of ``length`` bytes begins that begins earlier, too.

    Earlier is a smaller string number, or a smaller place in the same string.
    """
    shards, group, size, base = [], [], 0, 0
    first = []
    for i, s in enumerate(strings):
        group.append(s)
        size += len(s) + 1
        if size >= SHARD or i == len(strings) - 1:
            first.append(np.full(size, i + 1 - len(group)))
            shards.append(Shard(group, length, base))
            base, group, size = base + size, [], 0
    if not shards:
        return []
    suffix, block = merged(shards, length)
    string = np.concatenate([s.string for s in shards])[suffix] + np.concatenate(first)[suffix]
    place = np.concatenate([s.place for s in shards])[suffix]
    whole = place + length <= np.array([len(s) for s in strings], dtype=np.int64)[string]
    string, place, block = string[whole], place[whole], block[whole]
    order = np.lexsort((place, string, block))
    again = order[1:][block[order][1:] == block[order][:-1]]
    at = np.sort((string[again] << 32) + place[again])
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate([cuts, [len(at)]]))
    return [(int(a >> 32), int(a & 0xFFFFFFFF), int(c)) for a, c in zip(at[cuts], counts)]


_ROW = np.dtype([("key", "i8"), ("content", "i8"), ("doc", "i8"), ("mark", "i8"), ("span", "i8"), ("within", "i8")])
"""A context: its key, a hash of its bytes, its text, the place of its first string times 256 plus their number, and
whether one of them may begin twice in it."""


def _rows(batch: pa.RecordBatch, length: int, hot: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts of (doc, mark, text)."""
    doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    data, offsets = texts(batch.column(2))
    for low, high in spans(offsets):
        text, at, strings, key, content, within = contexts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], length, hot)
        rows = np.empty(len(text), dtype=_ROW)
        rows["key"], rows["content"] = key.view(np.int64), content.view(np.int64)
        rows["doc"], rows["mark"], rows["span"] = doc[low:high][text], mark[low:high][text], at * 256 + strings
        rows["within"] = within
        yield rows


def _unlike(rows: np.ndarray, *names: str) -> np.ndarray:
    """Whether each row but the first differs from the one before in a column."""
    out = np.zeros(max(0, len(rows) - 1), dtype=bool)
    for name in names:
        out |= rows[name][1:] != rows[name][:-1]
    return out


def _columns(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def hot_keys(rows: DataFrame, length: int, sample: int, often: int) -> np.ndarray:
    """Sorted keys that many distinct contexts of a sample of the texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _rows(batch, length, np.zeros(0, dtype=np.uint64)):
                yield _columns(["key", "content"], rows["key"], rows["content"])

    some = rows.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(sample)) == 0)
    counted = some.mapInArrow(lean(run), "key long, content long").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)
    counted = stored(counted, "keys")
    total = counted.agg(F.sum("n")).first()[0] or 0
    # keys with n contexts are at most the n-th part of the sum
    keys = [r[0] for r in counted.where(F.col("n") >= max(often, total // HOT)).select("key").collect()]
    return np.sort(np.array(keys, dtype=np.int64).view(np.uint64))


def candidates(rows: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """(doc, mark, span, key): copies of contexts, all of whose strings repeat, with no key; and the first ones of
    distinct contexts that share a key or may repeat within.

    A task keeps the first one of equal contexts and sends it by its key; copies are known at once and
    sent by place, so that a key of many copies does not meet in one task.
    """
    names = ["dealt", "copy", "content", "doc", "mark", "span", "within"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held)
            found = found[np.lexsort((found["span"], found["mark"], found["doc"], found["content"], found["key"]))]
            found = found[np.concatenate([[True], _unlike(found, *_ROW.names)])]
            copy = ~np.concatenate([[True], _unlike(found, "key", "content")])
            spread = mix(found["doc"].view(np.uint64) + found["span"].view(np.uint64) * _SPREAD).view(np.int64)
            dealt, content = np.where(copy, spread, found["key"]), np.where(copy, 0, found["content"])
            for low in range(0, len(found), 100_000):
                part = slice(low, low + 100_000)
                yield _columns(names, dealt[part], copy[part], content[part], *(found[c][part] for c in names[3:]))

        for batch in batches:
            for rows in _rows(batch, length, hot):
                if len(rows):
                    held.append(rows)
                    size += len(rows)
                if size > _FLUSH:
                    yield from flushed()
                    held, size = [], 0
        if size:
            yield from flushed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row; whether its key has several contexts; if not, the first one of its only context
        last, several, waiting = None, False, None

        def out(rows: np.ndarray, copy: np.ndarray) -> pa.RecordBatch:
            made = [pa.array(np.ascontiguousarray(rows[c])) for c in ("doc", "mark", "span")]
            return pa.RecordBatch.from_arrays([*made, pa.array(np.ascontiguousarray(rows["key"]), mask=copy)], ["doc", "mark", "span", "key"])

        for batch in batches:
            if not len(batch):
                continue
            rows = np.empty(len(batch), dtype=_ROW)
            for i, c in ((0, "key"), (2, "content"), (3, "doc"), (4, "mark"), (5, "span"), (6, "within")):
                rows[c] = batch.column(i).to_numpy()
            copy = batch.column(1).to_numpy(zero_copy_only=False)
            if copy.any():
                yield out(rows[copy], np.ones(copy.sum(), dtype=bool))
            rows = rows[~copy]
            if not len(rows):
                continue
            # the last row leads, to be compared with
            lead = last is not None
            line = np.concatenate([last, rows]) if lead else rows
            new = lambda *by: np.concatenate([np.ones(int(not lead), dtype=bool), _unlike(line, *by)])
            keep = new(*_ROW.names)
            new_key, first = new("key")[keep], new("key", "content")[keep]
            rows = rows[keep]
            if not len(rows):
                continue
            group = np.cumsum(new_key)
            counts = np.bincount(group, first * (1 + rows["within"]), group[-1] + 1)
            goes_on = not new_key[0]
            if goes_on and counts[0] and waiting is not None:
                yield out(waiting, np.zeros(1, dtype=bool))
                several, waiting = True, None
            open_ = counts > 1
            open_[0] = goes_on and several
            some = ~first | open_[group]
            if some.any():
                yield out(rows[some], ~first[some])
            if group[-1] > 0:
                several = bool(open_[-1])
                waiting = None if several else rows[first & (group == group[-1])]
            last = rows[-1:]

    sent = rows.mapInArrow(lean(send), "dealt long, copy boolean, content long, doc long, mark long, span long, within long")
    dealt = sent.repartition(partitions(rows.sparkSession), "dealt").sortWithinPartitions(*names)
    return dealt.mapInArrow(lean(gather), "doc long, mark long, span long, key long")


def compared(open_: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(doc, mark, span): the strings of distinct contexts of a key that another one has earlier."""
    buckets = open_.count() // BUCKET + 1
    lists = open_.groupBy("doc", "mark").agg(F.collect_list(F.struct("span", "key")).alias("found"))
    wanted = bloomed(rows.withColumnRenamed("doc", "doc_id"), open_.select(F.col("doc").alias("doc_id"))).withColumnRenamed("doc_id", "doc")
    raw = wanted.select("doc", "mark", F.col("text").cast("binary").alias("raw"))
    cut = lambda x: F.struct(
        F.pmod(F.xxhash64(x["key"]), F.lit(buckets)).alias("bucket"),
        x["span"].alias("span"),
        F.substring(F.col("raw"), F.shiftright(x["span"], 8).cast("int") + 1, (x["span"] % 256).cast("int") + F.lit(length - 1)).alias("bytes"),
    )
    strings = raw.join(lists, ["doc", "mark"]).select("doc", "mark", F.explode(F.transform("found", cut)).alias("x")).select("x.bucket", "doc", "mark", "x.span", "x.bytes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, strings = None, [], []

        def found() -> pa.RecordBatch:
            got = repeated(strings, length)
            made = [[places[i][0] for i, _, _ in got], [places[i][1] for i, _, _ in got], [((places[i][2] >> 8) + first) * 256 + n for i, first, n in got]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["doc", "mark", "span"])

        for batch in batches:
            for bucket, doc, mark, span, string in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and strings:
                    yield found()
                    places, strings = [], []
                now = bucket
                if not places or places[-1] != (doc, mark, span):
                    places.append((doc, mark, span))
                    strings.append(string)
        if strings:
            yield found()

    dealt = strings.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "doc", "mark", "span")
    return dealt.mapInArrow(lean(compare), "doc long, mark long, span long")


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def without_repeats(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: texts without what an earlier string of ``length`` bytes covers.

    Texts are taken as UTF-8 bytes, and strings do not cross them.  A byte goes if a string of ``length``
    bytes covers it that also begins earlier: in a document with a smaller id, or at a smaller place
    of the same one.  Overlapping occurrences count, and all is judged on the texts as they come.  ``spans`` are the
    maximal runs that go, as (start, length); ``kept`` are the other bytes.

    A null or empty text, or one with fewer than ``length`` bytes, is kept.  Rows of one id with
    different texts are ordered by a hash of the text; rows equal in id and text are one document, and each gets
    its result.  Rows without an id come after all others.  Other columns are not read; an empty table
    gives no rows.  ``sample`` and ``often`` say which keys are taken for frequent, and change no result.
    """
    if not 16 <= length <= 100_000:
        raise ValueError("strings have 16 to 100,000 bytes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    long = rows.where(F.octet_length("text") >= length).select("doc", "mark", "text")
    found = stored(candidates(long, length, hot_keys(long, length, sample, often)), "contexts")
    open_ = found.where("key IS NOT NULL")
    spans_ = found.where("key IS NULL").select("doc", "mark", "span").unionByName(compared(open_, long, length))
    lists = stored(spans_.groupBy("doc", "mark").agg(F.collect_list("span").alias("found")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for raw, found in zip(batch.column(1), batch.column(2)):
                raw = raw.as_py()
                sizes.append(len(raw))
                if not found.is_valid:
                    runs.append([])
                    kept.append(raw)
                    continue
                at = np.sort(found.values.to_numpy())
                first, stop = at >> 8, (at >> 8) + (at & 255) + length - 1
                stop = np.maximum.accumulate(stop)
                fresh = np.flatnonzero(np.concatenate([[True], first[1:] > stop[:-1]]))
                first, stop = first[fresh], stop[np.concatenate([fresh[1:], [len(at)]]) - 1]
                runs.append([{"start": a, "length": b - a} for a, b in zip(first.tolist(), stop.tolist())])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *stop.tolist()], [*first.tolist(), len(raw)])))
            made = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_SPAN)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_bytes", "spans", "kept"])

    touched, ids = rows.select(F.col("doc").alias("doc_id"), F.col("doc_id").alias("id"), "mark", "text"), lists.select(F.col("doc").alias("doc_id"))
    raw = F.col("text").cast("binary").alias("raw")
    near = bloomed(touched, ids).join(lists.withColumnRenamed("doc", "doc_id"), ["doc_id", "mark"], "left").select("id", raw, "found")
    rest = bloomed(touched, ids, without=True).select("id", raw, F.lit(None).cast("array<long>").alias("found"))
    return rest.unionByName(near).mapInArrow(lean(cut), "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")


@register("op12_repeated_bytes")
def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
