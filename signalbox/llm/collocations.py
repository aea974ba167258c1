"""Phrase collocations by prefix-free parsing.

The words of every piece of text are parsed into chunks.  A chunk begins at a trigger, a word whose
hash says so, and reaches over the next trigger by as many words as the longest phrase has less one, so
every phrase lies whole in the chunk in which it begins.  The distinct chunks of a language, with the
number of times that the parse has them, are the dictionary; from here on the texts are not read
again.  Phrases are counted inside distinct chunks, weighted, and only those that begin in a chunk's own
words, so an overlap counts once.

Counting goes by levels.  A phrase that occurs ``least`` times has parts that do, too, so hash counts of
one level, as a table of bits of fixed size, rule out most phrases of the next; what the tables let
through is counted by its words.  Counts and scores are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.llm.registry import register
from signalbox.llm.storage import partitions, stored
from signalbox.llm.text import Words, lean, mix, spans, texts, words_of

LEAST = 10
LONGEST = 3
CONTAINED = 50
FIRST = 2000
TRIGGER = 16
"""One word in so many, by hash, begins a chunk."""
FARTHEST = 64
"""A chunk without triggers is cut after so many words of its own."""
BITS = 26
"""The table that rules phrases out has 2 ** BITS bits, 8 MB, at any size of the corpus."""
SLICE = 1 << 21
"""Words of the dictionary, about, whose phrases one range of hashes holds."""
_FLUSH = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# bytes between words become spaces, those between pieces line feeds, and letters small
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 0x0A
_PLAIN[0x09] = 0x20
_PLAIN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def chunk_starts(words: Words, longest: int, trigger: int = TRIGGER, farthest: int = FARTHEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, own, end): words at which chunks begin, how many of their words are their own, and their ends."""
    n = len(words.start)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    breaks = np.concatenate([[0], np.cumsum(words.data == 0x0A)])[words.start]
    head = np.zeros(n, dtype=bool)
    head[0] = True
    head[1:] = breaks[1:] != breaks[:-1]
    head[words.bound[:-1][words.bound[:-1] < words.bound[1:]]] = True
    first = head | (words.hash % np.uint64(trigger) == 0)
    at = np.flatnonzero(first)
    # words since the last trigger: long stretches are cut at multiples
    first |= (np.arange(n) - at[np.cumsum(first) - 1]) % farthest == 0
    at = np.flatnonzero(first)
    own = np.diff(np.concatenate([at, [n]]))
    pieces = np.flatnonzero(head)
    piece_end = np.concatenate([pieces[1:], [n]])[np.searchsorted(pieces, at, side="right") - 1]
    return at, own, np.minimum(at + own + longest - 1, piece_end)


def joined(words: Words, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts of the words ``first[i]`` to ``end[i]``, with one space between them."""
    counts = end - first
    word = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    sizes = words.end[word] - words.start[word] + 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(words.start[word] - total[:-1], sizes) + np.arange(total[-1])
    out = words.data[np.minimum(source, len(words.data) - 1)]
    out[total[1:] - 1] = 0x20
    # the space after the last word is left out
    keep = np.ones(len(out), dtype=bool)
    last = np.cumsum(counts)
    keep[total[last] - 1] = False
    offsets = np.concatenate([[0], total[last] - np.arange(1, len(last) + 1)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out[keep])))


def _running(values: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the sequences ``values[cuts[i]:ends[i]]``."""
    longest = int((ends - cuts).max()) if len(cuts) else 0
    out = (ends - cuts).astype(np.uint64)
    for k in range(longest):
        here = np.flatnonzero(cuts + k < ends)
        out[here] = mix(out[here] * _SPREAD + values[cuts[here] + k])
    return out


def dictionary(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, chunk, own, freq): the distinct chunks of each language and how often the parse has them.

    ``own`` is the number of leading words in which phrases begin that count for this chunk.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(0))
            langs = pc.dictionary_encode(batch.column(1))
            code = langs.indices.to_numpy()
            for low, high in spans(offsets):
                part = _PLAIN[data[offsets[low] : offsets[high]]]
                words = Words(part, offsets[low : high + 1] - offsets[low], False)
                first, own, end = chunk_starts(words, longest)
                if not len(first):
                    continue
                lang = code[low:high][np.searchsorted(words.bound, first, side="right") - 1]
                names = _running(words.hash, first, end) ^ mix((own.astype(np.uint64) << np.uint64(20)) + lang.astype(np.uint64))
                _, at, freq = np.unique(names, return_index=True, return_counts=True)
                chunk = joined(words, first[at], end[at])
                key = pc.binary_join_element_wise(chunk, pa.array(own[at]).cast(pa.string()), langs.dictionary.take(pa.array(lang[at])), "\t")
                yield pa.RecordBatch.from_arrays([key, pa.array(freq)], ["key", "freq"])

    plain = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    found = plain.where("text IS NOT NULL").mapInArrow(lean(parse), "key string, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))
    # one narrow key is dealt; chunks have no tabs
    parts = F.split("key", "\t", 3)
    return found.select(parts[2].alias("lang"), parts[0].alias("chunk"), parts[1].cast("int").alias("own"), "freq")


class Grams:
    """The phrases of a batch of chunks: hashes, weights and places, by number of words."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = pc.dictionary_encode(batch.column(0))
        code = self.langs.indices.to_numpy()
        seeds = mix(np.array([zlib.crc32(x.as_py().encode()) for x in self.langs.dictionary], dtype=np.uint64) + _SPREAD)
        own, freq = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
        # one space is between words, and every chunk has its own count of them
        self.words = next(words_of(batch.column(1), False, limit=1 << 40))[2]
        bound = self.words.bound
        chunk = np.repeat(np.arange(len(own)), np.diff(bound))
        self.end, self.lang = bound[1:][chunk], code[chunk]
        self.freq = freq[chunk]
        self.at = np.flatnonzero(np.arange(len(chunk)) < bound[:-1][chunk] + own[chunk])
        self.hash = {1: mix(self.words.hash + seeds[self.lang])}

    def every(self, size: int) -> np.ndarray:
        """Hashes of the phrases of this size from all places on, across chunks too."""
        if size not in self.hash:
            self.hash[size] = mix(self.every(size - 1)[:-1] * _SPREAD + self.hash[1][size - 1 :] + np.uint64(size))
        return self.hash[size]

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the phrases of this size that begin in own words."""
        at = self.at[self.at + size <= self.end[self.at]]
        return at, self.every(size)[at]

    def passing(self, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those phrases whose parts of one word less are all in the table."""
        at, names = self.of(size)
        part = self.every(size - 1)
        keep = has(table, part[at]) & has(table, part[at + 1])
        return at[keep], names[keep]


def has(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = (names >> np.uint64(64 - BITS)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def frequent(chunks: DataFrame, sizes: list[int], least: int, table: Broadcast | None) -> np.ndarray:
    """A table of 2 ** BITS bits with those set that begin the hash of a phrase that occurs ``least`` times.

    Tasks send sorted hashes and their counts, cut by leading bits; each range of hashes gives its
    part of the table.  The bits that a range shares and the 40 after them stand for a hash: equal ones by
    chance let a phrase through that is counted by its words later.
    """
    words = chunks.agg(F.sum("own")).first()[0] or 0
    slices = 1 << min(20, max(6, (words // SLICE).bit_length()))
    cut = np.uint64(64 - slices.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            names, freq = summed(held, weights)
            ends = np.searchsorted(names >> cut, np.arange(slices + 1).astype(np.uint64))
            high, low = (names >> (cut - np.uint64(8))).astype(np.uint8), (names >> (cut - np.uint64(40))).astype("<u4")
            planes = [[x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] for x in (high, low, freq.astype("<i4"))]
            return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), *(pa.array(x, pa.binary()) for x in planes)], ["slice", "high", "low", "counts"])

        for batch in batches:
            if not len(batch):
                continue
            grams = Grams(batch)
            for n in sizes:
                at, names = grams.of(n) if table is None else grams.passing(n, np.frombuffer(table.value, dtype=np.uint8))
                # counts above the bound say no more than the bound
                held.append(names)
                weights.append(np.minimum(grams.freq[at], least).astype(np.int32))
                size += len(names)
            if size > _FLUSH:
                held, weights = ([x] for x in summed(held, weights))
                size = 0
                if len(held[0]) > _FLUSH:
                    yield flushed()
                    held, weights = [], []
        if held:
            yield flushed()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(len(batch)):
                key = batch.column(0)[i].as_py()
                high, low, counts = (np.frombuffer(batch.column(1 + k)[i].as_buffer(), dtype=t) for k, t in enumerate((np.uint8, "<u4", "<i4")))
                names = (high.astype(np.uint64) << (cut - np.uint64(8))) | (low.astype(np.uint64) << (cut - np.uint64(40)))
                # what comes waits until it is half as much as what is summed
                known, waiting = found.setdefault(key, ([], []))
                known.append(names)
                waiting.append(counts)
                if len(known) > 1 and sum(map(len, known[1:])) > max(_FLUSH, len(known[0]) // 2):
                    found[key] = tuple([x] for x in summed(known, waiting))
        out = []
        for key, (known, waiting) in found.items():
            names, freq = summed(known, waiting)
            bits = np.zeros((1 << BITS) // slices, dtype=bool)
            place = (names[freq >= least] >> np.uint64(64 - BITS)).astype(np.int64)
            bits[place] = True
            out.append((key, np.packbits(bits, bitorder="little").tobytes()))
        if out:
            key, bits = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    counted = chunks.mapInArrow(lean(count), "slice int, high binary, low binary, counts binary")
    parts = counted.repartition(min(slices, 2 * partitions(chunks.sparkSession)), "slice").mapInArrow(lean(decide), "slice int, bits binary")
    table = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    width = len(table) // slices
    for key, bits in parts.collect():  # slices rows, 8 MB together
        table[key * width : (key + 1) * width] = np.frombuffer(bits, dtype=np.uint8)
    return table


def summed(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in ascending order, and the sums of their counts."""
    name, count = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(name)
    name, count = name[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, dtype=np.int64)
    return name[first], np.add.reduceat(count, first) if len(first) else count


def phrase_counts(chunks: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all phrases up to ``longest`` words that occur ``least`` times."""
    context = chunks.sparkSession.sparkContext
    tables = [context.broadcast(frequent(chunks, [1, 2], least, None).tobytes())]
    for n in range(3, longest + 1):
        tables.append(context.broadcast(frequent(chunks, [n], least, tables[-1]).tobytes()))

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(t.value, dtype=np.uint8) for t in tables]
        for batch in batches:
            if not len(batch):
                continue
            grams = Grams(batch)
            for n in range(1, longest + 1):
                at, names = grams.of(n) if n < 3 else grams.passing(n, bits[n - 3])
                keep = has(bits[max(0, n - 2)], names)
                at, names = at[keep], names[keep]
                distinct, where, group = np.unique(names, return_index=True, return_inverse=True)
                freq = np.bincount(group, grams.freq[at], len(distinct)).astype(np.int64)
                at = at[where]
                key = pc.binary_join_element_wise(joined(grams.words, at, at + n), grams.langs.dictionary.take(pa.array(grams.lang[at])), "\t")
                yield pa.RecordBatch.from_arrays([key, pa.array(freq)], ["key", "f"])

    found = chunks.mapInArrow(lean(let_through), "key string, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    parts = F.split("key", "\t", 2)
    return found.select(parts[1].alias("lang"), parts[0].alias("phrase"), F.size(F.split(parts[0], " ")).alias("words"), "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score.

    Texts are lower-cased from A to Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs.  Phrases have 2 to ``longest`` words and occur a >= ``least`` times within pieces.  Of
    the cuts of a phrase into two parts that occur l and r times the one with the least
    ``floor(1000000 * a * a / (l * r))`` counts, the first one among equals.  A phrase goes if a longer
    one that holds it occurs ``contained`` percent of its times or more.  Ties go to the more frequent, then to the smaller
    phrase by its bytes.  n is the number of words of the language; a null language is ``und``.
    Null and empty texts have no words, repeated rows count again, doc_id and further columns are not
    read, and an empty table gives no rows.
    """
    if longest < 2 or longest > FARTHEST or least < 1:
        raise ValueError("phrases have two words at least")
    chunks = stored(dictionary(docs, longest), "chunks")
    counts = stored(phrase_counts(chunks, least, longest), "phrases")
    total = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    split = F.split("phrase", " ")
    phrases = counts.where("words > 1").withColumn("w", split).select("lang", "phrase", "words", "w", F.col("f").alias("a"))
    # parts of a phrase with fewer words, two at least
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    holders = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(holders, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {contained} * a").drop("longer")
    cuts = kept.select("lang", "phrase", "w", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    parts = counts.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # products of three counts pass 64 bits; 16 digits each leave 38 enough
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", *[x.alias(f"{c}_") for c, x in wide.items()])
    cuts = cuts.withColumn("score", F.expr("(cast(1000000 AS decimal(7,0)) * (a_ * a_)) div (l_ * r_)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


ORACLE = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, generate_subscripts(p, 1) AS piece, unnest(p) AS piece_text
    FROM (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)
), lists AS (
    SELECT lang, [x FOR x IN regexp_split_to_array(piece_text, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0
), grams AS (
    SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k
    FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
    SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), often AS (
    SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 10
), holders AS (
    SELECT lang, phrase, max(f) AS longer
    FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM often WHERE k = 3) GROUP BY lang, phrase
), kept AS (
    SELECT o.* FROM often o LEFT JOIN holders h ON o.lang = h.lang AND o.phrase = h.phrase
    WHERE o.k > 1 AND (h.longer IS NULL OR 100 * h.longer < 50 * o.f)
), cuts AS (
    SELECT lang, phrase, f AS a, w, k, unnest(range(1, k)) AS cut FROM kept
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best b JOIN totals t ON b.lang = t.lang
) WHERE rank <= 2000
"""


@register("op11_collocations", ORACLE)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
