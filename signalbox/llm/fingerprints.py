"""Document fingerprints by one-permutation MinHash, with column functions only.

Shingles are hashed once; the upper eight bits of a hash name its bin, and a bin keeps its
smallest hash.  An empty bin takes the value of the first full bin in a random order of its
own (optimal densification), the same order for every text.  Of each value, mixed with its bin,
the low four bits are kept: 256 bins are 16 longs.  Different values agree in four bits with chance 1/16, for
which the likeness is corrected.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.registry import register
from signalbox.llm.storage import with_next

SHINGLE = 5
BINS = 256
BITS = 4
TRIES = 6
"""Bins an empty bin looks into by a fixed table before it ranks all full bins."""
_SPACES = " \t\n\x0b\f\r"
_EMPTY = (1 << 56) - 1


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once for all its uses in ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def shingle_hashes(text: Column) -> Column:
    """One hash for each window of five words; a shorter text has its whole sequence, a text without words nothing."""

    def over(h: Column) -> Column:
        inner = F.transform(F.slice(h, F.lit(1), F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, inner).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(h)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), over)


def bin_values(hashes: Column) -> Column:
    """The smallest hash of every bin, null for an empty bin.

    The largest hash of every bin is added as a mark, so that after sorting every bin has a
    first element, and the mark comes first in the empty ones.
    """
    marks = F.array(*[F.lit(((b - BINS // 2) << 56) | _EMPTY).cast("long") for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, 56)
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    mins = let(F.sort_array(F.concat(hashes, marks)), first)
    return F.transform(mins, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) != F.lit(_EMPTY), x))


def densified(own: Column) -> Column:
    """Fill the nulls and keep low-order bits; a text without any full bin gets null.

    The bits are those of the hash together with the bin, so that one hash in many bins counts as
    many independent comparisons.
    """
    draw = random.Random(7)
    tables = [F.array(*[F.lit(draw.randrange(BINS)) for _ in range(BINS)]) for _ in range(TRIES)]

    def fill(full: Column) -> Column:
        def last(b: Column) -> Column:
            ranked = F.transform(full, lambda j: F.struct(F.xxhash64(b, j).alias("rank"), F.get(own, j).alias("value")))
            return F.array_min(ranked)["value"]

        return F.when(F.size(full) > 0, F.transform(own, lambda x, b: bits(F.coalesce(x, *[F.get(own, F.get(t, b)) for t in tables], last(b)), b)))

    bits = lambda x, b: F.xxhash64(x, b).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    positions = F.sequence(F.lit(0), F.lit(BINS - 1))
    return let(F.filter(positions, lambda j: F.get(own, j).isNotNull()), fill)


def fingerprint(text: Column) -> Column:
    """16 longs, or null for a text without words."""
    per = 64 // BITS

    def packed(values: Column) -> Column:
        def one(g: Column) -> Column:
            return F.aggregate(
                F.slice(values, g * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)
            )

        return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), one))

    return let(let(bin_values(shingle_hashes(text)), densified), packed)


def shown(packed: Column) -> Column:
    """Hexadecimal digits, one for each bin; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 64 // BITS, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; 1 for two texts without words, 0 for one."""
    ones = F.lit(int("1" * (64 // BITS), 16)).cast("long")

    def differing(x: Column, y: Column) -> Column:
        def folded(d: Column) -> Column:
            any_bit = d
            for k in range(1, BITS):
                any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
            return F.bit_count(any_bit.bitwiseAND(ones))

        return let(x.bitwiseXOR(y), folded)

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << BITS)
    estimate = ((F.lit(1.0) - differ / F.lit(float(BINS))) - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), estimate))


def edited(text: Column, n: Column, following: Column) -> Column:
    """The last quarter of the text replaced by as many first characters of the following one, or all it has."""
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(F.coalesce(following, F.lit("")), F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and their likeness.

    Null texts are empty; texts without words have the empty fingerprint; equal rows each get a
    row; an empty table gives no rows.  Texts and their first fingerprints move once.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = with_next(base.withColumn("packed", fingerprint(F.col("text"))), "doc_id", ["text", "packed"], wrap=True).withColumn("n", F.length("text"))
    changed = first.withColumn("edited", edited(F.col("text"), F.col("n"), F.col("next_text")))
    second = changed.select(
        "doc_id", "n", "packed", "next_packed", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_packed")
    )
    return second.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", shown(F.col("packed")).alias("fingerprint"),
        shown(F.col("edited_packed")).alias("edited_fingerprint"), likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


@register("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
