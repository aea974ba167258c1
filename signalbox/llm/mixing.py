"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that is served in proportion to its weight.  A document's virtual
finish time is its source's words up to and with it, in shuffled order, over the weight.
A source may be served ``epochs`` times; then its queue ends and the others share what is
left, so the budget ends all queues at one virtual time V and source ``s`` gets
``min(weight * V, epochs * size)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.llm.registry import register
from signalbox.llm.storage import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
CHUNKS = 4096
"""Parts of the hash range in which running sums are made before their starts are added."""
SOURCES = 100_000
"""Sources up to which their cuts, one short row each, are broadcast."""
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: str = SEED) -> Column:
    """Place of a document in the shuffled order."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last.  With the
    queues in the order of their ends, the budget less the first k caps, over the weight of the
    rest, is V for the right k and less for any other, so V is the largest of them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ends = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ends.rowsBetween(Window.unboundedPreceding, -1)
    after = ends.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("budget", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("target", F.least(F.col("weight") * F.max("level").over(every), F.col("cap")))
        .select("source", "source_size", "weight", "target")
    )


def mix(
    docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED
) -> DataFrame:
    """(doc_id, source, size, source_size, target, finish, servings, taken): the words of each document that the mix takes.

    ``finish`` is the virtual finish time of the first serving.  Documents are shuffled by
    the hash of seed and id, so reruns agree.  The document at which a source's target falls
    is taken in part, later ones not at all, earlier ones once per serving.  Empty texts have
    size 0 and 0 words taken; a null id has a place of its own in the order; equal rows are
    documents of their own.  Only ids, sources and sizes are shuffled; a source's running
    sum is made in parts by hash, and the parts' starts come from a small table of sums.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), shuffle_key(seed).alias("key"))
    rows = rows.withColumn("chunk", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % CHUNKS)
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("chunk_size").alias("source_size")), weights, share, epochs)
    chunks = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("chunk_size").over(chunks), F.lit(0)).alias("chunk_start")
    )
    starts = starts.join(targets, F.col("s").eqNullSafe(F.col("source"))).select("s", "c", "chunk_start", "source_size", "weight", "target")
    inside = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("chunk_start") + F.col("inside")
    goal = F.floor(F.col("target") + 0.5)
    served = [F.greatest(F.lit(0), F.least(F.col("size"), goal - before - F.col("source_size") * e)).cast("long") for e in range(epochs)]
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .select(
            "doc_id", "source", "key", "size", "source_size", "target",
            ((before + F.col("size")) / F.col("weight")).alias("finish"), F.array(*served).alias("servings"), sum(served, F.lit(0)).cast("long").alias("taken"),
        )
    )


def whole_documents(docs: DataFrame, size: Column, seed: str = SEED, epochs: int = EPOCHS, **options) -> DataFrame:
    """The mix in whole documents: each row as often as it is served by half or more, its columns unchanged.

    The order of a source's documents makes a serving a cut in that order, so the rows meet one
    row per source and their texts do not move.  A source without words is kept as it is.
    """
    mixed = mix(docs, size, seed=seed, epochs=epochs, **options)
    taken = lambda e: F.max(F.when((F.col("size") > 0) & (F.get("servings", F.lit(e)) * 2 >= F.col("size")), F.col("key")))
    cuts = stored(mixed.groupBy("source").agg(F.first("source_size").alias("words"), *[taken(e).alias(f"cut{e}") for e in range(epochs)]), "cuts")
    cuts = cuts.withColumnRenamed("source", "of")
    if cuts.count() <= SOURCES:
        cuts = F.broadcast(cuts)
    times = sum((F.coalesce((F.col("place") <= F.col(f"cut{e}")).cast("int"), F.lit(0)) for e in range(epochs)), F.lit(0))
    names = [f"`{c}`" for c in docs.columns]
    # names of the documents' own that clash are out of the way inside the struct
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("from"), shuffle_key(seed).alias("place"))
    met = rows.join(cuts, F.col("from").eqNullSafe(F.col("of")))
    met = met.withColumn("times", F.when(F.col("words") == 0, F.lit(1)).otherwise(times))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, (2 * source_size)::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT max(level) AS level FROM l),
t AS (SELECT l.source, source_size, least(weight * v.level, cap) AS target FROM l, v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target + 0.5) - before)) + greatest(0, least(size, floor(target + 0.5) - before - source_size)))::BIGINT AS taken
FROM r
"""


@register("op3_source_mix", ORACLE)
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
