"""Routing inputs derived from the driver tables, for Spark and as SQL.

The tables hold no routing data.  Integer arithmetic on document ids and lengths, followed by
one division, gives performances, costs and scores that are equal bit for bit on both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.session import spread
from signalbox.sources.tables import wide_to_panel

MODELS = [f"Model_{c}" for c in "ABCDEFGHIJK"]
# Multipliers of (id, length, model squared) and the modulus, per derived source.
PERFORMANCE = (31, 7, 13, 101)
SOURCES = {"alpha": (17, 11, 5, 97), "beta": (29, 3, 19, 89), "gamma": (31, 7, 13, 101)}
SPLIT_SEED = 42
HELD = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for text work, spread over the cores when the file has too few splits."""
    return spread(table(spark, sf_dir, "documents"))


def _mix(m: int, key: tuple[int, int, int, int]) -> Column:
    a, b, c, p = key
    return ((F.col("doc_id") * a + F.col("n_chars") * b + m * m * c) % p).cast("double")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled frame: ID, query and a performance and cost column per model."""
    columns = []
    for m, name in enumerate(MODELS):
        columns.append((_mix(m, PERFORMANCE) / 100).alias(f"{name}_performance"))
        columns.append((((m + 1) * (F.col("n_chars") + 200)).cast("double") / 1_000_000).alias(f"{name}_cost"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ID"), F.col("text").alias("query"), *columns)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_to_panel(wide(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str, source: str = "alpha", field: str = "score") -> DataFrame:
    key = SOURCES[source]
    cell = lambda m, name: F.struct(F.lit(name).alias("model"), (_mix(m, key) / key[3]).alias(field))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.array(*[cell(m, n) for m, n in enumerate(MODELS)]).alias("cells"))


def scored_panel(spark: SparkSession, sf_dir: str, source: str = "alpha") -> DataFrame:
    """Panel cells that also carry a predicted score; one projection of the documents."""
    key = SOURCES[source]
    docs = table(spark, sf_dir, "documents")
    cell = lambda m, name: F.struct(
        F.lit(name).alias("model"),
        (_mix(m, PERFORMANCE) / 100).alias("performance"),
        (((m + 1) * (F.col("n_chars") + 200)).cast("double") / 1_000_000).alias("cost"),
        (_mix(m, key) / key[3]).alias("score"),
    )
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("query"),
        F.array(*[cell(m, n) for m, n in enumerate(MODELS)]).alias("cells"),
    )


def base_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    letter = F.char(65 + F.col("doc_id") % 11)
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("Model_"), letter).alias("pred_model"))


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries with one to seven lines as models; not every query has every model."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"), "l_linenumber")
        .agg((F.avg("l_quantity") / 50).alias("performance"), F.avg("l_extendedprice").alias("cost"))
    )
    long = lines.select("id", F.concat(F.lit("Model_"), F.char(64 + F.col("l_linenumber"))).alias("model"), "performance", "cost")
    return C.from_long(long, "performance", "cost")


# Openings put before document texts so that every task rule is met.
OPENINGS = [
    "Fix the bug in this function:\n", "Solve the equation, prove it.\n", "日本語 haiku:\n",
    "The protein in a cell:\n", "Who wrote this?\n", "Write a short story.\n", "Cancel my order and refund it.\n",
    "A riddle, step by step:\n", "", "ARC-AGI Task 1a2b\n", "Sample Input\nConstraints\n", "def f(x): import y\n",
    "中文\n", "hint: arrange them. ",
]


def _prompted_text() -> Column:
    opening = F.get(F.lit(OPENINGS), (F.col("doc_id") % len(OPENINGS)).cast("int"))
    family = F.concat(F.lit(" ARC-AGI Task "), F.lower(F.hex("doc_id")), F.lit("\n"))
    return F.when(F.col("doc_id") % 23 == 5, family).otherwise(F.concat(opening, F.col("text")))


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts behind an opening chosen by id; an id-only family query every 23 ids."""
    return texts(spark, sf_dir).select(F.col("doc_id").alias("id"), _prompted_text().alias("query"))


def prompted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with prompted texts and the task label of each."""
    key = PERFORMANCE
    docs = texts(spark, sf_dir)
    cell = lambda m, name: F.struct(
        F.lit(name).alias("model"),
        (_mix(m, key) / 100).alias("performance"),
        (((m + 1) * (F.col("n_chars") + 200)).cast("double") / 1_000_000).alias("cost"),
    )
    return docs.select(
        F.col("doc_id").alias("id"), _prompted_text().alias("query"),
        F.array(*[cell(m, n) for m, n in enumerate(MODELS)]).alias("cells"),
    )


def text_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel for text work; the same rows as ``panel``."""
    key = PERFORMANCE
    cell = lambda m, name: F.struct(
        F.lit(name).alias("model"),
        (_mix(m, key) / 100).alias("performance"),
        (((m + 1) * (F.col("n_chars") + 200)).cast("double") / 1_000_000).alias("cost"),
    )
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("text").alias("query"),
        F.array(*[cell(m, n) for m, n in enumerate(MODELS)]).alias("cells"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with residual and performance arrays derived from label and id."""
    rows = table(spark, sf_dir, "embeddings")
    value = lambda m: ((F.col("vec_id") * 7 + F.col("label") * 13 + m * m * 5) % 41).cast("double") / 40
    perf = lambda m: F.when(F.col("label") % 11 == m, 0.9).otherwise(0.1 + 0.05 * ((F.col("vec_id") + m) % 7))
    return rows.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
        F.array(*[value(m) - 0.5 for m in range(11)]).alias("residuals"),
        F.array(*[perf(m).cast("double") for m in range(11)]).alias("performances"),
    )


# --- the same inputs as SQL ----------------------------------------------------------

_M = "(SELECT CAST(range AS BIGINT) AS m FROM range(11)) ms"


def _mix_sql(key: tuple[int, int, int, int], over: int) -> str:
    a, b, c, p = key
    return f"CAST((doc_id*{a}+n_chars*{b}+m*m*{c})%{p} AS DOUBLE)/{over}"


_LETTER = "'Model_'||chr(CAST(65+m AS INTEGER))"
SQL = {
    "panel": f"""panel AS (SELECT doc_id AS id, text AS query, {_LETTER} AS model,
        {_mix_sql(PERFORMANCE, 100)} AS performance,
        CAST((m+1)*(n_chars+200) AS DOUBLE)/1000000 AS cost FROM documents CROSS JOIN {_M})""",
    "den": """den AS (SELECT (SELECT max(cost) FROM panel) AS g,
        (SELECT avg(mx) FROM (SELECT max(cost) AS mx FROM panel GROUP BY id)) AS r)""",
    # reward under the mean of per-query maxima
    "rw": """rw AS (SELECT id, query, model, performance, cost, cost/(SELECT r FROM den) AS norm_cost,
        CAST(0.85 AS DOUBLE)*performance-(1-CAST(0.85 AS DOUBLE))*(cost/(SELECT r FROM den)) AS reward FROM panel)""",
    "rwg": """rwg AS (SELECT id, query, model, performance, cost, cost/(SELECT g FROM den) AS norm_cost,
        CAST(0.85 AS DOUBLE)*performance-(1-CAST(0.85 AS DOUBLE))*(cost/(SELECT g FROM den)) AS reward FROM panel)""",
    "ranked": """ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reward DESC, model) AS rk FROM rw)""",
    "base": """base AS (SELECT doc_id AS id, 'Model_'||chr(CAST(65+doc_id%11 AS INTEGER)) AS pred_model FROM documents)""",
    "sparse": """sparse AS (SELECT l_orderkey AS id, 'Model_'||chr(CAST(64+l_linenumber AS INTEGER)) AS model,
        avg(l_quantity)/50 AS performance, avg(l_extendedprice) AS cost FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "split": f"""split AS (SELECT doc_id AS id, text AS query,
        row_number() OVER (ORDER BY md5('{SPLIT_SEED}:'||doc_id), doc_id)
          <= greatest(1, round_even(count(*) OVER ()*CAST({HELD} AS DOUBLE), 0)) AS held_out FROM documents)""",
}
for _name, _key in SOURCES.items():
    SQL[_name] = (
        f"{_name} AS (SELECT doc_id AS id, {_LETTER} AS model, {_mix_sql(_key, _key[3])} AS score "
        f"FROM documents CROSS JOIN {_M})"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OPENING_SQL = "[" + ", ".join(_quoted(o) for o in OPENINGS) + "][CAST(doc_id%" + str(len(OPENINGS)) + "+1 AS INTEGER)]"
SQL["prompted"] = f"""prompted AS (SELECT doc_id AS id, CASE WHEN doc_id%23=5
    THEN ' ARC-AGI Task '||lower(printf('%x', doc_id))||chr(10) ELSE {_OPENING_SQL}||text END AS query FROM documents)"""


def sql(*ctes: str, body: str) -> str:
    """A query over named inputs; a CTE that is not a known name is taken as text."""
    return "WITH " + ",\n".join(SQL.get(c, c) for c in ctes) + "\n" + body
