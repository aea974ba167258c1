"""Rows and plain Python helpers for the tests of this folder; fixtures are imported by name."""

import re

import pytest

CLASHES = ["row", "key", "size", "taken", "node", "label", "place", "ghost", "packed", "n", "ids", "bucket", "grade", "severity", "slot", "hash"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    text = text or ""
    return [w for w in re.split("[\x20\x09-\x0d]+", text.translate(LOWER) if fold else text) if w]


def shingles(text, fold=True):
    w = words(text, fold)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


BASE = [f"word{i}" for i in range(40)]
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(300_000))
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE[:-1] + ["changed"])), (3, " ".join(BASE).upper()), (3, " ".join(BASE).upper()), (4, None), (5, ""),
    (6, " \t\n "), (7, "one two"), (8, "one two"), (9, LONG), (10, LONG + " tail"), (None, "no id here at all you see"), (None, None),
    (11, "It's <|endoftext|> café ÉTUDE é 12ab%%% ΣΣ x≠y"), (12, "a"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, None if k % 5 == 0 else f"s{k % 3}", *["?"] * len(CLASHES)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The small table's rows, and the frame."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df.orderBy("doc_id").toPandas(), df


@pytest.fixture(scope="session")
def run(spark, sf):
    """Result of a registered query on the small tables."""
    from signalbox.llm import registry

    registry.load()
    return lambda name: registry.QUERIES[name](spark, sf).toPandas()
