import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import session

    return session("4")


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def panel(spark):
    """Make a panel from {field: matrix}; models are Model_A, Model_B, ..."""

    def make(**fields):
        first = next(iter(fields.values()))
        rows = []
        for i, values in enumerate(first):
            cells = []
            for j in range(len(values)):
                cells.append((f"Model_{chr(65 + j)}", *[float(m[i][j]) for m in fields.values()]))
            rows.append((i, f"query {i}", cells))
        kinds = ", ".join(f"{f}: double" for f in fields)
        return spark.createDataFrame(rows, f"id long, query string, cells array<struct<model: string, {kinds}>>")

    return make


def matrix(df, field):
    """Field values per query in id order."""
    return [[c[field] for c in r.cells] for r in df.orderBy("id").collect()]
