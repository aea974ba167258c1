"""Registered queries of this subpackage and, where SQL can say them, their statements."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = [
    "ngram_join", "toxicity", "mixing", "packing", "token_files", "html_text", "fingerprints", "warc", "neural_lm", "graph_index",
    "collocations", "bwt_dedup", "periodic",
]


def register(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"signalbox.llm.{name}")
