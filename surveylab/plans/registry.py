"""Query registry: each entry is a Spark builder plus (optionally) the
equivalent DuckDB SQL over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    """Register a query; ``ids`` lists the SURVEY §2 operators it exercises."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, tuple(ids))
        return fn
    return deco
