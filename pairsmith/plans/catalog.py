"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each plan module registers its queries with ``@query(name, sql)``.  A query
takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QueryDef:
    name: str
    build: Builder
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, QueryDef] = {}


def query(name: str, sql: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QueryDef(name, fn, sql, operators)
        return fn
    return deco


def load_all() -> dict[str, QueryDef]:
    # importing the plan modules fills the registry
    from . import (q_prepare, q_text, q_hits, q_mix, q_kg, q_links,  # noqa: F401
                   q_locations, q_runs, q_ml, q_io, q_datasets, q_tagging)
    return REGISTRY
