"""Registry of named queries: each a builder over the given tables and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Build
    sql: str | None


_QUERIES: dict[str, Query] = {}
_MODULES = ("relational", "rolling", "pairs", "points_in_time", "standing", "health", "market", "style", "evaluation", "learning", "frame", "storing")


def query(covers: str, sql: str | None = None) -> Callable[[Build], Build]:

    def keep(build: Build) -> Build:
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = Query(name, covers, build, sql)
        return build

    return keep


def registry() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"tideline.plans.{module}")
    return dict(_QUERIES)
