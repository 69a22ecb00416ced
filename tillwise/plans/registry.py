"""Catalogue of runnable queries: a Spark function and, where SQL can say the
same, a reference SQL text for cross-checking."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwise.plans.standins import SQL_VIEWS, Tables
from tillwise.session import configure

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}

MODULES = (
    "marts",
    "windows",
    "filters",
    "joins",
    "sets",
    "transforms",
    "validation",
    "ingestion",
    "files",
    "quality",
    "anomalies",
    "series",
    "security",
    "privacy",
    "access",
    "updates",
    "streams",
)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under an operator id."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def _needed_views(sql: str) -> list[str]:
    """Views named in the SQL, with the views those are built from, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in SQL_VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(SQL_VIEWS[name])
    return [name for name in SQL_VIEWS if name in found]


def full_sql(sql: str) -> str:
    sql = sql.strip()
    views = [f"{name} AS ({SQL_VIEWS[name].strip()})" for name in _needed_views(sql)]
    if not views:
        return sql
    head = "WITH " + ",\n".join(views)
    if sql[:5].upper() == "WITH ":
        return head + ",\n" + sql[5:]
    return head + "\n" + sql


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tillwise.plans.{module}")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def reference_sql() -> dict[str, str]:
    load_all()
    return {name: full_sql(text) for name, text in _SQL.items()}
