"""Queries over the shared tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import base, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BASE = {"documents", "events", "pages", "benchmark", "labels", "embeddings", "conversations"}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register f(*tables) under a name; tables are the views named, base tables included."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[(base if v in BASE else view)(spark, sf_dir, v) for v in views])

        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql, *[v for v in views if v not in BASE]) if set(views) - BASE else sql
        return f

    return keep


def columns(name: str, table: str, key: str, **cols: tuple) -> None:
    """A query of column functions: alias=(function that makes the Spark column, SQL expression)."""
    text = f"SELECT {key}, " + ", ".join(f"{sql} AS {alias}" for alias, (_, sql) in cols.items()) + f" FROM {table}"
    query(name, text, (table,))(lambda df: df.select(key, *[make().alias(a) for a, (make, _) in cols.items()]))
