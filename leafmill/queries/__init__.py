"""Registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (read) -> DataFrame under its name; read(table) gives a table of the chosen folder, read.folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(table: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{table}.parquet")

            read.folder = sf_dir
            return f(read)

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import answers, caches, channels, details, figures, guards, pages, texts  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
