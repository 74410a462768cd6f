"""Registry of the named queries: a function of Views and, where SQL can say it, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Registers fn(v: Views) under its own name. views: derived views that the SQL uses."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLE[fn.__name__] = with_views(views, sql)
        return fn

    return add
