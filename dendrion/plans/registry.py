"""Queries under their names, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Registers a query under its function's name; the arguments are the views it reads, in order."""

    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes(*views)}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
        return f

    return register


def rounded(c, name: str, digits: int = 4):
    return F.round(c, digits).alias(name)
