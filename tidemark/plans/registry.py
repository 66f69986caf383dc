"""Where queries are registered beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the tables it names under its own name, with its SQL where there is one."""

    def add(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
