"""Where queries are registered, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.session import ship, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of ``t``, which gives a table by its name."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(lambda name: table(spark, sf_dir, name))

        run.__name__ = function.__name__
        run.__doc__ = function.__doc__
        QUERIES[function.__name__], SQL[function.__name__] = run, sql
        return run

    return register
