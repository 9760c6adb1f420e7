"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the given
tables (or data Spark derives from them) and runs one operator through the
library's own code. The oracle, when present, is an independent ANSI-SQL
statement over the same tables that DuckDB can run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temp views for fixture SQL."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def fixture(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a derivation statement (shared with the oracle) over the tables.

    Derivations only reshape the tables into the schema an operator expects;
    they do none of the operator's work.
    """
    views(spark, sf_dir, *tables)
    return spark.sql(sql)
