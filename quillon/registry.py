"""Names of queries, their functions and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Operators of the inventory that a query covers, by its name.
COVERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, covers: str = "", sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame; sql is what DuckDB runs for comparison."""

    def add(f):
        QUERIES[name], COVERS[name] = f, covers
        if sql:
            ORACLES[name] = sql
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the tables of sf_dir; only those that the text names are registered as views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def both(name: str, covers: str, sql: str, duck: str | None = None) -> None:
    """A query that is one SQL text for Spark; duck is its DuckDB form where the dialects differ."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    COVERS[name], ORACLES[name] = covers, duck or sql
