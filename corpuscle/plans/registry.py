"""Where queries are registered: a function of the tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpuscle.session import attach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The words of a text, as postings.ascii_tokens has them.
TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(attach(spark), sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register
