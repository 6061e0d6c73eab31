"""Registry of the checked queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_anew(df: DataFrame) -> DataFrame:
    """The same rows in other tasks and another order, in partitions whose size the session fixes, not their number."""
    return df.hint("rebalance")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round the named double columns (all if none is named)."""
    kinds = dict(df.dtypes)
    picked = names or [c for c, t in kinds.items() if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in picked})
