"""Small helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "8m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_BYTES`` at most, however long its texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def inputs(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under the operator's own names.

    Other columns never meet an operator's internal names, so extra columns cannot clash.
    """
    return bounded_batches(docs).select(*[docs[source].alias(name) for name, source in columns.items()])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_schema(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def hidden(*names: str) -> dict[str, str]:
    """Column names that no input column can have."""
    return {n: f"__{n}_{uuid.uuid4().hex}" for n in names}


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(scan: Scan) -> Scan:
    """``scan``, which at the end of a task gives memory that it no longer needs back to the machine.

    Python workers live on between tasks beside the executor's heap; without this the freed memory of all stages so far
    stays theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # other C libraries have no such call

    return run
