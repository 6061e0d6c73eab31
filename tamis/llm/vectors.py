"""Reading vector columns: which rows take part, and their entries as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import inputs


def usable(rows: DataFrame, key: str, vector: str, below: float = float("inf")) -> tuple[DataFrame, int]:
    """(key, vector of the rows that take part; their common length).

    Rows whose vector is NULL, empty, or holds NULL or an entry whose size is not under ``below`` are left out. So are
    vectors of another length than most of the rest have (of equally many, the longer); without any, the length is 0.
    An array of float stays one, other numeric arrays become double.
    """
    kept = inputs(rows, key=key, vector=vector)
    if dict(kept.dtypes)["vector"] != "array<float>":
        kept = kept.withColumn("vector", F.col("vector").cast("array<double>"))
    kept = kept.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: F.coalesce(F.abs(x) >= F.lit(below), F.lit(True))))
    lengths = kept.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    return kept.where(F.size("vector") == length), length


def matrix(batch: pa.RecordBatch, length: int, column: int = 1) -> np.ndarray:
    """Vectors of a batch of ``usable`` rows, one in a row."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
