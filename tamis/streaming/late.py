"""Rows that come later than the watermark: kept aside and counted instead of dropped in silence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.scalars import col
from tamis.streaming.measures import seconds

# What became of a row.
ACCEPTED, LATE, UNTIMED = "accepted", "late", "untimed"
MARKS = "high timestamp, bound timestamp, rows bigint, late bigint, untimed bigint"


def split_late(base: str, time_field: str, lateness: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch`` that writes each row once, to the folder of what became of it.

    A row is late when its time lies more than ``lateness`` before the newest time of all earlier micro-batches, and
    untimed without a time. One pass writes the rows and observes their numbers and newest time. ``base/marks`` keeps
    these per micro-batch; a repeated batch meets the mark of the batch before it, so it is split as it was.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MARKS).parquet(f"{base}/marks/epoch={epoch - 1}").first() if epoch else None
        high = before["high"] if before else None
        at = col(time_field).cast("timestamp")
        bound = F.lit(high) - F.make_dt_interval(secs=F.lit(seconds(lateness))) if high is not None else F.lit(None).cast("timestamp")
        fate = F.when(at.isNull(), UNTIMED).when(at < bound, LATE).otherwise(ACCEPTED)
        seen = Observation()
        marked = batch.withColumn("fate", fate).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("fate") == LATE).alias("late"), F.count_if(F.col("fate") == UNTIMED).alias("untimed"), F.max(at).alias("newest")
        )
        marked.write.mode("overwrite").partitionBy("fate").parquet(f"{base}/rows/epoch={epoch}")
        got = seen.get
        known = [t for t in (high, got["newest"]) if t is not None]
        one = spark.range(1).select(
            F.lit(max(known) if known else None).cast("timestamp").alias("high"), bound.alias("bound"), *[F.lit(got[n]).cast("bigint").alias(n) for n in ("rows", "late", "untimed")]
        )
        one.coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/epoch={epoch}")

    return step


def rows_by_fate(spark: SparkSession, base: str, schema: T.StructType, fate: str | None = None) -> DataFrame:
    """The rows written so far with ``epoch`` and ``fate``; of one fate only its folders are read."""
    full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("fate", T.StringType())])
    rows = spark.read.schema(full).parquet(f"{base}/rows")
    return rows if fate is None else rows.where(F.col("fate") == fate)


def marks(spark: SparkSession, base: str) -> DataFrame:
    """Per micro-batch: epoch, the watermark that held (``bound``), the newest time so far, and the numbers of rows."""
    return spark.read.schema(f"{MARKS}, epoch bigint").parquet(f"{base}/marks")
