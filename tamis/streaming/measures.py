"""Windowed measures on event streams. Each also works on a static frame with the same columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.functions.scalars import col

# Rate window, evaluation interval and alert window.
RATE_WINDOW = "5 minutes"
EVALUATION = "30 seconds"
ALERT_WINDOW = "1 hour"


def event_stream(
    spark: SparkSession, path: str, schema: StructType, time_field: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as a stream; ``time_field`` becomes a timestamp a watermark accepts."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    df = reader.parquet(path)
    return df if time_field is None else df.withColumn(time_field, col(time_field).cast("timestamp"))


def topic_stream(spark: SparkSession, servers: str, topic: str, group: str, schema, from_beginning: bool = False) -> DataFrame:
    """Messages of a Kafka-compatible topic as a stream of decoded rows."""
    from tamis.sources.tables import decode_messages, topic_options

    options = topic_options(servers, topic, group, from_beginning)
    return decode_messages(spark.readStream.format("kafka").options(**options).load(), schema)


def with_lateness(df: DataFrame, time_field: str, lateness: str | None) -> DataFrame:
    """Watermark of a stream; rows later than it are dropped and counted in the query progress."""
    return df.withWatermark(time_field, lateness) if lateness and df.isStreaming else df


def windowed(
    df: DataFrame,
    time_field: str,
    keys: Sequence[str],
    measures: dict[str, Column],
    width: str = RATE_WINDOW,
    slide: str | None = None,
    lateness: str | None = "10 minutes",
) -> DataFrame:
    """Measures per key and time window, as ``window_start``, ``window_end``, keys, measures."""
    marked = with_lateness(df, time_field, lateness)
    frame = F.window(col(time_field), width, slide) if slide else F.window(col(time_field), width)
    found = marked.groupBy(frame.alias("w"), *[col(k) for k in keys]).agg(*[m.alias(n) for n, m in measures.items()])
    return found.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[col(k) for k in keys], *measures
    )


def seconds(width: str) -> float:
    count, unit = width.split()
    return float(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def rate(df: DataFrame, time_field: str, keys: Sequence[str], width: str = RATE_WINDOW, slide: str | None = EVALUATION, lateness: str | None = "10 minutes") -> DataFrame:
    """Events per second over a sliding window."""
    out = windowed(df, time_field, keys, {"events": F.count(F.lit(1))}, width, slide, lateness)
    return out.withColumn("per_second", F.col("events") / seconds(width))


def quantile_5m(
    df: DataFrame, time_field: str, value: str, keys: Sequence[str] = (), fractions: dict[str, float] | None = None,
    width: str = RATE_WINDOW, slide: str | None = None, lateness: str | None = "10 minutes",
) -> DataFrame:
    """p95 and p99 of a duration per window, from one mergeable sketch per group."""
    wanted = fractions or {"p95": 0.95, "p99": 0.99}
    measures = {n: F.percentile_approx(col(value), p, 10_000) for n, p in wanted.items()}
    return windowed(df, time_field, keys, measures, width, slide, lateness)


def ratio(
    df: DataFrame, time_field: str, keys: Sequence[str], condition: Column, alias: str = "ratio",
    width: str = RATE_WINDOW, slide: str | None = None, lateness: str | None = "10 minutes",
) -> DataFrame:
    """Share of events that meet the condition (errors, cache hits), over at least one event."""
    measures = {"hits": F.count_if(condition), "total": F.count(F.lit(1))}
    out = windowed(df, time_field, keys, measures, width, slide, lateness)
    return out.withColumn(alias, F.col("hits") / F.greatest("total", F.lit(1)))


def increase_above(
    df: DataFrame, time_field: str, keys: Sequence[str], condition: Column, threshold: int,
    width: str = ALERT_WINDOW, lateness: str | None = "10 minutes",
) -> DataFrame:
    """Windows in which more than ``threshold`` events meet the condition."""
    out = windowed(df.where(condition), time_field, keys, {"increase": F.count(F.lit(1))}, width, None, lateness)
    return out.where(F.col("increase") > threshold)


def dedupe(df: DataFrame, time_field: str, ids: Sequence[str] = ("event_id",), lateness: str = "10 minutes") -> DataFrame:
    """One event per id; a redelivery within the lateness is dropped."""
    if not df.isStreaming:
        return df.dropDuplicates(list(ids))
    return df.withWatermark(time_field, lateness).dropDuplicatesWithinWatermark(list(ids))
