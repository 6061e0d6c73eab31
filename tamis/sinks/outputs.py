"""Writers for the outputs of a workflow."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.scalars import col, ordering
from tamis.operators.ordered import number_rows
from tamis.session import materialize

# The event topic, and the refresh limits of a dashboard.
REFRESH_MIN_SEC = 60
REFRESH_DEFAULT_SEC = 300


def publish_dashboard(df: DataFrame, base: str, dashboard_code: str, partition_by: Sequence[str] = ()) -> str:
    """Publish a new version of a dashboard's result; returns its path.

    Each version is a folder of its own, complete once its ``_SUCCESS`` file is there. Readers take
    ``published_dashboard``, so they never meet a gap, and a failed write leaves the version before.
    """
    path = f"{base}/{dashboard_code}/version={time.time_ns():020d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def published_dashboard(spark: SparkSession, base: str, dashboard_code: str) -> DataFrame:
    """The newest complete version."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{base}/{dashboard_code}")
    done = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(
        jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS")
    )
    if not done:
        raise LookupError(f"dashboard '{dashboard_code}' has not been published")
    return spark.read.parquet(max(f.getPath().getParent().toString() for f in done))


def refresh_interval(refresh_sec: int | None = None) -> str:
    """Trigger interval of a dashboard fed by a stream."""
    seconds = REFRESH_DEFAULT_SEC if refresh_sec is None else refresh_sec
    if seconds < REFRESH_MIN_SEC:
        raise ValueError(f"a dashboard refreshes at most every {REFRESH_MIN_SEC} seconds")
    return f"{seconds} seconds"


def export_sheets(
    base: str, metadata: Mapping[str, str], kpis: DataFrame, charts: Mapping[str, DataFrame], format: str = "csv"
) -> dict[str, str]:
    """One file set per sheet: Metadata (key, value), KPIs (id, label, value, unit), one per chart."""
    spark: SparkSession = kpis.sparkSession
    sheets = {
        "Metadata": spark.createDataFrame([(k, str(v)) for k, v in metadata.items()], "key string, value string"),
        "KPIs": kpis.select(F.col("kpi_id").alias("id"), "label", "value", "unit"),
        **charts,
    }
    paths = {}
    for name, df in sheets.items():
        path = f"{base}/sheet={name}"
        writer = df.write.mode("overwrite")
        if format == "csv":
            writer.option("header", "true").csv(path)
        else:
            writer.format(format).save(path)
        paths[name] = path
    return paths


def chunked(df: DataFrame, order_by: Sequence, rows_per_chunk: int) -> DataFrame:
    """Add ``sequence`` (from 0) and ``is_last``: consecutive chunks of the ordered result."""
    numbered = materialize(number_rows(df, [], order_by, "__rn"), "chunks")
    sequence = F.floor((F.col("__rn") - 1) / rows_per_chunk)
    last = numbered.agg(F.max(sequence)).scalar()
    return numbered.withColumn("sequence", sequence).withColumn("is_last", sequence == last).drop("__rn")


def write_chunks(df: DataFrame, path: str, order_by: Sequence, rows_per_chunk: int) -> None:
    """Write the ordered result as one folder per chunk, each chunk in one file."""
    parts = chunked(df, order_by, rows_per_chunk)
    parts.repartition("sequence").sortWithinPartitions("sequence", *ordering(order_by)).write.partitionBy("sequence").parquet(path)


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as ``(key, value)`` messages with a JSON value."""
    body = F.to_json(F.struct(*[col(c) for c in df.columns]))
    return df.select((col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), body.alias("value"))


def publish_events(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """Send rows to a topic of a Kafka-compatible broker."""
    as_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
