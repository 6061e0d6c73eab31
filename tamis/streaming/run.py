"""Start streams and read their results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tamis.functions.scalars import col
from tamis.plans import workflow
from tamis.session import scratch_path
from tamis.sinks.outputs import as_messages, refresh_interval

# Triggers of a schedule.
TRIGGERS = ("cron", "event", "manual")


def trigger_of(schedule: dict | None = None, refresh_sec: int | None = None) -> dict:
    """Trigger arguments: a manual or scheduled run takes what is there, an event run never stops."""
    kind = (schedule or {}).get("trigger", "manual")
    if kind not in TRIGGERS:
        raise ValueError(f"trigger '{kind}' is not supported")
    if refresh_sec is not None:
        return {"processingTime": refresh_interval(refresh_sec)}
    return {"processingTime": "0 seconds"} if kind == "event" else {"availableNow": True}


def write_epochs(df: DataFrame, path: str, mode: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch to its own ``epoch=`` folder; a repeated batch replaces itself."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drain(df: DataFrame, mode: str = "update", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over everything available and return its result as a table.

    In update mode a row is sent again when it changes, so the last epoch per ``keys`` counts; in
    complete mode the last epoch is the result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/epoch=-1")  # readable also without input
    query = write_epochs(df, path, mode, scratch_path(spark, "stream-state"))
    query.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    if mode == "append":
        return rows.drop("epoch")
    if mode == "complete":
        newest = rows.agg(F.max("epoch")).scalar()
        return rows.where(F.col("epoch") == newest).drop("epoch")
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*[col(c) for c in rest]), F.col("epoch")).alias("__v")
    found = rows.groupBy(*[col(k) for k in keys]).agg(last)
    return found.select(*[col(k) for k in keys], *[F.col("__v")[c].alias(c) for c in rest]).select(*df.columns)


def late_rows(query: StreamingQuery) -> int:
    """Rows a finished query dropped because they came later than the watermark."""
    return sum(
        op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators
    )


def publish_stream(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Send a stream of rows to a topic of a Kafka-compatible broker."""
    writer = as_messages(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_scheduled(
    definition: Mapping, arrivals: DataFrame, base: str, checkpoint: str, tables: Mapping[str, DataFrame] | None = None, refresh_sec: int | None = None
) -> StreamingQuery:
    """Run a definition on what arrives, as its ``schedule`` says; each run writes ``base/epoch=``.

    A manual or cron schedule takes what has arrived since the last run and ends; an event schedule goes on and runs
    for every micro-batch. A repeated run replaces its own result, so none counts twice after a restart.
    """

    def once(batch: DataFrame, epoch: int) -> None:
        workflow.run(definition, source=batch, tables=tables).output.write.mode("overwrite").parquet(f"{base}/epoch={epoch}")

    schedule = definition["spec"].get("schedule")
    writer = arrivals.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger_of(schedule, refresh_sec)).start()
