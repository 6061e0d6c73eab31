"""Streams over several micro-batches: rows out of order, late rows, scheduled runs."""

from pyspark.sql import functions as F

from tamis.queries.flows import _plain_times
from tamis.queries.registry import query, table
from tamis.session import scratch_path
from tamis.sources import topic_log
from tamis.sources.tables import decode_messages
from tamis.streaming import alerts, late, measures
from tamis.streaming.run import run_scheduled, write_epochs

SLICES = 6


def land_in_slices(df, arrival, path, count=SLICES):
    """Slices that arrive one after the other: ``arrival`` (0 to ``count`` - 1) says with which a row comes.

    All tasks write the files of a slice. The caller runs its stream whenever a slice has landed, so that a micro-batch
    is a slice however many files it has.
    """
    for i in range(count):
        df.where(arrival == i).write.mode("append").parquet(path)
        yield i


def _day(ts="ts"):
    return F.datediff(F.col(ts), F.lit("2024-01-01").cast("date"))


_ARRIVAL = "least(5, greatest(0, date_diff('day', DATE '2024-01-01', ts::DATE) // 5))"
_HOURS = """(SELECT CAST(user_id AS VARCHAR) AS key, to_timestamp(floor(epoch(ts) / 3600)::BIGINT * 3600)::TIMESTAMP AS t, bool_or(value > 10) AS active
  FROM events GROUP BY ALL)"""


@query(
    f"""WITH e AS (SELECT * FROM {_HOURS} WHERE epoch(t) + 3600 <= (SELECT epoch(max(ts)) - 3 * 86400 FROM events)),
    g AS (SELECT *, epoch(t) - epoch(lag(t) OVER (PARTITION BY key ORDER BY t)) > 2 * 86400 AS paused FROM e),
    r AS (SELECT *, sum(CASE WHEN active AND NOT coalesce(paused, false) THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g),
    s AS (SELECT key, t, min(t) OVER (PARTITION BY key, run) AS since, run FROM r WHERE active)
    SELECT key, since, min(t) AS fired_at FROM s WHERE epoch(t) - epoch(since) >= 43200 GROUP BY key, run, since"""
)
def q_stream_held_live(spark, sf):
    """Raw events in six slices, up to two days out of order; alerts as the watermark allows."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    came = F.col("ts") + F.make_interval(hours=F.pmod(F.col("event_id") * 7919, F.lit(48)).cast("int"))
    path, base, state = (scratch_path(spark, n) for n in ("arrivals", "alerts", "stream-state"))
    for _ in land_in_slices(events, F.least(F.lit(SLICES - 1), F.floor(F.datediff(came, F.lit("2024-01-01").cast("date")) / 5)), path):
        stream = measures.event_stream(spark, path, events.schema, "ts")
        found = alerts.live_held_alerts(stream, "user_id", "ts", F.col("value") > 10, "1 hour", "12 hours", "3 days", "2 days")
        write_epochs(found, base, "append", state).awaitTermination()
    return _plain_times(spark.read.schema(found.schema).parquet(base).select(*found.columns))


def _split(spark, sf):
    """All events, those of one id in fifty with the last slice; (base, schema)."""
    events = table(spark, sf, "events")
    path, base, state = (scratch_path(spark, n) for n in ("arrivals", "fates", "stream-state"))
    arrival = F.when(F.col("event_id") % 50 == 7, SLICES - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(_day() / 5))))
    for _ in land_in_slices(events, arrival, path):
        stream = measures.event_stream(spark, path, events.schema, "ts")
        stream.writeStream.foreachBatch(late.split_late(base, "ts", "2 days")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return base, stream.schema


_FATES = f"""(SELECT *, CASE WHEN event_id % 50 = 7 THEN 5 ELSE {_ARRIVAL} END AS came FROM events)"""
_LATE = f"came = 5 AND ts < (SELECT max(ts) FROM {_FATES} WHERE came < 5) - INTERVAL 2 DAY"


@query(f"SELECT event_id, ts, event_type, CASE WHEN {_LATE} THEN 'late' ELSE 'accepted' END AS fate FROM {_FATES}")
def q_stream_late_rows(spark, sf):
    base, schema = _split(spark, sf)
    return _plain_times(late.rows_by_fate(spark, base, schema).select("event_id", "ts", "event_type", "fate"))


@query(
    f"""SELECT CAST(came AS BIGINT) AS epoch, count(*) AS rows, count(*) FILTER (WHERE {_LATE}) AS late,
      max(max(ts)) OVER (ORDER BY came) AS high FROM {_FATES} GROUP BY came"""
)
def q_stream_late_counts(spark, sf):
    base, _ = _split(spark, sf)
    return _plain_times(late.marks(spark, base).select("epoch", "rows", "late", "high"))


@query(
    f"""SELECT {_ARRIVAL} AS came, event_type, sum(CAST(value AS DECIMAL(18, 2)))::DECIMAL(28, 2) AS total, count(*) AS n
    FROM events WHERE value > 5 GROUP BY ALL"""
)
def q_stream_scheduled(spark, sf):
    """A definition with an on-demand schedule, run three times on what has arrived by then; no row counts twice."""
    definition = {
        "apiVersion": "tamis/v1",
        "kind": "AnalyticsWorkflow",
        "metadata": {"name": "arrivals"},
        "spec": {
            "schedule": {"trigger": "manual"},
            "source": {"type": "upload", "format": "PARQUET", "objectKey": "events"},
            "pipeline": [
                {"id": "large", "kind": "filter", "expression": "value > 5"},
                {"id": "exact", "kind": "computed", "alias": "amount", "expression": "CAST(value AS DECIMAL(18, 2))"},
                {"id": "day", "kind": "computed", "alias": "came", "expression": "CAST(LEAST(5, GREATEST(0, DATEDIFF(ts, DATE '2024-01-01') DIV 5)) AS BIGINT)"},
                {
                    "id": "sums",
                    "kind": "aggregate",
                    "groupBy": ["came", "event_type"],
                    "aggregations": [{"alias": "total", "function": "SUM", "field": "amount"}, {"alias": "n", "function": "COUNT", "field": "event_id"}],
                },
            ],
        },
    }
    events = table(spark, sf, "events")
    path, base, state = (scratch_path(spark, n) for n in ("arrivals", "runs", "stream-state"))
    arrival = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(_day() / 5)))
    for i in land_in_slices(events, arrival, path):
        if i % 2:
            run_scheduled(definition, measures.event_stream(spark, path, events.schema), base, state).awaitTermination()
    return spark.read.parquet(base).select("came", "event_type", "total", "n")


_BODY = "event_id bigint, ts timestamp_ntz, event_type string, value double"


def _sent(spark, sf, path, low, high):
    """Append the events of a range of days to a topic log, keyed by user."""
    events = table(spark, sf, "events").where((_day() >= low) & (_day() < high)).select("user_id", "event_id", "ts", "event_type", "value")
    topic_log.append(events, path, "user_id", "ts")


@query("SELECT CAST(user_id AS VARCHAR) AS message_key, ts AS message_time, event_id, event_type, value FROM events")
def q_source_topic_log(spark, sf):
    path = scratch_path(spark, "topic")
    _sent(spark, sf, path, -9999, 12)
    _sent(spark, sf, path, 12, 9999)
    return _plain_times(topic_log.log_batch(spark, path, _BODY)).select("message_key", "message_time", "event_id", "event_type", "value")


@query(
    """SELECT 'all' AS reader, event_id, event_type, value FROM events
    UNION ALL SELECT 'new', event_id, event_type, value FROM events WHERE date_diff('day', DATE '2024-01-01', ts::DATE) >= 10"""
)
def q_stream_topic_resume(spark, sf):
    """Two groups read a topic in three sittings, the second and third by new queries that know nothing but their group.

    The first group starts at the beginning, the other at what comes after it was there. No message is lost or read twice.
    """
    path, base = scratch_path(spark, "topic"), scratch_path(spark, "taken")
    for sitting, (low, high) in enumerate(((-9999, 10), (10, 20), (20, 9999))):
        _sent(spark, sf, path, low, high)
        for group in ("all", "new"):
            if group == "new" and sitting == 0:
                topic_log.finish(path, group, topic_log.Log(path).refresh())  # there from now on
                continue

            def write(batch, epoch, folder=f"{base}/reader={group}/sitting={sitting}"):
                decode_messages(batch, _BODY).select("event_id", "event_type", "value").write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

            stream = topic_log.log_stream(spark, path, group, from_beginning=group == "all")
            state = scratch_path(spark, "stream-state")
            stream.writeStream.foreachBatch(topic_log.consume(path, group, write)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(base).select("reader", "event_id", "event_type", "value")
