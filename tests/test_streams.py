"""Live alerts, late rows and scheduled runs over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from tamis.queries.streams import land_in_slices
from tamis.session import scratch_path
from tamis.sources import topic_log
from tamis.streaming import alerts, late, measures, run
from tests.test_workflow import EVENTS, at, stream_of

ON, OFF = 1.0, 0.0


def live(spark, batches, **options):
    stream = stream_of(spark, batches)
    found = alerts.live_held_alerts(stream, "kind", "ts", F.col("value") > 0.5, "1 minute", "5 minutes", **options)
    return sorted((r.key or "", r.since, r.fired_at) for r in run.drain(found, "append").collect())


def test_live_alert_waits_for_the_watermark(spark):
    batches = [
        [(1, at(0), "a", ON), (2, at(2), "a", ON), (3, at(6), "a", ON)],
        [(4, at(1), "a", ON), (5, at(4.5), "a", OFF), (6, at(7), "b", ON)],  # out of order; the quiet interval comes late, yet in time
        [(7, at(11), "a", ON), (8, at(12), "b", ON), (9, at(11.5), "a", OFF), (10, None, "a", OFF)],
        [(11, at(60), "c", ON)],
    ]
    # a: quiet in minute 4, active from 6 to 11; b: active at 7 and 12; c ends the stream
    assert live(spark, batches, lateness="10 minutes") == [("a", at(6), at(11)), ("b", at(7), at(12))]


def test_live_alert_fires_by_timer_and_once(spark):
    batches = [[(1, at(0), "a", ON), (2, at(5), "a", ON), (3, at(6), "a", ON)], [(4, at(90), "z", ON)]]
    assert live(spark, batches, lateness="2 minutes") == [("a", at(0), at(5))]


def test_live_alert_rearms_after_a_pause(spark):
    batches = [[(1, at(0), "a", ON), (2, at(5), "a", ON)], [(3, at(300), "z", ON)], [(4, at(301), "a", ON), (5, at(306), "a", ON)], [(6, at(900), "z", ON)]]
    assert live(spark, batches, lateness="1 minute", idle="1 hour") == [("a", at(0), at(5)), ("a", at(301), at(306))]
    assert live(spark, batches, lateness="1 minute", idle="10 hours") == [("a", at(0), at(5))]


def test_state_of_silent_keys_goes(spark):
    batches = [[(i, at(0), f"k{i}", ON) for i in range(50)], [(99, at(200), "z", ON)], [(100, at(400), "z", ON)]]
    found = alerts.live_held_alerts(stream_of(spark, batches), "kind", "ts", F.col("value") > 0.5, "1 minute", "5 minutes", "1 minute", "30 minutes")
    query = run.write_epochs(found, scratch_path(spark, "out"), "append", scratch_path(spark, "state"))
    query.awaitTermination()
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1] == 1


def test_live_alerts_keep_state_by_bucket(spark):
    names = [None, *(f"k{i}" for i in range(2000))]
    batches = [
        [(i, at(0), n, ON) for i, n in enumerate(names)],
        [(i, at(5), n, OFF if i % 3 == 0 else ON) for i, n in enumerate(names)],
        [(i, at(6), n, ON) for i, n in enumerate(names) if i % 2] + [(-1, at(60), "z", ON)],
    ]
    stream = alerts.live_held_alerts(stream_of(spark, batches), "kind", "ts", F.col("value") > 0.5, "1 minute", "5 minutes", "10 minutes")
    out = scratch_path(spark, "out")
    query = run.write_epochs(stream, out, "append", scratch_path(spark, "state"))
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= alerts.BUCKETS
    found = {(r.key, r.since, r.fired_at) for r in spark.read.parquet(out).collect()}
    assert found == {(n, at(0), at(5)) for i, n in enumerate(names) if i % 3}
    assert set(live(spark, batches, lateness="10 minutes", buckets=1)) == {(n or "", *t) for n, *t in found}


def test_a_slice_lands_by_many_tasks_and_is_one_micro_batch(spark):
    path, base, state = (scratch_path(spark, n) for n in ("arrivals", "out", "state"))
    rows = spark.range(0, 600, 1, 4).select("id", (F.col("id") % 3).alias("came"))
    for i in land_in_slices(rows, F.col("came"), path, 3):
        assert len(spark.read.parquet(path).inputFiles()) == 4 * (i + 1)
        run.write_epochs(measures.event_stream(spark, path, rows.schema), base, "append", state).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(base).groupBy("epoch").agg(F.min("came"), F.max("came"), F.count("*")).sort("epoch").collect()] == [(i, i, i, 200) for i in range(3)]


def split(spark, batches, lateness="10 minutes"):
    base = scratch_path(spark, "fates")
    stream = stream_of(spark, batches)
    stream.writeStream.foreachBatch(late.split_late(base, "ts", lateness)).option("checkpointLocation", scratch_path(spark, "s")).trigger(availableNow=True).start().awaitTermination()
    return base, stream.schema


def test_late_rows_are_kept_aside(spark):
    batches = [
        [(1, at(0), "a", 1.0), (2, at(60), "a", 1.0)],
        [(3, at(49), "a", 1.0), (4, at(50), "a", 1.0), (5, None, "a", 1.0)],
        [],
        [(6, at(80), "a", 1.0), (7, at(55), "b", 1.0)],
        [(8, at(69.9), "a", 1.0), (9, at(70), "a", 1.0)],
    ]
    base, schema = split(spark, batches)
    fates = {r.event_id: r.fate for r in late.rows_by_fate(spark, base, schema).collect()}
    assert fates == {1: "accepted", 2: "accepted", 3: "late", 4: "accepted", 5: "untimed", 6: "accepted", 7: "accepted", 8: "late", 9: "accepted"}
    assert [r.event_id for r in late.rows_by_fate(spark, base, schema, late.UNTIMED).collect()] == [5]
    kept = late.marks(spark, base).groupBy().agg(F.sum("rows"), F.sum("late"), F.sum("untimed"), F.max("high")).first()
    assert tuple(kept) == (9, 2, 1, at(80))


def test_a_repeated_batch_is_split_as_before(spark):
    base, schema = split(spark, [[(1, at(60), "a", 1.0)], [(2, at(0), "a", 1.0), (3, at(200), "a", 1.0)]])
    again = spark.createDataFrame([(2, at(0), "a", 1.0), (3, at(200), "a", 1.0)], EVENTS)
    late.split_late(base, "ts", "10 minutes")(again, 1)
    assert {r.event_id: r.fate for r in late.rows_by_fate(spark, base, schema).collect()} == {1: "accepted", 2: "late", 3: "accepted"}
    assert late.marks(spark, base).count() == 2


def test_triggers_of_schedules():
    assert run.trigger_of({"trigger": "cron", "cron": "0 6 * * *"}) == {"availableNow": True}
    assert run.trigger_of({"trigger": "event"}) == {"processingTime": "0 seconds"}
    with pytest.raises(ValueError):
        run.trigger_of({"trigger": "sometimes"})


def test_event_schedule_runs_for_what_arrives(spark):
    definition = {
        "apiVersion": "tamis/v1", "kind": "AnalyticsWorkflow", "metadata": {"name": "n"},
        "spec": {"schedule": {"trigger": "event"}, "source": {"type": "upload"}, "pipeline": [{"id": "f", "kind": "filter", "expression": "value > 1"}]},
    }
    base = scratch_path(spark, "runs")
    query = run.run_scheduled(definition, stream_of(spark, [[(1, at(0), "a", 1.0)], [(2, at(0), "a", 2.0)]]), base, scratch_path(spark, "s"))
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert [r.event_id for r in spark.read.parquet(base).collect()] == [2]


def sent(spark, path, ids):
    rows = spark.createDataFrame([(f"k{i % 5}", i, at(i)) for i in ids], "k string, i int, t timestamp")
    topic_log.append(rows, path, "k", "t", 3)


def test_log_offsets_are_gapless_and_ordered(spark):
    path = scratch_path(spark, "topic")
    sent(spark, path, range(40))
    sent(spark, path, range(40, 55))
    rows = spark.read.parquet(f"{path}/log").orderBy("partition", "offset").collect()
    for p in {r.partition for r in rows}:
        own = [r for r in rows if r.partition == p]
        assert [r.offset for r in own] == list(range(len(own))) and [r.timestamp for r in own] == sorted(r.timestamp for r in own)
    assert topic_log.log_batch(spark, path, "i int").count() == 55
    assert topic_log.Log(path).refresh() == {p: sum(r.partition == p for r in rows) for p in {r.partition for r in rows}}


def test_log_stream_resumes_from_its_checkpoint(spark):
    path, out, state = (scratch_path(spark, n) for n in ("topic", "out", "state"))
    for ids in (range(20), range(20, 50)):
        sent(spark, path, ids)
        found = topic_log.log_stream(spark, path, from_beginning=True).select("offset", "partition", "value")
        run.write_epochs(found, out, "append", state).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 50 == rows.select("partition", "offset").distinct().count()


def test_log_groups(spark):
    path = scratch_path(spark, "topic")
    assert topic_log.log_batch(spark, path, "i int").collect() == [] and topic_log.finished(path, "g") is None
    sent(spark, path, range(10))
    topic_log.finish(path, "g", {0: 2, 1: 1})
    topic_log.finish(path, "g", {0: 1, 2: 4})
    assert topic_log.finished(path, "g") == {0: 2, 1: 1, 2: 4}
    got = []

    def fails_once(batch, epoch):
        if not got:
            got.append("failed")
            raise RuntimeError("sink is gone")
        got.extend(r.offset for r in batch.collect())

    for _ in range(2):
        step = topic_log.consume(path, "late", fails_once)
        stream = topic_log.log_stream(spark, path, "late", from_beginning=True).writeStream.foreachBatch(step)
        try:
            stream.option("checkpointLocation", scratch_path(spark, "s")).trigger(availableNow=True).start().awaitTermination()
        except Exception as error:
            assert "sink is gone" in str(error)
    assert len(got) == 11 and sum(topic_log.finished(path, "late").values()) == 10


def test_new_group_starts_at_the_end(spark):
    path = scratch_path(spark, "topic")
    sent(spark, path, range(10))
    reader = topic_log._Stream(path, "n", False)
    start = reader.initialOffset()
    sent(spark, path, range(10, 16))
    parts = reader.partitions(start, reader.latestOffset())
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 6
