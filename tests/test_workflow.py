"""Definitions, sources, sinks and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamis.plans import workflow
from tamis.session import scratch_path
from tamis.sinks import outputs
from tamis.sources import tables
from tamis.streaming import alerts, breach, measures, run


@pytest.fixture(scope="module")
def plots(spark):
    rows = [("north", "done", 10.0), ("north", "open", 5.0), ("south", "done", 20.0), ("south", "lost", 99.0)]
    return spark.createDataFrame(rows, "region string, status string, area double")


def definition(**spec):
    base = {"source": {"type": "upload"}, "pipeline": [], "kpis": [], "visualizations": [], "outputs": []}
    return {"apiVersion": "any/v1", "kind": "AnalyticsWorkflow", "spec": base | spec}


PIPELINE = [
    {"id": "large", "kind": "filter", "expression": "area >= 10"},
    {"id": "by_status", "kind": "aggregate", "groupBy": ["status"], "aggregations": [{"alias": "widest", "function": "MAX", "field": "area"}, {"alias": "fields", "function": "COUNT", "field": "area"}]},
]


def test_kpi_binds_to_the_last_step_with_its_columns(plots):
    kpis = [{"id": "kpi_rows", "expression": "AVG(area)"}, {"id": "kpi_status", "expression": "MIN(widest)"}, {"id": "kpi_all", "expression": "SUM(fields)"}]
    result = workflow.run(definition(pipeline=PIPELINE, kpis=kpis), source=plots)
    assert workflow.bind_kpis(result.steps, kpis).keys() == {"large", "by_status"}
    assert {r.kpi_id: r.value for r in result.kpis.collect()} == {"kpi_rows": 43.0, "kpi_status": 20.0, "kpi_all": 3.0}


def test_every_step_kind_runs(plots):
    steps = [
        {"id": "known", "kind": "filter", "expression": "status <> 'lost'"},
        {"id": "flag", "kind": "outlier", "field": "area", "strategy": "HARD_BOUNDS", "upperBound": 15},
        {"id": "norm", "kind": "normalize", "field": "area", "method": "MIN_MAX"},
        {"id": "code", "kind": "recode", "field": "status", "alias": "s", "mapping": {"done": 1}, "default": 0},
        {"id": "ha", "kind": "computed", "alias": "m2", "expression": "area * 10000", "type": "BIGINT"},
        {"id": "win", "kind": "window", "alias": "rk", "function": "RANK", "partitionBy": ["region"], "orderBy": [{"field": "area", "direction": "DESC"}]},
        {"id": "order", "kind": "sort", "orderBy": ["area"]},
        {"id": "long", "kind": "unpivot", "ids": ["region", "status"], "values": ["area", "area_norm"]},
        {"id": "wide", "kind": "pivot", "rowFields": ["region"], "columnField": "variable", "valueField": "value", "aggregation": "MAX"},
        {"id": "keys", "kind": "group_by", "fields": ["region"]},
        {"id": "back", "kind": "join", "right": "wide", "on": [{"left": "region", "right": "region"}], "joinType": "LEFT"},
    ]
    out = workflow.run(definition(pipeline=steps), source=plots).output
    assert sorted(map(tuple, out.select("region", "area", "area_norm").collect())) == [("north", 10.0, 1 / 3), ("south", 20.0, 1.0)]


def test_documents_are_checked(plots):
    for bad in (
        definition() | {"apiVersion": "any/v2"},
        definition() | {"kind": "Dashboard"},
        definition(pipeline=[{"id": "a", "kind": "cross"}]),
        definition(pipeline=[PIPELINE[0], PIPELINE[0]]),
        definition(outputs=[{}] * 9),
    ):
        with pytest.raises(ValueError):
            workflow.run(bad, source=plots)
    with pytest.raises(LookupError, match="population"):
        workflow.run_steps(plots, [{"id": "j", "kind": "join", "right": "population", "on": ["region"], "joinType": "LEFT"}])
    with pytest.raises(ValueError):
        workflow.evaluate_kpis({"source": plots}, [{"id": "kpi_x", "expression": "SUM(nope)"}])


def test_a_table_joins_by_name_and_limit_applies(plots, spark):
    people = spark.createDataFrame([("north", 7)], "code string, people int")
    steps = [{"id": "j", "kind": "join", "right": "people", "on": [{"left": "region", "right": "code"}], "joinType": "LEFT"}]
    result = workflow.run(definition(pipeline=steps), source=plots, tables={"people": people}, row_limit=3)
    assert result.output.count() == 3 and result.steps["j"].where("people = 7").count() == 2


def test_shared_step():
    assert workflow.shared_step(definition(pipeline=PIPELINE, kpis=[{}])["spec"]) == "by_status"
    assert workflow.shared_step(definition(pipeline=PIPELINE)["spec"]) is None
    assert workflow.shared_step(definition(pipeline=PIPELINE[:1], kpis=[{}])["spec"]) is None


def test_source_predicate(plots):
    readers = {"upload": lambda s: plots}
    assert tables.open_source({"type": "upload", "sqlPredicate": "area > 9"}, readers).count() == 3
    for bad in ("area > 9; DROP TABLE x", "area > 9 -- all"):
        with pytest.raises(ValueError):
            tables.open_source({"type": "upload", "sqlPredicate": bad}, readers)
    with pytest.raises(LookupError):
        tables.open_source({"type": "metabase"}, readers)


def test_connector_options():
    options = tables.jdbc_options("jdbc:x", "s", "t", "id", (0, 1000), 16)
    assert options["dbtable"] == "s.t" and options["numPartitions"] == "16" and options["upperBound"] == "1000"
    assert "partitionColumn" not in tables.jdbc_options("jdbc:x", "s", "t", None, None, 16)
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "s", "t", "id", None, 16)
    assert tables.topic_options("b:1", "t", "g")["startingOffsets"] == "latest"
    assert tables.topic_options("b:1", "t", "g", True)["startingOffsets"] == "earliest"


def test_the_clock_is_an_argument(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 3, 1, 12)), ("b", dt.datetime(2024, 3, 9))], "k string, at timestamp_ntz")
    steps = [
        {"id": "new", "kind": "filter", "expression": "at >= current_date - INTERVAL 2 DAYS AND k <> 'now()'"},
        {"id": "age", "kind": "computed", "alias": "days", "expression": "datediff(now(), at)", "type": "INTEGER"},
    ]
    out = workflow.run(definition(pipeline=steps), source=rows, as_of="2024-03-10 06:00:00").output
    assert [(r.k, r.days) for r in out.collect()] == [("b", 1)]


def test_documented_expressions(spark):
    rows = spark.createDataFrame(
        [("x", 1, 10.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 6)), ("x", 2, 15.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))],
        "g string, m int, v double, start timestamp_ntz, stop timestamp_ntz",
    )
    steps = [
        {"id": "change", "kind": "window", "alias": "pct", "partitionBy": ["g"], "orderBy": ["m"], "expression": "(v - LAG(v, 1) OVER w) / LAG(v, 1) OVER w * 100"}
    ]
    kpis = [{"id": "kpi_hours", "expression": "AVG(EXTRACT(EPOCH FROM (stop - start)) / 3600.0)"}, {"id": "kpi_change", "expression": "AVG(pct)"}]
    result = workflow.run(definition(pipeline=steps, kpis=kpis), source=rows)
    assert {r.kpi_id: r.value for r in result.kpis.collect()} == {"kpi_hours": 15.0, "kpi_change": 50.0}
    with pytest.raises(Exception, match="(?i)divide|nested|syntax|parse|type"):
        workflow.evaluate_kpis({"source": rows}, [{"id": "kpi_x", "expression": "SUM(v) +"}])


def test_drift_policy_of_a_definition(spark, plots):
    snapshot = {"region": "STRING", "status": "STRING", "area": "BIGINT"}
    with pytest.raises(workflow.DriftBlocked, match="area type changed"):
        workflow.run(definition(driftPolicy={"onTypeChange": "BLOCK"}), source=plots, snapshot=snapshot)
    settled = workflow.run(definition(driftPolicy={"onTypeChange": "AUTOCAST"}), source=plots, snapshot=snapshot)
    assert dict(settled.output.dtypes)["area"] == "bigint" and settled.drift.count() == 1
    policy = {"onRenamed": "AUTO_BY_SIMILARITY", "similarityThreshold": 0.8}
    renamed = plots.withColumnRenamed("region", "regions")
    assert workflow.run(definition(driftPolicy=policy), source=renamed, snapshot=snapshot | {"area": "DOUBLE"}).output.columns == ["region", "status", "area"]
    with pytest.raises(workflow.DriftBlocked):
        workflow.run(definition(), source=plots.drop("area"), snapshot=snapshot)


def test_a_definition_from_files_to_outputs(spark, plots):
    landing, base = scratch_path(spark, "landing"), scratch_path(spark, "out")
    plots.write.parquet(f"{landing}/plots")
    spec = definition(
        source={"type": "upload", "format": "PARQUET", "objectKey": "plots", "sqlPredicate": "area > 5"},
        pipeline=PIPELINE[1:],
        kpis=[{"id": "kpi_widest", "label": "Widest", "expression": "MAX(widest)", "format": {"unit": "ha"}}],
        visualizations=[{"id": "viz", "type": "PIE", "encoding": {"category": "status", "value": "fields"}}],
        outputs=[{"kind": "dashboard", "dashboardCode": "plots_by_status"}, {"kind": "excel", "objectKey": "book"}, {"kind": "email", "to": ["a@b"], "template": "t"}],
    )
    done = workflow.run(spec, tables.file_readers(spark, landing)).publish(base)
    assert done["email"] is None and set(done["excel"]) == {"Metadata", "KPIs", "viz"}
    assert outputs.published_dashboard(spark, base, "plots_by_status").count() == 2
    assert spark.read.csv(done["excel"]["KPIs"], header=True).first()["value"] == "99.0"
    lines = ['{"response_id": "r1", "answers": [{"question": "q", "answer": "b"}, {"question": "q", "answer": "a"}]}', '{"response_id": "r2", "answers": []}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{landing}/surveys/77")
    got = tables.open_source({"type": "surveymonkey", "surveyId": "77"}, tables.file_readers(spark, landing))
    assert sorted(map(tuple, got.collect())) == [("r1", "a; b"), ("r2", None)]


def test_dashboard_versions_and_ordered_chunks(spark, plots):
    base = scratch_path(spark, "boards")
    with pytest.raises(LookupError):
        outputs.published_dashboard(spark, base, "b")
    for n in (1, 4):
        outputs.publish_dashboard(plots.limit(n), base, "b")
        assert outputs.published_dashboard(spark, base, "b").count() == n
    path = scratch_path(spark, "chunks")
    outputs.write_chunks(spark.range(50), path, [("id", "DESC")], 20)
    assert [r.id for r in spark.read.parquet(f"{path}/sequence=1").collect()] == list(range(29, 9, -1))


def test_late_change_moves_the_next_run(spark):
    goals = spark.createDataFrame([("a", 10.0, "less_better", 100.0, 200.0)], "kpi_id string, target double, polarity string, warning_pct double, critical_pct double")
    base = scratch_path(spark, "late")
    rate = breach.watch_breaches(goals, base, 5)
    batch = lambda *rows: spark.createDataFrame(rows, "kpi_id string, run_at int, value double")
    rate(batch(("a", 1, 10.0), ("a", 2, 30.0), ("a", 3, 40.0)), 0)
    rate(batch(("a", 1, 50.0)), 1)
    got = {r.run_at: (r.previous, r.current) for r in breach.latest_breaches(spark, base).collect()}
    assert got == {1: (None, 50.0), 2: (50.0, 30.0), 3: (30.0, 40.0)}


def test_upload_formats(spark, plots):
    for kind, fmt in (("CSV", "csv"), ("PARQUET", "parquet"), ("JSONL", "json")):
        path = scratch_path(spark, "upload")
        plots.write.format(fmt).option("header", "true").save(path)
        assert tables.upload(spark, path, kind).count() == 4
        assert tables.upload(spark, path, kind, plots.schema).agg(F.sum("area")).first()[0] == 134.0
    with pytest.raises(ValueError):
        tables.upload(spark, "x", "XLSX")


def test_forms_and_keys(spark):
    path = scratch_path(spark, "forms")
    rows = [("validated", (1, "a")), ("draft", (2, "b")), (None, (3, "c"))]
    df = spark.createDataFrame(rows, "validation_status_id string, rec struct<n:int,s:string>")
    df.write.json(path)
    assert [tuple(r) for r in tables.form_submissions(spark, path, df.schema).collect()] == [("validated", 1, "a")]
    assert tables.form_submissions(spark, path, df.schema, validated_only=False).count() == 3
    kv = spark.createDataFrame([("a:1", '{"v": 1}'), ("a.1", '{"v": 2}'), ("ab:1", '{"v": 3}')], "key string, value string")
    assert [tuple(r) for r in tables.keyed_snapshots(kv, "a:*", "v int").collect()] == [("a:1", 1)]


def test_messages_decode(spark):
    raw = spark.createDataFrame([(b"k", b'{"a": 5}', dt.datetime(2024, 1, 1))], "key binary, value binary, timestamp timestamp")
    row = tables.decode_messages(raw, "a int").first()
    assert (row.message_key, row.a) == ("k", 5)


def test_golden_registry(spark, plots):
    from tamis.operators.compare import content_hash

    path = scratch_path(spark, "golden")
    plots.write.parquet(path)
    ddl = "region string, status string, area double"
    registry = lambda **over: spark.createDataFrame(
        [tuple(({"sub_project": "P", "name": "n", "schema": ddl, "rows_count": 4, "storage_uri": path} | over).values())],
        "sub_project string, name string, schema string, rows_count int, storage_uri string",
    )
    digest = content_hash(plots).first()["digest"]
    assert tables.golden_dataset(spark, registry(), "P", "n", digest).count() == 4
    for bad in (registry(rows_count=5), registry(schema="region string")):
        with pytest.raises(ValueError):
            tables.golden_dataset(spark, bad, "P", "n")
    with pytest.raises(ValueError):
        tables.golden_dataset(spark, registry(), "P", "n", "0")
    with pytest.raises(LookupError):
        tables.golden_dataset(spark, registry(), "P", "other")


def test_chunks(spark):
    path = scratch_path(spark, "chunks")
    outputs.write_chunks(spark.range(25).withColumnRenamed("id", "v"), path, ["v"], 10)
    back = spark.read.parquet(path)
    assert {r.sequence: (r.n, r.last) for r in back.groupBy("sequence").agg(F.count("*").alias("n"), F.max("is_last").alias("last")).collect()} == {
        0: (10, False), 1: (10, False), 2: (5, True),
    }


def test_dashboard_is_replaced(spark, plots):
    base = scratch_path(spark, "boards")
    outputs.publish_dashboard(plots, base, "b1")
    path = outputs.publish_dashboard(plots.limit(1), base, "b1")
    assert spark.read.parquet(path).count() == 1
    assert outputs.refresh_interval() == "300 seconds"
    with pytest.raises(ValueError):
        outputs.refresh_interval(5)


def test_triggers():
    assert run.trigger_of() == {"availableNow": True}
    assert run.trigger_of({"trigger": "event"}) == {"processingTime": "0 seconds"}
    assert run.trigger_of({"trigger": "cron"}, 600) == {"processingTime": "600 seconds"}
    with pytest.raises(ValueError):
        run.trigger_of({"trigger": "sometimes"})


T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def land(spark, path, name, rows, schema):
    """One file per batch, in order of names."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


EVENTS = "event_id int, ts timestamp, kind string, value double"


def stream_of(spark, batches, schema=EVENTS):
    path = scratch_path(spark, "events")
    for i, rows in enumerate(batches):
        land(spark, path, f"batch={i}", rows, schema)
    frame = spark.createDataFrame([], schema)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/*")


def test_late_rows_are_dropped_and_counted(spark):
    batches = [[(1, at(0), "a", 1.0), (2, at(60), "a", 1.0)], [(3, at(61), "a", 1.0)], [(4, at(1), "a", 1.0), (5, at(62), "a", 1.0)]]
    out = measures.windowed(stream_of(spark, batches), "ts", ["kind"], {"n": F.count(F.lit(1))}, "5 minutes", None, "10 minutes")
    path = scratch_path(spark, "late")
    query = run.write_epochs(out, path, "append", scratch_path(spark, "state"))
    query.awaitTermination()
    assert run.late_rows(query) == 1
    closed = spark.read.parquet(path)
    assert [(r.window_start, r.n) for r in closed.collect()] == [(T0, 1)]


def test_update_mode_keeps_the_last_value(spark):
    batches = [[(1, at(0), "a", 1.0)], [(2, at(1), "a", 2.0)], [(3, at(2), "b", 4.0)]]
    out = measures.windowed(stream_of(spark, batches), "ts", ["kind"], {"total": F.sum("value")}, "5 minutes")
    for mode in ("update", "complete"):
        got = run.drain(out, mode, ["window_start", "window_end", "kind"])
        assert sorted((r.kind, r.total) for r in got.collect()) == [("a", 3.0), ("b", 4.0)]


def test_drain_without_input(spark):
    path = scratch_path(spark, "none")
    empty = spark.createDataFrame([], EVENTS)
    empty.write.parquet(path)
    stream = measures.event_stream(spark, path, empty.schema)
    assert run.drain(measures.dedupe(stream, "ts"), "append").count() == 0


def test_redelivered_events(spark):
    batches = [[(1, at(0), "a", 1.0), (1, at(0), "a", 1.0)], [(1, at(0), "a", 1.0), (2, at(1), "a", 1.0)]]
    got = run.drain(measures.dedupe(stream_of(spark, batches), "ts"), "append")
    assert sorted(r.event_id for r in got.collect()) == [1, 2]
    static = spark.createDataFrame(batches[0], EVENTS)
    assert measures.dedupe(static, "ts").count() == 1


def test_held_alert_over_batches(spark):
    schema = "k string, t timestamp, on boolean"
    on = lambda k, *ms: [(k, at(m), True) for m in ms]
    batches = [
        on("a", 0, 1, 2) + on("b", 0),
        on("a", 3, 4, 5, 6) + [("b", at(4), False)],
        on("b", 5, 9) + [("a", at(7), False)] + on("a", 8, 14) + on("b", 10),
    ]
    got = run.drain(alerts.held_alerts(stream_of(spark, batches, schema), "k", "t", "on", 300), "append")
    fired = sorted((r.key, r.since, r.fired_at) for r in got.collect())
    assert fired == [("a", at(0), at(5)), ("a", at(8), at(14)), ("b", at(5), at(10))]
    static = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, alerts.held_alerts_batch(static, "k", "t", "on", 300).collect())) == fired


def test_breaches_over_batches(spark):
    goals = spark.createDataFrame([("a", 10.0, "less_better", 100.0, 200.0)], "kpi_id string, target double, polarity string, warning_pct double, critical_pct double")
    batches = [[(1, at(0), "a", 5.0)], [(2, at(60), "a", 25.0)], [(3, at(61), "a", -20.0), (4, at(120), "a", 12.0)]]
    days = measures.windowed(stream_of(spark, batches), "ts", ["kind"], {"value": F.sum("value")}, "1 hour", None, "2 hours")
    values = days.select(F.col("kind").alias("kpi_id"), F.col("window_start").alias("run_at"), "value")
    base = scratch_path(spark, "breaches")
    watch = breach.watch_breaches(goals, base, breach.runs_within(7200, 3600))
    values.writeStream.outputMode("update").foreachBatch(watch).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.run_at, r.previous, r.current, r.severity) for r in breach.latest_breaches(spark, base).collect()]
    # the second hour breached in its batch and came back under the limit in the next
    assert got == [(at(120), 5.0, 12.0, "WARNING")]
    second = spark.read.parquet(f"{base}/breaches").where("epoch = 1").first()
    assert (second.previous, second.current, second.severity, second.threshold) == (5.0, 25.0, "CRITICAL", 20.0)


def test_local_session_without_a_folder_of_its_own(spark, monkeypatch):
    from tamis import session

    class Plain:
        """A session whose settings name no checkpoint folder and refuse to be changed."""

        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

            @staticmethod
            def set(key, value):
                raise AssertionError("static settings cannot be changed")

    first = session.shared_dir(Plain)
    assert first == session.shared_dir(Plain) and first.rsplit("/", 1)[0]
