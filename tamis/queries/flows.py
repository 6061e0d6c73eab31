"""Sources, sinks and streams."""

from pyspark.sql import functions as F

from tamis.queries.registry import query, rounded, table
from tamis.session import scratch_path
from tamis.sinks import outputs
from tamis.sources import tables
from tamis.operators.sample import sample
from tamis.queries.derived import day_values, day_values_sql
from tamis.streaming import alerts, breach, measures
from tamis.streaming.run import drain


def _landed(df, label, format, **options):
    path = scratch_path(df.sparkSession, label)
    df.write.format(format).options(**options).save(path)
    return path


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def q_source_csv(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return tables.upload(spark, _landed(rows, "csv", "csv", header="true"), "CSV", rows.schema)


@query("SELECT doc_id, text, lang FROM documents")
def q_source_jsonl(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return tables.upload(spark, _landed(rows, "jsonl", "json"), "JSONL", rows.schema)


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http%'")
def q_source_parquet(spark, sf):
    source = {"type": "upload", "format": "PARQUET", "objectKey": "pages", "sqlPredicate": "url LIKE 'http%'"}
    readers = {"upload": lambda s: tables.upload(spark, f"{sf}/{s['objectKey']}.parquet", s["format"])}
    return tables.open_source(source, readers).select("page_id", "url")


@query("SELECT d.doc_id AS submission_id, 'validated' AS validation_status_id, lang, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def q_source_forms(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    dump = joined.select(
        F.col("doc_id").alias("submission_id"),
        F.when(F.col("quality") == 1, "validated").when(F.col("quality") == 0, "rejected").otherwise("draft").alias("validation_status_id"),
        F.struct("lang", "n_chars").alias("rec"),
    )
    return tables.form_submissions(spark, _landed(dump, "forms", "json"), dump.schema)


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS response_id, string_agg(DISTINCT text, '; ' ORDER BY text) FILTER (WHERE turn % 3 = 0) AS q0,
      string_agg(DISTINCT text, '; ' ORDER BY text) FILTER (WHERE turn % 3 = 1) AS q1, string_agg(DISTINCT text, '; ' ORDER BY text) FILTER (WHERE turn % 3 = 2) AS q2
    FROM conversations GROUP BY conv_id"""
)
def q_source_survey(spark, sf):
    rows = table(spark, sf, "conversations")
    answer = F.struct(F.concat(F.lit("q"), F.col("turn") % 3).alias("question"), F.col("text").alias("answer"))
    dump = rows.select(F.col("conv_id").cast("string").alias("response_id"), F.array(answer).alias("answers"))
    return tables.survey_responses(spark, _landed(dump, "survey", "json"), ["q0", "q1", "q2"])


@query(
    """SELECT 'stock:' || event_type || ':' || CAST(event_id AS VARCHAR) AS key, event_type AS kind, value, user_id FROM events
    WHERE event_type IN ('purchase', 'view') AND CAST(event_id AS VARCHAR) LIKE '%7'"""
)
def q_source_keyed(spark, sf):
    e = table(spark, sf, "events")
    dump = e.select(
        F.concat_ws(":", F.lit("stock"), "event_type", "event_id").alias("key"),
        F.to_json(F.struct(F.col("event_type").alias("kind"), "value", "user_id")).alias("value"),
    )
    return tables.keyed_snapshots(dump, "stock:[pv]*:*7", "kind string, value double, user_id bigint")


@query("SELECT * FROM supplier")
def q_source_golden(spark, sf):
    rows = table(spark, sf, "supplier")
    path = _landed(rows, "golden", "parquet")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    registry = rows.agg(F.count(F.lit(1)).cast("int").alias("rows_count")).select(
        F.lit("SALES").alias("sub_project"), F.lit("suppliers").alias("name"), F.lit(ddl).alias("schema"), "rows_count", F.lit(path).alias("storage_uri")
    )
    return sample(rows, "GOLDEN", golden=tables.golden_dataset(spark, registry, "SALES", "suppliers"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def q_sink_dashboard(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    base = scratch_path(spark, "boards")
    outputs.publish_dashboard(rows.limit(1), base, "orders_by_priority", ["o_orderstatus"])
    outputs.publish_dashboard(rows, base, "orders_by_priority", ["o_orderstatus"])
    return outputs.published_dashboard(spark, base, "orders_by_priority")


@query(
    """SELECT 'KPIs' AS sheet, 'kpi_total' AS name, CAST(round(sum(o_totalprice), 2) AS DECIMAL(38, 2))::VARCHAR AS shown FROM orders
    UNION ALL SELECT 'viz_status', o_orderstatus, CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'Metadata', 'orders', CAST(count(*) AS VARCHAR) FROM orders"""
)
def q_sink_sheets(spark, sf):
    orders = table(spark, sf, "orders")
    kpis = orders.agg(F.round(F.sum("o_totalprice"), 2).alias("value")).select(
        F.lit("kpi_total").alias("kpi_id"), F.lit("Total").alias("label"), "value", F.lit("EUR").alias("unit")
    )
    counts = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    base = scratch_path(spark, "sheets")
    paths = outputs.export_sheets(base, {"orders": str(orders.count())}, kpis, {"viz_status": counts})
    read = lambda name, schema: spark.read.schema(schema).csv(paths[name], header=True)
    meta = read("Metadata", "name string, shown string").select(F.lit("Metadata").alias("sheet"), "name", "shown")
    k = read("KPIs", "id string, label string, value double, unit string").select(
        F.lit("KPIs").alias("sheet"), F.col("id").alias("name"), F.col("value").cast("decimal(38,2)").cast("string").alias("shown")
    )
    viz = read("viz_status", "name string, shown string").select(F.lit("viz_status").alias("sheet"), "name", "shown")
    return meta.unionByName(k).unionByName(viz)


@query(
    """SELECT o_orderkey, n // 1000 AS sequence, n // 1000 = (SELECT (count(*) - 1) // 1000 FROM orders) AS is_last
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders)"""
)
def q_sink_chunks(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return outputs.chunked(rows, ["o_orderdate", "o_orderkey"], 1000).drop("o_orderdate")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS key, event_type, user_id FROM events"""
)
def q_sink_messages(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    sent = outputs.as_messages(rows, "event_id")
    body = F.from_json("value", "event_type string, user_id bigint")
    return sent.select("key", body.alias("b")).select("key", "b.*")


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return measures.event_stream(spark, f"{sf}/events.parquet*", schema, "ts")


def _plain_times(df):
    """Timestamps without zone, as the tables store them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query(
    """SELECT to_timestamp(s)::TIMESTAMP AS window_start, to_timestamp(s + 300)::TIMESTAMP AS window_end, event_type, count(*) AS events,
      count(*) / 300.0::DOUBLE AS per_second
    FROM (SELECT event_type, floor(epoch(ts) / 30)::BIGINT * 30 - unnest(range(10)) * 30 AS s FROM events) GROUP BY ALL"""
)
def q_stream_rate(spark, sf):
    out = measures.rate(_events(spark, sf), "ts", ["event_type"])
    return _plain_times(drain(out, "update", ["window_start", "window_end", "event_type"]))


_WINDOW = "to_timestamp(floor(epoch(ts) / {0})::BIGINT * {0})::TIMESTAMP AS window_start, to_timestamp(floor(epoch(ts) / {0})::BIGINT * {0} + {0})::TIMESTAMP AS window_end"


@query(
    f"""SELECT {_WINDOW.format(300)}, user_id, count(*) FILTER (WHERE event_type = 'error') AS hits, count(*) AS total,
      count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1)::DOUBLE AS error_ratio FROM events GROUP BY ALL"""
)
def q_stream_error_ratio(spark, sf):
    out = measures.ratio(_events(spark, sf), "ts", ["user_id"], F.col("event_type") == "error", "error_ratio")
    return _plain_times(drain(out, "update", ["window_start", "window_end", "user_id"]))


@query(
    f"""SELECT {_WINDOW.format(300)}, event_type, count(*) FILTER (WHERE CAST(props->>'$.k' AS INT) < 50) AS hits, count(*) AS total,
      round(count(*) FILTER (WHERE CAST(props->>'$.k' AS INT) < 50) / greatest(count(*), 1)::DOUBLE, 9) AS hit_ratio FROM events GROUP BY ALL"""
)
def q_stream_hit_ratio(spark, sf):
    hit = F.get_json_object("props", "$.k").cast("int") < 50
    out = measures.ratio(_events(spark, sf), "ts", ["event_type"], hit, "hit_ratio")
    return rounded(_plain_times(drain(out, "update", ["window_start", "window_end", "event_type"])), 9)


@query(f"SELECT {_WINDOW.format(3600)}, event_type, count(*) AS increase FROM events WHERE value > 60 GROUP BY ALL HAVING count(*) > 2")
def q_stream_hourly_alert(spark, sf):
    out = measures.increase_above(_events(spark, sf), "ts", ["event_type"], F.col("value") > 60, 2)
    return _plain_times(drain(out, "update", ["window_start", "window_end", "event_type"]))


@query("SELECT event_id, ts, event_type FROM events")
def q_stream_dedupe(spark, sf):
    twice = _events(spark, sf).select("event_id", "ts", "event_type").withColumn("d", F.explode(F.array(F.lit(1), F.lit(2)))).drop("d")
    return _plain_times(drain(measures.dedupe(twice, "ts"), "append"))


@query(
    f"""SELECT {_WINDOW.format(3600)}, event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY ALL"""
)
def q_stream_p95(spark, sf):
    out = measures.quantile_5m(_events(spark, sf), "ts", "value", ["event_type"], width="1 hour")
    return _plain_times(drain(out, "update", ["window_start", "window_end", "event_type"]))


_EVALS = """(SELECT CAST(user_id AS VARCHAR) AS key, to_timestamp(floor(epoch(ts) / 3600)::BIGINT * 3600)::TIMESTAMP AS t, bool_or(value > 10) AS active
  FROM events GROUP BY ALL)"""


@query(
    f"""WITH r AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM {_EVALS}),
    s AS (SELECT key, t, min(t) OVER (PARTITION BY key, run) AS since, run FROM r WHERE active)
    SELECT key, since, min(t) AS fired_at FROM s WHERE epoch(t) - epoch(since) >= 43200 GROUP BY key, run, since"""
)
def q_stream_held_alert(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = alerts.evaluations(e, "ts", ["user_id"], F.col("value") > 10, "1 hour")
    path = _landed(rows, "evaluations", "parquet")
    stream = measures.event_stream(spark, path, rows.schema)
    return _plain_times(drain(alerts.held_alerts(stream, "user_id", "window_start", "active", 43200), "append"))


@query(
    f"""WITH r AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM {_EVALS}),
    s AS (SELECT key, t, min(t) OVER (PARTITION BY key, run) AS since, run FROM r WHERE active)
    SELECT key, since, min(t) AS fired_at FROM s WHERE epoch(t) - epoch(since) >= 43200 GROUP BY key, run, since"""
)
def q_held_alert_batch(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = alerts.evaluations(e, "ts", ["user_id"], F.col("value") > 10, "1 hour")
    return _plain_times(alerts.held_alerts_batch(rows, "user_id", "window_start", "active", 43200))


_LIMIT = "CASE WHEN value > 2.0 * goal THEN 'CRITICAL' WHEN value > 1.2 * goal THEN 'WARNING' ELSE 'OK' END"


@query(
    f"""WITH h AS (SELECT *, avg(value) OVER (PARTITION BY kpi_id) AS goal FROM {day_values_sql()}),
    s AS (SELECT *, {_LIMIT} AS severity, lag(value) OVER (PARTITION BY kpi_id ORDER BY run_at) AS previous FROM h)
    SELECT kpi_id, run_at, previous, value AS current, round((value - previous) / nullif(previous, 0) * 100, 4) AS delta_pct, severity
    FROM s WHERE severity <> 'OK'"""
)
def q_stream_breach(spark, sf):
    goals = day_values(spark, sf).groupBy("kpi_id").agg(F.avg("value").alias("target")).withColumns(
        {"polarity": F.lit("less_better"), "warning_pct": F.lit(120.0), "critical_pct": F.lit(200.0)}
    )
    days = measures.windowed(_events(spark, sf), "ts", ["event_type"], {"total": F.sum("value")}, "1 day")
    values = days.select(F.col("event_type").alias("kpi_id"), F.col("window_start").alias("run_at"), F.round("total", 4).alias("value"))
    base = scratch_path(spark, "breaches")
    watch = breach.watch_breaches(goals, base, breach.runs_within(600, 86400))
    state = scratch_path(spark, "stream-state")
    run = values.writeStream.outputMode("update").foreachBatch(watch).option("checkpointLocation", state)
    run.trigger(availableNow=True).start().awaitTermination()
    out = breach.latest_breaches(spark, base)
    return rounded(_plain_times(out.drop("threshold", "polarity")), 4, "delta_pct")
