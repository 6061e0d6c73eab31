"""Result comparison, schema drift, lifecycle reports and audit chains."""

from pyspark.sql import functions as F

from tamis.operators import audit, compare, drift, lifecycle
from tamis.queries import derived as d
from tamis.queries.registry import dealt_anew, query, rounded, table
from tamis.session import materialize
from tamis.sinks import outputs


def _two_runs(spark, sf):
    """The same orders as two versions of a result: some rows changed, dropped, added or repeated."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderstatus <> 'P' OR o_totalprice < 450000").unionByName(o.where("o_orderstatus = 'F' AND o_totalprice > 480000"))
    new = o.where("o_orderstatus <> 'O' OR o_totalprice < 460000").withColumn(
        "o_totalprice", F.expr("CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice * 1.00005D WHEN o_orderkey % 30 = 0 THEN o_totalprice + 10 ELSE o_totalprice END")
    )
    return old, new


_OLD = """(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice < 450000
  UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 480000)"""
_NEW = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice * 1.00005::DOUBLE WHEN o_orderkey % 30 = 0
  THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'O' OR o_totalprice < 460000)"""


@query(
    f"""SELECT 'ADDED' AS change, CAST(count(*) AS BIGINT) AS copies, o_orderkey, o_orderstatus, o_totalprice FROM (FROM {_NEW} EXCEPT ALL FROM {_OLD}) GROUP BY ALL
    UNION ALL SELECT 'REMOVED', count(*), o_orderkey, o_orderstatus, o_totalprice FROM (FROM {_OLD} EXCEPT ALL FROM {_NEW}) GROUP BY ALL
    UNION ALL SELECT 'SAME', count(*), o_orderkey, o_orderstatus, o_totalprice FROM (FROM {_OLD} INTERSECT ALL FROM {_NEW}) GROUP BY ALL"""
)
def q_rows_added_removed(spark, sf):
    out = compare.row_changes(*_two_runs(spark, sf))
    return out.withColumn("copies", F.col("copies").cast("bigint"))


def _unique_runs(spark, sf):
    old, new = _two_runs(spark, sf)
    return old.distinct(), new.withColumn("extra", F.col("o_orderkey") % 3)


@query(
    f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'ADDED' WHEN b.o_orderkey IS NULL THEN 'REMOVED'
      WHEN a.o_orderstatus <> b.o_orderstatus OR abs(a.o_totalprice - b.o_totalprice) > abs(a.o_totalprice) * 0.0001 THEN 'CHANGED' ELSE 'SAME' END AS change,
      concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN abs(a.o_totalprice - b.o_totalprice) > abs(a.o_totalprice) * 0.0001 THEN 'o_totalprice' END) AS changed
    FROM (SELECT DISTINCT * FROM {_OLD}) a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey"""
)
def q_row_diff(spark, sf):
    return compare.row_diff(*_unique_runs(spark, sf), ["o_orderkey"]).select("o_orderkey", "change", F.array_join("changed", ",").alias("changed"))


@query(
    f"""WITH p AS (SELECT DISTINCT * FROM {_OLD}), c AS (SELECT *, o_orderkey % 3 AS extra FROM {_NEW}),
    j AS (SELECT p.o_orderkey AS pk, c.o_orderkey AS ck, p.o_orderstatus AS ps, c.o_orderstatus AS cs, p.o_totalprice AS pt, c.o_totalprice AS ct
      FROM p FULL JOIN c ON p.o_orderkey = c.o_orderkey),
    r AS (SELECT 'o_orderkey' AS "column", (SELECT count(DISTINCT o_orderkey) FROM p) AS distinct_before, (SELECT count(DISTINCT o_orderkey) FROM c) AS distinct_after,
        (SELECT count(*) FROM j WHERE pk IS NULL OR ck IS NULL) AS rows_differing
      UNION ALL SELECT 'o_orderstatus', (SELECT count(DISTINCT o_orderstatus) FROM p), (SELECT count(DISTINCT o_orderstatus) FROM c), (SELECT count(*) FROM j WHERE ps <> cs)
      UNION ALL SELECT 'o_totalprice', (SELECT count(DISTINCT o_totalprice) FROM p), (SELECT count(DISTINCT o_totalprice) FROM c), (SELECT count(*) FROM j WHERE abs(pt - ct) > abs(pt) * 0.0001)
      UNION ALL SELECT 'extra', NULL, (SELECT count(DISTINCT extra) FROM c), NULL)
    SELECT *, CASE WHEN "column" = 'extra' THEN 'NOUVEAU' WHEN rows_differing = 0 THEN 'IDENTIQUE' ELSE 'MODIFIE' END AS status FROM r"""
)
def q_column_diff(spark, sf):
    return compare.column_diff(*_unique_runs(spark, sf), ["o_orderkey"])


def _kpi_pair(spark, sf):
    """One KPI per customer before and after; some customers have orders on one side only."""
    rows = table(spark, sf, "orders")
    kpis = lambda df: df.groupBy(F.col("o_custkey").alias("kpi_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    limits = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("kpi_id"),
        F.expr("CASE WHEN c_nationkey < 20 THEN 25.0D ELSE 100000.0D END").alias("threshold"),
        (F.col("c_nationkey") < 10).alias("critical"),
        F.col("c_nationkey").alias("workflow_id"),
    )
    return kpis(rows.where("o_orderstatus <> 'P'")), kpis(rows.where("o_orderpriority <> '1-URGENT'")), limits


_PAIR = """WITH a AS (SELECT o_custkey AS kpi_id, round(sum(o_totalprice), 2) AS previous FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
  b AS (SELECT o_custkey AS kpi_id, round(sum(o_totalprice), 2) AS current FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
  f AS (SELECT coalesce(a.kpi_id, b.kpi_id) AS kpi_id, previous, current, current - previous AS delta_abs, (current - previous) / nullif(abs(previous), 0) * 100 AS delta_pct
    FROM a FULL JOIN b ON a.kpi_id = b.kpi_id),
  x AS (SELECT f.*, CASE WHEN c_nationkey < 20 THEN 25.0::DOUBLE ELSE 100000.0::DOUBLE END AS threshold,
    coalesce(delta_abs = 0 OR abs(delta_pct) <= CASE WHEN c_nationkey < 20 THEN 25.0 ELSE 100000.0 END, false) AS within_threshold, c_nationkey < 10 AS critical, c_nationkey AS workflow_id
    FROM f JOIN customer ON c_custkey = kpi_id)"""


@query(
    f"""{_PAIR} SELECT kpi_id, previous, current, round(delta_abs, 2) + 0.0 AS delta_abs, round(delta_pct, 6) + 0.0 AS delta_pct, threshold, within_threshold, critical FROM x"""
)
def q_kpi_diff(spark, sf):
    return rounded(rounded(compare.kpi_diff(*_kpi_pair(spark, sf)), 6, "delta_pct"), 2, "delta_abs")


@query(
    f"""{_PAIR} SELECT kpi_id, CASE WHEN within_threshold THEN 'OK' WHEN critical THEN 'BREACH' ELSE 'WARN' END AS decision FROM x"""
)
def q_kpi_decision(spark, sf):
    return compare.kpi_decisions(compare.kpi_diff(*_kpi_pair(spark, sf))).select("kpi_id", "decision")


@query(
    f"""{_PAIR}, v AS (SELECT kpi_id, workflow_id, CASE WHEN within_threshold THEN 'OK' WHEN critical THEN 'BREACH' ELSE 'WARN' END AS decision FROM x)
    SELECT workflow_id, CASE WHEN bool_or(decision = 'BREACH') THEN 'BLOCKED' WHEN bool_or(decision = 'WARN') THEN 'APPROVED_WITH_WARNINGS' ELSE 'APPROVED_FOR_DEPLOYMENT' END AS decision,
      NOT bool_or(decision = 'BREACH') AS within_threshold,
      coalesce(string_agg('kpi.' || CAST(kpi_id AS VARCHAR) || CASE decision WHEN 'BREACH' THEN '.breach' ELSE '.warn' END, ',' ORDER BY 'kpi.' || CAST(kpi_id AS VARCHAR) || CASE decision WHEN 'BREACH' THEN '.breach' ELSE '.warn' END)
        FILTER (WHERE decision <> 'OK'), '') AS reasons
    FROM v GROUP BY workflow_id"""
)
def q_verdict(spark, sf):
    before, after, limits = _kpi_pair(spark, sf)
    decisions = compare.kpi_decisions(compare.kpi_diff(before, after, limits))
    owned = decisions.join(limits.select("kpi_id", "workflow_id"), "kpi_id")
    out = compare.verdict(owned.withColumn("kpi_id", F.col("kpi_id").cast("string")), keys=["workflow_id"])
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH p AS (SELECT a.kpi_id, abs(b.value - a.value) / abs(a.value) * 100 AS gap FROM {d.day_values_sql()} a
      JOIN {d.day_values_sql("value * (1 + (event_id % 7) / 1000.0::DOUBLE)")} b ON a.kpi_id = b.kpi_id AND a.run_at = b.run_at)
    SELECT kpi_id, count(*) AS runs, round(max(gap), 4) AS worst, round(quantile_cont(gap, 0.95), 4) AS p95, quantile_cont(gap, 0.95) < 1.0 AS passes
    FROM p GROUP BY kpi_id"""
)
def q_shadow_p95(spark, sf):
    out = compare.shadow_divergence(d.day_values(spark, sf), d.day_values(spark, sf, "value * (1 + (event_id % 7) / 1000.0D)"))
    return rounded(out, 4)


_TOTALS = """(SELECT l_suppkey, l_returnflag, sum(l_quantity) AS qty FROM lineitem {0} GROUP BY ALL)"""
_TOP5 = "(SELECT string_agg(CAST(k AS VARCHAR), ', ' ORDER BY CAST(k AS VARCHAR)) FROM (SELECT l_suppkey AS k FROM {0} GROUP BY 1 ORDER BY sum(qty) DESC, k LIMIT 5))"


@query(
    f"""WITH a AS (FROM {_TOTALS.format("")}), b AS (FROM {_TOTALS.format("WHERE l_linenumber < 7 OR l_tax > 0.02")})
    SELECT 'total' AS "check", CAST(CAST((SELECT sum(qty) FROM a) AS DECIMAL(38, 2)) AS VARCHAR) AS legacy,
      CAST(CAST((SELECT sum(qty) FROM b) AS DECIMAL(38, 2)) AS VARCHAR) AS current,
      abs((SELECT sum(qty) FROM b) - (SELECT sum(qty) FROM a)) / (SELECT sum(qty) FROM a) * 100 < 0.5 AS passes
    UNION ALL SELECT 'top_5', {_TOP5.format("a")}, {_TOP5.format("b")}, {_TOP5.format("a")} = {_TOP5.format("b")}
    UNION ALL SELECT 'distinct_l_suppkey', CAST((SELECT count(DISTINCT l_suppkey) FROM a) AS VARCHAR), CAST((SELECT count(DISTINCT l_suppkey) FROM b) AS VARCHAR),
      (SELECT count(DISTINCT l_suppkey) FROM a) = (SELECT count(DISTINCT l_suppkey) FROM b)
    UNION ALL SELECT 'distinct_l_returnflag', CAST((SELECT count(DISTINCT l_returnflag) FROM a) AS VARCHAR), CAST((SELECT count(DISTINCT l_returnflag) FROM b) AS VARCHAR),
      (SELECT count(DISTINCT l_returnflag) FROM a) = (SELECT count(DISTINCT l_returnflag) FROM b)"""
)
def q_parity_top5(spark, sf):
    rows = table(spark, sf, "lineitem")
    total = F.sum("l_quantity").alias("qty")
    legacy = rows.groupBy("l_suppkey", "l_returnflag").agg(total)
    current = rows.where("l_linenumber < 7 OR l_tax > 0.02").groupBy("l_suppkey", "l_returnflag").agg(total)
    return compare.parity_checks(legacy, current, ["l_suppkey", "l_returnflag"], "qty")


def _chart_pair(spark, sf):
    part = table(spark, sf, "part")
    cells = lambda rows: rows.groupBy("p_type", "p_brand").agg(F.sum("p_size").alias("y"))
    return cells(part.where("p_brand <> 'Brand#3'")), cells(part.where("p_brand NOT IN ('Brand#5', 'Brand#7')"))


@query(
    """SELECT p_brand AS series, CASE WHEN p_brand = 'Brand#3' THEN 'ADDED' ELSE 'REMOVED' END AS change
    FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand IN ('Brand#3', 'Brand#5', 'Brand#7')"""
)
def q_series_diff(spark, sf):
    return compare.series_changes(*_chart_pair(spark, sf), "p_brand")


@query(
    """SELECT 'viz' AS chart_id, true AS structural_change, count(DISTINCT p_brand) FILTER (WHERE p_brand = 'Brand#3') AS series_added,
      count(DISTINCT p_brand) FILTER (WHERE p_brand IN ('Brand#5', 'Brand#7')) AS series_removed, true AS data_changed FROM part"""
)
def q_chart_diff(spark, sf):
    return compare.chart_diff(*_chart_pair(spark, sf), "p_brand", "viz").drop("hash_before", "hash_after")


@query("SELECT count(*) AS rows, true AS order_free, true AS sees_a_cell, true AS sees_a_copy FROM lineitem")
def q_content_hash(spark, sf):
    rows = table(spark, sf, "lineitem")
    one = compare.content_hash(rows)
    other = compare.content_hash(dealt_anew(rows)).select(F.col("digest").alias("d")).scalar()
    digest = lambda df: compare.content_hash(df).select(F.col("digest").alias("d")).scalar()
    first = rows.agg(F.min("l_orderkey")).scalar()
    cell = digest(rows.withColumn("l_tax", F.when(F.col("l_orderkey") == first, F.col("l_tax") + 1).otherwise(F.col("l_tax"))))
    copy = digest(rows.unionByName(rows.limit(1)))
    return one.select("rows", (F.col("digest") == other).alias("order_free"), (F.col("digest") != cell).alias("sees_a_cell"), (F.col("digest") != copy).alias("sees_a_copy"))


@query(
    """WITH v AS (SELECT event_type AS kpi_id, avg(value) AS value, avg(value) + (length(event_type) - 6) * 0.04 AS expected FROM events GROUP BY 1)
    SELECT kpi_id, round(expected, 6) AS expected, 0.05::DOUBLE AS tolerance, round(value, 6) AS value FROM v WHERE abs(value - expected) > 0.05"""
)
def q_golden_kpi(spark, sf):
    values = table(spark, sf, "events").groupBy(F.col("event_type").alias("kpi_id")).agg(F.avg("value").alias("value"))
    expected = values.select("kpi_id", (F.col("value") + (F.length("kpi_id") - 6) * 0.04).alias("expected"))
    return rounded(compare.golden_breaches(values, expected))


_CHANGES = f"""(SELECT coalesce(s.workflow_id, c.workflow_id) AS workflow_id, coalesce(s.field, c.field) AS field, s.type AS old_type, c.type AS new_type,
  CASE WHEN s.field IS NULL THEN 'NEW_FIELD' WHEN c.field IS NULL THEN 'REMOVED_FIELD' ELSE 'TYPE_CHANGE' END AS kind
  FROM {d.SNAPSHOT_SQL} s FULL JOIN {d.CURRENT_SQL} c ON s.workflow_id = c.workflow_id AND s.field = c.field WHERE s.type IS DISTINCT FROM c.type)"""


@query(f"SELECT workflow_id, kind, field, old_type, new_type FROM {_CHANGES}")
def q_drift_fields(spark, sf):
    return drift.field_changes(d.snapshot(spark, sf), d.current(spark, sf))


@query(f"SELECT s.workflow_id, s.field FROM {d.SNAPSHOT_SQL} s JOIN {d.CURRENT_SQL} c ON s.workflow_id = c.workflow_id AND s.field = c.field")
def q_drift_unchanged(spark, sf):
    return drift.unchanged_fields(d.snapshot(spark, sf), d.current(spark, sf))


def _drift_sql(result: str, limit: str = "0.85") -> str:
    """``result`` over ``drift``: all changes, with renames matched one to one in name order."""
    return f"""WITH RECURSIVE ch AS (FROM {_CHANGES}), pol AS (FROM {d.POLICIES_SQL}),
    pairs AS (SELECT r.workflow_id, r.field AS removed, a.field AS added, {limit} AS threshold,
        1.0::DOUBLE - CAST(levenshtein(r.field, a.field) AS DOUBLE) / greatest(length(r.field), length(a.field)) AS score
      FROM ch r JOIN ch a ON r.workflow_id = a.workflow_id AND r.kind = 'REMOVED_FIELD' AND a.kind = 'NEW_FIELD' LEFT JOIN pol ON pol.workflow_id = r.workflow_id),
    cand AS (SELECT workflow_id, removed, list(struct_pack(score := score, added := added) ORDER BY score DESC, added) AS cs,
        row_number() OVER (PARTITION BY workflow_id ORDER BY removed) AS n FROM pairs WHERE score >= threshold GROUP BY workflow_id, removed),
    walk AS (SELECT workflow_id, n, removed, cs[1] AS m, [cs[1].added] AS taken FROM cand WHERE n = 1
      UNION ALL SELECT c.workflow_id, c.n, c.removed, list_filter(c.cs, lambda x: NOT list_contains(w.taken, x.added))[1],
        list_concat(w.taken, [list_filter(c.cs, lambda x: NOT list_contains(w.taken, x.added))[1].added])
      FROM walk w JOIN cand c ON c.workflow_id = w.workflow_id AND c.n = w.n + 1),
    matched AS (SELECT workflow_id, removed, m.added AS added, m.score AS score FROM walk WHERE m IS NOT NULL),
    drift AS (SELECT ch.workflow_id, kind, field, NULL::VARCHAR AS new_field, old_type, new_type, NULL::DOUBLE AS score FROM ch
      LEFT JOIN matched a ON kind = 'REMOVED_FIELD' AND a.workflow_id = ch.workflow_id AND a.removed = field
      LEFT JOIN matched b ON kind = 'NEW_FIELD' AND b.workflow_id = ch.workflow_id AND b.added = field
      WHERE a.removed IS NULL AND b.added IS NULL
    UNION ALL SELECT m.workflow_id, 'RENAMED_FIELD', removed, added, r.old_type, n.new_type, round(score, 9) FROM matched m
      JOIN ch r ON r.workflow_id = m.workflow_id AND r.field = removed JOIN ch n ON n.workflow_id = m.workflow_id AND n.field = added),
    rated AS (SELECT x.*, CASE kind WHEN 'NEW_FIELD' THEN coalesce(on_new_field, 'REQUIRE_MAPPING') WHEN 'REMOVED_FIELD' THEN coalesce(on_removed_field, 'BLOCK')
        WHEN 'TYPE_CHANGE' THEN coalesce(on_type_change, 'REQUIRE_CAST') ELSE coalesce(on_renamed, 'SUGGEST') END AS action
      FROM drift x LEFT JOIN pol ON pol.workflow_id = x.workflow_id)
    {result}"""


@query(_drift_sql("FROM drift"))
def q_drift_renames(spark, sf):
    return rounded(drift.detect(d.snapshot(spark, sf), d.current(spark, sf)), 9)


@query(
    _drift_sql(
        """SELECT workflow_id, field, new_field, CASE WHEN kind = 'NEW_FIELD' THEN 'ADDED' WHEN kind = 'REMOVED_FIELD' THEN 'REMOVED' WHEN kind = 'RENAMED_FIELD' THEN 'RENAMED'
        WHEN old_type = 'int' AND new_type = 'bigint' THEN 'WIDENED' ELSE 'TYPE_CHANGED' END AS change, old_type, new_type,
      kind = 'REMOVED_FIELD' OR kind = 'TYPE_CHANGE' AND NOT (old_type = 'int' AND new_type = 'bigint') AS blocking FROM drift"""
    )
)
def q_schema_diff(spark, sf):
    return compare.output_changes(drift.detect(d.snapshot(spark, sf), d.current(spark, sf)))


_LIMIT = "coalesce(similarity_threshold, 0.85)"


def _rated(spark, sf):
    rules = d.policies(spark, sf)
    limits = rules.select("workflow_id", F.coalesce("similarity_threshold", F.lit(drift.THRESHOLD)).alias("similarity_threshold"))
    return drift.apply_policy(rounded(drift.detect(d.snapshot(spark, sf), d.current(spark, sf), limits), 9), rules.drop("similarity_threshold"))


@query(
    _drift_sql(
        """SELECT workflow_id, kind, field, new_field, action, action = 'BLOCK' AS blocks, CASE
      WHEN kind = 'REMOVED_FIELD' AND action = 'BLOCK' THEN 'Field ' || field || ' removed from source — blocked by policy'
      WHEN kind = 'NEW_FIELD' AND action = 'BLOCK' THEN 'Field ' || field || ' added to source — blocked by policy'
      WHEN kind = 'NEW_FIELD' AND action = 'REQUIRE_MAPPING' THEN 'Field ' || field || ' added to source — explicit mapping required'
      WHEN kind = 'TYPE_CHANGE' AND action = 'BLOCK' THEN 'Field ' || field || ' type changed ' || old_type || ' → ' || new_type || ' — blocked by policy'
      WHEN kind = 'TYPE_CHANGE' AND action = 'REQUIRE_CAST' THEN 'Field ' || field || ' type changed ' || old_type || ' → ' || new_type || ' — explicit cast required'
      WHEN kind = 'RENAMED_FIELD' AND action = 'BLOCK' THEN 'Field ' || field || ' renamed to ' || new_field || ' (similarity=' || CAST(score AS VARCHAR) || ') — blocked by policy'
      WHEN kind = 'RENAMED_FIELD' AND action = 'SUGGEST' THEN 'Field ' || field || ' likely renamed to ' || new_field || ' (similarity=' || CAST(score AS VARCHAR) || ') — confirm mapping'
      END AS reason FROM rated""",
        _LIMIT,
    )
)
def q_drift_policy(spark, sf):
    return _rated(spark, sf).select("workflow_id", "kind", "field", "new_field", "action", "blocks", "reason")


@query(
    _drift_sql(
        """SELECT workflow_id, bool_or(action = 'BLOCK') AS blocked, count(*) FILTER (WHERE action NOT IN ('IGNORE', 'WARN', 'AUTOCAST', 'AUTO_BY_SIMILARITY')) AS reasons,
      count(*) AS changes FROM rated GROUP BY workflow_id""",
        _LIMIT,
    )
)
def q_drift_decisions(spark, sf):
    return drift.policy_decisions(_rated(spark, sf))


@query(
    _drift_sql(
        """SELECT CAST(workflow_id AS VARCHAR) AS key, bool_or(action = 'BLOCK') AS blocked, count(*) FILTER (WHERE kind = 'NEW_FIELD') AS new_field,
      count(*) FILTER (WHERE kind = 'REMOVED_FIELD') AS removed_field, count(*) FILTER (WHERE kind = 'TYPE_CHANGE') AS type_change,
      count(*) FILTER (WHERE kind = 'RENAMED_FIELD') AS renamed_field,
      count(*) FILTER (WHERE action NOT IN ('IGNORE', 'WARN', 'AUTOCAST', 'AUTO_BY_SIMILARITY')) AS reasons,
      array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM rated GROUP BY workflow_id""",
        _LIMIT,
    )
)
def q_drift_messages(spark, sf):
    """Detection, policy and one message per workflow that drifts, read back from the message bodies."""
    messages = outputs.as_messages(drift.drift_events(_rated(spark, sf)), "workflow_id")
    body = "blocked boolean, new_field bigint, removed_field bigint, type_change bigint, renamed_field bigint, reasons array<string>, fields array<string>"
    read = messages.select("key", F.from_json("value", body).alias("m")).select("key", "m.*")
    return read.withColumns({"reasons": F.size("reasons").cast("bigint"), "fields": F.array_join("fields", ",")})


@query(
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER) AS customer,
      o_orderstatus AS status, NULL::VARCHAR AS region FROM orders"""
)
def q_drift_resolve(spark, sf):
    drifted = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE cast(o_custkey AS string) END AS customer",
        "o_orderstatus AS new_status",
        "o_orderpriority AS unknown",
    )
    wanted = {"o_orderkey": "bigint", "customer": "int", "status": "string", "region": "string"}
    return drift.resolve(drifted, wanted, {"status": "new_status"})


_JSON = """CASE WHEN event_id % 5 = 0 THEN '{"k": "' || event_type || '", "extra": 1.5}' WHEN event_id % 5 = 1 THEN '{"k": "12", "flag": "true"}' ELSE props END"""


@query(
    f"""SELECT DISTINCT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, field, CASE json_type(v) WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE 'string' END AS type
    FROM (SELECT event_type, ts, unnest(json_keys(j)) AS field, json_extract(j, '$.' || unnest(json_keys(j))) AS v FROM (SELECT event_type, ts, {_JSON} AS j FROM events))"""
)
def q_drift_json_fields(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_type", "cast(date_trunc('day', ts) AS timestamp_ntz) AS day", _JSON.replace("||", "||") + " AS j"
    )
    return drift.json_fields(rows, "j", ["event_type", "day"])


@query(
    f"""SELECT workflow_id, version_id, deployed_at FROM {d.VERSIONS_SQL} WHERE status = 'DEPLOYED'
    QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY deployed_at DESC NULLS LAST, version_id DESC) = 1"""
)
def q_active_version(spark, sf):
    return lifecycle.active_versions(d.versions(spark, sf)).select("workflow_id", "version_id", "deployed_at")


@query(
    f"""SELECT workflow_id, version_id, status FROM {d.VERSIONS_SQL}
    QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY status = 'DEPLOYED' DESC, created_at DESC, version_id DESC) = 1"""
)
def q_reference_version(spark, sf):
    return lifecycle.reference_versions(d.versions(spark, sf)).select("workflow_id", "version_id", "status")


@query(f"SELECT version_id, count(DISTINCT approver_subject) AS approvals FROM {d.APPROVALS_SQL} GROUP BY 1")
def q_approvals(spark, sf):
    return lifecycle.approval_counts(d.approvals(spark, sf))


@query(f"SELECT version_id, max(finished_at) AS last_simulation FROM {d.SIMULATIONS_SQL} WHERE status = 'SUCCEEDED' GROUP BY 1")
def q_last_simulation(spark, sf):
    return lifecycle.last_simulations(d.simulations(spark, sf))


@query(
    f"""WITH r AS (SELECT version_id, is_critical, CASE version_id % 3 WHEN 0 THEN 'SHADOW' WHEN 1 THEN 'DIRECT' ELSE 'BLUE_GREEN' END AS strategy
      FROM {d.VERSIONS_SQL} v JOIN {d.WORKFLOWS_SQL} w ON v.workflow_id = w.workflow_id),
    g AS (SELECT r.*, coalesce(a.approvals, 0) AS approvals, s.last_simulation, CASE WHEN is_critical THEN 2 ELSE 1 END AS needed FROM r
      LEFT JOIN (SELECT version_id, count(DISTINCT approver_subject) AS approvals FROM {d.APPROVALS_SQL} GROUP BY 1) a ON a.version_id = r.version_id
      LEFT JOIN (SELECT version_id, max(finished_at) AS last_simulation FROM {d.SIMULATIONS_SQL} WHERE status = 'SUCCEEDED' GROUP BY 1) s ON s.version_id = r.version_id),
    t AS (SELECT *, CASE WHEN approvals < needed THEN 'Approvals: ' || CAST(approvals AS VARCHAR) || '/' || CAST(needed AS VARCHAR) || '; ' ELSE '' END
        || CASE WHEN last_simulation IS NULL THEN 'No simulation found for this version; ' ELSE '' END
        || CASE WHEN last_simulation < TIMESTAMP '1999-01-01' - INTERVAL 7 DAY THEN 'Simulation older than 7 days; ' ELSE '' END
        || CASE WHEN is_critical AND strategy <> 'SHADOW' THEN 'Critical workflow requires SHADOW strategy first; ' ELSE '' END AS reasons FROM g)
    SELECT version_id, approvals, reasons, reasons = '' AS allowed FROM t"""
)
def q_gate_report(spark, sf):
    requests = d.versions(spark, sf).join(d.workflows(spark, sf), "workflow_id").selectExpr(
        "version_id",
        "is_critical",
        "CASE version_id % 3 WHEN 0 THEN 'SHADOW' WHEN 1 THEN 'DIRECT' ELSE 'BLUE_GREEN' END AS strategy",
    )
    out = lifecycle.gate_report(requests, d.approvals(spark, sf), d.simulations(spark, sf), F.expr("TIMESTAMP_NTZ '1999-01-01'"))
    joined = F.concat(F.array_join("reasons", "; "), F.when(F.size("reasons") > 0, "; ").otherwise(""))
    return out.select("version_id", "approvals", joined.alias("reasons"), "allowed")


@query(
    f"""SELECT v.workflow_id, e.version_id, deployment_id FROM {d.DEPLOYMENTS_SQL} e JOIN {d.VERSIONS_SQL} v ON v.version_id = e.version_id
    WHERE rolled_back_at IS NULL AND completed_at IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY v.workflow_id ORDER BY completed_at DESC, deployment_id DESC) = 1"""
)
def q_active_deployment(spark, sf):
    out = lifecycle.active_deployments(d.deployments(spark, sf), d.versions(spark, sf))
    return out.select("workflow_id", "version_id", "deployment_id")


@query(
    f"""WITH v AS (FROM {d.VERSIONS_SQL}), f AS (SELECT workflow_id, version_id FROM v)
    SELECT f.workflow_id, f.version_id AS failing_version, v.version_id AS target_version, v.deployed_at FROM f JOIN v ON v.workflow_id = f.workflow_id
    WHERE v.status = 'DEPRECATED' AND v.deployed_at IS NOT NULL AND v.version_id <> f.version_id
    QUALIFY row_number() OVER (PARTITION BY f.version_id ORDER BY v.deployed_at DESC, v.version_id DESC) = 1"""
)
def q_rollback_target(spark, sf):
    versions = d.versions(spark, sf)
    return lifecycle.rollback_targets(versions, versions)


@query(
    f"""WITH v AS (SELECT *, lag(semver) OVER (PARTITION BY workflow_id ORDER BY created_at, version_id) AS previous FROM {d.VERSIONS_SQL}),
    p AS (SELECT *, CAST(split_part(split_part(previous, '-', 1), '.', 1) AS INT) AS a, CAST(split_part(split_part(previous, '-', 1), '.', 2) AS INT) AS b,
      CAST(split_part(split_part(previous, '-', 1), '.', 3) AS INT) AS c, CAST(split_part(split_part(semver, '-', 1), '.', 1) AS INT) AS x,
      CAST(split_part(split_part(semver, '-', 1), '.', 2) AS INT) AS y, CAST(split_part(split_part(semver, '-', 1), '.', 3) AS INT) AS z FROM v)
    SELECT version_id, semver, previous, CASE WHEN previous IS NULL THEN 'FIRST' WHEN (x, y, z) = (a, b, c) THEN 'SAME' WHEN x = a + 1 AND y = 0 AND z = 0 THEN 'MAJOR'
      WHEN x = a AND y = b + 1 AND z = 0 THEN 'MINOR' WHEN x = a AND y = b AND z = c + 1 THEN 'PATCH' ELSE 'INVALID' END AS step FROM p"""
)
def q_version_steps(spark, sf):
    return lifecycle.version_steps(d.versions(spark, sf)).select("version_id", "semver", "previous", "step")


@query(f"SELECT status, count(*) AS versions FROM {d.VERSIONS_SQL} GROUP BY status")
def q_status_counts(spark, sf):
    return lifecycle.status_counts(d.versions(spark, sf))


@query(f"SELECT sub_project, count(*) AS workflows FROM {d.WORKFLOWS_SQL} WHERE archived_at IS NULL GROUP BY sub_project")
def q_workflows_per_project(spark, sf):
    return lifecycle.workflows_per_project(d.workflows(spark, sf))


@query(f"WITH {d.CHAIN_SQL} SELECT audit_id, workflow_id, parent_hash, self_hash FROM chain")
def q_chain_build(spark, sf):
    out = audit.build_chain(d.audit_entries(spark, sf), d.audit_keys(spark, sf))
    return out.select("audit_id", "workflow_id", "parent_hash", "self_hash")


def _tampered(spark, sf):
    """A stored log whose chains have lost entries and changed payloads."""
    chain = audit.build_chain(d.audit_entries(spark, sf), d.audit_keys(spark, sf)).where("payload <> '{\"k\": 7}'")
    changed = F.expr("CASE WHEN payload = '{\"k\": 8}' THEN concat(payload, ' ') ELSE payload END")
    return materialize(chain.withColumn("payload", changed), "audit")


_LINKED = f"""WITH {d.CHAIN_SQL}, kept AS (SELECT *, lag(self_hash) OVER (PARTITION BY workflow_id ORDER BY occurred_at, audit_id) AS before
  FROM chain JOIN (SELECT event_id, props FROM events) e ON event_id = audit_id WHERE props <> '{{"k": 7}}'),
  rated AS (SELECT *, parent_hash IS NOT DISTINCT FROM before AS linked, props <> '{{"k": 8}}' AS intact FROM kept)"""


@query(f"{_LINKED} SELECT audit_id, linked FROM rated")
def q_chain_links(spark, sf):
    return audit.check_links(_tampered(spark, sf)).select("audit_id", "linked")


@query(f"{_LINKED} SELECT audit_id, intact FROM rated")
def q_chain_hashes(spark, sf):
    return audit.check_hashes(_tampered(spark, sf), d.audit_keys(spark, sf)).select("audit_id", "intact")


@query(
    f"""{_LINKED} SELECT workflow_id, count(*) AS entries, count(*) FILTER (WHERE NOT linked OR NOT intact) AS breaks,
      arg_min(audit_id, (occurred_at, audit_id)) FILTER (WHERE NOT linked OR NOT intact) AS first_break,
      arg_min(CASE WHEN NOT linked THEN 'LINK' ELSE 'HASH' END, (occurred_at, audit_id)) FILTER (WHERE NOT linked OR NOT intact) AS cause
    FROM rated GROUP BY workflow_id"""
)
def q_chain_verify(spark, sf):
    return audit.verify(_tampered(spark, sf), d.audit_keys(spark, sf))
