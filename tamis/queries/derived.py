"""Control tables, catalogues and logs that Spark derives from the given tables, and their SQL."""

from pyspark.sql import functions as F

from tamis.queries.registry import table

VERSIONS_SQL = """(SELECT o_orderkey AS version_id, o_custkey AS workflow_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'DEPLOYED' WHEN 'O' THEN 'DEPRECATED' ELSE 'DRAFT' END AS status,
  CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 11 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS deployed_at,
  CAST(o_orderkey % 2 AS VARCHAR) || '.' || CAST(o_orderkey % 3 AS VARCHAR) || '.' || CAST(o_orderkey % 2 AS VARCHAR)
    || CASE WHEN o_orderkey % 7 = 0 THEN '-rc.1' ELSE '' END AS semver FROM orders)"""


def versions(spark, sf):
    o = table(spark, sf, "orders")
    return o.selectExpr(
        "o_orderkey AS version_id",
        "o_custkey AS workflow_id",
        "o_orderdate AS created_at",
        "CASE o_orderstatus WHEN 'F' THEN 'DEPLOYED' WHEN 'O' THEN 'DEPRECATED' ELSE 'DRAFT' END AS status",
        "CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 11 <> 0 THEN o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 5 AS int)) END AS deployed_at",
        "concat(o_orderkey % 2, '.', o_orderkey % 3, '.', o_orderkey % 2, CASE WHEN o_orderkey % 7 = 0 THEN '-rc.1' ELSE '' END) AS semver",
    )


WORKFLOWS_SQL = """(SELECT c_custkey AS workflow_id, c_mktsegment AS sub_project, c_acctbal > 5000 AS is_critical,
  CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2001-01-01' END AS archived_at FROM customer)"""


def workflows(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS workflow_id",
        "c_mktsegment AS sub_project",
        "c_acctbal > 5000 AS is_critical",
        "CASE WHEN c_acctbal < 0 THEN TIMESTAMP_NTZ '2001-01-01' END AS archived_at",
    )


APPROVALS_SQL = """(SELECT l_orderkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 100000000 END AS version_id,
  'user:' || CAST(l_suppkey % 3 AS VARCHAR) AS approver_subject FROM lineitem)"""


def approvals(spark, sf):
    # open lines approve versions of another range of ids, so some versions have no approval
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 100000000 END AS version_id", "concat('user:', l_suppkey % 3) AS approver_subject"
    )


SIMULATIONS_SQL = """(SELECT l_orderkey AS version_id, CASE WHEN l_returnflag = 'N' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
  l_shipdate AS finished_at FROM lineitem)"""


def simulations(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS version_id",
        "CASE WHEN l_returnflag = 'N' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status",
        "l_shipdate AS finished_at",
    )


DEPLOYMENTS_SQL = """(SELECT o_orderkey + 1000000 AS deployment_id, o_orderkey AS version_id,
  CASE WHEN o_totalprice > 50000 THEN o_orderdate + to_days(1) END AS completed_at,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + to_days(2) END AS rolled_back_at FROM orders)"""


def deployments(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey + 1000000 AS deployment_id",
        "o_orderkey AS version_id",
        "CASE WHEN o_totalprice > 50000 THEN o_orderdate + INTERVAL 1 DAY END AS completed_at",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 2 DAYS END AS rolled_back_at",
    )


# Catalogue: one workflow per brand, one field per part; the current schema drops, adds, renames
# and retypes some of them.
SNAPSHOT_SQL = """(SELECT p_brand AS workflow_id, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS field,
  CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'string' END AS type FROM part)"""
CURRENT_SQL = """(SELECT p_brand AS workflow_id,
  CASE WHEN p_size = 1 THEN upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') || '_' || CAST(p_partkey AS VARCHAR)
    ELSE replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size = 2 THEN 'x' WHEN p_size = 3 THEN '_added_later' ELSE '' END END AS field,
  CASE WHEN p_size IN (5, 6, 7) THEN 'bigint' WHEN p_size % 2 = 0 THEN 'int' ELSE 'string' END AS type
  FROM part WHERE p_size <> 4)"""


def snapshot(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_brand AS workflow_id",
        "concat(replace(p_name, ' ', '_'), '_', p_partkey) AS field",
        "CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'string' END AS type",
    )


def current(spark, sf):
    return table(spark, sf, "part").where("p_size <> 4").selectExpr(
        "p_brand AS workflow_id",
        """CASE WHEN p_size = 1 THEN concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', '_'), '_', p_partkey)
        ELSE concat(replace(p_name, ' ', '_'), '_', p_partkey, CASE WHEN p_size = 2 THEN 'x' WHEN p_size = 3 THEN '_added_later' ELSE '' END) END AS field""",
        "CASE WHEN p_size IN (5, 6, 7) THEN 'bigint' WHEN p_size % 2 = 0 THEN 'int' ELSE 'string' END AS type",
    )


POLICIES_SQL = """(SELECT DISTINCT p_brand AS workflow_id,
  CASE WHEN p_brand LIKE '%1' THEN 'IGNORE' WHEN p_brand LIKE '%2' THEN 'BLOCK' END AS on_new_field,
  CASE WHEN p_brand LIKE '%3' THEN 'WARN' END AS on_removed_field,
  CASE WHEN p_brand LIKE '%4' THEN 'AUTOCAST' WHEN p_brand LIKE '%5' THEN 'BLOCK' END AS on_type_change,
  CASE WHEN p_brand LIKE '%1' THEN 'AUTO_BY_SIMILARITY' WHEN p_brand LIKE '%2' THEN 'BLOCK' END AS on_renamed,
  CASE WHEN p_brand LIKE '%3' THEN 0.95::DOUBLE END AS similarity_threshold FROM part)"""


def policies(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_brand AS workflow_id",
        "CASE WHEN p_brand LIKE '%1' THEN 'IGNORE' WHEN p_brand LIKE '%2' THEN 'BLOCK' END AS on_new_field",
        "CASE WHEN p_brand LIKE '%3' THEN 'WARN' END AS on_removed_field",
        "CASE WHEN p_brand LIKE '%4' THEN 'AUTOCAST' WHEN p_brand LIKE '%5' THEN 'BLOCK' END AS on_type_change",
        "CASE WHEN p_brand LIKE '%1' THEN 'AUTO_BY_SIMILARITY' WHEN p_brand LIKE '%2' THEN 'BLOCK' END AS on_renamed",
        "CASE WHEN p_brand LIKE '%3' THEN 0.95D END AS similarity_threshold",
    ).distinct()


# Audit log: one chain per user of the event table.
def audit_entries(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS audit_id",
        "user_id AS workflow_id",
        "event_id % 5 AS version_id",
        "CASE WHEN event_id % 7 <> 0 THEN concat('user:', event_id % 7) END AS actor_subject",
        "event_type AS action",
        "props AS payload",
        "ts AS occurred_at",
        "concat('v', 1 + event_id % 5) AS key_version",
    )


def audit_keys(spark, sf):
    return table(spark, sf, "region").selectExpr("concat('v', r_regionkey + 1) AS key_version", "r_name AS secret")


_TEXT = "coalesce(CAST(length({0}) AS VARCHAR) || ':' || {0}, '-')"
_AUDIT_FIELDS = [
    "CAST(event_id AS VARCHAR)",
    "CAST(user_id AS VARCHAR)",
    "CAST(event_id % 5 AS VARCHAR)",
    "CASE WHEN event_id % 7 <> 0 THEN 'user:' || CAST(event_id % 7 AS VARCHAR) END",
    "event_type",
    "props",
    "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')",
]
# chain(audit_id, workflow_id, occurred_at, rn, parent_hash, self_hash, secret, body)
CHAIN_SQL = f"""RECURSIVE entries AS (
  SELECT event_id AS audit_id, user_id AS workflow_id, ts AS occurred_at, r_name AS secret,
    sha256({' || '.join('(' + _TEXT.format('(' + f + ')') + ')' for f in _AUDIT_FIELDS)}) AS body,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events JOIN region ON r_regionkey = event_id % 5),
chain AS (
  SELECT audit_id, workflow_id, occurred_at, rn, CAST(NULL AS VARCHAR) AS parent_hash,
    sha256(secret || '|' || body || '|-|' || secret) AS self_hash, secret, body FROM entries WHERE rn = 1
  UNION ALL
  SELECT e.audit_id, e.workflow_id, e.occurred_at, e.rn, c.self_hash,
    sha256(e.secret || '|' || e.body || '|' || c.self_hash || '|' || e.secret), e.secret, e.body
  FROM chain c JOIN entries e ON e.workflow_id = c.workflow_id AND e.rn = c.rn + 1)"""


def day_values(spark, sf, value="value"):
    """KPI history: one KPI per event type, one run per day."""
    e = table(spark, sf, "events")
    run = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_at")
    return e.groupBy(F.col("event_type").alias("kpi_id"), run).agg(F.round(F.sum(F.expr(value)), 4).alias("value"))


def day_values_sql(value="value"):
    return f"""(SELECT event_type AS kpi_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS run_at, round(sum({value}), 4) AS value
      FROM events GROUP BY ALL)"""
