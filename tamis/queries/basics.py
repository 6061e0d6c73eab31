"""Projection, filters, joins and aggregation."""

from pyspark.sql import functions as F

from tamis.functions import scalars
from tamis.operators import aggregate as agg
from tamis.operators import join, project, reshape
from tamis.plans import workflow
from tamis.queries.registry import query, rounded, table


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20 AND NOT (l_discount > 0.05)
      AND l_linestatus LIKE 'F%' AND upper(trim(l_returnflag)) = 'A'"""
)
def q_filter_compound(spark, sf):
    rows = project.filter_rows(
        table(spark, sf, "lineitem"),
        "l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20 AND NOT (l_discount > 0.05) "
        "AND l_linestatus LIKE 'F%' AND upper(trim(l_returnflag)) = 'A'",
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus <> 'F'")
def q_filter_simple(spark, sf):
    rows = project.compare(table(spark, sf, "orders"), "o_totalprice", ">=", "300000")
    return project.compare(rows, "o_orderstatus", "!=", "'F'").select("o_orderkey", "o_totalprice")


@query(
    """SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
      AND o_orderdate <= (SELECT max(o_orderdate) FROM orders)"""
)
def q_filter_last_30d(spark, sf):
    orders = table(spark, sf, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    return project.in_period(orders, "o_orderdate", last="P30D", as_of=newest).select("o_orderkey", "o_orderdate")


@query(
    """SELECT event_id, ts FROM events
    WHERE ts >= date_trunc('week', (SELECT max(ts) FROM events)) AND ts <= (SELECT max(ts) FROM events)"""
)
def q_filter_current_week(spark, sf):
    events = table(spark, sf, "events")
    return project.current_period(events, "ts", "week", events.agg(F.max("ts")).scalar()).select("event_id", "ts")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_quantity / 1000.0 AS tonnes,
      l_extendedprice * (1 - l_discount) AS net,
      CAST(CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'normal' ELSE 'small' END AS VARCHAR) AS size_class,
      CAST(extract(year FROM l_shipdate) AS INTEGER) AS ship_year
    FROM lineitem"""
)
def q_computed_arith(spark, sf):
    df = table(spark, sf, "lineitem")
    df = project.computed(df, "tonnes", "l_quantity / 1000.0D", "DOUBLE")
    df = project.computed(df, "net", "l_extendedprice * (1 - l_discount)", "DOUBLE")
    df = project.computed(
        df, "size_class", "CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'normal' ELSE 'small' END", "STRING"
    )
    df = project.computed(df, "ship_year", "extract(year FROM l_shipdate)", "INTEGER")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tonnes", "net", "size_class", "ship_year")


@query(
    """SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS INTEGER) AS size_read
    FROM part"""
)
def q_try_cast(spark, sf):
    raw = project.computed(
        table(spark, sf, "part"), "size_read", "CASE WHEN p_size % 5 = 0 THEN p_name ELSE cast(p_size AS string) END"
    )
    return scalars.try_cast(raw, "size_read", "INTEGER").select("p_partkey", "size_read")


@query(
    """SELECT 'raw' AS field, 'INTEGER' AS to_type, count(*) FILTER (WHERE p_size % 5 = 0) AS lost FROM part
    UNION ALL SELECT 'p_brand', 'DOUBLE', count(*) FROM part"""
)
def q_cast_losses(spark, sf):
    raw = project.computed(table(spark, sf, "part"), "raw", "CASE WHEN p_size % 5 = 0 THEN p_name ELSE cast(p_size AS string) END")
    return scalars.cast_losses(raw, {"raw": "INTEGER", "p_brand": "DOUBLE"})


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status_label FROM orders"""
)
def q_recode_status(spark, sf):
    out = project.recode(table(spark, sf, "orders"), "o_orderstatus", "status_label", {"F": "finished", "O": "open"})
    return out.select("o_orderkey", "status_label")


@query(
    """SELECT p_partkey, CAST(CASE p_size WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN NULL ELSE -1 END AS DOUBLE) AS weight
    FROM part"""
)
def q_recode_default(spark, sf):
    out = project.recode(table(spark, sf, "part"), "p_size", "weight", {"1": 0.5, "2": 1.5, "3": None}, -1)
    return out.select("p_partkey", "weight")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_name, 'unknown') AS part_label
    FROM lineitem LEFT JOIN part ON l_partkey = CASE WHEN p_size > 10 THEN p_partkey ELSE -p_partkey - 1 END"""
)
def q_recode_table(spark, sf):
    # all codes stay in the table; some are shifted out of reach, so that unknown codes occur
    codes = table(spark, sf, "part").withColumn("p_partkey", F.expr("CASE WHEN p_size > 10 THEN p_partkey ELSE -p_partkey - 1 END"))
    out = project.recode_by_table(table(spark, sf, "lineitem"), "l_partkey", "part_label", codes, "p_partkey", "p_name", "unknown")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "part_label")


def _labels(spark, sf):
    return table(spark, sf, "labels").withColumn("doc_id", F.expr("CASE WHEN quality = 1 THEN doc_id ELSE doc_id + 1000000000 END"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.expr("CASE WHEN n_chars % 7 > 0 THEN doc_id END").alias("doc_id"), "lang", "n_chars")


# whole tables; some keys are NULL or shifted, so that every join type has rows without a match
_DOCS = "(SELECT CASE WHEN n_chars % 7 > 0 THEN doc_id END AS doc_id, lang, n_chars FROM documents)"
_LABELS = "(SELECT CASE WHEN quality = 1 THEN doc_id ELSE doc_id + 1000000000 END AS doc_id, quality, toxic FROM labels)"


@query(f"SELECT d.doc_id, lang, n_chars, quality, toxic FROM {_DOCS} d JOIN {_LABELS} l ON d.doc_id = l.doc_id")
def q_join_inner(spark, sf):
    return join.join(_docs(spark, sf), _labels(spark, sf), ["doc_id"], "INNER")


@query(f"SELECT d.doc_id, lang, n_chars, quality, toxic FROM {_DOCS} d LEFT JOIN {_LABELS} l ON d.doc_id = l.doc_id")
def q_join_left(spark, sf):
    return join.join(_docs(spark, sf), _labels(spark, sf), ["doc_id"], "LEFT")


@query(f"SELECT l.doc_id, lang, n_chars, quality, toxic FROM {_DOCS} d RIGHT JOIN {_LABELS} l ON d.doc_id = l.doc_id")
def q_join_right(spark, sf):
    return join.join(_docs(spark, sf), _labels(spark, sf), ["doc_id"], "RIGHT")


@query(
    f"""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, n_chars, quality, toxic
    FROM {_DOCS} d FULL JOIN {_LABELS} l ON d.doc_id = l.doc_id"""
)
def q_join_full(spark, sf):
    return join.join(_docs(spark, sf), _labels(spark, sf), ["doc_id"], "FULL_OUTER")


@query(f"SELECT * FROM {_DOCS} d WHERE EXISTS (SELECT 1 FROM {_LABELS} l WHERE d.doc_id = l.doc_id)")
def q_join_semi(spark, sf):
    return join.join(_docs(spark, sf), _labels(spark, sf), ["doc_id"], "SEMI")


@query(f"SELECT * FROM {_DOCS} d WHERE NOT EXISTS (SELECT 1 FROM {_LABELS} l WHERE d.doc_id = l.doc_id)")
def q_join_anti(spark, sf):
    return join.join(_docs(spark, sf), _labels(spark, sf), ["doc_id"], "ANTI")


@query(
    """WITH busy AS (SELECT o_custkey, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey),
    top AS (SELECT * FROM busy WHERE orders >= 12)
    SELECT t.o_custkey, t.orders, t.total, b.orders AS orders_right, b.total AS total_right
    FROM top t JOIN busy b ON t.o_custkey = b.o_custkey"""
)
def q_join_step_ref(spark, sf):
    steps = workflow.run_steps(
        table(spark, sf, "orders"),
        [
            {
                "id": "busy",
                "kind": "aggregate",
                "groupBy": ["o_custkey"],
                "aggregations": [
                    {"alias": "orders", "function": "COUNT", "field": "o_orderkey"},
                    {"alias": "total", "function": "SUM", "field": "o_totalprice"},
                ],
            },
            {"id": "top", "kind": "filter", "expression": "orders >= 12"},
            {
                "id": "again",
                "kind": "join",
                "right": "busy",
                "on": [{"left": "o_custkey", "right": "o_custkey"}],
                "joinType": "INNER",
            },
        ],
    )
    return rounded(steps["again"], 2)


@query(
    """SELECT n_name, n_regionkey, count(DISTINCT c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey"""
)
def q_join_enrich(spark, sf):
    rows = join.enrich(
        table(spark, sf, "customer"), table(spark, sf, "nation"), [("c_nationkey", "n_nationkey")], ["n_name", "n_regionkey"]
    )
    out = agg.aggregate(
        rows,
        [
            {"alias": "customers", "function": "COUNT_DISTINCT", "field": "c_custkey"},
            {"alias": "balance", "function": "SUM", "field": "c_acctbal"},
        ],
        ["n_name", "n_regionkey"],
    )
    return rounded(out, 2)


@query(
    """SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean_qty, count(l_orderkey) AS n,
      min(l_shipdate) AS first_ship, max(l_discount) AS top_discount FROM lineitem"""
)
def q_agg_global(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "lineitem"),
        [
            {"alias": "total", "function": "SUM", "field": "l_extendedprice"},
            {"alias": "mean_qty", "function": "AVG", "field": "l_quantity"},
            {"alias": "n", "function": "COUNT", "field": "l_orderkey"},
            {"alias": "first_ship", "function": "MIN", "field": "l_shipdate"},
            {"alias": "top_discount", "function": "MAX", "field": "l_discount"},
        ],
    )
    return rounded(rounded(out, 2, "total"), 6, "mean_qty")


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price,
      round(avg(l_discount), 6) AS disc, count(l_orderkey) AS n, min(l_tax) AS lo, max(l_tax) AS hi
    FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def q_agg_group(spark, sf):
    wanted = [("qty", "SUM", "l_quantity"), ("price", "SUM", "l_extendedprice"), ("disc", "AVG", "l_discount")]
    wanted += [("n", "COUNT", "l_orderkey"), ("lo", "MIN", "l_tax"), ("hi", "MAX", "l_tax")]
    out = agg.aggregate(
        table(spark, sf, "lineitem"),
        [{"alias": a, "function": f, "field": c} for a, f, c in wanted],
        ["l_returnflag", "l_linestatus"],
    )
    return rounded(rounded(out, 2, "price"), 6, "disc")


@query(
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(l_orderkey) AS n
    FROM lineitem GROUP BY l_returnflag"""
)
def q_agg_count_distinct(spark, sf):
    return agg.aggregate(
        table(spark, sf, "lineitem"),
        [
            {"alias": "parts", "function": "COUNT_DISTINCT", "field": "l_partkey"},
            {"alias": "suppliers", "function": "COUNT_DISTINCT", "field": "l_suppkey"},
            {"alias": "n", "function": "COUNT", "field": "l_orderkey"},
        ],
        ["l_returnflag"],
    )


@query(
    """SELECT l_returnflag, round(median(l_extendedprice), 4) AS mid_price, round(median(l_quantity), 4) AS mid_qty,
      count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag"""
)
def q_agg_median(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "lineitem"),
        [
            {"alias": "mid_price", "function": "MEDIAN", "field": "l_extendedprice"},
            {"alias": "mid_qty", "function": "MEDIAN", "field": "l_quantity"},
            {"alias": "n", "function": "COUNT", "field": "l_orderkey"},
        ],
        ["l_returnflag"],
    )
    return rounded(out, 4)


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS dev FROM customer GROUP BY c_mktsegment")
def q_agg_stddev(spark, sf):
    return rounded(
        agg.aggregate(table(spark, sf, "customer"), [{"alias": "dev", "function": "STDDEV", "field": "c_acctbal"}], ["c_mktsegment"])
    )


@query(
    """SELECT event_type, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.75), 5) AS p75,
      round(quantile_cont(value, 0.9), 5) AS p90, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99
    FROM events GROUP BY event_type"""
)
def q_agg_percentiles(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "events"),
        [{"alias": f"p{p}", "function": f"PERCENTILE_{p}", "field": "value"} for p in (50, 75, 90, 95, 99)],
        ["event_type"],
    )
    return rounded(out, 5)


@query(
    """SELECT round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, count(o_orderkey) AS n
    FROM orders"""
)
def q_agg_median_global(spark, sf):
    out = agg.aggregate(
        table(spark, sf, "orders"),
        [
            {"alias": "mid", "function": "MEDIAN", "field": "o_totalprice"},
            {"alias": "p99", "function": "PERCENTILE_99", "field": "o_totalprice"},
            {"alias": "n", "function": "COUNT", "field": "o_orderkey"},
        ],
    )
    return rounded(out, 4)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def q_group_by_distinct(spark, sf):
    return agg.distinct_fields(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@query(
    """SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS top_finished,
      count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY o_orderpriority"""
)
def q_agg_filtered(spark, sf):
    return agg.aggregate_expressions(
        table(spark, sf, "orders"),
        {
            "top_finished": "max(o_totalprice) FILTER (WHERE o_orderstatus = 'F')",
            "large": "count(*) FILTER (WHERE o_totalprice > 200000)",
        },
        ["o_orderpriority"],
    )


@query(
    """SELECT l_suppkey, round(sum(l_quantity * l_discount) * 100.0 / nullif(sum(l_quantity), 0), 6) AS disc_pct
    FROM lineitem GROUP BY l_suppkey"""
)
def q_agg_ratio(spark, sf):
    out = agg.aggregate_expressions(
        table(spark, sf, "lineitem"),
        {"disc_pct": "sum(l_quantity * l_discount) * 100.0 / nullif(sum(l_quantity), 0)"},
        ["l_suppkey"],
    )
    return rounded(out)


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS value,
      CAST(GROUPING(l_returnflag) + GROUPING(l_linestatus) AS INTEGER) AS level
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def q_rollup_subtotals(spark, sf):
    return agg.subtotals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "SUM")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0 AS delay_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def q_delay_hours(spark, sf):
    rows = join.join(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")], "INNER")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        scalars.hours_between(F.col("l_shipdate"), F.col("o_orderdate")).cast("double").alias("delay_hours"),
    )


@query(
    """SELECT a.p_name AS a, b.p_name AS b, CASE WHEN a.p_name = b.p_name THEN 1.0
      ELSE 1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END AS score
    FROM (SELECT DISTINCT p_partkey, p_name FROM part) a JOIN part b ON b.p_partkey = a.p_partkey + 1"""
)
def q_similarity(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    both = part.join(nxt, "p_partkey")
    return both.select(F.col("p_name").alias("a"), "b", scalars.similarity(F.col("p_name"), F.col("b")).alias("score"))


@query("SELECT c_custkey, format('{:,.1f} t', c_acctbal * 10) AS shown FROM customer")
def q_number_label(spark, sf):
    c = table(spark, sf, "customer")
    # the label alone rounds, half to even: rounding before it would take the sign of a negative zero
    return c.select("c_custkey", scalars.number_label(F.col("c_acctbal") * 10, 1, "t", "#,##0.0").alias("shown"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def q_preview(spark, sf):
    return reshape.preview(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, [("o_totalprice", "DESC"), "o_orderkey"]
    )


