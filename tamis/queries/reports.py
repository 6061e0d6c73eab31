"""The flagship workflow, KPIs, charts and samples."""

import copy

from pyspark.sql import functions as F

from tamis.operators import charts, join, kpi, sample
from tamis.plans import workflow
from tamis.plans.simulate import simulate, simulate_series
from tamis.queries.derived import day_values, day_values_sql
from tamis.queries.registry import dealt_anew, query, rounded, table
from tamis.session import materialize

# Net sales per brand and year: which brands lead, and how much is sold at a deep discount.
FLAGSHIP = {
    "apiVersion": "tamis/v1",
    "kind": "AnalyticsWorkflow",
    "metadata": {"name": "brand-years", "subProject": "MERCH", "semver": "2.1.0", "isCritical": False},
    "spec": {
        "source": {"type": "upload", "format": "PARQUET", "objectKey": "lineitem"},
        "pipeline": [
            {"id": "net", "kind": "computed", "alias": "net", "expression": "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))"},
            {"id": "year", "kind": "computed", "alias": "sale_year", "expression": "year(l_shipdate)", "type": "INTEGER"},
            {"id": "deep", "kind": "recode", "field": "l_discount", "alias": "deep", "mapping": {"0.08": 1, "0.09": 1, "0.1": 1}, "default": 0},
            {"id": "brand", "kind": "join", "right": "part", "on": [{"left": "l_partkey", "right": "p_partkey"}], "joinType": "LEFT"},
            {
                "id": "brand_years",
                "kind": "aggregate",
                "groupBy": ["p_brand", "sale_year"],
                "aggregations": [
                    {"alias": "net_sales", "function": "SUM", "field": "net"},
                    {"alias": "sold_lines", "function": "COUNT", "field": "l_linenumber"},
                    {"alias": "deep_lines", "function": "SUM", "field": "deep"},
                    {"alias": "best_line", "function": "MAX", "field": "net"},
                ],
            },
            {"id": "place", "kind": "window", "alias": "place", "function": "RANK", "partitionBy": ["sale_year"], "orderBy": [{"field": "net_sales", "direction": "DESC"}]},
        ],
        "kpis": [
            {
                "id": "kpi_net_per_line",
                "label": "Net sales per line",
                "expression": "CAST(SUM(net_sales) AS DOUBLE) / SUM(sold_lines)",
                "format": {"pattern": "#,##0.00", "unit": "EUR", "decimals": 2},
                "target": {"source": "literal", "value": 30000},
                "thresholds": {"warningPct": 95.0, "criticalPct": 80.0},
            },
            {
                "id": "kpi_deep_share",
                "label": "Lines at a deep discount",
                "expression": "SUM(deep_lines) * 100.0D / SUM(sold_lines)",
                "format": {"pattern": "0.0", "unit": "%", "decimals": 1},
                "polarity": "less_better",
                "target": {"source": "cible_form", "formId": "1"},
                "thresholds": {"warningPct": 105.0, "criticalPct": 300.0},
                "critical": True,
            },
            {"id": "kpi_leaders", "label": "Brands that led a year", "expression": "COUNT(DISTINCT p_brand) WHERE place = 1", "format": {"pattern": "#,##0", "decimals": 0}, "polarity": "neutral"},
            {
                "id": "kpi_best_line",
                "label": "Best line",
                "expression": "CAST(MAX(best_line) AS DOUBLE)",
                "format": {"pattern": "#,##0", "unit": "EUR", "decimals": 0},
                "target": {"source": "computed", "value": "CAST(SUM(net_sales) AS DOUBLE) / SUM(sold_lines) * 4"},
            },
        ],
        "visualizations": [{"id": "viz_years", "type": "LINE_MULTI", "encoding": {"xField": "sale_year", "yField": "net_sales", "series": "p_brand"}}],
        "outputs": [{"kind": "dashboard", "dashboardCode": "brand_years", "refreshSec": 900}],
    },
}

_DEEP = "0.08, 0.09, 0.1"
_YEARS = """SELECT p_brand, CAST(year(l_shipdate) AS INTEGER) AS sale_year, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS net_sales,
    count(l_linenumber) AS sold_lines, CAST(count(*) FILTER (WHERE l_discount IN (0.08, 0.09, 0.1)) AS DOUBLE) AS deep_lines,
    max(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS best_line
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
_PLACED = f"SELECT *, CAST(rank() OVER (PARTITION BY sale_year ORDER BY net_sales DESC) AS INTEGER) AS place FROM ({_YEARS})"


def flagship(spark, sf) -> workflow.Result:
    # targets by form, here taken from the supplier table
    targets = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 3).cast("string").alias("form_id")).agg(
        F.count(F.lit(1)).alias("target_value")
    )
    readers = {"upload": lambda s: table(spark, sf, s["objectKey"])}
    return workflow.run(FLAGSHIP, readers, tables={"part": table(spark, sf, "part")}, targets=targets)


@query(
    f"""SELECT p_brand, sale_year, net_sales::DOUBLE AS net_sales, sold_lines, deep_lines, best_line::DOUBLE AS best_line, place FROM ({_PLACED})"""
)
def q_flagship_output(spark, sf):
    out = flagship(spark, sf).output
    return out.withColumns({c: F.col(c).cast("double") for c in ("net_sales", "best_line")})


@query(
    f"""WITH v AS ({_PLACED}), k AS (
      SELECT 'kpi_net_per_line' AS kpi_id, 'Net sales per line' AS label, sum(net_sales)::DOUBLE / sum(sold_lines) AS value, 'EUR' AS unit, 'more_better' AS polarity,
        false AS critical, 30000.0::DOUBLE AS target, 95.0::DOUBLE AS warning_pct, 80.0::DOUBLE AS critical_pct FROM v
      UNION ALL SELECT 'kpi_deep_share', 'Lines at a deep discount', sum(deep_lines) * 100.0 / sum(sold_lines), '%', 'less_better', true,
        (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1), 105.0, 300.0 FROM v
      UNION ALL SELECT 'kpi_leaders', 'Brands that led a year', count(DISTINCT p_brand) FILTER (WHERE place = 1), NULL, 'neutral', false, NULL, 75.0, 60.0 FROM v
      UNION ALL SELECT 'kpi_best_line', 'Best line', max(best_line)::DOUBLE, 'EUR', 'more_better', false, sum(net_sales)::DOUBLE / sum(sold_lines) * 4, 75.0, 60.0 FROM v)
    SELECT kpi_id, label, CASE kpi_id WHEN 'kpi_net_per_line' THEN format('{{:,.2f}} EUR', value) WHEN 'kpi_deep_share' THEN format('{{:.1f}} %', value)
        WHEN 'kpi_best_line' THEN format('{{:,.0f}} EUR', value) ELSE format('{{:,.0f}}', value) END AS display, round(value, 6) AS value, unit, polarity, critical, round(target, 6) AS target, warning_pct, critical_pct,
      round(value * 100.0 / nullif(target, 0), 4) AS attainment_pct,
      CASE WHEN polarity = 'neutral' THEN 'NEUTRAL'
        WHEN polarity = 'less_better' THEN CASE WHEN value > target * critical_pct / 100 THEN 'CRITICAL' WHEN value > target * warning_pct / 100 THEN 'WARNING' ELSE 'OK' END
        WHEN value < target * critical_pct / 100 THEN 'CRITICAL' WHEN value < target * warning_pct / 100 THEN 'WARNING' ELSE 'OK' END AS status FROM k"""
)
def q_flagship_kpis(spark, sf):
    return rounded(rounded(flagship(spark, sf).kpis, 4, "attainment_pct"), 6, "value", "target")


@query(
    f"""WITH v AS ({_YEARS}) SELECT x, series, coalesce(net_sales, 0)::DOUBLE AS y FROM (SELECT DISTINCT sale_year AS x FROM v) a
    CROSS JOIN (SELECT DISTINCT p_brand AS series FROM v) b LEFT JOIN v ON v.sale_year = x AND v.p_brand IS NOT DISTINCT FROM series"""
)
def q_flagship_chart(spark, sf):
    return flagship(spark, sf).chart("viz_years").withColumn("y", F.col("y").cast("double"))


def _next_version() -> dict:
    """The flagship with a wider notion of a deep discount and one more column."""
    new = copy.deepcopy(FLAGSHIP)
    steps = new["spec"]["pipeline"]
    next(s for s in steps if s["id"] == "deep")["mapping"]["0.07"] = 1
    steps.append({"id": "each", "kind": "computed", "alias": "net_per_line", "expression": "CAST(net_sales AS DOUBLE) / sold_lines", "type": "DOUBLE"})
    return new


_SHARE = f"""(SELECT 'kpi_deep_share' AS kpi_id, count(*) FILTER (WHERE l_discount IN ({_DEEP})) * 100.0::DOUBLE / count(*) AS previous,
  count(*) FILTER (WHERE l_discount IN (0.07, {_DEEP})) * 100.0::DOUBLE / count(*) AS current FROM lineitem)"""


@query(
    f"""WITH s AS (FROM {_SHARE}), groups AS ({_YEARS}),
    moved AS (SELECT count(*) AS n FROM (SELECT p_brand, year(l_shipdate) AS y FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL
      HAVING count(*) FILTER (WHERE l_discount = 0.07) > 0))
    SELECT kpi_id, round(previous, 6) AS previous, round(current, 6) AS current, CASE WHEN current = previous THEN 'OK' ELSE 'BREACH' END AS decision,
      CASE WHEN current = previous THEN 'APPROVED_FOR_DEPLOYMENT' ELSE 'BLOCKED' END AS verdict, (SELECT n FROM moved) AS rows_changed, 'ADDED' AS schema_change FROM s"""
)
def q_simulation_report(spark, sf):
    """The KPI that the new version moves, the verdict, how many output rows change, and the change of the output's columns."""
    targets = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 3).cast("string").alias("form_id")).agg(F.count(F.lit(1)).alias("target_value"))
    report = simulate(
        FLAGSHIP, _next_version(), table(spark, sf, "lineitem"), ["p_brand", "sale_year"], None, tables={"part": table(spark, sf, "part")}, targets=targets
    )
    changed = report.rows.where("change = 'CHANGED'").agg(F.count(F.lit(1)).alias("n")).scalar()
    schema = report.schema.agg(F.array_join(F.sort_array(F.collect_list("change")), ",").alias("c")).scalar()
    moved = report.kpis.where("decision <> 'OK'").select("kpi_id", "previous", "current", "decision")
    return rounded(moved.withColumns({"verdict": report.verdict.select("decision").scalar(), "rows_changed": changed, "schema_change": schema}), 6)


_SEEN = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_shipdate"


@query(
    f"""WITH seen AS (
      SELECT 1 AS step, 'GOLDEN' AS strategy, l_partkey, l_discount, l_shipdate FROM lineitem WHERE l_discount < 0.05
      UNION ALL SELECT 2, 'FIRST_N', l_partkey, l_discount, l_shipdate FROM (FROM lineitem ORDER BY {_SEEN} LIMIT 5000)
      UNION ALL SELECT 3, 'PERIOD', l_partkey, l_discount, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'
      UNION ALL SELECT 4, 'FULL', l_partkey, l_discount, l_shipdate FROM lineitem),
    groups AS (SELECT step, strategy, count(*) AS n, count(*) FILTER (WHERE l_discount = 0.07) AS hits FROM seen LEFT JOIN part ON l_partkey = p_partkey
      GROUP BY step, strategy, p_brand, year(l_shipdate))
    SELECT step, strategy, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE hits > 0) AS changed,
      CASE WHEN sum(hits) > 0 THEN 'BLOCKED' ELSE 'APPROVED_FOR_DEPLOYMENT' END AS decision, step = 1 AS passed FROM groups GROUP BY step, strategy"""
)
def q_simulation_series(spark, sf):
    """The new version on a golden set without the discount that it reads anew, on first rows, on a year and on all rows."""
    lines = table(spark, sf, "lineitem")
    targets = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 3).cast("string").alias("form_id")).agg(F.count(F.lit(1)).alias("target_value"))
    samplings = [
        {"strategy": "GOLDEN", "golden": lines.where("l_discount < 0.05")},
        {"strategy": "FIRST_N", "size": 5000, "order_by": _SEEN.split(", ")},
        {"strategy": "PERIOD", "period": {"field": "l_shipdate", "start": "1995-01-01", "end": "1995-12-31"}},
        {"strategy": "FULL"},
    ]
    series = simulate_series(
        FLAGSHIP, _next_version(), lines, ["p_brand", "sale_year"], samplings, tables={"part": table(spark, sf, "part")}, targets=targets
    )
    return series.select("step", "strategy", "rows", "changed", "decision", "passed")


_ORDER_KPIS = [
    {"id": "kpi_total", "label": "Total", "expression": "SUM(o_totalprice)", "format": {"pattern": "#,##0", "unit": "EUR", "decimals": 0},
     "target": {"source": "literal", "value": 5e9}},
    {"id": "kpi_open_share", "label": "Open share", "expression": "COUNT(*) FILTER (WHERE o_orderstatus = 'O') * 100.0 / COUNT(*)",
     "format": {"pattern": "0.0", "unit": "%", "decimals": 1}, "polarity": "less_better", "target": {"source": "literal", "value": 30},
     "thresholds": {"warningPct": 100, "criticalPct": 150}},
    {"id": "kpi_customers", "label": "Customers", "expression": "COUNT(DISTINCT o_custkey)", "format": {"pattern": "#,##0"}, "polarity": "neutral"},
]


@query(
    """SELECT 'kpi_total' AS kpi_id, 'Total' AS label, round(sum(o_totalprice), 2) AS value, 'EUR' AS unit FROM orders
    UNION ALL SELECT 'kpi_open_share', 'Open share', round(count(*) FILTER (WHERE o_orderstatus = 'O') * 100.0 / count(*), 2), '%' FROM orders
    UNION ALL SELECT 'kpi_customers', 'Customers', count(DISTINCT o_custkey), NULL FROM orders"""
)
def q_kpi_values(spark, sf):
    return rounded(kpi.kpi_values(table(spark, sf, "orders"), _ORDER_KPIS).select("kpi_id", "label", "value", "unit"), 2)


_EXACT = "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE) / count(*)"


@query(
    f"""WITH r AS (SELECT n_name, {_EXACT.format("c_acctbal")} AS value, {_EXACT.format("c_acctbal + c_nationkey * 10")} AS target
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
    SELECT n_name, value, target, round(value * 100.0 / target, 4) AS attainment_pct,
      CASE WHEN value < target * 0.96 THEN 'CRITICAL' WHEN value < target * 0.98 THEN 'WARNING' ELSE 'OK' END AS status FROM r"""
)
def q_kpi_by_region(spark, sf):
    rows = join.enrich(table(spark, sf, "customer"), table(spark, sf, "nation"), [("c_nationkey", "n_nationkey")], ["n_name"])
    out = kpi.grouped_kpi(
        rows, ["n_name"], _EXACT.format("c_acctbal"), _EXACT.format("c_acctbal + c_nationkey * 10"), warning_pct=98, critical_pct=96
    )
    return rounded(out, 4, "attainment_pct")


_STATUS = """CASE WHEN value > 2.0 * goal THEN 'CRITICAL' WHEN value > 1.2 * goal THEN 'WARNING' ELSE 'OK' END"""


def _history(spark, sf):
    rows = day_values(spark, sf)
    goals = rows.groupBy("kpi_id").agg(F.avg("value").alias("target"))
    return rows.join(goals, "kpi_id").withColumns(
        {"polarity": F.lit("less_better"), "warning_pct": F.lit(120.0), "critical_pct": F.lit(200.0)}
    )


@query(
    f"""WITH h AS (SELECT *, avg(value) OVER (PARTITION BY kpi_id) AS goal FROM {day_values_sql()})
    SELECT kpi_id, run_at, value, {_STATUS} AS status, round(value * 100.0 / goal, 4) AS attainment_pct FROM h"""
)
def q_kpi_status(spark, sf):
    rows = kpi.with_status(_history(spark, sf)).select("kpi_id", "run_at", "value", "status", "attainment_pct")
    return rounded(rows, 4, "attainment_pct")


@query(
    f"""WITH h AS (SELECT *, avg(value) OVER (PARTITION BY kpi_id) AS goal FROM {day_values_sql()}),
    s AS (SELECT *, {_STATUS} AS severity, lag(value) OVER (PARTITION BY kpi_id ORDER BY run_at) AS previous FROM h)
    SELECT kpi_id, run_at, previous, value AS current, round((value - previous) / nullif(previous, 0) * 100, 4) AS delta_pct,
      round(goal * CASE severity WHEN 'CRITICAL' THEN 2.0 ELSE 1.2 END, 4) AS threshold, 'less_better' AS polarity, severity
    FROM s WHERE severity <> 'OK'"""
)
def q_kpi_breach(spark, sf):
    return rounded(kpi.breaches(_history(spark, sf)), 4, "delta_pct", "threshold")


@query(
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY kpi_id ORDER BY run_at DESC) AS n FROM {day_values_sql()}),
    t AS (SELECT kpi_id, max(value) FILTER (WHERE n = 1) AS value, max(value) FILTER (WHERE n = 2) AS previous,
      string_agg(CAST(CAST(round(value) AS BIGINT) AS VARCHAR), ',' ORDER BY run_at) AS series FROM h GROUP BY kpi_id)
    SELECT kpi_id, value, previous, series, round((value - previous) / nullif(previous, 0) * 100, 4) AS delta_pct,
      CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS trend FROM t"""
)
def q_kpi_tile(spark, sf):
    tiles = kpi.tiles(day_values(spark, sf), ["kpi_id"], "run_at", "value")
    shown = F.array_join(F.transform("series", lambda v: F.round(v).cast("bigint").cast("string")), ",")
    return rounded(tiles.withColumn("series", shown), 4, "delta_pct")


def _price_months(spark, sf):
    mon = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return table(spark, sf, "orders").withColumn("mon", mon)


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def q_chart_bar(spark, sf):
    return rounded(charts.chart(_price_months(spark, sf), "BAR_VERTICAL", {"xField": "mon", "yField": "o_totalprice"}), 2)


@query("SELECT o_orderpriority AS x, CAST(count(o_orderkey) AS BIGINT) AS y FROM orders GROUP BY 1")
def q_chart_bar_horizontal(spark, sf):
    return charts.chart(
        table(spark, sf, "orders"), "BAR_HORIZONTAL", {"xField": "o_orderkey", "yField": "o_orderpriority"}, "COUNT", order_by="y", descending=True
    )


_GRID = """WITH c AS (SELECT p_brand AS x, p_size AS series, sum(p_partkey) AS v FROM part GROUP BY ALL),
  g AS (SELECT a.x, b.series, coalesce(v, 0) AS y FROM (SELECT DISTINCT x FROM c) a CROSS JOIN (SELECT DISTINCT series FROM c) b
    LEFT JOIN c ON c.x = a.x AND c.series = b.series)"""


@query(f"{_GRID} SELECT x, series, CAST(y AS BIGINT) AS y FROM g")
def q_chart_grouped(spark, sf):
    return charts.chart(table(spark, sf, "part"), "LINE_MULTI", {"xField": "p_brand", "yField": "p_partkey", "series": "p_size"})


@query(
    f"""{_GRID} SELECT x, series, CAST(y AS BIGINT) AS y,
      floor(CAST(y AS DOUBLE) / CASE WHEN sum(y) OVER (PARTITION BY x) = 0 THEN 1 ELSE CAST(sum(y) OVER (PARTITION BY x) AS DOUBLE) END * 1000 + 0.5) / 10 AS pct FROM g"""
)
def q_chart_100pct(spark, sf):
    return charts.chart(table(spark, sf, "part"), "BAR_100PCT", {"xField": "p_brand", "yField": "p_partkey", "series": "p_size"})


@query(
    """SELECT lang AS category, sum(n_chars)::BIGINT AS value, round(sum(n_chars) * 100.0 / (SELECT sum(n_chars) FROM documents), 6) AS pct
    FROM documents GROUP BY lang"""
)
def q_chart_pie(spark, sf):
    return rounded(charts.chart(table(spark, sf, "documents"), "DONUT", {"category": "lang", "value": "n_chars"}))


@query(
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS x, round(sum(o_totalprice), 2) AS left_value,
      round(median(o_totalprice), 4) AS right_value FROM orders GROUP BY 1"""
)
def q_chart_combo(spark, sf):
    out = charts.chart(
        _price_months(spark, sf),
        "COMBO_DUAL_AXIS",
        {
            "xField": "mon",
            "leftAxis": {"field": "o_totalprice", "aggregation": "SUM"},
            "rightAxis": {"field": "o_totalprice", "aggregation": "MEDIAN"},
        },
    )
    return rounded(rounded(out, 2, "left_value"), 4, "right_value")


@query("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def q_chart_scatter(spark, sf):
    return charts.chart(table(spark, sf, "lineitem"), "SCATTER", {"xField": "l_quantity", "yField": "l_extendedprice"})


@query(
    """SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey AS DOUBLE) AS size,
      round(12 + (p_partkey - lo) / nullif(CAST(hi - lo AS DOUBLE), 0) * 48, 6) AS symbol_size
    FROM part, (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part)"""
)
def q_chart_bubble(spark, sf):
    return rounded(charts.chart(table(spark, sf, "part"), "BUBBLE", {"xField": "p_size", "yField": "p_retailprice", "size": "p_partkey"}), 6, "symbol_size")


@query(
    """WITH c AS (SELECT dayofweek(ts) + 1 AS x, hour(ts) AS y, count(event_id) AS value FROM events GROUP BY ALL)
    SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, dense_rank() OVER (ORDER BY x) - 1 AS x_index, dense_rank() OVER (ORDER BY y) - 1 AS y_index,
      value, min(value) OVER () AS min_value, max(value) OVER () AS max_value FROM c"""
)
def q_chart_heatmap(spark, sf):
    rows = table(spark, sf, "events").selectExpr("dayofweek(ts) AS wd", "hour(ts) AS hr", "event_id")
    return charts.chart(rows, "HEATMAP", {"xField": "wd", "yField": "hr", "value": "event_id"}, "COUNT")


@query(
    """WITH v AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1)
    SELECT k AS region, value, 'province' AS level, (SELECT min(value) FROM v) AS min_value, (SELECT max(value) FROM v) AS max_value
    FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 1000 FROM nation) LEFT JOIN v ON k = c_nationkey"""
)
def q_chart_map(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey")
    areas = nation.unionByName(nation.select((F.col("n_nationkey") + 1000).alias("n_nationkey")))  # half of them without data
    out = charts.chart(
        table(spark, sf, "customer"),
        "CHOROPLETH_BF",
        {"regionField": "c_nationkey", "valueField": "c_acctbal", "level": "province"},
        reference=areas,
        code="n_nationkey",
    )
    return rounded(out, 2)


@query(
    """SELECT avg_price AS value, 150000.0::DOUBLE AS target, round(avg_price * 100.0 / 150000, 6) AS attainment_pct,
      CASE WHEN avg_price < 150000 * 0.6 THEN 'CRITICAL' WHEN avg_price < 150000 * 0.75 THEN 'WARNING' ELSE 'OK' END AS status
    FROM (SELECT round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY o_orderpriority)"""
)
def q_chart_gauge(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    rows = rows.withColumn("goal", F.lit(150000.0))
    return rounded(charts.chart(rows, "GAUGE_SEMI", {"value": "v", "target": "goal"}), 6, "attainment_pct")


@query(
    """SELECT l_linestatus, l_linenumber, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') / count(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A,
      sum(l_quantity) FILTER (WHERE l_returnflag = 'N') / count(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N,
      sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / count(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R,
      CAST(grouping(l_linestatus) + grouping(l_linenumber) AS INTEGER) AS level
    FROM lineitem GROUP BY ROLLUP (l_linestatus, l_linenumber)"""
)
def q_chart_pivot(spark, sf):
    return charts.chart(
        table(spark, sf, "lineitem"),
        "PIVOT_TABLE",
        {"rowFields": ["l_linestatus", "l_linenumber"], "columnFields": ["l_returnflag"], "valueField": "l_quantity", "aggregation": "AVG"},
    )


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def q_sample_first_n(spark, sf):
    return sample.sample(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "FIRST_N", 50, order_by=["o_orderdate", "o_orderkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def q_sample_last_n(spark, sf):
    return sample.sample(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "LAST_N", 50, order_by=["o_orderdate", "o_orderkey"])


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'")
def q_sample_period(spark, sf):
    return sample.sample(
        table(spark, sf, "events").select("event_id", "ts"),
        "PERIOD",
        period={"field": "ts", "start": "2024-01-10", "end": "2024-01-12 12:00:00"},
    )


@query(
    """WITH p AS (SELECT p_partkey, nullif(p_size, 50) AS p_size, p_retailprice, p_name FROM part)
    SELECT p_partkey, CASE WHEN p_size = (SELECT min(p_size) FROM p) THEN 'min:p_size,' ELSE '' END
      || CASE WHEN p_size = (SELECT max(p_size) FROM p) THEN 'max:p_size,' ELSE '' END || CASE WHEN p_size IS NULL THEN 'null:p_size,' ELSE '' END
      || CASE WHEN p_retailprice = (SELECT min(p_retailprice) FROM p) THEN 'min:p_retailprice,' ELSE '' END
      || CASE WHEN p_retailprice = (SELECT max(p_retailprice) FROM p) THEN 'max:p_retailprice,' ELSE '' END
      || CASE WHEN count(*) OVER (PARTITION BY p_name, p_size) > 1 THEN 'duplicate,' ELSE '' END AS boundary
    FROM p QUALIFY boundary <> ''"""
)
def q_sample_boundary(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr("nullif(p_size, 50)").alias("p_size"), "p_retailprice", "p_name")
    found = sample.boundary_values(rows, ["p_size", "p_retailprice"], ["p_name", "p_size"])
    return found.select("p_partkey", F.concat(F.array_join("boundary", ","), F.lit(",")).alias("boundary"))


@query("SELECT seed, least(1000, (SELECT count(*) FROM lineitem)) AS rows, least(1000, (SELECT count(*) FROM lineitem)) AS known, true AS repeatable FROM range(42, 46) t(seed)")
def q_sample_random(spark, sf):
    """Per seed: size of the sample, how many of its rows are rows of the table, and whether dealing the table anew gives the same rows."""
    rows = table(spark, sf, "lineitem")
    out = None
    for seed in range(42, 46):
        picked = materialize(sample.sample(rows, "RANDOM", 1000, seed), "picked")
        again = sample.sample(dealt_anew(rows), "RANDOM", 1000, seed)
        # the few rows of the sample go to the table, not the table to them
        met = rows.join(F.broadcast(picked), rows.columns, "left_semi")
        known = picked.join(met, rows.columns, "left_semi").agg(F.count(F.lit(1))).scalar()
        moved = picked.exceptAll(again).agg(F.count(F.lit(1))).scalar()
        one = picked.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(seed).cast("bigint").alias("seed"), "rows", known.alias("known"), (moved == 0).alias("repeatable"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT o_orderpriority, quota AS n FROM (
      SELECT *, base + CASE WHEN rest > 0 AND row_number() OVER (ORDER BY rest DESC, rows DESC, o_orderpriority) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT o_orderpriority, count(*) AS rows, CAST(floor(count(*) * 1000 / (SELECT count(*) FROM orders)) AS BIGINT) AS base,
        (count(*) * 1000) % (SELECT count(*) FROM orders) AS rest FROM orders GROUP BY 1))"""
)
def q_sample_stratified(spark, sf):
    picked = sample.sample(table(spark, sf, "orders"), "STRATIFIED", 1000, 42, ["o_orderkey"], "o_orderpriority")
    return picked.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
