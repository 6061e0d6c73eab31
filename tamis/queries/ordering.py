"""Window functions, outliers, normalization, reshaping and sorting."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators import quality, reshape, window
from tamis.operators.aggregate import quantiles
from tamis.queries.registry import query, rounded, table


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


_BY = [("o_orderdate", "DESC"), "o_orderkey"]
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST)"


@query(f"SELECT o_orderkey, CAST(row_number() {_OVER} AS INTEGER) AS v FROM orders")
def q_row_number(spark, sf):
    return window.window(_orders(spark, sf), "v", "ROW_NUMBER", ["o_custkey"], _BY).select("o_orderkey", "v")


@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS LAST) AS INTEGER) AS v FROM orders")
def q_rank(spark, sf):
    return window.window(_orders(spark, sf), "v", "RANK", ["o_orderpriority"], ["o_orderdate"]).select("o_orderkey", "v")


@query(
    """SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS LAST) AS INTEGER) AS v
    FROM orders"""
)
def q_dense_rank(spark, sf):
    return window.window(_orders(spark, sf), "v", "DENSE_RANK", ["o_orderpriority"], ["o_orderdate"]).select("o_orderkey", "v")


@query("SELECT o_orderkey, cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS LAST) AS v FROM orders")
def q_cume_dist(spark, sf):
    return window.window(_orders(spark, sf), "v", "CUME_DIST", ["o_orderpriority"], ["o_orderdate"]).select("o_orderkey", "v")


@query(
    """SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice NULLS LAST, o_orderkey) AS INTEGER) AS v
    FROM orders"""
)
def q_ntile(spark, sf):
    return window.window(_orders(spark, sf), "v", "NTILE", ["o_orderpriority"], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "v")


@query(f"SELECT o_orderkey, lag(o_totalprice, 1) {_OVER} AS v FROM orders")
def q_lag(spark, sf):
    return window.window(_orders(spark, sf), "v", "LAG", ["o_custkey"], _BY, "o_totalprice").select("o_orderkey", "v")


@query(f"SELECT o_orderkey, lead(o_totalprice, 2, 0) {_OVER} AS v FROM orders")
def q_lead(spark, sf):
    return window.window(_orders(spark, sf), "v", "LEAD", ["o_custkey"], _BY, "o_totalprice", offset=2, default=0.0).select("o_orderkey", "v")


@query(f"SELECT o_orderkey, first_value(o_totalprice) {_OVER} AS v FROM orders")
def q_first_value(spark, sf):
    return window.window(_orders(spark, sf), "v", "FIRST_VALUE", ["o_custkey"], _BY, "o_totalprice").select("o_orderkey", "v")


@query(f"SELECT o_orderkey, last_value(o_totalprice) {_OVER} AS v FROM orders")
def q_last_value(spark, sf):
    return window.window(_orders(spark, sf), "v", "LAST_VALUE", ["o_custkey"], _BY, "o_totalprice").select("o_orderkey", "v")


@query(
    """SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
      ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM orders"""
)
def q_frame_rows(spark, sf):
    frame = {"kind": "ROWS", "start": "2 PRECEDING", "end": "1 FOLLOWING"}
    return window.window(
        _orders(spark, sf), "v", "MAX", ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", frame=frame
    ).select("o_orderkey", "v")


@query(
    """SELECT p_partkey, count(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size
      RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM part"""
)
def q_frame_range(spark, sf):
    frame = {"kind": "RANGE", "start": "3 PRECEDING", "end": "CURRENT ROW"}
    return window.window(table(spark, sf, "part"), "v", "COUNT", ["p_brand"], ["p_size"], "p_retailprice", frame=frame).select(
        "p_partkey", "v"
    )


_WEEK = """SELECT o_orderkey, count(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate
  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS v FROM orders"""


def _week(spark, sf, sliced):
    frame = {"kind": "RANGE", "start": "7 DAYS PRECEDING", "end": "CURRENT ROW"}
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return window.window(orders, "v", "COUNT", ["o_orderpriority"], ["o_orderdate"], "o_totalprice", frame=frame, sliced=sliced).select("o_orderkey", "v")


@query(_WEEK)
def q_frame_range_time(spark, sf):
    return _week(spark, sf, False)


@query(_WEEK)
def q_frame_range_time_spread(spark, sf):
    return _week(spark, sf, True)


_MONTHS = """(SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS mon, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY ALL)"""


def _months(spark, sf):
    mon = F.date_trunc("month", "o_orderdate").alias("mon")
    out = table(spark, sf, "orders").groupBy("o_orderpriority", mon).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.withColumn("mon", F.col("mon").cast("timestamp_ntz"))


@query(
    f"""SELECT o_orderpriority, mon, total, round((total - lag(total) OVER w) / nullif(lag(total) OVER w, 0) * 100, 6) AS variation_pct
    FROM {_MONTHS} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY mon)"""
)
def q_variation_pct(spark, sf):
    return rounded(window.variation_pct(_months(spark, sf), "total", ["o_orderpriority"], ["mon"]))


@query(
    f"""SELECT o_orderpriority, mon, total, round(avg(total) OVER (PARTITION BY o_orderpriority ORDER BY mon
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM {_MONTHS}"""
)
def q_moving_avg(spark, sf):
    return rounded(window.moving_average(_months(spark, sf), "total", ["o_orderpriority"], ["mon"], 3), 4)


@query(
    f"""SELECT o_orderpriority, mon, total, round(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY mon
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_sum FROM {_MONTHS}"""
)
def q_running_sum(spark, sf):
    return rounded(window.running_sum(_months(spark, sf), "total", ["o_orderpriority"], ["mon"]), 2)


@query(
    """SELECT * FROM (SELECT l_suppkey, total, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank FROM
      (SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_suppkey)) WHERE rank <= 10"""
)
def q_top10_rank(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"))
    return window.top_by_rank(totals, [("total", "DESC")], 10)


@query(
    """SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice,
      CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS INTEGER) AS rank FROM orders) WHERE rank <= 3"""
)
def q_top3_by_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return window.top_by_rank(rows, [("o_totalprice", "DESC")], 3, ["o_orderpriority"])


@query(
    """SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role,
      lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations"""
)
def q_lag_lead_turns(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    rows = window.window(rows, "before_role", "LAG", ["conv_id"], ["turn"], "role")
    return window.window(rows, "next_turn", "LEAD", ["conv_id"], ["turn"], "turn")


@query(
    """SELECT c_custkey, abs(c_acctbal - m) > 3 * s AS c_acctbal_is_outlier
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 50 ELSE c_acctbal END AS c_acctbal FROM customer) x,
      (SELECT avg(v) AS m, stddev_samp(v) AS s FROM (SELECT CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 50 ELSE c_acctbal END AS v FROM customer)) st"""
)
def q_outlier_3sigma_flag(spark, sf):
    spiked = table(spark, sf, "customer").withColumn(
        "c_acctbal", F.expr("CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 50 ELSE c_acctbal END")
    )
    return quality.outlier(spiked, "c_acctbal", "THREE_SIGMA").select("c_custkey", "c_acctbal_is_outlier")


@query(
    """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)"""
)
def q_outlier_iqr_drop(spark, sf):
    return quality.outlier(table(spark, sf, "events"), "value", "IQR", action="DROP").select("event_id", "value")


@query(
    """SELECT event_id, event_type, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM
      (SELECT event_id, event_type, value FROM events) JOIN (SELECT event_type AS et, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
      (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)) ON event_type = et"""
)
def q_outlier_iqr_clamp_group(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(quality.outlier(rows, "value", "IQR", action="CLAMP", partition_by=["event_type"]))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END AS c_acctbal FROM customer")
def q_outlier_bounds_clamp(spark, sf):
    return quality.outlier(table(spark, sf, "customer"), "c_acctbal", "HARD_BOUNDS", 0, 5000, "CLAMP").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal < 100 OR c_acctbal > 'infinity'::DOUBLE AS c_acctbal_is_outlier FROM customer")
def q_outlier_constraint_flag(spark, sf):
    return quality.outlier(table(spark, sf, "customer"), "c_acctbal", "XLSFORM_CONSTRAINT", lower=100).select(
        "c_custkey", "c_acctbal_is_outlier"
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - m) / s, 6) + 0.0 AS l_extendedprice_norm FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)")
def q_norm_zscore(spark, sf):
    out = quality.normalize(table(spark, sf, "lineitem"), "l_extendedprice", "ZSCORE")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice_norm"))


@query(
    """SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 6) AS c_acctbal_norm
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment)"""
)
def q_norm_minmax(spark, sf):
    out = quality.normalize(table(spark, sf, "customer"), "c_acctbal", "MIN_MAX", ["c_mktsegment"])
    return rounded(out.select("c_custkey", "c_acctbal_norm"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (ORDER BY nullif(l_quantity, 7) ASC NULLS LAST) AS l_quantity_norm
    FROM lineitem"""
)
def q_norm_rank(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_quantity", F.expr("nullif(l_quantity, 7)"))
    out = quality.normalize(rows, "l_quantity", "RANK")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity_norm")


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS c_acctbal_norm FROM customer")
def q_norm_log(spark, sf):
    return rounded(quality.normalize(table(spark, sf, "customer"), "c_acctbal", "LOG").select("c_custkey", "c_acctbal_norm"))


@query(
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F,
      round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P
    FROM orders GROUP BY o_orderpriority"""
)
def q_pivot_sum(spark, sf):
    return rounded(reshape.pivot(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "SUM"), 2)


@query(
    "SELECT p_type, "
    + ", ".join(f'count(p_partkey) FILTER (WHERE p_size = {n}) AS "{n}"' for n in range(1, 52))
    + " FROM part GROUP BY p_type"
)
def q_pivot_count(spark, sf):
    return reshape.pivot(table(spark, sf, "part"), ["p_type"], "p_size", "p_partkey", "COUNT", list(range(1, 52)))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, amount FROM
      (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem)
      UNPIVOT INCLUDE NULLS (amount FOR measure IN (l_quantity, l_discount, l_tax))"""
)
def q_unpivot(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))
    return reshape.unpivot(
        rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount"
    )


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, o_totalprice FROM orders ORDER BY s DESC NULLS LAST, o_totalprice NULLS LAST")
def q_sort_nulls_last(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("s"), "o_totalprice")
    return reshape.sort(rows, [("s", "DESC"), "o_totalprice"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def q_page(spark, sf):
    return reshape.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", "DESC"), "o_orderkey"], 3, 20)


@query(
    """WITH listed AS (SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) - 1 AS nth,
      count(*) OVER () AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_shipdate, nth // 20 + 1 AS page FROM listed WHERE nth // 20 + 1 IN (1, (n + 19) // 20 // 2, (n + 19) // 20)"""
)
def q_page_index(spark, sf):
    """The first, the middle and the last page of all line items, from one index."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    index = reshape.PageIndex(rows, [("l_shipdate", "DESC"), "l_orderkey", "l_linenumber"])
    last = (index.count() + 19) // 20
    pages = [index.page(n, 20).withColumn("page", F.lit(n).cast("bigint")) for n in sorted({1, max(1, last // 2), max(1, last)})]
    return reduce(DataFrame.unionByName, pages)


@query(
    """SELECT l_suppkey, sum(l_quantity) AS value FROM lineitem GROUP BY l_suppkey ORDER BY value DESC, l_suppkey LIMIT 10"""
)
def q_topk(spark, sf):
    return reshape.top_groups(table(spark, sf, "lineitem"), ["l_suppkey"], "SUM", "l_quantity", 10)


# The forms that spread a group over tasks, forced here whatever the group sizes.
_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS v
    FROM lineitem"""
)
def q_row_number_global(spark, sf):
    rows = table(spark, sf, "lineitem").select(*_ITEM, "l_extendedprice")
    return window.window(rows, "v", "ROW_NUMBER", [], [("l_extendedprice", "DESC"), *_ITEM], sliced=True).drop("l_extendedprice")


@query("SELECT event_id, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS v FROM events")
def q_lag_spread(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return window.window(rows, "v", "LAG", ["event_type"], ["ts", "event_id"], "value", sliced=True).select("event_id", "v")


@query("SELECT event_id, CAST(ntile(7) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS v FROM events")
def q_ntile_spread(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return window.window(rows, "v", "NTILE", ["event_type"], [("value", "DESC"), "event_id"], buckets=7, sliced=True).select("event_id", "v")


@query(
    """SELECT p_partkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d FROM part
    WINDOW w AS (PARTITION BY p_type ORDER BY p_size DESC)"""
)
def q_ranks_spread(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    rows = window.window(rows, "r", "RANK", ["p_type"], [("p_size", "DESC")], sliced=True)
    return window.window(rows, "d", "DENSE_RANK", ["p_type"], [("p_size", "DESC")], sliced=True).select("p_partkey", "r", "d")


@query(
    """SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS v FROM part"""
)
def q_frame_range_spread(spark, sf):
    frame = {"kind": "RANGE", "start": "2 PRECEDING", "end": "3 FOLLOWING"}
    return window.window(table(spark, sf, "part"), "v", "MAX", ["p_type"], ["p_size"], "p_retailprice", frame=frame, sliced=True).select("p_partkey", "v")


@query(
    """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS near, count(*) OVER w AS n, round(sum(o_totalprice) OVER
      (PARTITION BY o_orderpriority ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND 1000 PRECEDING), 2) AS below FROM orders
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING)"""
)
def q_frame_range_dense(spark, sf):
    """Frames that hold a large part of a dense field."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    wide = {"kind": "RANGE", "start": "50000 PRECEDING", "end": "50000 FOLLOWING"}
    below = {"kind": "RANGE", "start": "UNBOUNDED PRECEDING", "end": "1000 PRECEDING"}
    frames = {alias: (function, "o_totalprice", frame) for alias, function, frame in (("near", "SUM", wide), ("n", "COUNT", wide), ("below", "SUM", below))}
    rows = window.range_frames(rows, ["o_orderpriority"], "o_totalprice", frames)
    return rows.select("o_orderkey", F.round("near", 2).alias("near"), "n", F.round("below", 2).alias("below"))


@query(
    """SELECT event_id, first_value(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND UNBOUNDED FOLLOWING) AS a,
      last_value(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 4 FOLLOWING) AS b,
      last_value(user_id) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 9 PRECEDING AND 2 FOLLOWING) AS c FROM events"""
)
def q_edges_spread(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts", "value", "user_id")
    order = ["ts", "event_id"]
    rows = window.window(rows, "a", "FIRST_VALUE", ["event_type"], order, "value", frame={"start": "3 PRECEDING", "end": "UNBOUNDED FOLLOWING"}, sliced=True)
    rows = window.window(rows, "b", "LAST_VALUE", ["event_type"], order, "value", frame={"start": "UNBOUNDED PRECEDING", "end": "4 FOLLOWING"}, sliced=True)
    near = {"kind": "RANGE", "start": "9 PRECEDING", "end": "2 FOLLOWING"}
    return window.window(rows, "c", "LAST_VALUE", ["event_type"], ["event_id"], "user_id", frame=near, sliced=True).select("event_id", "a", "b", "c")


@query(
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2
    FROM lineitem GROUP BY l_returnflag"""
)
def q_quantiles_spread(spark, sf):
    out = quantiles(table(spark, sf, "lineitem"), "l_extendedprice", {"q1": 0.25, "q2": 0.5}, ["l_returnflag"], sliced=True)
    return rounded(out, 4)
