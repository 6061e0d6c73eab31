"""The forms that spread a hot group over tasks equal the plain ones."""

import math
import random

import numpy as np
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamis.operators import aggregate, ordered, quality, window
from tamis.operators.ordered import number_rows, prefix_sum, top_per_group
from tamis.session import GROUP_ROWS_CONF


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """A key with over a third of the rows, ties, NULLs in key, order and value, and exact copies."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        order = rng.choice([None, *range(40)])
        rows.append((i, key, order, None if rng.random() < 0.1 else float(rng.randrange(1000))))
    return spark.createDataFrame(rows, "id int, k string, o int, v double").repartition(5).cache()


TOTAL = ["o", "id"]


@pytest.mark.parametrize("function", ["ROW_NUMBER", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "SUM", "COUNT", "MIN", "MAX"])
@pytest.mark.parametrize("keys", [["k"], []])
def test_spread_equals_plain_on_total_order(hot, function, keys):
    frame = {"kind": "ROWS", "start": "UNBOUNDED PRECEDING", "end": "CURRENT ROW"} if function in ("SUM", "COUNT", "MIN", "MAX") else None
    args = dict(alias="w", function=function, partition_by=keys, order_by=TOTAL, field="v", offset=3, default=-1.0, buckets=7, frame=frame)
    if function in ("ROW_NUMBER", "NTILE"):
        args["field"] = None
    assert rows_of(window.window(hot, sliced=True, **args)) == rows_of(window.window(hot, sliced=False, **args))


@pytest.mark.parametrize("function", ["RANK", "DENSE_RANK", "CUME_DIST"])
@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["o"], [("o", "DESC")]])
def test_spread_ranks_keep_ties(hot, function, keys, order):
    plain = window.window(hot, "w", function, keys, order, sliced=False)
    spread = window.window(hot, "w", function, keys, order, sliced=True)
    assert rows_of(spread) == rows_of(plain)
    assert spread.dtypes == plain.dtypes


@pytest.mark.parametrize("start,end", [("2 PRECEDING", "CURRENT ROW"), ("5 PRECEDING", "3 FOLLOWING"), ("1 FOLLOWING", "4 FOLLOWING"), ("6 PRECEDING", "2 PRECEDING")])
def test_spread_frames(spark, hot, start, end):
    frame = {"kind": "ROWS", "start": start, "end": end}
    spark.conf.set(GROUP_ROWS_CONF, "50")
    try:
        args = dict(alias="w", function="MAX", partition_by=["k"], order_by=TOTAL, field="v", frame=frame)
        assert rows_of(window.window(hot, **args)) == rows_of(window.window(hot, sliced=False, **args))
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)


def test_spread_whole_frame_and_average(hot):
    whole = {"kind": "ROWS", "start": "UNBOUNDED PRECEDING", "end": "UNBOUNDED FOLLOWING"}
    for function in ("SUM", "FIRST_VALUE", "LAST_VALUE"):
        args = dict(alias="w", function=function, partition_by=["k"], order_by=TOTAL, field="v", frame=whole)
        assert rows_of(window.window(hot, sliced=True, **args)) == rows_of(window.window(hot, sliced=False, **args))
    run = {"kind": "ROWS", "start": "UNBOUNDED PRECEDING", "end": "CURRENT ROW"}
    args = dict(alias="w", function="AVG", partition_by=["k"], order_by=TOTAL, field="v", frame=run)
    close = lambda df: [(r.id, None if r.w is None else round(r.w, 6)) for r in df.orderBy("id").collect()]
    assert close(window.window(hot, sliced=True, **args)) == close(window.window(hot, sliced=False, **args))


def test_last_value_covers_peers(hot):
    args = dict(alias="w", function="LAST_VALUE", partition_by=["k"], order_by=["o"], field="o")
    assert rows_of(window.window(hot, sliced=True, **args)) == rows_of(window.window(hot, sliced=False, **args))


def test_group_size_decides(spark, hot):
    spark.conf.set(GROUP_ROWS_CONF, "100")
    try:
        plan = window.window(hot, "w", "ROW_NUMBER", ["k"], TOTAL)
        assert "slices" in plan._jdf.queryExecution().optimizedPlan().toString() or "__slice" in plan._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)


def test_copies_of_one_row_are_numbered(spark):
    same = spark.range(500).select(F.lit("k").alias("k"), F.lit(1).alias("o"))
    numbers = [r.rn for r in number_rows(same, ["k"], ["o"], sliced=True).collect()]
    assert sorted(numbers) == list(range(1, 501))


def test_copies_of_one_row_spread_over_slices(spark):
    from tamis.operators.ordered import SLICE, _slices

    same = spark.range(4000).select(F.lit("k").alias("k"), F.lit(1).alias("o"))
    stored, _ = _slices(same, ["k"], ["o"], {"n": F.count(F.lit(1))})
    assert stored.select(SLICE).distinct().count() > 1


def test_prefix_sum_weights(hot):
    summed = lambda s: prefix_sum(hot, ["k"], TOTAL, F.col("id").cast("bigint"), "p", s)
    assert rows_of(summed(True)) == rows_of(summed(False))


def test_top_per_group(hot):
    best = top_per_group(hot, ["k"], [("o", "DESC"), "id"], 4)
    found = {}
    for r in best.collect():
        found.setdefault(r.k, []).append((r.rn, r.id))
    expected = {}
    for r in sorted(hot.collect(), key=lambda r: (r.o is None, -(r.o or 0), r.id)):
        group = expected.setdefault(r.k, [])
        if len(group) < 4:
            group.append((len(group) + 1, r.id))
    assert {k: sorted(v) for k, v in found.items()} == expected


@pytest.mark.parametrize("sliced", [True, False])
def test_quantiles_match_numpy(hot, sliced):
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = {r.k: r for r in aggregate.quantiles(hot, "v", wanted, ["k"], sliced).collect()}
    values = {}
    for r in hot.collect():
        if r.v is not None:
            values.setdefault(r.k, []).append(r.v)
    for k, v in values.items():
        for alias, p in wanted.items():
            assert got[k][alias] == pytest.approx(np.quantile(v, p), abs=1e-9)
    whole = aggregate.quantiles(hot, "v", wanted, (), sliced).first()
    every = [x for v in values.values() for x in v]
    assert whole.p90 == pytest.approx(np.quantile(every, 0.9), abs=1e-9)


def test_quantile_of_only_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert {r.k: r.m for r in aggregate.quantiles(df, "v", {"m": 0.5}, ["k"]).collect()} == {"a": None, "b": 2.0}


def test_median_in_global_aggregate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "v double")
    wanted = [{"alias": "m", "function": "MEDIAN", "field": "v"}, {"alias": "n", "function": "COUNT", "field": "v"}]
    assert tuple(aggregate.aggregate(df, wanted).first()) == (2.0, 3)


def test_approximate_quantile(hot):
    wanted = [{"alias": "m", "function": "MEDIAN", "field": "v"}]
    near = aggregate.aggregate(hot, wanted, ["k"], approximate=True)
    exact = {r.k: r.m for r in aggregate.aggregate(hot, wanted, ["k"]).collect()}
    for r in near.collect():
        assert abs(r.m - exact[r.k]) <= 20


def test_global_rank_needs_no_single_window(spark, hot):
    spark.conf.set(GROUP_ROWS_CONF, "10")
    try:
        out = quality.normalize(hot, "v", "RANK")
        expected = window.window(hot, "v_norm", "RANK", [], ["v"], sliced=False)
        assert rows_of(out) == rows_of(expected.withColumn("v_norm", F.col("v_norm").cast("bigint")))
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)


def test_running_sum_of_only_nulls_is_null(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 4.0)], "id int, v double")
    for sliced in (True, False):
        frame = {"kind": "ROWS", "start": "UNBOUNDED PRECEDING", "end": "CURRENT ROW"}
        out = window.window(df, "s", "SUM", [], ["id"], "v", frame=frame, sliced=sliced).orderBy("id").collect()
        assert [r.s for r in out] == [None, None, 4.0]


def test_alias_as_input(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0)], "id int, v double")
    for sliced in (True, False):
        out = window.window(df, "v", "LAG", [], ["id"], sliced=sliced).orderBy("id").collect()
        assert [r.v for r in out] == [None, 5.0]


def test_top_by_rank_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 4), ("e", 1)], "k string, v int")
    assert rows_of(window.top_by_rank(df, [("v", "DESC")], 3).select("k", "rank")) == [("a", 1), ("b", 1), ("c", 3), ("d", 3)]


def test_bad_frames_and_functions(hot):
    with pytest.raises(ValueError):
        window.bound("3 SIDEWAYS")
    with pytest.raises(ValueError):
        window.window(hot, "w", "MODE", ["k"], ["o"])
    with pytest.raises(ValueError):
        window.window(hot, "w", "SUM", ["k"], ["o"], "v", frame={"kind": "GROUPS"}, sliced=False)


def same(a, b):
    """Equal rows by id, numbers up to rounding."""
    flat = lambda df: [(r.id, None if r.w is None else round(float(r.w), 6)) for r in df.orderBy("id").collect()]
    assert flat(a) == flat(b)


@pytest.mark.parametrize("function", ["SUM", "AVG", "MIN", "MAX", "COUNT"])
def test_spread_default_frame_takes_in_ties(hot, function):
    args = dict(alias="w", function=function, partition_by=["k"], order_by=["o"], field="v")
    spread, plain = window.window(hot, sliced=True, **args), window.window(hot, sliced=False, **args)
    assert "__slice" in spread._jdf.queryExecution().analyzed().toString()
    same(spread, plain)


@pytest.mark.parametrize("function", ["SUM", "AVG", "MIN", "COUNT"])
@pytest.mark.parametrize(
    "start,end",
    [("UNBOUNDED PRECEDING", "3 FOLLOWING"), ("UNBOUNDED PRECEDING", "2 PRECEDING"), ("CURRENT ROW", "UNBOUNDED FOLLOWING"), ("2 PRECEDING", "UNBOUNDED FOLLOWING"), ("4 FOLLOWING", "UNBOUNDED FOLLOWING")],
)
def test_spread_half_open_frames(hot, function, start, end):
    frame = {"kind": "ROWS", "start": start, "end": end}
    args = dict(alias="w", function=function, partition_by=["k"], order_by=TOTAL, field="v", frame=frame)
    same(window.window(hot, sliced=True, **args), window.window(hot, sliced=False, **args))


@pytest.mark.parametrize("function", ["SUM", "AVG", "MAX", "COUNT"])
@pytest.mark.parametrize("order,start,end", [(["o"], "3 PRECEDING", "CURRENT ROW"), ([("o", "DESC")], "2 PRECEDING", "5 FOLLOWING"), (["o"], "1 FOLLOWING", "2 FOLLOWING")])
def test_spread_value_ranges(hot, function, order, start, end):
    frame = {"kind": "RANGE", "start": start, "end": end}
    args = dict(alias="w", function=function, partition_by=["k"], order_by=order, field="v", frame=frame)
    spread, plain = window.window(hot, sliced=True, **args), window.window(hot, sliced=False, **args)
    assert ("__c" if function == "MAX" else "__own") in spread._jdf.queryExecution().analyzed().toString()
    same(spread, plain)


@pytest.mark.parametrize(
    "function,frame",
    [
        ("ROW_NUMBER", None), ("NTILE", None), ("LAG", None), ("LEAD", None), ("SUM", {"kind": "ROWS"}), ("AVG", {"kind": "ROWS", "start": "2 PRECEDING"}), ("SUM", None),
        ("MAX", {"kind": "ROWS", "start": "CURRENT ROW", "end": "UNBOUNDED FOLLOWING"}), ("FIRST_VALUE", None), ("LAST_VALUE", {"kind": "ROWS"}), ("COUNT", {"kind": "RANGE"}),
    ],
)
def test_forms_agree_on_ties_types_and_nulls(spark, function, frame):
    rows = [(k, i // 8, None if i % 5 == 0 else Decimal(i * 7 % 11), i) for k in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o int, v decimal(10,2), id int")
    plain, spread = (window.window(df, "w", function, ["k"], ["o"], "v", frame=frame, sliced=s) for s in (False, True))
    assert plain.schema["w"].dataType == spread.schema["w"].dataType
    columns = ["k", "o", "v", "id", "w"]
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, spread.select(columns).collect()))


EDGE_FRAMES = [("UNBOUNDED PRECEDING", "3 FOLLOWING"), ("UNBOUNDED PRECEDING", "2 PRECEDING"), ("CURRENT ROW", "UNBOUNDED FOLLOWING"), ("2 PRECEDING", "UNBOUNDED FOLLOWING"), ("4 FOLLOWING", "UNBOUNDED FOLLOWING")]


@pytest.mark.parametrize("function,start,end", [(("FIRST_VALUE", "LAST_VALUE")[i % 2], *f) for i, f in enumerate(EDGE_FRAMES)])
def test_spread_edges_of_half_open_frames(hot, function, start, end):
    args = dict(alias="w", function=function, partition_by=["k"], order_by=TOTAL, field="v", frame={"kind": "ROWS", "start": start, "end": end})
    spread = window.window(hot, sliced=True, **args)
    assert "__rn" in spread._jdf.queryExecution().analyzed().toString()
    same(spread, window.window(hot, sliced=False, **args))


@pytest.mark.parametrize(
    "function,order,start,end",
    [("SUM", ["o"], *EDGE_FRAMES[0]), ("AVG", [("o", "DESC")], *EDGE_FRAMES[3]), ("MIN", ["o"], *EDGE_FRAMES[1]), ("MAX", [("o", "DESC")], *EDGE_FRAMES[4]), ("COUNT", ["o"], *EDGE_FRAMES[4])],
)
def test_spread_half_open_value_ranges(hot, function, order, start, end):
    args = dict(alias="w", function=function, partition_by=["k"], order_by=order, field="v", frame={"kind": "RANGE", "start": start, "end": end})
    spread = window.window(hot, sliced=True, **args)
    assert "__own" in spread._jdf.queryExecution().analyzed().toString()
    same(spread, window.window(hot, sliced=False, **args))


@pytest.mark.parametrize("function,start,end", [("FIRST_VALUE", *EDGE_FRAMES[3]), ("LAST_VALUE", *EDGE_FRAMES[1]), ("FIRST_VALUE", "2 PRECEDING", "1 FOLLOWING"), ("LAST_VALUE", "1 FOLLOWING", "3 FOLLOWING")])
def test_spread_edges_of_value_ranges(hot, function, start, end):
    args = dict(alias="w", function=function, partition_by=["k"], order_by=["o"], field="o", frame={"kind": "RANGE", "start": start, "end": end})
    same(window.window(hot, sliced=True, **args), window.window(hot, sliced=False, **args))


@pytest.mark.parametrize("start,end", [("3 FOLLOWING", "1 FOLLOWING"), ("1 PRECEDING", "2 PRECEDING")])
def test_empty_frames(hot, start, end):
    for kind in ("ROWS", "RANGE"):
        for function, want in (("SUM", None), ("COUNT", 0), ("LAST_VALUE", None)):
            args = dict(alias="w", function=function, partition_by=["k"], order_by=["o"], field="v", frame={"kind": kind, "start": start, "end": end})
            assert {r.w for r in window.window(hot, sliced=True, **args).collect()} == {want}


def test_wide_frame_over_a_dense_field_runs_in_many_tasks(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), (F.col("id") / 4000).alias("o"), F.col("id").cast("double").alias("v"), F.col("id").alias("id"))
    frame = {"kind": "RANGE", "start": "3 PRECEDING", "end": "3 FOLLOWING"}
    out = window.window(df, "w", "SUM", ["k"], ["o"], "v", frame=frame, sliced=True)
    assert {r.w for r in out.collect()} == {4000 * 3999 / 2}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition" not in plan.split("totals")[0] or "__slice" in plan


def test_double_sums_over_ranges_are_as_exact_as_plain_ones(spark):
    rng = np.random.default_rng(1)
    values = [float(v) * 10.0 ** float(e) for v, e in zip(rng.normal(size=300), rng.integers(-8, 9, 300))]
    values[40], values[90], values[91], values[200] = float("nan"), float("inf"), float("-inf"), None
    df = spark.createDataFrame([(i, i // 2, v) for i, v in enumerate(values)], "id int, o int, v double")
    got = window.window(df, "w", "SUM", [], ["o"], "v", frame={"kind": "RANGE", "start": "5 PRECEDING", "end": "5 FOLLOWING"}, sliced=True)
    for r in got.collect():
        inside = [v for i, v in enumerate(values) if abs(i // 2 - r.o) <= 5 and v is not None]
        odd = [v for v in inside if not np.isfinite(v)]
        if odd:
            want = sum(odd)
            assert (np.isnan(r.w) and np.isnan(want)) or r.w == want
        else:
            assert r.w == pytest.approx(math.fsum(inside), rel=1e-12, abs=1e-9)


FRAMES = {
    "a": ("SUM", "v", {"kind": "RANGE", "start": "3 PRECEDING", "end": "2 FOLLOWING"}),
    "b": ("COUNT", "v", {"kind": "RANGE", "start": "3 PRECEDING", "end": "2 FOLLOWING"}),
    "c": ("AVG", "id", {"kind": "RANGE", "start": "UNBOUNDED PRECEDING", "end": "1 PRECEDING"}),
    "d": ("SUM", "id", {"kind": "RANGE", "start": "2 FOLLOWING", "end": "UNBOUNDED FOLLOWING"}),
    "e": ("COUNT", "o", {"kind": "RANGE", "start": "UNBOUNDED PRECEDING", "end": "UNBOUNDED FOLLOWING"}),
}


def stored(monkeypatch):
    """Labels of the tables that are stored from now on."""
    labels = []
    for module in (ordered, window):
        monkeypatch.setattr(module, "materialize", lambda df, label="step", store=module.materialize: labels.append(label) or store(df, label))
    return labels


@pytest.mark.parametrize("keys,order", [(["k"], "o"), ([], ("o", "DESC"))])
def test_range_frames_share_one_pass(hot, monkeypatch, keys, order):
    odd = hot.withColumn("v", F.when(F.col("id") == 7, float("nan")).when(F.col("id") % 900 == 5, float("inf")).otherwise(F.col("v")))
    plain = odd
    for alias, (function, field, frame) in FRAMES.items():
        plain = window.window(plain, alias, function, keys, [order], field, frame=frame, sliced=False)
    labels = stored(monkeypatch)
    got = window.range_frames(odd, keys, order, FRAMES)
    assert labels == ["values", "slices"] and got.dtypes == plain.dtypes
    shown = lambda df: df.withColumns({c: F.round(c, 6).cast("string") for c in "vac"})
    assert rows_of(shown(got)) == rows_of(shown(plain))


def test_range_frames_refuse_what_cannot_share_and_know_empty_ones(hot):
    empty = {"kind": "RANGE", "start": "3 FOLLOWING", "end": "1 FOLLOWING"}
    out = window.range_frames(hot, ["k"], "o", {"s": ("SUM", "v", empty), "n": ("COUNT", "v", empty)})
    assert {(r.s, r.n) for r in out.collect()} == {(None, 0)} and out.count() == hot.count()
    for function, frame in (("MAX", empty), ("SUM", {"kind": "ROWS"})):
        with pytest.raises(ValueError):
            window.range_frames(hot, ["k"], "o", {"s": (function, "v", frame)})


def test_dense_frames_are_cut_once(spark, sf, monkeypatch):
    labels = stored(monkeypatch)
    entry.queries()["q_frame_range_dense"](spark, sf)
    assert labels == ["values", "slices"]
