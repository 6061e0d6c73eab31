"""Small literal cases of projection, joins, quality, charts, KPIs and samples."""

import datetime as dt
import functools

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamis.functions import scalars
from tamis.operators import charts, compare, join, kpi, project, quality, reshape, sample


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "g string, v double")


def test_ascending_order_puts_nulls_last(nulls):
    assert [r.v for r in reshape.sort(nulls, ["v"]).collect()] == [1.0, 3.0, None]
    assert [r.v for r in reshape.sort(nulls, [("v", "DESC")]).collect()] == [3.0, 1.0, None]


def test_drop_removes_null_rows(nulls):
    assert rows_of(quality.outlier(nulls, "v", "HARD_BOUNDS", 0, 10, "DROP")) == [("a", 1.0), ("b", 3.0)]


def test_clamp_keeps_null(nulls):
    out = quality.outlier(nulls, "v", "HARD_BOUNDS", 2, None, "CAP")
    assert rows_of(out) == [("a", 2.0), ("a", None), ("b", 3.0)]


def test_flag_is_default_and_null_stays_null(nulls):
    out = quality.outlier(nulls, "v", "HARD_BOUNDS", upper=2, action=None)
    assert rows_of(out.select("v", "v_is_outlier")) == [(1.0, False), (3.0, True), (None, None)]


def test_clamp_to_computed_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 21), 500]], "v double")
    out = quality.outlier(df, "v", "IQR", action="CLAMP")
    q1, q3 = 6.0, 16.0
    assert out.agg(F.max("v")).first()[0] == q3 + 1.5 * (q3 - q1)
    three = quality.outlier(df, "v", "THREE_SIGMA", action="DROP")
    assert three.count() == 20


def test_approximate_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(100), 10_000]], "v double")
    assert quality.outlier(df, "v", "IQR", action="DROP", exact=False).count() == 100


def test_unknown_strategy_and_action(nulls):
    for bad in (dict(strategy="MAD"), dict(strategy="IQR", action="HIDE")):
        with pytest.raises(ValueError):
            quality.outlier(nulls, "v", **bad)
    with pytest.raises(ValueError):
        quality.normalize(nulls, "v", "SIGMOID")


def test_constant_column_normalizes_to_null(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v_norm for r in quality.normalize(df, "v", "ZSCORE").collect()] == [None, None]
    assert [r.v_norm for r in quality.normalize(df, "v", "MIN_MAX").collect()] == [None, None]


def test_log_of_non_positive_is_null(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "v double")
    assert [r.v_norm for r in quality.normalize(df, "v", "LOG").collect()] == [None, None, 0.0]


def test_rank_of_nulls_is_last(nulls):
    assert rows_of(quality.normalize(nulls, "v", "RANK").select("v", "v_norm")) == [(1.0, 1), (3.0, 2), (None, 3)]


def test_recode_types(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "c int")
    assert [r.x for r in project.recode(df, "c", "x", {"1": "one", "2": None}, "other").collect()] == ["one", None, "other"]
    assert [r.x for r in project.recode(df, "c", "x", {"1": 5, "2": "two"}).collect()] == ["5", "two", None]
    long = {str(i): f"l{i}" for i in range(3, 400)} | {"1": None}
    assert [r.x for r in project.recode(df, "c", "x", long, "d").collect()] == [None, "d", "l9"]
    with pytest.raises(ValueError):
        project.recode(df, "c", "x", {})


def test_compare_literals(spark):
    df = spark.createDataFrame([("10", 10), ("b", 2)], "s string, n int")
    assert project.compare(df, "n", "<=", "2.5").count() == 1
    assert project.compare(df, "s", "=", "'b'").count() == 1
    with pytest.raises(ValueError):
        project.compare(df, "n", "~", 1)


def test_durations(spark):
    at = dt.datetime(2024, 3, 31, 12)
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 11),), (dt.datetime(2024, 2, 29, 12),), (at,)], "t timestamp_ntz")
    assert project.in_period(df, "t", last="P1M", as_of=at).count() == 2
    assert project.in_period(df, "t", last="PT90S", as_of=at).count() == 1
    with pytest.raises(ValueError):
        project.duration_interval("30 days")
    with pytest.raises(ValueError):
        project.in_period(df, "t", last="P1D")


def test_week_starts_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7),), (dt.datetime(2024, 1, 8),), (dt.datetime(2024, 1, 11),)], "t timestamp_ntz")
    assert project.current_period(df, "t", "week", dt.datetime(2024, 1, 10)).count() == 1


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "l1", 10), (2, "l2", 20), (None, "ln", 30), (2, "l2b", 40)], "k int, a string, v int")
    right = spark.createDataFrame([(2, "r2", 200), (3, "r3", 300), (None, "rn", 400)], "k int, b string, v int")
    return left, right


def test_join_columns_and_nulls(sides):
    left, right = sides
    inner = join.join(left, right, ["k"], "INNER")
    assert inner.columns == ["k", "a", "v", "b", "v_right"]
    assert inner.count() == 2
    full = join.join(left, right, ["k"], "FULL_OUTER")
    assert rows_of(full) == rows_of(
        left.alias("l").join(right.alias("r"), F.col("l.k") == F.col("r.k"), "full").select(
            F.coalesce("l.k", "r.k"), "l.a", "l.v", "r.b", "r.v"
        )
    )
    right_join = join.join(left, right, ["k"], "RIGHT")
    assert {(r.k, r.b) for r in right_join.collect()} == {(2, "r2"), (3, "r3"), (None, "rn")}


def test_join_with_other_names(sides):
    left, right = sides
    renamed = right.withColumnRenamed("k", "code")
    out = join.join(left, renamed, [{"left": "k", "right": "code"}], "FULL_OUTER")
    assert out.columns == ["k", "a", "v", "code", "b", "v_right"]
    assert out.count() == 6
    with pytest.raises(ValueError):
        join.join(left, right, ["k"], "CROSS")
    with pytest.raises(ValueError):
        join.join(left, right, [], "INNER")


def test_similarity_cases(spark):
    cases = [("", "", 1.0), ("abc", "abc", 1.0), ("abc", "abd", 2 / 3), ("abc", "xyz", 0.0), (None, "abc", 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r[0] for r in df.select(scalars.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([c[2] for c in cases])
    words = [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("", "abc", 3), ("", "", 0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in words], "a string, b string")
    assert [r[0] for r in df.select(F.levenshtein("a", "b")).collect()] == [w[2] for w in words]


def test_number_labels(spark):
    df = spark.createDataFrame([(1234.56,)], "v double")
    show = lambda *a: df.select(scalars.number_label(F.col("v"), *a)).first()[0]
    assert show(1, "t", "#,##0.0") == "1,234.6 t"
    assert show(0, None, "EUR #,##0") == "EUR 1,235"
    assert show(2, None, "0.00") == "1234.56"
    share = spark.createDataFrame([(0.1234,)], "v double")
    assert share.select(scalars.number_label(F.col("v"), 1, "%", "0.0%")).first()[0] == "12.3%"


def test_number_label_query_on_signs_and_halves(spark, tmp_path):
    amounts = [-0.0, 0.0, -0.01, -0.001, 0.025, 0.075, -99.99, 999.95, -123456.78, None]
    rows = [(i, a) for i, a in enumerate(amounts)]
    spark.createDataFrame(rows, "c_custkey bigint, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = dict(entry.queries()["q_number_label"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert got == dict(con.execute(entry.oracle_sql()["q_number_label"]).fetchall())
    assert got[0] == "-0.0 t"


def test_globs():
    assert scalars.glob_regex("a{x}:*") == "^a\\{x\\}:.*$"
    assert scalars.glob_regex("k?[ab].c") == "^k.[ab]\\.c$"


def test_gauge(spark):
    df = spark.createDataFrame([(84.2, 90.0)], "v double, t double")
    row = charts.gauge(df, "v", "t").first()
    assert round(row.attainment_pct, 2) == 93.56 and row.status == "OK"
    assert charts.gauge(df, "v").first().target == 100.0


@pytest.mark.parametrize(
    "polarity,value,expected",
    [
        ("more_better", 80, "OK"), ("more_better", 74.9, "WARNING"), ("more_better", 59.9, "CRITICAL"), ("more_better", 75, "OK"),
        ("less_better", 100, "OK"), ("less_better", 111, "WARNING"), ("less_better", 151, "CRITICAL"), ("neutral", 1, "NEUTRAL"),
    ],
)
def test_status_rule(spark, polarity, value, expected):
    limits = (110.0, 150.0) if polarity == "less_better" else (75.0, 60.0)
    df = spark.createDataFrame([(float(value),)], "v double")
    out = df.select(kpi.status(F.col("v"), F.lit(100.0), F.lit(polarity), F.lit(limits[0]), F.lit(limits[1])))
    assert out.first()[0] == expected


def test_status_without_target_is_null(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    assert df.select(kpi.status(F.col("v"), F.lit(None).cast("double"), F.lit("more_better"))).first()[0] is None


def test_kpi_where_form_and_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int")
    row = kpi.kpi_values(df, [{"id": "kpi_a", "expression": "SUM(v) WHERE k = 'a'", "format": {}}]).first()
    assert row.value == 1.0 and row.status is None
    assert kpi.kpi_values(df, [{"id": "kpi_s", "expression": "v * 2"}]).first().value == 10.0
    with pytest.raises(ValueError):
        kpi.kpi_values(df, [{"id": "kpi_x", "expression": "SUM(nope)"}])
    with pytest.raises(ValueError):
        kpi.kpi_values(df, [{"id": "kpi_x", "expression": "SUM(v)", "polarity": "upwards"}])


def test_every_chart_type_has_a_table(spark):
    df = spark.createDataFrame(
        [("n", "x", 1, 2.0, 3.0), ("n", "y", 2, 4.0, 5.0), ("s", "x", 3, 6.0, 7.0)], "region string, kind string, month int, v double, w double"
    )
    e = {
        "xField": "month", "yField": "v", "series": "kind", "category": "kind", "value": "v", "size": "w", "regionField": "region", "valueField": "v",
        "leftAxis": {"field": "v", "aggregation": "SUM"}, "rightAxis": {"field": "w", "aggregation": "AVG"}, "rowFields": ["region"], "columnFields": ["kind"],
        "period": "month",
    }
    assert len(charts.CHART_TYPES) == 21
    for kind in charts.CHART_TYPES:
        assert charts.chart(df, kind, e).count() > 0, kind
    with pytest.raises(ValueError):
        charts.chart(df, "RADAR", e)


def test_percent_of_empty_total(spark):
    df = spark.createDataFrame([("a", "s", 0.0), ("b", "s", 4.0), ("b", "t", 1.0)], "x string, s string, y double")
    got = {(r.x, r.series): r.pct for r in charts.percent_bars(df, "x", "s", "y").collect()}
    assert got == {("a", "s"): 0.0, ("a", "t"): 0.0, ("b", "s"): 80.0, ("b", "t"): 20.0}


def test_pivot_table_several_columns_and_functions(spark):
    df = spark.createDataFrame([("n", "x", 1, 2.0), ("n", "x", 2, 4.0), ("s", "y", 1, 6.0)], "r string, a string, b int, v double")
    for function, total in (("SUM", 2.0), ("COUNT", 1), ("MIN", 2.0), ("MAX", 2.0), ("AVG", 2.0)):
        out = charts.pivot_table(df, ["r"], ["a", "b"], "v", function)
        assert out.columns == ["r", "x / 1", "x / 2", "y / 1", "level"]
        assert out.where("level = 1").first()["x / 1"] == total


def test_pivot_missing_cells(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "r string, c string, v int")
    assert rows_of(reshape.pivot(df, ["r"], "c", "v", "SUM")) == [("a", 1, None), ("b", None, 2)]
    assert rows_of(reshape.pivot(df, ["r"], "c", "v", "COUNT")) == [("a", 1, 0), ("b", 0, 1)]
    with pytest.raises(ValueError):
        reshape.column_values(df, "r", 1)


def test_page_index(spark):
    """Every page equals the plain page, copies and NULLs included, and reads the folders of its slices alone."""
    rows = [(i % 7 if i % 11 else None, i % 3) for i in range(300)] + [(3, 1)] * 400
    df = spark.createDataFrame(rows, "a int, b int")
    order = [("a", "DESC"), "b"]
    index = reshape.PageIndex(df, order)
    assert index.count() == 700 and index.starts.count() > 3
    for number in (1, 4, 13, 35, 36):
        assert index.page(number).collect() == reshape.page(df, order, number).collect()
    got = [tuple(r) for n in range(1, 8) for r in index.page(n, 100).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    deep = index.page(34)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = reshape.PageIndex(df.where("a > 99"), order)
    assert empty.count() == 0 and empty.page(1).collect() == []


def test_page_limits(spark):
    df = spark.range(300)
    assert [r.id for r in reshape.page(df, ["id"], 0, 0).collect()] == [0]
    assert reshape.page(df, ["id"], 1, 500).count() == 100


@pytest.fixture(scope="module")
def hundred(spark):
    return spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("value"))


def test_sample_sizes(hundred):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(sample.sample(hundred, "FIRST_N", 3, order_by=["id"])) == [0, 1, 2]
    assert ids(sample.sample(hundred, "LAST_N", 3, order_by=["id"])) == [97, 98, 99]
    assert ids(sample.sample(hundred, "LAST_N", 2, order_by=[{"field": "id", "direction": "DESC"}])) == [0, 1]
    one = ids(sample.sample(hundred, "RANDOM", 10, 42))
    assert len(one) == 10 and one == ids(sample.sample(hundred, "RANDOM", 10, 42))
    assert one != ids(sample.sample(hundred, "RANDOM", 10, 43))
    assert len(ids(sample.sample(hundred.where("id < 3"), "RANDOM", 100))) == 3
    assert ids(sample.sample(hundred, "FULL")) == list(range(100))


@pytest.mark.parametrize("strategy", ["RANDOM", "STRATIFIED"])
def test_sample_does_not_depend_on_partitions(spark, strategy):
    base = spark.range(5000).withColumn("g", F.expr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('g', id % 7) END"))
    draws = [
        rows_of(sample.sample(base.repartition(n), strategy, 200, 7, ["id"], "g")) for n in (1, 4, 16)
    ]
    assert draws[0] == draws[1] == draws[2] and len(draws[0]) == 200


def test_stratified_shares(spark):
    base = spark.range(1000).withColumn("g", F.expr("CASE WHEN id < 601 THEN 'a' WHEN id < 900 THEN 'b' WHEN id < 999 THEN 'c' END"))
    got = {r.g: r.n for r in sample.stratified(base, "g", 10, 1, ["id"]).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 6, "b": 3, "c": 1}
    every = sample.stratified(base, "g", 5000, 1, ["id"])
    assert every.count() == 1000


def test_random_samples_are_even_over_many_seeds(spark):
    """40 samples of 500 of 10,000 sorted rows: each tenth of the table, and each pair of seeds, is met as often as by chance."""
    base = spark.range(10_000)
    picked = [sample.sample(base, "RANDOM", 500, seed).select(F.lit(seed).alias("seed"), "id") for seed in range(40)]
    rows = [(r.seed, r.id) for r in functools.reduce(lambda a, b: a.unionByName(b), picked).collect()]
    assert len(rows) == 40 * 500
    tenths = [sum(1 for _, i in rows if i // 1000 == t) for t in range(10)]
    assert all(abs(n - 2000) < 6 * (20_000 * 0.1 * 0.9) ** 0.5 for n in tenths)
    own = [{i for s, i in rows if s == seed} for seed in range(40)]
    shared = [len(a & b) for n, a in enumerate(own) for b in own[:n]]
    assert abs(sum(shared) / len(shared) - 25) < 2  # 500 * 500 / 10,000
    # parts of a step of the row number are as common as in the table
    assert all(abs(sum(1 for _, i in rows if i % 7 == k) - 20_000 / 7) < 6 * (20_000 * 6 / 49) ** 0.5 for k in range(7))


def test_column_diff_by_sketches(spark):
    """Marks and differing rows as in the exact form, distinct counts within five standard errors, no row expanded."""
    n = F.col("id")
    old = spark.range(20_000).select("id", (n % 5000).alias("a"), F.concat(F.lit("x"), n % 3).alias("b"), F.lit(None).cast("double").alias("c"))
    new = old.withColumn("a", F.when(n % 100 == 0, -n).otherwise(F.col("a")))
    exact = {r.column: r for r in compare.column_diff(old, new, ["id"]).collect()}
    sketched = compare.column_diff(old, new, ["id"], approximate=True)
    assert "Expand" not in sketched._jdf.queryExecution().executedPlan().toString()
    for r in sketched.collect():
        sure = exact[r.column]
        assert (r.rows_differing, r.status) == (sure.rows_differing, sure.status)
        assert abs(r.distinct_before - sure.distinct_before) <= 0.05 * sure.distinct_before
        assert abs(r.distinct_after - sure.distinct_after) <= 0.05 * sure.distinct_after


def test_sample_arguments(hundred):
    for bad in (dict(strategy="RESERVOIR"), dict(strategy="RANDOM", size=0), dict(strategy="RANDOM", size=20_000), dict(strategy="STRATIFIED"), dict(strategy="GOLDEN")):
        with pytest.raises(ValueError):
            sample.sample(hundred, **bad)


def test_boundary_values(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (3, 6)], "k int, v int")
    got = {(r.k, r.v): r.boundary for r in sample.boundary_values(df, ["v"], ["k"]).collect()}
    assert got == {(1, 5): ["min:v"], (2, None): ["null:v"], (3, 9): ["max:v", "duplicate"], (3, 6): ["duplicate"]}


def test_row_changes_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    assert rows_of(compare.row_changes(a, b)) == [(1, "REMOVED", 2), (1, "SAME", 1), (2, "REMOVED", 1), (3, "ADDED", 1), (None, "SAME", 1)]


def test_row_diff_tolerance_and_duplicates(spark):
    a = spark.createDataFrame([(1, 100.0, "x"), (2, 100.0, "x"), (3, None, "x"), (4, 1.0, "x"), (4, 1.0, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 100.009, "x"), (2, 100.02, "y"), (3, None, "x"), (4, 1.0, "x"), (5, 1.0, "x")], "k int, v double, s string")
    got = {r.k: (r.change, r.changed) for r in compare.row_diff(a, b, ["k"]).collect()}
    assert got == {1: ("SAME", []), 2: ("CHANGED", ["v", "s"]), 3: ("SAME", []), 4: ("DUPLICATED", []), 5: ("ADDED", [])}


def test_kpi_decisions_and_verdict(spark):
    before = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 0.0), ("d", 1.0)], "kpi_id string, value double")
    after = spark.createDataFrame([("a", 101.0), ("b", 110.0), ("c", 0.0), ("e", 1.0)], "kpi_id string, value double")
    limits = spark.createDataFrame([("a", 2.0, True), ("b", 2.0, False), ("c", 0.0, True), ("d", 1.0, True)], "kpi_id string, threshold double, critical boolean")
    rated = compare.kpi_decisions(compare.kpi_diff(before, after, limits))
    assert {r.kpi_id: r.decision for r in rated.collect()} == {"a": "OK", "b": "WARN", "c": "OK", "d": "BREACH", "e": "WARN"}
    blocked = compare.verdict(rated).first()
    assert blocked.decision == "BLOCKED" and not blocked.within_threshold and "kpi.d.breach" in blocked.reasons
    assert compare.verdict(rated.where("decision <> 'BREACH'")).first().decision == "APPROVED_WITH_WARNINGS"
    fine = rated.where("decision = 'OK'")
    assert compare.verdict(fine).first().decision == "APPROVED_FOR_DEPLOYMENT"
    lost = compare.schema_diff(spark.createDataFrame([(1, 2)], "region_id int, k int"), spark.createDataFrame([(1,)], "k int"))
    assert compare.verdict(fine, lost).first().reasons == ["schema.region_id.removed"]


def test_schema_diff(spark):
    a = spark.createDataFrame([], "i int, s int, d decimal(10,2), firstName string, gone int")
    b = spark.createDataFrame([], "i bigint, s string, d decimal(12,4), firstname string, extra_column int")
    got = {r.field: (r.change, r.blocking) for r in compare.schema_diff(a, b).collect()}
    assert got == {
        "i": ("WIDENED", False), "s": ("TYPE_CHANGED", True), "d": ("PRECISION_CHANGED", False), "firstName": ("RENAMED", False),
        "gone": ("REMOVED", True), "extra_column": ("ADDED", False),
    }


def test_column_diff_marks(spark):
    a = spark.createDataFrame([(1, 5.0, "x")], "k int, v double, old string")
    b = spark.createDataFrame([(1, 6.0, 1)], "k int, v double, fresh int")
    assert {r.column: r.status for r in compare.column_diff(a, b, ["k"]).collect()} == {
        "k": "IDENTIQUE", "v": "MODIFIE", "old": "DISPARU", "fresh": "NOUVEAU",
    }


def test_content_hash_sees_copies_and_values(spark):
    digest = lambda rows: tuple(compare.content_hash(spark.createDataFrame(rows, "a int, b string")).first())
    assert digest([(1, "x"), (2, "y")]) == digest([(2, "y"), (1, "x")])
    assert digest([(1, "x")]) != digest([(1, "x"), (1, "x")])
    assert digest([(1, "x")]) != digest([(1, "y")])


def test_golden_breaches(spark):
    values = spark.createDataFrame([("a", 1.04), ("b", 2.2)], "kpi_id string, value double")
    expected = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "kpi_id string, expected double")
    assert sorted(r.kpi_id for r in compare.golden_breaches(values, expected).collect()) == ["b", "c"]


def test_tiles_of_single_period(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 4.0), ("b", 2, 6.0)], "k string, p int, v double")
    got = {r.k: (r.value, r.previous, r.trend, r.series) for r in kpi.tiles(df, ["k"], "p", "v", 1).collect()}
    assert got == {"a": (5.0, None, "flat", [5.0]), "b": (6.0, 4.0, "up", [6.0])}


def test_cast_losses(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    assert tuple(scalars.cast_losses(df, {"s": "INTEGER"}).first()) == ("s", "INTEGER", 1)


def test_full_outer_key_types(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (5_000_000_000, "y")], "k long, r string")
    out = join.join(left, right, ["k"], "FULL_OUTER")
    assert dict(out.dtypes)["k"] == "bigint"
    assert sorted(map(tuple, out.collect())) == [(1, "a", None), (2, "b", "x"), (5_000_000_000, None, "y")]


def test_recode_of_keys_equal_as_text(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "c string")
    big = {1: "first", "1": "second", **{str(i): f"n{i}" for i in range(3, 400)}, "2": None}
    assert [r.s for r in project.recode(df, "c", "s", big, "other").collect()] == ["first", None, "other"]


def test_scatter_and_tiles_keep_all_rows(spark):
    df = spark.range(12_000).selectExpr("id", "id * 2 AS y", "id % 2 AS k")
    assert charts.chart(df, "SCATTER", {"xField": "id", "yField": "y"}).count() == 12_000
    assert {len(r.series) for r in kpi.tiles(df.limit(60), ["k"], "id", "y").collect()} == {30}
