"""Tidy tables behind the chart types; drawing is left to the reader of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col, percent_of
from tamis.operators.aggregate import PLAIN, quantiles, subtotals
from tamis.operators.kpi import CRITICAL_PCT, WARNING_PCT, status, tiles
from tamis.operators.ordered import prefix_sum
from tamis.operators.reshape import column_values
from tamis.operators.sample import random_rows
from tamis.session import materialize

# The chart types of a workflow, by the shape of their table.
SERIES = ("BAR_VERTICAL", "BAR_HORIZONTAL", "LINE", "AREA", "SPARKLINE")
MULTI_SERIES = ("BAR_GROUPED", "BAR_STACKED", "LINE_MULTI", "AREA_STACKED")
SHARES = ("PIE", "DONUT", "HALF_DONUT")
SINGLE = ("BAR_100PCT", "COMBO_DUAL_AXIS", "SCATTER", "BUBBLE", "HEATMAP", "CHOROPLETH_BF", "GAUGE_SEMI", "KPI_TILE", "PIVOT_TABLE")
CHART_TYPES = SERIES + MULTI_SERIES + SHARES + SINGLE
LEVELS = ("region", "province", "commune")


def chart(df: DataFrame, type: str, encoding: dict, aggregation: str = "SUM", **options) -> DataFrame:
    """Table of the chart ``type`` for ``df``; the encoding names the fields, as in a workflow."""
    kind, e = type.upper(), encoding
    if kind in SERIES:
        x, y = (e["yField"], e["xField"]) if kind == "BAR_HORIZONTAL" else (e.get("xField"), e["yField"])
        return series(df, x, y, aggregation, **options)
    if kind in MULTI_SERIES:
        return multi_series(df, e["xField"], e["series"], e["yField"], aggregation)
    if kind == "BAR_100PCT":
        return percent_bars(df, e["xField"], e["series"], e["yField"], aggregation)
    if kind in SHARES:
        return shares(df, e["category"], e["value"], aggregation)
    if kind == "COMBO_DUAL_AXIS":
        return dual_axis(df, e["xField"], e["leftAxis"], e["rightAxis"])
    if kind == "SCATTER":
        return scatter(df, e["xField"], e["yField"], **options)
    if kind == "BUBBLE":
        return bubbles(df, e["xField"], e["yField"], e["size"])
    if kind == "HEATMAP":
        return heatmap(df, e["xField"], e["yField"], e["value"], aggregation)
    if kind == "CHOROPLETH_BF":
        return region_map(df, e["regionField"], e["valueField"], aggregation, level=e.get("level", "region"), **options)
    if kind == "GAUGE_SEMI":
        return gauge(df, e["value"], e.get("target"), **options)
    if kind == "KPI_TILE":
        return tiles(df, options.pop("keys", ()), options.pop("period", None) or e["period"], e["value"], **options)
    if kind == "PIVOT_TABLE":
        return pivot_table(df, e["rowFields"], e.get("columnFields", []), e["valueField"], e.get("aggregation", "SUM"))
    raise ValueError(f"chart type '{type}' is not supported")


def _agg(function: str, field: str) -> Column:
    kind = function.upper()
    if kind not in PLAIN:
        raise ValueError(f"chart aggregation '{function}' is not supported")
    return PLAIN[kind](col(field))


def series(df: DataFrame, x: str | None, y: str, aggregation: str = "SUM", order_by: str = "x", descending: bool = False) -> DataFrame:
    """``(x, y)`` with one row per x, sorted by ``x`` or ``y``."""
    if x is None:
        return df.select(col(y).alias("y"))
    rows = df.groupBy(col(x).alias("x")).agg(_agg(aggregation, y).alias("y"))
    lead = F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_last()
    return rows.orderBy(lead, F.col("x").asc_nulls_last())


def grid(cells: DataFrame, a: str, b: str) -> DataFrame:
    """All combinations of the distinct values of two columns.

    The shorter list is dealt over salts and the other one repeated per salt, so the grid, which
    is the result asked for, is built by an equi-join in many tasks.
    """
    salts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = cells.select(col(a)).distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = cells.select(col(b)).distinct().withColumn("__salt", F.pmod(F.xxhash64(col(b)), F.lit(salts)).cast("int"))
    return left.join(right, "__salt").drop("__salt")


def multi_series(df: DataFrame, x: str, by: str, y: str, aggregation: str = "SUM") -> DataFrame:
    """``(x, series, y)`` for every x and series; a missing cell is 0."""
    cells = df.groupBy(col(x).alias("x"), col(by).alias("series")).agg(_agg(aggregation, y).alias("y"))
    stored = materialize(cells, "cells")
    given = stored.select(F.col("x").alias("__x"), F.col("series").alias("__s"), "y")
    match = F.col("x").eqNullSafe(F.col("__x")) & F.col("series").eqNullSafe(F.col("__s"))
    full = grid(stored, "x", "series").join(given, match, "left")
    return full.select("x", "series", F.coalesce(F.col("y"), F.lit(0)).alias("y"))


def percent_bars(df: DataFrame, x: str, by: str, y: str, aggregation: str = "SUM") -> DataFrame:
    """The dense grid plus ``pct``, the share of the x total in percent with one decimal."""
    cells = materialize(multi_series(df, x, by, y, aggregation), "cells")
    totals = cells.groupBy(F.col("x").alias("__x")).agg(F.sum("y").alias("__total"))
    joined = cells.join(totals, F.col("x").eqNullSafe(F.col("__x")), "left")
    total = F.when(F.col("__total") == 0, F.lit(1.0)).otherwise(F.col("__total").cast("double"))
    pct = F.floor(F.col("y").cast("double") / total * 1000 + 0.5) / 10
    return joined.select("x", "series", "y", pct.alias("pct"))


def shares(df: DataFrame, category: str, value: str, aggregation: str = "SUM") -> DataFrame:
    """``(category, value, pct)`` with the percentage of the overall total."""
    rows = df.groupBy(col(category).alias("category")).agg(_agg(aggregation, value).alias("value"))
    stored = materialize(rows, "shares")
    total = stored.agg(F.sum("value")).scalar()
    return stored.withColumn("pct", percent_of(F.col("value"), total))


def dual_axis(df: DataFrame, x: str, left: dict, right: dict) -> DataFrame:
    """``(x, left_value, right_value)``, each axis ``{"field", "aggregation"}`` with its own function."""
    if not left or not right:
        raise ValueError("a dual-axis chart needs both axes")
    plain, medians = [], {}
    for side, axis in (("left_value", left), ("right_value", right)):
        if axis["aggregation"].upper() == "MEDIAN":
            medians[side] = axis["field"]
        else:
            plain.append(_agg(axis["aggregation"], axis["field"]).alias(side))
    named = df.withColumn("x", col(x))
    rows = named.groupBy("x").agg(*plain) if plain else named.select("x").distinct()
    for side, field in medians.items():
        found = quantiles(named, field, {side: 0.5}, ["x"]).withColumnRenamed("x", "__x")
        rows = rows.join(found, F.col("x").eqNullSafe(F.col("__x")), "left").drop("__x")
    return rows.select("x", "left_value", "right_value").orderBy(F.col("x").asc_nulls_last())


def scatter(df: DataFrame, x: str, y: str, points: int | None = None, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Numeric pairs of every row; ``points`` asks for a sample of that size instead."""
    picked = df if points is None else random_rows(df, points, seed, key)
    return picked.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def bubbles(df: DataFrame, x: str, y: str, size: str) -> DataFrame:
    """Pairs with ``symbol_size`` between 12 and 60, linear in ``size``."""
    span = df.agg(F.struct(F.min(col(size)).cast("double").alias("lo"), F.max(col(size)).cast("double").alias("hi"))).scalar()
    width = F.when(span["hi"] == span["lo"], F.lit(1.0)).otherwise(span["hi"] - span["lo"])
    scaled = F.lit(12.0) + (col(size).cast("double") - span["lo"]) / width * 48.0
    return df.select(
        col(x).cast("double").alias("x"),
        col(y).cast("double").alias("y"),
        col(size).cast("double").alias("size"),
        scaled.alias("symbol_size"),
    )


def axis_index(cells: DataFrame, field: str, alias: str) -> DataFrame:
    """Distinct values of a field, numbered from 0 in their order."""
    values = cells.select(col(field)).distinct()
    return prefix_sum(values, [], [field], F.lit(1).cast("bigint"), alias, unique=True).withColumn(alias, F.col(alias) - 1)


def heatmap(df: DataFrame, x: str, y: str, value: str, aggregation: str = "SUM") -> DataFrame:
    """Cells with their axis positions and the overall range of values."""
    cells = materialize(
        df.groupBy(col(x).alias("x"), col(y).alias("y")).agg(_agg(aggregation, value).alias("value")), "cells"
    )
    xs = axis_index(cells, "x", "x_index").withColumnRenamed("x", "__x")
    ys = axis_index(cells, "y", "y_index").withColumnRenamed("y", "__y")
    span = cells.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    placed = cells.join(xs, F.col("x").eqNullSafe(F.col("__x"))).join(ys, F.col("y").eqNullSafe(F.col("__y")))
    return placed.select(
        "x", "y", "x_index", "y_index", "value", span["lo"].alias("min_value"), span["hi"].alias("max_value")
    )


def region_map(
    df: DataFrame,
    region: str,
    value: str,
    aggregation: str = "SUM",
    reference: DataFrame | None = None,
    code: str | None = None,
    level: str = "region",
) -> DataFrame:
    """Value per area with the range of values; reference areas without data show NULL."""
    if level not in LEVELS:
        raise ValueError(f"map level '{level}' is not supported")
    rows = materialize(df.groupBy(col(region).alias("region")).agg(_agg(aggregation, value).alias("value")), "areas")
    span = rows.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    shown = rows
    if reference is not None:
        areas = reference.select(col(code or region).alias("__area")).distinct()
        shown = areas.join(rows, F.col("__area") == F.col("region"), "left").select(F.col("__area").alias("region"), "value")
    return shown.select(
        "region", "value", F.lit(level).alias("level"), span["lo"].alias("min_value"), span["hi"].alias("max_value")
    )


def gauge(
    df: DataFrame,
    value: str,
    target: str | None = None,
    polarity: str = "more_better",
    warning_pct: float = WARNING_PCT,
    critical_pct: float = CRITICAL_PCT,
) -> DataFrame:
    """Value, target (100 when none is named), attainment and status of each input row."""
    v = col(value).cast("double")
    t = F.coalesce(col(target).cast("double"), F.lit(100.0)) if target else F.lit(100.0)
    return df.select(
        v.alias("value"),
        t.alias("target"),
        percent_of(v, t).alias("attainment_pct"),
        status(v, t, F.lit(polarity), F.lit(float(warning_pct)), F.lit(float(critical_pct))).alias("status"),
    )


def pivot_table(
    df: DataFrame,
    row_fields: Sequence[str],
    column_fields: Sequence[str],
    value_field: str,
    aggregation: str = "SUM",
    values: Sequence | None = None,
) -> DataFrame:
    """Rows by columns with subtotals: ``level`` counts the row fields rolled up.

    Several column fields are joined to one column name by `` / ``. The detail is aggregated once;
    the columns and subtotals come from that smaller table.
    """
    if not column_fields:
        return subtotals(df, row_fields, value_field, aggregation)
    kind = aggregation.upper()
    parts = [col(c).cast("string") for c in column_fields]
    label = parts[0] if len(parts) == 1 else F.concat_ws(" / ", *parts)
    rows = [col(r) for r in row_fields]
    detail = materialize(
        df.groupBy(*rows, label.alias("__c")).agg(
            F.sum(col(value_field)).alias("s") if kind in ("SUM", "AVG") else F.lit(0).alias("s"),
            F.count(col(value_field)).alias("n"),
            F.min(col(value_field)).alias("lo"),
            F.max(col(value_field)).alias("hi"),
        ),
        "detail",
    )
    cells = []
    for v in values if values is not None else column_values(detail, "__c"):
        here = F.col("__c") == F.lit(v)
        pick = lambda c, here=here: F.when(here, F.col(c))
        if kind == "SUM":
            cell = F.sum(pick("s"))
        elif kind == "COUNT":
            cell = F.coalesce(F.sum(pick("n")), F.lit(0).cast("bigint"))
        elif kind == "AVG":
            cell = F.sum(pick("s")) / F.nullif(F.sum(pick("n")), F.lit(0).cast("bigint"))
        elif kind == "MIN":
            cell = F.min(pick("lo"))
        elif kind == "MAX":
            cell = F.max(pick("hi"))
        else:
            raise ValueError(f"pivot aggregation '{aggregation}' is not supported")
        cells.append(cell.alias(str(v)))
    return detail.rollup(*rows).agg(*cells, F.bit_count(F.grouping_id()).alias("level"))
