"""Grouped and global aggregation, exact quantiles, distinct projection, subtotals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.scalars import col
from tamis.operators.ordered import groups_fit, join_on, prefix_sum

# The aggregate functions of a workflow.
PLAIN = {
    "SUM": F.sum,
    "AVG": F.avg,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.count_distinct,
    "MIN": F.min,
    "MAX": F.max,
    "STDDEV": F.stddev_samp,
}
QUANTILES = {
    "MEDIAN": 0.5,
    "PERCENTILE_50": 0.5,
    "PERCENTILE_75": 0.75,
    "PERCENTILE_90": 0.9,
    "PERCENTILE_95": 0.95,
    "PERCENTILE_99": 0.99,
}


def aggregate(
    df: DataFrame,
    aggregations: Sequence[dict],
    group_by: Sequence[str] = (),
    approximate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """``[{"alias", "function", "field"}]`` per group; no group columns give one row.

    Quantiles interpolate like ``percentile_cont``. They are exact and need no large buffer, see
    ``quantiles``; ``approximate=True`` uses one mergeable sketch per group instead.
    """
    if not aggregations:
        raise ValueError("aggregate needs at least one aggregation")
    plain: list[Column] = []
    exact: dict[str, dict[str, float]] = {}
    for a in aggregations:
        name = a["function"].upper()
        if name in PLAIN:
            plain.append(PLAIN[name](col(a["field"])).alias(a["alias"]))
        elif name in QUANTILES and approximate:
            plain.append(F.percentile_approx(col(a["field"]), QUANTILES[name], accuracy).alias(a["alias"]))
        elif name in QUANTILES:
            exact.setdefault(a["field"], {})[a["alias"]] = QUANTILES[name]
        else:
            raise ValueError(f"aggregate function '{a['function']}' is not supported")
    keys = [col(g) for g in group_by]
    parts = []
    if plain or not exact:
        parts.append(df.groupBy(*keys).agg(*plain))
    if exact:
        parts.append(_all_quantiles(df, exact, group_by))
    out = parts[0]
    for part in parts[1:]:
        if group_by:
            out = join_on(out, part, list(group_by))
        else:
            row = part.select(F.struct("*")).scalar()
            out = out.withColumns({c: row[c] for c in part.columns})
    return out.select(*[col(g) for g in group_by], *[col(a["alias"]) for a in aggregations])


def _all_quantiles(df: DataFrame, exact: dict[str, dict[str, float]], group_by: Sequence[str]) -> DataFrame:
    """Quantiles of several fields in one pass: the fields become rows of (field, value) first."""
    if len(exact) == 1:
        ((field, wanted),) = exact.items()
        return quantiles(df, field, wanted, group_by)
    keys = [col(g) for g in group_by]
    values = [F.struct(F.lit(i).alias("f"), col(field).cast("double").alias("v")) for i, field in enumerate(exact)]
    rows = df.select(*keys, F.explode(F.array(*values)).alias("__e")).select(*keys, F.col("__e.f").alias("__f"), F.col("__e.v").alias("__x"))
    found = quantiles(rows, "__x", {a: p for wanted in exact.values() for a, p in wanted.items()}, [*group_by, "__f"])
    own = [F.max(F.when(F.col("__f") == i, col(a))).alias(a) for i, wanted in enumerate(exact.values()) for a in wanted]
    return found.groupBy(*keys).agg(*own)


def quantiles(
    df: DataFrame,
    field: str,
    wanted: dict[str, float],
    group_by: Sequence[str] = (),
    sliced: bool | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, one column per ``{alias: fraction}``.

    Equal values are counted first, then each value gets the range of ranks it covers, and a
    quantile reads only the one or two values around its rank. No task holds a whole group.
    """
    keys = list(group_by)
    names = [col(k) for k in keys]
    # a NULL value weighs nothing but keeps a group of only NULLs in the result
    counts = df.groupBy(*names, col(field).cast("double").alias("__v")).agg(F.count(col(field)).alias("__n"))
    if sliced is None:
        # few rows per group settle it at once; else few distinct values per group do
        sliced = not (groups_fit(df, keys) or groups_fit(counts, keys))
    ranked = prefix_sum(counts, keys, ["__v"], F.col("__n"), "__upto", sliced, unique=True)
    if not sliced:
        sized = ranked.withColumn("__all", F.sum("__n").over(Window.partitionBy(*names)))
    else:
        totals = counts.groupBy(*names).agg(F.sum("__n").alias("__all"))
        sized = join_on(ranked, totals, keys, "inner") if keys else ranked.withColumn("__all", totals.scalar())
    picks = []
    for alias, p in wanted.items():
        place = F.lit(float(p)) * (F.col("__all") - 1)
        low, high = F.floor(place), F.ceil(place)
        first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
        a = F.max(F.when(low.between(first, last), F.col("__v")))
        b = F.max(F.when(high.between(first, last), F.col("__v")))
        frac = F.max(place - low)
        picks.append((a + (b - a) * frac).alias(alias))
    return sized.groupBy(*names).agg(*picks)


def distinct_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct combinations of the fields."""
    return df.select(*[col(f) for f in fields]).distinct()


def aggregate_expressions(df: DataFrame, expressions: dict[str, str], group_by: Sequence[str] = ()) -> DataFrame:
    """``{alias: SQL aggregate}`` per group, for filtered aggregates and ratios.

    For example ``SUM(x) FILTER (WHERE c)`` or ``SUM(a) * 100.0 / NULLIF(SUM(b), 0)``.
    """
    return df.groupBy(*[col(g) for g in group_by]).agg(*[F.expr(e).alias(n) for n, e in expressions.items()])


_MERGE = {"SUM": F.sum, "COUNT": F.sum, "MIN": F.min, "MAX": F.max}


def subtotals(
    df: DataFrame, row_fields: Sequence[str], field: str, function: str = "SUM", alias: str = "value"
) -> DataFrame:
    """Value per row, subtotal per leading row fields and grand total, marked by ``level``.

    ``level`` counts the row fields that are rolled up: 0 is detail. The rows are aggregated once
    at full detail; only that result is expanded for the subtotals.
    """
    kind = function.upper()
    names = [col(f) for f in row_fields]
    if kind == "AVG":
        detail = df.groupBy(*names).agg(F.sum(col(field)).alias("__s"), F.count(col(field)).alias("__n"))
        value = F.sum("__s") / F.nullif(F.sum("__n"), F.lit(0).cast("bigint"))
    elif kind in _MERGE:
        detail = df.groupBy(*names).agg(PLAIN[kind](col(field)).alias("__s"))
        value = _MERGE[kind]("__s")
    else:
        raise ValueError(f"subtotals of '{function}' are not supported")
    level = F.bit_count(F.grouping_id()).alias("level")
    return detail.rollup(*names).agg(value.alias(alias), level)
