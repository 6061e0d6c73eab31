"""KPIs: values, targets, status, breaches and tiles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col, number_label, percent_of
from tamis.operators.ordered import number_rows, top_per_group
from tamis.operators.window import window

# Default thresholds in percent of the target, and the polarities.
WARNING_PCT = 75.0
CRITICAL_PCT = 60.0
POLARITIES = ("more_better", "less_better", "neutral")

_TRAILING_WHERE = re.compile(r"^\s*(\w+\s*\(.*\))\s+WHERE\s+(.+)$", re.IGNORECASE | re.DOTALL)


def kpi_expression(text: str) -> str:
    """SQL of a KPI; ``AGG(x) WHERE c`` becomes ``AGG(x) FILTER (WHERE c)``."""
    found = _TRAILING_WHERE.match(text)
    return f"{found.group(1)} FILTER (WHERE {found.group(2)})" if found else text


def kpi_column(df: DataFrame, text: str) -> Column | None:
    """The KPI as an aggregate over ``df``, or None when ``df`` lacks a column it names.

    A plain scalar is taken as the MAX over the rows, so it needs no aggregate function.
    """
    sql = kpi_expression(text)
    errors = []
    for candidate in (F.expr(sql), F.max(F.expr(sql))):
        try:
            df.agg(candidate)
        except AnalysisException as error:
            errors.append(error)
            continue
        return candidate
    if any(str(e.getCondition()).startswith("UNRESOLVED_COLUMN") for e in errors):
        return None
    raise errors[0]  # a fault of the expression itself


def status(
    value: Column, target: Column, polarity: Column, warning_pct: Column | None = None, critical_pct: Column | None = None
) -> Column:
    """OK, WARNING, CRITICAL or NEUTRAL against the target; NULL without a target or value."""
    warn = target * F.coalesce(warning_pct, F.lit(WARNING_PCT)) / 100.0 if warning_pct is not None else target * (WARNING_PCT / 100.0)
    crit = target * F.coalesce(critical_pct, F.lit(CRITICAL_PCT)) / 100.0 if critical_pct is not None else target * (CRITICAL_PCT / 100.0)
    known = value.isNotNull() & target.isNotNull()
    return (
        F.when(polarity == "neutral", F.lit("NEUTRAL"))
        .when(~known, F.lit(None).cast("string"))
        .when((polarity == "less_better") & (value > crit), F.lit("CRITICAL"))
        .when((polarity == "less_better") & (value > warn), F.lit("WARNING"))
        .when((polarity != "less_better") & (value < crit), F.lit("CRITICAL"))
        .when((polarity != "less_better") & (value < warn), F.lit("WARNING"))
        .otherwise(F.lit("OK"))
    )


def kpi_values(df: DataFrame, kpis: Sequence[dict], targets: DataFrame | None = None) -> DataFrame:
    """One row per KPI, all computed in one aggregate over ``df``.

    ``targets`` holds ``(form_id, target_value)`` for targets that a form provides.
    """
    if not kpis:
        raise ValueError("no KPI given")
    aggs, entries = [], []
    for i, kpi in enumerate(kpis):
        value = kpi_column(df, kpi["expression"])
        if value is None:
            raise ValueError(f"KPI '{kpi['id']}' names columns the input does not have")
        aggs.append(value.cast("double").alias(f"v{i}"))
        target = kpi.get("target") or {}
        source = target.get("source", "literal" if "value" in target else None)
        goal = F.lit(None).cast("double")
        if source == "computed":
            computed = kpi_column(df, str(target["value"]))
            if computed is None:
                raise ValueError(f"target of KPI '{kpi['id']}' names columns the input does not have")
            aggs.append(computed.cast("double").alias(f"t{i}"))
            goal = F.col(f"t{i}")
        elif source == "literal" and target.get("value") is not None:
            goal = F.lit(float(target["value"]))
        limits = kpi.get("thresholds") or {}
        fmt = kpi.get("format") or {}
        polarity = kpi.get("polarity", "more_better")
        if polarity not in POLARITIES:
            raise ValueError(f"polarity '{polarity}' is not supported")
        entries.append(
            F.struct(
                F.lit(kpi["id"]).alias("kpi_id"),
                F.lit(kpi.get("label", kpi["id"])).alias("label"),
                F.col(f"v{i}").alias("value"),
                F.lit(fmt.get("unit")).cast("string").alias("unit"),
                number_label(
                    F.col(f"v{i}"), int(fmt.get("decimals", 0)), fmt.get("unit"), fmt.get("pattern")
                ).alias("display"),
                F.lit(polarity).alias("polarity"),
                F.lit(bool(kpi.get("critical", False))).alias("critical"),
                goal.alias("target"),
                F.lit(target.get("formId")).cast("string").alias("form_id"),
                F.lit(float(limits.get("warningPct", WARNING_PCT))).alias("warning_pct"),
                F.lit(float(limits.get("criticalPct", CRITICAL_PCT))).alias("critical_pct"),
            )
        )
    rows = df.agg(*aggs).select(F.inline(F.array(*entries)))
    if targets is not None:
        given = targets.select(col("form_id").alias("__form"), col("target_value").cast("double").alias("__goal"))
        rows = rows.join(given, F.col("form_id") == F.col("__form"), "left")
        rows = rows.withColumn("target", F.coalesce("target", "__goal")).drop("__form", "__goal")
    return with_status(rows).drop("form_id")


def with_status(rows: DataFrame) -> DataFrame:
    """Add ``attainment_pct`` and ``status`` to rows of value, target, polarity and thresholds."""
    return rows.withColumn("attainment_pct", percent_of(F.col("value"), F.col("target"))).withColumn(
        "status",
        status(F.col("value"), F.col("target"), F.col("polarity"), F.col("warning_pct"), F.col("critical_pct")),
    )


def grouped_kpi(
    df: DataFrame,
    dimensions: Sequence[str],
    expression: str,
    target: str | float | None = None,
    polarity: str = "more_better",
    warning_pct: float = WARNING_PCT,
    critical_pct: float = CRITICAL_PCT,
) -> DataFrame:
    """One KPI per combination of dimensions; ``target`` is a number or a SQL aggregate."""
    aggs = [F.expr(kpi_expression(expression)).cast("double").alias("value")]
    if isinstance(target, str):
        aggs.append(F.expr(kpi_expression(target)).cast("double").alias("target"))
    rows = df.groupBy(*[col(d) for d in dimensions]).agg(*aggs)
    if not isinstance(target, str):
        rows = rows.withColumn("target", F.lit(target).cast("double"))
    rows = rows.withColumns(
        {
            "polarity": F.lit(polarity),
            "warning_pct": F.lit(float(warning_pct)),
            "critical_pct": F.lit(float(critical_pct)),
        }
    )
    return with_status(rows).drop("polarity", "warning_pct", "critical_pct")


def breaches(history: DataFrame, run_field: str = "run_at", keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    """Runs whose status is WARNING or CRITICAL, with the previous run's value.

    ``history`` holds one row per KPI and run: keys, run, value, target, polarity, warning_pct,
    critical_pct. ``threshold`` is the limit that was crossed.
    """
    seen = window(history, "previous", "LAG", list(keys), [run_field], "value")
    rated = with_status(seen).where(F.col("status").isin("WARNING", "CRITICAL"))
    pct = F.when(F.col("status") == "CRITICAL", F.col("critical_pct")).otherwise(F.col("warning_pct"))
    change = (F.col("value") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0)) * 100.0
    return rated.select(
        *[col(k) for k in keys],
        col(run_field),
        F.col("previous"),
        F.col("value").alias("current"),
        change.alias("delta_pct"),
        (F.col("target") * pct / 100.0).alias("threshold"),
        F.col("polarity"),
        F.col("status").alias("severity"),
    )


def tiles(series: DataFrame, keys: Sequence[str], period: str, value: str, points: int | None = None) -> DataFrame:
    """Latest value per key, change against the period before, trend and the series of all periods.

    ``points`` asks for the last periods only; they are then cut before they are put into one array.
    A series is one value of the result, so it should be a series to look at, not raw events.
    """
    if points is None:
        recent = number_rows(series, keys, [(period, "DESC")], "__n")
    else:
        recent = top_per_group(series, keys, [(period, "DESC")], max(2, points), "__n")
    names = [col(k) for k in keys]
    now = F.max(F.when(F.col("__n") == 1, col(value)))
    before = F.max(F.when(F.col("__n") == 2, col(value)))
    trail = F.sort_array(F.collect_list(F.when(F.col("__n") <= (points or F.col("__n")), F.struct(col(period).alias("p"), col(value).alias("v")))))
    packed = recent.groupBy(*names).agg(
        now.alias("value"),
        before.alias("previous"),
        F.transform(trail, lambda e: e["v"]).alias("series"),
    )
    delta = (F.col("value") - F.col("previous")) / F.nullif(F.col("previous").cast("double"), F.lit(0.0)) * 100.0
    shown = packed.withColumn("delta_pct", delta)
    trend = F.when(F.col("delta_pct") > 0, "up").when(F.col("delta_pct") < 0, "down").otherwise("flat")
    return shown.withColumn("trend", trend)
