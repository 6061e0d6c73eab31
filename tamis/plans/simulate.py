"""Run two versions of a definition on the same rows and report what changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators import compare
from tamis.operators.sample import random_rows, sample
from tamis.plans import workflow
from tamis.session import materialize


@dataclass
class Report:
    """``kpis``: values, changes and a decision per KPI; ``rows`` and ``columns``: differences of the outputs by key;
    ``charts``: one row per chart that both versions have; ``schema``: changes of the output columns;
    ``verdict``: one row with the decision and its reasons; ``source``: the rows that both versions saw. KPIs and columns are those of one definition, so few."""

    kpis: DataFrame | None
    rows: DataFrame
    columns: DataFrame
    charts: DataFrame | None
    schema: DataFrame
    verdict: DataFrame | None
    source: DataFrame


def simulate(
    previous: Mapping,
    current: Mapping,
    source: DataFrame,
    keys: Sequence[str],
    size: int | None = 1000,
    seed: int = 42,
    sample_key: Sequence[str] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    targets: DataFrame | None = None,
    tolerance_pct: float = 0.0,
    as_of: str | None = None,
    sampling: Mapping | None = None,
) -> Report:
    """Both versions see the same rows of ``source`` and the same clock.

    ``sampling`` names a strategy with its options, as ``sample`` takes them; without it ``size`` random rows are
    seen, all rows if None. ``keys`` identify a row of the output. A KPI may change by ``tolerance_pct``.
    """
    if sampling is not None:
        seen = sample(source, **{"seed": seed, "key": sample_key, **sampling}).select(*source.columns)
    else:
        seen = source if size is None else random_rows(source, size, seed, sample_key)
    data = materialize(seen, "simulated")
    old, new = (workflow.run(d, source=data, tables=tables, targets=targets, as_of=as_of) for d in (previous, current))
    before, after = materialize(old.last, "before"), materialize(new.last, "after")
    schema = materialize(compare.schema_diff(before, after), "schema")
    kpis = ruling = None
    if old.kpis is not None and new.kpis is not None:
        limits = new.kpis.selectExpr("kpi_id", f"cast({float(tolerance_pct)} AS double) AS threshold", "critical")
        diff = compare.kpi_diff(old.kpis.select("kpi_id", "value"), new.kpis.select("kpi_id", "value"), limits)
        kpis = materialize(compare.kpi_decisions(diff), "decisions")
        ruling = compare.verdict(kpis, schema)
    charts = None
    for viz in current["spec"].get("visualizations", []):
        by = viz["encoding"].get("series")
        if by and any(v["id"] == viz["id"] for v in previous["spec"].get("visualizations", [])):
            one = compare.chart_diff(old.chart(viz["id"]), new.chart(viz["id"]), "series", viz["id"])
            charts = one if charts is None else charts.unionByName(one)
    return Report(kpis, compare.row_diff(before, after, keys), compare.column_diff(before, after, keys), charts, schema, ruling, data)


def simulate_series(
    previous: Mapping, current: Mapping, source: DataFrame, keys: Sequence[str], samplings: Sequence[Mapping], **options
) -> DataFrame:
    """The same comparison on one sample after another, such as a random, a stratified and a golden one.

    One row per sampling: ``step``, ``strategy``, rows seen, output rows ``added``, ``removed`` and ``changed``,
    ``decision`` (NULL without KPIs), ``reasons``, and ``passed``: neither this step nor an earlier one is blocked.
    """
    out = None
    for step, sampling in enumerate(samplings, 1):
        report = simulate(previous, current, source, keys, sampling=sampling, **options)
        moves = report.rows.agg(*[F.count_if(F.col("change") == kind).alias(kind.lower()) for kind in ("ADDED", "REMOVED", "CHANGED")])
        ruling = report.verdict.select("decision", "reasons") if report.verdict is not None else None
        none = F.lit(None)
        row = report.source.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(step).alias("step"),
            F.lit(sampling["strategy"].upper()).alias("strategy"),
            "rows",
            *[moves.select(c).scalar().alias(c) for c in ("added", "removed", "changed")],
            (ruling.select("decision").scalar() if ruling is not None else none.cast("string")).alias("decision"),
            (ruling.select("reasons").scalar() if ruling is not None else none.cast("array<string>")).alias("reasons"),
        )
        out = row if out is None else out.unionByName(row)
    # one row per sampling, so one task is enough
    so_far = Window.partitionBy(F.lit(1)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    blocked = F.coalesce(F.col("decision") == compare.BLOCKED, F.lit(False))
    return materialize(out, "series").withColumn("passed", ~F.bool_or(blocked).over(so_far))
