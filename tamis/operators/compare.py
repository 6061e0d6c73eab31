"""Comparison of two results: KPIs, rows, columns, charts, parity and shadow runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.scalars import col, row_hash
from tamis.operators.aggregate import quantiles
from tamis.operators.ordered import hashable, join_on
from tamis.operators.reshape import top_groups

# Verdicts and marks of a comparison report.
APPROVED = "APPROVED_FOR_DEPLOYMENT"
WARNINGS = "APPROVED_WITH_WARNINGS"
BLOCKED = "BLOCKED"
SAME_COLUMN = "IDENTIQUE"
NEW_COLUMN = "NOUVEAU"
LOST_COLUMN = "DISPARU"
CHANGED_COLUMN = "MODIFIE"
# Type changes that lose nothing, narrow to wide.
WIDENINGS = [
    ("tinyint", "smallint"),
    ("tinyint", "int"),
    ("tinyint", "bigint"),
    ("smallint", "int"),
    ("smallint", "bigint"),
    ("int", "bigint"),
    ("int", "double"),
    ("float", "double"),
    ("date", "timestamp"),
]
ROW_TOLERANCE = 0.0001
SHADOW_LIMIT_PCT = 1.0
PARITY_LIMIT_PCT = 0.5


def row_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Every distinct row with ``change`` ADDED, REMOVED or SAME and how many ``copies`` changed so.

    Both sides are counted in one grouping, so copies are compared as a multiset and equal rows
    collapse before the shuffle.
    """
    names = previous.columns
    both = previous.withColumns({"__p": F.lit(1), "__c": F.lit(0)}).unionByName(
        current.withColumns({"__p": F.lit(0), "__c": F.lit(1)})
    )
    counted = both.groupBy(*[col(n) for n in names]).agg(F.sum("__p").alias("__p"), F.sum("__c").alias("__c"))
    entry = lambda name, copies: F.struct(F.lit(name).alias("change"), copies.alias("copies"))
    kept = F.least("__p", "__c")
    marked = counted.withColumn(
        "__m",
        F.filter(
            F.array(entry("REMOVED", F.col("__p") - kept), entry("ADDED", F.col("__c") - kept), entry("SAME", kept)),
            lambda m: m["copies"] > 0,
        ),
    )
    return marked.select(*[col(n) for n in names], F.inline("__m"))


def kpi_diff(previous: DataFrame, current: DataFrame, limits: DataFrame | None = None, threshold: float = 0.0, keys: Sequence[str] = ("kpi_id",)) -> DataFrame:
    """KPI by KPI: both values, absolute and relative change, and whether it stays in tolerance.

    ``previous`` and ``current`` hold keys and ``value``; ``limits`` holds keys, ``threshold`` (in
    percent) and ``critical``. A KPI missing on one side is out of tolerance.
    """
    names = [col(k) for k in keys]
    tagged = previous.select(*names, F.lit(0).alias("__s"), col("value")).unionByName(
        current.select(*names, F.lit(1).alias("__s"), col("value"))
    )
    diff = tagged.groupBy(*names).agg(
        F.max(F.when(F.col("__s") == 0, F.col("value"))).cast("double").alias("previous"),
        F.max(F.when(F.col("__s") == 1, F.col("value"))).cast("double").alias("current"),
    )
    if limits is not None:
        given = limits.select(*names, col("threshold").alias("__t"), col("critical").alias("__k"))
        diff = join_on(diff, given, list(keys))
    else:
        diff = diff.withColumns({"__t": F.lit(None).cast("double"), "__k": F.lit(False)})
    change = F.col("current") - F.col("previous")
    pct = change / F.nullif(F.abs("previous"), F.lit(0.0)) * 100.0
    limit = F.coalesce(F.col("__t").cast("double"), F.lit(float(threshold)))
    inside = F.coalesce(F.when(change == 0, F.lit(True)).otherwise(F.abs(pct) <= limit), F.lit(False))
    return diff.select(
        *names,
        "previous",
        "current",
        change.alias("delta_abs"),
        pct.alias("delta_pct"),
        limit.alias("threshold"),
        inside.alias("within_threshold"),
        F.coalesce("__k", F.lit(False)).alias("critical"),
    )


def kpi_decisions(diff: DataFrame) -> DataFrame:
    """OK inside the tolerance; outside BREACH for a critical KPI, else WARN."""
    decision = F.when(F.col("within_threshold"), "OK").when(F.col("critical"), "BREACH").otherwise("WARN")
    return diff.withColumn("decision", decision)


def verdict(decisions: DataFrame, schema_changes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per comparison: decision, ``within_threshold`` and the sorted reasons.

    A comparison has at most as many reasons as its definition has KPIs and its output columns.
    """
    names = [col(k) for k in keys]
    lost = F.col("decision") == "BREACH"
    events = decisions.select(
        *names,
        lost.alias("__block"),
        (F.col("decision") == "WARN").alias("__warn"),
        F.when(lost, F.concat(F.lit("kpi."), F.col("kpi_id"), F.lit(".breach")))
        .when(F.col("decision") == "WARN", F.concat(F.lit("kpi."), F.col("kpi_id"), F.lit(".warn")))
        .alias("__reason"),
    )
    if schema_changes is not None:
        events = events.unionByName(
            schema_changes.select(
                *names,
                F.col("blocking").alias("__block"),
                F.lit(False).alias("__warn"),
                F.when(
                    F.col("blocking"), F.concat(F.lit("schema."), F.col("field"), F.lit("."), F.lower("change"))
                ).alias("__reason"),
            )
        )
    found = events.groupBy(*names).agg(
        F.coalesce(F.bool_or("__block"), F.lit(False)).alias("__block"),
        F.coalesce(F.bool_or("__warn"), F.lit(False)).alias("__warn"),
        F.sort_array(F.collect_list("__reason")).alias("reasons"),
    )
    decision = F.when(F.col("__block"), BLOCKED).when(F.col("__warn"), WARNINGS).otherwise(APPROVED)
    return found.select(*names, decision.alias("decision"), (~F.col("__block")).alias("within_threshold"), "reasons")


def _close(a: Column, b: Column, numeric: bool, tolerance: float) -> Column:
    if not numeric:
        return a.eqNullSafe(b)
    near = F.abs(a.cast("double") - b.cast("double")) <= F.abs(a.cast("double")) * F.lit(tolerance)
    return F.coalesce(a.eqNullSafe(b) | near, F.lit(False))


def _paired(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides by key as structs ``p`` and ``c``, without an outer join."""
    names = [col(k) for k in keys]

    def side(df: DataFrame, tag: str, other: str, other_df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        missing = [f for f in other_df.schema.fields if f.name not in keys]
        return df.select(
            *names,
            F.struct(*[col(c) for c in rest], F.lit(True).alias("__here")).alias(tag),
            F.lit(None)
            .cast(T.StructType([*missing, T.StructField("__here", T.BooleanType())]))
            .alias(other),
        )

    both = side(previous, "p", "c", current).unionByName(side(current, "c", "p", previous))
    return both.groupBy(*names).agg(
        F.first("p", ignorenulls=True).alias("p"),
        F.first("c", ignorenulls=True).alias("c"),
        F.greatest(F.count("p"), F.count("c")).alias("__copies"),
    )


def row_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str], tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Per key: ADDED, REMOVED, CHANGED or SAME, and the changed columns.

    Numbers may differ by ``tolerance`` of the previous value. Keys must be unique on both sides; a
    repeated key is reported as DUPLICATED, use ``row_changes`` for such data.
    """
    numbers = {f.name for f in previous.schema.fields if isinstance(f.dataType, T.NumericType)}
    shared = [c for c in previous.columns if c in current.columns and c not in keys]
    pairs = _paired(previous, current, keys)
    changed = F.array_compact(
        F.array(
            *[
                F.when(~_close(F.col("p")[c], F.col("c")[c], c in numbers, tolerance), F.lit(c))
                for c in shared
            ]
        )
        if shared
        else F.array().cast("array<string>")
    )
    out = pairs.withColumn("changed", changed)
    state = (
        F.when(F.col("__copies") > 1, "DUPLICATED")
        .when(F.col("p").isNull(), "ADDED")
        .when(F.col("c").isNull(), "REMOVED")
        .when(F.size("changed") > 0, "CHANGED")
        .otherwise("SAME")
    )
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    return out.select(
        *[col(k) for k in keys],
        state.alias("change"),
        F.when(both, F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed"),
    )


def column_diff(
    previous: DataFrame, current: DataFrame, keys: Sequence[str], tolerance: float = ROW_TOLERANCE, approximate: bool = False
) -> DataFrame:
    """Per column: distinct values before and after, rows that differ, and a status mark.

    Exact distinct counts expand each row once per column. ``approximate`` counts by sketches that
    merge (standard error 1 %), so wide tables are read once with nothing to shuffle but a sketch per
    column and task; rows that differ and the marks stay exact.
    """
    distinct = (lambda c: F.approx_count_distinct(col(c), 0.01)) if approximate else (lambda c: F.count_distinct(col(c)))
    numbers = {f.name for f in previous.schema.fields if isinstance(f.dataType, T.NumericType)}
    names = list(dict.fromkeys([*previous.columns, *current.columns]))
    old = previous.agg(*[distinct(c).alias(c) for c in previous.columns])
    new = current.agg(*[distinct(c).alias(c) for c in current.columns])
    shared = [c for c in previous.columns if c in current.columns and c not in keys]
    pairs = _paired(previous, current, keys)
    lonely = F.count_if(F.col("p").isNull() | F.col("c").isNull())
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    diffs = pairs.agg(
        F.struct(
            lonely.alias("__keys"),
            *[
                F.count_if(both & ~_close(F.col("p")[c], F.col("c")[c], c in numbers, tolerance)).alias(c)
                for c in shared
            ],
        )
    ).scalar()
    before, after = old.select(F.struct("*")).scalar(), new.select(F.struct("*")).scalar()
    none = F.lit(None).cast("bigint")
    entries = []
    for c in names:
        differing = diffs[c] if c in shared else diffs["__keys"] if c in keys else none
        if c not in previous.columns:
            mark = F.lit(NEW_COLUMN)
        elif c not in current.columns:
            mark = F.lit(LOST_COLUMN)
        else:
            mark = F.when(differing == 0, SAME_COLUMN).otherwise(CHANGED_COLUMN)
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                (before[c] if c in previous.columns else none).alias("distinct_before"),
                (after[c] if c in current.columns else none).alias("distinct_after"),
                differing.alias("rows_differing"),
                mark.alias("status"),
            )
        )
    return previous.sparkSession.range(1).select(F.inline(F.array(*entries)))


def shadow_divergence(
    served: DataFrame, shadow: DataFrame, limit_pct: float = SHADOW_LIMIT_PCT, run_field: str = "run_at"
) -> DataFrame:
    """Per KPI: the 95th percentile over runs of the relative gap in percent, and whether it passes.

    Both inputs hold ``(kpi_id, run, value)``.
    """
    other = shadow.select(col("kpi_id"), col(run_field), col("value").cast("double").alias("__v"))
    pairs = join_on(served.select("kpi_id", run_field, "value"), other, ["kpi_id", run_field], "inner")
    base = F.abs(F.col("value").cast("double"))
    gap = F.abs(F.col("__v") - F.col("value")) / F.nullif(base, F.lit(0.0)) * 100.0
    measured = pairs.withColumn("gap", F.when(F.col("__v") == F.col("value"), F.lit(0.0)).otherwise(gap))
    p95 = quantiles(measured, "gap", {"p95": 0.95}, ["kpi_id"])
    runs = measured.groupBy("kpi_id").agg(F.count(F.lit(1)).alias("runs"), F.max("gap").alias("worst"))
    return join_on(runs, p95, ["kpi_id"]).withColumn("passes", F.col("p95") < limit_pct)


def parity_checks(
    legacy: DataFrame,
    current: DataFrame,
    dimensions: Sequence[str],
    value: str,
    limit_pct: float = PARITY_LIMIT_PCT,
    n: int = 5,
) -> DataFrame:
    """Rows ``(check, legacy, current, passes)``: total gap, same top ``n``, same cardinalities."""

    def facts(df: DataFrame) -> DataFrame:
        return df.agg(
            F.struct(
                F.sum(col(value)).cast("double").alias("total"),
                *[F.count_distinct(col(d)).alias(f"n_{i}") for i, d in enumerate(dimensions)],
            )
        )

    def leaders(df: DataFrame) -> DataFrame:
        best = top_groups(df, [dimensions[0]], "SUM", value, n)
        return best.agg(F.array_join(F.sort_array(F.collect_list(col(dimensions[0]).cast("string"))), ", "))

    a, b = facts(legacy).scalar(), facts(current).scalar()
    top_a, top_b = leaders(legacy).scalar(), leaders(current).scalar()
    gap = F.abs(b["total"] - a["total"]) / F.nullif(F.abs(a["total"]), F.lit(0.0)) * 100.0
    row = lambda name, x, y, ok: F.struct(
        F.lit(name).alias("check"), x.cast("string").alias("legacy"), y.cast("string").alias("current"), ok.alias("passes")
    )
    total = lambda t: F.round(t, 2).cast("decimal(38,2)")
    entries = [
        row("total", total(a["total"]), total(b["total"]), F.coalesce(gap < limit_pct, F.lit(False))),
        row(f"top_{n}", top_a, top_b, top_a.eqNullSafe(top_b)),
    ]
    entries += [
        row(f"distinct_{d}", a[f"n_{i}"], b[f"n_{i}"], a[f"n_{i}"] == b[f"n_{i}"]) for i, d in enumerate(dimensions)
    ]
    return legacy.sparkSession.range(1).select(F.inline(F.array(*entries)))


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``(rows, digest)``, the same for the same multiset of rows in any order."""
    names = sorted(columns or hashable(df))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_hash(names).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def series_changes(previous: DataFrame, current: DataFrame, series: str) -> DataFrame:
    """``(series, change)`` for the series only one side has: ADDED or REMOVED."""
    tagged = previous.select(col(series).cast("string").alias("series"), F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        current.select(col(series).cast("string").alias("series"), F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    seen = tagged.groupBy("series").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    change = F.when(F.col("p") == 0, "ADDED").otherwise("REMOVED")
    return seen.where(F.col("p") != F.col("c")).select("series", change.alias("change"))


def chart_diff(previous: DataFrame, current: DataFrame, series: str, chart_id: str = "chart") -> DataFrame:
    """One row: structural change, how many series came and went, content before and after.

    The series themselves are the rows of ``series_changes``.
    """
    changes = series_changes(previous, current, series).agg(
        F.struct(
            F.count_if(F.col("change") == "ADDED").alias("added"),
            F.count_if(F.col("change") == "REMOVED").alias("removed"),
        )
    ).scalar()
    before = content_hash(previous).select(F.struct("*")).scalar()
    after = content_hash(current).select(F.struct("*")).scalar()
    shape = previous.dtypes != current.dtypes
    return previous.sparkSession.range(1).select(
        F.lit(chart_id).alias("chart_id"),
        (F.lit(shape) | (changes["added"] + changes["removed"] > 0)).alias("structural_change"),
        changes["added"].alias("series_added"),
        changes["removed"].alias("series_removed"),
        before["digest"].alias("hash_before"),
        after["digest"].alias("hash_after"),
        (before["digest"] != after["digest"]).alias("data_changed"),
    )


def schema_diff(previous: DataFrame, current: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Output columns ADDED, REMOVED, RENAMED, WIDENED, PRECISION_CHANGED or TYPE_CHANGED."""
    from tamis.functions.scalars import schema_table
    from tamis.operators.drift import detect

    return output_changes(detect(schema_table(previous, "output"), schema_table(current, "output"), threshold)).drop("workflow_id")


def output_changes(drift: DataFrame) -> DataFrame:
    """Drift rows of output schemas by kind of change, for any number of workflows.

    A removed column and a type change that may lose values are ``blocking``.
    """
    old, new = F.col("old_type"), F.col("new_type")
    pair = F.concat(old, F.lit(">"), new)
    widened = pair.isin([f"{a}>{b}" for a, b in WIDENINGS])
    decimals = old.startswith("decimal") & new.startswith("decimal")
    change = (
        F.when(F.col("kind") == "NEW_FIELD", "ADDED")
        .when(F.col("kind") == "REMOVED_FIELD", "REMOVED")
        .when(F.col("kind") == "RENAMED_FIELD", "RENAMED")
        .when(widened, "WIDENED")
        .when(decimals, "PRECISION_CHANGED")
        .otherwise("TYPE_CHANGED")
    )
    out = drift.withColumn("change", change)
    return out.select(
        "workflow_id", "field", "new_field", "change", "old_type", "new_type", F.col("change").isin("REMOVED", "TYPE_CHANGED").alias("blocking")
    )


def golden_breaches(values: DataFrame, expected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """KPIs whose value is missing or further than the tolerance from the expected one.

    ``expected`` holds ``(kpi_id, expected)`` and optionally ``tolerance``.
    """
    own = "tolerance" in expected.columns
    want = expected.select("kpi_id", "expected", (F.col("tolerance") if own else F.lit(tolerance)).cast("double").alias("tolerance"))
    joined = join_on(want, values.select("kpi_id", F.col("value").cast("double").alias("value")), ["kpi_id"])
    ok = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    return joined.where(~F.coalesce(ok, F.lit(False)))
