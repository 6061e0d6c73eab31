"""Scalar expressions shared by the operators."""

from __future__ import annotations

import re

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column types a workflow may declare.
DECLARED_TYPES = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "DECIMAL": "decimal(38,6)",
    "STRING": "string",
    "BOOL": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
}


def spark_type(declared: str) -> str:
    """Spark name of a declared type; a Spark type name passes through."""
    return DECLARED_TYPES.get(declared.upper(), declared)


def col(name: str) -> Column:
    """Column by exact name, also when the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def ordering(order_by: Iterable) -> list[Column]:
    """Sort expressions, NULLs last in both directions.

    Items are a name, ``(name, "DESC")`` or ``{"field": name, "direction": "DESC"}``.
    """
    out = []
    for item in order_by:
        if isinstance(item, str):
            name, direction = item, "ASC"
        elif isinstance(item, dict):
            name, direction = item["field"], item.get("direction", "ASC")
        else:
            name, direction = item
        descending = direction.upper() == "DESC"
        out.append(col(name).desc_nulls_last() if descending else col(name).asc_nulls_last())
    return out


def order_fields(order_by: Iterable) -> list[str]:
    return [i if isinstance(i, str) else i["field"] if isinstance(i, dict) else i[0] for i in order_by]


def row_hash(columns: Sequence[str], seed: int | None = None) -> Column:
    """64-bit hash of the named columns, the same on every run and partitioning."""
    parts = [col(c) for c in columns]
    if seed is not None:
        parts = [F.lit(seed).cast("bigint"), *parts]
    return F.xxhash64(*parts)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero divisor."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def percent_of(num: Column, den: Column) -> Column:
    return safe_ratio(num.cast("double") * 100.0, den.cast("double"))


_EPOCH = re.compile(r"\bEXTRACT\s*\(\s*EPOCH\s+FROM\s+\(\s*([^()]+?)\s+-\s+([^()]+?)\s*\)\s*\)", re.IGNORECASE)
_CLOCK = re.compile(r"\b(now\s*\(\s*\)|current_timestamp\b(?:\s*\(\s*\))?|current_date\b(?:\s*\(\s*\))?)", re.IGNORECASE)


def readable(expression: str, as_of: str | None = None) -> str:
    """An expression of a definition as Spark SQL.

    ``EXTRACT(EPOCH FROM (a - b))`` becomes seconds between two times; with ``as_of`` the clock is
    replaced by that time, so that a run can be repeated. Quoted text stays as it is.
    """
    parts = re.split(r"('(?:[^']|'')*')", expression)
    for i in range(0, len(parts), 2):
        seconds = r"((unix_micros(CAST(\1 AS TIMESTAMP)) - unix_micros(CAST(\2 AS TIMESTAMP))) / 1000000.0D)"
        parts[i] = _EPOCH.sub(seconds, parts[i])
        if as_of is not None:
            day = lambda m: f"CAST('{as_of}' AS DATE)" if m[1].lower().startswith("current_date") else f"CAST('{as_of}' AS TIMESTAMP_NTZ)"
            parts[i] = _CLOCK.sub(day, parts[i])
    return "".join(parts)


def hours_between(later: Column, earlier: Column) -> Column:
    """Delay in hours, from whole seconds."""
    return (F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / 3600.0


def similarity(a: Column, b: Column) -> Column:
    """``1 - levenshtein / longer length``: equal strings give 1, a NULL gives 0."""
    longer = F.greatest(F.length(a), F.length(b))
    score = F.when(a == b, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longer.cast("double")
    )
    return F.coalesce(score, F.lit(0.0))


def number_label(value: Column, decimals: int = 0, unit: str | None = None, pattern: str | None = None) -> Column:
    """Number as text: grouping when the pattern has a comma, ``%`` scaling, prefix and unit.

    ``#,##0.0`` with unit ``t`` gives ``1,234.5 t``; ``0.0%`` multiplies by 100.
    """
    body = pattern or "#,##0"
    shown = value.cast("double")
    suffix = ""
    if "%" in body:
        shown, suffix = shown * 100.0, "%"
    head = body[: _first_digit_mark(body)].strip()
    grouped = F.format_number(shown, decimals)
    text = grouped if "," in body else F.regexp_replace(grouped, ",", "")
    if head:
        text = F.concat(F.lit(head + " "), text)
    if suffix:
        text = F.concat(text, F.lit(suffix))
    return F.concat(text, F.lit(" " + unit)) if unit and not suffix else text


def _first_digit_mark(pattern: str) -> int:
    marks = [pattern.find(m) for m in "#0" if m in pattern]
    return min(marks) if marks else len(pattern)


def try_cast(df: DataFrame, field: str, to_type: str, alias: str | None = None) -> DataFrame:
    """Cast with NULL on bad input instead of an error."""
    return df.withColumn(alias or field, col(field).try_cast(spark_type(to_type)))


def cast_losses(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """One row per cast: how many non-NULL values the cast would turn into NULL."""
    row = df.agg(
        *[
            F.count_if(col(f).isNotNull() & col(f).try_cast(spark_type(t)).isNull()).alias(f"lost_{i}")
            for i, (f, t) in enumerate(casts.items())
        ]
    )
    entries = [
        F.struct(F.lit(f).alias("field"), F.lit(t).alias("to_type"), F.col(f"lost_{i}").alias("lost"))
        for i, (f, t) in enumerate(casts.items())
    ]
    return row.select(F.inline(F.array(*entries)))


def glob_regex(pattern: str) -> str:
    """Regular expression of a key glob with ``*``, ``?`` and ``[...]``."""
    out = []
    inside = False
    for ch in pattern:
        if inside:
            out.append(ch)
            inside = ch != "]"
        elif ch == "[":
            inside = True
            out.append(ch)
        elif ch in "*?":
            out.append(".*" if ch == "*" else ".")
        else:
            out.append("\\" + ch if ch in ".^$+(){}|\\" else ch)
    return "^" + "".join(out) + "$"


def schema_table(df: DataFrame, workflow_id: str) -> DataFrame:
    """The schema of ``df`` as rows ``(workflow_id, field, type)``."""
    rows = [(workflow_id, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    fields = T.StructType([T.StructField(n, T.StringType()) for n in ("workflow_id", "field", "type")])
    return df.sparkSession.createDataFrame(rows, fields)
