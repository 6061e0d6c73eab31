"""Filter, computed columns and recoding."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col, spark_type

_COMPARISONS = {
    "=": Column.__eq__,
    "==": Column.__eq__,
    "!=": Column.__ne__,
    "<>": Column.__ne__,
    "<": Column.__lt__,
    "<=": Column.__le__,
    ">": Column.__gt__,
    ">=": Column.__ge__,
}


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the SQL condition is true."""
    return df.where(F.expr(expression))


def compare(df: DataFrame, field: str, operator: str, literal) -> DataFrame:
    """``field operator literal``; text that reads as a number is compared as a double."""
    if operator not in _COMPARISONS:
        raise ValueError(f"comparison operator '{operator}' is not supported")
    if isinstance(literal, str):
        text = literal.strip("'\"")
        try:
            literal = float(literal)
        except ValueError:
            literal = text
    return df.where(_COMPARISONS[operator](col(field), F.lit(literal)))


_DURATION = re.compile(r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")


def duration_interval(text: str) -> Column:
    """ISO 8601 duration (``P30D``, ``PT5M``) as an interval."""
    found = _DURATION.match(text)
    if not found or not any(found.groups()):
        raise ValueError(f"not an ISO 8601 duration: '{text}'")
    y, mo, w, d, h, mi, s = (int(g or 0) for g in found.groups())
    return F.make_interval(*[F.lit(v) for v in (y, mo, w, d, h, mi, s)])


def in_period(
    df: DataFrame,
    field: str,
    start: str | dt.datetime | Column | None = None,
    end: str | dt.datetime | Column | None = None,
    last: str | None = None,
    as_of: str | dt.datetime | Column | None = None,
) -> DataFrame:
    """Rows whose time lies in ``[start, end]``, or in the ISO duration ``last`` before ``as_of``.

    ``as_of`` is explicit so that the same call gives the same rows on every day.
    """
    kind = dict(df.dtypes)[field]
    at = lambda v: v if isinstance(v, Column) else F.lit(v).cast(kind)
    if last is not None:
        if as_of is None:
            raise ValueError("a rolling period needs as_of")
        end = at(as_of)
        start = end - duration_interval(last)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (col(field) >= at(start))
    if end is not None:
        cond = cond & (col(field) <= at(end))
    return df.where(cond)


def current_period(df: DataFrame, field: str, unit: str, as_of: str | dt.datetime | Column) -> DataFrame:
    """Rows from the start of the running week, month, ... up to ``as_of``; weeks start on Monday."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return df.where(col(field).between(F.date_trunc(unit, end), end))


def computed(df: DataFrame, alias: str, expression: str, type: str | None = None) -> DataFrame:
    """Add or replace a column by a SQL expression, cast to the declared type."""
    value = F.expr(expression)
    return df.withColumn(alias, value.cast(spark_type(type)) if type else value)


def recode(df: DataFrame, field: str, alias: str, mapping: Mapping, default=None) -> DataFrame:
    """Replace codes by labels; an unknown code gives ``default``.

    Keys are compared as text and all results take one type: double when every value is a number,
    else string. Of keys that are equal as text the first counts.
    """
    if not mapping:
        raise ValueError(f"recode of '{field}' needs a mapping")
    values = [v for v in [*mapping.values(), default] if v is not None]
    numeric = bool(values) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    kind = "double" if numeric else "string"
    lit = lambda v: F.lit(None).cast(kind) if v is None else F.lit(v).cast(kind)
    code = col(field).cast("string")
    first: dict[str, object] = {}
    for key, value in mapping.items():
        first.setdefault(str(key), value)
    # a struct as value tells a NULL label from an unknown code
    table = F.create_map(*[c for k, v in first.items() for c in (F.lit(k), F.struct(lit(v).alias("label")))])
    found = F.try_element_at(table, code)
    return df.withColumn(alias, F.when(found.isNotNull(), found["label"]).otherwise(lit(default)))


def recode_by_table(
    df: DataFrame, field: str, alias: str, table: DataFrame, code: str, label: str, default=None
) -> DataFrame:
    """Recode by a lookup table with unique codes; Spark broadcasts it when it is small."""
    lookup = table.select(col(code).cast("string").alias("__code"), col(label).alias("__label"), F.lit(1).alias("__hit"))
    joined = df.join(lookup, col(field).cast("string") == F.col("__code"), "left")
    value = F.when(F.col("__hit").isNotNull(), F.col("__label")).otherwise(
        F.lit(default).cast(dict(lookup.dtypes)["__label"])
    )
    return joined.withColumn(alias, value).drop("__code", "__label", "__hit")
