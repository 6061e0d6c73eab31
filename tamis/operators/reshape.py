"""Pivot, unpivot, sorting, paging and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.functions.scalars import col, ordering, row_hash
from tamis.operators.aggregate import PLAIN, QUANTILES
from tamis.operators.ordered import SLICE, SPREAD, _slices, hashable
from tamis.session import materialize, scratch_path

# The pivot aggregations of a workflow.
PIVOT_FUNCTIONS = ("SUM", "AVG", "COUNT", "MIN", "MAX")


def column_values(df: DataFrame, field: str, limit: int | None = None) -> list:
    """The values that become columns, sorted. Above Spark's column limit this is an error."""
    limit = limit or int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = df.select(col(field)).where(col(field).isNotNull()).distinct().orderBy(col(field)).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"'{field}' has more than {limit} values, too many for columns")
    return [r[0] for r in rows]


def pivot(
    df: DataFrame,
    row_fields: Sequence[str],
    column_field: str,
    value_field: str,
    aggregation: str = "SUM",
    values: Sequence | None = None,
) -> DataFrame:
    """Long to wide. An absent cell is NULL, for COUNT it is 0."""
    kind = aggregation.upper()
    if kind not in PIVOT_FUNCTIONS:
        raise ValueError(f"pivot aggregation '{aggregation}' is not supported")
    wanted = list(values) if values is not None else column_values(df, column_field)
    rows = [col(f) for f in row_fields]
    wide = df.groupBy(*rows).pivot(column_field, wanted).agg(PLAIN[kind](col(value_field)))
    return wide.fillna(0, [str(v) for v in wanted]) if kind == "COUNT" else wide


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value"
) -> DataFrame:
    """Wide to long, keeping NULL cells."""
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], variable, value)


def sort(df: DataFrame, order_by: Sequence) -> DataFrame:
    """Global order, NULLs last; equal rows follow a row hash, so a hot value can be split."""
    return df.orderBy(*ordering(order_by), row_hash(hashable(df)))


def _page_bounds(number: int, size: int) -> tuple[int, int]:
    return max(1, number), min(max(1, size), 100)


def page(df: DataFrame, order_by: Sequence, number: int = 1, size: int = 20) -> DataFrame:
    """One page of a listing: number at least 1, size held between 1 and 100 (limits of the listing).

    Equal rows follow a row hash, so pages never overlap. Pages up to the one asked for pass through
    the last step; deep listings, or many pages of one listing, are better read from a ``PageIndex``.
    """
    number, size = _page_bounds(number, size)
    return df.orderBy(*ordering(order_by), row_hash(hashable(df))).offset((number - 1) * size).limit(size)


class PageIndex:
    """A sorted listing stored in range slices, each a folder of its own, with the rows before each slice.

    Any page then reads the slices that hold its rows and nothing of the others, however deep it is.
    Rows have the order of ``page``; exact copies of a row are spread over slices like other rows.
    """

    def __init__(self, df: DataFrame, order_by: Sequence):
        tie = "__tie"
        order = [*order_by, tie]
        placed, sums = _slices(df.withColumn(tie, row_hash(hashable(df))), [], order, {"n": F.count(F.lit(1))})
        earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
        self.starts = materialize(sums.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "starts")
        within = F.row_number().over(Window.partitionBy(SLICE).orderBy(*ordering(order), SPREAD))
        rows = placed.join(F.broadcast(self.starts.select(SLICE, "first")), SLICE).withColumn("__row", F.col("first") + within)
        self.path = scratch_path(df.sparkSession, "listing")
        rows.select(*[col(c) for c in df.columns], "__row", SLICE).write.partitionBy(SLICE).parquet(self.path)
        kinds = StructType(list(df.schema.fields)).add("__row", "long").add(SLICE, "integer")
        self.rows, self.columns = df.sparkSession.read.schema(kinds).parquet(self.path), df.columns

    def count(self) -> int:
        return self.starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """One page; the numbers of at most ``size`` slices reach the driver."""
        number, size = _page_bounds(number, size)
        low, high = (number - 1) * size, number * size
        held = self.starts.where((F.col("first") < high) & (F.col("first") + F.col("n") > low))
        slices = [r[0] for r in held.select(SLICE).collect()]
        found = self.rows.where(F.col(SLICE).isin(slices) & F.col("__row").between(low + 1, high))
        return found.orderBy("__row").select(*[col(c) for c in self.columns])


def top_n(df: DataFrame, order_by: Sequence, n: int) -> DataFrame:
    return df.orderBy(*ordering(order_by)).limit(n)


def top_groups(
    df: DataFrame, group_by: Sequence[str], function: str, field: str | None, n: int = 10, alias: str = "value"
) -> DataFrame:
    """The ``n`` groups with the largest aggregate, ties by group name."""
    kind = function.upper()
    if kind in QUANTILES:
        raise ValueError("rank groups by a plain aggregate")
    value = F.count(F.lit(1)) if field is None else PLAIN[kind](col(field))
    grouped = df.groupBy(*[col(g) for g in group_by]).agg(value.alias(alias))
    return top_n(grouped, [(alias, "DESC"), *group_by], n)


def preview(df: DataFrame, rows: int = 5, order_by: Sequence = ()) -> DataFrame:
    """The first rows, ordered when an order is given."""
    return (df.orderBy(*ordering(order_by)) if order_by else df).limit(rows)
