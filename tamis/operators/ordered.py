"""Ordered prefix sums and row numbers that no single hot group can choke.

A window partitioned by a key sends the whole group to one task. When a group is larger than
``spark.tamis.maxGroupRows`` the rows are cut into range slices of ``(keys, order)`` instead: the
window then runs per ``(keys, slice)``, and the sum of the earlier slices of the group is added.
Only the first group of a slice can have earlier slices, so that carry table has at most one row
per slice and is safe to broadcast whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.scalars import col, order_fields, ordering, row_hash
from tamis.session import KEYLESS_ROWS, materialize, max_group_rows

SLICE = "__slice"
SPREAD = "__spread"


def groups_fit(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when no group of ``keys`` holds more than ``limit`` rows.

    A partial count per key; a single number reaches the driver.
    """
    if limit is None:
        limit = max_group_rows(df.sparkSession)
        limit = limit if keys else min(limit, KEYLESS_ROWS)
    if not keys:
        return df.count() <= limit
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) <= limit


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """NULL-safe join on equally named keys; the right side's copies are dropped."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[_q(k)].eqNullSafe(renamed[_q(f"__r_{k}")])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence,
    weight: Column,
    alias: str,
    sliced: bool | None = None,
    unique: bool = False,
) -> DataFrame:
    """Sum of ``weight`` over the rows of the group up to and with this one.

    ``order_by`` should be total within a group, else the order of ties is free; ``unique`` says
    that there are no ties. ``sliced`` forces (True) or forbids (False) the cut into range slices;
    None checks group sizes.
    """
    keys = list(keys)
    sliced = (not groups_fit(df, keys)) if sliced is None else sliced
    if not sliced:
        win = Window.partitionBy(*[col(k) for k in keys]).orderBy(*ordering(order_by))
        return df.withColumn(alias, F.sum(weight).over(win.rowsBetween(Window.unboundedPreceding, 0)))
    return _sliced_sums(df, keys, order_by, {alias: weight}, unique)


def prefix_sums(df: DataFrame, keys: Sequence[str], order_by: Sequence, weights: dict[str, Column], unique: bool = False) -> DataFrame:
    """Several prefix sums over one cut into range slices."""
    return _sliced_sums(df, list(keys), order_by, weights, unique)


def _sliced_sums(df: DataFrame, keys: list[str], order_by: Sequence, weights: dict[str, Column], unique: bool) -> DataFrame:
    inputs = {f"__w{i}": w for i, w in enumerate(weights.values())}
    work, sums = _slices(df.withColumns(inputs), keys, order_by, {w: F.sum(w) for w in inputs}, unique)
    local = Window.partitionBy(*[col(k) for k in keys], SLICE).orderBy(*ordering(order_by), SPREAD).rowsBetween(Window.unboundedPreceding, 0)
    running = work.withColumns({f"{w}l": F.sum(w).over(local) for w in inputs})
    carried = join_on(running, F.broadcast(_carry(sums, keys, {f"{w}b": F.sum(w) for w in inputs})), [*keys, SLICE])
    totals = {alias: F.col(f"{w}l") + F.coalesce(F.col(f"{w}b"), F.lit(0)) for alias, w in zip(weights, inputs)}
    return carried.withColumns(totals).drop(*[w + x for w in inputs for x in ("", "l", "b")], SLICE, SPREAD)


def running_extreme(
    df: DataFrame, keys: Sequence[str], order_by: Sequence, value: Column, alias: str, largest: bool, unique: bool = False
) -> DataFrame:
    """Running MIN or MAX over range slices, for groups too large for one task."""
    agg = F.max if largest else F.min
    pick = F.greatest if largest else F.least
    keys = list(keys)
    work, parts = _slices(df.withColumn("__w", value), keys, order_by, {"ext": agg("__w")}, unique)
    local = Window.partitionBy(*[col(k) for k in keys], SLICE).orderBy(*ordering(order_by), SPREAD)
    running = work.withColumn("__local", agg("__w").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    carried = join_on(running, F.broadcast(_carry(parts, keys, {"__before": agg("ext")})), [*keys, SLICE])
    return carried.withColumn(alias, pick("__local", "__before")).drop(
        "__local", "__before", "__w", SLICE, SPREAD
    )


def _slices(
    df: DataFrame, keys: list[str], order_by: Sequence, partials: dict[str, Column], unique: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Cut into range slices, stored so that slice numbers never change, and aggregate each one.

    A range cut keeps ties of (keys, order) together, so unless there are none the rows get a
    position first. Positions depend on the order rows arrive in; they are stored before use, so
    that a task that runs again cannot move a row to another slice.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn(SPREAD, F.lit(0) if unique else F.monotonically_increasing_id())
    placed = placed if unique else materialize(placed, "positions")
    cut = (
        placed.repartitionByRange(slices, *[col(k) for k in keys], *ordering(order_by), col(SPREAD))
        .withColumn(SLICE, F.spark_partition_id())
    )
    stored = materialize(cut, "slices")
    sums = stored.groupBy(*[col(k) for k in keys], SLICE).agg(*[c.alias(n) for n, c in partials.items()])
    return stored, sums


def _carry(sums: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per (keys, slice) that has earlier slices: their totals. At most one row per slice."""
    in_order = Window.partitionBy(*[col(k) for k in keys]).orderBy(SLICE)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.withColumns({name: total.over(earlier) for name, total in totals.items()}).withColumn("__nth", F.row_number().over(in_order))
    return spans.where(F.col("__nth") > 1).select(*[col(k) for k in keys], SLICE, *totals)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence,
    alias: str = "rn",
    sliced: bool | None = None,
    tie_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Row number per group, ties in the order of a hash of ``tie_columns`` (default: all)."""
    tie = "__tie"
    hashed = df.withColumn(tie, row_hash(tie_columns or hashable(df)))
    out = prefix_sum(hashed, keys, [*order_by, tie], F.lit(1).cast("bigint"), alias, sliced)
    return out.drop(tie)


def hashable(df: DataFrame) -> list[str]:
    """Columns xxhash64 accepts (all but maps and variants)."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def value_ranks(df: DataFrame, keys: Sequence[str], order_by: Sequence, sliced: bool | None = None) -> DataFrame:
    """One row per distinct (keys, order values) with ``__n``, ``__upto`` and ``__dense``.

    Counting the ties first leaves a frame without hot values; ``__upto - __n + 1`` is RANK,
    ``__dense`` DENSE_RANK, and ``__upto`` over the group size CUME_DIST.
    """
    fields = list(dict.fromkeys([*keys, *order_fields(order_by)]))
    counts = df.groupBy(*[col(f) for f in fields]).agg(F.count(F.lit(1)).alias("__n"))
    if sliced is None:
        sliced = not groups_fit(counts, keys)
    if not sliced:
        win = (
            Window.partitionBy(*[col(k) for k in keys])
            .orderBy(*ordering(order_by))
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return counts.withColumn("__upto", F.sum("__n").over(win)).withColumn(
            "__dense", F.count(F.lit(1)).over(win)
        )
    # one pass for both sums: the pair is packed as decimal(38,0) = rows * 2^50 + distinct values
    pack = (F.col("__n").cast("decimal(38,0)") * F.lit(2**50).cast("decimal(38,0)") + F.lit(1)).cast("decimal(38,0)")
    both = prefix_sum(counts, keys, order_by, pack, "__both", True, unique=True)
    unit = F.lit(2**50).cast("decimal(38,0)")
    return (
        both.withColumn("__upto", F.floor(F.col("__both") / unit).cast("bigint"))
        .withColumn("__dense", (F.col("__both") % unit).cast("bigint"))
        .drop("__both")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence, n: int, alias: str = "rn", salts: int = 32
) -> DataFrame:
    """The first ``n`` rows of each group, numbered, without gathering a group in one task.

    Each group is first cut to its best ``n`` per salt (Spark prunes again before the shuffle),
    so the last step sees at most ``salts * n`` rows of a group.
    """
    names = [col(k) for k in keys]
    tie = row_hash(hashable(df))
    order = [*ordering(order_by), F.col("__tie")]
    salted = df.withColumn("__tie", tie).withColumn("__salt", F.pmod(F.shiftright("__tie", 40), F.lit(salts)))
    first = salted.withColumn(
        "__near", F.row_number().over(Window.partitionBy(*names, "__salt").orderBy(*order))
    ).where(F.col("__near") <= n)
    last = first.withColumn(alias, F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return last.where(F.col(alias) <= n).drop("__tie", "__salt", "__near")
