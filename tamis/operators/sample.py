"""Reproducible samples: the same seed gives the same rows on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.scalars import col, row_hash
from tamis.operators.ordered import hashable, join_on, top_per_group
from tamis.operators.project import in_period
from tamis.operators.reshape import top_n
from tamis.session import materialize

# The sampling strategies and the size limits of a simulation.
STRATEGIES = ("RANDOM", "STRATIFIED", "FIRST_N", "LAST_N", "PERIOD", "GOLDEN", "BOUNDARY_VALUES", "FULL")
MIN_SIZE = 1
MAX_SIZE = 10_000


def sample(
    df: DataFrame,
    strategy: str,
    size: int = 1000,
    seed: int = 42,
    key: Sequence[str] | None = None,
    strata: str | None = None,
    order_by: Sequence = (),
    period: dict | None = None,
    golden: DataFrame | None = None,
) -> DataFrame:
    """Sample by name of strategy. PERIOD, GOLDEN, BOUNDARY_VALUES and FULL do not use ``size``."""
    kind = strategy.upper()
    if kind not in STRATEGIES:
        raise ValueError(f"sampling strategy '{strategy}' is not supported")
    if not MIN_SIZE <= size <= MAX_SIZE:
        raise ValueError(f"sample size must lie between {MIN_SIZE} and {MAX_SIZE}")
    if kind == "RANDOM":
        return random_rows(df, size, seed, key)
    if kind == "STRATIFIED":
        if strata is None:
            raise ValueError("a stratified sample needs the strata column")
        return stratified(df, strata, size, seed, key)
    if kind == "FIRST_N":
        return first_n(df, order_by, size)
    if kind == "LAST_N":
        return last_n(df, order_by, size)
    if kind == "PERIOD":
        return in_period(df, **(period or {}))
    if kind == "GOLDEN":
        if golden is None:
            raise ValueError("a golden sample needs the golden dataset")
        return golden
    if kind == "BOUNDARY_VALUES":
        return boundary_values(df, key=key)
    return df


def _rank_hash(df: DataFrame, seed: int, key: Sequence[str] | None) -> Column:
    return row_hash(key or hashable(df), seed)


def _cut(share: Column) -> Column:
    """Hash below which about this share of the rows lies."""
    bounded = F.least(share, F.lit(1.0))
    return F.when(bounded >= 1.0, F.lit(2**63 - 1)).otherwise(
        (bounded * F.lit(2.0**64) - F.lit(2.0**63)).cast("bigint")
    )


def _spare(size: Column) -> Column:
    """Ten standard deviations above ``size``, so that a cut practically never falls short."""
    return size + 10 * F.sqrt(size.cast("double")) + 50


def random_rows(df: DataFrame, size: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``min(size, rows)`` rows: those with the smallest hash of key and seed.

    ``key`` should identify a row; without one all columns are hashed. Each task keeps its ``size``
    best rows only, so no more than that meets in the last step.
    """
    hashed = df.withColumn("__h", _rank_hash(df, seed, key))
    tie = F.xxhash64(*[col(c) for c in hashable(df)])
    return hashed.orderBy("__h", tie).limit(size).drop("__h")


def stratum_quotas(df: DataFrame, strata: str, size: int) -> DataFrame:
    """``(stratum, rows, quota)``: shares of ``size`` by largest remainder, so quotas add up to it.

    Equal remainders go to the larger stratum, then by its name. At most ``size`` quotas are above
    0, but the number of strata itself is not limited.
    """
    counts = df.groupBy(col(strata).alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    take = F.least(F.lit(size).cast("bigint"), total)
    exact = F.col("rows") * take
    shared = counts.withColumn("__base", F.floor(exact / total).cast("bigint")).withColumn(
        "__rest", (exact % total).cast("bigint")
    )
    left = shared.agg(F.max(take) - F.sum("__base")).scalar()
    # fewer than `size` strata can gain a row, so the best `size` remainders decide it
    best = top_n(shared.where(F.col("__rest") > 0), [("__rest", "DESC"), ("rows", "DESC"), "stratum"], size)
    placed = best.withColumn(
        "__nth",
        F.row_number().over(
            Window.orderBy(F.col("__rest").desc(), F.col("rows").desc(), F.col("stratum").asc_nulls_last())
        ),
    )
    gains = placed.where(F.col("__nth") <= left).select("stratum", F.lit(1).alias("__gain"))
    out = join_on(shared, gains, ["stratum"])
    return out.select("stratum", "rows", (F.col("__base") + F.coalesce("__gain", F.lit(0))).alias("quota"))


def stratified(df: DataFrame, strata: str, size: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """``min(size, rows)`` rows that keep the shares of one column.

    Each task keeps the ``size`` best rows of a stratum at most. At most ``size`` strata have a
    quota, which bounds the broadcast.
    """
    wanted = stratum_quotas(df, strata, size).where(F.col("quota") > 0)
    quotas = materialize(wanted.select(F.col("stratum").alias("__s"), "quota", "rows"), "quotas")
    hashed = df.withColumn("__h", _rank_hash(df, seed, key))
    joined = hashed.join(F.broadcast(quotas), col(strata).eqNullSafe(F.col("__s")), "inner")
    best = top_per_group(joined, [strata], ["__h"], size, "__rn").where(F.col("__rn") <= F.col("quota"))
    return best.select(*[col(c) for c in df.columns])


def first_n(df: DataFrame, order_by: Sequence, size: int) -> DataFrame:
    return top_n(df, order_by, size)


def last_n(df: DataFrame, order_by: Sequence, size: int) -> DataFrame:
    """The last rows in the given order."""
    flipped = []
    for item in order_by:
        if isinstance(item, str):
            flipped.append((item, "DESC"))
        else:
            name, direction = (item["field"], item["direction"]) if isinstance(item, dict) else item
            flipped.append((name, "ASC" if direction.upper() == "DESC" else "DESC"))
    return top_n(df, flipped, size)


def boundary_values(df: DataFrame, columns: Sequence[str] | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """Rows at the edges: a column's MIN or MAX, a NULL in a column, or a repeated key.

    All extremes come from one aggregate. ``boundary`` lists what makes the row a boundary case.
    """
    names = list(columns or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct")])
    edges = df.agg(
        F.struct(
            *[F.min(col(c)).alias(f"lo_{i}") for i, c in enumerate(names)],
            *[F.max(col(c)).alias(f"hi_{i}") for i, c in enumerate(names)],
        )
    ).scalar()
    marks = []
    for i, c in enumerate(names):
        marks.append(F.when(col(c) == edges[f"lo_{i}"], F.lit(f"min:{c}")))
        marks.append(F.when(col(c) == edges[f"hi_{i}"], F.lit(f"max:{c}")))
        marks.append(F.when(col(c).isNull(), F.lit(f"null:{c}")))
    work = df
    if key:
        repeated = df.groupBy(*[col(k) for k in key]).agg(F.count(F.lit(1)).alias("__copies")).where(F.col("__copies") > 1)
        work = join_on(df, repeated, list(key))
        marks.append(F.when(F.col("__copies").isNotNull(), F.lit("duplicate")))
    found = work.withColumn("boundary", F.array_compact(F.array(*marks))).where(F.size("boundary") > 0)
    return found.drop("__copies")
