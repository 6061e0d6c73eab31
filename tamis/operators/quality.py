"""Outlier treatment and normalization.

Statistics over a whole frame are one aggregated row read through a scalar subquery, so the rows
themselves are never gathered; statistics per group are a partial aggregate joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col
from tamis.operators.aggregate import quantiles
from tamis.operators.ordered import join_on, value_ranks

# Strategies, actions and methods of a workflow.
BOUND_STRATEGIES = ("HARD_BOUNDS", "XLSFORM_CONSTRAINT")
STATISTIC_STRATEGIES = ("THREE_SIGMA", "IQR")
ACTIONS = ("FLAG", "DROP", "CLAMP")
METHODS = ("ZSCORE", "MIN_MAX", "RANK", "LOG")


def with_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a frame of one row (no keys) or one row per key as column ``__st``."""
    values = [c for c in stats.columns if c not in keys]
    packed = stats.select(*[col(k) for k in keys], F.struct(*[col(v) for v in values]).alias("__st"))
    return join_on(df, packed, list(keys)) if keys else df.withColumn("__st", packed.scalar())


def fences(df: DataFrame, field: str, strategy: str, partition_by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """``lo`` and ``hi`` outside which a value counts as an outlier."""
    names = [col(k) for k in partition_by]
    if strategy == "THREE_SIGMA":
        mean, dev = F.avg(col(field)), F.stddev_samp(col(field))
        return df.groupBy(*names).agg((mean - 3 * dev).alias("lo"), (mean + 3 * dev).alias("hi"))
    if strategy != "IQR":
        raise ValueError(f"outlier strategy '{strategy}' has no computed fences")
    if exact:
        q = quantiles(df, field, {"q1": 0.25, "q3": 0.75}, partition_by)
    else:
        q = df.groupBy(*names).agg(
            F.percentile_approx(col(field), 0.25).alias("q1"), F.percentile_approx(col(field), 0.75).alias("q3")
        )
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select(*names, (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


def outlier(
    df: DataFrame,
    field: str,
    strategy: str,
    lower: float | None = None,
    upper: float | None = None,
    action: str = "FLAG",
    partition_by: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Flag (``{field}_is_outlier``), drop or clamp values outside the fences.

    DROP keeps only rows known to be inside, so a NULL value is dropped; CLAMP keeps NULL.
    """
    strategy, action = strategy.upper(), (action or "FLAG").upper()
    action = "CLAMP" if action == "CAP" else action
    if action not in ACTIONS:
        raise ValueError(f"outlier action '{action}' is not supported")
    x = col(field)
    if strategy in BOUND_STRATEGIES:
        lo = F.lit(float("-inf") if lower is None else float(lower))
        hi = F.lit(float("inf") if upper is None else float(upper))
        work = df
    elif strategy in STATISTIC_STRATEGIES:
        work = with_stats(df, fences(df, field, strategy, partition_by, exact), partition_by)
        lo, hi = F.col("__st.lo"), F.col("__st.hi")
    else:
        raise ValueError(f"outlier strategy '{strategy}' is not supported")
    outside = (x < lo) | (x > hi)
    if action == "FLAG":
        out = work.withColumn(f"{field}_is_outlier", outside)
    elif action == "DROP":
        out = work.where(~outside)
    else:
        out = work.withColumn(field, F.when(x < lo, lo).when(x > hi, hi).otherwise(x.cast("double")))
    return out.drop("__st")


def normalize(df: DataFrame, field: str, method: str, partition_by: Sequence[str] = (), alias: str | None = None) -> DataFrame:
    """``{field}_norm``: z-score, min-max, rank (ascending, NULLs last) or natural logarithm."""
    method = method.upper()
    keys = list(partition_by)
    out = alias or f"{field}_norm"
    x = col(field)
    if method == "LOG":
        return df.withColumn(out, F.ln(x))
    if method == "RANK":
        ranks = value_ranks(df, keys, [field])
        names = list(dict.fromkeys([*keys, field]))
        rank = (F.col("__upto") - F.col("__n") + 1).alias(out)
        return join_on(df, ranks.select(*[col(n) for n in names], rank), names)
    names = [col(k) for k in keys]
    if method == "ZSCORE":
        stats = df.groupBy(*names).agg(F.avg(x).alias("a"), F.stddev_samp(x).alias("b"))
        value = (x - F.col("__st.a")) / F.nullif(F.col("__st.b"), F.lit(0.0))
    elif method == "MIN_MAX":
        stats = df.groupBy(*names).agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"))
        value = (x - F.col("__st.a")) / F.nullif(F.col("__st.b") - F.col("__st.a"), F.lit(0.0))
    else:
        raise ValueError(f"normalization '{method}' is not supported")
    return with_stats(df, stats, keys).withColumn(out, value).drop("__st")

