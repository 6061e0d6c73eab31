"""Live KPI breaches: each micro-batch of KPI values is rated against the run before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.scalars import col
from tamis.operators.kpi import breaches
from tamis.operators.ordered import join_on, top_per_group


def watch_breaches(
    goals: DataFrame, base: str, keep_runs: int, keys: Sequence[str] = ("kpi_id",), run_field: str = "run_at"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``(keys, run, value)`` rows in update mode.

    ``goals`` holds keys, target, polarity, warning_pct and critical_pct. The state between batches
    is the last ``keep_runs`` runs per key: the windows that the stream's lateness can still change,
    and one more. A changed run and the run after it, whose ``previous`` it is, are rated again.
    State and breaches are written per epoch, so a repeated batch replaces itself.
    """
    ids = [*keys, run_field]

    def rate(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = f"{base}/values/epoch={epoch}"
        batch.select(*[col(i) for i in ids], "value").write.mode("overwrite").parquet(fresh)
        now = spark.read.schema(batch.select(*[col(i) for i in ids], "value").schema).parquet(fresh)
        known = now.withColumn("__new", F.lit(True))
        if epoch > 0:
            before = spark.read.schema(now.schema).parquet(f"{base}/state/epoch={epoch - 1}")
            known = before.withColumn("__new", F.lit(False)).unionByName(known)
        pick = F.struct(F.col("__new").alias("new"), F.col("value").alias("value"))
        history = known.groupBy(*[col(i) for i in ids]).agg(F.max_by(pick, F.col("__new").cast("int")).alias("__v"))
        history = history.select(*[col(i) for i in ids], F.col("__v.value").alias("value"), F.col("__v.new").alias("__new"))
        kept = top_per_group(history.drop("__new"), keys, [(run_field, "DESC")], keep_runs, "__n").drop("__n")
        kept.write.mode("overwrite").parquet(f"{base}/state/epoch={epoch}")
        rated = breaches(join_on(history.drop("__new"), goals, list(keys), "inner"), run_field, keys)
        # a key has no more runs here than the state keeps and the batch brings
        before = F.lag("__new", 1, False).over(Window.partitionBy(*[col(k) for k in keys]).orderBy(col(run_field)))
        touched = history.withColumn("__after", before).where(F.col("__new") | F.col("__after")).select(*[col(i) for i in ids])
        touched.write.mode("overwrite").parquet(f"{base}/rated/epoch={epoch}")
        again = spark.read.schema(touched.schema).parquet(f"{base}/rated/epoch={epoch}")
        join_on(rated, again, ids, "left_semi").write.mode("overwrite").parquet(f"{base}/breaches/epoch={epoch}")

    return rate


def runs_within(lateness_seconds: float, window_seconds: float) -> int:
    """How many runs per key the state must keep: the windows still open, one closed, one spare."""
    return int(lateness_seconds // window_seconds) + 3


def latest_breaches(spark: SparkSession, base: str, keys: Sequence[str] = ("kpi_id",), run_field: str = "run_at") -> DataFrame:
    """Breaches as of the last epoch that rated each run.

    A run that a later batch brought back under its limit is left out.
    """
    ids = [*keys, run_field]
    rated = spark.read.parquet(f"{base}/rated").groupBy(*[col(i) for i in ids]).agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{base}/breaches").join(rated, [*ids, "epoch"], "left_semi").drop("epoch")
