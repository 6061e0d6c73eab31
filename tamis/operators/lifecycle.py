"""Reports over the control tables: versions, approvals, simulations, deployments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col
from tamis.operators.ordered import join_on
from tamis.operators.window import window

# The deployment gate.
APPROVALS = 1
APPROVALS_CRITICAL = 2
SIMULATION_MAX_DAYS = 7


# The reasons a gate gives.
TOO_FEW = "Approvals: "
NO_SIMULATION = "No simulation found for this version"
OLD_SIMULATION = "Simulation older than {days} days"
NEEDS_SHADOW = "Critical workflow requires SHADOW strategy first"


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest order per key, as a partial aggregate: no group is ever sorted.

    NULL orders lowest, as in ``ORDER BY ... DESC NULLS LAST``.
    """
    best = F.max_by(F.struct(*[col(c) for c in df.columns]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*[col(k).alias(f"__{k}") for k in keys]).agg(best.alias("__b")).select("__b.*")


def active_versions(versions: DataFrame) -> DataFrame:
    """Per workflow the DEPLOYED version deployed last."""
    deployed = versions.where(F.col("status") == "DEPLOYED")
    return latest(deployed, ["workflow_id"], [F.col("deployed_at"), F.col("version_id")])


def reference_versions(versions: DataFrame) -> DataFrame:
    """Per workflow the newest DEPLOYED version, or the newest of any status if none is."""
    return latest(
        versions, ["workflow_id"], [F.col("status") == "DEPLOYED", F.col("created_at"), F.col("version_id")]
    )


def approval_counts(approvals: DataFrame) -> DataFrame:
    return approvals.groupBy("version_id").agg(F.count_distinct("approver_subject").alias("approvals"))


def last_simulations(simulations: DataFrame) -> DataFrame:
    """Per version the end of the last successful simulation."""
    return (
        simulations.where(F.col("status") == "SUCCEEDED").groupBy("version_id").agg(F.max("finished_at").alias("last_simulation"))
    )


def gate_report(
    requests: DataFrame,
    approvals: DataFrame,
    simulations: DataFrame,
    as_of: Column,
    require_simulation: bool = True,
    max_age_days: int = SIMULATION_MAX_DAYS,
) -> DataFrame:
    """Which requested deployments may go ahead, and the reasons against the others.

    ``requests`` holds ``(version_id, is_critical, strategy)``.
    """
    rows = join_on(requests, approval_counts(approvals), ["version_id"])
    rows = join_on(rows, last_simulations(simulations), ["version_id"])
    given = F.coalesce("approvals", F.lit(0).cast("bigint"))
    needed = F.when(F.col("is_critical"), APPROVALS_CRITICAL).otherwise(APPROVALS)
    too_old = F.col("last_simulation") < as_of - F.make_interval(days=F.lit(max_age_days))
    reasons = F.array_compact(
        F.array(
            F.when(
                given < needed,
                F.concat(F.lit(TOO_FEW), given.cast("string"), F.lit("/"), needed.cast("string")),
            ),
            F.when(F.lit(require_simulation) & F.col("last_simulation").isNull(), F.lit(NO_SIMULATION)),
            F.when(too_old, F.lit(OLD_SIMULATION.format(days=max_age_days))),
            F.when(
                F.col("is_critical") & (F.col("strategy") != "SHADOW"),
                F.lit(NEEDS_SHADOW),
            ),
        )
    )
    return rows.withColumn("approvals", given).withColumn("reasons", reasons).withColumn("allowed", F.size("reasons") == 0)


def active_deployments(deployments: DataFrame, versions: DataFrame) -> DataFrame:
    """Per workflow the last completed deployment that was not rolled back."""
    live = deployments.where(F.col("rolled_back_at").isNull() & F.col("completed_at").isNotNull())
    owned = join_on(live, versions.select("version_id", "workflow_id"), ["version_id"], "inner")
    return latest(owned, ["workflow_id"], [F.col("completed_at"), F.col("deployment_id")])


def rollback_targets(versions: DataFrame, failing: DataFrame) -> DataFrame:
    """Per failing ``(workflow_id, version_id)`` the version to restore.

    That is the DEPRECATED version of the workflow deployed last, the failing one excepted. Only the
    best two per workflow can be the answer, so the history is aggregated before the join.
    """
    old = versions.where((F.col("status") == "DEPRECATED") & F.col("deployed_at").isNotNull())
    order = F.struct(F.col("deployed_at").alias("t"), F.col("version_id").alias("v"))
    first = old.groupBy("workflow_id").agg(F.max(order).alias("first"))
    rest = join_on(old, first, ["workflow_id"]).where(order < F.col("first"))
    second = rest.groupBy("workflow_id").agg(F.max(order).alias("second"))
    best = join_on(first, second, ["workflow_id"])
    joined = join_on(failing.select("workflow_id", "version_id"), best, ["workflow_id"], "inner")
    pick = F.when(F.col("first.v") != F.col("version_id"), F.col("first")).otherwise(F.col("second"))
    out = joined.withColumn("__t", pick).where(F.col("__t").isNotNull())
    return out.select(
        "workflow_id",
        F.col("version_id").alias("failing_version"),
        F.col("__t.v").alias("target_version"),
        F.col("__t.t").alias("deployed_at"),
    )


def version_steps(versions: DataFrame, order_by: Sequence = ("created_at", "version_id")) -> DataFrame:
    """Check each version against the one before: +1 on one part, lower parts back to 0.

    ``semver`` is text; a pre-release suffix is ignored, and a step that only drops or changes the
    suffix is valid. ``step`` is FIRST, MAJOR, MINOR, PATCH, SAME or INVALID.
    """
    part = lambda c, i: F.split(F.split(col(c), "-")[0], r"\.")[i].cast("int")
    seen = window(versions, "previous", "LAG", ["workflow_id"], order_by, "semver")
    a, b, c = (part("previous", i) for i in range(3))
    x, y, z = (part("semver", i) for i in range(3))
    step = (
        F.when(F.col("previous").isNull(), "FIRST")
        .when((x == a) & (y == b) & (z == c), "SAME")
        .when((x == a + 1) & (y == 0) & (z == 0), "MAJOR")
        .when((x == a) & (y == b + 1) & (z == 0), "MINOR")
        .when((x == a) & (y == b) & (z == c + 1), "PATCH")
        .otherwise("INVALID")
    )
    return seen.withColumn("step", step).withColumn("valid", F.col("step") != "INVALID")


def status_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("status").agg(F.count(F.lit(1)).alias("versions"))


def workflows_per_project(workflows: DataFrame) -> DataFrame:
    """Workflows that are not archived, per sub-project."""
    return workflows.where(F.col("archived_at").isNull()).groupBy("sub_project").agg(F.count(F.lit(1)).alias("workflows"))
