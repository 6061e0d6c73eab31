"""Schema drift over a whole catalogue of workflows at once.

Schemas are rows ``(workflow_id, field, type)``; drift is rows
``(workflow_id, kind, field, new_field, old_type, new_type, score)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col, similarity, spark_type
from tamis.operators.ordered import join_on
from tamis.session import materialize

THRESHOLD = 0.85
# The default policy and the reasons it gives.
DEFAULT_POLICY = {
    "on_new_field": "REQUIRE_MAPPING",
    "on_removed_field": "BLOCK",
    "on_type_change": "REQUIRE_CAST",
    "on_renamed": "SUGGEST",
}
REASONS = {
    ("REMOVED_FIELD", "BLOCK"): "Field {field} removed from source — blocked by policy",
    ("NEW_FIELD", "BLOCK"): "Field {field} added to source — blocked by policy",
    ("NEW_FIELD", "REQUIRE_MAPPING"): "Field {field} added to source — explicit mapping required",
    ("TYPE_CHANGE", "BLOCK"): "Field {field} type changed {old_type} → {new_type} — blocked by policy",
    ("TYPE_CHANGE", "REQUIRE_CAST"): "Field {field} type changed {old_type} → {new_type} — explicit cast required",
    ("RENAMED_FIELD", "BLOCK"): "Field {field} renamed to {new_field} (similarity={score}) — blocked by policy",
    ("RENAMED_FIELD", "SUGGEST"): "Field {field} likely renamed to {new_field} (similarity={score}) — confirm mapping",
}


def snapshot_fields(versions: DataFrame, workflow_id: str = "workflow_id", snapshot: str = "schema_snapshot") -> DataFrame:
    """Fields of JSON snapshots ``{"f": {"type": t}}`` or ``{"f": "t"}`` as rows."""
    entries = F.explode(F.from_json(col(snapshot), "map<string,string>"))
    rows = versions.select(col(workflow_id).alias("workflow_id"), entries.alias("field", "__t"))
    nested = F.col("__t").startswith("{")
    return rows.select(
        "workflow_id", "field", F.when(nested, F.get_json_object("__t", "$.type")).otherwise(F.col("__t")).alias("type")
    )


def field_changes(snapshot: DataFrame, current: DataFrame, keys: Sequence[str] = ("workflow_id",)) -> DataFrame:
    """NEW_FIELD, REMOVED_FIELD and TYPE_CHANGE rows; fields equal on both sides give none."""
    ids = [*keys, "field"]
    names = [col(k) for k in ids]
    both = snapshot.select(*names, F.lit(0).alias("s"), "type").unionByName(
        current.select(*names, F.lit(1).alias("s"), "type")
    )
    old, new = F.col("s") == 0, F.col("s") == 1
    seen = both.groupBy(*names).agg(
        F.bool_or(old).alias("__old"),
        F.bool_or(new).alias("__new"),
        F.max(F.when(old, F.col("type"))).alias("old_type"),
        F.max(F.when(new, F.col("type"))).alias("new_type"),
    )
    kind = (
        F.when(~F.col("__old"), "NEW_FIELD")
        .when(~F.col("__new"), "REMOVED_FIELD")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "TYPE_CHANGE")
    )
    marked = seen.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return marked.select(*[col(k) for k in keys], "kind", "field", "old_type", "new_type")


def unchanged_fields(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Fields both schemas have, whatever their types."""
    ids = ["workflow_id", "field"]
    return snapshot.select(*ids).distinct().join(current.select(*ids), ids, "left_semi")


def _edits(a: Column, b: Column, threshold: Column) -> Column:
    """Most edits a pair of lengths ``a``, ``b`` may have at this similarity."""
    return F.floor((F.lit(1.0) - threshold) * F.greatest(a, b) + F.lit(1e-9)).cast("int")


def rename_candidates(removed: DataFrame, added: DataFrame) -> DataFrame:
    """All pairs of a removed and an added field of a workflow with similarity at the threshold.

    Inputs are ``(workflow_id, field, threshold)``. With at most ``d`` edits, one of ``d + 1`` equal
    pieces of the added name occurs unchanged in the removed name, at most ``d`` places away. The
    pieces are the join key, so only names that share one are scored, and no pair is missed.
    """
    longest = removed.agg(F.max(F.length("field"))).scalar()
    other_longest = added.agg(F.max(F.length("field"))).scalar()

    def lengths(limit: Column) -> Column:
        n, t = F.length("field"), F.col("threshold")
        low = F.greatest(F.ceil(n * t - 1e-9).cast("int"), F.lit(0))
        high = F.least(F.coalesce(F.floor(n / F.nullif(t, F.lit(0.0)) + 1e-9).cast("int"), limit), limit)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def pieces(df: DataFrame) -> DataFrame:
        """Pieces of the added name of length ``la`` when paired with a name of length ``lr``."""
        d = _edits(F.col("la"), F.col("lr"), F.col("threshold"))
        cut = df.withColumn("d", d).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        short = F.floor(F.col("la") / (F.col("d") + 1)).cast("int")
        first_long = F.col("d") + 1 - F.col("la") % (F.col("d") + 1)
        return cut.withColumn("size", short + F.when(F.col("i") >= first_long, 1).otherwise(0)).withColumn(
            "at", F.col("i") * short + F.greatest(F.col("i") - first_long, F.lit(0))
        )

    key = ["workflow_id", "lr", "la", "i", "piece"]
    right = pieces(
        added.withColumn("lr", F.explode(lengths(longest))).withColumn("la", F.length("field"))
    ).select(
        "workflow_id", "lr", "la", "i", F.substring("field", F.col("at") + 1, F.col("size")).alias("piece"), F.col("field").alias("added")
    )
    left = pieces(
        removed.withColumn("la", F.explode(lengths(other_longest))).withColumn("lr", F.length("field"))
    )
    first = F.greatest(F.col("at") - F.col("d"), F.lit(0))
    last = F.least(F.col("at") + F.col("d"), F.col("lr") - F.col("size"))
    left = left.where(first <= last).withColumn("p", F.explode(F.sequence(first, last)))
    left = left.select(
        "workflow_id",
        "lr",
        "la",
        "i",
        F.substring("field", F.col("p") + 1, F.col("size")).alias("piece"),
        F.col("field").alias("removed"),
        "threshold",
    ).distinct()
    scored = left.join(right, key).select(
        "workflow_id", "removed", "added", "threshold", similarity(F.col("removed"), F.col("added")).alias("score")
    )
    return scored.where(F.col("score") >= F.col("threshold")).drop("threshold").distinct()


def _claims(pairs: DataFrame, blocks: int | None) -> DataFrame:
    """What removed names would take if those of other blocks took nothing: ``(owner, removed, added, score)``.

    A block is a stretch of removed names in name order. Its pairs stream in order through one task,
    which remembers the names taken in this block.
    """
    by = [F.col("owner"), F.col("removed")]
    cut = pairs.repartitionByRange(blocks, *by) if blocks else pairs.repartitionByRange(*by)
    flow = cut.sortWithinPartitions("owner", "removed", F.desc("score"), "added")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, done, taken = None, None, set()
        for batch in batches:
            keep = []
            for own, old, new in zip(*(batch.column(n).to_pylist() for n in ("owner", "removed", "added"))):
                if own != here:
                    here, done, taken = own, None, set()
                keep.append(old != done and new not in taken)
                if keep[-1]:
                    done = old
                    taken.add(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return flow.mapInArrow(settle, flow.schema)


def match_renames(pairs: DataFrame, blocks: int | None = None) -> DataFrame:
    """One-to-one matches ``(workflow_id, removed, added, score)``.

    Removed names take, in name order, their best added name not taken before; equal scores go to
    the first name. Blocks of names claim side by side as if alone. Of several claims to an added
    name the first removed name's wins, and later names can never have it, so their pairs with it go
    and the workflows with a lost claim claim again. The claims of a block are final once those of
    the blocks before it are, so there are at most as many rounds as a workflow has blocks, and the
    result is that of one pass in order. Each round is stored. Nothing but whether a claim was lost
    reaches the driver.

    ``blocks`` is the number of blocks over all workflows; by default Spark chooses it by size.
    """
    owner = F.coalesce(F.concat(F.lit("="), F.col("workflow_id").cast("string")), F.lit("-"))
    open_ = materialize(pairs.select(owner.alias("owner"), "workflow_id", "removed", "added", "score"), "renames")
    settled = []
    while True:
        claims = materialize(_claims(open_, blocks), "claims")
        winners = claims.groupBy("owner", "added").agg(F.min("removed").alias("winner"), F.count(F.lit(1)).alias("n"))
        lost = winners.where(F.col("n") > 1).select("owner").distinct()
        if lost.isEmpty():
            settled.append(claims)
            break
        settled.append(claims.join(lost, "owner", "left_anti"))
        left = open_.join(lost, "owner", "left_semi").join(winners.drop("n"), ["owner", "added"], "left")
        left = left.where(F.col("winner").isNull() | (F.col("removed") <= F.col("winner")))
        open_ = materialize(left.select(*open_.columns), "renames")
    return reduce(DataFrame.unionByName, settled).select("workflow_id", "removed", "added", "score")


def detect(snapshot: DataFrame, current: DataFrame, threshold: float | DataFrame = THRESHOLD) -> DataFrame:
    """All drift rows, with likely renames in place of their removed and new fields.

    ``threshold`` is one number or a frame ``(workflow_id, similarity_threshold)``.
    """
    changes = materialize(field_changes(snapshot, current), "drift")
    if isinstance(threshold, DataFrame):
        limits = threshold.select("workflow_id", F.col("similarity_threshold").cast("double").alias("threshold"))
        ready = join_on(changes, limits, ["workflow_id"]).fillna({"threshold": THRESHOLD})
    else:
        ready = changes.withColumn("threshold", F.lit(float(threshold)))
    side = lambda kind: ready.where(F.col("kind") == kind).select("workflow_id", "field", "threshold")
    matches = match_renames(rename_candidates(side("REMOVED_FIELD"), side("NEW_FIELD")))
    gone = matches.select("workflow_id", F.col("removed").alias("field"), F.lit("REMOVED_FIELD").alias("kind")).unionByName(
        matches.select("workflow_id", F.col("added").alias("field"), F.lit("NEW_FIELD").alias("kind"))
    )
    rest = changes.join(gone, ["workflow_id", "field", "kind"], "left_anti")
    shape = ["workflow_id", "kind", "field", "new_field", "old_type", "new_type", "score"]
    plain = rest.withColumns({"new_field": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    removed = changes.where(F.col("kind") == "REMOVED_FIELD").select("workflow_id", F.col("field").alias("removed"), "old_type")
    added = changes.where(F.col("kind") == "NEW_FIELD").select("workflow_id", F.col("field").alias("added"), "new_type")
    renamed = (
        matches.join(removed, ["workflow_id", "removed"])
        .join(added, ["workflow_id", "added"])
        .select(
            "workflow_id",
            F.lit("RENAMED_FIELD").alias("kind"),
            F.col("removed").alias("field"),
            F.col("added").alias("new_field"),
            "old_type",
            "new_type",
            "score",
        )
    )
    return plain.select(*shape).unionByName(renamed)


def _text(template: str) -> Column:
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), F.coalesce(F.col(name).cast("string"), F.lit("null"))]
    return F.concat(*parts, F.lit(rest))


def apply_policy(drift: DataFrame, policies: DataFrame | None = None, default: Mapping[str, str] = DEFAULT_POLICY) -> DataFrame:
    """Add ``action``, ``blocks`` and ``reason`` (NULL when the policy stays silent) to drift rows.

    ``policies`` holds one row per workflow with any of the four policy columns.
    """
    rows = drift
    names = list(DEFAULT_POLICY)
    if policies is not None:
        given = [c for c in names if c in policies.columns]
        rows = join_on(rows, policies.select("workflow_id", *given), ["workflow_id"])
        rows = rows.withColumns(
            {c: F.coalesce(F.col(c), F.lit(default[c])) if c in given else F.lit(default[c]) for c in names}
        )
    else:
        rows = rows.withColumns({c: F.lit(default[c]) for c in names})
    action = (
        F.when(F.col("kind") == "NEW_FIELD", F.col("on_new_field"))
        .when(F.col("kind") == "REMOVED_FIELD", F.col("on_removed_field"))
        .when(F.col("kind") == "TYPE_CHANGE", F.col("on_type_change"))
        .otherwise(F.col("on_renamed"))
    )
    rows = rows.withColumn("action", action).drop(*names)
    reason = F.lit(None).cast("string")
    for (kind, act), template in REASONS.items():
        reason = F.when((F.col("kind") == kind) & (F.col("action") == act), _text(template)).otherwise(reason)
    return rows.withColumns({"blocks": F.col("action") == "BLOCK", "reason": reason})


def policy_decisions(rated: DataFrame) -> DataFrame:
    """Per workflow: blocked or not, and how many reasons; the reasons are the rows of ``rated``."""
    return rated.groupBy("workflow_id").agg(
        F.bool_or("blocks").alias("blocked"),
        F.count("reason").alias("reasons"),
        F.count(F.lit(1)).alias("changes"),
    )


def drift_events(rated: DataFrame) -> DataFrame:
    """One row per workflow that drifts: what its policy makes of it, for publication as a message.

    ``blocked``, the changes by kind, the ``reasons`` in order, and the ``fields`` that changed. A workflow has at most
    as many of them as its two schemas have fields. Workflows without drift have no row in ``rated`` and no event.
    """
    kinds = ["NEW_FIELD", "REMOVED_FIELD", "TYPE_CHANGE", "RENAMED_FIELD"]
    return rated.groupBy("workflow_id").agg(
        F.bool_or("blocks").alias("blocked"),
        *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds],
        F.sort_array(F.collect_list("reason")).alias("reasons"),
        F.sort_array(F.collect_set("field")).alias("fields"),
    )


def resolve(
    df: DataFrame,
    snapshot: Mapping[str, str],
    renamed: Mapping[str, str] | None = None,
    expressions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Bring drifted rows back to the snapshot schema ``{field: type}``.

    ``renamed`` maps a snapshot field to its new name; ``expressions`` gives a cast of its own.
    Unknown fields are left out, a value that does not fit its type becomes NULL, and so does a
    field that is gone.
    """
    renamed, expressions = dict(renamed or {}), dict(expressions or {})
    present = {renamed.get(f, f) for f in snapshot}
    base = df.select(*[c for c in df.columns if c in present])
    for field, new in renamed.items():
        base = base.withColumnRenamed(new, field)
    out = []
    for field, kind in snapshot.items():
        if field in expressions:
            value = F.expr(expressions[field])
        elif field in base.columns:
            value = col(field).try_cast(spark_type(kind))
        else:
            value = F.lit(None).cast(spark_type(kind))
        out.append(value.alias(field))
    return base.select(*out)


def json_fields(df: DataFrame, json: str, keys: Sequence[str]) -> DataFrame:
    """Distinct top-level fields of a JSON column with their JSON type, per ``keys``."""
    parsed = df.select(*[col(k) for k in keys], F.try_parse_json(col(json)).alias("__doc"))
    fields = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__doc").outer())).where("key IS NOT NULL")
    # the type as written: a quoted number stays text
    v = F.schema_of_variant(F.col("value"))
    kind = (
        F.when(F.col("value").isNull() | (v == "VOID"), "null")
        .when(v.startswith("OBJECT"), "object")
        .when(v.startswith("ARRAY"), "array")
        .when(v == "BOOLEAN", "boolean")
        .when(v.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | v.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(v.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .otherwise("string")
    )
    return fields.select(*[col(k) for k in keys], F.col("key").alias("field"), kind.alias("type")).distinct()


def resolution(rated: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """``renamed`` and ``expressions`` for ``resolve`` from one workflow's rated drift.

    Renames that the policy takes without asking are followed, and type changes that it casts are
    cast with NULL for what does not fit. A workflow has few fields, so its rows come to the driver.
    """
    rows = rated.where(F.col("action").isin("AUTO_BY_SIMILARITY", "AUTOCAST")).select("kind", "field", "new_field", "old_type").collect()
    renamed = {r["field"]: r["new_field"] for r in rows if r["kind"] == "RENAMED_FIELD"}
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    casts = {r["field"]: f"try_cast({quoted(r['field'])} AS {r['old_type']})" for r in rows if r["kind"] == "TYPE_CHANGE"}
    return renamed, casts
