"""Sharding by k-d tree partitioning, in DataFrame functions only.

Rows are points in a space of metadata dimensions, each scaled to 0..1. Copies of one text are one point: they take the
metadata of the copy of the least key. A node that holds more than the target splits
along its widest dimension at the weighted median (weights are bytes), until leaves reach the target. The median is
found without sorting: histograms of weights over the split order are aggregated per node, five times ever finer, so
that a pass shuffles a bounded number of bins per task and no node's rows ever meet in one task.

The split order is the dimension's value, within equal values a hash of the text, and within equal texts a hash of the
row. A cut that falls among the copies of a text moves to the nearer end of the group, so that equal texts stay in one
shard, unless that would move more than ``GROUP_SLACK`` of a shard's bytes: a group that outweighs the balance is cut.

Defined results: sizes are UTF-8 bytes of the text plus 1, so NULL and empty texts weigh 1. NULL metadata is a value of
its own, below all others. Repeated rows are told apart by a stored row number and dealt like other rows. An empty
table gives an empty table. Shards can be empty when there are fewer rows than shards. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import inputs, text_or_empty
from tamis.session import materialize

# A split order is an integer of 60 bits: of the dimension's value, of the text's hash and of the row's hash.
VALUE_BITS, TEXT_BITS, ROW_BITS, STEP_BITS = 24, 24, 12, 12
GROUP_SLACK = 0.02


def _unit(column: str, kind: str) -> Column:
    """A number for any metadata value; text keeps equal values together by a hash."""
    if kind in ("string", "binary", "boolean") or kind.startswith(("array", "struct", "map")):
        return F.coalesce((F.crc32(F.col(column).cast("string")) + 1).cast("double"), F.lit(0.0))
    return F.col(column).cast("double")


def points(docs: DataFrame, *, key: str, text: str, dimensions: Sequence[str]) -> DataFrame:
    """Stored once: row, key, size, text_crc32 and one number per dimension (d0, d1, ...), scaled to 0..1."""
    narrow = inputs(docs, key=key, text=text, **{f"m{i}": c for i, c in enumerate(dimensions)})
    kinds = dict(narrow.dtypes)
    names = [f"d{i}" for i in range(len(dimensions) + 1)]
    size = F.octet_length(text_or_empty()).cast("bigint") + 1
    raw = narrow.select(
        F.monotonically_increasing_id().alias("row"),
        "key",
        size.alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        F.xxhash64(text_or_empty()).alias("group"),
        F.log2(size).alias("d0"),
        *[_unit(f"m{i}", kinds[f"m{i}"]).alias(f"d{i + 1}") for i in range(len(dimensions))],
    )
    stored = materialize(raw, "points")
    # of copies, one speaks for all; texts without copies speak for themselves
    own = [*names]
    first = stored.groupBy("group").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct(*own), F.struct("key", "row")).alias("first")).where("copies > 1")
    stored = stored.join(first.select("group", "first"), "group", "left").withColumns({d: F.when(F.col("first").isNotNull(), F.col("first")[d]).otherwise(F.col(d)) for d in own})
    stored = materialize(stored.drop("first"), "grouped")
    ends = stored.agg(*[f(F.nanvl(F.col(d), F.lit(None))).alias(f"{f.__name__}_{d}") for d in names for f in (F.min, F.max)]).first()

    def scaled(d: str) -> Column:
        low, high = ends[f"min_{d}"], ends[f"max_{d}"]
        if low is None or not high > low:
            return F.lit(0.0)
        # NULL and NaN come before the least value
        return F.coalesce(F.nanvl((F.col(d) - low) / (high - low), F.lit(-0.01)), F.lit(-0.01))

    return stored.select("row", "key", "size", "text_crc32", "group", *[scaled(d).alias(d) for d in names])


def _order(dimension: Column) -> Column:
    value = F.floor((dimension + 0.02) / 1.04 * (2**VALUE_BITS - 1)).cast("bigint")
    text = F.shiftrightunsigned("group", 64 - TEXT_BITS)
    return F.shiftleft(value, TEXT_BITS + ROW_BITS) + F.shiftleft(text, ROW_BITS) + F.xxhash64("row").bitwiseAND(F.lit(2**ROW_BITS - 1))


def _cuts(placed: DataFrame, plan: dict[int, tuple[str, int]], names: list[str]) -> dict[int, tuple[str, int]]:
    """For each node that splits: its widest dimension and the split order at which the right child begins.

    ``plan``: node -> (dimension, leaves). The driver sees one row per node and step, that is at most the shard count.
    """
    width = VALUE_BITS + TEXT_BITS + ROW_BITS
    order = F.lit(None).cast("bigint")
    for d in names:
        nodes = [n for n, (picked, _) in plan.items() if picked == d]
        if nodes:
            order = F.when(F.col("node").isin(nodes), _order(F.col(d))).otherwise(order)
    ordered = placed.select("node", "size", order.alias("order")).where(F.col("order").isNotNull())
    totals = {r["node"]: r["bytes"] for r in ordered.groupBy("node").agg(F.sum("size").alias("bytes")).collect()}
    # bytes that should lie left of the cut; both sides get leaves in proportion
    wanted = {n: totals.get(n, 0) * (leaves // 2) / leaves for n, (_, leaves) in plan.items()}
    prefix = {n: 0 for n in plan}  # leading bits of the cut, found step by step
    slack = {n: GROUP_SLACK * totals.get(n, 0) / leaves for n, (_, leaves) in plan.items()}
    settled: dict[int, int] = {}
    for step in range(1, width // STEP_BITS + 1):
        shift = width - step * STEP_BITS
        inside = F.lit(False)
        for n, p in prefix.items():
            inside = inside | ((F.col("node") == n) & (F.shiftright("order", shift + STEP_BITS) == p))
        bins = ordered.where(inside).groupBy("node", F.shiftright("order", shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        target = F.create_map(*[F.lit(x) for n in wanted for x in (n, float(wanted[n]))])[F.col("node")]
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            bins.withColumn("upto", F.sum("bytes").over(upto))
            .where(F.col("upto") > target)
            .groupBy("node")
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("bytes")).alias("before"), "bytes")).alias("at"))
            .collect()
        )
        hit = {r["node"]: r["at"] for r in found}
        for n in plan:
            if n in hit:
                prefix[n] = hit[n]["bin"]
                wanted[n] -= hit[n]["before"]
            else:  # nothing lies right of the cut
                prefix[n] = (prefix[n] + 1) * 2**STEP_BITS
                wanted[n] = 0
        if shift == ROW_BITS:
            # the bin is one text: the cut goes to its nearer end unless that moves too much
            for n, at in hit.items():
                left, right = wanted[n], at["bytes"] - wanted[n]
                if min(left, right) <= slack[n]:
                    settled[n] = (prefix[n] + (left > right)) << ROW_BITS
    return {n: (plan[n][0], settled.get(n, prefix[n])) for n in plan}


def kd_shards(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    dimensions: Sequence[str] = ("source", "lang", "doc_id"),
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """One row per document: key, size, text_crc32, shard (from 0, in tree order), slot (from 0, gapless per shard).

    Give the number of ``shards``, or ``target_bytes`` that a leaf should reach. The size itself is the first
    dimension; ``dimensions`` names further metadata columns.
    """
    spark = docs.sparkSession
    placed = points(docs, key=key, text=text, dimensions=dimensions).withColumn("node", F.lit(1))
    names = [c for c in placed.columns if c[0] == "d" and c[1:].isdigit()]
    if shards is None:
        total = placed.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    # node -> (first shard, leaves); children of n are 2n and 2n + 1
    leaves = {1: (0, shards)}
    while open_nodes := {n: k for n, (_, k) in leaves.items() if k > 1}:
        spreads = placed.where(F.col("node").isin(list(open_nodes))).groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in names]).collect()
        widest = {r["node"]: max(names, key=lambda d: (r[d], -names.index(d))) for r in spreads}
        cuts = _cuts(placed, {n: (widest.get(n, names[0]), k) for n, k in open_nodes.items()}, names)
        child = F.col("node")
        for n, (d, at) in cuts.items():
            first, k = leaves.pop(n)
            leaves[2 * n], leaves[2 * n + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            child = F.when(F.col("node") == n, F.when(_order(F.col(d)) < at, 2 * n).otherwise(2 * n + 1)).otherwise(child)
        placed = materialize(placed.withColumn("node", child), "kd_level")
    number = F.create_map(*[F.lit(x) for n, (first, _) in leaves.items() for x in (n, first)])[F.col("node")]
    sharded = placed.select("row", "key", "size", "text_crc32", number.cast("int").alias("shard"))
    return _slots(sharded, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _slots(sharded: DataFrame, slices: int) -> DataFrame:
    """Gapless numbers per shard: rows are numbered within hashed slices and each slice starts where earlier ones end."""
    sliced = materialize(sharded.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")), "slices")
    counts = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("row")
    return (
        sliced.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, ["shard", "slice"])
        .select("key", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"))
    )
