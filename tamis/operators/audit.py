"""Hash-chained audit logs: build, check links, recompute hashes.

An entry's hash covers its fields, its key and the hash of the workflow's entry before it. The
digest is SHA-256, which Spark has built in. Fields are written as ``length:text`` (``-`` for NULL),
so no two entries share a text form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.scalars import col
from tamis.operators.ordered import join_on
from tamis.operators.window import window
from tamis.session import materialize

# The fields a hash covers, in this order, and the default chain order.
FIELDS = ("audit_id", "workflow_id", "version_id", "actor_subject", "action", "payload", "occurred_at")
ORDER = ("occurred_at", "audit_id")


def entry_text(df: DataFrame, fields: Sequence[str] = FIELDS) -> Column:
    """The fields of an entry in one unambiguous text; absent fields count as NULL."""
    kinds = dict(df.dtypes)
    parts = []
    for f in fields:
        if f not in kinds:
            parts.append(F.lit("-"))
            continue
        value = (
            F.date_format(col(f), "yyyy-MM-dd HH:mm:ss.SSSSSS") if kinds[f].startswith("timestamp") else col(f).cast("string")
        )
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def link_hash(secret: Column, body: Column, parent: Column) -> Column:
    return F.sha2(F.concat(secret, F.lit("|"), body, F.lit("|"), F.coalesce(parent, F.lit("-")), F.lit("|"), secret), 256)


def _with_body(entries: DataFrame, keys: DataFrame | None, fields: Sequence[str]) -> DataFrame:
    rows = entries.withColumn("__body", F.sha2(entry_text(entries, fields), 256))
    if keys is None:
        return rows.withColumn("__secret", F.lit(""))
    secrets = keys.select("key_version", col("secret").alias("__secret"))
    return join_on(rows, secrets, ["key_version"])


def build_chain(
    entries: DataFrame, keys: DataFrame | None = None, order_by: Sequence[str] = ORDER, fields: Sequence[str] = FIELDS
) -> DataFrame:
    """Add ``parent_hash`` and ``self_hash`` to the entries of each workflow.

    Entry digests are computed in parallel. The chain itself is sequential by definition: only
    digests pass in order through the task of their workflow, about 150 bytes per entry in batches
    of bounded size, and the rest of the entry is joined back by a stored row number. Entries of one
    place in the order are chained by their digest. Entries without a workflow form a chain of their
    own. An entry of an unknown key version has no ``self_hash``, and the next one no parent.
    """
    ready = materialize(_with_body(entries, keys, fields).withColumn("__row", F.monotonically_increasing_id()), "entries")
    owner = F.coalesce(F.concat(F.lit("="), col("workflow_id").cast("string")), F.lit("-"))
    digests = ready.select("__row", owner.alias("__owner"), *[col(o) for o in order_by], "__body", "__secret")
    flow = digests.repartition("__owner").sortWithinPartitions("__owner", *[col(o) for o in order_by], "__body", "__row")
    out = T.StructType(
        [T.StructField("__row", T.LongType()), T.StructField("parent_hash", T.StringType()), T.StructField("self_hash", T.StringType())]
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workflow, last = None, None
        for batch in batches:
            parents, selves = [], []
            for w, body, secret in zip(batch["__owner"], batch["__body"], batch["__secret"]):
                if w != workflow:
                    workflow, last = w, None
                parents.append(last)
                if isinstance(secret, str):
                    last = hashlib.sha256(f"{secret}|{body}|{last or '-'}|{secret}".encode()).hexdigest()
                else:
                    last = None
                selves.append(last)
            yield pd.DataFrame({"__row": batch["__row"], "parent_hash": parents, "self_hash": selves})

    linked = flow.select("__row", "__owner", "__body", "__secret").mapInPandas(link, out)
    return ready.join(linked, "__row").select(*[col(c) for c in entries.columns], "parent_hash", "self_hash")


def check_links(entries: DataFrame, order_by: Sequence[str] = ORDER) -> DataFrame:
    """Add ``linked``: the parent is the hash of the entry before, NULL for the first one."""
    seen = window(entries, "__prev", "LAG", ["workflow_id"], list(order_by), "self_hash")
    return seen.withColumn("linked", F.col("parent_hash").eqNullSafe(F.col("__prev"))).drop("__prev")


def check_hashes(entries: DataFrame, keys: DataFrame | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Add ``intact``: the stored hash equals the one recomputed from fields, key and parent."""
    ready = _with_body(entries, keys, fields)
    again = link_hash(F.col("__secret"), F.col("__body"), F.col("parent_hash"))
    intact = F.coalesce(again == F.col("self_hash"), F.lit(False))
    return ready.withColumn("intact", intact).drop("__body", "__secret")


def verify(
    entries: DataFrame, keys: DataFrame | None = None, order_by: Sequence[str] = ORDER, fields: Sequence[str] = FIELDS
) -> DataFrame:
    """Per workflow: entries checked, breaks, and the first entry that breaks the chain."""
    rated = check_links(check_hashes(entries, keys, fields), order_by)
    bad = ~(F.col("linked") & F.col("intact"))
    place = F.struct(*[col(o) for o in order_by])
    return rated.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(bad).alias("breaks"),
        F.min_by(F.when(bad, col("audit_id")), F.when(bad, place)).alias("first_break"),
        F.min_by(F.when(bad, F.when(~F.col("linked"), "LINK").otherwise("HASH")), F.when(bad, place)).alias("cause"),
    )
