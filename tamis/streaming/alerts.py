"""Alerts that must hold for a time before they fire."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import types as T

from tamis.functions.scalars import col
from tamis.operators.ordered import prefix_sum
from tamis.streaming.measures import seconds, windowed

HOLD = "5 minutes"
ALERT = "key string, since timestamp, fired_at timestamp"
# Groups of keys that share a call and a row of state: a call costs milliseconds, however few rows it has.
BUCKETS = 1024


def evaluations(
    df: DataFrame, time_field: str, keys: Sequence[str], condition: Column, interval: str = "30 seconds", lateness: str | None = None
) -> DataFrame:
    """One row per key and interval: did the condition occur? Bounds the rows a key sends on."""
    return windowed(df, time_field, keys, {"active": F.bool_or(condition)}, interval, None, lateness)


def held_alerts(rows: DataFrame, key: str, time_field: str, active: str, hold_seconds: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """Stream of ``(key, since, fired_at)``: the condition was active at every evaluation of a key
    for ``hold_seconds``; it fires once and is re-armed by an inactive evaluation.

    ``rows`` holds one evaluation per key and interval. The state of a key is its active-since time
    and a fired flag; evaluations are applied in time order within a trigger.
    """
    out = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("since", T.TimestampType()),
            T.StructField("fired_at", T.TimestampType()),
        ]
    )
    state = T.StructType([T.StructField("since_us", T.LongType()), T.StructField("fired", T.BooleanType())])
    hold_us = hold_seconds * 1_000_000

    def step(key_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        since, fired = held.get if held.exists else (None, False)
        since = None if since is not None and since < 0 else since
        seen = [(int(t), bool(a)) for b in batches for t, a in zip(b["__us"], b["__active"])]
        fires = []
        for at, on in sorted(seen):
            if not on:
                since, fired = None, False
                continue
            since = at if since is None else since
            if not fired and at - since >= hold_us:
                fired = True
                fires.append((since, at))
        held.update((-1 if since is None else since, fired))
        if fires:
            stamp = lambda us: pd.to_datetime(us, unit="us")
            yield pd.DataFrame(
                {
                    "key": [str(key_[0])] * len(fires),
                    "since": [stamp(s) for s, _ in fires],
                    "fired_at": [stamp(f) for _, f in fires],
                }
            )

    fed = rows.select(
        col(key).cast("string").alias("__key"),
        F.unix_micros(col(time_field)).alias("__us"),
        F.coalesce(col(active), F.lit(False)).alias("__active"),
    )
    return fed.groupBy("__key").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def held_alerts_batch(rows: DataFrame, key: str, time_field: str, active: str, hold_seconds: int = 300) -> DataFrame:
    """The same alerts from a static table of evaluations, without Python.

    A run of active evaluations is numbered by the inactive ones before it; the first evaluation of
    a run that is ``hold_seconds`` after its start fires.
    """
    base = rows.select(
        col(key).cast("string").alias("key"), col(time_field).alias("at"), F.coalesce(col(active), F.lit(False)).alias("on")
    )
    quiet = F.when(F.col("on"), 0).otherwise(1).cast("bigint")
    runs = prefix_sum(base, ["key"], ["at"], quiet, "run").where("on")
    starts = runs.groupBy("key", "run").agg(F.min("at").alias("since"))
    late = runs.join(starts, ["key", "run"]).where(
        F.unix_micros("at") - F.unix_micros("since") >= F.lit(hold_seconds * 1_000_000)
    )
    return late.groupBy("key", "run").agg(F.first("since").alias("since"), F.min("at").alias("fired_at")).drop("run")


def partial_evaluations(events: DataFrame, key: str, time_field: str, condition: Column, interval: str) -> DataFrame:
    """(key, start_us, active, latest): events of a task combined by key and interval, before any shuffle.

    A key that sends very many events reaches its state as one row per task and interval. ``latest`` is the newest
    event time of a row, for the watermark.
    """
    us = F.unix_micros(col(time_field))
    width = int(seconds(interval) * 1_000_000)
    fed = events.where(us.isNotNull()).select(
        col(key).cast("string").alias("key"), (us - F.pmod(us, F.lit(width))).alias("start_us"), F.coalesce(condition, F.lit(False)).alias("active"), us.alias("us")
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(["key", "start_us"]).aggregate([("active", "max"), ("us", "max")])
            yield from found.select(["key", "start_us", "active_max", "us_max"]).rename_columns(["key", "start_us", "active", "us"]).to_batches()

    return fed.mapInArrow(combine, "key string, start_us bigint, active boolean, us bigint").select("key", "start_us", "active", F.timestamp_micros("us").alias("latest"))


def live_held_alerts(
    events: DataFrame, key: str, time_field: str, condition: Column, interval: str = "30 seconds", hold: str = HOLD, lateness: str = "10 minutes", idle: str = "1 day",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Stream of ``(key, since, fired_at)`` straight from raw events, in one stateful step.

    An interval of a key is evaluated when the watermark has passed its end, so events may come in any order within
    ``lateness``; until then it waits in the state, and an event-time timer wakes a key that gets no more events. The
    alert fires once the condition held at each evaluation for ``hold``, and is re-armed by an evaluation without it or
    by a pause of more than ``idle`` between evaluations. After such a pause the state of a key is removed, so keys
    that are gone leave nothing behind.

    Keys are dealt by hash into ``buckets``, and a bucket is one group of the stateful step. Raise it for hundreds of
    millions of keys; a stream that runs on from a checkpoint must keep its number.
    """
    width, hold_us, idle_us = (int(seconds(x) * 1_000_000) for x in (interval, hold, idle))

    def evaluate(known: list, passed: int) -> tuple[list, int]:
        """The alerts of a key, and when it must be looked at again; ``known``, its state, is brought up to date."""
        since, fired, last, open_at = known
        fires = []
        for at in sorted(t for t in open_at if t + width <= passed):
            active = open_at.pop(at)
            if last >= 0 and at - last > idle_us:
                since, fired = -1, False
            last = at
            if not active:
                since, fired = -1, False
                continue
            since = at if since < 0 else since
            if not fired and at - since >= hold_us:
                fired = True
                fires.append((since, at))
        known[:3] = since, fired, last
        return fires, min(open_at) + width if open_at else last + width + idle_us

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = {}
        for name, since, fired, last, waiting in json.loads(state.get[0]) if state.exists else ():
            keys[name] = [since, fired, last, dict(waiting)]
        if not state.hasTimedOut:
            for batch in batches:
                for name, start, active in zip(batch["key"].tolist(), batch["start_us"].tolist(), batch["active"].tolist()):
                    open_at = keys.setdefault(name, [-1, False, -1, {}])[3]
                    open_at[start] = active or open_at.get(start, False)
        passed = state.getCurrentWatermarkMs() * 1000
        found, kept, wake = [], [], None
        for name, known in keys.items():
            fires, due = evaluate(known, passed)
            found += [(name, *f) for f in fires]
            if due > passed:
                kept.append([name, *known[:3], list(known[3].items())])
                wake = due if wake is None else min(wake, due)
        if wake is None:
            state.remove()
        else:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(-(-wake // 1000))
        if found:
            yield pd.DataFrame({"key": [f[0] for f in found], "since": pd.to_datetime([f[1] for f in found], unit="us"), "fired_at": pd.to_datetime([f[2] for f in found], unit="us")})

    parts = partial_evaluations(events, key, time_field, condition, interval).withWatermark("latest", lateness)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, ALERT, "keys string", "append", GroupStateTimeout.EventTimeTimeout)
