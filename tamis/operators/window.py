"""Window functions over partitions of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tamis.functions.scalars import col, order_fields, ordering, row_hash
from tamis.operators.ordered import (
    groups_fit,
    hashable,
    join_on,
    number_rows,
    prefix_sum,
    prefix_sums,
    running_extreme,
    top_per_group,
    value_ranks,
)
from tamis.session import materialize, max_group_rows

# The window functions of a workflow, then the framed aggregates.
RANKING = ("ROW_NUMBER", "RANK", "DENSE_RANK", "CUME_DIST", "NTILE")
OFFSETS = ("LAG", "LEAD")
EDGES = ("FIRST_VALUE", "LAST_VALUE")
FRAMED = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


def bound(text: str | int) -> int:
    """Frame bound: ``UNBOUNDED PRECEDING``, ``CURRENT ROW``, ``3 FOLLOWING``, or an offset."""
    if isinstance(text, int):
        return text
    words = text.strip().upper().split()
    if words == ["CURRENT", "ROW"]:
        return Window.currentRow
    if len(words) == 2 and words[1] in ("PRECEDING", "FOLLOWING"):
        before = words[1] == "PRECEDING"
        if words[0] == "UNBOUNDED":
            return Window.unboundedPreceding if before else Window.unboundedFollowing
        if words[0].isdigit():
            return -int(words[0]) if before else int(words[0])
    raise ValueError(f"frame bound '{text}' cannot be read")


_UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86_400, "WEEK": 604_800}


def _timed(frame: dict | None) -> dict | None:
    """A RANGE frame over time, such as ``7 DAYS PRECEDING``, with its bounds in microseconds; else None."""
    if frame is None or frame.get("kind", "ROWS").upper() != "RANGE":
        return None
    out, timed = dict(frame), False
    for side in ("start", "end"):
        words = str(frame.get(side, "")).strip().upper().split()
        if len(words) == 3 and words[1].rstrip("S") in _UNITS:
            out[side] = f"{int(words[0]) * _UNITS[words[1].rstrip('S')] * 1_000_000} {words[2]}"
            timed = True
    return out if timed else None


def window(
    df: DataFrame,
    alias: str,
    function: str,
    partition_by: Sequence[str] = (),
    order_by: Sequence = (),
    field: str | None = None,
    offset: int = 1,
    default=None,
    buckets: int = 4,
    frame: dict | None = None,
    sliced: bool | None = None,
) -> DataFrame:
    """Add ``alias = function OVER (PARTITION BY ... ORDER BY ... NULLS LAST)``.

    A RANGE frame over a time takes bounds such as ``7 DAYS PRECEDING``. ``field`` is the input of
    LAG, LEAD, FIRST_VALUE, LAST_VALUE and the framed aggregates; when absent, ``alias`` names the input. Groups above ``spark.tamis.maxGroupRows`` (and an empty
    ``partition_by`` with that many rows) take the form that spreads a group over tasks; ``sliced``
    forces or forbids it.
    """
    kind = function.upper()
    if kind not in RANKING + OFFSETS + EDGES and kind not in FRAMED:
        raise ValueError(f"window function '{function}' is not supported")
    keys = list(partition_by)
    order = list(order_by)
    source = field or alias
    if (frame_us := _timed(frame)) is not None:
        (named,) = order_fields(order)
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(named).cast("timestamp_ntz"))
        falling = not isinstance(order[0], str) and (order[0]["direction"] if isinstance(order[0], dict) else order[0][1]).upper() == "DESC"
        timed = df.withColumn("__at", at)
        by = [("__at", "DESC" if falling else "ASC")]
        return window(timed, alias, function, keys, by, source, offset, default, buckets, frame_us, sliced).drop("__at")
    if sliced is None:
        sliced = not groups_fit(df, keys)
    if sliced:
        spread = _spread(df, alias, kind, keys, order, source, offset, default, buckets, frame)
        if spread is not None:
            return _typed(spread, df, alias, kind, source)
    win = Window.partitionBy(*[col(k) for k in keys])
    by_rows = frame is not None and frame.get("kind", "ROWS").upper() == "ROWS"
    # where the place of a tied row counts, ties go by the hash of the row, as in the spread form
    if order and (kind in ("ROW_NUMBER", "NTILE") + OFFSETS or by_rows or (kind in EDGES and frame is None)):
        win = win.orderBy(*ordering(order), row_hash(hashable(df)))
    elif order:
        win = win.orderBy(*ordering(order))
    elif kind in RANKING + OFFSETS:
        win = win.orderBy(row_hash(hashable(df)))
    if kind in RANKING:
        calls = {
            "ROW_NUMBER": F.row_number,
            "RANK": F.rank,
            "DENSE_RANK": F.dense_rank,
            "CUME_DIST": F.cume_dist,
            "NTILE": lambda: F.ntile(buckets),
        }
        return df.withColumn(alias, calls[kind]().over(win))
    if kind in OFFSETS:
        shift = F.lag if kind == "LAG" else F.lead
        return df.withColumn(alias, shift(col(source), offset, default).over(win))
    if frame:
        win = _framed(win, frame)
    if kind in EDGES:
        edge = F.first_value if kind == "FIRST_VALUE" else F.last_value
        return df.withColumn(alias, edge(col(source)).over(win))
    return df.withColumn(alias, FRAMED[kind](col(source)).over(win))


def _typed(spread: DataFrame, df: DataFrame, alias: str, kind: str, source: str) -> DataFrame:
    """The spread form adds partial sums, which are wider; its result takes the type of the plain window."""
    if kind not in FRAMED or kind == "COUNT":
        return spread
    plain = df.limit(0).agg(FRAMED[kind](col(source)).alias("v")).dtypes[0][1]
    return spread.withColumn(alias, F.col(alias).cast(plain)) if dict(spread.dtypes)[alias] != plain else spread


def _framed(win, frame: dict):
    start = bound(frame.get("start", "UNBOUNDED PRECEDING"))
    end = bound(frame.get("end", "CURRENT ROW"))
    kind = frame.get("kind", "ROWS").upper()
    if kind not in ("ROWS", "RANGE"):
        raise ValueError(f"frame kind '{kind}' is neither ROWS nor RANGE")
    return win.rowsBetween(start, end) if kind == "ROWS" else win.rangeBetween(start, end)


def _spread(df, alias, kind, keys, order, source, offset, default, buckets, frame) -> DataFrame | None:
    """The same result with every group spread over tasks; None where only a plain window will do."""
    work = df if source != alias or kind in RANKING else df.withColumnRenamed(alias, "__in")
    src = source if source != alias or kind in RANKING else "__in"
    if kind in ("RANK", "DENSE_RANK", "CUME_DIST"):
        ranks = value_ranks(df, keys, order, True)
        if kind == "RANK":
            value = (F.col("__upto") - F.col("__n") + 1).cast("int")
        elif kind == "DENSE_RANK":
            value = F.col("__dense").cast("int")
        else:
            size = ranks.groupBy(*[col(k) for k in keys]).agg(F.sum("__n").alias("__all"))
            ranks = join_on(ranks, size, keys, "inner") if keys else ranks.withColumn("__all", size.scalar())
            value = F.col("__upto") / F.col("__all")
        fields = list(dict.fromkeys([*keys, *order_fields(order)]))
        return join_on(df, ranks.select(*[col(f) for f in fields], value.alias(alias)), fields)
    if kind == "ROW_NUMBER":
        out = number_rows(df, keys, order, "__rn", True)
        return out.withColumn(alias, F.col("__rn").cast("int")).drop("__rn")
    if kind == "NTILE":
        out = number_rows(df, keys, order, "__rn", True)
        size = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__all"))
        out = join_on(out, size, keys) if keys else out.withColumn("__all", size.scalar())
        rn, base, more = F.col("__rn"), F.floor(F.col("__all") / buckets), F.col("__all") % buckets
        big = more * (base + 1)
        # when base is 0 every row falls under `big`, so the divisor is only kept from being 0
        tile = F.when(rn <= big, F.floor((rn - 1) / (base + 1)) + 1).otherwise(
            more + F.floor((rn - 1 - big) / F.greatest(base, F.lit(1))) + 1
        )
        return out.withColumn(alias, tile.cast("int")).drop("__rn", "__all")
    if kind in OFFSETS:
        numbered = number_rows(work, keys, order, "__rn", True)
        step = offset if kind == "LAG" else -offset
        moved = numbered.select(
            *[col(k) for k in keys],
            (F.col("__rn") + step).alias("__rn"),
            col(src).alias("__moved"),
            F.lit(True).alias("__hit"),
        )
        out = join_on(numbered, moved, [*keys, "__rn"])
        value = F.when(F.col("__hit").isNull(), F.lit(default)).otherwise(F.col("__moved"))
        return out.withColumn(alias, value).drop("__rn", "__moved", "__hit", "__in")
    start = bound((frame or {}).get("start", "UNBOUNDED PRECEDING"))
    end = bound((frame or {}).get("end", "CURRENT ROW"))
    by_rows = frame is not None and frame.get("kind", "ROWS").upper() == "ROWS"
    whole = start == Window.unboundedPreceding and end == Window.unboundedFollowing
    if whole or not order:
        if kind in EDGES and not order:
            return None
        if kind in EDGES:
            numbered = number_rows(work, keys, order, "__rn", True)
            pick = F.min_by if kind == "FIRST_VALUE" else F.max_by
            edge = numbered.groupBy(*[col(k) for k in keys]).agg(pick(col(src), "__rn").alias(alias))
            return _attach(numbered.drop("__rn", "__in"), edge, keys, alias)
        total = work.groupBy(*[col(k) for k in keys]).agg(FRAMED[kind](col(src)).alias(alias))
        return _attach(work.drop("__in"), total, keys, alias)
    to_now = start == Window.unboundedPreceding and end == Window.currentRow
    if kind in EDGES and to_now:
        numbered = number_rows(work, keys, order, "__rn", True)
        if kind == "FIRST_VALUE":
            edge = numbered.groupBy(*[col(k) for k in keys]).agg(F.min_by(col(src), "__rn").alias(alias))
            return _attach(numbered.drop("__rn", "__in"), edge, keys, alias)
        if by_rows:
            return numbered.withColumn(alias, col(src)).drop("__rn", "__in")
        peers = list(dict.fromkeys([*keys, *order_fields(order)]))
        edge = numbered.groupBy(*[col(p) for p in peers]).agg(F.max_by(col(src), "__rn").alias(alias))
        return join_on(numbered.drop("__rn", "__in"), edge, peers)
    if kind in FRAMED and to_now:
        if by_rows:
            return _running(work, alias, kind, keys, order, src).drop("__in")
        return _running_peers(work, alias, kind, keys, order, src).drop("__in")
    finite = start > Window.unboundedPreceding and end < Window.unboundedFollowing
    if not by_rows:
        if finite and kind in ("MIN", "MAX"):
            return _value_range(work, alias, kind, keys, order, src, start, end)
        found = _range_frame(work, alias, kind, keys, order, src, start, end)
        return found if found is None else found.drop("__in")
    if finite and start <= end:
        return _halo(work, alias, kind, keys, order, src, start, end).drop("__in")
    if kind in FRAMED and not finite:
        return _half_open(work, alias, kind, keys, order, src, start, end).drop("__in")
    if not finite:
        return _edge_row(work, alias, kind, keys, order, src, start, end).drop("__in")
    return work.withColumn(alias, F.lit(0).cast("bigint") if kind == "COUNT" else F.lit(None).cast(dict(work.dtypes)[src])).drop("__in")


def _attach(df: DataFrame, one_per_group: DataFrame, keys: list[str], alias: str) -> DataFrame:
    return join_on(df, one_per_group, keys) if keys else df.withColumn(alias, one_per_group.scalar())


def _running(df, alias, kind, keys, order, src) -> DataFrame:
    tied = df.withColumn("__tie", row_hash(hashable(df)))
    by = [*order, "__tie"]
    if kind in ("MIN", "MAX"):
        return running_extreme(tied, keys, by, col(src), alias, kind == "MAX").drop("__tie")
    seen = F.when(col(src).isNotNull(), 1).otherwise(0).cast("bigint")
    if kind == "COUNT":
        return prefix_sum(tied, keys, by, seen, alias, True).drop("__tie")
    summed = prefix_sum(tied, keys, by, F.coalesce(col(src), F.lit(0)), "__sum", True)
    counted = prefix_sum(summed, keys, by, seen, "__seen", True)
    return counted.withColumn(alias, _from_sums(kind)).drop("__sum", "__seen", "__tie")


def _peer_parts(df, kind, keys, order, src) -> tuple[DataFrame, list[str]]:
    """One row per (keys, order values) with the parts the aggregate needs; ties weigh one row."""
    peers = list(dict.fromkeys([*keys, *order_fields(order)]))
    parts = df.groupBy(*[col(p) for p in peers]).agg(
        (F.sum(col(src)) if kind in ("SUM", "AVG") else F.lit(0)).alias("__s"),
        F.count(col(src)).alias("__k"),
        (F.max(col(src)) if kind == "MAX" else F.min(col(src)) if kind == "MIN" else F.lit(0)).alias("__x"),
    )
    return parts, peers


def _running_peers(df, alias, kind, keys, order, src) -> DataFrame:
    """Running aggregate that takes in all ties of the current row."""
    parts, peers = _peer_parts(df, kind, keys, order, src)
    if kind in ("MIN", "MAX"):
        found = running_extreme(parts, keys, order, F.col("__x"), alias, kind == "MAX", unique=True)
    else:
        found = prefix_sum(parts, keys, order, F.col("__k"), "__seen", True, unique=True)
        if kind != "COUNT":
            found = prefix_sum(found, keys, order, F.coalesce(F.col("__s"), F.lit(0)), "__sum", True, unique=True)
        found = found.withColumn(alias, _from_sums(kind))
    return join_on(df, found.select(*[col(p) for p in peers], alias), peers)


def _from_sums(kind: str) -> Column:
    """SUM, AVG or COUNT from ``__sum`` and the non-NULL count ``__seen``."""
    if kind == "COUNT":
        return F.col("__seen")
    some = F.nullif(F.col("__seen"), F.lit(0).cast("bigint"))
    return F.when(some.isNotNull(), F.col("__sum")) if kind == "SUM" else F.col("__sum") / some


def _half_open(df, alias, kind, keys, order, src, start: int, end: int) -> DataFrame:
    """ROWS frame with one open side: the running value of the row at the other bound.

    A frame open to the end is the same frame open to the start in reversed order.
    """
    numbered = number_rows(df, keys, order, "__rn", True)
    size = numbered.groupBy(*[col(k) for k in keys]).agg(F.max("__rn").alias("__all"))
    numbered = join_on(numbered, size, keys) if keys else numbered.withColumn("__all", size.scalar())
    if end == Window.unboundedFollowing:
        numbered = numbered.withColumn("__rn", F.col("__all") - F.col("__rn") + 1)
        shift = -start
    else:
        shift = end
    numbered = materialize(numbered, "numbered")
    running = _running(numbered, "__run", kind, keys, ["__rn"], src)
    at = running.select(*[col(k) for k in keys], F.col("__rn").alias("__at"), "__run")
    asked = numbered.withColumn("__at", F.least(F.col("__rn") + shift, F.col("__all")))
    value = F.col("__run") if kind != "COUNT" else F.coalesce("__run", F.lit(0).cast("bigint"))
    return join_on(asked, at, [*keys, "__at"]).withColumn(alias, value).drop("__rn", "__all", "__at", "__run")


def _edge_row(df, alias, kind, keys, order, src, start: int, end: int) -> DataFrame:
    """FIRST or LAST over a ROWS frame with one open side: the value of the row whose number is the frame's bound.

    At the open side that is the group's first or last row, if the frame has any row at all.
    """
    numbered = number_rows(df, keys, order, "__rn", True)
    size = numbered.groupBy(*[col(k) for k in keys]).agg(F.max("__rn").alias("__all"))
    numbered = join_on(numbered, size, keys) if keys else numbered.withColumn("__all", size.scalar())
    numbered = materialize(numbered, "numbered")
    first = F.lit(1).cast("bigint") if start == Window.unboundedPreceding else F.greatest(F.lit(1), F.col("__rn") + start)
    last = F.col("__all") if end == Window.unboundedFollowing else F.least("__all", F.col("__rn") + end)
    at = F.when(first <= last, first if kind == "FIRST_VALUE" else last)
    wanted = numbered.select(*[col(k) for k in keys], F.col("__rn").alias("__at"), col(src).alias("__edge"))
    found = join_on(numbered.withColumn("__at", at), wanted, [*keys, "__at"])
    return found.withColumn(alias, F.col("__edge")).drop("__rn", "__all", "__at", "__edge")


def _range_frame(df, alias, kind, keys, order, src, start: int, end: int) -> DataFrame | None:
    """RANGE frame over one numeric order column, whatever its width and density.

    Rows of one value are combined first. Each value then asks twice, at its two bounds, among the values themselves: in
    the order of values and asks, the running totals at an ask hold all values on one side of that bound. The running
    totals come from slices cut by rows, so a dense field is spread like any other. Sums, averages and counts are
    differences of two totals, see ``_sum_frames``.
    """
    fields = order_fields(order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if len(fields) != 1 or not isinstance(kinds[fields[0]], NumericType):
        return None
    open_start, open_end = start == Window.unboundedPreceding, end == Window.unboundedFollowing
    if not open_start and not open_end and start > end:
        return df.withColumn(alias, F.lit(0).cast("bigint") if kind == "COUNT" else F.lit(None).cast(dict(df.dtypes)[src]))
    falling = not isinstance(order[0], str) and (order[0]["direction"] if isinstance(order[0], dict) else order[0][1]).upper() == "DESC"
    if kind in ("SUM", "AVG", "COUNT"):
        return _sum_frames(df, keys, fields[0], falling, {alias: (kind, src, start, end)})
    if kind in EDGES:
        peers = list(dict.fromkeys([*keys, *fields]))
        pick = F.min_by if kind == "FIRST_VALUE" else F.max_by
        parts = df.withColumn("__tie", row_hash(hashable(df))).groupBy(*[col(p) for p in peers]).agg(pick(col(src), "__tie").alias("__x"), F.lit(1).cast("bigint").alias("__one"))
    else:
        parts, peers = _peer_parts(df, kind, keys, order, src)
    place = -col(fields[0]) if falling else col(fields[0])
    parts = materialize(parts.withColumn("__p", place).withColumn("__nul", F.col("__p").isNull().cast("int")), "values")
    sums = {"one": F.col("__one")} if kind in EDGES else {}
    weighed = parts.withColumns({f"__v_{n}": w for n, w in sums.items()})
    names = [f"__v_{n}" for n in sums] if sums else ["__x"]
    shift = {0: start, 2: end}  # asks just before and just after the values of their bound
    wanted = [side for side in (0, 2) if not (open_start if side == 0 else open_end)]
    asked = weighed.select(*[col(k) for k in keys], "__p", "__nul", F.lit(1).alias("__side"), F.col("__p").alias("__own"), *names)
    for side in wanted:
        kindred = dict(weighed.dtypes)
        ask = weighed.select(
            *[col(k) for k in keys], (F.col("__p") + F.lit(shift[side])).cast(kindred["__p"]).alias("__p"), "__nul", F.lit(side).alias("__side"), F.col("__p").alias("__own"),
            *[F.lit(None if n == "__x" else 0).cast(kindred[n]).alias(n) for n in names],
        )
        asked = asked.unionByName(ask)
    forward = [("__nul", "ASC"), ("__p", "ASC"), ("__side", "ASC")]
    own = [*keys, "__own"]
    if not sums:
        by = [(n, "DESC") for n, _ in forward] if open_end else forward
        got = running_extreme(asked, keys, by, F.col("__x"), "__found", kind == "MAX", unique=True).where(F.col("__side") != 1)
        values = join_on(parts.withColumn("__own", F.col("__p")), got.select(*[col(k) for k in own], "__found"), own)
        return join_on(df, values.select(*[col(p) for p in peers], F.col("__found").alias(alias)), peers)
    got = materialize(prefix_sums(asked, keys, forward, {f"__t{n}": F.col(n) for n in names}, unique=True), "totals")
    zero = lambda n: F.lit(0).cast(dict(got.dtypes)[n])
    at = {side: {n: F.max(F.when(F.col("__side") == side, F.col(f"__t{n}"))) for n in names} for side in wanted}
    flat = got.groupBy(*[col(k) for k in own]).agg(*[c.alias(f"__{side}{n}") for side in wanted for n, c in at[side].items()], F.max(F.when(F.col("__side") == 1, F.col(f"__t{names[0]}"))).alias("__nth"))
    if open_end:
        whole = weighed.groupBy(*[col(k) for k in keys]).agg(*[F.sum(n).alias(f"__2{n}") for n in names])
        flat = join_on(flat, whole, keys) if keys else flat.join(F.broadcast(whole))
    low = lambda n: zero(f"__t{n}") if open_start else F.col(f"__0{n}")
    n = names[0]
    index = F.when(low(n) < F.col(f"__2{n}"), low(n) + 1 if kind == "FIRST_VALUE" else F.col(f"__2{n}"))
    flat = flat.withColumn("__want", index.cast("bigint"))
    values = join_on(parts.withColumn("__own", F.col("__p")), flat.select(*[col(k) for k in own], "__want", "__nth"), own)
    values = materialize(values, "indexed")
    chosen = values.select(*[col(k) for k in keys], F.col("__nth").cast("bigint").alias("__want"), F.col("__x").alias("__found"))
    found = join_on(values.select(*[col(p) for p in peers], "__want"), chosen, [*keys, "__want"])
    return join_on(df, found.select(*[col(p) for p in peers], F.col("__found").alias(alias)), peers)


def range_frames(df: DataFrame, partition_by: Sequence[str], order_by, frames: dict[str, tuple[str, str, dict]]) -> DataFrame:
    """Add ``alias = function(field) OVER (PARTITION BY ... ORDER BY ... RANGE ...)`` for several frames in one pass.

    ``frames`` gives function (SUM, AVG or COUNT), field and frame by alias; ``order_by`` is one numeric field. Every
    group is spread over tasks, and the values of the field are cut and sorted once for all frames.
    """
    (field,) = order_fields([order_by])
    if not isinstance(df.schema[field].dataType, NumericType):
        raise ValueError(f"'{field}' is not a number")
    falling = not isinstance(order_by, str) and (order_by["direction"] if isinstance(order_by, dict) else order_by[1]).upper() == "DESC"
    wanted, empty = {}, {}
    for alias, (function, source, frame) in frames.items():
        kind = function.upper()
        if kind not in ("SUM", "AVG", "COUNT") or frame.get("kind", "ROWS").upper() != "RANGE":
            raise ValueError(f"'{function}' over this frame cannot share a pass")
        if alias in df.columns:
            raise ValueError(f"column '{alias}' exists")
        start, end = bound(frame.get("start", "UNBOUNDED PRECEDING")), bound(frame.get("end", "CURRENT ROW"))
        if start > end:
            empty[alias] = F.lit(0).cast("bigint") if kind == "COUNT" else F.lit(None).cast(dict(df.dtypes)[source])
        else:
            wanted[alias] = (kind, source, start, end)
    out = _sum_frames(df, list(partition_by), field, falling, wanted) if wanted else df
    for alias, (kind, source, *_) in wanted.items():
        out = _typed(out, df, alias, kind, source)
    return out.withColumns(empty).select(*[col(c) for c in df.columns], *frames)


def _sum_frames(df: DataFrame, keys: list[str], field: str, falling: bool, frames: dict[str, tuple[str, str, int, int]]) -> DataFrame:
    """Sums, averages and counts over RANGE frames, ``(kind, source, start, end)`` by alias.

    All frames ask among the same values, so one cut into slices and one sort serve them, and frames with a common
    bound share its ask. A sum over a frame is the difference of two totals, which is exact: integers and decimals by
    type, doubles by ``_exact_parts``.
    """
    peers = list(dict.fromkeys([*keys, field]))
    sources = list(dict.fromkeys(source for _, source, _, _ in frames.values()))
    summed = {source for kind, source, _, _ in frames.values() if kind != "COUNT"}
    pieces = [F.count(col(s)).alias(f"__k{i}") for i, s in enumerate(sources)] + [F.sum(col(s)).alias(f"__s{i}") for i, s in enumerate(sources) if s in summed]
    place = F.col("__own") if not falling else -F.col("__own")
    parts = df.groupBy(*[col(p) for p in peers]).agg(*pieces).withColumn("__own", col(field)).withColumn("__p", place)
    parts = materialize(parts.withColumn("__nul", F.col("__p").isNull().cast("int")), "values")
    exact = {i: _exact_parts(parts, f"__s{i}") for i, s in enumerate(sources) if s in summed}
    weights = {f"__v{i}_{n}": c for i, s in enumerate(sources) for n, c in {"k": F.col(f"__k{i}"), **exact.get(i, {})}.items()}
    weighed = parts.select(*[col(k) for k in keys], "__own", "__p", "__nul", *[c.alias(n) for n, c in weights.items()])
    types = dict(weighed.dtypes)
    # an ask stands just before (0) or just after (2) the values of its bound
    asks = [b for _, _, start, end in frames.values() for b in ((0, start), (2, end)) if abs(b[1]) < Window.unboundedFollowing]
    asks = {b: i for i, b in enumerate(dict.fromkeys(asks), 1)}
    asked = weighed.withColumns({"__side": F.lit(1), "__ask": F.lit(0)})
    for (side, shift), i in asks.items():
        nothing = {n: F.lit(0).cast(types[n]) for n in weights}
        ask = weighed.withColumns({"__p": (F.col("__p") + F.lit(shift)).cast(types["__p"]), "__side": F.lit(side), "__ask": F.lit(i), **nothing})
        asked = asked.unionByName(ask)
    totals = {f"__t{n}": F.col(n) for n in weights}
    got = prefix_sums(asked, keys, [("__nul", "ASC"), ("__p", "ASC"), ("__side", "ASC")], totals, unique=True)
    own = [*keys, "__own"]
    at = {f"__a{i}{n}": F.max(F.when(F.col("__ask") == i, F.col(f"__t{n}"))) for i in asks.values() for n in weights}
    at = at or {"__any": F.count(F.lit(1))}
    flat = got.groupBy(*[col(k) for k in own]).agg(*[c.alias(n) for n, c in at.items()])
    if any(end == Window.unboundedFollowing for *_, end in frames.values()):
        whole = weighed.groupBy(*[col(k) for k in keys]).agg(*[F.sum(n).alias(f"__all{n}") for n in weights])
        flat = join_on(flat, whole, keys) if keys else flat.join(F.broadcast(whole))
    found = {}
    for alias, (kind, source, start, end) in frames.items():
        i = sources.index(source)
        inside = {}
        for n in (w for w in weights if w.startswith(f"__v{i}_")):
            high = F.col(f"__all{n}" if end == Window.unboundedFollowing else f"__a{asks[2, end]}{n}")
            inside[n.split("_", 3)[3]] = high if start == Window.unboundedPreceding else high - F.col(f"__a{asks[0, start]}{n}")
        seen = inside.pop("k").cast("bigint")
        found[alias] = seen if kind == "COUNT" else F.when(seen > 0, _joined_parts(inside) if kind == "SUM" else _joined_parts(inside) / seen)
    values = flat.select(*[col(k) for k in keys], *([F.col("__own").alias(field)] if field not in keys else []), *[c.alias(a) for a, c in found.items()])
    return join_on(df, values, peers)


def _exact_parts(parts: DataFrame, name: str) -> dict[str, Column]:
    """Weights whose running totals are exact and can be subtracted, from the column ``name``.

    A double is cut into a multiple of a step so coarse that no total of such multiples is rounded, and a small rest;
    values that are not finite, if there are any, are counted, since they would swallow the totals after them.
    """
    kind = dict(parts.dtypes)[name]
    s = F.col(name)
    if kind not in ("double", "float"):
        return {"exact": F.coalesce(s, F.lit(0)).cast("decimal(38,0)" if not kind.startswith("decimal") else kind)}
    s = s.cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    # all totals stay under 2^52 steps
    largest, some = F.max(F.when(finite, F.abs(s))), F.count_if(finite)
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(largest, F.lit(1e-250)))) + F.ceil(F.log2(some + 1)) - 52)
    # three numbers reach the driver, so that the passes that follow neither compute them again nor carry idle counts
    step, known, finites = parts.agg(F.when(some > 0, step), F.count(s), some).first()
    step = F.lit(1.0 if step is None else step)
    coarse = F.when(finite, F.rint(s / step) * step).otherwise(0.0)
    count = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    whole = {"coarse": coarse, "rest": F.when(finite, s - coarse).otherwise(0.0)}
    if known == finites:
        return whole
    return whole | {
        "nan": count(F.isnan(s)),
        "up": count(s == float("inf")),
        "down": count(s == float("-inf")),
    }


def _joined_parts(inside: dict[str, Column]) -> Column:
    if "exact" in inside:
        return inside["exact"]
    if "nan" not in inside:
        return inside["coarse"] + inside["rest"]
    up, down = inside["up"] > 0, inside["down"] > 0
    odd = F.when((inside["nan"] > 0) | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf")))
    return F.coalesce(odd, inside["coarse"] + inside["rest"])


def _value_range(df, alias, kind, keys, order, src, start: int, end: int) -> DataFrame | None:
    """MIN or MAX over a RANGE frame of finite width over one numeric order column.

    Ties are combined first; then values are cut into stretches several frames wide, each with
    copies of its neighbours' edges, and a stretch is the window's partition.
    """
    finite = start > Window.unboundedPreceding and end < Window.unboundedFollowing
    fields = order_fields(order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not finite or start > end or len(fields) != 1 or not isinstance(kinds[fields[0]], NumericType):
        return None
    parts, peers = _peer_parts(df, kind, keys, order, src)
    falling = not isinstance(order[0], str) and (order[0]["direction"] if isinstance(order[0], dict) else order[0][1]).upper() == "DESC"
    place = -col(fields[0]) if falling else col(fields[0])
    before, after = max(0, -start), max(0, end)
    width = 16 * (before + after + 1)
    stretch = F.floor(F.col("__p") / width)
    inside = F.col("__p") - stretch * width
    copies = parts.withColumn("__p", place).withColumn(
        "__c",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(stretch.alias("to"), F.lit(True).alias("own")),
                    F.when(inside >= width - before, F.struct((stretch + 1).alias("to"), F.lit(False).alias("own"))),
                    F.when(inside <= after, F.struct((stretch - 1).alias("to"), F.lit(False).alias("own"))),
                )
            )
        ),
    )
    win = Window.partitionBy(*[col(k) for k in keys], F.col("__c.to")).orderBy(F.col("__p").asc_nulls_last()).rangeBetween(start, end)
    found = copies.withColumn(alias, FRAMED[kind]("__x").over(win))
    own = found.where(F.col("__c.own")).select(*[col(p) for p in peers], alias)
    return join_on(df, own, peers).drop("__in")


def _halo(df, alias, kind, keys, order, src, start: int, end: int) -> DataFrame:
    """ROWS frame of finite width: chunks of row numbers, each with copies of its neighbours' edges."""
    before, after = max(0, -start), max(0, end)
    chunk = max(max_group_rows(df.sparkSession), before + after + 1)
    rn = F.col("__rn") - 1
    numbered = number_rows(df, keys, order, "__rn", True).withColumn("__chunk", F.floor(rn / chunk))
    place = rn % chunk
    extra = F.array_compact(
        F.array(
            F.struct(F.col("__chunk").alias("to"), F.lit(True).alias("own")),
            F.when(place >= chunk - before, F.struct((F.col("__chunk") + 1).alias("to"), F.lit(False).alias("own"))),
            F.when(place < after, F.struct((F.col("__chunk") - 1).alias("to"), F.lit(False).alias("own"))),
        )
    )
    copies = numbered.withColumn("__c", F.explode(extra))
    win = (
        Window.partitionBy(*[col(k) for k in keys], F.col("__c.to")).orderBy("__rn").rowsBetween(start, end)
    )
    fn = {**FRAMED, "FIRST_VALUE": F.first_value, "LAST_VALUE": F.last_value}[kind]
    out = copies.withColumn(alias, fn(col(src)).over(win)).where(F.col("__c.own"))
    return out.drop("__rn", "__chunk", "__c")


def variation_pct(
    df: DataFrame, field: str, partition_by: Sequence[str], order_by: Sequence, alias: str = "variation_pct", offset: int = 1
) -> DataFrame:
    """Change against the row ``offset`` before, in percent; NULL without one or after a zero."""
    out = window(df, "__prev", "LAG", partition_by, order_by, field, offset)
    prev = F.col("__prev").cast("double")
    value = (col(field) - prev) / F.nullif(prev, F.lit(0.0)) * 100.0
    return out.withColumn(alias, value).drop("__prev")


def moving_average(
    df: DataFrame, field: str, partition_by: Sequence[str], order_by: Sequence, rows: int, alias: str = "moving_avg"
) -> DataFrame:
    """Mean of this row and the ``rows - 1`` before it."""
    frame = {"kind": "ROWS", "start": f"{rows - 1} PRECEDING", "end": "CURRENT ROW"}
    return window(df, alias, "AVG", partition_by, order_by, field, frame=frame)


def running_sum(
    df: DataFrame, field: str, partition_by: Sequence[str], order_by: Sequence, alias: str = "running_sum"
) -> DataFrame:
    frame = {"kind": "ROWS", "start": "UNBOUNDED PRECEDING", "end": "CURRENT ROW"}
    return window(df, alias, "SUM", partition_by, order_by, field, frame=frame)


def top_by_rank(df: DataFrame, order_by: Sequence, n: int, partition_by: Sequence[str] = (), alias: str = "rank") -> DataFrame:
    """Rows with RANK at most ``n``; ties at the last place are all kept.

    The ``n``-th row of each group bounds the result, so no whole group is sorted: first the best
    ``n`` rows per group are found, then every row that is at least as good is kept and ranked.
    """
    keys = list(partition_by)
    fields = list(dict.fromkeys([*keys, *order_fields(order_by)]))
    counts = df.groupBy(*[col(f) for f in fields]).agg(F.count(F.lit(1)).alias("__n"))
    best = top_per_group(counts, keys, order_by, n, "__pos")
    win = Window.partitionBy(*[col(k) for k in keys]).orderBy("__pos")
    ahead = F.coalesce(F.sum("__n").over(win.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = best.withColumn(alias, (ahead + 1).cast("int")).where(F.col(alias) <= n)
    return join_on(df, ranks.select(*[col(f) for f in fields], alias), fields, "inner")
