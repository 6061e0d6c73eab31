"""Equi-joins with one column rule for all join types.

A key of the same name on both sides is kept once (coalesced for RIGHT and FULL_OUTER); any other
name that both sides have gets the suffix ``_right`` on the right side. No side is hinted for
broadcast: Spark decides from the measured size, and splits a skewed key at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.scalars import col

# The join types of a workflow.
JOIN_TYPES = {
    "INNER": "inner",
    "LEFT": "left",
    "RIGHT": "right",
    "FULL_OUTER": "full",
    "SEMI": "left_semi",
    "ANTI": "left_anti",
}


def key_pairs(on: Sequence) -> list[tuple[str, str]]:
    """``[{"left": a, "right": b}]``, ``[("a", "b")]`` or ``["a"]`` as pairs."""
    pairs = []
    for item in on:
        if isinstance(item, str):
            pairs.append((item, item))
        elif isinstance(item, dict):
            pairs.append((item["left"], item["right"]))
        else:
            pairs.append(tuple(item))
    if not pairs:
        raise ValueError("a join needs at least one key pair")
    return pairs


def join(left: DataFrame, right: DataFrame, on: Sequence, join_type: str = "INNER") -> DataFrame:
    kind = join_type.upper()
    if kind not in JOIN_TYPES:
        raise ValueError(f"join type '{join_type}' is not supported")
    pairs = key_pairs(on)
    if kind == "FULL_OUTER":
        return _full(left, right, pairs)
    return _joined(left, right, pairs, JOIN_TYPES[kind])


def _prefixed(right: DataFrame) -> DataFrame:
    return right.select(*[col(c).alias(f"__r_{c}") for c in right.columns])


def _condition(pairs: list[tuple[str, str]]) -> Column:
    cond = None
    for a, b in pairs:
        test = col(a) == col(f"__r_{b}")
        cond = test if cond is None else cond & test
    return cond


def _joined(left: DataFrame, right: DataFrame, pairs, how: str) -> DataFrame:
    shared = {a for a, b in pairs if a == b}
    r = _prefixed(right)
    out = left.join(r, _condition(pairs), how)
    if how in ("left_semi", "left_anti"):
        return out
    keep = []
    for c in left.columns:
        keep.append(F.coalesce(col(c), col(f"__r_{c}")).alias(c) if how == "right" and c in shared else col(c))
    for c in right.columns:
        if c not in shared:
            keep.append(col(f"__r_{c}").alias(f"{c}_right" if c in left.columns else c))
    return out.select(*keep)


def _full(left: DataFrame, right: DataFrame, pairs) -> DataFrame:
    """LEFT rows plus the right rows without a match.

    Spark cannot split a hot key of a full outer join; it can split both joins used here.
    """
    matched = _joined(left, right, pairs, "left")
    known = left.select(*[col(a).alias(f"__r_{a}") for a, _ in pairs]).distinct()
    cond = None
    for a, b in pairs:
        test = col(b) == col(f"__r_{a}")
        cond = test if cond is None else cond & test
    missed = right.join(known, cond, "left_anti")
    shared = {a for a, b in pairs if a == b}
    types = dict(left.dtypes)
    # a key that both sides have takes the type that holds both
    wide = {c: left.select(col(c)).union(right.select(col(c))).dtypes[0][1] for c in shared}
    matched = matched.withColumns({c: col(c).cast(kind) for c, kind in wide.items()})
    padded = [(col(c).cast(wide[c]) if c in shared else F.lit(None).cast(types[c])).alias(c) for c in left.columns]
    for c in right.columns:
        if c not in shared:
            padded.append(col(c).alias(f"{c}_right" if c in left.columns else c))
    return matched.unionByName(missed.select(*padded))


def enrich(fact: DataFrame, reference: DataFrame, on: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """LEFT join to reference data, taking only the named reference columns."""
    pairs = key_pairs(on)
    if columns is not None:
        wanted = list(dict.fromkeys([*[b for _, b in pairs], *columns]))
        reference = reference.select(*[col(c) for c in wanted])
    return join(fact, reference, on, "LEFT")
