"""Whitening of embeddings by their leading principal components, found with Jacobi-Davidson.

Entries become integers, so that sums, means and deviations are exact. The fit list holds each distinct integer vector
once: duplicates meet in one grouping of packed bytes, after a first pass in each task. It is stored as blocks of packed
rows, and every product of the covariance with a block of vectors (``jacobi_davidson``) is one distributed pass over
them: each task centres its rows, multiplies, and returns one partial sum of the size of the vectors. Partial sums of
all tasks together stay under ``PARTIAL_BYTES``; beyond that tasks read more blocks each. The covariance matrix is never
formed.

Defined results: rows whose vector is NULL, empty, or holds NULL, non-finite entries or entries of 10**15 and more take no
part, nor do vectors of another length than most have. Components without variance cannot be scaled and are left out,
so a table with one distinct vector gives no rows. Equal rows give equal rows. A deviation beyond 64 bits is NULL. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm import jacobi_davidson
from tamis.llm.vectors import matrix, usable
from tamis.session import materialize

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1e15
COMPONENTS = 16
BLOCK_ROWS = 8192
PARTIAL_BYTES = 64 << 20


class Model(NamedTuple):
    length: int
    rows: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c), without the offset that all entries share."""
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64)


def _packed(row: np.ndarray) -> bytes:
    """The shortest of three integer types that holds the row; equal rows have equal bytes."""
    most = np.abs(row).max()
    return row.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpacked(rows: list[bytes], length: int) -> np.ndarray:
    by_size = {size: [i for i, r in enumerate(rows) if len(r) == size * length] for size in (2, 4, 8)}
    out = np.empty((len(rows), length), np.int64)
    for size, at in by_size.items():
        if at:
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), f"<i{size}").reshape(-1, length)
    return out


def fit_list(rows: DataFrame, length: int) -> DataFrame:
    """``block``: distinct integer vectors, many packed into one binary value with an even width; stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = {_packed(r) for r in _integers(matrix(batch, length))}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], ["packed"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def block():
            x = _unpacked(held, length)
            most = np.abs(x).max()
            return pa.RecordBatch.from_arrays([pa.array([x.astype("<i2" if most < 1 << 15 else "<i8").tobytes()], pa.binary()), pa.array([len(held)])], ["block", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.append(value)
                if len(held) == BLOCK_ROWS:
                    yield block()
                    held = []
        if held:
            yield block()

    distinct = rows.mapInArrow(pack, "packed binary").distinct()
    return materialize(distinct.mapInArrow(blocks, "block binary, n bigint"), "fit")


def _sums(fit: DataFrame, length: int, partial: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of ``partial`` of its blocks; one array of ``width`` numbers from each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data, n in zip(batch.column(0), batch.column(1)):
                raw = data.as_buffer()
                x = np.frombuffer(raw, f"<i{raw.size // (n.as_py() * length)}").reshape(-1, length)
                part = partial(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["part"])

    tasks = max(1, PARTIAL_BYTES // (8 * width))
    parts = fit.coalesce(tasks).mapInArrow(scan, "part binary").collect()
    return np.sum([np.frombuffer(p[0], np.float64) for p in sorted(parts)], axis=0) if parts else np.zeros(width)


def _wide_sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """(rows, exact sums of the integers without offset); halves of 32 bits keep sums of many rows exact."""

    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64).view(np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, n in zip(batch.column(0), batch.column(1)):
                raw = data.as_buffer()
                part = halves(np.frombuffer(raw, f"<i{raw.size // (n.as_py() * length)}").reshape(-1, length)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), pa.array(part)], ["place", "part"])

    parts = fit.mapInArrow(scan, "place bigint, part bigint").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["place"]: int(r["total"]) for r in parts}
    return total.get(0, 0), [(total.get(1 + i, 0) << 32) + total.get(1 + length + i, 0) for i in range(length)]


def _centre(x: np.ndarray, rows: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """(x - mean as double, n x - S as exact integers); the integers are of Python's type where 64 bits might not do."""
    middle = [s // rows for s in sums]
    off = x.astype(np.int64) - np.array(middle, np.int64)
    rest = [s - m * rows for s, m in zip(sums, middle)]
    if int(np.abs(off).max(initial=0)) * rows + rows < 1 << 53:
        exact = off * rows - np.array(rest, np.int64)
        return exact / rows, exact
    exact = off.astype(object) * rows - np.array(rest, object)
    return (off - np.array([r / rows for r in rest])), exact


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Model:
    """Leading components of the covariance of the fit list of ``rows`` (from ``usable``), and the check of the whitening."""
    found = fit_list(rows, length)
    n, sums = _wide_sums(found, length)
    if not n:
        return Model(length, 0, [0] * length, np.zeros(0), np.zeros((length, 0)), 0.0, 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            c = _centre(x, n, sums)[0]
            return (c.T @ (c @ block)).ravel()

        return _sums(found, length, partial, block.size).reshape(block.shape) / n

    values, vectors, _ = jacobi_davidson.leading(product, length, components)
    trace = float(_sums(found, length, lambda x: np.square(_centre(x, n, sums)[0]).sum(axis=0), length).sum()) / n
    some = values > 16 * length * jacobi_davidson.EPS * max(values[0], 0.0)
    values, vectors = values[some], vectors[:, some]
    count = len(values)
    if not count:
        return Model(length, n, sums, values, vectors, trace, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centre(x, n, sums)[0] @ vectors / np.sqrt(values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _sums(found, length, moments, count + count * count) / n
    covariance = got[count:].reshape(count, count) - np.outer(got[:count], got[:count])
    return Model(length, n, sums, values, vectors, trace, float(np.abs(covariance - np.eye(count)).max(initial=0.0)))


def whitened(rows: DataFrame, model: Model) -> DataFrame:
    """key, vector, n, deviation, whitened (array of one double per component) for each usable row."""
    kind = dict(rows.dtypes)
    length, n, sums, values, vectors, _, _ = model

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, exact = _centre(_integers(matrix(batch, length)), n, sums)
            w = c @ vectors / np.sqrt(values)
            if exact.dtype != object and int(np.abs(exact).max()) ** 2 * length < 1 << 63:
                deviation = (exact * exact).sum(axis=1).tolist()
            else:
                whole = exact.astype(object)
                deviation = [v if v < 1 << 63 else None for v in (whole * whole).sum(axis=1)]
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(len(w), n)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                ["key", "vector", "n", "deviation", "whitened"],
            )

    return rows.mapInArrow(scan, f"key {kind['key']}, vector {kind['vector']}, n bigint, deviation bigint, whitened array<double>")


def whiten(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Model]:
    """(the whitened rows, the model)."""
    rows, length = usable(embeddings, key, vector, below=LARGEST)
    model = fit(rows, length, components)
    return whitened(rows, model), model
