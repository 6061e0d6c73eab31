"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Inner products become distances: candidates are scaled by the largest norm and given one more entry that makes them unit
vectors, queries are scaled to unit length with a zero there. Each table hashes a vector by floor((a v + b) / w) for a
few Gaussian (2-stable) directions a; the joint cell is the bucket.

First every query visits its home bucket in each table. Its 20th best score there bounds the similarity c of what is
still to be found. Given c, the projection of a neighbour on a direction is normal around c times the query's own
projection with variance 1 - c*c, so the success probability of every perturbed bucket is a product of normal
integrals. Buckets are visited in falling order of it until the chance that all tables miss a neighbour at c is at most
``MISS``. Queries that still find too few visit every bucket of one table, so nothing is lost to sparse cells.

Rows stay where they are read: each task packs the vectors of a bucket into blocks, and the queries that probe a bucket
likewise. Blocks meet in a join by bucket, which Spark may split where one bucket is hot, and each pair of blocks is one
matrix product. Scores at or above a query's bound are computed anew, each product and the sum with its rounding errors
carried, so equal vectors have equal scores wherever they lie. Only the best of each query leave a task.

Buckets hold about 16 times the root of the number of rows, so the number of probes grows slower than the rows.

Defined results: rows whose vector is NULL, empty, zero or holds NULL or non-finite entries take no part, nor do vectors
of another length than most have. Rows with the same id and vector are one row; a query's own row is never found, other
rows of the same id may be. Ties go to the smaller id (NULL last). Tables of fewer than 1,024 rows have one bucket, so
the search is exact there. Rows with a NULL id are found but never ask. An empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.vectors import matrix, usable
from tamis.session import materialize

TABLES, WIDTH, MISS = 2, 3.0, 0.05
NEIGHBOURS = 20
BLOCK_ROWS = 4096
QUERY_BLOCK = 512
HELD_ROWS = 16_384
BUFFER = 200_000


class Hashing(NamedTuple):
    """Directions (table, function, entry) and offsets (table, function), and what scales vectors to unit length."""

    directions: np.ndarray
    offsets: np.ndarray
    largest: float
    length: int

    def projections(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(row, table, function) projections of unit vectors."""
        v = vectors.astype(np.float64)
        v = v / (np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1) * np.abs(v).max(axis=1))[:, None] if query else v / self.largest
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, 1.0 - np.square(v).sum(axis=1)))
        return np.einsum("nd,tkd->ntk", np.column_stack([v, rest]), self.directions)

    def cells(self, projections: np.ndarray) -> np.ndarray:
        return np.floor((projections + self.offsets) / WIDTH).astype(np.int64)


def functions_for(rows: int) -> int:
    """Hash functions a table takes, so that its buckets hold about 16 sqrt(rows)."""
    return max(0, int(math.log2(rows) / 2 - 4)) if rows else 0


def hashing(rows: DataFrame, length: int, tables: int = TABLES, seed: int = 13) -> Hashing:
    """One pass for the number of rows and their largest norm."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).first()
    rng = np.random.default_rng(seed)
    count = functions_for(found["n"])
    directions = rng.normal(size=(tables, count, length + 1))
    return Hashing(directions, rng.uniform(0, WIDTH, size=(tables, count)), float(found["largest"] or 1.0) * (1 + 1e-12), length)


def _bucket(table: int, cell: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(cell.tobytes(), seed=table) - (1 << 63)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7."""
    # fixed values of the usual rational approximation
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * np.abs(x))
    tail = np.exp(-np.square(x) / 2) / math.sqrt(2 * math.pi) * t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return np.where(x > 0, 1 - tail, tail)


def probe_order(projection: np.ndarray, offset: np.ndarray, c: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells, success probabilities) of one table, most likely first, until less than ``miss`` is left.

    ``projection`` is the query's, by function. Partial products that are too unlikely to be among the buckets wanted are
    cut; the cut is lowered until enough is found.
    """
    c = min(max(c, 0.0), 1.0)
    spread = max(math.sqrt(1 - c * c), 1e-6)
    reach = 6.0
    options = []
    for p, b in zip(projection, offset):
        low, high = math.floor((c * p - reach * spread + b) / WIDTH), math.floor((c * p + reach * spread + b) / WIDTH)
        cells = np.arange(low, high + 1)
        ends = (np.arange(low, high + 2) * WIDTH - b - c * p) / spread
        odds = np.diff(_normal(ends))
        options.append((cells, np.maximum(odds, 0)))
    cut = miss / 8
    while True:
        cells, odds = np.zeros((1, 0), np.int64), np.ones(1)
        for values, chances in options:
            product = odds[:, None] * chances[None, :]
            at, of = np.nonzero(product >= cut)
            cells, odds = np.column_stack([cells[at], values[of]]), product[at, of]
        order = np.argsort(-odds, kind="stable")
        cells, odds = cells[order], odds[order]
        sums = np.cumsum(odds)
        if len(sums) and sums[-1] >= 1 - miss:
            count = int(np.searchsorted(sums, 1 - miss)) + 1
            return cells[:count], odds[:count]
        if cut < 1e-14:
            return cells, odds
        cut /= 16


def _row_hash(vector: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(vector.tobytes()) - (1 << 63)


def _blocks_schema(key: pa.DataType, query: bool) -> pa.Schema:
    return pa.schema([("bucket", pa.int64()), ("keys", pa.list_(key)), ("hashes", pa.list_(pa.int64())), ("vectors", pa.binary()), *([("bounds", pa.list_(pa.float64())), ("block", pa.int64())] if query else [])])


def _ddl(key: str, query: bool) -> str:
    return f"bucket bigint, keys array<{key}>, hashes array<bigint>, vectors binary" + (", bounds array<double>, block bigint" if query else "")


class _Packer:
    """Rows of a task by bucket; full blocks leave at once, the rest when many rows are held."""

    def __init__(self, schema: pa.Schema, limit: int):
        self.schema, self.limit, self.held, self.count = schema, limit, {}, 0

    def add(self, bucket: int, row: tuple) -> Iterator[pa.RecordBatch]:
        rows = self.held.setdefault(bucket, [])
        rows.append(row)
        self.count += 1
        if len(rows) == self.limit:
            yield self._block(bucket, self.held.pop(bucket))
        elif self.count >= HELD_ROWS:
            yield from self.rest()

    def _block(self, bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        self.count -= len(rows)
        columns = [[bucket], [[r[0] for r in rows]], [[r[1] for r in rows]], [b"".join(r[2] for r in rows)]]
        if len(self.schema) > 4:
            name = xxhash.xxh64_intdigest(b"".join(str(r[:2]).encode() for r in rows), seed=bucket & 0xFFFFFFFF) - (1 << 63)
            columns += [[[r[3] for r in rows]], [name]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema)], schema=self.schema)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for bucket, rows in list(self.held.items()):
            yield self._block(bucket, rows)
        self.held = {}


def index(rows: DataFrame, hashes: Hashing) -> DataFrame:
    """Every row in a block of its bucket in every table; stored."""
    kind = dict(rows.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            packer = packer or _Packer(_blocks_schema(batch.schema.field(0).type, False), BLOCK_ROWS)
            vectors = matrix(batch, hashes.length)
            cells = hashes.cells(hashes.projections(vectors, query=False))
            for i, key in enumerate(batch.column(0).to_pylist()):
                row = (key, _row_hash(vectors[i]), vectors[i].tobytes())
                for t in range(cells.shape[1]):
                    yield from packer.add(_bucket(t, cells[i, t]), row)
        if packer:
            yield from packer.rest()

    return materialize(rows.mapInArrow(scan, _ddl(kind, False)), "index")


def probes(queries: DataFrame, hashes: Hashing, wanted: str, miss: float = MISS, spans: list[tuple[int, int]] | None = None) -> DataFrame:
    """Queries in blocks of the buckets that they visit.

    ``wanted``: "home" for the own buckets; "perturbed" for the further ones by the column ``bound``; "all" for every cell
    of the first table inside ``spans``.
    """
    kind = dict(queries.dtypes)["key"]
    each = miss ** (1 / len(hashes.directions))

    def visited(projection: np.ndarray, homes: np.ndarray, bound: float, norm: float) -> Iterator[tuple[int, np.ndarray]]:
        for t in range(len(homes)):
            if wanted == "home":
                yield t, homes[t]
            elif wanted == "perturbed":
                for cell in probe_order(projection[t], hashes.offsets[t], bound / (norm * hashes.largest), each)[0]:
                    if not np.array_equal(cell, homes[t]):
                        yield t, cell
            elif t == 0:
                grid = np.meshgrid(*[np.arange(a, b + 1) for a, b in spans], indexing="ij")
                yield from ((t, cell) for cell in np.column_stack([g.ravel() for g in grid]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            packer = packer or _Packer(_blocks_schema(batch.schema.field(0).type, True), QUERY_BLOCK)
            vectors = matrix(batch, hashes.length)
            bounds = batch.column(2).to_numpy(zero_copy_only=False)
            norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
            projections = hashes.projections(vectors, query=True)
            homes = hashes.cells(projections)
            for i, key in enumerate(batch.column(0).to_pylist()):
                row = (key, _row_hash(vectors[i]), vectors[i].tobytes(), bounds[i])
                for t, cell in visited(projections[i], homes[i], bounds[i], norms[i]):
                    yield from packer.add(_bucket(t, np.ascontiguousarray(cell, np.int64)), row)
        if packer:
            yield from packer.rest()

    return queries.mapInArrow(scan, _ddl(kind, True))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, with the errors of all steps carried: one result per pair of vectors."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    total, lost = np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        p = x * y
        # what rounding took from the product, by halves of 26 bits
        xh, yh = x * 134217729.0, y * 134217729.0
        xh, yh = xh - (xh - x), yh - (yh - y)
        error = ((xh * yh - p) + xh * (y - yh) + (x - xh) * yh) + (x - xh) * (y - yh)
        s = total + p
        z = s - total
        lost += (total - (s - z)) + (p - z) + np.where(np.isfinite(error), error, 0)
        total = s
    out = total + lost
    return np.where(np.isfinite(out), out, total)


class _Best:
    """The best candidates of each query that a task has met. A buffer is cut back to them when it is full."""

    def __init__(self, count: int):
        self.count, self.slots, self.names, self.bounds = count, {}, [], np.empty(0)
        self.parts, self.held = [], 0

    def slots_of(self, keys: list, hashes: list, bounds: list) -> np.ndarray:
        out = np.empty(len(keys), np.int64)
        fresh = []
        for i, name in enumerate(zip(keys, hashes)):
            slot = self.slots.get(name)
            if slot is None:
                slot = self.slots[name] = len(self.names)
                self.names.append(name)
                fresh.append(bounds[i])
            out[i] = slot
        self.bounds = np.concatenate([self.bounds, fresh])
        return out

    def add(self, slots, keys, hashes, scores):
        self.parts.append((slots, keys, hashes, scores))
        self.held += len(slots)
        if self.held > BUFFER:
            self.cut()

    def cut(self):
        if not self.parts:
            return
        slots, hashes, scores = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2, 3))
        keys = pa.concat_arrays([p[1] for p in self.parts])
        places = pa.compute.rank(keys, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((hashes, places, -scores, slots))
        # a candidate that was met in two tables has the same place twice in a row
        again = np.ones(len(order), bool)
        for column in (slots, places, hashes):
            again[1:] &= column[order[1:]] == column[order[:-1]]
        again[:1] = False
        order = order[~again]
        ordered = slots[order]
        first = np.searchsorted(ordered, ordered)
        order = order[np.arange(len(order)) - first < self.count]
        self.parts = [(slots[order], keys.take(pa.array(order)), hashes[order], scores[order])]
        self.held = len(order)
        filled, counts = np.unique(slots[order], return_counts=True)
        for slot, end, n in zip(filled, np.cumsum(counts), counts):
            if n == self.count:
                self.bounds[slot] = max(self.bounds[slot], scores[order[end - 1]])


def _visit(blocks: DataFrame, asked: DataFrame, length: int, kind: str, entry: np.dtype, neighbours: int) -> DataFrame:
    """(query, query_hash, found, found_hash, score): the best of what queries meet in the buckets that they visit, by task."""
    queries = asked.select("bucket", F.col("keys").alias("query_keys"), F.col("hashes").alias("query_hashes"), F.col("vectors").alias("query_vectors"), "bounds", "block")
    met = blocks.join(queries, "bucket").select("keys", "hashes", "vectors", "query_keys", "query_hashes", "query_vectors", "bounds", "block")
    # rounding of single products and sums, as a share of the product of norms
    slack = 2 * (length + 2) * float(np.finfo(entry).eps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known, key_type = _Best(neighbours), {}, None
        for batch in batches:
            key_type = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                keys, hashes = batch.column(0)[i].values, np.asarray(batch.column(1)[i].values)
                x = np.frombuffer(batch.column(2)[i].as_buffer(), entry).reshape(-1, length)
                q = np.frombuffer(batch.column(5)[i].as_buffer(), entry).reshape(-1, length)
                block = batch.column(7)[i].as_py()
                if block not in known:
                    known[block] = best.slots_of(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), batch.column(6)[i].as_py())
                slots = known[block]
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = q @ x.T
                    margin = slack * np.linalg.norm(q.astype(np.float64), axis=1) * np.linalg.norm(x.astype(np.float64), axis=1).max()
                    least = best.bounds[slots]
                    if rough.shape[1] > neighbours + 1:  # own row included, so one more than wanted
                        inside = np.partition(rough, rough.shape[1] - neighbours - 1, axis=1)[:, rough.shape[1] - neighbours - 1]
                        least = np.maximum(least, inside.astype(np.float64) - margin)
                    at, of = np.nonzero(~(rough < (least - margin)[:, None]))
                own = (hashes[of] == np.asarray(batch.column(4)[i].values)[at]) & np.asarray(pa.compute.fill_null(pa.compute.equal(keys.take(pa.array(of)), batch.column(3)[i].values.take(pa.array(at))), False))
                at, of = at[~own], of[~own]
                scores = exact_products(q[at], x[of])
                good = scores >= best.bounds[slots[at]]
                best.add(slots[at[good]], keys.take(pa.array(of[good])), hashes[of[good]], scores[good])
        best.cut()
        for slots, keys, hashes, scores in best.parts:
            names = [best.names[s] for s in slots]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names], key_type), pa.array([n[1] for n in names], pa.int64()), keys, pa.array(hashes), pa.array(scores)],
                ["query", "query_hash", "found", "found_hash", "score"],
            )

    return met.mapInArrow(scan, f"query {kind}, query_hash bigint, found {kind}, found_hash bigint, score double")


def _best(found: DataFrame, neighbours: int) -> DataFrame:
    """The best of each query over all tasks and tables, with ``rank``."""
    distinct = found.dropDuplicates(["query", "query_hash", "found", "found_hash"])
    by = Window.partitionBy("query", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("found"), "found_hash")
    return distinct.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= neighbours)


def nearest(
    embeddings: DataFrame, asks: Column | str, *, key: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS, tables: int = TABLES, miss: float = MISS
) -> DataFrame:
    """query, rank, found, score: the nearest rows of each row for which ``asks`` (over the column ``key``) holds."""
    rows, length = usable(embeddings, key, vector)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    kinds = dict(rows.dtypes)
    kind, entry = kinds["key"], np.dtype(np.float32 if kinds["vector"] == "array<float>" else np.float64)
    hashes = hashing(rows, length, tables)
    blocks = index(rows, hashes)
    asking = rows.where(asks)
    home = asking.withColumn("bound", F.lit(float("-inf")))
    visit = lambda asked: _visit(blocks, asked, length, kind, entry, neighbours)
    found = materialize(_best(visit(probes(home, hashes, "home")), neighbours), "home")
    if hashes.directions.shape[1]:
        bounds = found.where(F.col("rank") == neighbours).groupBy(F.col("query").alias("key")).agg(F.min("score").alias("bound"))
        bounded = asking.join(bounds, "key", "left").select("key", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        further = materialize(visit(probes(bounded, hashes, "perturbed", miss)), "further")
        found = materialize(_best(found.drop("rank").unionByName(further), neighbours), "found")
        counts = found.groupBy("query").agg(F.max("rank").alias("n")).where(F.col("n") == neighbours).select(F.col("query").alias("key"))
        short = asking.join(counts, "key", "left_anti").withColumn("bound", F.lit(float("-inf")))
        if not short.isEmpty():
            rest = visit(probes(short, hashes, "all", spans=_spans(rows, hashes)))
            found = _best(found.drop("rank").unionByName(rest), neighbours)
    return found.select("query", "rank", "found", "score")


def _spans(rows: DataFrame, hashes: Hashing) -> list[tuple[int, int]]:
    """Least and largest cell of each function of the first table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = hashes.cells(hashes.projections(matrix(batch, hashes.length), query=False))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.shape[1])), pa.array(cells.min(axis=0)), pa.array(cells.max(axis=0))], ["f", "low", "high"])

    ends = rows.mapInArrow(scan, "f bigint, low bigint, high bigint").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return [(r["low"], r["high"]) for r in sorted(ends)]
