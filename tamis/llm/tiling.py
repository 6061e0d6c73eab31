"""Benchmark decontamination by greedy string tiling.

Documents meet test items by shared runs of ``MIN_TILE`` tokens (seeds). For each document and item that share a seed,
running Karp-Rabin finds the longest common runs of tokens that nothing covers yet, marks them as tiles, and goes on
with shorter ones down to ``MIN_TILE``. Tiles may stand in any order, so reordered passages are found as well. A
document leaks an item when tiles cover at least ``COVERAGE`` of the item's tokens.

Tokens are runs of word characters in lower case. The items form a stated query set: they go to the tasks in blocks of
bounded size, one pass over the documents per block; documents are never shuffled.

Defined results: NULL and empty texts leak nothing. Items of fewer than ``MIN_TILE`` tokens cannot be told from chance
and are never leaked. Rows with the same item text are items of their own. Repeated documents are reported each. Empty
tables give an empty result. Other columns pass through or are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tamis.llm.common import arrow_schema, bounded_batches, frugal, inputs, text_or_empty

MIN_TILE, COVERAGE = 5, 0.6
BLOCK_BYTES = 16_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Rolling:
    """Karp-Rabin hashes of all windows of a sequence, for any width."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.powers = np.ones(n + 1, np.uint64)
        self.powers[1:] = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = np.cumsum((ids + 2).astype(np.uint64) * self.powers[:n], dtype=np.uint64)

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window, shifted so that equal windows hash alike wherever they stand."""
        count = len(self.sums) - width
        return (self.sums[width:] - self.sums[:count]) * _inverse_powers(count) if count > 0 else np.empty(0, np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _inverse_powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.cumprod(np.full(max(0, n - 1), _INVERSE, np.uint64), dtype=np.uint64)
    return out


def _free_windows(free: np.ndarray, width: int) -> np.ndarray:
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[width:] == taken[:-width]) if len(free) >= width else np.empty(0, np.int64)


def tile(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length). Ids below 0 never match."""
    item_free, text_free = item >= 0, text >= 0
    item_hash, text_hash = Rolling(item), Rolling(text)
    tiles: list[tuple[int, int, int]] = []
    width = max(min_tile, min(len(item), len(text)))
    while width >= min_tile:
        found = _longest_first(item, text, item_free, text_free, item_hash, text_hash, width)
        longest = found[0][0] if found else 0
        if longest > 2 * width:
            width = longest
            continue
        for length, a, b in found:
            if item_free[a : a + length].all() and text_free[b : b + length].all():
                item_free[a : a + length] = False
                text_free[b : b + length] = False
                tiles.append((a, b, length))
            # a match that an earlier tile covers in part is found again below, as a shorter one
        if found and any(item_free[a : a + width].all() and text_free[b : b + width].all() for _, a, b in found):
            continue
        if width == min_tile:
            # parts of covered matches that are still as long as a tile
            if found:
                continue
            break
        width = max(min_tile, width // 2)
    return tiles


def _longest_first(item, text, item_free, text_free, item_hash, text_hash, width) -> list[tuple[int, int, int]]:
    """Maximal uncovered common runs of at least ``width`` tokens: (length, item start, text start), longest first."""
    a_at, b_at = _free_windows(item_free, width), _free_windows(text_free, width)
    if not len(a_at) or not len(b_at):
        return []
    a_hash, b_hash = item_hash.windows(width)[a_at], text_hash.windows(width)[b_at]
    order = np.argsort(a_hash, kind="stable")
    a_at, a_hash = a_at[order], a_hash[order]
    low, high = np.searchsorted(a_hash, b_hash, "left"), np.searchsorted(a_hash, b_hash, "right")
    found, seen = [], set()
    for k in np.flatnonzero(high > low):
        b = int(b_at[k])
        for a in map(int, a_at[low[k] : high[k]]):
            if a and b and item_free[a - 1] and text_free[b - 1] and item[a - 1] == text[b - 1]:
                continue  # not the start of a maximal run
            most = min(len(item) - a, len(text) - b)
            same = (item[a : a + most] == text[b : b + most]) & item_free[a : a + most] & text_free[b : b + most]
            length = most if same.all() else int(same.argmin())
            if length >= width and (a, b) not in seen:  # the hash only proposes
                seen.add((a, b))
                found.append((length, a, b))
    return sorted(found, key=lambda f: (-f[0], f[1], f[2]))


class Items:
    """A block of test items with its seeds."""

    def __init__(self, rows: list[tuple[object, str]], min_tile: int = MIN_TILE):
        self.min_tile = min_tile
        self.vocabulary: dict[str, int] = {}
        self.keys, self.ids = [], []
        for key, text in rows:
            words = tokens(text)
            if len(words) >= min_tile:
                self.keys.append(key)
                self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        seeds = [(h, k) for k, ids in enumerate(self.ids) for h in np.unique(self._seeds(ids)).tolist()]
        seeds.sort()
        self.seed = np.array([h for h, _ in seeds], np.uint64)
        self.owner = np.array([k for _, k in seeds], np.int64)

    def _seeds(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.min_tile + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(self.min_tile):
            out = out * _BASE + (ids[k : k + n] + 2).astype(np.uint64)
        return out

    def leaks(self, text: str, coverage: float) -> Iterator[tuple[object, float, list[tuple[int, int, int]]]]:
        """(item, covered share, tiles) of each item that tiles of ``text`` cover enough."""
        words = tokens(text)
        if len(words) < self.min_tile or not len(self.seed):
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = _free_windows(ids >= 0, self.min_tile)
        if not len(known):
            return
        hashes = self._seeds(ids)[known]
        low, high = np.searchsorted(self.seed, hashes, "left"), np.searchsorted(self.seed, hashes, "right")
        hit = high > low
        if not hit.any():
            return
        # only tokens inside a seed can be part of a tile
        covered = np.zeros(len(ids) + 1, np.int64)
        np.add.at(covered, known[hit], 1)
        np.add.at(covered, known[hit] + self.min_tile, -1)
        places = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        # a gap between two runs of such tokens stays as one token that never matches
        gap = np.flatnonzero(np.diff(places) > 1) + 1
        short, position = np.insert(ids[places], gap, -1), np.insert(places, gap, -1)
        for owner in np.unique(np.concatenate([self.owner[a:b] for a, b in set(zip(low[hit].tolist(), high[hit].tolist()))])):
            item = self.ids[owner]
            tiles = tile(item, short, self.min_tile)
            share = sum(n for _, _, n in tiles) / len(item)
            if share >= coverage:
                yield self.keys[owner], share, sorted((a, int(position[b]), n) for a, b, n in tiles)


def blocks(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes``, so that neither driver nor tasks hold more at once."""
    rows = inputs(benchmark, item=item, text=text).select("item", text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64(F.col("item").cast("string"), F.col("text")), F.lit(count)) == block)
        yield Items([(r["item"], r["text"]) for r in part.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it leaks: key, item, coverage, tiles (item_start, text_start, length in tokens)."""
    narrow = inputs(docs, key=key, text=text)
    item_kind = dict(benchmark.dtypes)[item]
    described = f"key {dict(narrow.dtypes)['key']}, item {item_kind}, coverage double, tiles array<struct<item_start:int,text_start:int,length:int>>"
    schema = _parse_datatype_string(described)
    target = arrow_schema(schema)
    out = None
    for items in blocks(benchmark, item=item, text=item_text):

        def scan(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(row, *leak) for row, v in enumerate(batch.column(1)) for leak in items.leaks(v.as_py() or "", coverage)]
                tiles = [[{"item_start": a, "text_start": b, "length": n} for a, b, n in r[3]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], target.field("item").type),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array(tiles, target.field("tiles").type),
                    ],
                    schema=target,
                )

        found = narrow.mapInArrow(frugal(scan), schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that leak no item, all columns as they are."""
    place = bounded_batches(docs).columns.index(text)
    for items in blocks(benchmark, item=item, text=item_text):

        def scan(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(items.leaks(v.as_py() or "", coverage), None) is None for v in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(frugal(scan), docs.schema)
    return docs
