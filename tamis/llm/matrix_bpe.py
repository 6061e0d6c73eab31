"""Byte-level BPE encoding and decoding over padded numpy matrices.

Distinct pieces of a batch are laid out as rows of matrices, one matrix per length bucket. In every round each row
merges its leftmost pair of least rank; ranks of pairs come from an open-addressing hash table in numpy arrays. Rows
that have no pair left are taken out and the others close the gaps of their merges (compaction).

Two things keep the rounds of long pieces few, with the same ids. The pairs of a row that share its least rank are
merged in one round, unless a merge among them makes a pair of lower rank, which would come first; then only the
leftmost is. And a long piece is cut where no token of the vocabulary spans the border, so that no merge can cross it;
its parts are rows of their own.

Defined results: NULL counts as empty; an empty text has no ids. Any text round-trips, since all 256 bytes have ranks.
Repeated rows each get their row. Very long texts are cut into pieces first, very long pieces as above. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.common import frugal, inputs
from tamis.llm.pretokens import PieceCache, pieces

NEVER = np.int32(2**31 - 1)
BATCH_CHARS = 2_000_000
LONG_BYTES = 256  # longer pieces are cut where no token can span
SHORT = 32  # wider matrices merge all pairs of the least rank in one round
_BASE = 0x9E3779B97F4A7C15


class PairTable:
    """(left id, right id) -> id of the merged token, by hashing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), 2**bits - 1
        self.keys = np.full(2**bits, -1, np.int64)
        self.values = np.full(2**bits, NEVER, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, open_rows = self._slot(keys), np.arange(len(keys))
        while len(open_rows):
            free = self.keys[slot[open_rows]] == -1
            placed = open_rows[free]
            self.keys[slot[placed]] = keys[placed]  # of rows with the same slot the last one stays
            stays = self.keys[slot[open_rows]] == keys[open_rows]
            done = open_rows[stays]
            self.values[slot[done]] = merged[done]
            open_rows = open_rows[~stays]
            slot[open_rows] = (slot[open_rows] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, or NEVER. Padding (-1) never matches."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NEVER, np.int32)
        flat, result = keys.ravel(), out.ravel()
        rows = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(flat[rows])
        while len(rows):
            seen = self.keys[slot]
            hit = seen == flat[rows]
            result[rows[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != -1)
            rows, slot = rows[on], (slot[on] + 1) & self.mask
        return out


def _longer(windows: np.ndarray, codes: np.ndarray, n: int, to: int) -> np.ndarray:
    """Hashes of all runs of ``to`` bytes from those of all runs of ``n`` bytes."""
    for k in range(n, to):
        count = len(codes) - k
        windows = windows[:count] * np.uint64(_BASE) + codes[k:].astype(np.uint64) + np.uint64(1)
    return windows


class MatrixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int32) for x in zip(*pairs)) if pairs else (np.empty(0, np.int32),) * 3
        self.table = PairTable(left, right, merged)
        by_length: dict[int, list[bytes]] = {}
        for token in ranks:
            by_length.setdefault(len(token), []).append(token)
        # hashes of all tokens of a length, in order
        self.spans = {n: np.unique(_longer(np.zeros(n * len(own), np.uint64), np.frombuffer(b"".join(own), np.uint8), 0, n)[::n]) for n, own in sorted(by_length.items()) if n > 1}

    @classmethod
    def from_file(cls, path: str) -> MatrixBpe:
        with open(path, "rb") as file:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; no merge crosses the border of a word."""
        raw, owner = [], []
        for w, word in enumerate(words):
            data = word.encode()
            parts = [data] if len(data) <= LONG_BYTES else self.parts(data)
            raw += parts
            owner += [w] * len(parts)
        found = self._encode_parts(raw)
        if len(raw) == len(words):
            return found
        out: list[list[int]] = [[] for _ in words]
        for w, ids in zip(owner, found):
            out[w] += ids
        return out

    def parts(self, data: bytes) -> list[bytes]:
        """``data`` cut at the borders that lie inside no token found in it. A hash that meets by chance only keeps a border whole."""
        codes = np.frombuffer(data, np.uint8)
        windows, length = np.zeros(len(codes), np.uint64), 0
        inside = np.zeros(len(codes) + 1, np.int32)  # +1 where a token's inner borders begin, -1 where they end
        for n, hashes in self.spans.items():
            if n > len(codes):
                break
            windows, length = _longer(windows, codes, length, n), n
            at = np.searchsorted(hashes, windows)
            starts = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == windows)
            inside[starts + 1] += 1
            inside[starts + n] -= 1
        cuts = np.flatnonzero(np.cumsum(inside) == 0)  # the first is 0, the last the end
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _encode_parts(self, raw: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        buckets = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for bucket in np.unique(buckets):
            rows = np.flatnonzero((buckets == bucket) & (lengths > 0))
            step = max(1, BATCH_CHARS >> int(bucket))
            for at in range(0, len(rows), step):
                self._encode_rows(raw, lengths, rows[at : at + step], out)
        return out

    def _encode_rows(self, raw: list[bytes], lengths: np.ndarray, rows: np.ndarray, out: list[list[int]]) -> None:
        if not len(rows):
            return
        size = lengths[rows]
        matrix = np.full((len(rows), int(size.max())), -1, np.int32)
        inside = np.arange(matrix.shape[1]) < size[:, None]
        matrix[inside] = self.byte_ids[np.frombuffer(b"".join(raw[r] for r in rows), np.uint8)]
        ranks = self.table.find(matrix[:, :-1], matrix[:, 1:])
        while True:
            least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(rows), NEVER)
            ended = least == NEVER
            if ended.any():
                for r, ids, n in zip(rows[ended], matrix[ended].tolist(), size[ended]):
                    out[r] = ids[:n]
                rows, size, matrix, ranks, least = (x[~ended] for x in (rows, size, matrix, ranks, least))
                if not len(rows):
                    return
            matrix, ranks, size = self._merge(matrix, ranks, size, least)

    def _merge(self, matrix: np.ndarray, ranks: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the pairs of each row that have its least rank, from the left."""
        height, width = matrix.shape
        if width <= SHORT:  # hardly any pair comes twice
            row, at = np.arange(height), ranks.argmin(axis=1)
        else:
            row, at = np.nonzero(ranks == least[:, None])
            # of pairs that overlap one another in a chain every second one is merged
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            chain = np.flatnonzero(new)
            odd = (np.arange(len(row)) - np.repeat(chain, np.diff(np.append(chain, len(row))))) % 2
            row, at = row[odd == 0], at[odd == 0]
        token = least[row]
        before = np.where(at > 0, matrix[row, at - 1], -1)  # as it is when the pair's turn comes
        same = row[1:] == row[:-1]
        follows = np.concatenate([[False], same & (at[1:] == at[:-1] + 2)])
        before[follows] = token[follows]
        after = np.where(at + 2 < width, matrix[row, np.minimum(at + 2, width - 1)], -1)
        left, right = self.table.find(before, token), self.table.find(token, after)
        if same.any():
            early = np.zeros(height, bool)
            early[row[(left < token) | (right < token)]] = True
            keep = ~early[row] | np.concatenate([[True], ~same])
            row, at, token, left, right, follows = (x[keep] for x in (row, at, token, left, right, follows & ~early[row]))
        # the right half of a merged pair goes; what stands right of it closes the gap
        matrix[row, at] = token
        stays = np.arange(width) < size[:, None]
        stays[row, at + 1] = False
        size = size - np.bincount(row, minlength=height)
        narrow = int(size.max())
        filled = np.arange(narrow) < size[:, None]
        merged = np.full((height, narrow), -1, np.int32)
        merged[filled] = matrix[stays]
        # a pair's rank moves along with its left token; pairs beside a merge were looked up above
        moved = np.pad(ranks, ((0, 0), (0, 1)), constant_values=NEVER)
        ok = at > 0
        moved[row[ok], at[ok] - 1] = left[ok]
        moved[row, at] = right
        moved[row[follows], at[follows] - 2] = left[follows]  # the token before is a merged one
        out = np.full((height, narrow), NEVER, np.int32)
        out[filled] = moved[stays]
        return merged, out[:, : narrow - 1], size

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def model(path: str) -> MatrixBpe:
    """Read once per Python worker."""
    return MatrixBpe.from_file(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    """Piece -> (ids as 32-bit integers, ids as text). Lives as long as the Python worker, so tasks share it."""
    return PieceCache(model(path).encode, lambda ids: (array("i", ids).tobytes(), " ".join(map(str, ids))))


def _blocks(column: pa.Array, limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Texts of a batch in runs of bounded length."""
    block, chars = [], 0
    for value in column:
        text = value.as_py() or ""
        block.append(text)
        chars += len(text)
        if chars >= limit:
            yield block
            block, chars = [], 0
    if block:
        yield block


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (array<int>, unless ``with_ids`` is off), ids_sha256 and decoded_sha256, one row per row."""
    narrow = inputs(docs, key=key, text=text)
    kind = dict(narrow.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        cache = _cache(path)
        for batch in batches:
            row = 0
            for texts in _blocks(batch.column(1)):
                cut = [pieces(t) for t in texts]
                cache.learn(cut)
                ends, parts_ids, shas, decoded = [0], [], [], []
                for parts in cut:
                    found = [cache.known[p] for p in parts if p]
                    own = b"".join([ids for ids, _ in found])
                    ends.append(ends[-1] + len(own) // 4)
                    parts_ids.append(own)
                    shas.append(hashlib.sha256(" ".join([said for _, said in found]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(own, np.int32).tolist())).hexdigest())
                keys = batch.column(0).slice(row, len(texts))
                row += len(texts)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts_ids), np.int32)))] if with_ids else []
                columns = [keys, pa.array(np.diff(ends).astype(np.int64)), *lists, pa.array(shas), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    kinds = [kind, "bigint", *(["array<int>"] if with_ids else []), "string", "string"]
    return narrow.mapInArrow(frugal(scan), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
