"""Token-ID output: one concatenated id array per file, with Elias-Fano encoded document boundaries.

File format (little-endian):

    8 bytes   magic "TAMISEF1"
    u32 x 2   bytes per id, rows with a NULL key (they come first)
    i64       least key
    3 parts   keys minus the least one (rows without NULL), boundaries (documents + 1), ids
              each part: u64 length in bytes, then the bytes

An Elias-Fano part holds n non-decreasing numbers up to u in about 2 + log2(u / n) bits each:

    u64 x 3   n, u, low bits per number l
    low       n x l bits, packed
    high      unary code of the upper parts, n + (u >> l) + 1 bits, packed
    samples   u32 position of every 256th one bit in ``high``; select starts there

No table of 64-bit offsets is written; ``EliasFano.get`` finds one offset with a select on the high bits.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import frugal, inputs, text_or_empty
from tamis.llm.pretokens import PATTERN, TextEncoder
from tamis.session import materialize, scratch_path

MAGIC = b"TAMISEF1"
SAMPLE = 256
FILE_BYTES = 8 << 20


def _bits(values: np.ndarray, width: int) -> bytes:
    if width == 0 or len(values) == 0:
        return b""
    spread = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """Non-decreasing integers from 0 in near-minimal space."""

    def __init__(self, n: int, top: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.width, self.low, self.high, self.samples = n, top, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (top >> width) + 1, np.uint8)
        high[ones] = 1
        low = np.frombuffer(_bits(values & np.uint64((1 << width) - 1), width), np.uint8)
        return cls(n, top, width, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.n, self.top, self.width) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, top, width = struct.unpack_from("<QQQ", data)
        low, high, samples = -(-n * width // 8), -(-(n + (top >> width) + 1) // 8), -(-n // SAMPLE)
        at = 24
        return cls(
            n, top, width,
            np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", samples, at + low + high),
        )

    def select(self, i: int) -> int:
        """Position of the i-th one bit (from 0) of the high part."""
        position, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = position >> 3
        block = 64
        while True:
            bits = np.unpackbits(self.high[byte : byte + block], bitorder="little")
            if byte == position >> 3:
                bits[: position & 7] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += block

    def get(self, i: int) -> int:
        upper = self.select(i) - i
        bit = i * self.width
        held = int.from_bytes(self.low[bit >> 3 : (bit + self.width + 7) >> 3].tobytes(), "little") >> (bit & 7)
        return (upper << self.width) | (held & ((1 << self.width) - 1))

    def all(self) -> np.ndarray:
        """All numbers as int64."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.int64) << self.width
        if not self.width or not self.n:
            return upper
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return upper | (bits << np.arange(self.width)).sum(axis=1)


def pack(keys: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """One file. Keys ascend, those that are None come first; each of ``ids`` is a document's id array."""
    known = np.array([k for k in keys if k is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([0, *(len(x) // id_bytes for x in ids)])
    parts = [EliasFano.of(known - least).to_bytes(), EliasFano.of(ends).to_bytes(), b"".join(ids)]
    head = MAGIC + struct.pack("<IIq", id_bytes, len(keys) - len(known), least)
    return head + b"".join(struct.pack("<Q", len(p)) + p for p in parts)


class TokenFile:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        id_bytes, self.nulls, self.least = struct.unpack_from("<IIq", data, 8)
        view, at, parts = memoryview(data), 24, []
        for _ in range(3):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(view[at + 8 : at + 8 + size])
            at += 8 + size
        self._keys, self.ends = EliasFano.from_bytes(parts[0]), EliasFano.from_bytes(parts[1])
        self.ids = np.frombuffer(parts[2], f"<u{id_bytes}")

    def __len__(self) -> int:
        return self.ends.n - 1

    def keys(self) -> list[int | None]:
        return [None] * self.nulls + (self._keys.all() + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of one document by two selects."""
        return self.ids[self.ends.get(i) : self.ends.get(i + 1)]


BULK_WORDS, TEXTS_AT_ONCE, READ_ROWS = 400, 2048, 1024


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _library_encoder(tokenizer: str, id_bytes: int) -> Callable[[str], bytes]:
    """Ids of one match of the pattern, straight from the library's model, which reads bytes as letters."""
    model = _tokenizer(tokenizer).model
    kind = {2: "H", 4: "I"}[id_bytes]
    # Printable bytes stand for themselves, the others follow from U+0100 on.
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = {b: b if b in printable else next(others) for b in range(256)}

    def encode(match: str) -> bytes:
        own = array(kind, [t.id for t in model.tokenize(match.encode().decode("latin-1").translate(letter))])
        if sys.byteorder != "little":
            own.byteswap()
        return own.tobytes()

    return encode


def _bulk_encoder(tokenizer: str, id_bytes: int, at_once: int) -> Callable[[list[str]], list[bytes]]:
    """Ids of many words without white space at their ends, each after a space, by one call for a few hundred of them.

    Tokens that start with a space start a word, as no other byte of a word is a space.
    """
    tok, one = _tokenizer(tokenizer), _library_encoder(tokenizer, id_bytes)
    opens = np.zeros(max(tok.get_vocab().values()) + 1, bool)
    opens[[i for t, i in tok.get_vocab().items() if t.startswith("\u0120")]] = True

    def encode(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for group, found in zip(groups, tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            own = np.array(found.ids, f"<u{id_bytes}")
            starts = np.flatnonzero(opens[own]) * id_bytes
            if len(starts) == len(group):
                ids = own.tobytes()
                out += [ids[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)])]
            else:
                out += [b"".join(map(one, PATTERN.findall(" " + w))) for w in group]
        return out

    return encode


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, id_bytes: int) -> Callable[[list[str]], list[bytes]]:
    """Lives as long as the Python worker, so tasks share what it remembers.

    The library takes added tokens out of a text before its pattern; texts that may hold one go to the library whole.
    """
    tok = _tokenizer(tokenizer)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    bulk = _bulk_encoder(tokenizer, id_bytes, 1 if any(" " in t for t in added) else BULK_WORDS)
    plain = TextEncoder(_library_encoder(tokenizer, id_bytes), bulk)

    def encode(texts: list[str]) -> list[bytes]:
        whole = [any(t in text for t in added) for text in texts]
        rest = iter(plain.encode([t for t, w in zip(texts, whole) if not w]))
        return [np.array(tok.encode(t, add_special_tokens=False).ids, f"<u{id_bytes}").tobytes() if w else next(rest) for t, w in zip(texts, whole)]

    return encode


def _store(folder: str, name: str, data: bytes) -> None:
    """Whole files only: a task that runs again replaces its files by the same ones."""
    from pyarrow.fs import FileSystem

    system, base = FileSystem.from_uri(folder)
    passing = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write(data)
    system.move(passing, f"{base}/{name}")


def write_tokens(
    docs: DataFrame, tokenizer: str, *, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES
) -> tuple[DataFrame, str]:
    """Encode every text, append ``end_id`` and write ids in files by ascending key. Returns (manifest, folder).

    The manifest has one row per file: file, part, nth, documents, tokens. The folder must be one that all executors
    reach; by default a new one in ``spark.checkpoint.dir``.

    Defined results: NULL and empty texts have just the end id. NULL keys come first; equal keys are ordered by a hash
    of the text, and repeated rows are written as often as they come. An empty table gives no files. Other columns are
    not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    uri = folder if "://" in folder else (folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
    narrow = inputs(docs, key=key, text=text).select(F.col("key").cast("bigint").alias("key"), text_or_empty().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text").asc()]  # equal keys can be cut too
    ordered = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(tokenizer)
        id_bytes = 2 if max(tok.get_vocab_size(), end_id + 1) <= 65536 else 4
        kind = f"<u{id_bytes}"
        end = np.array([end_id], kind).tobytes()
        encoded = _encoder(tokenizer, id_bytes)
        part, nth, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal nth, keys, ids, size
            name = f"part-{part:07d}-{nth:05d}.tok"
            _store(uri, name, pack(keys, ids, id_bytes))
            rows.append((name, part, nth, len(keys), size // id_bytes))
            nth, keys, ids, size = nth + 1, [], [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                for k, own in zip(some.column(0).to_pylist(), encoded(some.column(1).to_pylist())):
                    own += end
                    if keys and size + len(own) > file_bytes:
                        flush()
                    keys.append(k)
                    ids.append(own)
                    size += len(own)
        if keys:
            flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
            ["file", "part", "nth", "documents", "tokens"],
        )

    manifest = ordered.mapInArrow(frugal(write), "file string, part int, nth int, documents bigint, tokens bigint")
    return materialize(manifest, "manifest"), folder


def file_starts(manifest: DataFrame) -> DataFrame:
    """file, first_token: ids in all files before it. Sums run per writing task, then over the tasks."""
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    starts = parts.select("part", before(Window.orderBy("part")).alias("ahead"))
    own = manifest.select("file", "part", before(Window.partitionBy("part").orderBy("nth")).alias("within"))
    return own.join(starts, "part").select("file", (F.col("ahead") + F.col("within")).alias("first_token"))


def read_tokens(manifest: DataFrame, folder: str, *, with_ids: bool = True) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and, unless ``with_ids`` is off, ids, one row per document, from the files.

    ``ids_crc32`` is taken over the ids as little-endian 32-bit integers.
    """
    spark = manifest.sparkSession
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1)):
                file = TokenFile(blob.as_py())
                keys = file.keys()
                for low in range(0, len(file), READ_ROWS):
                    # each document's bounds come from selects; only those of a few documents are held at once
                    high = min(low + READ_ROWS, len(file))
                    bounds = [file.ends.get(i) for i in range(low, high + 1)]
                    own = [file.ids[a:b] for a, b in zip(bounds, bounds[1:])]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                    offsets = np.array(bounds, np.int64)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(file.ids[bounds[0] : bounds[-1]].astype(np.int32)))] if with_ids else []
                    columns = [pa.array([name.as_py()] * len(own)), pa.array(keys[low:high], pa.int64()), pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), *lists]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["file", "key", "within", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = ["string", "bigint", "bigint", "bigint", "bigint", *(["array<int>"] if with_ids else [])]
    found = blobs.mapInArrow(frugal(read), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    placed = found.join(file_starts(manifest), "file").withColumn("start", F.col("within") + F.col("first_token"))
    return placed.select("key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
