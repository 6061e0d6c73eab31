"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numeric features. Each feature is cut into at most 64 bins; cyclic gradient boosting fits a
shallow tree to one feature after the other and adds it to that feature's lookup table. The strongest pairs then get
tables of two features the same way. A score is the sum of the tables' entries, taken by vectorised lookups.

Labels are read from at most ``MAX_ROWS`` labelled rows (those of the least hash of the key); all else covers all rows.

Defined results: NULL counts as empty, an empty text is scored like any other. Rows without a key are scored and are not
held out. A key with several labels counts once, with the larger label; NULL labels are left out. Without labels of
both kinds the score is the share of label 1, or 1 where nothing is labelled. Repeated rows are scored each. An empty
table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, frugal, inputs

MAX_ROWS = 20_000
BINS, PAIR_BINS = 64, 12
PAIRS = 8
THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "mean_word", "letters", "upper", "digits", "blanks", "ends", "symbols", "distinct_words",
    "same_as_previous", "repeated_shingles", "lines_per_word", "repeated_lines", "longest_word", "marked_words", "short_words",
)
_CLASSES = 7  # other symbols, lower, upper, other letters, digits, blanks, sentence marks


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    to = {"Ll": 1, "Lu": 2, "Lt": 2, "Lm": 3, "Lo": 3, "Mn": 3, "Mc": 3, "Nd": 4, "Nl": 4, "No": 4, "Zs": 5, "Zl": 5, "Zp": 5, "Cc": 5}
    for c in range(0x110000):
        kinds[c] = to.get(unicodedata.category(chr(c)), 0)
    for c in ".,;:'’-?":
        kinds[ord(c)] = 6
    return kinds


def features(text: str) -> list[float]:
    """One number per name in ``FEATURES``, from the whole text."""
    words = text.split()
    n, chars = len(words), len(text)
    kind = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=_CLASSES)
    letters = int(kind[1] + kind[2] + kind[3])
    lines = [x for x in text.split("\n") if x]
    sizes = list(map(len, words))
    if n >= 5:
        h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
        grams = h[4:].copy()
        for k in range(4):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : n - 4 + k]
        fresh = len(np.unique(grams)) / len(grams)
    else:
        fresh = 1.0
    per_char, per_word = 1 / max(1, chars), 1 / max(1, n)
    return [
        np.log1p(chars),
        np.log1p(n),
        sum(sizes) * per_word,
        letters * per_char,
        int(kind[2]) / max(1, letters),
        int(kind[4]) * per_char,
        int(kind[5]) * per_char,
        int(kind[6]) * per_char,
        int(kind[0]) * per_char,
        len(set(words)) * per_word,
        sum(map(operator.eq, words[1:], words)) * per_word,
        1.0 - fresh,
        len(lines) * per_word,
        1.0 - len(set(lines)) / max(1, len(lines)),
        np.log1p(max(sizes, default=0)),
        sum(not w[-1].isalnum() for w in words) * per_word,
        sum(map((3).__ge__, sizes)) * per_word,
    ]


@dataclass
class Gam:
    """Lookup tables: ``intercept`` + one table per feature + one table per pair."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edges, own) in enumerate(zip(self.edges, self.tables)):
            out += own[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), own in zip(self.pairs, self.pair_tables):
            out += own[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Values that part the column into at most ``bins`` bins of similar size."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def _best_split(g: np.ndarray, h: np.ndarray, low: int, high: int, damping: float) -> tuple[float, int]:
    """(gain, place) of the best cut of bins low..high-1."""
    if high - low < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    gs, hs = g[low:high].sum(), h[low:high].sum()
    gain = gl**2 / (hl + damping) + (gs - gl) ** 2 / (hs - hl + damping) - gs**2 / (hs + damping)
    at = int(gain.argmax())
    return float(gain[at]), low + at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, damping: float) -> np.ndarray:
    """A shallow tree over one feature's bins, as a value per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = max(((*_best_split(g, h, a, b, damping), a, b) for a, b in parts), key=lambda f: f[0])
        if found[0] <= 1e-9:
            break
        parts.remove((found[2], found[3]))
        parts += [(found[2], found[1]), (found[1], found[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + damping)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, damping: float) -> tuple[float, np.ndarray]:
    """A tree of two levels over a pair: one cut of the first feature and one of the second on either side."""
    best, values = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            total, own = 0.0, np.zeros_like(gg)
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[side].sum(axis=0), hh[side].sum(axis=0)
                gain, at = _best_split(gs, hs, 0, len(gs), damping)
                total += gain + gs.sum() ** 2 / (hs.sum() + damping)
                for inner in (slice(0, max(at, 0)), slice(max(at, 0), None)):
                    own[side, inner] = gs[inner].sum() / (hs[inner].sum() + damping)
            total -= gg.sum() ** 2 / (hh.sum() + damping)
            if total > best + 1e-12:
                best, values = total, own.T if flip else own
    return best, values


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 4, damping: float = 5.0) -> Gam:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Gam(40.0 if share == 1.0 else -40.0)
    share = float(y.mean())
    model = Gam(float(np.log(share / (1 - share))))
    model.edges = [_cut_points(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    logit = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = gradients()
            step = rate * _tree(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)), leaves, damping)
            table += step
            logit += step[at[k]]
    model.pair_edges = [_cut_points(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    shape = lambda i, j: (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)

    def grid(i: int, j: int, weight: np.ndarray) -> np.ndarray:
        a, b = shape(i, j)
        return np.bincount(coarse[i] * b + coarse[j], weight, a * b).reshape(a, b)

    g, h = gradients()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), damping)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), damping)[1]
            table += step
            logit += step[coarse[i], coarse[j]]
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    Labels that lack a document in ``docs`` take no part, so that a stage learns from what it is given.
    """
    marked = inputs(labels, key=key, label=label).where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
    marked = marked.groupBy("key").agg(F.max("label").cast("double").alias("label"))
    marked = marked.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(max_rows)  # so many rows at most are broadcast
    rows = inputs(docs, key=key, text=text).join(F.broadcast(marked), "key")
    measured = _measure(rows.select("key", "text", "label"), "text", "key").drop("text", "key").distinct()
    found = measured.toPandas().sort_values(["label", *FEATURES])
    return fit(found[list(FEATURES)].to_numpy(float), found["label"].to_numpy(float))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(v.as_py() or "") for v in column], float).reshape(len(column), len(FEATURES))


def _measure(df: DataFrame, text: str, *others: str) -> DataFrame:
    """``df`` with one column per feature."""
    place = df.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x[:, k]) for k in range(len(FEATURES))]], [*batch.schema.names, *FEATURES])

    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.mapInArrow(frugal(scan), kinds + ", " + ", ".join(f"{n} double" for n in FEATURES))


def score(docs: DataFrame, model: Gam, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    narrow = inputs(docs, key=key, text=text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["key", "score"])

    return narrow.mapInArrow(frugal(scan), f"key {dict(narrow.dtypes)['key']}, score double")


def keep_good(docs: DataFrame, model: Gam, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    place = bounded_batches(docs).columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(_matrix(batch.column(place))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(frugal(scan), docs.schema)
