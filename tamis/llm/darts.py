"""DartMinHash signatures of weighted sets, over flat numpy arrays of a batch of documents.

Every element owns the plane (weight, rank). It is cut into weight regions [0, 1), [1, 2), [2, 4), ...; in each region
hashed darts fall as a Poisson process, the same for every document. A document sees the darts below its element's
weight; each dart belongs to one of ``k`` coordinates, and a coordinate keeps its earliest dart (least rank). Two
documents agree in a coordinate with the probability of their weighted Jaccard similarity. Only darts of rank below
a bound are thrown, about k (ln k + 2) per document whatever its size; where a coordinate stays empty the bound doubles.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
CACHE_WORDS = 150_000


class WordHash(dict):
    """Word -> 64-bit hash, remembered within a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """A 64-bit finalizer; ``salt`` chooses the function."""
    with np.errstate(over="ignore"):
        z = x + np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(text: str, words: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of five words (lower case) and how often each occurs; all words if there are fewer than five."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out ^ h[k : k + n], k + 1)
    ids, counts = np.unique(out, return_counts=True)
    return ids, counts.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard; 1 for two empty sets."""
    total = a[1].sum() + b[1].sum()
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (total - common))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` 32-bit values per set; sets must not be empty."""
    out = np.zeros((len(sets), k), np.uint32)
    if not sets:
        return out
    weight_sum = np.array([w.sum() for _, w in sets])
    bound = k * (np.log(k) + 2) / weight_sum
    todo = np.arange(len(sets))
    while len(todo):
        filled, values = _throw([sets[d] for d in todo], bound[todo], k)
        whole = filled.all(axis=1)
        out[todo[whole]] = values[whole]
        todo = todo[~whole]
        bound[todo] *= 2
    return out


def _throw(sets: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All darts of rank below ``bound``, and the earliest of each coordinate."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    element, weight = np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets])
    low, width = np.zeros(len(doc)), np.ones(len(doc))
    regions = [(doc, element, weight, low, width)]
    edge = 1.0
    while (deep := weight > edge).any():
        doc_r, element_r, weight_r = doc[deep], element[deep], weight[deep]
        regions.append((doc_r, mix(element_r, int(edge) + 1_000_003), weight_r, np.full(len(doc_r), edge), np.full(len(doc_r), edge)))
        edge *= 2
    doc, element, weight, low, width = (np.concatenate(c) for c in zip(*regions))
    rank = np.zeros(len(doc))
    darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    throw = 0
    while len(doc):
        bits = mix(element, 2 * throw)
        rank = rank - np.log(_uniform(bits)) / width
        on = rank < bound[doc]
        doc, element, weight, low, width, rank, bits = (x[on] for x in (doc, element, weight, low, width, rank, bits))
        place = mix(element, 2 * throw + 1)
        seen = low + width * (1.0 - _uniform(place)) < weight
        name = mix(bits[seen], place[seen] >> np.uint64(1))
        darts.append((doc[seen] * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64), rank[seen], name.astype(np.uint32)))
        throw += 1
    slot, when, name = (np.concatenate(c) for c in zip(*darts))
    late_first = np.argsort(-when, kind="stable")  # of darts with one slot the earliest is written last
    filled, values = np.zeros(len(sets) * k, bool), np.zeros(len(sets) * k, np.uint32)
    filled[slot] = True
    values[slot[late_first]] = name[late_first]
    return filled.reshape(-1, k), values.reshape(-1, k)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per band of ``rows`` coordinates; bands have values of their own."""
    count = signature.shape[1] // rows
    out = np.zeros((len(signature), count), np.uint64)
    for b in range(count):
        value = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            value = mix(value ^ signature[:, b * rows + r].astype(np.uint64), r + 1)
        out[:, b] = value
    return out.view(np.int64)
