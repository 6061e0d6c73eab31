"""Fingerprints and near duplicates against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import dart_minhash, darts, oph_fingerprint
from tamis.llm.components import components


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(docs):
    made = oph_fingerprint.edited_prints(docs)
    return made.select(
        "key", "n_chars", "edited", oph_fingerprint.as_text(F.col("print")).alias("fp"), oph_fingerprint.likeness(F.col("print"), F.col("edited_print")).alias("near"),
        oph_fingerprint.likeness(F.col("print"), F.col("next_print")).alias("next"),
    ).collect()


def test_fingerprints(spark, sf, small):
    got = {r["key"]: r for r in edited(spark.read.parquet(f"{sf}/documents.parquet"))}
    order = small.sort_values("doc_id", ascending=False).reset_index(drop=True)
    errors = []
    for i, (key, text) in enumerate(zip(order.doc_id, order.text)):
        after = order.text[(i + 1) % len(order)]
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        assert (got[key]["edited"], got[key]["n_chars"]) == (want, len(text))
        errors += [got[key]["near"] - jaccard(sets(text), sets(want)), got[key]["next"] - jaccard(sets(text), sets(after))]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    by_text = defaultdict(set)
    for key, text in zip(order.doc_id, order.text):
        by_text[text].add(got[key]["fp"])
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_fingerprints(odd, none):
    rows = edited(odd)
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["near"] <= 1 and len(r["fp"]) in (0, 256)
    assert edited(none) == []


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    ids = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
    errors = []
    for _ in range(40):
        a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
        two = [(ids, a), (ids[20:], b[20:])]
        s = darts.signatures(two, 150)
        errors.append((s[0] == s[1]).mean() - darts.similarity(*two))
    assert abs(np.mean(errors)) < 0.02


def classes_by_force(rows):
    """Single linkage over all pairs of texts."""
    words = darts.WordHash()
    found = {k: darts.shingles(t or "", words) for k, t in rows.items()}
    top = {k: k for k in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if darts.similarity(found[a], found[b]) >= 0.8:
                high, low = max(find(a), find(b)), min(find(a), find(b))
                top[high] = low
    return {k: find(k) for k in keys}


def test_near_classes(spark, sf, small):
    got = {r["key"]: r["class_id"] for r in dart_minhash.near_classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == classes_by_force(dict(zip(small.doc_id, small.text)))


def test_large_group_of_chained_copies(spark):
    """Neighbours are alike, the ends are not; no bucket may lose the chain."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*(f"x{j}" for j in range(4 * i)), *base[4 * i :]]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: r["class_id"] for r in dart_minhash.near_classes(df).collect()}
    assert got == classes_by_force(dict(enumerate(texts)))


def test_copies_among_alike_texts(spark):
    """Buckets of texts of similarity 0.79, all unlike; in each family two late ones are near copies all the same."""
    texts = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(180)]
        tails = [[f"f{family}t{k}x{j}" for j in range(24)] for k in range(60)]
        tails[-1][:2] = tails[-2][:2]
        texts += [" ".join(base + tail) for tail in tails]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: r["class_id"] for r in dart_minhash.near_classes(df).collect()}
    want = classes_by_force(dict(enumerate(texts)))
    assert got == want and len(set(want.values())) == len(texts) - 4


def test_odd_near_duplicates(odd, none):
    rows = dart_minhash.near_classes(odd).collect()
    assert len(rows) == odd.count()
    by_key = defaultdict(set)
    for r in rows:
        by_key[r["class_id"]].add(r["key"])
    assert by_key[1] == {1, 11} and by_key[9] == {9, 10} and by_key[7] == {7, 8} and by_key[2] == {2, 3, None}
    kept = dart_minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    left = sorted(str(r["doc_id"]) for r in kept.collect())
    assert left == sorted(["1", "2", "4", "5", "6", "7", "9", "12", "-5", "None", "20", "20"])
    assert dart_minhash.near_classes(none).collect() == [] and dart_minhash.drop_near_duplicates(none).collect() == []


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_digest_of_equal_words():
    assert dart_minhash._node("A  b\nc") == dart_minhash._node("a b c") != dart_minhash._node("ab c")
    assert len(hashlib.sha256().hexdigest()) == 64
