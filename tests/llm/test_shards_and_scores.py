"""Sharding laws, the quality model and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import gam_quality, kd_shards, tiling
from tests.llm.test_fingerprints import classes_by_force


def dealt(docs, **options):
    return kd_shards.kd_shards(docs, **options).collect()


def laws(rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert set(by_shard) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_shards(spark, sf, small):
    rows = dealt(spark.read.parquet(f"{sf}/documents.parquet"), shards=16)
    laws(rows, 16)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    want = {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in zip(small.doc_id, small.text)}
    assert {r["key"]: (r["size"], r["text_crc32"]) for r in rows} == want
    largest, mean = max(s for s, _ in want.values()), sum(sizes.values()) / 16
    assert max(abs(v - mean) for v in sizes.values()) <= 4 * largest


def test_hot_value_and_uneven_leaves(spark):
    """One value and one text for nearly all rows; seven leaves."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("source"), F.lit("en").alias("lang"))
    rows = dealt(docs, dimensions=("source", "lang"), shards=7)
    laws(rows, 7)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 8
    by_bytes = dealt(docs, target_bytes=6000)
    assert len({r["shard"] for r in by_bytes}) == 5


def test_copies_stay_together(spark):
    """Copies with metadata of their own share a shard, and bytes stay near equal; a group beyond a shard is cut."""
    rows = [(i, f"text {i % 700} " + "w " * (i % 700 % 13), f"s{i % 5}", "en") for i in range(3000)]
    got = dealt(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=8)
    laws(got, 8)
    shards, sizes = defaultdict(set), Counter()
    for r in got:
        shards[rows[r["key"]][1]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    mean = sum(sizes.values()) / 8
    assert max(abs(n - mean) for n in sizes.values()) < 0.08 * mean
    hot = [(i, "one text for a third of all" if i % 3 == 0 else f"own text number {i} of the rest", f"s{i % 5}", "en") for i in range(3000)]
    sizes = Counter()
    for r in dealt(spark.createDataFrame(hot, "doc_id long, text string, source string, lang string"), shards=8):
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def tree_by_force(rows, shards):
    """Keys by shard, from sorting each node along its widest dimension and cutting at the weighted median."""
    if shards == 1:
        return [{k for k, _, _ in rows}]
    spread = np.ptp([p for *_, p in rows], axis=0)
    rows = sorted(rows, key=lambda r: r[2][int(np.argmax(spread))])
    total = sum(s for _, s, _ in rows)
    goal, run, at = total * (shards // 2) / shards, 0, 0
    while run + rows[at][1] <= goal:
        run += rows[at][1]
        at += 1
    left, right = goal - run, run + rows[at][1] - goal
    at += min(left, right) <= kd_shards.GROUP_SLACK * total / shards and left > right
    return tree_by_force(rows[:at], shards // 2) + tree_by_force(rows[at:], shards - shards // 2)


def test_tree_by_force(spark):
    """No two rows share a size or a value, so that the tree is one."""
    rng = np.random.default_rng(7)
    sizes, xs, ys = (rng.permutation(900)[:400] + 50 for _ in range(3))
    rows = [(i, "x" * (int(n) - 1), int(x), int(y)) for i, (n, x, y) in enumerate(zip(sizes, xs, ys))]
    unit = lambda v: (v - v.min()) / (v.max() - v.min())
    points = np.stack([unit(np.log2(sizes)), unit(xs.astype(float)), unit(ys.astype(float))], axis=1)
    for shards in (6, 16):
        by_shard = defaultdict(set)
        for r in dealt(spark.createDataFrame(rows, "doc_id long, text string, a long, b long"), dimensions=("a", "b"), shards=shards):
            by_shard[r["shard"]].add(r["key"])
        assert [by_shard[k] for k in range(shards)] == tree_by_force([(i, int(n), p) for i, (n, p) in enumerate(zip(sizes, points))], shards)


def test_odd_shards(odd, none):
    rows = dealt(odd, shards=16)
    laws(rows, 16)
    assert Counter((r["key"], r["size"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in odd.collect())
    assert dealt(none, shards=16) == []


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = gam_quality.train(docs, labels)
    scored = gam_quality.score(docs, model).join(labels, F.col("key") == labels["doc_id"]).where(gam_quality.held_out(F.col("key"))).toPandas()
    assert ((scored.score >= gam_quality.THRESHOLD) == (scored.quality == 1)).mean() > 0.97


def test_pairs_matter():
    """A product of two features has no main effect; only the pair tables can learn it."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_quality.fit(x, y, rounds=30)
    test = rng.random((2000, 4))
    assert ((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.9
    assert (1, 0) in model.pairs


def test_odd_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = gam_quality.train(odd, labels)
    scores = gam_quality.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert gam_quality.train(none, labels).score(np.zeros((1, len(gam_quality.FEATURES))))[0] > 0.99
    kept = gam_quality.keep_good(odd, gam_quality.Gam(40.0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert gam_quality.score(none, model).collect() == []
    assert gam_quality.held_out(F.lit(None)) is not None


def test_pipeline_stages(spark, sf, small):
    """Each stage against brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf).cache()
    model = gam_quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    x = np.array([gam_quality.features(t) for t in small.text])
    assert {r["doc_id"] for r in good.collect()} == set(small.doc_id[model.score(x) >= 0.7])

    slim = stages["line dedup"](spark, good, sf).cache()
    assert slim.columns == columns == good.columns
    sites = defaultdict(set)
    for r in good.collect():
        for line in r["text"].split("\n"):
            sites[line.strip(" \t\r")].add(r["source"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not (x.strip(" \t\r") and len(sites[x.strip(" \t\r")]) >= 10)) for r in good.collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in slim.collect()} == {k: (t, len(t)) for k, t in want.items()}

    alone = stages["MinHash near-dedup"](spark, slim, sf).cache()
    classes = classes_by_force({r["doc_id"]: r["text"] for r in slim.collect()})
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(set(classes.values())) and alone.columns == columns

    clean = stages["benchmark decontamination"](spark, alone, sf).cache()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaking = {r["key"] for r in tiling.leaks(alone, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in alone.collect()} - leaking and clean.columns == columns
    coded = stages["byte-level BPE"](spark, clean, sf)
    assert coded.count() == clean.count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r["doc_id"] for r in clean.collect())


def test_pipeline_with_odd_rows(spark, sf, odd, none):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
