"""Whitening against a dense decomposition, and the search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import jacobi_davidson, multiprobe, whitening
from tamis.llm.queries import QUERIES

ODD = "vec_id bigint, embedding array<float>, key string, vector string, bound string, rank string, n string, whitened string, label int"


def odd_rows(entries):
    return [(k, v, "a", "b", "c", "d", "e", "f", 1) for k, v in entries]


def test_leading_pairs():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(400, 50)), rng.normal(size=(30, 4)), rng.normal(size=(6, 40)), np.zeros((3, 7)), np.repeat(rng.normal(size=(90, 10)), 2, axis=1)):
        a = x.T @ x
        values, vectors, worst = jacobi_davidson.leading(lambda b: a @ b, len(a), 16)
        want = np.linalg.eigvalsh(a)[::-1][:16]
        assert len(values) == min(16, len(a)) and np.abs(values - want).max() <= 1e-12 * max(want[0], 1)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * max(want[0], 1) and worst < 1e-12
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def whitened_by_force(rows):
    """The contract with whole numbers and a dense decomposition; (id, component) -> row without sign."""
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in rows}
    distinct = [list(v) for v in {tuple(v) for v in x.values()}]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = lambda v: np.array([(n * c - s) / n for c, s in zip(v, sums)])
    c = np.array([centred(v) for v in distinct])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [i for i in range(min(16, len(values))) if values[i] > 1e-10 * values[0]]
    return {
        (k, i + 1): (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), abs(float(centred(v) @ vectors[:, i]) / math.sqrt(values[i])), values[i] / values.sum()) for k, v in x.items() for i in some
    }


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, size, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - size) < 1e-9 and abs(r["explained"] - share) < 1e-10 and r["identity_error"] < 1e-10


def test_whitening(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(QUERIES["op12_whitening"](spark, sf).collect(), whitened_by_force([(r[0], r[1]) for r in rows]))


def test_odd_embeddings(spark, tmp_path):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * 50]) for i in range(40)]
    good += [(100, good[0][1]), (101, [-0.0, 0.0, 0.0]), (102, [0.001, 0.002, 0.0]), (103, [0.0, 0.0, 0.0])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("inf"), 2.0]), (205, [1.0, 2.0]), (206, [1.0, 3e30, 2.0])]
    spark.createDataFrame(odd_rows(good + bad), ODD).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    check(QUERIES["op12_whitening"](spark, str(tmp_path)).collect(), whitened_by_force(good))


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 2**40), 1.0 - i, 5.0]) for i in range(20)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.whiten(data)[0].collect()
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {k: sum((20 * a - s) ** 2 for a, s in zip(v, sums)) for (k, _), v in zip(rows, x)}
    assert {r["key"]: r["deviation"] for r in got} == {k: v if v < 2**63 else None for k, v in want.items()}


@pytest.mark.parametrize("entries", [[], [(1, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, tmp_path, entries):
    spark.createDataFrame(odd_rows(entries), ODD).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op12_whitening"](spark, str(tmp_path)).collect() == []


def nearest_by_force(rows, count=20, every=20):
    out = {}
    for k, v in rows:
        if k % every == 0:
            scores = sorted((-math.fsum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != k)
            out[k] = [(j, -s) for s, j in scores[:count]]
    return out


def found(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_search_is_exact_on_small_tables(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(QUERIES["op13_multiprobe"](spark, sf).collect()) == nearest_by_force(rows)


def test_recall(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    data = spark.read.parquet(path)
    rows = [(r[0], r[1]) for r in data.select("vec_id", "embedding").collect()]
    got = found(multiprobe.nearest(data, F.col("key") % 100 == 0).select(F.col("query").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score").collect())
    want = nearest_by_force(rows, every=100)
    hits = sum(len({j for j, _ in got[k]} & {j for j, _ in want[k]}) for k in want)
    assert multiprobe.functions_for(len(rows)) > 0 and hits >= 0.9 * 20 * len(want)
    scores = dict((k, dict(v)) for k, v in nearest_by_force(rows, count=len(rows), every=100).items())
    assert all(abs(scores[k][j] - s) < 1e-15 for k, v in got.items() for j, s in v)


def test_odd_searches(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * (1 + i % 3)]) for i in range(2000)]
    good += [(5000 + i, good[40][1]) for i in range(300)]  # ties, and a hot bucket
    bad = [(9000, None), (9020, []), (9040, [1.0, None] + [0.0] * 4), (9060, [float("nan")] * 6), (9080, [0.0] * 6), (9100, [1.0]), (9120, [float("inf")] * 6)]
    spark.createDataFrame(odd_rows(good + good[40:41] + bad), ODD).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = found(QUERIES["op13_multiprobe"](spark, str(tmp_path)).collect()), nearest_by_force(good)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[k]) & set(want[k])) for k in want)
    assert hits >= 0.9 * 20 * len(want)
    assert got[40] == want[40]


@pytest.mark.parametrize("entries", [[], [(20, [1.0, 2.0])], [(20, None), (None, [1.0, 2.0])]])
def test_nothing_to_find(spark, tmp_path, entries):
    spark.createDataFrame(odd_rows(entries), ODD).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op13_multiprobe"](spark, str(tmp_path)).collect() == []


def test_null_id_is_found(spark, tmp_path):
    spark.createDataFrame(odd_rows([(20, [1.0, 2.0]), (None, [3.0, 1.0]), (1, [-1.0, 0.0])]), ODD).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert found(QUERIES["op13_multiprobe"](spark, str(tmp_path)).collect()) == {20: [(None, 5.0), (1, -1.0)]}


def test_probe_order_sums_to_the_chance():
    rng = np.random.default_rng(4)
    q = rng.normal(size=5)
    offset, c = rng.uniform(0, multiprobe.WIDTH, 5), 0.6
    cells, odds = multiprobe.probe_order(q, offset, c, 0.1)
    assert 0.9 <= odds.sum() <= 1 and (np.diff(odds) <= 0).all()
    near = c * q + math.sqrt(1 - c * c) * rng.normal(size=(40_000, 5))
    inside = {tuple(x) for x in cells}
    share = np.mean([tuple(x) in inside for x in np.floor((near + offset) / multiprobe.WIDTH).astype(int)])
    assert abs(share - odds.sum()) < 0.01
