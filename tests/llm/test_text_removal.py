"""Lines, units and benchmark passages against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import site_spread, tiling, unit_dedup
from tests.llm.conftest import LONG, PASSAGE


def test_boilerplate(odd, none):
    kept = site_spread.drop_boilerplate(odd, min_sites=2, report=True).collect()
    sites = defaultdict(set)
    for r in odd.collect():
        for line in (r["text"] or "").split("\n"):
            sites[line.strip(" \t\r")].add(r["source"])
    wide = {x for x, s in sites.items() if x and len(s) >= 2}
    assert wide
    want = Counter()
    for r in odd.collect():
        own = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\r") not in wide)
        want[(r["doc_id"], own)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in kept) == want
    assert site_spread.drop_boilerplate(odd).columns == odd.columns
    assert site_spread.drop_boilerplate(none).collect() == []


def test_spread_near_the_threshold(spark):
    """Sketches are off by a few percent; lines near the threshold are counted exactly."""
    rows = [(i, f"line{n}", f"site{i}") for n in (96, 99, 100, 101, 104, 400) for i in range(n)]
    found = site_spread.lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted(r["sites"] for r in site_spread.boilerplate(found, min_sites=100, lg_k=6).collect())
    assert len(got) == 4 and got[:3] == [100, 101, 104]


def test_units(odd, none):
    spans = unit_dedup.repeated_spans(odd)
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"])
    got = [(r["key"], r["kept_key"], r["start"], r["end"], r["kept_start"]) for r in spans.collect() if r["key"] == 8]
    assert got == [(8, 7, len("Own start.\n"), len(texts[8][0]), 0)]
    cut = {r["doc_id"]: (r["text"], r["removed_spans"]) for r in unit_dedup.remove_spans(odd, spans).collect()}
    assert cut[8][0] == "Own start.\n" and cut[8][1][0]["start"] == len("Own start.\n") and cut[6] == (LONG, None) and cut[2] == (None, None)
    assert unit_dedup.repeated_spans(none).collect() == []
    assert unit_dedup.remove_spans(odd, spans).columns == [*odd.columns, "removed_spans"]


def test_spans_keep_to_their_text(spark):
    passage = ". ".join(f"alpha beta gamma delta{i}" for i in range(20)) + "."
    docs = spark.createDataFrame([(1, passage), (2, "Own words first. " + passage), (2, "Another text of the same id, " * 5)], "doc_id int, text string")
    out = sorted(r["text"] for r in unit_dedup.remove_spans(docs, unit_dedup.repeated_spans(docs)).where("doc_id = 2").collect())
    assert out[0] == "Another text of the same id, " * 5 and out[1].replace(" ", "") == "Ownwordsfirst."


def test_units_of_each_kind():
    text = "a b\nc d\n\n \nE  f\n\ng"
    assert list(unit_dedup.cut(text, "paragraph")) == [(0, 7, "a b c d"), (11, 15, "e f"), (17, 18, "g")]
    assert list(unit_dedup.cut(" a b\n\nC. d", "line")) == [(1, 4, "a b"), (6, 10, "c. d")]
    assert list(unit_dedup.cut("A b. c?!d\n . ", "sentence")) == [(0, 4, "a b."), (5, 8, "c?!"), (8, 9, "d"), (11, 12, ".")]


def spans_by_force(docs):
    """Runs of repeated units, document by document, as the docstring says."""
    cut = {k: list(unit_dedup.cut(t, "sentence")) for k, t in docs}
    first, count = {}, Counter()
    for k in sorted(cut):
        for nth, (start, _, plain) in enumerate(cut[k]):
            first.setdefault(plain, (k, start, nth))
            count[plain] += 1
    out = set()
    for k, own in cut.items():
        at = 0
        while at < len(own):
            end = at
            while end < len(own) and count[own[end][2]] > 1:
                end += 1
            if end > at:
                words = [len(p.split()) for _, _, p in own]
                same = Counter()
                for i in range(at, end):
                    if first[own[i][2]] != (k, own[i][0], i):
                        same[first[own[i][2]][0], first[own[i][2]][2] - i] += words[i]
                if sum(words[max(0, at - 1) : end + 1]) >= 50 and max(same.values(), default=0) >= 15:
                    out |= {(k, *own[i][:2], *first[own[i][2]][:2]) for i in range(at, end) if first[own[i][2]] != (k, own[i][0], i)}
            at = max(end, at + 1)
    return out


def test_runs_against_brute_force(spark, small):
    rng = np.random.default_rng(6)
    pool = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], rng.integers(1, 9))) + "." for _ in range(60)]
    docs = [(int(k), " ".join(pool[i] for i in np.concatenate([np.arange(a, a + rng.integers(1, 15)) % 60 for a in rng.integers(0, 60, 4)]))) for k in range(80)]
    docs += [(1000 + int(k), t) for k, t in zip(small.doc_id, small.text)]
    got = unit_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r["key"], r["start"], r["end"], r["kept_key"], r["kept_start"]) for r in got} == spans_by_force(docs) and got


def tiles_by_force(item, text, least):
    """Greedy string tiling as first stated: look for the longest uncovered match again and again."""
    a_free, b_free, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a_free[a + n] and b_free[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        if best[0] < least:
            return total
        n, a, b = best[0], -best[1], -best[2]
        a_free[a : a + n] = [False] * n
        b_free[b : b + n] = [False] * n
        total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=40))
def test_tiles(item, text):
    a, b = np.array(item, np.int64), np.array(text, np.int64)
    tiles = tiling.tile(a, b, 3)
    used_a, used_b = [x for s, _, n in tiles for x in range(s, s + n)], [x for _, s, n in tiles for x in range(s, s + n)]
    assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
    assert all(n >= 3 and item[s : s + n] == text[t : t + n] for s, t, n in tiles)
    longest = max((n for _, _, n in tiles), default=0)
    force = tiles_by_force(item, text, 3)
    assert (force == 0) == (longest == 0)
    # ties in length may be broken otherwise, which moves the total a little
    assert abs(sum(n for _, _, n in tiles) - force) <= max(6, force // 2)


def test_reordered_passage(spark, odd, none):
    item = [f"t{i}" for i in range(40)]
    moved = " ".join([*item[20:], "between them", *item[:20]])
    docs = spark.createDataFrame([(1, f"start {moved} end"), (2, " ".join(item[:20]) + " other"), (3, None), (4, ""), (5, f"Start, {moved.upper()}!"), (5, f"Start, {moved.upper()}!")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, " ".join(item))], "item_id long, text string")
    got = sorted((r["key"], r["item"], r["coverage"], [tuple(t) for t in r["tiles"]]) for r in tiling.leaks(docs, bench).collect())
    assert [g[:3] for g in got] == [(1, 7, 1.0), (1, 10, 1.0), (5, 7, 1.0), (5, 7, 1.0), (5, 10, 1.0), (5, 10, 1.0)]
    assert got[0][3] == [(0, 23, 20), (20, 1, 20)]
    assert [r["doc_id"] for r in tiling.drop_leaking(docs, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    assert tiling.drop_leaking(odd, bench).count() == odd.count() and tiling.drop_leaking(odd, bench.limit(0)).count() == odd.count()
    assert tiling.leaks(none, bench).collect() == []


def test_leaks_by_force(spark, sf, small):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    words = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for key, text in zip(small.doc_id, small.text):
        mine = words(text)
        grams = {tuple(mine[i : i + 5]) for i in range(len(mine) - 4)}
        for item, passage in zip(bench.item_id, bench.text):
            own = words(passage)
            hit = [tuple(own[i : i + 5]) in grams for i in range(len(own) - 4)]
            covered = {i + k for i, h in enumerate(hit) if h for k in range(5)}
            if len(covered) >= 0.6 * len(own):
                want.add((key, item))
    got = {(r["key"], r["item"]) for r in tiling.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == want and want
