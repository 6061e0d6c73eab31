"""Schema drift, policies, lifecycle reports and audit chains on literal cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import audit, drift, lifecycle
from tamis.session import materialize


def schema(spark, fields, workflow="w"):
    return spark.createDataFrame([(workflow, f, t) for f, t in fields.items()], "workflow_id string, field string, type string")


def found(df):
    return sorted((r.kind, r.field, r.new_field) for r in df.collect())


@pytest.mark.parametrize(
    "old,new,expected",
    [
        ({"id": "int"}, {"id": "int", "email": "text"}, [("NEW_FIELD", "email", None)]),
        ({"id": "int", "phone": "text"}, {"id": "int"}, [("REMOVED_FIELD", "phone", None)]),
        ({"firstName": "text"}, {"firstname": "text"}, [("RENAMED_FIELD", "firstName", "firstname")]),
        ({"amount": "int"}, {"amount": "decimal"}, [("TYPE_CHANGE", "amount", None)]),
        ({"id": "int"}, {"id": "int"}, []),
    ],
)
def test_detect(spark, old, new, expected):
    assert found(drift.detect(schema(spark, old), schema(spark, new))) == expected


def test_rename_score(spark):
    row = drift.detect(schema(spark, {"firstName": "text"}), schema(spark, {"firstname": "text"})).first()
    assert row.score == pytest.approx(8 / 9)


def test_snapshot_forms(spark):
    rows = [("a", '{"id": {"type": "int"}, "n": {"type": "text", "x": 1}}'), ("b", '{"id": "long"}')]
    got = drift.snapshot_fields(spark.createDataFrame(rows, "workflow_id string, schema_snapshot string"))
    assert sorted(map(tuple, got.collect())) == [("a", "id", "int"), ("a", "n", "text"), ("b", "id", "long")]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return 1.0 if a == b else 1.0 - levenshtein(a, b) / max(len(a), len(b))


def names(rng, n):
    stems = ["volume", "region", "date_obs", "cas", "id", "montant_total", "x"]
    out = set()
    while len(out) < n:
        word = rng.choice(stems) + "_" * rng.randrange(2) + "".join(rng.choice("abc") for _ in range(rng.randrange(5)))
        out.add(word)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.85, 0.6, 0.92, 1.0, 0.3])
def test_candidates_are_complete(spark, threshold):
    rng = random.Random(threshold)
    pool = names(rng, 120)
    rng.shuffle(pool)
    sides = {"r": [("w1", f) for f in pool[:50]] + [("w2", f) for f in pool[20:60]], "a": [("w1", f) for f in pool[50:]] + [("w2", f) for f in pool[60:]]}
    frame = lambda rows: spark.createDataFrame([(w, f, float(threshold)) for w, f in rows], "workflow_id string, field string, threshold double")
    got = {(r.workflow_id, r.removed, r.added) for r in drift.rename_candidates(frame(sides["r"]), frame(sides["a"])).collect()}
    expected = {(w, r, a) for w, r in sides["r"] for v, a in sides["a"] if v == w and similarity(r, a) >= threshold}
    assert got == expected


def greedy(pairs):
    out, taken = set(), set()
    for w, r in sorted({(w, r) for w, r, _, _ in pairs}):
        best = None
        for s, a in sorted((-s, a) for v, x, a, s in pairs if v == w and x == r):
            if (w, a) not in taken:
                best = (a, -s)
                break
        if best:
            taken.add((w, best[0]))
            out.add((w, r, *best))
    return out


def test_matching_is_greedy_in_name_order(spark):
    rng = random.Random(3)
    pairs = [
        (f"w{w}", f"r{r:02d}", f"a{a:02d}", rng.choice([0.85, 0.9, 0.95]))
        for w in range(3) for r in range(15) for a in range(15) if rng.random() < 0.25
    ]
    frame = spark.createDataFrame(pairs, "workflow_id string, removed string, added string, score double")
    assert {tuple(r) for r in drift.match_renames(frame).collect()} == greedy(pairs)


@pytest.mark.parametrize("blocks", [1, 2, 7])
def test_blocks_claim_as_one_pass_would(spark, blocks):
    rng = random.Random(blocks)
    pairs = {(None, r, a): rng.choice([0.85, 0.9, 0.95]) for r in "abcdefghij" for a in "pqrstuv" if rng.random() < 0.7}
    pairs |= {("chain", f"r{r:02d}", f"a{a:02d}"): 1 - a / 100 for r in range(12) for a in range(12)}  # all want the same names
    pairs |= {("calm", f"r{r}", f"a{r}"): 0.9 for r in range(5)}
    rows = [(*k, s) for k, s in pairs.items()]
    frame = spark.createDataFrame(rows, "workflow_id string, removed string, added string, score double")
    expected = greedy([(w or "", r, a, s) for w, r, a, s in rows])
    assert {(w or "", *rest) for w, *rest in drift.match_renames(frame, blocks).collect()} == expected


def test_one_large_workflow_in_several_tasks(spark):
    """100,000 candidate pairs of one workflow: claims come from several tasks, rows are those of one pass."""
    n = F.col("id")
    pairs = spark.range(100_000).select(
        F.lit("w").alias("workflow_id"),
        F.format_string("r%05d", (n / 20).cast("int")).alias("removed"),
        F.format_string("a%05d", F.pmod(F.xxhash64(n), F.lit(6000)).cast("int")).alias("added"),
        (F.lit(0.85) + F.pmod(F.xxhash64(n, F.lit(1)), F.lit(15)) / 100).alias("score"),
    ).dropDuplicates(["removed", "added"])
    pairs = materialize(pairs, "pairs")
    owned = pairs.select(F.lit("=w").alias("owner"), "workflow_id", "removed", "added", "score")
    assert drift._claims(owned, 8).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    taken, expected = set(), set()
    best = {}
    for _, r, a, s in pairs.collect():
        best.setdefault(r, []).append((-s, a))
    for r in sorted(best):
        for s, a in sorted(best[r]):
            if a not in taken:
                taken.add(a)
                expected.add((r, a))
                break
    assert {(r.removed, r.added) for r in drift.match_renames(pairs, 8).collect()} == expected


def test_no_candidates(spark):
    empty = spark.createDataFrame([], "workflow_id string, removed string, added string, score double")
    assert drift.match_renames(empty).count() == 0


def test_thresholds_per_workflow(spark):
    old = schema(spark, {"firstName": "text"}, "a").unionByName(schema(spark, {"firstName": "text"}, "b"))
    new = schema(spark, {"firstname": "text"}, "a").unionByName(schema(spark, {"firstname": "text"}, "b"))
    limits = spark.createDataFrame([("a", 0.95)], "workflow_id string, similarity_threshold double")
    kinds = {(r.workflow_id, r.kind) for r in drift.detect(old, new, limits).collect()}
    assert kinds == {("a", "NEW_FIELD"), ("a", "REMOVED_FIELD"), ("b", "RENAMED_FIELD")}


def rate(spark, old, new, **policy):
    rated = drift.apply_policy(drift.detect(schema(spark, old), schema(spark, new)), default={**drift.DEFAULT_POLICY, **policy})
    row = drift.policy_decisions(rated).first()
    return (row.blocked, row.reasons) if row else None


def test_policy_cases(spark):
    assert rate(spark, {"a": "int", "phone": "t"}, {"a": "int"}) == (True, 1)
    assert rate(spark, {"a": "int"}, {"a": "int", "email": "t"}) == (False, 1)
    assert rate(spark, {"a": "int"}, {"a": "text"}, on_type_change="BLOCK") == (True, 1)
    assert rate(spark, {"firstName": "t"}, {"firstname": "t"}) == (False, 1)
    assert rate(spark, {"a": "int"}, {"a": "int", "email": "t"}, on_new_field="IGNORE") == (False, 0)
    assert rate(spark, {"firstName": "t"}, {"firstname": "t"}, on_renamed="AUTO_BY_SIMILARITY") == (False, 0)
    assert rate(spark, {"a": "int"}, {"a": "int"}) is None


def test_rename_reason_names_both_fields(spark):
    rated = drift.apply_policy(drift.detect(schema(spark, {"firstName": "t"}), schema(spark, {"firstname": "t"})))
    assert rated.first().reason == "Field firstName likely renamed to firstname (similarity=0.8888888888888888) — confirm mapping"


def test_resolve(spark):
    df = spark.createDataFrame([("1", "north", 7), ("x", "south", 8)], "cas string, nom_region string, cert int")
    out = drift.resolve(df, {"cas": "INTEGER", "region": "STRING", "gone": "DOUBLE"}, {"region": "nom_region"})
    assert [tuple(r) for r in out.collect()] == [(1, "north", None), (None, "south", None)]
    swapped = drift.resolve(df, {"cas": "STRING"}, expressions={"cas": "concat(cas, '!')"})
    assert [r.cas for r in swapped.collect()] == ["1!", "x!"]


NOW = dt.datetime(2026, 5, 11, 12)


@pytest.mark.parametrize(
    "critical,approvers,strategy,age_days,allowed",
    [
        (False, 1, "DIRECT", 1, True), (True, 1, "DIRECT", 1, False), (True, 2, "DIRECT", 1, False), (True, 2, "SHADOW", 1, True),
        (False, 1, "DIRECT", 8, False), (False, 1, "DIRECT", None, False), (False, 1, "DIRECT", 7, True),
    ],
)
def test_gate(spark, critical, approvers, strategy, age_days, allowed):
    requests = spark.createDataFrame([(1, critical, strategy)], "version_id int, is_critical boolean, strategy string")
    # the same approver twice counts once
    approvals = spark.createDataFrame([(1, f"user:{i}") for i in range(approvers)] + [(1, "user:0")], "version_id int, approver_subject string")
    runs = [] if age_days is None else [(1, "SUCCEEDED", NOW - dt.timedelta(days=age_days)), (1, "FAILED", NOW)]
    simulations = spark.createDataFrame(runs, "version_id int, status string, finished_at timestamp_ntz")
    row = lifecycle.gate_report(requests, approvals, simulations, F.lit(NOW).cast("timestamp_ntz")).first()
    assert row.allowed is allowed, row.reasons
    if approvers == 1 and critical:
        assert "Approvals: 1/2" in row.reasons


def test_version_steps(spark):
    first = "1.2.7"
    cases = {"2.0.0": "MAJOR", "1.3.0": "MINOR", "1.2.8": "PATCH", "3.0.0": "INVALID", "1.5.0": "INVALID", "2.1.0": "INVALID", "1.2.7-rc.1": "SAME"}
    rows = []
    for i, to in enumerate(cases):
        rows += [(i, 1, first, 1), (i, 2, to, 2)]
    df = spark.createDataFrame(rows, "workflow_id int, version_id int, semver string, created_at int")
    got = {r.semver: r.step for r in lifecycle.version_steps(df).where("version_id = 2").collect()}
    assert got == cases


def test_latest_puts_nulls_last(spark):
    df = spark.createDataFrame([("w", 1, None, "DEPLOYED"), ("w", 2, 5, "DEPLOYED"), ("w", 3, 9, "DRAFT"), ("v", 4, None, "DEPLOYED")], "workflow_id string, version_id int, deployed_at int, status string")
    assert {(r.workflow_id, r.version_id) for r in lifecycle.active_versions(df).collect()} == {("w", 2), ("v", 4)}


def test_rollback_target(spark):
    rows = [("w", 1, "DEPRECATED", 1), ("w", 2, "DEPRECATED", 2), ("w", 3, "DEPLOYED", 3), ("w", 4, "DEPRECATED", None), ("v", 9, "DEPRECATED", 1)]
    versions = spark.createDataFrame(rows, "workflow_id string, version_id int, status string, deployed_at int")
    failing = spark.createDataFrame([("w", 3), ("w", 2), ("v", 9)], "workflow_id string, version_id int")
    got = {(r.failing_version, r.target_version) for r in lifecycle.rollback_targets(versions, failing).collect()}
    assert got == {(3, 2), (2, 1)}


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, i % 2, None if i % 3 else "u", "DEPLOY", '{"a": 1}', NOW + dt.timedelta(seconds=i), "v1") for i in range(20)]
    return spark.createDataFrame(
        rows, "audit_id int, workflow_id int, actor_subject string, action string, payload string, occurred_at timestamp_ntz, key_version string"
    )


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([("v1", "secret")], "key_version string, secret string")


def test_chain_is_whole(entries, keys):
    chain = audit.build_chain(entries, keys)
    report = audit.verify(chain, keys).collect()
    assert [(r.entries, r.breaks, r.first_break) for r in report] == [(10, 0, None)] * 2
    assert chain.where("parent_hash IS NULL").count() == 2


def test_chain_breaks_are_found(spark, entries, keys):
    chain = audit.build_chain(entries, keys).cache()
    lost = audit.verify(chain.where("audit_id <> 4"), keys).where("workflow_id = 0").first()
    assert (lost.breaks, lost.first_break, lost.cause) == (1, 6, "LINK")
    changed = chain.withColumn("payload", F.when(F.col("audit_id") == 5, "{}").otherwise(F.col("payload")))
    edited = audit.verify(changed, keys).where("workflow_id = 1").first()
    assert (edited.breaks, edited.first_break, edited.cause) == (1, 5, "HASH")
    other = spark.createDataFrame([("v1", "guess")], "key_version string, secret string")
    assert audit.verify(chain, other).first().breaks == 10


def test_entry_text_is_unambiguous(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("-", "abc")], "actor_subject string, action string")
    texts = [r[0] for r in df.select(audit.entry_text(df, ["actor_subject", "action"])).collect()]
    assert len(set(texts)) == 4


def test_json_field_types(spark):
    df = spark.createDataFrame([("d1", '{"a": 1, "b": "x", "c": [1], "d": null, "e": {"f": 1}, "g": true, "h": 1.5}'), ("d2", '{"a": 2}')], "day string, j string")
    got = {(r.day, r.field): r.type for r in drift.json_fields(df, "j", ["day"]).collect()}
    assert got == {
        ("d1", "a"): "integer", ("d1", "b"): "string", ("d1", "c"): "array", ("d1", "d"): "null", ("d1", "e"): "object", ("d1", "g"): "boolean",
        ("d1", "h"): "number", ("d2", "a"): "integer",
    }


def test_quoted_json_values_are_text(spark):
    df = spark.createDataFrame([("d1", '{"a": "12", "b": "true"}'), ("d2", '{"a": 12, "b": true}'), ("d3", "not json"), ("d4", None), ("d5", "[1]")], "day string, j string")
    got = {(r.day, r.field): r.type for r in drift.json_fields(df, "j", ["day"]).collect()}
    assert got == {("d1", "a"): "string", ("d1", "b"): "string", ("d2", "a"): "integer", ("d2", "b"): "boolean"}


def test_chain_of_odd_entries(spark, keys):
    """No workflow, one place twice, and a key version that nobody knows."""
    stamp = "cast('2024-01-01' AS timestamp_ntz)"
    rows = spark.createDataFrame(
        [(1, None, "v1"), (2, None, "v1"), (3, 7, "v1"), (3, 7, "v1"), (4, 7, "v9"), (5, 7, "v1"), (6, 2**60, "v1"), (7, 2**60 + 1, "v1")],
        "audit_id long, workflow_id long, key_version string",
    ).withColumn("occurred_at", F.expr(stamp))
    chain = sorted(audit.build_chain(rows, keys).collect(), key=lambda r: (str(r.workflow_id), r.audit_id, r.parent_hash is not None))
    got = [(r.audit_id, r.parent_hash is None, r.self_hash is None) for r in chain]
    assert got == [(6, True, False), (7, True, False), (3, True, False), (3, False, False), (4, False, True), (5, True, False), (1, True, False), (2, False, False)]
    by_id = {r.audit_id: r for r in chain if r.audit_id != 3}
    assert by_id[2].parent_hash == by_id[1].self_hash
    assert audit.verify(audit.build_chain(rows, keys), keys).where("workflow_id = 7").first().first_break == 4


def test_drift_events(spark):
    """One event per workflow that drifts, blocked by its policy or not."""
    shape = "workflow_id string, field string, type string"
    before = spark.createDataFrame([("a", "x", "int"), ("a", "y", "int"), ("b", "x", "int"), ("c", "x", "int")], shape)
    after = spark.createDataFrame([("a", "x", "int"), ("b", "x", "int"), ("b", "extra", "int"), ("c", "x", "int")], shape)
    policies = spark.createDataFrame([("a", "BLOCK", "WARN"), ("b", "BLOCK", "IGNORE")], "workflow_id string, on_removed_field string, on_new_field string")
    rows = {r["workflow_id"]: r for r in drift.drift_events(drift.apply_policy(drift.detect(before, after), policies)).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["blocked"] and rows["a"]["removed_field"] == 1 and rows["a"]["fields"] == ["y"] and len(rows["a"]["reasons"]) == 1
    assert not rows["b"]["blocked"] and rows["b"]["new_field"] == 1 and rows["b"]["reasons"] == []
