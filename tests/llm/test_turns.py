"""Conversation repair against all edit scripts, and end to end against a plain reading of its contract."""

import hashlib
import re
import zlib

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import turn_repair
from tamis.llm.queries import QUERIES

PRICE = {"K": 0, "R": 3, "D": 4, "I": 3}


def scripts(initials, faults, most):
    """All edit scripts with their cost and resulting role initials, as long as they cost ``most`` at the utmost."""

    def go(i, cost, audit, made):
        if cost > most or not "suauauauauauauauau".startswith(made) and not "uauauauauauauauau".startswith(made):
            return
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", made):
            yield cost, audit, made
        for c in "ua":
            yield from go(i, cost + 3, audit + "I", made + c)
        if i < len(initials):
            yield from go(i + 1, cost + 4, audit + "D", made)
            if faults[i] in (turn_repair.SOUND, turn_repair.CUT):
                more = 3 if faults[i] == turn_repair.CUT else 0
                yield from go(i + 1, cost + more, audit + "K", made + initials[i])
                for c in "ua":
                    yield from go(i + 1, cost + more + 3, audit + "R", made + c)

    yield from go(0, 0, "", "")


TURNS = st.tuples(st.sampled_from(["s", "u", "a", "x"]), st.sampled_from([0, 0, 0, 1, 2, 3]))


@settings(max_examples=150, deadline=None)
@given(st.lists(TURNS, max_size=4))
def test_cheapest_of_all_scripts(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    cost, audit = turn_repair.by_lengths(initials, faults)
    assert (cost, audit) == min(s[:2] for s in scripts(initials, faults, cost))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "", "x"]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=40))
def test_lengths_and_phases_agree(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    assert turn_repair.by_lengths(initials, faults) == turn_repair.by_phases(initials, faults)


def test_very_long_conversation():
    initials, faults = ["s"] + ["u", "a", "a"] * 20_000, [0] * 60_001
    cost, audit = turn_repair.best_audit(initials, faults)
    assert cost == 60_000 and set(audit) == {"K", "I"}


SPACES = " \t\n\x0b\x0c\r"


def by_hand(table):
    """The contract row by row, over a pandas table; the cheapest script from costs by phase."""
    out = []
    for key, group in table.groupby("conv_id", dropna=False, sort=False):
        key = None if pd.isna(key) else int(key)
        rows = []
        for turn, role, text in zip(group.turn, group.role, group.text):
            turn = None if pd.isna(turn) else int(turn)
            role, text = " " if role is None or pd.isna(role) else role, " " if text is None or pd.isna(text) else text
            kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 1:
                text = ""
            elif kind == 2:
                text = re.sub("[.!?]", "", text)
            elif kind == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            plain = text.rstrip(SPACES)
            faults.append(1 if not plain else 2 if (role, text) in seen else 0 if plain[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        known = [r[0] for r in rows if r[0] is not None]
        cost, audit = turn_repair.by_phases(initials, faults)
        size, i, lines = len(audit) - audit.count("D"), 0, []
        for edit in audit:
            place = len(lines)
            role = ((["s"] if size % 2 else []) + ["user", "assistant"] * size)[place] if edit != "D" else ""
            if edit == "I":
                lines.append(f"{role}:")
                continue
            if edit != "D":
                lines.append(f"{rows[i][1] if edit == 'K' else role}:{rows[i][2]}")
            i += 1
        assert i == len(rows)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((key, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, sf):
    got = QUERIES["op11_turn_repair"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(spark.read.parquet(f"{sf}/conversations.parquet").toPandas())


ODD = "conv_id bigint, turn bigint, role string, text string, key string, digest string, part string, copies string, audit string"


def test_odd_conversations(spark, tmp_path):
    long = "word " * 200_000
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "No"), (2, None, None, None), (2, 5, "", "x"), (None, 1, "user", "a?"), (None, 1, "user", "a?"),
            (None, None, "system", "s."), (3, 9, "uncle", long), (3, 2, "user", ""), (3, 3, "assistant", "\x85."), (4, None, "user", " \x0b ")]
    rows += [(k, t, "user", "All gone.") for k in range(1000, 1200) for t in (7,) if zlib.crc32(f"{k}:{t}".encode()) % 20 == 0][:1]
    spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], ODD).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert sorted(map(tuple, got), key=str) == by_hand(table)
    gone = next(r for r in got if (r["conv_id"] or 0) >= 1000)
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect() == []


def test_repaired_turns(spark):
    rows = turn_repair.turns(spark.createDataFrame([(1, 0, "assistant", "Well."), (1, 1, "user", "So?")], "conv_id bigint, turn bigint, role string, text string"))
    found, mended = turn_repair.repair(rows)
    assert found.collect()[0]["audit"] == "IKKI"
    assert [tuple(r)[1:] for r in mended.collect()] == [(0, "user", ""), (1, "assistant", "Well."), (2, "user", "So?"), (3, "assistant", "")]
