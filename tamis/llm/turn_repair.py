"""Repair of conversation structure by Wagner-Fischer alignment to an alternating grammar.

The role initials of a repaired conversation are nothing, or ``ua`` once or more after an optional ``s``. Turns are
aligned to the grammar string of every feasible length: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert
(an empty user or assistant turn) 3, and a truncated turn that stays 3 more. Blank and duplicate turns must go. All
lengths share one table of costs, since the strings are suffixes of each other but for the leading ``s``. Its bands are
Ukkonen's: a cell that needs more insertions or deletions to its end than the incumbent repair costs in all is left
out. Every length of least cost is traced back from the first turn, by the least letter that keeps the cost; the
ASCII-least audit of all lengths wins.

Two passes keep memory bounded: the first deals rows without texts by conversation and gives an audit for each, the
second streams texts in order and applies the audit to one row at a time. Only initials, faults and 16-byte digests of
one conversation are held at once. The digest of a conversation's text is sequential, so one task streams it.
Conversations of more than ``LONG`` turns use costs by grammar phase instead of the table: the same optimum and the
same least letters, in linear time and space.

Defined results: NULL role or text is one space; rows whose key is NULL are one conversation; rows go by turn (NULL
first), then role, then a digest of the text. An empty text is blank; a conversation without rows has cost 0 and an empty
audit. Repeated rows are duplicates. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import inputs
from tamis.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LONG = 1000
FAR = 1 << 40
SOUND, BLANK, DUPLICATE, CUT = range(4)
ROLES = {"u": "user", "a": "assistant"}
BATCH_ROWS = 2000


def turns(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role, text, copies (1): the rows of conversations as the operator reads them."""
    narrow = inputs(rows, key=key, turn=turn, role=role, text=text)
    return narrow.select("key", "turn", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")], F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """``turns`` with known damage by the checksum of key and turn: dropped (``copies`` 0), emptied, without stops, repeated, or as user."""
    name = F.concat(*[F.coalesce(F.col(n).cast("string"), F.lit(" ")) if n else F.lit(":") for n in ("key", None, "turn")])
    kind = F.crc32(name) % 20
    return rows.select(
        "key",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(F.col("copies")).alias("copies"),
    )


def _step_costs(initial: str, fault: int) -> tuple[bool, int]:
    """(may stay, added cost of staying)."""
    return fault in (SOUND, CUT), TRUNCATED if fault == CUT else 0


def _greedy_cost(initials: list[str], faults: list[int]) -> int:
    """Cost of one valid repair: turns in order, those out of place get another role, and the last pair is filled."""
    cost, placed = 0, 0
    for i, (c, f) in enumerate(zip(initials, faults)):
        stays, more = _step_costs(c, f)
        want = "ua"[placed % 2]
        if not stays:
            cost += DELETE
        else:
            cost += more + (0 if c == want else REROLE)
            placed += 1
    return cost + (INSERT if placed % 2 else 0)


def _table(initials: list[str], faults: list[int], most: int) -> list[dict[int, int]]:
    """cost[i][k]: rows from i on aligned to the last k symbols of ``..uaua``, inside the band of an incumbent of ``most``."""
    n = len(initials)
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below, rest = table[i], table[i + 1] if i < n else None, n - i
        for k in range(max(0, rest - most // DELETE), rest + most // INSERT + 1):
            best = FAR
            if k:
                best = here.get(k - 1, FAR) + INSERT
            if below is not None:
                best = min(best, below.get(k, FAR) + DELETE)
                stays, more = _step_costs(initials[i], faults[i])
                if k and stays:
                    best = min(best, below.get(k - 1, FAR) + more + (0 if initials[i] == "au"[(k - 1) % 2] else REROLE))
            if best < FAR or (i == n and k == 0):
                here[k] = 0 if i == n and k == 0 else best
    return table


def _trace(initials: list[str], faults: list[int], table: list[dict[int, int]], length: int, lead: list[int] | None) -> str:
    """ASCII-least audit of least cost for one target length; ``lead`` has the costs while the leading s is open."""
    n, i, k, out = len(initials), 0, length, []
    while lead is not None:
        stays, more = _step_costs(initials[i], faults[i])
        if lead[i] == lead[i + 1] + DELETE:
            out.append("D")
            i += 1
            continue
        out.append("K")
        i += 1
        lead = None
    while i < n or k:
        now = table[i][k]
        stays, more = _step_costs(initials[i], faults[i]) if i < n else (False, 0)
        fits = stays and k and initials[i] == "au"[(k - 1) % 2]
        if i < n and table[i + 1].get(k, FAR) + DELETE == now:
            out.append("D")
            i += 1
        elif k and table[i].get(k - 1, FAR) + INSERT == now:
            out.append("I")
            k -= 1
        else:
            out.append("K" if fits and table[i + 1].get(k - 1, FAR) + more == now else "R")
            i, k = i + 1, k - 1
    return "".join(out)


def by_lengths(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, ties to the ASCII-least audit, over all feasible target lengths."""
    n = len(initials)
    table = _table(initials, faults, _greedy_cost(initials, faults))
    least = min(v for k, v in table[0].items() if k % 2 == 0)
    found = [(v, _trace(initials, faults, table, k, None)) for k, v in table[0].items() if k % 2 == 0 and v == least]
    for k in sorted({k for row in table for k in row if k and k % 2 == 0}) if "s" in initials else ():
        lead = [FAR] * (n + 1)
        for i in range(n - 1, -1, -1):
            stays, more = _step_costs(initials[i], faults[i])
            keep = table[i + 1].get(k, FAR) + more if stays and initials[i] == "s" else FAR
            lead[i] = min(lead[i + 1] + DELETE, keep)
        if lead[0] <= least:
            least = lead[0]
            found.append((lead[0], _trace(initials, faults, table, k, lead)))
    return min(found)


def by_phases(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """The same result from costs by grammar phase: nothing yet, after s, after u, after a. Linear in the turns."""
    n = len(initials)
    moves = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}

    def filled(row: list[int]) -> list[int]:
        for _ in range(2):  # at most two insertions in a row are of use
            for p in moves:
                for c, q in moves[p]:
                    if c != "s":
                        row[p] = min(row[p], row[q] + INSERT)
        return row

    ahead = [filled([0, FAR, FAR, 0])]
    for i in range(n - 1, -1, -1):
        stays, more = _step_costs(initials[i], faults[i])
        row, after = [], ahead[-1]
        for p in moves:
            best = after[p] + DELETE
            for c, q in moves[p] if stays else ():
                if initials[i] == c or c != "s":
                    best = min(best, after[q] + more + (0 if initials[i] == c else REROLE))
            row.append(best)
        ahead.append(filled(row))
    ahead.reverse()
    i, reached, out = 0, {0}, []
    left = ahead[0][0]
    cost = left
    while not (i == n and left == 0):
        stays, more = _step_costs(initials[i], faults[i]) if i < n else (False, 0)
        best = None
        for letter in "DIKR":
            to: dict[int, set[int]] = {}
            for p in reached:
                if letter == "D":
                    options = [(p, DELETE)] if i < n else []
                elif letter == "I":
                    options = [(q, INSERT) for c, q in moves[p] if c != "s"]
                else:
                    options = [(q, more if letter == "K" else more + REROLE) for c, q in (moves[p] if stays else ()) if (initials[i] == c if letter == "K" else c not in ("s", initials[i]))]
                for q, price in options:
                    if ahead[i if letter == "I" else i + 1][q] + price == left:
                        to.setdefault(price, set()).add(q)
            if to:
                best = (letter, to)
                break
        letter, to = best
        (price, reached), = to.items()
        out.append(letter)
        left -= price
        i += letter != "I"
    return cost, "".join(out)


def best_audit(initials: list[str], faults: list[int]) -> tuple[int, str]:
    return by_lengths(initials, faults) if len(initials) <= LONG else by_phases(initials, faults)


def _order(*first: str) -> list[Column]:
    return [F.col(n) for n in first] + [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: key, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    plain = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(plain == "", BLANK).when(F.substring(plain, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    light = rows.select("key", "turn", "role", F.unhex(F.md5("text")).alias("digest"), fault.cast("int").alias("fault"), "copies")
    dealt = light.repartition("key").sortWithinPartitions(*_order("key"))
    kind = dict(rows.dtypes)["key"]
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, done, open_key, now = None, [], None, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("key", batch.schema.field(0).type), *[(n, pa.string() if n == "audit" else pa.int64()) for n in names]])
            for key, turn, role, digest, fault, copies in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if now is None or key != open_key:
                    if now is not None:
                        done.append((open_key, *now.result()))
                    open_key, now = key, _Conversation()
                for _ in range(copies):
                    now.add(turn, role, digest, fault)
            if len(done) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)
                done = []
        if now is not None:
            done.append((open_key, *now.result()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)

    return dealt.mapInArrow(scan, f"key {kind}, " + ", ".join(f"{n} {'string' if n == 'audit' else 'bigint'}" for n in names))


class _Conversation:
    """What one conversation needs: initials, faults, digests seen and the range of turns."""

    def __init__(self):
        self.initials, self.faults, self.seen = [], [], set()
        self.low = self.high = self.last = None
        self.distinct = 0

    def add(self, turn, role, digest, fault):
        if turn is not None and turn != self.last:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.last, self.distinct = turn, self.distinct + 1
        same = hashlib.blake2b(digest + role.encode(), digest_size=16).digest()
        if fault != BLANK and same in self.seen:
            fault = DUPLICATE
        self.seen.add(same)
        self.initials.append(role[:1])
        self.faults.append(fault)

    def result(self):
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.distinct)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        return (gaps, *[self.faults.count(f) for f in (BLANK, DUPLICATE, CUT)], illegal, *best_audit(self.initials, self.faults))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, place, role, text of all turns of repaired conversations, in order within a task.

    ``found`` has the audit of each conversation of ``rows``. A conversation whose repair has no turns gives one row with
    NULL place, role and text.
    """
    none = F.lit(None)
    heads = found.select("key", F.lit(0).alias("part"), none.cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    body = rows.where("copies > 0").select("key", F.lit(1).alias("part"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text", "copies")
    dealt = heads.unionByName(body).repartition("key").sortWithinPartitions(*_order("key", "part")).select("key", "part", "role", "text", "copies")
    kind = dict(rows.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, length = "", 0, 0, 0
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field(0).type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            keys, places, roles, texts = [], [], [], []

            def put(key, role, text):
                nonlocal place
                keys.append(key)
                places.append(place)
                roles.append(role)
                texts.append(text)
                place += 1

            def want():
                lead = length % 2
                return "s" if lead and place == 0 else "ua"[(place - lead) % 2]

            def inserted(key):
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put(key, ROLES[want()], "")
                    at += 1

            for key, part, role, text, copies in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                if part == 0:
                    audit, at, place = text, 0, 0
                    length = len(audit) - audit.count("D")
                    if not length:
                        keys.append(key)
                        places.append(None)
                        roles.append(None)
                        texts.append(None)
                    inserted(key)
                    continue
                for _ in range(copies):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        put(key, role if edit == "K" else ROLES[want()], text)
                    inserted(key)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((keys, places, roles, texts), schema)], schema=schema)

    return dealt.mapInArrow(scan, f"key {kind}, place bigint, role string, text string")


def digests(turns_in_order: DataFrame) -> DataFrame:
    """key, sha256 of ``role:text`` of the turns of ``repaired``, joined by newlines; streamed, one turn at a time."""
    kind = dict(turns_in_order.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, open_key, done = None, None, []
        names = None
        for batch in batches:
            names = pa.schema([("key", batch.schema.field(0).type), ("sha256", pa.string())])
            for key, place, role, text in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                if not place:  # the first turn, or none at all
                    if state is not None:
                        done.append((open_key, state.hexdigest()))
                    state, open_key = hashlib.sha256(), key
                if place is not None:
                    state.update((("\n" if place else "") + role + ":" + text).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), names)], schema=names)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((open_key, state.hexdigest()), names)], schema=names)

    return turns_in_order.mapInArrow(scan, f"key {kind}, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of ``turns``; audits are stored once, since both results come from them."""
    found = materialize(audits(rows), "audits")
    return found, repaired(rows, found)
