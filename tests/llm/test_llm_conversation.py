"""Conversation repair against plain enumeration, and against its SQL on odd rows."""

import hashlib
import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from cohortia.llm import conversation
from cohortia.llm.conversation import Prefixes, solved, spelled
from cohortia.llm.sql import OP13


def cheapest(rows):
    """All strings of edits, by brute force: the least (cost, audit)."""
    flat = [(i, doomed or k > 0, cut and k == 0) for i, doomed, cut, n in rows for k in range(n)]
    found = []
    for gaps in itertools.product(("", "I", "II"), repeat=len(flat) + 1):
        for ops in itertools.product("DKR", repeat=len(flat)):
            cost, state, fits = 5 * sum(map(len, gaps)), 0, True
            for gap, op, (initial, doomed, cut) in zip(gaps, (*ops, ""), (*flat, ("", False, False))):
                for _ in gap:
                    state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                if op == "D":
                    cost += 2
                elif op:
                    role = initial if op == "K" else "a" if state == 2 else "u"
                    cost += 5 * cut + (op == "R")
                    state = conversation.NEXT.get((state, role), -1)
                    fits &= not doomed and state >= 0
                if not fits:
                    break
            if fits and state in (0, 3):
                found.append((cost, "".join(map("".join, zip(gaps, (*ops, ""))))))
    return min(found)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 2])  # the small ones collide all the time
def test_cheapest_edits(modulus):
    rng = random.Random(modulus)
    for _ in range(60):
        rows = [(rng.choice("suuaax"), rng.random() < 0.15, rng.random() < 0.3, rng.choice([0, 1, 1, 1, 2])) for _ in range(rng.randint(0, 4))]
        while sum(n for *_, n in rows) > 4:
            rows.pop()
        prefixes = Prefixes(modulus=modulus)
        paths = solved(rows, conversation.START, prefixes)
        ends = [(cost + conversation.ENDS[state][0], spelled(prefixes.text(node), rows) + conversation.ENDS[state][1])
                for state, (cost, node) in paths.items()]
        assert min(ends) == cheapest(rows)


def test_strings_compare_at_their_longest_common_prefix():
    rng = random.Random(2)
    for modulus in ((1 << 61) - 1, 3):
        prefixes, nodes = Prefixes(modulus=modulus), [0]
        for _ in range(400):
            nodes.append(prefixes.grown(rng.choice(nodes[-40:]), rng.choice("DK")))
        for _ in range(2000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            x, y = prefixes.text(a), prefixes.text(b)
            assert (prefixes.compared(a, b) < 0, prefixes.compared(a, b) == 0) == (x < y, x == y)


def odd_rows(rng, conversations=40):
    texts = ["Yes.", "No!", "Why?", "well", "", " \t", "Long " * 200 + "end.", None, "é ñ.", "x\ny.", "Trailing. \n"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    out = [(c, None if rng.random() < 0.05 else t // rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts))
           for c in range(conversations) for t in range(rng.choice([1, 2, 5, 12]))]
    out += rng.choices(out, k=20)  # repeated rows
    out += [(None, t, "user" if t % 2 else "assistant", f"n{t}.") for t in range(6)]
    # One conversation that crosses chunks, with roles that go wrong now and then.
    return out + [(77, t, rng.choice(["user", "assistant"]) if t % 5 else "user", rng.choice([f"w {t}.", f"w {t}", "again."])) for t in range(300)]


def by_sql(rows):
    table = pa.table({name: pa.array(column, kind) for name, column, kind in zip(
        ("conv_id", "turn", "role", "text"), zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))})
    connection = duckdb.connect()
    connection.register("conversations", table)
    return connection.sql(OP13)


def test_repair_is_the_same_as_sql_for_any_chunk(spark):
    rows = odd_rows(random.Random(5))
    frame = spark.createDataFrame([(*r, 1, "x", None) for r in rows],
                                  "conv_id long, turn int, role string, text string, at int, audit string, copies int")
    wanted = by_sql(rows)
    for chunk in (7, 8192):
        found = conversation.audited(*conversation.damaged(frame), chunk=chunk)
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(tuple, found.select(*wanted.columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)


def test_repaired_turns_are_what_the_digest_covers(spark):
    rows = odd_rows(random.Random(9), 15)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns = {}
    for r in conversation.repaired(frame, chunk=16).orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in conversation.audited(frame, chunk=16).collect():
        own = turns.get(r.conv_id, [])
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest()
        initials = "".join(a[0] for a, _ in own).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and (initials or not own)


def test_all_rows_damaged_away_and_no_rows(spark):
    gone = next(k for k in range(1000) if __import__("zlib").crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    row = conversation.audited(*conversation.damaged(frame)).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation.audited(frame.limit(0)).collect() == []
