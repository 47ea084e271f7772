"""Conversation repair against brute force."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from galley.llm.conversation_repair import Paths, damage, repair

sys.setrecursionlimit(20_000)
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines): every way tried, for each rest of the rows and each text of initials that is still possible."""

    @lru_cache(None)
    def go(i, shape, inserted):
        ends = [(0, "", ())] if i == len(rows) and shape in ("", "a") else []
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
        step = lambda cost, letter, rest, line=None: (cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2])
        for x, name in (("u", "user"), ("a", "assistant")):
            if x in allowed and inserted < 3:
                ends.append(step(3, "I", go(i, x, inserted + 1), name + ":"))
        if i < len(rows):
            role, text, fault = rows[i]
            late = 3 * (fault == "truncated")
            ends.append(step(4, "D", go(i + 1, shape, 0)))
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in allowed:
                    ends.append(step(late, "K", go(i + 1, role[0], 0), f"{role}:{text}"))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in allowed:
                        ends.append(step(3 + late, "R", go(i + 1, x, 0), f"{name}:{text}"))
        return min(ends) if ends else (10**9, "", ())

    return go(0, "", 0)


def brute(table, damaged=True):
    found = {}
    for conv, turn, role, text in table:
        mine = found.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20 if damaged else -1
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        seen, faulty = set(), []
        for _, role, text in rows:
            body = text.strip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        n = {f: sum(x[2] == f for x in faulty) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = cheapest(tuple(faulty))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Hi.", "What?", "Go on", "é!", "", " \n", "Hi.", "x\x0b", "a:b\nc."] + [f"t{i}." for i in range(20)]
    table = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 4, 8, 8, 30])):
            role = rng.choice([["user", "assistant"][turn % 2]] * 5 + ["user", "assistant", "system", "tool", "", None, "S", "useless"])
            table.append((conv, rng.choice([turn] * 9 + [None, turn * 3 - 50]), "system" if turn == 0 and conv % 3 == 0 else role, rng.choice(texts + [None])))
    table += [(1000, None, "user", "a."), (1000, None, "user", "a."), (None, 1, "user", "q?"), (None, 2, "assistant", "r."), (1001, -(2**62), "user", "x."), (1001, 2**62, "user", "x.")]
    table += [(1002, t, ["user", "assistant"][t % 2], f"line {t % 90}.") for t in range(400)]
    table += [(1003, 0, "user", "same.")] * 300
    table += [(2000 + i, 0, "user", "Hello there.") for i in range(60)]
    return table


SCHEMA = "conv_id bigint, turn bigint, role string, text string, `CONV_ID` string, copies string"


@pytest.fixture
def made(spark):
    def make(rows):
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
        finally:
            spark.conf.unset("spark.sql.caseSensitive")

    return make


@pytest.mark.parametrize("seed,rows,chars", [(1, 50_000, 1 << 21), (2, 3, 1 << 21), (3, 50_000, 9)])
def test_repair_equals_brute_force(made, seed, rows, chars):
    table = conversations(seed)
    random.Random(seed).shuffle(table)
    got = repair(damage(made(table).repartition(6)), copies="copies", piece_rows=rows, piece_chars=chars).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(table)


def test_undamaged_and_empty(made):
    table = conversations(4)
    got = repair(made(table), piece_rows=7).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(table, damaged=False)
    assert repair(made([])).count() == 0 and repair(damage(made([])), copies="copies").count() == 0


def test_nodes_are_worked_out_once_per_distinct_rest():
    rng = random.Random(5)
    signatures = {"".join(rng.choices("suaoUAx", weights=[1, 9, 9, 1, 1, 1, 2], k=rng.randint(0, 12))) for _ in range(3000)}
    rests = {s[i:] for s in signatures for i in range(len(s))}
    paths = Paths()
    for reverse in sorted(s[::-1] for s in signatures):
        cost, audit = paths.to(reverse)
        fault = {"x": "blank"}
        rows = tuple((x.lower(), "t", fault.get(x, "truncated" if x.isupper() else "")) for x in reverse[::-1])
        assert (cost, "".join(audit)) == cheapest(rows)[:2]
    assert paths.made == len(rests) and len(paths.solver.entries) < 200
