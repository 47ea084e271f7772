"""Heading counters against a step-by-step simulation, across block borders."""

import random

import pytest
from pyspark.sql import functions as F

from galley.operators.counters import heading_counters


def simulate(rows):
    live, out = {}, []
    for level, start, typed in rows:
        start = start if start > 0 else 1
        if level and any(p not in live for p in range(level)):
            value, path = start, None
        elif level == 0 and 0 not in live:
            value = typed if typed is not None else start
            path = True
        else:
            value = live[level] + 1 if level in live else start
            path = True
        live = {k: v for k, v in live.items() if k < level} | {level: value}
        out.append((value, [live[p] for p in range(level + 1)] if path else None))
    return out


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_matches_simulation(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for pkg in range(60):
        seq = [(rng.choice([0, 0, 1, 1, 2, 3, 4]), rng.randint(0, 4), rng.choice([None, 7])) for _ in range(rng.randint(1, 25))]
        for i, (value, path) in enumerate(simulate(seq)):
            want[pkg, i] = (value, path)
        rows += [(pkg, "b", i, lv, st, ty) for i, (lv, st, ty) in enumerate(seq)]
    df = spark.createDataFrame(rows, "pkg_id int, part string, ord bigint, level int, start bigint, typed bigint")
    got = {(r.pkg_id, r.ord): (r.value, r.path) for r in heading_counters(df, block=block).collect()}
    assert got == want


def test_plain_sequence(spark):
    rows = [(1, "b", i, lv, 1, None) for i, lv in enumerate([0, 1, 2, 1, 0, 1, 2])]
    df = spark.createDataFrame(rows, "pkg_id int, part string, ord bigint, level int, start bigint, typed bigint")
    out = heading_counters(df).orderBy("ord").select(F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("p"))
    assert [r.p for r in out.collect()] == ["1", "1.1", "1.1.1", "1.2", "2", "2.1", "2.1.1"]
