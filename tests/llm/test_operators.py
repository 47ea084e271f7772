"""Decontamination, outlier rules and sharding against brute force; awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import decontaminate, outliers, sharding


def fold(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, size=10):
    words = fold(text)
    hit, found = set(), set()
    for item, body in items:
        w = fold(body)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            p = w[k : k + size]
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most_bytes", [1 << 20, 300])
def test_decontamination(spark, frame, most_bytes):
    rng = random.Random(most_bytes)
    vocabulary = ["the", "Of", "and", "é", "x1", "longerword", "a", "b"]
    draw = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, rng.choice([" ", "-", ", "]).join(draw(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(1, items[1][1]), (77, None), (78, "..."), (None, "null item here"), (79, "zz"), (80, " ".join(["longerword"] * 12))]
    texts = [None, "", "!!", "zz", "zz zz", "Zz.", "null item here"]
    for _ in range(80):
        w = draw(rng.randint(0, 60))
        w[rng.randint(0, len(w)) :] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice([" ", "\n", "?  "]).join(w))
    rows = list(enumerate(texts)) + [(3, "zz"), (None, "zz")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.contaminated(frame(rows), table, most_bytes=most_bytes)).collect()
    want = [(d, *brute_hits(t, items)) for d, t in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    empty = decontaminate.digest(decontaminate.contaminated(frame(rows), table.limit(0))).collect()
    assert len(empty) == len(rows) and not any(r.contaminated for r in empty)
    assert decontaminate.contaminated(frame([]), table).count() == 0


def brute_statistics(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + k for v in grams.values() if len(v) > 1 for p in v for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def documents(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "a", "a b", "a a a", "a a a a", "x\x0by\x0cz", "é\n\né\n é\né", "#*$ %&|<>", "  nbsp", "line\r\nline\r\n"]
    for _ in range(60):
        texts.append(rng.choice([" ", "\n", "  "]).join(rng.choices(["ab", "c", "#d", "éf", "g|"], k=rng.randint(0, 120))))
    return texts


def test_statistics(frame):
    rows = list(enumerate(documents(4))) + [(0, None), (None, "a b c a b c")]
    got = outliers.statistics(frame(rows)).collect()
    want = [(d, *brute_statistics(t)) for d, t in rows]
    assert sorted(map(str, [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got])) == sorted(map(str, want))


def test_robust_rules(frame):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(5000)]
    rows = []
    for i in range(400):
        n = rng.randint(60, 300)
        odd = i % 40 == 0
        words = [w + ("$$%%" if odd else "") for w in rng.sample(vocabulary, n)]
        rows.append((i, " ".join(words), rng.choice(["en", None]), "big" if i % 3 else "small"))
    rows += [(1000, None), (1001, "short"), (1002, " ".join(["same"] * 80)), (None, " ".join(rng.sample(vocabulary, 90)), "xx", "alone")]
    got = {r.doc_id: r for r in outliers.robust_outliers(frame(rows)).collect()}
    assert len(got) == len(rows)
    assert all(not got[i].kept for i in (1000, 1001, 1002)) and all(got[i].base_failed for i in (1000, 1001, 1002))
    assert [got[i].kept for i in range(400)] == [i % 40 != 0 for i in range(400)] and got[None].kept
    assert outliers.robust_outliers(frame([])).count() == 0
    few = outliers.robust_outliers(frame([(1, " ".join(rng.sample(vocabulary, 90))), (2, None)])).collect()
    assert {r.doc_id: r.kept for r in few} == {1: True, 2: False}


def test_statistics_of_texts_beyond_the_packed_positions(frame, monkeypatch):
    monkeypatch.setattr(outliers, "POSITION_BITS", 4)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "dd"], k=n))) for i, n in enumerate([0, 2, 3, 15, 16, 17, 18, 40, 90, 300])]
    got = outliers.statistics(frame(rows)).collect()
    want = [(d, *brute_statistics(t)) for d, t in rows]
    assert sorted(map(str, [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got])) == sorted(map(str, want))


def test_equal_windows_with_others_of_the_same_hash_between_them(frame, monkeypatch):
    monkeypatch.setattr(outliers, "window_hash", lambda words="words", at="i": f"pmod(xxhash64({words}[{at}], {words}[{at} + 1], {words}[{at} + 2]), 8L)")
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(12)], k=n))) for i, n in enumerate([3, 40, 200, 400])]
    for bits in (24, 5):
        monkeypatch.setattr(outliers, "POSITION_BITS", bits)
        got = {r.doc_id: r.n_repeat_words for r in outliers.statistics(frame(rows)).collect()}
        assert got == {d: brute_statistics(t)[4] for d, t in rows}


def test_null_and_empty_names_are_groups_of_their_own(frame):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(5000)]
    plain = lambda n: " ".join(rng.sample(vocabulary, n))
    rows = [(i, plain(100), None if i % 2 else "", "s") for i in range(200)]
    rows = [(d, " ".join(w + "$$" for w in t.split()) if lang is None else t, lang, s) for d, t, lang, s in rows]
    assert all(r.kept for r in outliers.robust_outliers(frame(rows)).collect())


def test_minimum_covariance_against_numpy(spark):
    rng = np.random.default_rng(4)
    n, k = 400, len(outliers.AXES)
    mix = rng.normal(size=(k, k))
    x = np.round(rng.normal(size=(n, k)) @ mix, 3)
    x[:40] += 25
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{a} double" for a in outliers.AXES))
    (got,) = outliers.minimum_covariance(rows, ["g"]).collect()
    floor = np.array([outliers.FLOOR[a] for a in outliers.AXES])
    centre = np.median(x, axis=0)
    factor = np.diag(np.sqrt((1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2 + floor**2))
    for _ in range(3):
        y = np.linalg.solve(factor, (x - centre).T)
        bins = np.floor(np.log((y**2).sum(axis=0) + 1e-6) * 64)
        near = x[bins <= np.percentile(bins, 75)]
        centre = near.mean(axis=0)
        factor = np.linalg.cholesky(np.cov(near.T, bias=True) + np.diag(floor**2))
    assert np.allclose([got[f"m_{i}"] for i in range(k)], centre, atol=1e-6)
    assert np.allclose([[got[f"l_{i}_{j}"] if j <= i else 0 for j in range(k)] for i in range(k)], factor, atol=1e-6)


def test_an_outlier_on_each_axis_is_rejected(frame):
    rng = random.Random(10)
    vocabulary = [f"word{i:04}" for i in range(5000)]
    lines = lambda w, k=10: [" ".join(w[i : i + k]) for i in range(0, len(w), k)]
    rows = [(i, "\n".join(lines(rng.sample(vocabulary, rng.randint(100, 300)))), "en", "s") for i in range(300)]
    plain = rng.sample(vocabulary, 200)
    odd = {
        "length": "\n".join(lines([f"word{i:04}" for i in range(9000)])),
        "word_size": "\n".join(lines([w + "xxxx" for w in plain])),
        "symbols": "\n".join(lines([w + "#" for w in plain])),
        # Lines of two words are no 3-word window by themselves: two of five lines are copies.
        "lines": "\n".join(x for i, w in enumerate(lines(plain[:120], 2)) for x in ([w, "two words"] if i % 3 < 2 else [w])),
        "repeats": "\n".join(lines(plain[:160] + plain[:40])),
    }
    found = outliers.robust_outliers(frame(rows + [(1000 + i, t, "en", "s") for i, t in enumerate(odd.values())])).collect()
    got = {r.doc_id: r for r in found}
    assert not any(got[1000 + i].base_failed for i in range(5))
    assert [name for i, name in enumerate(odd) if got[1000 + i].kept] == []
    assert sum(got[i].kept for i in range(300)) >= 295


def test_outliers_run_without_python(frame):
    plan = outliers.robust_outliers(frame([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sharding(spark, frame):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7)) for i in range(1000)] + [(5, "again"), (5, "again"), (None, "x")]
    weights = [1.0] * 8 + [2.0] * 4
    got = sharding.rendezvous(frame(rows).repartition(5), weights, weights + [1.0]).collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in range(12):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 12 for r in moved) and 20 < len(moved) < 110
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    heavy = sum(r.shard >= 8 for r in got) / len(got)
    assert abs(heavy - 0.5) < 0.07
    again = {(r.doc_id, r.shard) for r in sharding.rendezvous(frame(rows), weights).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}
    assert sharding.rendezvous(frame([]), [1.0]).count() == 0
    plan = sharding.rendezvous(frame(rows), weights)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bids_match_their_rule(spark):
    df = spark.range(200).select("id", sharding.choose(F.col("id"), [1.0, 3.0]).alias("s"), *[F.xxhash64("id", F.lit(k)).alias(f"h{k}") for k in range(2)])
    for r in df.collect():
        costs = [-math.log((((r[f"h{k}"] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)) / w for k, w in enumerate([1.0, 3.0])]
        assert r.s == costs.index(min(costs))
