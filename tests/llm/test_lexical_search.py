"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from galley.llm import lexical_search
from galley.llm.lexical_search import Best, evaluate, search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            score = 0
            for t in terms(text):
                if b[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * b.total() * n) // total
                    score += w * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "É", "é", "x1", "ab", "Ab", "zz9"] + [f"w{i}" for i in range(300)]
    draw = lambda k: rng.choices(words, weights=[60, 40, 9, 9, 9, 9, 9, 9] + [1] * 300, k=k)
    docs = [(i, rng.choice([" ", "-", "\n", "\x7f", "_"]).join(draw(rng.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (7, docs[7][1]), (None, docs[9][1]), (n + 3, docs[9][1]), (n + 4, "the " * 30_000), (n + 5, "x" * 50_000 + " zz9")]
    items = [(i, " ".join(draw(rng.choice([1, 3, 30])))) for i in range(25)]
    items += [(1, items[1][1]), (None, "w1 w2 zz9"), (90, None), (91, "..."), (92, "nowhere"), (93, "x" * 50_000), (94, "the the THE w5")]
    return docs, items


@pytest.mark.parametrize("seed,most_bytes,top", [(1, 8 << 20, 10), (2, 100, 10), (3, 8 << 20, 1)])
def test_ranks_equal_brute_force(spark, frame, seed, most_bytes, top):
    docs, items = corpus(seed)
    table = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    got = search(frame(docs).repartition(5), table, top=top, most_bytes=most_bytes).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == brute(docs, items, top)


def test_empty_tables(spark, frame):
    table = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search(frame([]), table).count() == 0
    assert search(frame([(1, "a")]), table.limit(0)).count() == 0
    assert search(frame([(1, None), (2, "")]), table).count() == 0
    assert [tuple(r) for r in search(frame([(1, "a")]), table).collect()] == [(1, 1, 1, lexical_search.weight(1, 1) * (10**9 // (1000 + 8 * 100)))]


@pytest.mark.parametrize("step,short", [(1, 16), (7, 4), (64, 1), (512, 10**9)])
def test_hybrid_evaluation_equals_full_sums(monkeypatch, step, short):
    monkeypatch.setattr(lexical_search, "SHORT", short)
    rng = np.random.default_rng(step)
    for _ in range(40):
        best, full = Best(10), []
        for _ in range(4):  # slices: the least score wanted is carried on
            n = int(rng.integers(1, 400))
            ids, known = rng.permutation(10_000)[:n].astype(np.int64), rng.random(n) > 0.01
            lists, sums = [], np.zeros(n, np.int64)
            for _ in range(int(rng.integers(1, 12))):
                docs = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.1, 0.5, 1.0]))
                if len(docs):
                    scores = rng.integers(1, rng.choice([2, 5, 10**12]), len(docs))
                    lists.append((docs, scores))
                    sums[docs] += scores
            if lists:
                evaluate(lists, n, ids, known, best, step)
            full += [(-s, k, i) for s, k, i in zip(sums.tolist(), known.tolist(), ids.tolist()) if s > 0]
        assert [(-s, k, i) for s, k, i in zip(best.scores.tolist(), best.known.tolist(), best.ids.tolist())] == sorted(full)[:10]
