"""Near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest

from galley.llm import near_dup


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice(base)], [f"new{rng.randint(0, 99)}"]])
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = ["", None, "   \n", "one", "One", "a b c d", "a b c D", "Ünï x", "ünï x"]
    for size, n, most in ((150, 60, 9), (40, 30, 3), (12, 20, 2), (6, 10, 1), (300, 25, 20)):
        texts += family(rng, rng.choices(vocabulary, k=size), n, most)
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(40)]
    texts += [texts[20]] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 8)])
def test_components_equal_all_pairs(frame, monkeypatch, seed, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus(seed)
    got = near_dup.near_duplicates(frame(rows).repartition(3)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(frame):
    assert near_dup.near_duplicates(frame([])).count() == 0
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "x y z"), (5, "q r s"), (7, "q r s"), (8, "x y z"), (9, None)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(rows)).collect())
    assert got == [(0, None, True), (2, 2, True), (2, 2, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]


def test_an_id_that_represents_none_of_its_texts_links_them(frame):
    rows = [(2, "a b c d e f"), (3, "x y z"), (5, "a b c d e f"), (5, "x y z"), (6, "x y z"), (7, "q r s"), (8, "q r s")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(rows)).collect())
    assert got == [(2, 2, True), (3, 2, False), (5, 2, False), (5, 2, False), (6, 2, False), (7, 7, True), (8, 7, False)]


def test_signature_of_tiny_sets():
    one = np.array([5], np.uint64)
    assert (near_dup.signature(one) == 5).all()
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:270], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dup.signature(a) == near_dup.signature(b)).mean() - j) < 0.15
