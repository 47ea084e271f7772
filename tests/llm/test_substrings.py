"""Substring deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from galley.llm import fm_dedup, suffix_array, suffix_dedup
from galley.llm.fm_index import FMIndex


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(30)])
    index = FMIndex(text, 20)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        at = int(rng.integers(0, len(text) - n))
        pattern = text[at : at + n]
        if (pattern == 0).any():
            continue
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))


def brute_words(rows, size=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(60)] + ["a", "b"]
    draw = lambda n: rng.choices(words, k=n)
    shared = [draw(n) for n in (34, 35, 36, 50, 120, 300)]
    texts = ["", None, " \n ", "a", " ".join(["same"] * 200), " ".join(["same"] * 36), " ".join(["a", "b"] * 90)]
    for _ in range(120):
        w = draw(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared)[: rng.choice([34, 35, 60, 400])] + draw(rng.randint(0, 5))
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    texts += [texts[10]] * 4
    return list(enumerate(texts)) + [(5, texts[5]), (None, texts[12]), (None, texts[13]), (3, texts[20])]


@pytest.mark.parametrize("hot,chunk,sample", [(20_000, 1_000_000, 4000), (3, 100, 0), (20_000, 500, 4000)])
def test_words_equal_brute_force(frame, monkeypatch, hot, chunk, sample):
    monkeypatch.setattr(fm_dedup, "HOT", hot)
    monkeypatch.setattr(fm_dedup, "CHUNK", chunk)
    monkeypatch.setattr(fm_dedup, "SAMPLE", sample)
    rows = corpus(hot + chunk)
    got = fm_dedup.digest(fm_dedup.without_repeats(frame(rows).repartition(3))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)


def test_no_rows(frame):
    assert fm_dedup.without_repeats(frame([])).count() == 0


@pytest.mark.parametrize("letters", [2, 26])
def test_blockwise_order(monkeypatch, letters):
    monkeypatch.setattr(suffix_array, "BUCKET", 300)
    rng = np.random.default_rng(letters)
    block = rng.integers(97, 97 + letters, 150).astype(np.uint8)
    body = np.concatenate([block[: rng.integers(50, 150)] for _ in range(20)] + [np.full(300, 97, np.uint8), rng.integers(97, 97 + letters, 500).astype(np.uint8)])
    depth = 40
    wanted = np.arange(len(body) - depth + 1)
    sorted_ = suffix_array.BlockSuffixes(body, depth)
    raw = body.tobytes()
    got = np.concatenate(list(sorted_.buckets(wanted)))
    assert sorted(got.tolist()) == wanted.tolist()
    heads = [raw[i : i + depth] for i in got.tolist()]
    assert heads == sorted(heads)
    assert sorted_.equal_to_next(got).tolist() == [a == b for a, b in zip(heads, heads[1:])]


def brute_bytes(rows, size=100):
    bodies = [(-1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in bodies:
        for i in range(len(b) - size + 1):
            k = b[i : i + size]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, b), (orig, _) in zip(bodies, rows):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (d, i):
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(orig), len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,chunk,sample,piece", [(20_000, 4_000_000, 1000, 4_000_000), (3, 500, 0, 150), (20_000, 2000, 1000, 700)])
def test_bytes_equal_brute_force(frame, monkeypatch, hot, chunk, sample, piece):
    for name, value in (("HOT", hot), ("CHUNK", chunk), ("SAMPLE", sample), ("PIECE", piece)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(hot + chunk)
    got = suffix_dedup.digest(suffix_dedup.without_repeats(frame(rows).repartition(3))).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)
    assert suffix_dedup.without_repeats(frame([])).count() == 0


def periodic_words(seed):
    """Texts of 36 to 60 words that repeat a phrase no other text has, most of them within one run of windows."""
    rng = random.Random(seed)
    texts = [" ".join(f"p{i}" for _ in range(36 + i)) for i in range(25)]
    for k in range(60):
        phrase = [f"q{k}x{i}" for i in range(rng.randint(2, 25))]
        texts.append(" ".join([f"l{k}"] * rng.randint(0, 1) + (phrase * 30)[: rng.randint(36, 60)] + [f"r{k}"] * rng.randint(0, 1)))
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_words_repeated_inside_one_run(frame, monkeypatch, hot):
    monkeypatch.setattr(fm_dedup, "HOT", hot)
    rows = periodic_words(hot)
    got = fm_dedup.digest(fm_dedup.without_repeats(frame(rows).repartition(3))).collect()
    want = brute_words(rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(gone > 0 for _, _, gone, _ in want) > 50


def periodic_bytes(seed):
    """Texts of 101 to 180 bytes that repeat a string no other text has, most of them within one run of windows."""
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    texts = [c * n for c, n in zip("-=_*.~", (101, 115, 130, 150, 170, 180))]
    for _ in range(90):
        texts.append(draw(rng.choice([0, 3, 200])) + (draw(rng.randint(2, 79)) * 90)[: rng.randint(101, 180)] + draw(rng.choice([0, 3, 200])))
    return list(enumerate(texts))


@pytest.mark.parametrize("hot,piece", [(20_000, 4_000_000), (1, 4_000_000), (20_000, 130)])
def test_bytes_repeated_inside_one_run(frame, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = periodic_bytes(hot)
    got = suffix_dedup.digest(suffix_dedup.without_repeats(frame(rows).repartition(3))).collect()
    want = brute_bytes(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(gone > 0 for _, _, gone, _, _ in want) > 30


def test_common_passage_is_a_few_spans_a_document(frame, monkeypatch):
    """Runs of a very frequent anchor are not sent window by window from each document."""
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = draw(600)
    rows = [(i, draw(130) + passage + draw(130)) for i in range(40)]
    found, seen = suffix_dedup._repeated, []
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "_repeated", lambda *a: seen.append(found(*a)) or seen[-1])
    got = suffix_dedup.digest(suffix_dedup.without_repeats(frame(rows).repartition(3))).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)
    assert 39 <= seen[0].count() <= 40 * 40
