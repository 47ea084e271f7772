"""Packing: an exact round trip of all ids, full windows, even mixture; token counts against plain sums."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from galley.llm import packing, token_counts, tokens


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokens.vocabulary())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "Émile", "x²", "it's", "\n\n", " ", "ünder", "42", "…", "日本", "<|endoftext|>", "a|b", "--"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 400]))) for _ in range(n)]


def test_ids_equal_the_tokenizers(reference):
    rows = texts(1, 300) + ["", None, "a b", " lead", "tail  ", "we'll 'tis", "\x1c\x85 x"]
    got = tokens.Encoder(tokens.vocabulary()).encode(rows)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode(t or "", add_special_tokens=False).ids for t in rows]


@pytest.mark.parametrize("n,parts,queues", [(200, 3, 1024), (60, 1, 2), (1, 1, 1024)])
def test_every_id_in_one_piece(spark, frame, reference, n, parts, queues):
    rows = [(i, t, "en", f"s{0 if i % 3 else i % 5}") for i, t in enumerate(texts(n, n))] + [(7, None, None, None), (None, "x", "en", "s0"), (3, "same row"), (3, "same row")]
    out = packing.pack(frame(rows).repartition(parts), window=128, quantum=16, most_queues=queues).collect()
    ids = [(d, np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t, *_ in rows]
    # Pieces of repeated rows are told apart by their place; together they must be the rows' bytes.
    pieces = sorted(out, key=lambda r: (str(r.doc_id), r.start))
    assert sorted(b"".join(sorted(p.ids for p in pieces)) and [len(p.ids) // 4 == p.length for p in pieces])[0]
    single = {d: x for d, x in ids if d not in (3, 7)}
    for d, x in single.items():
        mine = [p for p in pieces if p.doc_id == d]
        assert b"".join(p.ids for p in mine) == x and [p.start for p in mine] == list(np.cumsum([0] + [p.length for p in mine])[:-1])
        assert all(p.doc_tokens == len(x) // 4 for p in mine)
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for _, x in ids)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(windows) == list(range(len(windows)))
    for w, spans in windows.items():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0] + [b for _, b in spans])[:-1])
        assert sum(b for _, b in spans) == 128 or w == len(windows) - 1


def test_mixture_is_even(spark, frame):
    rows = [(i, "the cat sat on the mat " * 20, "en", "big" if i % 4 else "small") for i in range(400)]
    out = packing.pack(frame(rows).repartition(4), window=256, quantum=16).groupBy("sequence_id", "source").sum("length").collect()
    share = {}
    for r in out:
        share.setdefault(r.sequence_id, {})[r.source] = r[2]
    full = [s for s in share.values() if sum(s.values()) == 256]
    assert len(full) > 150 and all(abs(s.get("small", 0) - 64) <= 16 for s in full)


def test_sequences_are_whole(spark, frame):
    pieces = packing.pack(frame([(i, "some words here " * 30) for i in range(20)]), window=64, quantum=16)
    made = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in made) and {r.n_tokens for r in made[:-1]} == {64}
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(pieces).collect()}
    assert digest == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in pieces.collect()}


def test_empty_tables(spark, frame):
    assert packing.pack(frame([])).collect() == []
    assert token_counts.counted(frame([])).collect() == []


def test_rollup_equals_plain_sums(spark, frame, reference, tmp_path):
    rows = [(i, t, random.choice(["en", "de", None]), random.choice(["a", None])) for i, t in enumerate(texts(5, 80) + ["  pad ", None, ""])]
    counted = token_counts.counted(frame(rows)).cache()
    roll = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert roll.totals().collect() == []

    def want(kept, trim):
        sums = {}
        for d, t, lang, source in kept:
            n = len(reference.encode((t or "").strip() if trim else t or "", add_special_tokens=False).ids)
            docs, total = sums.get((source, lang, "v"), (0, 0))
            sums[source, lang, "v"] = docs + 1, total + n
        return sums

    def got():
        return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}

    load = token_counts.inserts(counted, "v")
    roll.commit("1", load)
    roll.commit("1", load)
    assert got() == want(rows, False)
    roll.compact()
    assert roll.commit("1", load) is False and got() == want(rows, False)
    for _ in range(2):
        roll.commit("2", token_counts.revisions(counted, "v", "tokens", "trimmed"))
    assert got() == want(rows, True)
    roll.commit("3", token_counts.deletes(counted.where("doc_id % 2 = 0"), "v", "trimmed"))
    roll.commit("4", token_counts.inserts(counted.limit(0), "v"))
    assert got() == want([r for r in rows if r[0] % 2], True)
    roll.compact()
    assert got() == want([r for r in rows if r[0] % 2], True)
