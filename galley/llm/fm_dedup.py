"""Substring dedup with a compressed FM-index per shard.

Windows of ``size`` words are brought together by anchor (see ``anchors``): runs of windows with a repeated anchor are sent, as
words, to the shard of the anchor. A shard builds an FM-index over its distinct runs, and every run is streamed through
backward search; windows that the index holds twice are repeats. Copies of a run are added up before the shuffle; a run that
occurs twice is a repeat as it stands.

Shards are processed in chunks of whole anchors of about ``CHUNK`` words. Runs of an anchor that occurs more than ``HOT`` times
are sent window by window under the hash of the window, so no shard is larger than the others for a hot anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import wordhash
from galley.llm.anchors import inside, near_repeats, ordered, runs, sliding_min
from galley.llm.common import pick, slices
from galley.llm.fm_index import FMIndex

SIZE, GRAM, MOST = 35, 8, 28
HOT = 20_000
CHUNK = 1_000_000
#: Bytes of runs that a task holds to add up copies before it sends them.
HELD = 16_000_000
#: Documents looked at for common grams, and the share of them that makes a gram common. Only balance depends on these.
SAMPLE, COMMON = 4000, 0.005


def _low(texts: list[bytes], hot: np.ndarray, size: int):
    body, start, end, first = wordhash.words(texts)
    grams = wordhash.grams(wordhash.hashes(body, start, end), GRAM)
    value = ordered(grams, hot)
    return first, value, sliding_min(value, size - GRAM + 1)


def _common(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of grams that a share of COMMON or more of sampled documents hold: at most words / 20 of the sample."""
    total = rows.count()
    unit = F.pmod(F.xxhash64("did", F.lit("common")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                body, start, end, _ = wordhash.words([text.encode()])
                grams = np.unique(wordhash.grams(wordhash.hashes(body, start, end), GRAM) >> np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["g"])

    sampled = rows.where(unit <= SAMPLE / max(1, total)).select("row._text").mapInArrow(run, "g long")
    least = max(20, int(min(total, SAMPLE) * COMMON))
    found = sampled.groupBy("g").count().where(F.col("count") >= least).select("g").collect()
    return np.sort(np.array([r["g"] for r in found], np.int64).view(np.uint64))


def _rows(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``did, row``: the id, null as the least number, and all columns that are needed, with the text's hash ``rid``.

    Both joins with the texts take this very table, by id, so Spark deals the texts out once. Rows with equal id and text are
    treated alike.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    did = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    named = [F.col(c) for c in dict.fromkeys((key, *keep)) if c != text]
    rows = pick(docs, *dict.fromkeys((key, *keep, text)))
    return rows.select(did.alias("did"), F.struct(*named, body.alias("_text"), F.xxhash64(body).alias("rid")).alias("row"))


def _anchors(rows: DataFrame, hot, size: int) -> DataFrame:
    """``did, anchors``: one per run of windows, and one more for a run that holds two equal windows itself."""
    width = size - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 300):
            if part.num_rows:
                first, value, low = _low([t.encode() for t in part.column(1).to_pylist()], hot.value, size)
                near = near_repeats(value, width, MOST)
                found = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    anchor, start, count = runs(low, a, max(a, b - size + 1), MOST)
                    found.append(np.concatenate([anchor, inside(value, near, anchor, a + start, count, width)]))
                offsets = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["did", "anchors"])

    return rows.select("did", "row._text").mapInArrow(run, "did long, anchors array<long>")


def _cut(batch: pa.RecordBatch, hot: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes, int, int, int, int]]:
    """(shard, seg, words, did, rid, start, windows) of the runs with a repeated anchor in a batch of ``row, did, known, often``.

    The shard is the anchor and ``seg`` a hash of the words; runs of very frequent anchors are cut into windows, whose shard is
    another hash of the words.
    """
    row = batch.column(0)
    for text, rid, did, known, often in zip(row.field("_text").to_pylist(), row.field("rid").to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
        raw = text.encode()
        words = raw.split()
        low = _low([raw], hot, size)[2]
        anchor, start, count = runs(low, 0, max(0, len(words) - size + 1), MOST)
        many = set(often)
        for at in np.flatnonzero(np.isin(anchor, np.array(known, np.int64))).tolist():
            a, s, n = int(anchor[at]), int(start[at]), int(count[at])
            for lo, k in ((s, n),) if a not in many else ((s + i, 1) for i in range(n)):
                body = b" ".join(words[lo : lo + k + size - 1])
                one, two = unpack("<qq", hashlib.blake2b(body, digest_size=16).digest())
                yield (one if a in many else a), two, body, did, rid, lo, k


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _distinct(wanted: DataFrame, hot, size: int) -> DataFrame:
    """``shard, seg, words, copies``: runs, copies added up in the task that finds them."""
    kinds = {"shard": pa.int64(), "seg": pa.int64(), "words": pa.binary(), "copies": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        total = 0
        for batch in slices(batches, 200):
            for shard, seg, body, *_ in _cut(batch, hot.value, size):
                found = held.setdefault((shard, seg), [body, 0])
                found[1] += 1
                total += len(body) + 200 if found[1] == 1 else 0
            if total > HELD:
                yield _batch([(*k, *v) for k, v in held.items()], kinds)
                held, total = {}, 0
        yield _batch([(*k, *v) for k, v in held.items()], kinds)

    return wanted.mapInArrow(run, "shard long, seg long, words binary, copies long")


def _places(wanted: DataFrame, hot, size: int) -> DataFrame:
    """``shard, seg, did, rid, start`` of every run with a repeated anchor."""
    kinds = {"shard": pa.int64(), "seg": pa.int64(), "did": pa.int64(), "rid": pa.int64(), "start": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            yield _batch([(x[0], x[1], *x[3:6]) for x in _cut(batch, hot.value, size)], kinds)

    return wanted.mapInArrow(run, "shard long, seg long, did long, rid long, start long")


def shard_repeats(segments: list[bytes], copies: list[int], size: int = SIZE) -> list[int]:
    """For each distinct run of a shard, the windows that are repeats, as bits from the first window."""
    numbers: dict[bytes, int] = {}
    pieces = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in s.split(b" ")] + [0], np.int64) for s in segments]
    text = np.concatenate(pieces)
    ends = np.cumsum([len(p) for p in pieces]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    masks = [(1 << max(0, int(e - s) - size + 1)) - 1 if c > 1 else 0 for s, e, c in zip(starts, ends, copies)]
    once = np.flatnonzero(np.array(copies) == 1)
    index = FMIndex(text, MOST + size)
    stream, at = index.repeated(text, starts[once], ends[once], size)
    for k, p in zip(once[stream].tolist(), (at - starts[once[stream]]).tolist()):
        masks[k] |= 1 << p
    return masks


def _found(distinct: DataFrame, size: int) -> DataFrame:
    """``shard, seg, mask`` of distinct runs with a repeated window."""
    kinds = {"shard": pa.int64(), "seg": pa.int64(), "mask": pa.int64()}

    def flush(rows: list[list]) -> pa.RecordBatch:
        masks = shard_repeats([r[2] for r in rows], [r[3] for r in rows], size) if rows else []
        return _batch([(r[0], r[1], m) for r, m in zip(rows, masks) if m], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        words = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:2] == [row[0], row[1]]:
                    held[-1][3] += row[3]
                    continue
                if words > CHUNK and row[0] != held[-1][0]:
                    yield flush(held)
                    held, words = [], 0
                held.append(list(row))
                words += row[2].count(b" ") + 1
        yield flush(held)

    whole = distinct.repartition("shard").sortWithinPartitions("shard", "seg")
    return whole.mapInArrow(run, "shard long, seg long, mask long")


def without_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, n_words, spans, kept`` of every document.

    Every word that lies in a window of ``size`` words which also starts anywhere else, in this document or another, is
    removed. ``spans`` are the removed word ranges [from, to), merged and in order, as a flat array; ``kept`` are the other words
    joined by one space, or the text itself, white space and all, where nothing is removed.

    Null text has no words; a text of fewer words than a window loses nothing; repeated rows repeat each other; a null id is an
    id; an empty table gives no rows; other columns are ignored.
    """
    if size <= GRAM or MOST > 62:
        raise ValueError(f"windows must be longer than {GRAM} words")
    sc = docs.sparkSession.sparkContext
    rows = _rows(docs, key, text, keep)
    hot = sc.broadcast(_common(rows, size))
    # Reading the texts twice for their anchors, and cutting the runs twice, costs less than keeping them on disk.
    each = _anchors(rows, hot, size).select("did", F.explode("anchors").alias("anchor"))
    twice = each.groupBy("anchor").count().where("count > 1")
    known = each.join(twice, "anchor").groupBy("did").agg(F.collect_set("anchor").alias("known"), F.collect_set(F.when(F.col("count") > HOT, F.col("anchor"))).alias("often"))
    wanted = rows.join(known, "did").select("row", "did", "known", "often")
    found = _found(_distinct(wanted, hot, size), size)
    places = _places(wanted, hot, size).join(found, ["shard", "seg"])
    marks = places.groupBy("did").agg(F.collect_set(F.struct("rid", "start", "mask")).alias("marks"))
    joined = rows.join(marks, "did", "left").select("row", "marks")
    schema = rows.select("row.*").drop("_text", "rid").withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<bigint>"), "kept": F.lit("")}).schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            n_words, spans, kept = [], [], []
            row = batch.column(0)
            for body, rid, marks in zip(row.field("_text").to_pylist(), row.field("rid").to_pylist(), batch.column(1).to_pylist()):
                words = body.encode().split()
                gone = removed(len(words), [m for m in marks or [] if m["rid"] == rid], size)
                n_words.append(len(words))
                spans.append(gone)
                kept.append(rest(words, gone).decode() if gone else body)
            others = [row.field(n) for n in names[:-3]]
            yield pa.RecordBatch.from_arrays([*others, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())], names=names)

    return joined.mapInArrow(run, schema)


def removed(n: int, marks: list[dict], size: int) -> list[int]:
    """Word ranges that the marked windows cover, as a flat list."""
    if not marks:
        return []
    change = np.zeros(n + 1, np.int64)
    for m in marks:
        bits = m["mask"]
        starts = [m["start"] + i for i in range(bits.bit_length()) if bits >> i & 1]
        np.add.at(change, starts, 1)
        np.add.at(change, np.array(starts) + size, -1)
    covered = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(covered)).tolist()


def rest(words: list[bytes], gone: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(gone[::2], gone[1::2]):
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_removed, kept_sha256``: kept words joined by one space."""
    n_removed = F.expr("aggregate(spans, struct(0L as total, 1L as sign), (s, x) -> struct(s.total - s.sign * x as total, -s.sign as sign), s -> s.total)")
    joined = F.btrim(F.regexp_replace("kept", "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return found.select(key, "n_words", n_removed.alias("n_removed"), F.sha2(joined, 256).alias("kept_sha256"))
