"""Suffix-array dedup of bytes: every byte in a string of ``size`` bytes that also starts earlier is removed.

Windows of ``size`` bytes are brought together by anchor (see ``anchors``): runs of windows whose anchor occurs more than once go
to the anchor's shard as bytes, equal runs of a task once, with all their places. There all places of a run but the first are
repeats as they stand. A shard sorts the suffixes of its runs by difference-cover blocks (see ``suffix_array``); equal windows
are neighbours, and all but the earliest are repeats. A run that is its anchor's only one has no window in common with another.

Shards are processed in chunks of whole anchors of about ``CHUNK`` bytes. Runs of an anchor that occurs more than ``HOT`` times
meet by the hash of the run instead, and the first place of each goes on window by window under the hash of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.anchors import inside, near_repeats, ordered, runs, sliding_min
from galley.llm.common import pick, slices
from galley.llm.suffix_array import BlockSuffixes
from galley.llm.wordhash import BASE, mix

SIZE, GRAM, MOST = 100, 24, 80
HOT = 20_000
CHUNK = 2_000_000
#: Bytes of runs that a task holds to add up copies before it sends them, and of places that it holds of the runs it compares.
HELD = 16_000_000
#: Where a run stands.
PLACE = np.dtype([("did", "<i8"), ("rid", "<i8"), ("start", "<i4")])
#: Long texts are read in pieces of so many bytes.
PIECE = 4_000_000
#: Documents looked at for common grams, and the share of them that makes a gram common. Only balance depends on these.
SAMPLE, COMMON = 1000, 0.01


def grams(body: np.ndarray) -> np.ndarray:
    """Hash of each GRAM consecutive bytes, from hashes of 8 and 16."""
    if len(body) < GRAM:
        return np.zeros(0, np.uint64)
    h, power = body.astype(np.uint64) + np.uint64(1), BASE
    eight = None
    for width in (1, 2, 4, 8):
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        if width == 4:
            eight = h
    return mix(h[:-8] * np.uint64(pow(BASE, 8, 1 << 64)) + eight[16:])


def found_runs(texts: list[bytes], hot: np.ndarray, size: int, again: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, starts, counts) of each text's runs of windows; with ``again``, anchors of runs that hold two equal windows
    themselves come once more at the end of the anchors."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    width = size - GRAM + 1
    value = ordered(grams(joined), hot)
    low = sliding_min(value, width)
    near = near_repeats(value, width, MOST) if again else None
    out, at = [], 0
    for t in texts:
        anchor, start, count = runs(low, at, max(at, at + len(t) - size + 1), MOST)
        twice = inside(value, near, anchor, at + start, count, width) if again else anchor[:0]
        out.append((np.concatenate([anchor, twice]), start, count))
        at += len(t)
    return out


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the text, offset in it, piece) in lists that make about PIECE bytes; pieces of a text overlap by a window."""
    held, total = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - SIZE + 1), PIECE):
            held.append((i, lo, t[lo : lo + PIECE + SIZE - 1]))
            total += len(held[-1][2])
            if total >= PIECE:
                yield held
                held, total = [], 0
    if held:
        yield held


def all_runs(texts: list[bytes], hot: np.ndarray, size: int, again: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    parts: list[list] = [[] for _ in texts]
    for held in batches_of(texts):
        for (i, lo, _), (a, s, n) in zip(held, found_runs([h[2] for h in held], hot, size, again)):
            parts[i].append((a, s + lo, n))
    return [tuple(np.concatenate([p[k] for p in own]) for k in range(3)) for own in parts]


def _raw(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _common(rows: DataFrame) -> np.ndarray:
    """Hashes of grams that a share of COMMON or more of sampled documents hold: at most bytes / 10 of the sample."""
    total = rows.count()
    unit = F.pmod(F.xxhash64("did", F.lit("common")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in _raw(batch.column(0)):
                found = [grams(np.frombuffer(p, np.uint8)) for held in batches_of([text]) for _, _, p in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found) >> np.uint64(1)).view(np.int64))], names=["g"])

    sampled = rows.where(unit <= SAMPLE / max(1, total)).select("row._text").mapInArrow(run, "g long")
    least = max(10, int(min(total, SAMPLE) * COMMON))
    found = sampled.groupBy("g").count().where(F.col("count") >= least).select("g").collect()
    return np.sort(np.array([r["g"] for r in found], np.int64).view(np.uint64))


def _rows(docs: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``did, row``: the id, null as the least number, and all columns that are needed, with the text's hash ``rid``.

    Both joins with the texts take this very table, by id, so Spark deals the texts out once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    did = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    named = [F.col(c) for c in dict.fromkeys((key, *keep)) if c != text]
    rows = pick(docs, *dict.fromkeys((key, *keep, text)))
    return rows.select(did.alias("did"), F.struct(*named, body.alias("_text"), F.xxhash64(body).alias("rid")).alias("row"))


def _anchors(rows: DataFrame, hot, size: int) -> DataFrame:
    """``did, anchors`` of every document: one per run of windows, and one more for a run that holds two equal windows itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 200):
            if part.num_rows:
                found = [r[0] for r in all_runs(_raw(part.column(1)), hot.value, size, True)]
                offsets = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["did", "anchors"])

    return rows.select("did", "row._text").mapInArrow(run, "did long, anchors array<long>")


def _hashed(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _packed(places: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Places as binary values of so many places each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * PLACE.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(places.tobytes())])


def _runs(wanted: DataFrame, hot, size: int) -> DataFrame:
    """``shard, bytes, places, open``: runs with a repeated anchor, equal ones of a task once, with all their places.

    The shard is the anchor. It is a hash of the bytes where the anchor is very frequent; such runs are ``open``.
    """

    def flush(held: dict[bytes, int], keys: list[tuple[int, bool]], owner: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(np.array(owner, np.int64), kind="stable")
        every = np.concatenate([*places, np.zeros(0, PLACE)])[order]
        found = _packed(every, np.bincount(np.array(owner, np.int64), minlength=len(held)))
        columns = [pa.array([k for k, _ in keys], pa.int64()), pa.array(list(held), pa.binary()), found, pa.array([o for _, o in keys], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "bytes", "places", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, owner, places, total = {}, [], [], [], 0
        for batch in slices(batches, 200):
            row = batch.column(0)
            texts = _raw(row.field("_text"))
            for raw, rid, (anchor, start, count), did, known, often in zip(texts, row.field("rid").to_pylist(), all_runs(texts, hot.value, size), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                many = set(often)
                at = np.flatnonzero(np.isin(anchor, np.array(known, np.int64)))
                here = np.empty(len(at), PLACE)
                here["did"], here["rid"], here["start"] = did, rid, start[at]
                places.append(here)
                total += 60 * len(at)
                for a, lo, hi in zip(anchor[at].tolist(), start[at].tolist(), (start[at] + count[at] + size - 1).tolist()):
                    body = raw[lo:hi]
                    number = held.get(body)
                    if number is None:
                        number = held[body] = len(keys)
                        keys.append((_hashed(body), True) if a in many else (a, False))
                        total += len(body) + 200
                    owner.append(number)
                if total > HELD:
                    yield flush(held, keys, owner, places)
                    held, keys, owner, places, total = {}, [], [], [], 0
        yield flush(held, keys, owner, places)

    return wanted.mapInArrow(run, "shard long, bytes binary, places binary, open boolean")


def shard_repeats(segments: list[bytes], dids: np.ndarray, starts: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """For each distinct run, the windows of its first place that also start earlier: ranges [from, to), flat."""
    sizes = np.array([len(s) for s in segments], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    suffixes = BlockSuffixes(np.frombuffer(b"".join(segments), np.uint8), size)
    count = sizes - size + 1
    owner = np.repeat(np.arange(len(segments)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wanted = base[owner] + offset
    at_byte = np.repeat(np.arange(len(segments)), sizes)
    late = np.zeros(len(at_byte), bool)
    for at in suffixes.buckets(wanted):
        same = suffixes.equal_to_next(at)
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        shared = np.bincount(group)[group] > 1
        at, group = at[shared], group[shared]
        if not len(at):
            continue
        own = at_byte[at]
        did, place = dids[own], starts[own] + at - base[own]
        order = np.lexsort((place, did, group))
        at, group, did, place = at[order], group[order], did[order], place[order]
        first = np.searchsorted(group, group)
        late[at] = (did != did[first]) | (place != place[first])
    out = []
    for b, n in zip(base.tolist(), count.tolist()):
        flags = late[b : b + n]
        out.append(np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist() if flags.any() else [])
    return out


class _Chunk:
    """Different runs in order of shard and bytes, with their places."""

    def __init__(self, size: int):
        self.size, self.bodies, self.shards, self.open, self.pieces, self.owner, self.total, self.weight = size, [], [], [], [], [], 0, 0

    def add(self, shard: int, body: bytes, places: bytes, is_open: bool) -> None:
        if not self.bodies or (self.shards[-1], self.bodies[-1]) != (shard, body):
            self.bodies.append(body)
            self.shards.append(shard)
            self.open.append(is_open)
            self.total += len(body)
        self.pieces.append(places)
        self.owner.append(len(self.bodies) - 1)
        self.weight += len(places)

    def others(self) -> pa.RecordBatch:
        """Spans of all places of a run but the first, which is kept: rows that share an id may have it together."""
        rec = np.frombuffer(b"".join(self.pieces), PLACE)
        owner = np.repeat(np.array(self.owner, np.int64), [len(p) // PLACE.itemsize for p in self.pieces])
        order = np.lexsort((rec["rid"], rec["start"], rec["did"], owner))
        rec, owner = rec[order], owner[order]
        head = rec[np.searchsorted(owner, np.arange(len(self.bodies)))][owner]
        first = (rec["did"] == head["did"]) & (rec["start"] == head["start"])
        kept, number = rec[first], owner[first]
        once = np.concatenate([[True], (number[1:] != number[:-1]) | (kept["rid"][1:] != kept["rid"][:-1])])
        self.pieces, self.owner, self.weight = [p.tobytes() for p in kept[once]], number[once].tolist(), 0
        late = rec[~first]
        return _spans(late["did"], late["rid"], late["start"], late["start"] + np.array([len(b) for b in self.bodies], np.int64)[owner[~first]])

    def alone(self) -> np.ndarray:
        """Runs that are their shard's only ones and hold no two equal windows themselves."""
        shards = np.array(self.shards, np.int64)
        apart = np.concatenate([[True], shards[1:] != shards[:-1], [True]])
        lone = apart[:-1] & apart[1:]
        at = np.flatnonzero(lone)
        begin = np.cumsum([0, *(len(self.bodies[i]) for i in at.tolist())])
        near = near_repeats(grams(np.frombuffer(b"".join([self.bodies[i] for i in at.tolist()]), np.uint8)), self.size - GRAM + 1, MOST)
        lone[at[np.searchsorted(begin, near, "right") - 1]] = False
        return lone

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Spans of what is repeated, and the windows of open runs."""
        if not self.bodies:
            yield _spans(*[np.zeros(0, np.int64)] * 4)
            return
        yield self.others()
        first = np.frombuffer(b"".join(self.pieces), PLACE)
        owner = np.array(self.owner, np.int64)
        head = first[np.searchsorted(owner, np.arange(len(self.bodies)))]
        is_open = np.array(self.open, bool)
        met = np.flatnonzero(~is_open & ~self.alone())
        late = shard_repeats([self.bodies[i] for i in met.tolist()], head["did"][met], head["start"][met].astype(np.int64), self.size) if len(met) else []
        ranges = {i: x for i, x in zip(met.tolist(), late) if x}
        found = [(*p.tolist(), a, b + self.size - 1) for p, o in zip(first, owner.tolist()) if (x := ranges.get(o)) for a, b in zip(x[::2], x[1::2])]
        did, rid, start, lo, hi = (np.array([f[i] for f in found], np.int64) for i in range(5))
        yield _spans(did, rid, start + lo, start + hi)
        for place, o in zip(first, owner.tolist()):
            if is_open[o]:
                body, n = self.bodies[o], len(self.bodies[o]) - self.size + 1
                at = np.full(n, place, PLACE)
                at["start"] += np.arange(n, dtype=np.int32)
                windows = [body[i : i + self.size] for i in range(n)]
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([_hashed(w) for w in windows], pa.int64()), *none, pa.array(windows, pa.binary()), _packed(at, np.ones(n, np.int64))], names=_NAMES)


#: Spans have no bytes; windows have bytes and places.
_FOUND = "shard long, did long, rid long, lo int, hi int, bytes binary, places binary"
_NAMES = ["shard", "did", "rid", "lo", "hi", "bytes", "places"]


def _spans(did: np.ndarray, rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    wide, narrow = (lambda x: pa.array(np.ascontiguousarray(x, np.int64))), (lambda x: pa.array(np.ascontiguousarray(x, np.int32)))
    columns = [wide(did), wide(did), wide(rid), narrow(lo), narrow(hi)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(did), pa.binary()), pa.nulls(len(did), pa.binary())], names=_NAMES)


def _compared(items: Iterator[tuple | pa.RecordBatch], size: int, most: int, weight: int) -> Iterator[pa.RecordBatch]:
    """What is found in chunks of runs (``shard, bytes, places, open``); batches among them are handed on."""
    chunk = _Chunk(size)
    for item in items:
        if isinstance(item, pa.RecordBatch):
            yield item
            continue
        if chunk.total > most and item[0] != chunk.shards[-1]:
            yield from chunk.flush()
            chunk = _Chunk(size)
        chunk.add(*item)
        if chunk.weight > weight:
            yield chunk.others()
    yield from chunk.flush()


def _repeated(runs: DataFrame, size: int) -> DataFrame:
    """``did, rid, lo, hi``: byte ranges of documents that also start earlier."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        yield from _compared(rows, size, CHUNK, HELD)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column(5).is_null())
            rest = batch.filter(batch.column(5).is_valid())
            yield from zip(*(rest.column(i).to_pylist() for i in (0, 5, 6)), [False] * rest.num_rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _compared(parts(batches), size, CHUNK, HELD):
            yield found.select(_NAMES[1:5])

    found = runs.repartition("shard").sortWithinPartitions("shard", "bytes").mapInArrow(whole, _FOUND)
    return found.repartition("shard").sortWithinPartitions("bytes").mapInArrow(windows, "did long, rid long, lo int, hi int")


def without_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, n_bytes, spans, kept`` of every document.

    A byte is removed if it lies in a string of ``size`` bytes that also starts earlier: in a smaller id, or before in the same
    document. ``spans`` are the removed byte ranges [from, to), maximal and in order, as a flat array; ``kept`` are the
    remaining bytes (binary: a cut may fall inside a character).

    Null text is empty; a text shorter than a window loses nothing; rows that share an id are one document, so repeated rows
    lose the same bytes; a null id is smaller than all; an empty table gives no rows; other columns are ignored.
    """
    if size < 2 * GRAM:
        raise ValueError(f"windows must have at least {2 * GRAM} bytes")
    rows = _rows(docs, key, text, keep)
    hot = docs.sparkSession.sparkContext.broadcast(_common(rows))
    each = _anchors(rows, hot, size).select("did", F.explode("anchors").alias("anchor"))
    # The anchors are dealt out once, as rows of two numbers.
    twice = each.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("count > 1")
    known = twice.groupBy("did").agg(F.collect_set("anchor").alias("known"), F.collect_set(F.when(F.col("count") > HOT, F.col("anchor"))).alias("often"))
    wanted = rows.join(known, "did").select("row", "did", "known", "often")
    marks = _repeated(_runs(wanted, hot, size), size).groupBy("did").agg(F.collect_set(F.struct("rid", "lo", "hi")).alias("marks"))
    joined = rows.join(marks, "did", "left").select("row", "marks")
    schema = rows.select("row.*").drop("_text", "rid").withColumns({"n_bytes": F.lit(0).cast("long"), "spans": F.array().cast("array<bigint>"), "kept": F.lit("").cast("binary")}).schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            n_bytes, spans, kept = [], [], []
            row = batch.column(0)
            for raw, rid, own in zip(_raw(row.field("_text")), row.field("rid").to_pylist(), batch.column(1).to_pylist()):
                gone = merged([(m["lo"], m["hi"]) for m in own or [] if m["rid"] == rid])
                cuts = [0, *gone, len(raw)]
                n_bytes.append(len(raw))
                spans.append(gone)
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            others = [row.field(n) for n in names[:-3]]
            yield pa.RecordBatch.from_arrays([*others, pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=names)

    return joined.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256``."""
    return found.select(key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
