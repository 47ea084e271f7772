"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are the benchmark's word windows, as bytes with a space before, between and after the words; documents are
brought to the same form. A cursor stands at the last byte of where a pattern's first ``m`` bytes would end (``m``: the
shortest pattern). The block of bytes before the cursor is looked up in the shift table: most blocks occur in no pattern and the
cursor jumps; a shift of 0 means that some patterns' first ``m`` bytes end so. Their bucket, found by the hash of that
suffix, gives the patterns whose prefix is then compared and, if equal, the rest of the bytes.

Many cursors move at once: a text is cut into stretches and numpy advances all of them by their own shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import pick

#: A-Z to a-z; digits, letters and all bytes of other characters stay; the rest becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Length classes: patterns of at least so many bytes share a table, so one short pattern does not shorten all shifts.
CLASSES = (48, 32, 24, 16, 12, 8, 5, 3)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """The item's patterns: every ``size`` consecutive words; of an item with fewer, all words."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search tables for patterns whose length is at least ``least`` bytes."""

    def __init__(self, patterns: list[bytes], least: int):
        self.patterns, self.m = patterns, least
        self.block = min(8, max(2, least // 3)) if least > 2 else least
        entries = max(1, len(patterns) * (least - self.block + 1))
        self.bits = min(24, max(12, int(np.ceil(np.log2(entries))) + 4))
        body = np.frombuffer(b"".join(patterns), np.uint8)
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.body = body
        self.shift = np.full(1 << self.bits, least - self.block + 1, np.uint8 if least < 256 else np.int32)
        for end in range(self.block, least + 1):  # the last block of the prefix comes last and wins with 0
            h = self._hash(body, self.starts + end - 1)
            np.minimum.at(self.shift, h, least - end)
        suffix = self._suffix(body, self.starts + least - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.keys = suffix[self.order]

    def _word(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block that ends at each position, as one number."""
        value = body[at].astype(np.uint64)
        for k in range(1, self.block):
            value |= body[at - k].astype(np.uint64) << np.uint64(8 * k)
        return value

    def _hash(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((self._word(body, at) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _suffix(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Key of a suffix bucket: the last block of the first m bytes together with the first bytes before it."""
        return self._word(body, at) * MIX ^ self._word(body, at - (self.m - self.block)) * np.uint64(0xC2B2AE3D27D4EB4F)

    def search(self, body: np.ndarray, stretch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences in ``body`` and the pattern's number for each; patterns may be given more than once."""
        n, m = len(body), self.m
        if n < m or not len(self.patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cursor = np.arange(m - 1, n, stretch, dtype=np.int64)
        stop = np.minimum(cursor + stretch, n)
        found = []
        while len(cursor):
            step = self.shift[self._hash(body, cursor)].astype(np.int64)
            hits = cursor[step == 0]
            if len(hits):
                found.append(hits)
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate(found)
        keys = self._suffix(body, ends)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = hi - lo
        at = np.repeat(ends - m + 1, count)
        which = self.order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return self._confirm(body, at, which)

    def _confirm(self, body: np.ndarray, at: np.ndarray, which: np.ndarray, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Compare candidates with their patterns, some bytes at a time; those that differ are dropped at once."""
        fits = at + self.lengths[which] <= len(body)
        at, which = at[fits], which[fits]
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        offset = 0
        while len(at):
            k = offset + np.arange(width)
            inside = k[None, :] < self.lengths[which][:, None]
            p = np.minimum(self.starts[which][:, None] + k, len(self.body) - 1)
            t = np.minimum(at[:, None] + k, len(body) - 1)
            equal = ((self.body[p] == body[t]) | ~inside).all(axis=1)
            at, which = at[equal], which[equal]
            offset += width
            over = self.lengths[which] <= offset
            done.append((at[over], which[over]))
            at, which = at[~over], which[~over]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def tables(windows: dict[bytes, list[str]]) -> list[tuple[WuManber, list[list[str]]]]:
    """One search table per length class, with the items of each pattern."""
    rest, out = sorted(windows), []
    for least in (*CLASSES, 0):
        mine = [p for p in rest if len(p) >= least]
        rest = [p for p in rest if len(p) < least]
        if mine:
            out.append((WuManber(mine, least or min(map(len, mine))), [windows[p] for p in mine]))
    return out


def _blocks(items: DataFrame, item: str, text: str, size: int, most_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """Patterns with the ids of their items, in blocks of at most about ``most_bytes`` of benchmark text.

    The items stream to the driver one partition at a time; no more than one block is held.
    """
    windows, held = {}, 0
    for row in pick(items, item, text).where(F.col(text).isNotNull()).toLocalIterator():
        words = words_of(row[text])
        for w in windows_of(words, size):
            ids = windows.setdefault(w, [])
            if not ids or ids[-1] != str(row[item]):
                ids.append(str(row[item]))
        held += len(row[text])
        if held >= most_bytes:
            yield windows
            windows, held = {}, 0
    if windows:
        yield windows


STATE = "struct<n_words: bigint, spans: array<bigint>, items: array<string>>"


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, most_bytes: int = 8 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, text, n_words, spans, items`` of every document: word spans [from, to) that are hit, merged and in order,
    as a flat array, and the ids of the items that occur, in order as strings.

    Benchmarks of any size: each block of at most ``most_bytes`` of item text becomes one table of bounded size that is
    sent to the executors; documents pass through the tables of all blocks in the same task, without a shuffle. Nothing
    depends on how often an item or a source occurs.

    Null text has no words; items without words occur nowhere; repeated items share their windows; null ids are the
    text "None"; repeated documents each get a row; empty tables give no rows or no hits; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, *dict.fromkeys((key, *keep, text))).withColumn("state", F.lit(None).cast(STATE))
    found_any = False
    for windows in _blocks(items, item, item_text, size, most_bytes):
        found_any = True
        shared = spark.sparkContext.broadcast(windows)
        rows = rows.mapInArrow(_searcher(shared, rows.columns.index(text)), rows.schema)
    if not found_any:
        rows = rows.mapInArrow(_searcher(None, rows.columns.index(text)), rows.schema)
    return rows.select(key, *keep, text, F.col("state.n_words").alias("n_words"), F.col("state.spans").alias("spans"), F.col("state.items").alias("items"))


def _searcher(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines = tables(shared.value) if shared is not None else []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                before = part.column(part.num_columns - 1).to_pylist()
                state = search_texts(part.column(at).to_pylist(), engines, before)
                cols = [*part.columns[:-1], pa.array(state, part.schema.field(part.num_columns - 1).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return run


def search_texts(texts: list[str | None], engines, before: list[dict | None]) -> list[dict]:
    """Words, hit spans and items of each text, joined with what earlier blocks found."""
    forms = [b" " + b" ".join(words_of(t)) + b" " for t in texts]
    body = np.frombuffer(b"".join(forms), np.uint8)
    sizes = np.array([len(f) for f in forms], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    gap = body == 32
    # The word that follows each space has the number of spaces before it, counted from the document's first.
    rank = np.cumsum(gap)
    first = rank[base[:-1]] if len(forms) else rank[:0]
    last = rank[base[1:] - 1] if len(forms) else rank[:0]
    n_words = np.where(sizes > 2, last - first, 0)
    hits: list[dict[str, list]] = [{"spans": [], "items": set()} for _ in texts]
    for engine, ids in engines:
        at, which = engine.search(body)
        if not len(at):
            continue
        doc = np.searchsorted(base, at, "right") - 1
        lo = rank[at] - first[doc]
        hi = rank[at + engine.lengths[which] - 1] - first[doc]
        # A pattern may not begin in one document and end in the next; two spaces meet there, and no pattern has two.
        for d, a, b, w in zip(doc.tolist(), lo.tolist(), hi.tolist(), which.tolist()):
            hits[d]["spans"].append((a, b))
            hits[d]["items"].update(ids[w])
    out = []
    for n, found, old in zip(n_words.tolist(), hits, before):
        spans, ids = found["spans"], found["items"]
        if old is not None:
            flat = old["spans"]
            spans = spans + list(zip(flat[::2], flat[1::2]))
            ids = ids | set(old["items"])
        out.append({"n_words": n, "spans": merged(spans), "items": sorted(ids)})
    return out


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Spans in order, overlapping and adjoining ones joined, as a flat list."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated``: the findings as numbers."""
    n_hit = F.expr("aggregate(spans, struct(0L as total, 1L as sign), (s, x) -> struct(s.total - s.sign * x as total, -s.sign as sign), s -> s.total)")
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )
