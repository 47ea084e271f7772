"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens and is served in blocks of ``quantum`` tokens. Over the whole run a queue must be served in
proportion to its target, so after a share ``t`` of all service it has earned ``n * t`` of its ``n`` blocks; its deficit is
what it has earned and not yet got. The queue whose deficit first reaches half a block is served next. Deficits are never
reset, so they carry over from window to window, and since block ``j`` of a queue is due exactly at ``t = (j + 1/2) / n``, the
place of every block in the service order is a sum over queues that any task can compute alone: deficits carry across
partitions too, without packing one partition after the other. A window's mixture is within one block per queue of the target.

Every id is packed, so the targets are the queues' own shares and all queues run dry together. What is left of each queue,
less than a block, fills the last windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm import tokens
from galley.llm.common import pick, stored

#: The queue of all sources beyond the largest ``most_queues - 1``; an empty source has the queue "".
REST = "\x00rest"


def tokenized(docs: DataFrame, path: str, end: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, source, part, before, doc_tokens, ids``: ids (unsigned 32-bit, little-endian) with the end id, the input
    partition, and the tokens of the same source before this document in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen, tail = tokens.encoder(path).encode, TaskContext.get().partitionId(), {}, np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                ids = [x + tail for x in encode(piece.column(2).to_pylist())]
                before = []
                for s, x in zip(piece.column(1).to_pylist(), ids):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + len(x) // 4
                sizes = [len(x) // 4 for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "before", "doc_tokens", "ids"],
                )

    rows = pick(docs, key, source, text).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, before long, doc_tokens long, ids binary")


class Service:
    """The service order of all blocks: places of token ranges in the stream of windows."""

    def __init__(self, totals: list[int], quantum: int, window: int):
        self.quantum, self.window = quantum, window
        self.blocks = [n // quantum for n in totals]
        big = max(self.blocks, default=0) ** 2 >= 1 << 60
        self.n = np.array(self.blocks, object if big else np.int64)
        left = [n % quantum for n in totals]
        full = sum(self.blocks) * quantum
        self.tail = np.array([full + sum(left[:q]) for q in range(len(left))], np.int64)

    def places(self, queue: np.ndarray, block: np.ndarray) -> np.ndarray:
        """First token in the stream of each block; the last, part block of a queue lies in the tail."""
        out = self.tail[queue]
        own = self.n[queue]
        whole = np.flatnonzero(block < own)
        for lo in range(0, len(whole), 4096):
            at = whole[lo : lo + 4096]
            q, n = queue[at], own[at]
            due = 2 * block[at].astype(self.n.dtype) + 1
            place = np.zeros(len(at), self.n.dtype)
            for other in range(len(self.n)):
                # Blocks of the other queue that are due before; of equally due ones the lower queue goes first.
                place += (self.n[other] * due + n - (other >= q)) // (2 * n)
            out[at] = place.astype(np.int64) * self.quantum
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut the ranges [start, start + size) of queues: (range number, offset in the range, length, place) of each piece."""
        first, last = start // self.quantum, (start + size - 1) // self.quantum
        count = last - first + 1
        which = np.repeat(np.arange(len(start)), count)
        block = first[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lo = np.maximum(block * self.quantum, start[which])
        hi = np.minimum((block + 1) * self.quantum, (start + size)[which])
        place = self.places(queue[which], block) + lo - block * self.quantum
        # A part block in the tail may lie across the border of two windows.
        over = np.minimum(place + (hi - lo), (place // self.window + 1) * self.window) - place
        split = np.flatnonzero(over < hi - lo)
        which = np.concatenate([which, which[split]])
        lo2 = np.concatenate([lo, lo[split] + over[split]])
        hi2 = np.concatenate([np.minimum(hi, lo + over), hi[split]])
        place = np.concatenate([place, place[split] + over[split]])
        order = np.lexsort((lo2, which))
        which, lo2, hi2, place = which[order], lo2[order], hi2[order], place[order]
        # Neighbours that are served one after the other in one window are one piece.
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (place[1:] != place[:-1] + (hi2 - lo2)[:-1]) | (place[1:] // self.window != place[:-1] // self.window)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new)) - 1
        return which[begin], lo2[begin] - start[which[begin]], hi2[end] - lo2[begin], place[begin]


def pack(docs: DataFrame, path: str | None = None, window: int = 1024, quantum: int = 64, end: int = 0, most_queues: int = 1024, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids`` of every piece of every document.

    All sequences have ``window`` tokens but the last. ``ids`` are the piece's token ids as unsigned 32-bit little-endian bytes.
    The ``most_queues - 1`` largest sources have a queue each, all others share one: that bounds what every task is sent.
    Documents are tokenized once into a stored table; only sums by partition and source are shuffled, so a source that
    holds a third of all tokens is served by many tasks.

    Null and empty texts are the end id alone, a null source is the source "", repeated rows are packed as often as they
    occur, an empty table gives no pieces, other columns are ignored.
    """
    if window % quantum:
        raise ValueError("a window must be a whole number of quanta")
    spark = docs.sparkSession
    rows = stored(tokenized(docs, path or tokens.vocabulary(), end, key, source, text))
    sums = stored(rows.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")))
    totals = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(most_queues - 1).collect()
    everything = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = [r["source"] for r in totals] + [REST]
    sizes = [r["n"] for r in totals]
    sizes.append(everything - sum(sizes))
    queues = spark.createDataFrame(list(zip(names, range(len(names)))), "source string, queue int")
    by_queue = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.join(queues, "source", "left")
        .withColumn("queue", F.coalesce("queue", F.lit(len(names) - 1)))
        .select("part", "source", "queue", F.coalesce(F.sum("n").over(by_queue), F.lit(0)).alias("first"))
    )
    # Written, so that its size is known before the join is planned: where it is small, the ids are not shuffled.
    starts = stored(starts)
    service = Service(sizes, quantum, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                queue, start, size = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
                which, offset, length, place = service.pieces(queue, start, size)
                ids, at = part.column(5), which.tolist()
                held = [memoryview(x.as_buffer()) for x in ids]
                body = [bytes(held[w][4 * o : 4 * (o + n)]) for w, o, n in zip(at, offset.tolist(), length.tolist())]
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(offset), pa.array(length), pa.array(size[which]), pa.array(place // window), pa.array(place % window), pa.array(body, pa.binary())],
                    names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    placed = rows.join(starts, ["part", "source"]).select("doc_id", "source", "queue", (F.col("first") + F.col("before")).alias("at"), "doc_tokens", "ids")
    return placed.mapInArrow(run, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the windows themselves; a window has a bounded number of pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
