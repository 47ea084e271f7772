"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star edges, exact confirmation.

* A document's set of word shingles is hashed once. The top bits of a hash choose one of ``BINS`` bins, each bin keeps its
  least hash, and an empty bin takes the value of the first non-empty bin in a fixed random order of its own.
* Bands of ``ROWS`` bins are bucket keys. Documents with equal sets are one class and enter once, so copies cost nothing.
* In a bucket only edges from its leader to each other member are candidates: as many pairs as members. The leader is the
  member that shares most buckets, which is the middle of a family of copies. Edges are confirmed on full sets.
* A bucket whose other members are not all in one component by then may hide links that do not touch the leader. Such buckets
  are cut into blocks of bounded size, and each pair of blocks is compared on full sets inside one task, which returns the
  components it finds, never pairs. So no two sets that share a bucket are left uncompared.

Two sets of similarity 0.75 share no bucket with a probability of about 5 in a million, more similar ones less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import wordhash
from galley.llm.common import checkpointed, pick
from galley.llm.graph import components

SIZE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Members and shingles of a block; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_EDGES = (np.arange(BINS, dtype=np.uint64)) << np.uint64(64 - 7)
_ORDER = np.random.default_rng(20).integers(0, BINS, (BINS, 4096))


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``size`` consecutive words, of fewer words all of them; A-Z are lowered."""
    body, start, end, first = wordhash.words([(t or "").encode().lower() for t in texts])
    h = wordhash.hashes(body, start, end)
    runs = wordhash.grams(h, size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            out.append(wordhash.grams(h[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin for a sorted, non-empty set."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.append(at[1:], len(shingles)) > at
    value = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if not len(empty):
        return value
    source = np.full(BINS, int(np.flatnonzero(full)[0]))
    source[full] = np.flatnonzero(full)
    for lo in range(0, _ORDER.shape[1], 64):
        tries = _ORDER[empty, lo : lo + 64]
        hit = full[tries]
        found = hit.any(axis=1)
        source[empty[found]] = tries[found, hit[found].argmax(axis=1)]
        empty = empty[~found]
        if not len(empty):
            break
    return value[source]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(ROWS):
        h = wordhash.mix(h ^ rows[:, k]) + np.uint64(k)
    return h.view(np.int64)


def _signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = shingle_sets(part.column(1).to_pylist())
                bands = [band_keys(signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
                offsets = np.cumsum([0, *map(len, bands)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]))),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    rows = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``rep, shingles`` of the wanted (rep, digest): full sets as sorted unsigned 64-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a document need not be compared again
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                reps, digests = part.column(0).to_pylist(), part.column(2).to_pylist()
                out: list[tuple[int, bytes]] = []
                for rep, digest, s in zip(reps, digests, shingle_sets(part.column(1).to_pylist())):
                    body = s.tobytes()
                    if rep not in seen and hashlib.blake2b(body, digest_size=16).digest() == digest:
                        seen.add(rep)
                        out.append((rep, body))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["rep", "shingles"])

    rows = pick(docs, key, text).select(F.col(key).cast("long").alias("rep"), F.col(text).alias("_text"))
    return rows.join(wanted.select("rep", "digest"), "rep").select("rep", "_text", "digest").mapInArrow(run, "rep long, shingles binary")


def similar(x: int, y: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(similar(len(p), len(q), both, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = edges.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(reps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(rep, least rep linked with it) for the members of a block pair, over pairs that are not in one component yet."""
    n = len(reps)
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1
    number, owner = number[often], owner[often]
    both = np.zeros((n, n), np.float32)
    lo = 0
    while lo < len(number):  # shared tokens, some thousands at a time
        hi = int(np.searchsorted(number, number[lo] + 4096))
        _, column = np.unique(number[lo:hi], return_inverse=True)
        matrix = np.zeros((n, int(column.max()) + 1), np.float32)
        matrix[owner[lo:hi], column] = 1
        both += matrix @ matrix.T
        lo = hi
    common = np.rint(both).astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    linked &= roots[:, None] != roots[None, :]
    label = reps.copy()
    while True:
        nearest = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        lower = np.minimum(label, nearest)
        if (lower == label).all():
            break
        label = lower
    return [(int(r), int(m)) for r, m in zip(reps, label) if r != m]


def _rest(shared: DataFrame, buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among members of buckets that the leaders' edges have not joined."""
    known = shared.join(found, shared["rep"] == found["node"], "left").select("k", "rep", "n", F.coalesce("root", "rep").alias("root"))
    known = known.join(buckets.select("k", "leader", "members"), "k")
    others = F.when(F.col("rep") != F.col("leader"), F.col("root"))
    state = known.groupBy("k").agg(F.min(others).alias("low"), F.max(others).alias("high"), F.first("members").alias("members"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    # Bands often gather the same members; one such bucket is enough.
    open_ = state.where("low <> high").groupBy("members", "shingles", "s1", "s2").agg(F.min("k").alias("k"))
    parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    rows = known.select("k", "rep", "root").join(open_.select("k", parts.alias("parts")), "k")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "root").join(sets, "rep")

    def run(table: pa.Table) -> pa.Table:
        reps, first = np.unique(table.column("rep").to_numpy(), return_index=True)
        roots = table.column("root").to_numpy()[first]
        bodies = table.column("shingles").combine_chunks()
        links = block_links(reps, roots, [np.frombuffer(bodies[int(i)].as_buffer(), np.uint64) for i in first], percent) if len(set(roots.tolist())) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("k", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked if 100 * |both| >= percent * |either| for their sets of 5-word shingles; ``component_id`` is the least
    id that links reach, and ``kept`` marks the document that has it.

    Null and blank texts have no shingles and are linked with nothing. Rows that share an id are one document with several
    texts, each returned. A null id is linked with nothing, has no component and is kept. An empty table gives no rows, other
    columns are ignored. Sets are compared by 64-bit hashes of shingles.
    """
    sig = checkpointed(_signatures(docs, key, text))
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    reps = checkpointed(classes.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    rows = reps.select("rep", "n", F.explode("bands").alias("k"))
    crowded = rows.groupBy("k").agg(F.count("*").alias("members")).where("members > 1")
    shared = checkpointed(rows.join(crowded, "k").select("k", "rep", "n", "members"))
    # Leaders: the members that share most buckets, of equals the least id.
    popular = shared.groupBy("rep").agg(F.sum("members").alias("popular"))
    ranked = F.max(F.struct("popular", (-F.col("rep")).alias("minus"), "n", "members")).alias("top")
    buckets = shared.join(popular, "rep").groupBy("k").agg(ranked).select("k", (-F.col("top.minus")).alias("leader"), F.col("top.n").alias("leader_n"), F.col("top.members").alias("members"))
    buckets = checkpointed(buckets)
    # A pair's sizes alone rule it out if the smaller is less than percent of the larger.
    fits = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    edges = shared.select("k", "rep", "n").join(buckets, "k").where(F.col("rep") != F.col("leader")).where(fits)
    edges = edges.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    wanted = reps.select("rep", "digest").join(shared.select("rep").distinct(), "rep", "left_semi")
    sets = checkpointed(_sets(docs, wanted, key, text))
    links = checkpointed(_confirmed(edges, sets, percent))
    # A document with several texts links the classes of all of them, be it the least id of one of them or of none.
    own = sig.where("n_shingles > 0 and doc_id is not null").join(reps.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    bridges = own.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").select("a")
    several = own.join(reps.select(F.col("rep").alias("a")).unionByName(bridges), "a", "left_semi")
    links = links.unionByName(several.distinct())
    found = checkpointed(components(links))
    more = checkpointed(_rest(shared, buckets, found, sets, percent))
    if not more.isEmpty():
        stars = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = checkpointed(components(stars.unionByName(more)))
    named = reps.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("class"))
    out = sig.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
