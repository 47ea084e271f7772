"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents become postings of the queried terms, one row per slice of documents, so that no list of a frequent term is ever in
one place. In a slice, the short lists of a query are added up term at a time into accumulators; the accumulators, sorted by
document and bounded by their largest sum, are then one iterator among the long lists. Document at a time (some hundred
documents per step of numpy), only iterators whose bounds can still lift a document into the best ``top`` are walked; the others
are probed by skipping to the few documents that are still open. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.common import pick, slices, stored
from galley.llm.wordhash import hashes

#: A-Z to a-z, other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of terms: digits, letters and all bytes of other characters.
TERM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Texts of a slice: so many documents, or so many bytes.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: Lists that hold at most one in so many documents of a slice are short.
SHORT = 16
#: Documents of a slice that are evaluated together.
STEP = 512

POSTINGS = "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, offsets array<int>, docs array<int>, tfs array<int>, n_docs bigint, n_terms bigint"


def split_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, end, first): the joined lower-case bytes, borders of all terms, and the number of each text's first term
    with one more entry for the end."""
    body = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = TERM[body]
    before = np.concatenate([[False], inside[:-1]])
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    return body, start, end, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def terms_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    body, start, end, _ = split_terms([text.encode()])
    raw = body.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


class Vocabulary:
    """The terms that queries ask for, found in texts by hash and confirmed byte by byte."""

    def __init__(self, terms: list[bytes]):
        body, start, end, _ = split_terms(terms)
        value = hashes(body, start, end)
        order = np.argsort(value)
        self.terms = [terms[i] for i in order.tolist()]
        self.hashes, self.body, self.start, self.length = value[order], body, start[order], (end - start)[order]

    def find(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words of the body are terms, numbers of those terms)."""
        if not len(self.hashes) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = hashes(body, start, end)
        at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == value) & (self.length[at] == end - start))
        at = at[hit]
        good, left, offset = np.ones(len(hit), bool), np.arange(len(hit)), 0
        while len(left):
            good[left] = body[start[hit[left]] + offset] == self.body[self.start[at[left]] + offset]
            offset += 1
            left = left[good[left] & (self.length[at[left]] > offset)]
        return hit[good], at[good]


def postings(batch: pa.RecordBatch, vocabulary: Vocabulary) -> dict:
    """Postings of one slice of (key, text): terms in order, each with its documents in order and their counts."""
    texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
    body, start, end, first = split_terms(texts)
    hit, term = vocabulary.find(body, start, end)
    doc = np.searchsorted(first, hit, "right") - 1
    pair, tf = np.unique(term * len(texts) + doc, return_counts=True)
    term, doc = pair // max(1, len(texts)), pair % max(1, len(texts))
    known, at = np.unique(term, return_index=True)
    lengths = np.diff(first)
    return {
        "doc_ids": batch.column(0).to_pylist(),
        "lengths": lengths,
        "terms": known,
        "offsets": np.append(at, len(term)),
        "docs": doc,
        "tfs": tf,
        "n_docs": int((lengths > 0).sum()),
        "n_terms": int(lengths.sum()),
    }


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most SLICE_ROWS rows whose texts have about SLICE_BYTES; one longer text is a slice of its own."""
    for batch in slices(batches, SLICE_ROWS):
        sizes = np.array([len(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), SLICE_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _scanner(shared, schema: pa.Schema):
    def run(batches):
        vocabulary = Vocabulary(shared.value)
        for part in _cut(batches):
            row = postings(part, vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    return run


class Best:
    """The best ``top`` documents of one query so far: higher scores first, then smaller ids, a null id before all."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, known, -scores))[: self.top]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.top:
            # A document that only reaches the last score may still win by its id.
            self.least = int(self.scores[-1])


def evaluate(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, known: np.ndarray, best: Best, step: int = STEP) -> None:
    """Adds to ``best`` the slice's documents by the sums of their scores in ``lists`` of (documents in order, scores)."""
    short = [x for x in lists if len(x[0]) * SHORT <= n_docs]
    iterators = [x for x in lists if len(x[0]) * SHORT > n_docs]
    if short:
        # Term at a time: the short lists become one list of sums.
        docs, at = np.unique(np.concatenate([d for d, _ in short]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([s for _, s in short]))
        iterators.append((docs, sums))
    iterators.sort(key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(x[1].max()) for x in iterators])
    cursors = [0] * len(iterators)
    lo = 0
    while lo < n_docs:
        # Documents that only iterators before ``essential`` hold cannot reach the least score wanted.
        essential = int(np.searchsorted(bounds, best.least))
        if essential == len(iterators):
            return
        # Skip to the next document of an essential iterator.
        heads = []
        for k in range(essential, len(iterators)):
            docs = iterators[k][0]
            cursors[k] += int(np.searchsorted(docs[cursors[k] :], lo))
            if cursors[k] < len(docs):
                heads.append(int(docs[cursors[k]]))
        if not heads:
            return
        lo = min(heads)
        hi = min(n_docs, lo + step)
        total, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for k in range(essential, len(iterators)):
            docs, scores = iterators[k]
            end = cursors[k] + int(np.searchsorted(docs[cursors[k] :], hi))
            at = docs[cursors[k] : end] - lo
            total[at] += scores[cursors[k] : end]
            seen[at] = True
            cursors[k] = end
        open_ = np.flatnonzero(seen)
        total = total[open_]
        for k in range(essential - 1, -1, -1):
            live = total + bounds[k] >= best.least
            open_, total = open_[live], total[live]
            if not len(open_):
                break
            docs, scores = iterators[k]
            at = np.minimum(np.searchsorted(docs, open_ + lo), len(docs) - 1)
            total = total + np.where(docs[at] == open_ + lo, scores[at], 0)
        live = total >= best.least
        if live.any():
            at = open_[live] + lo
            best.add(total[live], ids[at], known[at])
        lo = hi


def impacts(tf: np.ndarray, lengths: np.ndarray, docs: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight: 10^9 tf div (1000 tf + 8 m), m from the document's length."""
    m = 100 - 75 + (75 * lengths * n) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])


def _searcher(shared, schema: pa.Schema, top: int):
    def run(batches):
        queries, weights, n, total = shared.value
        best = [Best(top) for _ in queries]
        for batch in slices(batches, 1):
            row = {name: batch.column(i)[0] for i, name in enumerate(batch.schema.names)}
            ids = row["doc_ids"].values
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            lengths, terms, offsets, docs, tfs = (row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lengths", "terms", "offsets", "docs", "tfs"))
            gain = impacts(tfs, lengths, docs, n, total)
            place = dict(zip(terms.tolist(), range(len(terms))))
            for query, found in zip(queries, best):
                lists = []
                for term, repeats in query["terms"]:
                    at, weight = place.get(term), weights[term] * repeats
                    if at is not None and weight > 0:
                        lists.append((docs[offsets[at] : offsets[at + 1]], gain[offsets[at] : offsets[at + 1]] * weight))
                if lists:
                    evaluate(lists, len(lengths), ids, known, found)
        for query, found in zip(queries, best):
            if len(found.scores):
                size = len(found.scores)
                cols = [[query["at"]] * size, [query["item"]] * size, [i if k else None for i, k in zip(found.ids.tolist(), found.known.tolist())], found.scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _blocks(items: DataFrame, item: str, text: str, most_bytes: int) -> Iterator[list[dict]]:
    """Queries with their terms and repeats, in blocks of about ``most_bytes`` of text; items stream to the driver and no more than
    one block is held."""
    block, held, at = [], 0, 0
    for row in pick(items, item, text).toLocalIterator():
        found = Counter(terms_of(row[text]))
        if found:
            block.append({"at": at, "item": row[item], "terms": list(found.items())})
            held += len(row[text])
        at += 1
        if held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def weight(n: int, df: int) -> int:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search_block(docs: DataFrame, block: list[dict], item_type, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(sorted({t for q in block for t, _ in q["terms"]}))
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    empty = spark.createDataFrame([], POSTINGS)
    schema = pa.schema([(f.name, {"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}.get(f.name, pa.int64() if f.name.startswith("n_") else pa.list_(pa.int32()))) for f in empty.schema])
    index = stored(docs.mapInArrow(_scanner(spark.sparkContext.broadcast(vocabulary.terms), schema), POSTINGS))
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
    held = index.select(F.explode(F.expr("transform(terms, (t, i) -> struct(t as term, offsets[i + 1] - offsets[i] as n))")).alias("x"))
    held = held.groupBy("x.term").agg(F.sum("x.n").alias("df")).collect()  # at most one row per term of the block
    weights = np.zeros(len(number), np.int64)
    for row in held:
        weights[row.term] = weight(totals.n, row.df)
    queries = [{"at": q["at"], "item": q["item"], "terms": [(number[t], r) for t, r in q["terms"]]} for q in block]
    shared = spark.sparkContext.broadcast((queries, weights.tolist(), totals.n, totals.total))
    out = f"at bigint, item {item_type}, doc_id bigint, score bigint"
    arrow = pa.schema([("at", pa.int64()), ("item", pa.string() if item_type == "string" else pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    return index.mapInArrow(_searcher(shared, arrow, top), out)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10, most_bytes: int = 8 << 20) -> DataFrame:
    """``item, rank, key, score``: the ``top`` best documents of every query, ranks from 1, ties by smaller key.

    A score is the sum over a query's terms, repeats included, of w * (10^9 tf div (1000 tf + 8 m)) with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L; N, L and df are counted over all documents. Documents
    with score 0 are not returned.

    Queries come in blocks of at most about ``most_bytes`` of text, each against all documents: their terms are what is sent to
    executors and counted on the driver. Documents are read in slices of bounded size, wherever they lie; a task holds one
    slice and the best documents of a block's queries, and only those reach the one shuffle, which ranks them.

    Keys are cast to whole numbers. Null text has no terms; a null key is a document of its own and comes first among ties;
    every row is a document and every row of ``items`` a query, repeated or not; a query without terms returns nothing; empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, key, text).select(F.col(key).cast("long").alias(key), text)
    kind = dict(pick(items, item).dtypes)[item]
    item_type = "string" if kind == "string" else "bigint"
    found = None
    for block in _blocks(items, item, item_text, most_bytes):
        part = _search_block(rows, block, item_type, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"at bigint, item {item_type}, doc_id bigint, score bigint")
    best = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").cast(kind).alias(item), "rank", F.col("doc_id").alias(key), "score")
