"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a vector of statistics. Trees are grown level by level on binned statistics with the logistic loss: one
histogram of gradients per node, statistic and bin, and the split with the best gain. All trees have the same depth, so the
forest is three arrays, and numpy walks all trees for many documents at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import held_out, pick, stored

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"'(),-./:;?@[\\]^_`{}~+="
ASCII = bytes(range(128))
NAMES = (
    "bytes", "words", "word_size", "upper", "digits", "symbols", "marks", "exclaims", "not_ascii", "lines", "same_lines", "short_lines", "distinct", "commonest", "stutter", "triples", "short_words", "long_words", "titled",
    "entropy",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of NAMES; zeros for null and empty text."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode()
    n = len(raw)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda members: (n - len(raw.translate(None, members))) / n
    count = Counter(words)
    w = max(1, len(words))
    triples = len(words) - 2 - len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 0
    sizes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = sizes[sizes > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), (n - raw.count(b" ")) / w, share(UPPER), share(DIGITS), share(SYMBOLS), share(MARKS), raw.count(b"!") / n, 1 - share(ASCII), len(lines) / w,
        1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)), len(count) / w, max(count.values(), default=0) / w,
        sum(map(str.__eq__, words, words[1:])) / w, triples / w, sum(len(x) <= 3 for x in words) / w, sum(len(x) > 14 for x in words) / w, sum(map(str.istitle, words)) / w, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Forest:
    """Trees of one depth: inner nodes (trees, 2**depth - 1) in breadth-first order, leaves (trees, 2**depth)."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees:
            tree = np.arange(trees)
            for lo in range(0, len(x), 2048):
                part = x[lo : lo + 2048]
                row = np.arange(len(part))[:, None]
                node = np.zeros((len(part), trees), np.int64)
                for _ in range((inner + 1).bit_length() - 1):
                    node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.limit[tree, node])
                out[lo : lo + 2048] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boost trees on statistics x (n, statistics) and labels y of 0 and 1. With one label only, the forest is a constant."""
    n, width = x.shape if len(x) else (0, len(NAMES))
    inner, leaves = 2**depth - 1, 2**depth
    mean = min(max(float(y.mean()), 0.01), 0.99) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: at most edges[b]
    slots = width * bins
    cell = binned + np.arange(width) * bins
    margin = np.full(n, base)
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * slots + cell).ravel()
            hist = [np.bincount(at, np.repeat(v, width), count * slots).reshape(count, width, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(v, axis=2) for v in hist)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least * 0.05) | (right_h < least * 0.05)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            value = gain.reshape(count, -1)[np.arange(count), best]
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if value[k] > 1e-6 and b < len(edges[f]):
                    forest.feature[t, first + k], forest.limit[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), forest.feature[t, node]] > forest.limit[t, node])
        leaf = node - inner
        sums_g, sums_h = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        forest.leaf[t] = -rate * sums_g / (sums_h + ridge)
        margin += forest.leaf[t, leaf]
    return forest


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, stats`` of every document."""
    rows = pick(docs, key, *keep, text)
    schema = rows.drop(text).withColumn("stats", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                stats = pa.array([statistics(t) for t in part.column(part.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], stats], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def fit(stats: DataFrame, labels: DataFrame, most: int = 20_000, key: str = "doc_id", label: str = "quality") -> Forest:
    """Learn from at most ``most`` labelled documents that are not held out, chosen by the hash of their id."""
    known = pick(labels, key, label).where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.select(key, F.col(label).cast("int").alias("_label"))
    total = known.count()
    unit = F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = known.where(unit <= min(1.0, 1.2 * most / max(1, total)))
    rows = stats.join(known, key).select("stats", "_label", F.xxhash64(key).alias("h")).orderBy("h", "_label", "stats").limit(most).collect()
    x = np.array([r["stats"] for r in rows], float).reshape(len(rows), len(NAMES))
    return grow(x, np.array([r["_label"] for r in rows], float))


def scored(stats: DataFrame, forest: Forest, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every measured document."""
    rows = stats.select(key, held_out(key).alias("held_out"), "stats")
    schema = rows.drop("stats").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(2)
            x = body.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forest.score(x))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key, held_out, score, predicted``: the probability that a document's quality is 1.

    Texts are read once: their statistics, a few numbers each, are stored, joined with the labels to learn, and scored.
    Null and empty texts have zero statistics and a score like any other; labels other than 0 and 1, without an id or of
    unknown ids teach nothing; without labels the score is 0.5; repeated rows each get a row, an empty table gives none, other
    columns are ignored.
    """
    stats = stored(measured(docs, key, text))
    return scored(stats, fit(stats, labels, most, key, label), key)
