"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document's tokens, a delete takes them away, a revised count takes the old number
away and adds the new one. A batch of changes is summed by source, language and tokenizer version and committed as one
partition of the rollup's log; totals are sums over committed batches, so a batch costs its own size, never the corpus's.

A batch is committed under its id: writing it again replaces the partition, so a batch that is repeated after a failure counts
once. ``compact`` folds batches into a base that names them; later repeats of those are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import tokens
from galley.llm.common import pick

GROUP = ("source", "lang", "version")
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, path: str | None = None, key: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """``doc_id, source, lang, tokens, trimmed``: token counts of every whole text, and of it without surrounding white space."""
    path = path or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(3).to_pylist()]
                sizes = [len(x) // 4 for x in encode(texts)]
                short = {i: t.strip() for i, t in enumerate(texts) if t != t.strip()}
                trimmed = list(sizes)
                for i, x in zip(short, encode(list(short.values()))):
                    trimmed[i] = len(x) // 4
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes, pa.int64()), pa.array(trimmed, pa.int64())], names=["doc_id", "source", "lang", "tokens", "trimmed"])

    rows = pick(docs, key, source, lang, text).select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long, trimmed long")


def inserts(rows: DataFrame, version: str, count: str = "tokens") -> DataFrame:
    """Changes that add each row's document with its count."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), F.col(count).cast("long").alias("tokens"))


def deletes(rows: DataFrame, version: str, count: str = "tokens") -> DataFrame:
    """Changes that take each row's document away."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).cast("long").alias("docs"), (-F.col(count)).cast("long").alias("tokens"))


def revisions(rows: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Changes from an old count to a new one; the document stays."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that driver and executors share.

    Null sources and languages are groups of their own, null counts add nothing, an empty batch is a batch, and a group whose
    documents and tokens are all taken away has no row. Only the sums of a batch are kept: as many rows as it has groups.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        """Committed entries of a kind, by the marker that Spark writes when all files are there."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path)]
        return sorted(p.getName() for p in done if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches it holds."""
        bases = self._names("base")
        if not bases:
            return None, set()
        rows = self.spark.read.schema("batch string").json(f"{self.folder}/base/{bases[-1]}/batches")
        return bases[-1], {r["batch"] for r in rows.collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch, or replace it if it was added before; False if a base holds it already."""
        if batch in self._base()[1]:
            return False
        sums = changes.groupBy(*GROUP).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch/{batch}")
        return True

    def _summed(self, batches: list[str], base: str | None) -> DataFrame:
        paths = [f"{self.folder}/batch/{b}" for b in batches] + ([f"{self.folder}/base/{base}/sums"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*paths)
        out = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` over all committed batches."""
        base, held = self._base()
        return self._summed([b for b in self._names("batch") if b not in held], base)

    def compact(self) -> None:
        """Fold all committed batches into a new base; readers see the old base until the new one is complete."""
        base, held = self._base()
        batches = self._names("batch")
        name = f"{int((base or '0').split('-')[0]) + 1:012d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.folder}/base/{name}"
        self._summed([b for b in batches if b not in held], base).write.parquet(f"{target}/sums")
        listed = self.spark.createDataFrame([(b,) for b in sorted({*batches, *held})], "batch string")
        listed.coalesce(1).write.json(f"{target}/batches")
        self.spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("append").json(target)
