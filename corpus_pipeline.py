"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows of the one before; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import decontaminate, fm_dedup, language_id, near_dup, packing
from galley.llm.common import pick, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return pick(df, *COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those of no learned language go; a missing language is filled in.

    Null and empty texts have no letters; repeated rows are judged alike and all stay.
    """
    docs = _documents(docs)
    named = language_id.identify(docs, language_id.fit(docs), keep=("text", "lang", "source", "n_chars"))
    return named.where("sure").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    docs = _documents(docs)
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out; a document of which nothing is left goes."""
    found = fm_dedup.without_repeats(_documents(docs), keep=("lang", "source", "n_chars"))
    cut = F.size("spans") > 0
    found = found.where(~cut | (F.col("kept") != "")).withColumn("n_chars", F.when(cut, F.length("kept")).otherwise(F.col("n_chars")).cast("long"))
    return found.withColumnRenamed("kept", "text").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(_documents(docs), items, keep=("lang", "source", "n_chars"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack(_documents(docs))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: The language network and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
