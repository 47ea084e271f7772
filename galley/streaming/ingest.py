"""Arriving packs and changed targets, batch by batch.

The inputs have no event time, so there are no watermarks: each trigger takes
what arrived and merges it. A batch is merged against the stored tables, which
makes replaying a batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators.library import import_packs, stale_pairs
from galley.plans.packs import import_library


def _stored(spark: SparkSession, table: str, ddl: str) -> DataFrame:
    """Stored rows; an absent table is empty."""
    try:
        rows = spark.read.schema(ddl).parquet(table)
        rows.schema  # resolved here on any kind of session
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)
    return rows


_PACK = "pack_id string, fingerprint string, identity string"
_REPORT = "pack_id string, pkg_id string, pack_sha256 string, target_sha256 string, options string"


Rules = Callable[[DataFrame], DataFrame]


def import_batch(batch: DataFrame, batch_id: int, library: str, log: str, rules: Rules | None = None) -> None:
    """Merge one batch of packs into a library.

    ``rules`` finds the violations (``pack_id, rule``) of a batch: whichever rule
    sets of ``quality`` its rows can be held against. Packs with any are logged as
    rejected and stay out. Rows are written under the batch id, so a repeated batch
    overwrites itself.
    """
    spark = batch.sparkSession
    before = _stored(spark, library, f"{_PACK}, batch bigint").filter(F.col("batch") != batch_id)
    stored = before.drop("batch")
    outcome = import_library(batch, stored, rules(batch)) if rules else import_packs(batch, stored)
    decided = outcome.withColumn("batch", F.lit(batch_id)).persist()
    try:
        added = decided.filter(F.col("action") == "append")
        for rows, folder in ((added.select("pack_id", "fingerprint", "identity", "batch"), library), (decided, log)):
            rows.drop("batch").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    finally:
        decided.unpersist()


def import_stream(
    arrivals: DataFrame, library: str, log: str, state: str, rules: Rules | None = None
) -> StreamingQuery:
    """Import everything that arrived so far, then stop."""
    return (
        arrivals.writeStream.foreachBatch(lambda df, i: import_batch(df, i, library, log, rules))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def refresh_batch(
    pairs: DataFrame, batch_id: int, reports: str, report: Callable[[DataFrame], DataFrame]
) -> None:
    """Report again on the pairs whose inputs changed, and on no others."""
    spark = pairs.sparkSession
    known = _stored(spark, reports, f"{_REPORT}, batch bigint").filter(F.col("batch") != batch_id)
    stale = stale_pairs(pairs.dropDuplicates(["pack_id", "pkg_id", "pack_sha256", "target_sha256", "options"]), known)
    report(stale).write.mode("overwrite").parquet(f"{reports}/batch={batch_id}")


def refresh_stream(
    pairs: DataFrame, reports: str, state: str, report: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    return (
        pairs.writeStream.foreachBatch(lambda df, i: refresh_batch(df, i, reports, report))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
