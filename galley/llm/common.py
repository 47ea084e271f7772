"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the deduplication operators: runs of anything but ASCII white space.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may do without it; there a temporary folder is set as the checkpoint folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="galley-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder; Spark removes the files with the DataFrame."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table of its own in the shared folder: for wide intermediate rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/galley-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most ``rows`` rows, so that a task holds few texts at a time; at least one, if there was any."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(lo, rows)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact case; others, clashing or not, are left out. A missing one is null text."""
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[(F.col(f"_{at[n]}") if n in at else F.lit(None).cast("string")).alias(n) for n in names])


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
