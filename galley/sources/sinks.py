"""Tables written by jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PACK_BUCKETS = 256


def with_bucket(df: DataFrame, key: str = "pack_id", buckets: int = PACK_BUCKETS) -> DataFrame:
    """Storage bucket of a pack, from its id."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_packs(
    packs: DataFrame, parts: DataFrame, folder: str, run: str, buckets: int = PACK_BUCKETS
) -> None:
    """Add the packs of a run and their parts to a library.

    A run has a partition of its own that a repeat replaces. Inside it packs are
    sorted by storage bucket, so that readers of a bucket skip the other row groups
    and few files are written. Parts go first: a pack row is only visible once its
    parts are there.
    """
    for df, name in ((parts, "pack_parts"), (packs, "packs")):
        spread = with_bucket(df, buckets=buckets).repartitionByRange("bucket")
        rows = spread.sortWithinPartitions("bucket")
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={run}")


def write_plan(plan: dict[str, DataFrame], folder: str, run: str) -> None:
    """Rewrite plan tables of an apply run; a repeat replaces the run's rows."""
    for name, df in plan.items():
        df.write.mode("overwrite").parquet(f"{folder}/plan_{name}/run={run}")


def export_packs(packs: DataFrame, parts: DataFrame, violations: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated copy of chosen packs: only those without any violation."""
    bad = violations.select("pack_id").distinct()
    good = packs.join(wanted.select("pack_id").distinct(), "pack_id", "left_semi").join(
        bad, "pack_id", "left_anti"
    )
    return good, parts.join(good.select("pack_id"), "pack_id", "left_semi")
