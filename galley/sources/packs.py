"""Pack files and libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galley.registries import PACK_PART_PREFIX, REQUIRED_PACK_PARTS
from galley.schemas import MANIFEST
from galley.sources.packages import members, missing_parts, read_files, scan


def parse_manifests(raw: DataFrame) -> DataFrame:
    """Manifest text to its fixed schema; unreadable JSON gives NULL."""
    return raw.withColumn("manifest", F.from_json("json", MANIFEST, {"mode": "PERMISSIVE"}))


def read_packs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Scanned packs: ``members``, ``parts``, ``packs`` and ``scanned``."""
    scanned = scan(read_files(spark, folder, "pack"), "pack")
    return split_packs(scanned)


def split_packs(scanned: DataFrame) -> dict[str, DataFrame]:
    readable = members(scanned).withColumnRenamed("pkg_id", "pack_id")
    parts = readable.filter(F.col("name").startswith(PACK_PART_PREFIX)).select(
        "pack_id",
        F.substring("name", len(PACK_PART_PREFIX) + 1, 1 << 20).alias("name"),
        "content",
    )
    manifests = readable.filter(F.col("name") == "manifest.json").select(
        "pack_id", F.col("content").cast("string").alias("json")
    )
    return {
        "scanned": scanned,
        "parts": parts,
        "packs": parse_manifests(manifests),
    }


def declared_parts(packs: DataFrame) -> DataFrame:
    """Part hashes a manifest declares."""
    return packs.select("pack_id", F.explode("manifest.part_sha256").alias("name", "sha256"))


def missing_pack_parts(parts: DataFrame) -> DataFrame:
    return missing_parts(parts.withColumnRenamed("pack_id", "pkg_id"), REQUIRED_PACK_PARTS)


def used_formats(packs: DataFrame) -> DataFrame:
    """Format previews of a library, one row each."""
    return packs.select("pack_id", F.explode("manifest.used_formats").alias("f")).select("pack_id", "f.*")


def listing(packs: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good packs, newest first, and the errors of the others.

    A broken pack never hides a good one.
    """
    bad = violations.select("pack_id").distinct()
    good = packs.join(bad, "pack_id", "left_anti")
    return good.orderBy(F.col("created_at").desc_nulls_last(), "pack_id"), violations
