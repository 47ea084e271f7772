"""Font coverage of a pack library on a machine's installed fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from galley.functions.fonts import alias_key
from galley.operators.fonts import match_fonts


def coverage(formats: DataFrame, aliases: DataFrame, faces: DataFrame) -> DataFrame:
    """Installed, alias, ambiguous and missing fonts per pack.

    ``formats`` has ``pack_id, font_latin, font_east_asia``; ``aliases``
    ``key, alias``. A font is matched once, however many packs name it.
    """
    named = formats.select("pack_id", F.explode(F.array("font_latin", "font_east_asia")).alias("name")).filter(
        "name IS NOT NULL AND name <> ''"
    ).distinct()
    wanted = named.select(F.col("name").alias("req_id"), "name").distinct()
    spelled = wanted.withColumn("key", alias_key(F.col("name"))).join(aliases, "key").select("req_id", "alias")
    matched = match_fonts(wanted, spelled, faces)
    return (
        named.join(matched.select(F.col("req_id").alias("name"), "kind"), "name")
        .groupBy("pack_id", "kind")
        .agg(F.count(F.lit(1)).alias("fonts"))
    )
