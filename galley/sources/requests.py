"""Edit requests: JSON of sparse style patches to long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from galley.registries import MAX_EDIT_BYTES

_REQUEST = "styles array<map<string,string>>"


def edits(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits in long form and the rejected requests.

    ``requests`` has ``pack_id, inline, file``: exactly one of the two carries
    the JSON text, of at most 1 MiB.
    """
    both = F.col("inline").isNotNull() & F.col("file").isNotNull()
    none = F.col("inline").isNull() & F.col("file").isNull()
    text = F.coalesce("inline", "file")
    parsed = requests.withColumn("request", F.from_json(text, _REQUEST)).withColumn(
        "keys", F.json_object_keys(text)
    )
    extra = F.array_except("keys", F.array(F.lit("styles")))
    rule = (
        F.when(both, F.lit("two_sources"))
        .when(none, F.lit("no_source"))
        .when(F.octet_length(text) > MAX_EDIT_BYTES, F.lit("too_large"))
        .when(F.col("keys").isNull(), F.lit("not_an_object"))
        .when(F.size(extra) > 0, F.lit("unknown_field"))
        .when(F.coalesce(F.size("request.styles"), F.lit(0)) == 0, F.lit("no_styles"))
    )
    checked = parsed.withColumn("rule", rule)
    rejected = checked.filter("rule IS NOT NULL").select("pack_id", "rule")
    each = checked.filter("rule IS NULL").select(
        "pack_id", F.posexplode("request.styles").alias("seq", "patch")
    )
    style_id = F.trim(F.try_element_at("patch", F.lit("style_id")))
    fields = F.map_filter("patch", lambda k, _: k != "style_id")
    empty = each.filter(F.size(fields) == 0).select("pack_id", F.lit("empty_patch").alias("rule"))
    long = each.select(
        "pack_id", style_id.alias("style_id"), F.explode(fields).alias("field", "value"), "seq"
    )
    return long, rejected.unionByName(empty)
