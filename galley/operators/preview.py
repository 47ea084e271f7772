"""Format previews: what every style of a profile looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from galley.functions.numerals import example
from galley.functions.props import BAG, attr, bag_attr, has_prop, merge_bag, preview_indents
from galley.functions.text import sample_text
from galley.functions.units import (
    eighth_points,
    half_points,
    hex_color,
    line_rule,
    line_spacing,
    on_value,
    twips_to_pt,
)
from galley.operators import ordering
from galley.operators.fonts import text_color
from galley.operators.graph import settled
from galley.schemas import PROFILE, RULE


def table_colors(tpr: Column, shades: Column, header_fill: Column, colors: Column) -> dict:
    """Fill and accent of a table style.

    The base shade, else the first valid shade anywhere; the first-row shade,
    else the first valid text colour. ``shades`` and ``colors`` are raw values
    in document order.
    """
    first_valid = lambda values: F.try_element_at(
        F.filter(F.transform(values, hex_color), lambda v: v.isNotNull()), F.lit(1)
    )
    base = hex_color(bag_attr(tpr, "shd", "fill"))
    return {
        "table_fill_hex": F.coalesce(base, first_valid(shades)),
        "table_accent_hex": F.coalesce(hex_color(header_fill), first_valid(colors)),
    }


def table_measures(tpr: Column) -> dict:
    """Top border and cell margins of a table style."""
    border = F.try_element_at(tpr, F.lit("tblBorders"))
    margins = F.try_element_at(tpr, F.lit("tblCellMar"))
    out = {
        "table_border_style": attr(border, "top.val"),
        "table_border_color_hex": hex_color(attr(border, "top.color")),
        "table_border_width_pt": eighth_points(attr(border, "top.sz")),
    }
    for side in ("top", "bottom", "left", "right"):
        in_twips = F.coalesce(attr(margins, f"{side}.type"), F.lit("dxa")) == "dxa"
        out[f"table_cell_margin_{side}_pt"] = F.when(in_twips, twips_to_pt(attr(margins, f"{side}.w")))
    return out


def with_override(eff_ppr: Column, ind: Column, spacing: Column, jc: Column) -> Column:
    """Effective bag after a saved heading override."""
    none = F.create_map().cast(BAG)
    entry = lambda name, value: F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(none)
    alignment = F.when(jc.isNotNull(), F.create_map(F.lit("val"), jc))
    return merge_bag(eff_ppr, F.map_concat(entry("ind", ind), entry("spacing", spacing), entry("jc", alignment)))


LOOK = "model string, style_id string, style_type string, rule struct<" + RULE.replace(" string", ":string").replace(" int", ":int") + ">, " \
    "restart boolean, " + PROFILE


def previews(
    usage: DataFrame,
    models: DataFrame,
    resolved: DataFrame,
    fonts: DataFrame,
    colors: DataFrame,
    rules: DataFrame,
    profiles: DataFrame,
) -> DataFrame:
    """Preview record of every style in ``usage``, with its ``rank`` in a list.

    ``usage`` has ``pkg_id, style_type, style_id, usage_count, by_story,
    inferred, inference_label``; ``rules`` may carry ``restart``. ``models`` has
    ``pkg_id, model``; ``resolved``, ``fonts`` and ``colors`` are those of the
    models. A style looks alike in all packages of a model that give it the same
    rule and profile: it is worked out once, under these values as JSON.
    """
    keys = ["pkg_id", "style_id"]
    shape = StructType.fromDDL(LOOK)
    asked = (
        usage.join(models, "pkg_id", "left")
        .join(rules.select(*keys, "rule", "restart"), keys, "left")
        .join(profiles, keys, "left")
        .withColumn("look", F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape])))
        .select(*keys, "usage_count", "inferred", "inference_label", F.col("by_story").alias("usage_by_story"), "look")
    )
    asked = settled(asked)
    distinct = asked.select("look").distinct().select("look", F.from_json("look", shape).alias("l")).select("look", "l.*")
    named = lambda df: df.withColumnRenamed("pkg_id", "model")
    joined = (
        distinct.join(named(resolved.drop("style_type", "ord")), ["model", "style_id"], "left")
        .join(named(fonts), ["model", "style_id"], "left")
        .join(named(colors), "model", "left")
    )
    rank = ordering.format_rank(F.col("type"), F.col("outline_level"), F.col("name"))
    return asked.join(_shown(joined).withColumn("rank", rank), "look").drop("look")


def _shown(joined: DataFrame) -> DataFrame:
    joined = joined.withColumn("ppr_", with_override(F.col("eff_ppr"), F.col("ind"), F.col("spacing"), F.col("jc")))
    r = F.col("rule")
    ppr, rpr = F.col("ppr_"), F.col("eff_rpr")
    line, rule = bag_attr(ppr, "spacing", "line"), bag_attr(ppr, "spacing", "lineRule")
    shown = F.when(r.isNotNull(), example(r["level_text"], r["level"], r["start"]))
    name = F.coalesce("name", "style_id")
    return joined.select(
        "look",
        name.alias("name"),
        F.col("style_type").alias("type"),
        sample_text(F.col("style_type"), name, F.col("outline"), shown).alias("sample"),
        "font_latin",
        "font_east_asia",
        half_points(F.coalesce(bag_attr(rpr, "sz", "val"), bag_attr(rpr, "szCs", "val"))).alias("size_pt"),
        on_value(rpr, "b").alias("bold"),
        on_value(rpr, "i").alias("italic"),
        text_color(rpr, F.col("theme_colors")).alias("color_hex"),
        bag_attr(ppr, "jc", "val").alias("alignment"),
        twips_to_pt(bag_attr(ppr, "spacing", "before")).alias("space_before_pt"),
        twips_to_pt(bag_attr(ppr, "spacing", "after")).alias("space_after_pt"),
        line_spacing(line, rule).alias("line_spacing"),
        line_rule(line, rule).alias("line_rule"),
        *[v.alias(k) for k, v in preview_indents(F.try_element_at(ppr, F.lit("ind"))).items()],
        F.col("outline").alias("outline_level"),
        (r.isNotNull() | has_prop(ppr, "numPr")).alias("numbered"),
        r["level"].alias("numbering_level"),
        r["number_format"].alias("numbering_format"),
        r["level_text"].alias("numbering_pattern"),
        shown.alias("numbering_example"),
        r["start"].alias("numbering_start"),
        F.col("restart").alias("numbering_restart"),
    )


def refresh(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Previews after an edit: looks are new, counts and marks stay.

    ``previous`` has ``pack_id, style_id, usage_count, inferred, configured``;
    ``fresh`` the newly computed looks. Styles that vanished drop out.
    """
    label = (
        F.when(F.col("configured"), F.lit("自定义表格方案"))
        .when(F.col("inferred"), F.lit("智能补全"))
    )
    carried = previous.select(
        "pack_id",
        "style_id",
        F.greatest(F.lit(0), F.coalesce("usage_count", F.lit(0))).alias("usage_count"),
        F.coalesce("inferred", F.lit(False)).alias("inferred"),
        F.coalesce("configured", F.lit(False)).alias("configured"),
    ).withColumn("inference_label", label)
    return carried.join(fresh, ["pack_id", "style_id"])


def backfill(packs: DataFrame, aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Older packs as readers see them: alias lists and a table candidate added.

    ``packs`` has ``pack_id, font, font_aliases, table_candidate``; the stored
    rows are not rewritten.
    """
    return (
        packs.join(aliases.withColumnRenamed("aliases", "found"), ["pack_id", "font"], "left")
        .join(candidates.withColumnRenamed("style_id", "offered"), "pack_id", "left")
        .withColumn("font_aliases", F.coalesce("font_aliases", "found"))
        .withColumn("table_candidate", F.coalesce("table_candidate", "offered"))
        .drop("found", "offered")
    )
