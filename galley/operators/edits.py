"""Style edits: overlay, replay and what they do to property bags.

Edits arrive in long form ``(pack_id, style_id, field, value, seq)``. One style
has at most as many live fields as the protocol knows, so after the latest
value per field is taken, a style's edit is one small map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.props import (
    ATTRS,
    BAG,
    alignment_profile,
    attr,
    changed_attrs,
    changed_props,
    indent_profile,
    spacing_profile,
)
from galley.functions.units import (
    chars_to_hundredths,
    lenient_int,
    line_to_raw,
    on_off,
    pt_to_eighths,
    pt_to_half_points,
    pt_to_twips,
)
from galley.registries import (
    ALIGNMENTS,
    INDENT_ATTRS,
    LINE_RULES,
    NUMBERING_FIELDS,
    PARAGRAPH_FIELDS,
    RUN_FIELDS,
    SPACING_FLAG_ATTRS,
    SPACING_INT_ATTRS,
    TABLE_FIELDS,
)



def latest(edits: DataFrame) -> DataFrame:
    """Latest value per style and field."""
    return edits.groupBy("pack_id", "style_id", "field").agg(F.max_by("value", "seq").alias("value"))


def patches(edits: DataFrame) -> DataFrame:
    """One map of fields per edited style."""
    return (
        latest(edits)
        .groupBy("pack_id", "style_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("patch"))
    )


def accumulate(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Saved edits overridden by later ones, per style and field."""
    old = saved.withColumn("wave", F.lit(0))
    new = incoming.withColumn("wave", F.lit(1))
    return (
        old.unionByName(new)
        .groupBy("pack_id", "style_id", "field")
        .agg(F.max_by("value", F.struct("wave", "seq")).alias("value"))
    )


def _field(patch: Column, name: str) -> Column:
    return F.try_element_at(patch, F.lit(name))


def _prop(bag: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(bag, F.lit(name)), F.create_map().cast(ATTRS))


def run_bag(rpr: Column, patch: Column) -> Column:
    """Run bag after an edit; an explicit font or colour drops its theme one."""
    bag = F.coalesce(rpr, F.create_map().cast(BAG))
    latin, east = _field(patch, "font_latin"), _field(patch, "font_east_asia")
    bold, color = _field(patch, "bold"), _field(patch, "color_hex")
    flag = F.when(bold == "true", F.lit("1")).when(bold.isNotNull(), F.lit("0"))
    half = pt_to_half_points(_field(patch, "size_pt"))
    fonts = changed_attrs(
        _prop(bag, "rFonts"),
        {"ascii": latin, "hAnsi": latin, "eastAsia": east},
        {
            "asciiTheme": latin.isNotNull(), "hAnsiTheme": latin.isNotNull(),
            "eastAsiaTheme": east.isNotNull(),
        },
    )
    painted = changed_attrs(
        _prop(bag, "color"),
        {"val": color},
        {n: F.lit(True) for n in ("themeColor", "themeTint", "themeShade")},
    )
    new = {
        "rFonts": (latin.isNotNull() | east.isNotNull(), fonts),
        "color": (color.isNotNull(), painted),
    }
    for names, value in ((("b", "bCs"), flag), (("sz", "szCs"), half)):
        for name in names:
            new[name] = (value.isNotNull(), changed_attrs(_prop(bag, name), {"val": value}))
    return changed_props(bag, new)


def _indent(ind: Column, patch: Column) -> Column:
    """Indent after an edit: the other unit becomes zero, and of first line and
    hanging only the chosen one stays."""
    zero = F.lit("0")
    sets: dict = {}
    for side, names, chars in (
        ("left", ("left", "start"), ("leftChars", "startChars")),
        ("right", ("right", "end"), ("rightChars", "endChars")),
    ):
        twips = pt_to_twips(_field(patch, f"{side}_indent_pt")).cast("string")
        units = chars_to_hundredths(_field(patch, f"{side}_indent_chars")).cast("string")
        points = F.coalesce(twips, F.when(units.isNotNull(), zero))
        letters = F.when(twips.isNotNull(), zero).otherwise(units)
        sets |= {n: points for n in names} | {n: letters for n in chars}
    given = {
        (kind, unit): _field(patch, f"{kind}_indent_{unit}")
        for kind in ("first_line", "hanging")
        for unit in ("pt", "chars")
    }
    amount = lambda kind: F.coalesce(given[kind, "pt"], given[kind, "chars"]).cast("double")
    live = lambda kind: F.coalesce(F.abs(amount(kind)) > 1e-9, F.lit(False))
    hanging_first = live("hanging") & ~live("first_line")
    choice = F.when(hanging_first & given["hanging", "pt"].isNotNull(), F.lit("hanging pt")).when(
        hanging_first, F.lit("hanging chars")
    )
    for kind, unit in given:
        choice = choice.when(given[kind, unit].isNotNull(), F.lit(f"{kind} {unit}"))
    gone: dict = {}
    for kind, (in_pt, in_chars), other in (
        ("first_line", ("firstLine", "firstLineChars"), "hanging"),
        ("hanging", ("hanging", "hangingChars"), "first_line"),
    ):
        by_pt, by_chars = choice == f"{kind} pt", choice == f"{kind} chars"
        sets[in_pt] = F.when(by_pt, pt_to_twips(given[kind, "pt"]).cast("string")).when(by_chars, zero)
        sets[in_chars] = F.when(by_chars, chars_to_hundredths(given[kind, "chars"]).cast("string")).when(by_pt, zero)
        dropped = F.coalesce(choice.startswith(other), F.lit(False))
        gone |= {in_pt: dropped, in_chars: dropped}
    return changed_attrs(ind, sets, gone)


def paragraph_bag(ppr: Column, patch: Column) -> Column:
    """Paragraph bag after an edit."""
    bag = F.coalesce(ppr, F.create_map().cast(BAG))
    jc, zero = _field(patch, "alignment"), F.lit("0")
    line, rule = _field(patch, "line_spacing"), _field(patch, "line_rule")
    both = line.isNotNull() & rule.isNotNull()
    sets = {"line": F.when(both, line_to_raw(line, rule).cast("string")), "lineRule": F.when(both, rule)}
    touched = both
    for side in ("before", "after"):
        pt = _field(patch, f"space_{side}_pt")
        touched = touched | pt.isNotNull()
        sets[side] = pt_to_twips(pt).cast("string")
        for other in (f"{side}Lines", f"{side}Autospacing"):
            sets[other] = F.when(pt.isNotNull(), zero)
    indents = [_field(patch, f) for f in PARAGRAPH_FIELDS if "_indent_" in f]
    return changed_props(
        bag,
        {
            "jc": (jc.isNotNull(), changed_attrs(_prop(bag, "jc"), {"val": jc})),
            "spacing": (touched, changed_attrs(_prop(bag, "spacing"), sets)),
            "ind": (F.coalesce(*indents).isNotNull(), _indent(_prop(bag, "ind"), patch)),
        },
    )


def table_bag(tpr: Column, patch: Column) -> Column:
    """Table bag after an edit. Borders and margins are dotted attributes, such
    as ``top.color``; a border edit touches every border, a margin edit only
    the given side."""
    bag = F.coalesce(tpr, F.create_map().cast(BAG))
    fill, style = _field(patch, "table_fill_hex"), _field(patch, "table_border_style")
    color = _field(patch, "table_border_color_hex")
    width = pt_to_eighths(_field(patch, "table_border_width_pt")).cast("string")
    theme = ("themeColor", "themeTint", "themeShade", "themeFill", "themeFillTint", "themeFillShade")
    shade = changed_attrs(
        _prop(bag, "shd"),
        {"val": F.lit("clear"), "color": F.lit("auto"), "fill": fill},
        {t: F.lit(True) for t in theme},
    )
    borders, sets, gone = _prop(bag, "tblBorders"), {}, {}
    for side in ("top", "left", "bottom", "right", "insideH", "insideV"):
        sets[f"{side}.val"] = F.coalesce(style, attr(borders, f"{side}.val"), F.lit("single"))
        sets |= {f"{side}.color": color, f"{side}.sz": width}
        gone |= {f"{side}.{t}": color.isNotNull() for t in theme[:3]}
    margins, any_margin = {}, []
    for side in ("top", "left", "bottom", "right"):
        pt = _field(patch, f"table_cell_margin_{side}_pt")
        any_margin.append(pt)
        margins[f"{side}.w"] = pt_to_twips(pt).cast("string")
        margins[f"{side}.type"] = F.when(pt.isNotNull(), F.lit("dxa"))
    return changed_props(
        bag,
        {
            "shd": (fill.isNotNull(), shade),
            "tblBorders": (F.coalesce(style, color, width).isNotNull(), changed_attrs(borders, sets, gone)),
            "tblCellMar": (F.coalesce(*any_margin).isNotNull(), changed_attrs(_prop(bag, "tblCellMar"), margins)),
        },
    )


def history(edits: DataFrame) -> DataFrame:
    """``pack_id, style_id, waves``: the fields of every revision of a style as one map each, in order of ``revision``.

    A style has as many live fields as the protocol knows, so this list stays short.
    """
    each = edits.groupBy("pack_id", "style_id", "revision", "field").agg(F.max_by("value", "seq").alias("value"))
    maps = each.groupBy("pack_id", "style_id", "revision").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("patch"))
    # Maps cannot be sorted, so the list is ordered by revision alone.
    by_revision = lambda a, b: F.when(a["revision"] < b["revision"], -1).when(a["revision"] > b["revision"], 1).otherwise(0)
    ordered = F.array_sort(F.collect_list(F.struct("revision", "patch")), by_revision)
    return maps.groupBy("pack_id", "style_id").agg(F.transform(ordered, lambda x: x["patch"]).alias("waves"))


def replay(styles: DataFrame, waves: DataFrame) -> DataFrame:
    """Style sheet of a pack after all revisions of :func:`history`, one after the other."""
    joined = styles.join(waves, ["pack_id", "style_id"], "left")
    turns = F.coalesce("waves", F.array().cast("array<map<string,string>>"))

    def folded(bag: str, fields, change) -> Column:
        edited = F.exists(turns, lambda p: touches(p, fields))
        start = F.coalesce(F.col(bag), F.create_map().cast(BAG))
        after = F.aggregate(turns, start, lambda acc, p: F.when(touches(p, fields), change(acc, p)).otherwise(acc))
        return F.when(edited, after).otherwise(F.col(bag))

    return joined.withColumns(
        {
            "rpr": folded("rpr", RUN_FIELDS, run_bag),
            "ppr": folded("ppr", PARAGRAPH_FIELDS, paragraph_bag),
            "tpr": folded("tpr", TABLE_FIELDS, table_bag),
            "edited": F.col("waves").isNotNull(),
        }
    ).drop("waves")


def touches(patch: Column, fields) -> Column:
    return F.exists(F.map_keys(patch), lambda k: k.isin(*fields))


def overlay(styles: DataFrame, edits: DataFrame) -> DataFrame:
    """Style sheet of a pack with its edits applied."""
    joined = styles.join(patches(edits), ["pack_id", "style_id"], "left")
    patch = F.col("patch")
    on = lambda fields: F.coalesce(touches(patch, fields), F.lit(False))
    return joined.withColumns(
        {
            "rpr": F.when(on(RUN_FIELDS), run_bag(F.col("rpr"), patch)).otherwise(F.col("rpr")),
            "ppr": F.when(on(PARAGRAPH_FIELDS), paragraph_bag(F.col("ppr"), patch)).otherwise(F.col("ppr")),
            "tpr": F.when(on(TABLE_FIELDS), table_bag(F.col("tpr"), patch)).otherwise(F.col("tpr")),
            "edited": patch.isNotNull(),
        }
    ).drop("patch")


def edit_levels(levels: DataFrame, rules: DataFrame, edits: DataFrame) -> DataFrame:
    """List levels with numbering edits of the headings that use them.

    ``rules`` has ``pack_id, style_id, rule``; ``levels`` ``pack_id, num_id,
    ilvl, num_fmt, lvl_text, start, lvl_restart, start_override``.
    """
    mine = (
        patches(edits)
        .join(rules, ["pack_id", "style_id"])
        .select(
            "pack_id",
            F.col("rule.num_id").alias("num_id"),
            F.col("rule.level").alias("ilvl"),
            "patch",
            "style_id",
        )
        .groupBy("pack_id", "num_id", "ilvl")
        .agg(F.max_by("patch", "style_id").alias("patch"))
    )
    patch = F.col("patch")
    start = _field(patch, "numbering_start").cast("int")
    restart = _field(patch, "numbering_restart")
    return (
        levels.join(mine, ["pack_id", "num_id", "ilvl"], "left")
        .withColumns(
            {
                "num_fmt": F.coalesce(_field(patch, "numbering_format"), "num_fmt"),
                "lvl_text": F.coalesce(_field(patch, "numbering_pattern"), "lvl_text"),
                "start": F.coalesce(start, "start"),
                "start_override": F.when(
                    F.col("start_override").isNotNull(), F.coalesce(start, "start_override")
                ),
                "lvl_restart": F.when(
                    restart.isNotNull(), F.when(restart == "true", F.col("ilvl")).otherwise(F.lit(0))
                ).otherwise(F.col("lvl_restart")),
            }
        )
        .drop("patch")
    )


def check_targets(edits: DataFrame, exposed: DataFrame) -> DataFrame:
    """Edits whose style is unknown, hidden or of the wrong type.

    ``exposed`` has ``pack_id, style_id, style_type, outline``.
    """
    kind = (
        F.when(F.col("field").isin(*RUN_FIELDS), F.lit("run"))
        .when(F.col("field").isin(*PARAGRAPH_FIELDS), F.lit("paragraph"))
        .when(F.col("field").isin(*TABLE_FIELDS), F.lit("table"))
        .when(F.col("field").isin(*NUMBERING_FIELDS), F.lit("numbering"))
    )
    joined = edits.withColumn("kind", kind).join(exposed, ["pack_id", "style_id"], "left")
    style = F.col("style_type")
    fits = (
        F.when(F.col("kind") == "run", style.isin("paragraph", "character"))
        .when(F.col("kind") == "paragraph", style == "paragraph")
        .when(F.col("kind") == "table", style == "table")
        .when(F.col("kind") == "numbering", (style == "paragraph") & F.col("outline").isNotNull())
    )
    rule = F.when(style.isNull(), F.lit("unknown_style")).when(~fits, F.lit("wrong_type"))
    return (
        joined.withColumn("rule", rule)
        .filter("rule IS NOT NULL")
        .select("pack_id", "style_id", "field", "rule")
    )


def sync_overrides(profiles: DataFrame, edits: DataFrame, headings: DataFrame) -> DataFrame:
    """Merge paragraph edits of headings into their saved overrides.

    ``profiles`` has ``pack_id, style_id, ind, spacing, jc``; ``headings``
    ``pack_id, style_id`` of heading styles.
    """
    return sync_history(profiles, patches(edits).select("pack_id", "style_id", F.array("patch").alias("waves")), headings)


def sync_history(profiles: DataFrame, waves: DataFrame, headings: DataFrame) -> DataFrame:
    """The same for all revisions of :func:`history`, one after the other."""
    mine = (
        waves.withColumn("waves", F.filter("waves", lambda p: touches(p, PARAGRAPH_FIELDS)))
        .filter(F.size("waves") > 0)
        .join(headings.select("pack_id", "style_id").distinct(), ["pack_id", "style_id"], "left_semi")
    )
    entry = lambda name, value: F.when(
        value.isNotNull(), F.create_map(F.lit(name), value)
    ).otherwise(F.create_map().cast(BAG))
    joined = profiles.join(mine, ["pack_id", "style_id"], "full")
    jc = F.when(F.col("jc").isNotNull(), F.create_map(F.lit("val"), F.col("jc")))
    bag = F.map_concat(entry("ind", F.col("ind")), entry("spacing", F.col("spacing")), entry("jc", jc))
    new = joined.withColumn("bag", F.aggregate("waves", bag, paragraph_bag))
    pick = lambda fresh, old: F.when(F.col("waves").isNotNull(), fresh).otherwise(F.col(old)).alias(old)
    at = lambda p: F.try_element_at("bag", F.lit(p))
    return new.select(
        "pack_id",
        "style_id",
        pick(indent_profile(at("ind")), "ind"),
        pick(spacing_profile(at("spacing")), "spacing"),
        pick(alignment_profile(F.col("bag")), "jc"),
    )


def saved_profiles(saved: DataFrame, styles: DataFrame) -> DataFrame:
    """Saved heading overrides that are still valid.

    ``saved`` has ``pack_id, style_id, ind, spacing, jc, legacy_ind``. Only
    profiles of existing paragraph styles count. A bad attribute or value drops
    its property only; the older indent-only field fills in where there is no
    indent, and there unknown attributes are skipped.
    """
    integer = lambda v: lenient_int(v).isNotNull()
    ind, spacing, legacy = F.col("ind"), F.col("spacing"), F.col("legacy_ind")
    ind_ok = (F.size(ind) > 0) & F.forall(
        F.map_entries(ind), lambda e: e["key"].isin(*INDENT_ATTRS) & integer(e["value"])
    )
    spacing_ok = (F.size(spacing) > 0) & F.forall(
        F.map_entries(spacing),
        lambda e: (e["key"].isin(*SPACING_INT_ATTRS) & integer(e["value"]))
        | (e["key"].isin(*SPACING_FLAG_ATTRS) & on_off(e["value"]).isNotNull())
        | ((e["key"] == "lineRule") & e["value"].isin(*LINE_RULES)),
    )
    legacy_known = F.map_filter(legacy, lambda k, _: k.isin(*INDENT_ATTRS))
    legacy_ok = (F.size(legacy_known) > 0) & F.forall(F.map_values(legacy_known), integer)
    known = styles.select("pack_id", "style_id", "style_type").distinct()
    paragraph = F.col("style_type") == "paragraph"
    return (
        saved.join(known, ["pack_id", "style_id"])
        .select(
            "pack_id",
            "style_id",
            F.coalesce(
                F.when(paragraph & ind_ok, indent_profile(ind)),
                F.when(legacy_ok, indent_profile(legacy_known)),
            ).alias("ind"),
            F.when(paragraph & spacing_ok, spacing_profile(spacing)).alias("spacing"),
            F.when(paragraph & F.col("jc").isin(*ALIGNMENTS), F.col("jc")).alias("jc"),
        )
        .filter("ind IS NOT NULL OR spacing IS NOT NULL OR jc IS NOT NULL")
    )
