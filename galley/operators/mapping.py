"""Target styles onto a format source, and what follows for content.

All lookups of one source travel in one row of maps (see ``catalog.index``), so
mapping is a single equi-join on the pack, whatever the number of tiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.props import (
    BAG,
    bag_attr,
    changed_props,
    clear_cell_indent,
    dropped,
    keep_only,
    plain_table_cell,
)
from galley.functions.text import style_key
from galley.registries import (
    CELL_KEEP,
    PARAGRAPH_KEEP,
    ROW_KEEP,
    RUN_KEEP,
    SETTINGS_TAGS,
    TABLE_KEEP,
)


def _lookup(map_: str, key: Column) -> Column:
    return F.try_element_at(map_, key)


def _of_type(style_type: str, key: Column) -> Column:
    return F.concat(F.lit(style_type + ":"), key)


def desired_level(outline: Column, shift: int | Column) -> Column:
    return F.least(F.lit(8), outline + shift)


def _mapped(style_type: str, shift: int) -> Column:
    """Source style for a target style, first tier that answers.

    Expects ``style_id``, the target's ``t_name, t_aliases, t_outline, t_known``
    and the maps of the source index.
    """
    level = desired_level(F.col("t_outline"), shift).cast("int")
    authority = _lookup("authority", level)
    same = _lookup("ids", F.col("style_id"))
    spellings = F.concat(
        F.array("t_name"), F.coalesce("t_aliases", F.array().cast("array<string>")), F.array("style_id")
    )
    named = F.filter(
        F.transform(spellings, lambda s: _lookup("names", _of_type(style_type, style_key(s)))),
        lambda s: s.isNotNull(),
    )
    usual = _lookup("defaults", F.lit(style_type))
    heading = style_type == "paragraph"
    tiers = [
        F.when(F.col("t_known"), authority) if heading else None,
        F.when(same["style_type"] == style_type, F.col("style_id")),
        F.when(F.col("t_known"), F.try_element_at(named, F.lit(1))),
        F.when(F.col("t_known"), _lookup("headings", level)) if heading else None,
        _lookup("names", _of_type(style_type, style_key(F.col("style_id")))),
        usual,
    ]
    picked = F.coalesce(*[t for t in tiers if t is not None])
    return F.when(F.coalesce("style_id", F.lit("")) == "", usual).otherwise(picked)


def _with_lookups(refs: DataFrame, resolved: DataFrame, index: DataFrame) -> DataFrame:
    target = resolved.select(
        "pkg_id",
        "style_id",
        F.col("name").alias("t_name"),
        F.col("aliases").alias("t_aliases"),
        F.col("outline").alias("t_outline"),
        F.lit(True).alias("t_known"),
    )
    known = refs.join(target, ["pkg_id", "style_id"], "left").fillna(False, ["t_known"])
    return known.join(index, "pack_id")


def _blocked(shift: int) -> Column:
    """A demoted level without an authority: rejected rather than guessed."""
    level = desired_level(F.col("t_outline"), shift).cast("int")
    gone = (level != F.col("t_outline")) & _lookup("authority", level).isNull()
    return F.coalesce(F.col("t_known") & gone, F.lit(False))


def map_styles(refs: DataFrame, resolved: DataFrame, index: DataFrame, style_type: str, shift: int = 0) -> DataFrame:
    """Map distinct ``(pkg_id, pack_id, style_id)`` references to source styles."""
    blocked = _blocked(shift) if style_type == "paragraph" else F.lit(False)
    return _with_lookups(refs, resolved, index).select(
        *refs.columns, _mapped(style_type, shift).alias("mapped"), blocked.alias("blocked")
    )


def heading_for_level(level: Column) -> Column:
    """Source heading of a level: the authority, else any heading style."""
    return F.coalesce(_lookup("authority", level), _lookup("headings", level))


def numbered_peers(rules: DataFrame, resolved: DataFrame) -> DataFrame:
    """First numbered style of every level, by id, as a map per source."""
    peers = (
        rules.join(resolved.select("pkg_id", "style_id", "outline"), ["pkg_id", "style_id"])
        .filter("outline IS NOT NULL")
        .groupBy("pkg_id", "outline")
        .agg(F.min("style_id").alias("peer"))
    )
    return peers.groupBy(F.col("pkg_id").alias("pack_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("outline", "peer"))).alias("peers")
    )


def map_paragraphs(
    paragraphs: DataFrame,
    resolved: DataFrame,
    defaults: DataFrame,
    index: DataFrame,
    shift: int | Column = 0,
) -> DataFrame:
    """Mapped style and level of every paragraph under every requested pack.

    ``paragraphs`` carries ``pack_id``. A direct heading level asks for that
    heading; direct body text maps without a shift and never ends in a heading;
    the rest map by style. Lookups run once per distinct reference and are
    joined back. The shift applies to the body part only; it may be a column
    with one value per package and pack.
    """
    keyed = paragraphs.withColumns({"_k": F.coalesce("style_id", F.lit("")), "_shift": F.lit(shift)})
    refs = keyed.select("pkg_id", "pack_id", F.col("_k").alias("style_id"), "_shift").distinct()
    shift = F.col("_shift")
    usual = defaults.filter(F.col("style_type") == "paragraph").join(
        resolved.select("pkg_id", "style_id", "outline"), ["pkg_id", "style_id"]
    ).select("pkg_id", F.col("outline").alias("usual_outline"))
    level_of = lambda s: _lookup("ids", s)["outline"]
    source_usual = _lookup("defaults", F.lit("paragraph"))
    plain, moved = _mapped("paragraph", 0), _mapped("paragraph", shift)
    by_level = [heading_for_level(F.lit(k)) for k in range(9)]
    answers = (
        _with_lookups(refs, resolved, index)
        .join(usual, "pkg_id", "left")
        .select(
            "pkg_id",
            "pack_id",
            F.col("style_id").alias("_k"),
            F.when(F.col("style_id") == "", F.col("usual_outline")).otherwise(F.col("t_outline")).alias("_outline"),
            plain.alias("_plain"),
            moved.alias("_moved"),
            F.when(level_of(plain).isNotNull(), source_usual).otherwise(plain).alias("_body"),
            _blocked(shift).alias("_blocked"),
            level_of(plain).alias("_plain_level"),
            level_of(moved).alias("_moved_level"),
            F.array(*by_level).alias("_headings"),
            F.array(*[level_of(h) for h in by_level]).alias("_heading_levels"),
        )
    )
    joined = keyed.join(answers, ["pkg_id", "pack_id", "_k"])
    direct = F.col("direct_outline")
    body_part = F.col("part") == "word/document.xml"
    step = F.when(body_part, shift).otherwise(F.lit(0))
    outline = F.when(direct.isNotNull(), F.when(direct <= 8, direct)).otherwise(F.col("_outline"))
    target = F.when(F.col("has_ppr"), outline)
    desired = F.least(F.lit(8), target + step).cast("int")
    acts = F.col("has_ppr") & (F.col("style_id").isNotNull() | target.isNotNull())
    shifted = body_part & (shift > 0)

    def choose(asked: Column, body: Column, far: Column, near: Column) -> Column:
        styled = F.when(shifted, far).otherwise(near)
        return F.when(acts, F.when(direct <= 8, asked).when(direct == 9, body).otherwise(styled))

    asked = F.get("_headings", F.col("desired"))
    asked_level = F.get("_heading_levels", F.col("desired"))
    body_level = F.when(F.col("_plain_level").isNull(), F.lit(None).cast("int"))
    no_heading = (direct <= 8) & asked.isNull()
    no_demotion = direct.isNull() & shifted & F.col("_blocked")
    return (
        joined.withColumn("target_outline", target)
        .withColumn("desired", desired)
        .withColumn("mapped", choose(asked, F.col("_body"), F.col("_moved"), F.col("_plain")))
        .withColumn(
            "mapped_outline",
            choose(asked_level, body_level, F.col("_moved_level"), F.col("_plain_level")),
        )
        .withColumn(
            "fault",
            F.when(acts & no_heading, F.lit("no_heading_for_level")).when(
                acts & no_demotion, F.lit("no_demoted_heading")
            ),
        )
        .select(*paragraphs.columns, "target_outline", "desired", "mapped", "mapped_outline", "fault")
    )


def prefer_numbered(mapped: DataFrame, rules: DataFrame, used: DataFrame, peers: DataFrame) -> DataFrame:
    """Move headings off an unused, unnumbered style when a numbered style of
    the same level exists.

    ``rules`` and ``used`` have ``pack_id, style_id``; both are bounded by the
    style sheets of the packs.
    """
    skip = (
        rules.select("pack_id", "style_id")
        .unionByName(used.select("pack_id", "style_id"))
        .distinct()
        .select("pack_id", F.col("style_id").alias("mapped"), F.lit(True).alias("stays"))
    )
    peer = _lookup("peers", F.col("desired"))
    moved = F.col("stays").isNull() & F.col("desired").isNotNull() & F.col("mapped").isNotNull()
    return (
        mapped.join(skip, ["pack_id", "mapped"], "left")
        .join(peers, "pack_id", "left")
        .withColumn("mapped", F.when(moved, F.coalesce(peer, "mapped")).otherwise(F.col("mapped")))
        .withColumn("mapped_outline", F.when(moved & peer.isNotNull(), F.col("desired")).otherwise(F.col("mapped_outline")))
        .drop("stays", "peers")
    )


def map_run_styles(refs: DataFrame, resolved: DataFrame, index: DataFrame) -> DataFrame:
    """Character styles: a default result keeps a style only if the source has
    the same id, else the style is dropped (NULL)."""
    found = map_styles(refs, resolved, index, "character").drop("blocked")
    maps = index.select("pack_id", "defaults", F.map_keys("ids").alias("known"))
    usual = _lookup("defaults", F.lit("character"))
    kept = F.when(F.array_contains("known", F.col("style_id")), F.col("style_id"))
    return (
        found.join(maps, "pack_id")
        .withColumn(
            "mapped",
            F.when(F.col("mapped").isNotNull() & ~F.col("mapped").eqNullSafe(usual), F.col("mapped")).otherwise(
                F.when(F.col("mapped").isNotNull(), kept)
            ),
        )
        .drop("defaults", "known")
    )


def map_table_styles(refs: DataFrame, resolved: DataFrame, index: DataFrame, used: DataFrame) -> DataFrame:
    """Table styles: only styles the source really uses are taken over.

    ``used`` has ``pack_id, used_styles, preferred``. A source without any
    table keeps the target's style (``preserved``).
    """
    found = map_styles(refs, resolved, index, "table").drop("blocked")
    defaults = index.select("pack_id", _lookup("defaults", F.lit("table")).alias("usual"))
    none = F.coalesce(F.size("used_styles"), F.lit(0)) == 0
    taken = F.array_contains("used_styles", F.col("mapped"))
    fallback = F.coalesce("preferred", "usual", "mapped")
    return (
        found.join(used, "pack_id", "left")
        .join(defaults, "pack_id")
        .withColumn("preserved", none)
        .withColumn(
            "mapped",
            F.when(none, F.col("style_id")).when(taken, F.col("mapped")).otherwise(fallback),
        )
        .drop("used_styles", "preferred", "usual")
    )


def section_layouts(targets: DataFrame, layouts: DataFrame) -> DataFrame:
    """Source layout for every target section: same position, the last one
    repeated.

    ``targets`` has ``pkg_id, pack_id, idx``; ``layouts`` has ``pack_id, idx``
    and layout columns.
    """
    counts = layouts.groupBy("pack_id").agg((F.max("idx") + 1).alias("n"))
    chosen = layouts.withColumnRenamed("idx", "source_idx")
    return (
        targets.join(counts, "pack_id")
        .withColumn("source_idx", F.least(F.col("idx"), F.col("n") - 1))
        .drop("n")
        .join(chosen, ["pack_id", "source_idx"])
    )


def merge_settings(target: DataFrame, source: DataFrame, keep_table_default: bool | Column = False) -> DataFrame:
    """Settings after a transfer: format tags from the source, the rest kept.

    ``target`` has ``pkg_id, pack_id, tag, value``; ``source`` ``pack_id, tag,
    value``. ``origin`` tells where a row comes from. ``keep_table_default`` may
    be a column of both tables.
    """
    copied = F.col("tag").isin(*SETTINGS_TAGS) & ~(F.lit(keep_table_default) & (F.col("tag") == "defaultTableStyle"))
    kept = target.filter(~copied).withColumn("origin", F.lit("target"))
    pairs = target.select("pkg_id", "pack_id").distinct()
    taken = pairs.join(source.filter(copied), "pack_id").select(
        "pkg_id", "pack_id", "tag", "value", F.lit("source").alias("origin")
    )
    return kept.select(*taken.columns).unionByName(taken)


def strip_properties(nodes: DataFrame) -> DataFrame:
    """Allow-list projection of every property container, with a removal count."""
    keep = {
        "paragraph": PARAGRAPH_KEEP, "run": RUN_KEEP, "table": TABLE_KEEP, "row": ROW_KEEP,
        "cell": CELL_KEEP,
    }
    kept, gone = F.col("bag"), F.lit(0)
    for kind, allowed in keep.items():
        mine = F.col("kind") == kind
        kept = F.when(mine, keep_only(F.col("bag"), allowed)).otherwise(kept)
        gone = F.when(mine, dropped(F.col("bag"), allowed)).otherwise(gone)
    return nodes.withColumn("kept", kept).withColumn("removed", gone)


def heading_overrides(mapped: DataFrame, profiles: DataFrame) -> DataFrame:
    """Give headings the saved indent, spacing and alignment of their style.

    ``mapped`` has ``pack_id, mapped, mapped_outline, ppr``; ``profiles`` has
    ``pack_id, style_id, ind, spacing, jc``. A component replaces the whole
    property.
    """
    profile = profiles.select("pack_id", F.col("style_id").alias("mapped"), "ind", "spacing", "jc")
    joined = mapped.join(profile, ["pack_id", "mapped"], "left")
    heading = F.col("mapped_outline").isNotNull()
    some = lambda c: heading & F.col(c).isNotNull() & (F.size(c) > 0)
    jc = F.create_map(F.lit("val"), F.col("jc"))
    new = changed_props(
        F.coalesce("ppr", F.create_map().cast(BAG)),
        {
            "ind": (some("ind"), F.col("ind")),
            "spacing": (some("spacing"), F.col("spacing")),
            "jc": (heading & F.col("jc").isNotNull(), jc),
        },
    )
    return (
        joined.withColumn("ppr", new)
        .withColumn("indent_applied", some("ind"))
        .drop("ind", "spacing", "jc")
    )


def cell_indents(cells: DataFrame, two_char: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Table cell paragraphs without a two-character first line.

    ``cells`` has ``pack_id, effective, ppr, in_table``; ``two_char`` and
    ``wrappers`` hold pack styles (``pack_id, style_id`` and ``pack_id,
    base_id, style_id``).
    """
    two = two_char.select(
        "pack_id", F.col("style_id").alias("effective"), F.lit(True).alias("two")
    )
    wrap = wrappers.select(
        "pack_id", F.col("base_id").alias("effective"), F.col("style_id").alias("wrapper")
    )
    joined = cells.join(two, ["pack_id", "effective"], "left").join(
        wrap, ["pack_id", "effective"], "left"
    )
    cleared = clear_cell_indent(F.col("ppr"), F.col("two"))
    step = joined.withColumn("_c", F.when(F.col("in_table"), cleared)).withColumn(
        "ppr", F.coalesce("_c.ppr", "ppr")
    )
    hardened = (
        F.col("in_table")
        & F.col("wrapper").isNotNull()
        & F.col("ppr").isNotNull()
        & plain_table_cell(F.col("ppr"))
        & ~bag_attr(F.col("ppr"), "pStyle", "val").eqNullSafe(F.col("wrapper"))
    )
    return (
        step.withColumn("indent_cleared", F.coalesce("_c.changed", F.lit(False)))
        .withColumn("hardened", F.coalesce(hardened, F.lit(False)))
        .drop("_c", "two")
    )
