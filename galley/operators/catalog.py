"""Style sheets: inheritance, defaults, name index and heading styles.

A style sheet is one XML part of at most 64 MiB, so one package's sheet is a
bounded map. Inheritance is walked inside that map: a single shuffle by package
resolves chains of any length, without one join per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.props import (
    BAG,
    attr,
    bag_attr,
    has_prop,
    merge_bag,
    nonzero,
)
from galley.functions.text import heading_key, style_key
from galley.functions.units import lenient_int
from galley.registries import DEFAULT_STYLE_NAMES, WRAPPER_NAME, WRAPPER_PREFIX

_FIELDS = (
    "style_type", "name", "aliases", "based_on", "own_outline", "is_default", "ppr", "rpr",
)


def sheets(styles: DataFrame) -> DataFrame:
    """One row per package: ``sheet`` maps a style id to its definition.

    A repeated id keeps its first place and its last definition. The document
    defaults (``ord`` -1) sit under the empty id.
    """
    # Definitions are moved once: by package, which groups their ids as well.
    last = styles.repartition("pkg_id").groupBy("pkg_id", F.coalesce("style_id", F.lit("")).alias("style_id")).agg(
        F.min("ord").alias("ord"), F.max_by(F.struct(*_FIELDS), "ord").alias("def")
    )
    entry = F.struct("style_id", F.struct("ord", "def.*").alias("value"))
    return last.groupBy("pkg_id").agg(F.map_from_entries(F.collect_list(entry)).alias("sheet"))


def _chain(parents: Column, style_id: Column, known: Column) -> Column:
    """Style ids from a style to its root; stops at a gap or a cycle.

    ``parents`` maps styles to the style they are based on, ``known`` lists all
    ids. No chain has more steps than there are parents.
    """
    state = lambda path, ahead: F.struct(path.alias("path"), ahead.alias("ahead"))

    def walk(acc: Column, _: Column) -> Column:
        ahead, path = acc["ahead"], acc["path"]
        goes_on = F.array_contains(known, ahead) & ~F.array_contains(path, ahead)
        step = F.when(
            goes_on, state(F.array_append(path, ahead), F.try_element_at(parents, ahead))
        ).otherwise(state(path, F.lit(None).cast("string")))
        return F.when(ahead.isNull(), acc).otherwise(step)

    start = state(F.array(style_id), F.try_element_at(parents, style_id))
    return F.aggregate(F.map_keys(parents), start, walk, lambda acc: acc["path"])


def _nearest(levels: Column, value) -> Column:
    """First non-NULL value from the leaf to the root."""
    found = F.transform(levels, value)
    return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(1))


def resolve(styles: DataFrame, bags: bool = True) -> DataFrame:
    """Every style with its chain, outline, list reference and effective bags.

    Without ``bags`` the effective bags are left out, which most callers do not
    need and which cost the most.
    """
    empty = F.create_map().cast(BAG)
    own_styles = F.map_filter("sheet", lambda k, _: k != "")
    linked = F.map_filter("sheet", lambda k, v: (k != "") & (F.coalesce(v["based_on"], F.lit("")) != ""))
    base = sheets(styles).select(
        "pkg_id",
        F.try_element_at("sheet", F.lit("")).alias("defaults"),
        own_styles.alias("sheet"),
        F.transform_values(linked, lambda _, v: v["based_on"]).alias("parents"),
        F.map_keys(own_styles).alias("known"),
    )
    sheet, defaults = F.col("sheet"), F.col("defaults")
    default_bags = {b: F.coalesce(defaults[b], empty) for b in ("ppr", "rpr")}
    fields = ("ord", *_FIELDS)

    def with_chain(entry: Column) -> Column:
        return F.struct(
            entry["key"].alias("style_id"),
            entry["value"].alias("own"),
            _chain(F.col("parents"), entry["key"], F.col("known")).alias("chain"),
        )

    def with_levels(row: Column) -> Column:
        levels = F.transform(row["chain"], lambda s: F.element_at(sheet, s))
        return F.struct(*[row[f].alias(f) for f in ("style_id", "own", "chain")], levels.alias("levels"))

    def fold(levels: Column, bag: str) -> Column:
        return F.aggregate(
            F.reverse(levels),
            default_bags[bag],
            lambda acc, s: F.when(F.size(s[bag]) > 0, merge_bag(acc, s[bag])).otherwise(acc),
        )

    def derived(row: Column) -> Column:
        levels = row["levels"]
        outline = _nearest(levels, lambda s: s["own_outline"])
        listed = F.filter(levels, lambda s: has_prop(s["ppr"], "numPr"))
        refs = F.transform(listed, lambda s: F.element_at(s["ppr"], "numPr"))
        first = F.try_element_at(refs, F.lit(1))
        reference = F.struct(
            attr(first, "numId").alias("num_id"), lenient_int(attr(first, "ilvl")).cast("int").alias("ilvl")
        )
        inherited = lambda name: F.coalesce(
            _nearest(refs, lambda r: attr(r, name)), bag_attr(default_bags["ppr"], "numPr", name)
        )
        return F.struct(
            row["style_id"].alias("style_id"),
            *[row["own"][f].alias(f) for f in fields],
            row["chain"].alias("chain"),
            F.when(outline <= 8, outline).alias("outline"),
            F.when(first.isNotNull(), reference).alias("num_ref"),
            inherited("numId").alias("list_num_id"),
            inherited("ilvl").alias("list_ilvl"),
            (F.size(refs) > 0).alias("list_from_style"),
            *([fold(levels, b).alias("eff_" + b) for b in ("ppr", "rpr")] if bags else []),
        )

    walked = F.transform(F.transform(F.map_entries(sheet), with_chain), with_levels)
    return base.select("pkg_id", F.inline(F.transform(walked, derived)))


def indents_two_chars(resolved: DataFrame) -> DataFrame:
    """Body styles whose effective first line is exactly two characters."""
    ind = F.try_element_at("eff_ppr", F.lit("ind"))
    return resolved.filter(
        (F.col("style_type") == "paragraph")
        & (lenient_int(attr(ind, "firstLineChars")) == 200)
        & ~nonzero(ind, "hanging", "hangingChars")
        & ~has_prop(F.col("eff_ppr"), "numPr")
        & F.col("outline").isNull()
    )


def _spellings(styles: DataFrame) -> DataFrame:
    names = F.concat(F.array("style_id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        styles.filter(F.col("ord") >= 0)
        .select("pkg_id", "ord", "style_id", "style_type", "is_default", F.posexplode(names))
        .withColumn("key", style_key(F.col("col")))
    )


def name_index(styles: DataFrame) -> DataFrame:
    """First definition for every normalised id, name and alias of a type."""
    return (
        _spellings(styles)
        .filter(F.col("key") != "")
        .groupBy("pkg_id", "style_type", "key")
        .agg(F.min_by("style_id", F.struct("ord", "pos")).alias("style_id"))
    )


def default_styles(styles: DataFrame) -> DataFrame:
    """Default style per type: flagged, else well known by name, else first."""
    rank = F.lit(None).cast("int")
    for style_type, known in DEFAULT_STYLE_NAMES.items():
        for i, name in enumerate(known):
            hit = (F.col("style_type") == style_type) & (F.col("key") == style_key(F.lit(name)))
            rank = F.when(hit, F.lit(i)).otherwise(rank)
    kinds = F.col("style_type").isin(*DEFAULT_STYLE_NAMES)
    first = F.struct("ord", "style_id")
    named = F.struct(F.col("rank"), F.col("ord"), F.col("pos"), F.col("style_id"))
    return (
        _spellings(styles)
        .withColumn("rank", rank)
        .groupBy("pkg_id", "style_type")
        .agg(
            F.min(F.when(F.col("is_default"), first)).alias("flagged"),
            F.min(F.when(F.col("rank").isNotNull(), named)).alias("named"),
            F.min(F.when(kinds, first)).alias("first"),
        )
        .select(
            "pkg_id",
            "style_type",
            F.coalesce("flagged.style_id", "named.style_id", "first.style_id").alias("style_id"),
        )
        .filter(F.col("style_id").isNotNull())
    )


def headings_by_level(resolved: DataFrame) -> DataFrame:
    """Heading style per level: the last canonical one, else the first."""
    canonical = heading_key(F.col("style_id")) | heading_key(F.col("name"))
    return (
        resolved.filter((F.col("style_type") == "paragraph") & F.col("outline").isNotNull())
        .groupBy("pkg_id", F.col("outline").alias("level"))
        .agg(
            F.max_by("style_id", F.when(canonical, F.col("ord"))).alias("canonical"),
            F.min_by("style_id", "ord").alias("first"),
        )
        .select("pkg_id", "level", F.coalesce("canonical", "first").alias("style_id"))
    )


def named_table_styles(settings: DataFrame) -> DataFrame:
    """``pkg_id, style_id``: the table style that settings name."""
    return settings.filter(F.col("tag") == "defaultTableStyle").select(
        "pkg_id", attr(F.col("attrs"), "val").alias("style_id")
    )


def default_table_style(settings: DataFrame, styles: DataFrame, any_type: bool = True) -> DataFrame:
    """Table style named in the settings when it exists, else the default one."""
    named = named_table_styles(settings)
    known = styles.filter(F.col("ord") >= 0)
    if not any_type:
        known = known.filter(F.col("style_type") == "table")
    chosen = named.join(known.select("pkg_id", "style_id").distinct(), ["pkg_id", "style_id"], "left_semi")
    usual = default_styles(styles).filter(F.col("style_type") == "table")
    return (
        usual.select("pkg_id", F.col("style_id").alias("usual"))
        .join(chosen.groupBy("pkg_id").agg(F.min("style_id").alias("named")), "pkg_id", "full")
        .select("pkg_id", F.coalesce("named", "usual").alias("style_id"))
    )


def index(styles: DataFrame, resolved: DataFrame, authority: DataFrame) -> DataFrame:
    """One row per source: every lookup that style mapping needs, as maps.

    ``authority`` has ``pkg_id, level, style_id``. A source's style sheet is
    bounded, and so are these maps.
    """

    def as_map(df: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
        pair = F.struct(key.alias("key"), value.alias("value"))
        return df.groupBy("pkg_id").agg(F.map_from_entries(F.collect_list(pair)).alias(name))

    typed = F.concat("style_type", F.lit(":"), "key")
    level = F.col("level").cast("int")
    parts = [
        as_map(
            resolved, F.col("style_id"), F.struct("style_type", "outline"), "ids"
        ),
        as_map(name_index(styles), typed, F.col("style_id"), "names"),
        as_map(default_styles(styles), F.col("style_type"), F.col("style_id"), "defaults"),
        as_map(headings_by_level(resolved), level, F.col("style_id"), "headings"),
        as_map(authority, level, F.col("style_id"), "authority"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part, "pkg_id", "left")
    return whole.withColumnRenamed("pkg_id", "pack_id")


def swap_table_styles(source: DataFrame, *targets: DataFrame) -> DataFrame:
    """Source styles with the table family taken from the target sheets.

    Without any target table style the source stays as it is. Across sheets the
    first definition of an id wins.
    """
    ranked = None
    for rank, sheet in enumerate(targets):
        mine = sheet.filter(F.col("style_type") == "table").withColumn("sheet", F.lit(rank))
        ranked = mine if ranked is None else ranked.unionByName(mine)
    columns = [c for c in source.columns if c not in ("pkg_id", "style_id")]
    swapped = (
        ranked.groupBy("pkg_id", "style_id")
        .agg(F.min_by(F.struct(*columns), F.struct("sheet", "ord")).alias("def"))
        .select("pkg_id", "style_id", "def.*")
    )
    has_tables = swapped.select("pkg_id").distinct().withColumn("swapped", F.lit(True))
    kept = (
        source.join(has_tables, "pkg_id", "left")
        .filter((F.col("style_type") != "table") | F.col("swapped").isNull())
        .drop("swapped")
    )
    return kept.unionByName(swapped)


def wrapper_styles(styles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Zero-indent companion of every two-character body style.

    An id already held by such a companion is reused; one held by another style
    gets the first free suffix.
    """
    preferred = F.concat(
        F.lit(WRAPPER_PREFIX + "_"), F.substring(F.sha2("style_id", 256), 1, 12)
    )
    bases = indents_two_chars(resolved).select(
        "pkg_id",
        F.col("style_id").alias("base_id"),
        F.col("name").alias("base_name"),
        preferred.alias("preferred"),
    )
    ind = F.try_element_at("ppr", F.lit("ind"))
    taken = (
        styles.filter(F.col("style_id").startswith(WRAPPER_PREFIX))
        .withColumn(
            "generated",
            (F.col("style_type") == "paragraph")
            & F.col("name").startswith(WRAPPER_NAME)
            & (attr(ind, "firstLine") == "0")
            & (attr(ind, "firstLineChars") == "0"),
        )
        .groupBy("pkg_id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("style_id", F.struct("based_on", "generated")))
            ).alias("taken")
        )
    )
    held = F.try_element_at("taken", F.col("preferred"))
    reuse = F.coalesce(held["generated"] & (held["based_on"] == F.col("base_id")), F.lit(False))
    free = F.filter(
        F.transform(
            F.sequence(F.lit(2), F.size("taken") + 2),
            lambda n: F.concat(F.col("preferred"), F.lit("_"), n.cast("string")),
        ),
        lambda c: ~F.map_contains_key(F.col("taken"), c),
    )
    style_id = F.when(held.isNull() | reuse, F.col("preferred")).otherwise(free[0])
    several = bases.groupBy("pkg_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(
        F.col("n") > 1, F.concat(F.lit(WRAPPER_NAME + " - "), "base_name")
    ).otherwise(F.lit(WRAPPER_NAME))
    return (
        bases.join(several, "pkg_id")
        .join(taken, "pkg_id", "left")
        .select(
            "pkg_id",
            "base_id",
            style_id.alias("style_id"),
            name.alias("name"),
            reuse.alias("reused"),
        )
    )
