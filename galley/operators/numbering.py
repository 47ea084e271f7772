"""List definitions: proxies, levels with overrides, and heading rules.

A numbering part is bounded like any XML part, so the levels of one list travel
as a short array and a rule is picked without exploding candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.props import bag_attr


def concrete_lists(nums: DataFrame, abstracts: DataFrame, styles: DataFrame) -> DataFrame:
    """Abstract list each concrete list finally stands for.

    A list may point to a style, the style to another list, and so on. The last
    list of that path that still has a definition decides; a cycle ends it.
    """

    def as_map(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        last = df.groupBy("pkg_id", key).agg(F.max_by(value, "ord").alias("value"))
        pair = F.struct(F.col(key).alias("key"), "value")
        return last.groupBy("pkg_id").agg(F.map_from_entries(F.collect_list(pair)).alias(name))

    own_num = bag_attr(F.col("ppr"), "numPr", "numId")
    linked = styles.filter(own_num.isNotNull() & F.col("style_id").isNotNull())
    maps = (
        as_map(nums.filter("num_id IS NOT NULL"), "num_id", F.col("abstract_id"), "nums")
        .join(
            as_map(
                abstracts.filter("abstract_id IS NOT NULL"),
                "abstract_id",
                F.coalesce("num_style_link", F.lit("")),
                "abstracts",
            ),
            "pkg_id",
        )
        .join(as_map(linked, "style_id", own_num, "style_nums"), "pkg_id", "left")
    )
    abstract_of = lambda n: F.try_element_at("nums", n)
    defined = lambda n: F.coalesce(
        F.map_contains_key(F.col("abstracts"), abstract_of(n)), F.lit(False)
    )

    def follow(path: Column, _: Column) -> Column:
        link = F.try_element_at("abstracts", abstract_of(F.element_at(path, -1)))
        nxt = F.try_element_at("style_nums", link)
        goes_on = nxt.isNotNull() & ~F.array_contains(path, nxt) & defined(nxt)
        return F.when(goes_on, F.array_append(path, nxt)).otherwise(path)

    def last(num: Column) -> Column:
        path = F.aggregate(F.map_keys(F.col("nums")), F.array(num), follow)
        return F.struct(
            num.alias("num_id"),
            F.when(defined(num), abstract_of(F.element_at(path, -1))).alias("abstract_id"),
        )

    return maps.select("pkg_id", F.inline(F.transform(F.map_keys("nums"), last)))


def levels(lists: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective levels of every concrete list.

    ``lists`` comes from :func:`concrete_lists`. An override's own level beats
    the base level value by value, its start override beats both. The first
    definition of a level counts.
    """
    fields = ["ord", "start", "num_fmt", "lvl_text", "lvl_restart"]
    base = (
        levels.filter("ilvl IS NOT NULL")
        .groupBy("pkg_id", "abstract_id", "ilvl")
        .agg(F.min_by(F.struct(*fields, "pstyle", "fonts", "ind", "tab_pos"), "ord").alias("b"))
    )
    over = overrides.groupBy("pkg_id", "num_id", "ilvl").agg(
        F.min_by(F.struct("start_override", "has_lvl", *fields), "ord").alias("o")
    )
    own = lists.filter("abstract_id IS NOT NULL").join(base, ["pkg_id", "abstract_id"])
    added = over.join(lists.filter("abstract_id IS NOT NULL"), ["pkg_id", "num_id"])
    both = own.join(
        added.select("pkg_id", "num_id", "ilvl", "abstract_id", "o"),
        ["pkg_id", "num_id", "ilvl", "abstract_id"],
        "full",
    )
    own_level = F.coalesce(F.col("o.has_lvl"), F.lit(False))
    pick = lambda f: F.coalesce(F.when(own_level, F.col("o." + f)), F.col("b." + f)).alias(f)
    return both.filter(F.col("b").isNotNull() | own_level).select(
        "pkg_id",
        "num_id",
        "abstract_id",
        "ilvl",
        F.col("b.ord").alias("ord"),
        F.coalesce("o.start_override", pick("start")).alias("start"),
        pick("num_fmt"),
        pick("lvl_text"),
        pick("lvl_restart"),
        F.col("o.start_override").alias("start_override"),
        F.col("b.pstyle").alias("pstyle"),
        F.col("b.fonts").alias("fonts"),
        F.col("b.ind").alias("ind"),
        F.col("b.tab_pos").alias("tab_pos"),
    )


def restarts(level: Column, lvl_restart: Column) -> Column:
    """Whether a level restarts after its parent; NULL at the top level."""
    return F.when(level > 0, F.coalesce(lvl_restart != 0, F.lit(True)))


def _level_arrays(effective: DataFrame) -> DataFrame:
    """Levels of one list as an array in file order; override-only ones last."""
    item = F.struct(
        F.coalesce("ord", F.lit(1 << 30)).alias("ord"), "ilvl", "pstyle", "num_fmt", "lvl_text",
        "start", F.col("ord").isNotNull().alias("base"),
    )
    return effective.groupBy("pkg_id", "num_id").agg(
        F.array_sort(F.collect_list(item)).alias("levels")
    )


def pick_rules(refs: DataFrame, effective: DataFrame) -> DataFrame:
    """Heading rule of every ``(style_id, num_id, level_hint, outline)``.

    Levels are tried in turn: the hint, the level linked to the style, the
    outline, the top one, then those of the list; the first that exists wins.
    A list id that is empty, zero or not a number gives no rule, nor does a
    level without a number format.
    """
    valid = F.col("num_id").rlike("^[0-9]+$") & (F.col("num_id") != "0")
    joined = refs.join(_level_arrays(effective), ["pkg_id", "num_id"], "left")
    levels_ = F.col("levels")
    linked = F.filter(levels_, lambda x: x["base"] & (x["pstyle"] == F.col("style_id")))
    wanted = F.array(
        F.col("level_hint").cast("int"),
        F.try_element_at(linked, F.lit(1))["ilvl"],
        F.col("outline").cast("int"),
        F.lit(0),
    )
    listed = F.transform(F.filter(levels_, lambda x: x["base"]), lambda x: x["ilvl"])
    tries = F.filter(
        F.concat(wanted, listed),
        lambda k: k.between(0, 8) & F.exists(levels_, lambda x: x["ilvl"] == k),
    )
    level = F.try_element_at(tries, F.lit(1))
    found = joined.withColumn("level", F.when(valid, level)).withColumn(
        "picked", F.filter("levels", lambda x: x["ilvl"] == F.col("level"))[0]
    )
    rule = F.struct(
        "num_id",
        "level",
        F.col("picked.num_fmt").alias("number_format"),
        F.col("picked.lvl_text").alias("level_text"),
        F.col("picked.start").alias("start"),
    )
    usable = F.col("level").isNotNull() & (F.coalesce("picked.num_fmt", F.lit("")) != "none")
    return found.withColumn("rule", F.when(usable, rule)).drop("levels", "level", "picked")


def linked_rules(heading_styles: DataFrame, effective: DataFrame) -> DataFrame:
    """Rule of a style without a list reference: the lowest list that has a
    level linked back to it."""
    back = (
        effective.filter(F.col("ord").isNotNull() & F.col("pstyle").isNotNull())
        .filter(F.col("num_id").rlike("^[0-9]+$") & (F.col("num_id") != "0"))
        .filter(F.coalesce("num_fmt", F.lit("")) != "none")
        .select(
            "pkg_id",
            F.col("pstyle").alias("style_id"),
            F.struct(
                "num_id",
                F.col("ilvl").alias("level"),
                F.col("num_fmt").alias("number_format"),
                F.col("lvl_text").alias("level_text"),
                "start",
            ).alias("rule"),
            F.struct(F.col("num_id").cast("decimal(38,0)"), "num_id", "ord").alias("rank"),
        )
    )
    lowest = back.groupBy("pkg_id", "style_id").agg(F.min_by("rule", "rank").alias("rule"))
    return heading_styles.join(lowest, ["pkg_id", "style_id"])


def style_rules(resolved: DataFrame, effective: DataFrame) -> DataFrame:
    """Numbering rule each heading style carries by itself."""
    headings = resolved.filter(
        (F.col("style_type") == "paragraph") & F.col("outline").isNotNull()
    ).select("pkg_id", "style_id", "outline", "num_ref")
    num_id = F.col("num_ref.num_id")
    direct = pick_rules(
        headings.filter(F.coalesce(num_id, F.lit("0")) != "0").select(
            "pkg_id",
            "style_id",
            "outline",
            num_id.alias("num_id"),
            F.col("num_ref.ilvl").alias("level_hint"),
        ),
        effective,
    ).select("pkg_id", "style_id", "outline", "rule")
    unnumbered = headings.filter(F.col("num_ref").isNull() | num_id.isNull())
    reverse = linked_rules(unnumbered.select("pkg_id", "style_id", "outline"), effective)
    return direct.unionByName(reverse).filter("rule IS NOT NULL")


def saved_rules(saved: DataFrame, resolved: DataFrame, effective: DataFrame) -> DataFrame:
    """Saved ``(style_id, num_id, level)`` read again against current lists."""
    refs = saved.join(resolved.select("pkg_id", "style_id", "outline"), ["pkg_id", "style_id"], "left")
    return (
        pick_rules(
            refs.select("pkg_id", "style_id", "outline", "num_id", F.col("level").alias("level_hint")),
            effective,
        )
        .filter("rule IS NOT NULL")
        .select("pkg_id", "style_id", "outline", "rule")
    )


def align_styles(used: DataFrame, style_refs: DataFrame, rules: DataFrame) -> DataFrame:
    """Give every used heading style its rule and take other lists away.

    ``style_refs`` has ``pkg_id, style_id, num_id, ilvl``; styles that are not
    used keep theirs. ``changed`` marks the styles written to: those that get a
    rule and those that lose a reference.
    """
    return (
        style_refs.join(used.withColumn("used", F.lit(True)), ["pkg_id", "style_id"], "left")
        .join(rules.select("pkg_id", "style_id", "rule"), ["pkg_id", "style_id"], "left")
        .select(
            "pkg_id",
            "style_id",
            F.when(F.col("used"), F.col("rule.num_id")).otherwise(F.col("num_id")).alias("num_id"),
            F.when(F.col("used"), F.col("rule.level")).otherwise(F.col("ilvl")).alias("ilvl"),
            (
                F.coalesce("used", F.lit(False))
                & F.coalesce("rule.num_id", "num_id", F.col("ilvl").cast("string")).isNotNull()
            ).alias("changed"),
        )
    )


def seed_starts(nums: DataFrame, rules: DataFrame, seeds: DataFrame) -> DataFrame:
    """Start override of level 0 for every list a rule uses, where a seed exists."""
    used = rules.select("pkg_id", F.col("rule.num_id").alias("num_id")).distinct()
    return (
        nums.join(used.withColumn("used", F.lit(True)), ["pkg_id", "num_id"], "left")
        .join(seeds.filter("seed > 0"), "pkg_id", "left")
        .select(
            "pkg_id",
            "num_id",
            F.when(F.col("used"), F.coalesce("seed", "start_override"))
            .otherwise(F.col("start_override"))
            .alias("start_override"),
        )
    )
