"""Missing heading levels: styles, spacing and numbering carried on downwards.

Each level depends on the two above it, generated ones included, so one package
is a fold over at most nine levels held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.numerals import next_pattern, repeatable, spells_own_path
from galley.functions.props import bag_attr
from galley.functions.units import lenient_int
from galley.operators.graph import settled

# Bounds of extrapolated sizes (half points), spacing and indents (twips).
MAX_STEP = 12
NO_BODY_FLOOR = 16
ASSUMED_BODY = 22
BEFORE = (40, 40)
AFTER = (0, 20)
MAX_DROP = 120
MAX_INDENT = 4320
INDENT_STEP = 360
TOP_LEVELS = 3


def deeper_size(older: Column, prior: Column, body: Column, level: Column) -> Column:
    """Half-point size of the next level."""
    assumed = F.coalesce(F.when(body != 0, body), F.lit(ASSUMED_BODY)) + 2
    prior = F.coalesce(F.when(prior != 0, prior), assumed)
    step = F.coalesce(F.when(older > prior, older - prior), F.lit(2))
    step = F.least(F.greatest(step, F.lit(1)), F.lit(MAX_STEP))
    floor = F.coalesce(F.when(level == TOP_LEVELS, body + 1).otherwise(body), F.lit(NO_BODY_FLOOR))
    return F.greatest(floor, prior - step)


def deeper_spacing(older: Column, prior: Column, floor: int, default: int) -> Column:
    """Spacing of the next level; it never grows."""
    prior = F.coalesce(prior, F.lit(floor))
    delta = F.coalesce(prior - older, F.lit(-default))
    delta = F.least(F.greatest(delta, F.lit(-MAX_DROP)), F.lit(0))
    return F.greatest(F.lit(floor), prior + delta)


def deeper_indent(older: Column, prior: Column, default: int) -> Column:
    """Indent or tab of the next list level, NULL where the level above has none."""
    moved = prior + F.coalesce(prior - older, F.lit(default))
    return F.least(F.greatest(moved, F.lit(0)), F.lit(MAX_INDENT))


def level_gaps(levels: Column, max_level: int = 4) -> Column:
    """Missing levels below the third, NULL unless the first three are there."""
    complete = F.size(F.array_intersect(levels, F.array(F.lit(0), F.lit(1), F.lit(2)))) == 3
    wanted = F.sequence(F.lit(TOP_LEVELS), F.lit(max_level))
    return F.when(complete, F.array_except(wanted, levels))


def contiguous(levels: Column) -> Column:
    """True when sorted levels have no hole between the first and the last."""
    return F.coalesce(
        F.array_max(levels) - F.array_min(levels) + 1 == F.size(F.array_distinct(levels)),
        F.lit(True),
    )


def measures(resolved: DataFrame, *kept: str) -> DataFrame:
    """Size and spacing every style resolves to, and the columns ``kept`` of the style."""
    positive = lambda c: F.when(c > 0, c)
    size = F.coalesce(
        positive(lenient_int(bag_attr(F.col("eff_rpr"), "sz", "val"))),
        positive(lenient_int(bag_attr(F.col("eff_rpr"), "szCs", "val"))),
    )
    of = lambda name: lenient_int(bag_attr(F.col("eff_ppr"), "spacing", name))
    return resolved.select(
        "pkg_id",
        "style_id",
        size.alias("size"),
        of("before").alias("before"),
        of("after").alias("after"),
        *kept,
    )


def complete_levels(authority: DataFrame, measured: DataFrame, body: DataFrame, max_level: int = 4) -> DataFrame:
    """Generated levels with their size and spacing.

    ``authority`` has ``pkg_id, level, style_id``; ``body`` the default
    paragraph style per package. Packages that lack one of the first three
    levels get nothing.
    """
    item = F.struct(
        "level", F.struct("style_id", "size", "before", "after").alias("value")
    )
    known = (
        authority.join(measured, ["pkg_id", "style_id"], "left")
        .groupBy("pkg_id")
        .agg(F.map_from_entries(F.collect_list(item)).alias("known"))
    )
    body_size = body.select("pkg_id", "style_id").join(measured, ["pkg_id", "style_id"]).select(
        "pkg_id", F.col("size").alias("body")
    )
    ready = known.join(body_size, "pkg_id", "left").filter(
        F.map_contains_key("known", 0) & F.map_contains_key("known", 1) & F.map_contains_key("known", 2)
    )

    def row(level: Column, value: Column, generated: Column) -> Column:
        fields = [value[f].cast("bigint").alias(f) for f in ("size", "before", "after")]
        return F.struct(
            level.cast("int").alias("level"),
            value["style_id"].alias("style_id"),
            *fields,
            generated.alias("generated"),
        )

    top = F.transform(
        F.sequence(F.lit(0), F.lit(TOP_LEVELS - 1)),
        lambda k: row(k, F.element_at("known", k), F.lit(False)),
    )

    def grow(acc: Column, k: Column) -> Column:
        prior, older = F.element_at(acc, -1), F.element_at(acc, -2)
        made = F.struct(
            F.lit(None).cast("string").alias("style_id"),
            deeper_size(older["size"], prior["size"], F.col("body"), k).alias("size"),
            deeper_spacing(older["before"], prior["before"], *BEFORE).alias("before"),
            deeper_spacing(older["after"], prior["after"], *AFTER).alias("after"),
        )
        given = F.try_element_at("known", k)
        return F.when(
            given.isNotNull(), F.array_append(acc, row(k, given, F.lit(False)))
        ).otherwise(F.array_append(acc, row(k, made, F.lit(True))))

    filled = F.aggregate(F.sequence(F.lit(TOP_LEVELS), F.lit(max_level)), top, grow)
    return (
        ready.select("pkg_id", F.inline(filled))
        .filter("generated")
        .select("pkg_id", "level", "size", "before", "after")
    )


def completion_ids(missing: DataFrame, resolved: DataFrame, headings: DataFrame) -> DataFrame:
    """Style id each generated level gets.

    A heading style that exists for the level is reused, then ``HeadingN``
    unless another type holds it, then ``InferredHeadingN`` with the first free
    suffix. ``missing`` has ``pkg_id, level``.
    """
    number = (F.col("level") + 1).cast("string")
    usual = F.concat(F.lit("Heading"), number)
    base = F.concat(F.lit("InferredHeading"), number)
    taken = (
        resolved.filter(F.col("style_id").rlike("^(Inferred)?Heading[1-9]"))
        .groupBy("pkg_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("style_id", "style_type"))).alias("taken")
        )
    )
    existing = headings.select("pkg_id", "level", F.col("style_id").alias("existing"))
    holder = F.try_element_at("taken", usual)
    candidates = F.concat(
        F.array(base),
        F.transform(
            F.sequence(F.lit(2), F.coalesce(F.size("taken"), F.lit(0)) + 2),
            lambda n: F.concat(base, n.cast("string")),
        ),
    )
    free = F.filter(
        candidates, lambda c: F.coalesce(~F.map_contains_key(F.col("taken"), c), F.lit(True))
    )
    return (
        missing.join(existing, ["pkg_id", "level"], "left")
        .join(taken, "pkg_id", "left")
        .select(
            "pkg_id",
            "level",
            F.coalesce(
                "existing",
                F.when(holder.isNull() | (holder == "paragraph"), usual),
                free[0],
            ).alias("style_id"),
        )
    )


def shared_label_font(first: Column, second: Column) -> Column:
    """List label font the first two levels agree on, as attribute maps."""
    pairs = lambda m: F.array_sort(F.map_entries(m))
    clash = first.isNotNull() & second.isNotNull() & (pairs(first) != pairs(second))
    return F.when(~clash, F.coalesce(second, first))


def extend_numbering(rules: DataFrame, effective: DataFrame, missing: DataFrame) -> DataFrame:
    """Numbering of generated levels, where the first levels allow it.

    ``rules`` has ``pkg_id, level, rule`` for the authoritative styles,
    ``missing`` has ``pkg_id, levels``. The first three rules must spell their
    own path, the third must be repeatable, and every level above the first
    generated one needs a rule and a definition.
    """
    definition = F.struct(
        "num_id", "ilvl", "lvl_text", "num_fmt", "fonts",
        *[
            lenient_int(F.try_element_at("ind", F.lit(a))).alias(a)
            for a in ("left", "start", "hanging", "firstLine")
        ],
        F.col("tab_pos").cast("bigint").alias("tab"),
    )
    defined = effective.withColumnRenamed("start", "first_number").select(
        "pkg_id", "num_id", F.col("ilvl").alias("level"), definition.alias("d")
    )
    ruled = (
        rules.filter(F.col("rule.level") == F.col("level"))
        .select("pkg_id", "level", "rule", F.col("rule.num_id").alias("num_id"))
        .join(defined, ["pkg_id", "num_id", "level"])
        .groupBy("pkg_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("level", "d"))).alias("defs"),
            F.map_from_entries(
                F.collect_list(F.struct("level", F.col("rule.level_text").alias("t")))
            ).alias("texts"),
        )
        .join(missing, "pkg_id")
    )
    own_path = F.lit(True)
    for k in range(TOP_LEVELS):
        own_path = own_path & F.coalesce(
            spells_own_path(F.try_element_at("texts", F.lit(k)), F.lit(k)), F.lit(False)
        )
    first = F.array_min("levels")
    above = F.sequence(F.lit(0), first - 1)
    ready = ruled.filter(
        own_path
        & repeatable(F.try_element_at("texts", F.lit(2)))
        & contiguous(F.col("levels"))
        & F.forall(above, lambda k: F.map_contains_key(F.col("defs"), k))
    )
    shape = ("left", "start", "hanging", "firstLine", "tab")

    def level_row(k: Column, d: Column, text: Column) -> Column:
        return F.struct(
            k.cast("int").alias("level"),
            text.alias("lvl_text"),
            *[d[a].cast("bigint").alias(a) for a in shape],
            d["num_fmt"].alias("num_fmt"),
        )

    def grow(acc: Column, k: Column) -> Column:
        prior, older = F.element_at(acc, -1), F.try_element_at(acc, F.lit(-2))
        step = lambda a: INDENT_STEP if a in ("left", "start", "tab") else 0
        made = F.struct(
            *[deeper_indent(older[a], prior[a], step(a)).alias(a) for a in shape],
            prior["num_fmt"].alias("num_fmt"),
        )
        text = next_pattern(prior["lvl_text"], prior["level"])
        return F.array_append(acc, level_row(k, made, text))

    start = F.transform(
        above,
        lambda k: level_row(k, F.element_at("defs", k), F.element_at("defs", k)["lvl_text"]),
    )
    grown = F.aggregate(F.array_sort("levels"), start, grow)
    return (
        ready.select(
            "pkg_id",
            first.alias("first"),
            shared_label_font(
                F.try_element_at("defs", F.lit(0))["fonts"], F.try_element_at("defs", F.lit(1))["fonts"]
            ).alias("fonts"),
            F.explode(grown).alias("row"),
        )
        .filter(F.col("row.level") >= F.col("first"))
        .select("pkg_id", "row.*", "fonts")
    )


def merge_numbering(rules: DataFrame, authority: DataFrame, made: DataFrame, effective: DataFrame, next_ids: DataFrame) -> DataFrame:
    """Heading rules with one list for all levels, where levels were generated or the first three are split over several lists and
    their numbers spell a hierarchy; other packages keep their rules.

    ``rules`` has ``pkg_id, style_id, rule``; ``authority`` and ``made`` ``pkg_id, level, style_id`` of real and generated
    headings; ``effective`` the levels of the lists; ``next_ids`` ``pkg_id, next_id``, the id that a new list takes. ``made``
    marks the rules of generated headings in the result.
    """
    upper = authority.select("pkg_id", F.col("level").cast("int").alias("held"), "style_id")
    ruled = upper.join(rules.select("pkg_id", "style_id", "rule"), ["pkg_id", "style_id"])
    top = ruled.filter(F.col("held") < TOP_LEVELS).groupBy("pkg_id").agg(F.count_distinct("held").alias("n"), F.count_distinct("rule.num_id").alias("lists"))
    levels = made.groupBy("pkg_id").agg(F.array_sort(F.collect_set(F.col("level").cast("int"))).alias("levels"))
    todo = (
        top.filter(F.col("n") == TOP_LEVELS)
        .join(levels, "pkg_id", "left")
        .filter((F.col("lists") > 1) | F.col("levels").isNotNull())
        # Without new headings the next level only tells whether the first three can be one list.
        .select("pkg_id", F.coalesce("levels", F.array(F.lit(TOP_LEVELS))).alias("levels"))
    )
    grown = settled(extend_numbering(ruled.select("pkg_id", F.col("held").alias("level"), "rule"), effective, todo))
    fixed = grown.groupBy("pkg_id").agg(F.min("level").alias("first")).join(next_ids.select("pkg_id", F.col("next_id").cast("string").alias("one")), "pkg_id")
    rule = F.col("rule")
    named = F.struct(F.col("one").alias("num_id"), *[rule[f].alias(f) for f in ("level", "number_format", "level_text", "start")])
    kept = rules.join(upper, ["pkg_id", "style_id"], "left").join(fixed, "pkg_id", "left").select(
        "pkg_id", "style_id", F.when(F.col("held") < F.col("first"), named).otherwise(rule).alias("rule"), F.lit(False).alias("made")
    )
    new = grown.join(fixed.drop("first"), "pkg_id").join(made.select("pkg_id", F.col("level").cast("int").alias("level"), "style_id"), ["pkg_id", "level"])
    new = new.select(
        "pkg_id", "style_id",
        F.struct(F.col("one").alias("num_id"), "level", F.col("num_fmt").alias("number_format"), F.col("lvl_text").alias("level_text"), F.lit(1).alias("start")).alias("rule"),
        F.lit(True).alias("made"),
    )
    return kept.unionByName(new.withColumn("rule", F.col("rule").cast(dict(kept.dtypes)["rule"])))
