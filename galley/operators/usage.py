"""Usage counts and votes.

Every vote is two partial aggregations: counts per candidate, then the best
candidate per group as a minimum over ``(-count, first seen, id)``. No group is
collected or ranked in a window, so one hot style or package only costs its
partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.props import (
    ATTRS,
    BAG,
    alignment_profile,
    bag_attr,
    dropped,
    has_prop,
    indent_profile,
    signature,
    spacing_profile,
)
from galley.functions.text import casefold, orientation
from galley.functions.units import lenient_int, twips_to_cm
from galley.operators.numbering import pick_rules
from galley.registries import BODY_PART, PARAGRAPH_KEEP, RUN_KEEP, SECTION_TAGS, WORD

POSITION = ("part", "ord")


def position() -> Column:
    """Document order: parts by name, then the order inside the part."""
    return F.struct(*POSITION)


def number(rows: DataFrame) -> Column:
    """How many nodes rows stand for: each for itself, or for the ``n`` of a tally."""
    return F.sum("n") if "n" in rows.columns else F.count(F.lit(1))


def list_reference(ppr: Column) -> dict[str, Column]:
    """What a paragraph says itself about its list."""
    return {
        "listed": has_prop(ppr, "numPr"),
        "num_id": bag_attr(ppr, "numPr", "numId"),
        "level_hint": bag_attr(ppr, "numPr", "ilvl").try_cast("int"),
    }


def tally(nodes: DataFrame) -> DataFrame:
    """Nodes of a part that count and vote alike, as one row with their number ``n`` and the first ``ord``.

    All counts and votes of a profile but those on sections read these rows, so nodes are read once. Paragraphs are told apart
    by style, list reference, alignment, and by indent and spacing as JSON; other nodes by style. ``manual``, ``bags`` and
    ``characters`` are sums.
    """
    kind, bag = F.col("kind"), F.col("bag")
    paragraph, run = kind == "paragraph", kind == "run"
    direct = list_reference(bag) | {
        "ind": F.to_json(F.try_element_at(bag, F.lit("ind"))),
        "spacing": F.to_json(F.try_element_at(bag, F.lit("spacing"))),
        "jc": alignment_profile(bag),
    }
    own = {k: F.when(paragraph, v) for k, v in direct.items()}
    return (
        nodes.select(
            "pkg_id", "kind", "part", "ord", "style_id",
            *[v.alias(k) for k, v in own.items()],
            F.when(paragraph, manual_paragraph(bag)).when(run, manual_run(bag)).alias("manual"),
            F.when(run, F.col("has_bag")).alias("has_bag"),
            F.when(run, _characters()).alias("characters"),
        )
        .groupBy("pkg_id", "kind", "part", "style_id", *own)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ord").alias("ord"),
            count_if(F.col("manual")).alias("manual"),
            count_if(F.col("has_bag")).alias("bags"),
            F.sum("characters").alias("characters"),
        )
    )


def signed(tallied: DataFrame) -> DataFrame:
    """Tallied paragraphs with the signatures of indent and spacing for their JSON; each text is read once."""
    given = {"ind": F.col("ind_json"), "spacing": F.col("spacing_json")}
    texts = tallied.select(*[F.col(k).alias(k + "_json") for k in given]).distinct()
    attrs = {k: F.from_json(text, ATTRS) for k, text in given.items()}
    texts = texts.select(
        *given.values(),
        signature(indent_profile(attrs["ind"])).alias("ind"),
        signature(spacing_profile(attrs["spacing"])).alias("spacing"),
    )
    raw = tallied.withColumnsRenamed({k: k + "_raw" for k in given})
    same = [F.col(k + "_raw").eqNullSafe(text) for k, text in given.items()]
    return raw.join(texts, reduce(lambda a, b: a & b, same)).drop(*[k + end for k in given for end in ("_raw", "_json")])


def totals(tallied: DataFrame) -> DataFrame:
    """What :func:`summary` and :func:`manual_formatting` count, from a tally; the latter's names begin with ``manual_``."""
    kind, none = F.col("kind"), F.lit(0)
    of = lambda value, test: F.coalesce(F.sum(F.when(test, F.col(value))), none)
    return tallied.groupBy("pkg_id").agg(
        of("n", kind == "paragraph").alias("paragraphs"),
        of("n", kind == "run").alias("runs"),
        of("n", kind == "table").alias("tables"),
        of("n", (kind == "section") & (F.col("part") == BODY_PART)).alias("sections"),
        of("n", kind == "section").alias("all_sections"),
        of("characters", kind == "run").alias("characters"),
        of("manual", kind == "paragraph").alias("manual_paragraphs"),
        of("manual", kind == "run").alias("manual_runs"),
        of("bags", kind == "run").alias("manual_runs_any"),
    )


def with_default_style(nodes: DataFrame, defaults: DataFrame, style_type: str) -> DataFrame:
    """Give nodes without a style the package's default style of a type."""
    usual = defaults.filter(F.col("style_type") == style_type) if (
        "style_type" in defaults.columns
    ) else defaults
    usual = usual.select("pkg_id", F.col("style_id").alias("usual"))
    return (
        nodes.join(usual, "pkg_id", "left")
        .withColumn("style_id", F.coalesce(F.when(F.col("style_id") != "", F.col("style_id")), "usual"))
        .drop("usual")
    )


def style_usage(nodes: DataFrame) -> DataFrame:
    """Uses of every style, in total and per story.

    ``nodes`` has ``pkg_id, style_type, story, style_id`` with default styles
    already filled in.
    """
    per_story = (
        nodes.filter(F.coalesce("style_id", F.lit("")) != "")
        .groupBy("pkg_id", "style_type", "style_id", "story")
        .agg(number(nodes).alias("n"))
    )
    return per_story.groupBy("pkg_id", "style_type", "style_id").agg(
        F.sum("n").alias("usage_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("story", "n")))).alias("by_story"),
    )


def heading_authority(headings: DataFrame) -> DataFrame:
    """Heading style of each level: most used, then first seen, then by id.

    ``headings`` has ``pkg_id, part, ord, style_id, outline``.
    """
    counts = (
        headings.filter(F.col("outline").isNotNull() & F.col("style_id").isNotNull())
        .groupBy("pkg_id", F.col("outline").alias("level"), "style_id")
        .agg(F.count(F.lit(1)).alias("votes"), F.min(position()).alias("first_seen"))
    )
    best = F.min_by(F.struct("style_id", "votes"), F.struct(-F.col("votes"), "first_seen", "style_id"))
    return counts.groupBy("pkg_id", "level").agg(best.alias("w")).select("pkg_id", "level", "w.*")


def heading_authority_by_body(usage: DataFrame, resolved: DataFrame) -> DataFrame:
    """Heading style of each level: most body uses, then all uses, then by id."""
    body = F.coalesce(F.try_element_at("by_story", F.lit("body")), F.lit(0))
    ranked = usage.filter(F.col("style_type") == "paragraph").join(
        resolved.filter("outline IS NOT NULL").select("pkg_id", "style_id", "outline"),
        ["pkg_id", "style_id"],
    )
    best = F.min_by("style_id", F.struct(-body, -F.col("usage_count"), "style_id"))
    return ranked.groupBy("pkg_id", F.col("outline").alias("level")).agg(best.alias("style_id"))


def property_consensus(paragraphs: DataFrame) -> DataFrame:
    """Most frequent direct indent, spacing and alignment of every style.

    The three vote apart, and having none is a vote: where it wins there is no
    override. ``paragraphs`` has ``pkg_id, part, ord, style_id, ppr``.
    """
    ppr = F.col("ppr")
    own = {
        "ind": signature(indent_profile(F.try_element_at(ppr, F.lit("ind")))),
        "spacing": signature(spacing_profile(F.try_element_at(ppr, F.lit("spacing")))),
        "jc": alignment_profile(ppr),
    }
    return property_winners(paragraphs.select("pkg_id", "style_id", *POSITION, *[v.alias(k) for k, v in own.items()]))


_VOTED = ("ind", "spacing", "jc")


def property_winners(paragraphs: DataFrame) -> DataFrame:
    """:func:`property_consensus` of paragraphs, or a tally of them, with ``ind``, ``spacing`` and ``jc`` to be voted on."""
    ballots = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in _VOTED])
    some = ["n"] if "n" in paragraphs.columns else []
    counts = (
        paragraphs.select("pkg_id", "style_id", *POSITION, *some, F.inline(ballots))
        .groupBy("pkg_id", "style_id", "component", "value")
        .agg(number(paragraphs).alias("votes"), F.min(position()).alias("first_seen"))
    )
    best = F.min_by(
        F.struct("value", "votes"),
        F.struct(-F.col("votes"), "first_seen", F.coalesce("value", F.lit(""))),
    )
    return (
        counts.groupBy("pkg_id", "style_id", "component")
        .agg(best.alias("w"))
        .select("pkg_id", "style_id", "component", "w.value", "w.votes")
    )


def consensus_profiles(winners: DataFrame) -> DataFrame:
    """Consensus as one profile per style; styles without any override drop out."""

    def of(component: str) -> Column:
        return F.max(F.when(F.col("component") == component, F.col("value")))

    as_map = lambda c: F.when(c.isNotNull(), F.str_to_map(c, F.lit(";"), F.lit("=")))
    return (
        winners.groupBy("pkg_id", "style_id")
        .agg(of("ind").alias("i"), of("spacing").alias("s"), of("jc").alias("jc"))
        .filter("coalesce(i, s, jc) IS NOT NULL")
        .select(
            "pkg_id",
            "style_id",
            as_map(F.col("i")).alias("ind"),
            as_map(F.col("s")).alias("spacing"),
            "jc",
        )
    )


def inherit_parent_indent(
    profiles: DataFrame, observed: DataFrame, inferred: DataFrame, authority: DataFrame
) -> DataFrame:
    """Generated heading styles nobody used take the indent of the level above.

    ``inferred`` and ``authority`` have ``pkg_id, level, style_id``. A generated
    style can follow a generated one, so a package's few levels are folded in
    one row, from the top down.
    """
    pairs = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    silent = (
        inferred.join(observed.select("pkg_id", "style_id"), ["pkg_id", "style_id"], "left_anti")
        .groupBy("pkg_id")
        .agg(F.array_sort(F.collect_list(F.struct("level", "style_id"))).alias("silent"))
    )
    known = profiles.filter("ind IS NOT NULL").groupBy("pkg_id").agg(pairs("style_id", "ind").alias("known"))
    places = authority.groupBy("pkg_id").agg(pairs("level", "style_id").alias("places"))

    def lend(acc: Column, item: Column) -> Column:
        above = F.try_element_at(acc, F.try_element_at("places", item["level"] - 1))
        new = above.isNotNull() & ~F.map_contains_key(acc, item["style_id"])
        return F.when(new, F.map_concat(acc, F.create_map(item["style_id"], above))).otherwise(acc)

    lent = (
        silent.join(known, "pkg_id")
        .join(places, "pkg_id")
        .withColumn("known", F.aggregate("silent", F.col("known"), lend))
        .select("pkg_id", "known", F.explode("silent").alias("s"))
        .select("pkg_id", "s.style_id", F.try_element_at("known", F.col("s.style_id")).alias("ind"))
        .filter("ind IS NOT NULL")
    )
    return profiles.unionByName(lent, allowMissingColumns=True)


def rule_votes(paragraphs: DataFrame, resolved: DataFrame, rules: DataFrame, effective: DataFrame) -> DataFrame:
    """Numbering rule of every used heading style, by vote of its paragraphs.

    Paragraphs are counted per distinct list reference first, so a rule is
    looked up once per reference and not once per paragraph. List id 0 is an
    explicit "no number" and counts against all rules together.
    """
    own = [v.alias(k) for k, v in list_reference(F.col("ppr")).items()]
    model = resolved.withColumn("model", F.col("pkg_id"))
    return rule_winners(paragraphs.select("pkg_id", "style_id", *POSITION, *own), model, rules, effective)


_REFERENCE = ("listed", "num_id", "level_hint")


def rule_winners(paragraphs: DataFrame, resolved: DataFrame, rules: DataFrame, effective: DataFrame) -> DataFrame:
    """:func:`rule_votes` of paragraphs, or a tally of them, that have a :func:`list_reference`.

    ``resolved`` names as ``model`` the package whose lists in ``effective`` are also those of ``pkg_id``. A reference is looked
    up once for all packages of a model.
    """
    inherited = rules.select("pkg_id", "style_id", F.col("rule").alias("own"))
    ballots = (
        paragraphs.groupBy("pkg_id", "style_id", *_REFERENCE)
        .agg(number(paragraphs).alias("n"), F.min(position()).alias("first_seen"))
        .join(
            resolved.filter("outline IS NOT NULL").select("pkg_id", "model", "style_id", "outline"),
            ["pkg_id", "style_id"],
        )
        .join(inherited, ["pkg_id", "style_id"], "left")
        .withColumn("suppressed", F.coalesce(F.col("num_id") == "0", F.lit(False)))
        .withColumn(
            "num_id",
            F.when(F.col("listed") & ~F.col("suppressed"), F.coalesce("num_id", "own.num_id")),
        )
    )
    asked = ballots.filter("num_id IS NOT NULL").select(
        F.col("model").alias("pkg_id"), "style_id", "outline", "num_id", "level_hint"
    ).distinct()
    keys = {"pkg_id": "model", **{k: k for k in ("style_id", "outline", "num_id", "level_hint")}}
    picked = pick_rules(asked, effective).select(*[F.col(k).alias("asked_" + k) for k in keys], "rule")
    same = [F.col("asked_" + k).eqNullSafe(F.col(v)) for k, v in keys.items()]
    votes = ballots.join(picked, reduce(lambda a, b: a & b, same), "left").withColumn(
        "rule", F.when(F.col("listed"), F.col("rule")).otherwise(F.col("own"))
    )
    per_rule = votes.groupBy("pkg_id", "style_id", "rule").agg(
        F.sum(F.when(F.col("rule").isNotNull(), F.col("n")).otherwise(0)).alias("votes"),
        F.sum(F.when(F.col("suppressed"), F.col("n")).otherwise(0)).alias("suppressed"),
        F.min("first_seen").alias("first_seen"),
    )
    best = F.min_by(
        "rule", F.when(F.col("rule").isNotNull(), F.struct(-F.col("votes"), "first_seen"))
    )
    return (
        per_rule.groupBy("pkg_id", "style_id")
        .agg(
            best.alias("rule"),
            F.sum("votes").alias("votes"),
            F.sum("suppressed").alias("suppressed"),
            F.count("rule").alias("rules"),
        )
        .select(
            "pkg_id",
            "style_id",
            F.when(F.col("votes") > F.col("suppressed"), F.col("rule")).alias("rule"),
            "votes",
            "suppressed",
            (F.col("rules") > 1).alias("conflict"),
        )
    )


def manual_paragraph(ppr: Column) -> Column:
    """Direct paragraph formatting beyond style and section."""
    return dropped(ppr, PARAGRAPH_KEEP) > 0


def manual_run(rpr: Column) -> Column:
    """Direct run formatting beyond the properties that carry meaning."""
    return dropped(rpr, RUN_KEEP) > 0


def count_if(test: Column) -> Column:
    return F.coalesce(F.count_if(test), F.lit(0))


def _characters() -> Column:
    return F.length(F.replace("text", F.lit("\t"), F.lit("")))


def summary(nodes: DataFrame) -> DataFrame:
    """Paragraphs, runs, tables, sections and characters of every package.

    ``sections`` counts the body only; ``all_sections`` every part.
    """
    kind = F.col("kind")
    body = F.col("part") == "word/document.xml"
    return nodes.groupBy("pkg_id").agg(
        count_if(kind == "paragraph").alias("paragraphs"),
        count_if(kind == "run").alias("runs"),
        count_if(kind == "table").alias("tables"),
        count_if((kind == "section") & body).alias("sections"),
        count_if(kind == "section").alias("all_sections"),
        F.coalesce(F.sum(F.when(kind == "run", _characters())), F.lit(0)).alias("characters"),
    )


def page_layouts(nodes: DataFrame) -> DataFrame:
    """Page size, orientation and margins of the body's first section, in cm."""
    size = lambda name: bag_attr(F.col("bag"), "pgSz", name)
    cm = lambda raw: twips_to_cm(raw)
    margin = lambda name: cm(bag_attr(F.col("bag"), "pgMar", name)).alias(f"margin_{name}_cm")
    turned = orientation(size("orient"), lenient_int(size("w")), lenient_int(size("h")))
    layout = F.struct(
        cm(size("w")).alias("width_cm"), cm(size("h")).alias("height_cm"), turned.alias("orientation"),
        *[margin(side) for side in ("top", "bottom", "left", "right")],
    )
    body = nodes.filter((F.col("kind") == "section") & (F.col("part") == "word/document.xml"))
    return body.groupBy("pkg_id").agg(F.min_by(layout, "ord").alias("page_layout"))


def manual_formatting(nodes: DataFrame) -> DataFrame:
    """Directly formatted paragraphs and runs.

    Two counts of runs: ``runs`` ignores meaningful properties, ``runs_any``
    takes every run that has a property container.
    """
    kind = F.col("kind")
    return nodes.groupBy("pkg_id").agg(
        count_if((kind == "paragraph") & manual_paragraph(F.col("bag"))).alias("paragraphs"),
        count_if((kind == "run") & manual_run(F.col("bag"))).alias("runs"),
        count_if((kind == "run") & F.col("has_bag")).alias("runs_any"),
    )


def paragraph_levels(paragraphs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Heading level of every paragraph: a direct outline beats the style's;
    9 says body text."""
    outlines = resolved.select("pkg_id", "style_id", "outline")
    level = F.when(
        F.col("direct_outline").isNotNull(),
        F.when(F.col("direct_outline") <= 8, F.col("direct_outline")),
    ).otherwise(F.col("outline"))
    return (
        paragraphs.join(outlines, ["pkg_id", "style_id"], "left")
        .withColumn("level", level)
        .drop("outline")
    )


def level_histogram(leveled: DataFrame) -> DataFrame:
    """Body headings per level."""
    return (
        leveled.filter((F.col("part") == "word/document.xml") & F.col("level").isNotNull())
        .groupBy("pkg_id", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def used_levels(leveled: DataFrame) -> DataFrame:
    """Levels in use per package; at most nine."""
    return (
        leveled.filter("level IS NOT NULL")
        .groupBy("pkg_id")
        .agg(F.array_sort(F.collect_set("level")).alias("levels"))
    )


def used_tables(tables: DataFrame, resolved: DataFrame) -> DataFrame:
    """Table styles in use: first seen position and count.

    ``tables`` has default styles filled in. The first encountered one is the
    choice of a migration, the most used one that of a profile.
    """
    known = resolved.filter(F.col("style_type") == "table").select("pkg_id", "style_id")
    return (
        tables.join(known, ["pkg_id", "style_id"], "left_semi")
        .groupBy("pkg_id", "style_id")
        .agg(number(tables).alias("n"), F.min(position()).alias("first_seen"))
    )


def preferred_tables(used: DataFrame) -> DataFrame:
    most = F.struct(-F.col("n"), "first_seen")
    return used.groupBy("pkg_id").agg(
        F.min_by("style_id", "first_seen").alias("first_style"),
        F.min_by("style_id", most).alias("common_style"),
        F.count(F.lit(1)).alias("styles"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def editable_sheets(styles: DataFrame) -> DataFrame:
    """Whether a style sheet can be edited: no repeated style id."""
    per_id = styles.filter(F.col("ord") >= 0).groupBy("pkg_id", "style_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_id.groupBy("pkg_id").agg((F.max("n") == 1).alias("editable"))


def pack_counters(used_formats: DataFrame, defined: DataFrame) -> DataFrame:
    """Used, inferred, custom, defined and hidden style counts of a profile.

    ``used_formats`` has ``pkg_id, inferred, configured``; ``defined`` one row
    per defined style, or their number ``n`` per package.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    inferred, configured = flag(F.col("inferred")), flag(F.col("configured"))
    shown = used_formats.groupBy("pkg_id").agg(
        count_if(~inferred & ~configured).alias("used"),
        count_if(inferred & ~configured).alias("inferred"),
        count_if(configured).alias("custom"),
        F.count(F.lit(1)).alias("shown"),
    )
    total = defined.groupBy("pkg_id").agg(number(defined).alias("defined"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.join(shown, "pkg_id", "left").select(
        "pkg_id",
        zero("used").alias("used"),
        zero("inferred").alias("inferred"),
        zero("custom").alias("custom"),
        "defined",
        F.greatest(F.lit(0), F.col("defined") - zero("shown")).alias("hidden"),
    )


def distinct_fonts(used_formats: DataFrame) -> DataFrame:
    """Fonts a profile names, sorted without regard to case."""
    fonts = F.array("font_latin", "font_east_asia")
    names = used_formats.select("pkg_id", F.explode(fonts).alias("font")).filter(
        F.coalesce("font", F.lit("")) != ""
    )
    return (
        names.distinct()
        .groupBy("pkg_id")
        .agg(F.array_sort(F.collect_list(F.struct(casefold(F.col("font")).alias("k"), "font"))).alias("f"))
        .select("pkg_id", F.transform("f", lambda x: x["font"]).alias("fonts"))
    )


def ordered_distinct(values: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(values)


def _attribute(entry: Column) -> Column:
    value = entry["value"]
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit(" w:"), entry["key"], F.lit('="'), value, F.lit('"'))


def _element(tag: Column, attrs: Column, space: str = "") -> Column:
    """Element text of a property: its attributes by name, dotted ones as attributes of a child."""
    entries = F.array_sort(F.map_entries(attrs))
    dotted = lambda e: F.contains(e["key"], F.lit("."))
    own = F.array_join(F.transform(F.filter(entries, lambda e: ~dotted(e)), _attribute), "")
    nested = F.filter(entries, dotted)
    name = lambda e: F.substring_index(e["key"], ".", 1)
    bare = lambda e: F.struct(F.substring_index(e["key"], ".", -1).alias("key"), e["value"].alias("value"))
    child = lambda c: F.concat(F.lit("<w:"), c, F.array_join(F.transform(F.filter(nested, lambda e: name(e) == c), lambda e: _attribute(bare(e))), ""), F.lit("/>"))
    children = F.array_join(F.transform(F.array_distinct(F.transform(nested, name)), child), "")
    begin = F.concat(F.lit("<w:"), tag, F.lit(space), own)
    return F.when(children == "", F.concat(begin, F.lit("/>"))).otherwise(F.concat(begin, F.lit(">"), children, F.lit("</w:"), tag, F.lit(">")))


def stored_layouts(nodes: DataFrame) -> DataFrame:
    """``pkg_id, section_layouts``: the allowed layout tags of the body's sections in order, each as base64 of its element.

    A body is one part, and its sections are bounded like it.
    """
    allowed = F.filter(F.map_entries(F.coalesce("bag", F.create_map().cast(BAG))), lambda e: e["key"].isin(*SECTION_TAGS))
    space = f' xmlns:w="{WORD}"'
    encoded = F.transform(allowed, lambda e: F.regexp_replace(F.base64(_element(e["key"], e["value"], space).cast("binary")), r"\s", ""))
    rows = nodes.filter((F.col("kind") == "section") & (F.col("part") == BODY_PART)).select("pkg_id", "ord", encoded.alias("layout"))
    return rows.groupBy("pkg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "layout"))), lambda x: x["layout"]).alias("section_layouts"))
