"""Property bags: ``map<property, map<attribute, value>>`` of a style, a
paragraph or a run. Zero and nine are meaningful values here; they are never
folded into NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from galley.functions.units import lenient_int, on_off
from galley.registries import (
    ALIGNMENTS,
    INDENT_ATTRS,
    INDENT_GROUPS,
    LINE_RULES,
    SPACING_ATTRS,
    SPACING_FLAG_ATTRS,
    SPACING_INT_ATTRS,
)

ATTRS = "map<string,string>"
BAG = "map<string,map<string,string>>"


def attr(attrs: Column, *names: str) -> Column:
    """First attribute present among several names."""
    return F.coalesce(*[F.try_element_at(attrs, F.lit(n)) for n in names])


def bag_attr(bag: Column, prop: str, *names: str) -> Column:
    return attr(F.try_element_at(bag, F.lit(prop)), *names)


def has_prop(bag: Column, prop: str) -> Column:
    return F.coalesce(F.map_contains_key(bag, prop), F.lit(False))


def has_attr(attrs: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(attrs, name), F.lit(False))


def names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def keep_only(bag: Column, keep) -> Column:
    return F.map_filter(bag, lambda k, _: k.isin(*keep))


def dropped(bag: Column, keep) -> Column:
    """Number of properties an allow-list removes."""
    extra = F.filter(F.map_keys(bag), lambda k: ~k.isin(*keep))
    return F.coalesce(F.size(extra), F.lit(0))


def nonzero(attrs: Column, *which: str) -> Column:
    tests = [F.coalesce(lenient_int(attr(attrs, n)), F.lit(0)) != 0 for n in which]
    return reduce(lambda a, b: a | b, tests)


def override(older: Column, newer: Column) -> Column:
    """Attributes of two maps, the newer one winning."""
    rest = F.map_filter(older, lambda k, _: ~F.map_contains_key(newer, k))
    return F.map_concat(rest, newer)


def changed_attrs(attrs: Column, sets: dict, gone: dict | None = None) -> Column:
    """Attributes with some set and some removed.

    ``sets`` maps names to values, NULL leaving the attribute alone; ``gone``
    maps names to conditions. ``attrs`` is read once, so changes of any number
    stay one small expression.
    """
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sets.items()]
    new = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    if gone:
        removed = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in gone.items()]))
        attrs = F.map_filter(attrs, lambda k, _: ~F.array_contains(removed, k))
    return override(attrs, new)


def changed_props(bag: Column, new: dict) -> Column:
    """Bag with some properties replaced: ``new`` maps names to ``(when, attrs)``."""
    entries = [
        F.when(test, F.struct(F.lit(k).alias("key"), attrs.cast(ATTRS).alias("value")))
        for k, (test, attrs) in new.items()
    ]
    return override(bag, F.map_from_entries(F.array_compact(F.array(*entries))))


def merge_indent(older: Column, newer: Column) -> Column:
    """Indent after a later style level.

    A later first-line choice removes an earlier hanging one and the other way
    round; a group replaces its older spelling; a zero in character units only
    removes what was there.
    """
    first = has_attr(newer, "firstLine") | nonzero(newer, "firstLineChars")
    hanging = has_attr(newer, "hanging") | nonzero(newer, "hangingChars")
    gone = {name: F.lit(False) for name in INDENT_ATTRS}
    for name in ("firstLine", "firstLineChars"):
        gone[name] = gone[name] | hanging
    for name in ("hanging", "hangingChars"):
        gone[name] = gone[name] | first
    for group in INDENT_GROUPS:
        present = reduce(lambda a, b: a | b, [has_attr(newer, n) for n in group])
        for name in group:
            gone[name] = gone[name] | present
    removed = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in gone.items()]))
    rest = F.map_filter(older, lambda k, _: ~F.array_contains(removed, k))
    live = F.map_filter(
        newer, lambda k, v: ~(k.endswith("Chars") & F.coalesce(lenient_int(v) == 0, F.lit(False)))
    )
    return override(rest, live)


def merge_bag(older: Column, newer: Column) -> Column:
    """Property bag after a later style level."""
    empty = F.create_map().cast(ATTRS)

    def pick(prop: Column, a: Column, b: Column) -> Column:
        merged = F.when(prop == "ind", merge_indent(F.coalesce(a, empty), b)).otherwise(
            F.when(prop.isin("rFonts", "spacing") & a.isNotNull(), override(a, b)).otherwise(b)
        )
        return F.when(b.isNull(), a).otherwise(merged)

    return F.map_zip_with(older, newer, pick)


def _ordered(values: dict) -> Column:
    """Map of the attributes that have a value, in the given order."""
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def indent_profile(attrs: Column) -> Column:
    """Indent that reliably overrides list geometry: missing left and hanging
    become an explicit zero."""
    ints = {n: lenient_int(attr(attrs, n)).cast("string") for n in INDENT_ATTRS}
    horizontal = F.coalesce(*[ints[n] for n in ("left", "start", "leftChars", "startChars")])
    hangs = F.coalesce(ints["hanging"], ints["hangingChars"])
    first = (F.coalesce(ints["firstLine"], F.lit("0")) != "0") | (
        F.coalesce(ints["firstLineChars"], F.lit("0")) != "0"
    )
    filled = dict(ints)
    filled["left"] = F.when(horizontal.isNull(), F.lit("0")).otherwise(ints["left"])
    filled["hanging"] = F.when(hangs.isNull() & ~first, F.lit("0")).otherwise(ints["hanging"])
    return F.when(attrs.isNotNull(), _ordered(filled))


def spacing_profile(attrs: Column) -> Column:
    """Valid spacing attributes in schema order; NULL when none is left."""
    values = {}
    for name in SPACING_ATTRS:
        raw = attr(attrs, name)
        if name in SPACING_INT_ATTRS:
            values[name] = lenient_int(raw).cast("string")
        elif name in SPACING_FLAG_ATTRS:
            values[name] = on_off(raw)
        else:
            values[name] = F.when(raw.isin(*LINE_RULES), raw)
    profile = _ordered(values)
    return F.when(attrs.isNotNull() & (F.size(profile) > 0), profile)


def alignment_profile(bag: Column) -> Column:
    value = bag_attr(bag, "jc", "val")
    return F.when(value.isin(*ALIGNMENTS), value)


def signature(attrs: Column) -> Column:
    """Map as text in its own order; a map cannot be a grouping key."""
    return F.array_join(
        F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )


def sorted_signature(attrs: Column) -> Column:
    pairs = F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")


def bag_signature(bag: Column) -> Column:
    """Whole bag as text, properties and attributes in name order."""
    pairs = F.transform(
        F.map_entries(bag),
        lambda e: F.concat(e["key"], F.lit("("), sorted_signature(e["value"]), F.lit(")")),
    )
    return F.array_join(F.array_sort(pairs), " ")


def schema_order(bag: Column, order) -> Column:
    """Property names of a bag in schema order, unknown ones last by name."""
    rank = names(order)
    ranked = F.transform(
        F.map_keys(bag),
        lambda k: F.struct(
            F.when(F.array_contains(rank, k), F.array_position(rank, k))
            .otherwise(F.lit(len(order) + 1))
            .alias("rank"),
            k.alias("name"),
        ),
    )
    return F.transform(F.array_sort(ranked), lambda s: s["name"])


def preview_indents(ind: Column) -> dict:
    """Indents to show: character units beat points, hanging beats first line."""

    def pair(points, chars):
        in_chars = attr(ind, *chars)
        pt = F.when(in_chars.isNull(), F.round(lenient_int(attr(ind, *points)) / F.lit(20.0), 2))
        return pt, F.round(lenient_int(in_chars) / F.lit(100.0), 2)

    left = pair(("start", "left"), ("startChars", "leftChars"))
    right = pair(("end", "right"), ("endChars", "rightChars"))
    first = pair(("firstLine",), ("firstLineChars",))
    hang = pair(("hanging",), ("hangingChars",))

    def live(values):
        return (F.coalesce(values[0], F.lit(0.0)) != 0) | (F.coalesce(values[1], F.lit(0.0)) != 0)

    shown_first = ~live(hang)
    first_given = live(first) | first[0].isNotNull() | first[1].isNotNull()
    shown_hang = live(hang) | ~first_given
    return {
        "left_indent_pt": left[0],
        "left_indent_chars": left[1],
        "right_indent_pt": right[0],
        "right_indent_chars": right[1],
        "first_line_indent_pt": F.when(shown_first, first[0]),
        "first_line_indent_chars": F.when(shown_first, first[1]),
        "hanging_indent_pt": F.when(shown_hang, hang[0]),
        "hanging_indent_chars": F.when(shown_hang, hang[1]),
    }


def plain_table_cell(ppr: Column) -> Column:
    """True when a cell paragraph may take a style without first-line indent."""
    ind = F.try_element_at(ppr, F.lit("ind"))
    chars, twips = lenient_int(attr(ind, "firstLineChars")), lenient_int(attr(ind, "firstLine"))
    small = (
        F.when(has_attr(ind, "firstLineChars"), F.coalesce(chars.isin(0, 200), F.lit(False)))
        .when(has_attr(ind, "firstLine"), twips.isNull() | (twips == 0))
        .otherwise(F.lit(True))
    )
    level = lenient_int(bag_attr(ppr, "outlineLvl", "val"))
    heading = F.coalesce(level.between(0, 8), F.lit(False))
    return ~nonzero(ind, "hanging", "hangingChars") & small & ~has_prop(ppr, "numPr") & ~heading


def clear_cell_indent(ppr: Column, style_indents_two: Column) -> Column:
    """Cell paragraph bag without a two-character first line.

    Returns ``struct(ppr, changed)``.
    """
    ind = F.try_element_at(ppr, F.lit("ind"))
    chars = lenient_int(attr(ind, "firstLineChars"))
    explicit = F.coalesce(chars == 200, F.lit(False))
    other_chars = has_attr(ind, "firstLineChars") & F.coalesce(chars != 0, F.lit(True))
    level = lenient_int(bag_attr(ppr, "outlineLvl", "val"))
    heading = F.coalesce(level.between(0, 8), F.lit(False))
    inherits = (
        F.coalesce(style_indents_two, F.lit(False))
        & ~other_chars
        & ~has_prop(ppr, "numPr")
        & ~heading
    )
    act = ~nonzero(ind, "hanging", "hangingChars") & (explicit | inherits)
    empty = F.create_map().cast(ATTRS)
    zeros = F.create_map(F.lit("firstLineChars"), F.lit("0"), F.lit("firstLine"), F.lit("0"))
    cleared = override(
        F.coalesce(ppr, F.create_map().cast(BAG)),
        F.create_map(F.lit("ind"), override(F.coalesce(ind, empty), zeros)),
    )
    moved = (F.coalesce(attr(ind, "firstLineChars"), F.lit("")) != "0") | (
        F.coalesce(attr(ind, "firstLine"), F.lit("")) != "0"
    )
    return F.struct(F.when(act, cleared).otherwise(ppr).alias("ppr"), (act & moved).alias("changed"))
