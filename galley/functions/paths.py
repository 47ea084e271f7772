"""Part paths inside a package."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from galley.registries import CONTENT_PART_PATTERN, MAX_NAME_BYTES


def folder(part: Column) -> Column:
    return F.regexp_replace(part, "[^/]*$", "")


def base_name(part: Column) -> Column:
    return F.element_at(F.split(part, "/"), -1)


def rels_path(part: Column) -> Column:
    return F.concat(folder(part), F.lit("_rels/"), base_name(part), F.lit(".rels"))


def _normal(path: Column) -> Column:
    """Collapse empty, "." and ".." segments; leading ".." are kept."""

    def step(stack: Column, seg: Column) -> Column:
        last = F.try_element_at(stack, F.lit(-1))
        can_pop = (F.size(stack) > 0) & (last != "..")
        return (
            F.when(seg.isin("", "."), stack)
            .when((seg == "..") & can_pop, F.slice(stack, 1, F.size(stack) - 1))
            .otherwise(F.array_append(stack, seg))
        )

    stack = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(stack) == 0, F.lit(".")).otherwise(F.array_join(stack, "/"))


def resolve_target(base: Column, target: Column) -> Column:
    """Part a relationship points to; NULL when it leaves the package."""
    joined = F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(
        F.concat(folder(base), target)
    )
    path = _normal(joined)
    return F.when(~((path == "..") | path.startswith("../")), path)


def relative_target(base: Column, part: Column) -> Column:
    """Path of a part as seen from the folder of another part."""
    here = F.filter(F.split(folder(base), "/"), lambda s: s != "")
    there = F.filter(F.split(part, "/"), lambda s: s != "")
    shortest = F.least(F.size(here), F.size(there))
    common = F.aggregate(
        F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))),
        F.lit(0),
        lambda n, i: F.when(
            (n == i - 1) & (i <= shortest) & (F.get(here, i - 1) == F.get(there, i - 1)), i
        ).otherwise(n),
    )
    ups = F.array_repeat(F.lit(".."), F.size(here) - common)
    rest = F.slice(there, common + 1, F.size(there))
    path = F.concat(ups, rest)
    return F.when(F.size(path) == 0, F.lit(".")).otherwise(F.array_join(path, "/"))


def is_content_part(name: Column) -> Column:
    return name.rlike(CONTENT_PART_PATTERN)


def is_xml_part(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(xml|rels)$")


def story(part: Column) -> Column:
    """Story a part belongs to: body, header, footer, notes or comments."""
    name = base_name(part)
    return (
        F.when(part == "word/document.xml", F.lit("body"))
        .when(name.startswith("header"), F.lit("header"))
        .when(name.startswith("footer"), F.lit("footer"))
        .when(name == "footnotes.xml", F.lit("footnote"))
        .when(name == "endnotes.xml", F.lit("endnote"))
        .when(name == "comments.xml", F.lit("comment"))
        .otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    )


def rel_role(rel_type: Column) -> Column:
    """Last path segment of a relationship type."""
    return F.element_at(F.split(F.regexp_replace(rel_type, "/+$", ""), "/"), -1)


def unsafe_name(name: Column) -> Column:
    """Rule a member name breaks, NULL for a safe name."""
    inner = F.regexp_replace(name, "/$", "")
    return (
        F.when(name == "", F.lit("empty_name"))
        .when(F.octet_length(name) > MAX_NAME_BYTES, F.lit("long_name"))
        .when(name.rlike(r"[\x00-\x1f\x7f]"), F.lit("control_character"))
        .when(name.contains("\\"), F.lit("backslash"))
        .when(name.rlike("^(/|[A-Za-z]:)"), F.lit("absolute_path"))
        .when(inner.rlike(r"(^|/)(\.{1,2})?(/|$)"), F.lit("unsafe_path"))
    )
