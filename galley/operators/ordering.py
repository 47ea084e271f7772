"""Orders and set rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galley.functions.numerals import placeholders
from galley.functions.paths import is_content_part
from galley.functions.text import casefold, style_key
from galley.operators.graph import settled
from galley.registries import BODY_NAMES, FORMAT_ROLES


def format_rank(style_type: Column, outline: Column, name: Column) -> Column:
    """Sort key of a format list: headings by level, body text first among the
    other paragraphs, then character and table styles, each by name."""
    heading = (style_type == "paragraph") & outline.isNotNull()
    group = (
        F.when(heading, 0)
        .when(style_type == "paragraph", 1)
        .when(style_type == "character", 2)
        .otherwise(3)
    )
    normal = F.when(style_key(name).isin(*BODY_NAMES), 0).otherwise(1)
    place = F.when(heading, outline).when(style_type == "paragraph", normal).otherwise(0)
    text = F.when(group == 1, style_key(name)).otherwise(casefold(name))
    return F.struct(group.alias("grp"), place.cast("int").alias("place"), text.alias("text"))


def difference(left: Column, right: Column) -> Column:
    """Sorted elements of one array that the other lacks."""
    return F.array_sort(F.array_except(left, right))


def unknown_names(present: DataFrame, allowed) -> DataFrame:
    """Rows whose name is on no allow-list."""
    return present.filter(~F.col("name").isin(*allowed))


def union_styles(*sets: DataFrame) -> DataFrame:
    """Distinct ``pkg_id, style_id`` over several sets."""
    whole = sets[0].select("pkg_id", "style_id")
    for other in sets[1:]:
        whole = whole.unionByName(other.select("pkg_id", "style_id"))
    return whole.distinct()


def pattern_levels(pattern: Column, level: Column) -> Column:
    """Placeholders of a pattern that are allowed, and those that are not."""
    found = F.array_distinct(placeholders(pattern))
    allowed = F.sequence(F.lit(1), (level + 1).cast("int"))
    return F.struct(
        F.array_intersect(found, allowed).alias("allowed"),
        F.array_except(found, allowed).alias("deeper"),
    )


def exposed(styles: DataFrame, used: DataFrame) -> DataFrame:
    """Styles shown to a user: only the used ones."""
    return styles.join(used.select("pkg_id", "style_id").distinct(), ["pkg_id", "style_id"], "left_semi")


def table_candidate(default_tables: DataFrame, used_tables: DataFrame) -> DataFrame:
    """The one unused table style offered when a package uses no table."""
    return default_tables.join(used_tables.select("pkg_id").distinct(), "pkg_id", "left_anti")


def active_parts(parts: DataFrame, rels: DataFrame, references: DataFrame) -> DataFrame:
    """Stories in use: the body, headers and footers a section refers to, and
    notes and comments.

    ``parts`` has ``pkg_id, part``; ``rels`` ``pkg_id, rel_id, role, part`` of
    the body's internal relationships; ``references`` ``pkg_id, rel_id``.
    """
    framed = rels.filter(F.col("role").isin("header", "footer")).join(
        references.select("pkg_id", "rel_id").distinct(), ["pkg_id", "rel_id"], "left_semi"
    )
    notes = rels.filter(F.col("role").isin("footnotes", "endnotes", "comments"))
    linked = framed.select("pkg_id", "part").unionByName(notes.select("pkg_id", "part")).distinct()
    present = parts.filter(is_content_part(F.col("part")))
    body = present.filter(F.col("part") == "word/document.xml")
    others = present.filter(F.col("part") != "word/document.xml").join(
        linked, ["pkg_id", "part"], "left_semi"
    )
    return body.unionByName(others)


def content_flags(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Revisions, signatures and macros of a package."""
    low = F.lower("name")
    marks = parts.groupBy("pkg_id").agg(
        F.bool_or(low.startswith("_xmlsignatures/")).alias("signed"),
        F.bool_or(low.endswith("vbaproject.bin")).alias("macros"),
    )
    revised = nodes.groupBy("pkg_id").agg(F.bool_or(F.col("kind") == "revision").alias("revised"))
    return marks.join(revised, "pkg_id", "left").fillna(False, ["revised"])


def format_only(rows: DataFrame, tags) -> DataFrame:
    """Rows of format parts without tags or attributes that carry content.

    ``rows`` has ``role, tag, rel_attrs``.
    """
    return rows.filter(
        F.col("role").isin(*FORMAT_ROLES, "settings")
        & ~F.col("tag").isin(*tags)
        & (F.col("rel_attrs") == 0)
    )


def top_one(counts: DataFrame, key: str, best: Column, order: Column) -> DataFrame:
    """The first entry of each key: a minimum, so no group is sorted or gathered."""
    return counts.groupBy(key).agg(F.min_by(best, order).alias("w")).select(key, "w.*")


def capped(rows: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    """The first ``limit`` distinct values of each key, in order, as a list.

    Values are numbered per block of the key first, so a key of any size is cut down
    in many tasks before its few survivors meet.
    """
    distinct = rows.select(key, value).distinct()
    block = Window.partitionBy(key, F.pmod(F.xxhash64(value), F.lit(64))).orderBy(value)
    few = distinct.withColumn("place", F.row_number().over(block)).filter(F.col("place") <= limit)
    return few.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(value)), 1, limit).alias(value))


def ordinals(rows: DataFrame, value: Column, name: str = "part") -> DataFrame:
    """Entries of a list column with their 0-based position."""
    return rows.select("*", F.posexplode(value).alias("pos", name)).withColumn("pos", F.col("pos").cast("bigint"))


def places(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``, the 1-based position in a total order over all rows.

    Rows are dealt into sorted ranges; a range starts where the ones before it end.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_row", inside).join(starts, "_range")
    return placed.withColumn("place", (F.col("_start") + F.col("_row")).cast("bigint")).drop("_range", "_row", "_start")
