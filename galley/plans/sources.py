"""Packs as the sources of a transfer: what a demotion adds to them.

A demoted heading may need a level that its pack has no heading for. Levels below the third are then carried on from the first
three, up to the deepest one that a target asks for. Each pack and depth that any pair needs is worked out once, as a source of
its own; there are at most ten per pack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.text import style_key
from galley.operators import catalog, completion, numbering
from galley.operators.graph import settled

DEEPEST = 8


@dataclass(frozen=True)
class Packs:
    """Tables of the packs: ``styles`` and ``effective`` (levels of the lists) by ``pkg_id``, the others by ``pack_id``."""

    styles: DataFrame
    authority: DataFrame
    rules: DataFrame
    used: DataFrame
    tables: DataFrame
    profiles: DataFrame
    layouts: DataFrame
    settings: DataFrame
    nums: DataFrame
    effective: DataFrame


@dataclass(frozen=True)
class Sources:
    """The same by source; a source stands in ``pack_id``."""

    index: DataFrame
    styles: DataFrame
    rules: DataFrame
    used: DataFrame
    tables: DataFrame
    profiles: DataFrame
    layouts: DataFrame
    settings: DataFrame
    used_ids: DataFrame
    two_char: DataFrame
    wrappers: DataFrame
    numbered_styles: DataFrame

    @staticmethod
    def named(df: DataFrame) -> DataFrame:
        """Rows with the pack's own name and ``demote`` instead of the source."""
        source = F.col("pack_id")
        return df.withColumns({"demote": source.rlike("#d[0-9]$"), "pack_id": F.regexp_replace(source, "#d?[0-9]$", "")})


def source_id(pack: Column, demote: Column, reach: Column) -> Column:
    return F.concat(pack, F.when(demote, F.lit("#d")).otherwise(F.lit("#")), reach.cast("string"))


def _asked(pairs: DataFrame, body_levels: DataFrame, authority: DataFrame) -> DataFrame:
    """Pairs with ``reach``, the deepest level to be made for them (0 for none), and ``unresolved`` levels."""
    none = F.array().cast("array<int>")
    have = authority.groupBy("pack_id").agg(F.collect_set(F.col("level").cast("int")).alias("have"))
    joined = pairs.distinct().join(body_levels, "pkg_id", "left").join(have, "pack_id", "left")
    have, levels = F.coalesce("have", none), F.coalesce("body_levels", none)
    desired = F.when(F.col("demote"), F.array_distinct(F.transform(levels, lambda x: F.least(F.lit(DEEPEST), x + 1)))).otherwise(none)
    missing = F.array_except(desired, have)
    reach = F.coalesce(F.when(F.array_max(missing) >= completion.TOP_LEVELS, F.array_max(missing)), F.lit(0))
    complete = F.size(F.array_intersect(have, F.array(*[F.lit(k) for k in range(completion.TOP_LEVELS)]))) == completion.TOP_LEVELS
    made = F.when((reach > 0) & complete, F.sequence(F.lit(completion.TOP_LEVELS), F.greatest(reach, F.lit(completion.TOP_LEVELS)))).otherwise(none)
    return joined.select(
        "pkg_id", "pack_id", "demote", "keep_layout", reach.alias("reach"), F.array_sort(F.array_except(missing, made)).alias("unresolved")
    )


def _as_map(df: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    return df.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def _index(sources: DataFrame, index: DataFrame, made: DataFrame) -> DataFrame:
    """Lookups of the packs with the headings made for each source."""
    typed = lambda text: F.concat(F.lit("paragraph:"), style_key(text))
    heading = F.concat(F.lit("heading "), (F.col("level") + 1).cast("string"))
    spelled = made.select("source", "style_id", F.explode(F.array(typed(F.col("style_id")), typed(heading))).alias("name"))
    spelled = spelled.groupBy("source", "name").agg(F.min("style_id").alias("style_id"))
    level = F.col("level").cast("int")
    out = (
        sources.join(index, "pack_id")
        .join(_as_map(made, level, F.col("style_id"), "new_authority"), "source", "left")
        .join(_as_map(made, F.col("style_id"), F.struct(F.lit("paragraph").alias("style_type"), level.alias("outline")), "new_ids"), "source", "left")
        .join(_as_map(spelled, F.col("name"), F.col("style_id"), "new_names"), "source", "left")
    )

    def grown(old: str, new: str, first: str) -> Column:
        """One map from two; keys of both keep the value of ``first``."""
        rest, best = (new, old) if first == old else (old, new)
        free = F.map_filter(rest, lambda k, _: ~F.coalesce(F.map_contains_key(F.col(best), k), F.lit(False)))
        return F.when(F.col(new).isNull(), F.col(old)).when(F.col(old).isNull(), F.col(new)).otherwise(F.map_concat(F.col(best), free))

    return out.select(
        F.col("source").alias("pack_id"), grown("ids", "new_ids", "new_ids").alias("ids"), grown("names", "new_names", "names").alias("names"), "defaults", "headings",
        grown("authority", "new_authority", "authority").alias("authority"),
    )


def _rules(sources: DataFrame, packs: Packs, authority: DataFrame, made: DataFrame, tops: DataFrame) -> DataFrame:
    """Rules of each source: those of its pack, or one list for all levels where it has to be (see ``completion.merge_numbering``)."""
    keyed = lambda df: df.withColumnRenamed("source", "pkg_id")
    own = keyed(sources.select("source", "pack_id").join(packs.rules, "pack_id").drop("pack_id"))
    effective = packs.effective.withColumnRenamed("pkg_id", "pack_id").join(sources.select("source", "pack_id"), "pack_id").drop("pack_id")
    merged = completion.merge_numbering(own, keyed(authority), keyed(made), keyed(effective), keyed(tops).select("pkg_id", F.col("max_num").alias("next_id")))
    outlines = own.select("pkg_id", "style_id", "outline").unionByName(keyed(made).select("pkg_id", "style_id", F.col("level").cast("int").alias("outline"))).distinct()
    return merged.drop("made").join(outlines, ["pkg_id", "style_id"]).withColumnRenamed("pkg_id", "pack_id")


def _list_ids(sources: DataFrame, packs: Packs) -> DataFrame:
    """``source, max_num, abstract_ids``: ids that each pack's own lists take; ``max_num`` counts one list for merged levels."""
    number = F.col("num_id").try_cast("bigint")
    held = packs.nums.groupBy("pack_id").agg(F.max(number).alias("top"), F.collect_set("abstract_id").alias("abstract_ids"))
    return sources.join(held, "pack_id", "left").select("source", (F.coalesce("top", F.lit(0)) + 1).alias("max_num"), "top", "abstract_ids")


def _profiles(sources: DataFrame, packs: Packs, authority: DataFrame, made: DataFrame) -> DataFrame:
    """Saved paragraph properties; a heading that was made takes the indent of the nearest real heading above it."""
    own = sources.select("source", "pack_id").join(packs.profiles, "pack_id").drop("pack_id")
    above = made.select("source", F.col("style_id").alias("made_id"), "level").join(
        authority.select("source", F.col("level").alias("upper"), "style_id"), "source"
    ).filter(F.col("upper") < F.col("level"))
    nearest = above.groupBy("source", "made_id").agg(F.max_by("style_id", "upper").alias("style_id"))
    taken = nearest.join(own.select("source", "style_id", "ind"), ["source", "style_id"]).filter("ind IS NOT NULL")
    new = taken.select("source", F.col("made_id").alias("style_id"), "ind")
    return own.unionByName(new, allowMissingColumns=True).withColumnRenamed("source", "pack_id")


def sources_of(pairs: DataFrame, body_levels: DataFrame, packs: Packs) -> tuple[DataFrame, DataFrame, Sources]:
    """(pairs by source, rejected pairs, sources).

    Pairs come back as ``pkg_id, pack_id`` (the source), ``demote, keep_layout``; those with a level that the pack neither has nor
    allows to be made are rejected with each such level.
    """
    asked = _asked(pairs, body_levels, packs.authority).withColumn("source", source_id(F.col("pack_id"), F.col("demote"), F.col("reach")))
    asked = settled(asked)
    unmet = asked.select(
        "pkg_id", F.col("source").alias("pack_id"), F.lit("level_without_heading").alias("rule"), F.explode("unresolved").alias("level")
    )
    accepted = asked.filter(F.size("unresolved") == 0).select("pkg_id", F.col("source").alias("pack_id"), "demote", "keep_layout")
    sources = settled(asked.select("source", "pack_id", "reach").distinct())

    resolved = settled(catalog.resolve(packs.styles))
    by_pack = packs.authority.withColumnRenamed("pack_id", "pkg_id")
    body = catalog.default_styles(packs.styles).filter("style_type = 'paragraph'")
    missing = completion.complete_levels(by_pack, completion.measures(resolved), body, DEEPEST)
    named = completion.completion_ids(missing.select("pkg_id", "level"), resolved, catalog.headings_by_level(resolved))
    made = named.withColumnRenamed("pkg_id", "pack_id").join(sources, "pack_id").filter(F.col("level") <= F.col("reach"))
    made = settled(made.select("source", "level", "style_id"))
    authority = settled(sources.select("source", "pack_id").join(packs.authority, "pack_id").select("source", F.col("level").cast("int").alias("level"), "style_id"))

    tops = settled(_list_ids(sources, packs))
    rules = settled(_rules(sources, packs, authority, made, tops))
    merged = rules.filter(F.col("rule.num_id").isNotNull()).select(F.col("pack_id").alias("source"), F.col("rule.num_id").alias("num_id"))
    extra = merged.join(tops.select("source", F.col("max_num").cast("string").alias("num_id")), ["source", "num_id"], "left_semi").select("source").distinct()
    # A list made for merged levels takes an id and an abstract list of its own before the target's lists come in.
    abstract_top = F.coalesce(F.array_max(F.transform("abstract_ids", lambda x: x.try_cast("bigint"))), F.lit(0)) + 1
    used_ids = tops.join(extra.withColumn("merged", F.lit(True)), "source", "left").select(
        F.col("source").alias("pack_id"),
        F.when(F.col("merged"), F.col("max_num")).otherwise(F.coalesce("top", F.lit(0))).alias("max_num"),
        F.when(F.col("merged"), F.array_append(F.coalesce("abstract_ids", F.array().cast("array<string>")), abstract_top.cast("string"))).otherwise(F.col("abstract_ids")).alias("abstract_ids"),
    )
    by_source = lambda df: sources.select("source", "pack_id").join(df, "pack_id").drop("pack_id").withColumnRenamed("source", "pack_id")
    of_pack = lambda df: by_source(df.withColumnRenamed("pkg_id", "pack_id"))
    used = by_source(packs.used).unionByName(made.select(F.col("source").alias("pack_id"), "style_id")).distinct()

    refs = of_pack(resolved.filter("style_type = 'paragraph'").select("pkg_id", "style_id", "num_ref.num_id", "num_ref.ilvl"))
    refs = refs.unionByName(made.select(F.col("source").alias("pack_id"), "style_id"), allowMissingColumns=True)
    headings = authority.select("source", "style_id").unionByName(made.select("source", "style_id")).distinct()
    aligned = numbering.align_styles(
        headings.withColumnRenamed("source", "pkg_id"), refs.withColumnRenamed("pack_id", "pkg_id"), rules.withColumnRenamed("pack_id", "pkg_id")
    )
    found = Sources(
        index=settled(_index(sources, catalog.index(packs.styles, resolved, by_pack), made)),
        styles=of_pack(packs.styles.filter("ord >= 0")),
        rules=rules,
        used=used,
        tables=by_source(packs.tables),
        profiles=_profiles(sources, packs, authority, made),
        layouts=by_source(packs.layouts),
        settings=by_source(packs.settings),
        used_ids=used_ids,
        two_char=of_pack(catalog.indents_two_chars(resolved).select("pkg_id", "style_id")),
        wrappers=of_pack(catalog.wrapper_styles(packs.styles, resolved).select("pkg_id", "base_id", "style_id")),
        numbered_styles=aligned.withColumnRenamed("pkg_id", "pack_id"),
    )
    return accepted, unmet, found
