"""Impact report for requested pairs of pack and target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from galley.operators import usage
from galley.operators.quality import infeasible_demotions


def target_facts(nodes: DataFrame, leveled: DataFrame, flags: DataFrame) -> DataFrame:
    """Everything a report needs to know about a target, one row per package.

    Computed once, however many packs ask for it.
    """
    histogram = usage.level_histogram(leveled).groupBy("pkg_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("levels")
    )
    return (
        usage.summary(nodes)
        .join(usage.manual_formatting(nodes).withColumnsRenamed({"paragraphs": "manual_paragraphs", "runs": "manual_runs"}), "pkg_id")
        .join(histogram, "pkg_id", "left")
        .join(flags, "pkg_id", "left")
    )


def pack_facts(packs: DataFrame) -> DataFrame:
    """What a report needs to know about a pack: ``packs`` has ``pack_id,
    pack_sha256, levels, fonts, has_tables, warnings``."""
    return packs.select("pack_id", "pack_sha256", F.col("levels").alias("have"), "fonts", "has_tables", "warnings")


def preflight(requests: DataFrame, targets: DataFrame, packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and rejects of the requested pairs.

    ``requests`` has ``pack_id, pkg_id, demote, keep_layout``. Only requested
    pairs are formed, by two equi-joins on facts that are one row per side.
    """
    levels = F.coalesce(F.map_keys("levels"), F.array().cast("array<int>"))
    joined = requests.join(targets, "pkg_id").join(pack_facts(packs), "pack_id")
    used = joined.select("pkg_id", "pack_id", levels.alias("levels")).filter(F.size("levels") > 0)
    asked = used.join(
        requests.filter("demote").select("pkg_id", "pack_id").distinct(), ["pkg_id", "pack_id"], "left_semi"
    )
    outcome = infeasible_demotions(
        asked, packs.select("pack_id", "levels")
    ).select("pkg_id", "pack_id", "unresolved", F.col("inferred").alias("generated"))
    both = joined.join(outcome, ["pkg_id", "pack_id"], "left").withColumn(
        "blocked", F.coalesce(F.size("unresolved") > 0, F.lit(False)) & F.col("demote")
    )
    counts = F.coalesce("levels", F.create_map().cast("map<int,bigint>"))
    movable = F.aggregate(
        F.map_entries(F.map_filter(counts, lambda k, _: k < 8)),
        F.lit(0).cast("bigint"),
        lambda acc, e: acc + e["value"],
    )
    bottom = F.try_element_at(counts, F.lit(8))
    notes = F.array(
        F.when((F.col("tables") > 0) & ~F.col("has_tables"), F.lit("tables_kept")),
        F.when(F.col("demote") & (bottom > 0), F.lit("level_nine_stays")),
        F.when(F.col("revised"), F.lit("has_revisions")),
        F.when(F.col("signed"), F.lit("has_signature")),
        F.when(F.col("macros"), F.lit("has_macros")),
    )
    warnings = F.array_distinct(
        F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(notes))
    )
    options = F.concat_ws(
        ",", F.when(F.col("demote"), F.lit("demote")), F.when(F.col("keep_layout"), F.lit("keep_layout"))
    )
    report = both.filter(~F.col("blocked")).select(
        "pack_id",
        "pkg_id",
        "paragraphs",
        "runs",
        "tables",
        F.col("all_sections").alias("sections"),
        "characters",
        F.transform(F.map_entries(counts), lambda e: F.struct((e["key"] + 1).alias("level"), e["value"].alias("n"))).alias("heading_levels"),
        F.when(F.col("demote"), movable).otherwise(F.lit(0)).alias("demotions"),
        F.when(F.col("demote"), F.transform("generated", lambda k: k + 1)).alias("generated_levels"),
        F.when(F.col("has_tables"), F.lit("apply_pack_table_style"))
        .otherwise(F.lit("preserve_target_remove_two_character_indent"))
        .alias("table_action"),
        F.when(F.col("keep_layout"), F.lit("preserve_target")).otherwise(F.lit("apply_pack")).alias("page_layout_action"),
        "fonts",
        "manual_paragraphs",
        F.col("runs_any").alias("manual_runs"),
        warnings.alias("warnings"),
        "pack_sha256",
        "target_sha256",
        options.alias("options"),
    )
    rejected = both.filter("blocked").select(
        "pack_id", "pkg_id", F.lit("demotion_not_possible").alias("rule"), "unresolved"
    )
    return report, rejected
