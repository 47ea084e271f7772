"""Packs: create from profiles, import, list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from galley.functions.text import file_stem
from galley.operators import library, numbering, quality
from galley.operators.graph import settled
from galley.plans.profile import Profile
from galley.registries import PACK_PRIVACY, PACK_SCHEMA_VERSION, REQUIRED_PACK_PARTS
from galley.schemas import MANIFEST


def manifests(p: Profile, names: DataFrame) -> DataFrame:
    """Pack manifest of every profiled package: ``pack_id, manifest``.

    ``names`` has ``pkg_id, pack_id, name, created_at``. Formats, authorities
    and rules of one package are bounded by its style sheet.
    """
    # A preview has exactly the fields, types and order of the stored schema.
    stored = StructType.fromDDL(MANIFEST)["used_formats"].dataType.elementType
    have = set(p.formats.columns)
    fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored]
    formats = p.formats.groupBy("pkg_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", F.struct(*fields).alias("format"))),
            lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0),
        ).alias("sorted"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "table", F.col("style_id")))).alias("used_table_styles"),
        F.array_sort(F.collect_set(F.when(F.col("inferred"), F.col("style_id")))).alias("inferred_heading_styles"),
    )

    def pairs(key: Column, value: Column) -> Column:
        found = F.map_from_entries(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))
        keys = F.array_sort(F.map_keys(found))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(found, k)))

    authority = p.authority.groupBy("pkg_id").agg(
        pairs(F.col("level").cast("string"), F.col("style_id")).alias("heading_authorities")
    )
    rules = p.rules.groupBy("pkg_id").agg(
        pairs(F.col("style_id"), F.col("rule")).alias("heading_numbering")
    )
    profiles = p.profiles.groupBy("pkg_id").agg(
        pairs(F.col("style_id"), F.struct("ind", "spacing", "jc")).alias("heading_paragraph_properties"),
    )
    indents = p.profiles.filter("ind IS NOT NULL").groupBy("pkg_id").agg(pairs(F.col("style_id"), F.col("ind")).alias("heading_paragraph_indents"))
    joined = names
    for part in (formats, authority, rules, profiles, indents, p.sections, p.preferred, p.counters, p.manual.drop("runs_any"), p.layouts):
        clash = {c: f"manual_{c}" for c in ("paragraphs", "runs") if c in part.columns}
        joined = joined.join(part.withColumnsRenamed(clash), "pkg_id", "left")
    joined = joined.join(p.summary, "pkg_id", "left")
    manifest = F.struct(
        F.lit(PACK_SCHEMA_VERSION).alias("schema_version"),
        F.col("pack_id").alias("id"),
        "name",
        "created_at",
        F.transform("sorted", lambda x: x["format"]).alias("used_formats"),
        "used_table_styles",
        "inferred_heading_styles",
        F.coalesce("page_layout", F.lit(None)).alias("page_layout"),
        F.col("used").alias("used_style_count"),
        F.col("inferred").alias("inferred_style_count"),
        F.col("custom").alias("custom_style_count"),
        F.col("defined").alias("defined_style_count"),
        F.col("hidden").alias("hidden_style_count"),
        "heading_authorities",
        "heading_numbering",
        "heading_paragraph_properties",
        "heading_paragraph_indents",
        "section_layouts",
        "preferred_table_style",
        F.lit(None).cast("map<string,map<string,string>>").alias("heading_numbering_user_edits"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in PACK_PRIVACY]), F.array(*[F.lit(v) for v in PACK_PRIVACY.values()])).alias("privacy"),
        F.struct(
            F.col("manual_paragraphs").alias("paragraph_count"), F.col("manual_runs").alias("run_count")
        ).alias("manual_formatting"),
        F.struct(
            F.col("paragraphs").alias("paragraph_count"),
            F.col("runs").alias("run_count"),
            F.col("tables").alias("table_count"),
            F.col("sections").alias("section_count"),
        ).alias("document_summary"),
    )
    return joined.select("pkg_id", "pack_id", "name", "created_at", manifest.alias("manifest"))


def create_packs(described: DataFrame, format_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pack rows and part rows ready to be stored.

    ``described`` has ``pkg_id, pack_id, name``; ``format_parts`` ``pkg_id,
    name, content`` of format parts only.
    """
    # Contents are hashed where they are read: packs need the hashes alone.
    ids = described.select("pkg_id", "pack_id")
    parts = library.part_hashes(format_parts).join(ids, "pkg_id").drop("pkg_id")
    hashes = settled(parts.select("pack_id", "name", "sha256"))
    declared = hashes.groupBy("pack_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("part_sha256")
    )
    packs = (
        described.join(library.fingerprint(hashes), "pack_id", "left")
        .join(declared, "pack_id", "left")
        .withColumn("stem", file_stem(F.col("name")))
    )
    # What the stored parts are goes into the manifest, so that a reader can check them.
    sealed = F.col("manifest").withField("format_part_count", F.coalesce("part_count", F.lit(0)).cast("bigint"))
    sealed = sealed.withField("part_sha256", F.col("part_sha256")).withField("format_fingerprint", F.col("fingerprint"))
    return packs.withColumn("manifest", sealed).drop("part_sha256"), parts


def import_library(incoming: DataFrame, stored: DataFrame, violations: DataFrame) -> DataFrame:
    """Import valid packs; broken ones are reported as rejected."""
    bad = violations.select("pack_id").distinct()
    good = incoming.join(bad, "pack_id", "left_anti")
    decided = library.import_packs(good, stored)
    turned_away = incoming.join(bad, "pack_id", "left_semi").select(
        "seq", "pack_id", "fingerprint", "identity", F.lit("reject").alias("action")
    )
    return decided.unionByName(turned_away, allowMissingColumns=True)


def health(inventory: DataFrame, parts: DataFrame, packs: DataFrame, declared: DataFrame) -> DataFrame:
    """Violations of a whole library: ``pack_id, rule, detail``.

    ``packs`` has declared and computed values, see ``quality.integrity_rules``.
    """
    named = lambda df: df.withColumnRenamed("pkg_id", "pack_id")
    required = F.array(*[F.lit(p) for p in REQUIRED_PACK_PARTS])
    missing = (
        parts.groupBy("pack_id")
        .agg(F.collect_set(F.when(F.col("name").isin(*REQUIRED_PACK_PARTS), F.col("name"))).alias("found"))
        .select(
            "pack_id",
            F.lit("missing_part").alias("rule"),
            F.explode(F.array_except(required, "found")).alias("detail"),
        )
    )
    differences = library.reconcile(declared, parts)
    return (
        named(quality.package_rules(inventory))
        .unionByName(named(quality.pack_limits(inventory)))
        .unionByName(missing)
        .unionByName(quality.integrity_rules(packs, differences))
    )


def rules_of(packs: DataFrame) -> DataFrame:
    """Saved heading rules of packs: ``pkg_id, style_id, num_id, level``."""
    return packs.select(
        F.col("pack_id").alias("pkg_id"), F.explode("manifest.heading_numbering").alias("style_id", "r")
    ).select("pkg_id", "style_id", "r.num_id", "r.level")


def effective_lists(nums: DataFrame, abstracts: DataFrame, styles: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    return numbering.levels(numbering.concrete_lists(nums, abstracts, styles), levels, overrides)
