"""From files to the tables that profiles are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from galley.functions.paths import rel_role, resolve_target
from galley.operators import ordering
from galley.operators.graph import settled
from galley.plans.profile import Corpus
from galley.registries import BODY_PART
from galley.sources import ooxml, packages


def corpus_of(scanned: DataFrame, into: str) -> Corpus:
    """Tables of all packages of a stored scan; files with a fault are left out.

    Every reader starts from the partition of the scan that holds its members, so
    no archive is opened again. A part is parsed once: its rows are stored below
    the folder ``into``, which a repeated run replaces, and everything reads them
    from there.
    """
    spark = scanned.sparkSession
    good = settled(packages.accepted(scanned))

    def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{into}/{name}")
        return spark.read.schema(df.schema).parquet(f"{into}/{name}")

    # Accepted files have no fault, so their members are those with content. Parts that are alike take few bytes but as long to
    # parse as others: they are dealt out by package, since tasks by bytes would leave most of them to one.
    parts = scanned.filter(F.col("fault").isNull() & F.col("content").isNotNull()).drop("fault").join(good, "pkg_id", "left_semi")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda *kinds: parts.filter(F.col("kind").isin(*kinds)).drop("kind").repartition(tasks, "pkg_id")
    rels = stored(ooxml.relationships(of("rels")), "rels")
    roles = settled(ooxml.format_roles(rels))
    lists = ooxml.numbering_tables(stored(ooxml.numbering_rows(ooxml.role_members(of("numbering", "content", "other"), roles, "numbering")), "numbering", "kind"))
    settings = stored(ooxml.settings(of("settings")), "settings")
    return Corpus(
        nodes=stored(ooxml.content(of("content")), "nodes", "kind"),
        styles=stored(ooxml.styles(ooxml.role_members(of("styles", "content", "other"), roles, "styles")), "styles"),
        nums=lists["num"],
        abstracts=lists["abstract"],
        levels=lists["level"],
        overrides=lists["override"],
        theme=stored(ooxml.theme(ooxml.role_members(of("theme", "other"), roles, "theme")), "theme"),
        languages=settings.filter(F.col("tag") == "themeFontLang").select("pkg_id", F.try_element_at("attrs", F.lit("eastAsia")).alias("lang")),
        settings=settings,
        active=settled(active_stories(of("content"), rels)),
    )


def active_stories(contents: DataFrame, rels: DataFrame) -> DataFrame:
    """``pkg_id, part`` of the stories that a package really shows."""
    body = rels.filter(
        (F.col("base_part") == BODY_PART) & (F.coalesce("target_mode", F.lit("Internal")) != "External")
    ).select(
        "pkg_id",
        "rel_id",
        rel_role(F.col("rel_type")).alias("role"),
        resolve_target(F.col("base_part"), F.col("target")).alias("part"),
    )
    present = contents.select("pkg_id", F.col("name").alias("part"))
    return ordering.active_parts(present, body, ooxml.frame_references(contents)).select("pkg_id", "part").distinct()
