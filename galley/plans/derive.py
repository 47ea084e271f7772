"""Derive packs: a request's edits go to the log of its pack, and the log is replayed on the pack as it was imported."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from galley.functions.props import bag_signature
from galley.operators import catalog, edits as E, fonts, quality
from galley.operators.graph import settled
from galley.operators.preview import refresh
from galley.registries import MAX_NAME_LENGTH, NUMBERING_FIELDS
from galley.sources.edit_log import EditLog

CUSTOM_SUFFIX = " · 自定义"


@dataclass(frozen=True)
class Base:
    """Packs before any edit, by ``pack_id``.

    ``styles`` has the sheet with bags ``ppr, rpr, tpr``; ``exposed`` the styles open to edits with type and outline; ``previous``
    the used formats with ``usage_count, inferred, configured``; ``profiles`` the saved heading overrides; ``rules`` the heading
    rules; ``levels`` the list levels; ``fonts`` the names in the font table; ``candidates`` a table style that becomes used
    once it is edited; ``names`` the display names.
    """

    styles: DataFrame
    exposed: DataFrame
    previous: DataFrame
    profiles: DataFrame
    rules: DataFrame
    levels: DataFrame
    fonts: DataFrame
    candidates: DataFrame
    names: DataFrame


@dataclass(frozen=True)
class Derived:
    """Packs after the log, and what was turned away; packs without any edit are not derived.

    Revisions are applied to a style one after the other inside its row, so that an edit which takes another's effect away does
    so in the order they came. A table is worked out for those who read it: levels and rejects need no style sheet.
    """

    base: Base
    rows: DataFrame
    rejects: DataFrame

    def _mine(self, df: DataFrame) -> DataFrame:
        return df.join(self.touched.select("pack_id"), "pack_id", "left_semi")

    @cached_property
    def touched(self) -> DataFrame:
        """``pack_id, revision``: derived packs with their last revision."""
        return self.rows.groupBy("pack_id").agg(F.max("revision").alias("revision"))

    @property
    def _ordered(self) -> DataFrame:
        return self.rows.withColumn("seq", F.struct("revision", "seq"))

    @cached_property
    def _waves(self) -> DataFrame:
        return settled(E.history(self.rows))

    @cached_property
    def styles(self) -> DataFrame:
        return settled(E.replay(self._mine(self.base.styles), self._waves))

    def _resolved(self, bags: bool) -> DataFrame:
        return catalog.resolve(self.styles.withColumnRenamed("pack_id", "pkg_id"), bags).withColumnRenamed("pkg_id", "pack_id")

    @cached_property
    def _outlines(self) -> DataFrame:
        return settled(self._resolved(False).select("pack_id", "style_id", "style_type", "outline"))

    @cached_property
    def levels(self) -> DataFrame:
        return E.edit_levels(self._mine(self.base.levels), self.base.rules, self._ordered)

    @cached_property
    def rules(self) -> DataFrame:
        at = self.levels.select("pack_id", "num_id", F.col("ilvl").alias("level"), "num_fmt", "lvl_text", F.coalesce("start_override", "start").alias("first"))
        return (
            self._mine(self.base.rules)
            .withColumns({"num_id": F.col("rule.num_id"), "level": F.col("rule.level")})
            .join(at, ["pack_id", "num_id", "level"], "left")
            .select(
                "pack_id", "style_id",
                F.struct(
                    "num_id", "level", F.coalesce("num_fmt", "rule.number_format").alias("number_format"),
                    F.coalesce("lvl_text", "rule.level_text").alias("level_text"), F.coalesce("first", "rule.start").alias("start"),
                ).alias("rule"),
            )
        )

    @cached_property
    def profiles(self) -> DataFrame:
        headings = self._outlines.filter((F.col("style_type") == "paragraph") & F.col("outline").isNotNull()).select("pack_id", "style_id")
        return E.sync_history(self._mine(self.base.profiles), self._waves, headings)

    @cached_property
    def fonts(self) -> DataFrame:
        added = fonts.missing_font_records(E.latest(self._ordered), self.base.fonts)
        held = self._mine(self.base.fonts).select("pack_id", "name", F.lit(False).alias("added"))
        return held.unionByName(added.select("pack_id", "name", F.lit(True).alias("added")))

    @cached_property
    def _taken(self) -> DataFrame:
        """A table style on offer is used from its first edit on."""
        return self.base.candidates.join(self.rows.select("pack_id", "style_id").distinct(), ["pack_id", "style_id"], "left_semi")

    @cached_property
    def _previous(self) -> DataFrame:
        offered = self._taken.select("pack_id", "style_id", F.lit(0).cast("bigint").alias("usage_count"), F.lit(True).alias("inferred"), F.lit(True).alias("configured"))
        return self._mine(self.base.previous).join(self._taken, ["pack_id", "style_id"], "left_anti").unionByName(offered, allowMissingColumns=True)

    @cached_property
    def previews(self) -> DataFrame:
        return refresh(self._previous, self._resolved(True).select("pack_id", "style_id", "style_type", "outline", "eff_ppr", "eff_rpr"))

    @cached_property
    def packs(self) -> DataFrame:
        return _manifests(self.base, self.rows, self.touched, self.styles, refresh(self._previous, self._outlines), self._taken)


def violations(base: Base, edits: DataFrame) -> DataFrame:
    """``pack_id, style_id, rule`` of edits that cannot be applied: bad values, styles that are not open, repeated style ids."""
    open_ = base.exposed.unionByName(
        base.candidates.select("pack_id", "style_id", F.lit("table").alias("style_type")), allowMissingColumns=True
    ).dropDuplicates(["pack_id", "style_id"])
    outlines = open_.select("pack_id", "style_id", F.col("outline").alias("level"))
    repeated = base.styles.groupBy("pack_id", "style_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = edits.select("pack_id").distinct()
    return (
        quality.edit_rules(edits.join(outlines, ["pack_id", "style_id"], "left"))
        .select("pack_id", "style_id", "rule")
        .unionByName(E.check_targets(edits, open_).select("pack_id", "style_id", "rule"))
        .unionByName(repeated.join(wanted, "pack_id", "left_semi").select("pack_id", "style_id", F.lit("repeated_style").alias("rule")))
        .distinct()
    )


def derive(base: Base, log: EditLog, revision: int, edits: DataFrame) -> Derived:
    """Packs with the edits of one more revision; a pack with any bad edit keeps its state and is in ``rejects``."""
    bad = settled(violations(base, edits))
    log.append(revision, edits.join(bad.select("pack_id").distinct(), "pack_id", "left_anti"))
    return replayed(base, log, revision, bad)


def replayed(base: Base, log: EditLog, revision: int, rejects: DataFrame) -> Derived:
    """Packs as the log up to ``revision`` leaves them."""
    return Derived(base, settled(log.rows(revision)), rejects)


def _manifests(base: Base, rows: DataFrame, touched: DataFrame, sheet: DataFrame, previews: DataFrame, taken: DataFrame) -> DataFrame:
    """One row per derived pack: who it is, what it comes from, and what it counts.

    The id follows from the parent and its edits, so that a repeated job names the same pack. ``numbering_user_edits`` are all
    numbering edits in force, ``edited_styles`` those of the last revision alone.
    """
    last = rows.join(touched, ["pack_id", "revision"])
    fields = last.groupBy("pack_id", "style_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    edited = fields.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("style_id", "fields"))).alias("edited_styles"))
    values = rows.groupBy("pack_id", "style_id", "field").agg(F.max_by("value", F.struct("revision", "seq")).alias("value"))
    pair = F.struct("field", "value")
    numbered = values.groupBy("pack_id", "style_id").agg(F.array_sort(F.collect_list(F.when(F.col("field").isin(*NUMBERING_FIELDS), pair))).alias("number_edits"))
    kept = numbered.filter(F.size("number_edits") > 0).groupBy("pack_id").agg(
        F.array_sort(F.collect_list(F.struct("style_id", F.col("number_edits").alias("fields")))).alias("numbering_user_edits")
    )
    state = values.groupBy("pack_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("style_id", "field", "value")))), 256).alias("state"))
    look = F.concat_ws("\x00", "style_id", bag_signature(F.col("ppr")), bag_signature(F.col("rpr")), bag_signature(F.col("tpr")))
    # One pack's sheet is bounded, and so is this list.
    print_ = sheet.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("defined_style_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce(look, "style_id"))), "\n"), 256).alias("format_fingerprint")
    )
    heading = F.col("inferred") & (F.col("style_type") == "paragraph") & F.col("outline").isNotNull()
    number = lambda test: F.count(F.when(test, F.lit(1)))
    counts = previews.groupBy("pack_id").agg(
        number(~F.col("inferred")).alias("used_style_count"), number(heading).alias("inferred_style_count"),
        number(F.col("configured")).alias("custom_style_count"), F.count(F.lit(1)).alias("shown"),
        F.array_sort(F.collect_set(F.when(heading, F.col("style_id")))).alias("inferred_heading_styles"),
        F.array_sort(F.collect_set(F.when((F.col("style_type") == "table") & ~F.col("inferred"), F.col("style_id")))).alias("used"),
    )
    chosen = taken.groupBy("pack_id").agg(F.min("style_id").alias("chosen"))
    out = touched
    for part in (edited, kept, state, print_, counts, chosen, base.names):
        out = out.join(part, "pack_id", "left")
    name = F.substring(F.concat(F.coalesce("name", F.lit("")), F.lit(CUSTOM_SUFFIX)), 1, MAX_NAME_LENGTH)
    return out.select(
        F.sha2(F.concat_ws("\n", "pack_id", "state"), 256).alias("derived_id"),
        F.col("pack_id").alias("source_pack_id"), "revision", name.alias("name"), "edited_styles", "numbering_user_edits",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used_style_count", "inferred_style_count", "custom_style_count", "defined_style_count")],
        F.greatest(F.lit(0), F.col("defined_style_count") - F.coalesce("shown", F.lit(0))).alias("hidden_style_count"),
        "inferred_heading_styles", F.when(F.col("chosen").isNotNull(), F.array("chosen")).otherwise(F.col("used")).alias("used_table_styles"),
        "format_fingerprint",
    )
