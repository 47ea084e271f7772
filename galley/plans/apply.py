"""Rewrite plan: what applying packs to targets would change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from galley.functions.numerals import typed_shape
from galley.functions.props import BAG, dropped, has_prop, keep_only, override
from galley.operators import catalog, counters, lists, mapping, numbering, usage
from galley.operators.graph import settled
from galley.plans.sources import Packs, Sources, sources_of
from galley.registries import BODY_PART, PARAGRAPH_KEEP, RUN_KEEP


def _numbers(numbered: DataFrame, keys: list[str], demotes: bool = True) -> DataFrame:
    """Printed numbers and typed prefixes of numbered paragraphs.

    ``numbered`` has ``shape``, the typed number as it stands in the text, so that no texts are moved. Printed numbers follow the
    rules' levels. A typed number is held against them, but that of a demoted heading against the target's own levels: those are
    counted apart, where any pair ``demotes``.
    """
    moved = F.col("demoted")
    if demotes:
        numbered = settled(numbered)
    printed = counters.fitted_numbers(numbered.withColumn("level", F.col("rule_level"))).drop("shape")
    printed = printed.withColumns({c: F.when(~moved, F.col(c)) for c in ("prefix", "typed")})
    printed = counters.matched_prefixes(counters.heading_counters(printed, keys))
    found = ("level", "matched", "typed", "prefix")
    if not demotes:
        return printed.select(*keys, "ord", "demoted", "value", "path", *found)
    own = counters.fitted_numbers(numbered.filter(moved).withColumn("level", F.col("target_outline"))).drop("shape")
    own = counters.matched_prefixes(counters.heading_counters(own, keys))
    mine = own.select(*keys, "ord", *[F.col(c).alias("own_" + c) for c in found])
    both = printed.join(mine, [*keys, "ord"], "left")
    pick = lambda c: F.when(moved, F.col("own_" + c)).otherwise(F.col(c)).alias(c)
    return both.select(*keys, "ord", "demoted", "value", "path", *[pick(c) for c in found])


def plan_paragraphs(
    paragraphs: DataFrame,
    resolved: DataFrame,
    defaults: DataFrame,
    index: DataFrame,
    rules: DataFrame,
    used: DataFrame,
    tables_used: DataFrame,
    list_map: DataFrame,
    shift: int | Column = 0,
) -> DataFrame:
    """One row per paragraph and pack: new style, number, prefix, list.

    ``rules`` has ``pack_id, style_id, outline, rule``; ``used`` ``pack_id,
    style_id``; ``tables_used`` ``pack_id, used_styles``; ``list_map``
    ``pkg_id, num_id, new_num_id`` and ``pack_id`` where ids depend on it.
    ``shift`` may be a column with one value per package and pack.
    """
    keyed = paragraphs.withColumns(_case(shift))
    answers = _answers(keyed.select("pkg_id", "pack_id", *CASE, "_by").distinct(), resolved, defaults, index, rules, used, tables_used)
    at = [c for c in ("pkg_id", "pack_id", "num_id") if c in list_map.columns]
    ruled = _read(keyed).join(answers, ["pkg_id", "pack_id", *CASE, "_by"]).drop(*CASE)
    return _planned(ruled.join(list_map.select(*at, "new_num_id"), at, "left"), isinstance(shift, Column) or shift > 0).drop("_by")


# Everything that depends on the pack is worked out once per case of a package: style, direct level, own properties, and whether
# the body holds it. Paragraphs meet the answers in one join by package, so a pack that serves all targets is no hot key.
CASE = ("_style", "_direct", "_ppr", "_in_body")
# What a paragraph brings itself; with its package's styles this tells its lists, its level and so its case.
BROUGHT = ("_style", "_direct", "_leveled", "_own_ppr", "_in_body", "_num", "_ilvl")


def _brought() -> dict[str, Column]:
    case = _case()
    return {
        "_style": case["_style"],
        "_direct": case["_direct"],
        "_leveled": F.col("direct_outline").isNotNull(),
        "_own_ppr": case["_ppr"],
        "_in_body": case["_in_body"],
        "_num": F.coalesce("num_id", F.lit("\x00")),
        "_ilvl": F.coalesce("ilvl_raw", F.lit("\x00")),
    }


# What a plan's counts read of properties and texts, taken before any join: a reader of the counts alone moves neither.
READ = ("_level", "_listed", "_gone", "_gone_unleveled", "_shape")


def _read(paragraphs: DataFrame) -> DataFrame:
    ppr, unleveled = F.col("ppr"), F.map_filter("ppr", lambda k, _: k != "outlineLvl")
    return paragraphs.withColumns(
        {
            "_level": has_prop(ppr, "outlineLvl"),
            "_listed": has_prop(ppr, "numPr"),
            "_gone": dropped(ppr, PARAGRAPH_KEEP),
            "_gone_unleveled": dropped(unleveled, PARAGRAPH_KEEP),
            "_shape": F.when(F.col("plain"), typed_shape(F.col("text"))),
        }
    )


def _case(shift: int | Column | None = None) -> dict[str, Column]:
    case = {
        "_style": F.coalesce("style_id", F.lit("\x00")),
        "_direct": F.coalesce("direct_outline", F.lit(-1)).cast("int"),
        "_ppr": F.coalesce("has_ppr", F.lit(False)),
        "_in_body": F.coalesce(F.col("part") == BODY_PART, F.lit(False)),
    }
    return case if shift is None else case | {"_by": F.lit(shift)}


def _answers(
    cases: DataFrame, resolved: DataFrame, defaults: DataFrame, index: DataFrame, rules: DataFrame, used: DataFrame, tables_used: DataFrame
) -> DataFrame:
    """What every case of a package and pack becomes, and the ``fault`` that rejects the pair.

    ``cases`` has the distinct ``pkg_id, pack_id``, the columns of ``CASE`` and ``_by``, the shift.
    """
    asked = cases.withColumns(
        {
            "style_id": F.when(F.col("_style") != "\x00", F.col("_style")),
            "direct_outline": F.when(F.col("_direct") != -1, F.col("_direct")),
            "has_ppr": F.col("_ppr"),
            "part": F.when(F.col("_in_body"), F.lit(BODY_PART)).otherwise(F.lit("")),
        }
    )
    mapped = mapping.map_paragraphs(settled(asked), resolved, defaults, index, F.col("_by"))
    peers = (
        rules.filter("outline IS NOT NULL")
        .groupBy("pack_id", "outline")
        .agg(F.min("style_id").alias("peer"))
        .groupBy("pack_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("outline", "peer"))).alias("peers"))
    )
    moved = mapping.prefer_numbered(mapped, rules, used, peers)
    answers = moved.join(
        rules.select("pack_id", F.col("style_id").alias("mapped"), "rule"), ["pack_id", "mapped"], "left"
    ).join(tables_used.select("pack_id", F.size("used_styles").alias("table_styles")), "pack_id", "left")
    found = ("target_outline", "desired", "mapped", "mapped_outline", "fault", "rule", "table_styles")
    return answers.select("pkg_id", "pack_id", *CASE, "_by", *found)


def _planned(ruled: DataFrame, demotes: bool) -> DataFrame:
    """Plan of paragraphs that have met the answers to their cases.

    ``ruled`` has the columns of ``READ``, the shift as ``_by``, and as ``new_num_id`` the new id of the list it refers to.
    """
    body = F.coalesce(F.col("part") == BODY_PART, F.lit(False))
    ppr, unleveled = F.col("ppr"), F.map_filter("ppr", lambda k, _: k != "outlineLvl")
    ruled = ruled.withColumn("shifted", (F.col("_by") > 0) & body)

    keys = ["pack_id", "pkg_id", "part"]
    numbered = ruled.filter("rule IS NOT NULL").select(
        *keys, "ord", F.col("_shape").alias("shape"), (F.col("shifted") & F.col("target_outline").isNotNull()).alias("demoted"), "target_outline",
        F.col("rule.level").cast("int").alias("rule_level"), F.col("rule.start").alias("start"),
    )
    counted = _numbers(numbered, keys, demotes)
    matched, consumed = F.col("matched"), F.col("prefix.consumed")
    stripped = F.when(matched, F.substring("text", consumed + 1, F.length("text"))).otherwise(F.col("text"))

    kept_table = F.col("in_table") & (F.coalesce("table_styles", F.lit(0)) == 0)
    pinned = F.coalesce(
        F.col("mapped").isNotNull()
        & F.col("target_outline").isNotNull()
        & (F.col("mapped_outline") == F.col("desired"))
        & F.col("_level"),
        F.lit(False),
    )
    without_level = F.when(pinned, unleveled).otherwise(ppr)
    removed = F.when(pinned, 1).otherwise(0) + F.when(kept_table, 0).when(pinned, F.col("_gone_unleveled")).otherwise(F.col("_gone"))
    style = F.create_map(F.lit("pStyle"), F.create_map(F.lit("val"), F.col("mapped")))
    styled = F.when(F.col("mapped").isNotNull(), override(without_level, style)).otherwise(without_level)
    # What is written: the kept properties, explicit body text, and the list of the rule or of the target.
    kept = F.when(kept_table, styled).otherwise(keep_only(styled, PARAGRAPH_KEEP))
    plain_level = F.create_map(F.lit("outlineLvl"), F.create_map(F.lit("val"), F.lit("9")))
    kept = F.when(F.col("direct_outline") == 9, override(kept, plain_level)).otherwise(kept)
    old_list = F.try_element_at("ppr", F.lit("numPr"))
    listed = F.when(
        F.col("rule").isNotNull(), F.create_map(F.lit("ilvl"), F.col("rule.level").cast("string"), F.lit("numId"), F.col("new_num_id"))
    ).when(F.col("new_num_id").isNotNull() & old_list.isNotNull(), override(old_list, F.create_map(F.lit("numId"), F.col("new_num_id"))))
    unlisted = F.map_filter("kept", lambda k, _: k != "numPr")
    # Lists are settled before the numbers come: a reader of the paragraphs in a list moves no others.
    new_list = F.when(F.col("rule").isNotNull(), F.col("rule.num_id")).when(F.col("target_outline").isNull(), F.col("new_num_id"))
    return (
        ruled.withColumn("new_num_id", new_list)
        .join(counted, [*keys, "ord"], "left")
        .withColumn("properties_removed", removed)
        .withColumn("stripped", F.when(F.col("rule").isNotNull(), stripped))
        .withColumn("kept", kept)
        .withColumn("listed", listed)
        .withColumn("ppr", F.when(F.col("listed").isNotNull(), override(unlisted, F.create_map(F.lit("numPr"), F.col("listed")))).otherwise(unlisted))
        .drop("kept", "listed", *READ)
        .withColumn("restyled", F.coalesce(F.col("mapped") != F.col("style_id"), F.col("mapped").isNotNull()))
        .withColumn("kept_table", kept_table)
    )


def plan_properties(
    plan: DataFrame, index: DataFrame, profiles: DataFrame, two_char: DataFrame, wrappers: DataFrame
) -> DataFrame:
    """Paragraph plan with saved heading overrides and cleared cell indents.

    Adds ``indent_applied``, ``indent_cleared`` and ``hardened``. ``profiles``,
    ``two_char`` and ``wrappers`` hold styles of the packs.
    """
    usual = index.select("pack_id", F.try_element_at("defaults", F.lit("paragraph")).alias("usual"))
    headed = mapping.heading_overrides(plan, profiles)
    cells = headed.join(usual, "pack_id").withColumn("effective", F.coalesce("mapped", "usual")).drop("usual")
    return mapping.cell_indents(cells, two_char, wrappers)


def plan_runs(runs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Run plan: mapped character style and removed properties.

    ``runs`` may be rows of :func:`alike`, which have ``removed``; ``mapped``
    has ``pkg_id, pack_id, style_id, mapped``.
    """
    counted = runs if "removed" in runs.columns else runs.withColumn("removed", dropped(F.col("bag"), RUN_KEEP))
    return counted.join(mapped, ["pkg_id", "pack_id", "style_id"], "left").withColumn(
        "restyled",
        F.col("style_id").isNotNull() & ~F.col("mapped").eqNullSafe(F.col("style_id")),
    )


def alike(nodes: DataFrame) -> DataFrame:
    """Runs, tables and cells that count alike in a package, as one row with their number ``n``.

    ``nodes`` has ``kind``; the rest is what ``mapping.strip_properties`` reads. Statistics take these rows for the nodes
    themselves: only sums of a package meet its packs.
    """
    return mapping.strip_properties(nodes).groupBy("pkg_id", "kind", "style_id", "removed").agg(F.count(F.lit(1)).alias("n"))


def _counts(kind: str) -> dict[str, Column]:
    """Counters of a transfer by the plan table whose rows they count: facts and numbers."""
    c, table = F.col, F.col("kind") == "table"
    return {
        "paragraphs": {
            "paragraphs_seen": F.lit(True),
            "heading_numbers_applied": c("rule").isNotNull(),
            "heading_prefixes_removed": c("matched"),
            "styles_remapped": c("restyled"),
            "heading_indents_applied": c("indent_applied"),
            "table_paragraph_indents_cleared": c("indent_cleared"),
            "table_paragraph_styles_hardened": c("hardened"),
            "body_list_paragraphs_preserved": c("rule").isNull() & (c("new_num_id") != "0"),
            "style_list_paragraphs_materialized": c("list_given"),
            "heading_levels_demoted": c("shifted") & (c("target_outline") < 8) & (c("mapped_outline") == c("desired")),
            "heading_level9_unchanged": c("shifted") & (c("target_outline") >= 8) & c("mapped").isNotNull(),
            "paragraph_properties_removed": c("properties_removed"),
        },
        "runs": {"runs_seen": F.lit(True), "run_properties_removed": c("removed"), "styles_remapped": c("restyled")},
        "tables": {
            "tables_seen": table,
            "table_formats_preserved": table & c("preserved"),
            "table_properties_removed": F.when(~c("preserved"), c("removed")),
            "styles_remapped": table & c("restyled"),
        },
    }[kind]


def _counted(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One row per package and pack with the sums of some counters; facts count 1, or ``n`` where rows have it."""
    kinds = dict(df.select(*[e.alias(n) for n, e in counts.items()]).dtypes)
    times = F.col("n") if "n" in df.columns else F.lit(1)
    number = {n: F.when(e, times) if kinds[n] == "boolean" else e * times for n, e in counts.items()}
    return df.groupBy("pkg_id", "pack_id").agg(*[F.sum(e).cast("bigint").alias(n) for n, e in number.items()])


def statistics(
    pairs: DataFrame,
    parts: DataFrame,
    paragraphs: DataFrame,
    runs: DataFrame,
    tables: DataFrame,
    sections: DataFrame,
    settings: DataFrame,
    imported: DataFrame | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Transfer statistics per target and pack from the plan rows.

    ``pairs`` has every requested ``pkg_id, pack_id``, so a target without
    paragraphs has its row too; ``parts`` has the content parts (``pkg_id,
    part``); ``sections`` the rows of ``mapping.section_layouts``, none where the
    pack has no layouts or the target keeps its own; ``runs`` and ``tables`` may
    be planned from rows of :func:`alike`; ``imported`` has the rows of
    ``lists.fresh_lists`` and ``starts`` ``pkg_id, pack_id, seed``. Every table
    is added up by itself first, and the sums meet in one more aggregation.
    """
    keys = ["pkg_id", "pack_id"]
    wanted = pairs.select(*keys).distinct()
    cleaned = wanted.join(parts.groupBy("pkg_id").agg(F.count_distinct("part").alias("content_parts_cleaned")), "pkg_id", "left")
    known = {c: e for c, e in _counts("paragraphs").items() if c != "style_list_paragraphs_materialized" or "list_given" in paragraphs.columns}
    sums = [
        cleaned,
        _counted(paragraphs, known),
        _counted(runs, _counts("runs")),
        _counted(tables, _counts("tables")),
        sections.groupBy(*keys).agg(F.count_distinct("part", "idx").alias("sections_updated")),
        _counted(settings, {"settings_items_imported": F.col("origin") == "source"}),
    ]
    if imported is not None:
        real = imported.filter("new_num_id <> '0'")
        definitions = real.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("target_numbering_definitions_imported"),
            F.count_distinct("new_abstract_id").alias("target_numbering_abstracts_imported"),
        )
        sums.append(definitions)
    if starts is not None:
        sums.append(starts.select(*keys, F.col("seed").alias("heading_numbering_start")))
    whole = sums[0]
    for other in sums[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    names = [c for c in whole.columns if c not in keys]
    empty = lambda c: F.sum(c) if c == "heading_numbering_start" else F.coalesce(F.sum(c), F.lit(0))
    added = whole.groupBy(*keys).agg(*[empty(c).cast("bigint").alias(c) for c in names])
    return added.join(wanted, keys, "left_semi")


def list_plan(paragraphs: DataFrame, concrete: DataFrame, source_lists: DataFrame) -> DataFrame:
    """New list ids for the body lists of every target.

    ``paragraphs`` has ``level, num_id``; ``concrete`` the target's lists;
    ``source_lists`` ``pkg_id, max_num, abstract_ids``.
    """
    wanted = lists.referenced_lists(paragraphs).join(concrete, ["pkg_id", "num_id"], "left")
    return lists.fresh_lists(wanted, source_lists)


@dataclass(frozen=True)
class Targets:
    """Content tables of the packages to be rewritten, as the readers give them.

    ``boxes`` are nodes of kind table, row and cell; ``levels`` the levels of
    abstract lists; ``settings`` has ``pkg_id, tag, value``.
    """

    paragraphs: DataFrame
    runs: DataFrame
    boxes: DataFrame
    sections: DataFrame
    settings: DataFrame
    parts: DataFrame
    styles: DataFrame
    nums: DataFrame
    abstracts: DataFrame
    levels: DataFrame


_PAIR = ("pkg_id", "pack_id")


@dataclass(frozen=True)
class _Transfer:
    """The steps of :func:`apply` by source (see :class:`Sources`), each worked out when it is asked for."""

    requested: DataFrame
    targets: Targets
    packs: Packs

    @cached_property
    def resolved(self) -> DataFrame:
        """What references and mappings read of a style."""
        found = catalog.resolve(self.targets.styles, False)
        return settled(found.select("pkg_id", "style_id", "name", "aliases", "outline", "list_num_id", "list_ilvl", "list_from_style"))

    @cached_property
    def defaults(self) -> DataFrame:
        return settled(catalog.default_styles(self.targets.styles))

    @cached_property
    def cases(self) -> DataFrame:
        """What levels, lists and styles depend on, once per package: a few rows, read instead of the paragraphs.

        Inherited lists become their own here: ``num_id`` is the list, ``given`` the property that a paragraph gets.
        """
        seen = self.targets.paragraphs.select("pkg_id", *[e.alias(n) for n, e in _brought().items()]).distinct()
        text = lambda c: F.when(F.col(c) != "\x00", F.col(c))
        asked = seen.withColumns(
            {
                "style_id": text("_style"), "num_id": text("_num"), "ilvl_raw": text("_ilvl"),
                "direct_outline": F.when(F.col("_leveled"), F.col("_direct")), "has_ppr": F.col("_own_ppr"), "ppr": F.lit(None).cast(BAG),
            }
        )
        direct = F.col("direct_outline")
        read = lists.effective_reference(asked, self.resolved, self.defaults)
        rows = lists.materialized(read.withColumn("level", F.when(direct.isNotNull(), F.when(direct <= 8, direct)).otherwise(F.col("outline"))))
        return settled(rows.select("pkg_id", *BROUGHT, F.col("has_ppr").alias("_ppr"), "level", "num_id", F.col("ppr").alias("given"), "list_given"))

    @cached_property
    def sources(self) -> tuple[DataFrame, DataFrame, Sources]:
        body = self.cases.withColumn("part", F.when(F.col("_in_body"), F.lit(BODY_PART)))
        return sources_of(self.requested, _body_levels(body), self.packs)

    @property
    def asked(self) -> DataFrame:
        return self.sources[0]

    @property
    def found(self) -> Sources:
        return self.sources[2]

    @cached_property
    def answers(self) -> DataFrame:
        shifts = self.asked.select(*_PAIR, F.col("demote").cast("int").alias("_by"))
        cases, found = self.cases.select("pkg_id", *CASE).distinct().join(shifts, "pkg_id"), self.found
        return settled(_answers(cases, self.resolved, self.defaults, found.index, found.rules, found.used, found.tables))

    @cached_property
    def faults(self) -> DataFrame:
        return settled(self.answers.filter("fault IS NOT NULL").select(*_PAIR, F.col("fault").alias("rule"), F.col("desired").alias("level")).distinct())

    @cached_property
    def rejects(self) -> DataFrame:
        return self.sources[1].unionByName(self.faults.join(self.asked, [*_PAIR], "left_semi"))

    @cached_property
    def good(self) -> DataFrame:
        return settled(self.asked.join(self.faults, [*_PAIR], "left_anti"))

    @property
    def pairs(self) -> DataFrame:
        return self.good.select(*_PAIR)

    @cached_property
    def lists(self) -> DataFrame:
        return settled(_list_rows(self.targets, self.cases, self.good, self.found))

    @cached_property
    def met(self) -> DataFrame:
        """All that the plan of an accepted pair takes from a paragraph's case: answers, and lists under their new ids."""
        pairs = self.good.select(*_PAIR, F.col("demote").cast("int").alias("_by"))
        answers = self.answers.join(pairs, [*_PAIR, "_by"])
        ruled = self.cases.join(answers, ["pkg_id", *CASE])
        return settled(ruled.join(self.lists.select(*_PAIR, "num_id", "new_num_id"), [*_PAIR, "num_id"], "left").drop("_ppr", "level"))

    def _plan(self, paragraphs: DataFrame) -> DataFrame:
        read = paragraphs.withColumns(_brought()).drop("num_id")
        given = F.col("given").isNotNull()
        more = F.when(given & ~F.col("_listed"), 1).otherwise(0)
        ruled = (
            read.join(self.met, ["pkg_id", *BROUGHT])
            .drop(*BROUGHT)
            .withColumns({c: F.col(c) + more for c in ("_gone", "_gone_unleveled")})
            .withColumn("ppr", F.when(given, override(F.coalesce("ppr", F.create_map().cast(BAG)), F.col("given"))).otherwise(F.col("ppr")))
            .withColumn("has_ppr", F.col("has_ppr") | given)
            .drop("given")
        )
        planned = _planned(ruled, True).withColumnRenamed("_by", "shift")
        return plan_properties(planned, self.found.index, self.found.profiles, self.found.two_char, self.found.wrappers)

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Plan of the accepted pairs. It is not settled: who reads few of its columns moves no others."""
        return self._plan(_read(self.targets.paragraphs))

    @cached_property
    def counted(self) -> DataFrame:
        """The plan without texts and properties, for those that count it several times: only cells need their properties for it."""
        slim = _read(self.targets.paragraphs).withColumn("ppr", F.when(F.col("in_table"), F.col("ppr")))
        return settled(self._plan(slim).drop("ppr", "text", "prefix", "stripped", "path"))

    @cached_property
    def seeds(self) -> DataFrame:
        first = counters.seeded_starts(self.counted.filter("rule IS NOT NULL"), [*_PAIR, "demoted"])
        return first.groupBy(*_PAIR).agg(F.min_by("seed", "ord").alias("seed")).filter("seed > 0")

    @cached_property
    def run_styles(self) -> DataFrame:
        refs = self.targets.runs.filter("style_id IS NOT NULL").select("pkg_id", "style_id").distinct().join(self.pairs, "pkg_id")
        return mapping.map_run_styles(refs, self.resolved, self.found.index)

    @cached_property
    def sections(self) -> DataFrame:
        return mapping.section_layouts(self.targets.sections.join(self.good.filter("NOT keep_layout").select(*_PAIR), "pkg_id"), self.found.layouts)

    @property
    def keep(self) -> DataFrame:
        return self.found.tables.select("pack_id", (F.coalesce(F.size("used_styles"), F.lit(0)) == 0).alias("keep"))

    @cached_property
    def settings(self) -> DataFrame:
        settings = self.targets.settings.join(self.pairs, "pkg_id").join(self.keep, "pack_id")
        return mapping.merge_settings(settings, self.found.settings.join(self.keep, "pack_id"), F.col("keep"))


@dataclass(frozen=True)
class Applied:
    """What a transfer writes, by ``pkg_id``, ``pack_id`` and ``demote``; rejected pairs are in ``rejects`` alone.

    A table is worked out for those who read it: rejects cost no plan of paragraphs, and paragraphs no statistics. What several
    tables start from is settled when the first of them is asked for.
    """

    transfer: _Transfer

    @cached_property
    def rejects(self) -> DataFrame:
        return Sources.named(self.transfer.rejects)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return Sources.named(self.transfer.paragraphs)

    @cached_property
    def runs(self) -> DataFrame:
        t = self.transfer
        return Sources.named(plan_runs(t.targets.runs.join(t.pairs, "pkg_id"), t.run_styles))

    @cached_property
    def boxes(self) -> DataFrame:
        t = self.transfer
        return Sources.named(_boxes(mapping.strip_properties(t.targets.boxes), t.resolved, t.good, t.found))

    @cached_property
    def sections(self) -> DataFrame:
        return Sources.named(self.transfer.sections)

    @cached_property
    def settings(self) -> DataFrame:
        return Sources.named(self.transfer.settings)

    @cached_property
    def lists(self) -> DataFrame:
        return Sources.named(self.transfer.lists)

    @cached_property
    def abstracts(self) -> DataFrame:
        t = self.transfer
        return Sources.named(lists.isolate(t.targets.abstracts, t.targets.levels, t.lists)[0])

    @cached_property
    def levels(self) -> DataFrame:
        t = self.transfer
        return Sources.named(lists.isolate(t.targets.abstracts, t.targets.levels, t.lists)[1])

    @cached_property
    def starts(self) -> DataFrame:
        t = self.transfer
        ruled = t.found.rules.select("pack_id", F.col("rule.num_id").alias("num_id")).distinct()
        return Sources.named(t.seeds.join(ruled, "pack_id").select(*_PAIR, "num_id", "seed"))

    @cached_property
    def numbered_styles(self) -> DataFrame:
        return Sources.named(self.transfer.found.numbered_styles)

    @cached_property
    def table_styles(self) -> DataFrame:
        """Packs without table styles keep the target's."""
        t = self.transfer
        source_tables = t.found.styles.filter("style_type = 'table'")
        owned = t.pairs.join(source_tables, "pack_id").withColumn("origin", F.lit("source"))
        brought = t.targets.styles.filter("style_type = 'table' AND ord >= 0").join(t.pairs, "pkg_id").join(t.keep.filter("keep"), "pack_id")
        own_tables = brought.select("pkg_id").distinct()
        table_styles = owned.join(t.keep, "pack_id").join(own_tables.withColumn("has", F.lit(True)), "pkg_id", "left").filter("NOT keep OR has IS NULL")
        columns = [*_PAIR, "style_id", "name", "origin"]
        return Sources.named(table_styles.select(*columns).unionByName(brought.withColumn("origin", F.lit("target")).select(*columns)))

    @cached_property
    def statistics(self) -> DataFrame:
        t = self.transfer
        run_sums = plan_runs(alike(t.targets.runs.withColumn("kind", F.lit("run"))).join(t.pairs, "pkg_id"), t.run_styles)
        box_sums = _boxes(alike(t.targets.boxes), t.resolved, t.good, t.found)
        return Sources.named(statistics(t.good, t.targets.parts, t.counted, run_sums, box_sums, t.sections, t.settings, t.lists, t.seeds))


def _body_levels(rows: DataFrame) -> DataFrame:
    """Distinct heading levels of every package's body."""
    body = rows.filter((F.col("part") == BODY_PART) & F.col("level").isNotNull())
    return body.groupBy("pkg_id").agg(F.collect_set(F.col("level").cast("int")).alias("body_levels"))


def _list_rows(targets: Targets, rows: DataFrame, pairs: DataFrame, packs: Sources) -> DataFrame:
    """New ids of the lists that body paragraphs refer to, per pair.

    A list counts only if what it finally stands for has levels.
    """
    usable = targets.levels.select("pkg_id", "abstract_id").distinct()
    concrete = numbering.concrete_lists(targets.nums, targets.abstracts, targets.styles).join(usable, ["pkg_id", "abstract_id"], "left_semi")
    wanted = lists.referenced_lists(rows).join(concrete, ["pkg_id", "num_id"], "left")
    return lists.fresh_lists(wanted.join(pairs.select("pkg_id", "pack_id"), "pkg_id"), packs.used_ids, ("pkg_id", "pack_id"))


def _boxes(stripped: DataFrame, resolved: DataFrame, pairs: DataFrame, packs: Sources) -> DataFrame:
    """Tables, rows and cells with the tables' new styles; ``stripped`` comes from ``mapping.strip_properties`` or :func:`alike`."""
    keys = ["pkg_id", "pack_id"]
    stripped = stripped.join(pairs.select(*keys), "pkg_id").withColumn("_k", F.coalesce("style_id", F.lit("")))
    refs = stripped.filter("kind = 'table'").select(*keys, F.col("_k").alias("style_id")).distinct()
    styles = mapping.map_table_styles(refs, resolved, packs.index, packs.tables).withColumnRenamed("style_id", "_k").drop("preserved")
    none = packs.tables.select("pack_id", (F.coalesce(F.size("used_styles"), F.lit(0)) == 0).alias("preserved"))
    return (
        stripped.join(none, "pack_id", "left")
        .fillna(True, ["preserved"])
        .join(styles, [*keys, "_k"], "left")
        .withColumn("mapped", F.when((F.col("kind") == "table") & ~F.col("preserved"), F.col("mapped")).otherwise(F.col("style_id")))
        .withColumn("restyled", ~F.col("mapped").eqNullSafe(F.col("style_id")))
        .drop("_k")
    )


def apply(pairs: DataFrame, targets: Targets, packs: Packs) -> Applied:
    """The whole transfer of packs to targets.

    ``pairs`` has ``pkg_id, pack_id, demote, keep_layout``. In the order of a transfer: lists that body paragraphs inherit
    become their own; packs get the deeper headings that a demotion asks for, with their numbering; paragraphs are mapped,
    counted and cleaned; referenced lists are brought in under fresh ids and without links to styles; a typed first number
    sets the start of the pack's heading lists; tables, runs, sections and settings follow. A pair whose headings the pack
    cannot express is rejected as a whole.
    """
    return Applied(_Transfer(pairs, targets, packs))
