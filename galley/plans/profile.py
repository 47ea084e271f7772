"""Profile a corpus, and turn profiles into packs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from galley.functions.paths import story
from galley.operators import catalog, completion, numbering, usage
from galley.operators.fonts import style_fonts, theme_colors, theme_fonts
from galley.operators.graph import settled
from galley.operators.preview import previews


@dataclass(frozen=True)
class Corpus:
    """Tables of one set of packages, as the readers give them.

    ``active`` names the stories in use (``pkg_id, part``); without it all content
    parts count.
    """

    nodes: DataFrame
    styles: DataFrame
    nums: DataFrame
    abstracts: DataFrame
    levels: DataFrame
    overrides: DataFrame
    theme: DataFrame
    languages: DataFrame
    settings: DataFrame
    active: DataFrame | None = None


@dataclass(frozen=True)
class Profile:
    """What a corpus really uses, per package."""

    formats: DataFrame
    authority: DataFrame
    rules: DataFrame
    profiles: DataFrame
    summary: DataFrame
    manual: DataFrame
    counters: DataFrame
    completed: DataFrame
    layouts: DataFrame
    sections: DataFrame
    preferred: DataFrame


def designs(c: Corpus) -> DataFrame:
    """``pkg_id, model``: packages whose style sheet, lists, theme, language and default table style are alike share a model.

    A model is a hash over all rows of these tables, in the order of the rows' own hashes.
    """
    of = {
        "styles": c.styles,
        "nums": c.nums,
        "abstracts": c.abstracts.select("pkg_id", "abstract_id", "num_style_link", "ord"),
        "levels": c.levels,
        "overrides": c.overrides,
        "theme": c.theme,
        "languages": c.languages,
        "settings": catalog.named_table_styles(c.settings),
    }
    rows = []
    for name, table in of.items():
        text = F.to_json(F.struct(F.lit(name).alias("table"), *[F.col(k) for k in table.columns if k != "pkg_id"]))
        rows.append(table.select("pkg_id", F.unhex(F.sha2(text, 256)).alias("row")))
    whole = F.to_json(F.array_sort(F.collect_list("row")))
    return reduce(DataFrame.unionByName, rows).groupBy("pkg_id").agg(F.sha2(whole, 256).alias("model"))


def _held(owners: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows of a table of models or cases for every package that holds one."""
    return owners.select("pkg_id", key).join(table.withColumnRenamed("pkg_id", key), key).drop(key)


def _once(owners: DataFrame, key: str):
    """Takes from a table the rows of one package of every model or case, under the key of that."""
    first = settled(owners.groupBy(key).agg(F.min("pkg_id").alias("pkg_id")))
    return lambda table: table.join(first, "pkg_id").withColumn("pkg_id", F.col(key)).drop(key)


def profile(c: Corpus) -> Profile:
    """Used styles with their looks, heading authorities, numbering, overrides
    and counts of every package.

    Nodes are read once, into a tally of those that count alike; the wide style
    tables meet a few rows per package. What hangs on a style sheet and its lists
    alone is worked out once per model, what hangs on the headings and rules
    found beside these once per case. Tables that several steps read are
    checkpointed once: they are computed one time, and the plans built on them
    stay short.
    """
    models = settled(designs(c))
    once = _once(models, "model")
    per_model = lambda table: _held(models, "model", table)
    styles, nums = settled(once(c.styles)), settled(once(c.nums))
    resolved = settled(catalog.resolve(styles))
    defaults = settled(catalog.default_styles(styles))
    usual = settled(per_model(defaults))
    tables = catalog.default_table_style(once(c.settings.filter(F.col("tag") == "defaultTableStyle")), styles)
    nodes = c.nodes if c.active is None else c.nodes.join(c.active, ["pkg_id", "part"], "left_semi")
    sections = settled(nodes.filter(F.col("kind") == "section").select("pkg_id", "kind", "part", "ord", "bag"))
    tallied = settled(usage.tally(nodes)).withColumn("story", story(F.col("part")))
    totals = settled(usage.totals(tallied))

    paragraphs = usage.with_default_style(
        tallied.filter(F.col("kind") == "paragraph"), usual, "paragraph"
    )
    runs = tallied.filter((F.col("kind") == "run") & F.col("style_id").isNotNull())
    drawn = usage.with_default_style(tallied.filter(F.col("kind") == "table"), per_model(tables), "table")
    typed = lambda df, kind: df.select("pkg_id", "story", "style_id", F.lit(kind).alias("style_type"), "n")
    used = settled(
        usage.style_usage(
            typed(paragraphs, "paragraph")
            .unionByName(typed(runs, "character"))
            .unionByName(typed(drawn, "table"))
        )
    )
    of_model = lambda table: table.withColumnRenamed("pkg_id", "model")
    headed = settled(
        used.filter(F.col("style_type") == "paragraph")
        .select("pkg_id", "style_id")
        .join(models, "pkg_id")
        .join(of_model(resolved.filter("outline IS NOT NULL").select("pkg_id", "style_id", "outline")), ["model", "style_id"])
    )
    actual = settled(usage.heading_authority_by_body(used, headed))

    lists = numbering.concrete_lists(nums, once(c.abstracts), styles)
    effective = settled(numbering.levels(lists, once(c.levels), once(c.overrides)))
    own = of_model(numbering.style_rules(resolved, effective).select("pkg_id", "style_id", "rule"))
    carried = headed.join(own, ["model", "style_id"]).select("pkg_id", "style_id", "rule")
    voted = settled(usage.rule_winners(paragraphs, headed, carried, effective).filter("rule IS NOT NULL"))

    # Packages of one model with the same headings and rules are one case.
    listed = lambda df, name, *fields: df.groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    cases = settled(
        models.join(listed(actual, "headings", "level", "style_id"), "pkg_id")
        .join(listed(voted, "rules", "style_id", "rule"), "pkg_id", "left")
        .select("pkg_id", "model", F.sha2(F.to_json(F.struct("model", "headings", "rules")), 256).alias("case"))
    )
    one = _once(cases, "case")
    case_models = settled(cases.select(F.col("case").alias("pkg_id"), "model").distinct())
    in_case = lambda table: _held(case_models, "model", table)
    case_headings, case_rules = settled(one(actual)), settled(one(voted.select("pkg_id", "style_id", "rule")))
    generated = settled(
        completion.complete_levels(
            case_headings, in_case(completion.measures(resolved)), in_case(defaults.filter(F.col("style_type") == "paragraph"))
        )
    )
    made = settled(
        completion.completion_ids(
            generated.select("pkg_id", "level"), in_case(resolved.select("pkg_id", "style_id", "style_type")), in_case(catalog.headings_by_level(resolved))
        )
    )
    inferred = settled(_held(cases, "case", made))
    authority = settled(actual.unionByName(inferred))

    headings = authority.select("pkg_id", "style_id").unionByName(
        voted.select("pkg_id", "style_id")
    ).distinct()
    observed = paragraphs.join(headings, ["pkg_id", "style_id"], "left_semi")
    winners = settled(usage.property_winners(usage.signed(observed)))
    profiles = settled(
        usage.inherit_parent_indent(
            usage.consensus_profiles(winners), winners.select("pkg_id", "style_id").distinct(), inferred, authority
        )
    )

    marks = used.withColumns(
        {"inferred": F.lit(False), "inference_label": F.lit(None).cast("string")}
    ).unionByName(
        inferred.select(
            "pkg_id",
            "style_id",
            F.lit("paragraph").alias("style_type"),
            F.lit(0).cast("bigint").alias("usage_count"),
            F.lit(True).alias("inferred"),
            F.lit("智能补全").alias("inference_label"),
        ),
        allowMissingColumns=True,
    )
    theme = settled(once(c.theme))
    fonts = style_fonts(styles, resolved, theme_fonts(theme, once(c.languages)))
    restarts = effective.select(
        F.col("pkg_id").alias("m"),
        F.col("num_id").alias("n"),
        F.col("ilvl").alias("l"),
        numbering.restarts(F.col("ilvl"), F.col("lvl_restart")).alias("restart"),
    )
    restarting = case_rules.join(case_models, "pkg_id").join(
        restarts, (F.col("model") == F.col("m")) & (F.col("rule.num_id") == F.col("n")) & (F.col("rule.level") == F.col("l")), "left"
    ).select("pkg_id", "style_id", "restart")
    # Generated headings carry the numbering on, in one list with the levels above them.
    number = F.col("num_id").try_cast("bigint")
    next_ids = nums.groupBy("pkg_id").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"))
    merged = completion.merge_numbering(case_rules, case_headings, made, in_case(effective), in_case(next_ids))
    ruled = settled(
        merged.join(restarting, ["pkg_id", "style_id"], "left").withColumn(
            "restart", F.when(F.col("made"), F.lit(True)).otherwise(F.col("restart"))
        )
    )
    rules = settled(_held(cases, "case", ruled.drop("made")))
    formats = previews(marks, models, resolved, fonts, theme_colors(theme), rules, profiles)
    common = usage.preferred_tables(
        usage.used_tables(drawn, per_model(resolved.filter(F.col("style_type") == "table").select("pkg_id", "style_id", "style_type")))
    ).select("pkg_id", "common_style")
    usual_tables = usual.filter(F.col("style_type") == "table").select("pkg_id", F.col("style_id").alias("usual"))
    defined = styles.filter(F.col("ord") >= 0).groupBy("pkg_id").agg(F.count(F.lit(1)).alias("n"))
    return Profile(
        formats=formats,
        authority=authority,
        rules=rules.drop("restart"),
        profiles=profiles,
        summary=totals.select(*[k for k in totals.columns if not k.startswith("manual_")]),
        manual=totals.select("pkg_id", *[F.col("manual_" + k).alias(k) for k in ("paragraphs", "runs", "runs_any")]),
        counters=usage.pack_counters(marks.withColumn("configured", F.lit(False)), per_model(defined)),
        completed=_held(cases, "case", generated.join(made, ["pkg_id", "level"])),
        layouts=usage.page_layouts(sections),
        sections=usage.stored_layouts(sections),
        preferred=common.join(usual_tables, "pkg_id", "full").select("pkg_id", F.coalesce("common_style", "usual").alias("preferred_table_style")),
    )
