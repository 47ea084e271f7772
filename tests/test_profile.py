"""Numbering of generated headings in profiles."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from harness.queries import jobs
from galley.plans import profile as profile_plan


@pytest.fixture(scope="module")
def profiled(spark):
    return profile_plan.profile(jobs.corpus(spark, "/root/testdata/sf0.001"))


def test_generated_levels_carry_the_numbering_on(profiled):
    authority, rules, made = {}, {}, {}
    for r in profiled.authority.collect():
        authority[r.pkg_id, r.level] = r.style_id
    for r in profiled.rules.collect():
        rules[r.pkg_id, r.style_id] = r.rule
    for r in profiled.completed.collect():
        made.setdefault(r.pkg_id, {})[r.level] = r.style_id
    carried = 0
    for pkg, levels in made.items():
        top = [rules.get((pkg, authority.get((pkg, k)))) for k in range(3)]
        path = lambda k: re.compile("[^%]*" + "[^%]+".join(f"%{i + 1}" for i in range(k + 1)) + "[^%]*")
        fits = all(t is not None and t.level == k and path(k).fullmatch(t.level_text or "") for k, t in enumerate(top))
        for level, style in levels.items():
            rule = rules.get((pkg, style))
            if not fits:
                assert rule is None
                continue
            carried += 1
            assert (rule.level, rule.start, rule.level_text) == (level, 1, ".".join(f"%{i + 1}" for i in range(level + 1)))
            # One list for all levels, that no other style has.
            assert {t.num_id for t in top} == {rule.num_id} == {"6"}
    assert carried > 5
    shown = {(r.pkg_id, r.style_id): r for r in profiled.formats.filter("inferred").collect()}
    for pkg, levels in made.items():
        for level, style in levels.items():
            look, rule = shown[pkg, style], rules.get((pkg, style))
            assert look.numbering_pattern == (rule.level_text if rule else None) and look.numbering_restart == (True if rule else None)
            assert look.numbered or rule is None


def varied(spark):
    """The harness's corpus with sheets, lists and themes of some packages of their own, and one package with nothing but nodes."""
    c = jobs.corpus(spark, "/root/testdata/sf0.001")
    n = F.col("pkg_id")
    first = F.col("style_id") == "H1"
    styles = c.styles.withColumn("name", F.when((n % 7 == 0) & first, F.concat(F.lit("Title "), n % 3)).otherwise(F.col("name")))
    styles = styles.withColumn("is_default", F.when(n % 11 == 0, F.col("style_id") == "Body").otherwise(F.col("is_default")))
    levels = c.levels.withColumn("lvl_text", F.when(n % 5 == 0, F.concat("lvl_text", F.lit(")"))).otherwise(F.col("lvl_text")))
    known = lambda df: df.filter(n != 3)
    tables = {k: known(df) for k, df in vars(c).items() if df is not None and k not in ("nodes", "styles", "levels")}
    return replace(c, nodes=c.nodes, styles=known(styles), levels=known(levels), **tables)


def plain(value):
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


def test_packages_of_one_model_get_what_each_gets_alone(spark, monkeypatch):
    def found():
        p = profile_plan.profile(varied(spark))
        return {k: sorted((repr(plain(r)) for r in df.select(*sorted(df.columns)).collect())) for k, df in vars(p).items()}

    shared = found()
    assert 4 < profile_plan.designs(varied(spark)).select("model").distinct().count() < 150
    monkeypatch.setattr(profile_plan, "designs", lambda c: c.styles.select("pkg_id", F.col("pkg_id").cast("string").alias("model")).distinct())
    alone = found()
    assert all(shared.values()) and shared == alone


def test_profiles_read_nodes_once_and_resolve_alike_sheets_once(spark, monkeypatch):
    """Sections, which few nodes are, may be read beside the rest."""
    from galley.operators import catalog

    resolve, sheets, seen = catalog.resolve, [], spark.sparkContext.accumulator(0)

    def resolved(styles, *rest):
        sheets.append(styles.select("pkg_id").distinct().count())
        return resolve(styles, *rest)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(catalog, "resolve", resolved)
    c = jobs.corpus(spark, "/root/testdata/sf0.001")
    rows = c.nodes.count()
    p = profile_plan.profile(replace(c, nodes=c.nodes.mapInArrow(counted, c.nodes.schema)))
    for df in (p.formats, p.summary, p.manual, p.layouts, p.sections, p.preferred):
        df.collect()
    # Four languages, two outlines of a style, two colours and three table styles named in the settings.
    assert len(sheets) == 1 and sheets[0] <= 48
    assert rows <= seen.value <= 2 * rows
