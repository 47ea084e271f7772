"""The edit log and what its replay makes of packs."""

import random

import pytest
from pyspark.sql import functions as F

from galley.functions.props import BAG, bag_signature
from galley.operators import edits as E
from galley.plans import derive as D
from galley.sources.edit_log import EditLog

NONE = "CAST(NULL AS map<string,string>)"
EDIT = "pack_id string, style_id string, field string, value string, seq int"


@pytest.fixture
def base(spark):
    sheet = spark.sql(
        f"""SELECT pack_id, style_id, style_type, name, CAST(array() AS array<string>) AS aliases, CAST(NULL AS string) AS based_on, outline AS own_outline, false AS is_default, ord,
            CAST(map('ind', map('left', '10', 'hanging', '20')) AS {BAG}) AS ppr, CAST(map() AS {BAG}) AS rpr, CAST(NULL AS {BAG}) AS tpr
            FROM VALUES ('p', 'H', 'paragraph', 'Heading', 0, 0), ('p', 'B', 'paragraph', 'Body', NULL, 1), ('p', 'T', 'table', 'Grid', NULL, 2),
                        ('q', 'H', 'paragraph', 'Heading', 0, 0), ('q', 'B', 'paragraph', 'Body', NULL, 1), ('r', 'B', 'paragraph', 'Body', NULL, 0), ('r', 'B', 'paragraph', 'Body', NULL, 1)
            AS t(pack_id, style_id, style_type, name, outline, ord)"""
    )
    open_ = sheet.filter("style_id IN ('H', 'B')").select("pack_id", "style_id", "style_type", F.col("own_outline").alias("outline")).distinct()
    return D.Base(
        styles=sheet, exposed=open_,
        previous=open_.select("pack_id", "style_id", F.lit(3).cast("bigint").alias("usage_count"), F.lit(False).alias("inferred"), F.lit(False).alias("configured")),
        profiles=spark.sql(f"SELECT 'p' AS pack_id, 'H' AS style_id, map('left', '5') AS ind, {NONE} AS spacing, 'center' AS jc"),
        rules=spark.sql("SELECT 'p' AS pack_id, 'H' AS style_id, named_struct('num_id', '1', 'level', 0, 'number_format', 'decimal', 'level_text', '%1', 'start', 1) AS rule"),
        levels=spark.sql("SELECT 'p' AS pack_id, '1' AS num_id, 0 AS ilvl, 'decimal' AS num_fmt, '%1' AS lvl_text, 1 AS start, CAST(NULL AS int) AS lvl_restart, CAST(NULL AS int) AS start_override"),
        fonts=spark.sql("SELECT 'p' AS pack_id, 'ARIAL' AS name"), candidates=spark.sql("SELECT 'p' AS pack_id, 'T' AS style_id"), names=spark.sql("SELECT 'p' AS pack_id, 'Mine' AS name"),
    )


def requests(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDIT)


def looks(out):
    rows = out.styles.select("pack_id", "style_id", bag_signature(F.col("ppr")), bag_signature(F.col("rpr")), bag_signature(F.col("tpr")), "edited").collect()
    return sorted(map(str, rows))


ROUNDS = [
    [("p", "H", "left_indent_pt", "5"), ("p", "H", "font_latin", "Arial"), ("p", "H", "numbering_start", "4"), ("q", "B", "bold", "true")],
    [("p", "H", "left_indent_chars", "2"), ("p", "H", "first_line_indent_pt", "3"), ("p", "B", "font_latin", "Novel")],
    [("p", "H", "left_indent_pt", "7"), ("p", "H", "hanging_indent_chars", "1"), ("p", "H", "numbering_format", "upperRoman"), ("p", "T", "table_fill_hex", "FF0000")],
]


@pytest.mark.parametrize("snapshots", [(), (1, 2)])
def test_rounds_equal_edits_applied_one_after_the_other(spark, base, tmp_path, snapshots):
    log, sheet = EditLog(spark, str(tmp_path / "log")), base.styles.filter("pack_id <> 'r'")
    for n, rows in enumerate(ROUNDS, 1):
        if n < len(ROUNDS):
            log.append(n, requests(spark, rows))
        else:
            out = D.derive(base, log, n, requests(spark, rows))
            assert out.rejects.count() == 0
        sheet = E.overlay(sheet, requests(spark, rows))
        if n in snapshots:
            log.compact(n)
    want = {(r.pack_id, r.style_id): tuple(r)[2:] for r in sheet.select("pack_id", "style_id", *[bag_signature(F.coalesce(c, F.create_map().cast(BAG))) for c in ("ppr", "rpr", "tpr")]).collect()}
    got = {(r.pack_id, r.style_id): tuple(r)[2:] for r in out.styles.select("pack_id", "style_id", *[bag_signature(F.coalesce(c, F.create_map().cast(BAG))) for c in ("ppr", "rpr", "tpr")]).collect()}
    assert got == want and set(got) == {("p", "H"), ("p", "B"), ("p", "T"), ("q", "H"), ("q", "B")}
    packs = {r.source_pack_id: r for r in out.packs.collect()}
    p = packs["p"]
    assert p.name == "Mine · 自定义" and p.revision == 3 and packs["q"].revision == 1
    assert [(e.style_id, e.fields) for e in p.edited_styles] == [("H", ["hanging_indent_chars", "left_indent_pt", "numbering_format"]), ("T", ["table_fill_hex"])]
    assert [(e.style_id, [tuple(f) for f in e.fields]) for e in p.numbering_user_edits] == [("H", [("numbering_format", "upperRoman"), ("numbering_start", "4")])]
    assert (p.used_style_count, p.custom_style_count, p.defined_style_count, p.hidden_style_count, p.used_table_styles) == (2, 1, 3, 0, ["T"])
    assert [(r.num_fmt, r.start) for r in out.levels.collect()] == [("upperRoman", 4)] and [r.rule.start for r in out.rules.collect()] == [4]
    assert sorted(r.name for r in out.fonts.filter("pack_id = 'p'").collect()) == ["ARIAL", "Novel"]
    (h,) = out.profiles.filter("pack_id = 'p' AND style_id = 'H'").collect()
    assert h.jc == "center" and h.ind["left"] == "140" and h.ind["hangingChars"] == "100"


def test_repeats_and_rejects_change_nothing(spark, base, tmp_path):
    log = EditLog(spark, str(tmp_path / "log"))
    first = D.derive(base, log, 1, requests(spark, ROUNDS[0]))
    again = D.derive(base, log, 1, requests(spark, ROUNDS[0]))
    assert looks(first) == looks(again) and sorted(first.packs.collect()) == sorted(again.packs.collect())
    bad = [("p", "H", "size_pt", "9999"), ("p", "B", "bold", "true"), ("q", "B", "bold", "false"), ("q", "T", "bold", "true"), ("r", "B", "bold", "true")]
    out = D.derive(base, log, 2, requests(spark, bad))
    assert sorted(tuple(r) for r in out.rejects.collect()) == [("p", "H", "range"), ("q", "T", "unknown_style"), ("r", "B", "repeated_style")]
    assert looks(out) == looks(first)


def test_log_compaction_keeps_what_is_in_force(spark, tmp_path):
    rng = random.Random(1)
    log, last = EditLog(spark, str(tmp_path / "log")), {}
    for n in range(1, 7):
        rows = [(rng.choice("pq"), rng.choice("AB"), rng.choice(["bold", "size_pt"]), str(rng.randint(5, 99))) for _ in range(5)]
        log.append(n, requests(spark, rows))
        last |= {r[:3]: r[3] for r in rows}
        if n in (2, 4):
            log.compact(n)
    live = E.latest(log.rows().withColumn("seq", F.struct("revision", "seq"))).collect()
    assert {(r.pack_id, r.style_id, r.field): r.value for r in live} == last
    with pytest.raises(ValueError):
        log.rows(3)
