"""Scalar rules and their traps."""

from pyspark.sql import functions as F

from galley.functions import fonts, numerals, paths, props, text, units


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_line_spacing_rounds_like_binary_half_even(spark):
    raws = list(range(1, 3000))
    got = values(spark, [(str(r),) for r in raws], "raw string", units.line_spacing(F.col("raw"), F.lit("auto")))
    assert [g[0] for g in got] == [round(r / 240.0, 2) for r in raws]


def test_style_key(spark):
    got = values(spark, [("Heading　 1_-–",), ("STRAßE",), (None,)], "s string", text.style_key(F.col("s")))
    assert [g[0] for g in got] == ["heading1", "strasse", ""]


def test_casefold_of_every_letter_that_needs_it(spark):
    letters = [x for x in map(chr, range(0x110000)) if x.casefold() != x.lower()]
    assert len(letters) > 250
    rows = [(f"a{x}b", f"a{x}b".casefold()) for x in letters] + [("Straße ﬁnal ΑΣ", "strasse final ας".casefold())]
    got = values(spark, rows, "s string, want string", text.casefold(F.col("s")), F.col("want"))
    assert [g for g in got if g[0] != g[1]] == []


def test_font_keys(spark):
    got = values(spark, [("Ａrial",), ("Café-1",)], "s string", fonts.alias_key(F.col("s")), fonts.strict_key(F.col("s")), fonts.compact_key(F.col("s")))
    assert got == [("arial", "arial", "arial"), ("café-1", "cafe-1", "cafe1")]


def test_han_numbers(spark):
    cases = {"三": 3, "十": 10, "十二": 12, "二十": 20, "一百零五": 105, "两千三百": 2300, "一万": 10000, "一二": 12, "零": None, "甲": None}
    got = values(spark, [(k,) for k in cases], "s string", numerals.han_number(F.col("s")))
    assert [g[0] for g in got] == list(cases.values())


def test_typed_prefixes(spark):
    cases = [
        ("3.1 Scope", 1, (4, [3, 1])), ("（2） x", 0, (4, [2])), ("第三章 绪论", 0, (4, [3])), ("第三章 绪论", 1, None), ("3.14 Pi", 0, None), ("3.1", 1, None), ("1.2、 y", 1, (5, [1, 2])),
    ]
    got = values(spark, [(t, lv) for t, lv, _ in cases], "s string, l int", numerals.typed_prefix(F.col("s"), F.col("l")))
    assert [(g[0].consumed, g[0].numbers) if g[0] else None for g in got] == [c[2] for c in cases]


def test_targets_stay_in_the_package(spark):
    rows = [("word/document.xml", "styles.xml"), ("word/document.xml", "/word/a.xml"), ("word/document.xml", "../../x"), ("word/document.xml", "../docProps/./a.xml")]
    got = values(spark, rows, "b string, t string", paths.resolve_target(F.col("b"), F.col("t")))
    assert [g[0] for g in got] == ["word/styles.xml", "word/a.xml", None, "docProps/a.xml"]


def test_indent_merge_keeps_tombstones(spark):
    m = "map<string,string>"
    rows = [
        ({"hanging": "240", "left": "90"}, {"firstLine": "0"}), ({"firstLineChars": "200", "firstLine": "420"}, {"firstLineChars": "0"}), ({"left": "90"}, {"start": "20"}), ({"firstLine": "5"}, {"hanging": "1", "firstLine": "2"}),
    ]
    got = values(spark, rows, f"a {m}, b {m}", props.merge_indent(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [{"left": "90", "firstLine": "0"}, {"firstLine": "420"}, {"start": "20"}, {"hanging": "1", "firstLine": "2"}]
