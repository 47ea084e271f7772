"""Driver tables as operator inputs.

The same derivation is stated once as SQL expressions that both engines read,
so the Spark inputs and the oracle inputs are the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harness import templates as T

# Columns derived from a line of text, in both engines.
LEN = "length(text)"
LINE_COLUMNS = {
    "part": "CASE WHEN lower(text) LIKE '%license%' THEN 'word/footer1.xml' "
    "WHEN text LIKE '%@%' THEN 'word/comments.xml' ELSE 'word/document.xml' END",
    "style_id": f"CASE WHEN ord = 0 THEN 'H1' WHEN text LIKE '% | %' THEN 'Cell' WHEN {LEN} < 40 THEN 'H2' "
    f"WHEN {LEN} < 60 THEN 'H3' WHEN {LEN} BETWEEN 100 AND 140 THEN NULL ELSE 'Body' END",
    "in_table": "text LIKE '% | %'",
    "plain": "NOT (text LIKE '%@%')",
    "direct_outline": f"CAST(CASE WHEN {LEN} % 29 = 0 THEN 9 WHEN {LEN} % 31 = 0 THEN {LEN} % 4 END AS INT)",
    "num_id": f"CASE WHEN {LEN} % 11 = 0 THEN '0' WHEN {LEN} % 7 = 0 THEN CAST(1 + {LEN} % 5 AS STRING) "
    f"WHEN {LEN} % 23 = 0 THEN 'x1' END",
    "ilvl_raw": f"CASE WHEN {LEN} % 14 = 0 THEN CAST({LEN} % 10 AS STRING) END",
    "ind_left": f"CASE WHEN {LEN} % 3 = 0 THEN CAST({LEN} % 4 * 240 AS STRING) END",
    "ind_chars": f"CASE WHEN {LEN} % 6 = 0 THEN CAST({LEN} % 5 * 100 AS STRING) END",
    "sp_before": f"CASE WHEN {LEN} % 4 = 0 THEN CAST({LEN} % 3 * 120 AS STRING) END",
    "jc": f"CASE WHEN {LEN} % 5 = 1 THEN 'center' WHEN {LEN} % 5 = 2 THEN 'odd' END",
}
# A typed heading number in front of some headings.
TYPED_TEXT = (
    f"CASE WHEN style_id = 'H1' AND {LEN} % 3 = 0 THEN concat('第三章 ', text) "
    f"WHEN style_id = 'H1' AND {LEN} % 3 = 1 THEN concat('2. ', text) "
    f"WHEN style_id = 'H2' AND {LEN} % 4 < 3 THEN concat(CASE WHEN {LEN} % 2 = 0 THEN '3.' ELSE '（1.' END, "
    f"CAST(1 + {LEN} % 4 AS STRING), CASE WHEN {LEN} % 2 = 0 THEN ' ' ELSE '） ' END, text) "
    f"WHEN style_id = 'H3' AND {LEN} % 2 = 0 THEN concat('1.1.', CAST(1 + {LEN} % 3 AS STRING), '、 ', text) "
    "ELSE text END"
)
OUTLINE_TWEAK = "CASE WHEN style_id = 'H3' AND n_chars < 1500 THEN NULL ELSE own_outline END"
PACK_OF_LANG = "CASE lang WHEN 'en' THEN 'atlas' WHEN 'de' THEN 'birch' WHEN 'fr' THEN 'cedar' ELSE 'delta' END"
SECOND_PACK = "CASE lang WHEN 'en' THEN 'delta' WHEN 'de' THEN 'cedar' WHEN 'fr' THEN 'birch' ELSE 'atlas' END"
EVENT_LEVEL = (
    "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 "
    "WHEN 'purchase' THEN 3 ELSE 4 END"
)
EVENT_START = "CAST(1 + length(props) % 3 AS BIGINT)"
EVENT_TYPED = "CASE WHEN event_type = 'signup' AND value > 8 THEN CAST(floor(value) AS BIGINT) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows, columns: str) -> DataFrame:
    return spark.sql(T.values(rows, columns, "spark"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("pkg_id"), "lang", "source", "n_chars", "text"
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    cut = docs(spark, d).select(
        "pkg_id", "lang", "n_chars", F.posexplode(F.split("text", "\n")).alias("ord", "text")
    )
    return cut.withColumn("ord", F.col("ord").cast("bigint"))


def par(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph scalars."""
    return lines(spark, d).select("*", *[F.expr(sql).alias(name) for name, sql in LINE_COLUMNS.items()])


def _bag(entries: dict):
    # Arrays of one or no entry are put together without a function per element: nodes of whole corpora go through here.
    some = lambda test, key, value, kind: F.when(
        test, F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    ).otherwise(F.array().cast(f"array<struct<key:string,value:{kind}>>"))
    pairs = []
    for prop, (present, attrs) in entries.items():
        values = [v.cast("string") for v in attrs.values()]
        items = [some(v.isNotNull(), a, v, "string") for a, v in zip(attrs, values)]
        pairs.append(some(present, prop, F.map_from_entries(F.concat(*items)), "map<string,string>"))
    return F.map_from_entries(F.concat(*pairs))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph rows with their property bag."""
    c = F.col
    some = lambda *names: F.coalesce(*[c(n) for n in names]).isNotNull()
    bag = _bag(
        {
            "pStyle": (some("style_id"), {"val": c("style_id")}),
            "numPr": (some("num_id", "ilvl_raw"), {"numId": c("num_id"), "ilvl": c("ilvl_raw")}),
            "spacing": (some("sp_before"), {"before": c("sp_before")}),
            "ind": (some("ind_left", "ind_chars"), {"left": c("ind_left"), "firstLineChars": c("ind_chars")}),
            "jc": (some("jc"), {"val": c("jc")}),
            "outlineLvl": (some("direct_outline"), {"val": c("direct_outline")}),
        }
    )
    base = par(spark, d).withColumn("bag", bag)
    has = F.size("bag") > 0
    return base.select(
        "pkg_id", "lang", "part", "ord", "style_id", has.alias("has_ppr"), "direct_outline",
        "num_id", "ilvl_raw", F.when(has, c("bag")).alias("ppr"), "in_table", "plain", "text",
    )


def styles(spark: SparkSession, d: str) -> DataFrame:
    """Style sheet of every document: that of its language."""
    sheet = literal(spark, T.sheet_rows(True), T.SHEET_COLUMNS + ", ppr bag, rpr bag")
    return (
        docs(spark, d)
        .select("pkg_id", "lang", "n_chars")
        .join(F.broadcast(sheet), "lang")
        .withColumn("own_outline", F.expr(OUTLINE_TWEAK))
        .drop("lang", "n_chars")
    )


def numbering(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Numbering part of every document; all share one."""
    ids = docs(spark, d).select("pkg_id")

    def every(rows, columns: str) -> DataFrame:
        fields = [c.split() for c in columns.split(",")]
        struct = lambda row: ", ".join(
            f"'{n}', CAST({T.literal(v, 'spark')} AS {t})" for (n, t), v in zip(fields, row)
        )
        fixed = ", ".join(f"named_struct({struct(row)})" for row in rows)
        return ids.selectExpr("pkg_id", f"inline(array({fixed}))")

    place = lambda rows: [(*r, i) for i, r in enumerate(rows)]
    ind = F.map_from_arrays(
        F.array(F.lit("left"), F.lit("hanging")), F.array(F.col("lft").cast("string"), F.col("hanging").cast("string"))
    )
    return {
        "abstracts": every(place(T.ABSTRACTS), "abstract_id string, num_style_link string, nsid string, ord int"),
        "nums": every(place(T.NUMS), "num_id string, abstract_id string, ord int"),
        "levels": every(
            place(T.LEVELS),
            "abstract_id string, ilvl int, start int, num_fmt string, lvl_text string, lvl_restart int, "
            "pstyle string, lft int, hanging int, tab_pos int, ord int",
        )
        .withColumn("ind", ind)
        .withColumn("fonts", F.lit(None).cast("map<string,string>"))
        .drop("lft", "hanging"),
        "overrides": every(
            place(T.OVERRIDES),
            "num_id string, ilvl int, start_override int, has_lvl boolean, start int, num_fmt string, "
            "lvl_text string, lvl_restart int, ord int",
        ),
    }


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requested pairs: every document asks for one pack, labelled ones for two."""
    base = docs(spark, d).select("pkg_id", "lang")
    first = base.select("pkg_id", F.expr(PACK_OF_LANG).alias("pack_id"))
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("pkg_id")).distinct()
    second = base.join(labelled, "pkg_id", "left_semi").select(
        "pkg_id", F.expr(SECOND_PACK).alias("pack_id")
    )
    return first.unionByName(second)


def pack_styles(spark: SparkSession) -> DataFrame:
    rows = []
    seen: dict[str, int] = {}
    for pack, sid, kind, name, aliases, level, default, two in T.PACK_STYLES:
        ord_ = seen[pack] = seen.get(pack, -1) + 1
        ppr = {"ind": {"firstLineChars": "200"}} if two else {}
        rows.append((pack, ord_, sid, kind, name, aliases, None, level, default, ppr, {}))
    return literal(
        spark, rows, T.SHEET_COLUMNS.replace("lang", "pkg_id", 1) + ", ppr bag, rpr bag"
    )


def pack_authority(spark: SparkSession) -> DataFrame:
    return literal(spark, T.PACK_AUTHORITY, "pkg_id string, level int, style_id string")


def pack_rules(spark: SparkSession) -> DataFrame:
    levels = {(p, s): lv for p, s, _, _, _, lv, _, _ in T.PACK_STYLES}
    rows = [(*r, levels.get(r[:2])) for r in T.PACK_RULES]
    flat = literal(
        spark, rows, "pack_id string, style_id string, num_id string, level int, level_text string, start int, outline int"
    )
    rule = F.struct(
        "num_id", "level", F.lit("decimal").alias("number_format"), "level_text", "start"
    )
    return flat.select("pack_id", "style_id", "outline", rule.alias("rule"))


def pack_profiles(spark: SparkSession) -> DataFrame:
    flat = literal(spark, T.PACK_PROFILES, "pack_id string, style_id string, i string, s string, jc string")
    as_map = lambda c: F.when(F.col(c).isNotNull(), F.str_to_map(F.col(c), F.lit(";"), F.lit("=")))
    return flat.select("pack_id", "style_id", as_map("i").alias("ind"), as_map("s").alias("spacing"), "jc")


def pack_lists(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(concrete lists, effective levels) of the packs."""
    from galley.operators import numbering

    place = lambda rows: [(*r, i) for i, r in enumerate(rows)]
    nums = literal(spark, place(T.PACK_NUMS), "pkg_id string, num_id string, abstract_id string, ord int")
    abstracts = literal(spark, place(T.PACK_ABSTRACTS), "pkg_id string, abstract_id string, ord int").withColumn("num_style_link", F.lit(None).cast("string"))
    levels = literal(
        spark, place(T.PACK_LEVELS),
        "pkg_id string, abstract_id string, ilvl int, start int, num_fmt string, lvl_text string, lft int, hanging int, tab_pos int, ord int",
    )
    ind = F.map_from_arrays(F.array(F.lit("left"), F.lit("hanging")), F.array(F.col("lft").cast("string"), F.col("hanging").cast("string")))
    none = lambda t: F.lit(None).cast(t)
    levels = levels.withColumns({"ind": ind, "fonts": none("map<string,string>"), "pstyle": none("string"), "lvl_restart": none("int")})
    over = literal(spark, T.OVERRIDES[:1], "num_id string, ilvl int, start_override int, has_lvl boolean, start int, num_fmt string, lvl_text string, lvl_restart int")
    over = over.withColumns({"pkg_id": F.lit(""), "ord": F.lit(0)}).filter("pkg_id <> ''")
    concrete = numbering.concrete_lists(nums, abstracts, pack_styles(spark))
    return nums.drop("ord"), numbering.levels(concrete, levels, over)


def pack_index(spark: SparkSession) -> DataFrame:
    from galley.operators import catalog

    sheet = pack_styles(spark)
    return catalog.index(sheet, catalog.resolve(sheet), pack_authority(spark))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs: the comma-separated pieces of every line."""
    cut = par(spark, d).select(
        "pkg_id", "part", F.col("ord").alias("parent_ord"), F.posexplode(F.split("text", ", ")).alias("ord", "text")
    )
    c = F.col
    styled = cut.withColumn("ord", c("ord").cast("bigint")).withColumn("style_id", F.expr(RUN_STYLE))
    flags = {name: F.expr(sql) for name, sql in RUN_FLAGS.items()}
    bag = _bag(
        {"rStyle": (c("style_id").isNotNull(), {"val": c("style_id")})}
        | {name: (test, {"val": F.lit("1")}) for name, test in flags.items()}
    )
    return styled.withColumn("bag", bag).withColumn("has_bag", F.size("bag") > 0)


RUN_STYLE = (
    f"CASE WHEN {LEN} % 5 = 0 THEN 'Strong' WHEN {LEN} % 7 = 0 THEN 'Quote' WHEN {LEN} % 9 = 0 THEN 'Nowhere' END"
)
RUN_FLAGS = {"b": f"{LEN} % 2 = 0", "lang": f"{LEN} % 3 = 0", "vanish": f"{LEN} % 13 = 0", "u": f"{LEN} % 8 = 3"}
TABLE_STYLE = f"CASE WHEN {LEN} % 2 = 0 THEN 'GridA' WHEN {LEN} % 3 = 0 THEN 'Nowhere' END"
TABLE_FLAGS = {"tblW": f"{LEN} % 2 = 0", "tblBorders": f"{LEN} % 3 = 0", "shd": f"{LEN} % 5 = 0"}
CELL_FLAGS = {"tcW": f"{LEN} % 2 = 1", "vMerge": f"{LEN} % 3 = 0", "shd": f"{LEN} % 4 = 0", "tcBorders": f"{LEN} % 5 = 0"}


def tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables: every line with cell bars is a one-row table."""
    c = F.col
    base = par(spark, d).filter("in_table").select("pkg_id", "part", "ord", "text")
    styled = base.withColumn("style_id", F.expr(TABLE_STYLE))
    bag = _bag(
        {"tblStyle": (c("style_id").isNotNull(), {"val": c("style_id")})}
        | {n: (F.expr(s), {"val": F.lit("1")}) for n, s in TABLE_FLAGS.items()}
    )
    return styled.withColumn("bag", bag).withColumn("has_bag", F.size("bag") > 0)


def cells(spark: SparkSession, d: str) -> DataFrame:
    cut = par(spark, d).filter("in_table").select(
        "pkg_id", "part", F.col("ord").alias("parent_ord"), F.posexplode(F.split("text", r" \| ")).alias("ord", "text")
    )
    bag = _bag({n: (F.expr(s), {"val": F.lit("1")}) for n, s in CELL_FLAGS.items()})
    return cut.withColumn("bag", bag).withColumn("has_bag", F.size("bag") > 0)


SECTION_WIDTH = "CASE WHEN idx % 2 = 0 THEN '11906' ELSE '16838' END"
SECTION_HEIGHT = "CASE WHEN idx % 2 = 0 THEN '16838' ELSE '11906' END"
SECTION_LEFT = "CAST(1800 - 10 * (pkg_id % 3) AS STRING)"
SECTION_COUNT = "CAST(1 + floor(n / 10) AS BIGINT)"


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections: one per ten lines of a document."""
    counted = docs(spark, d).select("pkg_id", "lang", F.size(F.split("text", "\n")).alias("n"))
    return counted.select(
        "pkg_id", "lang", F.explode(F.sequence(F.lit(0), F.expr(SECTION_COUNT).cast("int") - 1)).alias("idx")
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """All content nodes in one table."""
    cols = ["pkg_id", "part", "ord", "parent_ord", "style_id", "has_bag", "bag", "in_table", "text"]
    none = lambda t: F.lit(None).cast(t)
    paras = paragraphs(spark, d).withColumnsRenamed({"has_ppr": "has_bag", "ppr": "bag"}).withColumn("parent_ord", none("bigint"))
    kinds = {
        "paragraph": paras,
        "run": runs(spark, d).withColumn("in_table", F.lit(False)),
        "table": tables(spark, d).withColumns({"parent_ord": none("bigint"), "in_table": F.lit(True)}),
        "cell": cells(spark, d).withColumns({"style_id": none("string"), "in_table": F.lit(True), "ord": F.col("ord").cast("bigint")}),
        "section": sections(spark, d).select(
            "pkg_id", F.lit("word/document.xml").alias("part"), F.col("idx").cast("bigint").alias("ord"),
            none("bigint").alias("parent_ord"), none("string").alias("style_id"), F.lit(True).alias("has_bag"),
            _bag({"pgSz": (F.lit(True), {"w": F.expr(SECTION_WIDTH), "h": F.expr(SECTION_HEIGHT)}), "pgMar": (F.lit(True), {"top": F.lit("1440"), "left": F.expr(SECTION_LEFT)}),
                  "titlePg": (F.col("idx") == 0, {"val": none("string")}), "headerReference": (F.lit(True), {"id": F.lit("r1")})}).alias("bag"), F.lit(False).alias("in_table"), none("string").alias("text"),
        ),
    }
    out = None
    for kind, df in kinds.items():
        rows = df.select(*cols).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def events(spark: SparkSession, d: str) -> DataFrame:
    """Heading rows from events: a user is a package, the type gives the level."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("pkg_id"),
        F.lit("word/document.xml").alias("part"),
        F.col("event_id").alias("ord"),
        F.expr(EVENT_LEVEL).cast("int").alias("level"),
        F.expr(EVENT_START).alias("start"),
        F.expr(EVENT_TYPED).alias("typed"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("pkg_id"), "turn", "role", "text"
    )


def fixed(name: str, rows, columns: str) -> str:
    return T.values(rows, columns, "duck")


def _columns(columns: dict) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


_place = lambda rows: [(*r, i) for i, r in enumerate(rows)]
_pack_rows = []
_seen: dict[str, int] = {}
for _p, _s, _k, _n, _a, _l, _d, _t in T.PACK_STYLES:
    _seen[_p] = _seen.get(_p, -1) + 1
    _pack_rows.append((_p, _seen[_p], _s, _k, _n, _a, _l, _d, _t))
_pack_level = {(r[0], r[2]): r[6] for r in _pack_rows}

NAME_KEY = (
    "replace(translate(lower(regexp_replace(coalesce({0}, ''), '[\\s_\\-–—\\x{{3000}}\\x{{00a0}}]+', '', 'g')), 'ςſ', 'σs'), 'ß', 'ss')"
)


def key(col: str) -> str:
    """Style name key in the oracle dialect."""
    return NAME_KEY.format(col)


# Named subqueries of the oracle: name -> (needs, sql).
CTES: dict[str, tuple[list[str], str]] = {
    "doc": ([], "SELECT doc_id AS pkg_id, lang, source, n_chars, text FROM documents"),
    "line": (
        ["doc"],
        "SELECT pkg_id, lang, n_chars, unnest(string_split(text, chr(10))) AS text, "
        "CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord FROM doc",
    ),
    "par": (["line"], f"SELECT *, {_columns(LINE_COLUMNS)} FROM line"),
    "ppar": (
        ["par"],
        "SELECT *, coalesce(style_id, num_id, ilvl_raw, sp_before, ind_left, ind_chars, jc, "
        "CAST(direct_outline AS VARCHAR)) IS NOT NULL AS has_ppr FROM par",
    ),
    "tpl": ([], fixed("tpl", T.sheet_rows(False), T.SHEET_COLUMNS)),
    "tprop": ([], fixed("tprop", T.prop_rows(), "lang string, style_id string, bag string, prop string, attr string, val string")),
    "sty": (
        ["doc", "tpl"],
        f"SELECT d.pkg_id, d.lang, t.ord, t.style_id, t.style_type, t.name, t.aliases, t.based_on, "
        f"{OUTLINE_TWEAK.replace('style_id', 't.style_id').replace('n_chars', 'd.n_chars').replace('own_outline', 't.own_outline')} AS own_outline, "
        "t.is_default FROM doc d JOIN tpl t ON d.lang = t.lang",
    ),
    # chain by recursion, level 0 is the style itself
    "chain": (
        ["sty"],
        "SELECT pkg_id, lang, style_id, style_id AS cur, 0 AS depth, [style_id] AS path FROM sty "
        "UNION ALL SELECT c.pkg_id, c.lang, c.style_id, p.style_id, c.depth + 1, list_append(c.path, p.style_id) "
        "FROM chain c JOIN sty s ON s.pkg_id = c.pkg_id AND s.style_id = c.cur "
        "JOIN sty p ON p.pkg_id = s.pkg_id AND p.style_id = s.based_on WHERE NOT list_contains(c.path, p.style_id)",
    ),
    "outl": (
        ["chain", "sty"],
        "SELECT c.pkg_id, c.style_id, nullif(arg_min(s.own_outline, c.depth) FILTER (s.own_outline IS NOT NULL), 9) AS outline "
        "FROM chain c JOIN sty s ON s.pkg_id = c.pkg_id AND s.style_id = c.cur GROUP BY ALL",
    ),
    "numpr": (
        ["tprop"],
        "SELECT lang, style_id, max(val) FILTER (attr = 'numId') AS num_id, CAST(max(val) FILTER (attr = 'ilvl') AS INT) AS ilvl "
        "FROM tprop WHERE bag = 'p' AND prop = 'numPr' GROUP BY ALL",
    ),
    "dflt": (
        ["sty"],
        "SELECT * FROM (SELECT pkg_id, style_type, coalesce("
        "arg_min(style_id, ord) FILTER (is_default), "
        f"arg_min(style_id, ord) FILTER ((style_type = 'paragraph' AND ({key('style_id')} IN ('normal', '正文') OR {key('name')} IN ('normal', '正文'))) "
        f"OR (style_type = 'character' AND ({key('style_id')} = 'defaultparagraphfont' OR {key('name')} = 'defaultparagraphfont')) "
        f"OR (style_type = 'table' AND ({key('style_id')} = 'tablenormal' OR {key('name')} = 'tablenormal'))), "
        "CASE WHEN style_type IN ('paragraph', 'character', 'table') THEN arg_min(style_id, ord) END) AS style_id "
        "FROM sty GROUP BY pkg_id, style_type) WHERE style_id IS NOT NULL",
    ),
    # chain per language, with the document defaults at its far end
    "lchain": (
        ["tpl"],
        "SELECT lang, style_id, style_id AS cur, 0 AS depth, [style_id] AS path FROM tpl UNION ALL "
        "SELECT c.lang, c.style_id, p.style_id, c.depth + 1, list_append(c.path, p.style_id) FROM lchain c "
        "JOIN tpl s ON s.lang = c.lang AND s.style_id = c.cur JOIN tpl p ON p.lang = s.lang AND p.style_id = s.based_on "
        "WHERE NOT list_contains(c.path, p.style_id)",
    ),
    "lfull": (
        ["lchain"],
        "SELECT lang, style_id, cur, depth FROM lchain UNION ALL SELECT DISTINCT lang, style_id, '', 1000 FROM lchain",
    ),
    "lprop": (
        ["lfull", "tprop"],
        "SELECT c.lang, c.style_id, c.depth, p.bag, p.prop, p.attr, p.val FROM lfull c JOIN tprop p ON p.lang = c.lang AND p.style_id = c.cur",
    ),
    "lind": (
        ["lprop"],
        "SELECT lang, style_id, depth, attr, val FROM lprop WHERE bag = 'p' AND prop = 'ind' AND attr IS NOT NULL",
    ),
    "indev": (
        ["lind"],
        "SELECT lang, style_id, depth, attr, CASE WHEN attr LIKE '%Chars' AND val = '0' THEN 1 ELSE 0 END AS kill, val FROM lind "
        "UNION ALL SELECT lang, style_id, depth, g.other, 1, NULL FROM lind JOIN (VALUES ('left', 'start'), ('start', 'left'), "
        "('right', 'end'), ('end', 'right'), ('leftChars', 'startChars'), ('startChars', 'leftChars'), "
        "('rightChars', 'endChars'), ('endChars', 'rightChars')) g(a, other) ON attr = g.a "
        "UNION ALL SELECT lang, style_id, depth, unnest(['hanging', 'hangingChars']), 1, NULL FROM lind "
        "WHERE attr = 'firstLine' OR (attr = 'firstLineChars' AND val <> '0') "
        "UNION ALL SELECT lang, style_id, depth, unnest(['firstLine', 'firstLineChars']), 1, NULL FROM lind "
        "WHERE attr = 'hanging' OR (attr = 'hangingChars' AND val <> '0')",
    ),
    # effective attributes of every style
    "lattr": (
        ["lprop", "indev"],
        "SELECT lang, style_id, 'p' AS bag, 'ind' AS prop, attr, val FROM (SELECT * FROM indev QUALIFY row_number() OVER "
        "(PARTITION BY lang, style_id, attr ORDER BY depth, kill) = 1) WHERE kill = 0 "
        "UNION ALL SELECT lang, style_id, bag, prop, attr, arg_min(val, depth) FROM lprop WHERE prop IN ('spacing', 'rFonts') AND attr IS NOT NULL GROUP BY ALL "
        "UNION ALL SELECT lang, style_id, bag, prop, attr, val FROM (SELECT *, min(depth) OVER (PARTITION BY lang, style_id, bag, prop) AS near FROM lprop "
        "WHERE prop NOT IN ('spacing', 'rFonts', 'ind')) WHERE depth = near AND attr IS NOT NULL",
    ),
    "abst": ([], fixed("abst", _place(T.ABSTRACTS), "abstract_id string, num_style_link string, nsid string, ord int")),
    "nums": ([], fixed("nums", _place(T.NUMS), "num_id string, abstract_id string, ord int")),
    "lvls": (
        [],
        fixed(
            "lvls", _place(T.LEVELS),
            "abstract_id string, ilvl int, start int, num_fmt string, lvl_text string, lvl_restart int, pstyle string, "
            "lft int, hanging int, tab_pos int, ord int",
        ),
    ),
    "ovr": (
        [],
        fixed(
            "ovr", _place(T.OVERRIDES),
            "num_id string, ilvl int, start_override int, has_lvl boolean, start int, num_fmt string, lvl_text string, "
            "lvl_restart int, ord int",
        ),
    ),
    # final abstract list of every concrete one, per language
    "proxy": (
        ["nums", "abst", "numpr"],
        "SELECT l.lang, n.num_id, n.num_id AS cur, n.abstract_id AS abs, 0 AS depth, [n.num_id] AS path "
        "FROM (SELECT DISTINCT lang FROM numpr) l, nums n JOIN abst a ON a.abstract_id = n.abstract_id "
        "UNION ALL SELECT p.lang, p.num_id, n.num_id, n.abstract_id, p.depth + 1, list_append(p.path, n.num_id) "
        "FROM proxy p JOIN abst a ON a.abstract_id = p.abs JOIN numpr s ON s.lang = p.lang AND s.style_id = a.num_style_link "
        "JOIN nums n ON n.num_id = s.num_id JOIN abst b ON b.abstract_id = n.abstract_id WHERE NOT list_contains(p.path, n.num_id)",
    ),
    "conc": (["proxy"], "SELECT lang, num_id, arg_max(abs, depth) AS abstract_id FROM proxy GROUP BY ALL"),
    "eff": (
        ["conc", "lvls", "ovr"],
        "SELECT coalesce(b.lang, o.lang) AS lang, coalesce(b.num_id, o.num_id) AS num_id, coalesce(b.ilvl, o.ilvl) AS ilvl, b.ord AS ord, "
        "coalesce(o.start_override, CASE WHEN o.has_lvl THEN o.start END, b.start) AS start, "
        "coalesce(CASE WHEN o.has_lvl THEN o.num_fmt END, b.num_fmt) AS num_fmt, "
        "coalesce(CASE WHEN o.has_lvl THEN o.lvl_text END, b.lvl_text) AS lvl_text, "
        "coalesce(CASE WHEN o.has_lvl THEN o.lvl_restart END, b.lvl_restart) AS lvl_restart, b.pstyle AS pstyle, o.start_override AS start_override, "
        "b.lft AS lft, b.hanging AS hanging, b.tab_pos AS tab_pos "
        "FROM (SELECT c.lang, c.num_id, l.* FROM conc c JOIN lvls l ON l.abstract_id = c.abstract_id) b "
        "FULL JOIN (SELECT c.lang, o.* FROM ovr o JOIN conc c ON c.num_id = o.num_id) o "
        "ON o.lang = b.lang AND o.num_id = b.num_id AND o.ilvl = b.ilvl WHERE b.ord IS NOT NULL OR o.has_lvl",
    ),
    "req": (
        ["doc"],
        f"SELECT pkg_id, {PACK_OF_LANG} AS pack_id FROM doc UNION ALL "
        f"SELECT pkg_id, {SECOND_PACK} AS pack_id FROM doc WHERE pkg_id IN (SELECT doc_id FROM labels)",
    ),
    "psty": (
        [],
        fixed(
            "psty", _pack_rows,
            "pack_id string, ord int, style_id string, style_type string, name string, aliases strings, outline int, "
            "is_default boolean, two boolean",
        ),
    ),
    "pauth": ([], fixed("pauth", T.PACK_AUTHORITY, "pack_id string, level int, style_id string")),
    "prule": (
        [],
        fixed(
            "prule", [(*r, _pack_level.get(r[:2])) for r in T.PACK_RULES],
            "pack_id string, style_id string, num_id string, level int, level_text string, start int, outline int",
        ),
    ),
    "pnum": ([], fixed("pnum", T.PACK_NUMS, "pack_id string, num_id string, abstract_id string")),
    "ptab": ([], fixed("ptab", T.PACK_TABLES, "pack_id string, used_styles strings, preferred string")),
    "play": ([], fixed("play", T.PACK_LAYOUTS, "pack_id string, idx int, width int, height int")),
    "pprof": ([], fixed("pprof", T.PACK_PROFILES, "pack_id string, style_id string, i string, s string, jc string")),
    "pset": ([], fixed("pset", T.PACK_SETTINGS, "pack_id string, tag string, value string")),
    "pname": (
        ["psty"],
        "SELECT pack_id, style_type, k, arg_min(style_id, ord * 100 + pos) AS style_id FROM (SELECT pack_id, style_type, ord, style_id, "
        f"unnest(list_transform(list_concat([style_id, name], aliases), lambda x: {key('x')})) AS k, "
        "generate_subscripts(list_concat([style_id, name], aliases), 1) AS pos FROM psty) WHERE k <> '' GROUP BY ALL",
    ),
    "phead": (
        ["psty"],
        "SELECT pack_id, outline AS level, coalesce(arg_max(style_id, ord) FILTER ("
        f"regexp_matches({key('style_id')}, '^(heading|标题)[1-9]$') OR regexp_matches({key('name')}, '^(heading|标题)[1-9]$')), "
        "arg_min(style_id, ord)) AS style_id FROM psty WHERE style_type = 'paragraph' AND outline IS NOT NULL GROUP BY ALL",
    ),
    "pdflt": (
        ["psty", "pname"],
        "SELECT p.pack_id, p.style_type, coalesce(arg_min(p.style_id, p.ord) FILTER (p.is_default), "
        "max(n.style_id), arg_min(p.style_id, p.ord)) AS style_id FROM psty p LEFT JOIN pname n ON n.pack_id = p.pack_id "
        "AND n.style_type = p.style_type AND n.k = CASE p.style_type WHEN 'paragraph' THEN 'normal' "
        "WHEN 'character' THEN 'defaultparagraphfont' ELSE 'tablenormal' END GROUP BY ALL",
    ),
    "ev": (
        [],
        f"SELECT user_id AS pkg_id, event_id AS ord, {EVENT_LEVEL} AS l, {EVENT_START} AS st, {EVENT_TYPED} AS typed FROM events",
    ),
    "run": (
        ["par"],
        "SELECT *, " + RUN_STYLE + " AS style_id FROM (SELECT pkg_id, part, ord AS parent_ord, unnest(string_split(text, ', ')) AS text, "
        "generate_subscripts(string_split(text, ', '), 1) - 1 AS ord FROM par)",
    ),
    "tbl": (["par"], f"SELECT pkg_id, part, ord, text, {TABLE_STYLE} AS style_id FROM par WHERE in_table"),
    "cell": (
        ["par"],
        "SELECT pkg_id, part, ord AS parent_ord, unnest(string_split(text, ' | ')) AS text FROM par WHERE in_table",
    ),
    "sect": (
        ["doc"],
        f"SELECT pkg_id, lang, unnest(range({SECTION_COUNT})) AS idx FROM (SELECT pkg_id, lang, len(string_split(text, chr(10))) AS n FROM doc)",
    ),
}


def oracle(needs: list[str], body: str) -> str:
    """Full oracle text: the named subqueries it needs, in order, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            if dep not in order:
                visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    parts = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH RECURSIVE {parts}, {body[5:]}"
    return f"WITH RECURSIVE {parts} {body}"
