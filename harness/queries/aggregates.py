"""Aggregations and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.operators import catalog, fonts, library, numbering, quality, usage
from galley.operators.graph import settled
from harness import adapters as A
from harness.registry import query

# Paragraphs with the default style filled in, and the style's outline.
STYLED = (
    "SELECT p.*, coalesce(p.style_id, d.style_id) AS sid FROM ppar p "
    "LEFT JOIN dflt d ON d.pkg_id = p.pkg_id AND d.style_type = 'paragraph'"
)
HEADED = f"SELECT x.*, o.outline FROM ({STYLED}) x LEFT JOIN outl o ON o.pkg_id = x.pkg_id AND o.style_id = x.sid"
STYLED_NEEDS = ["ppar", "dflt"]
HEADED_NEEDS = ["ppar", "dflt", "outl"]

story = (
    "CASE part WHEN 'word/document.xml' THEN 'body' WHEN 'word/comments.xml' THEN 'comment' ELSE 'footer' END"
)


def sheet_facts(spark, d):
    """(styles with their outlines, default styles), worked out once for all steps that ask for them."""
    sheet = A.styles(spark, d)
    resolved = catalog.resolve(sheet, False).select("pkg_id", "style_id", "style_type", "name", "aliases", "outline")
    return settled(resolved), settled(catalog.default_styles(sheet))


def styled(spark, d, defaults=None):
    defaults = catalog.default_styles(A.styles(spark, d)) if defaults is None else defaults
    return usage.with_default_style(A.paragraphs(spark, d), defaults, "paragraph")


def headed(spark, d):
    resolved = catalog.resolve(A.styles(spark, d), False).select("pkg_id", "style_id", "outline")
    return styled(spark, d).join(resolved, ["pkg_id", "style_id"], "left")


def text_map(c, key="story", value="n"):
    return F.array_join(
        F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )


@query(
    "a1_style_usage",
    STYLED_NEEDS,
    f"""SELECT pkg_id, sid AS style_id, CAST(sum(n) AS BIGINT) AS usage_count,
        string_agg(story || '=' || n, ',' ORDER BY story) AS by_story
        FROM (SELECT pkg_id, sid, {story} AS story, count(*) AS n FROM ({STYLED}) WHERE sid IS NOT NULL GROUP BY ALL)
        GROUP BY ALL""",
)
def a1(spark, d):
    from galley.functions.paths import story as story_of

    rows = styled(spark, d).select(
        "pkg_id", "style_id", F.lit("paragraph").alias("style_type"), story_of(F.col("part")).alias("story")
    )
    return usage.style_usage(rows).select(
        "pkg_id", "style_id", "usage_count", text_map(F.col("by_story")).alias("by_story")
    )


@query(
    "a1_turn_usage_by_story",
    [],
    """SELECT style_id, CAST(sum(n) AS BIGINT) AS usage_count, string_agg(story || '=' || n, ',' ORDER BY story) AS by_story
       FROM (SELECT role AS story, CASE WHEN length(text) < 80 THEN 'short' WHEN text LIKE '%?%' THEN 'question' ELSE 'long' END AS style_id,
       count(*) AS n FROM conversations GROUP BY ALL) GROUP BY ALL""",
)
def a1_turns(spark, d):
    style = F.expr("CASE WHEN length(text) < 80 THEN 'short' WHEN text LIKE '%?%' THEN 'question' ELSE 'long' END")
    rows = A.turns(spark, d).select(
        F.lit(0).alias("pkg_id"), F.lit("paragraph").alias("style_type"), F.col("role").alias("story"), style.alias("style_id")
    )
    return usage.style_usage(rows).select("style_id", "usage_count", text_map(F.col("by_story")).alias("by_story"))


@query(
    "a1_tag_usage",
    [],
    r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|a|b|title)\b', 1)) AS tag FROM pages)
        GROUP BY ALL""",
)
def a1_tags(spark, d):
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|a|b|title)\b"), F.lit(1))
    rows = A.table(spark, d, "pages").select(
        F.col("page_id").alias("pkg_id"), F.lit("tag").alias("style_type"), F.lit("page").alias("story"), F.explode(tags).alias("style_id")
    )
    return usage.style_usage(rows).select(
        F.col("pkg_id").alias("page_id"), F.col("style_id").alias("tag"), F.col("usage_count").alias("n")
    )


VOTES = f"""SELECT pkg_id, outline AS level, sid AS style_id, count(*) AS votes, min(part || lpad(CAST(ord AS VARCHAR), 12, '0')) AS seen,
    count(*) FILTER (part = 'word/document.xml') AS body FROM ({HEADED}) WHERE outline IS NOT NULL GROUP BY ALL"""


@query(
    "a2_heading_authority",
    HEADED_NEEDS,
    f"""SELECT pkg_id, CAST(level AS BIGINT) AS level, style_id, votes FROM ({VOTES})
        QUALIFY row_number() OVER (PARTITION BY pkg_id, level ORDER BY votes DESC, seen, style_id) = 1""",
)
def a2(spark, d):
    return usage.heading_authority(headed(spark, d)).withColumn("level", F.col("level").cast("bigint"))


@query(
    "a3_heading_authority_body",
    HEADED_NEEDS,
    f"""SELECT pkg_id, CAST(level AS BIGINT) AS level, style_id FROM ({VOTES})
        QUALIFY row_number() OVER (PARTITION BY pkg_id, level ORDER BY body DESC, votes DESC, style_id) = 1""",
)
def a3(spark, d):
    from galley.functions.paths import story as story_of

    rows = styled(spark, d).select(
        "pkg_id", "style_id", F.lit("paragraph").alias("style_type"), story_of(F.col("part")).alias("story")
    )
    resolved = catalog.resolve(A.styles(spark, d), False).select("pkg_id", "style_id", "outline")
    won = usage.heading_authority_by_body(usage.style_usage(rows), resolved)
    return won.withColumn("level", F.col("level").cast("bigint"))


IND_SIG = """CASE WHEN ind_left IS NULL AND ind_chars IS NULL THEN NULL ELSE
    concat_ws(';', 'left=' || coalesce(ind_left, CASE WHEN ind_left IS NULL THEN '0' END), 'firstLineChars=' || ind_chars,
    CASE WHEN coalesce(ind_chars, '0') = '0' THEN 'hanging=0' END) END"""
BALLOTS = f"""SELECT pkg_id, sid, part, ord, 'ind' AS component, {IND_SIG} AS value FROM ({STYLED})
    UNION ALL SELECT pkg_id, sid, part, ord, 'spacing', 'before=' || sp_before FROM ({STYLED})
    UNION ALL SELECT pkg_id, sid, part, ord, 'jc', CASE WHEN jc = 'center' THEN jc END FROM ({STYLED})"""


@query(
    "a4_property_consensus",
    STYLED_NEEDS,
    f"""SELECT pkg_id, sid AS style_id, component, value, votes FROM (
        SELECT pkg_id, sid, component, value, count(*) AS votes, min(part || lpad(CAST(ord AS VARCHAR), 12, '0')) AS seen
        FROM ({BALLOTS}) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY pkg_id, sid, component ORDER BY votes DESC, seen) = 1""",
)
def a4(spark, d):
    return usage.property_consensus(styled(spark, d))


@query(
    "a4_event_type_consensus",
    [],
    """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""",
)
def a4_events(spark, d):
    rows = A.table(spark, d, "events").select(
        F.col("user_id").alias("pkg_id"), F.lit("x").alias("part"), F.col("event_id").alias("ord"),
        F.col("event_type").alias("style_id"), F.lit(0).alias("outline"),
    )
    return usage.heading_authority(rows).select(
        F.col("pkg_id").alias("user_id"), F.col("style_id").alias("event_type"), F.col("votes").alias("n")
    )


# Heading rule of a reference (lang, style_id, num_id, hint, outline): first level that exists.
def pick_sql(refs: str) -> str:
    return f"""SELECT r.*, e.ilvl AS r_level, e.num_fmt AS r_fmt, e.lvl_text AS r_text, e.start AS r_start FROM ({refs}) r
        LEFT JOIN LATERAL (
          SELECT e.* FROM eff e WHERE e.lang = r.lang AND e.num_id = r.num_id AND e.ilvl BETWEEN 0 AND 8
            AND regexp_matches(r.num_id, '^[0-9]+$') AND r.num_id <> '0'
            AND (e.ord IS NOT NULL OR e.ilvl IN (coalesce(r.hint, -1), coalesce(r.outline, -1), 0))
          ORDER BY CASE WHEN e.ilvl = r.hint THEN 0
                        WHEN e.pstyle = r.style_id THEN 1 WHEN e.ilvl = r.outline THEN 2 WHEN e.ilvl = 0 THEN 3 ELSE 4 END, e.ord
          LIMIT 1) e ON true"""


RULE_TEXT = "r_level || '|' || coalesce(r_fmt, '') || '|' || coalesce(r_text, '') || '|' || coalesce(CAST(r_start AS VARCHAR), '')"
STYLE_REF = """SELECT c.pkg_id, c.lang, c.style_id, o.outline, arg_min(n.num_id, c.depth) FILTER (n.style_id IS NOT NULL AND n.num_id IS NOT NULL) AS near_num,
    min(c.depth) FILTER (n.style_id IS NOT NULL) AS near FROM chain c JOIN outl o ON o.pkg_id = c.pkg_id AND o.style_id = c.style_id
    LEFT JOIN numpr n ON n.lang = c.lang AND n.style_id = c.cur WHERE o.outline IS NOT NULL
    AND c.style_id IN (SELECT style_id FROM tpl WHERE style_type = 'paragraph') GROUP BY ALL"""
OWN_REF = f"""SELECT s.pkg_id, s.lang, s.style_id, s.outline, s.near IS NOT NULL AS has_ref, n.num_id AS num_id, n.ilvl AS hint FROM ({STYLE_REF}) s
    LEFT JOIN chain c ON c.pkg_id = s.pkg_id AND c.style_id = s.style_id AND c.depth = s.near
    LEFT JOIN numpr n ON n.lang = s.lang AND n.style_id = c.cur"""
REVERSE = """SELECT lang, pstyle AS style_id, arg_min(num_id, CAST(num_id AS BIGINT) * 100 + ord) AS num_id,
    arg_min(ilvl, CAST(num_id AS BIGINT) * 100 + ord) AS hint FROM eff WHERE pstyle IS NOT NULL AND ord IS NOT NULL
    AND coalesce(num_fmt, '') <> 'none' GROUP BY ALL"""
ALL_REFS = f"""SELECT pkg_id, lang, style_id, outline, num_id, hint FROM ({OWN_REF}) WHERE has_ref AND num_id IS NOT NULL
    UNION ALL SELECT o.pkg_id, o.lang, o.style_id, o.outline, v.num_id, v.hint FROM ({OWN_REF}) o
    JOIN ({REVERSE}) v ON v.lang = o.lang AND v.style_id = o.style_id WHERE o.num_id IS NULL"""
STYLE_RULES = f"SELECT * FROM ({pick_sql(ALL_REFS)}) WHERE r_level IS NOT NULL AND coalesce(r_fmt, '') <> 'none'"
RULE_NEEDS = ["ppar", "dflt", "outl", "chain", "numpr", "tpl", "eff"]


def effective(spark, d, sheet=None):
    n = A.numbering(spark, d)
    sheet = A.styles(spark, d) if sheet is None else sheet
    lists = numbering.concrete_lists(n["nums"], n["abstracts"], sheet)
    return numbering.levels(lists, n["levels"], n["overrides"])


def rule_text(c="rule"):
    part = lambda f: F.coalesce(F.col(f"{c}.{f}").cast("string"), F.lit(""))
    return F.when(
        F.col(c).isNotNull(),
        F.concat_ws("|", part("num_id"), part("level"), part("number_format"), part("level_text"), part("start")),
    )


@query(
    "a5_rule_vote",
    RULE_NEEDS,
    f"""WITH own AS ({STYLE_RULES}),
        ballots AS (SELECT h.pkg_id, h.lang, h.sid AS style_id, h.outline, h.part, h.ord,
          (h.num_id IS NOT NULL OR h.ilvl_raw IS NOT NULL) AS listed, coalesce(h.num_id = '0', false) AS sup,
          CASE WHEN h.num_id IS NOT NULL OR h.ilvl_raw IS NOT NULL THEN coalesce(h.num_id, o.num_id) END AS num_id, CAST(h.ilvl_raw AS INT) AS hint,
          o.num_id || '|' || o.r_level || '|' || coalesce(o.r_fmt, '') || '|' || coalesce(o.r_text, '') || '|' || coalesce(CAST(o.r_start AS VARCHAR), '') AS own
          FROM ({HEADED}) h LEFT JOIN own o ON o.pkg_id = h.pkg_id AND o.style_id = h.sid WHERE h.outline IS NOT NULL),
        picked AS (SELECT *, CASE WHEN NOT listed THEN own WHEN NOT sup AND r_level IS NOT NULL AND coalesce(r_fmt, '') <> 'none'
          THEN num_id || '|' || {RULE_TEXT} END AS rule FROM ({pick_sql('SELECT * FROM ballots')})),
        per AS (SELECT pkg_id, style_id, rule, count(*) FILTER (rule IS NOT NULL) AS v, count(*) FILTER (sup) AS s,
          min(part || lpad(CAST(ord AS VARCHAR), 12, '0')) AS seen FROM picked GROUP BY ALL)
        SELECT pkg_id, style_id, CASE WHEN sum(v) > sum(s) THEN arg_min(rule, lpad(CAST(1000000 - v AS VARCHAR), 8, '0') || seen) FILTER (rule IS NOT NULL) END AS rule,
          CAST(sum(v) AS BIGINT) AS votes, CAST(sum(s) AS BIGINT) AS suppressed, count(rule) > 1 AS conflict FROM per GROUP BY ALL""",
)
def a5(spark, d):
    sheet = A.styles(spark, d)
    resolved = settled(catalog.resolve(sheet, False).filter("outline IS NOT NULL").select("pkg_id", "style_id", "style_type", "outline", "num_ref"))
    levels = settled(effective(spark, d, sheet))
    own = numbering.style_rules(resolved, levels)
    votes = usage.rule_votes(styled(spark, d), resolved, own, levels)
    return votes.withColumn("rule", rule_text())


@query(
    "a6_document_summary",
    ["par", "run", "tbl", "sect"],
    """SELECT p.pkg_id, p.n AS paragraphs, r.n AS runs, coalesce(t.n, 0) AS tables, s.n AS sections, r.chars AS characters
       FROM (SELECT pkg_id, count(*) AS n FROM par GROUP BY ALL) p
       JOIN (SELECT pkg_id, count(*) AS n, CAST(sum(length(replace(text, chr(9), ''))) AS BIGINT) AS chars FROM run GROUP BY ALL) r USING (pkg_id)
       LEFT JOIN (SELECT pkg_id, count(*) AS n FROM tbl GROUP BY ALL) t USING (pkg_id)
       JOIN (SELECT pkg_id, count(*) AS n FROM sect GROUP BY ALL) s USING (pkg_id)""",
)
def a6(spark, d):
    return usage.summary(A.nodes(spark, d)).drop("all_sections")


RUN_ANY = " OR ".join(["style_id IS NOT NULL", *A.RUN_FLAGS.values()])
RUN_MANUAL = " OR ".join(A.RUN_FLAGS[f] for f in ("b", "u"))
PAR_MANUAL = (
    "coalesce(num_id, ilvl_raw, sp_before, ind_left, ind_chars, jc, CAST(direct_outline AS VARCHAR)) IS NOT NULL"
)


@query(
    "a7_manual_formatting",
    ["par", "run"],
    f"""SELECT p.pkg_id, p.n AS paragraphs, r.n AS runs, r.a AS runs_any
        FROM (SELECT pkg_id, count(*) FILTER ({PAR_MANUAL}) AS n FROM par GROUP BY ALL) p
        JOIN (SELECT pkg_id, count(*) FILTER ({RUN_MANUAL}) AS n, count(*) FILTER ({RUN_ANY}) AS a FROM run GROUP BY ALL) r USING (pkg_id)""",
)
def a7(spark, d):
    return usage.manual_formatting(A.nodes(spark, d))


LEVELED = f"""SELECT *, CASE WHEN direct_outline IS NOT NULL THEN CASE WHEN direct_outline <= 8 THEN direct_outline END ELSE outline END AS level
    FROM ({HEADED})"""


def leveled(spark, d, facts=None):
    resolved, defaults = (catalog.resolve(A.styles(spark, d), False), None) if facts is None else facts
    return usage.paragraph_levels(styled(spark, d, defaults), resolved.select("pkg_id", "style_id", "outline"))


@query(
    "a8_level_histogram",
    HEADED_NEEDS,
    f"""SELECT pkg_id, CAST(level AS BIGINT) AS level, count(*) AS n FROM ({LEVELED})
        WHERE part = 'word/document.xml' AND level IS NOT NULL GROUP BY ALL""",
)
def a8(spark, d):
    return usage.level_histogram(leveled(spark, d)).withColumn("level", F.col("level").cast("bigint"))


@query(
    "a9_used_levels",
    HEADED_NEEDS,
    f"""SELECT pkg_id, string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) AS levels
        FROM (SELECT DISTINCT pkg_id, level FROM ({LEVELED}) WHERE level IS NOT NULL) GROUP BY ALL""",
)
def a9(spark, d):
    return usage.used_levels(leveled(spark, d)).select(
        "pkg_id", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels")
    )


TABLES_USED = """SELECT t.pkg_id, coalesce(t.style_id, f.style_id) AS style_id, count(*) AS n,
    min(part || lpad(CAST(t.ord AS VARCHAR), 12, '0')) AS seen FROM tbl t LEFT JOIN dflt f ON f.pkg_id = t.pkg_id AND f.style_type = 'table'
    WHERE coalesce(t.style_id, f.style_id) IN (SELECT style_id FROM tpl WHERE style_type = 'table') GROUP BY ALL"""


def used_tables(spark, d):
    sheet = A.styles(spark, d)
    filled = usage.with_default_style(A.tables(spark, d), catalog.default_styles(sheet), "table")
    return usage.used_tables(filled, sheet.filter("ord >= 0"))


@query(
    "a10_used_tables",
    ["tbl", "dflt", "tpl"],
    f"""SELECT pkg_id, arg_min(style_id, seen) AS first_style, arg_min(style_id, lpad(CAST(1000000 - n AS VARCHAR), 8, '0') || seen) AS common_style,
        count(*) AS styles FROM ({TABLES_USED}) GROUP BY ALL""",
)
def a10(spark, d):
    return usage.preferred_tables(used_tables(spark, d))


INVENTORY_SQL = "SELECT source AS pkg_id, 'word/part' || doc_id || '.xml' AS name, n_chars AS file_size, length(text) AS compress_size FROM documents"


def inventory(spark, d):
    """Member metadata: a source is a package, a document one of its parts."""
    return A.table(spark, d, "documents").select(
        F.col("source").alias("pkg_id"),
        F.concat(F.lit("word/part"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"),
        F.col("n_chars").alias("file_size"),
        F.length("text").cast("bigint").alias("compress_size"),
        F.lit(8).alias("compress_type"),
        F.lit(0).alias("flag_bits"),
        F.lit(False).alias("is_dir"),
    )


@query(
    "a11_package_totals",
    [],
    f"""SELECT pkg_id, count(*) AS members, CAST(sum(file_size) AS BIGINT) AS total_size, max(file_size) AS max_size,
        bool_or(file_size > 512 * 1024 * 1024) AS oversized FROM ({INVENTORY_SQL}) GROUP BY ALL""",
)
def a11(spark, d):
    return quality.package_totals(inventory(spark, d))


@query(
    "a12_fingerprint",
    [],
    """SELECT conv_id AS pack_id, sha256(string_agg('turn' || lpad(CAST(turn AS VARCHAR), 6, '0') || chr(0) || sha256(text) || chr(10), ''
       ORDER BY turn)) AS fingerprint, count(*) AS part_count FROM conversations GROUP BY ALL""",
)
def a12(spark, d):
    parts = A.turns(spark, d).select(
        F.col("pkg_id").alias("pack_id"),
        F.concat(F.lit("turn"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("name"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return library.fingerprint(library.part_hashes(parts))


@query(
    "a14_distinct_fonts",
    ["par"],
    """SELECT pkg_id, string_agg(font, ',' ORDER BY k, font) AS fonts FROM (SELECT DISTINCT pkg_id, font, lower(font) AS k FROM (
       SELECT pkg_id, CASE WHEN length(text) % 3 = 0 THEN 'Arial' WHEN length(text) % 3 = 1 THEN 'bodoni' END AS font FROM par
       UNION ALL SELECT pkg_id, CASE WHEN length(text) % 4 = 0 THEN 'SimSun' ELSE 'arial' END FROM par) WHERE font IS NOT NULL) GROUP BY ALL""",
)
def a14(spark, d):
    named = A.par(spark, d).select(
        "pkg_id",
        F.expr("CASE WHEN length(text) % 3 = 0 THEN 'Arial' WHEN length(text) % 3 = 1 THEN 'bodoni' END").alias("font_latin"),
        F.expr("CASE WHEN length(text) % 4 = 0 THEN 'SimSun' ELSE 'arial' END").alias("font_east_asia"),
    )
    return usage.distinct_fonts(named).select("pkg_id", F.array_join("fonts", ",").alias("fonts"))


@query(
    "a15_ordered_distinct",
    [],
    """SELECT pkg_id, string_agg(w, ' ' ORDER BY pos) AS words FROM (SELECT doc_id AS pkg_id, w, min(pos) AS pos FROM (
       SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x,
       LATERAL (SELECT string_split(line, ' ')[1] AS w) GROUP BY ALL) GROUP BY ALL""",
)
def a15(spark, d):
    firsts = F.transform(F.split("text", "\n"), lambda s: F.split(s, " ")[0])
    return A.docs(spark, d).select(
        "pkg_id", F.array_join(usage.ordered_distinct(firsts), " ").alias("words")
    )


@query(
    "a17_pack_counters",
    ["ppar", "dflt", "tpl", "doc"],
    f"""SELECT d.pkg_id, coalesce(u.used, 0) AS used, coalesce(u.inferred, 0) AS inferred, CAST(0 AS BIGINT) AS custom, t.n AS defined,
        greatest(0, t.n - coalesce(u.used, 0) - coalesce(u.inferred, 0)) AS hidden
        FROM doc d JOIN (SELECT lang, count(*) AS n FROM tpl GROUP BY ALL) t ON t.lang = d.lang
        LEFT JOIN (SELECT pkg_id, count(*) FILTER (n > 1) AS used, count(*) FILTER (n = 1) AS inferred FROM
          (SELECT pkg_id, sid, count(*) AS n FROM ({STYLED}) WHERE sid IS NOT NULL GROUP BY ALL) GROUP BY ALL) u ON u.pkg_id = d.pkg_id""",
)
def a17(spark, d):
    shown = (
        styled(spark, d).filter("style_id IS NOT NULL").groupBy("pkg_id", "style_id").agg(F.count(F.lit(1)).alias("n"))
        .select("pkg_id", (F.col("n") == 1).alias("inferred"), F.lit(False).alias("configured"))
    )
    return usage.pack_counters(shown, A.styles(spark, d).filter("ord >= 0"))


@query(
    "a18_duplicates",
    [],
    "SELECT content, count(*) AS n FROM (SELECT sha256(text) AS content FROM documents) GROUP BY ALL HAVING count(*) > 1",
)
def a18(spark, d):
    hashed = A.table(spark, d, "documents").select(F.sha2("text", 256).alias("content"))
    return usage.duplicates(hashed, "content")


@query(
    "a19_editable_sheets",
    ["line"],
    """SELECT pkg_id, max(n) = 1 AS editable FROM (SELECT pkg_id, text, count(*) AS n FROM line GROUP BY ALL) GROUP BY ALL""",
)
def a19(spark, d):
    rows = A.lines(spark, d).withColumnRenamed("text", "style_id")
    return usage.editable_sheets(rows)


def faces(spark, d):
    """Font faces: a part type is a family, a part one of its faces."""
    return A.table(spark, d, "part").select(
        F.col("p_brand").alias("family"),
        F.col("p_type").alias("localized"),
        F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("postscript"),
        (F.col("p_size") % 11).alias("weight"),
        (F.col("p_partkey") % 2 == 1).alias("styled"),
    )


@query(
    "a20_font_families",
    [],
    """SELECT lower(p_brand) AS family_key, arg_min(p_brand, p_brand) AS family,
       arg_min(p_brand || '-' || p_partkey, CASE WHEN p_partkey % 2 = 1 THEN '1' ELSE '0' END || abs(p_size % 11 - 5) || lower(p_brand || '-' || p_partkey)) AS preferred,
       count(*) AS faces FROM part GROUP BY ALL""",
)
def a20(spark, d):
    return fonts.font_families(faces(spark, d))


@query(
    "a21_font_options",
    [],
    """WITH f AS (SELECT 'latin' AS role, o_orderkey AS ord, o_orderpriority AS font, [o_orderstatus, upper(o_orderpriority), CAST(o_custkey AS VARCHAR)] AS aliases FROM orders
       UNION ALL SELECT 'east' AS role, o_orderkey, o_orderstatus, [o_orderpriority] FROM orders),
       a AS (SELECT DISTINCT role, lower(font) AS key, unnest(aliases) AS alias FROM f)
       SELECT n.role, n.key, n.font, count(a.alias) AS alias_count, min(a.alias) AS first_alias
       FROM (SELECT role, lower(font) AS key, arg_min(font, ord) AS font FROM f GROUP BY ALL) n
       LEFT JOIN a ON a.role = n.role AND a.key = n.key AND lower(a.alias) <> a.key GROUP BY ALL""",
)
def a21(spark, d):
    o = A.table(spark, d, "orders")
    latin = o.select(
        F.lit("latin").alias("role"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("font"),
        F.array("o_orderstatus", F.upper("o_orderpriority"), F.col("o_custkey").cast("string")).alias("aliases"),
    )
    east = o.select(
        F.lit("east").alias("role"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("font"),
        F.array("o_orderpriority").alias("aliases"),
    )
    return fonts.font_options(latin.unionByName(east))
