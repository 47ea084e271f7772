"""Row-level functions, filters, orders and set rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import fonts as FF, numerals, paths, props, text as X, units as U
from galley.operators import catalog, completion, mapping, ordering, usage
from galley.operators.lists import number_order
from galley.registries import CELL_KEEP, MAX_FONT_ALIASES, RUN_KEEP, TABLE_KEEP
from harness import adapters as A
from harness.queries.aggregates import HEADED, HEADED_NEEDS, LEVELED, STYLED, STYLED_NEEDS, headed, leveled, styled
from harness.registry import query

QUOTED = lambda names: ", ".join(f"'{n}'" for n in names)
hundred = lambda c: F.round(c * 100).cast("bigint")

# --- filters ---------------------------------------------------------------

PART_NAME = (
    "CASE WHEN length(text) % 7 = 0 THEN concat('word/header', CAST(length(text) % 10 AS STRING), '.xml') "
    "WHEN length(text) % 7 = 1 THEN 'word/footnotes.xml' WHEN length(text) % 7 = 2 THEN 'word/media/image.xml' "
    "WHEN length(text) % 7 = 3 THEN 'word/glossary/document.xml' WHEN length(text) % 7 = 4 THEN 'word/footer.xml' "
    "WHEN length(text) % 7 = 5 THEN 'xword/document.xml' ELSE 'word/document.xml' END"
)


@query(
    "p1_content_parts", ["line"],
    rf"""SELECT part, count(*) AS n FROM (SELECT {PART_NAME} AS part FROM line)
        WHERE regexp_matches(part, '^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments|glossary/document)\.xml$') GROUP BY ALL""",
)
def p1(spark, d):
    rows = A.lines(spark, d).select(F.expr(PART_NAME).alias("part"))
    return rows.filter(paths.is_content_part(F.col("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


REL_ROLE = "CASE length(text) % 6 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'footnotes' WHEN 3 THEN 'comments' ELSE 'image' END"


@query(
    "p2_active_parts", ["line"],
    f"""WITH r AS (SELECT pkg_id, ord, {REL_ROLE} AS role, 'word/' || {REL_ROLE} || '.xml' AS part, length(text) % 2 = 0 AS used FROM line),
        have AS (SELECT DISTINCT pkg_id, part FROM (SELECT pkg_id, 'word/document.xml' AS part FROM line UNION ALL SELECT pkg_id, part FROM r WHERE ord % 5 <> 4))
        SELECT pkg_id, part FROM have WHERE part = 'word/document.xml' UNION ALL
        SELECT DISTINCT h.pkg_id, h.part FROM have h JOIN r ON r.pkg_id = h.pkg_id AND r.part = h.part
        WHERE (role IN ('header', 'footer') AND used) OR role IN ('footnotes', 'comments')""",
)
def p2(spark, d):
    role = F.expr(REL_ROLE)
    rels = A.lines(spark, d).select(
        "pkg_id", F.col("ord").cast("string").alias("rel_id"), role.alias("role"),
        F.concat(F.lit("word/"), role, F.lit(".xml")).alias("part"), (F.length("text") % 2 == 0).alias("used"), "ord",
    )
    body = A.docs(spark, d).select("pkg_id", F.lit("word/document.xml").alias("part"))
    parts = body.unionByName(rels.filter("ord % 5 <> 4").select("pkg_id", "part")).distinct()
    return ordering.active_parts(parts, rels, rels.filter("used"))


@query(
    "p3_story", ["line"],
    f"""SELECT story, count(*) AS n FROM (SELECT CASE WHEN part = 'word/document.xml' THEN 'body' WHEN part LIKE '%/header%' THEN 'header'
        WHEN part LIKE '%/footer%' THEN 'footer' WHEN part LIKE '%/footnotes.xml' THEN 'footnote'
        ELSE regexp_extract(part, '([^/]*)[.]xml$', 1) END AS story FROM (SELECT {PART_NAME} AS part FROM line)) GROUP BY ALL""",
)
def p3(spark, d):
    rows = A.lines(spark, d).select(paths.story(F.expr(PART_NAME)).alias("story"))
    return rows.groupBy("story").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p4_direct_formatting", ["ppar"],
    """SELECT pkg_id, ord, coalesce(num_id, ilvl_raw, sp_before, ind_left, ind_chars, jc, CAST(direct_outline AS VARCHAR)) IS NOT NULL AS manual FROM ppar""",
)
def p4(spark, d):
    return A.paragraphs(spark, d).select("pkg_id", "ord", usage.manual_paragraph(F.col("ppr")).alias("manual"))


def dropped_sql(flags: dict, keep, extra: str = "0") -> str:
    return " + ".join(f"CASE WHEN {sql} THEN 1 ELSE 0 END" for name, sql in flags.items() if name not in keep) or extra


@query(
    "p5_allow_list", ["ppar", "run", "tbl", "cell"],
    f"""SELECT pkg_id, kind, CAST(sum(removed) AS BIGINT) AS removed FROM (
        SELECT pkg_id, 'paragraph' AS kind, CASE WHEN coalesce(num_id, ilvl_raw) IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sp_before IS NOT NULL THEN 1 ELSE 0 END
          + CASE WHEN coalesce(ind_left, ind_chars) IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN jc IS NOT NULL THEN 1 ELSE 0 END
          + CASE WHEN direct_outline IS NOT NULL THEN 1 ELSE 0 END AS removed FROM ppar
        UNION ALL SELECT pkg_id, 'run', {dropped_sql(A.RUN_FLAGS, RUN_KEEP)} FROM run
        UNION ALL SELECT pkg_id, 'table', {dropped_sql(A.TABLE_FLAGS, TABLE_KEEP)} FROM tbl
        UNION ALL SELECT pkg_id, 'cell', {dropped_sql(A.CELL_FLAGS, CELL_KEEP)} FROM cell) GROUP BY ALL""",
)
def p5(spark, d):
    rows = mapping.strip_properties(A.nodes(spark, d).filter("kind <> 'section'"))
    return rows.groupBy("pkg_id", "kind").agg(F.sum("removed").alias("removed"))


@query(
    "p7_format_only", [],
    r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|a|b|title)\b', 1)) AS tag FROM pages)
        WHERE tag IN ('h1', 'li', 'b', 'title') GROUP BY ALL""",
)
def p7(spark, d):
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|a|b|title)\b"), F.lit(1))
    rows = A.table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag")).select(
        "page_id", F.lit("styles").alias("role"), "tag", F.when(F.col("tag") == "a", 1).otherwise(0).alias("rel_attrs")
    )
    kept = ordering.format_only(rows, ("p", "t", "r"))
    return kept.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_plain_cell", ["ppar"],
    """SELECT pkg_id, ord, (ind_chars IS NULL OR ind_chars IN ('0', '200')) AND num_id IS NULL AND ilvl_raw IS NULL
       AND NOT coalesce(direct_outline BETWEEN 0 AND 8, false) AS plain_cell FROM ppar""",
)
def p9(spark, d):
    return A.paragraphs(spark, d).select("pkg_id", "ord", props.plain_table_cell(F.col("ppr")).alias("plain_cell"))


@query(
    "p10_two_char_styles", ["doc", "lattr", "lprop", "tpl", "outl"],
    """WITH two AS (SELECT lang, style_id FROM lattr WHERE prop = 'ind' AND attr = 'firstLineChars' AND val = '200'
         EXCEPT SELECT lang, style_id FROM lattr WHERE prop = 'ind' AND attr IN ('hanging', 'hangingChars') AND val <> '0'
         EXCEPT SELECT lang, style_id FROM lprop WHERE prop = 'numPr')
       SELECT d.pkg_id, t.style_id FROM doc d JOIN two t ON t.lang = d.lang JOIN tpl p ON p.lang = t.lang AND p.style_id = t.style_id AND p.style_type = 'paragraph'
       JOIN outl o ON o.pkg_id = d.pkg_id AND o.style_id = t.style_id AND o.outline IS NULL""",
)
def p10(spark, d):
    return catalog.indents_two_chars(catalog.resolve(A.styles(spark, d))).select("pkg_id", "style_id")


@query(
    "p11_plain_prefix", ["par"],
    """SELECT pkg_id, ord, plain AND regexp_matches(t, '^1[.]2[.]3 ') AS guarded FROM (SELECT *, concat('1.2.3 ', text) AS t FROM par WHERE text <> '')""",
)
def p11(spark, d):
    rows = A.par(spark, d).filter("text <> ''").withColumn("text", F.concat(F.lit("1.2.3 "), "text")).withColumn("level", F.lit(2))
    from galley.operators.counters import typed_numbers

    return typed_numbers(rows).select("pkg_id", "ord", F.col("prefix").isNotNull().alias("guarded"))


@query(
    "p12_content_flags", [],
    """SELECT source AS pkg_id, bool_or(text LIKE '%@%') AS revised, bool_or(doc_id % 50 = 7) AS signed, bool_or(n_chars > 30000) AS macros
       FROM documents GROUP BY ALL""",
)
def p12(spark, d):
    rows = A.docs(spark, d)
    doc = F.col("pkg_id")
    parts = rows.select(
        F.col("source"), F.when(doc % 50 == 7, F.lit("_XMLsignatures/a.xml")).when(F.col("n_chars") > 30000, F.lit("word/vbaProject.bin")).otherwise(F.lit("x")).alias("name"),
        F.when((doc % 50 == 7) & (F.col("n_chars") > 30000), F.lit("word/vbaProject.bin")).alias("other"),
    )
    named = parts.select(F.col("source").alias("pkg_id"), "name").unionByName(
        parts.filter("other IS NOT NULL").select(F.col("source").alias("pkg_id"), F.col("other").alias("name"))
    )
    nodes = rows.select(F.col("source").alias("pkg_id"), F.when(F.col("text").contains("@"), F.lit("revision")).otherwise(F.lit("run")).alias("kind"))
    return ordering.content_flags(nodes, named)


@query(
    "p13_exposed_styles", STYLED_NEEDS + ["sty", "tbl"],
    f"""SELECT s.pkg_id, s.style_id FROM sty s WHERE (s.pkg_id, s.style_id) IN (SELECT DISTINCT (pkg_id, sid) FROM ({STYLED}))
        UNION ALL SELECT f.pkg_id, f.style_id FROM dflt f WHERE f.style_type = 'table' AND f.pkg_id NOT IN (SELECT pkg_id FROM tbl)""",
)
def p13(spark, d):
    sheet = A.styles(spark, d)
    shown = ordering.exposed(sheet.filter("ord >= 0"), styled(spark, d)).select("pkg_id", "style_id")
    usual = catalog.default_styles(sheet).filter("style_type = 'table'").select("pkg_id", "style_id")
    return shown.unionByName(ordering.table_candidate(usual, A.tables(spark, d)))


@query(
    "p14_font_search", [],
    """SELECT DISTINCT lower(p_brand) AS family_key FROM part WHERE contains(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 'd1')
       OR contains(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), 'd1') OR contains(regexp_replace(lower(p_brand || '-' || p_partkey), '[^a-z0-9]', '', 'g'), 'd1')""",
)
def p14(spark, d):
    from galley.operators.fonts import search_families
    from harness.queries.aggregates import faces

    return search_families(faces(spark, d), "D 1")


# Searches that people type, from every part whose key is divisible by 50: pieces of names in several lengths and spellings.
SEARCHES = """SELECT p_partkey AS query_id, CASE CAST(floor(p_partkey / 50) AS BIGINT) % 5 WHEN 0 THEN p_brand WHEN 1 THEN substr(p_type, 3, 6) WHEN 2 THEN substr(p_type, 2, 2)
    WHEN 3 THEN concat('-', CAST(p_partkey AS STRING)) ELSE concat(substr(p_name, 1, 4), '!') END AS query FROM part WHERE p_partkey % 50 = 0"""


@query(
    "p14_font_index", [],
    f"""WITH k AS (SELECT DISTINCT lower(p_brand) AS family_key, regexp_replace(lower(unnest([p_brand, p_type, p_brand || '-' || p_partkey])), '[^a-z0-9]', '', 'g') AS c FROM part),
        q AS (SELECT query_id, regexp_replace(lower(query), '[^a-z0-9]', '', 'g') AS w FROM ({SEARCHES}))
        SELECT DISTINCT q.query_id, k.family_key FROM q JOIN k ON contains(k.c, q.w) WHERE q.w <> ''""",
)
def p14_index(spark, d):
    """Many searches at once over a stored table of grams."""
    from galley.operators.fonts import name_postings, search_postings
    from galley.operators.graph import settled
    from harness.queries.aggregates import faces

    A.table(spark, d, "part").createOrReplaceTempView("part")
    return search_postings(settled(name_postings(faces(spark, d))), spark.sql(SEARCHES))


# --- orders and set rules ------------------------------------------------------


@query(
    "o1_format_order", ["sty", "outl"],
    f"""SELECT s.pkg_id, s.style_id, CASE WHEN s.style_type = 'paragraph' AND o.outline IS NOT NULL THEN 0 WHEN s.style_type = 'paragraph' THEN 1 WHEN s.style_type = 'character' THEN 2 ELSE 3 END AS grp,
        CASE WHEN s.style_type = 'paragraph' THEN coalesce(o.outline, CASE WHEN {A.key('s.name')} IN ('normal', '正文', 'bodytext') THEN 0 ELSE 1 END) ELSE 0 END AS place,
        CASE WHEN s.style_type = 'paragraph' AND o.outline IS NULL THEN {A.key('s.name')} ELSE replace(lower(s.name), 'ß', 'ss') END AS text
        FROM sty s JOIN outl o ON o.pkg_id = s.pkg_id AND o.style_id = s.style_id""",
)
def o1(spark, d):
    resolved = catalog.resolve(A.styles(spark, d), False)
    rank = ordering.format_rank(F.col("style_type"), F.col("outline"), F.col("name"))
    return resolved.select("pkg_id", "style_id", rank.alias("r")).select("pkg_id", "style_id", "r.*").orderBy("pkg_id", "grp", "place", "text")


@query(
    "o2_newest_first", [],
    "SELECT o_orderkey AS pack_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders ORDER BY created_at DESC NULLS LAST",
)
def o2(spark, d):
    from galley.operators.library import newest_first

    packs = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pack_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")
    )
    return newest_first(packs)


@query(
    "o3_schema_order", ["ppar"],
    """SELECT pkg_id, ord, concat_ws(',', CASE WHEN style_id IS NOT NULL THEN 'pStyle' END, CASE WHEN coalesce(num_id, ilvl_raw) IS NOT NULL THEN 'numPr' END,
       CASE WHEN sp_before IS NOT NULL THEN 'spacing' END, CASE WHEN coalesce(ind_left, ind_chars) IS NOT NULL THEN 'ind' END,
       CASE WHEN jc IS NOT NULL THEN 'jc' END, CASE WHEN direct_outline IS NOT NULL THEN 'outlineLvl' END) AS names FROM ppar WHERE has_ppr""",
)
def o3(spark, d):
    from galley.registries import PARAGRAPH_ORDER

    rows = A.paragraphs(spark, d).filter("has_ppr")
    return rows.select("pkg_id", "ord", F.array_join(props.schema_order(F.col("ppr"), PARAGRAPH_ORDER), ",").alias("names"))


@query(
    "o4_top_style", STYLED_NEEDS,
    f"""SELECT pkg_id, sid AS style_id, n FROM (SELECT pkg_id, sid, count(*) AS n, min(ord) AS seen FROM ({STYLED}) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY pkg_id ORDER BY n DESC, seen) = 1""",
)
def o4(spark, d):
    counts = styled(spark, d).groupBy("pkg_id", "style_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    return ordering.top_one(counts, "pkg_id", F.struct("style_id", "n"), F.struct(-F.col("n"), "seen"))


@query(
    "o5_capped_names", [],
    """SELECT o_custkey AS pkg_id, list_reduce(list_prepend('', list_sort(list(DISTINCT o_orderkey))[:64]), lambda a, b: a || CASE WHEN a = '' THEN '' ELSE ',' END || b) AS names
       FROM (SELECT o_custkey % 40 AS o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS o_orderkey FROM orders) GROUP BY ALL""",
)
def o5(spark, d):
    named = A.table(spark, d, "orders").select(
        (F.col("o_custkey") % 40).alias("pkg_id"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("name")
    )
    return ordering.capped(named, "pkg_id", "name", MAX_FONT_ALIASES).select("pkg_id", F.array_join("name", ",").alias("names"))


@query(
    "o6_number_order", ["par"],
    """SELECT num_id, row_number() OVER (ORDER BY TRY_CAST(num_id AS BIGINT) NULLS LAST, num_id) AS place FROM (SELECT DISTINCT num_id FROM par WHERE num_id IS NOT NULL)""",
)
def o6(spark, d):
    ids = A.par(spark, d).filter("num_id IS NOT NULL").select("num_id").distinct()
    return ordering.places(ids, *number_order(F.col("num_id")))


@query(
    "u1_missing_levels", HEADED_NEEDS,
    f"""SELECT pkg_id, array_to_string(list_filter([0, 1, 2], lambda x: NOT list_contains(levels, x)), ',') AS missing
        FROM (SELECT pkg_id, list(DISTINCT outline) FILTER (outline IS NOT NULL) AS levels FROM ({HEADED}) GROUP BY ALL HAVING count(outline) > 0)""",
)
def u1(spark, d):
    rows = headed(spark, d).groupBy("pkg_id").agg(F.collect_set("outline").alias("levels")).filter(F.size("levels") > 0)
    gone = ordering.difference(F.array(F.lit(0), F.lit(1), F.lit(2)), F.col("levels"))
    return rows.select("pkg_id", F.array_join(F.transform(gone, lambda x: x.cast("string")), ",").alias("missing"))


@query(
    "u2_unknown_parts", ["line"],
    f"SELECT pkg_id, part AS name, count(*) AS n FROM (SELECT pkg_id, {PART_NAME} AS part FROM line) WHERE part NOT IN ('word/document.xml', 'word/footnotes.xml') GROUP BY ALL",
)
def u2(spark, d):
    rows = A.lines(spark, d).select("pkg_id", F.expr(PART_NAME).alias("name"))
    unknown = ordering.unknown_names(rows, ("word/document.xml", "word/footnotes.xml"))
    return unknown.groupBy("pkg_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u3_unmet_levels", HEADED_NEEDS + ["req", "pauth"],
    f"""SELECT l.pkg_id, r.pack_id, CAST(l.level AS BIGINT) AS level FROM (SELECT DISTINCT pkg_id, level FROM ({LEVELED}) WHERE level IS NOT NULL) l
        JOIN req r ON r.pkg_id = l.pkg_id WHERE NOT EXISTS (SELECT 1 FROM pauth a WHERE a.pack_id = r.pack_id AND a.level = l.level)""",
)
def u3(spark, d):
    have = A.pack_authority(spark).groupBy(F.col("pkg_id").alias("pack_id")).agg(F.collect_set("level").alias("have"))
    rows = usage.used_levels(leveled(spark, d)).join(A.requests(spark, d), "pkg_id").join(have, "pack_id")
    gone = ordering.difference(F.col("levels"), F.col("have"))
    return rows.select("pkg_id", "pack_id", F.explode(gone).alias("level")).withColumn("level", F.col("level").cast("bigint"))


@query(
    "u4_unresolvable_lists", HEADED_NEEDS + ["nums", "abst"],
    f"""SELECT pkg_id, num_id, CASE WHEN regexp_matches(num_id, '^[0-9]+$') THEN 'undefined_list' ELSE 'invalid_id' END AS rule
        FROM (SELECT DISTINCT pkg_id, num_id FROM ({LEVELED}) WHERE level IS NULL AND num_id IS NOT NULL) WHERE num_id <> '0'
        AND num_id NOT IN (SELECT n.num_id FROM nums n JOIN abst a ON a.abstract_id = n.abstract_id)""",
)
def u4(spark, d):
    from galley.operators import lists, numbering

    n = A.numbering(spark, d)
    known = numbering.concrete_lists(n["nums"], n["abstracts"], A.styles(spark, d)).filter("abstract_id IS NOT NULL")
    return lists.unresolvable(lists.referenced_lists(leveled(spark, d)), known)


@query(
    "u5_style_union", STYLED_NEEDS,
    f"""SELECT DISTINCT pkg_id, sid AS style_id FROM ({STYLED}) WHERE sid IS NOT NULL UNION SELECT pkg_id, style_id FROM dflt WHERE style_type = 'table'
        UNION SELECT pkg_id, 'Heading4' FROM doc""",
)
def u5(spark, d):
    sheet = A.styles(spark, d)
    usual = catalog.default_styles(sheet).filter("style_type = 'table'")
    made = A.docs(spark, d).select("pkg_id", F.lit("Heading4").alias("style_id"))
    return ordering.union_styles(styled(spark, d).filter("style_id IS NOT NULL"), usual, made)


PATTERN = "concat('%', CAST(1 + length(text) % 4 AS STRING), CASE WHEN length(text) % 3 = 0 THEN '.%2' ELSE '-' END, '%', CAST(1 + ord % 5 AS STRING))"


@query(
    "u6_pattern_levels", ["line"],
    f"""SELECT pkg_id, ord, array_to_string(list_filter(lv, lambda x: x <= 3), ',') AS allowed, array_to_string(list_filter(lv, lambda x: x > 3), ',') AS deeper
        FROM (SELECT pkg_id, ord, list_reduce(list_prepend([]::INT[], list_transform(regexp_extract_all({PATTERN}, '%([1-9])', 1), lambda x: [CAST(x AS INT)])),
          lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS lv FROM line)""",
)
def u6(spark, d):
    rows = A.lines(spark, d).select("pkg_id", "ord", ordering.pattern_levels(F.expr(PATTERN), F.lit(2)).alias("p"))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("pkg_id", "ord", as_text("p.allowed").alias("allowed"), as_text("p.deeper").alias("deeper"))


# --- scalar functions ------------------------------------------------------------

line_fn = lambda spark, d, **cols: A.lines(spark, d).select("pkg_id", "ord", *[c.alias(n) for n, c in cols.items()])


@query("f1_style_key", ["line"], f"SELECT pkg_id, ord, {A.key('text')} AS k FROM line")
def f1(spark, d):
    return line_fn(spark, d, k=X.style_key(F.col("text")))


# The texts are composed Latin letters, for which these rules need no NFKC tables.
@query("f2_font_alias_key", ["line"], "SELECT pkg_id, ord, replace(lower(trim(text)), 'ß', 'ss') AS k FROM line")
def f2(spark, d):
    return line_fn(spark, d, k=FF.alias_key(F.col("text")))


@query(
    "f3_font_keys", ["line"],
    """SELECT pkg_id, ord, strict, regexp_replace(strict, '[^a-z0-9]', '', 'g') AS compact FROM (SELECT pkg_id, ord, replace(lower(strip_accents(text)), 'ß', 'ss') AS strict FROM line)""",
)
def f3(spark, d):
    return line_fn(spark, d, strict=FF.strict_key(F.col("text")), compact=FF.compact_key(F.col("text")))


HREF = r"""SELECT page_id, 'word/' || regexp_extract(url, '//[^/]*/([^?#]*)', 1) AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target,
    generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages"""


def hrefs(spark, d):
    base = F.concat(F.lit("word/"), F.regexp_extract("url", r"//[^/]*/([^?#]*)", 1))
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return A.table(spark, d, "pages").select("page_id", base.alias("base"), F.posexplode(found).alias("pos", "target")).withColumn(
        "pos", (F.col("pos") + 1).cast("bigint")
    )


@query(
    "f4_rels_path", [],
    f"SELECT page_id, pos, regexp_replace(base, '^(.*/)?([^/]*)$', '\\1_rels/\\2.rels') AS rels FROM ({HREF})",
)
def f4(spark, d):
    return hrefs(spark, d).select("page_id", "pos", paths.rels_path(F.col("base")).alias("rels"))


SHIFTED = "CASE pos % 4 WHEN 0 THEN concat('..', target) WHEN 1 THEN concat('../../..', target) WHEN 2 THEN concat('a/./b/..', target) ELSE target END"


@query(
    "f5_resolve_target", [],
    f"""WITH RECURSIVE h AS (SELECT *, {SHIFTED} AS t FROM ({HREF})),
        j AS (SELECT *, string_split(CASE WHEN t LIKE '/%' THEN ltrim(t, '/') ELSE regexp_replace(base, '[^/]*$', '') || t END, '/') AS segs FROM h),
        w AS (SELECT page_id, pos, segs, 1 AS i, CAST([] AS VARCHAR[]) AS st FROM j UNION ALL
          SELECT page_id, pos, segs, i + 1, CASE WHEN segs[i] IN ('', '.') THEN st WHEN segs[i] = '..' AND len(st) > 0 AND st[-1] <> '..' THEN st[:len(st) - 1] ELSE list_append(st, segs[i]) END
          FROM w WHERE i <= len(segs))
        SELECT page_id, pos, CASE WHEN st[1] = '..' THEN NULL WHEN len(st) = 0 THEN '.' ELSE array_to_string(st, '/') END AS part FROM w WHERE i = len(segs) + 1""",
)
def f5(spark, d):
    return hrefs(spark, d).select("page_id", "pos", paths.resolve_target(F.col("base"), F.expr(SHIFTED)).alias("part"))


@query(
    "f6_relative_target", [],
    f"""SELECT page_id, pos, repeat('../', len(regexp_extract_all(base, '[^/]+/'))) || 'media' || target AS rel FROM ({HREF}) WHERE target LIKE '/_%'""",
)
def f6(spark, d):
    rows = hrefs(spark, d).filter("target LIKE '/_%'")
    return rows.select("page_id", "pos", paths.relative_target(F.col("base"), F.concat(F.lit("media"), "target")).alias("rel"))


RAW = "CASE WHEN length(text) % 13 = 0 THEN 'auto' ELSE CAST(length(text) * 7 - 300 AS STRING) END"
INT = f"TRY_CAST({RAW} AS BIGINT)"


@query(
    "f7_units_from_raw", ["line"],
    f"""SELECT pkg_id, ord, CAST(round({INT} * 100 / 20.0) AS BIGINT) AS pt, CAST(round({INT} * 50.0) AS BIGINT) AS half, CAST({INT} * 125 AS BIGINT) AS eighth, {INT} AS hundredth,
        CAST(round(round({INT} / 1440.0 * 2.54, 2) * 100) AS BIGINT) AS cm FROM line""",
)
def f7(spark, d):
    raw = F.expr(RAW)
    return line_fn(
        spark, d, pt=hundred(U.twips_to_pt(raw)), half=hundred(U.half_points(raw)),
        eighth=F.round(U.eighth_points(raw) * 1000).cast("bigint"), hundredth=hundred(U.hundredths(raw)), cm=hundred(U.twips_to_cm(raw)),
    )


@query(
    "f8_units_to_raw", [],
    """SELECT event_id, CAST(round(value * 20) AS BIGINT) AS twips, CAST(round(value * 100) AS BIGINT) AS chars, CAST(round(floor(value) / 2 * 2) AS BIGINT) AS half,
       CAST(round(floor(value) / 8 * 8) AS BIGINT) AS eighth, CASE WHEN event_type = 'view' THEN CAST(floor(value) * 240 AS BIGINT) ELSE CAST(floor(value) * 20 AS BIGINT) END AS line
       FROM (SELECT *, floor(value * 20) / 20 AS v FROM (SELECT event_id, event_type, floor(value * 20) / 20.0 AS value FROM events))""",
)
def f8(spark, d):
    v = F.col("value")
    rows = A.table(spark, d, "events").select("event_id", "event_type", (F.floor(v * 20) / 20.0).alias("value"))
    return rows.select(
        "event_id", U.pt_to_twips(v).alias("twips"), U.chars_to_hundredths(v).alias("chars"), U.pt_to_half_points(F.floor(v) / 2).alias("half"),
        U.pt_to_eighths(F.floor(v) / 8).alias("eighth"),
        U.line_to_raw(F.floor(v), F.when(F.col("event_type") == "view", F.lit("auto")).otherwise(F.lit("exact"))).alias("line"),
    )


@query(
    "f9_line_spacing", ["line"],
    """SELECT pkg_id, ord, CASE WHEN rule = 'auto' THEN CAST(round(raw * 100 / 240.0) AS BIGINT) ELSE raw * 5 END AS spacing, rule FROM (
       SELECT pkg_id, ord, CAST(length(text) * 4 AS BIGINT) AS raw, CASE WHEN length(text) % 3 = 0 THEN 'exact' ELSE 'auto' END AS rule FROM line)""",
)
def f9(spark, d):
    raw = (F.length("text") * 4).cast("string")
    rule = F.when(F.length("text") % 3 == 0, F.lit("exact"))
    return line_fn(spark, d, spacing=hundred(U.line_spacing(raw, rule)), rule=U.line_rule(raw, rule))


COLOR = "CASE length(text) % 4 WHEN 0 THEN concat('#', substr(md5(text), 1, 6)) WHEN 1 THEN concat(' ', substr(md5(text), 1, 6), ' ') WHEN 2 THEN substr(md5(text), 1, 5) ELSE 'auto' END"


@query(
    "f10_hex_color", ["line"],
    f"SELECT pkg_id, ord, nullif(regexp_extract(upper(trim({COLOR}, ' ')), '^#*([0-9A-F]{{6}})$', 1), '') AS color FROM line",
)
def f10(spark, d):
    return line_fn(spark, d, color=U.hex_color(F.expr(COLOR)))


FLAG = "CASE length(text) % 6 WHEN 0 THEN 'On' WHEN 1 THEN ' true ' WHEN 2 THEN '0' WHEN 3 THEN 'OFF' WHEN 4 THEN 'maybe' END"


@query(
    "f11_flags", ["line"],
    f"""SELECT pkg_id, ord, CASE length(text) % 6 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN '0' END AS on_off, length(text) % 6 NOT IN (2, 3) AS on_value FROM line""",
)
def f11(spark, d):
    raw = F.expr(FLAG)
    bag = F.create_map(F.lit("b"), F.when(raw.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("val"), raw)))
    return line_fn(spark, d, on_off=U.on_off(raw), on_value=U.on_value(bag, "b"))


@query(
    "f12_lenient_int", ["line"],
    "SELECT pkg_id, ord, TRY_CAST(nullif(regexp_extract(props, '^ *([+-]?[0-9]+) *$', 1), '') AS BIGINT) AS v FROM (SELECT pkg_id, ord, CASE length(text) % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN '-7' WHEN 2 THEN '3.5' WHEN 3 THEN 'x' ELSE '+4' END AS props FROM line)",
)
def f12(spark, d):
    raw = F.expr("CASE length(text) % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN '-7' WHEN 2 THEN '3.5' WHEN 3 THEN 'x' ELSE '+4' END")
    return line_fn(spark, d, v=U.lenient_int(raw))


LANGTAG = "CASE length(text) % 9 WHEN 0 THEN 'ja-JP' WHEN 1 THEN 'zh-CN' WHEN 2 THEN 'zh_Hant' WHEN 3 THEN 'ko' WHEN 4 THEN 'ZH-tw' WHEN 5 THEN 'zh' WHEN 6 THEN concat(lang, '-XX') WHEN 7 THEN '' END"


@query(
    "f13_theme_script", ["line"],
    "SELECT pkg_id, ord, CASE length(text) % 9 WHEN 0 THEN 'Jpan' WHEN 1 THEN 'Hans' WHEN 2 THEN 'Hant' WHEN 3 THEN 'Hang' WHEN 4 THEN 'Hant' WHEN 5 THEN 'Hans' END AS script FROM line",
)
def f13(spark, d):
    return line_fn(spark, d, script=X.theme_script(F.expr(LANGTAG)))


THEME_SQL = """SELECT pkg_id, n_chars % 3 AS e, n_chars % 2 AS h, n_chars % 5 AS l FROM doc"""


@query(
    "f14_theme_font", ["doc"],
    f"""SELECT pkg_id, CASE WHEN l = 0 AND h = 0 THEN 'MS Mincho' WHEN e = 0 THEN 'EA Face' WHEN h = 1 THEN 'SimSun' ELSE 'Latin Face' END AS face FROM ({THEME_SQL})""",
)
def f14(spark, d):
    from galley.operators.fonts import theme_fonts

    docs = A.docs(spark, d)
    n = F.col("n_chars")
    face = lambda script, value: F.struct(F.lit(script).alias("script"), value.alias("value"))
    rows = docs.select(
        "pkg_id", F.lit("font").alias("kind"), F.lit("minor").alias("grp"), F.lit(0).alias("ord"),
        F.inline(F.array(
            face("latin", F.lit("Latin Face")), face("ea", F.when(n % 3 == 0, F.lit("EA Face")).otherwise(F.lit(""))),
            face("Hans", F.when(n % 2 == 1, F.lit("SimSun"))), face("Jpan", F.when(n % 2 == 0, F.lit("MS Mincho"))),
        )),
    ).filter("value IS NOT NULL")
    languages = docs.select("pkg_id", F.when(n % 5 == 0, F.lit("ja-JP")).otherwise(F.lit("en-US")).alias("lang"))
    return theme_fonts(rows, languages).select("pkg_id", F.try_element_at("theme_fonts", F.lit("minorEastAsia")).alias("face"))


HAN = (
    "concat(CASE WHEN length(text) >= 100 THEN concat(substr('零一二三四五六七八九', 1 + CAST(floor(length(text) / 100) AS INT) % 10, 1), '百') ELSE '' END, "
    "substr('零一二三四五六七八九', 1 + CAST(floor(length(text) / 10) AS INT) % 10, 1), '十', substr('零一二三四五六七八九', 1 + length(text) % 10, 1))"
)


@query(
    "f15_han_number", ["line"],
    """SELECT pkg_id, ord, CASE WHEN length(text) >= 100 THEN greatest(1, CAST(floor(length(text) / 100) AS BIGINT) % 10) * 100 ELSE 0 END
       + greatest(1, CAST(floor(length(text) / 10) AS BIGINT) % 10) * 10 + length(text) % 10 AS v FROM line""",
)
def f15(spark, d):
    return line_fn(spark, d, v=numerals.han_number(F.expr(HAN)))


@query(
    "f16_typed_prefix", ["line"],
    """SELECT pkg_id, ord, 4 + length(CAST(length(text) % 50 AS VARCHAR)) AS consumed, '1.' || (length(text) % 50) AS numbers FROM line WHERE regexp_matches(text, '^[^\\s]')""",
)
def f16(spark, d):
    rows = A.lines(spark, d).filter(F.col("text").rlike(r"^[^\s]"))
    typed = F.concat(F.lit("1."), (F.length("text") % 50).cast("string"), F.lit("、 "), F.col("text"))
    p = numerals.typed_prefix(typed, F.lit(1))
    return rows.select(
        "pkg_id", "ord", p["consumed"].alias("consumed"), F.array_join(F.transform(p["numbers"], lambda x: x.cast("string")), ".").alias("numbers")
    )


@query(
    "f17_number_example", ["line"],
    """SELECT pkg_id, ord, CASE ord % 3 WHEN 0 THEN CAST(2 + ord % 7 AS VARCHAR) || '.' WHEN 1 THEN '1.' || (2 + ord % 7) || '.' ELSE '1.1.' || (2 + ord % 7) END AS shown FROM line""",
)
def f17(spark, d):
    level = (F.col("ord") % 3).cast("int")
    pattern = F.when(level == 0, F.lit(" %1. ")).when(level == 1, F.lit("%1.%2.")).otherwise(F.lit("%1.%2.%3"))
    return line_fn(spark, d, shown=numerals.example(pattern, level, F.lit(2) + F.col("ord") % 7))


P3 = "concat(CASE WHEN length(text) % 5 = 0 THEN 'Teil ' ELSE '(' END, '%1', CASE WHEN length(text) % 7 = 0 THEN '' ELSE '.' END, '%2', CASE WHEN length(text) % 3 = 0 THEN '-' ELSE '.' END, '%3)')"


@query(
    "f18_pattern_tests", ["line"],
    "SELECT pkg_id, ord, length(text) % 5 <> 0 AND length(text) % 7 <> 0 AND length(text) % 3 <> 0 AS repeatable, true AS own_path FROM line",
)
def f18(spark, d):
    p = F.expr(P3)
    return line_fn(spark, d, repeatable=numerals.repeatable(p), own_path=numerals.spells_own_path(p, F.lit(2)))


@query(
    "f19_indent_profile", ["ppar"],
    """SELECT pkg_id, ord, concat_ws(';', 'left=' || coalesce(ind_left, '0'), 'firstLineChars=' || ind_chars, CASE WHEN coalesce(ind_chars, '0') = '0' THEN 'hanging=0' END) AS profile
       FROM ppar WHERE coalesce(ind_left, ind_chars) IS NOT NULL""",
)
def f19(spark, d):
    ind = F.try_element_at("ppr", F.lit("ind"))
    return A.paragraphs(spark, d).filter(ind.isNotNull()).select("pkg_id", "ord", props.signature(props.indent_profile(ind)).alias("profile"))


SP = {"before": "CAST(length(text) AS STRING)", "beforeAutospacing": "CASE length(text) % 3 WHEN 0 THEN 'On' WHEN 1 THEN 'off' ELSE 'x' END", "line": "CASE WHEN length(text) % 2 = 0 THEN '240' ELSE 'wide' END",
      "lineRule": "CASE length(text) % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'exact' ELSE 'none' END"}


@query(
    "f20_spacing_profile", ["line"],
    """SELECT pkg_id, ord, concat_ws(';', 'before=' || length(text), CASE length(text) % 3 WHEN 0 THEN 'beforeAutospacing=1' WHEN 1 THEN 'beforeAutospacing=0' END,
       CASE WHEN length(text) % 2 = 0 THEN 'line=240' END, CASE length(text) % 4 WHEN 0 THEN 'lineRule=auto' WHEN 1 THEN 'lineRule=exact' END) AS profile FROM line""",
)
def f20(spark, d):
    attrs = F.create_map(*[x for k, v in SP.items() for x in (F.lit(k), F.expr(v))])
    return line_fn(spark, d, profile=props.signature(props.spacing_profile(attrs)))


@query(
    "f21_indent_merge", ["ppar"],
    """SELECT pkg_id, ord, concat_ws(';', CASE WHEN coalesce(ind_chars, '0') <> '0' THEN 'firstLineChars=' || ind_chars END, CASE WHEN coalesce(ind_chars, '0') = '0' THEN 'hanging=240' END,
       'left=' || coalesce(ind_left, '90'), 'rightChars=50') AS merged FROM ppar""",
)
def f21(spark, d):
    older = F.create_map(*[F.lit(x) for x in ("left", "90", "hanging", "240", "rightChars", "50")])
    ind = F.coalesce(F.try_element_at("ppr", F.lit("ind")), F.create_map().cast(props.ATTRS))
    return A.paragraphs(spark, d).select("pkg_id", "ord", props.sorted_signature(props.merge_indent(older, ind)).alias("merged"))


@query(
    "f22_preview_indents", ["ppar"],
    """SELECT pkg_id, ord, CAST(CAST(ind_left AS INT) * 5 AS BIGINT) AS left_pt, CAST(ind_chars AS BIGINT) AS first_chars,
       CASE WHEN coalesce(ind_chars, '0') <> '0' THEN NULL WHEN ind_chars IS NULL THEN CAST(NULL AS BIGINT) END AS hanging_pt FROM ppar""",
)
def f22(spark, d):
    shown = props.preview_indents(F.try_element_at("ppr", F.lit("ind")))
    return A.paragraphs(spark, d).select(
        "pkg_id", "ord", hundred(shown["left_indent_pt"]).alias("left_pt"), hundred(shown["first_line_indent_chars"]).alias("first_chars"),
        hundred(shown["hanging_indent_pt"]).alias("hanging_pt"),
    )


@query(
    "f23_orientation", ["doc"],
    "SELECT pkg_id, CASE WHEN n_chars % 4 = 0 THEN 'landscape' WHEN n_chars % 4 = 1 THEN NULL WHEN n_chars > 1000 THEN 'landscape' ELSE 'portrait' END AS orientation FROM doc",
)
def f23(spark, d):
    n = F.col("n_chars")
    given = F.when(n % 4 == 0, F.lit("landscape")).otherwise(F.lit(""))
    width = F.when(n % 4 == 1, F.lit(0)).otherwise(n)
    return A.docs(spark, d).select("pkg_id", X.orientation(given, width, F.lit(1000)).alias("orientation"))


@query(
    "f24_sample_text", ["sty", "outl"],
    f"""SELECT s.pkg_id, s.style_id, CASE WHEN s.style_type = 'table' THEN '表头　｜　内容　｜　数据' WHEN s.style_type = 'character' THEN '字符样式预览 · 中文 Aa 123'
        WHEN o.outline IS NOT NULL THEN (o.outline + 1) || '级标题 · ' || s.name WHEN regexp_matches(lower(s.name), 'list|number|bullet') THEN '1. 列表项目预览'
        WHEN {A.key('s.name')} IN ('normal', '正文', 'bodytext') THEN '这是一段正文预览，用于观察字体、字号与行距。' ELSE '样式预览 · 中文 Aa 123' END AS sample
        FROM sty s JOIN outl o ON o.pkg_id = s.pkg_id AND o.style_id = s.style_id""",
)
def f24(spark, d):
    resolved = catalog.resolve(A.styles(spark, d), False)
    none = F.lit(None).cast("string")
    return resolved.select("pkg_id", "style_id", X.sample_text(F.col("style_type"), F.col("name"), F.col("outline"), none).alias("sample"))


@query(
    "f25_file_stem", ["line"],
    r"""SELECT pkg_id, ord, CASE WHEN t = '' THEN 'word-format' ELSE substr(t, 1, 48) END AS stem FROM (SELECT pkg_id, ord,
        trim(regexp_replace(regexp_replace(trim(text, ' '), '[^\p{L}\p{N}_-]', '-', 'g'), '-{2,}', '-', 'g'), '-') AS t FROM line)""",
)
def f25(spark, d):
    return line_fn(spark, d, stem=X.file_stem(F.col("text")))


@query(
    "f26_table_colors", ["line"],
    """SELECT pkg_id, ord, CASE WHEN length(text) % 3 = 0 THEN 'AABBCC' WHEN length(text) % 3 = 1 THEN '00FF00' END AS fill,
       CASE WHEN length(text) % 2 = 0 THEN '112233' ELSE 'FF0000' END AS accent FROM line""",
)
def f26(spark, d):
    from galley.operators.preview import table_colors

    n = F.length("text")
    shd = F.create_map(F.lit("fill"), F.when(n % 3 == 0, F.lit("aabbcc")).otherwise(F.lit("auto")))
    tpr = F.create_map(F.lit("shd"), shd)
    shades = F.when(n % 3 == 1, F.array(F.lit("auto"), F.lit("00ff00"))).otherwise(F.array(F.lit("auto")))
    header = F.when(n % 2 == 0, F.lit("112233"))
    c = table_colors(tpr, shades, header, F.array(F.lit("x"), F.lit("ff0000")))
    return line_fn(spark, d, fill=c["table_fill_hex"], accent=c["table_accent_hex"])


@query(
    "f27_restart", ["doc", "eff"],
    "SELECT d.pkg_id, e.num_id, e.ilvl, CASE WHEN e.ilvl > 0 THEN coalesce(e.lvl_restart <> 0, true) END AS restart FROM doc d JOIN eff e ON e.lang = d.lang",
)
def f27(spark, d):
    from galley.operators.numbering import restarts
    from harness.queries.aggregates import effective

    return effective(spark, d).select("pkg_id", "num_id", "ilvl", restarts(F.col("ilvl"), F.col("lvl_restart")).alias("restart"))


@query(
    "f28_label_font", ["line"],
    "SELECT pkg_id, ord, CASE length(text) % 4 WHEN 0 THEN 'ascii=A' WHEN 1 THEN 'ascii=B' WHEN 2 THEN 'ascii=A' END AS font FROM line",
)
def f28(spark, d):
    n = F.length("text") % 4
    one = lambda v: F.create_map(F.lit("ascii"), F.lit(v))
    first = F.when(n.isin(0, 2), one("A")).when(n == 3, one("C"))
    second = F.when(n == 0, one("A")).when(n.isin(1, 3), one("B"))
    return line_fn(spark, d, font=props.signature(completion.shared_label_font(first, second)))


NAME = "CASE ord % 9 WHEN 0 THEN concat('/', text) WHEN 1 THEN concat('C:', text) WHEN 2 THEN 'a//b' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'a/b/' WHEN 5 THEN concat('a', chr(7)) WHEN 6 THEN 'a/.' WHEN 7 THEN '' ELSE 'word/styles.xml' END"


@query(
    "f29_member_names", ["line"],
    """SELECT pkg_id, ord, CASE WHEN ord % 9 IN (0, 1) AND strlen(text) > 1021 THEN 'long_name' ELSE CASE ord % 9 WHEN 0 THEN 'absolute_path' WHEN 1 THEN 'absolute_path'
       WHEN 2 THEN 'unsafe_path' WHEN 3 THEN 'unsafe_path' WHEN 5 THEN 'control_character' WHEN 6 THEN 'unsafe_path' WHEN 7 THEN 'empty_name' END END AS fault FROM line WHERE strlen(text) NOT BETWEEN 1020 AND 1024""",
)
def f29(spark, d):
    rows = A.lines(spark, d).filter(~F.octet_length("text").between(1020, 1024))
    return rows.select("pkg_id", "ord", paths.unsafe_name(F.expr(NAME)).alias("fault"))


@query(
    "f30_human_size", ["doc"],
    "SELECT pkg_id, CASE WHEN s >= 1048576 THEN printf('%.1f MiB', s / 1048576.0) WHEN s >= 1024 THEN printf('%.1f KiB', s / 1024.0) ELSE printf('%d B', s) END AS size FROM (SELECT pkg_id, n_chars * 2 * (n_chars % 512) AS s FROM doc) WHERE s * 10 % 1024 <> 512",
)
def f30(spark, d):
    n = F.col("n_chars")
    rows = A.docs(spark, d).select("pkg_id", (n * 2 * (n % 512)).alias("s")).filter("s * 10 % 1024 <> 512")
    return rows.select("pkg_id", X.human_size(F.col("s")).alias("size"))


@query("f31_content_hash", [], "SELECT doc_id AS pkg_id, sha256(text) AS sha256 FROM documents")
def f31(spark, d):
    from galley.operators.library import part_hashes

    rows = A.docs(spark, d).select("pkg_id", F.encode("text", "UTF-8").alias("content"))
    return part_hashes(rows).select("pkg_id", "sha256")


@query(
    "f32_on_step", [],
    "SELECT event_id, CAST(round(value * 100) AS BIGINT) % 5 = 0 AS on_05, CAST(round(value * 100) AS BIGINT) % 50 = 0 AS on_half FROM events",
)
def f32(spark, d):
    v = F.col("value")
    return A.table(spark, d, "events").select("event_id", U.on_step(v, 0.05).alias("on_05"), U.on_step(v, 0.5).alias("on_half"))
