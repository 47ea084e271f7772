"""Style sheets, numbering and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import props
from galley.operators import catalog, lists, mapping, numbering
from galley.registries import SETTINGS_TAGS
from harness import adapters as A
from harness.queries.aggregates import (
    HEADED_NEEDS,
    LEVELED,
    OWN_REF,
    RULE_NEEDS,
    RULE_TEXT,
    STYLE_RULES,
    STYLED,
    effective,
    pick_sql,
    rule_text,
    styled,
)
from harness.registry import query

# --- mapping ---------------------------------------------------------------

REFS = """SELECT DISTINCT s.pkg_id, r.pack_id, s.style_id, s.style_type FROM sty s JOIN req r ON r.pkg_id = s.pkg_id
    UNION ALL SELECT DISTINCT pkg_id, pack_id, 'Nowhere', unnest(['paragraph', 'character', 'table']) FROM req
    UNION ALL SELECT DISTINCT pkg_id, pack_id, '', unnest(['paragraph', 'character', 'table']) FROM req"""


def mapped_sql(refs: str, shift: int | str = 0, v: str = "p") -> str:
    """Mapping of (pkg_id, pack_id, style_id, style_type) tier by tier; pack tables are named with ``v``."""
    spell = f"list_transform(list_concat([t.name], t.aliases, [t.style_id]), lambda x: {A.key('x')})"
    return f"""SELECT r.*, o.outline AS t_outline, least(8, o.outline + {shift}) AS level,
        CASE WHEN coalesce(r.style_id, '') = '' THEN f.style_id ELSE coalesce(
          CASE WHEN r.style_type = 'paragraph' AND t.style_id IS NOT NULL THEN a.style_id END,
          same.style_id,
          (SELECT arg_min(n.style_id, list_position({spell}, n.k)) FROM {v}name n WHERE n.pack_id = r.pack_id AND n.style_type = r.style_type
             AND list_contains({spell}, n.k)),
          CASE WHEN r.style_type = 'paragraph' THEN h.style_id END,
          raw.style_id, f.style_id) END AS mapped,
        coalesce(r.style_type = 'paragraph' AND t.style_id IS NOT NULL AND o.outline IS NOT NULL AND least(8, o.outline + {shift}) <> o.outline
          AND a.style_id IS NULL, false) AS blocked
        FROM ({refs}) r
        LEFT JOIN sty t ON t.pkg_id = r.pkg_id AND t.style_id = r.style_id
        LEFT JOIN outl o ON o.pkg_id = r.pkg_id AND o.style_id = r.style_id
        LEFT JOIN {v}auth a ON a.pack_id = r.pack_id AND a.level = least(8, o.outline + {shift})
        LEFT JOIN {v}sty same ON same.pack_id = r.pack_id AND same.style_id = r.style_id AND same.style_type = r.style_type
        LEFT JOIN {v}head h ON h.pack_id = r.pack_id AND h.level = least(8, o.outline + {shift})
        LEFT JOIN {v}name raw ON raw.pack_id = r.pack_id AND raw.style_type = r.style_type AND raw.k = {A.key('r.style_id')} AND raw.k <> ''
        LEFT JOIN {v}dflt f ON f.pack_id = r.pack_id AND f.style_type = r.style_type"""


MAP_NEEDS = ["sty", "outl", "req", "psty", "pauth", "pname", "phead", "pdflt"]


def style_refs(spark, d, style_type: str):
    sheet = A.styles(spark, d).filter(F.col("style_type") == style_type)
    pairs = A.requests(spark, d)
    extra = pairs.select("pkg_id", "pack_id", F.explode(F.array(F.lit("Nowhere"), F.lit(""))).alias("style_id"))
    return sheet.select("pkg_id", "style_id").join(pairs, "pkg_id").select("pkg_id", "pack_id", "style_id").unionByName(extra)


@query("j1_style_map", MAP_NEEDS, f"SELECT pkg_id, pack_id, style_id, mapped FROM ({mapped_sql(REFS)}) WHERE style_type = 'paragraph'")
def j1(spark, d):
    resolved = catalog.resolve(A.styles(spark, d), False)
    refs = style_refs(spark, d, "paragraph")
    return mapping.map_styles(refs, resolved, A.pack_index(spark), "paragraph").drop("blocked")


@query(
    "j1_style_map_demoted", MAP_NEEDS,
    f"SELECT pkg_id, pack_id, style_id, mapped, blocked FROM ({mapped_sql(REFS, 1)}) WHERE style_type = 'paragraph'",
)
def j1_demoted(spark, d):
    resolved = catalog.resolve(A.styles(spark, d), False)
    return mapping.map_styles(style_refs(spark, d, "paragraph"), resolved, A.pack_index(spark), "paragraph", 1)


# --- style sheets ------------------------------------------------------------

BAG_TEXT = """SELECT lang, style_id, bag, string_agg(prop || '(' || coalesce(attrs, '') || ')', ' ' ORDER BY prop) AS txt FROM (
    SELECT p.lang, p.style_id, p.bag, p.prop, string_agg(a.attr || '=' || a.val, ';' ORDER BY a.attr) AS attrs
    FROM (SELECT DISTINCT lang, style_id, bag, prop FROM lprop) p
    LEFT JOIN lattr a ON a.lang = p.lang AND a.style_id = p.style_id AND a.bag = p.bag AND a.prop = p.prop GROUP BY ALL) GROUP BY ALL"""


@query(
    "j2_style_cascade", ["doc", "lprop", "lattr"],
    f"""SELECT d.pkg_id, p.style_id, p.txt AS ppr, r.txt AS rpr FROM doc d JOIN ({BAG_TEXT}) p ON p.lang = d.lang AND p.bag = 'p'
        JOIN ({BAG_TEXT}) r ON r.lang = p.lang AND r.style_id = p.style_id AND r.bag = 'r'""",
)
def j2(spark, d):
    return catalog.resolve(A.styles(spark, d)).select(
        "pkg_id", "style_id",
        props.bag_signature(F.col("eff_ppr")).alias("ppr"), props.bag_signature(F.col("eff_rpr")).alias("rpr"),
    )


@query("j3_outline", ["outl"], "SELECT pkg_id, style_id, CAST(outline AS BIGINT) AS outline FROM outl")
def j3(spark, d):
    return catalog.resolve(A.styles(spark, d), False).select("pkg_id", "style_id", F.col("outline").cast("bigint").alias("outline"))


@query(
    "j4_numbering_reference", ["chain", "numpr"],
    """SELECT c.pkg_id, c.style_id, n.num_id, n.ilvl FROM (SELECT c.pkg_id, c.lang, c.style_id, min(depth) AS depth FROM chain c
         JOIN numpr n ON n.lang = c.lang AND n.style_id = c.cur GROUP BY ALL) m
       JOIN chain c ON c.pkg_id = m.pkg_id AND c.style_id = m.style_id AND c.depth = m.depth JOIN numpr n ON n.lang = c.lang AND n.style_id = c.cur""",
)
def j4(spark, d):
    return catalog.resolve(A.styles(spark, d), False).filter("num_ref IS NOT NULL").select(
        "pkg_id", "style_id", "num_ref.num_id", "num_ref.ilvl"
    )


EFF_LIST = f"""SELECT p.*, s.sn, s.si, s.has, coalesce(p.num_id, s.sn) AS raw, coalesce(p.ilvl_raw, CAST(s.si AS VARCHAR)) AS rl FROM ({LEVELED}) p
    LEFT JOIN (SELECT c.pkg_id, c.style_id, arg_min(n.num_id, c.depth) FILTER (n.num_id IS NOT NULL) AS sn,
      arg_min(n.ilvl, c.depth) FILTER (n.ilvl IS NOT NULL) AS si, count(n.style_id) > 0 AS has
      FROM chain c LEFT JOIN numpr n ON n.lang = c.lang AND n.style_id = c.cur GROUP BY ALL) s ON s.pkg_id = p.pkg_id AND s.style_id = p.sid"""
EFF_NUM = f"""SELECT *, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN raw END AS eff_num_id,
    CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN CASE WHEN raw = '0' THEN CAST(rl AS INT)
      WHEN CAST(rl AS INT) BETWEEN 0 AND 8 THEN CAST(rl AS INT) ELSE 0 END END AS eff_ilvl,
    coalesce(has AND (num_id IS NULL OR ilvl_raw IS NULL) AND regexp_matches(raw, '^[0-9]+$'), false) AS inherited FROM ({EFF_LIST})"""
LIST_NEEDS = HEADED_NEEDS + ["chain", "numpr"]


def referenced(spark, d):
    sheet = A.styles(spark, d)
    resolved = catalog.resolve(sheet, False)
    defaults = catalog.default_styles(sheet)
    rows = lists.effective_reference(A.paragraphs(spark, d), resolved, defaults)
    direct = F.col("direct_outline")
    level = F.when(direct.isNotNull(), F.when(direct <= 8, direct)).otherwise(F.col("outline"))
    return rows.withColumn("level", level)


@query("j5_effective_list", LIST_NEEDS, f"SELECT pkg_id, ord, eff_num_id, eff_ilvl, inherited FROM ({EFF_NUM})")
def j5(spark, d):
    return referenced(spark, d).select("pkg_id", "ord", "eff_num_id", "eff_ilvl", "inherited")


@query(
    "j6_list_proxy", ["doc", "conc", "nums"],
    """SELECT d.pkg_id, n.num_id, c.abstract_id FROM doc d CROSS JOIN nums n LEFT JOIN conc c ON c.lang = d.lang AND c.num_id = n.num_id""",
)
def j6(spark, d):
    n = A.numbering(spark, d)
    return numbering.concrete_lists(n["nums"], n["abstracts"], A.styles(spark, d))


@query(
    "j7_level_override", ["doc", "eff"],
    "SELECT d.pkg_id, e.num_id, e.ilvl, e.start, e.num_fmt, e.lvl_text FROM doc d JOIN eff e ON e.lang = d.lang",
)
def j7(spark, d):
    return effective(spark, d).select("pkg_id", "num_id", "ilvl", "start", "num_fmt", "lvl_text")


PICK_REFS = f"""SELECT DISTINCT pkg_id, lang, sid AS style_id, coalesce(num_id, 'none') AS num_id, CAST(ilvl_raw AS INT) AS hint, outline FROM ({LEVELED})"""


@query(
    "j8_level_pick", HEADED_NEEDS + ["eff"],
    f"""SELECT pkg_id, style_id, num_id, hint, CASE WHEN r_level IS NOT NULL AND coalesce(r_fmt, '') <> 'none' THEN num_id || '|' || {RULE_TEXT} END AS rule
        FROM ({pick_sql(PICK_REFS)})""",
)
def j8(spark, d):
    resolved = catalog.resolve(A.styles(spark, d), False).select("pkg_id", "style_id", "outline")
    refs = (
        styled(spark, d).join(resolved, ["pkg_id", "style_id"], "left")
        .select("pkg_id", "style_id", F.coalesce("num_id", F.lit("none")).alias("num_id"), F.col("ilvl_raw").cast("int").alias("level_hint"), "outline")
        .distinct()
    )
    return numbering.pick_rules(refs, effective(spark, d)).select(
        "pkg_id", "style_id", "num_id", F.col("level_hint").alias("hint"), rule_text().alias("rule")
    )


@query(
    "j9_reverse_numbering", RULE_NEEDS,
    f"""SELECT pkg_id, style_id, num_id || '|' || {RULE_TEXT} AS rule FROM ({STYLE_RULES})""",
)
def j9(spark, d):
    sheet = A.styles(spark, d)
    rules = numbering.style_rules(catalog.resolve(sheet, False), effective(spark, d, sheet))
    return rules.select("pkg_id", "style_id", rule_text().alias("rule"))


# --- paragraphs ----------------------------------------------------------------


def paragraph_sql(shift: int | str, v: str = "p", req: str = "req") -> str:
    """Mapped paragraphs; ``shift`` may name a column of ``req``, whose packs are described by the tables named with ``v``."""
    moved = f", r.{shift}" if isinstance(shift, str) else ""
    refs = f"SELECT DISTINCT p.pkg_id, r.pack_id, p.style_id, 'paragraph' AS style_type{moved} FROM ppar p JOIN {req} r ON r.pkg_id = p.pkg_id"
    own = f"r.{shift}" if moved else str(shift)
    return f"""SELECT x.*, CASE WHEN acts THEN CASE WHEN direct_outline <= 8 THEN coalesce(a.style_id, h.style_id)
          WHEN direct_outline = 9 THEN CASE WHEN b.outline IS NOT NULL THEN f.style_id ELSE m0 END
          WHEN step > 0 THEN m1 ELSE m0 END END AS mapped,
        CASE WHEN acts AND direct_outline <= 8 AND coalesce(a.style_id, h.style_id) IS NULL THEN 'no_heading_for_level'
          WHEN acts AND direct_outline IS NULL AND step > 0 AND blocked THEN 'no_demoted_heading' END AS fault
        FROM (SELECT p.*, m0.mapped AS m0, m1.mapped AS m1, m1.blocked, least(8, p.tout + p.step) AS desired,
            has_ppr AND (p.style_id IS NOT NULL OR p.tout IS NOT NULL) AS acts
          FROM (SELECT p.*, r.pack_id{moved}, CASE WHEN has_ppr THEN level END AS tout, CASE WHEN part = 'word/document.xml' THEN {own} ELSE 0 END AS step
            FROM ({LEVELED}) p JOIN {req} r ON r.pkg_id = p.pkg_id) p
          JOIN ({mapped_sql(refs, v=v)}) m0 ON m0.pkg_id = p.pkg_id AND m0.pack_id = p.pack_id AND m0.style_id IS NOT DISTINCT FROM p.style_id
          JOIN ({mapped_sql(refs, own, v)}) m1 ON m1.pkg_id = p.pkg_id AND m1.pack_id = p.pack_id AND m1.style_id IS NOT DISTINCT FROM p.style_id) x
        LEFT JOIN {v}auth a ON a.pack_id = x.pack_id AND a.level = x.desired
        LEFT JOIN {v}head h ON h.pack_id = x.pack_id AND h.level = x.desired
        LEFT JOIN {v}sty b ON b.pack_id = x.pack_id AND b.style_id = x.m0
        LEFT JOIN {v}dflt f ON f.pack_id = x.pack_id AND f.style_type = 'paragraph'"""


def mapped_paragraphs(spark, d, shift: int = 0):
    sheet = A.styles(spark, d)
    rows = A.paragraphs(spark, d).join(A.requests(spark, d), "pkg_id")
    return mapping.map_paragraphs(
        rows, catalog.resolve(sheet, False), catalog.default_styles(sheet), A.pack_index(spark), shift
    )


PAR_NEEDS = HEADED_NEEDS + MAP_NEEDS


@query(
    "j10_heading_lookup", PAR_NEEDS,
    f"SELECT pkg_id, pack_id, ord, mapped, fault FROM ({paragraph_sql(0)})",
)
def j10(spark, d):
    return mapped_paragraphs(spark, d).select("pkg_id", "pack_id", "ord", "mapped", "fault")


@query(
    "j10_heading_lookup_demoted", PAR_NEEDS,
    f"SELECT pkg_id, pack_id, ord, CAST(desired AS BIGINT) AS desired, mapped, fault FROM ({paragraph_sql(1)})",
)
def j10_demoted(spark, d):
    return mapped_paragraphs(spark, d, 1).select(
        "pkg_id", "pack_id", "ord", F.col("desired").cast("bigint").alias("desired"), "mapped", "fault"
    )


def peers(spark):
    rules = A.pack_rules(spark).withColumnRenamed("pack_id", "pkg_id").select("pkg_id", "style_id")
    resolved = A.pack_styles(spark).withColumnRenamed("own_outline", "outline")
    return mapping.numbered_peers(rules, resolved)


PEERED = f"""SELECT x.*, CASE WHEN mapped IS NOT NULL AND desired IS NOT NULL AND mapped NOT IN (SELECT style_id FROM prule WHERE pack_id = x.pack_id)
      AND mapped NOT IN (SELECT style_id FROM pauth WHERE pack_id = x.pack_id)
      THEN coalesce((SELECT min(style_id) FROM prule WHERE pack_id = x.pack_id AND outline = x.desired), mapped) ELSE mapped END AS peered
    FROM ({paragraph_sql(0)}) x"""


@query("j11_numbered_peer", PAR_NEEDS + ["prule"], f"SELECT pkg_id, pack_id, ord, peered AS mapped FROM ({PEERED})")
def j11(spark, d):
    used = A.pack_authority(spark).select(F.col("pkg_id").alias("pack_id"), "style_id")
    return mapping.prefer_numbered(mapped_paragraphs(spark, d), A.pack_rules(spark), used, peers(spark)).select(
        "pkg_id", "pack_id", "ord", "mapped"
    )


RUN_REFS = """SELECT DISTINCT x.pkg_id, r.pack_id, x.style_id, 'character' AS style_type FROM run x JOIN req r ON r.pkg_id = x.pkg_id WHERE x.style_id IS NOT NULL"""
RUN_MAPPED = f"""SELECT m.pkg_id, m.pack_id, m.style_id, CASE WHEN m.mapped IS NOT NULL AND m.mapped IS DISTINCT FROM f.style_id THEN m.mapped
    WHEN m.mapped IS NOT NULL AND s.style_id IS NOT NULL THEN m.style_id END AS mapped
    FROM ({mapped_sql(RUN_REFS)}) m LEFT JOIN pdflt f ON f.pack_id = m.pack_id AND f.style_type = 'character'
    LEFT JOIN psty s ON s.pack_id = m.pack_id AND s.style_id = m.style_id"""


def run_map(spark, d, resolved=None):
    refs = A.runs(spark, d).filter("style_id IS NOT NULL").select("pkg_id", "style_id").distinct()
    refs = refs.join(A.requests(spark, d), "pkg_id").select("pkg_id", "pack_id", "style_id")
    resolved = catalog.resolve(A.styles(spark, d), False) if resolved is None else resolved
    return mapping.map_run_styles(refs, resolved, A.pack_index(spark))


@query("j12_run_style_map", MAP_NEEDS + ["run"], RUN_MAPPED)
def j12(spark, d):
    return run_map(spark, d)


TABLE_REFS = """SELECT DISTINCT x.pkg_id, r.pack_id, x.style_id, 'table' AS style_type FROM tbl x JOIN req r ON r.pkg_id = x.pkg_id"""
TABLE_MAPPED = f"""SELECT m.pkg_id, m.pack_id, m.style_id, len(u.used_styles) = 0 AS preserved,
    CASE WHEN len(u.used_styles) = 0 THEN m.style_id WHEN list_contains(u.used_styles, m.mapped) THEN m.mapped
      ELSE coalesce(u.preferred, f.style_id, m.mapped) END AS mapped
    FROM ({mapped_sql(TABLE_REFS)}) m JOIN ptab u ON u.pack_id = m.pack_id LEFT JOIN pdflt f ON f.pack_id = m.pack_id AND f.style_type = 'table'"""


def pack_tables(spark):
    from harness import templates as T

    return A.literal(spark, T.PACK_TABLES, "pack_id string, used_styles strings, preferred string")


def table_map(spark, d, resolved=None):
    refs = A.tables(spark, d).select("pkg_id", F.coalesce("style_id", F.lit("")).alias("style_id")).distinct()
    refs = refs.join(A.requests(spark, d), "pkg_id").select("pkg_id", "pack_id", "style_id")
    resolved = catalog.resolve(A.styles(spark, d), False) if resolved is None else resolved
    found = mapping.map_table_styles(refs, resolved, A.pack_index(spark), pack_tables(spark))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return found.select("pkg_id", "pack_id", blank("style_id"), "preserved", blank("mapped"))


@query("j13_table_style_map", MAP_NEEDS + ["tbl", "ptab"], TABLE_MAPPED)
def j13(spark, d):
    return table_map(spark, d)


@query(
    "j14_section_layout", ["sect", "req", "play"],
    """SELECT s.pkg_id, r.pack_id, CAST(s.idx AS BIGINT) AS idx, l.width, l.height FROM sect s JOIN req r ON r.pkg_id = s.pkg_id
       JOIN (SELECT pack_id, max(idx) AS top FROM play GROUP BY ALL) t ON t.pack_id = r.pack_id
       JOIN play l ON l.pack_id = r.pack_id AND l.idx = least(s.idx, t.top)""",
)
def j14(spark, d):
    from harness import templates as T

    layouts = A.literal(spark, T.PACK_LAYOUTS, "pack_id string, idx int, width int, height int")
    targets = A.sections(spark, d).join(A.requests(spark, d), "pkg_id")
    return mapping.section_layouts(targets, layouts).select(
        "pkg_id", "pack_id", F.col("idx").cast("bigint").alias("idx"), "width", "height"
    )


# --- body lists ------------------------------------------------------------------

WANT = """want AS (SELECT DISTINCT p.pkg_id, p.num_id FROM lev p WHERE p.level IS NULL AND p.num_id IS NOT NULL)"""


@query(
    "j15_list_remap", HEADED_NEEDS + ["nums"],
    f"""WITH lev AS ({LEVELED}), {WANT},
        given AS (SELECT pkg_id, num_id, '0' AS new_num_id FROM want WHERE num_id = '0' UNION ALL
          SELECT w.pkg_id, w.num_id, CAST(30 + row_number() OVER (PARTITION BY w.pkg_id ORDER BY CAST(w.num_id AS BIGINT)) AS VARCHAR)
          FROM want w JOIN nums n ON n.num_id = w.num_id WHERE w.num_id <> '0')
        SELECT l.pkg_id, l.ord, CASE WHEN l.level IS NULL THEN g.new_num_id END AS new_num_id,
          coalesce(CASE WHEN l.level IS NULL THEN g.new_num_id END <> '0', false) AS preserved
        FROM lev l LEFT JOIN given g ON g.pkg_id = l.pkg_id AND g.num_id = l.num_id""",
)
def j15(spark, d):
    from harness.queries.aggregates import leveled

    rows = leveled(spark, d)
    wanted = lists.referenced_lists(rows).join(
        A.numbering(spark, d)["nums"].select("pkg_id", "num_id", "abstract_id"), ["pkg_id", "num_id"], "left"
    )
    used = A.docs(spark, d).select("pkg_id", F.lit(30).alias("max_num"), F.lit(None).cast("array<string>").alias("abstract_ids"))
    return lists.remap_lists(rows, lists.fresh_lists(wanted, used)).select("pkg_id", "ord", "new_num_id", "preserved")


@query(
    "j36_list_materialization", LIST_NEEDS,
    f"""SELECT pkg_id, ord, eff_num_id, eff_ilvl, inherited AND eff_num_id <> '0' AS counted FROM ({EFF_NUM})
        WHERE level IS NULL AND eff_num_id IS NOT NULL
        AND (eff_num_id IS DISTINCT FROM num_id OR eff_ilvl IS DISTINCT FROM CAST(ilvl_raw AS INT))""",
)
def j36(spark, d):
    return lists.materialize(referenced(spark, d)).select("pkg_id", "ord", "eff_num_id", "eff_ilvl", "counted")


@query(
    "j37_referenced_lists", HEADED_NEEDS,
    f"SELECT DISTINCT pkg_id, num_id FROM ({LEVELED}) WHERE level IS NULL AND num_id IS NOT NULL",
)
def j37(spark, d):
    from harness.queries.aggregates import leveled

    return lists.referenced_lists(leveled(spark, d))


@query(
    "j38_list_isolation", ["doc", "lvls"],
    """SELECT d.pkg_id, CAST(100 + CAST(l.abstract_id AS INT) AS VARCHAR) AS abstract_id, l.ilvl, l.lvl_text, CAST(NULL AS VARCHAR) AS pstyle
       FROM doc d CROSS JOIN lvls l WHERE l.abstract_id IN ('0', '1')""",
)
def j38(spark, d):
    n = A.numbering(spark, d)
    ids = n["abstracts"].filter("abstract_id IN ('0', '1')").select(
        "pkg_id", "abstract_id", (F.col("abstract_id").cast("int") + 100).cast("string").alias("new_abstract_id")
    )
    _, levels = lists.isolate(n["abstracts"], n["levels"], ids)
    return levels.select("pkg_id", "abstract_id", "ilvl", "lvl_text", "pstyle")


# --- other updates -----------------------------------------------------------------


@query(
    "j23_table_family_swap", ["sty", "doc", "psty"],
    f"""WITH src AS (SELECT d.pkg_id, p.* FROM doc d JOIN psty p ON p.pack_id = {A.PACK_OF_LANG})
        SELECT pkg_id, style_id, style_type, name FROM src WHERE style_type <> 'table'
        UNION ALL SELECT pkg_id, style_id, style_type, name FROM sty WHERE style_type = 'table'""",
)
def j23(spark, d):
    packs = A.pack_styles(spark).withColumnRenamed("pkg_id", "pack_id")
    owner = A.docs(spark, d).select("pkg_id", F.expr(A.PACK_OF_LANG).alias("pack_id"))
    source = owner.join(packs, "pack_id").select("pkg_id", "ord", "style_id", "style_type", "name")
    target = A.styles(spark, d).filter("ord >= 0").select("pkg_id", "ord", "style_id", "style_type", "name")
    return catalog.swap_table_styles(source, target).drop("ord")


@query(
    "j29_wrapper_styles", ["doc", "lattr", "lprop", "tpl", "outl"],
    """WITH two AS (SELECT lang, style_id FROM lattr WHERE prop = 'ind' AND attr = 'firstLineChars' AND val = '200'
         EXCEPT SELECT lang, style_id FROM lattr WHERE prop = 'ind' AND attr IN ('hanging', 'hangingChars') AND val <> '0'
         EXCEPT SELECT lang, style_id FROM lprop WHERE prop = 'numPr')
       SELECT d.pkg_id, t.style_id AS base_id, 'WordFormatTableNoIndent_' || substr(sha256(t.style_id), 1, 12) AS style_id,
         CASE WHEN count(*) OVER (PARTITION BY d.pkg_id) > 1 THEN '表格正文（无首行缩进） - ' || p.name ELSE '表格正文（无首行缩进）' END AS name, false AS reused
       FROM doc d JOIN two t ON t.lang = d.lang JOIN tpl p ON p.lang = t.lang AND p.style_id = t.style_id AND p.style_type = 'paragraph'
       JOIN outl o ON o.pkg_id = d.pkg_id AND o.style_id = t.style_id AND o.outline IS NULL""",
)
def j29(spark, d):
    sheet = A.styles(spark, d)
    return catalog.wrapper_styles(sheet, catalog.resolve(sheet))


ALIGN = f"""WITH own AS ({OWN_REF}), used AS (SELECT DISTINCT pkg_id, sid AS style_id FROM ({STYLED}))
    SELECT o.pkg_id, o.style_id, CASE WHEN u.style_id IS NOT NULL THEN r.num_id ELSE o.num_id END AS num_id,
      CASE WHEN u.style_id IS NOT NULL THEN r.r_level ELSE o.hint END AS ilvl,
      u.style_id IS NOT NULL AND coalesce(r.num_id, o.num_id, CAST(o.hint AS VARCHAR)) IS NOT NULL AS changed
    FROM own o LEFT JOIN used u ON u.pkg_id = o.pkg_id AND u.style_id = o.style_id
    LEFT JOIN ({STYLE_RULES}) r ON r.pkg_id = o.pkg_id AND r.style_id = o.style_id"""


@query("j31_rule_alignment", RULE_NEEDS, ALIGN)
def j31(spark, d):
    sheet = A.styles(spark, d)
    resolved = catalog.resolve(sheet, False)
    rules = numbering.style_rules(resolved, effective(spark, d, sheet))
    used = styled(spark, d).select("pkg_id", "style_id").distinct()
    refs = resolved.filter("style_type = 'paragraph' AND outline IS NOT NULL").select(
        "pkg_id", "style_id", "num_ref.num_id", "num_ref.ilvl"
    )
    return numbering.align_styles(used, refs, rules)


SAVED = """SELECT DISTINCT pkg_id, lang, sid AS style_id, coalesce(num_id, '1') AS num_id, CAST(ilvl_raw AS INT) AS hint, outline FROM ({0})"""


@query(
    "j33_saved_rules", HEADED_NEEDS + ["eff"],
    f"""SELECT pkg_id, style_id, num_id || '|' || {RULE_TEXT} AS rule FROM ({pick_sql(SAVED.format(LEVELED))}) WHERE r_level IS NOT NULL AND coalesce(r_fmt, '') <> 'none'""",
)
def j33(spark, d):
    saved = (
        styled(spark, d)
        .select("pkg_id", "style_id", F.coalesce("num_id", F.lit("1")).alias("num_id"), F.col("ilvl_raw").cast("int").alias("level"))
        .distinct()
    )
    resolved = catalog.resolve(A.styles(spark, d), False)
    return numbering.saved_rules(saved, resolved, effective(spark, d)).select("pkg_id", "style_id", rule_text().alias("rule"))


def bag_expr(ind: str, spacing: str, jc: str) -> str:
    return f"concat_ws(' ', 'ind(' || {ind} || ')', 'jc(val=' || {jc} || ')', 'spacing(' || {spacing} || ')')"


OWN_IND = "concat_ws(';', 'firstLineChars=' || ind_chars, 'left=' || ind_left)"
SORTED_PROFILE = "array_to_string(list_sort(string_split({0}, ';')), ';')"
OVERRIDE = f"""SELECT x.pkg_id, x.pack_id, x.ord, x.mapped, {bag_expr(
    "coalesce(CASE WHEN p.outline IS NOT NULL THEN " + SORTED_PROFILE.format('f.i') + " END, CASE WHEN coalesce(ind_left, ind_chars) IS NOT NULL THEN " + OWN_IND + " END)",
    "coalesce(CASE WHEN p.outline IS NOT NULL THEN " + SORTED_PROFILE.format('f.s') + " END, 'before=' || sp_before)",
    "coalesce(CASE WHEN p.outline IS NOT NULL THEN f.jc END, x.jc)")} AS bag,
    coalesce(p.outline IS NOT NULL AND f.i IS NOT NULL, false) AS indent_applied
    FROM ({paragraph_sql(0)}) x LEFT JOIN psty p ON p.pack_id = x.pack_id AND p.style_id = x.mapped
    LEFT JOIN pprof f ON f.pack_id = x.pack_id AND f.style_id = x.mapped"""


@query("j34_heading_overrides", PAR_NEEDS + ["pprof"], OVERRIDE)
def j34(spark, d):
    out = mapping.heading_overrides(mapped_paragraphs(spark, d), A.pack_profiles(spark))
    shown = F.map_filter("ppr", lambda k, _: k.isin("ind", "spacing", "jc"))
    return out.select("pkg_id", "pack_id", "ord", "mapped", props.bag_signature(shown).alias("bag"), "indent_applied")


@query(
    "j35_start_override", ["doc", "nums"],
    """SELECT d.pkg_id, n.num_id, CASE WHEN n.num_id IN ('1', '4') AND s > 0 THEN s END AS start_override
       FROM (SELECT pkg_id, n_chars % 4 AS s FROM doc) d CROSS JOIN nums n""",
)
def j35(spark, d):
    nums = A.numbering(spark, d)["nums"].select("pkg_id", "num_id", F.lit(None).cast("bigint").alias("start_override"))
    seeds = A.docs(spark, d).select("pkg_id", (F.col("n_chars") % 4).alias("seed"))
    rules = nums.filter("num_id IN ('1', '4')").select("pkg_id", F.struct("num_id").alias("rule"))
    return numbering.seed_starts(nums, rules, seeds)


NAMED_TABLE = "CASE WHEN n_chars % 3 = 0 THEN 'GridA' WHEN n_chars % 3 = 1 THEN 'Nowhere' END"


@query(
    "j39_default_table_style", ["doc", "dflt"],
    f"""SELECT d.pkg_id, CASE WHEN {NAMED_TABLE} = 'GridA' THEN 'GridA' ELSE f.style_id END AS style_id FROM doc d
        JOIN dflt f ON f.pkg_id = d.pkg_id AND f.style_type = 'table'""",
)
def j39(spark, d):
    value = F.expr(NAMED_TABLE)
    settings = A.docs(spark, d).filter(value.isNotNull()).select(
        "pkg_id", F.lit("defaultTableStyle").alias("tag"), F.create_map(F.lit("val"), value).alias("attrs")
    )
    return catalog.default_table_style(settings, A.styles(spark, d))


@query(
    "j40_completion_id", ["outl", "sty", "doc"],
    f"""WITH head AS (SELECT o.pkg_id, o.outline AS level, coalesce(
          arg_max(o.style_id, s.ord) FILTER (regexp_matches({A.key('s.name')}, '^(heading|标题)[1-9]$') OR regexp_matches({A.key('s.style_id')}, '^(heading|标题)[1-9]$')),
          arg_min(o.style_id, s.ord)) AS style_id
          FROM outl o JOIN sty s ON s.pkg_id = o.pkg_id AND s.style_id = o.style_id WHERE o.outline IS NOT NULL AND s.style_type = 'paragraph' GROUP BY ALL),
        want AS (SELECT pkg_id, unnest(range(0, 9)) AS level FROM doc)
        SELECT w.pkg_id, w.level, coalesce(h.style_id, 'Heading' || (w.level + 1)) AS style_id FROM want w LEFT JOIN head h ON h.pkg_id = w.pkg_id AND h.level = w.level""",
)
def j40(spark, d):
    from galley.operators import completion

    missing = A.docs(spark, d).select("pkg_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("level"))
    resolved = catalog.resolve(A.styles(spark, d), False)
    out = completion.completion_ids(missing, resolved, catalog.headings_by_level(resolved))
    return out.withColumn("level", F.col("level").cast("bigint"))


TARGET_TAGS = {"defaultTabStop": "lang", "zoom": "source", "rsids": "CAST(n_chars AS STRING)", "defaultTableStyle": "lang"}


@query(
    "p6_settings_merge", ["doc", "req", "pset"],
    f"""WITH t AS ({" UNION ALL ".join(f"SELECT pkg_id, '{tag}' AS tag, {v} AS value FROM doc" for tag, v in TARGET_TAGS.items())})
        SELECT r.pkg_id, r.pack_id, t.tag, t.value, 'target' AS origin FROM req r JOIN t ON t.pkg_id = r.pkg_id WHERE t.tag IN ('zoom', 'rsids', 'defaultTableStyle')
        UNION ALL SELECT r.pkg_id, r.pack_id, s.tag, s.value, 'source' FROM req r JOIN pset s ON s.pack_id = r.pack_id
        WHERE s.tag IN ({", ".join(repr(t) for t in SETTINGS_TAGS)}) AND s.tag <> 'defaultTableStyle'""",
)
def p6(spark, d):
    from harness import templates as T

    source = A.literal(spark, T.PACK_SETTINGS, "pack_id string, tag string, value string")
    entries = F.array(*[F.struct(F.lit(t).alias("tag"), F.expr(v).alias("value")) for t, v in TARGET_TAGS.items()])
    target = A.docs(spark, d).select("pkg_id", F.inline(entries)).join(A.requests(spark, d), "pkg_id")
    return mapping.merge_settings(target, source, keep_table_default=True)


def two_char_pack_styles(spark):
    resolved = catalog.resolve(A.pack_styles(spark))
    return catalog.indents_two_chars(resolved).select(F.col("pkg_id").alias("pack_id"), "style_id")


CELL_STEP = f"""SELECT x.*, coalesce(x.mapped, f.style_id) AS effective,
    coalesce((SELECT bool_or(two) FROM psty p WHERE p.pack_id = x.pack_id AND p.style_id = coalesce(x.mapped, f.style_id) AND p.style_type = 'paragraph' AND p.outline IS NULL), false) AS two
    FROM ({paragraph_sql(0)}) x LEFT JOIN pdflt f ON f.pack_id = x.pack_id AND f.style_type = 'paragraph'"""


@query(
    "p8_cell_indents", PAR_NEEDS,
    f"""SELECT pkg_id, pack_id, ord,
        in_table AND (coalesce(ind_chars, '') = '200' OR (two AND coalesce(ind_chars, '0') = '0' AND num_id IS NULL AND ilvl_raw IS NULL
          AND NOT coalesce(direct_outline BETWEEN 0 AND 8, false))) AS indent_cleared
        FROM ({CELL_STEP})""",
)
def p8(spark, d):
    usual = A.pack_index(spark).select("pack_id", F.try_element_at("defaults", F.lit("paragraph")).alias("usual"))
    cells = mapped_paragraphs(spark, d).join(usual, "pack_id").withColumn("effective", F.coalesce("mapped", "usual"))
    sheet = A.pack_styles(spark)
    wrappers = catalog.wrapper_styles(sheet, catalog.resolve(sheet)).select(F.col("pkg_id").alias("pack_id"), "base_id", "style_id")
    out = mapping.cell_indents(cells, two_char_pack_styles(spark), wrappers)
    return out.select("pkg_id", "pack_id", "ord", "indent_cleared")
