"""Graphs, fonts, libraries and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import props
from galley.operators import catalog, edits as E, fonts, graph, library, preview

from harness import adapters as A
from harness.queries.aggregates import STYLED, STYLED_NEEDS, faces, styled
from harness.registry import query

# --- part graph: line i of a document links to lines 2i+1 and 2i+2 -------------

CLOSURE = """e AS (SELECT pkg_id, ord AS a, unnest([2 * ord + 1, 2 * ord + 2]) AS b FROM line),
    reach AS (SELECT pkg_id, ord FROM line WHERE ord = 1 UNION SELECT l.pkg_id, l.ord FROM reach r JOIN e ON e.pkg_id = r.pkg_id AND e.a = r.ord
      JOIN line l ON l.pkg_id = e.pkg_id AND l.ord = e.b)"""


def closure(spark, d):
    name = lambda c: F.concat(F.lit("word/p"), c.cast("string"), F.lit(".xml"))
    rows = A.lines(spark, d).select("pkg_id", "ord")
    parts = rows.select("pkg_id", name(F.col("ord")).alias("part"))
    links = rows.select(
        "pkg_id", name(F.col("ord")).alias("base_part"), F.explode(F.array(F.col("ord") * 2 + 1, F.col("ord") * 2 + 2)).alias("t")
    ).select("pkg_id", "base_part", name(F.col("t")).alias("target_part"))
    return graph.part_closure(parts.filter("part = 'word/p1.xml'"), links, parts)


@query("j16_part_closure", ["line"], f"WITH {CLOSURE} SELECT pkg_id, 'word/p' || ord || '.xml' AS part FROM reach")
def j16(spark, d):
    return closure(spark, d)[0]


@query(
    "j16_dangling_links", ["line"],
    f"""WITH {CLOSURE} SELECT r.pkg_id, 'word/p' || r.ord || '.xml' AS base_part, 'word/p' || e.b || '.xml' AS target_part FROM reach r JOIN e ON e.pkg_id = r.pkg_id AND e.a = r.ord
        WHERE (e.pkg_id, e.b) NOT IN (SELECT (pkg_id, ord) FROM line)""",
)
def j16_dangling(spark, d):
    return closure(spark, d)[1]


def doc_themes(spark, d):
    docs = A.docs(spark, d)
    n = F.col("n_chars")
    face = lambda grp, script, value: F.struct(F.lit(grp).alias("grp"), F.lit(script).alias("script"), value.alias("value"))
    rows = docs.select(
        "pkg_id", F.lit("font").alias("kind"), F.lit(0).alias("ord"),
        F.inline(F.array(
            face("major", "latin", F.when(n % 2 == 0, F.lit("Major Face")).otherwise(F.lit(""))),
            face("minor", "latin", F.lit("Latin Face")),
            face("minor", "ea", F.when(n % 3 == 0, F.lit("EA Face")).otherwise(F.lit(""))),
        )),
    )
    return fonts.theme_fonts(rows, docs.select("pkg_id", F.lit("en-US").alias("lang")))


@query(
    "j17_theme_fonts", ["doc", "lfull", "tprop"],
    """WITH f AS (SELECT c.lang, c.style_id, c.depth, max(val) FILTER (attr = 'ascii') AS ascii, max(val) FILTER (attr = 'hAnsi') AS hansi, max(val) FILTER (attr = 'eastAsia') AS ea,
         max(val) FILTER (attr = 'asciiTheme') AS th, max(val) FILTER (attr = 'eastAsiaTheme') AS te
         FROM lfull c JOIN tprop p ON p.lang = c.lang AND p.style_id = c.cur AND p.prop = 'rFonts' GROUP BY ALL),
       l AS (SELECT lang, style_id, arg_min(th, depth) FILTER (coalesce(th, ascii, hansi) IS NOT NULL) AS x, min(depth) FILTER (coalesce(th, ascii, hansi) IS NOT NULL) AS ld,
         min(depth) FILTER (coalesce(te, ea) IS NOT NULL) AS ed FROM f GROUP BY ALL)
       SELECT d.pkg_id, l.style_id, CASE WHEN a.th IS NOT NULL THEN coalesce(CASE WHEN d.n_chars % 2 = 0 THEN 'Major Face' END, a.ascii, a.hansi) ELSE coalesce(a.ascii, a.hansi) END AS font_latin,
         CASE WHEN b.te IS NOT NULL THEN CASE WHEN d.n_chars % 3 = 0 THEN 'EA Face' ELSE 'Latin Face' END ELSE b.ea END AS font_east_asia
       FROM doc d JOIN l ON l.lang = d.lang LEFT JOIN f a ON a.lang = l.lang AND a.style_id = l.style_id AND a.depth = l.ld
       LEFT JOIN f b ON b.lang = l.lang AND b.style_id = l.style_id AND b.depth = l.ed""",
)
def j17(spark, d):
    sheet = A.styles(spark, d)
    return fonts.style_fonts(sheet, catalog.resolve(sheet, False), doc_themes(spark, d))


def alias_edges(spark, d):
    """Font tables: a customer is a package, an ordered part is listed under its
    supplier's name."""
    item = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    owner = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pkg_id"))
    return item.join(owner, "l_orderkey").select(
        "pkg_id", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("b")
    )


EDGES = """e AS (SELECT DISTINCT o_custkey AS pkg_id, 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    twoway AS (SELECT pkg_id, a, b FROM e UNION ALL SELECT pkg_id, b, a FROM e),
    lab AS (SELECT DISTINCT pkg_id, a AS node, a AS label FROM twoway UNION SELECT l.pkg_id, b.b, l.label FROM lab l JOIN twoway b ON b.pkg_id = l.pkg_id AND b.a = l.node WHERE l.label < b.b),
    root AS (SELECT pkg_id, node, min(label) AS root FROM lab GROUP BY ALL)"""


@query("j18_components", [], f"WITH RECURSIVE {EDGES} SELECT pkg_id, node, root FROM root")
def j18_components(spark, d):
    return graph.components(alias_edges(spark, d))


@query(
    "j18_font_aliases", [],
    f"""WITH RECURSIVE {EDGES}, g AS (SELECT pkg_id, root, list(node ORDER BY lower(node), node) AS names FROM root GROUP BY ALL)
        SELECT r.pkg_id, r.node, array_to_string(list_filter(g.names, lambda x: x <> r.node)[:64], ',') AS aliases
        FROM root r JOIN g ON g.pkg_id = r.pkg_id AND g.root = r.root WHERE len(g.names) > 1""",
)
def j18(spark, d):
    # Links are dealt out by package once; what follows finds them there.
    edges = alias_edges(spark, d).repartition("pkg_id").distinct()
    shown = edges.select("pkg_id", F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "pkg_id", "node", F.col("node").alias("name"), F.lower("node").alias("fold")
    )
    out = graph.font_aliases(edges, shown)
    return out.select("pkg_id", "node", F.array_join("aliases", ",").alias("aliases"))


REQ_NAME = (
    "CASE p_partkey % 6 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_type) WHEN 2 THEN concat(p_brand, CAST(p_partkey AS STRING)) "
    "WHEN 3 THEN concat('Nothing', CAST(p_partkey AS STRING)) WHEN 4 THEN ' ' ELSE concat('None', CAST(p_partkey AS STRING)) END"
)
COMPACT = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query(
    "j19_font_match", [],
    f"""WITH k AS (SELECT DISTINCT fam, unnest([fam, lower(p_type), fam || '-' || p_partkey]) AS s FROM (SELECT *, lower(p_brand) AS fam FROM part)),
        sk AS (SELECT s, min(fam) AS lo, max(fam) AS hi FROM k GROUP BY ALL), ck AS (SELECT {COMPACT.format('s')} AS c, min(fam) AS lo, max(fam) AS hi FROM k GROUP BY ALL),
        r AS (SELECT p_partkey AS req_id, {REQ_NAME} AS name, CASE WHEN p_partkey % 6 = 3 THEN replace(p_brand, '#', ' ') END AS alias FROM part),
        m AS (SELECT r.*, coalesce(s.lo, c.lo, a.lo) AS lo, CASE WHEN s.lo IS NOT NULL THEN s.hi WHEN c.lo IS NOT NULL THEN c.hi ELSE a.hi END AS hi
          FROM r LEFT JOIN sk s ON s.s = lower(trim(r.name)) LEFT JOIN ck c ON c.c = {COMPACT.format('r.name')} AND c.c <> '' LEFT JOIN ck a ON a.c = {COMPACT.format('r.alias')})
        SELECT req_id, name, CASE WHEN trim(name) = '' THEN 'inherited' WHEN lo IS NULL THEN 'missing' WHEN lo <> hi THEN 'ambiguous'
          WHEN EXISTS (SELECT 1 FROM part WHERE lower(p_brand) = lo AND (lower(p_brand) = lower(name) OR lower(p_brand) || '-' || p_partkey = lower(name))) THEN 'installed' ELSE 'alias' END AS kind,
          CASE WHEN lo = hi THEN lo END AS family_key FROM m""",
)
def j19(spark, d):
    part = A.table(spark, d, "part")
    reqs = part.select(F.col("p_partkey").alias("req_id"), F.expr(REQ_NAME).alias("name"))
    aliases = part.filter("p_partkey % 6 = 3").select(
        F.col("p_partkey").alias("req_id"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("alias")
    )
    return fonts.match_fonts(reqs, aliases, faces(spark, d))


# --- libraries -------------------------------------------------------------------

PACK_ID = "concat('p', CAST(n_chars % 700 AS STRING))"


def arrivals(spark, d):
    return A.docs(spark, d).select(
        F.col("pkg_id").alias("seq"), F.expr(PACK_ID).alias("pack_id"), F.sha2("text", 256).alias("fingerprint"), F.col("lang").alias("identity")
    )


def stored_packs(spark, d):
    toxic = A.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("pkg_id"))
    return A.docs(spark, d).join(toxic, "pkg_id", "left_semi").select(
        F.concat(F.lit("p"), (F.col("pkg_id") % 90).cast("string")).alias("pack_id"), F.sha2("text", 256).alias("fingerprint"), F.col("lang").alias("identity")
    )


# Packs that a rule set turns away before the import.
BROKEN_PACK = f"({PACK_ID}) LIKE '%7'"
GOOD_NAME = f"NOT ({BROKEN_PACK})"
STORED_SQL = "SELECT 'p' || (doc_id % 90) AS pack_id, sha256(text) || lang AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
NOTHING_STORED = "SELECT '' AS pack_id, '' AS k WHERE false"
ARRIVALS_SQL = f"SELECT doc_id AS seq, {PACK_ID} AS pack_id, sha256(text) || lang AS k FROM documents"


def import_sql(arrivals: str, stored: str) -> str:
    """Arrivals (``seq, pack_id, k``) taken one by one: named subqueries that end in ``walk``."""
    return f"""st AS ({stored}),
    inc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, * FROM ({arrivals})),
    inc2 AS MATERIALIZED (SELECT inc.*, coalesce(bool_or(s.k <> inc.k), false) AS clash, (SELECT min(pack_id) FROM st t WHERE t.k = inc.k) AS sid FROM inc LEFT JOIN st s ON s.pack_id = inc.pack_id GROUP BY ALL),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS ks, CAST(NULL AS BIGINT) AS seq, '' AS action, CAST(NULL AS VARCHAR) AS library_id
      UNION ALL SELECT n.i, CASE WHEN act = 'append' THEN list_append(ids, n.pack_id) ELSE ids END, CASE WHEN act = 'append' THEN list_append(ks, n.k) ELSE ks END, n.seq, act,
        CASE WHEN act <> 'conflict' THEN coalesce(n.sid, CASE WHEN act = 'append' THEN n.pack_id ELSE ids[list_position(ks, n.k)] END) END
      FROM (SELECT w.ids, w.ks, n.*, CASE WHEN n.clash OR (list_contains(w.ids, n.pack_id) AND w.ks[list_position(w.ids, n.pack_id)] <> n.k) THEN 'conflict'
          WHEN n.sid IS NOT NULL OR list_contains(w.ks, n.k) THEN 'reuse' ELSE 'append' END AS act
        FROM walk w JOIN inc2 n ON n.i = w.i + 1) n)"""


@query("j20_import", [], f"WITH RECURSIVE {import_sql(ARRIVALS_SQL, STORED_SQL)} SELECT seq, action, library_id FROM walk WHERE i > 0")
def j20(spark, d):
    return library.import_packs(arrivals(spark, d), stored_packs(spark, d)).select("seq", "action", "library_id")


# Chains of 1,000 arrivals: each shares its id with the one before or its content; every eleventh is a stranger's.
CHAIN_ID = "concat('p', CAST(floor(doc_id / 1000) AS BIGINT), '-', CAST(floor((doc_id % 1000 + 1) / 2) AS BIGINT))"
CHAIN_CONTENT = "concat('c', CAST(floor(doc_id / 1000) AS BIGINT), '-', CAST(CASE WHEN n_chars % 11 = 0 THEN floor((doc_id % 1000) / 5) ELSE floor((doc_id % 1000) / 2) END AS BIGINT))"


@query(
    "j20_long_chains", [],
    f"""WITH RECURSIVE {import_sql(f"SELECT doc_id AS seq, {CHAIN_ID} AS pack_id, {CHAIN_CONTENT} AS k FROM documents", NOTHING_STORED)}
        SELECT seq, action, library_id FROM walk WHERE i > 0""",
)
def j20_long_chains(spark, d):
    """Chains longer than what one task may walk."""
    rows = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.expr(CHAIN_ID).alias("pack_id"), F.expr(CHAIN_CONTENT).alias("fingerprint"), F.lit("").alias("identity")
    )
    return library.import_packs(rows, stored_packs(spark, d).filter("pack_id = ''"), most=10).select("seq", "action", "library_id")


def turn_parts(spark, d):
    return A.turns(spark, d).select(F.col("pkg_id").alias("pack_id"), F.col("turn").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), "turn", "text")


@query(
    "j22_checksum_reconciliation", [],
    """WITH c AS (SELECT conv_id AS pack_id, CAST(turn AS VARCHAR) AS name, sha256(text) AS h FROM conversations),
       x AS (SELECT conv_id AS pack_id, CAST(turn AS VARCHAR) AS name, CASE WHEN turn % 4 = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM conversations WHERE turn % 7 <> 3
         UNION ALL SELECT DISTINCT conv_id, '99', 'gone' FROM conversations)
       SELECT coalesce(c.pack_id, x.pack_id) AS pack_id, coalesce(c.name, x.name) AS name, CASE WHEN x.h IS NULL THEN 'undeclared_part' WHEN c.h IS NULL THEN 'missing_part' ELSE 'hash_mismatch' END AS rule
       FROM c FULL JOIN x ON x.pack_id = c.pack_id AND x.name = c.name WHERE c.h IS DISTINCT FROM x.h""",
)
def j22(spark, d):
    actual = turn_parts(spark, d)
    declared = actual.filter("turn % 7 <> 3").select(
        "pack_id", "name", F.when(F.col("turn") % 4 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256")
    ).unionByName(actual.select("pack_id", F.lit("99").alias("name"), F.lit("gone").alias("sha256")).distinct())
    return library.reconcile(declared, actual).select("pack_id", "name", "rule")


@query(
    "j27_missing_parts", [],
    """SELECT DISTINCT c.conv_id AS pkg_id, r.role AS part FROM conversations c CROSS JOIN (VALUES ('system'), ('user'), ('assistant')) r(role)
       WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r.role)""",
)
def j27(spark, d):
    from galley.sources.packages import missing_parts

    return missing_parts(A.turns(spark, d).withColumnRenamed("role", "name"), ("system", "user", "assistant"))


@query(
    "a13_application_identity", [],
    """SELECT conv_id AS pack_id, sha256('{' || string_agg('"' || lpad(CAST(turn AS VARCHAR), 3, '0') || '":"' || role || '"', ',' ORDER BY turn) || '}') AS identity FROM conversations GROUP BY ALL""",
)
def a13(spark, d):
    pair = F.struct(F.lpad(F.col("turn").cast("string"), 3, "0").alias("key"), F.col("role").alias("value"))
    roles = A.turns(spark, d).groupBy(F.col("pkg_id").alias("pack_id")).agg(F.map_from_entries(F.collect_list(pair)).alias("m"))
    none = lambda t: F.lit(None).cast(t)
    manifest = F.struct(
        none("array<array<string>>").alias("section_layouts"), F.col("m").alias("heading_authorities"),
        none("map<string,struct<num_id:string,level:int,number_format:string,level_text:string,start:int>>").alias("heading_numbering"),
        none("map<string,map<string,string>>").alias("heading_numbering_user_edits"), none("map<string,map<string,string>>").alias("heading_paragraph_indents"),
        none("map<string,struct<ind:map<string,string>,spacing:map<string,string>,jc:string>>").alias("heading_paragraph_properties"),
        none("array<string>").alias("used_table_styles"), none("string").alias("preferred_table_style"),
    )
    whole = library.application_identity(roles.select("pack_id", manifest.alias("manifest")))
    return whole.select("pack_id", F.sha2(F.get_json_object("identity", "$.heading_authorities"), 256).alias("identity"))


# --- edits ---------------------------------------------------------------------------

FIELD = (
    "CASE length(text) % 9 WHEN 0 THEN 'color_hex' WHEN 1 THEN 'bold' WHEN 2 THEN 'size_pt' WHEN 3 THEN 'left_indent_pt' WHEN 4 THEN 'space_before_pt' "
    "WHEN 5 THEN 'alignment' WHEN 6 THEN 'font_latin' WHEN 7 THEN 'first_line_indent_chars' ELSE 'right_indent_chars' END"
)
VALUE = (
    "CASE length(text) % 9 WHEN 0 THEN upper(substr(md5(text), 1, 6)) WHEN 1 THEN CASE WHEN length(text) % 2 = 0 THEN 'true' ELSE 'false' END "
    "WHEN 2 THEN CAST(5 + length(text) % 40 AS STRING) WHEN 5 THEN CASE WHEN length(text) % 2 = 0 THEN 'center' ELSE 'right' END "
    "WHEN 6 THEN concat('Face ', CAST(length(text) % 20 AS STRING)) ELSE CAST(length(text) % 30 AS STRING) END"
)
EDITS_SQL = f"SELECT pkg_id AS pack_id, style_id, {FIELD} AS field, {VALUE} AS value, ord AS seq FROM par WHERE style_id IS NOT NULL"
LATEST = f"SELECT pack_id, style_id, field, arg_max(value, seq) AS value FROM ({EDITS_SQL}) GROUP BY ALL"
# Attributes every field sets: (field, bag, property, attribute, value).
def sets_sql(latest: str) -> str:
    return f"""SELECT pack_id, style_id, u.* FROM ({latest}), LATERAL (VALUES
    ('color_hex', 'r', 'color', 'val', value), ('bold', 'r', 'b', 'val', CASE value WHEN 'true' THEN '1' ELSE '0' END), ('bold', 'r', 'bCs', 'val', CASE value WHEN 'true' THEN '1' ELSE '0' END),
    ('size_pt', 'r', 'sz', 'val', CAST(TRY_CAST(value AS BIGINT) * 2 AS VARCHAR)), ('size_pt', 'r', 'szCs', 'val', CAST(TRY_CAST(value AS BIGINT) * 2 AS VARCHAR)),
    ('left_indent_pt', 'p', 'ind', 'left', CAST(TRY_CAST(value AS BIGINT) * 20 AS VARCHAR)), ('left_indent_pt', 'p', 'ind', 'start', CAST(TRY_CAST(value AS BIGINT) * 20 AS VARCHAR)),
    ('left_indent_pt', 'p', 'ind', 'leftChars', '0'), ('left_indent_pt', 'p', 'ind', 'startChars', '0'),
    ('right_indent_chars', 'p', 'ind', 'rightChars', CAST(TRY_CAST(value AS BIGINT) * 100 AS VARCHAR)), ('right_indent_chars', 'p', 'ind', 'endChars', CAST(TRY_CAST(value AS BIGINT) * 100 AS VARCHAR)),
    ('right_indent_chars', 'p', 'ind', 'right', '0'), ('right_indent_chars', 'p', 'ind', 'end', '0'),
    ('first_line_indent_chars', 'p', 'ind', 'firstLineChars', CAST(TRY_CAST(value AS BIGINT) * 100 AS VARCHAR)), ('first_line_indent_chars', 'p', 'ind', 'firstLine', '0'),
    ('space_before_pt', 'p', 'spacing', 'before', CAST(TRY_CAST(value AS BIGINT) * 20 AS VARCHAR)), ('space_before_pt', 'p', 'spacing', 'beforeLines', '0'), ('space_before_pt', 'p', 'spacing', 'beforeAutospacing', '0'),
    ('alignment', 'p', 'jc', 'val', value), ('font_latin', 'r', 'rFonts', 'ascii', value), ('font_latin', 'r', 'rFonts', 'hAnsi', value)) u(f, bag, prop, attr, val) WHERE u.f = field"""


KILLS = "(VALUES ('color_hex', 'color', 'themeColor'), ('font_latin', 'rFonts', 'asciiTheme'), ('font_latin', 'rFonts', 'hAnsiTheme'), ('first_line_indent_chars', 'ind', 'hanging'), ('first_line_indent_chars', 'ind', 'hangingChars')) k(field, prop, attr)"


def edits(spark, d):
    rows = A.par(spark, d).filter("style_id IS NOT NULL")
    return rows.select(
        F.col("pkg_id").alias("pack_id"), "style_id", F.expr(FIELD).alias("field"), F.expr(VALUE).alias("value"), F.col("ord").cast("int").alias("seq")
    )


def overlay_sql(latest: str, packs: str = "true", before: str = "") -> str:
    """Bags of all styles after the last edits; ``packs`` tells which packs are wanted, ``before`` names what both rest on."""
    return f"""WITH {before}last AS ({latest}), sets AS ({sets_sql(latest)}),
        own AS (SELECT s.pkg_id AS pack_id, s.style_id, p.bag, p.prop, p.attr, p.val FROM sty s JOIN tprop p ON p.lang = s.lang AND p.style_id = s.style_id),
        live AS (SELECT o.* FROM own o WHERE NOT EXISTS (SELECT 1 FROM sets x WHERE x.pack_id = o.pack_id AND x.style_id = o.style_id AND x.bag = o.bag AND x.prop = o.prop AND x.attr = o.attr)
          AND NOT EXISTS (SELECT 1 FROM last e JOIN {KILLS} ON k.field = e.field WHERE e.pack_id = o.pack_id AND e.style_id = o.style_id AND k.prop = o.prop AND k.attr = o.attr)),
        allp AS (SELECT pack_id, style_id, bag, prop FROM own UNION SELECT pack_id, style_id, bag, prop FROM sets),
        alla AS (SELECT pack_id, style_id, bag, prop, attr, val FROM live WHERE attr IS NOT NULL UNION ALL SELECT pack_id, style_id, bag, prop, attr, val FROM sets),
        txt AS (SELECT pack_id, style_id, bag, string_agg(prop || '(' || coalesce(attrs, '') || ')', ' ' ORDER BY prop) AS t FROM (
          SELECT p.*, string_agg(a.attr || '=' || a.val, ';' ORDER BY a.attr) AS attrs FROM allp p LEFT JOIN alla a USING (pack_id, style_id, bag, prop) GROUP BY ALL) GROUP BY ALL)
        SELECT s.pkg_id AS pack_id, s.style_id, coalesce(p.t, '') AS ppr, coalesce(r.t, '') AS rpr, EXISTS (SELECT 1 FROM last e WHERE e.pack_id = s.pkg_id AND e.style_id = s.style_id) AS edited
        FROM sty s LEFT JOIN txt p ON p.pack_id = s.pkg_id AND p.style_id = s.style_id AND p.bag = 'p' LEFT JOIN txt r ON r.pack_id = s.pkg_id AND r.style_id = s.style_id AND r.bag = 'r' WHERE {packs}"""


@query("j24_edit_overlay", ["doc", "par", "sty", "tprop"], overlay_sql(LATEST))
def j24(spark, d):
    sheet = A.styles(spark, d).filter("ord >= 0").withColumnRenamed("pkg_id", "pack_id").withColumn("tpr", F.lit(None).cast(props.BAG))
    out = E.overlay(sheet, edits(spark, d))
    return out.select("pack_id", "style_id", props.bag_signature(F.col("ppr")).alias("ppr"), props.bag_signature(F.col("rpr")).alias("rpr"), "edited")


# Only some styles of a document are open to edits, and some under another type.
EXPOSED_SQL = "SELECT pkg_id AS pack_id, style_id, CASE WHEN style_id = 'Cell' THEN 'table' ELSE style_type END AS style_type FROM sty WHERE style_id <> 'H3'"


def exposed(spark, d):
    kind = F.when(F.col("style_id") == "Cell", F.lit("table")).otherwise(F.col("style_type"))
    resolved = catalog.resolve(A.styles(spark, d), False)
    return resolved.filter("style_id <> 'H3'").select(F.col("pkg_id").alias("pack_id"), "style_id", kind.alias("style_type"), "outline")


@query(
    "j25_edit_targets", ["par", "sty"],
    f"""SELECT e.pack_id, e.style_id, e.field, CASE WHEN x.style_id IS NULL THEN 'unknown_style' ELSE 'wrong_type' END AS rule FROM ({EDITS_SQL}) e
        LEFT JOIN ({EXPOSED_SQL}) x ON x.pack_id = e.pack_id AND x.style_id = e.style_id WHERE x.style_id IS NULL OR x.style_type = 'table'""",
)
def j25(spark, d):
    return E.check_targets(edits(spark, d), exposed(spark, d))


@query(
    "j26_edit_replay", ["par"],
    f"""SELECT pack_id, style_id, field, arg_max(value, wave * 100000 + seq) AS value FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS wave FROM ({EDITS_SQL})) GROUP BY ALL""",
)
def j26(spark, d):
    rows = edits(spark, d)
    return E.accumulate(rows.filter("seq % 2 = 1"), rows.filter("seq % 2 = 0"))


@query(
    "j28_missing_fonts", ["par", "doc"],
    f"""SELECT pack_id, lower(value) AS key, min(value) AS name FROM ({EDITS_SQL}) WHERE field = 'font_latin'
        AND (pack_id, lower(value)) NOT IN (SELECT (pkg_id, 'face ' || (n_chars % 20)) FROM doc) GROUP BY ALL""",
)
def j28(spark, d):
    table = A.docs(spark, d).select(F.col("pkg_id").alias("pack_id"), F.concat(F.lit("FACE "), (F.col("n_chars") % 20).cast("string")).alias("name"))
    return fonts.missing_font_records(edits(spark, d), table)


@query(
    "j30_manifest_backfill", ["doc", "dflt"],
    """SELECT d.pkg_id AS pack_id, CASE n_chars % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'Arial MT' END AS font_aliases, CASE WHEN n_chars % 2 = 0 THEN 'own' ELSE f.style_id END AS table_candidate
       FROM doc d LEFT JOIN dflt f ON f.pkg_id = d.pkg_id AND f.style_type = 'table'""",
)
def j30(spark, d):
    docs, n = A.docs(spark, d), F.col("n_chars")
    packs = docs.select(
        F.col("pkg_id").alias("pack_id"), F.when(n % 3 == 1, F.lit("arial")).otherwise(F.lit("other")).alias("font"),
        F.when(n % 3 == 0, F.lit("stored")).alias("font_aliases"), F.when(n % 2 == 0, F.lit("own")).alias("table_candidate"),
    )
    aliases = docs.select(F.col("pkg_id").alias("pack_id"), F.lit("arial").alias("font"), F.lit("Arial MT").alias("aliases"))
    usual = catalog.default_styles(A.styles(spark, d)).filter("style_type = 'table'").select(F.col("pkg_id").alias("pack_id"), "style_id")
    return preview.backfill(packs, aliases, usual).select("pack_id", "font_aliases", "table_candidate")


def saved(spark, d):
    """Saved overrides: one per document and style, from its longest line."""
    n = F.length("text")
    longest = A.par(spark, d).filter("style_id IS NOT NULL").groupBy("pkg_id", "style_id").agg(F.max(n).alias("n"))
    pick = lambda k, v: F.when(k, v)
    c = F.col("n")
    return longest.select(
        F.col("pkg_id").alias("pack_id"),
        F.when(c % 7 == 0, F.lit("Gone")).otherwise(F.col("style_id")).alias("style_id"),
        pick(c % 2 == 0, F.create_map(F.lit("left"), F.when(c % 4 == 0, F.lit("x")).otherwise(c.cast("string")))).alias("ind"),
        pick(c % 3 == 0, F.create_map(F.lit("before"), c.cast("string"), F.when(c % 5 == 0, F.lit("odd")).otherwise(F.lit("after")), F.lit("1"))).alias("spacing"),
        F.when(c % 5 < 2, F.lit("center")).when(c % 5 == 2, F.lit("middle")).alias("jc"),
        pick(c % 11 < 5, F.create_map(F.lit("hanging"), F.lit("5"), F.lit("odd"), F.lit("1"))).alias("legacy_ind"),
    )


@query(
    "j32_saved_profiles", ["par", "sty"],
    """WITH s AS (SELECT pkg_id, style_id, max(length(text)) AS n FROM par WHERE style_id IS NOT NULL GROUP BY ALL),
       p AS (SELECT pkg_id AS pack_id, style_id, coalesce(CASE WHEN n % 2 = 0 AND n % 4 <> 0 THEN 'left=' || n || ';hanging=0' END, CASE WHEN n % 11 < 5 THEN 'left=0;hanging=5' END) AS ind,
         CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN 'before=' || n || ';after=1' END AS spacing, CASE WHEN n % 5 < 2 THEN 'center' END AS jc FROM s WHERE n % 7 <> 0)
       SELECT * FROM p WHERE coalesce(ind, spacing, jc) IS NOT NULL AND (pack_id, style_id) IN (SELECT (pkg_id, style_id) FROM sty)""",
)
def j32(spark, d):
    sheet = A.styles(spark, d).filter("ord >= 0").select(F.col("pkg_id").alias("pack_id"), "style_id", "style_type")
    out = E.saved_profiles(saved(spark, d), sheet)
    return out.select("pack_id", "style_id", props.signature(F.col("ind")).alias("ind"), props.signature(F.col("spacing")).alias("spacing"), "jc")


@query(
    "j41_override_sync", ["par", "sty", "outl"],
    f"""WITH e AS (SELECT pack_id, style_id, max(value) FILTER (field = 'space_before_pt') AS sp, max(value) FILTER (field = 'alignment') AS al, max(value) FILTER (field = 'left_indent_pt') AS li FROM ({LATEST})
          WHERE field IN ('space_before_pt', 'alignment', 'left_indent_pt') GROUP BY ALL),
        h AS (SELECT pkg_id AS pack_id, style_id FROM outl WHERE outline IS NOT NULL),
        base AS (SELECT pack_id, style_id, 'center' AS jc FROM h WHERE style_id = 'H1'),
        k AS (SELECT e.* FROM e JOIN h USING (pack_id, style_id))
        SELECT coalesce(k.pack_id, b.pack_id) AS pack_id, coalesce(k.style_id, b.style_id) AS style_id,
          CASE WHEN li IS NOT NULL THEN 'left=' || (CAST(li AS INT) * 20) || ';start=' || (CAST(li AS INT) * 20) || ';leftChars=0;startChars=0;hanging=0' END AS ind,
          CASE WHEN sp IS NOT NULL THEN 'before=' || (CAST(sp AS INT) * 20) || ';beforeLines=0;beforeAutospacing=0' END AS spacing,
          CASE WHEN k.pack_id IS NULL THEN b.jc ELSE coalesce(al, b.jc) END AS jc
        FROM k FULL JOIN base b ON b.pack_id = k.pack_id AND b.style_id = k.style_id""",
)
def j41(spark, d):
    heads = catalog.resolve(A.styles(spark, d), False).filter("outline IS NOT NULL").select(F.col("pkg_id").alias("pack_id"), "style_id")
    none = F.lit(None).cast("map<string,string>")
    profiles = heads.filter("style_id = 'H1'").select("pack_id", "style_id", none.alias("ind"), none.alias("spacing"), F.lit("center").alias("jc"))
    mine = edits(spark, d).filter("field IN ('space_before_pt', 'alignment', 'left_indent_pt')")
    out = E.sync_overrides(profiles, mine, heads)
    return out.select("pack_id", "style_id", props.signature(F.col("ind")).alias("ind"), props.signature(F.col("spacing")).alias("spacing"), "jc")


@query(
    "j42_profile_refresh", STYLED_NEEDS + ["outl"],
    f"""SELECT u.pkg_id AS pack_id, u.sid AS style_id, u.n AS usage_count, u.n = 1 AS inferred, CASE WHEN u.n = 1 THEN '智能补全' END AS inference_label, o.outline
        FROM (SELECT pkg_id, sid, count(*) AS n FROM ({STYLED}) GROUP BY ALL) u JOIN outl o ON o.pkg_id = u.pkg_id AND o.style_id = u.sid""",
)
def j42(spark, d):
    used = styled(spark, d).groupBy(F.col("pkg_id").alias("pack_id"), "style_id").agg(F.count(F.lit(1)).alias("usage_count"))
    previous = used.withColumn("inferred", F.col("usage_count") == 1).withColumn("configured", F.lit(False))
    fresh = catalog.resolve(A.styles(spark, d), False).select(F.col("pkg_id").alias("pack_id"), "style_id", "outline")
    return preview.refresh(previous, fresh).drop("configured")
