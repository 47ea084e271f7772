"""Readers, sinks, streams and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from galley.functions import props
from galley.functions.fonts import alias_key
from galley.operators import catalog, library, mapping, quality
from galley.operators.graph import settled, shared_folder
from galley.plans.corpus import corpus_of
from galley.plans import apply as apply_plan, derive as derive_plan, fonts as font_plan, packs as pack_plan, preflight as preflight_plan, profile as profile_plan
from galley.plans.sources import Packs
from galley.sources import ooxml, packages, requests as edit_requests, sinks
from galley.sources.edit_log import EditLog
from galley.registries import PACK_SCHEMA_VERSION, SETTINGS_TAGS, WORD
from galley.schemas import MANIFEST
from galley.sources.packs import declared_parts, parse_manifests
from galley.streaming import ingest
from harness import adapters as A, documents as D, templates as T
from harness.queries import joins, libraries as L, windows
from harness.queries.aggregates import HEADED_NEEDS, LEVELED, STYLED, STYLED_NEEDS, effective, faces, leveled, sheet_facts
from harness.registry import query

# --- readers ------------------------------------------------------------------

FILES = ["[Content_Types].xml", "word/_rels/document.xml.rels", "word/document.xml", "word/numbering.xml", "word/styles.xml"]
# Some files are cut short, some have no entries, some have a cut-off body, some lack the styles.
CUT, EMPTY, BROKEN = "pkg_id % 10 = 3", "pkg_id % 17 = 2", "pkg_id % 19 = 4"
FILE_SQL = f"SELECT pkg_id || '.docx' AS pkg_id, unnest({FILES}) AS name, pkg_id AS id FROM doc WHERE NOT ({CUT} OR {EMPTY})"


@query(
    "s1_corpus_scan", ["doc"],
    f"""SELECT pkg_id, name FROM ({FILE_SQL}) WHERE NOT (id % 13 = 5 AND name = 'word/styles.xml') AND id % 19 <> 4""",
)
def s1(spark, d):
    return packages.members(packages.scan(D.archives(spark, d))).select("pkg_id", "name")


@query(
    "s1_rejects", ["doc"],
    f"""SELECT pkg_id || '.docx' AS pkg_id, 'not_a_zip' AS rule, CAST(NULL AS VARCHAR) AS detail FROM doc WHERE {CUT}
       UNION ALL SELECT pkg_id || '.docx', 'empty_archive', NULL FROM doc WHERE {EMPTY} AND NOT ({CUT})
       UNION ALL SELECT pkg_id || '.docx', 'malformed_xml', 'word/document.xml' FROM doc WHERE {BROKEN} AND NOT ({CUT} OR {EMPTY})
       UNION ALL SELECT pkg_id || '.docx', 'missing_part', 'word/styles.xml' FROM doc WHERE pkg_id % 13 = 5 AND NOT ({CUT} OR {EMPTY} OR {BROKEN})""",
)
def s1_rejects(spark, d):
    return packages.rejects(packages.store_scan(D.archives(spark, d), scratch(spark)))


@query(
    "s1_every_file", ["doc"],
    f"""SELECT pkg_id || '.docx' AS pkg_id, NOT ({CUT} OR {EMPTY} OR {BROKEN} OR pkg_id % 13 = 5) AS accepted FROM doc""",
)
def s1_every_file(spark, d):
    scanned = packages.store_scan(D.archives(spark, d), scratch(spark))
    good = packages.accepted(scanned).withColumn("accepted", F.lit(True))
    return good.unionByName(packages.rejects(scanned).select("pkg_id", F.lit(False).alias("accepted")).distinct())


@query(
    "s2_member_inventory", ["doc"],
    f"""SELECT pkg_id, name, false AS is_dir, CAST(8 AS BIGINT) AS compress_type FROM ({FILE_SQL}) WHERE NOT (id % 13 = 5 AND name = 'word/styles.xml')""",
)
def s2(spark, d):
    inv = packages.inventory(D.archives(spark, d))
    return inv.select("pkg_id", "name", "is_dir", F.col("compress_type").cast("bigint").alias("compress_type"))


BASE_NAME = "substring_index(pkg_id, '/', -1)"


@query(
    "s1_by_ranges", ["doc"],
    f"""SELECT pkg_id || '.docx' AS pkg_id, CASE WHEN {CUT} THEN 'not_a_zip' WHEN {EMPTY} THEN 'empty_archive' WHEN {BROKEN} THEN 'malformed_xml' WHEN pkg_id % 13 = 5 THEN 'missing_part' ELSE 'accepted' END AS rule,
        CASE WHEN {CUT} OR {EMPTY} THEN 0 WHEN {BROKEN} OR pkg_id % 13 = 5 THEN 0 ELSE {len(FILES)} END AS members FROM doc""",
)
def s1_by_ranges(spark, d):
    """Files on disk, read by ranges: directories first, then only the members of files that passed."""
    scanned = packages.store_ranges(spark, D.files(spark, d, f"{scratch(spark)}/files"), scratch(spark))
    good = packages.members(scanned).join(packages.accepted(scanned), "pkg_id", "left_semi").groupBy("pkg_id").agg(F.count(F.lit(1)).cast("int").alias("members"))
    every = good.select("pkg_id", F.lit("accepted").alias("rule"), "members").unionByName(packages.rejects(scanned).select("pkg_id", "rule", F.lit(0).alias("members")))
    return every.withColumn("pkg_id", F.expr(BASE_NAME))


@query(
    "s2_by_ranges", ["doc"],
    f"""SELECT pkg_id, name, false AS is_dir, CAST(8 AS BIGINT) AS compress_type FROM ({FILE_SQL}) WHERE NOT (id % 13 = 5 AND name = 'word/styles.xml')""",
)
def s2_by_ranges(spark, d):
    """Directories read from the ends of files on disk."""
    found = packages.directories(packages.listed(spark, D.files(spark, d, f"{scratch(spark)}/files"))).filter("name IS NOT NULL")
    return found.select(F.expr(BASE_NAME).alias("pkg_id"), "name", "is_dir", F.col("compress_type").cast("bigint").alias("compress_type"))


PPR_TEXT = """concat_ws(' ', 'ind(' || CASE WHEN coalesce(ind_left, ind_chars) IS NOT NULL THEN concat_ws(';', 'firstLineChars=' || ind_chars, 'left=' || ind_left) END || ')', 'jc(val=' || jc || ')',
    'numPr(' || CASE WHEN coalesce(num_id, ilvl_raw) IS NOT NULL THEN concat_ws(';', 'ilvl=' || ilvl_raw, 'numId=' || num_id) END || ')', 'outlineLvl(val=' || direct_outline || ')',
    'pStyle(val=' || style_id || ')', 'spacing(before=' || sp_before || ')')"""


@query(
    "s5_content_extraction", ["ppar"],
    f"""SELECT pkg_id, ord, style_id, has_ppr, CAST(direct_outline AS BIGINT) AS direct_outline, num_id, CAST(ilvl_raw AS BIGINT) AS ilvl, in_table, plain, text,
        nullif({PPR_TEXT}, '') AS bag FROM ppar""",
)
def s5(spark, d):
    rows = ooxml.paragraphs(ooxml.content(D.document_parts(spark, d)))
    return rows.select(
        "pkg_id", "ord", "style_id", "has_ppr", F.col("direct_outline").cast("bigint").alias("direct_outline"), "num_id",
        F.col("ilvl").cast("bigint").alias("ilvl"), "in_table", "plain", "text", props.bag_signature(F.col("ppr")).alias("bag"),
    )


def role_parts(spark, d, role):
    parts = D.members(spark, d)
    return ooxml.role_members(parts, ooxml.format_roles(ooxml.relationships(parts)), role)


@query(
    "s6_style_sheets", ["doc", "tpl"],
    """SELECT d.pkg_id, CAST(t.ord AS BIGINT) AS ord, t.style_id, t.style_type, t.name, array_to_string(t.aliases, ',') AS aliases, t.based_on, CAST(t.own_outline AS BIGINT) AS own_outline, t.is_default
       FROM doc d JOIN tpl t ON t.lang = d.lang""",
)
def s6(spark, d):
    rows = ooxml.styles(role_parts(spark, d, "styles")).filter("ord >= 0")
    return rows.select(
        "pkg_id", F.col("ord").cast("bigint").alias("ord"), "style_id", "style_type", "name", F.array_join("aliases", ",").alias("aliases"), "based_on",
        F.col("own_outline").cast("bigint").alias("own_outline"), "is_default",
    )


@query(
    "s7_numbering_levels", ["doc", "lvls"],
    "SELECT d.pkg_id, l.abstract_id, CAST(l.ilvl AS BIGINT) AS ilvl, l.num_fmt, l.lvl_text, l.pstyle, CAST(l.lft AS VARCHAR) AS lft, CAST(l.tab_pos AS BIGINT) AS tab FROM doc d CROSS JOIN lvls l",
)
def s7(spark, d):
    rows = ooxml.numbering(role_parts(spark, d, "numbering"))["level"]
    return rows.select(
        "pkg_id", "abstract_id", F.col("ilvl").cast("bigint").alias("ilvl"), "num_fmt", "lvl_text", "pstyle",
        F.try_element_at("ind", F.lit("left")).alias("lft"), F.col("tab_pos").cast("bigint").alias("tab"),
    )


@query(
    "s8_format_roles", ["doc"],
    "SELECT pkg_id, 'styles' AS role, 'word/styles.xml' AS part, 'r1' AS rel_id FROM doc UNION ALL SELECT pkg_id, 'numbering', 'word/numbering.xml', 'r3' FROM doc",
)
def s8(spark, d):
    return ooxml.format_roles(ooxml.relationships(D.members(spark, d)))


THEME_XML = (
    '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme><a:accent1><a:srgbClr val="%s"/></a:accent1>'
    '<a:dk1><a:sysClr lastClr="000000"/></a:dk1></a:clrScheme><a:fontScheme><a:minorFont><a:latin typeface="%s"/><a:font script="Jpan" typeface="Mincho"/></a:minorFont>'
    "</a:fontScheme></a:themeElements></a:theme>"
)


@query(
    "s9_theme", ["doc"],
    """SELECT pkg_id, unnest(['color', 'color', 'font', 'font']) AS kind, unnest(['accent1', 'dk1', 'latin', 'Jpan']) AS script, unnest([substr(md5(text), 1, 6), '000000', 'Face ' || lang, 'Mincho']) AS value FROM doc""",
)
def s9(spark, d):
    xml = F.format_string(THEME_XML, F.substring(F.md5("text"), 1, 6), F.concat(F.lit("Face "), "lang"))
    parts = A.docs(spark, d).select("pkg_id", F.lit("word/theme/theme1.xml").alias("name"), F.encode(xml, "UTF-8").alias("content"))
    return ooxml.theme(parts).select("pkg_id", "kind", "script", "value")


@query("s9_font_table", [], "SELECT DISTINCT c.o_custkey AS pkg_id, p.name, p.alt AS alt_name FROM (SELECT DISTINCT o_custkey FROM orders) c, LATERAL (VALUES ('Font & ' || c.o_custkey, 'Alt'), ('Solo', NULL)) p(name, alt)")
def s9_fonts(spark, d):
    ids = A.table(spark, d, "orders").select(F.col("o_custkey").alias("pkg_id")).distinct()
    xml = F.format_string(
        f'<w:fonts {D.W}><w:font w:name="Font &amp; %d"><w:altName w:val="Alt"/></w:font><w:font w:name="Solo"/></w:fonts>', F.col("pkg_id")
    )
    parts = ids.select("pkg_id", F.lit("word/fontTable.xml").alias("name"), F.encode(xml, "UTF-8").alias("content"))
    return ooxml.font_table(parts).select("pkg_id", "name", "alt_name")


@query("s10_section_layouts", ["doc"], "SELECT pkg_id, CAST(0 AS BIGINT) AS idx, 'pgSz' AS tag, 'h=16838;w=11906' AS attrs FROM doc")
def s10(spark, d):
    rows = ooxml.sections(ooxml.content(D.document_parts(spark, d)))
    return rows.select("pkg_id", F.col("idx").cast("bigint").alias("idx"), "tag", props.sorted_signature(F.col("attrs")).alias("attrs"))


EDIT_JSON = "concat('{\"styles\":[{\"style_id\":\"H', CAST(1 + n_chars % 3 AS STRING), '\",\"size_pt\":\"', CAST(n_chars % 40 AS STRING), '\",\"bold\":\"true\"}]', CASE WHEN n_chars % 5 = 0 THEN ',\"x\":1' ELSE '' END, '}')"


@query(
    "s11_edit_requests", ["doc"],
    """SELECT pkg_id AS pack_id, 'H' || (1 + n_chars % 3) AS style_id, f.field, CASE f.field WHEN 'bold' THEN 'true' ELSE CAST(n_chars % 40 AS VARCHAR) END AS value
       FROM doc CROSS JOIN (VALUES ('size_pt'), ('bold')) f(field) WHERE n_chars % 5 <> 0 AND n_chars % 7 <> 0""",
)
def s11(spark, d):
    n, text = F.col("n_chars"), F.expr(EDIT_JSON)
    rows = A.docs(spark, d).select(
        F.col("pkg_id").alias("pack_id"), text.alias("inline"), F.when(n % 7 == 0, text).alias("file")
    )
    return edit_requests.edits(rows)[0].select("pack_id", "style_id", "field", "value")


@query("s12_tree_manifest", [], "SELECT lang || '/' || doc_id AS name, sha256(text) AS sha256, false AS outside FROM documents WHERE lang <> 'es' UNION ALL SELECT NULL, sha256(text), true FROM documents WHERE lang = 'es'")
def s12(spark, d):
    root = F.when(F.col("lang") == "es", F.lit("/other/")).otherwise(F.lit("/tree/"))
    files = A.docs(spark, d).select(
        F.concat(root, "lang", F.lit("/"), F.col("pkg_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return packages.tree_manifest(files, "/tree/").select("name", "sha256", "outside")


@query(
    "s12_tree_digest", [],
    """WITH f AS (SELECT lang || '/' || doc_id AS name, sha256(text) AS h FROM documents WHERE lang <> 'es'), e AS (SELECT substr(sha256(name), 1, 2) AS shard, sha256(h || ' ' || name) AS entry FROM f),
       s AS (SELECT shard, sha256(string_agg(entry, '' ORDER BY entry)) AS digest FROM e GROUP BY ALL) SELECT sha256(string_agg(digest, '' ORDER BY shard)) AS digest FROM s""",
)
def s12_digest(spark, d):
    files = A.docs(spark, d).filter("lang <> 'es'").select(
        F.concat(F.lit("/tree/"), "lang", F.lit("/"), F.col("pkg_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return packages.tree_digest(packages.tree_manifest(files, "/tree/"))


# --- library jobs and sinks ------------------------------------------------------

def pack_rows(spark, d):
    parts = A.turns(spark, d).select(
        F.col("pkg_id").alias("pack_id"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("name"), F.encode("text", "UTF-8").alias("content")
    )
    return library.part_hashes(parts)


def scratch(spark) -> str:
    """Folder for job output, below the folder that all executors share."""
    return f"{shared_folder(spark)}/galley-{uuid.uuid4().hex}"


@query(
    "k1_pack_sink", [],
    "SELECT conv_id AS pack_id, count(*) AS parts, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY ALL",
)
def k1(spark, d):
    folder = scratch(spark)
    parts = pack_rows(spark, d)
    for _ in range(2):  # a repeated run replaces its rows
        sinks.write_packs(library.fingerprint(parts), parts, folder, "first", buckets=8)
    stored = spark.read.parquet(f"{folder}/pack_parts")
    return stored.groupBy("pack_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query(
    "k3_pack_export", [],
    "SELECT conv_id AS pack_id, CAST(turn AS BIGINT) AS turn FROM conversations WHERE conv_id % 3 = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
)
def k3(spark, d):
    rows = A.turns(spark, d).withColumnRenamed("pkg_id", "pack_id")
    bad = rows.filter("role = 'system'").select("pack_id", F.lit("x").alias("rule"))
    packs = rows.select("pack_id").distinct()
    return sinks.export_packs(packs, rows, bad, packs.filter("pack_id % 3 = 0"))[1].select("pack_id", "turn")


@query(
    "s3_pack_scan", [],
    "SELECT conv_id AS pack_id, count(*) AS parts, CAST(1 AS BIGINT) AS schema_version FROM conversations GROUP BY ALL",
)
def s3(spark, d):
    from galley.sources.packs import split_packs

    # A turn without a number is a part too.
    parts = pack_rows(spark, d).select("pack_id", F.concat(F.lit("parts/"), F.coalesce("name", F.lit(""))).alias("name"), "content")
    manifest = parts.select("pack_id").distinct().select(
        "pack_id", F.lit("manifest.json").alias("name"), F.encode(F.lit('{"schema_version":1}'), "UTF-8").alias("content")
    )
    whole = parts.unionByName(manifest).select(
        F.col("pack_id").alias("pkg_id"), "name", F.lit(False).alias("is_dir"), "content", F.lit(None).cast("string").alias("fault")
    )
    split = split_packs(whole)
    counted = split["parts"].groupBy("pack_id").agg(F.count(F.lit(1)).alias("parts"))
    packs = split["packs"].select(F.col("pack_id").alias("of"), F.col("manifest.schema_version").cast("bigint").alias("schema_version"))
    return counted.join(packs, F.col("pack_id").eqNullSafe(F.col("of"))).drop("of")


HEALTH = """WITH p AS (SELECT conv_id AS pack_id, count(*) AS n FROM conversations GROUP BY ALL),
    r AS (SELECT pack_id, unnest(['missing_part', 'missing_part', 'missing_part']) AS rule FROM p UNION ALL SELECT conv_id, 'hash_mismatch' FROM conversations WHERE turn % 6 = 5
    UNION ALL SELECT pack_id, 'part_count' FROM p WHERE pack_id % 9 = 0)"""


def library_health(spark, d):
    parts = pack_rows(spark, d)
    size = F.octet_length("content").cast("bigint")
    inventory = parts.select(
        F.col("pack_id").alias("pkg_id"), F.concat(F.lit("parts/"), "name").alias("name"), size.alias("file_size"), size.alias("compress_size"),
        F.lit(8).alias("compress_type"), F.lit(0).alias("flag_bits"), F.lit(False).alias("is_dir"),
    )
    declared = parts.select("pack_id", "name", F.when(F.col("name").cast("int") % 6 == 5, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    packs = library.fingerprint(parts).select(
        "pack_id", "fingerprint", "part_count", F.lit(1).alias("schema_version"), F.col("fingerprint").alias("declared_fingerprint"),
        (F.col("part_count") + F.when(F.col("pack_id") % 9 == 0, 1).otherwise(0)).alias("declared_parts"),
    )
    return pack_plan.health(inventory, parts, packs, declared)


@query("g7_library_health", [], f"{HEALTH} SELECT pack_id, rule, count(*) AS n FROM r GROUP BY ALL")
def g7(spark, d):
    return library_health(spark, d).groupBy("pack_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s4_library_listing", [],
    """SELECT o_orderkey AS pack_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderstatus <> 'F' ORDER BY created_at DESC, pack_id""",
)
def s4(spark, d):
    from galley.sources.packs import listing

    o = A.table(spark, d, "orders")
    packs = o.select(F.col("o_orderkey").alias("pack_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    bad = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pack_id"), F.lit("broken").alias("rule"))
    return listing(packs, bad)[0]


@query(
    "g6_library_import", [],
    f"""WITH RECURSIVE {L.import_sql(f"{L.ARRIVALS_SQL} WHERE NOT ({L.BROKEN_PACK})", L.STORED_SQL)}
        SELECT seq, action FROM walk WHERE i > 0 UNION ALL SELECT doc_id, 'reject' FROM documents WHERE {L.BROKEN_PACK}""",
)
def g6(spark, d):
    incoming = L.arrivals(spark, d)
    broken = incoming.select("pack_id", F.lit("layout_tag").alias("rule")).filter("pack_id LIKE '%7'")
    return pack_plan.import_library(incoming, L.stored_packs(spark, d), broken).select("seq", "action")


# A manifest without faults, but for the id and name that each arrival brings.
T_MANIFEST = (
    '{"schema_version":%d,"used_formats":[],"used_table_styles":[],"used_style_count":1,"format_part_count":1,"manual_formatting":{"paragraph_count":0,"run_count":0},'
    '"document_summary":{"paragraph_count":0,"run_count":0,"table_count":0,"section_count":1},"page_layout":{"width_cm":21.0}}' % PACK_SCHEMA_VERSION
)


@query(
    "t1_import_stream", [],
    f"""WITH RECURSIVE {L.import_sql(f"{L.ARRIVALS_SQL} WHERE {L.GOOD_NAME}", L.NOTHING_STORED)}
        SELECT seq, action, library_id FROM walk WHERE i > 0 UNION ALL SELECT doc_id, 'reject', NULL FROM documents WHERE NOT ({L.GOOD_NAME})""",
)
def t1(spark, d):
    folder = scratch(spark)
    stream = spark.readStream.schema("doc_id bigint, text string, lang string, source string, n_chars bigint").parquet(f"{d}/documents.parquet*")
    arrivals = stream.select(
        F.col("doc_id").alias("seq"), F.expr(L.PACK_ID).alias("pack_id"), F.sha2("text", 256).alias("fingerprint"), F.col("lang").alias("identity")
    )
    # V3 on what an arrival tells about its manifest; the id of some is too long for the rule.
    shape = T_MANIFEST

    def rules(batch):
        m = F.from_json(F.lit(shape), MANIFEST)
        odd = F.when(F.col("pack_id").like("%7"), F.repeat(F.lit("x"), 129)).otherwise(F.col("pack_id"))
        rows = batch.select("pack_id", m.withField("id", odd).withField("name", F.col("pack_id")).alias("manifest"))
        return quality.manifest_rules(rows).select("pack_id", "rule")

    ingest.import_stream(arrivals, f"{folder}/library", f"{folder}/log", f"{folder}/state", rules).awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("seq", "action", "library_id")


@query(
    "t2_refresh_stream", [],
    "SELECT 'p' || user_id AS pack_id, count(*) AS n FROM events GROUP BY ALL",
)
def t2(spark, d):
    folder = scratch(spark)
    schema = A.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    pairs = stream.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("pack_id"), F.col("event_id").cast("string").alias("pkg_id"),
        F.sha2("event_type", 256).alias("pack_sha256"), F.sha2("props", 256).alias("target_sha256"), F.lit("").alias("options"),
    )
    for _ in range(2):
        ingest.refresh_stream(pairs, f"{folder}/reports", f"{folder}/state", lambda df: df).awaitTermination()
    return spark.read.parquet(f"{folder}/reports").groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))


# --- profile, preflight, apply -----------------------------------------------------


def corpus(spark, d):
    sheet = A.styles(spark, d)
    n = A.numbering(spark, d)
    docs = A.docs(spark, d)
    c = F.col("n_chars")
    face = lambda kind, grp, script, value: F.struct(F.lit(kind).alias("kind"), F.lit(grp).alias("grp"), F.lit(script).alias("script"), value.alias("value"))
    theme = docs.select("pkg_id", F.lit(0).alias("ord"), F.inline(F.array(
        face("font", "major", "latin", F.lit("Major Face")), face("font", "minor", "latin", F.lit("Latin Face")),
        face("color", "", "accent1", F.when(c % 2 == 0, F.lit("AA0000")).otherwise(F.lit("zz"))),
    )))
    named = F.expr(joins.NAMED_TABLE)
    settings = docs.select("pkg_id", F.inline(F.array(
        F.struct(F.lit("zoom").alias("tag"), F.create_map(F.lit("val"), c.cast("string")).alias("attrs")),
        F.struct(F.lit("defaultTableStyle").alias("tag"), F.create_map(F.lit("val"), F.coalesce(named, F.lit(""))).alias("attrs")),
    )))
    return profile_plan.Corpus(
        nodes=A.nodes(spark, d), styles=sheet, nums=n["nums"], abstracts=n["abstracts"], levels=n["levels"], overrides=n["overrides"],
        theme=theme, languages=docs.select("pkg_id", F.lit("en").alias("lang")), settings=settings,
    )


# A table without a style counts as the one its settings name, if there is such a style, else as the usual one.
TABLE_USUAL = "SELECT f.pkg_id, CASE WHEN d.n_chars % 3 = 0 THEN 'GridA' ELSE f.style_id END AS style_id FROM dflt f JOIN doc d ON d.pkg_id = f.pkg_id WHERE f.style_type = 'table'"


@query(
    "g1_profile", STYLED_NEEDS + ["run", "tbl", "tpl", "lattr", "doc"],
    f"""WITH used AS (SELECT pkg_id, 'paragraph' AS type, sid AS style_id, count(*) AS n FROM ({STYLED}) WHERE sid IS NOT NULL GROUP BY ALL
          UNION ALL SELECT pkg_id, 'character', style_id, count(*) FROM run WHERE style_id IS NOT NULL GROUP BY ALL
          UNION ALL SELECT t.pkg_id, 'table', coalesce(t.style_id, f.style_id), count(*) FROM tbl t LEFT JOIN ({TABLE_USUAL}) f ON f.pkg_id = t.pkg_id GROUP BY ALL)
        SELECT u.pkg_id, u.type, u.style_id, u.n AS usage_count, coalesce(t.name, u.style_id) AS name, CAST(sz.val AS BIGINT) * 50 AS size FROM used u JOIN doc d ON d.pkg_id = u.pkg_id
        LEFT JOIN tpl t ON t.lang = d.lang AND t.style_id = u.style_id LEFT JOIN lattr sz ON sz.lang = d.lang AND sz.style_id = u.style_id AND sz.prop = 'sz'""",
)
def g1(spark, d):
    formats = profile_plan.profile(corpus(spark, d)).formats.filter("NOT inferred")
    return formats.select("pkg_id", "type", "style_id", "usage_count", "name", F.round(F.col("size_pt") * 100).cast("bigint").alias("size"))


@query(
    "g1_from_files", STYLED_NEEDS + ["doc"],
    f"""SELECT pkg_id || '.docx' AS pkg_id, sid AS style_id, count(*) AS usage_count FROM ({STYLED}) WHERE sid IS NOT NULL
        AND NOT ({CUT} OR {EMPTY} OR {BROKEN} OR pkg_id % 13 = 5) GROUP BY ALL""",
)
def g1_from_files(spark, d):
    """Files to scan to profile: paragraph styles with their counts."""
    folder = scratch(spark)
    scanned = packages.store_scan(D.archives(spark, d), folder)
    formats = profile_plan.profile(corpus_of(scanned, f"{folder}/corpus")).formats
    return formats.filter("NOT inferred AND type = 'paragraph'").select("pkg_id", "style_id", "usage_count")


@query("g2_create_packs")
def g2(spark, d):
    packs, _ = created_packs(spark, d)
    return packs.select("pack_id", "stem", "fingerprint", "part_count", F.to_json("manifest").alias("manifest"))


WORD_SPACE = f' xmlns:w="{WORD}"'
LAYOUT_SQL = f"""list_filter([
      '<w:pgSz{WORD_SPACE} w:h="' || {A.SECTION_HEIGHT} || '" w:w="' || {A.SECTION_WIDTH} || '"/>', '<w:pgMar{WORD_SPACE} w:left="' || {A.SECTION_LEFT} || '" w:top="1440"/>',
      CASE WHEN idx = 0 THEN '<w:titlePg{WORD_SPACE}/>' END], lambda x: x IS NOT NULL)"""


@query(
    "g2_applied_metadata", STYLED_NEEDS + ["tbl", "tpl", "doc", "sect"],
    f"""WITH t AS (SELECT t.pkg_id, coalesce(t.style_id, f.style_id) AS style_id, count(*) AS n, min(part || lpad(CAST(t.ord AS VARCHAR), 12, '0')) AS seen FROM tbl t
          LEFT JOIN ({TABLE_USUAL}) f ON f.pkg_id = t.pkg_id GROUP BY ALL),
        known AS (SELECT t.* FROM t WHERE style_id IN (SELECT style_id FROM tpl WHERE style_type = 'table')),
        best AS (SELECT pkg_id, style_id FROM known QUALIFY row_number() OVER (PARTITION BY pkg_id ORDER BY n DESC, seen) = 1),
        s AS (SELECT pkg_id, string_agg(array_to_string(list_transform(l, lambda x: base64(encode(x))), ','), ';' ORDER BY idx) AS layouts FROM (SELECT pkg_id, idx, {LAYOUT_SQL} AS l FROM sect) GROUP BY ALL)
        SELECT 'pack-' || d.pkg_id AS pack_id, coalesce((SELECT string_agg(style_id, ',' ORDER BY style_id) FROM t WHERE t.pkg_id = d.pkg_id), '') AS used_table_styles,
          coalesce(b.style_id, f.style_id) AS preferred_table_style, s.layouts AS section_layouts
        FROM doc d JOIN dflt f ON f.pkg_id = d.pkg_id AND f.style_type = 'table' LEFT JOIN best b ON b.pkg_id = d.pkg_id JOIN s ON s.pkg_id = d.pkg_id""",
)
def g2_applied_metadata(spark, d):
    """What a pack applies beyond its parts: layouts of all sections and table styles."""
    packs, _ = created_packs(spark, d)
    m = F.col("manifest")
    return packs.select(
        "pack_id", F.array_join(m["used_table_styles"], ",").alias("used_table_styles"), m["preferred_table_style"].alias("preferred_table_style"),
        F.array_join(F.transform(m["section_layouts"], lambda x: F.array_join(x, ",")), ";").alias("section_layouts"),
    )


@query(
    "g2_round_trip", STYLED_NEEDS + ["run", "tbl", "tpl", "lattr", "doc"],
    f"""WITH used AS (SELECT pkg_id, 'p' || sid AS style_id FROM ({STYLED}) WHERE sid IS NOT NULL UNION SELECT pkg_id, 'c' || style_id FROM run WHERE style_id IS NOT NULL
          UNION SELECT t.pkg_id, 't' || coalesce(t.style_id, f.style_id) FROM tbl t LEFT JOIN ({TABLE_USUAL}) f ON f.pkg_id = t.pkg_id)
        SELECT 'pack-' || d.pkg_id AS pack_id, count(DISTINCT u.style_id) AS used_formats, CAST(4 AS BIGINT) AS parts, CAST(4 AS BIGINT) AS declared, CAST(0 AS BIGINT) AS violations
        FROM doc d LEFT JOIN used u ON u.pkg_id = d.pkg_id GROUP BY ALL""",
)
def g2_round_trip(spark, d):
    """Store packs, read the manifests back by the fixed schema and run the rules on them."""
    folder = scratch(spark)
    packs, parts = created_packs(spark, d)
    sinks.write_packs(packs.select("pack_id", "fingerprint", "part_count", F.to_json("manifest").alias("json")), parts, folder, "first")
    read = settled(parse_manifests(spark.read.parquet(f"{folder}/packs")))
    hashes = spark.read.parquet(f"{folder}/pack_parts").select("pack_id", "name", "sha256")
    m = F.col("manifest")
    values = read.select(
        "pack_id", "part_count", m["schema_version"].alias("schema_version"), m["format_fingerprint"].alias("declared_fingerprint"), "fingerprint", m["format_part_count"].alias("declared_parts")
    )
    declared = declared_parts(read)
    found = quality.manifest_rules(read).select("pack_id").unionByName(quality.integrity_rules(values, library.reconcile(declared, hashes)).select("pack_id"))
    bad = found.groupBy("pack_id").agg(F.count(F.lit(1)).alias("violations"))
    listed = read.select("pack_id", F.size(F.filter(m["used_formats"], lambda f: ~f["inferred"])).cast("bigint").alias("used_formats"), F.col("part_count").cast("bigint").alias("parts"))
    counted = declared.groupBy("pack_id").agg(F.count(F.lit(1)).alias("declared"))
    return listed.join(counted, "pack_id").join(bad, "pack_id", "left").fillna(0, ["violations"])


def created_packs(spark, d):
    names = A.docs(spark, d).select(
        "pkg_id", F.concat(F.lit("pack-"), F.col("pkg_id").cast("string")).alias("pack_id"), F.concat("source", F.lit(" "), "lang").alias("name"), F.lit("2024-01-01T00:00:00+00:00").alias("created_at")
    )
    described = pack_plan.manifests(profile_plan.profile(corpus(spark, d)), names)
    parts = D.members(spark, d).filter("name IN ('word/styles.xml', 'word/numbering.xml', '[Content_Types].xml', 'word/_rels/document.xml.rels')")
    return pack_plan.create_packs(described, parts)


def pack_summaries(spark):
    have = A.pack_authority(spark).groupBy(F.col("pkg_id").alias("pack_id")).agg(F.array_sort(F.collect_set("level")).alias("levels"))
    tables = joins.pack_tables(spark)
    return have.join(tables, "pack_id").select(
        "pack_id", "levels", F.sha2("pack_id", 256).alias("pack_sha256"), F.array(F.lit("Arial"), "pack_id").alias("fonts"),
        (F.size("used_styles") > 0).alias("has_tables"), F.array(F.lit("check"), F.lit("has_revisions")).alias("warnings"),
    )


def preflights(spark, d):
    docs = A.docs(spark, d).select("pkg_id", F.sha2("text", 256).alias("target_sha256"), F.col("text").contains("@").alias("revised"), F.lit(False).alias("signed"), F.lit(False).alias("macros"))
    # Read twice, by the pairs and by the demotions they ask for.
    targets = settled(preflight_plan.target_facts(A.nodes(spark, d), leveled(spark, d), docs))
    pairs = A.requests(spark, d).withColumns({"demote": F.col("pkg_id") % 2 == 0, "keep_layout": F.col("pack_id") == "cedar"})
    return preflight_plan.preflight(pairs, targets, pack_summaries(spark))


PREFLIGHT_NEEDS = HEADED_NEEDS + ["req", "pauth", "run", "tbl", "sect", "ptab", "doc"]
@query(
    "j21_pack_target_impact", PREFLIGHT_NEEDS,
    f"""WITH pre AS (SELECT r.pkg_id, r.pack_id, r.pkg_id % 2 = 0 AS demote FROM req r), bodylv AS (SELECT DISTINCT pkg_id, level FROM ({LEVELED}) WHERE part = 'word/document.xml' AND level IS NOT NULL),
        a AS (SELECT pack_id, list(level) AS have FROM pauth GROUP BY ALL),
        w AS (SELECT p.pkg_id, p.pack_id, a.have, list(DISTINCT least(8, b.level + 1)) AS want FROM pre p JOIN bodylv b ON b.pkg_id = p.pkg_id JOIN a ON a.pack_id = p.pack_id WHERE p.demote GROUP BY ALL),
        m AS (SELECT *, list_filter(want, lambda x: NOT list_contains(have, x)) AS gone FROM w),
        blocked AS (SELECT pkg_id, pack_id FROM m WHERE len(gone) > 0 AND NOT (list_has_all(have, [0, 1, 2]) AND list_max(gone) >= 3 AND list_min(gone) >= 3)),
        lv AS (SELECT pkg_id, CAST(sum(n) AS BIGINT) AS moved, string_agg((level + 1) || '=' || n, ',' ORDER BY level) AS heading_levels FROM (SELECT pkg_id, level, count(*) AS n FROM ({LEVELED}) WHERE part = 'word/document.xml' AND level IS NOT NULL GROUP BY ALL) GROUP BY ALL)
        SELECT p.pkg_id, p.pack_id, coalesce(lv.heading_levels, '') AS heading_levels, CASE WHEN p.demote THEN coalesce(lv.moved, 0) ELSE 0 END AS demotions,
          CASE WHEN len(t.used_styles) > 0 THEN 'apply_pack_table_style' ELSE 'preserve_target_remove_two_character_indent' END AS table_action,
          concat_ws(',', 'check', 'has_revisions', CASE WHEN len(t.used_styles) = 0 AND EXISTS (SELECT 1 FROM tbl x WHERE x.pkg_id = p.pkg_id) THEN 'tables_kept' END) AS warnings
        FROM pre p JOIN ptab t ON t.pack_id = p.pack_id LEFT JOIN lv ON lv.pkg_id = p.pkg_id WHERE (p.pkg_id, p.pack_id) NOT IN (SELECT (pkg_id, pack_id) FROM blocked)""",
)
def j21(spark, d):
    report, _ = preflights(spark, d)
    levels = F.transform("heading_levels", lambda e: F.concat(e["level"].cast("string"), F.lit("="), e["n"].cast("string")))
    return report.select("pkg_id", "pack_id", F.array_join(levels, ",").alias("heading_levels"), "demotions", "table_action", F.array_join("warnings", ",").alias("warnings"))


@query("g3_preflight_rejects")
def g3(spark, d):
    _, rejected = preflights(spark, d)
    return rejected.select("pack_id", "pkg_id", "rule", F.array_join(F.transform("unresolved", lambda x: x.cast("string")), ",").alias("unresolved"))


def paragraph_plan(spark, d, facts=None):
    resolved, defaults = facts = facts or sheet_facts(spark, d)
    rows = leveled(spark, d, facts)
    wanted = A.numbering(spark, d)["nums"].select("pkg_id", "num_id", "abstract_id")
    used = A.docs(spark, d).select("pkg_id", F.lit(30).alias("max_num"), F.lit(None).cast("array<string>").alias("abstract_ids"))
    authority = A.pack_authority(spark).select(F.col("pkg_id").alias("pack_id"), "style_id")
    return apply_plan.plan_paragraphs(
        A.paragraphs(spark, d).join(A.requests(spark, d), "pkg_id"), resolved, defaults, A.pack_index(spark), A.pack_rules(spark), authority,
        joins.pack_tables(spark), apply_plan.list_plan(rows, wanted, used),
    )


PLAN = joins.PEERED


@query(
    "k2_rewrite_plan", joins.PAR_NEEDS + ["prule", "nums", "ptab"],
    f"""WITH x AS ({PLAN}), given AS (SELECT pkg_id, num_id, '0' AS nn FROM (SELECT DISTINCT pkg_id, num_id FROM ({LEVELED}) WHERE level IS NULL AND num_id = '0') UNION ALL
          SELECT w.pkg_id, w.num_id, CAST(30 + row_number() OVER (PARTITION BY w.pkg_id ORDER BY CAST(w.num_id AS BIGINT)) AS VARCHAR)
          FROM (SELECT DISTINCT pkg_id, num_id FROM ({LEVELED}) WHERE level IS NULL AND num_id IS NOT NULL) w JOIN nums n ON n.num_id = w.num_id WHERE w.num_id <> '0')
        SELECT x.pkg_id, x.pack_id, x.ord, x.peered AS mapped, CASE WHEN r.style_id IS NOT NULL THEN r.num_id WHEN x.tout IS NULL THEN g.nn END AS new_num_id,
          r.style_id IS NOT NULL AS numbered, x.peered IS NOT NULL AND x.peered IS DISTINCT FROM x.style_id AS restyled
        FROM x LEFT JOIN prule r ON r.pack_id = x.pack_id AND r.style_id = x.peered LEFT JOIN given g ON g.pkg_id = x.pkg_id AND g.num_id = x.num_id""",
)
def k2(spark, d):
    folder = scratch(spark)
    plan = paragraph_plan(spark, d)
    keep = plan.select("pkg_id", "pack_id", "ord", "mapped", "new_num_id", F.col("rule").isNotNull().alias("numbered"), "restyled")
    sinks.write_plan({"paragraphs": keep}, folder, "first")
    return spark.read.parquet(f"{folder}/plan_paragraphs").drop("run")


def statistics(spark, d):
    pairs, facts = A.requests(spark, d), sheet_facts(spark, d)
    paras = paragraph_plan(spark, d, facts)
    paras = paras.withColumns({c: F.lit(False) for c in ("indent_applied", "indent_cleared", "hardened")})
    runs = apply_plan.plan_runs(apply_plan.alike(A.runs(spark, d).withColumn("kind", F.lit("run"))).join(pairs, "pkg_id"), joins.run_map(spark, d, facts[0]))
    boxes = A.tables(spark, d).withColumn("kind", F.lit("table")).select("pkg_id", "kind", "style_id", "bag").unionByName(
        A.cells(spark, d).select("pkg_id", F.lit("cell").alias("kind"), F.lit(None).cast("string").alias("style_id"), "bag")
    )
    named = joins.table_map(spark, d, facts[0]).drop("preserved").select("pkg_id", "pack_id", F.coalesce("style_id", F.lit("")).alias("_k"), "mapped")
    tables = (
        apply_plan.alike(boxes).join(pairs, "pkg_id").withColumn("_k", F.coalesce("style_id", F.lit("")))
        .join(joins.pack_tables(spark).select("pack_id", (F.size("used_styles") == 0).alias("preserved")), "pack_id")
        .join(named, ["pkg_id", "pack_id", "_k"], "left")
        .withColumn("restyled", (F.col("kind") == "table") & ~F.col("preserved") & ~F.col("mapped").eqNullSafe(F.col("style_id")))
    )
    layouts = A.literal(spark, T.PACK_LAYOUTS, "pack_id string, idx int, width int, height int").filter("pack_id <> 'delta'")
    sections = mapping.section_layouts(A.sections(spark, d).join(pairs, "pkg_id").withColumn("part", F.lit("word/document.xml")), layouts)
    parts = A.nodes(spark, d).select("pkg_id", "part").distinct()
    source = A.literal(spark, T.PACK_SETTINGS, "pack_id string, tag string, value string")
    target = A.docs(spark, d).select("pkg_id", F.lit("zoom").alias("tag"), F.lit("1").alias("value")).join(pairs, "pkg_id")
    return apply_plan.statistics(pairs, parts, paras, runs, tables, sections, mapping.merge_settings(target, source))


@query(
    "a16_transfer_statistics", joins.PAR_NEEDS + ["run", "tbl", "cell", "sect", "pset", "ptab", "prule"],
    f"""WITH x AS ({PLAN}), p AS (SELECT pkg_id, pack_id, count(*) AS paragraphs_seen, count(*) FILTER (peered IN (SELECT style_id FROM prule r WHERE r.pack_id = x.pack_id)) AS heading_numbers_applied FROM x GROUP BY ALL),
        r AS (SELECT q.pkg_id, q.pack_id, count(*) AS runs_seen, CAST(sum({" + ".join(f"CASE WHEN {A.RUN_FLAGS[f]} THEN 1 ELSE 0 END" for f in ("b", "u"))}) AS BIGINT) AS run_properties_removed FROM run x JOIN req q ON q.pkg_id = x.pkg_id GROUP BY ALL),
        t AS (SELECT q.pkg_id, q.pack_id, count(*) AS tables_seen, count(*) FILTER (len(u.used_styles) = 0) AS table_formats_preserved FROM tbl x JOIN req q ON q.pkg_id = x.pkg_id JOIN ptab u ON u.pack_id = q.pack_id GROUP BY ALL),
        s AS (SELECT s.pkg_id, q.pack_id, count(*) AS n FROM sect s JOIN req q ON q.pkg_id = s.pkg_id WHERE q.pack_id <> 'delta' GROUP BY ALL), g AS (SELECT pack_id, count(*) AS n FROM pset WHERE tag NOT IN ('zoom', 'rsids') GROUP BY ALL)
        SELECT p.*, r.runs_seen, r.run_properties_removed, coalesce(t.tables_seen, 0) AS tables_seen, coalesce(t.table_formats_preserved, 0) AS table_formats_preserved, coalesce(s.n, 0) AS sections_updated, coalesce(g.n, 0) AS settings_items_imported, CAST(0 AS BIGINT) AS heading_level9_unchanged
        FROM p JOIN r USING (pkg_id, pack_id) LEFT JOIN t USING (pkg_id, pack_id) LEFT JOIN s USING (pkg_id, pack_id) LEFT JOIN g ON g.pack_id = p.pack_id""",
)
def a16(spark, d):
    return statistics(spark, d).select(
        "pkg_id", "pack_id", "paragraphs_seen", "heading_numbers_applied", "runs_seen", "run_properties_removed", "tables_seen", "table_formats_preserved",
        "sections_updated", "settings_items_imported", "heading_level9_unchanged",
    )


# --- the whole transfer ---------------------------------------------------------
#
# Packs as sources of a transfer, for the oracle: a request with a demotion may need headings that its pack gets for it.

BODY_LEVELS = f"SELECT pkg_id, list(DISTINCT level) AS levels FROM ({LEVELED}) WHERE part = 'word/document.xml' AND level IS NOT NULL GROUP BY ALL"
HAVE = "SELECT pack_id, list(level) AS have FROM pauth GROUP BY ALL"
ASKED = f"""SELECT *, CASE WHEN list_has_all(have, [0, 1, 2]) AND reach > 0 THEN list_filter(missing, lambda x: x < 3) ELSE missing END AS unresolved,
      base || CASE WHEN demote THEN '#d' ELSE '#' END || reach AS pack_id FROM (
    SELECT *, CASE WHEN list_max(missing) >= 3 THEN list_max(missing) ELSE 0 END AS reach FROM (
    SELECT *, CASE WHEN demote THEN list_filter(list_distinct(list_transform(levels, lambda x: least(8, x + 1))), lambda x: NOT list_contains(have, x)) ELSE [] END AS missing FROM (
    SELECT r.pkg_id, r.pack_id AS base, r.pkg_id % 2 = 0 AS demote, coalesce(b.levels, []) AS levels, h.have
    FROM req r LEFT JOIN ({BODY_LEVELS}) b ON b.pkg_id = r.pkg_id LEFT JOIN ({HAVE}) h ON h.pack_id = r.pack_id)))"""
SOURCE_CTES = f"""asked AS (SELECT DISTINCT pkg_id, base, demote, reach, have, unresolved, pack_id FROM ({ASKED})),
    vreq AS (SELECT pkg_id, pack_id, base, CASE WHEN demote THEN 1 ELSE 0 END AS shift FROM asked WHERE len(unresolved) = 0),
    src AS (SELECT DISTINCT pack_id, base, reach, have FROM asked),
    made AS (SELECT m.pack_id, m.base, m.level, coalesce(h.style_id, 'Heading' || (m.level + 1)) AS style_id
      FROM (SELECT pack_id, base, unnest(list_filter(range(3, reach + 1), lambda x: NOT list_contains(have, x))) AS level FROM src WHERE list_has_all(have, [0, 1, 2])) m
      LEFT JOIN phead h ON h.pack_id = m.base AND h.level = m.level),
    vauth AS (SELECT s.pack_id, a.level, a.style_id FROM src s JOIN pauth a ON a.pack_id = s.base UNION ALL SELECT pack_id, level, style_id FROM made),
    vsty AS (SELECT s.pack_id, p.* EXCLUDE (pack_id) FROM src s JOIN psty p ON p.pack_id = s.base
      UNION ALL SELECT pack_id, 1000 + level, style_id, 'paragraph', 'heading ' || (level + 1), CAST([] AS VARCHAR[]), level, false, false FROM made),
    vname AS (SELECT pack_id, style_type, k, arg_min(style_id, ord * 100 + pos) AS style_id FROM (SELECT pack_id, style_type, ord, style_id,
        unnest(list_transform(list_concat([style_id, name], aliases), lambda x: {A.key('x')})) AS k,
        generate_subscripts(list_concat([style_id, name], aliases), 1) AS pos FROM vsty) WHERE k <> '' GROUP BY ALL),
    vhead AS (SELECT s.pack_id, h.level, h.style_id FROM src s JOIN phead h ON h.pack_id = s.base),
    vdflt AS (SELECT s.pack_id, f.style_type, f.style_id FROM src s JOIN pdflt f ON f.pack_id = s.base),
    vtab AS (SELECT s.pack_id, t.used_styles, t.preferred FROM src s JOIN ptab t ON t.pack_id = s.base),
    top AS (SELECT s.pack_id, coalesce(max(CAST(n.num_id AS BIGINT)), 0) AS top FROM src s LEFT JOIN pnum n ON n.pack_id = s.base GROUP BY ALL),
    own AS (SELECT s.pack_id, r.style_id, r.num_id, r.level, r.start, r.outline, a.level AS held FROM src s JOIN prule r ON r.pack_id = s.base
      LEFT JOIN pauth a ON a.pack_id = s.base AND a.style_id = r.style_id),
    merged AS (SELECT pack_id FROM own WHERE held < 3 AND level = held GROUP BY ALL HAVING count(DISTINCT held) = 3 INTERSECT SELECT pack_id FROM made),
    vrule AS (SELECT o.pack_id, o.style_id, CASE WHEN o.held < 3 AND m.pack_id IS NOT NULL THEN CAST(t.top + 1 AS VARCHAR) ELSE o.num_id END AS num_id, o.level, o.start, o.outline
      FROM own o JOIN top t ON t.pack_id = o.pack_id LEFT JOIN merged m ON m.pack_id = o.pack_id
      UNION ALL SELECT d.pack_id, d.style_id, CAST(t.top + 1 AS VARCHAR), d.level, 1, d.level FROM made d JOIN merged m ON m.pack_id = d.pack_id JOIN top t ON t.pack_id = d.pack_id),
    vprof AS (SELECT s.pack_id, p.style_id, p.i FROM src s JOIN pprof p ON p.pack_id = s.base
      UNION ALL SELECT d.pack_id, d.style_id, p.i FROM (SELECT d.pack_id, d.base, d.style_id, arg_max(a.style_id, a.level) AS upper FROM made d JOIN pauth a ON a.pack_id = d.base AND a.level < d.level GROUP BY ALL) d
        JOIN pprof p ON p.pack_id = d.base AND p.style_id = d.upper WHERE p.i IS NOT NULL)"""

# Paragraphs with inherited lists written out.
LISTED = f"""SELECT *, {A.TYPED_TEXT} AS ttext, CASE WHEN given THEN eff_num_id WHEN level IS NULL AND eff_num_id IS NOT NULL THEN eff_num_id ELSE num_id END AS num2,
      given OR num_id IS NOT NULL OR ilvl_raw IS NOT NULL AS has_list, given AND inherited AND eff_num_id <> '0' AS counted FROM (
    SELECT *, level IS NULL AND eff_num_id IS NOT NULL AND (eff_num_id IS DISTINCT FROM num_id OR eff_ilvl IS DISTINCT FROM CAST(ilvl_raw AS INT)) AS given FROM ({joins.EFF_NUM}))"""
LIST_CTES = f"""listed AS ({LISTED}),
    want AS (SELECT DISTINCT l.pkg_id, l.num2, c.abstract_id FROM listed l JOIN conc c ON c.lang = l.lang AND c.num_id = l.num2
      WHERE l.level IS NULL AND l.num2 <> '0' AND c.abstract_id IN (SELECT abstract_id FROM lvls)),
    given AS (SELECT r.pkg_id, r.pack_id, w.num2, w.abstract_id, CAST(t.top + CASE WHEN m.pack_id IS NULL THEN 0 ELSE 1 END
        + row_number() OVER (PARTITION BY r.pkg_id, r.pack_id ORDER BY CAST(w.num2 AS BIGINT)) AS VARCHAR) AS nn
      FROM want w JOIN vreq r ON r.pkg_id = w.pkg_id JOIN top t ON t.pack_id = r.pack_id LEFT JOIN merged m ON m.pack_id = r.pack_id
      UNION ALL SELECT DISTINCT l.pkg_id, r.pack_id, '0', NULL, '0' FROM listed l JOIN vreq r ON r.pkg_id = l.pkg_id WHERE l.level IS NULL AND l.num2 = '0')"""
MOVED = f"""SELECT x.*, CASE WHEN mapped IS NOT NULL AND desired IS NOT NULL AND mapped NOT IN (SELECT style_id FROM vrule WHERE pack_id = x.pack_id)
      AND mapped NOT IN (SELECT style_id FROM vauth WHERE pack_id = x.pack_id)
      THEN coalesce((SELECT min(style_id) FROM vrule WHERE pack_id = x.pack_id AND outline = x.desired), mapped) ELSE mapped END AS peered
    FROM ({joins.paragraph_sql('shift', 'v', 'vreq')}) x"""
PLAN_CTES = f"""mapped AS MATERIALIZED ({MOVED}),
    bad AS (SELECT DISTINCT pkg_id, pack_id FROM mapped WHERE fault IS NOT NULL),
    plan AS MATERIALIZED (SELECT x.*, l.ttext,
        l.num2, l.has_list, l.counted, g.nn, g.abstract_id, s.outline AS new_outline, s.two AND s.style_type = 'paragraph' AND s.outline IS NULL AS own_two,
        r.style_id IS NOT NULL AS numbered, r.num_id AS rule_num, r.level AS rule_level, CAST(r.start AS BIGINT) AS st,
        len(t.used_styles) = 0 AS bare, x.in_table AND len(t.used_styles) = 0 AS kept, x.step > 0 AND x.tout IS NOT NULL AS demoted, p.i AS ind
      FROM mapped x JOIN listed l ON l.pkg_id = x.pkg_id AND l.ord = x.ord LEFT JOIN vsty s ON s.pack_id = x.pack_id AND s.style_id = x.peered AND s.style_type = 'paragraph'
      LEFT JOIN given g ON g.pkg_id = x.pkg_id AND g.pack_id = x.pack_id AND g.num2 = l.num2
      LEFT JOIN vrule r ON r.pack_id = x.pack_id AND r.style_id = x.peered JOIN vtab t ON t.pack_id = x.pack_id
      LEFT JOIN vprof p ON p.pack_id = x.pack_id AND p.style_id = x.peered AND s.outline IS NOT NULL
      WHERE (x.pkg_id, x.pack_id) NOT IN (SELECT (pkg_id, pack_id) FROM bad)),
    own_count AS ({windows.counter_sql(windows.fitted_sql("SELECT pkg_id, pack_id, part, ord, plain, ttext, tout AS l, st FROM plan WHERE numbered AND demoted"), "pkg_id, pack_id, part")}),
    new_count AS ({windows.counter_sql("SELECT * EXCLUDE (typed, nums), CASE WHEN NOT demoted THEN typed END AS typed, CASE WHEN NOT demoted THEN nums END AS nums FROM ("
      + windows.fitted_sql("SELECT pkg_id, pack_id, part, ord, plain, ttext, rule_level AS l, st, demoted FROM plan WHERE numbered") + ")", "pkg_id, pack_id, part")}),
    typed AS (SELECT pkg_id, pack_id, part, ord, l, typed, coalesce(ok AND nums = path, false) AS matched, true AS demoted FROM own_count
      UNION ALL SELECT pkg_id, pack_id, part, ord, l, typed, coalesce(ok AND nums = path, false), false FROM new_count),
    seeds AS (SELECT pkg_id, pack_id, arg_min(typed, ord) AS seed FROM (SELECT * FROM typed WHERE l = 0 AND part = 'word/document.xml'
        QUALIFY row_number() OVER (PARTITION BY pkg_id, pack_id, demoted ORDER BY ord) = 1) WHERE matched AND typed > 0 GROUP BY ALL)"""
APPLY_NEEDS = joins.PAR_NEEDS + ["run", "tbl", "cell", "sect", "pset", "ptab", "prule", "pprof", "pnum", "conc", "lvls", "chain", "numpr"]
# Cells: the indent that is left, whether a list is left, a direct level that is left, and the style's two characters.
CELLS = """SELECT *, in_table AND (coalesce(chars, '') = '200' OR (two AND coalesce(chars, '0') = '0' AND NOT listed_now AND NOT level_now)) AS cleared FROM (
    SELECT p.*, CASE WHEN ind IS NOT NULL THEN NULL WHEN kept THEN ind_chars END AS chars, numbered OR (has_list AND tout IS NULL AND nn IS NOT NULL) AS listed_now,
      kept AND coalesce(direct_outline BETWEEN 0 AND 8, false) AND NOT pinned AS level_now,
      coalesce(CASE WHEN peered IS NOT NULL THEN own_two ELSE (SELECT bool_or(s.two) FROM vdflt f JOIN vsty s ON s.pack_id = f.pack_id AND s.style_id = f.style_id AND s.style_type = 'paragraph'
        WHERE f.pack_id = p.pack_id AND f.style_type = 'paragraph' AND s.outline IS NULL) END, false) AS two
    FROM (SELECT *, coalesce(peered IS NOT NULL AND tout IS NOT NULL AND new_outline = desired AND direct_outline IS NOT NULL, false) AS pinned FROM plan) p)"""
KEPT_FLAG = lambda flags, names: " + ".join(f"CASE WHEN {flags[n]} THEN 1 ELSE 0 END" for n in names)
APPLY_RUNS = joins.mapped_sql("SELECT DISTINCT x.pkg_id, r.pack_id, x.style_id, 'character' AS style_type FROM run x JOIN vreq r ON r.pkg_id = x.pkg_id WHERE x.style_id IS NOT NULL", v="v")
APPLY_TABLES = joins.mapped_sql("SELECT DISTINCT x.pkg_id, r.pack_id, x.style_id, 'table' AS style_type FROM tbl x JOIN vreq r ON r.pkg_id = x.pkg_id", v="v")


@query(
    "g4_apply_statistics", APPLY_NEEDS,
    f"""WITH {SOURCE_CTES}, {LIST_CTES}, {PLAN_CTES}, cells AS ({CELLS}),
      good AS (SELECT * FROM vreq WHERE (pkg_id, pack_id) NOT IN (SELECT (pkg_id, pack_id) FROM bad)),
      p AS (SELECT c.pkg_id, c.pack_id, count(*) AS paragraphs_seen, count(*) FILTER (numbered) AS heading_numbers_applied, count(*) FILTER (y.matched) AS heading_prefixes_removed,
          count(*) FILTER (peered IS NOT NULL AND peered IS DISTINCT FROM style_id) AS moved, count(*) FILTER (ind IS NOT NULL) AS heading_indents_applied,
          count(*) FILTER (cleared) AS table_paragraph_indents_cleared, count(*) FILTER (cleared AND two AND NOT listed_now AND NOT level_now) AS table_paragraph_styles_hardened,
          count(*) FILTER (NOT numbered AND tout IS NULL AND nn <> '0') AS body_list_paragraphs_preserved, count(*) FILTER (counted) AS style_list_paragraphs_materialized,
          count(*) FILTER (step > 0 AND tout < 8 AND new_outline = desired) AS heading_levels_demoted, count(*) FILTER (step > 0 AND tout >= 8 AND peered IS NOT NULL) AS heading_level9_unchanged,
          sum(CASE WHEN kept THEN CAST(pinned AS INT) ELSE CAST(has_list AS INT) + CAST(sp_before IS NOT NULL AS INT) + CAST(ind_left IS NOT NULL OR ind_chars IS NOT NULL AS INT)
            + CAST(jc IS NOT NULL AS INT) + CAST(direct_outline IS NOT NULL AS INT) END) AS paragraph_properties_removed
        FROM cells c LEFT JOIN (SELECT pkg_id, pack_id, part, ord, bool_or(matched) AS matched FROM typed GROUP BY ALL) y ON y.pkg_id = c.pkg_id AND y.pack_id = c.pack_id AND y.part = c.part AND y.ord = c.ord GROUP BY ALL),
      r AS (SELECT q.pkg_id, q.pack_id, count(*) AS runs_seen, sum({KEPT_FLAG(A.RUN_FLAGS, ("b", "u"))}) AS run_properties_removed,
          count(*) FILTER (x.style_id IS NOT NULL AND CASE WHEN m.mapped IS NOT NULL AND m.mapped IS DISTINCT FROM f.style_id THEN m.mapped WHEN m.mapped IS NOT NULL AND s.style_id IS NOT NULL THEN m.style_id END
            IS DISTINCT FROM x.style_id) AS moved
        FROM run x JOIN good q ON q.pkg_id = x.pkg_id LEFT JOIN ({APPLY_RUNS}) m ON m.pkg_id = x.pkg_id AND m.pack_id = q.pack_id AND m.style_id = x.style_id
        LEFT JOIN vdflt f ON f.pack_id = q.pack_id AND f.style_type = 'character' LEFT JOIN (SELECT DISTINCT pack_id, style_id FROM vsty) s ON s.pack_id = q.pack_id AND s.style_id = x.style_id GROUP BY ALL),
      t AS (SELECT q.pkg_id, q.pack_id, count(*) AS tables_seen, count(*) FILTER (len(u.used_styles) = 0) AS table_formats_preserved,
          sum(CASE WHEN len(u.used_styles) > 0 THEN {KEPT_FLAG(A.TABLE_FLAGS, ("tblBorders", "shd"))} ELSE 0 END) AS props,
          count(*) FILTER (len(u.used_styles) > 0 AND CASE WHEN list_contains(u.used_styles, m.mapped) THEN m.mapped ELSE coalesce(u.preferred, f.style_id, m.mapped) END IS DISTINCT FROM x.style_id) AS moved
        FROM tbl x JOIN good q ON q.pkg_id = x.pkg_id JOIN vtab u ON u.pack_id = q.pack_id
        LEFT JOIN ({APPLY_TABLES}) m ON m.pkg_id = x.pkg_id AND m.pack_id = q.pack_id AND m.style_id IS NOT DISTINCT FROM x.style_id
        LEFT JOIN vdflt f ON f.pack_id = q.pack_id AND f.style_type = 'table' GROUP BY ALL),
      c AS (SELECT q.pkg_id, q.pack_id, sum({KEPT_FLAG(A.CELL_FLAGS, ("shd", "tcBorders"))}) AS props FROM cell x JOIN good q ON q.pkg_id = x.pkg_id JOIN vtab u ON u.pack_id = q.pack_id
        WHERE len(u.used_styles) > 0 GROUP BY ALL),
      s AS (SELECT q.pkg_id, q.pack_id, count(*) AS n FROM sect x JOIN good q ON q.pkg_id = x.pkg_id WHERE q.base NOT IN ('delta', 'cedar') GROUP BY ALL),
      g AS (SELECT v.pack_id, count(*) AS n FROM src v JOIN pset x ON x.pack_id = v.base JOIN vtab u ON u.pack_id = v.pack_id
        WHERE x.tag IN ({", ".join(repr(t) for t in SETTINGS_TAGS)}) AND NOT (x.tag = 'defaultTableStyle' AND len(u.used_styles) = 0) GROUP BY ALL),
      d AS (SELECT pkg_id, pack_id, count(*) AS n, count(DISTINCT abstract_id) AS a FROM given WHERE nn <> '0' GROUP BY ALL),
      parts AS (SELECT pkg_id, count(DISTINCT part) AS n FROM (SELECT pkg_id, part FROM par UNION ALL SELECT pkg_id, 'word/document.xml' FROM doc) GROUP BY ALL)
      SELECT q.pkg_id, q.base AS pack_id, q.shift = 1 AS demote, parts.n AS content_parts_cleaned, p.* EXCLUDE (pkg_id, pack_id, moved, paragraph_properties_removed), CAST(paragraph_properties_removed AS BIGINT) AS paragraph_properties_removed,
        r.runs_seen, CAST(r.run_properties_removed AS BIGINT) AS run_properties_removed, coalesce(t.tables_seen, 0) AS tables_seen, coalesce(t.table_formats_preserved, 0) AS table_formats_preserved,
        CAST(coalesce(t.props, 0) + coalesce(c.props, 0) AS BIGINT) AS table_properties_removed, CAST(p.moved + r.moved + coalesce(t.moved, 0) AS BIGINT) AS styles_remapped,
        coalesce(s.n, 0) AS sections_updated, coalesce(g.n, 0) AS settings_items_imported, coalesce(d.n, 0) AS target_numbering_definitions_imported, coalesce(d.a, 0) AS target_numbering_abstracts_imported,
        CAST(seeds.seed AS BIGINT) AS heading_numbering_start
      FROM good q JOIN parts ON parts.pkg_id = q.pkg_id JOIN p ON p.pkg_id = q.pkg_id AND p.pack_id = q.pack_id JOIN r ON r.pkg_id = q.pkg_id AND r.pack_id = q.pack_id
      LEFT JOIN t ON t.pkg_id = q.pkg_id AND t.pack_id = q.pack_id LEFT JOIN c ON c.pkg_id = q.pkg_id AND c.pack_id = q.pack_id LEFT JOIN s ON s.pkg_id = q.pkg_id AND s.pack_id = q.pack_id
      LEFT JOIN g ON g.pack_id = q.pack_id LEFT JOIN d ON d.pkg_id = q.pkg_id AND d.pack_id = q.pack_id LEFT JOIN seeds ON seeds.pkg_id = q.pkg_id AND seeds.pack_id = q.pack_id""",
)
def g4(spark, d):
    """All 23 counters of every accepted transfer."""
    return applied(spark, d).statistics


@query(
    "g4_rejects", APPLY_NEEDS,
    f"""WITH {SOURCE_CTES}, {LIST_CTES}, {PLAN_CTES}
      SELECT pkg_id, base AS pack_id, demote, 'level_without_heading' AS rule, CAST(unnest(unresolved) AS INT) AS level FROM asked
      UNION ALL SELECT DISTINCT m.pkg_id, r.base, r.shift = 1, m.fault, CAST(m.desired AS INT) FROM mapped m JOIN vreq r ON r.pkg_id = m.pkg_id AND r.pack_id = m.pack_id WHERE m.fault IS NOT NULL""",
)
def g4_rejects(spark, d):
    """Pairs that no transfer is made for, with every level that stands in the way."""
    return applied(spark, d).rejects


@query(
    "g4_numbered_paragraphs", APPLY_NEEDS,
    f"""WITH {SOURCE_CTES}, {LIST_CTES}, {PLAN_CTES}
      SELECT p.pkg_id, r.base AS pack_id, r.shift = 1 AS demote, p.part, p.ord, p.peered AS mapped, CASE WHEN p.numbered THEN p.rule_num WHEN p.tout IS NULL THEN p.nn END AS new_num_id,
        n.v AS value, n.path, y.matched
      FROM plan p JOIN vreq r ON r.pkg_id = p.pkg_id AND r.pack_id = p.pack_id LEFT JOIN new_count n ON n.pkg_id = p.pkg_id AND n.pack_id = p.pack_id AND n.part = p.part AND n.ord = p.ord
      LEFT JOIN (SELECT pkg_id, pack_id, part, ord, bool_or(matched) AS matched FROM typed GROUP BY ALL) y ON y.pkg_id = p.pkg_id AND y.pack_id = p.pack_id AND y.part = p.part AND y.ord = p.ord
      WHERE p.numbered OR (p.tout IS NULL AND p.nn IS NOT NULL)""",
)
def g4_numbered(spark, d):
    """Paragraphs that end in a list: the pack's heading list or the target's own under its new id."""
    rows = applied(spark, d).paragraphs.filter("new_num_id IS NOT NULL")
    return rows.select("pkg_id", "pack_id", "demote", "part", "ord", "mapped", "new_num_id", "value", windows.path_text().alias("path"), "matched")


@query(
    "g4_imported_levels", APPLY_NEEDS,
    f"""WITH {SOURCE_CTES}, {LIST_CTES}, {PLAN_CTES},
      good AS (SELECT * FROM vreq WHERE (pkg_id, pack_id) NOT IN (SELECT (pkg_id, pack_id) FROM bad)),
      held AS (SELECT s.pack_id, n.abstract_id FROM src s JOIN pnum n ON n.pack_id = s.base UNION ALL SELECT m.pack_id, CAST(coalesce(max(CAST(n.abstract_id AS BIGINT)), 0) + 1 AS VARCHAR)
        FROM merged m JOIN src s ON s.pack_id = m.pack_id LEFT JOIN pnum n ON n.pack_id = s.base GROUP BY m.pack_id),
      firsts AS (SELECT pkg_id, pack_id, abstract_id, min(CAST(nn AS BIGINT)) AS pos FROM given WHERE nn <> '0' GROUP BY ALL),
      queue AS (SELECT pkg_id, pack_id, abstract_id, row_number() OVER (PARTITION BY pkg_id, pack_id ORDER BY pos) AS i FROM firsts),
      given_ids AS (SELECT q.pkg_id, q.pack_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS abstract_id, CAST(NULL AS VARCHAR) AS new_id, coalesce(list(h.abstract_id) FILTER (h.abstract_id IS NOT NULL), []) AS taken
        FROM (SELECT DISTINCT pkg_id, pack_id FROM queue) q LEFT JOIN held h ON h.pack_id = q.pack_id GROUP BY ALL
        UNION ALL SELECT pkg_id, pack_id, i, abstract_id, new_id, list_append(taken, new_id) FROM (
          SELECT g.pkg_id, g.pack_id, q.i, q.abstract_id, g.taken, CASE WHEN list_contains(g.taken, q.abstract_id)
            THEN CAST(coalesce(list_max(list_transform(g.taken, lambda x: CAST(x AS BIGINT))), -1) + 1 AS VARCHAR) ELSE q.abstract_id END AS new_id
          FROM given_ids g JOIN queue q ON q.pkg_id = g.pkg_id AND q.pack_id = g.pack_id AND q.i = g.i + 1)),
      newabs AS (SELECT pkg_id, pack_id, abstract_id, new_id FROM given_ids WHERE i > 0)
      SELECT a.pkg_id, q.base AS pack_id, q.shift = 1 AS demote, a.new_id AS abstract_id, l.ilvl, l.lvl_text, CAST(NULL AS VARCHAR) AS pstyle
      FROM newabs a JOIN good q ON q.pkg_id = a.pkg_id AND q.pack_id = a.pack_id JOIN lvls l ON l.abstract_id = a.abstract_id""",
)
def g4_imported_levels(spark, d):
    """Levels of the lists that come with the target: new ids, no links to styles."""
    return applied(spark, d).levels.select("pkg_id", "pack_id", "demote", "abstract_id", "ilvl", "lvl_text", "pstyle")


def applied(spark, d) -> apply_plan.Applied:
    pairs = A.requests(spark, d).withColumns({"demote": F.col("pkg_id") % 2 == 0, "keep_layout": F.col("pack_id") == "cedar"})
    lists_ = A.numbering(spark, d)
    entries = F.array(*[F.struct(F.lit(t).alias("tag"), F.expr(v).cast("string").alias("value")) for t, v in joins.TARGET_TAGS.items()])
    nodes = A.nodes(spark, d)
    targets = apply_plan.Targets(
        paragraphs=A.paragraphs(spark, d).withColumn("text", F.expr(A.TYPED_TEXT)),
        runs=A.runs(spark, d),
        boxes=nodes.filter("kind IN ('table', 'cell')"),
        sections=A.sections(spark, d).withColumn("part", F.lit("word/document.xml")),
        settings=A.docs(spark, d).select("pkg_id", F.inline(entries)),
        parts=nodes.select("pkg_id", "part").distinct(),
        styles=A.styles(spark, d),
        nums=lists_["nums"], abstracts=lists_["abstracts"], levels=lists_["levels"],
    )
    nums, effective = A.pack_lists(spark)
    authority = A.pack_authority(spark).withColumnRenamed("pkg_id", "pack_id")
    packs = Packs(
        styles=A.pack_styles(spark), authority=authority, rules=A.pack_rules(spark), used=authority.select("pack_id", "style_id"), tables=joins.pack_tables(spark),
        profiles=A.pack_profiles(spark), layouts=A.literal(spark, T.PACK_LAYOUTS, "pack_id string, idx int, width int, height int").filter("pack_id <> 'delta'"),
        settings=A.literal(spark, T.PACK_SETTINGS, "pack_id string, tag string, value string"), nums=nums.withColumnRenamed("pkg_id", "pack_id"), effective=effective,
    )
    return apply_plan.apply(pairs, targets, packs)


# --- derivation ----------------------------------------------------------------------
#
# Two requests per pack: the first and the last value that its lines ask for. Some ask for styles that are not open, some second
# requests for sizes that are not allowed.

WAVE_FIELDS = f"""SELECT pkg_id AS pack_id, style_id, {L.FIELD} AS field, {L.VALUE} AS value, ord, length(text) AS n FROM par WHERE style_id IS NOT NULL
    UNION ALL SELECT pkg_id AS pack_id, style_id, CASE length(text) % 3 WHEN 0 THEN 'numbering_format' WHEN 1 THEN 'numbering_start' ELSE 'numbering_restart' END AS field,
      CASE length(text) % 3 WHEN 0 THEN CASE WHEN length(text) % 2 = 0 THEN 'upperRoman' ELSE 'lowerLetter' END WHEN 1 THEN CAST(1 + length(text) % 7 AS STRING)
        ELSE CASE WHEN style_id = 'H1' OR length(text) % 2 = 0 THEN 'false' ELSE 'true' END END AS value, ord, length(text) AS n FROM par WHERE style_id IN ('H1', 'H2')"""
SECOND = "CASE WHEN field = 'size_pt' AND n % 3 = 0 THEN '999' ELSE value END"
WAVES = f"""SELECT pack_id, style_id, field, {{first}}(value, ord) AS v1, {{last}}({SECOND}, ord) AS v2, count(*) AS c, min(ord) AS seq FROM ({WAVE_FIELDS}) GROUP BY pack_id, style_id, field"""
LOG_CTES = f"""w AS ({WAVES.format(first="arg_min", last="arg_max")}),
    bad1 AS (SELECT DISTINCT pack_id, style_id, CASE style_id WHEN 'H3' THEN 'unknown_style' ELSE 'wrong_type' END AS rule FROM w WHERE style_id IN ('H3', 'Cell')),
    bad2 AS (SELECT DISTINCT pack_id, style_id, 'range' AS rule FROM w WHERE c > 1 AND v2 = '999' AND pack_id NOT IN (SELECT pack_id FROM bad1)),
    log AS (SELECT *, c > 1 AND pack_id NOT IN (SELECT pack_id FROM bad2) AS second FROM w WHERE pack_id NOT IN (SELECT pack_id FROM bad1)),
    final AS (SELECT pack_id, style_id, field, CASE WHEN second THEN v2 ELSE v1 END AS value FROM log),
    rev AS (SELECT pack_id, CASE WHEN bool_or(second) THEN 2 ELSE 1 END AS revision FROM log GROUP BY ALL)"""


def derived(spark, d):
    """Both requests derived through one log, which is compacted in between: (first, second)."""
    A.par(spark, d).createOrReplaceTempView("par")
    waves = settled(spark.sql(WAVES.format(first="min_by", last="max_by")))
    none = lambda t: F.lit(None).cast(t)
    sheet = A.styles(spark, d).filter("ord >= 0").withColumnRenamed("pkg_id", "pack_id").withColumn("tpr", none(props.BAG))
    open_ = settled(L.exposed(spark, d))
    ids = A.docs(spark, d).select(F.col("pkg_id").alias("pack_id"), "n_chars", "lang")
    rule = lambda style, level: F.struct(F.lit(style).alias("style_id"), F.struct(F.lit("1").alias("num_id"), F.lit(level).alias("level"), none("string").alias("number_format"),
        none("string").alias("level_text"), none("int").alias("start")).alias("rule"))
    bags = "map<string,string>"
    base = derive_plan.Base(
        styles=sheet, exposed=open_, previous=open_.select("pack_id", "style_id", F.lit(1).cast("bigint").alias("usage_count"), F.lit(False).alias("inferred"), F.lit(False).alias("configured")),
        profiles=ids.select("pack_id", F.lit("H1").alias("style_id"), none(bags).alias("ind"), none(bags).alias("spacing"), F.lit("center").alias("jc")),
        rules=ids.select("pack_id", F.inline(F.array(rule("H1", 0), rule("H2", 1)))),
        levels=effective(spark, d).filter("num_id = '1'").withColumnRenamed("pkg_id", "pack_id").select("pack_id", "num_id", "ilvl", "num_fmt", "lvl_text", "start", "lvl_restart", "start_override"),
        fonts=ids.select("pack_id", F.concat(F.lit("FACE "), (F.col("n_chars") % 20).cast("string")).alias("name")),
        candidates=ids.select("pack_id", F.lit("GridA").alias("style_id")), names=ids.select("pack_id", F.concat(F.lit("pack "), "lang").alias("name")),
    )
    log = EditLog(spark, f"{scratch(spark)}/log")
    request = lambda rows, value: rows.select("pack_id", "style_id", "field", F.col(value).alias("value"), F.col("seq").cast("int").alias("seq"))
    first = derive_plan.derive(base, log, 1, request(waves, "v1"))
    log.compact(1)
    later = waves.filter("c > 1").join(first.touched, "pack_id", "left_semi")
    return first, derive_plan.derive(base, log, 2, request(later, "v2"))


@query("g5_derive", ["doc", "par", "sty", "tprop"], L.overlay_sql("SELECT * FROM final", "s.pkg_id IN (SELECT pack_id FROM rev)", f"{LOG_CTES}, "))
def g5(spark, d):
    """Style sheets after both requests."""
    out = derived(spark, d)[1].styles
    return out.select("pack_id", "style_id", props.bag_signature(F.col("ppr")).alias("ppr"), props.bag_signature(F.col("rpr")).alias("rpr"), "edited")


@query(
    "g5_rejects", ["par"],
    f"WITH {LOG_CTES} SELECT 1 AS revision, * FROM bad1 UNION ALL SELECT 2, * FROM bad2",
)
def g5_rejects(spark, d):
    first, second = derived(spark, d)
    label = lambda out, n: out.rejects.select(F.lit(n).alias("revision"), "pack_id", "style_id", "rule")
    return label(first, 1).unionByName(label(second, 2))


@query(
    "g5_manifests", ["doc", "par", "sty"],
    f"""WITH {LOG_CTES}, last AS (SELECT l.pack_id, l.style_id, string_agg(l.field, ',' ORDER BY l.field) AS fields FROM log l JOIN rev r ON r.pack_id = l.pack_id WHERE r.revision = 1 OR l.second GROUP BY ALL),
        num AS (SELECT pack_id, style_id, string_agg(field || '=' || value, ',' ORDER BY field) AS t FROM final WHERE field LIKE 'numbering%' GROUP BY ALL),
        fonts AS (SELECT f.pack_id, string_agg(DISTINCT f.value, ',' ORDER BY f.value) AS t FROM final f JOIN doc d ON d.pkg_id = f.pack_id WHERE f.field = 'font_latin' AND lower(f.value) <> 'face ' || (d.n_chars % 20) GROUP BY ALL),
        sheet AS (SELECT pkg_id AS pack_id, count(*) AS n, count(*) FILTER (style_id <> 'H3') AS shown FROM sty GROUP BY ALL)
        SELECT r.pack_id, r.revision, 'pack ' || d.lang || ' · 自定义' AS name, (SELECT string_agg(style_id || ':' || fields, ';' ORDER BY style_id) FROM last WHERE last.pack_id = r.pack_id) AS edited,
          coalesce((SELECT string_agg(style_id || ':' || t, ';' ORDER BY style_id) FROM num WHERE num.pack_id = r.pack_id), '') AS numbering, coalesce(f.t, '') AS fonts,
          s.shown AS used_style_count, CAST(0 AS BIGINT) AS inferred_style_count, CAST(0 AS BIGINT) AS custom_style_count, s.n AS defined_style_count, s.n - s.shown AS hidden_style_count
        FROM rev r JOIN doc d ON d.pkg_id = r.pack_id JOIN sheet s ON s.pack_id = r.pack_id LEFT JOIN fonts f ON f.pack_id = r.pack_id""",
)
def g5_manifests(spark, d):
    out = derived(spark, d)[1]
    fonts = out.fonts.filter("added").groupBy(F.col("pack_id").alias("source_pack_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("fonts"))
    listed = lambda c, inner: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x["style_id"], F.lit(":"), F.array_join(inner(x["fields"]), ","))), ";"), F.lit(""))
    pairs = lambda fields: F.transform(fields, lambda f: F.concat(f["field"], F.lit("="), f["value"]))
    return out.packs.join(fonts, "source_pack_id", "left").select(
        F.col("source_pack_id").alias("pack_id"), "revision", "name", listed("edited_styles", lambda f: f).alias("edited"), listed("numbering_user_edits", pairs).alias("numbering"),
        F.coalesce("fonts", F.lit("")).alias("fonts"), "used_style_count", "inferred_style_count", "custom_style_count", "defined_style_count", "hidden_style_count",
    )


@query(
    "g5_levels", ["doc", "par", "eff"],
    f"""WITH {LOG_CTES}, n AS (SELECT pack_id, CASE style_id WHEN 'H1' THEN 0 ELSE 1 END AS ilvl, max(value) FILTER (field = 'numbering_format') AS f, CAST(max(value) FILTER (field = 'numbering_start') AS INT) AS s,
          max(value) FILTER (field = 'numbering_restart') AS r FROM final WHERE style_id IN ('H1', 'H2') GROUP BY ALL)
        SELECT r.pack_id, e.num_id, e.ilvl, coalesce(n.f, e.num_fmt) AS num_fmt, e.lvl_text, coalesce(n.s, e.start) AS start, CASE WHEN e.start_override IS NOT NULL THEN coalesce(n.s, e.start_override) END AS start_override,
          CASE n.r WHEN 'true' THEN e.ilvl WHEN 'false' THEN 0 ELSE e.lvl_restart END AS lvl_restart
        FROM rev r JOIN doc d ON d.pkg_id = r.pack_id JOIN eff e ON e.lang = d.lang AND e.num_id = '1' LEFT JOIN n ON n.pack_id = r.pack_id AND n.ilvl = e.ilvl""",
)
def g5_levels(spark, d):
    """List levels after the numbering edits of both requests."""
    return derived(spark, d)[1].levels.select("pack_id", "num_id", "ilvl", "num_fmt", "lvl_text", "start", "start_override", "lvl_restart")


@query(
    "g8_font_coverage", [],
    f"""WITH k AS (SELECT DISTINCT fam, unnest([fam, lower(p_type), fam || '-' || p_partkey]) AS s FROM (SELECT *, lower(p_brand) AS fam FROM part)),
        sk AS (SELECT s, min(fam) AS lo, max(fam) AS hi FROM k GROUP BY ALL), ck AS (SELECT {L.COMPACT.format('s')} AS c, min(fam) AS lo, max(fam) AS hi FROM k GROUP BY ALL),
        n AS (SELECT DISTINCT o_custkey AS pack_id, 'Brand#' || (11 + o_orderkey % 60) AS name FROM orders),
        x AS (SELECT *, CASE WHEN CAST(substr(name, 7) AS INT) % 10 IN (0, 6, 7, 8, 9) THEN 'brand ' || (CAST(substr(name, 7) AS INT) - 5) END AS alias FROM n),
        m AS (SELECT n.pack_id, n.name, coalesce(s.lo, c.lo, a.lo) AS lo, CASE WHEN s.lo IS NOT NULL THEN s.hi WHEN c.lo IS NOT NULL THEN c.hi ELSE a.hi END AS hi FROM x n
          LEFT JOIN sk s ON s.s = lower(n.name) LEFT JOIN ck c ON c.c = {L.COMPACT.format('n.name')} LEFT JOIN ck a ON a.c = {L.COMPACT.format('n.alias')})
        SELECT pack_id, CASE WHEN lo IS NULL THEN 'missing' WHEN lo <> hi THEN 'ambiguous' WHEN lo = lower(name) THEN 'installed' ELSE 'alias' END AS kind, count(*) AS fonts FROM m GROUP BY ALL""",
)
def g8(spark, d):
    name = F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 60 + 11).cast("string"))
    formats = A.table(spark, d, "orders").select(F.col("o_custkey").alias("pack_id"), name.alias("font_latin"), F.lit(None).cast("string").alias("font_east_asia"))
    # A name that ends in 6 to 9 or 0 is also known by the one five before it.
    number = F.substring("font_latin", 7, 3).cast("int")
    aliases = formats.select(alias_key(F.col("font_latin")).alias("key"), F.concat(F.lit("brand "), (number - 5).cast("string")).alias("alias")).filter((number % 10 == 0) | (number % 10 > 5)).distinct()
    return font_plan.coverage(formats, aliases, faces(spark, d))
